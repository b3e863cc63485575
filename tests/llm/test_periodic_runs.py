"""Periodic runs against brute force: the solver, the query, and tiles of every size."""

import hashlib
import random
import zlib

import numpy as np
from brute import DOCUMENTS, WORD
from hypothesis import given, settings
from hypothesis import strategies as st

from folioscope.llm import periodic_runs
from folioscope.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def all_runs(words):
    """(start, length, period) of every run, each period tried at each place."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(12, 2 * q):
                span = words[i : j + q]
                if not any(span[p:] == span[:-p] for p in range(1, q)):
                    out.append((i, j + q - i, q))
            i = max(i + 1, j)
    return sorted(out, key=lambda r: (r[0], r[2]))


def answer(doc_id, text, rearranged):
    words = WORD.findall(text or "")
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if rearranged and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = all_runs(words)
    dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    most = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{m},{q}\n" for s, m, q in runs)
    return (doc_id, len(runs), *most, *(hashlib.sha256(x.encode()).hexdigest() for x in (listed, kept)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=90), st.integers(1, 40), st.integers(1, 4))
def test_runs_of_a_line_are_brute_force_s(root, repeats, kinds):
    words = [w % kinds for w in root] * (1 + repeats % 5) + [w % kinds for w in root[: repeats]]
    found = periodic_runs.solve(np.array(words, np.int64), 1, len(words) // 2 + 1)
    got = sorted(zip(found.start.tolist(), (found.end - found.start).tolist(), found.period.tolist(), strict=True), key=lambda r: (r[0], r[2]))
    assert got == all_runs(words)


def test_a_false_match_of_hashes_is_cut_by_the_words():
    codes = np.array([*range(20), *range(20), 5, *range(20), *range(20), *range(20)])
    text = periodic_runs.Stretch(codes)
    claimed = periodic_runs.Runs(*np.array([[20], [0], [len(codes)]]))
    exact = periodic_runs._exact(text, claimed)
    assert [tuple(c.tolist()) for c in exact] == [(20, 20), (0, 41), (40, 101)]


def test_the_query_is_brute_force_s(spark, texts):
    got = {tuple(r) for r in QUERIES["op12_periodic_runs"](spark, SF).collect()}
    short = {i: t for i, t in texts.items() if len(WORD.findall(t or "")) < 700}
    assert len(got) == len(texts) and len(short) > 150
    assert {r for r in got if r[0] in short} == {answer(i, t, True) for i, t in short.items()}


def tiled_texts():
    pick, rows = random.Random(3), []
    for i in range(40):
        words = [pick.choice("abcdefghij"[: 1 + i % 10]) for _ in range(pick.randint(200, 1500))]
        for _ in range(3):
            at, p = pick.randrange(len(words)), pick.randint(1, 400)
            for k in range(at + p, min(len(words), at + p * pick.randint(2, 9))):
                words[k] = words[k - p]
        rows.append((i, " ".join(words)))
    return [*rows, (40, "same " * 3000)]


def test_tiles_of_any_size_give_the_same(spark):
    docs = spark.createDataFrame(tiled_texts(), "doc_id long, text string")
    whole = sorted(periodic_runs.find_runs(docs).collect())
    assert sum(r.n_runs for r in whole) > 40 and max(r.period or 0 for r in whole) > 150
    for size in (128, 512, 8192):
        assert sorted(periodic_runs.find_runs(docs, long_bytes=300, tile=size).collect()) == whole
    assert [tuple(r) for r in whole if r.doc_id % 8 == 0 and r.doc_id < 40] == [
        answer(i, t, False) for i, t in tiled_texts() if i % 8 == 0 and i < 40
    ]


def test_odd_rows(odd_documents, no_documents):
    short = [(i, t) for i, t in DOCUMENTS if i != 4]
    for long_bytes in (1 << 16, 0):
        rows = periodic_runs.find_runs(odd_documents, long_bytes=long_bytes).collect()
        assert len(rows) == len(DOCUMENTS)
        got = sorted((tuple(r) for r in rows if r.doc_id != 4), key=repr)
        assert got == sorted((answer(i, t, False) for i, t in short), key=repr)
        # Pairs of words come again after 977 * 13 of them, and not before.
        assert [(r.n_runs, r.start, r.period) for r in rows if r.doc_id == 4] == [(1, 0, 2 * 977 * 13)]
    assert periodic_runs.find_runs(no_documents).count() == 0
