"""The conversation trie against brute force and its SQL."""

import hashlib
import random
import zlib

import compare
import pytest
from brute import words
from pyspark.sql import functions as F

from folioscope.llm import conversation_trie
from folioscope.llm.catalog import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, depth long, code long, key string"


def nodes_of(rows, rebuild):
    """Every node from sets of prefixes."""
    told = {}
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", said(r))):
        told.setdefault(conv, []).append((role or "", text or ""))
    if rebuild:
        head = {c: zlib.crc32(str(c).encode()) % 4 for c in told}
        told = {c: tuple(told.get(c - c % 20, [])[: head[c]] + own[head[c] :]) for c, own in told.items()}
    told = {c: tuple(t) for c, t in told.items()}
    members = {}
    for c, t in told.items():
        for d in range(len(t) + 1):
            members.setdefault(t[:d], []).append(c)
    out = set()
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        children = [p for p in below if len(p) == len(path) + 1]
        leaves = sum(not any(q[: len(p)] == p and len(q) > len(p) for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * len(words(p[-1][1])) for p in below if p)
        ends = ",".join(str(c) for c in sorted(convs) if told[c] == path)
        parent = min(members[path[:-1]]) if path else None
        out.add((min(convs), len(path), parent, len(convs), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def said(row):
    role, text = row[2] or "", row[3] or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def random_rows(n, seed):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(3 * n), n):
        for turn in range(pick.randint(1, 6)):
            rows.append((c, pick.choice([turn, turn, turn, None, 0]), pick.choice(["user", "tool", None]), pick.choice(["a", "a", "b c", None, ""])))
    return rows + rows[:5]


def result(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


@pytest.mark.parametrize("shard_turns", [5, 40, 100_000])
@pytest.mark.parametrize("rebuild", [False, True])
def test_nodes_are_brute_force_s(spark, rebuild, shard_turns, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BYTES", 60)
    rows = random_rows(150, 7)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)
    got = result(conversation_trie.conversation_trie(df, rebuild, shard_turns))
    assert len(got) == len(set(got))
    assert set(got) == nodes_of(rows, rebuild)


def test_conversations_that_are_all_alike_go_over_many_shards(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "PIECE_BYTES", 60)
    rows = [(c, t, "user", f"turn {t}") for c in range(400) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = result(conversation_trie.conversation_trie(df, shard_turns=50))
    ids = hashlib.sha256(",".join(map(str, range(400))).encode()).hexdigest()
    assert sorted(got) == [
        (0, 0, None, 400, 1, 1, 3 * 399 * 2, conversation_trie.NO_ENDS),
        (0, 1, 0, 400, 1, 1, 3 * 399 * 2, conversation_trie.NO_ENDS),
        (0, 2, 0, 400, 1, 1, 2 * 399 * 2, conversation_trie.NO_ENDS),
        (0, 3, 0, 400, 0, 1, 399 * 2, ids),
    ]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "no conversation"), (1, None, None, None), (1, 0, "user", "x y"), (2, 0, None, ""), (2, 5, "user", "x y"), (3, 1, "u", "ser")]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    assert set(result(conversation_trie.conversation_trie(df))) == nodes_of(rows, False)
    assert result(conversation_trie.conversation_trie(df.limit(0))) == []
    assert result(conversation_trie.conversation_trie(df.where(F.col("conv_id").isNull()))) == []


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_the_query_is_its_sql_s(spark, sf):
    ok, note = compare.compare(spark, compare.connect(sf), "op13_conversation_trie", sf)
    assert ok, note
    if sf.endswith("0.001"):
        rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
        assert set(result(QUERIES["op13_conversation_trie"](spark, sf))) == nodes_of(rows, True)
