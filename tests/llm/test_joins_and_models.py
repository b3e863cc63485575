"""Shingle join, top-k, packing, language model, pipeline: brute force and odd input."""

import itertools
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from brute import DOCUMENTS, components, shingles, unigram
from tokenizers import Tokenizer

import corpus_pipeline
from folioscope.llm import hidden_markov, maxscore, packing, shingle_join
from folioscope.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"
JSON = public_tokenizers.path("byte_bpe_50k.json")


def variants(seed: int, groups: int, size: int) -> dict[int, str]:
    """Groups of texts that differ by a few words, around the least similarity."""
    pick = random.Random(seed)
    out = {}
    for g in range(groups):
        base = [f"w{pick.randrange(400)}" for _ in range(pick.choice([3, 8, 40, 90]))]
        for _ in range(size):
            own = list(base)
            for _ in range(pick.choice([0, 0, 1, 2, 3])):
                own[pick.randrange(len(own))] = f"w{pick.randrange(400)}"
            own = own[pick.choice([0, 0, 1, 4]) :]
            out[len(out) + 1] = " ".join(own)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_are_brute_force_s(spark, seed):
    texts = variants(seed, 12, 14)
    rows = shingle_join.link_documents(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in rows} == components(texts)
    assert {r.doc_id: r.n_shingles for r in rows} == {i: len(shingles(t)) for i, t in texts.items()}


def test_components_of_the_corpus(spark, texts):
    rows = QUERIES["op8_shingle_join"](spark, SF).collect()
    assert {r.doc_id: r.component_id for r in rows} == components(texts)


def test_components_of_odd_rows(odd_documents, no_documents):
    rows = shingle_join.link_documents(odd_documents).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id != 4) == sorted(
        (i is None, i, len(shingles(t)), 5 if i == 6 else i) for i, t in DOCUMENTS if i != 4
    )
    assert shingle_join.link_documents(no_documents).count() == 0
    assert shingle_join.one_of_each(odd_documents).count() == len(DOCUMENTS) - 2


def test_top_k_is_brute_force_s(spark):
    pick = np.random.default_rng(5)
    vectors = {i: pick.integers(-9, 10, 6).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    rows = maxscore.top_k(df, df.where("vec_id % 7 = 0"), 5).collect()
    want = set()
    for q in range(0, 300, 7):
        scored = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scored, 1)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in rows} == want


def test_top_k_of_odd_vectors(spark):
    rows = [
        (0, [0.5, 0.5]), (1, None), (2, []), (3, [0.1, None]), (4, [float("nan"), 0.1]), (5, [float("inf"), 1.0]),
        (6, [0.5, 0.5]), (6, [0.5, 0.5]), (7, [-0.5, -0.5]), (8, [0.5]), (None, [0.5, 0.5]), (9, [0.5, 0.5]),
    ]
    df = spark.createDataFrame([(i, v, i) for i, v in rows], "vec_id long, embedding array<double>, score long")
    clean = maxscore.scaled(df)
    got = sorted(maxscore.top_k(clean, clean.where("vec_id in (0, 8)"), 5).collect(), key=lambda r: (r.query_id, r["rank"]))
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [
        (0, 1, 6, 32768), (0, 2, 9, 32768), (0, 3, 7, -32768),
    ]
    assert maxscore.top_k(clean.limit(0), clean.limit(0)).count() == 0


def test_top_k_shuffles_its_blocks(spark, monkeypatch):
    """Blocks are repeated for each shard: broadcast, they would go through the driver once for each."""
    monkeypatch.setattr(maxscore, "SHARD_ROWS", 30)
    monkeypatch.setattr(maxscore, "BLOCK_ROWS", 20)
    pick = np.random.default_rng(6)
    vectors = {i: pick.integers(-300, 300, 6).tolist() for i in range(300)}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, v array<long>")
    found = maxscore.top_k(df, df.where("vec_id % 5 = 0"), 3)
    got = {(r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    for q in range(0, 300, 5):
        best = sorted((-int(np.dot(vectors[q], v)), i) for i, v in vectors.items() if i != q)[:3]
        assert {r for r in got if r[0] == q} == {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}


@pytest.mark.parametrize(("most", "width"), [(127, 1), (-128, 1), (128, 2), (1 << 15, 4), (-(1 << 31), 4), (1 << 31, 8), (-(1 << 63), 8)])
def test_packed_vectors_take_the_least_width(spark, most, width):
    df = spark.createDataFrame([(3, [1, most, 0]), (4, [5]), (5, [])], "vec_id long, v array<long>")
    row = maxscore._packed(df, 1, "shard").first()
    assert len(row.flat) == 4 * width
    back = maxscore._unpacked(row["ids"], row.sizes, row.flat)
    assert {n: (i.tolist(), v.tolist()) for n, (i, v) in back.items()} == {0: ([5], [[]]), 1: ([4], [[5]]), 3: ([3], [[1, most, 0]])}


def test_top_k_matches_its_sql(spark):
    import compare

    ok, note = compare.compare(spark, compare.connect(SF), "op5_maxscore", SF)
    assert ok, note


def encoded(text):
    return [*Tokenizer.from_file(JSON).encode(text or "", add_special_tokens=False).ids, 2]


def check_packing(rows, ids_of, room=1024):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids_of)
    for doc, pieces in by_doc.items():
        ids, at = ids_of[doc], 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r.piece)):
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.piece, r.start, r.ids_crc32) == (k, at, zlib.crc32(part))
            at += r.length
        assert at == len(ids) and len(pieces) == math.ceil(len(ids) / room)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= room
    return len(by_sequence)


def test_packing_of_the_corpus(spark, texts):
    rows = QUERIES["op10_packing"](spark, SF).collect()
    n = check_packing(rows, {i: encoded(t) for i, t in texts.items()})
    assert n <= math.ceil(sum(r.length for r in rows) / 1024) + 2


def test_packing_of_odd_rows(odd_documents, no_documents):
    once = odd_documents.where("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.packed(once, JSON).collect(), {i: encoded(t) for i, t in DOCUMENTS if i is not None})
    assert packing.packed(odd_documents, JSON).groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
    assert packing.packed(no_documents, JSON).count() == 0


def test_encoder_agrees_with_the_tokenizer():
    pick = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", ".", " .", "!", "'s", "'", "é", " ", "　", "\x1c", "<|endoftext|>", "1", "²", "_", "日本", "\U0001f642", "\r\n", "it's", "--"]
    own, theirs = packing.Encoder(JSON), Tokenizer.from_file(JSON)
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randint(0, 12)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_fullest_set_is_the_best_of_all():
    pick = random.Random(4)
    for _ in range(200):
        room = pick.randint(1, 30)
        counts = np.zeros(room + 1, np.int64)
        for _ in range(pick.randint(0, 6)):
            counts[pick.randint(1, room)] += 1
        items = [n for n in range(1, room + 1) for _ in range(counts[n])]
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        got = packing.fullest(counts, room)
        assert sum(got) == best and all(got.count(n) <= counts[n] for n in set(got))


def test_unigram_scores_are_brute_force_s(spark, texts):
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    rows = QUERIES["op3_hidden_markov"](spark, SF).collect()
    train = [t for i, t in texts.items() if not held[i]]
    assert {r.doc_id: r.held_out for r in rows} == held
    for r in random.Random(1).sample(rows, 25):
        n, known, total, score = unigram(train, texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(score, rel=1e-9)


def test_hidden_states_predict_better_than_words_alone(spark):
    got = QUERIES["op3_hidden_markov"](spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum()


def test_likelihood_and_counts_over_all_paths(monkeypatch):
    monkeypatch.setattr(hidden_markov, "CLASSES", 6)
    monkeypatch.setattr(hidden_markov, "SPAN", 3)
    pick, k = np.random.default_rng(1), 3
    model = hidden_markov.Hmm(pick.dirichlet(np.ones(k)), pick.dirichlet(np.ones(k), size=k), pick.dirichlet(np.ones(6), size=k))
    sequences = [pick.integers(0, 6, size=n) for n in (1, 4, 7, 2, 7)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sequences])))
    flat = np.concatenate(sequences)
    start, step, emit, logs = np.zeros(k), np.zeros((k, k)), np.zeros((6, k)), []
    for s in sequences:
        paths = {}
        for z in itertools.product(range(k), repeat=len(s)):
            p = model.start[z[0]] * model.emit[z[0], s[0]]
            for i in range(1, len(s)):
                p *= model.step[z[i - 1], z[i]] * model.emit[z[i], s[i]]
            paths[z] = p
        total = sum(paths.values())
        logs.append(math.log(total))
        for z, p in paths.items():
            start[z[0]] += p / total
            for i in range(len(s)):
                emit[s[i], z[i]] += p / total
                if i:
                    step[z[i - 1], z[i]] += p / total
    got = hidden_markov.expected(model, flat, bounds)
    assert hidden_markov.forward(model, flat, bounds) == pytest.approx(logs)
    assert got.start == pytest.approx(start) and got.step == pytest.approx(step) and got.emit == pytest.approx(emit)


def test_forward_values_are_scaled_at_few_steps_and_stay_in_range(monkeypatch):
    monkeypatch.setattr(hidden_markov, "CLASSES", 3)
    # Each step asks for the least transition, and one class is nearly never emitted.
    rare, seldom = 1e-12, 1e-200
    model = hidden_markov.Hmm(
        np.array([0.5, 0.5]), np.array([[1 - rare, rare], [rare, 1 - rare]]),
        np.array([[1 - 1e-30, 1e-30, seldom], [1e-30, 1 - 1e-30, seldom]]),
    )
    sequences = [np.arange(n) % 2 for n in (1, 16, 17, 700, 9000)] + [np.full(40, 2)]
    bounds = np.concatenate(([0], np.cumsum([len(s) for s in sequences])))
    flat = np.concatenate(sequences)
    want = []
    for s in sequences:
        logs = np.log(model.start) + np.log(model.emit[:, s[0]])
        for c in s[1:]:
            logs = np.logaddexp(logs[0] + np.log(model.step[0]), logs[1] + np.log(model.step[1])) + np.log(model.emit[:, c])
        want.append(np.logaddexp(*logs))
    assert hidden_markov.forward(model, flat, bounds) == pytest.approx(want)
    got = hidden_markov.expected(model, flat, bounds)
    assert got.loglik == pytest.approx(sum(want))
    assert got.emit.sum(axis=1) == pytest.approx(np.bincount(flat)) and got.step.sum() == pytest.approx(len(flat) - 6)
    span = hidden_markov._Group(model, flat, bounds, np.argsort(np.diff(bounds), kind="stable")).ahead(0, None)
    assert len(span.scaled) < len(span.cls) / 8


def test_the_end_counts_where_words_are_more_frequent(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "a b c " * 50, False), (2, "a b b a", True), (3, "", True)], "doc_id long, text string, held boolean"
    )
    monkeypatch.setattr(hidden_markov, "FREQUENT", 2)
    got = {r.doc_id: r for r in hidden_markov.score(docs, "held").collect()}
    for i, text in ((1, "a b c " * 50), (2, "a b b a"), (3, "")):
        n, known, total, score = unigram(["a b c " * 50], text)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(score, rel=1e-9)


def test_every_round_of_training_sees_every_row(spark):
    pick = np.random.default_rng(2)
    texts = [np.append(pick.integers(1, 9, size=pick.integers(1, 6)) + (8 if i % 2 else 0), 0) for i in range(3000)]
    rows = [(i, t.astype("<u2").tobytes()) for i, t in enumerate(texts)]
    flat, bounds = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    total = np.bincount(flat, minlength=hidden_markov.CLASSES)
    none = np.zeros(0, np.int64)
    counts = hidden_markov.Counts(len(flat), 17, none.view(np.uint64), none, total, (total > 0).astype(np.int64))
    model = hidden_markov.initial(counts)
    assert hidden_markov.ROUNDS >= 3
    for _ in range(hidden_markov.ROUNDS):
        model = hidden_markov.updated(hidden_markov.expected(model, flat, bounds), counts)
    got = hidden_markov.baum_welch(spark.createDataFrame(rows, "row long, classes binary"), counts)
    for a, b in zip(got, model, strict=True):
        assert a == pytest.approx(b, rel=1e-6)


def test_language_model_of_odd_rows(odd_documents, no_documents):
    from pyspark.sql import functions as F

    rows = hidden_markov.score(odd_documents.withColumn("held", F.lit(False)), "held").collect()
    assert len(rows) == len(DOCUMENTS) and all(math.isfinite(r.score) and r.score < 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    unseen = hidden_markov.score(odd_documents.withColumn("held", F.lit(True)), "held").collect()
    assert len(unseen) == len(DOCUMENTS) and {r.train_tokens for r in unseen} == {0} and {r.n_known for r in unseen} == {0}
    assert hidden_markov.score(no_documents.withColumn("held", F.lit(False)), "held").count() == 0


def test_pipeline_is_its_operators(spark, documents, texts):
    from folioscope.llm import quality_rules, toxicity

    good = {r.doc_id for r in quality_rules.judge(documents, quality_rules.fitted(spark, SF, documents)).where("kept").collect()}
    kept = documents.where(documents.doc_id.isin(list(good)))
    model = toxicity.fitted(spark, SF, kept)
    clean = {r.doc_id for r in toxicity.score(kept, model).where("predicted = 0").collect()}
    first = {i for i, c in components({i: texts[i] for i in clean}).items() if i == c}
    rows = corpus_pipeline.run(spark, SF).collect()
    check_packing(rows, {i: encoded(texts[i]) for i in first})


def test_pipeline_stages_keep_the_columns(spark, odd_documents, documents):
    docs = documents
    for _, step in corpus_pipeline.STAGES[:-1]:
        docs = step(spark, docs, SF)
        assert docs.columns == documents.columns
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, odd_documents, SF).count() >= 0, name
        assert step(spark, odd_documents.limit(0), SF).count() == 0, name
