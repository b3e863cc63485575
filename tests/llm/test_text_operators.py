"""Language, token counts, pieces, quality, toxicity, licences: brute force, held-out rows, odd input."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from brute import DOCUMENTS, measures
from pyspark.sql import functions as F

from folioscope.llm import language, licence_scan, piece_transducer, quality_rules, token_counts, toxicity
from folioscope.llm.catalog import QUERIES
from folioscope.llm.transducers import Transducer

SF = "/root/testdata/sf0.001"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ROWS = len(DOCUMENTS)


@pytest.fixture(scope="module")
def pieces():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def mixed_texts(n: int, seed: int) -> list[str]:
    pick = random.Random(seed)
    parts = "ab the  in▁<s></s>éß①日本語の🙂\n\tzz  --==!!..12ABxy"
    return ["".join(pick.choice(parts) for _ in range(pick.randint(0, 40))) for _ in range(n)]


def test_languages_of_rows_held_out(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = QUERIES["op4_language"](spark, "/root/testdata/sf0.01").join(documents.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("ok")).toPandas()
    assert held.ok.mean() > 0.95
    assert got.where("score < 0 or score > 1").count() == 0


def test_language_of_odd_rows(odd_documents, no_documents):
    none = language.fit(no_documents)
    assert {r.lang_pred for r in language.identify(odd_documents, none).collect()} == {"und"}
    model = language.Model({"aa": b"the same short text, twice in the table " * 9, "bb": b"zyx wvu tsr qpo nml kji hgf edc ba " * 9})
    rows = language.identify(odd_documents, model, reject=False).collect()
    assert len(rows) == ROWS
    by = {r.doc_id: r.lang_pred for r in rows}
    assert [by[i] for i in (1, 2, 3)] == ["und"] * 3 and by[5] == by[6] == "aa"
    assert language.identify(no_documents, model).count() == 0


def test_a_tie_goes_to_the_first_language_and_is_not_certain():
    packer = language.Packer(language.Model({"b": b"x" * 64, "a": b"x" * 64}))
    assert packer.verdict("some text")[0] == "a"
    assert packer.verdict("some text")[2] is False


def test_token_counts_are_the_library_s(spark, texts, pieces):
    got = {r.doc_id: r for r in QUERIES["op9_token_counts"](spark, SF).collect()}
    assert {i: r.n_tokens for i, r in got.items()} == {i: len(pieces.encode(t)) for i, t in texts.items()}
    assert all(r.n_bytes == len(texts[i].encode()) and r.over_limit == (r.n_tokens > 4096) for i, r in got.items())


def test_token_counts_of_mixed_and_odd_texts(odd_documents, no_documents, pieces):
    counter = token_counts.Counter(MODEL)
    some = mixed_texts(3000, 1)
    assert counter.lengths(some) == [len(x) for x in pieces.encode(some)]
    rows = token_counts.count_tokens(odd_documents, MODEL, 4096).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(pieces.encode(t or "")) for _, t in DOCUMENTS)
    assert token_counts.count_tokens(no_documents, MODEL, 4096).count() == 0


def test_pieces_are_the_library_s_and_decode(pieces):
    encoder, decoder = piece_transducer.Encoder(MODEL), piece_transducer.Decoder(MODEL)
    for text in mixed_texts(1500, 2):
        ids = encoder.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == pieces.encode(text)
        assert decoder.decode(ids) == pieces.decode(pieces.encode(text)) == text.replace("▁", " ")


def test_pieces_of_tables(spark, documents, odd_documents, no_documents, texts, pieces):
    assert QUERIES["op6_piece_transducer"](spark, SF).where("not round_trip").count() == 0
    encoded = piece_transducer.encode(documents, MODEL)
    assert {r.doc_id: r.ids for r in encoded.collect()} == {i: pieces.encode(t) for i, t in texts.items()}
    assert {r.doc_id: r.text for r in piece_transducer.decode(encoded, MODEL).collect()} == texts
    assert piece_transducer.digests(odd_documents, MODEL).where("round_trip").count() == ROWS
    assert piece_transducer.encode(no_documents, MODEL).count() == 0


def test_unigram_models_take_the_cheapest_path():
    encoder = piece_transducer.Encoder(MODEL)
    encoder.spec = encoder.spec._replace(kind=piece_transducer.UNIGRAM)
    encoder._id = {"a": 0, "b": 1, "ab": 2, "abb": 3}
    encoder._score = np.array([-1.0, -1.0, -1.5, -4.0])
    assert encoder.path("abb") == ["ab", "b"]


def test_quality_measures_are_brute_force_s(spark, texts):
    for r in QUERIES["op2_quality_rules"](spark, SF).collect():
        n, chars, symbols, lines, repeated = want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 50 or 100 * repeated > 50 * n)
        assert not (r.base_failed and r.kept)


def test_quality_verdicts_follow_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op2_quality_rules"](spark, sf).where("not base_failed")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    both = got.join(labels, "doc_id").toPandas()
    assert (both.kept == (both.quality == 1)).mean() > 0.95


def test_quality_of_odd_rows(odd_documents, no_documents):
    model = quality_rules.fit(no_documents.select("text", F.lit(1).alias("label")))
    rows = quality_rules.judge(odd_documents, model).collect()
    assert sorted((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows) == sorted(
        measures(t) for _, t in DOCUMENTS
    )
    assert not any(r.kept for r in rows if r.n_words < 50)
    assert quality_rules.judge(no_documents, model).count() == 0
    assert quality_rules.kept_only(odd_documents, model).columns == odd_documents.columns


def test_toxicity_of_rows_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op1_toxicity"](spark, sf).where("held_out")
    both = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    hit = ((both.predicted == 1) & (both.toxic == 1)).sum()
    assert hit / (both.toxic == 1).sum() > 0.85 and hit / (both.predicted == 1).sum() > 0.85


def test_toxicity_of_odd_rows(odd_documents, no_documents):
    model = toxicity.fit(no_documents.select("text", F.lit(1).alias("label")))
    rows = toxicity.score(odd_documents, model).collect()
    assert len(rows) == ROWS and all(0 <= r.score <= 1 and r.predicted == 0 for r in rows)
    assert toxicity.score(no_documents, model).count() == 0
    assert toxicity.clean_only(odd_documents, model).count() == ROWS


def outputs(clause: str) -> list[str]:
    reader = toxicity.Reader(toxicity.Model({"idiot": 3.0}, toxicity.PRIOR_WEIGHTS))
    return [o for hits, _ in reader.clauses(clause) for o in hits]


@pytest.mark.parametrize(
    ("clause", "want"),
    [
        ("what an idiot", ["plain"]),
        ("you are an idiot", ["aimed"]),
        ("he is no idiot", ["denied"]),
        ("the report said such an idiot", ["reported"]),
        ("i will kill you", ["menace"]),
        ("kill the lights in here now please you", []),
        ("nobody will kill you", ["denied"]),
        ("said nothing. an idiot", ["plain"]),
    ],
)
def test_grammar_reads_clauses(clause, want):
    assert outputs(clause) == want


def test_composition_and_cheapest_path():
    a = Transducer(0)
    a.add(0, "x", "y", 1.0, 0)
    a.add(0, "x", "z", 0.5, 1)
    b = Transducer(0, [0])
    b.add(0, "y", "p", 0.0, 0)
    b.add(0, "z", "q", 2.0, 0)
    both = a.composed(b, ["x"])
    assert both.shortest(["x"]) == (1.0, ["p"])
    assert both.shortest([]) == (0.0, [])
    assert both.shortest(["unknown"]) is None


def test_licences_found_by_line(spark, documents):
    model = licence_scan.fit(documents)
    planted = [
        (1, "Some prose of the corpus here.\nReleased under the MIT License.\nMore prose."),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        (3, "She renewed her driver's license at the office."),
        (4, "Licensed under CC BY-NC 4.0.\n\nLicensed under the Apache License, Version 2.0."),
        (5, None),
        (6, ""),
    ]
    rows = licence_scan.notices(spark.createDataFrame(planted, "doc_id long, text string"), model).collect()
    assert sorted((r.doc_id, r.line, r.family) for r in rows) == [
        (1, 1, "MIT"), (2, 0, "MIT"), (4, 0, "CC-BY-NC"), (4, 2, "Apache-2.0"),
    ]
    by = dict(planted)
    for r in rows:
        assert by[r.doc_id].encode()[r.start : r.end].decode() == by[r.doc_id].split("\n")[r.line]


def test_licences_of_corpus_and_odd_rows(spark, documents, odd_documents, no_documents, texts):
    lines = {
        "This work is licensed under the GNU General Public License, version 3.": "GPL",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    }
    got = {r.doc_id: r.families for r in QUERIES["op7_licence_scan"](spark, SF).collect()}
    assert got == {i: " ".join(sorted({lines[x] for x in t.split("\n") if x in lines})) for i, t in texts.items()}
    model = licence_scan.fit(no_documents)
    assert licence_scan.notices(odd_documents, model).count() == 0
    assert licence_scan.notices(no_documents, model).count() == 0


def test_lines_are_numbered_and_bounded():
    _, found = licence_scan.lines(pa.array(["a b\n\nc", None, "", "\nd"]))
    assert list(zip(found.text.tolist(), found.number.tolist(), strict=True)) == [(0, 0), (0, 2), (3, 1)]


def test_quality_fit_hashes_texts_in_parallel(spark):
    rows = [(f"text number {i} " + ("good words " if i % 2 else "bad ones ") * 9, i % 2) for i in range(64)]
    sample = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "text string, label int")
    spark.sparkContext.setJobGroup("quality-fit", "")
    try:
        model = quality_rules.fit(sample)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    seen = spark.sparkContext.statusTracker()
    stages = [seen.getStageInfo(i) for j in seen.getJobIdsForGroup("quality-fit") for i in seen.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) >= 4
    assert model.weights.any()


def test_rare_languages_keep_all_texts_and_ends_are_learned(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in (2, 1, 0)) * 2
    rows = [(i, f"{word(i)} is said", "aa") for i in range(200)]
    rows += [(1000 + i, "opening " * 400 + f"ending{word(i)}", "bb") for i in range(300)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert all(word(i).encode() in model.dictionaries["aa"] for i in range(200))
    ends = sum(f"ending{word(i)}".encode() in model.dictionaries["bb"] for i in range(300))
    assert ends == language.TEXTS_PER_LANGUAGE and len(model.dictionaries["bb"]) <= language.DICTIONARY_BYTES + 300
