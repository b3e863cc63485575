"""Languages against packing by brute force; many languages of long texts; languages of little text."""

import zstandard

from folioscope.llm import language
from folioscope.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def packed_sizes(model, text):
    """Bytes of a text behind each language's dictionary, every piece packed anew by its own compressor."""
    plain = language.prepared(text)
    pieces = [plain[i : i + language.PIECE_BYTES] for i in range(0, len(plain), language.PIECE_BYTES)]
    out = {}
    for k, content in model.dictionaries.items():
        raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out[k] = sum(len(zstandard.ZstdCompressor(level=language.LEVEL, dict_data=raw).compress(p)) for p in pieces)
    return out


def test_wide_margins_are_brute_force_s(spark, documents, texts):
    from folioscope.llm.shared import fold

    model = language.fit(documents.where(fold("doc_id", 5) != 0))
    got = {r.doc_id: r for r in QUERIES["op4_language"](spark, SF).collect()}
    wide = 0
    for i, text in texts.items():
        sizes = sorted(packed_sizes(model, text).items(), key=lambda x: x[1])
        if sizes[1][1] > 1.05 * sizes[0][1]:
            wide += 1
            assert got[i].lang_pred == sizes[0][0]
    assert wide > 100


def test_sixty_languages_of_long_texts(spark):
    word = lambda i, k: "".join(chr(97 + (i * 7 + k * j) % 26) for j in range(1, 7))
    rows = [(60 * t + i, " ".join(word(i, t + k) for k in range(12_000)), f"l{i}") for i in range(60) for t in range(6)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.dictionaries) == 60
    assert all(language.DICTIONARY_BYTES * 0.9 < len(d) <= language.DICTIONARY_BYTES + 300 for d in model.dictionaries.values())


def test_a_language_of_one_letter_can_be_predicted(spark):
    rows = [(1, "a", "aa"), (2, "bcd efg hij klm nop " * 30, "bb"), (3, "12", "cc")]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(model.dictionaries) == ["aa", "bb"]
    assert language.Packer(model).verdict("a a a a a a a a a")[0] == "aa"


def test_shares_fill_a_dictionary():
    assert language.shares([10, 500, 5000], 1000) == [333, 495, 495]
    assert language.shares([], 1000) == [] and sum(language.shares([200] * 40, 1000)) >= 1000
