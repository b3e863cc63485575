"""Language by compression: the language whose raw-content dictionary packs a text smallest."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import fold, table
from folioscope.llm.vectext import slices
from folioscope.staging import stage

#: Texts per language that a dictionary is cut from, and its size in bytes.
TEXTS_PER_LANGUAGE = 256
DICTIONARY_BYTES = 112 << 10
#: Places, evenly across a text, that its share of a dictionary comes from.
PLACES = 4
#: Parts that a language's ids are ranked in before the best of all parts are.
PARTS = 32
#: A text is packed in pieces of so many bytes, so that it leans on the dictionary, not on itself.
PIECE_BYTES = 2048
LEVEL = 6
#: Where that leaves a narrow margin, each piece is packed anew, repeated so often: a frame too
#: short to shrink is stored as it is, which hides what the dictionary would have saved.
REPEATS = 8
#: Below this relative gap between the best and the second best size, a verdict is not certain.
NARROW = 0.01
#: How many of the saved bits count as evidence in the score.
EVIDENCE = 0.05

LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


class Model(NamedTuple):
    """Raw dictionary content by language."""

    dictionaries: dict[str, bytes]


def prepared(text: str) -> bytes:
    """Lower case, with every ASCII character that is no letter blanked."""
    return text.lower().encode("utf-8", "replace").translate(_BLANK)


def spread(plain: bytes, share: int) -> bytes:
    """At most ``share`` bytes of a text, from PLACES places evenly across it."""
    if len(plain) <= share:
        return plain
    size = (share - PLACES + 1) // PLACES
    last = len(plain) - size
    return b" ".join(plain[at : at + size] for at in (i * last // (PLACES - 1) for i in range(PLACES)))


def shares(lengths: list[int], size: int = DICTIONARY_BYTES) -> list[int]:
    """Bytes that texts of these ascending lengths may each take of a dictionary: equal shares of what is left."""
    out, left = [], size
    for i, n in enumerate(lengths):
        share = max(64, left // (len(lengths) - i)) if left > 0 else 0
        out.append(share)
        left -= n if n <= share else PLACES * ((share - PLACES + 1) // PLACES) + PLACES - 1
    return out


def _long_enough(content: bytes) -> bytes:
    """A dictionary has eight bytes at least; shorter content is repeated."""
    return content if len(content) >= 8 else b" ".join([content] * 8)


def fit(docs: DataFrame, lang: str = "lang") -> Model:
    """Learn a dictionary for each value of ``lang`` from (doc_id, text, lang).

    Rows with a null language or text teach nothing. The ``TEXTS_PER_LANGUAGE`` ids of a language
    whose hashes are least are gathered, first in parts, so that a frequent language is not sorted
    in one task and one with no more ids keeps all it has. Their texts, no more than a dictionary of
    each, are kept aside; the driver reads their lengths, and of each text its share, so one
    dictionary per language in all.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    ids = usable.select(F.col(lang).alias("lang"), "doc_id", F.xxhash64("doc_id").alias("h")).distinct()
    for key in (("lang", F.pmod("h", F.lit(PARTS))), ("lang",)):
        least = Window.partitionBy(*key).orderBy("h", "doc_id")
        ids = ids.withColumn("place", F.row_number().over(least)).where(F.col("place") <= TEXTS_PER_LANGUAGE).drop("place")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                plain = [b" ".join(prepared(t).split()) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("lang"), pa.array([spread(p, DICTIONARY_BYTES) for p in plain], pa.binary())],
                    ["lang", "plain"],
                )

    rows = (
        usable.select("doc_id", "text", F.col(lang).alias("lang"))
        .join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"])
        .select(F.col("lang").cast("string").alias("lang"), "text")
        .mapInArrow(cut, "lang string, plain binary")
        .where(F.octet_length("plain") > 0)
    )
    shortest = Window.partitionBy("lang").orderBy(F.octet_length("plain"), "plain")
    chosen = stage(rows.withColumn("place", F.row_number().over(shortest)), "dictionary-texts")
    lengths: dict[str, list[int]] = {}
    for r in sorted(chosen.select("lang", "place", F.octet_length("plain").alias("n")).collect()):
        lengths.setdefault(r.lang, []).append(r.n)
    allowed = [(k, i + 1, share) for k, own in lengths.items() for i, share in enumerate(shares(own)) if share]

    def shorten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [spread(p, n) for p, n in zip(batch.column("plain").to_pylist(), batch.column("share").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("place"), pa.array(parts, pa.binary())], ["lang", "place", "part"]
            )

    held: dict[str, list[bytes]] = {}
    if allowed:
        given = docs.sparkSession.createDataFrame(allowed, "lang string, place int, share int")
        parts = (
            chosen.join(F.broadcast(given), ["lang", "place"]).select("lang", "place", "plain", "share")
            .mapInArrow(shorten, "lang string, place int, part binary")
        )
        for r in sorted(parts.collect(), key=lambda r: (r.lang, r.place)):
            held.setdefault(r.lang, []).append(bytes(r.part))
    # The content at the end of a dictionary is the cheapest to refer to.
    return Model({k: _long_enough(b" ".join(v)) for k, v in held.items()})


class Packer:
    """Compressors of a model, one per language, reused for all texts of a task."""

    def __init__(self, model: Model):
        self.languages = sorted(model.dictionaries)
        self._compressors = []
        for k in self.languages:
            raw = zstandard.ZstdCompressionDict(model.dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=LEVEL)
            self._compressors.append(
                zstandard.ZstdCompressor(level=LEVEL, dict_data=raw, write_content_size=False, write_dict_id=False)
            )

    @staticmethod
    def _narrow(sizes: list[int]) -> bool:
        two = sorted(sizes)[:2]
        return len(two) == 2 and two[1] - two[0] < NARROW * two[1]

    def sizes(self, text: str) -> list[int]:
        data = prepared(text)
        pieces = [data[i : i + PIECE_BYTES] for i in range(0, len(data), PIECE_BYTES)]
        sizes = [sum(len(c.compress(p)) for p in pieces) for c in self._compressors]
        if self._narrow(sizes):
            sizes = [sum(len(c.compress(p * REPEATS)) for p in pieces) for c in self._compressors]
        return sizes

    def verdict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, certain); ties go to the language that sorts first."""
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0, False
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        share = sum(math.exp(min(0.0, -8 * EVIDENCE * (s - sizes[best]))) for s in sizes)
        return self.languages[best], 1.0 / share, not self._narrow(sizes)


def identify(docs: DataFrame, model: Model, reject: bool = True) -> DataFrame:
    """(doc_id, lang_pred, score, certain) for every row of (doc_id, text).

    ``und`` with score 0 for a null or empty text, one without letters, and for every text if
    the model has no language. With ``reject``, a text whose margin is narrow is ``und`` too;
    ``certain`` is false for it either way. Texts are used whole; a row that occurs twice gives
    two rows; other columns of ``docs`` are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = [packer.verdict(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([f[0] if f[2] or not reject else "und" for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.bool_()),
                    ],
                    ["doc_id", "lang_pred", "score", "certain"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double, certain boolean"
    )


@query("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the folds other than 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 5) != 0))
    return identify(docs, model, reject=False).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "certain"
    )
