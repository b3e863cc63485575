"""Token counts of whole texts: lengths only, in batches of even size."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.llm.vectext import slices

#: Bytes of text that are counted at once, and stretches whose lengths a task remembers.
BATCH_BYTES = 2 << 20
REMEMBERED = 500_000
#: Characters of the longest stretch that is remembered.
LONG_STRETCH = 64

_STRETCH = re.compile(r" +[^ ]+| +")


class Counter:
    """Counts tokens of a sentencepiece model, stretch by stretch.

    The model sees a text with a blank in front. A stretch begins where a run of blanks does.
    If no piece holds a blank behind another character, no token crosses the start of a
    stretch, so the lengths of the stretches add up to the length of the text, however long
    that is. The pieces are looked at when the model is loaded; if they are not like that,
    texts are encoded whole.
    """

    def __init__(self, path: str):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self._model.id_to_piece(i) for i in range(self._model.get_piece_size()))
        self._safe = not any("▁" in p.lstrip("▁") for p in pieces)
        self._safe &= self._encoded(["a b", "a  b"]) == [2, 3] and self._encoded(["a"]) == [1]
        self._known: dict[str, int] = {" ": 1}

    def _encoded(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self._model.encode(texts, num_threads=1)]

    def lengths(self, texts: list[str]) -> list[int]:
        """Number of tokens of each text."""
        if not self._safe:
            return self._encoded(texts)
        if len(self._known) > REMEMBERED:
            self._known = {" ": 1}
        known, passing = self._known, {}
        cut = [_STRETCH.findall(" " + t.replace("▁", " ")) if t else [] for t in texts]
        fresh = list({s for parts in cut for s in parts if s not in known})
        for s, n in zip(fresh, self._encoded([s[1:] for s in fresh]), strict=True):
            (known if len(s) <= LONG_STRETCH else passing)[s] = n
        if passing:
            known = {**known, **passing}
        return [sum(map(known.__getitem__, parts)) for parts in cut]


@lru_cache(maxsize=1)
def loaded(path: str) -> Counter:
    """The counter of a model, kept by the process with what it has remembered."""
    return Counter(path)


def count_tokens(docs: DataFrame, model: str, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of (doc_id, text).

    A null text counts as empty: no bytes, no tokens, not over the limit. A repeated row gives
    a row each time; other columns are not read. ``model`` is the path of a sentencepiece
    model that every executor can open. Rows are narrow, nothing is shuffled, and a batch of
    many short or few long texts holds about the same number of bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = loaded(model)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                text = pc.fill_null(part.column("text"), "")
                n = pa.array(counter.lengths(text.to_pylist()), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pc.binary_length(text).cast(pa.int64()), n, pc.greater(n, limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


@query("op9_token_counts")
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by the 32k piece model; over the limit above 4096."""
    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096
    )
