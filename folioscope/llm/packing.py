"""Packing of tokenised documents into sequences by minimum bin slack."""

from __future__ import annotations

import re
import string
import threading
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.llm.vectext import slices
from folioscope.staging import stage

#: Bytes of ids and text that a worker remembers, about, and characters of the longest stretch of them.
REMEMBERED_BYTES, LONG_STRETCH = 128 << 20, 64
#: Seconds after its last task of this kind until a worker forgets them.
IDLE_SECONDS = 2.0
#: What a remembered stretch takes besides its characters and ids.
ENTRY_BYTES = 180

_MARKS = string.punctuation
_STRETCH = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: White space beyond the six ASCII bytes; texts that hold any are encoded whole.
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def _byte_signs() -> dict[int, int]:
    """The sign that stands for each byte: printable ones for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (b for b in range(256) if b not in set(plain))
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(others)}


class _Known(dict):
    """Ids of stretches; one that is missing is encoded when it is asked for.

    Punctuation at the end of a stretch, behind a letter, is split off by the tokenizer whatever
    follows, and so is a line break in front; so a word is encoded once with and without them.
    A word of letters, with a blank in front or not, is merged as it is. Half of what is remembered
    is the stretches met last; when they fill their half, those before them are forgotten.
    """

    def __init__(self, model):
        self._model, self._merges = model, model.model
        self._added = [t.content for t in model.get_added_tokens_decoder().values()]
        self._signs = _byte_signs()
        self._before: dict[str, bytes] = {}
        self._size = 0

    def forget(self) -> None:
        self.clear()
        self._before, self._size = {}, 0

    def __missing__(self, stretch: str) -> bytes:
        ids = self._before.get(stretch)
        if ids is None:
            ids = self._encoded(stretch)
        if len(stretch) <= LONG_STRETCH:
            self[stretch] = ids
            self._size += ENTRY_BYTES + len(stretch) + len(ids)
            if 2 * self._size > REMEMBERED_BYTES:
                self._before, self._size = dict(self), 0
                self.clear()
        return ids

    def _encoded(self, stretch: str) -> bytes:
        word = stretch.rstrip(_MARKS)
        if word != stretch and word[-1:].isalpha() and not any(t in stretch for t in self._added):
            return self[word] + self[stretch[len(word) :]]
        if stretch[:1] == "\n" and stretch[1:].isalpha():
            return self["\n"] + self[stretch[1:]]
        if stretch.removeprefix(" ").isalpha():
            signs = stretch.encode().decode("latin-1").translate(self._signs)
            return array("I", [t.id for t in self._merges.tokenize(signs)]).tobytes()
        return array("I", self._model.encode(stretch, add_special_tokens=False).ids).tobytes()


class Encoder:
    """Ids of texts by a byte-level BPE tokenizer, as 32-bit words of the machine, little-endian.

    The tokenizer splits a text before it merges, and always where white space begins behind
    other characters; so stretches of white space with what follows are encoded on their own,
    each distinct one once. Added special tokens hold no white space and stay in one stretch.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self._known = _Known(self._model)
        self._idle: threading.Timer | None = None
        sample = "It's a\nsample, isn't it?!\n\n  Größe 12 word\tend."
        if self.encode(sample) != array("I", self._model.encode(sample, add_special_tokens=False).ids).tobytes():
            raise ValueError("the tokenizer does not split texts like a byte-level BPE")

    def encode(self, text: str) -> bytes:
        parts = [text] if not text.isascii() and _ODD_SPACE.search(text) else _STRETCH.findall(text)
        return b"".join(map(self._known.__getitem__, parts))

    def busy(self) -> None:
        """A task begins: keep what is remembered."""
        if self._idle is not None:
            self._idle.cancel()

    def rest(self) -> None:
        """A task has ended. A worker process outlives it, and other work needs the memory, so what is
        remembered goes unless another task follows; to look up what has gone is only slower."""
        self._idle = threading.Timer(IDLE_SECONDS, self._known.forget)
        self._idle.daemon = True
        self._idle.start()


@lru_cache(maxsize=1)
def loaded(path: str) -> Encoder:
    """The encoder of a tokenizer, kept by the process, with what it remembers while it is used."""
    return Encoder(path)


class Pattern(NamedTuple):
    """A way to fill a sequence, used for ``times`` sequences: lengths, with repeats."""

    lengths: list[int]
    times: int


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths that fill ``room`` best, at most ``counts[n]`` of length n; long ones first.

    Subset sums are the bits of one integer. The sets reached before each length are kept, so
    that the way to the best sum can be read back.
    """
    mask = (1 << (room + 1)) - 1
    reach, trail = 1, []
    for n in range(min(room, len(counts) - 1), 0, -1):
        left = min(int(counts[n]), room // n)
        while left > 0:
            new = (reach | reach << n) & mask
            if new == reach:
                break
            trail.append((n, reach))
            reach = new
            left -= 1
        if reach >> room & 1:
            break
    total = reach.bit_length() - 1
    picked = []
    for n, before in reversed(trail):
        if not before >> total & 1:
            picked.append(n)
            total -= n
    return picked


def minimum_bin_slack(counts: np.ndarray, room: int) -> list[Pattern]:
    """Patterns that use up ``counts[n]`` pieces of each length n.

    Each sequence begins with the longest piece left and takes the fullest set that fits beside
    it. A pattern is repeated as often as its lengths last, so the work depends on the number
    of lengths and not on the number of pieces.
    """
    left = counts.astype(np.int64).copy()
    out = []
    for longest in range(min(room, len(left) - 1), 0, -1):
        while left[longest]:
            left[longest] -= 1
            lengths = [longest, *fullest(left, room - longest)]
            left[longest] += 1
            own, need = np.unique(lengths, return_counts=True)
            times = int((left[own] // need).min())
            left[own] -= need * times
            out.append(Pattern(lengths, times))
    return out


class Places(NamedTuple):
    """Where the r-th piece of a length goes: runs of ranks, by length."""

    first_rank: dict[int, np.ndarray]
    sequence: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]


def places(patterns: list[Pattern]) -> Places:
    runs: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    base = 0
    for lengths, times in patterns:
        offset = 0
        for n in lengths:
            runs.setdefault(n, []).append((used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    column = lambda j: {n: np.array([r[j] for r in rs], np.int64) for n, rs in runs.items()}
    return Places(column(0), column(1), column(2))


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, task long, rank long"
)


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, room: int) -> DataFrame:
    """Pieces of at most ``room`` ids of every row of (doc_id, text): a text's ids and ``end_id``.

    A null text counts as empty and has the end id alone. Only longer documents are cut; all
    pieces but the first are full. ``task`` and ``rank`` number the pieces of each length within
    the task that made them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(tokenizer)
        encoder.busy()
        task = TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        ranks = np.zeros(room + 1, np.int64)
        try:
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = []
                    for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                        ids = encoder.encode(text or "") + end
                        total = len(ids) // 4
                        head = (total - 1) % room + 1
                        for piece, start in enumerate([0, *range(head, total, room)]):
                            n = head if piece == 0 else room
                            crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
                            rows.append((doc, piece, start, n, crc, task, int(ranks[n])))
                            ranks[n] += 1
                    names = [f.split(" ")[0] for f in PIECES.split(", ")]
                    kinds = [pa.int32() if c == "piece" else pa.int64() for c in names]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)], names
                    )
        finally:
            encoder.rest()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def pack(pieces: DataFrame, room: int) -> DataFrame:
    """Give each row of staged ``cut_pieces`` a sequence_id and a gapless offset in it.

    The counts of pieces by length, of which there are at most ``room``, are all that reaches
    the driver; it makes patterns from them. A piece's global rank among those of its length is
    its rank in its task plus what earlier tasks have made, summed over (length, task) rows.
    The places of ranks, bounded by the lengths as well, are broadcast.
    """
    counts = np.zeros(room + 1, np.int64)
    by_task = pieces.groupBy("length", "task").agg(F.max("rank").alias("last"))
    by_task = stage(by_task.select("length", "task", (F.col("last") + 1).alias("n")), "pieces-by-task")
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r.length] = r.n
    held = pieces.sparkSession.sparkContext.broadcast(places(minimum_bin_slack(counts, room)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = pieces.join(offsets, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("earlier")).alias("rank")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where = held.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                of = np.flatnonzero(length == n)
                at = np.searchsorted(where.first_rank[int(n)], rank[of], "right") - 1
                sequence[of] = where.sequence[int(n)][at] + rank[of] - where.first_rank[int(n)][at]
                offset[of] = where.offset[int(n)][at]
            kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        run,
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, room: int = 1024) -> DataFrame:
    """Sequences for every row of (doc_id, text), one row per piece.

    No rows give no rows; repeated rows are packed each time; other columns are not read.
    """
    return pack(stage(cut_pieces(docs, tokenizer, end_id, room), "pieces"), room)


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 1024 ids, each document closed by id 2."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
