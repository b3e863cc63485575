"""Periodic runs of words: tiles by period octave, solved alone, fragments stitched."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.llm.vectext import mixed, slices
from folioscope.staging import stage

#: Shortest run, in words.
SHORTEST = 12
#: Words of the smallest tile. Longer periods have tiles of sixteen times their octave's first.
TILE = 8192
#: Texts of more bytes are cut into tiles; a shorter one is a single tile for every octave.
LONG_BYTES = 65_536
#: Texts that a task solves side by side.
SLICE = 1 << 20
#: Periods below this are found by comparing words at that distance.
NEAR = 8

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

Arrange = Callable[[list[bytes], int | None], list[bytes]]


class Runs(NamedTuple):
    """Runs [start, end) with their smallest periods."""

    period: np.ndarray
    start: np.ndarray
    end: np.ndarray


class Stretch:
    """Codes of words, with prefix hashes from which any two windows can be compared.

    Equal windows have equal hashes. That unequal ones differ is not taken for granted: a run is
    compared word by word before it counts.
    """

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        n = len(codes)
        power = np.full(n, _BASE, np.uint64)
        back = np.full(n + 1, _INVERSE, np.uint64)
        power[:1] = back[:1] = 1
        self._back = np.multiply.accumulate(back)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power), out=self._sums[1:])

    def hashes(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        return (self._sums[at + width] - self._sums[at]) * self._back[at]

    def same(self, a: np.ndarray, b: np.ndarray, width: np.ndarray) -> np.ndarray:
        return self.hashes(a, width) == self.hashes(b, width)

    def ahead(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix at ``a`` and ``b``, at most ``room``."""
        return self._longest(room, lambda k: (a, b, k))

    def behind(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix that ends before ``a`` and ``b``."""
        return self._longest(room, lambda k: (a - k, b - k, k))

    def _longest(self, room: np.ndarray, windows) -> np.ndarray:
        got = np.zeros(len(room), np.int64)
        step = 1 << (int(room.max()).bit_length() if len(room) else 0)
        while step := step >> 1:
            more = got + step
            fits = more <= room
            a, b, k = windows(np.where(fits, more, 0))
            got = np.where(fits & self.same(a, b, k), more, got)
        return got


@lru_cache(maxsize=1)
def _least_factors(bits: int) -> np.ndarray:
    """Least prime factor of every number of at most ``bits`` bits."""
    least = np.arange(1 << bits, dtype=np.int32)
    for r in range(2, 1 << (bits + 1) // 2):
        if least[r] == r:
            multiples = least[r * r :: r]
            np.minimum(multiples, r, out=multiples)
    return least


def _smallest(text: Stretch, runs: Runs) -> np.ndarray:
    """Whether no smaller period holds; one that did would divide the run's own."""
    good = np.ones(len(runs.period), bool)
    if not len(good):
        return good
    least = _least_factors(int(runs.period.max()).bit_length())
    left = runs.period
    while (left > 1).any():
        at = np.flatnonzero(left > 1)
        shorter = runs.period[at] // least[left[at]]
        good[at] &= ~text.same(runs.start[at], runs.start[at] + shorter, runs.end[at] - runs.start[at] - shorter)
        left = np.where(left > 1, left // least[left], 1)
    return good


def _stretches(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the maximal blocks of consecutive numbers in an ascending array."""
    cut = np.flatnonzero(np.diff(hit) != 1)
    return hit[np.concatenate(([0], cut + 1))], hit[np.concatenate((cut, [len(hit) - 1]))] + 1


def _near(text: Stretch, n: int, q: int) -> Runs:
    """Runs of one short period, from the words that are repeated at its distance."""
    hit = np.flatnonzero(text.codes[: n - q] == text.codes[q:n])
    if not len(hit):
        return Runs(*np.zeros((3, 0), np.int64))
    start, end = _stretches(hit)
    long = end - start >= max(q, SHORTEST - q)
    return Runs(np.full(int(long.sum()), q, np.int64), start[long], end[long] + q)


def _far(text: Stretch, n: int, low: int, high: int) -> Runs:
    """Runs of periods from ``low`` to below ``high``, which is at most twice ``low``.

    Such a run repeats ``low`` words or more at its distance, so it holds a whole block between
    two boundaries that are half of ``low`` apart, and the block comes again a period later. At
    such a boundary the two Z-functions, of the words from there on and of those before it
    backwards, tell how far the words agree with those a period on.
    """
    width = low // 2
    hashes = text.hashes(np.arange(n - width + 1), width)
    bounds = np.arange(0, max(0, n - width + 1 - low), width)
    span = high - low
    later = np.concatenate((hashes[low:], np.zeros(span, np.uint64)))
    again = np.lib.stride_tricks.sliding_window_view(later, span)[bounds] == hashes[bounds][:, None]
    # Neighbouring blocks that come again at one distance are of one run; the first stands for all.
    again[1:] &= ~again[:-1]
    row, col = np.nonzero(again)
    at, q = bounds[row], col + low
    inside = at + q <= n - width
    at, q = at[inside], q[inside]
    ahead = text.ahead(at, at + q, n - at - q)
    behind = text.behind(at, at + q, at)
    long = ahead + behind >= np.maximum(q, SHORTEST - q)
    found = np.unique(np.stack((q, at - behind, at + ahead + q))[:, long], axis=1)
    return Runs(*found)


def _exact(text: Stretch, runs: Runs) -> Runs:
    """Runs whose words were compared; one that prefix hashes made too long is cut where words differ."""
    out = []
    for q, s, e in zip(*(c.tolist() for c in runs), strict=True):
        equal = text.codes[s : e - q] == text.codes[s + q : e]
        if equal.all():
            out.append((q, s, e))
            continue
        for a, b in zip(*_stretches(np.flatnonzero(equal)), strict=True) if equal.any() else ():
            if b - a >= max(q, SHORTEST - q):
                out.append((q, s + a, s + b + q))
    return Runs(*np.array(sorted(set(out)), np.int64).reshape(-1, 3).T)


def solve(codes: np.ndarray, low: int, high: int, lengths: np.ndarray | None = None) -> Runs:
    """All runs whose smallest period is from ``low`` to below ``high``.

    ``lengths``: those of texts that lie one after the other, longest first, each closed by a
    code of its own; no run can hold such a code. Only texts of two periods are looked at.
    """
    text, octaves = Stretch(codes), []
    low = max(low, 1)
    ends = None if lengths is None else np.cumsum(lengths)

    def reach(q: int) -> int:
        if ends is None:
            return len(codes) if len(codes) >= 2 * q else 0
        k = int(np.searchsorted(-lengths, -2 * q, "right"))
        return int(ends[k - 1]) if k else 0

    while low < high:
        top = low + 1 if low < NEAR else min(2 * low, high)
        n = reach(low)
        if n < max(SHORTEST, 2 * low):
            break
        found = _near(text, n, low) if low < NEAR else _far(text, n, low, top)
        octaves.append(Runs(*(c[_smallest(text, found)] for c in found)))
        low = top
    return _exact(text, Runs(*map(np.concatenate, zip(*octaves, strict=True)))) if octaves else Runs(*np.zeros((3, 0), np.int64))


class Codes(dict):
    """Numbers words in the order in which they are asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document, by a checksum of its id, is periodic from some word on."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n = len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    root = words[a : a + p]
    return (words[:a] + root * ((n - a) // p + 1))[:n]


RESULT = (
    "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
    "runs_sha256 string, collapsed_sha256 string"
)
_RESULT = pa.schema(
    [
        (name, pa.string() if kind == "string" else pa.int64())
        for name, kind in (field.split(" ") for field in RESULT.split(", "))
    ]
)


def digest(doc_id: int | None, words: list[bytes], runs: list[tuple[int, int, int]]) -> tuple:
    """The result row of a document from its words and its (start, length, period)."""
    runs.sort(key=lambda r: (r[0], r[2]))
    listed = hashlib.sha256()
    for run in runs:
        listed.update(b"%d,%d,%d\n" % run)
    kept, done = [], 0
    for first, end in sorted((s + q, s + n) for s, n, q in runs):
        if first > done:
            kept += words[done:first]
        done = max(done, end)
    kept += words[done:]
    collapsed = hashlib.sha256(b" ".join(kept)).hexdigest()
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    most = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return doc_id, len(runs), *most, listed.hexdigest(), collapsed


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_RESULT)], schema=_RESULT
    )


def _words(text: str | None, doc_id: int | None, arrange: Arrange | None) -> list[bytes]:
    # bytes.split() without an argument parts at exactly the six white space bytes of ASCII.
    words = (text or "").encode().split()
    return arrange(words, doc_id) if arrange else words


def _whole(docs: DataFrame, arrange: Arrange | None) -> DataFrame:
    """Results of texts that are one tile for every octave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                ids = part.column("doc_id").to_pylist()
                texts = [_words(t, i, arrange) for i, t in zip(ids, part.column("text").to_pylist(), strict=True)]
                order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
                codes = Codes()
                flat = [list(map(codes.__getitem__, texts[k])) for k in order]
                for k, own in enumerate(flat):
                    own.append(len(codes) + k)
                lengths = np.array([len(own) for own in flat], np.int64)
                line = np.array([c for own in flat for c in own], np.int64)
                begins = np.cumsum(lengths) - lengths
                found = solve(line, 1, int(lengths[0]) // 2 + 1, lengths)
                of = np.searchsorted(begins, found.start, "right") - 1
                runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
                for k, s, e, q in zip(of.tolist(), (found.start - begins[of]).tolist(), (found.end - begins[of]).tolist(), found.period.tolist(), strict=True):
                    runs[order[k]].append((s, e - s, q))
                yield _batch([digest(*row) for row in zip(ids, texts, runs, strict=True)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, RESULT)


def tiles(docs: DataFrame, arrange: Arrange | None, size: int) -> DataFrame:
    """(row, low, high, start, codes): overlapping tiles for the octaves of every staged (row, doc_id, text).

    The smallest tiles serve all octaves that are at most a sixteenth of them; each later octave
    has tiles of its own. Neighbours share four times the octave's first period, twice any of
    its periods, so each stretch of two periods lies in some tile.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                codes = Codes()
                words = _words(text, doc, arrange)
                line = np.fromiter(map(codes.__getitem__, words), "<i4", len(words))
                low, first = 1, size // 16
                while low == 1 or 2 * low <= len(line):
                    reach, shared = 16 * first, 4 * first
                    for begin in range(0, max(1, len(line) - shared), reach - shared):
                        tile = line[begin : begin + reach]
                        yield pa.RecordBatch.from_pydict(
                            {
                                "row": pa.array([row], pa.int64()),
                                "low": pa.array([low], pa.int64()),
                                "high": pa.array([2 * first], pa.int64()),
                                "start": pa.array([begin], pa.int64()),
                                "codes": pa.array([tile.tobytes()], pa.binary()),
                            }
                        )
                    low = first = 2 * first

    return docs.select("row", "doc_id", "text").mapInArrow(
        run, "row long, low long, high long, start long, codes binary"
    )


def fragments(cut: DataFrame) -> DataFrame:
    """(row, period, start, end) of the runs inside each tile, solved without its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.to_pylist():
                found = solve(np.frombuffer(tile["codes"], "<i4").astype(np.int64), tile["low"], tile["high"])
                n = len(found.period)
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": pa.array(np.full(n, tile["row"], np.int64)),
                        "period": pa.array(found.period),
                        "start": pa.array(found.start + tile["start"]),
                        "end": pa.array(found.end + tile["start"]),
                    }
                )

    return cut.mapInArrow(run, "row long, period long, start long, end long")


def stitch(parts: DataFrame) -> DataFrame:
    """(row, period, start, end) of whole runs: fragments of one period that share a period are one run."""
    before = Window.partitionBy("row", "period").orderBy("start", "end")
    reached = F.max("end").over(before.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(F.col("start") + F.col("period") <= reached, 0).otherwise(1)
    return (
        parts.withColumn("opens", opens)
        .withColumn("run", F.sum("opens").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("row", "period", "run")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("run")
    )


def _tiled(docs: DataFrame, arrange: Arrange | None, size: int) -> DataFrame:
    """Results of long texts: tiles are solved apart, their fragments meet by text and period."""
    docs = stage(docs, "long-texts")
    cut = tiles(docs, arrange, size).repartition("row", "low", "start")
    whole = stitch(fragments(cut))
    listed = whole.groupBy("row").agg(F.collect_list(F.struct("start", "end", "period")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, runs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "runs")), strict=True):
                own = [(r["start"], r["end"] - r["start"], r["period"]) for r in runs or []]
                yield _batch([digest(doc, _words(text, doc, arrange), own)])

    return docs.join(listed, "row", "left").select("doc_id", "text", "runs").mapInArrow(run, RESULT)


def find_runs(
    docs: DataFrame, arrange: Arrange | None = None, long_bytes: int = LONG_BYTES, tile: int = TILE
) -> DataFrame:
    """Count, longest and digests of the periodic runs of words of every row of (doc_id, text).

    A run is a stretch of words of at least twelve, and at least two of its smallest period,
    that no neighbour extends. Null and blank texts have none and the digests of empty strings.
    A repeated row is answered each time; a null doc_id is kept, and counts as an empty id when
    words are rearranged. No rows give no rows; other columns are not read. ``arrange`` changes
    the words of a document before they are searched.

    Only texts over ``long_bytes`` are moved: once to be kept aside, as tiles of 4 bytes a word and
    octave, and once more to meet their runs, which are at most as many as their words.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    long = kept.withColumn("row", F.monotonically_increasing_id()).where(size > long_bytes)
    return _whole(kept.where(size <= long_bytes), arrange).unionByName(_tiled(long, arrange, tile))


@query("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, of which every tenth is made periodic."""
    return find_runs(table(spark, sf_dir, "documents"), planted)
