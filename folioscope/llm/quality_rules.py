"""Quality of texts: fixed rules, and a calibrated regression on hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import logistic
from folioscope.llm.registry import query
from folioscope.llm.shared import labelled_texts, table
from folioscope.llm.vectext import chained, mixed, raw, slices, sums, word_hashes, words

#: Labelled rows the regression is fitted on, at most: a bound on the sample, not on what is scored.
FIT_ROWS = 4_000
#: Hash cells of each kind of n-gram.
CELLS = 1 << 14
KINDS = ("three characters", "word", "two words")
#: A text is kept if the calibrated chance that it is good is at least this.
KEEP_FROM = 0.5
#: Fixed rules: fewest words, and largest share in percent of words in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

#: Bytes of text that a task holds as numbers at a time, if no text is longer.
SLICE = 1 << 20

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_PRIME, _PRIME2 = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    offset: float


class Grams(NamedTuple):
    """Hash cells of all n-grams of one kind, by text: cells[first[i]:first[i + 1]]."""

    cells: np.ndarray
    first: np.ndarray


def _char_grams(data: np.ndarray, bounds: np.ndarray) -> Grams:
    n = len(data) - 2
    if n <= 0:
        return Grams(np.zeros(0, np.int32), np.zeros(len(bounds), np.int64))
    cells = np.empty(n, np.int32)
    # Hashes are eight times as long as the text, so a long one is gone through in windows.
    for begin in range(0, n, SLICE):
        wide = data[begin : begin + SLICE + 2].astype(np.uint64)
        h = wide[:-2] * _PRIME
        h += wide[1:-1]
        h *= _PRIME
        h += wide[2:]
        cells[begin : begin + SLICE] = mixed(h) % np.uint64(CELLS)
    inside = np.ones(n, bool)
    for cut in bounds[1:-1]:
        inside[max(0, cut - 2) : min(cut, n)] = False
    first = np.concatenate(([0], np.cumsum(inside)))[np.minimum(bounds, n)]
    return Grams(cells[inside], first)


def grams(data: np.ndarray, bounds: np.ndarray) -> tuple[list[Grams], np.ndarray]:
    """The three kinds of n-grams with their cells set apart, and the hashes of all words."""
    w = words(data, bounds)
    h = word_hashes(data, w.start, w.end)
    pairs, at = chained(h, 2, w.first)
    cell = np.uint64(CELLS)
    return [
        _char_grams(data, bounds),
        Grams((h % cell).astype(np.int32) + CELLS, w.first),
        Grams((mixed(pairs ^ _PRIME2) % cell).astype(np.int32) + 2 * CELLS, np.searchsorted(at, w.first)),
    ], h


def _rows(kinds: list[Grams]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Sparse rows: shares of the cells among the n-grams of their kind."""
    out = []
    for i in range(len(kinds[0].first) - 1):
        at, value = [], []
        for g in kinds:
            own = g.cells[g.first[i] : g.first[i + 1]]
            cells, n = np.unique(own, return_counts=True)
            at.append(cells.astype(np.int32))
            value.append((n / max(1, len(own))).astype(np.float32))
        out.append((np.concatenate(at), np.concatenate(value)))
    return out


def fit(sample: DataFrame) -> Model:
    """Fit on (text, label) rows, which the caller has bounded; without both labels, keep all.

    The texts are hashed in parallel; the sparse rows are shuffled to one task, so that the driver
    gets the weights only. Three quarters train the weights, one quarter calibrates the margins.
    """

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                kinds, _ = grams(*raw(part.column("text")))
                rows = _rows(kinds)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a.tobytes() for a, _ in rows], pa.binary()),
                        pa.array([v.tobytes() for _, v in rows], pa.binary()),
                        part.column("label"),
                    ],
                    ["at", "value", "label"],
                )

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(
            (a, v, y)
            for batch in batches
            for a, v, y in zip(*(batch.column(c).to_pylist() for c in ("at", "value", "label")), strict=True)
        )
        model = _trained(rows)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), *(pa.array([float(x)]) for x in model[1:])],
            ["weights", "bias", "slope", "offset"],
        )

    found = (
        sample.select("text", "label")
        .mapInArrow(features, "at binary, value binary, label int")
        .repartition(1)
        .mapInArrow(train, "weights binary, bias double, slope double, offset double")
        .first()
    )
    if found is None:
        return _trained([])
    return Model(np.frombuffer(found.weights, np.float32), found.bias, found.slope, found.offset)


def _trained(got: list[tuple[bytes, bytes, int]]) -> Model:
    """A model from sparse rows and labels."""
    width = CELLS * len(KINDS)
    y = np.array([1.0 if label else 0.0 for _, _, label in got])
    if len(got) < 8 or y.min() == y.max():
        return Model(np.zeros(width, np.float32), 0.0, 1.0, 20.0)
    rows = [(np.frombuffer(a, np.int32), np.frombuffer(v, np.float32)) for a, v, _ in got]
    turn = np.arange(len(rows)) % 4 == 3
    pick = lambda which: logistic.stacked([rows[i] for i in np.flatnonzero(which)])
    w, bias = logistic.fit(pick(~turn), y[~turn], width)
    slope, offset = logistic.calibration(logistic.margins(pick(turn), w, bias), y[turn])
    return Model(w, bias, slope, offset)


def chances(kinds: list[Grams], model: Model) -> np.ndarray:
    """Calibrated chance that each text is good."""
    z = np.full(len(kinds[0].first) - 1, model.bias)
    for g in kinds:
        n = np.diff(g.first)
        z += sums(model.weights[g.cells].astype(np.float64), g.first) / np.maximum(1, n)
    return logistic.sigmoid(model.slope * z + model.offset)


def _repeated_words(h: np.ndarray, first: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a three-word window found at least twice in it."""
    windows, at = chained(h, 3, first)
    covered = np.zeros(len(h), bool)
    if len(at):
        key = mixed(windows + text[at].astype(np.uint64) * _PRIME2)
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[at[twice] + k] = True
    return sums(covered.astype(np.int64), first)


def _repeated_lines(text: str | None) -> int:
    lines = (text or "").split("\n")
    if len(lines) == len(set(lines)):
        return 0
    return sum(n - 1 for n in _line_counts(lines).values())


def _line_counts(lines: list[str]) -> dict[str, int]:
    seen: dict[str, int] = {}
    for line in lines:
        if line.strip(" \t\n\v\f\r"):
            seen[line] = seen.get(line, 0) + 1
    return seen


FIELDS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, base_failed boolean, kept boolean, score double"
)


def judged(part: pa.RecordBatch, model: Model) -> pa.RecordBatch:
    """Measures, rule and verdict of each text of a batch."""
    data, bounds = raw(part.column("text"))
    kinds, h = grams(data, bounds)
    w = words(data, bounds)
    n_words = np.diff(w.first)
    opens = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    chars = sums(opens[w.end] - opens[w.start], w.first)
    symbols = sums(SYMBOLS[data].astype(np.int64), bounds)
    repeated = _repeated_words(h, w.first, w.text)
    lines = np.array([_repeated_lines(t) for t in part.column("text").to_pylist()], np.int64)
    failed = (n_words < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * n_words)
    score = chances(kinds, model)
    columns = [n_words, chars, symbols, lines, repeated]
    return pa.RecordBatch.from_arrays(
        [part.column("doc_id")]
        + [pa.array(c.astype(np.int64)) for c in columns]
        + [pa.array(failed), pa.array(~failed & (score >= KEEP_FROM)), pa.array(score)],
        [f.split(" ")[0] for f in FIELDS.split(", ")],
    )


def judge(docs: DataFrame, model: Model) -> DataFrame:
    """Measures, fixed rules and the model's verdict for every row of (doc_id, text).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, score. A null text is empty: all counts 0, base_failed true, kept false. Repeated
    rows give a row each; other columns are not read. Nothing is shuffled; a task holds 1 MB of
    text, or one longer text, at a time.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield judged(part, held.value)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, FIELDS)


def kept_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose verdict is to keep them."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                yield part.filter(judged(part, held.value).column("kept"))

    return docs.mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model for ``docs``, from those of them that have a quality label."""
    return fit(labelled_texts(docs, table(spark, sf_dir, "labels"), "quality", F.lit(True), FIT_ROWS))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and learned verdict for every document."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fitted(spark, sf_dir, docs))
