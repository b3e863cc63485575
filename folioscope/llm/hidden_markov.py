"""Hidden Markov language model: Baum-Welch over partitions, exact likelihood of whole texts.

A token is emitted in two steps: a state emits a class of words, of which there is a fixed
number, and the class emits the word. States, transitions and class emissions are trained by
Baum-Welch; expected counts are added up over partitions. The chance of a word in its class
comes from counts over the whole training corpus, which stay distributed. So what the driver
and the tasks hold does not grow with the corpus, and the counts do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import fold, table
from folioscope.llm.vectext import LOWER, mixed, raw, slices, sums, word_hashes, words
from folioscope.staging import stage

STATES = 8
#: Word classes; class 0 holds only the end of a text.
CLASSES = 8192
#: Rounds of Baum-Welch, each over all training texts.
ROUNDS = 7
#: Words whose counts every task holds; the others are joined.
FREQUENT = 1 << 16
#: Words of up to so many bytes have a class of their own hash, longer ones of their ending.
SHORT_WORD, ENDING = 5, 3
#: Tokens whose states are computed at once, and bytes of classes that are sorted by length for that. A
#: step costs the same for few texts as for many, so the more texts of a length there are, the better.
TOKENS_AT_ONCE, SORTED_AT_ONCE = 1 << 18, 32 << 20
#: Cells of word counts to each power of two, by which the frequent words are told apart.
COUNT_CELLS = 64
#: Hash that stands for the end token.
END = np.uint64(0x5E17D0C5E17D0C11)

_SALT = np.uint64(0xA24BAED4963EE407)


class Tokens(NamedTuple):
    """Word hashes and classes of the texts of a slice; the ends of texts are not among them."""

    h: np.ndarray
    cls: np.ndarray
    first: np.ndarray


def tokens(column: pa.Array) -> Tokens:
    data, bounds = raw(column)
    data = LOWER[data]
    w = words(data, bounds)
    h = word_hashes(data, w.start, w.end)
    size = w.end - w.start
    ending = word_hashes(data, np.maximum(w.start, w.end - ENDING), w.end)
    key = np.where(size <= SHORT_WORD, h, mixed(ending ^ _SALT))
    return Tokens(h, (key % np.uint64(CLASSES - 1)).astype(np.int64) + 1, w.first)


class Counts(NamedTuple):
    """Statistics of the training tokens that are of fixed size."""

    total: int
    distinct: int
    frequent: np.ndarray
    frequent_counts: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray


def count_words(docs: DataFrame) -> DataFrame:
    """(token, cls, c): how often each word occurs in ``docs``, and the end token.

    A task sends each word of 64 MB of text once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            h = np.concatenate([x[0] for x in held])
            token, at, back = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(back, weights=np.concatenate([x[2] for x in held]), minlength=len(token))
            return token, np.concatenate([x[1] for x in held])[at], c

        def emitted() -> pa.RecordBatch:
            token, cls, c = merged()
            return pa.RecordBatch.from_arrays(
                [pa.array(token.view(np.int64)), pa.array(cls.astype(np.int32)), pa.array(c.astype(np.int64))],
                ["token", "cls", "c"],
            )

        for batch in batches:
            for part in slices(batch, "text"):
                t = tokens(part.column("text"))
                h, at, c = np.unique(t.h, return_index=True, return_counts=True)
                held.append((
                    np.append(h, END), np.append(t.cls[at], 0), np.append(c, part.num_rows).astype(np.float64),
                ))
                size += part.column("text").nbytes
                if size > 64 << 20:
                    yield emitted()
                    held, size = [], 0
        if held:
            yield emitted()

    counted = docs.mapInArrow(run, "token long, cls int, c long")
    return counted.groupBy("token").agg(F.min("cls").alias("cls"), F.sum("c").alias("c"))


def summarised(counted: DataFrame) -> Counts:
    """What tasks need to know of the counts; the most frequent words are bounded by FREQUENT."""
    class_total, class_distinct = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in counted.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("k")).collect():
        class_total[r.cls], class_distinct[r.cls] = r.n, r.k
    # A threshold that at most FREQUENT words pass, from numbers of words by size of their counts.
    cell = F.floor(F.log2("c") * COUNT_CELLS)
    least, passed = None, 0
    for r in sorted(counted.groupBy(cell.alias("cell")).agg(F.count("*").alias("k")).collect(), reverse=True):
        passed += r.k
        if passed > FREQUENT:
            break
        least = r.cell
    rows = counted.where(F.lit(False) if least is None else cell >= least).select("token", "c").toArrow()
    token = rows.column("token").to_numpy().view(np.uint64)
    order = np.argsort(token)
    return Counts(
        int(class_total.sum()), int(class_distinct.sum()), token[order], rows.column("c").to_numpy()[order],
        class_total, class_distinct,
    )


class Hmm(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray


def initial(counts: Counts, states: int = STATES) -> Hmm:
    """Near-uniform start: class frequencies, tilted a little for each state by a fixed hash."""
    share = (counts.class_total + 1.0) / (counts.class_total.sum() + CLASSES)
    cell = mixed(np.arange(states * CLASSES, dtype=np.uint64) + _SALT).reshape(states, CLASSES)
    tilt = 0.5 + (cell >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    emit = share * tilt
    step = np.full((states, states), 0.4 / (states - 1)) if states > 1 else np.ones((1, 1))
    np.fill_diagonal(step, 0.6 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True))


def _blocks(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Texts in groups of a bounded number of tokens, like lengths together."""
    order = np.argsort(np.diff(bounds), kind="stable")
    upto = np.cumsum(np.diff(bounds)[order])
    begin = 0
    while begin < len(order):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + TOKENS_AT_ONCE, "right")))
        yield order[begin:end]
        begin = end


#: Steps whose forward values are kept at once on the way back.
SPAN = 4096
#: Steps after which forward values are scaled to a sum of 1; a divisor of SPAN. In a step the sum falls to
#: the least transition at worst, 1 by the training tokens, as emissions are divided by their class's greatest.
RESCALE = 16


class _Span(NamedTuple):
    """Steps of a group, one after the other: step t has the rows first[t] to first[t + 1]."""

    first: np.ndarray
    #: Sequence of each row, its class, what its states emit there, and forward values.
    of: np.ndarray
    cls: np.ndarray
    seen: np.ndarray
    alpha: np.ndarray
    #: Rows where sequences end, rows where forward values were scaled, and what they were divided by.
    ends: np.ndarray
    scaled: np.ndarray
    scale: np.ndarray


class _Group:
    """Sequences side by side: a row for each sequence and step, states in columns, longest sequences first."""

    def __init__(self, model: Hmm, cls: np.ndarray, bounds: np.ndarray, members: np.ndarray):
        self.members = members[::-1]
        self._size = (bounds[self.members + 1] - bounds[self.members])[::-1]
        self._base, self._cls, self._model = bounds[self.members], cls, model
        self.longest = int(self._size[-1]) if len(self._size) else 0
        self._emit = np.ascontiguousarray((model.emit / model.emit.max(axis=0)).T)

    def ahead(self, begin: int, alpha: np.ndarray | None) -> _Span:
        """The SPAN steps from ``begin`` on, after the forward values ``alpha`` of the step before."""
        steps = np.arange(begin, min(begin + SPAN, self.longest))
        live = len(self._size) - np.searchsorted(self._size, steps, "right")
        first = np.concatenate(([0], np.cumsum(live)))
        of = np.arange(first[-1]) - np.repeat(first[:-1], live)
        cls = self._cls[self._base[of] + np.repeat(steps, live)].astype(np.intp)
        seen = np.take(self._emit, cls, axis=0)
        out, scale = np.empty_like(seen), np.ones(len(cls))
        at, each = first.tolist(), np.ones(seen.shape[1])
        for i in range(len(steps)):
            a = out[at[i] : at[i + 1]]
            if alpha is None:
                a[:] = self._model.start
            else:
                np.matmul(alpha[: len(a)], self._model.step, out=a)
            a *= seen[at[i] : at[i + 1]]
            if i % RESCALE == RESCALE - 1:
                c = scale[at[i] : at[i + 1]]
                np.matmul(a, each, out=c)
                a /= c[:, None]
            alpha = a
        # Sequences that end in this span are in a row, as they are in order of length.
        ended = np.arange(len(self._size) - np.searchsorted(self._size, begin + len(steps), "right"), live[0])
        ends = first[self._size[::-1][ended] - 1 - begin] + ended
        c = out[ends] @ each
        out[ends] /= c[:, None]
        scale[ends] *= c
        scaled = np.flatnonzero(scale != 1)
        return _Span(first, of, cls, seen, out, ends, scaled, scale[scaled])


def forward(model: Hmm, cls: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Natural log likelihood of each class sequence cls[bounds[i]:bounds[i + 1]], by the scaled forward recursion."""
    out, greatest = np.zeros(len(bounds) - 1), np.log(model.emit.max(axis=0))
    for members in _blocks(bounds):
        group = _Group(model, cls, bounds, members)
        alpha, total = None, np.zeros(len(members))
        for begin in range(0, group.longest, SPAN):
            span = group.ahead(begin, alpha)
            total += np.bincount(span.of, weights=greatest[span.cls], minlength=len(members))
            total += np.bincount(span.of[span.scaled], weights=np.log(span.scale), minlength=len(members))
            alpha = span.alpha[span.first[-2] :].copy()
        out[group.members] = total
    return out


class Expected(NamedTuple):
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray
    loglik: float


def expected(model: Hmm, cls: np.ndarray, bounds: np.ndarray) -> Expected:
    """Expected counts of Baum-Welch over whole class sequences.

    The forward pass keeps its values at every SPAN-th step only and is run again within each
    span on the way back, so that a very long text takes little more memory than a short one.
    Forward times backward values need no scaling: those of a row add up to 1.
    """
    k = len(model.start)
    out = Expected(np.zeros(k), np.zeros((k, k)), np.zeros((CLASSES, k)), 0.0)
    times = np.bincount(cls, minlength=CLASSES)
    loglik = float(times[times > 0] @ np.log(model.emit.max(axis=0)[times > 0]))
    back = np.ascontiguousarray(model.step.T)
    for members in _blocks(bounds):
        group = _Group(model, cls, bounds, members)
        marks: dict[int, np.ndarray | None] = {0: None}
        span = None
        for begin in range(0, group.longest, SPAN):
            span = None
            span = group.ahead(begin, marks[begin])
            if begin + SPAN < group.longest:
                marks[begin + SPAN] = span.alpha[span.first[-2] :].copy()
        beta = np.ones((len(members), k))
        for begin in sorted(marks, reverse=True) if span else ():
            if begin + SPAN < group.longest:
                span = None
                span = group.ahead(begin, marks[begin])
            loglik += float(np.log(span.scale).sum())
            at = span.first.tolist()
            betas, onward = np.empty_like(span.alpha), span.seen
            betas[span.ends] = 1
            betas[at[-2] :] = beta[: at[-1] - at[-2]]
            onward[span.scaled] /= span.scale[:, None]
            for i in range(len(at) - 2, -1, -1):
                here = onward[at[i] : at[i + 1]]
                here *= betas[at[i] : at[i + 1]]
                to = betas[at[i - 1] : at[i - 1] + len(here)] if i else beta[: len(here)]
                np.matmul(here, back, out=to)
            # Pairs of steps: the forward value before each row with what came onward to it.
            if marks[begin] is not None:
                out.step[:] += model.step * (marks[begin][: at[1]].T @ onward[: at[1]])
            before = np.repeat(span.first[:-2], np.diff(span.first)[1:]) + span.of[at[1] :]
            out.step[:] += model.step * (np.take(span.alpha, before, axis=0).T @ onward[at[1] :])
            betas *= span.alpha
            if begin == 0:
                out.start[:] += betas[: at[1]].sum(axis=0)
            _added(out.emit, span.cls, betas)
    return out._replace(loglik=loglik)


def _added(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    for j, column in enumerate(np.ascontiguousarray(rows.T)):
        to[:, j] += np.bincount(at, weights=column, minlength=len(to))


def updated(parts: Expected, counts: Counts) -> Hmm:
    """Maximise: counts with a little mass on everything, emissions leaning on class frequencies."""
    share = (counts.class_total + 1.0) / (counts.class_total.sum() + CLASSES)
    emit = parts.emit.T + 0.5 * share * CLASSES
    return Hmm(
        (parts.start + 1) / (parts.start + 1).sum(),
        (parts.step + 1) / (parts.step + 1).sum(axis=1, keepdims=True),
        emit / emit.sum(axis=1, keepdims=True),
    )


def baum_welch(sequences: DataFrame, counts: Counts, states: int = STATES) -> Hmm:
    """Train on staged rows (row, classes), all of them in every round.

    A task returns a row of counts for each class it has seen, each state and the start, which
    are summed by key before the driver reads them. Their number does not grow with the corpus.
    """
    model = initial(counts, states)
    spark = sequences.sparkSession
    sequences = sequences.select("classes")
    for _ in range(ROUNDS):
        held = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = held.value
            start, step, emit = np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states))
            for batch in batches:
                for part in slices(batch, "classes", SORTED_AT_ONCE):
                    cls = [np.frombuffer(x, "<u2") for x in part.column("classes").to_pylist()]
                    bounds = np.concatenate(([0], np.cumsum([len(c) for c in cls])))
                    got = expected(now, np.concatenate(cls), bounds)
                    start, step, emit = start + got.start, step + got.step, emit + got.emit
            seen = np.flatnonzero(emit.any(axis=1))
            if len(seen):
                keys = np.concatenate(([-1], -2 - np.arange(states), seen))
                rows = np.concatenate((start[None], step, emit[seen]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), *(pa.array(rows[:, j]) for j in range(states))],
                    ["key", *(f"s{j}" for j in range(states))],
                )

        columns = [f"s{j}" for j in range(states)]
        found = (
            sequences.mapInArrow(run, "key long, " + ", ".join(f"{c} double" for c in columns))
            .groupBy("key")
            .agg(*(F.sum(c).alias(c) for c in columns))
            .toArrow()
        )
        key = found.column("key").to_numpy()
        rows = np.stack([found.column(c).to_numpy() for c in columns], axis=1) if len(key) else np.zeros((0, states))
        total = Expected(np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)), 0.0)
        total.emit[key[key >= 0]] = rows[key >= 0]
        total.step[-2 - key[key <= -2]] = rows[key <= -2]
        if (key == -1).any():
            total.start[:] = rows[key == -1][0]
        model = updated(total, counts)
    return model


def _prepared(docs: DataFrame, counts: Counts) -> DataFrame:
    """Class sequences, what the frequent words add, and the rarer words with their numbers."""
    held = docs.sparkSession.sparkContext.broadcast((counts.frequent, np.log10(counts.frequent_counts + 1.0)))
    # The end is alone in its class, so its count does not depend on its being frequent.
    end_log = math.log10(counts.class_total[0] + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, logs = held.value
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text"):
                t = tokens(part.column("text"))
                at = np.minimum(np.searchsorted(frequent, t.h), max(0, len(frequent) - 1))
                hit = frequent[at] == t.h if len(frequent) else np.zeros(len(t.h), bool)
                value = np.where(hit, logs[at], 0.0) if len(frequent) else np.zeros(len(t.h))
                first, n = t.first, np.diff(t.first)
                rest, rest_n, seq = [], [], []
                cls = t.cls.astype("<u2")
                for i in range(part.num_rows):
                    own = slice(first[i], first[i + 1])
                    h, c = np.unique(t.h[own][~hit[own]], return_counts=True)
                    rest.append(h.view(np.int64))
                    rest_n.append(c.astype(np.int32))
                    seq.append(cls[own].tobytes() + b"\0\0")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row + np.arange(part.num_rows), pa.int64()),
                        part.column("doc_id"),
                        part.column("held_out"),
                        pa.array(n + 1, pa.int64()),
                        pa.array(sums(hit.astype(np.int64), first) + (end_log > 0), pa.int64()),
                        pa.array(sums(value, first) + end_log, pa.float64()),
                        pa.array(seq, pa.binary()),
                        pa.array(rest, pa.list_(pa.int64())),
                        pa.array(rest_n, pa.list_(pa.int32())),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "classes", "rest", "rest_n"],
                )
                row += part.num_rows

    return docs.mapInArrow(
        run,
        "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, classes binary, "
        "rest array<long>, rest_n array<int>",
    )


def _likelihoods(prepared: DataFrame, model: Hmm, counts: Counts) -> DataFrame:
    """log10 of the class sequence's likelihood and of the class totals its words are divided by."""
    divisor = np.log10(counts.class_total + counts.class_distinct + 1.0)
    held = prepared.sparkSession.sparkContext.broadcast((model, divisor))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, div = held.value
        for batch in batches:
            for part in slices(batch, "classes", SORTED_AT_ONCE):
                cls = [np.frombuffer(x, "<u2") for x in part.column("classes").to_pylist()]
                bounds = np.concatenate(([0], np.cumsum([len(c) for c in cls]))).astype(np.int64)
                flat = np.concatenate(cls)
                value = forward(now, flat, bounds) / math.log(10) - sums(div[flat], bounds)
                kept = ["row", "doc_id", "held_out", "n_tokens", "known", "logs"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(value)], [*kept, "chain"])

    return prepared.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "classes").mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, known long, logs double, chain double"
    )


def score(docs: DataFrame, held_out: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text, held_out).

    Trains on the rows whose ``held_out`` is false and scores all. Tokens are the words,
    lower-cased (A to Z), and an end; a null or empty text is an end alone. base_score is the
    smoothed unigram's log10 probability. score is that of the hidden Markov model: the exact
    likelihood of the class sequence, times the chance of each word in its class, (c + 1) over
    the class's tokens and words and one; a word never seen takes the place of that one. Without
    training rows all counts are 0. Repeated rows train and are scored each time.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col(held_out).alias("held_out"))
    counted = stage(count_words(docs.where(~F.col("held_out"))), "word-counts")
    counts = summarised(counted)
    prepared = stage(_prepared(docs, counts), "word-classes")
    model = baum_welch(prepared.where(~F.col("held_out")).select("row", "classes"), counts)
    total = float(counts.total + counts.distinct + 1)
    rest = (
        prepared.select("row", F.explode(F.arrays_zip("rest", "rest_n")).alias("e"))
        .select("row", F.col("e.rest").alias("token"), F.col("e.rest_n").alias("k"))
        .join(counted.select("token", "c"), "token")
        .groupBy("row")
        .agg(F.sum("k").alias("more"), F.sum(F.col("k") * F.log10(F.col("c") + F.lit(1.0))).alias("more_logs"))
    )
    logs = F.col("logs") + F.coalesce("more_logs", F.lit(0.0))
    return (
        _likelihoods(prepared, model, counts)
        .join(rest, "row", "left")
        .select(
            "doc_id",
            "held_out",
            "n_tokens",
            (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
            F.lit(counts.total).cast("long").alias("train_tokens"),
            (logs - F.col("n_tokens") * math.log10(total)).alias("base_score"),
            (F.col("chain") + logs).alias("score"),
        )
    )


@query("op3_hidden_markov")
def op3_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and hidden Markov scores of every document, trained without fold 2 of 7."""
    docs = table(spark, sf_dir, "documents")
    return score(docs.withColumn("held", fold("doc_id", 7) == 2), "held")
