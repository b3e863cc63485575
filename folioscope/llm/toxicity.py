"""Toxicity of texts: a weighted finite-state grammar over clauses, with a learned lexicon.

Words become symbols: insult, threat verb, target, negation, report, other. Four transducers are
composed over them: one raises insults near a target, one makes threats of threat verbs with a
target, one lowers what stands in the scope of a negation, one lowers what is reported speech.
The composed machine reads a clause at a time; the cost of its cheapest path is what the clause
says for or against toxicity. Stems of insults and their weights are learned from labelled texts,
as is the curve from clause scores to a chance.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.logistic import newton, sigmoid
from folioscope.llm.registry import query
from folioscope.llm.shared import fold, labelled_texts, table
from folioscope.llm.transducers import ANY, Transducer
from folioscope.staging import stage
from folioscope.llm.vectext import slices

#: Labelled rows that stems and weights are learned from, at most.
FIT_ROWS = 12_000
#: Stems kept, at most: the strongest. Labelled texts a stem must occur in.
STEMS, SUPPORT = 20_000, 3
#: A stem in this share of the toxic texts is common; others count only by texts without one.
COMMON = 0.02
SHORTEST, LONGEST = 3, 10
#: Chance, under the share of toxic texts, of a stem as one-sided as the ones that are kept.
CHANCE = 1e-5
#: From this score on, a text is toxic.
TOXIC_FROM = 0.3

# Common insults, threat verbs, targets, negations and verbs of report.
INSULTS = ["idiot", "moron", "scum", "trash", "loser", "pathetic", "worthless", "stupid", "disgusting", "vermin"]
THREATS = ["kill", "hurt", "destroy", "shoot", "stab", "burn", "töten", "verletzen", "tuer", "blesser", "matar", "herir"]
TARGETS = [
    "you", "your", "u", "he", "she", "they", "them", "him", "her", "these", "those", "people",
    "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "te", "tú", "usted", "vosotros", "ellos",
]
NEGATIONS = ["not", "no", "never", "nobody", "isn", "aren", "don", "nicht", "kein", "keine", "nie", "pas", "jamais", "nunca", "jamás"]
REPORTS = [
    "said", "says", "say", "called", "calls", "wrote", "quoted", "claimed", "reported", "sagte", "schrieb", "nannte",
    "dit", "écrit", "appelé", "dijo", "escribió", "llamó",
]
#: Weight of an insult of the fixed list that labels say nothing of.
PRIOR = 2.0

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oitgnr"
ALPHABET = [OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT]
#: What a matched insult or threat comes out as, and its share of its weight before any learning.
PLAIN, AIMED, DENIED, REPORTED, MENACE = "plain", "aimed", "denied", "reported", "menace"
OUTPUTS = [PLAIN, AIMED, DENIED, REPORTED, MENACE]
SHARES = [1.0, 1.3, 0.4, 0.5, 1.3]
REACH = 3

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:\n]")
_CLAUSE_ENDS = set(".!?;:\n")


def _near_target() -> Transducer:
    """An insult within three words behind a target is aimed."""
    t = Transducer(0)
    for left in range(REACH + 1):
        after = max(0, left - 1)
        t.add(left, TARGET, TARGET, 0.0, REACH)
        t.add(left, INSULT, AIMED if left else PLAIN, 0.0, after)
        t.add(left, ANY, ANY, 0.0, after)
    return t


def _threats() -> Transducer:
    """A threat verb is a threat if a target stands within three words before or behind it.

    Behind is a guess at the verb that the following words must bear out: a path that guessed
    ends well only if the target comes in time. The guess is the cheaper path where both end.
    """
    calm, guessed = "calm", "guessed"
    t = Transducer((calm, 0), [(calm, k) for k in range(REACH + 1)])
    for left in range(REACH + 1):
        after = (calm, max(0, left - 1))
        t.add((calm, left), TARGET, TARGET, 0.0, (calm, REACH))
        if left:
            t.add((calm, left), THREAT, MENACE, -1.0, after)
        else:
            t.add((calm, 0), THREAT, MENACE, -1.0, (guessed, REACH))
            t.add((calm, 0), THREAT, OTHER, 0.0, after)
        t.add((calm, left), ANY, ANY, 0.0, after)
    for left in range(1, REACH + 1):
        t.add((guessed, left), TARGET, TARGET, 0.0, (calm, REACH))
        t.add((guessed, left), ANY, ANY, 0.0, (guessed, left - 1))
    return t


def _scoped(mark: str, becomes: str, reach: int | None) -> Transducer:
    """What is matched within ``reach`` words behind ``mark``, or in the rest of the clause."""
    t = Transducer(0)
    states = [0, 1] if reach is None else list(range(reach + 1))
    for left in states:
        after = left if reach is None else max(0, left - 1)
        t.add(left, mark, mark, 0.0, states[-1])
        for hit in (PLAIN, AIMED, MENACE):
            t.add(left, hit, becomes if left else hit, 0.0, after)
        t.add(left, ANY, ANY, 0.0, after)
    return t


def grammar() -> Transducer:
    """Targets, threats, negation and report, composed over the alphabet of word symbols."""
    aimed = _near_target().composed(_threats(), ALPHABET)
    denied = aimed.composed(_scoped(NEGATION, DENIED, REACH), ALPHABET)
    return denied.composed(_scoped(REPORT, REPORTED, None), ALPHABET)


class Lexicon:
    """Character transducer from words to symbols: stems as a trie, fixed words whole."""

    def __init__(self, stems: dict[str, float]):
        self._trie: dict = {}
        for stem, weight in stems.items():
            node = self._trie
            for c in stem:
                node = node.setdefault(c, {})
            node[""] = weight
        self._whole = {w: (k, 0.0) for k, ws in ((REPORT, REPORTS), (NEGATION, NEGATIONS), (TARGET, TARGETS)) for w in ws}
        self._whole |= {w: (THREAT, PRIOR) for w in THREATS}
        self._known: dict[str, tuple[str, float] | None] = {}

    def symbol(self, word: str) -> tuple[str, float] | None:
        """(symbol, weight) of a lower-case word, None if it is of no interest."""
        known = self._known
        if word not in known:
            if len(known) > 300_000:
                known.clear()
            known[word] = self._read(word)
        return known[word]

    def _read(self, word: str) -> tuple[str, float] | None:
        node, best = self._trie, None
        for c in word + "$":
            node = node.get(c)
            if node is None:
                break
            best = max(node.get("", -1.0), best if best is not None else -1.0)
        if best is not None and best > 0:
            return INSULT, best
        return self._whole.get(word)


class Model(NamedTuple):
    stems: dict[str, float]
    weights: np.ndarray


class Reader:
    """Scores texts clause by clause with a model's lexicon and the grammar."""

    def __init__(self, model: Model):
        self._lexicon = Lexicon(model.stems)
        self._grammar = grammar()
        self._weights = model.weights

    def clauses(self, text: str) -> Iterator[tuple[list[str], list[float]]]:
        """Matched outputs of the clauses that hold an insult or a threat verb, with their weights."""
        symbols: list[str] = []
        weights: list[float] = []
        live = False
        symbol = self._lexicon.symbol
        for token in _TOKEN.findall(text.lower() + "\n"):
            if token in _CLAUSE_ENDS:
                if live:
                    found = self._grammar.shortest(symbols)
                    if found:
                        hits = [(o, w) for o, w in zip(found[1], weights, strict=True) if o in OUTPUTS]
                        if hits:
                            yield [o for o, _ in hits], [w for _, w in hits]
                symbols, weights, live = [], [], False
                continue
            got = symbol(token)
            if got is None:
                symbols.append(OTHER)
                weights.append(0.0)
            else:
                symbols.append(got[0])
                weights.append(got[1])
                live = live or got[0] in (INSULT, THREAT)

    def features(self, text: str | None) -> np.ndarray:
        """log(1 + weight matched) by kind of output, log(1 + clauses matched), and 1."""
        sums = Counter()
        clauses = 0
        for outputs, weights in self.clauses(text or ""):
            clauses += 1
            for o, w in zip(outputs, weights, strict=True):
                sums[o] += w
        return np.array([*(math.log1p(sums[o]) for o in OUTPUTS), math.log1p(clauses), 1.0])

    def score(self, text: str | None) -> float:
        return float(sigmoid(self.features(text) @ self._weights))


#: Weights before any label is seen: shares of the outputs, clauses, and an offset.
PRIOR_WEIGHTS = np.array([*(2.0 * s for s in SHARES), 0.5, -4.0])


def _stem_counts(sample: DataFrame, explained: dict[str, float]) -> DataFrame:
    """(stem, toxic, clean): labelled texts that hold a word with that stem.

    Toxic texts with one of the stems in ``explained`` are not counted, so that words which
    copies of a toxic text merely share with each other gain nothing from them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        lexicon = Lexicon(explained)
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                own = set(_TOKEN.findall(text.lower()))
                if label and explained and any((lexicon.symbol(w) or " ")[0] == INSULT for w in own):
                    continue
                found = {w + "$" for w in own}
                counts[1 if label else 0].update(
                    {w[:n] for w in found for n in range(SHORTEST, min(len(w), LONGEST) + 1)}
                )
        stems = list(counts[1])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(stems + [s for s in counts[0] if s not in counts[1]], pa.string()),
                pa.array([counts[1][s] for s in stems] + [0] * sum(s not in counts[1] for s in counts[0]), pa.int64()),
                pa.array([counts[0][s] for s in stems] + [n for s, n in counts[0].items() if s not in counts[1]], pa.int64()),
            ],
            ["stem", "toxic", "clean"],
        )

    parts = sample.mapInArrow(run, "stem string, toxic long, clean long")
    return parts.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _strong_stems(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Stems whose one-sidedness is no chance; of nested ones, the longest that loses nothing."""
    by = {r.stem: (r.toxic, r.clean) for r in rows}
    share = toxic / max(1, toxic + clean)
    kept = {}
    for stem, (a, b) in by.items():
        # Normal-free bound on a or more toxic among a + b texts (Chernoff).
        p = a / (a + b)
        gap = p * math.log(p / share) + (0 if p == 1 else (1 - p) * math.log((1 - p) / (1 - share)))
        if p > share and (a + b) * gap >= -math.log(CHANCE) and b <= 0.1 * a:
            kept[stem] = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1))
    for stem in sorted(kept, key=len, reverse=True):
        shorter = stem[:-1]
        if shorter in kept and by[stem][0] >= 0.9 * by[shorter][0]:
            del kept[shorter]
    return {s: min(6.0, w) for s, w in kept.items() if w > 0.5}


def fit(sample: DataFrame) -> Model:
    """Learn stems and weights from (text, label) rows, which the caller has bounded.

    Without both labels, the fixed insults and the weights before learning are all there is.
    """
    # Several passes follow; they read these rows and not the table that they come from.
    sample = stage(sample.select("text", "label"), "toxicity-sample")
    totals = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sum(n for k, n in totals.items() if k), totals.get(0, 0)
    fixed = {w: PRIOR for w in INSULTS}
    if not toxic or not clean:
        return Model(fixed, PRIOR_WEIGHTS)
    common = {}
    for least in (max(SUPPORT, COMMON * toxic), SUPPORT):
        rows = (
            _stem_counts(sample, common)
            .where((F.col("toxic") >= least) & (F.col("clean") <= 0.1 * F.col("toxic")))
            .orderBy(F.desc(F.col("toxic") - 10 * F.col("clean")), "stem")
            .limit(STEMS)
            .collect()
        )
        common |= _strong_stems(rows, toxic, clean)
    stems = fixed | common
    first = Model(stems, PRIOR_WEIGHTS)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(first)
        for batch in batches:
            got = [reader.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.list_(pa.float64())), batch.column("label")], ["x", "label"])

    seen = sample.mapInArrow(features, "x array<double>, label int").collect()
    x = np.array([r.x for r in seen])
    y = np.array([1.0 if r.label else 0.0 for r in seen])
    return Model(stems, newton(x, y, PRIOR_WEIGHTS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) for every row of (doc_id, text).

    The score lies between 0 and 1 and is a number for null and empty texts too, which match
    nothing; predicted is 1 from 0.3 on. Texts are read whole; repeated rows give a row each;
    other columns are not read. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                got = [reader.score(t) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(got, pa.float64()), pa.array([int(s >= TOXIC_FROM) for s in got], pa.int32())],
                    ["doc_id", "score", "predicted"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double, predicted int"
    )


def clean_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are not predicted to be toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(held.value)
        for batch in batches:
            for part in slices(batch, "text"):
                clean = [reader.score(t) < TOXIC_FROM for t in part.column("text").to_pylist()]
                yield part.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fitted(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """The model for ``docs``, from those of them that are labelled and not held out (fold 2 of 4)."""
    labels = table(spark, sf_dir, "labels")
    return fit(labelled_texts(docs, labels, "toxic", fold("doc_id", 4) != 2, FIT_ROWS))


@query("op1_toxicity")
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the folds other than 2 of 4."""
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fitted(spark, sf_dir, docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
