"""Similarity join of documents on word shingles, by set relations instead of pairs.

Sets that are equal become one. Of the rest, only those of whose least hashes enough occur in
another set can have a partner at all. Among these, each set is first compared with a central
set that it shares hashes with: its links to all that are close to the same centre follow from
the two differences, without a look at the sets. What remains are links between sets of
different groups; their index lists hold only hashes that several groups share, are cut into
blocks by set size, and a set visits only the blocks that can hold a partner of its.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.llm.vectext import LOWER, chained, mixed, raw, slices, word_hashes, words
from folioscope.operators.graph import connected_components
from folioscope.staging import stage

WIDTH = 5
#: Least similarity in percent: 100 * common >= SIMILAR * union.
SIMILAR = 80
#: Hashes a task gathers before it deals them out, and hashes of a bucket on average.
CHUNK, BUCKET = 2_000_000, 100_000
#: Blocks of index lists span sizes that differ by less than this factor.
BLOCK_RATIO = 1.03
#: Narrow tables of at most so many counted rows (some 30 MB) are broadcast, larger ones shuffled.
BROADCAST_ROWS = 500_000

_MANY = np.iinfo(np.int64).min
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text.

    Words are lower-cased (A to Z). Fewer than five words make one shingle, none an empty set.
    """
    data, bounds = raw(column)
    data = LOWER[data]
    w = words(data, bounds)
    h = word_hashes(data, w.start, w.end)
    windows, at = chained(h, WIDTH, w.first)
    first = np.searchsorted(at, w.first)
    out = []
    for i in range(len(bounds) - 1):
        a, b = w.first[i], w.first[i + 1]
        if b - a >= WIDTH:
            out.append(np.unique(windows[first[i] : first[i + 1]]))
        elif b > a:
            out.append(chained(h[a:b], b - a, np.array([0, b - a]))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _prints(s: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit fingerprints of a set."""
    a = int(mixed(s).sum(dtype=np.uint64)) if len(s) else 0
    b = int(np.bitwise_xor.reduce(mixed(s * _ODD))) if len(s) else 0
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def spare(n: int) -> int:
    """How many hashes of a set of ``n`` a partner may lack at most."""
    return n - -(-SIMILAR * n // 100)


def looked_at(n: int) -> int:
    """How many of the least hashes of a set of ``n`` decide whether it can have a partner."""
    return min(n, spare(n) + 1 + n // 10)


def _spare(n: str) -> Column:
    return F.col(n) - F.ceil(F.col(n) * SIMILAR / 100)


def _links(a: str, b: str, common: Column) -> Column:
    return (100 + SIMILAR) * common >= SIMILAR * (F.col(a) + F.col(b))


def _narrow_sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                prints = [_prints(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                    ],
                    ["doc_id", "n", "f", "g"],
                )

    return docs.mapInArrow(run, "doc_id long, n long, f long, g long")


def _runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    if not len(ordered):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    return start, np.diff(np.concatenate((start, [len(ordered)])))


def _dealt(sets: dict[tuple, tuple[int, np.ndarray]], buckets: int) -> pa.RecordBatch:
    """A chunk's hashes by bucket, each once; one that several sets hold is marked as such.

    Buckets below 0 carry how many of each set's hashes the chunk alone has shown to be shared.
    """
    ids = np.array([d for d, _ in sets.values()], np.int64)
    sizes = np.array([len(s) for _, s in sets.values()])
    flat = np.concatenate([s for _, s in sets.values()])
    owner = np.repeat(np.arange(len(ids)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    start, length = _runs(flat)
    shared = np.repeat(length > 1, length)
    here = np.bincount(owner[shared], minlength=len(ids))
    h = flat[start]
    who = np.where(length > 1, _MANY, ids[owner[start]])
    bucket = (mixed(h ^ _ODD) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    begin, n = _runs(bucket[order])
    rows = [
        (int(bucket[order[b]]), h[order[b : b + k]].tobytes(), who[order[b : b + k]].tobytes())
        for b, k in zip(begin, n, strict=True)
    ]
    rows.append((-1 - int(ids[0]) % buckets, ids.tobytes(), here.astype(np.int64).tobytes()))
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())],
        ["bucket", "hashes", "owners"],
    )


def shared_counts(docs: DataFrame, buckets: int) -> DataFrame:
    """(doc_id, shared): how many of the looked-at hashes of a set occur in another set too.

    Sets equal to another of the same chunk are counted under the smallest id; equal sets of
    different chunks count as sharing, which only lets more sets pass. Each chunk sends a hash
    once, however many of its sets hold it, so a hash of a third of all sets makes no large
    group.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[int, np.ndarray]] = {}
        total = 0
        for batch in batches:
            for part in slices(batch, "text"):
                for doc, s in zip(part.column("doc_id").to_pylist(), shingle_sets(part.column("text")), strict=True):
                    if len(s):
                        key = (len(s), *_prints(s))
                        if key not in held:
                            held[key] = doc, s[: looked_at(len(s))].copy()
                            total += len(held[key][1])
                        elif doc < held[key][0]:
                            held[key] = doc, held[key][1]
                if total >= CHUNK:
                    yield _dealt(held, buckets)
                    held, total = {}, 0
        if held:
            yield _dealt(held, buckets)

    def count(group: pa.Table) -> pa.Table:
        a = [np.frombuffer(x, np.int64) for x in group.column("hashes").to_pylist()]
        b = [np.frombuffer(x, np.int64) for x in group.column("owners").to_pylist()]
        if group.column("bucket")[0].as_py() < 0:
            ids, n = np.concatenate(a), np.concatenate(b)
        else:
            h, who = np.concatenate(a), np.concatenate(b)
            order = np.argsort(h, kind="stable")
            start, length = _runs(h[order])
            shared = who[order][np.repeat(length > 1, length)]
            ids, n = np.unique(shared[shared != _MANY], return_counts=True)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(n.astype(np.int64))})

    return (
        docs.mapInArrow(deal, "bucket long, hashes binary, owners binary")
        .groupBy("bucket")
        .applyInArrow(count, "doc_id long, n long")
        .groupBy("doc_id")
        .agg(F.sum("n").alias("shared"))
    )


def _full_sets(texts: DataFrame) -> DataFrame:
    """(doc_id, n, central, tokens, head): all hashes, and the looked-at ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text"))
                lists = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(s) for s in sets], pa.int64()),
                        part.column("central"),
                        pa.array([s.view(np.int64) for s in sets], lists),
                        pa.array([s[: looked_at(len(s))].view(np.int64) for s in sets], lists),
                    ],
                    ["doc_id", "n", "central", "tokens", "head"],
                )

    return texts.select("doc_id", "text", "central").mapInArrow(
        run, "doc_id long, n long, central double, tokens array<long>, head array<long>"
    )


def _if_small(narrow: DataFrame) -> DataFrame:
    """A staged table of ids, marked for broadcast if its counted rows are few enough."""
    return F.broadcast(narrow) if narrow.count() <= BROADCAST_ROWS else narrow


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Staged pairs (a, b) with the number of hashes they have in common and their sizes."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}"))
    asked = stage(pairs.select("b").distinct(), "shingle-asked")
    return (
        side("a").join(_if_small(pairs), "a")
        .join(side("b").join(_if_small(asked), "b", "left_semi"), "b")
        .select("a", "b", "na", "nb", F.size(F.array_intersect("ta", "tb")).cast("long").alias("common"))
    )


def _stars(sets: DataFrame) -> DataFrame:
    """(doc_id, centre, difference, linked): each set beside the centre it shares most with.

    The centre of a hash is the set of those that hold it which has the largest part of its
    hashes in other sets: the one that the others are variants of. Centres are aggregated, not
    gathered, so that a hash of very many sets costs one row per task.
    """
    heads = sets.select("doc_id", "central", F.explode("head").alias("token"))
    centres = (
        heads.groupBy("token")
        .agg(F.max(F.struct("central", (-F.col("doc_id")).alias("minus"))).alias("best"), F.count("*").alias("k"))
        .where(F.col("k") > 1)
        .select("token", (-F.col("best.minus")).alias("centre"))
    )
    beside = (
        heads.join(centres, "token")
        .where(F.col("doc_id") != F.col("centre"))
        .groupBy("doc_id", "centre")
        .agg(F.count("*").alias("k"))
        .groupBy("doc_id")
        .agg(F.max(F.struct("k", (-F.col("centre")).alias("minus"))).alias("best"))
        .select(F.col("doc_id").alias("a"), (-F.col("best.minus")).alias("b"))
    )
    return _verified(stage(beside, "shingle-beside"), sets).select(
        F.col("a").alias("doc_id"),
        F.col("b").alias("centre"),
        (F.col("na") + F.col("nb") - 2 * F.col("common")).alias("difference"),
        _links("na", "nb", F.col("common")).alias("linked"),
    )


def _grouped(sets: DataFrame, stars: DataFrame) -> DataFrame:
    """Sets with grp: a centre that they link to, or themselves."""
    own = stars.where("linked").groupBy("doc_id").agg(F.min("centre").alias("own"))
    with_own = sets.join(_if_small(stage(own, "shingle-groups")), "doc_id", "left")
    return with_own.withColumn("grp", F.coalesce("own", "doc_id")).drop("own")


def _crossing(sets: DataFrame, tokens: str) -> DataFrame:
    """(doc_id, u): how many of the hashes in ``tokens`` each set shares with another group."""
    flat = sets.select("doc_id", "grp", F.explode(tokens).alias("token"))
    several = (
        flat.groupBy("token")
        .agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"))
        .where(F.col("lo") != F.col("hi"))
        .select("token")
    )
    return flat.select("doc_id", "token").join(several, "token").groupBy("doc_id").agg(F.countDistinct("token").alias("u"))


def _still_open(sets: DataFrame) -> DataFrame:
    """The sets that may have a partner in another group: the least hashes are counted first."""
    n = F.col("n")
    few = _crossing(sets, "head").join(sets.select("doc_id", "n"), "doc_id")
    looked = F.least(n, _spare("n") + 1 + F.floor(n / 10))
    few = _if_small(stage(few.where(F.col("u") >= looked - _spare("n")).select("doc_id").distinct(), "shingle-open"))
    sets = sets.join(few, "doc_id", "left_semi")
    all_ = _crossing(sets, "tokens").join(sets.select("doc_id", "n"), "doc_id")
    left = _if_small(stage(all_.where(F.col("u") >= n - _spare("n")).select("doc_id").distinct(), "shingle-open"))
    return sets.join(left, "doc_id", "left_semi")


def _open_tokens(sets: DataFrame) -> DataFrame:
    """(doc_id, n, grp, lists, u): the hashes of each set that another group holds too.

    ``lists`` has them from rare to frequent; ``u`` is their number. Sets of which less than
    the least similarity is left have no partner in another group and are dropped.
    """
    flat = sets.select("doc_id", "n", "grp", F.explode("tokens").alias("token"))
    several = (
        flat.groupBy("token")
        .agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.count("*").alias("k"))
        .where(F.col("lo") != F.col("hi"))
        .select("token", "k")
    )
    return (
        flat.join(several, "token")
        .groupBy("doc_id", "n", "grp")
        .agg(F.sort_array(F.collect_set(F.struct("k", "token"))).alias("lists"))
        .withColumn("u", F.size("lists").cast("long"))
        .where(F.col("u") >= F.col("n") - _spare("n"))
    )


def _block(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / F.log(F.lit(BLOCK_RATIO))).cast("int")


def _cross_pairs(opened: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different groups that may link.

    A set is listed under the first of its open hashes, as many as it may lack and one, less
    the hashes that no other group holds. Each list is cut into blocks by set size. In each
    list, sets of its largest group wait; the others visit the blocks of the sizes that a
    partner can have: at least the share of its own size, at most what its open hashes from
    this place on allow. A set that has lost too much to its own changes has no such block.
    """
    listed = opened.select(
        "doc_id", "n", "grp", "u",
        F.posexplode(F.slice("lists", F.lit(1), (_spare("n") + 1 - (F.col("n") - F.col("u"))).cast("int"))).alias("i", "e"),
    ).select("doc_id", "n", "grp", (F.col("u") - F.col("i")).alias("left"), F.col("e.token").alias("token"))
    largest = (
        listed.groupBy("token", "grp")
        .agg(F.count("*").alias("k"))
        .groupBy("token")
        .agg(F.max(F.struct("k", "grp")).alias("most"), F.count("*").alias("groups"))
        .where(F.col("groups") > 1)
        .select("token", F.col("most.grp").alias("waiting"))
    )
    listed = listed.join(largest, "token")
    n = F.col("n")
    least = F.ceil(n * SIMILAR / 100)
    # Of two sets whose first common open hash stands here, no more than what is left is common.
    most = F.least(F.floor(n * 100 / SIMILAR), F.floor(F.col("left") * (100 + SIMILAR) / SIMILAR) - n)
    visits = (
        listed.where(F.col("grp") != F.col("waiting"))
        .select("doc_id", "n", "grp", "token", least.alias("least"), most.alias("most"))
        .where(F.col("least") <= F.col("most"))
        .select(
            F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("grp").alias("ga"), "token", "least", "most",
            F.explode(F.sequence(_block(F.col("least")), _block(F.col("most")))).alias("block"),
        )
    )
    index = listed.select(
        F.col("doc_id").alias("b"), F.col("grp").alias("gb"), "token", "n", _block(n).alias("block"),
        least.alias("b_least"), most.alias("b_most"),
    )
    return (
        visits.join(index, ["token", "block"])
        .where((F.col("ga") != F.col("gb")) & F.col("n").between(F.col("least"), F.col("most")))
        .where(F.col("na").between(F.col("b_least"), F.col("b_most")))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )


def _answers(pairs: DataFrame, sets: DataFrame, stars: DataFrame) -> DataFrame:
    """The pairs that link.

    If both sets stand beside the same centre, their difference lies between the difference
    and the sum of theirs from it; only pairs that this leaves undecided are looked at.
    """
    beside = stars.select("doc_id", "centre", "difference").unionByName(
        stars.select(F.col("centre").alias("doc_id"), "centre", F.lit(0).cast("long").alias("difference"))
    )
    beside = beside.groupBy("doc_id").agg(F.min_by(F.struct("centre", "difference"), "difference").alias("x"))
    beside = beside.select("doc_id", "x.centre", "x.difference")
    side = lambda x: beside.select(F.col("doc_id").alias(x), "centre", F.col("difference").alias(f"d{x}"))
    size = lambda x: sets.select(F.col("doc_id").alias(x), F.col("n").alias(f"n{x}"))
    bounds = (
        pairs.join(side("a"), "a")
        .join(side("b"), ["b", "centre"])
        .select("a", "b", F.abs(F.col("da") - F.col("db")).alias("low"), (F.col("da") + F.col("db")).alias("high"))
    )
    room = (F.col("na") + F.col("nb")) * (100 - SIMILAR) / (100 + SIMILAR)
    judged = stage(
        pairs.join(bounds, ["a", "b"], "left")
        .join(size("a"), "a")
        .join(size("b"), "b")
        .select("a", "b", F.when(F.col("high") <= room, True).when(F.col("low") > room, False).alias("links")),
        "shingle-pairs",
    )
    checked = _verified(stage(judged.where(F.col("links").isNull()).select("a", "b"), "shingle-pairs"), sets)
    return (
        judged.where("links").select("a", "b")
        .unionByName(checked.where(_links("na", "nb", F.col("common"))).select("a", "b"))
        .distinct()
    )


def link_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of (doc_id, text).

    Two documents link when 100 times the number of their common shingles is at least 80 times
    that of all their shingles; component_id is the smallest doc_id that links reach. A null,
    empty or blank text has no shingles and its own id. A row without doc_id links with nothing
    and has no component. A repeated row gives a row each time; an id with several texts is one
    document with the links of all. Other columns are not read. No pair is lost: every step
    drops only sets or pairs that cannot link.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    narrow = stage(_narrow_sets(docs), "shingle-sets")
    classes = stage(
        narrow.where(F.col("doc_id").isNotNull() & (F.col("n") > 0))
        .groupBy("n", "f", "g")
        .agg(F.min("doc_id").alias("rep")),
        "shingle-classes",
    )
    hashes = narrow.agg(F.sum("n")).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), hashes // (3 * BUCKET))
    looked = F.least(F.col("n"), _spare("n") + 1 + F.floor(F.col("n") / 10))
    known = docs.where(F.col("doc_id").isNotNull())
    survivors = stage(
        classes.withColumnRenamed("rep", "doc_id")
        .join(shared_counts(known, buckets), "doc_id")
        .where(F.col("shared") >= looked - _spare("n"))
        .select("doc_id", (F.col("shared") / looked).alias("central")),
        "shingle-survivors",
    )
    sets = stage(_full_sets(known.join(_if_small(survivors), "doc_id")), "shingle-full")
    first = stage(_stars(sets), "shingle-stars")
    opened = stage(_still_open(_grouped(sets, first)), "shingle-open")
    # Variants of one another that are far from the first centres get centres of their own.
    ends = F.explode(F.array("doc_id", "centre")).alias("doc_id")
    touched = _if_small(stage(first.where("linked").select(ends).distinct(), "shingle-touched"))
    second = stage(_stars(opened.join(touched, "doc_id", "left_anti")), "shingle-stars")
    stars = first.unionByName(second)
    direct = stars.where("linked").select(F.col("doc_id").alias("a"), F.col("centre").alias("b"))
    opened = stage(_open_tokens(_grouped(opened.drop("grp"), stars)), "shingle-lists")
    pairs = stage(_cross_pairs(opened), "shingle-pairs")
    edges = direct.unionByName(_answers(pairs, sets, stars))
    components = connected_components(edges, "a", "b")
    named = narrow.join(classes, ["n", "f", "g"], "left").join(
        components.select(F.col("node").alias("rep"), F.col("component")), "rep", "left"
    )
    return named.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, that of the smallest doc_id, with all its columns.

    Repeated rows of an id leave one; rows without doc_id link with nothing and all stay.
    """
    first = link_documents(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id")
    named = docs.where(F.col("doc_id").isNotNull())
    stay = named.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))


@query("op8_shingle_join")
def op8_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under links of 0.8 Jaccard similarity on five-word shingles."""
    return link_documents(table(spark, sf_dir, "documents"))
