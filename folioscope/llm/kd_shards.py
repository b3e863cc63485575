"""Shards of near equal bytes by a k-d tree over metadata, in DataFrame functions alone."""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.operators.joins import lookup_join
from folioscope.staging import stage

#: Bits of a place: of its dimension, of the text's hash, and of the part of a group of copies.
VALUE_BITS, TIE_BITS, PART_BITS = 26, 24, 12
#: Intervals into which a pass divides what is left of a node's places.
INTERVALS = 1024
#: Equal texts stay together up to this part of a shard; rows over that part are dealt first.
GROUP_PART, HEAVY_PART = 64, 8


class Cut(NamedTuple):
    """An inner node: rows up to ``place`` along ``axis`` belong to ``left``, the others to ``right``."""

    axis: int
    place: int
    left: Cut | int
    right: Cut | int


class Open(NamedTuple):
    """A node that is still to be cut, or a leaf if it has one shard."""

    number: int
    shards: list[int]


def narrow(docs: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """One short row for each document; the text is read here and nowhere else.

    ``part`` and ``at`` are the task and place in which the row was read.
    """
    text = F.coalesce("text", F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("said"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("at"),
        *(c.alias(f"raw_{name}") for name, c in dimensions.items()),
    )


def _placed(rows: DataFrame, column: str, low, high) -> Column:
    """A value's place between the least and the greatest, from 1 on; null is before all, at 0.

    Strings are placed by the six bytes that follow what all of them begin with, in byte order.
    """
    top = (1 << VALUE_BITS) - 2
    value = F.col(column)
    if dict(rows.dtypes)[column] == "string":
        shared = len(os.path.commonprefix([low.encode(), high.encode()])) if low is not None else 0
        six = F.substring(value.cast("binary"), shared + 1, 6)
        value = F.conv(F.rpad(F.hex(six), 12, "0"), 16, 10).cast("double")
        low, high = (int((x or "").encode()[shared : shared + 6].ljust(6, b"\0").hex(), 16) for x in (low, high))
    else:
        value = value.cast("double")
    if low is None or high <= low:
        return F.when(value.isNull(), 0).otherwise(1).cast("long")
    share = F.least(F.greatest((value - low) / (float(high) - float(low)), F.lit(0.0)), F.lit(1.0))
    return F.when(value.isNull(), 0).otherwise(1 + F.floor(share * (top - 1))).cast("long")


def points(docs: DataFrame, dimensions: dict[str, Column], count: int) -> tuple[DataFrame, int]:
    """Staged rows with a place for each dimension, and the bytes of a shard, at least 1.

    A place is the scaled value, then a hash of the text, so that equal values are still told
    apart. Copies take the least value of their group, so that they have one place and stay
    together; a group of more than 1/64 of a shard is dealt over as many parts as that takes.
    """
    raw = [f"raw_{name}" for name in dimensions]
    rows = stage(narrow(docs, dimensions), "sharding")
    bounds = rows.agg(
        F.sum("size").alias("total"),
        *(f(F.when(~F.isnan(c), F.col(c)) if kind in ("double", "float") else F.col(c)).alias(f"{n}_{c}")
          for c, kind in rows.select(raw).dtypes for n, f in (("low", F.min), ("high", F.max))),
    ).first()
    target = max(1, -(-(bounds["total"] or 0) // count))
    values = [f"value{i}" for i in range(len(raw))]
    placed = rows.select(
        "doc_id", "size", "text_crc32", "said", "part", "at",
        *(_placed(rows, c, bounds[f"low_{c}"], bounds[f"high_{c}"]).alias(v) for c, v in zip(raw, values, strict=True)),
    )
    copies = (
        placed.groupBy("said")
        .agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("bytes"), *(F.min(v).alias(f"group_{v}") for v in values))
        .where("copies > 1")
    )
    joined = lookup_join(placed, copies, "said", "left", staged=True)
    parts = F.ceil(F.coalesce("bytes", F.lit(0)) * GROUP_PART / target)
    part = F.when(parts > 1, F.pmod(F.xxhash64("at"), F.least(parts, F.lit(1 << PART_BITS)))).otherwise(0)
    tie = F.shiftrightunsigned(F.xxhash64("said"), 64 - TIE_BITS)
    low = F.shiftleft(tie, PART_BITS) + part
    places = [
        (F.shiftleft(F.coalesce(f"group_{v}", v), TIE_BITS + PART_BITS) + low).alias(f"place{i}")
        for i, v in enumerate(values)
    ]
    return stage(joined.select("doc_id", "size", "text_crc32", "part", "at", *places), "points"), target


def _walk(node: Cut | Open | int, leaf) -> Column:
    """The column that ``leaf`` makes for whatever node a row comes to."""
    if not isinstance(node, Cut):
        return leaf(node)
    return F.when(F.col(f"place{node.axis}") <= node.place, _walk(node.left, leaf)).otherwise(_walk(node.right, leaf))


def _opened(node: Cut | Open) -> list[Open]:
    return [*_opened(node.left), *_opened(node.right)] if isinstance(node, Cut) else [node]


def _replaced(node: Cut | Open, done: dict[int, Cut]) -> Cut | Open:
    if isinstance(node, Cut):
        return node._replace(left=_replaced(node.left, done), right=_replaced(node.right, done))
    return done.get(node.number, node)


class Search(NamedTuple):
    """Where a node's weighted median still may be: places from ``low`` to ``high``."""

    axis: int
    low: int
    high: int
    below: int
    wanted: int


def medians(rows: DataFrame, tree: Cut | Open, open_: dict[int, Search]) -> dict[int, tuple[int, int]]:
    """(axis, place) for each node: the place up to which its rows come nearest to the bytes wanted.

    Each pass sums bytes over a thousand intervals of every node at once and goes on inside the
    interval in which the wanted sum is reached, until that holds a single place. Rows are not
    shuffled, only sums are, and of these a pass brings one row per node to the driver.
    """
    found: dict[int, tuple[int, int]] = {}
    while open_:

        def state(node: Open, open_=open_) -> Column:
            s = open_.get(node.number)
            if s is None:
                return F.lit(None).cast("struct<node:int,place:bigint,cell:bigint,wanted:bigint>")
            place = F.col(f"place{s.axis}")
            step = (s.high - s.low) // INTERVALS + 1
            inside = place.between(s.low, s.high)
            return F.when(
                inside,
                F.struct(
                    F.lit(node.number).cast("int").alias("node"),
                    place.alias("place"),
                    F.floor((place - s.low) / F.lit(step)).cast("long").alias("cell"),
                    F.lit(s.wanted - s.below).cast("long").alias("wanted"),
                ),
            )

        held = rows.select("size", _walk(tree, state).alias("s")).where("s is not null").select("size", "s.*")
        cells = held.groupBy("node", "cell", "wanted").agg(
            F.sum("size").alias("bytes"), F.min("place").alias("low"), F.max("place").alias("high")
        )
        upto = Window.partitionBy("node").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        hit = cells.withColumn("upto", F.sum("bytes").over(upto)).where("upto >= wanted and upto - bytes < wanted")
        next_: dict[int, Search] = {}
        for r in hit.collect():
            s = open_[r.node]
            before = r.upto - r.bytes
            if r.low < r.high:
                next_[r.node] = s._replace(low=r.low, high=r.high, below=s.below + before)
            else:
                nearer = r.wanted - before < r.upto - r.wanted
                found[r.node] = (s.axis, r.low - 1 if nearer else r.low)
        open_ = next_
    return found


def kd_tree(rows: DataFrame, axes: int, room: list[int]) -> Cut | int:
    """The tree whose leaves are the numbers of shards, each with its share of ``room``.

    A node of several shards is cut along the axis on which its rows lie widest apart, the first
    such, at the weighted median: the place that parts its bytes like the room of both halves.
    """
    shift = TIE_BITS + PART_BITS
    shards = [s for s, r in enumerate(room) if r > 0] or [0]
    tree: Cut | Open = Open(0, shards)
    number = 0
    while cutting := [n for n in _opened(tree) if len(n.shards) > 1]:
        node = _walk(tree, lambda n: F.lit(n.number)).alias("node")
        spans = rows.groupBy(node).agg(
            F.sum("size").alias("bytes"),
            *(f(f"place{i}").alias(f"{k}{i}") for i in range(axes) for k, f in (("low", F.min), ("high", F.max))),
        )
        spans = {r.node: r for r in spans.collect()}
        searches: dict[int, Search] = {}
        for n in cutting:
            r, half = spans.get(n.number), len(n.shards) // 2
            if r is None:
                continue
            widths = [(r[f"high{i}"] >> shift) - (r[f"low{i}"] >> shift) for i in range(axes)]
            axis = widths.index(max(widths))
            left, both = sum(room[s] for s in n.shards[:half]), sum(room[s] for s in n.shards)
            searches[n.number] = Search(axis, r[f"low{axis}"], r[f"high{axis}"], 0, max(1, r.bytes * left // both))
        places = medians(rows, tree, searches)
        done: dict[int, Cut] = {}
        for n in cutting:
            half = len(n.shards) // 2
            axis, place = places.get(n.number, (0, -1))
            done[n.number] = Cut(axis, place, Open(number + 1, n.shards[:half]), Open(number + 2, n.shards[half:]))
            number += 2
        tree = _replaced(tree, done)
    return _leaves(tree)


def _leaves(node: Cut | Open) -> Cut | int:
    if isinstance(node, Cut):
        return node._replace(left=_leaves(node.left), right=_leaves(node.right))
    return node.shards[0]


def _dealt(sizes: list[tuple[int, int]], target: int, count: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Shards of the heavy rows (size, at), the largest first into the emptiest, and the room left."""
    room, out = [target] * count, []
    for size, at in sorted(sizes, key=lambda r: (-r[0], r[1])):
        shard = max(range(count), key=lambda s: (room[s], -s))
        room[shard] -= size
        out.append((at, shard))
    return out, room


def kd_shards(docs: DataFrame, dimensions: dict[str, Column], count: int) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row of (doc_id, text).

    Law ``bytes``: shards have sizes as equal as the rows allow. Null and empty texts weigh 8
    bytes; equal texts, repeated rows among them, keep together while they take at most 1/64 of a
    shard. Null dimensions come before all others, and doc_id may be null. No rows give no
    rows; other columns are not read. ``slot`` numbers the rows of a shard in the order in which
    they were read.

    Rows of more than 1/8 of a shard, of which there are at most eight for each, cannot be
    balanced by a cut. They go first, each to the emptiest shard, and the tree fills the room left.
    """
    rows, target = points(docs, dimensions, count)
    large = F.col("size") > target // HEAVY_PART
    heavy, room = _dealt([(r.size, r.at) for r in rows.where(large).select("size", "at").collect()], target, count)
    tree = kd_tree(rows.where(~large), len(dimensions), room)
    shard = _walk(tree, F.lit).cast("int")
    if heavy:
        dealt = rows.sparkSession.createDataFrame(heavy, "at long, given int")
        rows = rows.join(F.broadcast(dealt), "at", "left")
        shard = F.coalesce("given", shard)
    return _slots(rows.withColumn("shard", shard))


def _slots(rows: DataFrame) -> DataFrame:
    """Number the rows of each shard: by the task that read them, and inside it by place.

    A window holds the rows of one task and shard, not those of a shard.
    """
    counts = rows.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("at"))
    return rows.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("offset") + inside - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op11_kd_shards")
def op11_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards, cut by source, language and the logarithm of their length."""
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "length": F.log2(1 + F.col("n_chars"))}
    return kd_shards(table(spark, sf_dir, "documents"), dimensions, 24)
