"""Exact top-k inner products by MaxScore over shards of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table

#: Vectors of a shard, and queries of a block, on average.
SHARD_ROWS = 4096
BLOCK_ROWS = 1024
#: Queries of a block that a shard answers at once.
QUERIES_AT_ONCE = 256
#: Heads of lists whose rows set the first threshold: so many lists, so many rows of each.
HEAD_LISTS, HEAD_ROWS = 4, 8
#: Lists count as essential until the bounds of the others sum to less than this share of the
#: threshold. At 1 the split is the least one; vectors without zeros have every row in nearly
#: every list, and a few lists more leave far fewer rows to be probed.
SPLIT_SHARE = 0.25
#: Terms that are probed between two looks at the threshold.
STRIDE = 8


class Shard:
    """One shard's vectors and, for each dimension, its rows by weight: a list for either sign."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.vectors = np.ascontiguousarray(vectors[order], dtype=np.float64)
        rows = np.argsort(self.vectors, axis=0, kind="stable")
        self.low_heads, self.high_heads = rows[:HEAD_ROWS], rows[::-1][:HEAD_ROWS]
        self.top, self.low = self.vectors.max(axis=0), self.vectors.min(axis=0)

    def _first_thresholds(self, own: np.ndarray, q: np.ndarray, terms: np.ndarray, k: int) -> np.ndarray:
        """For each query the k-th best score among the rows that head its strongest lists."""
        lead = terms[:, :HEAD_LISTS]
        up = np.take_along_axis(q, lead, axis=1) > 0
        rows = np.where(up[None], self.high_heads[:, lead], self.low_heads[:, lead])
        rows = np.sort(rows.transpose(1, 0, 2).reshape(len(q), -1), axis=1)
        score = np.einsum("qrd,qd->qr", self.vectors[rows], q)
        score[self.ids[rows] == own[:, None]] = -np.inf
        score[:, 1:][rows[:, 1:] == rows[:, :-1]] = -np.inf
        if score.shape[1] < k:
            return np.full(len(q), -np.inf)
        return np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]

    def search(self, own: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number of the query, id, score) of the k best rows of each query; ties to the smaller id.

        The bound of a term is the largest product any row has with the query there. Terms by
        falling bound are essential until the rest cannot lift a row to the threshold. The
        essential lists are traversed for all queries of the block at once; only rows that the
        rest may still lift to the threshold are probed there, a few terms at a time.
        """
        q = q.astype(np.float64)
        bound = np.maximum(q * self.top, q * self.low)
        terms = np.argsort(-bound, axis=1, kind="stable")
        falling = np.take_along_axis(bound, terms, axis=1)
        # rest[:, j]: the most that the terms from the j-th on can add; it may be below 0.
        rest = np.concatenate((np.cumsum(falling[:, ::-1], axis=1)[:, ::-1], np.zeros((len(q), 1))), axis=1)
        least = self._first_thresholds(own, q, terms, k)
        split = (rest > SPLIT_SHARE * np.maximum(least, 0)[:, None]).argmin(axis=1)
        split[np.isneginf(least)] = q.shape[1]
        place = np.argsort(terms, axis=1)
        essential = np.where(place < split[:, None], q, 0)
        score = essential @ self.vectors.T
        left = np.take_along_axis(rest, split[:, None], axis=1)
        of, row = np.nonzero(score + left >= least[:, None])
        score = score[of, row]
        keep = self.ids[row] != own[of]
        of, row, score = of[keep], row[keep], score[keep]
        for begin in range(int(split.min()), q.shape[1], STRIDE):
            end = min(begin + STRIDE, q.shape[1])
            few = terms[of, begin:end]
            weight = np.where(np.arange(begin, end)[None] >= split[of][:, None], np.take_along_axis(q[of], few, axis=1), 0)
            score = score + np.einsum("pt,pt->p", weight, self.vectors[row[:, None], few])
            reached = np.maximum(split[of], end)
            alive = score + rest[of, reached] >= least[of]
            of, row, score = of[alive], row[alive], score[alive]
        order = np.lexsort((self.ids[row], -score, of))
        of, row, score = of[order], row[order], score[order]
        rank = np.arange(len(of)) - np.searchsorted(of, of)
        best = rank < k
        return of[best], self.ids[row[best]], score[best].astype(np.int64)


def _packed(rows: DataFrame, groups: int, name: str) -> DataFrame:
    """Rows (vec_id, v) in ``groups`` even groups, each as binary columns; components take the least width."""

    def pack(batch: pa.Table) -> pa.Table:
        ids = batch.column("vec_id").to_numpy()
        v = batch.column("v").combine_chunks()
        flat, sizes = pc.list_flatten(v).to_numpy(), pc.list_value_length(v).to_numpy()
        reach = max(int(flat.max(initial=0)), -1 - int(flat.min(initial=0)))
        kind = np.min_scalar_type(-1 - reach)
        return pa.table(
            {
                name: pa.array([batch.column(name)[0].as_py()], pa.int64()),
                "ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                "sizes": pa.array([sizes.astype("<i4").tobytes()], pa.binary()),
                "flat": pa.array([flat.astype(kind.newbyteorder("<")).tobytes()], pa.binary()),
            }
        )

    return (
        rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
        .groupBy(name)
        .applyInArrow(pack, f"{name} long, ids binary, sizes binary, flat binary")
    )


def _unpacked(ids: bytes, sizes: bytes, flat: bytes) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and matrix of the vectors of each length."""
    i, s = np.frombuffer(ids, "<i8"), np.frombuffer(sizes, "<i4")
    at = np.concatenate(([0], np.cumsum(s)))
    f = np.frombuffer(flat, f"<i{len(flat) // at[-1] if flat else 8}")
    out = {}
    for n in np.unique(s):
        of = np.flatnonzero(s == n)
        out[int(n)] = i[of], f[at[of][:, None] + np.arange(n)[None, :]]
    return out


def scaled(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", by: int = 256) -> DataFrame:
    """(vec_id, v): components x as floor(by * x), without vectors that cannot take part.

    Left out are null vectors, empty ones, those with a null or non-finite component, and null
    ids. Rows that are equal in id and components count once.
    """
    x = F.transform(F.col(column), lambda c: c.cast("double"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (
        vectors.select(F.col(id_column).cast("long").alias("vec_id"), x.alias("x"), bad.alias("bad"))
        .where(F.col("vec_id").isNotNull() & (F.size("x") > 0) & ~F.col("bad"))
        .select("vec_id", F.transform("x", lambda c: F.floor(c * by).cast("long")).alias("v"))
        .distinct()
    )


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query its k best rows by inner product.

    Both tables are (vec_id, v) with v an array of long. A row with the query's own id is no
    candidate, nor is one of another length. Ties go to the smaller id. A query with fewer than
    k candidates gets all of them; without candidates it has no row, and empty tables give an
    empty result.

    Vectors form shards of some 4,096 rows and queries blocks of some 1,024, both packed into
    one row each. Every block meets every shard in a task step that holds one of each and
    computes in doubles, which are exact up to 2**53; it
    returns k rows per query and shard, which are merged, first in part, by query. Blocks are
    shuffled to the shards, never broadcast: there is a copy of each for every shard.
    """
    n, m = vectors.count(), queries.count()
    spark = vectors.sparkSession
    shards = max(1, n // SHARD_ROWS)
    blocks = max(1, m // BLOCK_ROWS)
    spread = max(spark.sparkContext.defaultParallelism, shards * blocks // 8)
    packed = _packed(vectors, shards, "shard")
    asked = (
        _packed(queries, blocks, "block")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards - 1).cast("long"))))
        .select("shard", *(F.col(c).alias(f"q_{c}") for c in ("ids", "sizes", "flat")))
    )
    # Blocks are small before they are repeated for each shard, so Spark would broadcast them.
    meetings = asked.join(packed.repartition(min(shards, spread), "shard").hint("merge"), "shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, mine = None, {}
        for batch in batches:
            for row in range(batch.num_rows):
                here = {c: batch.column(c)[row].as_py() for c in batch.schema.names}
                # The meetings of a shard follow each other.
                if here["shard"] != at:
                    at = here["shard"]
                    mine = {
                        size: Shard(*part)
                        for size, part in _unpacked(here["ids"], here["sizes"], here["flat"]).items()
                    }
                out = [(np.zeros(0, np.int64),) * 3]
                for size, (ids, vs) in _unpacked(here["q_ids"], here["q_sizes"], here["q_flat"]).items():
                    if size in mine:
                        for begin in range(0, len(ids), QUERIES_AT_ONCE):
                            own = ids[begin : begin + QUERIES_AT_ONCE]
                            of, found, score = mine[size].search(own, vs[begin : begin + QUERIES_AT_ONCE], k)
                            out.append((own[of], found, score))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[j] for x in out]), pa.int64()) for j in range(3)],
                    ["query_id", "vec_id", "score"],
                )

    found = meetings.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.max("score").alias("score"))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


SQL = """
WITH rows_ AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), cells AS (
  SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS d FROM rows_
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM cells q JOIN cells c ON q.d = c.d AND q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
  GROUP BY ALL
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op5_maxscore", SQL)
def op5_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every vector whose id is divisible by 50, its five best among all others."""
    rows = scaled(table(spark, sf_dir, "embeddings"))
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0))
