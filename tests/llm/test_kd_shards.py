"""K-d sharding: its cuts against brute force, near equal shards, copies together, odd rows."""

import zlib
from collections import Counter, defaultdict

from brute import DOCUMENTS
from pyspark.sql import functions as F

from folioscope.llm import kd_shards
from folioscope.llm.catalog import QUERIES

SF = "/root/testdata/sf0.01"
DIMENSIONS = {"source": F.col("source"), "lang": F.col("lang"), "length": F.log2(1 + F.col("n_chars"))}


def brute_tree(rows, shards, room):
    """{at: shard} by sorting the rows of each node and trying every place to cut at."""
    if len(shards) == 1 or not rows:
        return {r.at: shards[0] for r in rows}
    widths = [(max(r[f"place{i}"] for r in rows) >> 36) - (min(r[f"place{i}"] for r in rows) >> 36) for i in range(3)]
    axis = f"place{widths.index(max(widths))}"
    half = len(shards) // 2
    wanted = max(1, sum(r.size for r in rows) * sum(room[s] for s in shards[:half]) // sum(room[s] for s in shards))
    weights = Counter()
    for r in rows:
        weights[r[axis]] += r.size
    at, best, upto = -1, wanted, 0
    for place in sorted(weights):
        upto += weights[place]
        if abs(upto - wanted) < best or (abs(upto - wanted) == best and upto >= wanted):
            at, best = place, abs(upto - wanted)
    left = [r for r in rows if r[axis] <= at]
    right = [r for r in rows if r[axis] > at]
    return {**brute_tree(left, shards[:half], room), **brute_tree(right, shards[half:], room)}


def test_cuts_are_brute_force_s(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows, target = kd_shards.points(docs, DIMENSIONS, 24)
    got = {(r.doc_id, r.shard) for r in kd_shards.kd_shards(docs, DIMENSIONS, 24).collect()}
    held = rows.collect()
    heavy, room = kd_shards._dealt([(r.size, r.at) for r in held if r.size > target // 8], target, 24)
    want = dict(heavy) | brute_tree([r for r in held if r.size <= target // 8], list(range(24)), room)
    assert got == {(r.doc_id, want[r.at]) for r in held}


def test_shards_of_the_query(spark):
    rows = QUERIES["op11_kd_shards"](spark, "/root/testdata/sf0.1").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, slots, homes = Counter(), defaultdict(list), defaultdict(set)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        homes[raw].add(r.shard)
    assert sorted(sizes) == list(range(24))
    assert max(sizes.values()) < 1.02 * min(sizes.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(shards) == 1 for shards in homes.values())


def test_a_third_of_all_rows_may_be_copies(spark):
    rows = [(i, "the same text " * 20 if i % 3 == 0 else f"text {i} " * (10 + i % 30), "s", None, 5) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    sizes = Counter()
    for r in kd_shards.kd_shards(docs, DIMENSIONS, 24).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) < 1.1 * min(sizes.values())


def test_odd_rows(odd_documents, no_documents):
    dimensions = {"source": F.col("source"), "lang": F.col("lang"), "score": F.col("score")}
    rows = kd_shards.kd_shards(odd_documents, dimensions, 4).collect()
    assert sorted((r.doc_id or 0, r.size) for r in rows) == sorted((i or 0, len((t or "").encode()) + 8) for i, t in DOCUMENTS)
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert kd_shards.kd_shards(no_documents, dimensions, 4).count() == 0
    one = kd_shards.kd_shards(odd_documents, {"id": F.col("doc_id")}, 1)
    assert {r.shard for r in one.collect()} == {0}


def test_places_follow_values(spark):
    values = ["http://a", "http://b/long", "http://b", "http://é", None]
    docs = spark.createDataFrame([(i, "x", v, float("nan") if i == 1 else float(i)) for i, v in enumerate(values)], "doc_id long, text string, url string, n double")
    raw = kd_shards.narrow(docs, {"url": F.col("url"), "n": F.col("n")})
    place = raw.select("raw_url", kd_shards._placed(raw, "raw_url", "http://a", "http://é").alias("p"))
    order = [r.raw_url for r in place.orderBy("p").collect()]
    assert order == [None, "http://a", "http://b", "http://b/long", "http://é"]
    assert kd_shards.kd_shards(docs, {"n": F.col("n")}, 3).count() == 5
