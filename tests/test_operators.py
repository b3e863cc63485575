"""Operators against brute force, literal cases and hot keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import errors as E
from folioscope.operators import graph as G
from folioscope.operators import inventory as I
from folioscope.operators import joins as J
from folioscope.operators import links as L
from folioscope.operators import oplog as O
from folioscope.operators import quality as Q
from folioscope.operators import state as T
from folioscope.operators import symbols as S
from folioscope.plans import reports


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_join_salts_hot_keys_only(spark, how):
    facts = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 1, None).otherwise((F.col("id") % 50).cast("string")).alias("k"), "id"
    )
    lookup = spark.createDataFrame([("hot", 1)] + [(str(i), i) for i in range(0, 50, 2)], "k string, v int")
    plain = facts.join(lookup, "k", how)
    salted = J.lookup_join(facts, lookup, "k", how, heavy_rows=100)
    key = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert key(salted) == key(plain)
    assert "_salt" in salted._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("heavy", ["nulls", "one in two thousand"])
def test_lookup_join_has_no_hot_task(spark, heavy):
    if heavy == "nulls":
        key = F.when(F.col("id") % 10 == 0, (F.col("id") % 997).cast("string"))
    else:
        key = F.when(F.col("id") % 40 == 0, "hot").otherwise(F.col("id").cast("string"))
    facts = spark.range(80_000).select(key.alias("k"), "id")
    lookup = facts.where("k is not null").select("k").distinct().withColumn("v", F.lit(1))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = J.lookup_join(facts, lookup, "k", "left", heavy_rows=500)
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 80_000 and max(sizes) <= 3 * sum(sizes) / len(sizes)


def test_components_leave_two_folders(spark):
    from pathlib import Path

    from folioscope.staging import _home, release

    release(spark)
    chain = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = G.connected_components(chain, "a", "b")
    assert found.where("component = 0").count() == 401
    assert len(list(Path(_home(spark)).glob("components-*/slot*"))) == 2
    assert not list(Path(_home(spark)).glob("facts-*"))


def test_number_rows(spark):
    df = spark.range(1000).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("k"))
    got = [r.k for r in J.number_rows(df, ["k"]).orderBy("position").collect()]
    assert got == sorted(f"n{i}" for i in range(1000))
    batches = J.batches(df, ["k"], 300).groupBy("batch").count()
    assert rows(batches) == [(0, 300), (1, 300), (2, 300), (3, 100)]


def brute_components(pairs):
    seen = {}
    for a, b in pairs:
        if a != b:
            seen.setdefault(a, a), seen.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            if a != b and seen[a] != seen[b]:
                seen[a] = seen[b] = min(seen[a], seen[b])
                changed = True
    return sorted(seen.items())


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(80):03}", f"n{rng.randrange(80):03}") for _ in range(45)]
    pairs += [(f"c{i:03}", f"c{i + 1:03}") for i in range(40)] + [("hub", f"h{i}") for i in range(40)]
    edges = spark.createDataFrame(pairs, "a string, b string")
    assert rows(G.connected_components(edges, "a", "b")) == brute_components(pairs)


def test_components_of_nothing(spark):
    edges = spark.createDataFrame([("x", "x")], "a string, b string")
    assert rows(G.connected_components(edges, "a", "b")) == []


@pytest.mark.parametrize("seed", [3, 4])
def test_transitive_reduction(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"m{rng.randrange(12)}", f"m{rng.randrange(12)}") for _ in range(50)}
    pairs = {(a, b) for a, b in pairs if a != b}
    kept = {
        (u, w) for u, w in pairs
        if not any((u, v) in pairs and (v, w) in pairs for v in {b for a, b in pairs if a == u} - {w})
    }
    got = G.reduce_transitive(spark.createDataFrame(sorted(pairs), "source string, target string"))
    assert {tuple(r) for r in got.select("source", "target").collect()} == kept


def test_reduction_of_chain(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c")], "source string, target string")
    assert rows(G.reduce_transitive(edges)) == [("a", "b"), ("b", "c")]


TASKS = "id string, priority int"
DEPS = "id string, dep string"


def test_levels_and_priorities(spark):
    tasks = spark.createDataFrame([("a", 1), ("b", 5), ("c", 2), ("d", 2)], TASKS)
    deps = spark.createDataFrame([("c", "a"), ("c", "b"), ("d", "c")], DEPS)
    levels = G.dependency_levels(tasks, deps)
    assert rows(levels) == [("a", 0), ("b", 0), ("c", 1), ("d", 2)]
    assert rows(G.order_in_level(tasks, levels)) == [(0, 1, "b", 5), (0, 2, "a", 1), (1, 1, "c", 2), (2, 1, "d", 2)]


def test_levels_of_a_long_chain(spark):
    n = 12_000
    tasks = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("priority"))
    deps = spark.range(1, n).select(F.col("id").cast("string").alias("id"), (F.col("id") - 1).cast("string").alias("dep"))
    levels = G.dependency_levels(tasks, deps)
    assert levels.count() == n and levels.where("level <> cast(id as int)").isEmpty()


def test_levels_where_chains_meet(spark):
    pick = random.Random(6)
    want, pairs = {}, []
    for i in range(60):
        own = sorted({pick.randrange(i) for _ in range(pick.choice([0, 1, 1, 2]))}) if i else []
        pairs += [(str(i), str(d)) for d in own]
        want[str(i)] = max((want[str(d)] + 1 for d in own), default=0)
    tasks = spark.createDataFrame([(k, 1) for k in want], TASKS)
    assert {r.id: r.level for r in G.dependency_levels(tasks, spark.createDataFrame(pairs, DEPS)).collect()} == want


@pytest.mark.parametrize("deps", [[("a", "b"), ("b", "a")], [("a", "nowhere")]])
def test_levels_refuse_cycles_and_missing_tasks(spark, deps):
    tasks = spark.createDataFrame([("a", 1), ("b", 1)], TASKS)
    with pytest.raises(G.UnresolvedTasksError, match="a ->"):
        G.dependency_levels(tasks, spark.createDataFrame(deps, DEPS))


def test_levels_of_a_long_ladder_take_few_rounds(spark, monkeypatch):
    """Each task waits for the last one, for a leaf of its own and, every fifth, for one further back."""
    rounds = []
    chains = G._chains
    monkeypatch.setattr(G, "_chains", lambda *a: rounds.append(1) or chains(*a))
    n = 60
    pairs = [(k, k - 1) for k in range(1, n)] + [(k, 1000 + k) for k in range(1, n)] + [(k, k - 3) for k in range(5, n, 5)]
    tasks = spark.createDataFrame([(k,) for k in [*range(n), *range(1001, 1000 + n)]], "id long")
    levels = {r.id: r.level for r in G.dependency_levels(tasks, spark.createDataFrame(pairs, "id long, dep long")).collect()}
    assert levels == {k: k if k < n else 0 for k in levels} and len(levels) == 2 * n - 1
    assert len(rounds) < 8


def test_rounds_of_a_tree_write_each_name_twice_at_most(spark, monkeypatch):
    written = []
    write = G.Stage.write
    monkeypatch.setattr(G.Stage, "write", lambda self, df: written.append(df.dtypes) or write(self, df))
    ops = spark.createDataFrame([(f"o{i}", f"o{i - 1}" if i else None) for i in range(9)], "name string, parent string")
    got = {(r.name, r.root, r.depth, r.parent) for r in G.operation_tree(ops).collect()}
    assert got == {(f"o{i}", "o0", i, f"o{i - 1}" if i else None) for i in range(9)}
    assert written and all([t for _, t in columns].count("string") <= 2 for columns in written)


def test_operation_tree(spark):
    ops = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "b"), ("x", "gone")], "name string, parent string")
    tree = G.operation_tree(ops)
    assert rows(tree) == [
        ("a", "r", 1, "r"), ("b", "r", 2, "a"), ("c", "r", 3, "b"), ("r", "r", 0, None), ("x", "x", 0, None),
    ]
    assert {(r.name, r.depth, r.tree_path) for r in G.operation_tree(ops, root="a").collect()} == {
        ("a", 1, "a"), ("b", 2, "a/b"), ("c", 3, "a/b/c"),
    }
    circle = spark.createDataFrame([("a", "b"), ("b", "a")], "name string, parent string")
    with pytest.raises(ValueError, match="circle"):
        G.operation_tree(circle, max_rounds=6)


NOTES = [
    ("index.md", "# Index\n[[api/mod]] [[mod]] [[util|Utility]] [md](guide.md) [web](http://x)"),
    ("api/mod.md", "# Mod\n[[nowhere]] [up](../index.md) [dir](api/)"),
    ("guide.md", "text [[api/mod#Top]] [a](guide.md#x)"),
    ("lib/util.md", "alone"),
    ("a/same.md", ""),
    ("b/same.md", "[[same]]"),
]


@pytest.fixture(scope="module")
def notes(spark):
    return spark.createDataFrame(NOTES, "path string, content string")


def test_validity_is_by_path(spark, notes):
    links = L.extract_links(notes)
    got = {(r.source, r.target, r.type): r.valid for r in L.resolve_links(L.graph_links(links), notes.select("path")).collect()}
    assert got["index", "api/mod", "wikilink"] and got["index", "guide", "markdown_link"]
    assert not got["index", "mod", "wikilink"] and not got["api/mod", "nowhere", "wikilink"]
    assert not got["guide", "api/mod#Top", "wikilink"]
    assert not got["api/mod", "index", "markdown_link"]  # leaves the root
    assert got["api/mod", "api", "markdown_link"]  # a folder


def test_anchors_can_be_ignored(spark, notes):
    links = L.anchorless_validity(L.graph_links(L.extract_links(notes)), notes.select("path"))
    got = {(r.source, r.target): r.valid_ignoring_anchor for r in links.collect()}
    assert got["guide", "api/mod#Top"] and got["guide", "guide"]


def test_real_notes_win_over_placeholders(spark, notes):
    nodes = {r.name: r for r in L.build_nodes(notes, L.extract_links(notes)).collect()}
    assert nodes["api/mod"].inbound_links == 2  # by path and by unique stem
    assert nodes["lib/util"].inbound_links == 1 and nodes["lib/util"].exists and nodes["lib/util"].word_count == 1
    assert nodes["guide"].inbound_links == 0 and nodes["guide"].inbound_all == 1
    assert not nodes["nowhere"].exists and nodes["nowhere"].size == 0
    assert not nodes["same"].exists  # ambiguous stem
    assert rows(L.duplicate_stems(notes)) == [("same", 2, "a/same.md")]


def test_orphans_spare_entry_pages(spark, notes):
    found = {r.name for r in L.orphans(L.build_nodes(notes, L.extract_links(notes))).collect()}
    assert found == {"guide", "a/same", "b/same"}


def test_three_candidates(spark):
    files = spark.createDataFrame([("existing.md",), ("plain.txt",), ("raw",)], "path string")
    note = spark.createDataFrame([("n.md", "[[existing]] [[plain]] [[raw]] [[missing]] [[existing|Alias]]")], "path string, content string")
    assert rows(L.wikilink_candidates(note, files)) == [("existing", True), ("missing", False), ("plain", True), ("raw", True)]


@pytest.mark.parametrize("seed", [5])
def test_suggestions_against_brute_force(spark, seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choice("abAB_") for _ in range(n))
    names = sorted({word(rng.randrange(1, 8)) for _ in range(60)})
    targets = sorted({word(rng.randrange(1, 10)) for _ in range(30)})
    want = []
    for t in targets:
        hits = [n for n in names if n.lower() in t.lower() or t.lower() in n.lower()][:3]
        want += [(t, i + 1, n) for i, n in enumerate(hits)]
    got = L.link_suggestions(
        spark.createDataFrame([(t,) for t in targets], "target string"),
        spark.createDataFrame([(n, True) for n in names], "name string, exists boolean"),
    )
    assert rows(got) == sorted(want)


@pytest.mark.parametrize("task_rows", [2, 1_000_000])
def test_containment_finds_all_pairs(spark, monkeypatch, task_rows):
    monkeypatch.setattr(L, "TASK_ROWS", task_rows)
    rng = random.Random(2)
    word = lambda n: "common" * rng.randrange(2) + "".join(rng.choice("abcé") for _ in range(n))
    texts = sorted({word(rng.randrange(0, 12)) for _ in range(120)} | {"common", "", "ab"})
    patterns = sorted({word(rng.randrange(2, 6)) for _ in range(60)} | {t[1:6] for t in texts} | {"nowhere", "abc"})
    got = L.containment(
        spark.createDataFrame([(p,) for p in patterns], "pattern string"), spark.createDataFrame([(t,) for t in texts], "text string")
    )
    want = sorted((p, t) for p in patterns for t in texts if len(p) > L.GRAM and p in t)
    assert rows(got) == want and len(want) > 100


def test_scores_over_present_parts(spark):
    df = spark.createDataFrame([(80.0, None, 50.0), (None, None, None)], "completeness double, quality double, links double")
    got = [r.overall for r in Q.overall_score(df).collect()]
    assert got[0] == pytest.approx((8 * 0.4 + 5 * 0.25) / 0.65) and got[1] == 0.0


def test_empty_project_rules_differ(spark):
    modules = spark.createDataFrame([], "name string, file_path string, docstring string")
    symbols = spark.createDataFrame([], "module string, kind string, name string, docstring string, line_number int, is_private boolean")
    counts = Q.coverage_counts(modules, symbols)
    assert Q.completeness(counts).first().completeness == 100.0
    assert Q.coverage(counts).first().coverage == 0.0
    advice = [r.message for r in reports.validation_report(modules, symbols).collect()]
    assert advice[0] == "Low modules documentation coverage (0.0%) - add docstrings to 0 modules"


def test_complexity(spark):
    summary = spark.createDataFrame([("m", 5, 2, 6, 2, 3)], "name string, functions int, classes int, methods int, properties int, imports int")
    assert S.complexity(summary).first().complexity == pytest.approx(2.32)


def test_first_owner_in_path_order(spark):
    modules = spark.createDataFrame([("a", "z/a.py"), ("a.b", "a/b.py"), ("pkg", "pkg/__init__.py")], "name string, file_path string")
    imports = spark.createDataFrame([("m", 0, "a.b.c"), ("m", 1, "hashlib"), ("m", 2, "os.path"), ("m", 3, "pkg"), ("m", 4, "abc_x")], "module string, ord int, import_name string")
    assert rows(S.resolve_imports(imports, modules)) == [
        ("a.b.c", "internal", "a.b"), ("abc_x", "external", None), ("hashlib", "external", None),
        ("os.path", "stdlib", None), ("pkg", "internal", "pkg"),
    ]


def test_search_survives_missing_docstrings(spark):
    modules = spark.createDataFrame([("core", "core.py", None)], "name string, file_path string, docstring string")
    symbols = spark.createDataFrame([("core", "class", "Core", None, 3)], "module string, kind string, name string, docstring string, line_number int")
    assert {r.kind for r in S.search(modules, symbols, "core").collect()} == {"module", "class"}
    assert S.search(modules, symbols, "core", case_sensitive=True).count() == 1


def test_profile_without_source_folder(spark):
    files = spark.createDataFrame([("__init__.py",), ("main.py",), ("README.md",)], "path string")
    assert rows(S.source_folders(files, "p").drop("rank")) == [(".", 2, True)]
    got = S.repository_profile(files, "p").first()
    assert (got.has_tests, got.has_docs, got.project_size, got.package_structure) == (False, True, "small", "package")


def test_touch_counts_as_change(spark):
    t = dt.datetime(2024, 1, 1)
    schema = "path string, size long, mtime timestamp, hash string"
    before = spark.createDataFrame([("a", 1, t, "x"), ("b", 1, t, "x"), ("c", 1, t, None)], schema)
    now = spark.createDataFrame([("a", 1, t + dt.timedelta(1), "x"), ("c", 1, t, None), ("d", 1, t, "x")], schema)
    assert rows(T.diff_snapshots(now, before)) == [("a", "modified"), ("b", "deleted"), ("c", "unchanged"), ("d", "new")]


def test_full_build_is_due_without_one(spark):
    empty = lambda s: spark.createDataFrame([], s)
    got = T.build_stats(
        empty("path string"), empty("path string, dep string"), empty("source string, output string"),
        empty("last_full_build timestamp"), F.lit(dt.datetime(2024, 1, 1)),
    ).first()
    assert got.full_build_due and got.tracked_files == 0


def test_unknown_hash_fails_early(spark):
    with pytest.raises(ValueError):
        T.content_hash(F.lit("x"), "crc")


def test_retention_keeps_newest(spark):
    day = dt.datetime(2024, 6, 1)
    backups = spark.createDataFrame([("d", f"b{i}", day - dt.timedelta(i * 20)) for i in range(8)], "dir string, path string, mtime timestamp")
    gone = T.expired_backups(backups, F.lit(day), 30, 5)
    assert {r.path for r in gone.collect()} == {"b5", "b6", "b7"}
    assert T.expired_backups(backups, F.lit(day), 30, 8).count() == 0


def test_since_accepts_zulu_and_refuses_nonsense(spark):
    files = spark.createDataFrame([("a", dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 1))], "path string, mtime timestamp")
    assert [r.path for r in T.changes_since(files, "2024-01-01T12:00:00Z").collect()] == ["a"]
    assert T.changes_since(files, None).count() == 2
    assert not T.is_timestamp("yesterday") and T.changes_since(files, "yesterday").count() == 0


def event(name, seq, status, **kw):
    base = {"current": None, "increment": None, "total": None, "message": None, "parent": None}
    at = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seq)
    return {"name": name, "seq": seq, "ts": at, "status": status} | base | kw


LOG = "name string, seq long, ts timestamp, status string, current long, increment long, total long, message string, parent string"
EVENTS = [
    event("a", 0, "start", total=10, message="go"), event("a", 2, "update", current=4), event("a", 4, "update", increment=1, message="five"),
    event("b", 1, "update", current=3), event("b", 2, "start", parent="a"), event("b", 3, "completed"), event("b", 4, "cancelled"),
    event("b", 5, "start"), event("c", 0, "start", total=5), event("c", 3, "cancelled"), event("d", 1, "failed"),
]


def test_latest_state(spark):
    log = spark.createDataFrame([tuple(e.values()) for e in EVENTS], LOG)
    got = {r.name: r for r in O.latest_state(log).collect()}
    assert set(got) == {"a", "b", "c"}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.status, a.current, a.total, a.message, a.progress_percentage) == ("running", 5, 10, "five", 50.0)
    assert a.elapsed == 4.0 and a.estimated_remaining == pytest.approx(4.0)
    assert (b.status, b.current, b.total, b.parent) == ("completed", 1, 1, "a")
    assert (c.status, c.current, c.elapsed) == ("cancelled", 0, 3.0)
    assert {(r.name, r.rejected) for r in O.rejected_starts(log).collect()} == {("b", "already exists"), ("b", "not found"), ("d", "not found")}


def test_metadata_merges_per_key(spark):
    log = spark.createDataFrame(
        [("a", 1, {"x": "1", "y": "2"}), ("a", 2, {"x": "3"}), ("b", 1, {"z": "9"})], "name string, seq long, metadata map<string,string>"
    )
    got = {r.name: r.metadata for r in O.metadata_maps(O.merged_metadata(log)).collect()}
    assert got == {"a": {"x": "3", "y": "2"}, "b": {"z": "9"}}


def test_sessions_are_half_open_and_cross_buckets(spark):
    base = dt.datetime(2024, 1, 1)
    at = [0, 1.9, 3.8, 5.8, 9.9, 10.1, 30]
    events = spark.createDataFrame([("p", f"f{i % 3}", base + dt.timedelta(seconds=s)) for i, s in enumerate(at)], "project string, path string, ts timestamp")
    got = O.sessions(events, "project", 2.0, bucket_seconds=5).orderBy("ts").collect()
    assert [(r.session_start - base).total_seconds() for r in got] == [0, 0, 0, 5.8, 9.9, 9.9, 30]


def test_errors(spark):
    log = spark.createDataFrame(
        [("OSError", "[Errno 2] No such file or directory: 'x'", None), ("ModuleNotFoundError", "No module named 'yaml'", None),
         ("ValueError", "SPHINX crashed", None), ("KeyError", "strange", "obsidian_conversion"), ("MemoryError", "", None)],
        "exc_type string, message string, operation string",
    )
    found = E.classify(log)
    assert [(r.error_id.split("_KeyError")[0], r.category) for r in found.collect()] == [
        ("file_not_found", "file_system"), ("module_not_found", "dependency"), ("sphinx_build_error", "sphinx_build"),
        ("generic", "obsidian_conversion"), ("memory_error", "performance"),
    ]
    first = E.suggest(found).where("error_id = 'module_not_found' AND priority = 1").first()
    assert first.command == "uv add yaml" and "'yaml'" in first.description
    assert E.error_summary(found).first().has_critical


SOURCE = '''"""Mod."""
import os, sys
from typing import Any
from typing import List
from . import sibling
MAX: int = 3
name = True
class Box(Base, Generic[T]):
    size = 1
    kind: str | None = None
    def __init__(self, a: int, /, b: "Url", *c: int, d: List[int] = (), **e) -> None:
        local = 1
        def helper(): pass
    @property
    def label(self): """L."""
    @functools.lru_cache(maxsize=1)
    @staticmethod
    async def go(): ...
    class Inner: pass
def outer():
    x = 1
    class Local: pass
'''


def test_source_inventory(spark):
    files = spark.createDataFrame([("p/m.py", SOURCE), ("bad.py", "def ("), ("empty.py", "")], "path string, content string")
    records = I.extract(files)
    symbols = {r.name: r for r in I.symbols_of(records, "proj").collect()}
    assert {n: (r.kind, r.parent) for n, r in symbols.items()} == {
        "Box": ("class", None), "__init__": ("method", "Box"), "helper": ("function", "__init__"), "label": ("property", "Box"),
        "go": ("method", "Box"), "Inner": ("class", "Box"), "outer": ("function", None), "Local": ("class", "outer"),
    }
    init, box, go = symbols["__init__"], symbols["Box"], symbols["go"]
    assert init.signature == "__init__(self, b: Url, *c: int, **e, d: List[int]) -> None" or init.signature == "__init__(b: Url, *c: int, **e, d: List[int]) -> None"
    assert init.is_private and box.base_classes == ["Base", "Generic[T]"]
    assert box.variables == {"size": "int", "kind": "str | None"}
    assert go.is_async and go.is_static and go.decorators == ["functools.lru_cache", "staticmethod"]
    modules = {r.name: r for r in I.modules_of(records, files, "proj").collect()}
    assert set(modules) == {"p.m", "empty"}
    assert modules["p.m"].constants == {"MAX": "int"} and modules["p.m"].variables == {"name": "bool"}
    imports = I.imports_of(records, "proj")
    assert sorted(r.import_name for r in imports.collect()) == ["os", "sys", "typing", "typing"]
    assert rows(I.from_imports(imports)) == [("p.m", "typing", "Any"), ("p.m", "typing", "List")]
    assert [r.path for r in I.parse_errors(records).collect()] == ["bad.py"]


@pytest.mark.parametrize("since", ["20240101", "2024-W01-1", "20240101T000000", "2024-01-01T00:00:00Z", "2024-01-01 00:00:00+00:00"])
def test_changes_since_any_iso_form(spark, since):
    files = spark.sql("SELECT * FROM VALUES ('a', TIMESTAMP '2024-01-02 00:00:00'), ('b', TIMESTAMP '2023-12-31 00:00:00') t(path, mtime)")
    assert [r.path for r in T.changes_since(files, since).collect()] == ["a"]


def test_errors_without_type_or_message(spark):
    log = spark.createDataFrame([(None, None, None), ("ValueError", None, None)], "exc_type string, message string, operation string")
    got = E.classify(log).collect()
    assert all(r.error_id and r.title for r in got)


def reached_from(edges, node):
    seen, todo = set(), [node]
    while todo:
        for a, b in edges:
            if a == todo[-1] and b not in seen:
                seen.add(b)
                todo.insert(0, b)
        todo.pop()
    return seen


def random_graph(seed, n, m, acyclic):
    rng = random.Random(seed)
    pairs = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
    return sorted({(min(a, b), max(a, b)) for a, b in pairs if a != b} if acyclic else pairs)


@pytest.mark.parametrize(("seed", "n", "m"), [(1, 30, 40), (2, 12, 20)])
def test_cycles_against_closure(spark, seed, n, m):
    edges = random_graph(seed, n, m, False)
    reach = {v: reached_from(edges, v) for v in {x for e in edges for x in e}}
    same = {v: {v} | {w for w in reach[v] if v in reach[w]} for v in reach}
    df = spark.createDataFrame(edges, "source long, target long")
    assert rows(G.strong_components(df)) == sorted((v, min(s)) for v, s in same.items())
    stuck = {v for v in reach if v in reach[v]}
    report = {tuple(r) for r in G.cycle_report(df.toDF("id", "dep")).collect()}
    assert report == {(v, min(same[v]), len(same[v]), "in cycle") for v in stuck} | {
        (v, None, None, "behind") for v in reach if v not in stuck and reach[v] & stuck
    }


def mutual(pairs):
    return sorted({*pairs, *((b, a) for a, b in pairs)})


@pytest.mark.parametrize("edges", [
    mutual([(9, leaf) for leaf in range(9)]) + [(20, 21), (21, 3)],
    [(i, i + 1) for i in range(9)] + [(i, i + 2) for i in range(8)] + [(9, 0), (9, 30), (30, 31), (31, 30)],
    [(a * 10 + i, a * 10 + (i + 1) % 4) for a in range(5) for i in range(4)] + [(a * 10 + 2, a * 10 - 10) for a in range(1, 5)] + [(1, 33)],
    mutual([(i * 7 % 16, (i + 1) * 7 % 16) for i in range(12)] + [(0, b) for b in (40, 41, 42)]) + [(40, 50), (50, 51)],
    random_graph(5, 40, 90, False),
    [],
])
def test_strong_components_of_odd_shapes(spark, edges):
    reach = {v: reached_from(edges, v) for v in {x for e in edges for x in e}}
    want = sorted((v, min({v} | {w for w in reach[v] if v in reach[w]})) for v in reach)
    assert rows(G.strong_components(spark.createDataFrame(edges, "source long, target long"))) == want
    named = spark.createDataFrame([(f"n{a:03}", f"n{b:03}") for a, b in edges], "source string, target string")
    assert rows(G.strong_components(named)) == [(f"n{v:03}", f"n{c:03}") for v, c in want]


def test_circles_one_behind_the_other_take_few_rounds(spark, monkeypatch):
    written, write = [], G.Stage.write
    monkeypatch.setattr(G.Stage, "write", lambda self, df: written.append(1) or write(self, df))
    edges = [(a * 3 + i, a * 3 + (i + 1) % 3) for a in range(10) for i in range(3)] + [(a * 3, a * 3 + 3) for a in range(9)]
    got = rows(G.strong_components(spark.createDataFrame(edges, "source long, target long")))
    assert got == [(v, v - v % 3) for v in range(30)]
    assert len(written) < 30


@pytest.mark.parametrize(("seed", "n", "m"), [(3, 14, 40), (4, 25, 45)])
def test_full_reduction_against_closure(spark, seed, n, m):
    edges = random_graph(seed, n, m, True)
    want = [(a, b) for a, b in edges if not any(b in reached_from(edges, v) for u, v in edges if u == a and v != b)]
    df = spark.createDataFrame(edges, "source long, target long")
    assert rows(G.reduce_reachable(df)) == sorted(want) and len(want) < len(edges)
    with pytest.raises(G.UnresolvedTasksError):
        G.reduce_reachable(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "source long, target long"))
