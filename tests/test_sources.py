"""File scans, sinks, state tables and streams."""

import datetime as dt
import json

from pyspark.sql import functions as F

from folioscope import staging
from folioscope.operators import inventory as I
from folioscope.operators import state as T
from folioscope.sources import files, sinks
from folioscope.sources.state_store import BUILD_META, FILE_STATE, StateTable
from folioscope.streaming import changes as C


def tree(tmp_path):
    root = tmp_path / "proj"
    for path, text in {
        "src/a.py": "import b\n", "src/pkg/__init__.py": "", "tests/test_a.py": "x = 1\n", "docs/n.md": "# N\r\nline\n",
        "docs/deep/m.md": "m", "site/p.html": "<body><h1>P</h1></body>", ".hidden": "h", "docs/.secret.md": "s",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_bytes(text.encode())
    return str(root)


def test_scans(spark, tmp_path):
    root = tree(tmp_path)
    assert {r.path for r in files.scan_sources(spark, root, ["tests/"]).select("path").collect()} == {"src/a.py", "src/pkg/__init__.py"}
    notes = {r.path: r.content for r in files.scan_notes(spark, root).collect()}
    assert notes["docs/n.md"] == "# N\nline\n" and set(notes) == {"docs/n.md", "docs/deep/m.md", "docs/.secret.md"}
    assert files.scan_pages(spark, root).first().rel_path == "site/p.html"
    listed = files.scan_files(spark, root)
    assert {r.path for r in listed.collect()} == {"src/a.py", "src/pkg/__init__.py", "tests/test_a.py", "docs/n.md", "docs/deep/m.md", "site/p.html"}
    assert {r["size"] for r in listed.where("path = 'src/a.py'").collect()} == {9}
    ordered = [r.path for r in files.reading_order(files.scan_sources(spark, root).select("path")).collect()]
    assert ordered == ["src/a.py", "src/pkg/__init__.py", "tests/test_a.py"]


def test_snapshot_and_state_survive_rewriting(spark, tmp_path):
    root = tree(tmp_path)
    now = F.lit(dt.datetime(2024, 1, 1))
    table = StateTable(spark, str(tmp_path / "state"), "file_state", FILE_STATE)
    assert table.load().count() == 0
    current = files.snapshot(files.with_content(files.scan_sources(spark, root), root))
    diff = T.diff_snapshots(current, table.load())
    assert {r.change for r in diff.collect()} == {"new"}
    table.save(T.upsert_state(table.load(), T.changed_files(diff), current, now))
    assert {r.change for r in T.diff_snapshots(current, table.load()).collect()} == {"unchanged"}
    # Saving a table computed from itself reads the old version to the end.
    table.save(table.load().where("path LIKE 'src/%'"))
    assert table.load().count() == 2
    meta = StateTable(spark, str(tmp_path / "state"), "build_meta", BUILD_META)
    assert meta.load().count() == 0


def test_only_cache_misses_are_extracted(spark, tmp_path):
    root = tree(tmp_path)
    scanned = files.with_content(files.scan_sources(spark, root), root)
    current = scanned.withColumn("hash", T.content_hash(F.col("content")))
    now = dt.datetime(2024, 1, 1)
    cache = current.where("path = 'src/a.py'").select("path", "size", "hash", F.lit(now).alias("cached_at"))
    misses = T.cache_misses(current, cache, F.lit(now), 60)
    assert {r.path for r in misses.collect()} == {"src/pkg/__init__.py", "tests/test_a.py"}
    assert I.extract(misses).where("record = 'module'").count() == 2
    later = F.lit(now + dt.timedelta(seconds=61))
    assert T.cache_misses(current, cache, later, 60).count() == 3


def test_sinks(spark, tmp_path):
    notes = spark.createDataFrame([("a.md", "", "x"), ("d/b.md", "d", "y")], "path string, folder string, body string")
    written = sinks.write_notes(notes, str(tmp_path / "notes"))
    assert sorted(map(tuple, written.select("path", "folder", "body").collect())) == [("a.md", "", "x"), ("d/b.md", "d", "y")]
    sinks.write_report(notes.select("path"), str(tmp_path / "report"))
    lines = [json.loads(x) for f in (tmp_path / "report").glob("*.json") for x in f.read_text().splitlines()]
    assert {x["path"] for x in lines} == {"a.md", "d/b.md"}
    numbered = spark.range(100).select("id", F.col("id").cast("string").alias("line"))
    sinks.write_lines(numbered, ["id"], str(tmp_path / "lines"))
    text = "".join(f.read_text() for f in sorted((tmp_path / "lines").glob("part-*")))
    assert text.split() == [str(i) for i in range(100)]


def test_release_removes_staged_tables(spark):
    staged = staging.stage(spark.range(3), "probe")
    assert staged.count() == 3
    assert staging.release(spark)


def test_change_stream_reaches_every_callback(spark, tmp_path):
    schema = "project string, path string, event_type string, ts timestamp"
    base = dt.datetime(2024, 1, 1)
    events = [
        ("p", "src/a.py", "modified", base), ("p", "src/a.py", "modified", base + dt.timedelta(seconds=1)),
        ("p", "src/b.py", "created", base + dt.timedelta(seconds=1.5)), ("p", "src/c.txt", "modified", base),
        ("p", "src/z.py", "deleted", base + dt.timedelta(minutes=5)),
    ]
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = C.intake(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["src"], [])
    state = spark.createDataFrame([("src/a.py", 1, base, "old"), ("src/b.py", 1, base, "same")], "path string, size long, mtime timestamp, hash string")
    current = spark.createDataFrame([("src/a.py", 1, base, "new"), ("src/b.py", 1, base, "same")], state.schema)
    seen = []

    def broken(df, batch):
        raise RuntimeError("callback")

    query = C.notify_changes(
        C.debounce(stream), lambda: current, lambda: state,
        [broken, lambda df, batch: seen.extend(map(tuple, df.collect()))], str(tmp_path / "ck"), availableNow=True,
    )
    query.awaitTermination()
    assert seen == [("src/a.py", "modified")]
    assert C.watch_status(query)["is_watching"] is False


def test_listing_holds_no_whole_folder(tmp_path):
    """Entries of a mounted folder come one by one."""
    from pyarrow import fs

    for i in range(5):
        (tmp_path / f"_f{i}.py").write_text("x" * i)
    (tmp_path / "deep").mkdir()
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    entries = files._entries(fs.LocalFileSystem(), str(tmp_path))
    first = next(entries)
    (tmp_path / "later").mkdir()
    got = {e[:3] for e in [first, *entries]}
    assert got - {("later", True, 0)} == {(f"_f{i}.py", False, i) for i in range(5)} | {("deep", True, 0)}
