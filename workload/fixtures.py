"""Input views derived from the shared tables.

Each view is one SELECT in SQL that Spark and the checking database both understand, so both
build the same rows. Views may read the shared tables and earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS: dict[str, str] = {}

# Views that only the reference SQL uses.
ORACLE_VIEWS: dict[str, str] = {}

VIEWS["notes"] = """
SELECT doc_id,
  'doc_' || CAST(doc_id AS STRING) || '.md' AS path,
  CASE WHEN doc_id % 4 = 0
       THEN '---' || chr(10) || 'title: Doc ' || CAST(doc_id AS STRING) || chr(10) || '---' || chr(10) || chr(10)
       ELSE '' END
  || CASE WHEN doc_id % 3 <> 0 THEN '# Doc ' || CAST(doc_id AS STRING) || chr(10) || chr(10) ELSE '' END
  || text
  || CASE WHEN doc_id % 10 < 8 THEN chr(10) || '[[doc_' || CAST(doc_id + 1 AS STRING) || ']]' ELSE '' END
  || CASE WHEN doc_id % 25 = 1 THEN chr(10) || '[[doc_0|home]]' ELSE '' END
  || CASE WHEN doc_id % 5 = 0 THEN chr(10) || '[[missing_' || CAST(doc_id AS STRING) || ']]' ELSE '' END
  || CASE WHEN doc_id % 6 = 0 THEN chr(10) || '[site](http://x)' ELSE '' END
  || CASE WHEN doc_id % 7 = 0 THEN chr(10) || '[next](doc_' || CAST(doc_id + 1 AS STRING) || '.md)' ELSE '' END
  || CASE WHEN doc_id % 11 = 0 THEN chr(10) || '[a](doc_' || CAST(doc_id AS STRING) || '.md#top)' ELSE '' END
  || CASE WHEN doc_id % 13 = 0 THEN chr(10) || '[[DOC_1' || CAST(doc_id % 10 AS STRING) || ']]' ELSE '' END
  || CASE WHEN doc_id % 50 = 49 THEN chr(10) || '[[' ELSE '' END
    AS content,
  TIMESTAMP '2024-01-01 00:00:00' + doc_id * INTERVAL '1' MINUTE AS mtime
FROM documents
"""


def render_spark(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table or a fixture view as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = VIEWS[name]
    inputs = {t: render_spark(spark, sf_dir, t) for t in _references(sql)}
    for t in inputs:
        sql = re.sub(rf"\b(FROM|JOIN)\s+{t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **inputs)


def _references(sql: str) -> list[str]:
    names = [*TABLES, *VIEWS]
    return [n for n in names if _in_from(sql, n)]


def _in_from(sql: str, name: str) -> bool:
    return re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql) is not None


def with_views(sql: str) -> str:
    """Prepend the views the SQL reads, in order, as common table expressions."""
    needed: list[str] = []

    views = {**VIEWS, **ORACLE_VIEWS}

    seen: set[str] = set()

    def visit(text: str) -> None:
        for name in views:
            if name not in seen and re.search(rf"(?:\bFROM|\bJOIN|,)\s+{name}\b", text):
                seen.add(name)
                visit(views[name])
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    ctes = ", ".join(f"{n} AS ({views[n].strip()})" for n in needed)
    body = sql.strip()
    if re.match(r"WITH\s+RECURSIVE\b", body):
        return f"WITH RECURSIVE {ctes}, {body[len('WITH RECURSIVE'):].strip()}"
    if re.match(r"WITH\b", body):
        return f"WITH {ctes}, {body[4:].strip()}"
    return f"WITH {ctes} {body}"


VIEWS["modules"] = """
SELECT k, file_path,
  CASE WHEN file_path LIKE '%/__init__.py' THEN replace(replace(file_path, '/__init__.py', ''), '/', '.')
       ELSE replace(replace(file_path, '.py', ''), '/', '.') END AS name,
  docstring,
  file_path LIKE '%/__init__.py' AS is_package,
  CASE WHEN k % 97 = 0 THEN '' WHEN k % 50 = 0 THEN folder || '/p' || CAST(k AS STRING) ELSE folder END AS folder,
  size, mtime
FROM (
  SELECT p_partkey AS k,
    lower(replace(replace(p_brand, '#', '_'), ' ', '_')) || '/' || lower(replace(p_type, ' ', '_')) AS folder,
    CASE WHEN p_partkey % 97 = 0 THEN CASE WHEN p_partkey % 194 = 0 THEN '_m' ELSE 'm' END || CAST(p_partkey AS STRING) || '.py'
         WHEN p_partkey % 50 = 0 THEN lower(replace(replace(p_brand, '#', '_'), ' ', '_')) || '/' || lower(replace(p_type, ' ', '_'))
              || '/p' || CAST(p_partkey AS STRING) || '/__init__.py'
         ELSE lower(replace(replace(p_brand, '#', '_'), ' ', '_')) || '/' || lower(replace(p_type, ' ', '_'))
              || '/m' || CAST(p_partkey AS STRING) || '.py' END AS file_path,
    CASE WHEN p_size % 3 = 0 THEN NULL WHEN p_size % 11 = 0 THEN '   '
         ELSE 'Module about ' || p_name || repeat(' and more text', p_size) END AS docstring,
    1000 + p_partkey * 3 AS size,
    TIMESTAMP '2024-01-01 00:00:00' + p_partkey * INTERVAL '3' MINUTE AS mtime
  FROM part
) x
"""

VIEWS["package_modules"] = """
SELECT k, file_path, name, docstring, is_package, replace(folder, '/', '.') AS package_path, size, mtime FROM modules
"""

VIEWS["symbols"] = """
SELECT m.name AS module,
  CASE WHEN h < 2 THEN 'class' WHEN h < 6 THEN 'function' WHEN h < 9 THEN 'method' ELSE 'property' END AS kind,
  private_mark || CASE WHEN h < 2 THEN 'Class' WHEN h < 6 THEN 'func' WHEN h < 9 THEN 'meth' ELSE 'prop' END || '_' || serial AS name,
  CASE WHEN h >= 6 THEN CASE WHEN l_suppkey % 5 = 0 THEN '_Class_' ELSE 'Class_' END || serial END AS parent,
  l_linenumber * 10 AS line_number,
  CASE WHEN CAST(l_quantity AS INT) % 3 = 0 THEN NULL ELSE 'Does ' || l_returnflag || ' and ' || l_linestatus END AS docstring,
  private_mark = '_' AS is_private
FROM (
  SELECT l_partkey, l_suppkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
    (l_orderkey + l_linenumber) % 10 AS h,
    CAST(l_orderkey AS STRING) || '_' || CAST(l_linenumber AS STRING) AS serial,
    CASE WHEN CAST(l_quantity AS INT) % 7 = 0 THEN '_' ELSE '' END AS private_mark
  FROM lineitem
) l JOIN modules m ON m.k = l.l_partkey
"""

VIEWS["imports"] = """
SELECT m.name AS module, i.ord, i.import_name FROM modules m JOIN (
  SELECT k, 0 AS ord, 'os' AS import_name FROM modules WHERE k % 2 = 0
  UNION ALL SELECT k, 1, 'requests.sessions' FROM modules WHERE k % 5 = 0
  UNION ALL SELECT k, 2, 'json.decoder' FROM modules WHERE k % 3 = 0
  UNION ALL SELECT k, 3, 'hashlib' FROM modules WHERE k % 7 = 0
  UNION ALL SELECT a.k, 4, b.name FROM modules a JOIN modules b ON b.k = a.k - 1 WHERE a.k % 4 <> 0
  UNION ALL SELECT a.k, 5, b.name FROM modules a JOIN modules b ON b.k = a.k - 2 WHERE a.k % 6 = 3
  UNION ALL SELECT a.k, 6, b.name FROM modules a JOIN modules b ON b.k = a.k - a.k % 10 WHERE a.k % 3 = 1
  UNION ALL SELECT a.k, 7, b.name || '.helper' FROM modules a JOIN modules b ON b.k = a.k - 3 WHERE a.k % 5 = 2
  UNION ALL SELECT k, 8, 'os' FROM modules WHERE k % 10 = 0
  UNION ALL SELECT k, 9, name FROM modules WHERE k % 29 = 0
) i ON i.k = m.k
"""

VIEWS["repo_files"] = """
SELECT CASE WHEN k % 3 = 0 THEN 'src/' || file_path WHEN k % 3 = 1 THEN 'lib/' || file_path
            WHEN k % 5 = 0 THEN 'tests/test_' || CAST(k AS STRING) || '.py'
            WHEN k % 5 = 1 THEN 'docs/page_' || CAST(k AS STRING) || '.rst'
            ELSE file_path END AS path, size, mtime
FROM modules
"""
