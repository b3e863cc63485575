"""Queries over modules, symbols and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import paths, rules
from folioscope.operators import graph as G
from folioscope.operators import joins as J
from folioscope.operators import symbols as S
from workload.fixtures import ORACLE_VIEWS, render_spark
from workload.registry import query

STDLIB_SQL = ", ".join(f"'{n}'" for n in S.STDLIB)

ORACLE_VIEWS["import_owners"] = f"""
SELECT import_name,
  CASE WHEN owner IS NOT NULL THEN 'internal' WHEN split_part(import_name, '.', 1) IN ({STDLIB_SQL}) THEN 'stdlib' ELSE 'external' END AS import_class, owner
FROM (SELECT i.import_name, (SELECT m.name FROM modules m WHERE i.import_name = m.name OR starts_with(i.import_name, m.name || '.')
        ORDER BY string_split(m.file_path, '/') LIMIT 1) AS owner
      FROM (SELECT DISTINCT import_name FROM imports) i)
"""
ORACLE_VIEWS["module_edges"] = """
SELECT DISTINCT i.module AS source, o.owner AS target FROM imports i JOIN import_owners o ON o.import_name = i.import_name
WHERE o.owner IS NOT NULL AND o.owner <> i.module
"""
ORACLE_VIEWS["reduced_edges"] = """
SELECT source, target FROM module_edges e
WHERE NOT EXISTS (SELECT 1 FROM module_edges a JOIN module_edges b ON b.source = a.target WHERE a.source = e.source AND b.target = e.target)
"""


def _modules(spark, sf):
    return render_spark(spark, sf, "package_modules")


def _code(spark, sf):
    return _modules(spark, sf), render_spark(spark, sf, "imports")


@query(
    "module_identity",
    """
SELECT file_path, name, package_path, is_package, CAST(split(replace(file_path, '.py', ''), '/')[-1] AS VARCHAR) AS stem FROM package_modules
""",
)
def module_identity(spark, sf):
    path = F.col("file_path")
    return _modules(spark, sf).select(
        "file_path",
        paths.module_name(path, "project").alias("name"),
        paths.package_path(path).alias("package_path"),
        paths.is_package(path).alias("is_package"),
        paths.stem(path).alias("stem"),
    )


@query("import_classes", "SELECT import_name, import_class, owner FROM import_owners")
def import_classes(spark, sf):
    modules, imports = _code(spark, sf)
    return S.resolve_imports(imports, modules)


@query(
    "classified_imports",
    "SELECT i.module, i.ord, i.import_name, o.import_class, o.owner FROM imports i JOIN import_owners o ON o.import_name = i.import_name",
)
def classified_imports(spark, sf):
    modules, imports = _code(spark, sf)
    return S.classified_imports(imports, modules).select(
        "module", "ord", "import_name", "import_class", "owner"
    )


@query(
    "non_stdlib_imports",
    f"SELECT DISTINCT import_name FROM imports WHERE split_part(import_name, '.', 1) NOT IN ({STDLIB_SQL})",
)
def non_stdlib_imports(spark, sf):
    return _code(spark, sf)[1].where(~S.is_stdlib(F.col("import_name"))).select("import_name").distinct()


@query("dependency_sets", "SELECT import_name, import_class FROM import_owners")
def dependency_sets(spark, sf):
    modules, imports = _code(spark, sf)
    return S.dependency_sets(imports, modules)


@query(
    "dependency_sets_of_package",
    "SELECT DISTINCT i.import_name, o.import_class FROM imports i JOIN import_owners o ON o.import_name = i.import_name WHERE starts_with(i.module, 'brand_1')",
)
def dependency_sets_of_package(spark, sf):
    modules, imports = _code(spark, sf)
    return S.dependency_sets(imports.where(F.col("module").startswith("brand_1")), modules)


@query(
    "dependency_rows",
    """
SELECT m.name AS module, i.ord, i.import_name FROM modules m
LEFT JOIN (SELECT i.* FROM imports i JOIN import_owners o ON o.import_name = i.import_name WHERE o.import_class = 'internal') i ON i.module = m.name
""",
)
def dependency_rows(spark, sf):
    modules, imports = _code(spark, sf)
    return S.dependency_rows(imports, modules)


@query("module_edges", "SELECT source, target FROM module_edges")
def module_edges(spark, sf):
    modules, imports = _code(spark, sf)
    return S.module_edges(imports, modules)


@query("module_dependency_graph", "SELECT source, target FROM reduced_edges")
def module_dependency_graph(spark, sf):
    modules, imports = _code(spark, sf)
    return S.dependency_graph(imports, modules)


@query("dependency_relationships", "SELECT count(*) AS dependency_relationships FROM reduced_edges")
def dependency_relationships(spark, sf):
    modules, imports = _code(spark, sf)
    return S.dependency_graph(imports, modules).agg(
        F.count(F.lit(1)).alias("dependency_relationships")
    )


@query(
    "independent_modules",
    "SELECT name FROM modules WHERE name NOT IN (SELECT source FROM reduced_edges)",
)
def independent_modules(spark, sf):
    modules, imports = _code(spark, sf)
    return G.without_dependencies(modules.select("name"), S.module_edges(imports, modules))


@query(
    "file_dependencies",
    "SELECT a.file_path AS path, b.file_path AS dep FROM module_edges e JOIN modules a ON a.name = e.source JOIN modules b ON b.name = e.target",
)
def file_dependencies(spark, sf):
    modules, imports = _code(spark, sf)
    return S.file_dependencies(imports, modules)


@query(
    "package_members",
    """
SELECT p.package, m.name AS module FROM
 (SELECT DISTINCT unnest([list_aggregate(string_split(package_path, '.')[1:i], 'string_agg', '.') FOR i IN range(1, len(string_split(package_path, '.')) + 1)]) AS package
  FROM package_modules WHERE package_path <> '') p
LEFT JOIN package_modules m ON m.package_path = p.package
""",
)
def package_members(spark, sf):
    return S.packages(_modules(spark, sf))


@query(
    "submodules",
    """
SELECT m.package_path AS package, m.name AS module FROM package_modules m
WHERE NOT m.is_package AND m.package_path IN (SELECT package_path FROM package_modules WHERE is_package)
UNION ALL
SELECT p.package_path, p.package_path || '.sub_' || CAST(p.k AS VARCHAR) FROM package_modules p WHERE p.is_package
""",
)
def submodules(spark, sf):
    modules = _modules(spark, sf)
    added = modules.where("is_package").select(
        F.concat("package_path", F.lit(".sub_"), F.col("k").cast("string")).alias("name"),
        F.lit(False).alias("is_package"),
        "package_path",
    )
    return S.submodules(modules.select("name", "is_package", "package_path").unionByName(added))


@query(
    "top_packages",
    "SELECT DISTINCT split_part(package_path, '.', 1) AS package FROM package_modules WHERE package_path <> ''",
)
def top_packages(spark, sf):
    return S.top_packages(_modules(spark, sf))


@query(
    "public_top_level_modules",
    "SELECT name FROM package_modules WHERE package_path = '' AND NOT starts_with(name, '_')",
)
def public_top_level_modules(spark, sf):
    return S.public_top_level(_modules(spark, sf)).select("name")


@query(
    "contents_listing",
    """
SELECT 0 AS section, file_path AS sort_key, name AS entry FROM package_modules WHERE package_path = '' AND NOT starts_with(name, '_')
UNION ALL SELECT DISTINCT 1, split_part(package_path, '.', 1), split_part(package_path, '.', 1) FROM package_modules WHERE package_path <> ''
""",
)
def contents_listing(spark, sf):
    return S.contents_listing(_modules(spark, sf)).orderBy("section", "sort_key")


DIRECTIVE = "chr(10) || '.. automodule:: ' || {} || chr(10) || '   :members:' || chr(10) || '   :undoc-members:' || chr(10) || '   :show-inheritance:' || chr(10)"


@query(
    "module_pages",
    f"""
SELECT name, name || ' module' || chr(10) || repeat('=', length(name) + 7) || chr(10) || {DIRECTIVE.format('name')} AS page
FROM package_modules WHERE NOT is_package AND NOT starts_with(name, '_')
""",
)
def module_pages(spark, sf):
    return S.module_pages(_modules(spark, sf))


@query(
    "package_page_blocks",
    f"""
SELECT package_path AS package, '' AS module,
  package_path || ' package' || chr(10) || repeat('=', length(package_path) + 8) || chr(10) || {DIRECTIVE.format('package_path')}
  || chr(10) || 'Submodules' || chr(10) || '----------' || chr(10) || chr(10) AS block
FROM package_modules WHERE is_package
""",
)
def package_page_blocks(spark, sf):
    return S.package_page_blocks(_modules(spark, sf))


@query(
    "public_symbols",
    "SELECT module, kind, name FROM symbols WHERE NOT is_private AND NOT starts_with(coalesce(parent, ''), '_')",
)
def public_symbols(spark, sf):
    return S.public_symbols(render_spark(spark, sf, "symbols")).select("module", "kind", "name")


FOUND = """
SELECT kind, name, module, line_number, CASE WHEN length(coalesce(docstring, '')) > 200 THEN docstring[1:200] || '...' ELSE coalesce(docstring, '') END AS docstring,
  CASE WHEN contains(lower(name), 'r and') THEN 'name' ELSE 'docstring' END AS match_type
FROM (SELECT 'module' AS kind, name, name AS module, NULL::INTEGER AS line_number, docstring FROM modules
      UNION ALL SELECT kind, name, module, line_number, docstring FROM symbols WHERE kind IN ('class', 'function'))
WHERE contains(lower(name), 'r and') OR contains(lower(coalesce(docstring, '')), 'r and')
"""


@query("symbol_search", FOUND)
def symbol_search(spark, sf):
    return S.search(_modules(spark, sf), render_spark(spark, sf, "symbols"), "R and")


@query(
    "symbol_search_by_name",
    """
SELECT kind, name, module, line_number, coalesce(docstring, '') AS docstring, 'name' AS match_type
FROM symbols WHERE kind = 'class' AND contains(name, 'Class_1')
""",
)
def symbol_search_by_name(spark, sf):
    return S.search(
        _modules(spark, sf), render_spark(spark, sf, "symbols"), "Class_1", "classes", True
    )


@query(
    "symbol_search_totals",
    f"SELECT coalesce(kind, 'total') AS kind, count(*) AS matches FROM ({FOUND}) GROUP BY ROLLUP (kind)",
)
def symbol_search_totals(spark, sf):
    return S.search_totals(S.search(_modules(spark, sf), render_spark(spark, sf, "symbols"), "R and"))


ORACLE_VIEWS["module_counts"] = """
SELECT m.name, m.file_path, m.is_package, coalesce(s.f, 0) AS functions, coalesce(s.c, 0) AS classes, coalesce(s.m, 0) AS methods,
  coalesce(s.p, 0) AS properties, coalesce(i.n, 0) AS imports
FROM modules m LEFT JOIN (SELECT module, count(*) FILTER (kind = 'function') AS f, count(*) FILTER (kind = 'class') AS c,
  count(*) FILTER (kind = 'method') AS m, count(*) FILTER (kind = 'property') AS p FROM symbols GROUP BY module) s ON s.module = m.name
LEFT JOIN (SELECT module, count(*) AS n FROM imports GROUP BY module) i ON i.module = m.name
"""
COMPLEXITY = "(1.0::DOUBLE + functions * 0.1::DOUBLE + classes * 0.2::DOUBLE + methods * 0.05::DOUBLE + properties * 0.03::DOUBLE + imports * 0.02::DOUBLE)"


def _summary(spark, sf):
    modules, imports = _code(spark, sf)
    return S.module_summary(modules, render_spark(spark, sf, "symbols"), imports)


@query("module_summary", "SELECT * FROM module_counts")
def module_summary(spark, sf):
    return _summary(spark, sf)


@query(
    "module_complexity",
    f"SELECT name, {COMPLEXITY} AS complexity, greatest(0, 100 - floor({COMPLEXITY} * 10))::INTEGER AS priority FROM module_counts",
)
def module_complexity(spark, sf):
    return S.complexity(_summary(spark, sf))


@query(
    "project_counts",
    "SELECT (SELECT count(*) FROM modules) AS modules, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'function') AS functions FROM symbols",
)
def project_counts(spark, sf):
    return S.project_counts(_modules(spark, sf), render_spark(spark, sf, "symbols"))


@query(
    "project_rows",
    """
SELECT name AS module, 'module' AS kind, '{"name":"' || name || '","file_path":"' || file_path || '"' ||
  coalesce(',"docstring":"' || docstring || '"', '') || ',"package_path":"' || package_path || '"}' AS item FROM package_modules
UNION ALL
SELECT module, kind, '{"name":"' || name || '"' || coalesce(',"parent":"' || parent || '"', '') || ',"line_number":' || CAST(line_number AS VARCHAR) ||
  coalesce(',"docstring":"' || docstring || '"', '') || ',"is_private":' || CAST(is_private AS VARCHAR) || '}' FROM symbols
""",
)
def project_rows(spark, sf):
    return S.project_rows(_modules(spark, sf), render_spark(spark, sf, "symbols"))


PARALLEL = f"""
SELECT n AS total_modules, free AS independent_modules, n - free AS modules_with_dependencies, (n - free) / n AS dependency_ratio,
  round(work * 2, 4) AS estimated_sequential_time_seconds, round(work / 12 * 2, 4) AS estimated_parallel_time_seconds, round(12.0::DOUBLE, 4) AS estimated_speedup_factor,
  CASE WHEN free / n > 0.7 THEN 'high' WHEN free / n > 0.4 THEN 'moderate' ELSE 'low' END AS parallelism_potential
FROM (SELECT (SELECT count(*) FROM modules) AS n, (SELECT count(*) FROM modules WHERE name NOT IN (SELECT source FROM reduced_edges)) AS free,
  (SELECT sum({COMPLEXITY}) FROM module_counts) AS work)
"""


def _parallel(spark, sf):
    modules, imports = _code(spark, sf)
    edges = S.module_edges(imports, modules)
    return S.parallelism(modules, edges, S.complexity(_summary(spark, sf)), 12)


@query("parallelism_estimate", PARALLEL)
def parallelism_estimate(spark, sf):
    seconds = [
        "estimated_sequential_time_seconds",
        "estimated_parallel_time_seconds",
        "estimated_speedup_factor",
    ]
    return _parallel(spark, sf).withColumns({c: F.round(c, 4) for c in seconds})


@query(
    "parallelism_advice",
    f"""
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, m AS message FROM (
SELECT 0 AS o, CASE WHEN independent_modules / total_modules < 0.3 THEN 'High dependency coupling detected - consider refactoring to reduce inter-module dependencies' END AS m FROM ({PARALLEL})
UNION ALL SELECT 1, CASE WHEN total_modules < 10 THEN 'Small project - parallel processing overhead may exceed benefits' END FROM ({PARALLEL})
UNION ALL SELECT 2, 'Excellent parallelization potential - parallel processing highly recommended') WHERE m IS NOT NULL
""",
)
def parallelism_advice(spark, sf):
    return rules.as_rows(_parallel(spark, sf), rules.parallelism_advice())


@query(
    "source_folders",
    """
SELECT folder, count(*) AS python_files, bool_or(path = folder || '/__init__.py') AS has_init, CASE folder WHEN 'src' THEN 1 ELSE 2 END AS rank
FROM (SELECT split_part(path, '/', 1) AS folder, path FROM repo_files WHERE path LIKE '%.py' AND contains(path, '/'))
WHERE folder IN ('src', 'lib') GROUP BY folder
""",
)
def source_folders(spark, sf):
    return S.source_folders(render_spark(spark, sf, "repo_files"), "demo").orderBy("rank").limit(2)


PROFILE = """
SELECT count(*) FILTER (path LIKE '%.py') AS python_files,
  bool_or(regexp_matches(path, '(^|/)test_[^/]*\\.py$') OR regexp_matches(path, '_test\\.py$') OR contains('/' || path, '/tests/')) AS has_tests,
  bool_or(starts_with(path, 'docs/') OR starts_with(path, 'doc/') OR path = 'README.md' OR regexp_matches(path, '^[^/]*\\.rst$')) AS has_docs,
  CASE WHEN count(*) FILTER (path LIKE '%.py') > 100 THEN 'large' WHEN count(*) FILTER (path LIKE '%.py') > 20 THEN 'medium' ELSE 'small' END AS project_size,
  'multi' AS package_structure
FROM repo_files
"""


@query("repository_profile", PROFILE)
def repository_profile(spark, sf):
    return S.repository_profile(render_spark(spark, sf, "repo_files"), "demo")


@query(
    "setup_advice",
    f"""
SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, m AS message FROM (
SELECT 0 AS o, 'Consider setting obsidian.vault_path to integrate with your Obsidian vault' AS m
UNION ALL SELECT 1, CASE WHEN project_size = 'large' THEN 'Large project detected - consider using exclude_patterns to focus documentation' END FROM ({PROFILE})
UNION ALL SELECT 2, CASE WHEN has_tests THEN 'Tests detected - consider adding ''sphinx.ext.doctest'' extension' END FROM ({PROFILE})
UNION ALL SELECT 3, CASE WHEN NOT has_docs THEN 'No existing documentation found - generated docs will be your primary documentation' END FROM ({PROFILE})
) WHERE m IS NOT NULL
""",
)
def setup_advice(spark, sf):
    profile = S.repository_profile(render_spark(spark, sf, "repo_files"), "demo")
    known = profile.withColumns({"has_vault": F.lit(False), "has_doctest": F.lit(False)})
    return rules.as_rows(known, rules.setup_advice())


@query("corpus_size", "SELECT count(*) AS files, sum(size)::BIGINT AS bytes FROM repo_files")
def corpus_size(spark, sf):
    return S.corpus_size(render_spark(spark, sf, "repo_files"))


@query(
    "file_info",
    """
SELECT m.name AS module, m.file_path, m.size, len(string_split(coalesce(m.docstring, ''), chr(10)))::INTEGER - CASE WHEN coalesce(m.docstring, '') = '' THEN 1 ELSE 0 END AS line_count, s.kind, s.name, s.line_number
FROM modules m LEFT JOIN symbols s ON s.module = m.name
WHERE m.file_path = (SELECT min(file_path) FROM modules)
""",
)
def file_info(spark, sf):
    from folioscope.functions import text

    modules = _modules(spark, sf).withColumn(
        "line_count", text.line_count(F.coalesce("docstring", F.lit("")))
    )
    path = modules.agg(F.min("file_path")).scalar()
    return S.file_info(modules, render_spark(spark, sf, "symbols"), path).select(
        "module", "file_path", "size", "line_count", "kind", "name", "line_number"
    )


@query(
    "execution_levels",
    """
WITH RECURSIVE e AS (SELECT DISTINCT a.name AS source, b.name AS target FROM modules a JOIN modules b ON (b.k = a.k - 1 AND a.k % 500 <> 0) OR (b.k = a.k - 7 AND a.k % 50 = 0)),
up(id, lvl) AS (SELECT name, 0 FROM modules WHERE name NOT IN (SELECT source FROM e) UNION SELECT e.source, up.lvl + 1 FROM up JOIN e ON e.target = up.id)
SELECT level, row_number() OVER (PARTITION BY level ORDER BY priority DESC, id) AS position, id, priority FROM
(SELECT u.id, max(u.lvl)::INTEGER AS level, m.k % 7 AS priority FROM up u JOIN modules m ON m.name = u.id GROUP BY u.id, m.k)
""",
)
def execution_levels(spark, sf):
    modules = _modules(spark, sf)
    tasks = modules.select(F.col("name").alias("id"), (F.col("k") % 7).alias("priority"), "k")
    other = tasks.select(F.col("id").alias("dep"), F.col("k").alias("dk"))
    k = F.col("k")
    # Chains of five hundred tasks, every fiftieth of which waits for an earlier one too.
    wanted = F.array_compact(
        F.array(F.when(k % 500 != 0, k - 1), F.when(k % 50 == 0, k - 7))
    )
    deps = tasks.select("id", F.explode(wanted).alias("dk")).join(other, "dk").select("id", "dep")
    levels = G.dependency_levels(tasks, deps)
    return G.order_in_level(tasks.select("id", "priority"), levels)


@query(
    "ready_tasks",
    "SELECT name AS id FROM modules m WHERE k % 2 = 1 AND NOT EXISTS (SELECT 1 FROM module_edges e JOIN modules d ON d.name = e.target WHERE e.source = m.name AND d.k % 2 = 1)",
)
def ready_tasks(spark, sf):
    modules, imports = _code(spark, sf)
    deps = S.module_edges(imports, modules).select(
        F.col("source").alias("id"), F.col("target").alias("dep")
    )
    done = modules.where("k % 2 = 0").select(F.col("name").alias("id"))
    return G.ready_tasks(modules.select(F.col("name").alias("id")), deps, done)


@query(
    "missing_dependencies",
    "SELECT source AS id, target AS dep FROM module_edges e JOIN modules d ON d.name = e.target WHERE d.k % 5 = 0",
)
def missing_dependencies(spark, sf):
    modules, imports = _code(spark, sf)
    deps = S.module_edges(imports, modules).select(
        F.col("source").alias("id"), F.col("target").alias("dep")
    )
    renamed = F.when(F.col("k") % 5 == 0, F.concat(F.lit("moved."), F.col("name"))).otherwise(F.col("name"))
    present = modules.select(renamed.alias("id"))
    return G.missing_dependencies(present, deps)


@query(
    "file_batches",
    "SELECT file_path, position, (position // 100)::BIGINT AS batch FROM (SELECT file_path, row_number() OVER (ORDER BY file_path) - 1 AS position FROM modules)",
)
def file_batches(spark, sf):
    return J.batches(_modules(spark, sf).select("file_path"), ["file_path"], 100)


@query(
    "source_scan_excluded",
    """
SELECT path FROM repo_files WHERE path LIKE '%.py' AND NOT starts_with(path, 'tests/') AND NOT regexp_matches(path, '(^|/)brand_2[^/]*/')
  AND NOT path LIKE '%/__init__.py'
""",
)
def source_scan_excluded(spark, sf):
    files = render_spark(spark, sf, "repo_files").where(F.col("path").endswith(".py"))
    patterns = ["tests/", "*brand_2*", "__init__.py"]
    return files.where(~paths.excluded(F.col("path"), patterns, "glob")).select("path")


@query(
    "update_scope",
    "SELECT path FROM repo_files WHERE path LIKE '%.py' AND NOT contains(path, 'economy') AND NOT regexp_matches(path, '(^|/)m1[^/]*\\.py$') AND NOT contains(lower(path), 'test')",
)
def update_scope(spark, sf):
    p = F.col("path")
    files = render_spark(spark, sf, "repo_files").where(p.endswith(".py"))
    kept = files.where(~paths.excluded(p, ["economy", "m1*.py"], "substring_or_path"))
    return kept.where(~F.lower(p).contains("test")).select("path")


@query(
    "memory_scope",
    "SELECT path FROM repo_files WHERE NOT contains(path, 'tests') AND NOT contains(path, '_1')",
)
def memory_scope(spark, sf):
    files = render_spark(spark, sf, "repo_files")
    return files.where(~paths.excluded(F.col("path"), ["tests", "_1"], "substring")).select("path")


@query(
    "watch_scope",
    "SELECT path FROM repo_files WHERE path LIKE '%.py' AND (starts_with(path, 'src/') OR starts_with(path, 'lib/')) AND NOT regexp_matches(path, '(^|/)m2[^/]*\\.py$')",
)
def watch_scope(spark, sf):
    from folioscope.streaming.changes import in_watch_scope

    files = render_spark(spark, sf, "repo_files")
    return files.where(in_watch_scope(F.col("path"), ["src", "lib"], ["m2*.py"])).select("path")
