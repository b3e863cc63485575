"""Queries over coverage, note quality, scores and advice."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.operators import links as L
from folioscope.operators import quality as Q
from folioscope.plans import reports
from workload.fixtures import ORACLE_VIEWS, render_spark
from workload.links import COMPONENTS, _base, _notes
from workload.registry import query

NOW_SQL = "TIMESTAMP '2024-01-01 12:00:00'"

ORACLE_VIEWS["items"] = """
SELECT 'module' AS type, name, file_path AS file, 1 AS line, coalesce(trim(docstring) <> '', false) AS documented, 'medium' AS severity
FROM modules
UNION ALL
SELECT s.kind, s.module || '.' || s.name, m.file_path, s.line_number, coalesce(trim(s.docstring) <> '', false),
  CASE WHEN s.kind = 'class' THEN 'high' WHEN s.is_private THEN 'low' ELSE 'medium' END
FROM symbols s JOIN modules m ON m.name = s.module
WHERE s.kind = 'class' OR (s.kind = 'function' AND NOT s.is_private)
"""
ORACLE_VIEWS["coverage_row"] = """
SELECT count(*) FILTER (type = 'module') AS modules_total, count(*) FILTER (type = 'module' AND documented) AS modules_documented,
  count(*) FILTER (type = 'class') AS classes_total, count(*) FILTER (type = 'class' AND documented) AS classes_documented,
  count(*) FILTER (type = 'function') AS functions_total, count(*) FILTER (type = 'function' AND documented) AS functions_documented,
  count(*) AS total_items, count(*) FILTER (documented) AS documented_items,
  count(*) FILTER (NOT documented) AS missing,
  count(*) FILTER (documented) / count(*) * 100 AS coverage
FROM items
"""
ORACLE_VIEWS["coverage_types"] = """
SELECT 'modules' AS type, modules_total AS total, modules_documented AS documented, CASE WHEN modules_total > 0 THEN modules_documented / modules_total * 100 ELSE 0.0::DOUBLE END AS coverage FROM coverage_row
UNION ALL SELECT 'classes', classes_total, classes_documented, CASE WHEN classes_total > 0 THEN classes_documented / classes_total * 100 ELSE 0.0::DOUBLE END FROM coverage_row
UNION ALL SELECT 'functions', functions_total, functions_documented, CASE WHEN functions_total > 0 THEN functions_documented / functions_total * 100 ELSE 0.0::DOUBLE END FROM coverage_row
UNION ALL SELECT 'overall', total_items, documented_items, coverage FROM coverage_row
"""
STRIP = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x0b\x1c-\x1f\x{{0085}}\x{{00a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
OCC = "((length(content) - length(replace(content, '{0}', ''))) // {1})"
WORDS = r"len(regexp_extract_all(content, '[^\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
BODY = STRIP.format(r"regexp_replace(content, '(?m)^#+.*$', '', 'g')")
ORACLE_VIEWS["checks"] = rf"""
SELECT path, regexp_matches(content, '^# [^\n]') AS structure, length({BODY}) > 50 AS content_ok,
  {OCC.format('[[', 2)} = {OCC.format(']]', 2)} AS brackets, {OCC.format('```', 3)} % 2 = 0 AS fences,
  starts_with(content, '---') AS metadata,
  regexp_matches(regexp_replace(content, '^---\n(?s:.*?)\n---\n\s*', ''), '^# [^\n]') AS after_matter
FROM notes
"""
ORACLE_VIEWS["status_check_rows"] = rf"""
SELECT path, starts_with({STRIP.format('content')}, '# ') AS structure, {WORDS} AS words,
  {OCC.format('[[', 2)} = {OCC.format(']]', 2)} AS formatting
FROM notes
"""


def _code(spark, sf):
    modules = render_spark(spark, sf, "modules")
    return modules, render_spark(spark, sf, "symbols")


@query("coverage_by_type", "SELECT * FROM coverage_types")
def coverage_by_type(spark, sf):
    return Q.coverage_by_type(Q.coverage(Q.coverage_counts(*_code(spark, sf))))


@query(
    "coverage_with_private",
    """
SELECT count(*) AS total_items, count(*) FILTER (documented) AS documented_items,
  count(*) FILTER (documented) / count(*) * 100 AS completeness
FROM (SELECT coalesce(trim(docstring) <> '', false) AS documented FROM modules
      UNION ALL SELECT coalesce(trim(docstring) <> '', false) FROM symbols WHERE kind IN ('class', 'function'))
""",
)
def coverage_with_private(spark, sf):
    counts = Q.coverage_counts(*_code(spark, sf), include_private=True)
    return Q.completeness(counts).select("total_items", "documented_items", "completeness")


@query(
    "missing_documentation",
    "SELECT type, name, file, line, severity FROM items WHERE NOT documented",
)
def missing_documentation(spark, sf):
    return Q.missing_documentation(Q.documentable_items(*_code(spark, sf)))


@query(
    "note_quality_checks",
    """
SELECT 'structure' AS "check", count(*) FILTER (structure) AS passed, count(*) AS total, count(*) FILTER (structure) / count(*) * 100 AS score FROM checks
UNION ALL SELECT 'content', count(*) FILTER (content_ok), count(*), count(*) FILTER (content_ok) / count(*) * 100 FROM checks
UNION ALL SELECT 'formatting', count(*) FILTER (brackets AND fences), count(*), count(*) FILTER (brackets AND fences) / count(*) * 100 FROM checks
UNION ALL SELECT 'metadata', count(*) FILTER (metadata), count(*), count(*) FILTER (metadata) / count(*) * 100 FROM checks
UNION ALL SELECT 'structure_after_frontmatter', count(*) FILTER (after_matter), count(*), count(*) FILTER (after_matter) / count(*) * 100 FROM checks
""",
)
def note_quality_checks(spark, sf):
    names = [*rules.CHECKS, "structure_after_frontmatter"]
    return Q.check_totals(Q.note_checks(_notes(spark, sf)), names)


ISSUES_SQL = """
SELECT 'structure' AS type, 'medium' AS severity, 'Missing main heading in ' || path AS message, path AS file, 'structure' AS category FROM checks WHERE NOT structure
UNION ALL SELECT 'content', 'medium', 'Insufficient content in ' || path, path, 'content' FROM checks WHERE NOT content_ok
UNION ALL SELECT 'formatting', 'low', 'Formatting issues in ' || path || ': ' ||
  concat_ws(', ', CASE WHEN NOT brackets THEN 'unmatched wikilink brackets' END, CASE WHEN NOT fences THEN 'unmatched code blocks' END),
  path, 'formatting' FROM checks WHERE NOT (brackets AND fences)
UNION ALL SELECT 'metadata', 'low', 'Missing YAML frontmatter in ' || path, path, 'metadata' FROM checks WHERE NOT metadata
"""


@query("note_issues", ISSUES_SQL)
def note_issues(spark, sf):
    return Q.note_issues(Q.note_checks(_notes(spark, sf)))


@query("issues_per_type", f"SELECT type, count(*) AS issues FROM ({ISSUES_SQL}) GROUP BY type")
def issues_per_type(spark, sf):
    return Q.issues_per_type(Q.note_issues(Q.note_checks(_notes(spark, sf))))


@query(
    "status_quality",
    """
SELECT 'structure' AS "check", count(*) FILTER (structure) AS passed, count(*) AS total, count(*) FILTER (structure) / count(*) * 100 AS score FROM status_check_rows
UNION ALL SELECT 'content', count(*) FILTER (words > 20), count(*), count(*) FILTER (words > 20) / count(*) * 100 FROM status_check_rows
UNION ALL SELECT 'formatting', count(*) FILTER (formatting), count(*), count(*) FILTER (formatting) / count(*) * 100 FROM status_check_rows
UNION ALL SELECT 'links', count(*), count(*), 100.0::DOUBLE FROM status_check_rows
""",
)
def status_quality(spark, sf):
    return Q.check_totals(Q.status_checks(_notes(spark, sf)), Q.STATUS_CHECKS)


STATUS_ISSUES_SQL = """
SELECT path AS file, 'structure' AS type, 'medium' AS severity, 'Missing main heading' AS issue FROM status_check_rows WHERE NOT structure
UNION ALL SELECT path, 'content', 'low', 'Minimal content (' || CAST(words AS VARCHAR) || ' words)' FROM status_check_rows WHERE words <= 20
UNION ALL SELECT path, 'formatting', 'low', 'unmatched wikilink brackets' FROM status_check_rows WHERE NOT formatting
"""


@query("status_issues", STATUS_ISSUES_SQL)
def status_issues(spark, sf):
    return Q.status_issues(Q.status_checks(_notes(spark, sf)))


@query(
    "issues_by_severity",
    f"""
SELECT s.severity, count(i.severity) AS issues FROM (VALUES ('high'), ('medium'), ('low')) s(severity)
LEFT JOIN ({STATUS_ISSUES_SQL}) i ON i.severity = s.severity GROUP BY s.severity
""",
)
def issues_by_severity(spark, sf):
    return Q.issues_by_severity(Q.status_issues(Q.status_checks(_notes(spark, sf))))


ORACLE_VIEWS["quality_row"] = """
SELECT (count(*) FILTER (structure) + count(*) FILTER (content_ok) + count(*) FILTER (brackets AND fences) + count(*) FILTER (metadata))
  / (count(*) * 4) * 100 AS quality,
  count(*) FILTER (NOT structure) AS structure_issues, count(*) FILTER (NOT content_ok) AS content_issues,
  count(*) FILTER (NOT (brackets AND fences)) AS formatting_issues, count(*) FILTER (NOT metadata) AS metadata_issues
FROM checks
"""
ORACLE_VIEWS["score_row"] = """
SELECT c.coverage AS completeness, q.quality, l.links, l.broken_links,
  ((0.0::DOUBLE + c.coverage / 10 * 0.4::DOUBLE) + q.quality / 10 * 0.35::DOUBLE + l.links / 10 * 0.25::DOUBLE) / (0.4::DOUBLE + 0.35::DOUBLE + 0.25::DOUBLE) AS overall
FROM coverage_row c, quality_row q,
  (SELECT count(*) FILTER (valid) / count(*) * 100 AS links, count(*) FILTER (NOT valid) AS broken_links FROM link_checks) l
"""


@query("validation_scores", "SELECT round(completeness, 6) AS completeness, round(quality, 6) AS quality, round(links, 6) AS links, broken_links, round(overall, 6) AS overall FROM score_row")
def validation_scores(spark, sf):
    metrics = reports.validation_metrics(*_code(spark, sf), _notes(spark, sf))
    return metrics.select(
        *[F.round(c, 6).alias(c) for c in ("completeness", "quality", "links", "overall")],
        "broken_links",
    )


@query(
    "completeness_score_alone",
    "SELECT round(coverage / 10, 6) AS overall FROM coverage_row",
)
def completeness_score_alone(spark, sf):
    metrics = reports.validation_metrics(*_code(spark, sf))
    return metrics.select(F.round("overall", 6).alias("overall"))


ADVICE = "SELECT (row_number() OVER (ORDER BY o) - 1)::INTEGER AS position, m AS message FROM ({}) WHERE m IS NOT NULL"


@query(
    "validation_advice",
    ADVICE.format(
        """
SELECT 0 AS o, CASE WHEN completeness < 70 THEN 'Documentation completeness is ' || printf('%.1f', completeness) || '% - consider adding docstrings to improve coverage' END AS m FROM score_row
UNION ALL SELECT CASE type WHEN 'modules' THEN 1 WHEN 'classes' THEN 2 ELSE 3 END,
  CASE WHEN coverage < 50 THEN 'Low ' || type || ' documentation coverage (' || printf('%.1f', coverage) || '%) - add docstrings to ' || CAST(total - documented AS VARCHAR) || ' ' || type END
  FROM coverage_types WHERE type <> 'overall'
UNION ALL SELECT 4, CASE WHEN quality < 80 THEN 'Documentation quality score is ' || printf('%.1f', quality) || '% - review formatting and content structure' END FROM score_row
UNION ALL SELECT 5, CASE WHEN structure_issues > 0 THEN 'Fix ' || CAST(structure_issues AS VARCHAR) || ' structure issues in documentation files' END FROM quality_row
UNION ALL SELECT 6, CASE WHEN content_issues > 0 THEN 'Fix ' || CAST(content_issues AS VARCHAR) || ' content issues in documentation files' END FROM quality_row
UNION ALL SELECT 7, CASE WHEN formatting_issues > 0 THEN 'Fix ' || CAST(formatting_issues AS VARCHAR) || ' formatting issues in documentation files' END FROM quality_row
UNION ALL SELECT 8, CASE WHEN metadata_issues > 0 THEN 'Fix ' || CAST(metadata_issues AS VARCHAR) || ' metadata issues in documentation files' END FROM quality_row
UNION ALL SELECT 9, CASE WHEN links < 90 THEN 'Link validation score is ' || printf('%.1f', links) || '% - fix ' || CAST(broken_links AS VARCHAR) || ' broken links' END FROM score_row
UNION ALL SELECT 10, CASE WHEN broken_links > 0 THEN 'Update ' || CAST(broken_links AS VARCHAR) || ' broken cross-references' END FROM score_row
UNION ALL SELECT 11, CASE WHEN overall < 6 THEN 'Overall documentation quality is below average - focus on completeness and consistency improvements'
  WHEN overall < 8 THEN 'Good documentation foundation - focus on quality refinements and link maintenance'
  WHEN overall >= 9 THEN 'Excellent documentation quality - consider automating maintenance workflows' END FROM score_row
"""
    ),
)
def validation_advice(spark, sf):
    return reports.validation_report(*_code(spark, sf), _notes(spark, sf))


@query(
    "link_advice",
    COMPONENTS
    + ", hub AS (SELECT name, inbound_links FROM nodes WHERE inbound_links > 0 ORDER BY 2 DESC, 1 LIMIT 1), e AS (SELECT count(*) FILTER (valid) AS good, count(*) FILTER (NOT valid) AS bad, count(*) FILTER (NOT valid AND type = 'wikilink') AS high FROM edges), per AS (SELECT (SELECT count(*) FROM edges) / (SELECT count(*) FROM nodes) AS avg_links) "
    + ADVICE.format(
        """
SELECT 0 AS o, CASE WHEN high > 0 THEN 'Fix ' || CAST(high AS VARCHAR) || ' high-priority broken wikilinks' END AS m FROM e
UNION ALL SELECT 1, CASE WHEN bad > high THEN 'Review and fix ' || CAST(bad - high AS VARCHAR) || ' additional broken links' END FROM e
UNION ALL SELECT 2, CASE WHEN count(*) > 0 THEN 'Connect ' || CAST(count(*) AS VARCHAR) || ' orphaned files to improve discoverability' END
  FROM nodes WHERE present AND inbound_links = 0 AND lower(name) NOT IN ('index', 'readme', 'home')
UNION ALL SELECT 3, CASE WHEN count(*) > 0 THEN 'Link ' || CAST(count(*) AS VARCHAR) || ' isolated files to improve documentation navigation' END
  FROM nodes WHERE inbound_links = 0 AND outbound_links = 0
UNION ALL SELECT 4, CASE WHEN avg_links < 2 THEN 'Consider adding more cross-references to improve documentation connectivity'
  WHEN avg_links > 10 THEN 'High link density detected - consider organizing into topic clusters' END FROM per
UNION ALL SELECT 5, CASE WHEN count(DISTINCT component) > 3 THEN 'Documentation has ' || CAST(count(DISTINCT component) AS VARCHAR) || ' distinct clusters - consider creating topic index pages' END FROM component_of
UNION ALL SELECT 6, CASE WHEN good / (good + bad) < 0.9 THEN 'Link validity is ' || printf('%.1f', good / (good + bad) * 100) || '% - focus on fixing broken references' END FROM e
UNION ALL SELECT 7, CASE WHEN inbound_links > 10 THEN '''' || name || ''' is a major hub - ensure it has comprehensive content' END FROM hub
"""
    ),
)
def link_advice(spark, sf):
    notes, _, links = _base(spark, sf)
    return reports.link_report(notes, links)


def _now():
    return F.expr(NOW_SQL)


def _sources(spark, sf):
    return render_spark(spark, sf, "modules").select(F.col("file_path").alias("path"), "mtime")


@query(
    "update_history",
    f"SELECT path, strftime(mtime, '%Y-%m-%dT%H:%M:%S') AS last_modified, length(content)::INTEGER AS size FROM notes WHERE mtime > {NOW_SQL} - INTERVAL 30 DAY",
)
def update_history(spark, sf):
    notes = _notes(spark, sf).withColumn("size", F.length("content"))
    return Q.update_history(notes, _now()).select(
        "path", F.date_format("mtime", "yyyy-MM-dd'T'HH:mm:ss").alias("last_modified"), "size"
    )


@query(
    "update_statistics",
    f"SELECT count(*) AS total_updates, count(DISTINCT path) AS files_modified, count(*) / 30 AS average_updates_per_day FROM notes WHERE mtime > {NOW_SQL} - INTERVAL 30 DAY",
)
def update_statistics(spark, sf):
    return Q.update_statistics(_notes(spark, sf), _now())


SYNC = f"""
SELECT s AS source_changes, n AS note_changes, CASE WHEN s = 0 AND n = 0 THEN 'up_to_date' WHEN s > n THEN 'docs_behind' WHEN n > s THEN 'docs_ahead' ELSE 'synchronized' END AS sync_status
FROM (SELECT (SELECT count(*) FROM modules WHERE mtime > {NOW_SQL} - INTERVAL 7 DAY AND file_path NOT LIKE '%brand_1%') AS s,
             (SELECT count(*) FROM notes WHERE mtime > {NOW_SQL} - INTERVAL 7 DAY) AS n)
"""


@query("sync_status", SYNC)
def sync_status(spark, sf):
    return Q.sync_status(_sources(spark, sf), _notes(spark, sf), _now(), exclude=["brand_1"])


ORACLE_VIEWS["status_row"] = f"""
SELECT c.coverage, c.missing, (q.a + q.b + q.c + q.n) / (q.n * 4) * 100 AS quality, s.sync_status
FROM coverage_row c,
  (SELECT count(*) AS n, count(*) FILTER (structure) AS a, count(*) FILTER (words > 20) AS b, count(*) FILTER (formatting) AS c FROM status_check_rows) q,
  ({SYNC.replace(" AND file_path NOT LIKE '%brand_1%'", "")}) s
"""
ORACLE_VIEWS["status_advice_rows"] = """
SELECT 0 AS o, CASE WHEN coverage < 50 THEN 'Documentation coverage is low (' || printf('%.1f', coverage) || '%) - prioritize adding docstrings to modules and classes'
  WHEN coverage < 80 THEN 'Good progress on documentation coverage (' || printf('%.1f', coverage) || '%) - focus on documenting remaining functions' END AS m FROM status_row
UNION ALL SELECT CASE type WHEN 'modules' THEN 1 WHEN 'classes' THEN 2 ELSE 3 END,
  CASE WHEN coverage < 30 THEN 'Very low ' || type || ' documentation coverage (' || printf('%.1f', coverage) || '%) - add docstrings to ' || CAST(total - documented AS VARCHAR) || ' ' || type END
  FROM coverage_types WHERE type <> 'overall'
UNION ALL SELECT 4, CASE WHEN quality > 0 AND quality < 70 THEN 'Documentation quality could be improved (score: ' || printf('%.1f', quality) || '/100) - review formatting and content structure' END FROM status_row
UNION ALL SELECT 5, CASE sync_status WHEN 'docs_behind' THEN 'Source code has recent changes - consider regenerating documentation'
  WHEN 'docs_ahead' THEN 'Documentation has been updated recently - ensure it reflects current code' END FROM status_row
UNION ALL SELECT 6, CASE WHEN missing > 0 THEN 'Add docstrings to ' || CAST(missing AS VARCHAR) || ' undocumented items for complete coverage' END FROM status_row
"""


@query("status_advice", ADVICE.format("SELECT * FROM status_advice_rows"))
def status_advice(spark, sf):
    return reports.status_report(*_code(spark, sf), _notes(spark, sf), _sources(spark, sf), _now())


@query(
    "health_summary",
    """
SELECT round(score, 6) AS overall_score,
  CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 80 THEN 'good' WHEN score >= 70 THEN 'fair' WHEN score >= 60 THEN 'poor' ELSE 'critical' END AS overall_health,
  CASE WHEN score >= 90 THEN 'A' WHEN score >= 80 THEN 'B' WHEN score >= 70 THEN 'C' WHEN score >= 60 THEN 'D' ELSE 'F' END AS coverage_grade,
  CASE WHEN quality >= 90 THEN 'A' WHEN quality >= 80 THEN 'B' WHEN quality >= 70 THEN 'C' WHEN quality >= 60 THEN 'D' ELSE 'F' END AS quality_grade,
  concat_ws('; ', CASE WHEN coverage < 50 THEN 'Improve documentation coverage' END,
    CASE WHEN quality > 0 AND quality < 70 THEN 'Address quality issues' END,
    CASE WHEN sync_status = 'docs_behind' THEN 'Update documentation to match recent code changes' END) AS priority_actions,
  (SELECT string_agg(m, '; ' ORDER BY o) FROM (SELECT o, m FROM status_advice_rows WHERE m IS NOT NULL ORDER BY o LIMIT 3)) AS next_steps
FROM (SELECT *, CASE WHEN quality > 0 THEN coverage * 0.6::DOUBLE + quality * 0.4::DOUBLE ELSE coverage END AS score FROM status_row)
""",
)
def health_summary(spark, sf):
    metrics = reports.status_metrics(
        *_code(spark, sf), _notes(spark, sf), _sources(spark, sf), _now()
    )
    return Q.health_summary(metrics).withColumn("overall_score", F.round("overall_score", 6))


@query(
    "graph_report_json",
    """
SELECT name, '{"name":"' || name || '","inbound":' || CAST(inbound_links AS VARCHAR) || ',"outbound":' || CAST(outbound_links AS VARCHAR) || '}' AS report FROM nodes
""",
)
def graph_report_json(spark, sf):
    notes, _, links = _base(spark, sf)
    nodes = L.build_nodes(notes, links)
    return nodes.select(
        "name",
        F.to_json(
            F.struct("name", F.col("inbound_links").alias("inbound"), F.col("outbound_links").alias("outbound"))
        ).alias("report"),
    )
