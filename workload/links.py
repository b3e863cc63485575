"""Queries over the link graph of the notes view."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import links as L
from workload.fixtures import ORACLE_VIEWS, render_spark
from workload.registry import query

ORACLE_VIEWS["wiki_links"] = r"""
SELECT doc_id, path, replace(path, '.md', '') AS source, t AS target, coalesce(nullif(a, ''), t) AS display
FROM (SELECT doc_id, path,
        unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 1)) AS t,
        unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|([^\]]+))?\]\]', 2)) AS a
      FROM notes)
"""
ORACLE_VIEWS["md_links"] = r"""
SELECT doc_id, path, replace(path, '.md', '') AS source, txt AS display, url,
  regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '^(.+)\.[^.]+$', '\1') AS target
FROM (SELECT doc_id, path,
        unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 1)) AS txt,
        unnest(regexp_extract_all(content, '\[([^\]]+)\]\(([^)]+)\)', 2)) AS url
      FROM notes)
"""
ORACLE_VIEWS["edges"] = """
SELECT source, target, 'wikilink' AS type, display, target || '.md' IN (SELECT path FROM notes) AS valid
FROM wiki_links
UNION ALL
SELECT source, target, 'markdown_link' AS type, display, url IN (SELECT path FROM notes) AS valid
FROM md_links WHERE NOT starts_with(url, 'http')
"""
WORDS = r"len(regexp_extract_all(content, '[^\s\x0b\x1c-\x1f\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))"
ORACLE_VIEWS["nodes"] = f"""
SELECT coalesce(n.name, i.target) AS name, coalesce(n.path, i.target || '.md') AS path,
  coalesce(n.size, 0) AS size, coalesce(n.words, 0) AS word_count,
  coalesce(n.n_out, 0) AS outbound_links, coalesce(i.n, 0) AS inbound_links, coalesce(m.n, 0) AS markdown_in,
  n.name IS NOT NULL AS present
FROM (SELECT replace(path, '.md', '') AS name, path, length(content)::INTEGER AS size, ({WORDS})::INTEGER AS words,
        (SELECT count(*) FROM edges e WHERE e.source = replace(path, '.md', '')) AS n_out FROM notes) n
FULL OUTER JOIN (SELECT target, count(*) AS n FROM wiki_links GROUP BY target) i ON n.name = i.target
LEFT JOIN (SELECT target, count(*) AS n FROM edges WHERE type = 'markdown_link' AND valid GROUP BY target) m
  ON m.target = n.name
"""


def _notes(spark, sf):
    return render_spark(spark, sf, "notes").select("path", "content", "mtime")


def _measured(spark, sf):
    """Short rows of the notes, read and matched once, for reports with several branches."""
    notes = L.measured(_notes(spark, sf))
    return notes, notes.select("path"), L.extract_links(notes)


def _base(spark, sf):
    notes = _notes(spark, sf)
    return notes, notes.select("path"), L.extract_links(notes)


@query(
    "link_extraction",
    """
SELECT source, 'wikilink' AS type, target, display AS display_text, NULL AS url FROM wiki_links
UNION ALL SELECT source, 'markdown_link', target, display, url FROM md_links
""",
)
def link_extraction(spark, sf):
    return _base(spark, sf)[2].select("source", "type", "target", "display_text", "url")


@query(
    "headings",
    r"""
SELECT path, length(h1)::INTEGER AS level, trim(h2) AS text,
  regexp_replace(replace(lower(trim(h2)), ' ', '-'), '[^\p{L}\p{N}_\-]', '', 'g') AS anchor
FROM (SELECT path, unnest(regexp_extract_all(content, '(?m)^(#+)[\s\x0b]+(.+)$', 1)) AS h1,
        unnest(regexp_extract_all(content, '(?m)^(#+)[\s\x0b]+(.+)$', 2)) AS h2 FROM notes)
""",
)
def headings(spark, sf):
    return (
        _notes(spark, sf)
        .select("path", F.explode(text.headings(F.col("content"))).alias("h"))
        .select("path", "h.*")
    )


@query(
    "link_resolution",
    """
SELECT source, target, type, valid,
  CASE WHEN type = 'wikilink' THEN split_part(target, '#', 1) || '.md' IN (SELECT path FROM notes)
       ELSE split_part(url, '#', 1) IN (SELECT path FROM notes) END AS valid_ignoring_anchor
FROM (SELECT source, target, 'wikilink' AS type, NULL AS url, target || '.md' IN (SELECT path FROM notes) AS valid
      FROM wiki_links
      UNION ALL
      SELECT source, target, 'markdown_link', url, url IN (SELECT path FROM notes)
      FROM md_links WHERE NOT starts_with(url, 'http'))
""",
)
def link_resolution(spark, sf):
    _, files, links = _base(spark, sf)
    resolved = L.resolve_links(L.graph_links(links), files)
    return L.anchorless_validity(resolved, files).select(
        "source", "target", "type", "valid", "valid_ignoring_anchor"
    )


@query(
    "dead_links",
    """
SELECT e.source, e.target, e.type, e.display AS display_text,
  coalesce(n.present, false) AS target_exists,
  CASE WHEN e.type = 'wikilink' THEN 'high' ELSE 'medium' END AS severity
FROM edges e LEFT JOIN nodes n ON n.name = e.target WHERE NOT e.valid
""",
)
def dead_links(spark, sf):
    _, files, links = _base(spark, sf)
    return L.dead_links(links, files).drop("ord")


@query(
    "dead_link_report",
    """
SELECT e.source, n.inbound_links, n.outbound_links, e.target, e.type,
  CASE WHEN e.type = 'wikilink' THEN 'high' ELSE 'medium' END AS severity
FROM edges e JOIN nodes n ON n.name = e.source WHERE NOT e.valid
""",
)
def dead_link_report(spark, sf):
    notes, files, links = _measured(spark, sf)
    degrees = L.build_nodes(notes, links).select(
        F.col("name").alias("source"), "inbound_links", "outbound_links"
    )
    dead = L.dead_links(links, files).select("source", "target", "type", "severity")
    return dead.join(degrees, "source").select(
        "source", "inbound_links", "outbound_links", "target", "type", "severity"
    )


@query(
    "link_graph_nodes",
    r"""
SELECT name, path, size, word_count, outbound_links, inbound_links, inbound_links + markdown_in AS inbound_all,
  present AS "exists",
  CASE WHEN present THEN (SELECT len(regexp_extract_all(content, '(?m)^#+[\s\x0b]+.+$'))::INTEGER FROM notes t WHERE t.path = nodes.path)
       ELSE 0 END AS n_headings
FROM nodes
""",
)
def link_graph_nodes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.build_nodes(notes, links).withColumn("n_headings", F.size("headings")).drop("headings")


@query(
    "link_graph_edges",
    "SELECT source, target, type, display AS display_text, valid FROM edges",
)
def link_graph_edges(spark, sf):
    _, files, links = _base(spark, sf)
    return L.resolve_links(L.graph_links(links), files).select(
        "source", "target", "type", "display_text", "valid"
    )


@query(
    "node_degrees",
    "SELECT name, outbound_links, inbound_links FROM nodes",
)
def node_degrees(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.build_nodes(notes, links).select("name", "outbound_links", "inbound_links")


@query(
    "duplicate_stems",
    """
SELECT 'note_' || CAST(doc_id % (SELECT count(*) * 9 // 10 FROM documents) AS VARCHAR) AS stem,
  count(*) AS notes, min(source || '/note_' || CAST(doc_id % (SELECT count(*) * 9 // 10 FROM documents) AS VARCHAR) || '.md') AS first_path
FROM documents GROUP BY 1 HAVING count(*) > 1
""",
)
def duplicate_stems(spark, sf):
    docs = render_spark(spark, sf, "documents")
    size = docs.agg(F.floor(F.count(F.lit(1)) * 9 / 10)).scalar()
    named = docs.select(
        F.concat(
            "source", F.lit("/note_"), (F.col("doc_id") % size).cast("string"), F.lit(".md")
        ).alias("path")
    )
    return L.duplicate_stems(named)


@query(
    "orphan_notes",
    """
SELECT name, path, size, word_count, outbound_links,
  CASE WHEN outbound_links > 0 THEN 'Add links to this file from related pages'
       ELSE 'Consider linking this file from index or removing if unused' END AS suggestion
FROM nodes WHERE present AND inbound_links = 0 AND lower(name) NOT IN ('index', 'readme', 'home')
""",
)
def orphan_notes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.orphans(L.build_nodes(notes, links))


@query(
    "existing_nodes",
    "SELECT name, path FROM nodes WHERE present",
)
def existing_nodes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.existing_nodes(L.build_nodes(notes, links)).select("name", "path")


@query(
    "graph_export_nodes",
    """
SELECT name AS id, name AS label, greatest(5, least(50, word_count // 50))::INTEGER AS size,
  inbound_links AS inbound, outbound_links AS outbound,
  CASE WHEN inbound_links > 5 THEN 'hub' WHEN outbound_links > 5 THEN 'authority'
       WHEN inbound_links = 0 THEN 'orphan' ELSE 'regular' END AS "group"
FROM nodes WHERE present
""",
)
def graph_export_nodes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.graph_export_nodes(L.build_nodes(notes, links))


@query(
    "graph_export_edges",
    "SELECT source, target, type, 1 AS weight FROM edges WHERE valid",
)
def graph_export_edges(spark, sf):
    _, files, links = _base(spark, sf)
    return L.graph_export_edges(links, files)


@query(
    "layout_hints",
    """
SELECT CASE WHEN n > 20 THEN 'force_directed' ELSE 'circular' END AS recommended_layout,
  n > 10 AS clustering_enabled, true AS highlight_hubs
FROM (SELECT count(*) AS n FROM nodes WHERE present)
""",
)
def layout_hints(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.layout_hints(L.build_nodes(notes, links))


STATISTICS_SQL = """
SELECT (SELECT count(*) FROM nodes) AS total_files,
  (SELECT sum(word_count)::BIGINT FROM nodes) AS total_words,
  (SELECT count(*) FROM nodes WHERE inbound_links > 0 OR outbound_links > 0) AS connected_files,
  (SELECT count(*) FROM nodes WHERE inbound_links = 0 AND outbound_links = 0) AS isolated_files,
  count(*) AS total_links,
  count(*) FILTER (type = 'wikilink') AS wikilinks,
  count(*) FILTER (type = 'markdown_link') AS markdown_links,
  count(*) FILTER (valid) AS valid_links,
  count(*) FILTER (NOT valid) AS broken_links,
  count(*) / (SELECT count(*) FROM nodes) AS average_links_per_file
FROM edges
"""


@query("link_statistics", STATISTICS_SQL)
def link_statistics(spark, sf):
    notes, files, links = _measured(spark, sf)
    return L.link_statistics(L.build_nodes(notes, links), links, files)


@query(
    "hub_notes",
    "SELECT name, inbound_links FROM nodes WHERE inbound_links > 0 ORDER BY 2 DESC, 1 LIMIT 5",
)
def hub_notes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.top_nodes(L.build_nodes(notes, links), "inbound_links")


@query(
    "authority_notes",
    "SELECT name, outbound_links FROM nodes WHERE outbound_links > 0 ORDER BY 2 DESC, 1 LIMIT 5",
)
def authority_notes(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.top_nodes(L.build_nodes(notes, links), "outbound_links")


ORACLE_VIEWS["link_checks"] = """
SELECT path, 'wikilinks' AS link_class, 'wikilink' AS type, target, display, target || '.md' IN (SELECT path FROM notes) AS valid
FROM wiki_links
UNION ALL
SELECT path, CASE WHEN starts_with(url, 'http') THEN 'external' WHEN contains(url, '#') THEN 'anchors' ELSE 'internal' END,
  'markdown_link', url, display,
  CASE WHEN starts_with(url, 'http') OR contains(url, '#') THEN true ELSE url IN (SELECT path FROM notes) END
FROM md_links
"""


@query(
    "link_validation",
    """
SELECT count(*) AS total_links, count(*) FILTER (valid) AS valid_links, count(*) FILTER (NOT valid) AS broken_links,
  count(*) FILTER (link_class = 'internal') AS internal, count(*) FILTER (link_class = 'external') AS "external",
  count(*) FILTER (link_class = 'wikilinks') AS wikilinks, count(*) FILTER (link_class = 'anchors') AS anchors,
  CASE WHEN count(*) = 0 THEN 100.0::DOUBLE ELSE count(*) FILTER (valid) / count(*) * 100 END AS score
FROM link_checks
""",
)
def link_validation(spark, sf):
    _, files, links = _base(spark, sf)
    return L.link_validation(links, files)


@query(
    "broken_cross_references",
    """
SELECT path AS source, type, target, display, 'medium' AS severity,
  CASE WHEN type = 'wikilink' THEN 'Broken wikilink to ' ELSE 'Broken markdown link to ' END || target AS message
FROM link_checks WHERE NOT valid
""",
)
def broken_cross_references(spark, sf):
    _, files, links = _base(spark, sf)
    return L.broken_cross_references(links, files)


@query(
    "wikilink_candidates",
    r"""
SELECT link, link || '.md' IN (SELECT path FROM notes) OR link IN (SELECT path FROM notes)
  OR link || '.txt' IN (SELECT path FROM notes) AS "exists"
FROM (SELECT DISTINCT unnest(regexp_extract_all(content, '\[\[([^\]|]+)(?:\|[^\]]*)?\]\]', 1)) AS link FROM notes)
""",
)
def wikilink_candidates(spark, sf):
    notes, files, _ = _base(spark, sf)
    return L.wikilink_candidates(notes, files)


SUGGESTION_SQL = """
SELECT target, (row_number() OVER (PARTITION BY target ORDER BY name))::INTEGER AS rank, name
FROM (SELECT DISTINCT target FROM edges WHERE NOT valid) d
JOIN (SELECT name FROM nodes WHERE present) n
  ON contains(lower(n.name), lower(d.target)) OR contains(lower(d.target), lower(n.name))
QUALIFY row_number() OVER (PARTITION BY target ORDER BY name) <= 3
"""


def _dead_and_nodes(spark, sf):
    notes, files, links = _measured(spark, sf)
    dead = L.resolve_links(L.graph_links(links), files).where("NOT valid").select("target").distinct()
    nodes = notes.select(L.note_key(F.col("path")).alias("name"), F.lit(True).alias("exists"))
    return dead, nodes


@query("link_fix_candidates", SUGGESTION_SQL)
def link_fix_candidates(spark, sf):
    return L.link_suggestions(*_dead_and_nodes(spark, sf))


@query(
    "link_fix_suggestions",
    f"""
SELECT d.target, CASE WHEN s.names IS NULL THEN 'Create missing file: ' || d.target || '.md'
  ELSE 'Consider linking to: ' || s.names END AS suggestion
FROM (SELECT DISTINCT target FROM edges WHERE NOT valid) d
LEFT JOIN (SELECT target, string_agg(name, ', ' ORDER BY rank) AS names FROM ({SUGGESTION_SQL}) GROUP BY target) s
  ON s.target = d.target
""",
)
def link_fix_suggestions(spark, sf):
    dead, nodes = _dead_and_nodes(spark, sf)
    return L.suggestion_text(dead, L.link_suggestions(dead, nodes))


ORACLE_VIEWS["note_pairs"] = """
SELECT source AS a, target AS b FROM edges WHERE valid
UNION SELECT target, source FROM edges WHERE valid
"""
COMPONENTS = """
WITH RECURSIVE reach(a, b) AS (
  SELECT a, a FROM note_pairs UNION SELECT r.a, p.b FROM reach r JOIN note_pairs p ON p.a = r.b
), component_of AS (
  SELECT a AS name, min(b) AS component FROM reach GROUP BY a HAVING count(*) > 1
)
"""


@query("link_cluster_members", COMPONENTS + "SELECT name, component FROM component_of")
def link_cluster_members(spark, sf):
    notes, _, links = _measured(spark, sf)
    return L.link_clusters(links, notes).select("name", "component")


@query(
    "link_clusters",
    COMPONENTS
    + """
SELECT c.component, count(*) AS size, sum(n.word_count)::BIGINT AS total_words,
  max(coalesce(x.inside, 0))::BIGINT AS internal_links, max(coalesce(x.outside, 0))::BIGINT AS external_links
FROM component_of c JOIN nodes n ON n.name = c.name
LEFT JOIN (SELECT s.component, count(*) FILTER (t.component IS NOT DISTINCT FROM s.component) AS inside,
             count(*) FILTER (t.component IS DISTINCT FROM s.component) AS outside
           FROM edges e JOIN component_of s ON s.name = e.source LEFT JOIN component_of t ON t.name = e.target
           GROUP BY s.component) x ON x.component = c.component
GROUP BY c.component
""",
)
def link_clusters(spark, sf):
    notes, _, links = _measured(spark, sf)
    members = L.link_clusters(links, notes)
    return L.cluster_summary(members, notes, links).orderBy(F.desc("size"), "component")
