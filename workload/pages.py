"""Queries over the HTML pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import html, paths, text
from folioscope.operators import pages as P
from folioscope.sources import sinks
from workload.fixtures import ORACLE_VIEWS, VIEWS, render_spark
from workload.registry import query

VIEWS["html_pages"] = """
SELECT page_id,
  CASE WHEN page_id % 17 = 0 THEN '_static/' WHEN page_id % 19 = 0 THEN '_private/' ELSE '' END
  || regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')
  || '_' || CAST(page_id AS STRING)
  || CASE WHEN page_id % 23 = 0 THEN '/search.html' ELSE '.html' END AS rel_path,
  CASE WHEN page_id % 31 = 0 THEN NULL ELSE html END AS html,
  TIMESTAMP '2024-01-01 00:00:00' + page_id * INTERVAL '1' MINUTE AS mtime
FROM pages
"""
SKIP = "(" + " OR ".join(f"contains(rel_path, '{s}')" for s in html.SKIPPED_PAGES) + ")"
ORACLE_VIEWS["kept_pages"] = f"SELECT * FROM html_pages WHERE NOT {SKIP} AND html IS NOT NULL"
ORACLE_VIEWS["page_bodies"] = r"""
SELECT rel_path, mtime,
  regexp_replace(regexp_replace(regexp_replace(
    regexp_extract(regexp_replace(html, '(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>', '', 'g'),
      '(?is)<body\b[^>]*>(.*?)(?:</body\s*>|$)', 1),
    '(?is)<nav\b[^>]*>.*?</nav\s*>', '', 'g'), '(?is)<header\b[^>]*>.*?</header\s*>', '', 'g'), '(?is)<footer\b[^>]*>.*?</footer\s*>', '', 'g') AS body
FROM kept_pages
"""


def _replace_chain(expr: str, steps: list[tuple[str, str]]) -> str:
    for pattern, into in steps:
        into = " || ".join(f"'{p}'" if p != "\n" else "chr(10)" for p in into.replace("\n", "\0\n\0").split("\0") if p) or "''"
        expr = f"regexp_replace({expr}, '{pattern}', {into}, 'g')"
    return expr


MARKDOWN_SQL = _replace_chain(
    "body",
    [
        (r"[ \t\r\n]+", " "),
        (r"(?is)<h1\b[^>]*>\s*(.*?)\s*</h1\s*>", "\n\n# \\1\n\n"),
        (r"(?i)<br\s*/?>", "\ue000"),
        (r"(?is)<b\b[^>]*>\s*(.*?)\s*</b\s*>", "**\\1**"),
        (r"(?i)<li\b[^>]*>\s*", "\n- "),
        (r"(?i)</?p\b[^>]*>", "\n\n"),
        (r"(?i)</?(?:div|article|ul)\b[^>]*>", "\n"),
        (r"<[/!?a-zA-Z][^>]*>", ""),
        (r"[ \t]*\n[ \t]*", "\n"),
        ("\ue000[ \\t]*", "  \n"),
        ("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "\u00a9"),
        ("&middot;", "\u00b7"), ("&amp;", "&"),
    ],
)
TIDY_STEPS = [
    (r"\n{3,}", "\n\n"),
    (r"```(\w+)?\n\n+", "```\\1\n"),
    (r"\n+([\s\x0b\x{0085}\x{00a0}]*[-*+])", "\n\\1"),
]
ORACLE_VIEWS["converted"] = rf"""
SELECT rel_path, mtime, regexp_replace(replace(replace({_replace_chain('md', TIDY_STEPS)}, '\_', '_'), '\*', '*'), '^\s+|\s+$', '', 'g') AS body
FROM (SELECT rel_path, mtime, {MARKDOWN_SQL} AS md FROM page_bodies)
"""
STEM_SQL = "regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '^(.+)\\.[^.]+$', '\\1')"
TITLE_SQL = f"coalesce(nullif(trim(regexp_extract(body, '(?m)^# (.+)$', 1)), ''), {STEM_SQL})"
NOTE_SQL = "regexp_replace(rel_path, '\\.html$', '.md')"
FOLDER_SQL = "regexp_extract(rel_path, '^(.*)/[^/]*$', 1)"
TAGS_SQL = f"array_to_string(list_concat(['code'], list_transform(list_filter(string_split({FOLDER_SQL}, '/'), lambda d: d <> '' AND NOT starts_with(d, '_')), lambda d: 'code/' || d)), ', ')"


def _pages(spark, sf):
    return render_spark(spark, sf, "html_pages").select("rel_path", "html", "mtime")


@query("page_scan_kept", f"SELECT rel_path FROM html_pages WHERE NOT {SKIP}")
def page_scan_kept(spark, sf):
    return P.convertible(_pages(spark, sf)).select("rel_path")


@query("page_markdown", f"SELECT {NOTE_SQL} AS path, body FROM converted")
def page_markdown(spark, sf):
    return P.convert(_pages(spark, sf)).select("path", "body")


@query(
    "page_notes",
    f"SELECT {NOTE_SQL} AS path, {FOLDER_SQL} AS folder, {TITLE_SQL} AS title, {TAGS_SQL} AS tags, md5(body) AS body_md5 FROM converted",
)
def page_notes(spark, sf):
    return P.convert(_pages(spark, sf)).select(
        "path", "folder", "title", F.array_join("tags", ", ").alias("tags"), F.md5("body").alias("body_md5")
    )


# Pages of every construct, around a page's number and a digest of its address, and by hand what they
# stand for.
VIEWS["construct_pages"] = """
SELECT page_id, host, concat('<body><div><nav><ul><li>gone</div><div role=main><h2>Page ', page_id, '</h2><ol start=3><li>', host, '<ul><li>a ',
  page_id, '</li></ul><li>b</ol><table><tr><th>k<th>v<tr><td>', page_id, '<td><b>', host, '</b></table><img src=', page_id,
  '.png><dl><dd class="headerlink">gone</dd></dl><a href=x_', page_id, '.html#a.b-c>go</a><pre><code class="language-python">x  = ', page_id,
  '</code></pre></div><p>', host, '</p></body>') AS html
FROM (SELECT page_id, substr(md5(url), 1, 8) AS host FROM pages) t
"""


@query(
    "page_constructs",
    """
SELECT page_id, array_to_string([
  '## Page ' || page_id, '', '3. ' || host, '   - a ' || page_id, '4. b', '', '| k | v |', '| --- | --- |',
  '| ' || page_id || ' | **' || host || '** |', '', '![](' || page_id || '.png)', '', '[[x_' || page_id || '#b c|go]]', '',
  '```python', 'x  = ' || page_id, '```'], chr(10)) AS markdown
FROM construct_pages
""",
)
def page_constructs(spark, sf):
    pages = render_spark(spark, sf, "construct_pages").select("page_id", F.col("html").alias("markdown"))
    pages = html.to_markdown(pages, "markdown").withColumn("markdown", html.wikilinked(F.col("markdown")))
    return pages.withColumn("markdown", html.tidied(F.col("markdown")))


@query(
    "page_frontmatter",
    f"""
SELECT {NOTE_SQL} AS path, '---' || chr(10) || 'title: ' || {TITLE_SQL} || chr(10) || 'tags: [' || {TAGS_SQL} || ']' || chr(10)
  || 'source: ' || regexp_extract(rel_path, '([^/]*)$', 1) || chr(10) || 'created: ' || CAST(epoch(mtime)::BIGINT AS VARCHAR) || '.0' || chr(10)
  || 'type: documentation' || chr(10) || '---' || chr(10) || chr(10) AS frontmatter
FROM converted
""",
)
def page_frontmatter(spark, sf):
    notes = P.convert(_pages(spark, sf))
    return notes.select(
        "path", F.expr("substring(content, 1, length(content) - length(body))").alias("frontmatter")
    )


@query(
    "page_manifest",
    f"""
SELECT rel_path AS source, {NOTE_SQL} AS output, rel_path AS relative_path FROM kept_pages
UNION ALL SELECT 'generated', 'index.md', 'index.md'
""",
)
def page_manifest(spark, sf):
    return P.manifest(_pages(spark, sf))


@query(
    "page_errors",
    f"SELECT rel_path, 'Failed to convert ' || rel_path || ': no content' AS error FROM html_pages WHERE NOT {SKIP} AND html IS NULL",
)
def page_errors(spark, sf):
    return P.conversion_errors(_pages(spark, sf))


ORACLE_VIEWS["page_anchor_rows"] = r"""
SELECT rel_path, label, url, regexp_replace(split_part(url, '#', 1), '\.html$', '') AS target,
  starts_with(url, 'http://') OR starts_with(url, 'https://') OR starts_with(url, 'mailto:') OR starts_with(url, 'ftp://') AS is_external
FROM (SELECT rel_path, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 1)) AS url,
        unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a\s*>', 2)) AS label
      FROM kept_pages)
"""


@query("page_links", "SELECT rel_path, label, url, target, is_external FROM page_anchor_rows")
def page_links(spark, sf):
    return P.page_links(P.convertible(_pages(spark, sf))).drop("ord")


@query(
    "page_link_targets",
    """
SELECT a.rel_path, a.url, a.target, coalesce(replace(k.rel_path, '.html', ''), a.target) AS note
FROM page_anchor_rows a LEFT JOIN kept_pages k ON replace(k.rel_path, '.html', '') = a.target WHERE NOT a.is_external
""",
)
def page_link_targets(spark, sf):
    pages = _pages(spark, sf)
    return P.link_targets(P.page_links(P.convertible(pages)), pages).select(
        "rel_path", "url", "target", "note"
    )


LABEL = "'Doc ' || CAST(doc_id AS VARCHAR)"
VIEWS["link_texts"] = """
SELECT doc_id, '[' || CASE WHEN doc_id % 4 = 0 THEN 'api mod' || CAST(doc_id AS STRING) ELSE 'Label ' || CAST(doc_id AS STRING) END || ']('
  || CASE WHEN doc_id % 5 = 0 THEN 'http://x/' WHEN doc_id % 5 = 1 THEN 'mailto:' ELSE '' END
  || 'api/mod' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 2 = 0 THEN '.html' ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN '#pkg.mod.Some-Class' WHEN doc_id % 3 = 1 THEN '#sec-tion' ELSE '' END || ')' AS link,
  text
FROM documents
"""


@query(
    "link_rewriting",
    """
SELECT doc_id, text || chr(10) || CASE WHEN doc_id % 5 < 2 THEN link ELSE
  '[[api/mod' || CAST(doc_id AS VARCHAR) || CASE WHEN doc_id % 3 = 0 THEN '#Some Class' WHEN doc_id % 3 = 1 THEN '#sec tion' ELSE '' END
  || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '|Label ' || CAST(doc_id AS VARCHAR) END || ']]' END || ' end' AS rewritten
FROM link_texts
""",
)
def link_rewriting(spark, sf):
    docs = render_spark(spark, sf, "link_texts")
    body = F.concat("text", F.lit("\n"), "link", F.lit(" end"))
    return docs.select("doc_id", html.wikilinked(body).alias("rewritten"))


@query(
    "page_index",
    f"""
SELECT folder, 1 AS rank, rel_path AS path, '- [[' || stem || ']]' AS line FROM (
  SELECT rel_path, {STEM_SQL} AS stem, CASE WHEN {FOLDER_SQL} = '' THEN 'Root' ELSE {FOLDER_SQL} END AS folder FROM kept_pages)
UNION ALL
SELECT DISTINCT folder, 0, '', CASE WHEN folder = 'Root' THEN '## Documentation Files' ELSE '## ' || folder END FROM (
  SELECT CASE WHEN {FOLDER_SQL} = '' THEN 'Root' ELSE {FOLDER_SQL} END AS folder FROM kept_pages)
""",
)
def page_index(spark, sf):
    notes = P.manifest(_pages(spark, sf), with_index=False)
    return P.index_lines(notes).orderBy("folder", "rank", "path")


@query(
    "folder_index",
    r"""
SELECT CASE WHEN path LIKE '%.md' THEN 'Files' ELSE 'Other Files' END AS section, path,
  CASE WHEN path LIKE '%.md' THEN '- [[' || path || '|Doc ' || regexp_extract(path, 'doc_([0-9]+)', 1) || ']]'
       ELSE '- [' || path || '](' || path || ')' END AS line
FROM (SELECT CASE WHEN doc_id % 9 = 0 THEN replace(path, '.md', '.png') ELSE path END AS path FROM notes)
""",
)
def folder_index(spark, sf):
    notes = render_spark(spark, sf, "notes")
    files = notes.select(
        F.when(F.col("doc_id") % 9 == 0, F.replace("path", F.lit(".md"), F.lit(".png")))
        .otherwise(F.col("path"))
        .alias("path")
    )
    return P.folder_index_lines(files).orderBy("section", "path")


@query(
    "notes_written_by_folder",
    f"SELECT {FOLDER_SQL} AS folder, count(*) AS notes, sum(length(body))::BIGINT AS chars FROM converted GROUP BY 1",
)
def notes_written_by_folder(spark, sf):
    notes = P.convert(_pages(spark, sf))
    written = sinks.write_notes(notes.select("path", "folder", "body"), name="page-notes")
    return written.groupBy("folder").agg(
        F.count(F.lit(1)).alias("notes"), F.sum(F.length("body")).alias("chars")
    )


@query(
    "titles_and_stems",
    """
SELECT path, CASE WHEN doc_id % 3 <> 0 THEN 'Doc ' || CAST(doc_id AS VARCHAR) ELSE replace(path, '.md', '') END AS title,
  'Doc ' || CAST(doc_id AS VARCHAR) AS display_name
FROM notes
""",
)
def titles_and_stems(spark, sf):
    notes = render_spark(spark, sf, "notes")
    stem = paths.stem(F.col("path"))
    return notes.select(
        "path",
        text.title_or_stem(F.col("content"), stem).alias("title"),
        text.display_name(stem).alias("display_name"),
    )
