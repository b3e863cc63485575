"""HTML page corpus to linked notes. Input pages: ``rel_path``, ``html``, ``mtime``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import html, paths, text
from folioscope.operators.joins import lookup_join


def tags(path: Column, prefix: str = "code/") -> Column:
    """The prefix itself, then one tag per public folder of the path."""
    folders = F.filter(F.split(paths.parent(path), "/"), lambda d: (d != "") & ~d.startswith("_"))
    own = F.array(F.lit(prefix.rstrip("/"))) if prefix else F.array().cast("array<string>")
    return F.concat(own, F.transform(folders, lambda d: F.concat(F.lit(prefix), d)))


def epoch_text(ts: Column) -> Column:
    """Seconds since the epoch with at least one decimal."""
    micros = F.unix_micros(ts.cast("timestamp"))
    digits = F.regexp_replace(F.lpad((F.pmod(micros, F.lit(1_000_000))).cast("string"), 6, "0"), "0{1,5}$", "")
    return F.concat(F.floor(micros / 1_000_000).cast("bigint").cast("string"), F.lit("."), digits)


def frontmatter(title: Column, tag_list: Column, source: Column, created: Column) -> Column:
    joined = F.array_join(tag_list, ", ")
    return F.concat(
        F.lit("---\ntitle: "),
        title,
        F.when(F.size(tag_list) > 0, F.concat(F.lit("\ntags: ["), joined, F.lit("]"))).otherwise(""),
        F.lit("\nsource: "),
        source,
        F.lit("\ncreated: "),
        created,
        F.lit("\ntype: documentation\n---\n\n"),
    )


# Text that YAML would read as something else: words for true, false and null, numbers, dates, merge keys.
_OTHER_TYPES = (
    r"(?i)(?:y|n|yes|no|true|false|on|off|null|~|=|<<|[-+]?(?:0b[01_]+|0x[0-9a-f_]+|[0-9][0-9_]*(?::[0-5]?[0-9])*)"
    r"|[-+]?(?:[0-9][0-9_]*)?\.[0-9_]*(?:e[-+]?[0-9]+)?|[-+]?\.inf|\.nan|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}.*)"
)
# Indicators at the front, a colon or a number sign that starts a key or a comment, blanks at the ends.
_INDICATED = r"(?s)\A[,\[\]{}#&*!|>'\"%@`].*|\A[-?:](?:\s.*)?|.*:(?:\s.*)?|.*\s#.*|\s.*|.*\s|"


def yaml_scalar(value: Column) -> Column:
    """A text as YAML reads it back: plain where that is safe, else quoted; null is ``null``."""
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for char, sign in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\x85", "\\N"), ("\u2028", "\\L"), ("\u2029", "\\P")):
        escaped = F.replace(escaped, F.lit(char), F.lit(sign))
    # Other control characters have no place in a YAML file, not even escaped by name.
    escaped = F.regexp_replace(escaped, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")
    single = F.concat(F.lit("'"), F.replace(value, F.lit("'"), F.lit("''")), F.lit("'"))
    return (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"[\x00-\x1f\x7f\x{85}\x{2028}\x{2029}]"), F.concat(F.lit('"'), escaped, F.lit('"')))
        .when(value.rlike(f"\\A(?:{_OTHER_TYPES})\\z") | value.rlike(rf"\A(?:{_INDICATED})\z"), single)
        .otherwise(value)
    )


def note_header(title: Column, tag_list: Column, created: Column, source: Column | None = None) -> Column:
    """YAML header of a note, keys in alphabetical order, values quoted where YAML calls for it."""
    items = F.when(
        F.size(tag_list) > 0,
        F.concat(F.lit("\ntags:\n"), F.array_join(F.transform(tag_list, lambda t: F.concat(F.lit("- "), yaml_scalar(t))), "\n")),
    ).otherwise(F.lit("\ntags: []"))
    origin = F.lit("") if source is None else F.concat(F.lit("\nsource: "), yaml_scalar(source))
    return F.concat(
        F.lit("---\ncreated: '"), created, F.lit("'"), origin, items, F.lit("\ntitle: "), yaml_scalar(title), F.lit("\n---\n")
    )


def convertible(pages: DataFrame) -> DataFrame:
    return pages.where(~html.is_skipped(F.col("rel_path")))


def conversion_errors(pages: DataFrame) -> DataFrame:
    """Pages that cannot be converted; they never fail the job."""
    return (
        convertible(pages)
        .where(F.col("html").isNull())
        .select(
            "rel_path",
            F.concat(F.lit("Failed to convert "), "rel_path", F.lit(": no content")).alias("error"),
        )
    )


def convert(pages: DataFrame, wikilinks: bool = True, tag_prefix: str = "code/") -> DataFrame:
    """Notes: path, folder, title, tags, content with frontmatter. No shuffle, one pass."""
    work = convertible(pages).where(F.col("html").isNotNull()).withColumn("body", F.col("html"))
    work = html.to_markdown(work.drop("html"), "body")
    if wikilinks:
        work = work.withColumn("body", html.wikilinked(F.col("body")))
    work = work.withColumn("body", html.tidied(F.col("body")))
    title = text.title_or_stem(F.col("body"), paths.stem(F.col("rel_path")))
    work = work.withColumns({"title": title, "tags": tags(F.col("rel_path"), tag_prefix)})
    head = frontmatter(
        F.col("title"), F.col("tags"), paths.basename(F.col("rel_path")), epoch_text(F.col("mtime"))
    )
    path = paths.html_to_note(F.col("rel_path"))
    return work.select(
        path.alias("path"),
        paths.parent(path).alias("folder"),
        "rel_path",
        "title",
        "tags",
        "body",
        F.concat(head, "body").alias("content"),
        "mtime",
    )


def manifest(pages: DataFrame, with_index: bool = True) -> DataFrame:
    """Source, output and relative path of every converted page, and of the index."""
    rows = convertible(pages).where(F.col("html").isNotNull()).select(
        F.col("rel_path").alias("source"),
        paths.html_to_note(F.col("rel_path")).alias("output"),
        F.col("rel_path").alias("relative_path"),
    )
    if not with_index:
        return rows
    index = pages.sparkSession.range(1).select(
        F.lit("generated").alias("source"),
        F.lit("index.md").alias("output"),
        F.lit("index.md").alias("relative_path"),
    )
    return rows.unionByName(index)


def page_links(pages: DataFrame) -> DataFrame:
    """Every link of a page's raw HTML: label, url and cleaned target."""
    anchors = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"'][^>]*>(.*?)</a\s*>"
    found = text.matches(html.without_raw_text(F.col("html")), anchors)
    return (
        pages.select("rel_path", F.posexplode(found).alias("ord", "a"))
        .select(
            "rel_path",
            "ord",
            F.regexp_extract("a", anchors, 2).alias("label"),
            F.regexp_extract("a", anchors, 1).alias("url"),
        )
        .withColumns(
            {
                "is_external": html.is_external(F.col("url")),
                "target": html.clean_url(F.col("url")),
            }
        )
    )


def link_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Look every internal link up among the pages; unknown targets keep their cleaned url."""
    known = convertible(pages).select(
        paths.without_suffix(F.col("rel_path"), ".html").alias("target"),
        paths.without_suffix(paths.html_to_note(F.col("rel_path")), ".md").alias("note"),
    )
    return lookup_join(links.where(~F.col("is_external")), known, "target", "left").withColumn(
        "note", F.coalesce("note", "target")
    )


def index_lines(notes: DataFrame, wikilinks: bool = True) -> DataFrame:
    """Lines of the index by folder, each with its place (folder, rank, path).

    A folder may hold any share of the notes, so the index is rows; sort by the three place
    columns to write it, which range-partitions also inside a folder.
    """
    p = F.col("relative_path")
    folder = F.when(paths.parent(p) == "", "Root").otherwise(paths.parent(p))
    entry = (
        F.concat(F.lit("- [["), paths.stem(p), F.lit("]]"))
        if wikilinks
        else F.concat(F.lit("- ["), paths.stem(p), F.lit("]("), p, F.lit(")"))
    )
    entries = notes.where(paths.basename(p) != "index.md").select(
        folder.alias("folder"), F.lit(1).alias("rank"), p.alias("path"), entry.alias("line")
    )
    heads = notes.select(folder.alias("folder")).distinct().select(
        "folder",
        F.lit(0).alias("rank"),
        F.lit("").alias("path"),
        F.when(F.col("folder") == "Root", "## Documentation Files")
        .otherwise(F.concat(F.lit("## "), "folder"))
        .alias("line"),
    )
    return heads.unionByName(entries)


def folder_index_lines(files: DataFrame) -> DataFrame:
    """Index of a folder listing: notes with display names first, other files after them."""
    p = F.col("path")
    is_note = p.endswith(".md")
    return files.select(
        F.when(is_note, "Files").otherwise("Other Files").alias("section"),
        "path",
        F.when(
            is_note,
            F.concat(F.lit("- [["), p, F.lit("|"), text.display_name(paths.stem(p)), F.lit("]]")),
        )
        .otherwise(F.concat(F.lit("- ["), paths.basename(p), F.lit("]("), p, F.lit(")")))
        .alias("line"),
    )
