"""Link graph of a note corpus.

Input notes: ``path`` (relative), ``content``, and optionally ``size`` and ``mtime``.
A note's key is its path without ``.md``; a link that names a unique file stem reaches that
note too. Links are rows; the content column never leaves the first stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import paths, text
from folioscope.operators.graph import connected_components
from folioscope.operators.joins import TASK_ROWS, lookup_join, one_row
from folioscope.staging import stage

# Stems that may stay without inbound links.
ENTRY_PAGES = ["index", "readme", "home"]


def is_web_url(url: Column) -> Column:
    """The rule of the analysis: anything that begins with ``http``."""
    return url.startswith("http")


def note_key(path: Column) -> Column:
    return paths.without_suffix(path, ".md")


def link_list(content: Column) -> Column:
    """array<struct<type, target, display_text, url>>: all links of a text in order, by type."""
    wiki = F.transform(
        text.wikilinks(content),
        lambda x: F.struct(
            F.lit("wikilink").alias("type"),
            x["target"].alias("target"),
            x["display"].alias("display_text"),
            F.lit(None).cast("string").alias("url"),
        ),
    )
    markdown = F.transform(
        text.markdown_links(content),
        lambda x: F.struct(
            F.lit("markdown_link").alias("type"),
            paths.stem(x["url"]).alias("target"),
            x["display"].alias("display_text"),
            x["url"].alias("url"),
        ),
    )
    return F.concat(wiki, markdown)


def extract_links(notes: DataFrame) -> DataFrame:
    """One row per link of notes, measured or not; external links included.

    Columns: source_path, source (note key), ord, type, target, display_text, url, link_path
    (the path that must exist for the link to be valid).
    """
    links = F.col("links") if "links" in notes.columns else link_list(F.col("content"))
    return (
        notes.select(
            F.col("path").alias("source_path"),
            note_key(F.col("path")).alias("source"),
            F.posexplode(links).alias("ord", "link"),
        )
        .select("source_path", "source", "ord", "link.*")
        .withColumn(
            "link_path",
            paths.normalise(
                F.when(F.col("type") == "wikilink", F.concat("target", F.lit(".md"))).otherwise(
                    F.col("url")
                )
            ),
        )
    )


def graph_links(links: DataFrame) -> DataFrame:
    """Links that belong to the graph: everything except web links."""
    return links.where((F.col("type") == "wikilink") | ~is_web_url(F.col("url")))


def existing_paths(files: DataFrame, with_folders: bool = True) -> DataFrame:
    """Paths a link may point at: the files and, for markdown links, their folders."""
    own = files.select(F.col("path").alias("link_path"))
    if not with_folders:
        return own
    folders = files.select(F.explode(paths.ancestors(F.col("path"))).alias("link_path"))
    return own.unionByName(folders.distinct())


def resolve_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``valid``: the linked path exists among ``files(path)``."""
    known = existing_paths(files).withColumn("valid", F.lit(True))
    return lookup_join(links, known, "link_path", "left").withColumn(
        "valid", F.coalesce("valid", F.lit(False))
    )


def anchorless_validity(links: DataFrame, files: DataFrame) -> DataFrame:
    """Add ``valid_ignoring_anchor``: validity once ``#anchor`` is cut off the target."""
    bare = links.withColumn(
        "link_path",
        paths.normalise(
            F.when(
                F.col("type") == "wikilink",
                F.concat(F.substring_index("target", "#", 1), F.lit(".md")),
            ).otherwise(F.substring_index("url", "#", 1))
        ),
    )
    known = existing_paths(files).withColumn("valid_ignoring_anchor", F.lit(True))
    return lookup_join(bare, known, "link_path", "left").withColumn(
        "valid_ignoring_anchor", F.coalesce("valid_ignoring_anchor", F.lit(False))
    )


def dead_links(links: DataFrame, files: DataFrame) -> DataFrame:
    """Graph links whose target does not exist.

    ``target_exists`` tells whether a note of that name exists all the same, in another folder.
    """
    missing = (
        resolve_links(graph_links(links), files).where(~F.col("valid")).drop("valid", "link_path")
    )
    names = note_names(files).select(
        F.col("name").alias("target"), F.lit(True).alias("target_exists")
    )
    return lookup_join(missing, names, "target", "left").select(
        "source",
        "target",
        "type",
        "display_text",
        "ord",
        F.coalesce("target_exists", F.lit(False)).alias("target_exists"),
        F.when(F.col("type") == "wikilink", "high").otherwise("medium").alias("severity"),
    )


def duplicate_stems(notes: DataFrame) -> DataFrame:
    """Stems used by more than one note; links by such a stem are ambiguous."""
    return (
        notes.select(paths.stem(F.col("path")).alias("stem"), "path")
        .groupBy("stem")
        .agg(F.count(F.lit(1)).alias("notes"), F.min("path").alias("first_path"))
        .where(F.col("notes") > 1)
    )


def note_names(notes: DataFrame) -> DataFrame:
    """Names by which a note can be reached: its key and, where unique, its stem."""
    keyed = notes.select(note_key(F.col("path")).alias("key"), paths.stem(F.col("path")).alias("stem"))
    stems = (
        keyed.groupBy("stem")
        .agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key"))
        .where((F.col("n") == 1) & (F.col("stem") != F.col("key")))
        .select(F.col("stem").alias("name"), "key", F.lit(1).alias("rank"))
    )
    own = keyed.select(F.col("key").alias("name"), "key", F.lit(0).alias("rank"))
    return own.unionByName(stems).groupBy("name").agg(F.min_by("key", "rank").alias("key"))


def inbound_counts(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Links per target key: wikilinks only, and valid links of both types.

    Counts come first, so a target with a third of all links is one row per map task.
    """
    per_name = (
        graph_links(links)
        .groupBy("target", "link_path")
        .agg(
            F.count_if(F.col("type") == "wikilink").alias("wiki"),
            F.count_if(F.col("type") == "markdown_link").alias("markdown"),
        )
    )
    known = notes.select(F.col("path").alias("link_path"), F.lit(True).alias("is_note"))
    names = note_names(notes).select(F.col("name").alias("target"), "key")
    # Stems like ``index`` are the target of very many paths.
    return (
        lookup_join(per_name.join(known, "link_path", "left"), names, "target", "left")
        .select(
            F.coalesce("key", "target").alias("wiki_key"),
            F.when(F.col("is_note"), note_key(F.col("link_path"))).alias("path_key"),
            "wiki",
            "markdown",
        )
        .select(
            F.explode(
                F.array(
                    F.struct(
                        F.col("wiki_key").alias("key"),
                        F.col("wiki").alias("inbound_links"),
                        F.lit(0).cast("bigint").alias("markdown_in"),
                        (F.col("wiki") > 0).alias("is_node"),
                    ),
                    F.struct(
                        F.col("path_key").alias("key"),
                        F.lit(0).cast("bigint").alias("inbound_links"),
                        F.col("markdown").alias("markdown_in"),
                        F.lit(False).alias("is_node"),
                    ),
                )
            ).alias("t")
        )
        .select("t.*")
        .where(F.col("key").isNotNull() & ((F.col("inbound_links") > 0) | (F.col("markdown_in") > 0)))
        .groupBy("key")
        .agg(
            F.sum("inbound_links").alias("inbound_links"),
            F.sum(F.col("inbound_links") + F.col("markdown_in")).alias("inbound_all"),
        )
    )


def note_features(notes: DataFrame, *kept: str) -> DataFrame:
    """Per-note measures that need no shuffle; the content stays behind."""
    if "content" not in notes.columns:
        return notes.select("name", "path", "size", "word_count", "headings", "outbound_links")
    content = F.col("content")
    outbound = F.size(text.matches(content, text.WIKILINK)) + F.size(
        F.filter(text.markdown_links(content), lambda x: ~is_web_url(x["url"]))
    )
    return notes.select(
        note_key(F.col("path")).alias("name"),
        "path",
        F.length(content).alias("size"),
        text.word_count(content).alias("word_count"),
        text.headings(content).alias("headings"),
        outbound.alias("outbound_links"),
        *kept,
    )


def measured(notes: DataFrame) -> DataFrame:
    """Paths, measures and links of notes, written once, for reports of several branches.

    This is the only pass over the text: what follows reads these short rows.
    """
    names = ["name", "path", "size", "word_count", "headings", "outbound_links"]
    with_links = note_features(notes.withColumn("links", link_list(F.col("content"))), "links")
    return stage(with_links.select(*names, "links"), "measured-notes")


def build_nodes(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Graph nodes: every note, and a placeholder for every unresolved wikilink target."""
    inbound = inbound_counts(links, notes).withColumnRenamed("key", "name")
    joined = note_features(notes).withColumn("exists", F.lit(True)).join(
        inbound, "name", "full_outer"
    )
    zero = F.lit(0)
    return joined.select(
        "name",
        F.coalesce("path", F.concat("name", F.lit(".md"))).alias("path"),
        F.coalesce("size", zero).alias("size"),
        F.coalesce("word_count", zero).alias("word_count"),
        F.coalesce("headings", F.array().cast(joined.schema["headings"].dataType)).alias("headings"),
        F.coalesce("outbound_links", zero).cast("bigint").alias("outbound_links"),
        F.coalesce("inbound_links", zero).cast("bigint").alias("inbound_links"),
        F.coalesce("inbound_all", zero).cast("bigint").alias("inbound_all"),
        F.coalesce("exists", F.lit(False)).alias("exists"),
    )


def existing_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.coalesce("exists", F.lit(True)))


def orphans(nodes: DataFrame) -> DataFrame:
    """Existing notes without inbound links, entry pages excepted."""
    return existing_nodes(nodes).where(
        (F.col("inbound_links") == 0) & ~F.lower(paths.stem(F.col("path"))).isin(ENTRY_PAGES)
    ).select(
        "name",
        "path",
        "size",
        "word_count",
        "outbound_links",
        F.when(F.col("outbound_links") > 0, "Add links to this file from related pages")
        .otherwise("Consider linking this file from index or removing if unused")
        .alias("suggestion"),
    )


def node_group(inbound: Column, outbound: Column) -> Column:
    return (
        F.when(inbound > 5, "hub")
        .when(outbound > 5, "authority")
        .when(inbound == 0, "orphan")
        .otherwise("regular")
    )


def graph_export_nodes(nodes: DataFrame) -> DataFrame:
    return existing_nodes(nodes).select(
        F.col("name").alias("id"),
        F.col("name").alias("label"),
        F.greatest(F.lit(5), F.least(F.lit(50), F.floor(F.col("word_count") / 50)))
        .cast("int")
        .alias("size"),
        F.col("inbound_links").alias("inbound"),
        F.col("outbound_links").alias("outbound"),
        node_group(F.col("inbound_links"), F.col("outbound_links")).alias("group"),
    )


def graph_export_edges(links: DataFrame, files: DataFrame) -> DataFrame:
    return (
        resolve_links(graph_links(links), files)
        .where("valid")
        .select("source", "target", "type", F.lit(1).alias("weight"))
    )


def layout_hints(nodes: DataFrame) -> DataFrame:
    total = existing_nodes(nodes).agg(F.count(F.lit(1)).alias("n"))
    return total.select(
        F.when(F.col("n") > 20, "force_directed").otherwise("circular").alias("recommended_layout"),
        (F.col("n") > 10).alias("clustering_enabled"),
        F.lit(True).alias("highlight_hubs"),
    )


def _valid_counts(links: DataFrame, files: DataFrame, by: list[str]) -> DataFrame:
    """Number of links and valid links per group; each distinct path is looked up once."""
    counted = links.groupBy(*by, "link_path").agg(F.count(F.lit(1)).alias("n"))
    known = existing_paths(files).withColumn("known", F.lit(True))
    return (
        counted.join(known, "link_path", "left")
        .groupBy(*by)
        .agg(
            F.sum("n").alias("total"),
            F.coalesce(F.sum(F.when(F.col("known"), F.col("n"))), F.lit(0)).alias("valid"),
        )
    )


def link_statistics(nodes: DataFrame, links: DataFrame, files: DataFrame) -> DataFrame:
    """One row: files, links, words, per-type and validity counts, connectivity."""
    linked = (F.col("inbound_links") > 0) | (F.col("outbound_links") > 0)
    node_part = nodes.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("total_words"),
        F.count_if(linked).alias("connected_files"),
        F.count_if(~linked).alias("isolated_files"),
    )
    of_type = lambda t: F.when(F.col("type") == t, F.col("total"))
    link_part = _valid_counts(graph_links(links), files, ["type"]).agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_links"),
        F.coalesce(F.sum(of_type("wikilink")), F.lit(0)).alias("wikilinks"),
        F.coalesce(F.sum(of_type("markdown_link")), F.lit(0)).alias("markdown_links"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_links"),
        F.coalesce(F.sum(F.col("total") - F.col("valid")), F.lit(0)).alias("broken_links"),
    )
    return one_row(node_part, link_part).withColumn(
        "average_links_per_file",
        F.when(F.col("total_files") > 0, F.col("total_links") / F.col("total_files")).otherwise(0.0),
    )


def top_nodes(nodes: DataFrame, measure: str, limit: int = 5) -> DataFrame:
    """Nodes with most inbound (hubs) or outbound (authorities) links, zeros dropped."""
    return (
        nodes.where(F.col(measure) > 0)
        .select("name", measure)
        .orderBy(F.desc(measure), "name")
        .limit(limit)
    )


def link_class(links: DataFrame) -> DataFrame:
    """Classes of the validation dialect: wikilink, external, anchor, internal."""
    return links.withColumn(
        "link_class",
        F.when(F.col("type") == "wikilink", "wikilinks")
        .when(is_web_url(F.col("url")), "external")
        .when(F.col("url").contains("#"), "anchors")
        .otherwise("internal"),
    )


def link_validation(links: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts per class, valid and broken links and the score.

    External and anchor links count as valid; a corpus without links scores 100.
    """
    per_class = _valid_counts(link_class(links), files, ["link_class"]).withColumn(
        "valid",
        F.when(F.col("link_class").isin("external", "anchors"), F.col("total")).otherwise(
            F.col("valid")
        ),
    )
    of = lambda c: F.coalesce(
        F.sum(F.when(F.col("link_class") == c, F.col("total"))), F.lit(0)
    )
    return per_class.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total_links"),
        F.coalesce(F.sum("valid"), F.lit(0)).alias("valid_links"),
        F.coalesce(F.sum(F.col("total") - F.col("valid")), F.lit(0)).alias("broken_links"),
        *[of(c).alias(c) for c in ("internal", "external", "wikilinks", "anchors")],
    ).withColumn(
        "score",
        F.when(F.col("total_links") == 0, 100.0).otherwise(
            F.col("valid_links") / F.col("total_links") * 100
        ),
    )


def broken_cross_references(links: DataFrame, files: DataFrame) -> DataFrame:
    """Broken links of the validation dialect, one row each."""
    checked = link_class(links).where(F.col("link_class").isin("wikilinks", "internal"))
    goal = F.when(F.col("type") == "wikilink", F.col("target")).otherwise(F.col("url"))
    return (
        resolve_links(checked, files)
        .where(~F.col("valid"))
        .select(
            F.col("source_path").alias("source"),
            "type",
            goal.alias("target"),
            F.col("display_text").alias("display"),
            F.lit("medium").alias("severity"),
            F.concat(
                F.when(F.col("type") == "wikilink", "Broken wikilink to ").otherwise(
                    "Broken markdown link to "
                ),
                goal,
            ).alias("message"),
        )
    )


def wikilink_candidates(notes: DataFrame, files: DataFrame) -> DataFrame:
    """Per distinct wikilink: does ``t.md``, ``t`` or ``t.txt`` exist?"""
    targets = notes.select(
        F.explode(
            F.transform(
                text.matches(F.col("content"), text.WIKILINK_LOOSE),
                lambda m: F.regexp_extract(m, text.WIKILINK_LOOSE, 1),
            )
        ).alias("link")
    ).distinct()
    tried = targets.select(
        "link",
        F.explode(
            F.transform(
                F.array(F.lit(".md"), F.lit(""), F.lit(".txt")),
                lambda e: paths.normalise(F.concat(F.col("link"), e)),
            )
        ).alias("link_path"),
    )
    known = existing_paths(files).withColumn("known", F.lit(True))
    return (
        tried.join(known, "link_path", "left")
        .groupBy("link")
        .agg(F.coalesce(F.bool_or("known"), F.lit(False)).alias("exists"))
    )


#: Characters of the grams by which names and targets find each other.
GRAM = 3


def _grams(df: DataFrame, column: str, size: int = GRAM) -> DataFrame:
    """The columns and ``gram``: every distinct stretch of ``size`` characters of a column."""
    starts = F.sequence(F.lit(1), F.length(column) - (size - 1))
    cut = F.transform(starts, lambda i: F.substring(F.col(column), i, F.lit(size)))
    return df.where(F.length(column) >= size).select("*", F.explode(F.array_distinct(cut)).alias("gram"))


def _first_names(df: DataFrame, by: str, limit: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy("name")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def containment(patterns: DataFrame, texts: DataFrame) -> DataFrame:
    """All (pattern, text) in which a text contains a pattern of more than ``GRAM`` characters.

    An inverted index lists the texts of each gram that occurs in a pattern. A pattern needs all its
    grams, so it looks at the list of its rarest one only, and drops out if one has no list; what
    it finds there is compared in full. A list of over a million texts is dealt to one salt for each
    million, and the patterns that ask for it are repeated as often.
    """
    own = stage(_grams(patterns.select("pattern").distinct().where(F.length("pattern") > GRAM), "pattern"), "pattern-grams")
    index = stage(_grams(texts.select("text").distinct(), "text").join(own.select("gram").distinct(), "gram", "left_semi"), "gram-index")
    lists = stage(index.groupBy("gram").agg(F.count(F.lit(1)).alias("texts")), "gram-lists")
    rarest = (
        lookup_join(own, lists, "gram", "left", staged=True)
        .groupBy("pattern")
        .agg(F.min(F.struct("texts", "gram")).alias("rarest"), F.bool_and(F.col("texts").isNotNull()).alias("listed"))
        .where("listed")
    )
    salts = F.ceil(F.col("texts") / TASK_ROWS).cast("int")
    asked = rarest.select(
        "pattern", "rarest.gram", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rarest.texts") / TASK_ROWS).cast("int") - 1)).alias("salt")
    )
    # Each of these lists has a million rows of the index, which bounds how many there are.
    long = lists.where(F.col("texts") > TASK_ROWS).select("gram", salts.alias("salts"))
    dealt = index.join(F.broadcast(long), "gram", "left").select(
        "gram", "text", F.pmod(F.xxhash64("text"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    )
    return asked.join(dealt, ["gram", "salt"]).where(F.contains("text", "pattern")).select("pattern", "text")


def link_suggestions(
    dead_targets: DataFrame, nodes: DataFrame, limit: int = 3
) -> DataFrame:
    """First ``limit`` names, in name order, that contain or are contained in a dead target.

    Long targets find names, and long names find targets, through an index of grams. A target or
    name of at most ``GRAM`` characters is a gram itself, so an equi-join on grams of its length
    does; on the name side only the first names of each gram are shuffled, so that a gram which a
    third of all names share stays small.
    """
    targets = stage(dead_targets.select("target").distinct().withColumn("low", F.lower("target")), "targets")
    names = stage(existing_nodes(nodes).select("name", F.lower("name").alias("low")).distinct(), "names")
    low_targets, low_names = targets.select("low").distinct(), names.select("low").distinct()
    found = containment(
        low_targets.withColumnRenamed("low", "pattern"), low_names.withColumnRenamed("low", "text")
    ).join(names.withColumnRenamed("low", "text"), "text").select(F.col("pattern").alias("low"), "name")
    inside = containment(
        low_names.withColumnRenamed("low", "pattern"), low_targets.withColumnRenamed("low", "text")
    ).join(names.withColumnRenamed("low", "pattern"), "pattern").select(F.col("text").alias("low"), "name")
    for size in range(1, GRAM + 1):
        of_size = F.length("low") == size
        wanted = low_targets.where(of_size).withColumnRenamed("low", "gram")
        first = _first_names(_grams(names, "low", size).join(wanted, "gram", "left_semi"), "gram", limit)
        found = found.unionByName(first.select(F.col("gram").alias("low"), "name"))
        short = names.where(of_size).select("name", F.col("low").alias("gram"))
        inside = inside.unionByName(_grams(low_targets, "low", size).join(short, "gram").select("low", "name"))
    either = found.unionByName(inside).distinct().join(targets, "low")
    return _first_names(either, "target", limit).select("target", "rank", "name")


def suggestion_text(dead_targets: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One sentence per dead target; at most three names are gathered per row."""
    lists = suggestions.groupBy("target").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda s: s["name"]),
            ", ",
        ).alias("similar")
    )
    targets = dead_targets.select("target").distinct()
    return targets.join(lists, "target", "left").select(
        "target",
        F.when(F.col("similar").isNotNull(), F.concat(F.lit("Consider linking to: "), "similar"))
        .otherwise(F.concat(F.lit("Create missing file: "), "target", F.lit(".md")))
        .alias("suggestion"),
    )


def link_clusters(links: DataFrame, notes: DataFrame) -> DataFrame:
    """Members of clusters: notes connected by valid links, taken as undirected."""
    note_paths = notes.select(F.col("path").alias("link_path"), F.lit(True).alias("is_note"))
    edges = (
        graph_links(links)
        .where(F.col("link_path").isNotNull())
        .select("source", "link_path")
        .distinct()
    )
    valid = lookup_join(edges, note_paths, "link_path", "inner").select(
        "source", note_key(F.col("link_path")).alias("target")
    )
    return connected_components(valid, "source", "target").withColumnRenamed("node", "name")


def cluster_summary(members: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """Size, words, links inside and links leaving, per cluster."""
    words = notes.select(
        note_key(F.col("path")).alias("name"),
        (F.col("word_count") if "word_count" in notes.columns else text.word_count(F.col("content"))).alias("words"),
    )
    sizes = (
        members.join(words, "name")
        .groupBy("component")
        .agg(F.count(F.lit(1)).alias("size"), F.sum("words").alias("total_words"))
    )
    # Links per (cluster, target) are counted before targets are looked up, so neither a giant
    # cluster nor a popular target becomes one task.
    leaving = (
        lookup_join(
            graph_links(links).select(F.col("source").alias("name"), "target"), members, "name", "inner"
        )
        .groupBy("component", "target")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    names = note_names(notes).select(F.col("name").alias("target"), "key")
    goals = names.join(
        members.select(F.col("name").alias("key"), F.col("component").alias("target_component")), "key"
    ).select("target", "target_component")
    inside = F.col("component") == F.col("target_component")
    crossing = (
        lookup_join(leaving, goals, "target", "left")
        .groupBy("component")
        .agg(
            F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("internal_links"),
            F.sum(F.when(inside, 0).otherwise(F.col("n"))).alias("external_links"),
        )
    )
    return sizes.join(crossing, "component", "left").select(
        "component",
        "size",
        "total_words",
        F.coalesce("internal_links", F.lit(0)).alias("internal_links"),
        F.coalesce("external_links", F.lit(0)).alias("external_links"),
    )
