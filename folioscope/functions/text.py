"""Markdown text: links, headings, words, titles, quality predicates.

Patterns use ``(?U)`` where whitespace must be Unicode-aware, and ``(?d)`` together with
``(?m)`` so that only a line feed ends a line.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a link and as a heading.
WIKILINK = r"\[\[([^\]|]+)(?:\|([^\]]+))?\]\]"
WIKILINK_LOOSE = r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"
MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+)\)"
HEADING = r"(?mdU)^(#+)\s+(.+)$"
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode whitespace from both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+"))


def matches(text: Column, pattern: str) -> Column:
    """All whole matches; one pass over the text, groups are cut from the short matches."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def wikilinks(text: Column) -> Column:
    """array<struct<target, display>>; the display text defaults to the target."""

    def parse(m: Column) -> Column:
        target = F.regexp_extract(m, WIKILINK, 1)
        alias = F.regexp_extract(m, WIKILINK, 2)
        return F.struct(
            target.alias("target"), F.when(alias == "", target).otherwise(alias).alias("display")
        )

    return F.transform(matches(text, WIKILINK), parse)


def markdown_links(text: Column) -> Column:
    """array<struct<display, url>>; images match too."""
    return F.transform(
        matches(text, MARKDOWN_LINK),
        lambda m: F.struct(
            F.regexp_extract(m, MARKDOWN_LINK, 1).alias("display"),
            F.regexp_extract(m, MARKDOWN_LINK, 2).alias("url"),
        ),
    )


def anchor(heading: Column) -> Column:
    """Heading text to anchor: lower case, blanks to dashes, other marks dropped."""
    dashed = F.replace(F.lower(heading), F.lit(" "), F.lit("-"))
    return F.regexp_replace(dashed, r"[^\p{L}\p{N}_\-]", "")


def headings(text: Column) -> Column:
    """array<struct<level, text, anchor>>."""

    def parse(m: Column) -> Column:
        title = strip(F.regexp_extract(m, HEADING, 2))
        return F.struct(
            F.length(F.regexp_extract(m, HEADING, 1)).alias("level"),
            title.alias("text"),
            anchor(title).alias("anchor"),
        )

    return F.transform(matches(text, HEADING), parse)


def first_title(text: Column) -> Column:
    """Text of the first level-one heading, null without one."""
    found = strip(F.regexp_extract(text, r"(?md)^# (.+)$", 1))
    return F.when(text.rlike(r"(?md)^# .+$"), found)


def title_or_stem(text: Column, stem: Column) -> Column:
    title = first_title(text)
    return F.when(F.coalesce(title, F.lit("")) == "", stem).otherwise(title)


def line_count(text: Column) -> Column:
    """Lines as a reader sees them: a trailing line feed does not open another line."""
    breaks = F.regexp_count(text, F.lit(r"\n"))
    open_tail = (F.length(text) > 0) & ~text.endswith("\n")
    return breaks + F.when(open_tail, 1).otherwise(0)


def snippet(text: Column, limit: int = 200) -> Column:
    text = F.coalesce(text, F.lit(""))
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def display_name(stem: Column) -> Column:
    """``user_guide`` to ``User Guide``; every run of letters starts with a capital."""
    runs = matches(F.replace(stem, F.lit("_"), F.lit(" ")), r"\p{L}+|[^\p{L}]+")
    return F.array_join(F.transform(runs, F.initcap), "")


def occurrences(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return F.regexp_count(text, F.lit(rf"\Q{literal}\E"))


def brackets_balanced(text: Column) -> Column:
    return occurrences(text, "[[") == occurrences(text, "]]")


def fences_even(text: Column) -> Column:
    return occurrences(text, "```") % 2 == 0


def opens_with_heading(text: Column) -> Column:
    """A level-one heading at the very first character."""
    return text.rlike(r"(?d)\A# .+")


def body_without_headings(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"(?md)^#+.*$", ""))


def has_frontmatter(text: Column) -> Column:
    return text.startswith("---")


def without_frontmatter(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n\s*", "")


def has_any(text: Column, literals: list[str]) -> Column:
    """True when any of the literals occurs."""
    found = F.lit(False)
    for literal in literals:
        found = found | text.contains(literal)
    return found
