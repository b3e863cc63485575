"""Threshold rules that turn a one-row metrics frame into advice, grades and bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ["modules", "classes", "functions"]
CHECKS = ["structure", "content", "formatting", "metadata"]


def fixed(value: Column, digits: int = 1) -> Column:
    """Fixed-point text, ties to even."""
    return F.replace(F.format_number(value, digits), F.lit(","), F.lit(""))


def percent(ratio: Column) -> Column:
    return F.concat(fixed(ratio * 100), F.lit("%"))


def say(*parts) -> Column:
    """Concatenate literals and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def messages(*rules: tuple[Column, Column]) -> Column:
    """The messages of all rules whose condition holds, in order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in rules]))


def as_rows(df: DataFrame, rules: Column) -> DataFrame:
    return df.select(F.posexplode(rules).alias("position", "message"))


def grade(score: Column) -> Column:
    return (
        F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D")
    ).otherwise("F")


def health(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent")
        .when(score >= 80, "good")
        .when(score >= 70, "fair")
        .when(score >= 60, "poor")
        .otherwise("critical")
    )


# The message texts and thresholds below are part of the expected results.


def link_advice() -> Column:
    """Needs dead_high, dead_other, orphans, isolated_files, average_links_per_file, clusters,
    valid_links, broken_links, top_hub, top_hub_links."""
    c = F.col
    links = c("valid_links") + c("broken_links")
    ratio = c("valid_links") / links
    return messages(
        (c("dead_high") > 0, say("Fix ", c("dead_high"), " high-priority broken wikilinks")),
        (c("dead_other") > 0, say("Review and fix ", c("dead_other"), " additional broken links")),
        (
            c("orphans") > 0,
            say("Connect ", c("orphans"), " orphaned files to improve discoverability"),
        ),
        (
            c("isolated_files") > 0,
            say(
                "Link ",
                c("isolated_files"),
                " isolated files to improve documentation navigation",
            ),
        ),
        (
            c("average_links_per_file") < 2,
            say("Consider adding more cross-references to improve documentation connectivity"),
        ),
        (
            c("average_links_per_file") > 10,
            say("High link density detected - consider organizing into topic clusters"),
        ),
        (
            c("clusters") > 3,
            say(
                "Documentation has ",
                c("clusters"),
                " distinct clusters - consider creating topic index pages",
            ),
        ),
        (
            (links > 0) & (ratio < 0.9),
            say("Link validity is ", percent(ratio), " - focus on fixing broken references"),
        ),
        (
            c("top_hub_links") > 10,
            say("'", c("top_hub"), "' is a major hub - ensure it has comprehensive content"),
        ),
    )


def validation_advice() -> Column:
    """Needs completeness, <type>_total/_documented/_coverage, quality, <check>_issues,
    links, broken_links and overall; a part that was not run is null and is skipped."""
    c = F.col
    per_type = [
        (
            c("completeness").isNotNull() & (c(f"{t}_coverage") < 50),
            say(
                f"Low {t} documentation coverage (",
                fixed(c(f"{t}_coverage")),
                "%) - add docstrings to ",
                c(f"{t}_total") - c(f"{t}_documented"),
                f" {t}",
            ),
        )
        for t in TYPES
    ]
    per_check = [
        (
            c("quality").isNotNull() & (c(f"{k}_issues") > 0),
            say("Fix ", c(f"{k}_issues"), f" {k} issues in documentation files"),
        )
        for k in CHECKS
    ]
    return messages(
        (
            c("completeness") < 70,
            say(
                "Documentation completeness is ",
                fixed(c("completeness")),
                "% - consider adding docstrings to improve coverage",
            ),
        ),
        *per_type,
        (
            c("quality") < 80,
            say(
                "Documentation quality score is ",
                fixed(c("quality")),
                "% - review formatting and content structure",
            ),
        ),
        *per_check,
        (
            c("links") < 90,
            say(
                "Link validation score is ",
                fixed(c("links")),
                "% - fix ",
                c("broken_links"),
                " broken links",
            ),
        ),
        (c("broken_links") > 0, say("Update ", c("broken_links"), " broken cross-references")),
        (
            c("overall") < 6,
            say(
                "Overall documentation quality is below average - "
                "focus on completeness and consistency improvements"
            ),
        ),
        (
            (c("overall") >= 6) & (c("overall") < 8),
            say(
                "Good documentation foundation - "
                "focus on quality refinements and link maintenance"
            ),
        ),
        (
            c("overall") >= 9,
            say("Excellent documentation quality - consider automating maintenance workflows"),
        ),
    )


def status_advice() -> Column:
    """Needs coverage, <type>_total/_documented/_coverage, quality, sync_status, missing."""
    c = F.col
    per_type = [
        (
            c(f"{t}_coverage") < 30,
            say(
                f"Very low {t} documentation coverage (",
                fixed(c(f"{t}_coverage")),
                "%) - add docstrings to ",
                c(f"{t}_total") - c(f"{t}_documented"),
                f" {t}",
            ),
        )
        for t in TYPES
    ]
    return messages(
        (
            c("coverage") < 50,
            say(
                "Documentation coverage is low (",
                fixed(c("coverage")),
                "%) - prioritize adding docstrings to modules and classes",
            ),
        ),
        (
            (c("coverage") >= 50) & (c("coverage") < 80),
            say(
                "Good progress on documentation coverage (",
                fixed(c("coverage")),
                "%) - focus on documenting remaining functions",
            ),
        ),
        *per_type,
        (
            (c("quality") > 0) & (c("quality") < 70),
            say(
                "Documentation quality could be improved (score: ",
                fixed(c("quality")),
                "/100) - review formatting and content structure",
            ),
        ),
        (
            c("sync_status") == "docs_behind",
            say("Source code has recent changes - consider regenerating documentation"),
        ),
        (
            c("sync_status") == "docs_ahead",
            say("Documentation has been updated recently - ensure it reflects current code"),
        ),
        (
            c("missing") > 0,
            say(
                "Add docstrings to ",
                c("missing"),
                " undocumented items for complete coverage",
            ),
        ),
    )


def priority_actions() -> Column:
    c = F.col
    return messages(
        (c("coverage") < 50, say("Improve documentation coverage")),
        ((c("quality") > 0) & (c("quality") < 70), say("Address quality issues")),
        (
            c("sync_status") == "docs_behind",
            say("Update documentation to match recent code changes"),
        ),
    )


def parallelism_advice() -> Column:
    """Needs total_modules, independent_modules, estimated_speedup_factor."""
    c = F.col
    return messages(
        (
            c("independent_modules") / c("total_modules") < 0.3,
            say(
                "High dependency coupling detected - "
                "consider refactoring to reduce inter-module dependencies"
            ),
        ),
        (
            c("estimated_speedup_factor") < 2,
            say("Limited parallel speedup expected - consider using incremental builds instead"),
        ),
        (
            c("total_modules") < 10,
            say("Small project - parallel processing overhead may exceed benefits"),
        ),
        (
            c("estimated_speedup_factor") > 5,
            say("Excellent parallelization potential - parallel processing highly recommended"),
        ),
    )


def setup_advice() -> Column:
    """Needs has_vault, project_size, has_tests, has_doctest, has_docs."""
    c = F.col
    return messages(
        (
            ~c("has_vault"),
            say("Consider setting obsidian.vault_path to integrate with your Obsidian vault"),
        ),
        (
            c("project_size") == "large",
            say("Large project detected - consider using exclude_patterns to focus documentation"),
        ),
        (
            c("has_tests") & ~c("has_doctest"),
            say("Tests detected - consider adding 'sphinx.ext.doctest' extension"),
        ),
        (
            ~c("has_docs"),
            say(
                "No existing documentation found - "
                "generated docs will be your primary documentation"
            ),
        ),
    )
