"""Link, validation and status reports, each a one-row frame plus advice rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import rules
from folioscope.operators import links as L
from folioscope.operators import quality as Q
from folioscope.operators.joins import one_row


def link_metrics(notes: DataFrame, links: DataFrame) -> DataFrame:
    """Everything the link advice needs. Stage ``links`` first on large corpora: it is read
    by several independent branches."""
    files = notes.select("path")
    nodes = L.build_nodes(notes, links)
    dead = L.dead_links(links, files).agg(
        F.count_if(F.col("severity") == "high").alias("dead_high"),
        F.count_if(F.col("severity") != "high").alias("dead_other"),
    )
    clusters = L.link_clusters(links, notes).agg(F.countDistinct("component").alias("clusters"))
    hub = L.top_nodes(nodes, "inbound_links", 1).agg(
        F.first("name").alias("top_hub"), F.first("inbound_links").alias("top_hub_links")
    )
    lonely = L.orphans(nodes).agg(F.count(F.lit(1)).alias("orphans"))
    return one_row(L.link_statistics(nodes, links, files), dead, clusters, hub, lonely)


def link_report(notes: DataFrame, links: DataFrame) -> DataFrame:
    return rules.as_rows(link_metrics(notes, links), rules.link_advice())


def validation_metrics(
    modules: DataFrame, symbols: DataFrame, notes: DataFrame | None = None
) -> DataFrame:
    """Completeness, quality, link score and the overall score; without notes only the first."""
    parts = [Q.completeness(Q.coverage_counts(modules, symbols))]
    if notes is not None:
        checks = Q.note_checks(notes)
        totals = Q.check_totals(checks, rules.CHECKS)
        parts.append(Q.quality_score(totals))
        parts.append(
            totals.agg(
                *[
                    F.max(F.when(F.col("check") == k, F.col("total") - F.col("passed"))).alias(
                        f"{k}_issues"
                    )
                    for k in rules.CHECKS
                ]
            )
        )
        parts.append(
            L.link_validation(L.extract_links(notes), notes.select("path")).select(
                F.col("score").alias("links"), "broken_links"
            )
        )
        return Q.overall_score(one_row(*parts))
    empty = {k: F.lit(None).cast("bigint") for k in [*(f"{k}_issues" for k in rules.CHECKS), "broken_links"]}
    empty |= {"quality": F.lit(None).cast("double"), "links": F.lit(None).cast("double")}
    return Q.overall_score(parts[0].withColumns(empty))


def validation_report(modules: DataFrame, symbols: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    return rules.as_rows(validation_metrics(modules, symbols, notes), rules.validation_advice())


def status_metrics(
    modules: DataFrame, symbols: DataFrame, notes: DataFrame, sources: DataFrame, now: Column
) -> DataFrame:
    counts = Q.coverage(Q.coverage_counts(modules, symbols)).withColumn(
        "missing", F.col("total_items") - F.col("documented_items")
    )
    totals = Q.check_totals(Q.status_checks(notes), Q.STATUS_CHECKS)
    return one_row(counts, Q.quality_score(totals), Q.sync_status(sources, notes, now))


def status_report(
    modules: DataFrame, symbols: DataFrame, notes: DataFrame, sources: DataFrame, now: Column
) -> DataFrame:
    metrics = status_metrics(modules, symbols, notes, sources, now)
    return rules.as_rows(metrics, rules.status_advice())
