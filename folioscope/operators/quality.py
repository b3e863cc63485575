"""Coverage of code by docstrings, quality checks of notes, scores and status.

Inputs: modules(name, file_path, docstring, ...), symbols(module, kind, name, docstring,
line_number, is_private, ...), notes(path, content, mtime). All groups are a handful of
fixed labels, so every aggregate is combined on the map side into a few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import rules, text
from folioscope.operators.joins import lookup_join, one_row


def has_docstring(docstring: Column) -> Column:
    return F.coalesce(text.strip(docstring) != "", F.lit(False))


def documentable_items(
    modules: DataFrame, symbols: DataFrame, include_private: bool = False
) -> DataFrame:
    """Modules, classes and functions; methods and properties are never counted.

    Private classes are counted, private functions only with ``include_private``.
    """
    whole = modules.select(
        F.lit("module").alias("type"),
        "name",
        F.col("file_path").alias("file"),
        F.lit(1).alias("line"),
        has_docstring(F.col("docstring")).alias("documented"),
        F.lit("medium").alias("severity"),
    )
    counted = symbols.where(F.col("kind").isin("class", "function"))
    if not include_private:
        counted = counted.where((F.col("kind") == "class") | ~F.col("is_private"))
    files = modules.select(F.col("name").alias("module"), F.col("file_path").alias("file"))
    narrow = counted.select("module", "kind", "name", "line_number", "is_private", "docstring")
    narrow = narrow.withColumn("documented", has_docstring(F.col("docstring"))).drop("docstring")
    parts = lookup_join(narrow, files, "module", "inner").select(
        F.col("kind").alias("type"),
        F.concat_ws(".", "module", "name").alias("name"),
        "file",
        F.col("line_number").alias("line"),
        "documented",
        F.when(F.col("kind") == "class", "high")
        .when(F.col("is_private"), "low")
        .otherwise("medium")
        .alias("severity"),
    )
    return whole.unionByName(parts)


def missing_documentation(items: DataFrame) -> DataFrame:
    return items.where(~F.col("documented")).drop("documented")


def coverage_counts(
    modules: DataFrame, symbols: DataFrame, include_private: bool = False
) -> DataFrame:
    """One row with totals, documented counts and coverage per type and over all.

    Counting needs no file names, so modules and symbols are not joined.
    """
    functions = F.col("kind") == "function"
    if not include_private:
        functions = functions & ~F.col("is_private")
    classes = F.col("kind") == "class"
    done = has_docstring(F.col("docstring"))
    counts = one_row(
        modules.agg(
            F.count(F.lit(1)).alias("modules_total"), F.count_if(done).alias("modules_documented")
        ),
        symbols.agg(
            F.count_if(classes).alias("classes_total"),
            F.count_if(classes & done).alias("classes_documented"),
            F.count_if(functions).alias("functions_total"),
            F.count_if(functions & done).alias("functions_documented"),
        ),
    )
    for t in rules.TYPES:
        total, documented = F.col(f"{t}_total"), F.col(f"{t}_documented")
        counts = counts.withColumn(
            f"{t}_coverage", F.when(total > 0, documented / total * 100).otherwise(0.0)
        )
    total = F.col("modules_total") + F.col("classes_total") + F.col("functions_total")
    documented = (
        F.col("modules_documented") + F.col("classes_documented") + F.col("functions_documented")
    )
    return counts.withColumns({"total_items": total, "documented_items": documented})


def _overall(counts: DataFrame, empty: float, name: str) -> DataFrame:
    share = F.col("documented_items") / F.col("total_items") * 100
    return counts.withColumn(
        name, F.when(F.col("total_items") > 0, share).otherwise(F.lit(empty))
    )


def completeness(counts: DataFrame) -> DataFrame:
    """Validation rule: nothing to document scores 100."""
    return _overall(counts, 100.0, "completeness")


def coverage(counts: DataFrame) -> DataFrame:
    """Status rule: nothing to document scores 0."""
    return _overall(counts, 0.0, "coverage")


def coverage_by_type(counts: DataFrame) -> DataFrame:
    """One row per type plus ``overall``, from ``coverage`` or ``completeness`` output."""
    score = "completeness" if "completeness" in counts.columns else "coverage"
    rows = [
        F.struct(
            F.lit(t).alias("type"),
            F.col(f"{t}_total").alias("total"),
            F.col(f"{t}_documented").alias("documented"),
            F.col(f"{t}_coverage").alias("coverage"),
        )
        for t in rules.TYPES
    ]
    rows.append(
        F.struct(
            F.lit("overall").alias("type"),
            F.col("total_items").alias("total"),
            F.col("documented_items").alias("documented"),
            F.col(score).alias("coverage"),
        )
    )
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def note_checks(notes: DataFrame) -> DataFrame:
    """The four validation checks per note, and the heading check behind the frontmatter."""
    c = F.col("content")
    return notes.select(
        "path",
        text.opens_with_heading(c).alias("structure"),
        (F.length(text.body_without_headings(c)) > 50).alias("content"),
        (text.brackets_balanced(c) & text.fences_even(c)).alias("formatting"),
        text.has_frontmatter(c).alias("metadata"),
        text.opens_with_heading(text.without_frontmatter(c)).alias("structure_after_frontmatter"),
        F.array_join(
            F.array_compact(
                F.array(
                    F.when(~text.brackets_balanced(c), "unmatched wikilink brackets"),
                    F.when(~text.fences_even(c), "unmatched code blocks"),
                )
            ),
            ", ",
        ).alias("formatting_problem"),
    )


def check_totals(checks: DataFrame, names: list[str]) -> DataFrame:
    """Passed and total per check."""
    one = checks.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(n)).alias(n) for n in names]
    )
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("passed")) for n in names])
    return (
        one.select("total", F.explode(rows).alias("r"))
        .select("r.check", "r.passed", "total")
        .withColumn(
            "score", F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100).otherwise(0.0)
        )
    )


def quality_score(totals: DataFrame) -> DataFrame:
    return totals.agg(F.sum("passed").alias("passed"), F.sum("total").alias("total")).select(
        F.when(F.col("total") > 0, F.col("passed") / F.col("total") * 100)
        .otherwise(0.0)
        .alias("quality")
    )


def note_issues(checks: DataFrame) -> DataFrame:
    """One row per failed check."""

    def issue(kind: str, severity: str, message: Column) -> Column:
        return F.when(
            ~F.col(kind),
            F.struct(
                F.lit(kind).alias("type"),
                F.lit(severity).alias("severity"),
                message.alias("message"),
                F.lit(kind).alias("category"),
            ),
        )

    p = F.col("path")
    found = F.array_compact(
        F.array(
            issue("structure", "medium", rules.say("Missing main heading in ", p)),
            issue("content", "medium", rules.say("Insufficient content in ", p)),
            issue(
                "formatting",
                "low",
                rules.say("Formatting issues in ", p, ": ", F.col("formatting_problem")),
            ),
            issue("metadata", "low", rules.say("Missing YAML frontmatter in ", p)),
        )
    )
    return checks.select(F.col("path").alias("file"), F.explode(found).alias("i")).select(
        "i.type", "i.severity", "i.message", "file", "i.category"
    )


def issues_per_type(issues: DataFrame) -> DataFrame:
    return issues.groupBy("type").agg(F.count(F.lit(1)).alias("issues"))


def status_checks(notes: DataFrame) -> DataFrame:
    """The four status checks; the link check always passes."""
    c = F.col("content")
    return notes.select(
        "path",
        text.strip(c).startswith("# ").alias("structure"),
        (text.word_count(c) > 20).alias("content"),
        text.brackets_balanced(c).alias("formatting"),
        F.lit(True).alias("links"),
        text.word_count(c).alias("words"),
    )


STATUS_CHECKS = ["structure", "content", "formatting", "links"]


def status_issues(checks: DataFrame) -> DataFrame:
    def issue(kind: str, severity: str, message: Column) -> Column:
        return F.when(
            ~F.col(kind),
            F.struct(
                F.lit(kind).alias("type"), F.lit(severity).alias("severity"), message.alias("issue")
            ),
        )

    found = F.array_compact(
        F.array(
            issue("structure", "medium", F.lit("Missing main heading")),
            issue("content", "low", rules.say("Minimal content (", F.col("words"), " words)")),
            issue("formatting", "low", F.lit("unmatched wikilink brackets")),
        )
    )
    return checks.select(F.col("path").alias("file"), F.explode(found).alias("i")).select(
        "file", "i.type", "i.severity", "i.issue"
    )


def issues_by_severity(issues: DataFrame) -> DataFrame:
    """high, medium and low, zeros included."""
    levels = ["high", "medium", "low"]
    one = issues.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in levels])
    rows = F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("issues")) for s in levels])
    return one.select(F.explode(rows).alias("r")).select("r.*")


# Weights of the overall score.
WEIGHTS = {"completeness": 0.4, "quality": 0.35, "links": 0.25}


def overall_score(scores: DataFrame) -> DataFrame:
    """Weighted mean on a 0 to 10 scale over the parts that are present (not null)."""
    weighted, weight = F.lit(0.0), F.lit(0.0)
    for part, w in WEIGHTS.items():
        present = F.col(part).isNotNull()
        weighted = weighted + F.when(present, F.col(part) / 10 * w).otherwise(0.0)
        weight = weight + F.when(present, F.lit(w)).otherwise(0.0)
    return scores.withColumn("overall", F.when(weight > 0, weighted / weight).otherwise(0.0))


def update_history(notes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Notes changed in the last ``days`` days, newest first."""
    return (
        notes.where(F.col("mtime") > now - F.make_dt_interval(F.lit(days)))
        .select("path", "mtime", "size")
        .orderBy(F.desc("mtime"), "path")
    )


def update_statistics(notes: DataFrame, now: Column, days: int = 30) -> DataFrame:
    recent = notes.where(F.col("mtime") > now - F.make_dt_interval(F.lit(days)))
    per_file = recent.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    total = F.coalesce(F.sum("n"), F.lit(0))
    return per_file.agg(
        total.alias("total_updates"),
        F.count(F.lit(1)).alias("files_modified"),
        (total / days if days > 0 else F.lit(0.0)).alias("average_updates_per_day"),
    )


def sync_status(
    sources: DataFrame, notes: DataFrame, now: Column, days: int = 7, exclude: list[str] = ()
) -> DataFrame:
    """Recent source changes against recent note changes."""
    since = now - F.make_dt_interval(F.lit(days))
    kept = sources.where(F.col("path").endswith(".py"))
    for pattern in exclude:
        kept = kept.where(~F.col("path").contains(pattern))
    counts = one_row(
        kept.agg(F.count_if(F.col("mtime") > since).alias("source_changes")),
        notes.agg(F.count_if(F.col("mtime") > since).alias("note_changes")),
    )
    s, n = F.col("source_changes"), F.col("note_changes")
    return counts.withColumn(
        "sync_status",
        F.when((s == 0) & (n == 0), "up_to_date")
        .when(s > n, "docs_behind")
        .when(n > s, "docs_ahead")
        .otherwise("synchronized"),
    )


def health_summary(status: DataFrame) -> DataFrame:
    """Needs what ``rules.status_advice`` needs; lists come out as joined text."""
    c, q = F.col("coverage"), F.coalesce("quality", F.lit(0.0))
    overall = F.when(q > 0, c * 0.6 + q * 0.4).otherwise(c)
    return status.select(
        overall.alias("overall_score"),
        rules.health(overall).alias("overall_health"),
        rules.grade(overall).alias("coverage_grade"),
        rules.grade(q).alias("quality_grade"),
        F.array_join(rules.priority_actions(), "; ").alias("priority_actions"),
        F.array_join(F.slice(rules.status_advice(), 1, 3), "; ").alias("next_steps"),
    )
