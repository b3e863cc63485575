"""Relational work over modules, symbols and imports of a code corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import paths, text
from folioscope.operators.graph import reduce_transitive, without_dependencies
from folioscope.operators.joins import lookup_join, one_row

# Top-level names that count as the standard library.
STDLIB = (
    "os sys json xml urllib http collections itertools functools operator re string io pathlib "
    "datetime time random math statistics logging threading multiprocessing subprocess socket "
    "asyncio unittest doctest argparse configparser csv sqlite3 pickle copy types typing "
    "dataclasses enum abc contextlib warnings traceback inspect ast dis keyword token tokenize "
    "struct codecs locale gettext"
).split()

# Folders that usually hold sources, in order of preference.
SOURCE_FOLDERS = ["src", "lib", "app"]


def is_stdlib(import_name: Column) -> Column:
    return F.substring_index(import_name, ".", 1).isin(STDLIB)


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Per distinct import name: class and owning module.

    The owner is the first module, in path order, whose name equals the import or is a dotted
    prefix of it. Prefixes are short, so the search is an equi-join on exploded prefixes of
    the distinct names.
    """
    names = imports.select("import_name").distinct()
    tried = names.select(
        "import_name", F.explode(paths.dotted_prefixes(F.col("import_name"))).alias("name")
    )
    # One row per name, so that a prefix which most imports share can be dealt to several tasks.
    known = modules.groupBy("name").agg(F.min(F.split("file_path", "/")).alias("path_order"))
    owners = (
        lookup_join(tried, known, "name", "inner")
        .groupBy("import_name")
        .agg(F.min_by("name", F.struct("path_order", "name")).alias("owner"))
    )
    return names.join(owners, "import_name", "left").select(
        "import_name",
        F.when(F.col("owner").isNotNull(), "internal")
        .when(is_stdlib(F.col("import_name")), "stdlib")
        .otherwise("external")
        .alias("import_class"),
        "owner",
    )


def classified_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Every import row with its class and owner."""
    return lookup_join(imports, resolve_imports(imports, modules), "import_name", "left")


def dependency_sets(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Distinct imports with their class: all of them, or those of a subset of modules when
    ``imports`` is filtered first."""
    return resolve_imports(imports, modules).select("import_name", "import_class")


def dependency_rows(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Internal imports per module in source order, raw names, duplicates kept.

    A module without internal imports has one row with a null import.
    """
    internal = classified_imports(imports, modules).where(F.col("import_class") == "internal")
    rows = internal.select("module", "ord", "import_name")
    idle = (
        modules.select(F.col("name").alias("module"))
        .join(rows.select("module").distinct(), "module", "left_anti")
        .select(
            "module", F.lit(None).cast("int").alias("ord"), F.lit(None).cast("string").alias("import_name")
        )
    )
    return rows.unionByName(idle)


def module_edges(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Module to owning module, self references dropped, distinct."""
    return (
        classified_imports(imports, modules)
        .where(F.col("owner").isNotNull() & (F.col("owner") != F.col("module")))
        .select(F.col("module").alias("source"), F.col("owner").alias("target"))
        .distinct()
    )


def dependency_graph(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """Module graph with implied edges removed."""
    return reduce_transitive(module_edges(imports, modules))


def file_dependencies(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(path, dep): the file of a module and the files of the modules it imports."""
    files = modules.select("name", "file_path")
    edges = module_edges(imports, modules)
    left = lookup_join(
        edges, files.select(F.col("name").alias("source"), F.col("file_path").alias("path")), "source", "inner"
    )
    return lookup_join(
        left, files.select(F.col("name").alias("target"), F.col("file_path").alias("dep")), "target", "inner"
    ).select("path", "dep")


def packages(modules: DataFrame) -> DataFrame:
    """Every package, ancestors included, with the modules listed under it (null when none)."""
    inside = modules.where(F.col("package_path") != "")
    every = inside.select(
        F.explode(paths.dotted_prefixes(F.col("package_path"))).alias("package")
    ).distinct()
    listed = inside.select(F.col("package_path").alias("package"), F.col("name").alias("module"))
    empty = every.join(listed.select("package").distinct(), "package", "left_anti").withColumn(
        "module", F.lit(None).cast("string")
    )
    return listed.unionByName(empty)


def submodules(modules: DataFrame) -> DataFrame:
    """Package to submodule; packages are those that have a package file."""
    own = (
        modules.where("is_package")
        .select(
            F.when(F.col("package_path") != "", F.col("package_path"))
            .otherwise(F.col("name"))
            .alias("package")
        )
        .distinct()
    )
    plain = modules.where(~F.col("is_package")).select(
        F.col("package_path").alias("package"), F.col("name").alias("module")
    )
    return plain.join(own, "package", "left_semi")


def top_packages(modules: DataFrame) -> DataFrame:
    return (
        modules.where(F.col("package_path") != "")
        .select(F.substring_index("package_path", ".", 1).alias("package"))
        .distinct()
    )


def public_top_level(modules: DataFrame) -> DataFrame:
    """Public modules outside any package."""
    return modules.where((F.col("package_path") == "") & ~paths.is_private(F.col("name")))


def contents_listing(modules: DataFrame) -> DataFrame:
    """Entries of the table of contents: stand-alone modules in path order, then packages."""
    alone = public_top_level(modules).select(
        F.lit(0).alias("section"), F.col("file_path").alias("sort_key"), F.col("name").alias("entry")
    )
    grouped = top_packages(modules).select(
        F.lit(1).alias("section"), F.col("package").alias("sort_key"), F.col("package").alias("entry")
    )
    return alone.unionByName(grouped)


def _titled(title: Column, underline: str) -> Column:
    return F.concat(title, F.lit("\n"), F.repeat(F.lit(underline), F.length(title)), F.lit("\n"))


def _directive(name: Column) -> Column:
    return F.concat(
        F.lit("\n.. automodule:: "),
        name,
        F.lit("\n   :members:\n   :undoc-members:\n   :show-inheritance:\n"),
    )


def module_pages(modules: DataFrame) -> DataFrame:
    """Page text of every public plain module."""
    plain = modules.where(~F.col("is_package") & ~paths.is_private(F.col("name")))
    title = F.concat("name", F.lit(" module"))
    return plain.select(
        "name", F.concat(_titled(title, "="), _directive(F.col("name"))).alias("page")
    )


def package_page_blocks(modules: DataFrame) -> DataFrame:
    """Package pages as ordered blocks: a head, then one block per submodule by name.

    A package may hold any number of modules, so its page is rows and not one string.
    """
    heads = (
        modules.where("is_package")
        .select(
            F.when(F.col("package_path") != "", F.col("package_path"))
            .otherwise(F.col("name"))
            .alias("package")
        )
        .where(~paths.is_private(F.col("package")))
        .distinct()
    )
    head_text = F.concat(
        _titled(F.concat("package", F.lit(" package")), "="),
        _directive(F.col("package")),
        F.lit("\nSubmodules\n----------\n\n"),
    )
    body_text = F.concat(
        F.lit("\n"),
        _titled(F.concat("module", F.lit(" module")), "-"),
        _directive(F.col("module")),
    )
    head = heads.select("package", F.lit("").alias("module"), head_text.alias("block"))
    body = submodules(modules).where(~paths.is_private(F.col("package"))).select(
        "package", "module", body_text.alias("block")
    )
    return head.unionByName(body)


def public_symbols(symbols: DataFrame) -> DataFrame:
    """Private symbols and everything inside private ones dropped."""
    inside_private = F.coalesce(paths.is_private(F.col("parent")), F.lit(False))
    return symbols.where(~F.col("is_private") & ~inside_private)


def search(
    modules: DataFrame,
    symbols: DataFrame,
    query: str,
    kind: str = "all",
    case_sensitive: bool = False,
) -> DataFrame:
    """Modules, classes and functions whose name or docstring holds the query."""
    wanted = {"all": ["module", "class", "function"], "modules": ["module"],
              "classes": ["class"], "functions": ["function"]}
    if kind not in wanted:
        raise ValueError(f"unknown search type {kind}")
    fold = (lambda c: c) if case_sensitive else F.lower
    needle = query if case_sensitive else query.lower()
    rows = modules.select(
        F.lit("module").alias("kind"), "name", F.col("name").alias("module"),
        F.lit(None).cast("int").alias("line_number"), "docstring",
    ).unionByName(
        symbols.where(F.col("kind").isin("class", "function")).select(
            "kind", "name", "module", "line_number", "docstring"
        )
    )
    in_name = fold(F.col("name")).contains(needle)
    in_text = fold(F.coalesce("docstring", F.lit(""))).contains(needle)
    return (
        rows.where(F.col("kind").isin(wanted[kind]))
        .where(in_name | in_text)
        .select(
            "kind", "name", "module", "line_number",
            text.snippet(F.col("docstring")).alias("docstring"),
            F.when(in_name, "name").otherwise("docstring").alias("match_type"),
        )
    )


def search_totals(found: DataFrame) -> DataFrame:
    return found.rollup("kind").agg(F.count(F.lit(1)).alias("matches")).select(
        F.coalesce("kind", F.lit("total")).alias("kind"), "matches"
    )


def symbol_counts(symbols: DataFrame) -> DataFrame:
    count = lambda k: F.count_if(F.col("kind") == k)
    return symbols.groupBy(F.col("module").alias("name")).agg(
        count("function").alias("functions"),
        count("class").alias("classes"),
        count("method").alias("methods"),
        count("property").alias("properties"),
    )


def module_summary(modules: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Counts per module, zeros included."""
    imported = imports.groupBy(F.col("module").alias("name")).agg(
        F.count(F.lit(1)).alias("imports")
    )
    counts = ["functions", "classes", "methods", "properties", "imports"]
    joined = (
        modules.select("name", "file_path", "is_package")
        .join(symbol_counts(symbols), "name", "left")
        .join(imported, "name", "left")
    )
    return joined.select(
        "name", "file_path", "is_package", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts]
    )


def complexity(summary: DataFrame) -> DataFrame:
    score = (
        F.lit(1.0)
        + F.col("functions") * 0.1
        + F.col("classes") * 0.2
        + F.col("methods") * 0.05
        + F.col("properties") * 0.03
        + F.col("imports") * 0.02
    )
    return summary.select(
        "name",
        score.alias("complexity"),
        F.greatest(F.lit(0), F.lit(100) - F.floor(score * 10)).cast("int").alias("priority"),
    )


def project_counts(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    return one_row(
        modules.agg(F.count(F.lit(1)).alias("modules")),
        symbols.agg(
            F.count_if(F.col("kind") == "class").alias("classes"),
            F.count_if(F.col("kind") == "function").alias("functions"),
        ),
    )


def project_rows(modules: DataFrame, symbols: DataFrame) -> DataFrame:
    """The whole structure as rows: one JSON document per module and per symbol."""
    heads = modules.select(
        F.col("name").alias("module"),
        F.lit("module").alias("kind"),
        F.to_json(F.struct("name", "file_path", "docstring", "package_path")).alias("item"),
    )
    parts = symbols.select(
        "module",
        "kind",
        F.to_json(F.struct("name", "parent", "line_number", "docstring", "is_private")).alias("item"),
    )
    return heads.unionByName(parts)


def file_info(modules: DataFrame, symbols: DataFrame, path: str) -> DataFrame:
    """Everything about one file: the module row repeated on its symbols."""
    one = modules.where(F.col("file_path") == path)
    return one.select(
        F.col("name").alias("module"), "file_path", "size", "mtime", "line_count"
    ).join(symbols, "module", "left")


def parallelism(
    modules: DataFrame, edges: DataFrame, scores: DataFrame, workers: int
) -> DataFrame:
    """Estimate of how well module work runs in parallel."""
    independent = without_dependencies(modules.select("name"), edges)
    counts = one_row(
        modules.agg(F.count(F.lit(1)).alias("total_modules")),
        independent.agg(F.count(F.lit(1)).alias("independent_modules")),
        scores.agg(F.sum("complexity").alias("work")),
    )
    sequential = F.col("work") * 2
    parallel = F.col("work") / workers * 2
    ratio = F.col("independent_modules") / F.col("total_modules")
    return counts.select(
        "total_modules",
        "independent_modules",
        (F.col("total_modules") - F.col("independent_modules")).alias("modules_with_dependencies"),
        F.when(
            F.col("total_modules") > 0,
            (F.col("total_modules") - F.col("independent_modules")) / F.col("total_modules"),
        )
        .otherwise(0.0)
        .alias("dependency_ratio"),
        sequential.alias("estimated_sequential_time_seconds"),
        parallel.alias("estimated_parallel_time_seconds"),
        F.when(parallel > 0, sequential / parallel).otherwise(1.0).alias("estimated_speedup_factor"),
        F.when(ratio > 0.7, "high").when(ratio > 0.4, "moderate").otherwise("low").alias(
            "parallelism_potential"
        ),
    )


def source_folders(files: DataFrame, project: str) -> DataFrame:
    """Usual source folders that hold Python files, in order of preference; else the root."""
    python = files.where(F.col("path").endswith(".py"))
    wanted = [*SOURCE_FOLDERS, project]
    order = F.array(*[F.lit(w) for w in wanted])
    nested = F.col("path").contains("/")
    top = F.when(nested, F.substring_index("path", "/", 1)).otherwise(".")
    grouped = (
        python.withColumn("folder", top)
        .where(F.col("folder").isin([*wanted, "."]))
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("python_files"),
            F.bool_or(
                F.col("path")
                == F.when(F.col("folder") == ".", "__init__.py").otherwise(
                    F.concat("folder", F.lit("/__init__.py"))
                )
            ).alias("has_init"),
        )
        .withColumn(
            "rank",
            F.when(F.col("folder") == ".", 100).otherwise(F.array_position(order, F.col("folder"))).cast("int"),
        )
    )
    # At most five rows from here on; the root counts only when no usual folder was found.
    best = grouped.agg(F.min("rank")).scalar()
    return grouped.where((F.col("folder") != ".") | (best == 100))


def repository_profile(files: DataFrame, project: str) -> DataFrame:
    """Size bucket, presence of tests and docs, package shape."""
    name = paths.basename(F.col("path"))
    py = F.col("path").endswith(".py")
    folders = F.concat(F.lit("/"), paths.parent(F.col("path")), F.lit("/"))
    counts = files.agg(
        F.count_if(py).alias("python_files"),
        F.coalesce(
            F.bool_or(
                name.rlike(r"^test_.*\.py\z") | name.rlike(r"_test\.py\z") | folders.contains("/tests/")
            ),
            F.lit(False),
        ).alias("has_tests"),
        F.coalesce(
            F.bool_or(
                F.col("path").rlike(r"^(docs|doc)/")
                | (F.col("path") == "README.md")
                | F.col("path").rlike(r"^[^/]*\.rst\z")
            ),
            F.lit(False),
        ).alias("has_docs"),
    )
    candidates = source_folders(files, project)
    shape = candidates.agg(
        F.count(F.lit(1)).alias("candidates"),
        F.coalesce(F.min_by("has_init", "rank"), F.lit(False)).alias("first_has_init"),
    )
    size = F.col("python_files")
    return one_row(counts, shape).select(
        "python_files",
        "has_tests",
        "has_docs",
        F.when(size > 100, "large").when(size > 20, "medium").otherwise("small").alias("project_size"),
        F.when(F.col("candidates") > 1, "multi")
        .when(F.col("first_has_init"), "package")
        .otherwise("single")
        .alias("package_structure"),
    )


def corpus_size(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    )
