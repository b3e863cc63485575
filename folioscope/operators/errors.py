"""Classification of error logs by ordered rules, with suggestions.

``error_log(error_id_in, exc_type, message, operation)``. Rules are small tables that the caller
may extend; they are turned into one expression, so the log is classified in a single pass.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import rules as R


@dataclass(frozen=True)
class ErrorRule:
    """Matches when the pattern occurs in the message, ignoring case, or equals the type."""

    pattern: str
    error_id: str
    title: str
    severity: str
    category: str
    description: str


# Rules in the order in which they are tried. ``{}`` stands for the message,
# ``{module}`` for the module named in it.
ERROR_RULES = [
    ErrorRule("[Errno 2] No such file or directory", "file_not_found", "File or Directory Not Found", "error", "file_system",
              "The system cannot find the specified file or directory: {}"),
    ErrorRule("FileNotFoundError", "file_not_found", "File or Directory Not Found", "error", "file_system",
              "The system cannot find the specified file or directory: {}"),
    ErrorRule("[Errno 13] Permission denied", "permission_denied", "Permission Denied", "error", "file_system",
              "Access denied to file or directory: {}"),
    ErrorRule("PermissionError", "permission_denied", "Permission Denied", "error", "file_system",
              "Access denied to file or directory: {}"),
    ErrorRule("ModuleNotFoundError", "module_not_found", "Python Module Not Found", "error", "dependency",
              "Required Python module '{module}' is not installed or available"),
    ErrorRule("ImportError", "import_error", "Python Import Error", "error", "dependency",
              "Failed to import required module or component: {}"),
    ErrorRule("sphinx", "sphinx_build_error", "Sphinx Documentation Build Failed", "error", "sphinx_build",
              "Sphinx failed to build documentation: {}"),
    ErrorRule("configuration", "configuration_error", "Configuration Error", "error", "configuration",
              "Invalid or missing configuration: {}"),
    ErrorRule("MemoryError", "memory_error", "Insufficient Memory", "critical", "performance",
              "Operation failed due to insufficient available memory"),
    ErrorRule("TimeoutError", "timeout_error", "Operation Timed Out", "warning", "performance",
              "Operation exceeded maximum allowed time: {}"),
]

# Exception types that are operating-system errors or import errors.
OS_ERRORS = ["OSError", "IOError", "FileNotFoundError", "PermissionError", "FileExistsError", "IsADirectoryError",
             "NotADirectoryError", "BlockingIOError", "ChildProcessError", "ConnectionError", "BrokenPipeError",
             "ConnectionAbortedError", "ConnectionRefusedError", "ConnectionResetError", "InterruptedError",
             "ProcessLookupError", "TimeoutError"]
IMPORT_ERRORS = ["ImportError", "ModuleNotFoundError"]

# Fixed values: (category, error_id or null for all, priority, title, description, action, command).
SUGGESTIONS = [
    ("file_system", "file_not_found", 1, "Check File Path", "Verify the file path is correct and the file exists", "investigate", None),
    ("file_system", "file_not_found", 2, "Create Missing Directory", "Create the missing directory structure", "fix", "mkdir -p <directory_path>"),
    ("file_system", "file_not_found", 3, "Update Configuration", "Update project configuration to point to correct paths", "configure", None),
    ("file_system", "permission_denied", 1, "Check File Permissions", "Verify you have read/write permissions for the file or directory", "investigate", "ls -la <file_path>"),
    ("file_system", "permission_denied", 2, "Fix Permissions", "Update file permissions to allow access", "fix", "chmod 755 <directory_path>"),
    ("file_system", "permission_denied", 3, "Run as Administrator", "Run the operation with elevated privileges", "workaround", None),
    ("dependency", "module_not_found", 1, "Install Missing Package", "Install the required Python package: {module}", "fix", "uv add {module}"),
    ("dependency", "module_not_found", 2, "Check Virtual Environment", "Ensure you're using the correct Python virtual environment", "investigate", "uv sync"),
    ("dependency", "module_not_found", 3, "Update Dependencies", "Update all project dependencies to latest versions", "fix", "uv sync --upgrade"),
    ("dependency", "import_error", 1, "Install Missing Package", "Install the required Python package: unknown", "fix", "uv add unknown"),
    ("dependency", "import_error", 2, "Check Virtual Environment", "Ensure you're using the correct Python virtual environment", "investigate", "uv sync"),
    ("dependency", "import_error", 3, "Update Dependencies", "Update all project dependencies to latest versions", "fix", "uv sync --upgrade"),
    ("configuration", None, 1, "Validate Configuration", "Check configuration file syntax and required fields", "investigate", None),
    ("configuration", None, 2, "Create Default Configuration", "Generate a default configuration file", "fix", None),
    ("configuration", None, 3, "Check Documentation", "Review configuration documentation and examples", "investigate", None),
    ("sphinx_build", None, 1, "Check Sphinx Configuration", "Verify conf.py settings and required extensions", "investigate", None),
    ("sphinx_build", None, 2, "Install Sphinx Extensions", "Install any missing Sphinx extensions", "fix", "uv add sphinx sphinx-rtd-theme"),
    ("sphinx_build", None, 3, "Clean Build Directory", "Remove existing build files and rebuild", "fix", None),
    ("obsidian_conversion", None, 1, "Check Obsidian Vault Path", "Verify the Obsidian vault path is correct and accessible", "investigate", None),
    ("obsidian_conversion", None, 2, "Create Obsidian Folder", "Create the target folder in your Obsidian vault", "fix", None),
    ("obsidian_conversion", None, 3, "Check Markdown Syntax", "Verify generated markdown is valid", "investigate", None),
    ("performance", "memory_error", 1, "Enable Batch Processing", "Process files in smaller batches to reduce memory usage", "configure", None),
    ("performance", "memory_error", 2, "Close Unused Applications", "Free up system memory by closing unnecessary applications", "workaround", None),
    ("performance", "memory_error", 3, "Increase Virtual Memory", "Increase system swap/virtual memory settings", "configure", None),
    ("performance", "timeout_error", 1, "Increase Timeout Settings", "Configure longer timeout values for large projects", "configure", None),
    ("performance", "timeout_error", 2, "Enable Parallel Processing", "Use parallel processing to speed up operations", "configure", None),
    ("performance", "timeout_error", 3, "Reduce Project Scope", "Process smaller subsets of the project", "workaround", None),
]


def missing_module(message: Column) -> Column:
    return F.when(message.contains("'"), F.regexp_extract(message, "'([^']*)", 1)).otherwise("unknown")


def inferred_category(exc_type: Column, message: Column, operation: Column) -> Column:
    low = F.lower(message)
    done_in = F.coalesce(operation, F.lit(""))
    return (
        F.when(exc_type.isin(OS_ERRORS), "file_system")
        .when(exc_type.isin(IMPORT_ERRORS), "dependency")
        .when(low.contains("config"), "configuration")
        .when(low.contains("sphinx") | (done_in == "sphinx_build"), "sphinx_build")
        .when(low.contains("obsidian") | (done_in == "obsidian_conversion"), "obsidian_conversion")
        .otherwise("validation")
    )


def classify(error_log: DataFrame, rules: list[ErrorRule] = ERROR_RULES) -> DataFrame:
    """Add error_id, title, description, severity, category; the first matching rule wins.

    A missing type or message counts as empty text.
    """
    kind, message = F.coalesce("exc_type", F.lit("")), F.coalesce("message", F.lit(""))
    chosen = None
    for rule in rules:
        hit = F.lower(message).contains(rule.pattern.lower()) | (kind == rule.pattern)
        head, brace, tail = rule.description.partition("{module}")
        if not brace:
            head, brace, tail = rule.description.partition("{}")
        value = missing_module(message) if brace == "{module}" else message
        described = F.concat(F.lit(head), value, F.lit(tail)) if brace else F.lit(head)
        found = F.struct(
            F.lit(rule.error_id).alias("error_id"),
            F.lit(rule.title).alias("title"),
            described.alias("description"),
            F.lit(rule.severity).alias("severity"),
            F.lit(rule.category).alias("category"),
        )
        chosen = F.when(hit, found) if chosen is None else chosen.when(hit, found)
    generic = F.struct(
        F.concat(
            F.lit("generic_"), kind, F.lit("_"), F.lpad((F.crc32(message) % 10000).cast("string"), 4, "0")
        ).alias("error_id"),
        F.concat(kind, F.lit(": "), F.substring(message, 1, 100)).alias("title"),
        message.alias("description"),
        F.lit("error").alias("severity"),
        inferred_category(kind, message, F.col("operation")).alias("category"),
    )
    chosen = generic if chosen is None else chosen.otherwise(generic)
    return error_log.withColumn("_c", chosen).select(*error_log.columns, "_c.*")


def suggestion_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        SUGGESTIONS,
        "category string, rule_id string, priority int, suggestion string, detail string, action_type string, command string",
    )


def suggest(classified: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per error and suggestion. The rule table has a fixed, small number of rows."""
    table = suggestion_rules(classified.sparkSession) if rules is None else rules
    joined = classified.join(F.broadcast(table), "category").where(
        F.col("rule_id").isNull() | (F.col("rule_id") == F.col("error_id"))
    )
    module = missing_module(F.col("message"))
    fill = lambda c: F.replace(F.col(c), F.lit("{module}"), module)
    return joined.select(
        *classified.columns,
        "priority",
        "suggestion",
        fill("detail").alias("detail"),
        "action_type",
        fill("command").alias("command"),
    )


def by_severity(classified: DataFrame, severity: str) -> DataFrame:
    return classified.where(F.col("severity") == severity)


def by_category(classified: DataFrame, category: str) -> DataFrame:
    return classified.where(F.col("category") == category)


def error_report(classified: DataFrame) -> DataFrame:
    """Counts by category, by severity and over all, in one pass."""
    return classified.groupingSets([["category"], ["severity"], []], "category", "severity").agg(
        F.count(F.lit(1)).alias("errors"),
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("has_critical"),
        F.grouping_id().alias("_g"),
    ).select(
        F.when(F.col("_g") == 1, "category").when(F.col("_g") == 2, "severity").otherwise("total").alias("grouping"),
        F.coalesce("category", "severity", F.lit("all")).alias("value"),
        "errors",
        "has_critical",
    )


def error_summary(classified: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("severity") == s)
    return classified.agg(
        F.count(F.lit(1)).alias("total"),
        count("critical").alias("critical"),
        count("error").alias("errors"),
        count("warning").alias("warnings"),
        count("info").alias("info"),
        F.coalesce(F.bool_or(F.col("severity") == "critical"), F.lit(False)).alias("has_critical"),
    )
