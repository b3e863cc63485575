"""Relative paths, file names, dotted module names and glob patterns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that file names may not hold, the stand-in name, the length cap.
INVALID_FILENAME_CHARS = '<>:"/\\|?*'
UNNAMED_FILE = "unnamed_file"
MAX_FILENAME = 250


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def suffix(path: Column) -> Column:
    """``.md`` for ``a/b.md``; empty without one or for a dot file."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)\z", 1)


def stem(path: Column) -> Column:
    name = basename(path)
    return F.regexp_replace(name, r"^(.+)\.[^.]+\z", "$1")


def parent(path: Column) -> Column:
    """Parent folder, empty at the root."""
    return F.regexp_extract(path, r"^(.*)/[^/]*\z", 1)


def without_suffix(path: Column, ending: str) -> Column:
    return F.when(
        path.endswith(ending), F.substring(path, F.lit(1), F.length(path) - len(ending))
    ).otherwise(path)


def normalise(path: Column) -> Column:
    """Drop ``.`` and empty segments and fold ``..``. Paths that leave the root turn null."""

    def fold(acc: Column, part: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, F.lit(1), F.size(acc) - 1))
        return F.when(part.isin("", "."), acc).when(part == "..", up).otherwise(
            F.concat(acc, F.array(part))
        )

    folded = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), fold)
    # Most paths are clean already, so the fold runs for the few that are not.
    odd = path.rlike(r"(^|/)\.{0,2}(/|\z)")
    return F.when(path.startswith("/"), F.lit(None)).when(
        odd, F.array_join(folded, "/")
    ).otherwise(path)


def ancestors(path: Column, separator: str = "/") -> Column:
    """Every proper ancestor, nearest last: ``a/b/c`` gives ``[a, a/b]``."""
    parts = F.split(path, rf"\Q{separator}\E")
    count = F.size(parts)
    return F.when(
        count > 1,
        F.transform(
            F.sequence(F.lit(1), count - 1),
            lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator),
        ),
    ).otherwise(F.array().cast("array<string>"))


def dotted_prefixes(name: Column) -> Column:
    """``a.b.c`` gives ``[a, a.b, a.b.c]``."""
    return F.concat(ancestors(name, "."), F.array(name))


def html_to_note(path: Column) -> Column:
    return F.when(path.endswith(".html"), F.concat(without_suffix(path, ".html"), F.lit(".md"))).otherwise(path)


def is_package(path: Column) -> Column:
    return basename(path) == "__init__.py"


def package_path(path: Column) -> Column:
    return F.replace(parent(path), F.lit("/"), F.lit("."))


def module_name(path: Column, project: str) -> Column:
    """Dotted module name; a package file is named after its folder, the root one after the project."""
    package = package_path(path)
    plain = F.when(package == "", stem(path)).otherwise(F.concat_ws(".", package, stem(path)))
    own = F.when(package == "", F.lit(project)).otherwise(package)
    return F.when(is_package(path), own).otherwise(plain)


def is_private(name: Column) -> Column:
    return name.startswith("_")


def is_constant(name: Column) -> Column:
    return (name == F.upper(name)) & (name != F.lower(name))


def sanitise_filename(name: Column) -> Column:
    # Trimmed and cut first: an invalid character is one character before and after.
    trimmed = F.btrim(name, F.lit(". \t\n\r"))
    named = F.when(trimmed == "", F.lit(UNNAMED_FILE)).otherwise(trimmed)
    # Leading dots are gone, so the last dot always starts an extension.
    extension = F.when(F.contains(named, F.lit(".")), F.concat(F.lit("."), F.substring_index(named, ".", -1))).otherwise("")
    head = F.substring(
        F.substring(named, F.lit(1), F.length(named) - F.length(extension)),
        F.lit(1),
        F.lit(MAX_FILENAME) - F.length(extension),
    )
    cut = F.when(F.length(named) > MAX_FILENAME, F.concat(head, extension)).otherwise(named)
    return F.translate(cut, INVALID_FILENAME_CHARS, "_" * len(INVALID_FILENAME_CHARS))


def backup_name(path: Column, at: Column) -> Column:
    """File name of a backup taken at a time."""
    return F.concat(path, F.lit(".backup."), F.date_format(at, "yyyyMMdd_HHmmss"))


def glob_regex(pattern: str) -> str:
    """Shell glob as an anchored Java pattern; ``*`` also crosses ``/``."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        close = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif close > 0:
            body = pattern[i + 1 : close].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = close
        else:
            out.append("\\Q" + c + "\\E" if not c.isalnum() else c)
        i += 1
    return "(?s)\\A" + "".join(out) + "\\z"


def path_match_regex(pattern: str) -> str:
    """Right-anchored match by whole segments, ``*`` staying inside one."""
    segments = [
        glob_regex(s)[6:-2].replace(".*", "[^/]*") for s in pattern.strip("/").split("/") if s != "."
    ]
    head = "\\A/" if pattern.startswith("/") else "(?:\\A|/)"
    return head + "/".join(segments) + "\\z"


def _any_like(values: Column, regex: str) -> Column:
    return F.exists(values, lambda v: v.rlike(regex))


def excluded(path: Column, patterns: list[str], dialect: str = "glob") -> Column:
    """True when a relative path is excluded.

    ``glob``: base name equals the pattern, or the pattern matches the path or an ancestor
    folder; a pattern ending in ``/`` names a folder prefix. ``substring``: the pattern occurs
    anywhere. ``path``: right-anchored segment match. ``substring_or_path``: either of these.
    """
    hit = F.lit(False)
    for pattern in patterns:
        if dialect in ("substring", "substring_or_path"):
            hit = hit | path.contains(pattern)
        if dialect in ("path", "substring_or_path"):
            hit = hit | path.rlike(path_match_regex(pattern))
        if dialect == "glob":
            regex = glob_regex(pattern.rstrip("/"))
            folders = _any_like(ancestors(path), regex)
            if pattern.endswith("/"):
                hit = hit | folders
            else:
                hit = hit | (basename(path) == pattern) | path.rlike(regex) | folders
                # The root folder counts as an ancestor named ".".
                if pattern in (".", "*", "?"):
                    hit = hit | F.lit(True)
    return hit
