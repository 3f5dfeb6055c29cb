"""Path expressions: components, suffix, language routing, relative form."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Directory names that are never walked. The last one is compared
# literally, so a real `name.egg-info` directory is walked.
DEFAULT_EXCLUDED_DIRS = (
    "node_modules", ".venv", "venv", "__pycache__", "dist", "build",
    ".git", ".hg", ".svn", ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache",
    "coverage", ".coverage", "htmlcov", "eggs", ".eggs", "*.egg-info",
)


def parts(path: Column) -> Column:
    """Path components. Arrays compare component by component, as sorted paths do."""
    return F.split(path, "/")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, or '' (`.bashrc` and `name.` have none)."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def outside_default_dirs(path: Column) -> Column:
    """True unless an ancestor directory carries a default-excluded name."""
    folders = F.slice(parts(path), F.lit(1), F.size(parts(path)) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in DEFAULT_EXCLUDED_DIRS]))


def has_extension(path: Column, extensions: Iterable[str]) -> Column:
    """Case-sensitive suffix filter."""
    return suffix(path).isin(*extensions)


def relative_to(path: Column, root: Column) -> Column:
    """``path`` below ``root``; '.' for the root itself; the base name if outside."""
    prefix = F.concat(F.regexp_replace(root, "/+$", ""), F.lit("/"))
    return (
        F.when(path.startswith(prefix), F.substring(path, F.length(prefix) + 1, F.length(path)))
        .when(path == root, F.lit("."))
        .otherwise(basename(path))
    )


def prefixes(path: Column) -> Column:
    """Every path that gates a file: each ancestor directory twice (plain and with a
    trailing slash), then the file itself."""
    pieces = parts(path)
    folders = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))),
            lambda n: F.array(
                F.array_join(F.slice(pieces, F.lit(1), n), "/"),
                F.concat(F.array_join(F.slice(pieces, F.lit(1), n), "/"), F.lit("/")),
            ),
        )
    )
    return F.when(
        F.size(pieces) > 1, F.concat(folders, F.array(path))
    ).otherwise(F.array(path))
