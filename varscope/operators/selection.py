"""Which files of a corpus take part in a scan.

Selection looks at paths only, so it reads two columns of the corpus, and source text is
never shuffled: literal path tests run inside the scan, per-repo rules are either
broadcast (when counted to be few) or applied to the much smaller references afterwards.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varscope.functions import ignore, paths
from varscope.operators.extract import extract, route_language, supported
from varscope.operators.inventory import with_position
from varscope.operators.joins import join_per_key
from varscope.operators.languages import DEFAULT_LANGUAGES, Language
from varscope.session import fits_broadcast

def drop_default_dirs(files: DataFrame) -> DataFrame:
    return files.filter(paths.outside_default_dirs(F.col("path")))


def filter_extensions(files: DataFrame, extensions: Iterable[str]) -> DataFrame:
    return files.filter(paths.has_extension(F.col("path"), extensions))


def _excluded(kinds: Sequence[str]):
    column = {"gitignore": "ignore_rules", "exclude": "exclude_rules"}
    test = F.lit(False)
    for kind in kinds:
        test = test | ignore.matches(F.col("path"), F.col(column[kind]))
    return test


def apply_rules(
    rows: DataFrame,
    rules: DataFrame,
    kinds: Sequence[str] = ("gitignore", "exclude"),
    small: bool | None = None,
    exempt: Column | None = None,
) -> DataFrame:
    """Drop rows (anything with repo and path) that the rules of their repo exclude."""
    if small is None:
        small = fits_broadcast(rules)
    # A repo may own a third of all rows; its rules are one row.
    joined = join_per_key(rows, ignore.exclusion_rules(rules), ["repo"], ["path"], small)
    kept = ~_excluded(kinds)
    if exempt is not None:
        kept = exempt | kept
    return joined.filter(kept).select(*rows.columns)


def config_rules(config: DataFrame) -> DataFrame:
    """Exclude globs of resolved configurations as rule rows."""
    return config.select(
        "repo",
        F.lit("exclude").alias("kind"),
        F.posexplode("exclude").alias("ord", "pattern"),
    )


def walked_paths(
    files: DataFrame,
    rules: DataFrame | None = None,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
) -> DataFrame:
    """(repo, path, language) of the supported files a full scan visits.

    Only these two columns of the file table are read.
    """
    rows = supported(route_language(drop_default_dirs(files.select("repo", "path")), languages))
    return rows if rules is None else apply_rules(rows, rules)


def unreadable_paths(
    files: DataFrame,
    rules: DataFrame | None = None,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
) -> DataFrame:
    """The visited files without text. The null test is pushed to the scan, where the
    statistics of a row group that has no null rule it out unread."""
    return walked_paths(files.filter(F.col("content").isNull()), rules, languages)


def walk_refs(
    files: DataFrame,
    rules: DataFrame | None = None,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
    small: bool | None = None,
) -> DataFrame:
    """References of a full scan, with positions."""
    rows = route_language(drop_default_dirs(files), languages)
    if rules is None:
        return with_position(extract(rows, languages))
    if small is None:
        small = fits_broadcast(rules)
    if small:
        return with_position(extract(apply_rules(supported(rows), rules, small=True), languages))
    return with_position(apply_rules(extract(rows, languages), rules, small=False))


def single_file(files: DataFrame, path: str) -> DataFrame:
    """A file named directly is scanned whatever the rules say."""
    return files.filter(F.col("path") == path)


def staged_paths(
    files: DataFrame, changes: DataFrame, languages: Sequence[Language] = DEFAULT_LANGUAGES
) -> DataFrame:
    """Listed files that exist and are supported, once per listing, with list position."""
    known = supported(route_language(files.select("repo", "path"), languages))
    return changes.join(known, ["repo", "path"]).select("repo", "path", "language", "ord")


def staged_refs(
    files: DataFrame,
    changes: DataFrame,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
) -> DataFrame:
    """References of the listed files in list order; no ignore or exclude rule applies.

    Only listed files are read. Few changes are broadcast to the scan; otherwise the text of
    the supported files is shuffled, which costs a small part of reading all of it.
    """
    # Extraction runs once per listed file; repeats of a path come back by the join.
    listed = changes.select("repo", "path").distinct()
    if fits_broadcast(changes):
        listed = F.broadcast(listed)
    known = supported(route_language(files, languages)).drop("language")
    refs = extract(known.join(listed, ["repo", "path"], "left_semi"), languages)
    return with_position(refs.join(changes, ["repo", "path"]), F.col("ord")).drop("ord")


def staged_stats(
    files: DataFrame, changes: DataFrame, refs: DataFrame, languages: Sequence[Language] = DEFAULT_LANGUAGES
) -> DataFrame:
    """(repo, scanned_files, found, errors) of a scan of the listed files.

    Every listing of a supported file counts as scanned; one that cannot be read is an
    error. Listed files that do not exist, or have no language, are passed over. ``refs``
    are those of ``staged_refs``. No text is read.
    """
    lost = files.select("repo", "path", F.col("content").isNull().alias("_lost"))
    scanned = (
        staged_paths(files, changes, languages)
        .join(lost, ["repo", "path"])
        .groupBy("repo")
        .agg(F.count("*").alias("scanned_files"), F.count_if("_lost").alias("errors"))
    )
    found = refs.select("repo", "name").distinct().groupBy("repo").agg(F.count("*").alias("found"))
    return scanned.join(found, "repo", "left").select(
        "repo", "scanned_files", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"), "errors"
    )


def changed_or_walked_refs(
    files: DataFrame,
    changes: DataFrame,
    rules: DataFrame | None = None,
    languages: Sequence[Language] = DEFAULT_LANGUAGES,
    small: bool | None = None,
) -> DataFrame:
    """References of the listed files, or of a full scan for repos without a list.

    The text is read once. With few changes and rules the choice of files is made inside
    the scan; otherwise it is made on the references.
    """
    if small is None:
        small = fits_broadcast(changes) and (rules is None or fits_broadcast(rules))
    listing = changes.select("repo").distinct().withColumn("_listed", F.lit(True))
    places = F.broadcast(changes) if small else changes

    def choose(rows: DataFrame) -> DataFrame:
        listed = F.col("_listed").isNotNull()
        marked = (
            join_per_key(rows, listing, ["repo"], ["path"], small)
            .join(places, ["repo", "path"], "left")
            .filter(
                F.when(listed, F.col("ord").isNotNull()).otherwise(
                    paths.outside_default_dirs(F.col("path"))
                )
            )
        )
        if rules is not None:
            marked = apply_rules(marked, rules, small=small, exempt=listed)
        return marked.drop("_listed")

    rows = supported(route_language(files, languages))
    if small:
        refs = extract(choose(rows), languages, keep=["ord"])
    else:
        refs = choose(extract(rows, languages))
    return with_position(refs, F.coalesce("ord", F.lit(0))).drop("ord")
