"""The registered queries: one per operator, each over whole tables.

Every callable takes (spark, sf_dir) and returns a DataFrame of scalar columns.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.functions import naming, paths, text
from varscope.operators import (
    descriptions,
    extract,
    inventory,
    reconcile,
    reports,
    selection,
    template,
    verdict,
)
from varscope.operators.languages import (
    DEFAULT_LANGUAGES,
    DOCKER,
    GO,
    JAVASCRIPT,
    PYTHON,
    SHELL,
    START,
    LexedLanguage,
    LineLanguage,
)
from varscope.operators.joins import join_heavy
from varscope.operators.ordering import with_ordinal
from varscope.plans import corpus
from varscope.session import materialize, new_table_path, tune
from varscope.sources import sinks, tables
from varscope.sources.cache import CacheStore
from varscope.streaming import alerts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return function(spark, sf_dir)

    QUERIES[function.__name__] = run
    return run


# A language registered by a user: environment lookups of Ruby.
RUBY = LexedLanguage(
    name="ruby",
    extensions=(".rb",),
    guards=("ENV",),
    anchor="ENV",
    head=r"(?<![\w.:@$])(ENV)\s*+(?:\[|\.\s*+fetch\s*+\()",
    skip=r"#[^\n]*+|\"(?:[^\"\\\n]++|\\[\s\S])*+\"?|'(?:[^'\\\n]++|\\[\s\S])*+'?",
    call=(
        START + r"ENV\s*+(?:\.\s*+fetch\s*+)?+[(\[]"
        r"(?=(?:\s*+(\"[^\"\n]*+\"|'[^'\n]*+')(?=\s*+[,)\]])"
        r"(?:\s*+,\s*+(?:(\"[^\"\n]*+\"|'[^'\n]*+')(?=\s*+[,)])|([^\s)\]])))?)?)"
    ),
    key_groups=(1,),
    default_group=2,
    other_argument_group=3,
)

# Line languages given by their grammar alone: variables of make files, and settings of service units.
MAKE = LineLanguage(
    "make",
    (".mk",),
    ("$",),
    filename_prefixes=("Makefile",),
    references=(r"\$[({]([A-Z_][A-Z0-9_]*+)[)}]",),
    assigned=r"(?md)^([A-Z_][A-Z0-9_]*+) *+[?:+]?=",
    specials=("MAKE",),
)
SETTINGS = LineLanguage(
    "unit",
    (".unit",),
    ("Environment",),
    declaration=r" *+(Environment|PassEnvironment) *+= *+([A-Z_][A-Z0-9_]*+)(?: *+(=)([^\n]*+)| ([^\n]*+))?$",
    valued_by=(("Environment", "sign"),),
)

REF = ("repo", "path", "line", "column", "name", "default_value", "is_required")


# --------------------------------------------------------------------- shared inputs


def files(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.source_files(spark, sf)


def walked(spark: SparkSession, sf: str) -> DataFrame:
    return selection.walk_refs(files(spark, sf), corpus.ignore_rules(spark, sf))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.inventory(walked(spark, sf))


def entries(spark: SparkSession, sf: str) -> DataFrame:
    return template.parse_templates(corpus.env_templates(spark, sf))


def merged(spark: SparkSession, sf: str) -> DataFrame:
    return reconcile.reconcile(found(spark, sf), entries(spark, sf))


def visited(spark: SparkSession, sf: str) -> DataFrame:
    return selection.walked_paths(files(spark, sf), corpus.ignore_rules(spark, sf))


def lines(array: Column) -> Column:
    return F.array_join(array, "\n")


def refs_of(spark: SparkSession, sf: str, language, condition: str = "true") -> DataFrame:
    return extract.extract_language(files(spark, sf), language).filter(condition).select(*REF)


# --------------------------------------------------------------------------- sources


@query
def source_files(spark, sf):
    ordered = with_ordinal(
        tables.walk_order(files(spark, sf)).select(
            "repo", "parts", "path",
            F.octet_length("content").alias("n_bytes"),
            F.md5(F.encode("content", "UTF-8")).alias("digest"),
        ),
        ["repo"], ["parts"],
    )
    return ordered.drop("parts")


@query
def single_file(spark, sf):
    return extract.extract(selection.single_file(files(spark, sf), "node_modules/f26.py")).select(*REF)


@query
def staged_files(spark, sf):
    return selection.staged_paths(files(spark, sf), corpus.changes(spark, sf))


@query
def staged_refs(spark, sf):
    return selection.staged_refs(files(spark, sf), corpus.changes(spark, sf)).select(*REF, F.col("pos.rank").alias("ord"))


@query
def staged_result(spark, sf):
    """Findings, scanned files and errors of an explicit list, some of whose files cannot be read."""
    broken, changes = _partly_unreadable(spark, sf), corpus.changes(spark, sf)
    return selection.staged_stats(broken, changes, selection.staged_refs(broken, changes))


@query
def template_source(spark, sf):
    repos = files(spark, sf).select("repo").distinct()
    return repos.join(corpus.env_templates(spark, sf), "repo", "left").select(
        "repo",
        F.col("content").isNotNull().alias("has_template"),
        F.size(text.to_lines(F.coalesce("content", F.lit("")))).alias("n_lines"),
    )


@query
def config_precedence(spark, sf):
    repos = files(spark, sf).select("repo").distinct()
    resolved = tables.resolve_config(repos, corpus.repo_config(spark, sf))
    return resolved.select("repo", F.array_join("exclude", ",").alias("exclude"), "output")


@query
def cache_load(spark, sf):
    store = corpus.keyed_files(spark, sf).selectExpr(
        "'key' || cast(k as string) as key",
        """case k % 4 when 0 then '["d' || cast(k as string) || '", "e"]'
           when 1 then '["d"]' when 2 then '{"a": 1}' else 'broken [' end as entry""",
    )
    return tables.read_cache(store)


# ----------------------------------------------------------------------------- paths


@query
def default_dir_filter(spark, sf):
    return selection.drop_default_dirs(files(spark, sf).select("repo", "path"))


@query
def ignore_filter(spark, sf):
    rules = corpus.ignore_rules(spark, sf)
    return selection.apply_rules(files(spark, sf).select("repo", "path"), rules, ("gitignore",))


@query
def exclude_filter(spark, sf):
    rules = corpus.ignore_rules(spark, sf)
    return selection.apply_rules(files(spark, sf).select("repo", "path"), rules, ("exclude",))


@query
def extension_filter(spark, sf):
    return selection.filter_extensions(files(spark, sf).select("repo", "path"), (".py", ".ts", ".tsx"))


@query
def suffix_projection(spark, sf):
    named = corpus.keyed_files(spark, sf).selectExpr(
        """case k % 5 when 0 then path when 1 then 'a.b/.hid' || cast(k as string)
           when 2 then 'x.tar.S' || cast(k as string) when 3 then 'foo' || cast(k as string) || '.'
           else 'dir.d/f' || cast(k as string) end as path"""
    )
    return named.select("path", paths.suffix(F.col("path")).alias("suffix"))


@query
def route_language(spark, sf):
    return extract.route_language(files(spark, sf).select("repo", "path"))


@query
def supported_files(spark, sf):
    return extract.supported(extract.route_language(files(spark, sf).select("repo", "path")))


@query
def relative_path(spark, sf):
    placed = corpus.keyed_files(spark, sf).selectExpr(
        "'/w/' || repo || '/' || path as path",
        """case k % 3 when 0 then '/w/' || repo when 1 then '/w/' || repo || '/' || path
           else '/other' end as root""",
    )
    return placed.select(
        "path", "root", paths.relative_to(F.col("path"), F.col("root")).alias("relative")
    )


@query
def line_split(spark, sf):
    texts = corpus.keyed_files(spark, sf).selectExpr(
        "k",
        """'a' || case k % 8 when 0 then chr(10) when 1 then chr(13) || chr(10) when 2 then chr(13)
           when 3 then chr(11) when 4 then chr(12) when 5 then chr(28) when 6 then chr(30)
           else chr(133) end || case when k % 3 = 0 then '' else 'b' || chr(10) end as text""",
    )
    return texts.select("k", F.posexplode(text.to_lines(F.col("text"))).alias("line", "text"))


# ------------------------------------------------------------------------ extraction


@query
def lexical_mask(spark, sf):
    return extract.extract(files(spark, sf)).select("repo", "path", "language", "line", "column", "name")


@query
def py_getenv(spark, sf):
    return refs_of(spark, sf, PYTHON, "contains(snippet, 'getenv(')")


@query
def py_environ_get(spark, sf):
    return refs_of(spark, sf, PYTHON, "contains(snippet, 'environ.get(')")


@query
def py_environ_subscript(spark, sf):
    return refs_of(spark, sf, PYTHON, "contains(snippet, 'environ[')")


@query
def py_defaults(spark, sf):
    return refs_of(spark, sf, PYTHON)


@query
def js_member(spark, sf):
    return refs_of(spark, sf, JAVASCRIPT, "not contains(snippet, 'env[')")


@query
def js_subscript(spark, sf):
    return refs_of(spark, sf, JAVASCRIPT, "contains(snippet, 'env[')")


@query
def go_getenv(spark, sf):
    return refs_of(spark, sf, GO)


@query
def shell_refs(spark, sf):
    return refs_of(spark, sf, SHELL)


@query
def shell_specials(spark, sf):
    named = corpus.keyed_files(spark, sf).selectExpr(
        "k",
        "case k % 7 when 0 then '_' when 1 then 'A' when 2 then '7' when 3 then '__' "
        "when 4 then '#' when 5 then '12' else name end as name",
    )
    return named.select("k", "name", extract.is_shell_special(F.col("name")).alias("special"))


@query
def shell_locals(spark, sf):
    scripts = extract.route_language(files(spark, sf)).filter("language = 'shell'")
    names = extract.own_names(text.unify_lines(F.col("content")), SHELL)
    return scripts.select("repo", "path", F.array_join(F.array_sort(names), ",").alias("locals"))


@query
def docker_env(spark, sf):
    return refs_of(spark, sf, DOCKER, "startswith(trim(snippet), 'ENV')")


@query
def docker_arg(spark, sf):
    return refs_of(spark, sf, DOCKER, "startswith(trim(snippet), 'ARG')")


@query
def docker_unquote(spark, sf):
    values = corpus.keyed_files(spark, sf).selectExpr(
        "k",
        """case k % 6 when 0 then ' "' || name || '" ' when 1 then '''' || name || ''''
           when 2 then '"' || name || '''' when 3 then '"' when 4 then '""'
           else ' ' || name || '"' end as raw""",
    )
    return values.select("k", text.unquote(F.col("raw")).alias("value"))


@query
def ref_locations(spark, sf):
    return extract.extract(files(spark, sf)).select("repo", "path", "name", "line", "column", "snippet")


@query
def custom_language(spark, sf):
    scripts = corpus.keyed_files(spark, sf).selectExpr(
        "repo",
        "'lib/f' || cast(k as string) || '.rb' as path",
        """'# ENV["DECOY_C"]' || chr(10) || 's = ''ENV["DECOY_S"]''' || chr(10) ||
           case k % 3 when 0 then 'a = ENV["' || name || '"]'
           when 1 then '  b = ENV.fetch("' || name || '", "r' || cast(k % 5 as string) || '")'
           else 'c = ENV.fetch("' || name || '") { 1 }' end || chr(10) || 'ENV[dyn]' as content""",
    )
    return extract.extract(scripts, (*DEFAULT_LANGUAGES, RUBY)).select("language", *REF)


@query
def custom_line_language(spark, sf):
    """Two line languages known by their grammars alone, beside the built-in ones."""
    keyed = corpus.keyed_files(spark, sf)
    makes = keyed.selectExpr(
        "repo", "'build/f' || k || case when k % 2 = 0 then '.mk' else '/Makefile' end as path",
        """'OWN = 1' || chr(10) || 'x: $(OWN) $(' || name || ')' || chr(10) || chr(9) || '${MAKE} ${' || name || '}'
           || ' $(lower)' as content""",
    )
    units = keyed.selectExpr(
        "repo", "'unit/f' || k || '.unit' as path",
        """'[Service]' || chr(10) || case when k % 3 = 0 then 'PassEnvironment=' || name
           else 'Environment=' || name || '=\"d' || (k % 5) || '\"' end || chr(10) || 'Environment=' || name || '=again'
           as content""",
    )
    return extract.extract(makes.unionByName(units), (*DEFAULT_LANGUAGES, MAKE, SETTINGS)).select("language", *REF)


@query
def prose_controls(spark, sf):
    """No reference is found in whole prose, web pages and conversations."""
    sources = (("documents", "text"), ("pages", "html"), ("conversations", "text"))
    counted = None
    for table, column in sources:
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(
            F.lit(table).alias("repo"), F.col(column).alias("content")
        )
        as_files = rows.select(
            "repo",
            F.explode(F.array(*[F.lit(f"f{e}") for e in (".py", ".js", ".go", ".sh", "")])).alias("path"),
            "content",
        ).withColumn("path", F.when(F.col("path") == "f", "Dockerfile").otherwise(F.col("path")))
        part = (
            rows.groupBy("repo").agg(F.count("*").alias("n_texts"))
            .join(
                extract.extract(as_files).groupBy("repo").agg(F.count("*").alias("n_refs")),
                "repo", "left",
            )
            .na.fill(0)
        )
        counted = part if counted is None else counted.unionByName(part)
    return counted


# ----------------------------------------------------------------------- aggregation


@query
def file_findings(spark, sf):
    places = F.transform(
        "locations",
        lambda p: F.concat(p["line"].cast("string"), F.lit(":"), p["column"].cast("string")),
    )
    return inventory.file_findings(extract.extract(files(spark, sf))).select(
        "repo", "path", "language", "name", "is_required", "default_value",
        F.array_join(places, ",").alias("places"),
    )


@query
def inventory_(spark, sf):
    return found(spark, sf).select(
        "repo", "name", "inferred_type", "is_required", "default_value", "language",
        "n_locations",
        F.array_join("first_pos.parts", "/").alias("first_file"),
        F.array_join("last_pos.parts", "/").alias("last_file"),
    )


@query
def required_fold(spark, sf):
    return found(spark, sf).select("repo", "name", "is_required")


@query
def default_fold(spark, sf):
    return found(spark, sf).select("repo", "name", "default_value")


@query
def first_language(spark, sf):
    return found(spark, sf).select("repo", "name", "language", "inferred_type")


@query
def inventory_order(spark, sf):
    ordered = with_ordinal(found(spark, sf).select("repo", "name", "first_pos"), ["repo"], ["first_pos", "name"])
    return ordered.select("repo", "ord", "name")


@query
def scanned_files(spark, sf):
    return inventory.scanned_files(visited(spark, sf))


def _partly_unreadable(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.keyed_files(spark, sf).selectExpr(
        "repo", "path", "case when k % 71 = 0 then null else content end as content"
    )


@query
def scan_errors(spark, sf):
    lost = _partly_unreadable(spark, sf).filter("content is null")
    return inventory.scan_errors(extract.route_language(lost))


@query
def scan_summary(spark, sf):
    broken, rules = _partly_unreadable(spark, sf), corpus.ignore_rules(spark, sf)
    return inventory.scan_stats(
        selection.walked_paths(broken, rules),
        inventory.scan_errors(selection.unreadable_paths(broken, rules)),
        inventory.inventory(selection.walk_refs(broken, rules)),
    )


# ---------------------------------------------------------------------- names, rules

TYPED_SUFFIXES = tuple(
    dict.fromkeys(
        [e for _, group in naming.SCAN_TYPES for e in group]
        + [e for _, group in naming.NAME_TYPES for e in group]
        + ["_" + word for word, _, _ in naming.LAST_WORDS]
        + ["_CREDENTIALS", "_OTHER", "_X"]
    )
)


def _typed_names(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.keyed_files(spark, sf).selectExpr("k", f"{typed_name_sql()} as name")


def typed_name_sql() -> str:
    """Names over every rule suffix: prefixed, bare, without underscore, in lower case."""
    n = len(TYPED_SUFFIXES)
    suffix = f"case k % {n} " + " ".join(
        f"when {i} then '{e}'" for i, e in enumerate(TYPED_SUFFIXES)
    ) + " end"
    known = "case k % 20 " + " ".join(
        f"when {i} then '{name}'" for i, (name, _, _) in enumerate(naming.KNOWN_NAMES)
    ) + " end"
    return (
        f"case k % 7 when 0 then replace({suffix}, '_', '') when 1 then 'NO' || replace({suffix}, '_', '') "
        f"when 2 then lower('db' || {suffix}) when 3 then {known} when 4 then {suffix} "
        f"else 'APP_' || cast(k % 9 as string) || {suffix} end"
    )


@query
def infer_type(spark, sf):
    return _typed_names(spark, sf).select("k", "name", naming.infer_type(F.col("name")).alias("inferred_type"))


@query
def infer_type_name_only(spark, sf):
    return _typed_names(spark, sf).select(
        "k", "name", naming.infer_type_name_only(F.col("name")).alias("inferred_type")
    )


@query
def describe_rules(spark, sf):
    named = _typed_names(spark, sf).withColumn(
        "d", naming.describe(F.col("name"))
    )
    return named.select("k", "name", "d.description", "d.example")


@query
def service_titles(spark, sf):
    named = corpus.keyed_files(spark, sf).selectExpr(
        "k", "'S' || cast(a as string) || 'BUCKET_v2API_' || cast(k as string) || 'X_KEY' as name"
    )
    return named.select(
        "k",
        naming.service_title(F.col("name")).alias("title"),
        naming.service_slug(F.col("name")).alias("slug"),
    )


# ------------------------------------------------------------------------- templates


@query
def template_lines(spark, sf):
    return template.template_lines(corpus.env_templates(spark, sf)).select(
        "repo", F.col("line").cast("bigint").alias("line"), "kind"
    )


@query
def template_kv(spark, sf):
    return entries(spark, sf).select("repo", "ord", "key")


@query
def template_values(spark, sf):
    return entries(spark, sf).select("repo", "key", "value", "inline_comment")


@query
def template_comments(spark, sf):
    return entries(spark, sf).select("repo", "key", lines(F.col("comments")).alias("comments"))


@query
def template_blanks(spark, sf):
    return entries(spark, sf).select("repo", "key", "blank_line_before")


# -------------------------------------------------------------------- reconciliation


@query
def merge_existing(spark, sf):
    return reconcile.existing(entries(spark, sf), found(spark, sf)).select("repo", "key", "value")


@query
def merge_stale(spark, sf):
    return reconcile.stale(entries(spark, sf), found(spark, sf)).select(
        "repo", "key", "value", lines(F.col("comments")).alias("comments")
    )


@query
def merge_new(spark, sf):
    return reconcile.new(entries(spark, sf), found(spark, sf)).select(
        "repo", "key", "value", lines(F.col("comments")).alias("comments"), "blank_line_before"
    )


@query
def merged_(spark, sf):
    rows = merged(spark, sf).select(
        "repo", "pos", "key", "status", "value", lines(F.col("comments")).alias("comments"),
        "blank_line_before",
    )
    return with_ordinal(rows, ["repo"], ["pos"]).drop("pos")


@query
def diff_arrays(spark, sf):
    return with_ordinal(reconcile.diff(merged(spark, sf)), ["repo", "status"], ["pos"]).drop("pos")


@query
def undescribed(spark, sf):
    return reconcile.undescribed(found(spark, sf), entries(spark, sf)).select("repo", "name", "existing")


def _rule_descriptions(names: DataFrame) -> DataFrame:
    return names.select("repo", "name", naming.describe(F.col("name")).alias("d")).select(
        "repo", "name", "d.description", "d.example"
    )


def _described(spark: SparkSession, sf: str) -> DataFrame:
    names = materialize(found(spark, sf))
    documented = entries(spark, sf)
    return reconcile.apply_descriptions(
        reconcile.reconcile(names, documented),
        _rule_descriptions(reconcile.undescribed(names, documented)),
    )


@query
def described_entries(spark, sf):
    return _described(spark, sf).select("repo", "key", "status", lines(F.col("comments")).alias("comments"))


@query
def render_template(spark, sf):
    return with_ordinal(
        reconcile.entry_lines(_described(spark, sf)), ["repo"], ["pos"]
    ).select("repo", "ord", "text")


# -------------------------------------------------------------------------- verdicts


def _verdicts(spark: SparkSession, sf: str, **flags) -> DataFrame:
    return verdict.check(
        merged(spark, sf), inventory.scanned_files(visited(spark, sf)), **flags
    )


@query
def check(spark, sf):
    plain = _verdicts(spark, sf)
    strict = verdict.exit_code(F.col("n_new"), F.col("n_stale"), True, False)
    return plain.withColumn("strict_exit_code", strict)


@query
def check_stale(spark, sf):
    return _verdicts(spark, sf, fail_on_stale=True)


def _brought(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(files, configuration): ignore files and templates lie among the files."""
    rules = corpus.ignore_rules(spark, sf)

    def patterns(kind):
        ordered = F.array_sort(F.collect_list(F.struct("ord", "pattern")))
        return rules.filter(F.col("kind") == kind).groupBy("repo").agg(
            F.transform(ordered, lambda rule: rule["pattern"]).alias("patterns")
        )

    ignore_files = patterns("gitignore").select(
        "repo", F.lit(".gitignore").alias("path"), F.array_join("patterns", "\n").alias("content")
    )
    templates = corpus.env_templates(spark, sf).select("repo", F.lit(".env.example").alias("path"), "content")
    config = patterns("exclude").select(
        "repo", F.lit("project").alias("source"), F.lit(True).alias("valid"),
        F.col("patterns").alias("exclude"), F.lit(None).cast("string").alias("output"),
    )
    brought = files(spark, sf).select("repo", "path", "content").unionByName(ignore_files).unionByName(templates)
    return brought, config


@query
def check_configured(spark, sf):
    return verdict.check_configured(*_brought(spark, sf), fail_on_stale=True)


@query
def generate_configured(spark, sf):
    rows = verdict.generate_configured(*_brought(spark, sf))
    return with_ordinal(rows, ["repo"], ["pos"]).select("repo", "ord", "text")


@query
def sinks_(spark, sf):
    """Rendered templates, written as one document a repo and read back."""
    path = new_table_path(spark)
    sinks.write_documents(reconcile.entry_lines(_described(spark, sf)), path, ("pos",))
    return sinks.read_documents(spark, path)


@query
def check_json(spark, sf):
    entries_ = materialize(merged(spark, sf))
    verdicts = materialize(verdict.check(entries_, inventory.scanned_files(visited(spark, sf))))
    rows = with_ordinal(verdict.verdict_lines(entries_, verdicts), ["repo"], ["section", "pos"])
    return rows.select("repo", "ord", "text")


@query
def check_changes(spark, sf):
    return verdict.check_changes(
        files(spark, sf), corpus.changes(spark, sf), entries(spark, sf),
        corpus.ignore_rules(spark, sf),
    )


def _streamed(spark: SparkSession, sf: str, event_time: str | None = None) -> DataFrame:
    """First alerts over the whole corpus, read as a stream of files."""
    source = corpus.corpus_path(spark, sf)
    # A micro-batch has work for every core, many times over: its own cost is paid less often.
    batch = 16 * spark.sparkContext.defaultParallelism
    stream = (
        spark.readStream.schema(spark.read.parquet(source).schema)
        .option("maxFilesPerTrigger", batch)
        .parquet(source)
        .select("repo", "path", "content", *([F.timestamp_seconds("k").alias(event_time)] if event_time else []))
    )
    output, state = new_table_path(spark), new_table_path(spark)
    documented = materialize(alerts.documented_names(entries(spark, sf)))
    found = alerts.check_stream(stream, documented, event_time=event_time, delay="100000 days")
    alerts.run_once(found, output, state)
    return spark.read.schema("repo string, name string").parquet(output)


@query
def check_stream(spark, sf):
    return _streamed(spark, sf)


@query
def check_stream_events(spark, sf):
    """The form with bounded state; within the delay each name is reported once."""
    return _streamed(spark, sf, "seen_at")


@query
def drift_outputs(spark, sf):
    entries_ = materialize(merged(spark, sf))
    verdicts = verdict.check(entries_, inventory.scanned_files(visited(spark, sf)))
    numbered = with_ordinal(
        entries_.filter("status in ('NEW', 'STALE')").select("repo", "status", "pos", "key"),
        ["repo", "status"], ["pos"],
    )
    return verdict.drift_outputs(numbered, verdicts)


# ---------------------------------------------------------------------- descriptions


@query
def scrub_snippets(spark, sf):
    return extract.extract(files(spark, sf)).select(
        "repo", "path", "line", text.scrub_snippet(F.col("snippet")).alias("scrubbed")
    )


class _Described:
    """Requested names with cache keys, the cache they meet, and batches of the misses."""

    def __init__(self, spark: SparkSession, sf: str, all_keys: bool = False):
        self.refs = materialize(walked(spark, sf))
        self.names = names = materialize(inventory.inventory(self.refs))
        requested = materialize(reconcile.undescribed(names, entries(spark, sf)))
        # Only names that want a description are hashed.
        wanted = requested.select("repo", "name")
        keys = materialize(
            descriptions.cache_keys(
                self.refs if all_keys else join_heavy(self.refs, wanted, ["repo", "name"], names, "n_locations"),
                names if all_keys else names.join(wanted, ["repo", "name"], "left_semi"),
            )
        )
        self.keyed = materialize(requested.join(keys, ["repo", "name"]))
        # Cached in an earlier run: names numbered 0, 4 and 8.
        self.cache = keys.filter("name rlike '^V[048]_'").select(
            "key",
            F.concat(F.lit("cached "), "name").alias("description"),
            F.lit("ce").alias("example"),
        ).distinct()  # equal lines in two repositories share one key
        self.hits, self.misses = descriptions.cache_lookup(self.keyed, self.cache)

    def batches(self) -> DataFrame:
        return descriptions.prompt_batches(self.misses, ("existing", "first_pos", "name"))


def _responses(batched: DataFrame) -> DataFrame:
    """Answers as a model might give them: plain, wrapped in prose, or useless."""
    answer = F.expr(
        """case when name rlike '^V(1|5|9)_'
             then '"' || name || '": {"description": "said ' || name || '", "example": "se"}'
           when name rlike '^V(2|6|10)_' then '"' || name || '": {"description": "only"}'
           else '"' || name || '": "no object"' end"""
    )
    number = F.substring_index("batch_id", ":", -1).cast("int") % 3
    joined = F.concat(
        F.lit('{"UNASKED": {"description": "x", "example": "y"}, '),
        F.array_join(F.array_sort(F.collect_list(answer)), ", "),
        F.lit("}"),
    )
    return (
        batched.groupBy("batch_id")
        .agg(joined.alias("json"))
        .select(
            "batch_id",
            F.when(number == 0, F.col("json"))
            .when(number == 1, F.concat(F.lit("Sure:\n```\n"), "json", F.lit("\n```")))
            .otherwise("sorry, no")
            .alias("text"),
        )
    )


@query
def cache_keys(spark, sf):
    refs = materialize(walked(spark, sf))
    return descriptions.cache_keys(refs, materialize(inventory.inventory(refs)))


@query
def cache_hits(spark, sf):
    case = _Described(spark, sf)
    return (
        case.hits.select("repo", "name", "description", "example")
        .unionByName(
            case.misses.select(
                "repo", "name",
                F.lit(None).cast("string").alias("description"),
                F.lit(None).cast("string").alias("example"),
            )
        )
    )


@query
def prompt_batches(spark, sf):
    return _Described(spark, sf).batches().select("repo", "name", "ord", "batch_id")


@query
def prompts(spark, sf):
    case = _Described(spark, sf)
    return descriptions.prompts(case.batches(), case.refs)


@query
def parse_responses(spark, sf):
    batched = _Described(spark, sf).batches()
    return descriptions.parse_responses(batched, _responses(batched))


@query
def resolve_descriptions(spark, sf):
    case = _Described(spark, sf)
    batched = case.batches()
    parsed = descriptions.parse_responses(batched, _responses(batched))
    return descriptions.resolve(case.keyed, case.hits, parsed)


@query
def cache_upsert(spark, sf):
    case = _Described(spark, sf, all_keys=True)
    batched = case.batches()
    parsed = descriptions.parse_responses(batched, _responses(batched))
    fresh = case.keyed.select("repo", "name", "key").join(parsed, ["repo", "name"])
    return descriptions.upsert(case.cache, fresh.select("key", "description", "example"))


@query
def cache_store(spark, sf):
    """A cache of one entry a file, written over twice by few keys, compacted once, and read."""
    keyed = corpus.keyed_files(spark, sf)
    entry = lambda text, where: keyed.filter(where).selectExpr(
        "'key' || cast(k as string) as key", f"'{text} ' || name as description", "'e' as example"
    )
    store = CacheStore(spark, new_table_path(spark), compact=2)
    for text, where in (("old", "true"), ("new", "k % 100 = 3"), ("newer", "k % 200 = 3"), ("last", "k % 100 = 7")):
        store.upsert(entry(text, where))
    return store.read()


# --------------------------------------------------------------------------- reports


@query
def report_json(spark, sf):
    broken, rules = _partly_unreadable(spark, sf), corpus.ignore_rules(spark, sf)
    refs = materialize(selection.walk_refs(broken, rules))
    names = materialize(inventory.inventory(refs))
    errors = materialize(inventory.scan_errors(selection.unreadable_paths(broken, rules)))
    visited_ = selection.walked_paths(broken, rules)
    stats = materialize(inventory.scan_stats(visited_, errors, names))
    rows = reports.report_json(refs, names, stats, errors)
    return with_ordinal(rows, ["repo"], list(reports.ORDER)).select("repo", "ord", "text")


@query
def report_markdown(spark, sf):
    refs = materialize(walked(spark, sf))
    names = materialize(inventory.inventory(refs))
    repos = files(spark, sf).select("repo").distinct()
    rows = reports.report_markdown(refs, names, repos)
    return with_ordinal(rows, ["repo"], list(reports.ORDER)).select("repo", "ord", "text")


@query
def generate_described(spark, sf):
    """The template with the best texts there are: cached, else answered, else by rule."""
    case = _Described(spark, sf)
    batched = materialize(case.batches())
    parsed = descriptions.parse_responses(batched, _responses(batched))
    texts = descriptions.resolve(case.keyed, case.hits, parsed)
    merged_ = reconcile.apply_descriptions(reconcile.reconcile(case.names, entries(spark, sf)), texts)
    return with_ordinal(reconcile.entry_lines(merged_), ["repo"], ["pos"]).select("repo", "ord", "text")


for _name in ("inventory_", "merged_", "sinks_"):
    QUERIES[_name.rstrip("_")] = QUERIES.pop(_name)
