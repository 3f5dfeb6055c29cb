"""Source corpus rendered from ``orders``, one file per row, with its truth known.

The rendering is ANSI SQL that Spark and DuckDB read alike. Every property of a file is
arithmetic on the order key, so expected results are computed from keys alone and never
by parsing text. A third of all files belongs to ``repo0``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.operators.reconcile import MARKER
from varscope.session import new_table_path

NL = "chr(10)"
TAB = "chr(9)"
SUFFIXES = ("_URL", "_KEY", "_PORT", "_ENABLED", "_TIMEOUT", "_NAME", "_HOST")


def _case(subject: str, values) -> str:
    whens = " ".join(f"when {i} then '{v}'" for i, v in enumerate(values))
    return f"case {subject} {whens} end"


SUFFIX_OF = _case("s", SUFFIXES)
NAME_OF = f"'V' || cast(a as string) || {SUFFIX_OF}"

# Each layer may use columns of the layers before it.
KEY_LAYERS = (
    {
        "r": "case when k % 47 < 16 then 0 else k % 31 end",
        "a": "k % 11",
        "s": "k % 7",
        "ks": "cast(k as string)",
        "again": "k % 6 = 0",
    },
    {
        "repo": "'repo' || cast(r as string)",
        "name": NAME_OF,
        "lang": (
            "case when s >= 5 then case when k % 2 = 0 then 'python' else 'docker' end "
            "when k % 5 = 0 then 'python' when k % 5 = 1 then 'javascript' "
            "when k % 5 = 2 then 'go' when k % 5 = 3 then 'shell' else 'docker' end"
        ),
        "valued": "k % 3 = 0 or (s >= 5 and a < 6)",
        "dv": "'d' || cast(k % 37 as string)",
        "f": "k % 4",
    },
    {
        # Second argument or value present but not a usable default.
        "hollow": "(not valued) and k % 41 = 0",
        "dir": (
            "case when k % 13 = 0 then 'node_modules/' when k % 17 = 0 then 'gen/' "
            "when k % 19 = 0 then 'tests/' when k % 10 = 9 then 'src-b/' else 'src/' end"
        ),
        "ext": (
            "case when k % 23 = 0 then '.txt' "
            "when lang = 'python' then case when k % 9 = 4 then '.pyw' else '.py' end "
            "when lang = 'javascript' then case k % 3 when 0 then '.js' when 1 then '.ts' "
            "else '.TSX' end "
            "when lang = 'go' then '.go' "
            "else case when k % 2 = 0 then '.sh' else '.bash' end end"
        ),
    },
    {
        "path": (
            "case when lang = 'docker' then 'svc' || ks || '/' || case k % 3 "
            "when 0 then 'Dockerfile' when 1 then 'Dockerfile.py' else 'dockerfile' end "
            "else dir || 'f' || ks || ext end"
        ),
        "arg2": (
            "case when valued then ', ''' || dv || '''' when hollow then ', None' else '' end"
        ),
        "arg1": (
            "case when valued then ', \"' || dv || '\"' when hollow then ', None' else '' end"
        ),
    },
    {
        # Code in literals, regex literals and markup text that a shallow reader would run past.
        "py_traps": (
            "'; t = f\"{d[\"k\"]:{''>''}{w}} {{os.getenv(''DECOY_F'')}} {x:os} {y!r:#>9}\" "
            "+ rb''' || chr(92) || '''os.environ[\"DECOY_B\"]'''"
        ),
        "js_traps": (
            "' for (const y of z) /\"/.test(y); let w = i++ / 2, x = j-- / w / 3;'"
            "|| ' v = <b c=''process.env.DECOY_A'' d={() => <i/>}>it''s process.env.DECOY_K {u / 2}</b>;'"
            "|| ' q(p.split(/[\"''`]/), p.match(/[/*]/), a / b / c, <p>Don''t see http://x</p>, '"
            "|| '`a${g({k: {l: {m: {n: `}''${1}process.env.DECOY_N`}}}})} process.env.DECOY_M`);'"
        ),
        # The line that holds the first reference; multi-line calls continue in `ref_rest`.
        "ref_line": (
            "case lang "
            "when 'python' then case f "
            "when 0 then 'a = os.getenv(\"' || name || '\"' || arg1 || ')' "
            "when 1 then 'b = {\"k\": os.environ.get(''' || name || '''' || arg2 || ')}' "
            "when 2 then case when arg1 = '' then 'c = os.environ[\"' || name || '\"]' "
            "else 'c = os.getenv(' end "
            "else case when k % 8 = 3 then 'd = f\"é{{{f''{q(\"}\")}''}{os.getenv(''' || name || '''' || arg2 || ')}}}x\"' "
            "else 'd = f\"é{os.getenv(''' || name || '''' || arg2 || ')}x\"' end end "
            "when 'javascript' then case f "
            "when 0 then 'const a = process.env.' || name || ' || \"x\";' "
            "when 1 then 'const b = process.env[\"' || name || '\"];' "
            "when 2 then 'const c = `p${process.env.' || name || '}q process.env.DECOY_T`;' "
            "else 'g(process?.env?.' || name || ');' end "
            f"when 'go' then {TAB} || case when k % 2 = 0 then 'a := os.Getenv(\"' "
            "else 'b, ok := os.LookupEnv(\"' end || name || '\")' "
            "when 'shell' then case f "
            "when 0 then 'echo \"$' || name || '\"' "
            "when 1 then 'echo \"${' || name || ':-z}\"' "
            "when 2 then name || '=${' || name || ':-1}' "
            "else 'export ' || name || '=\"$' || name || '\"' end "
            "else case when valued then case f "
            "when 0 then 'ENV ' || name || '=\"' || dv || '\"' "
            "when 1 then 'ARG ' || name || '=' || dv "
            "when 2 then '  ENV ' || name || ' ' || dv "
            "else 'ARG ' || name || '=''' || dv || '''' end "
            "when hollow then 'ARG ' || name || '=' "
            "when k % 2 = 0 then 'ENV ' || name || '=' else 'ARG ' || name end end"
        ),
        "ref_rest": (
            "case when lang = 'python' and f = 2 and arg1 <> '' "
            f"then {NL} || '    \"' || name || '\"' || arg1 || {NL} || ')' else '' end"
        ),
        "again_line": (
            "case lang when 'python' then 'y = os.environ[\"' || name || '\"]' "
            "when 'javascript' then 'i = [process.env.' || name || ', 1];' "
            f"when 'go' then {TAB} || 'use(\"os.Getenv(x)\", os.Getenv(\"' || name || '\"))' "
            "when 'shell' then '# uses ${' || name || '}' "
            "else 'ENV ' || name || '=other' end"
        ),
    },
    {
        "content": (
            "case lang "
            f"when 'python' then '# os.getenv(\"DECOY_C\")' || {NL} || 'import os' || {NL} || '\"\"\"' || {NL} "
            f"|| 'os.getenv(\"DECOY_D\")' || {NL} || '\"\"\"' || {NL} "
            f"|| 's = ''os.environ[\"DECOY_S\"]''' || py_traps || {NL} "
            f"|| ref_line || '  ' || ref_rest || {NL} || 'z = os.getenv(dyn)' || {NL} "
            f"|| case when again then again_line || {NL} else '' end "
            f"when 'javascript' then '// process.env.DECOY_C' || {NL} || '/* process.env.DECOY_B' || {NL} "
            f"|| '*/ const s = \"process.env.DECOY_S\";' || js_traps || {NL} || ref_line || ' ' || chr(13) || {NL} "
            f"|| 'h(process.env[dyn], x.process.env.DECOY_X);' || {NL} "
            f"|| case when again then again_line || {NL} else '' end "
            f"when 'go' then 'package main' || {NL} || '// os.Getenv(\"DECOY_C\")' || {NL} "
            f"|| 'var r = `os.Getenv(\"DECOY_R\")`' || {NL} || 'func main() {{' || {NL} "
            f"|| ref_line || {NL} || {TAB} || 'os.Getenv(dyn)' || {NL} "
            f"|| case when again then again_line || {NL} else '' end || '}}' || {NL} "
            f"when 'shell' then '#!/bin/sh' || {NL} || 'LOC=1' || {NL} "
            f"|| 'echo $LOC $lower $1 $$ $_ ${{#}}' || {NL} || ref_line || '  ' || {NL} "
            f"|| case when again then again_line || {NL} else '' end "
            f"else 'FROM base' || {NL} || '# ENV DECOY_C=1' || {NL} || ref_line || {NL} "
            f"|| 'ARG lower=1' || {NL} || 'RUN echo ${{DECOY_R}}' || {NL} "
            f"|| case when again then again_line || {NL} else '' end end"
        ),
    },
)


DOLLAR_BRACE = "$' || '{"


def _spark(df: DataFrame, layers) -> DataFrame:
    for layer in layers:
        # `${` inside SQL text would be taken for a variable to substitute.
        df = df.selectExpr(
            "*", *[f"{sql.replace('${', DOLLAR_BRACE)} as {name}" for name, sql in layer.items()]
        )
    return df


def layered_sql(source: str, layers) -> str:
    """The same layers as nested DuckDB subqueries over ``source``."""
    sql = source
    for layer in layers:
        columns = ", ".join(f"{expression} as {name}" for name, expression in layer.items())
        sql = f"select *, {columns} from ({sql})"
    return sql


# Source files in one stored file. Their text packs to few bytes, which say little about the
# work of reading it: small stored files let the number of tasks grow with the corpus.
FILES_PER_PART = 20_000


def render(orders: DataFrame) -> DataFrame:
    """Keys, their arithmetic and the file each one stands for."""
    tasks = orders.sparkSession.sparkContext.defaultParallelism
    # Dealt by their count: the splits of a table may hold all its rows in a few row groups.
    parts = max(tasks, -(-orders.count() // FILES_PER_PART))
    keys = orders.select(F.col("o_orderkey").alias("k")).repartition(parts)
    return _spark(keys, KEY_LAYERS).select(
        "k", "r", "a", "s", "repo", "name", "lang", "path", "content"
    )


_tables: dict[tuple[str, str, str], str] = {}


def _stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]
) -> str:
    """Path of an input table; built and written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        path = new_table_path(spark)
        build().write.parquet(path)
        _tables[key] = path
    return _tables[key]


def corpus_path(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the rendered corpus. Files of a repo lie together, as in a table loaded
    repo by repo: the compiled ignore rules of a repo then serve a run of rows."""
    def build() -> DataFrame:
        orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
        return render(orders).sortWithinPartitions("repo", "path")

    return _stored(spark, sf_dir, "corpus", build)


def _input(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(build)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = _stored(spark, sf_dir, build.__name__, lambda: build(spark, sf_dir))
        return spark.read.parquet(path)

    return read


def keyed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(corpus_path(spark, sf_dir))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_files(repo, path, content)."""
    return keyed_files(spark, sf_dir).select("repo", "path", "content")


# ------------------------------------------------------------- rules, configs, changes

# Rules of repository number r: (kind, ord, pattern, condition on r).
RULES = (
    ("gitignore", 1, "# generated code", "r % 4 <> 3"),
    ("gitignore", 2, "gen/", "r % 4 <> 3"),
    ("gitignore", 3, "!gen/f*", "r % 4 <> 3"),
    ("gitignore", 4, "/src-b/*.js", "r % 4 <> 3"),
    ("gitignore", 5, "!*9.js", "r % 4 <> 3"),
    ("gitignore", 6, "**/src-b/f*[0-9].go", "r % 2 = 0"),
    ("exclude", 1, "tests", "r % 5 <> 4"),
    ("exclude", 2, "!src-b/", "r % 5 <> 4"),
)


def _repo_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Distinct over the keys: 31 values whatever the size.
    return keyed_files(spark, sf_dir).select("r", "repo").distinct()


@_input
def ignore_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ", ".join(
        f"if({when}, named_struct('kind', '{kind}', 'ord', {ord_}, 'pattern', '{pattern}'), null)"
        for kind, ord_, pattern, when in RULES
    )
    return (
        _repo_numbers(spark, sf_dir)
        .selectExpr("repo", f"explode(filter(array({rows}), x -> x is not null)) as rule")
        .select("repo", "rule.*")
    )


@_input
def repo_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dedicated file for even r (invalid when r % 3 = 0), project file for r % 4 < 3."""
    return _repo_numbers(spark, sf_dir).selectExpr(
        "repo",
        """inline(filter(array(
            if(r % 2 = 0, named_struct('source', 'dedicated', 'valid', r % 3 <> 0,
               'exclude', if(r % 8 = 2, array(), array('tests/', 'd' || cast(r as string))),
               'output', if(r % 8 = 2, null, 'env' || cast(r as string))), null),
            if(r % 4 < 3, named_struct('source', 'project', 'valid', true,
               'exclude', array('p' || cast(r as string)),
               'output', 'proj' || cast(r as string)), null)
        ), x -> x is not null))""",
    )


@_input
def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change lists: k % 29 = 0, last key first, some listed twice, some missing; none for
    r % 10 = 0."""
    return (
        keyed_files(spark, sf_dir)
        .filter("k % 29 = 0 and r % 10 <> 0")
        .selectExpr(
            "repo",
            """inline(filter(array(
                named_struct('path', path, 'ord', 1000000000000 - k),
                if(k % 58 = 0, named_struct('path', path, 'ord', 2000000000000 - k), null),
                if(k % 58 <> 0, named_struct('path', 'gone/' || path, 'ord', k), null)
            ), x -> x is not null))""",
        )
    )


# ------------------------------------------------------------------------- templates

DOCUMENTED = "r <> 30 and (r % 5 = 1 or (a + r) % 2 = 0)"
ENTRY_LAYERS = (
    {"name": NAME_OF, "style": "(a + s) % 4", "va": "cast(a as string)"},
    {
        "entry_text": (
            f"case style when 0 then name || '=v' || va || {NL} "
            f"when 1 then {NL} || '# about ' || name || {NL} || name || '=\"q # x\"' || {NL} "
            f"when 2 then '{MARKER}' || {NL} || 'export ' || name || '=v' || va || '  # note ' || {NL} "
            f"else {NL} || '# lost' || {NL} || ' ' || {NL} || '  # about ' || name || '  ' || {NL} "
            f"|| 'junk line' || {NL} || name || '=''w=1'' tail' || {NL} end"
        ),
    },
)


@_input
def env_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """env_templates(repo, content). A repo documents at most 77 names, so each text is
    assembled from a bounded group."""
    entries = (
        keyed_files(spark, sf_dir).filter(DOCUMENTED).select("r", "repo", "a", "s").distinct()
    )
    return (
        _spark(entries, ENTRY_LAYERS)
        .groupBy("repo", "r")
        .agg(F.array_sort(F.collect_list(F.struct("a", "s", "entry_text"))).alias("entries"))
        .select(
            "repo",
            F.concat(
                F.array_join(F.transform("entries", lambda e: e["entry_text"]), ""),
                F.expr(
                    f"case when r % 3 = 0 then 'OLD_' || cast(r as string) || '=x' || {NL} else '' end"
                ),
            ).alias("content"),
        )
    )
