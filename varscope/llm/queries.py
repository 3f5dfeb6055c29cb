"""The registered queries of this package and their expected results in DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varscope.llm import (
    language,
    licences,
    lines,
    near,
    packing,
    pieces,
    quality,
    resample,
    secrets,
    spelling,
    suffixes,
    voronoi,
    windows,
)
from varscope.llm.ship import ship
from varscope.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(function: Query) -> Query:
    @wraps(function)
    def run(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
        ship(spark)
        return function(spark, sf_dir, **options)

    QUERIES[function.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the folder is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def sha256(column: str):
    return F.sha2(F.col(column).cast("binary"), 256)


@query
def op7_substring_dedup(spark, sf_dir):
    kept = windows.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


@query
def op9_quality_rules(spark, sf_dir):
    counted = materialize(quality.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    judged = quality.judge(counted, quality.estimate(counted))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(
        "doc_id",
        *(F.col(quality.PREFIX + c).alias(c) for c in names),
        F.round(quality.PREFIX + "posterior", 9).alias("posterior"),
    )


@query
def op1_sentencepiece(spark, sf_dir, path=None):
    path = path or tokenizer_path("piece_bpe_32k.model")
    encoded = table(spark, sf_dir, "documents").select("doc_id", pieces.encode(F.col("text"), path).alias("pieces"))
    return encoded.select(
        "doc_id",
        (F.octet_length("pieces.ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("pieces.ids", 256).alias("ids_sha256"),
        F.sha2(pieces.decode(F.col("pieces.ids"), path).cast("binary"), 256).alias("decoded_sha256"),
        F.sha2(F.concat("pieces.begins", "pieces.ends"), 256).alias("spans_sha256"),
    )


@query
def op10_packing(spark, sf_dir, path=None):
    packed = packing.pack(table(spark, sf_dir, "documents"), path or tokenizer_path("word_bpe_49k.json"))
    return packed.select(
        "doc_id",
        "start",
        (F.length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


@query
def op8_line_dedup(spark, sf_dir):
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "lines.n_lines", "lines.n_dropped", sha256("lines.kept_text").alias("kept_sha256")
    )


ORACLES["op8_line_dedup"] = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from d),
k as (
    select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
    from l
),
o as (select key, min(doc_id) as owner from k where length(key) >= 10 group by key),
r as (select k.*, coalesce(o.owner < k.doc_id, false) as gone from k left join o on k.key = o.key)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from r group by doc_id
"""


@query
def op2_secret_scan(spark, sf_dir):
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long")  # noqa: E731
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(secrets.KINDS)),
        F.sha2(secrets.span_list(base).cast("binary"), 256).alias("base_sha256"),
        secrets.span_list(F.col("secrets")).alias("spans"),
    )


@query
def op4_ngram_jaccard_join(spark, sf_dir):
    return near.near_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op4_ngram_jaccard_join"] = r"""
with recursive t as (
    select doc_id, coalesce(text, '') as text,
        list_filter(string_split_regex(coalesce(text, ''), '[ 	

]+'), lambda w: w <> '') as w
    from documents
),
r as (select text, min(doc_id) as node, count(*) as copies, any_value(w) as w from t where len(w) > 0 group by text),
s as (
    select node, unnest(list_distinct(list_transform(range(greatest(len(w) - 4, 1)), lambda k: array_to_string(w[k+1:k+5], ' ')))) as gram
    from r
),
n as (select node, count(*) as grams from s group by node),
p as (select a.node as a, b.node as b, count(*) as both from s a join s b on a.gram = b.gram and a.node <> b.node group by all),
l as (
    select a, b from p join n x on x.node = a join n y on y.node = b
    where p.both >= 0.8 * (x.grams + y.grams - p.both) - 1e-9
),
c as (select node, node as other from r union select c.node, l.b from c join l on c.other = l.a),
k as (select node, min(other) as class_id from c group by node),
m as (select l.a as node, sum(r.copies) as links from l join r on r.node = l.b group by l.a)
select t.doc_id, coalesce(k.class_id, t.doc_id) as class_id,
    case when r.node is null then 0 else coalesce(m.links, 0) + r.copies - 1 end::bigint as n_links,
    coalesce(r.copies, count(*) over (partition by t.text)) as n_copies
from t left join r on r.text = t.text left join k on k.node = r.node left join m on m.node = r.node
"""


@query
def op3_suffix_array_dedup(spark, sf_dir):
    return suffixes.repeated_passages(table(spark, sf_dir, "documents"))


ORACLES["op3_suffix_array_dedup"] = r"""
with t as (
    select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '') as w
    from documents where doc_id is not null
),
s as (select doc_id, w, unnest(range(len(w) - 49)) as a from t where len(w) >= 50),
k as (select doc_id, a, md5(array_to_string(w[a+1:a+50], ' ')) as h from s),
o as (select h, min(doc_id) as first from k group by h),
r as (select k.doc_id, a, first from k join o using (h) where first < k.doc_id),
i as (select *, case when a > coalesce(lag(a) over (partition by doc_id order by a), -100) + 50 then 1 else 0 end as new from r),
g as (select *, sum(new) over (partition by doc_id order by a rows unbounded preceding) as span from i)
select doc_id, min(a) as start_word, (max(a) + 50 - min(a))::bigint as n_words, min(first) as first_doc_id
from g group by doc_id, span
"""


@query
def op6_exact_top_k(spark, sf_dir):
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


ORACLES["op6_exact_top_k"] = """
with v as (
    select row_number() over () as row, vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e
    from embeddings
    where vec_id is not null and embedding is not null
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.row, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.row <> q.row and len(c.e) = len(q.e)
),
r as (select *, row_number() over (partition by row order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 5
"""


@query
def op5_license_scan(spark, sf_dir):
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("best_dice", F.round("best_dice", 6))


_TEMPLATES = ", ".join(
    "({}, '{}', '{}')".format(k, name, " ".join(re.findall("[0-9a-z]+", text.lower())))
    for k, (name, text) in enumerate(licences.TEMPLATES)
)
_GRAMS = "list_distinct(list_transform(range(len(w) - 1), lambda k: w[k+1] || ' ' || w[k+2]))"
ORACLES["op5_license_scan"] = f"""
with t(id, licence, words) as (values {_TEMPLATES}),
tw as (select *, string_split(words, ' ') as w from t),
tg as (select id, licence, len(w) as length, w[1] || ' ' || w[2] as head, {_GRAMS} as g from tw),
d as (
    select row_number() over () as row, doc_id,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as x
    from documents
),
l as (select row, unnest(string_split(x, chr(10))) as x, unnest(range(len(string_split(x, chr(10))))) as n from d),
lw as (select row, n, list_filter(string_split_regex(x, '[^a-z0-9]+'), lambda v: v <> '') as w from l),
filled as (select *, n - row_number() over (partition by row order by n) as paragraph from lw where len(w) > 0),
whole as (select row, flatten(list(w order by n)) as w from filled group by row),
s as (
    select row, w, null as own from filled
    union all select row, flatten(list(w order by n)), null from filled group by row, paragraph
    union all select row, w, null from whole
),
p as (
    select row, w, i, w[i] || ' ' || w[i+1] as head
    from (select row, w, unnest(range(1, len(w))) as i from whole)
),
sg as (
    select row_number() over () as segment, row, null as own, {_GRAMS} as g from s where len(w) > 1
    union all
    select -(row * 1000000 + i), row, id, g from (
        select row, i, id, {_GRAMS} as g
        from (select p.row, i, id, p.w[i : i + length - 1] as w from p join tg using (head) where i + length - 1 <= len(p.w))
    )
),
m as (
    select segment, row, licence, 2 * len(list_intersect(sg.g, tg.g)) / (len(sg.g) + len(tg.g)) as dice, id
    from sg join tg on (own is null or own = id)
        and len(sg.g) <= 1.5 * len(tg.g) + 1e-9 and len(tg.g) <= 1.5 * len(sg.g) + 1e-9
),
b as (select segment, row, first(licence order by dice desc, id) as licence, max(dice) as dice from m
    where dice >= 0.8 - 1e-12 group by segment, row)
select doc_id, licence, count(*) as n_segments, round(max(dice), 6) as best_dice
from b join d using (row) group by row, doc_id, licence
"""


_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\v\f\r]+'), lambda w: w <> '')"
ORACLES["op7_substring_dedup"] = f"""
with t as (select doc_id, {_WORDS} as w from documents),
s as (select doc_id, w, unnest(range(len(w) - 12)) as a from t where len(w) >= 13),
k as (select doc_id, a, array_to_string(w[a+1:a+13], ' ') as h from s),
o as (select h, min(doc_id) as first from k group by h),
g as (select distinct doc_id, a + unnest(range(13)) as pos from k join o using (h) where first < k.doc_id),
p as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as word from t),
j as (select p.*, g.pos is not null as gone from p left join g on g.doc_id = p.doc_id and g.pos = p.pos),
x as (
    select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by pos) filter (not gone) as kept
    from j group by doc_id
)
select t.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
    sha256(coalesce(kept, '')) as kept_sha256
from t left join x using (doc_id)
"""


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _spans_sql(kind: int, pattern: str, keep: str, group: int = 0) -> str:
    """Spans of one kind: lengths of the gaps and matches before each match."""
    p = _text(pattern)
    return f"""
    select doc_id, start, {kind} as kind, start + length(m) as stop from (
        select doc_id, ms[i] as m, parts[i] as part,
            list_sum(list_transform(gaps[1:i], lambda z: length(z)))
            + coalesce(list_sum(list_transform(ms[1:i-1], lambda z: length(z))), 0) as start
        from (
            select *, unnest(range(1, len(ms) + 1)) as i from (
                select doc_id, string_split_regex(x, {p}) as gaps, regexp_extract_all(x, {p}, 0) as ms,
                    regexp_extract_all(x, {p}, {group}) as parts
                from d
            )
        )
    ) where {keep}"""


_TERMS = "[" + ", ".join(map(str, secrets.TERMS)) + "]"
def _plain(pattern: str) -> str:
    """The pattern without the marks that forbid giving characters back."""
    return _text(pattern.replace("++", "+").replace("*+", "*").replace("}+", "}"))


# The parts of a candidate that hold no placeholder, if one does.
_PARTS = f"list_filter(string_split_regex(m, '[/_-]'), lambda p: not regexp_matches(p, {_text(secrets.PLACEHOLDER)}))"
_VALUE = (
    f"case when list_bool_or(list_transform(string_split_regex(m, '[/_-]'), "
    f"lambda p: regexp_matches(p, {_text(secrets.PLACEHOLDER)}))) then array_to_string({_PARTS}, '_') else m end"
)
_W = f"least(length(v), {secrets.WINDOW})"
_LEAST = (
    f"list_min(list_transform(range(length(v) - {_W} + 1), lambda k: list_sum(list_transform("
    f"map_values(list_aggregate(string_split(substr(v, k + 1, {_W}), ''), 'histogram')), "
    f"lambda n: {_TERMS}[n::bigint + 1]))))"
)
_MOST = "case " + " ".join(
    f"when regexp_matches(v, {_text(c.pattern)}) then "
    f"{[c.most(n) for n in range(secrets.SHORTEST, secrets.WINDOW + 1)]}[{_W} - {secrets.SHORTEST - 1}]"
    for c in secrets.CLASSES
) + " else -1 end"
_NOT_ALLOWED = " and ".join(f"not regexp_matches(v, {_plain(a)})" for a in secrets.ALLOWED)
_ENTROPY = (
    f"length(v) >= {secrets.SHORTEST} and regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') "
    f"and {_NOT_ALLOWED} and {_LEAST} <= {_MOST}"
)
_RUN = secrets.CANDIDATE[secrets.CANDIDATE.index(")") + 1 :].replace("}+", "}")
_NAMES = "['" + "', '".join(secrets.KINDS) + "']"
_LIST = f"string_agg({_NAMES}[kind + 1] || ':' || start || ':' || stop, ',' order by start, kind, stop)"
ORACLES["op2_secret_scan"] = f"""
with d as (select doc_id, coalesce(text, '') as x from documents),
c as ({_spans_sql(3, _RUN, "true")}),
s as (
    {_spans_sql(0, secrets.ASSIGN, f"length(part) >= {secrets.ASSIGN_CHARS}", 2)}
    union all {_spans_sql(1, secrets.ACCESS, f"length(m) >= {secrets.ACCESS_CHARS}")}
    union all {_spans_sql(2, secrets.HEX, f"length(m) >= {secrets.HEX_CHARS}")}
    union all select doc_id, start, kind, stop from (
        select *, {_VALUE} as v from (select *, substr(x, (start + 1)::bigint, (stop - start)::bigint) as m from c join d using (doc_id))
    ) where {_ENTROPY}
),
g as (
    select doc_id, {", ".join(f"count(*) filter (kind = {k}) as n_{name}" for k, name in enumerate(secrets.KINDS))},
        {_LIST} filter (kind < 3) as base, {_LIST} as spans
    from s group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{name}, 0) as n_{name}" for name in secrets.KINDS)},
    sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""


@query
def op11_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string")) % 4
    model = language.learn(docs.where(remainder != 2))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id",
        F.coalesce(remainder == 2, F.lit(False)).alias("held_out"),
        F.col("language.lang").alias("lang_pred"),
        "language.score",
        "language.accepted",
    )


@query
def op12_spelling_variants(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"), drop_every=31)


@query
def op13_resample(spark, sf_dir):
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.resample(docs, target).drop("n_words")


# Steps of a checksum by its low byte, from the rule; `steps` is one list of 256.
_CRC_STEPS = """crc_steps as (
    select list(list_reduce([i::ubigint] || list_transform(range(8), lambda z: 0::ubigint),
        lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) order by i) as steps
    from range(256) r(i)
)"""


def _crc(text: str) -> str:
    """Unsigned checksum of the UTF-8 bytes of a column; ``crc_steps`` must be joined."""
    return f"""xor(list_reduce([4294967295::ubigint] || list_transform(range(0, octet_length(encode({text}))),
        lambda k: ('0x' || substr(hex(encode({text})), 2 * k::int + 1, 2))::ubigint),
        lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255)::int + 1])), 4294967295::ubigint)"""


_LOWERED = f"translate(coalesce(text, ''), '{resample.UPPER}', '{resample.LOWER}')"
ORACLES["op13_resample"] = rf"""
with {_CRC_STEPS},
t as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as f from benchmark),
d as (select doc_id, unnest(w) as f from t),
n as (select f, {_crc("f")} % 10000 as bucket from (select f from d union select f from b), crc_steps),
s as (select bucket, count(*) as s from d join n using (f) group by bucket),
k as (select bucket, count(*) as t from b join n using (f) group by bucket),
g as (
    select bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((select count(*) from d) + 10000))
        / ((s + 1) * ((select count(*) from b) + 10000)))) as gain
    from s left join k using (bucket)
),
m as (
    select doc_id, floor(sum(gain) / count(*))::bigint as weight from d join n using (f) join g using (bucket) group by doc_id
),
x as (
    select doc_id, len(w)::bigint as n_features, coalesce(weight, 0) as weight,
        ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
    from t left join m using (doc_id)
),
y as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from x),
r as (
    select doc_id, row_number() over (order by score desc, doc_id) as rank from y where n_features >= 20
    qualify rank <= floor(10 * count(*) over () / 100)
)
select y.doc_id, n_features, weight, score, rank from y left join r using (doc_id)
"""

ORACLES["op12_spelling_variants"] = f"""
with recursive {_CRC_STEPS},
t as (select doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-zÀ-ÿ]+')) as run from documents),
h as (select run, {_crc("(doc_id || ':' || run)")} as h from t, crc_steps where length(run) >= 7),
c as (
    select case when h % 31 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2)
        else run end as word
    from h
),
v as (select word, count(*) as n from c where length(word) >= 7 group by word having count(*) >= 2),
k as (
    select word, n, i, substr(word, 1, i::int) || substr(word, i::int + 2) as short
    from (select *, unnest(range(length(word))) as i from v)
),
e as (
    select a.word, b.word as other from k a join k b on a.i = b.i and a.short = b.short and a.word <> b.word
    union select k.word, v.word from k join v on k.short = v.word
    union select v.word, k.word from k join v on k.short = v.word
),
m as (
    select e.word, count(*) as n_near, first(e.other order by v.n desc, e.other) as best, max(v.n) as best_n
    from e join v on v.word = e.other group by e.word
),
f as (
    select v.word, v.n, coalesce(n_near, 0) as n_near, case when best_n >= 10 * v.n then best end as form,
        case when best_n >= 10 * v.n then best_n end as form_n
    from v left join m using (word)
),
r as (
    select word, word as root, 0 as steps from f
    union all select r.word, f.form, steps + 1 from r join f on f.word = r.root where f.form is not null
),
z as (select word, arg_max(root, steps) as root from r group by word)
select f.word, form, root, n, n_near, form_n from f join z using (word)
"""
