"""Expected results in DuckDB SQL.

Results about files are computed from order keys alone (see ``corpus``): they hold no
lexer and no pattern of the queries they check. Results about names and values restate
the rule in plain SQL.
"""

from __future__ import annotations

from varscope.functions import naming
from varscope.operators.descriptions import PROMPT_HEAD, PROMPT_TAIL
from varscope.operators.reconcile import MARKER, STALE_COMMENT
from varscope.plans import corpus
from varscope.plans.queries import TYPED_SUFFIXES, typed_name_sql

NL = "chr(10)"

_FILES = corpus.layered_sql("select o_orderkey as k from orders", corpus.KEY_LAYERS)

# One row per file: whether each filter keeps it.
BASE = f"""
f as (
  select *, string_split(path, '/') as parts,
    (lang = 'docker' or ext <> '.txt') as routed,
    (lang = 'docker' or dir <> 'node_modules/') as outside,
    (lang = 'docker' or not ((dir = 'gen/' and r % 4 <> 3)
      or (dir = 'src-b/' and ext = '.go' and r % 2 = 0))) as not_ignored,
    (lang = 'docker' or not (dir = 'tests/' and r % 5 <> 4)) as not_excluded
  from ({_FILES})
),
-- One row per reference in a file of a known language.
refs as (
  select k, r, a, s, repo, path, parts, lang as language, name, outside, not_ignored, not_excluded,
    case lang when 'python' then 7 when 'javascript' then 4 when 'go' then 5 when 'shell' then 4
      else 3 end as line,
    case lang when 'python' then case f when 1 then 10 when 3 then case when k % 8 = 3 then 24 else 9 end else 4 end
      when 'javascript' then case f when 2 then 14 when 3 then 2 else 10 end
      when 'go' then case when k % 2 = 0 then 6 else 10 end else 0 end as col,
    ref_line as snippet,
    case when lang in ('python', 'docker') and valued then dv
      when lang = 'docker' and hollow then '' end as d,
    not (lang in ('python', 'docker') and (valued or hollow)) as required,
    f as form, arg1, valued
  from f where routed
  union all
  select k, r, a, s, repo, path, parts, lang, name, outside, not_ignored, not_excluded,
    case lang when 'python' then case when f = 2 and arg1 <> '' then 11 else 9 end
      when 'javascript' then 6 when 'go' then 7 else 5 end,
    case lang when 'python' then 4 when 'javascript' then 5 when 'go' then 21 else 0 end,
    again_line, null, true, 9, '', valued
  from f where routed and again and lang <> 'docker'
),
-- References a full scan visits, in reading order.
seen as (
  select *, row_number() over (partition by repo order by parts, line, col) as o
  from refs where outside and not_ignored and not_excluded
),
inv as (
  select repo, r, a, s, name, count(*) as n, min(o) as first_o, max(o) as last_o,
    bool_or(required) as required,
    coalesce(arg_min(d, o) filter (where d <> ''), first(d order by o desc)) as d,
    arg_min(language, o) as language,
    arg_min(path, o) as first_file, arg_max(path, o) as last_file,
    case s when 0 then 'URL' when 1 then 'SECRET' when 2 then 'PORT' when 3 then 'BOOLEAN'
      when 4 then 'INTEGER' else 'STRING' end as kind,
    row_number() over (partition by repo order by min(o)) as ord
  from seen group by repo, r, a, s, name
),
-- Template entries.
doc as (
  select *, (a + s) % 4 as style, row_number() over (partition by r order by a, s) as ord,
    case (a + s) % 4 when 1 then 'q # x' when 3 then 'w=1' else 'v' || a end as value,
    case (a + s) % 4 when 0 then '' when 1 then '# about ' || name when 2 then '{MARKER}'
      else '  # about ' || name end as comments,
    case when (a + s) % 4 = 2 then '# note' end as inline
  from (select distinct repo, r, a, s, name from f where {corpus.DOCUMENTED})
),
entry as (
  select repo, r, ord, name as key, value, comments, inline, style,
    style = 3 or (style = 1 and ord > 1) as blank from doc
  union all
  select repo, r, count(*) + 1, 'OLD_' || r, 'x', '', null, 0, false
  from doc where r % 3 = 0 group by repo, r
),
mrg as (
  select e.repo, 0 as side, e.ord, e.key, e.value,
    case when i.name is null then '{STALE_COMMENT}' || e.key
      || case when e.comments = '' then '' else {NL} || e.comments end
      else e.comments end as comments,
    e.inline, e.blank, case when i.name is null then 'STALE' else 'EXISTING' end as status,
    e.comments as own_comments
  from entry e left join inv i on e.repo = i.repo and e.key = i.name
  union all
  select i.repo, 1, i.ord, i.name, coalesce(i.d, ''), '{MARKER}', null, false, 'NEW', ''
  from inv i anti join entry e on e.repo = i.repo and e.key = i.name
),
ordered as (select *, row_number() over (partition by repo order by side, ord) as place from mrg),
visits as (
  select repo, count(*) filter (where outside and routed and not_ignored and not_excluded) as n
  from f group by repo
),
"""

REF_COLUMNS = (
    'repo, path, line, col as "column", name, d as default_value, required as is_required'
)

ORACLES: dict[str, str] = {}


def oracle(name: str, select: str, more: str = "") -> None:
    ctes = (BASE + more).strip().rstrip(",")
    ORACLES[name] = f"with {ctes} {select}"


# --------------------------------------------------------------------------- sources

oracle(
    "source_files",
    "select repo, path, cast(strlen(content) as int) as n_bytes, md5(content) as digest, "
    "row_number() over (partition by repo order by parts) as ord from f",
)
oracle(
    "single_file", f"select {REF_COLUMNS} from refs where path = 'node_modules/f26.py'"
)
CHANGES = """
chg as (
  select repo, r, path, 1000000000000 - k as ord, k from f where k % 29 = 0 and r % 10 <> 0
  union all
  select repo, r, path, 2000000000000 - k, k from f where k % 58 = 0 and r % 10 <> 0
),
"""
oracle(
    "staged_files",
    "select c.repo, c.path, f.lang as language, c.ord from chg c join f on f.k = c.k where f.routed",
    CHANGES,
)
oracle(
    "staged_refs",
    f"select {', '.join('p.' + c.strip() for c in REF_COLUMNS.split(','))}, c.ord from chg c join refs p on p.k = c.k",
    CHANGES,
)
oracle(
    "staged_result",
    """select repo, count(*) as scanned_files, any_value(coalesce(found, 0)) as found,
         count(*) filter (where k % 71 = 0) as errors
       from (select c.repo, f.k from chg c join f on f.k = c.k where f.routed)
       left join (select c.repo, count(distinct name) as found from chg c join refs p on p.k = c.k
         where p.k % 71 <> 0 group by c.repo) using (repo)
       group by repo""",
    CHANGES,
)
oracle(
    "template_source",
    """select repo, max(has) = 1 as has_template, cast(sum(n) as int) as n_lines from (
         select distinct repo, 0 as has, 0 as n from f
         union all
         select repo, 1, case style when 0 then 1 when 1 then 3 when 2 then 2 else 6 end from entry
       ) group by repo""",
)
oracle(
    "config_precedence",
    """select distinct repo,
         case when r % 2 = 0 and r % 3 <> 0 then case when r % 8 = 2 then '' else 'tests/,d' || r end
           when r % 4 < 3 then 'p' || r else '' end as exclude,
         case when r % 2 = 0 and r % 3 <> 0 then
             case when r % 8 = 2 then '.env.example' else 'env' || r end
           when r % 4 < 3 then 'proj' || r else '.env.example' end as output
       from f""",
)
oracle(
    "cache_load",
    "select 'key' || k as key, 'd' || k as description, 'e' as example from f where k % 4 = 0",
)

# ----------------------------------------------------------------------------- paths

oracle("default_dir_filter", "select repo, path from f where outside")
oracle("ignore_filter", "select repo, path from f where not_ignored")
oracle("exclude_filter", "select repo, path from f where not_excluded")
oracle(
    "extension_filter",
    "select repo, path from f where (lang <> 'docker' and ext in ('.py', '.ts')) "
    "or (lang = 'docker' and k % 3 = 1)",
)
oracle(
    "suffix_projection",
    """select path, case when dot > 1 and dot < length(base) then base[dot:] else '' end as suffix
       from (select path, base, length(base) - strpos(reverse(base), '.') + 1 as dot from (
         select path, string_split(path, '/')[-1] as base from (
           select case k % 5 when 0 then path when 1 then 'a.b/.hid' || ks
             when 2 then 'x.tar.S' || ks when 3 then 'foo' || ks || '.'
             else 'dir.d/f' || ks end as path from f)) where strpos(base, '.') > 0
         union all
         select path, base, 0 from (select 'dir.d/f' || ks as path, 'f' || ks as base, k from f
           where k % 5 = 4
           union all select path, parts[-1], k from f where k % 5 = 0 and strpos(parts[-1], '.') = 0))""",
)
oracle(
    "route_language",
    "select repo, path, case when routed then lang end as language from f",
)
oracle("supported_files", "select repo, path, lang as language from f where routed")
oracle(
    "relative_path",
    """select '/w/' || repo || '/' || path as path,
         case k % 3 when 0 then '/w/' || repo when 1 then '/w/' || repo || '/' || path
           else '/other' end as root,
         case k % 3 when 0 then path when 1 then '.' else parts[-1] end as relative from f""",
)
oracle(
    "line_split",
    """select k, 0 as line, 'a' as text from f
       union all select k, 1, 'b' from f where k % 3 <> 0""",
)

# ------------------------------------------------------------------------ extraction

oracle(
    "lexical_mask",
    'select repo, path, language, line, col as "column", name from refs',
)
for _name, _where in (
    ("py_getenv", "language = 'python' and (form in (0, 3) or (form = 2 and arg1 <> ''))"),
    ("py_environ_get", "language = 'python' and form = 1"),
    ("py_environ_subscript",
     "language = 'python' and (form = 9 or (form = 2 and arg1 = ''))"),
    ("py_defaults", "language = 'python'"),
    ("js_member", "language = 'javascript' and form <> 1"),
    ("js_subscript", "language = 'javascript' and form = 1"),
    ("go_getenv", "language = 'go'"),
    ("shell_refs", "language = 'shell'"),
    ("docker_env",
     "language = 'docker' and ((valued and form in (0, 2)) or (not valued and k % 41 <> 0 and k % 2 = 0))"),
    ("docker_arg",
     "language = 'docker' and ((valued and form in (1, 3)) or (not valued and (k % 41 = 0 or k % 2 = 1)))"),
):
    oracle(_name, f"select {REF_COLUMNS} from refs where {_where}")
oracle(
    "shell_specials",
    """select k, name, name in ('_', '7', '#') as special from (
         select k, case k % 7 when 0 then '_' when 1 then 'A' when 2 then '7' when 3 then '__'
           when 4 then '#' when 5 then '12' else name end as name from f)""",
)
oracle(
    "shell_locals",
    "select repo, path, 'LOC' as locals from f where routed and lang = 'shell'",
)
oracle(
    "docker_unquote",
    """select k, case k % 6 when 0 then name when 1 then name when 2 then '"' || name || ''''
         when 3 then '"' when 4 then '' else name || '"' end as value from f""",
)
oracle("ref_locations", 'select repo, path, name, line, col as "column", snippet from refs')
oracle(
    "custom_language",
    """select 'ruby' as language, repo, 'lib/f' || k || '.rb' as path, 3 as line,
         case k % 3 when 1 then 6 else 4 end as "column", name,
         case when k % 3 = 1 then 'r' || (k % 5) end as default_value,
         k % 3 <> 1 as is_required from f""",
)
oracle(
    "custom_line_language",
    """select 'make' as language, repo, 'build/f' || k || case when k % 2 = 0 then '.mk' else '/Makefile' end as path,
         unnest([2, 3]) as line, 0 as "column", name, null::varchar as default_value, true as is_required from f
       union all
       select 'unit', repo, 'unit/f' || k || '.unit', 2, 0, name, case when k % 3 <> 0 then 'd' || (k % 5) end, k % 3 = 0
       from f""",
)
oracle(
    "prose_controls",
    """select 'documents' as repo, count(*) as n_texts, 0 as n_refs from documents
       union all select 'pages', count(*), 0 from pages
       union all select 'conversations', count(*), 0 from conversations""",
)

# ----------------------------------------------------------------------- aggregation

oracle(
    "file_findings",
    """select repo, path, language, name, bool_or(required) as is_required,
         coalesce(arg_min(d, line) filter (where d <> ''), first(d order by line desc)) as default_value,
         string_agg(line || ':' || col, ',' order by line) as places
       from refs group by repo, path, language, name""",
)
oracle(
    "inventory",
    """select repo, name, kind as inferred_type, required as is_required, d as default_value,
         language, n as n_locations, first_file, last_file from inv""",
)
oracle("required_fold", "select repo, name, required as is_required from inv")
oracle("default_fold", "select repo, name, d as default_value from inv")
oracle("first_language", "select repo, name, language, kind as inferred_type from inv")
oracle("inventory_order", "select repo, ord, name from inv")
oracle("scanned_files", "select repo, n as scanned_files from visits where n > 0")
oracle(
    "scan_errors",
    "select repo, path, 'File not found: ' || path as error from f where routed and k % 71 = 0",
)
KEPT = "outside and routed and not_ignored and not_excluded"
oracle(
    "scan_summary",
    f"""select repo, scanned_files, coalesce(found, 0) as found, errors from (
          select repo, count(*) as scanned_files, count(*) filter (where k % 71 = 0) as errors
          from f where {KEPT} group by repo)
        left join (select repo, count(distinct name) as found from seen where k % 71 <> 0
          group by repo) using (repo)""",
)

# ---------------------------------------------------------------------- names, rules


# The type rules once more, as endings of the upper-cased name in plain order: a wrong entry of
# the engine's own tables shows here.
_ENDS = """regexp_matches(u, '{0}$')"""
_SCAN_TYPE = "case " + " ".join(
    f"when {_ENDS.format(pattern)} then '{kind}'"
    for pattern, kind in (
        ("(^|_)(URL|URI|DSN|ENDPOINT)", "URL"),
        ("(^|_)(KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|CREDENTIALS|CERT|PRIVATE)", "SECRET"),
        ("(^|_)PORT", "PORT"),
        ("(DEBUG|VERBOSE|(^|_)(ENABLED|DISABLED|FLAG|ACTIVE))", "BOOLEAN"),
        ("(^|_)(TIMEOUT|RETRIES|MAX|MIN|COUNT|SIZE|LIMIT|TTL|INTERVAL)", "INTEGER"),
    )
) + " else 'STRING' end"
_NAME_TYPE = "case " + " ".join(
    f"when {_ENDS.format(pattern)} then '{kind}'"
    for pattern, kind in (
        ("(^|_)(URL|URI)", "URL"),
        ("(^|_)(KEY|TOKEN|SECRET|PASSWORD|PASSWD|PASS|PRIVATE)", "SECRET"),
        ("(^|_)PORT", "INTEGER"),
        ("(^|_)HOST", "STRING"),
        ("(^|_)(ENABLED|DISABLED|FLAG|ACTIVE)|^(DEBUG|VERBOSE)", "BOOLEAN"),
    )
) + " else 'STRING' end"


TYPED = f"typed as (select k, {typed_name_sql()} as name from f), "
TYPED_UPPER = TYPED + "tu as (select k, name, upper(name) as u from typed), "
oracle(
    "infer_type",
    "select k, name, case when u in ('DEBUG', 'VERBOSE') then 'BOOLEAN' when u = 'PORT' then 'PORT' "
    f"else {_SCAN_TYPE} end as inferred_type from tu",
    TYPED_UPPER,
)
oracle(
    "infer_type_name_only",
    f"select k, name, {_NAME_TYPE} as inferred_type from tu",
    TYPED_UPPER,
)


def _values(rows) -> str:
    quoted = (
        "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows
    )
    return "(values " + ", ".join(quoted) + ")"


def _describe_sql(source: str, extra: str) -> str:
    """Descriptions of upper-case names made of one-case words (title case by hand)."""
    title = (
        "array_to_string(list_transform(string_split({0}, '_'), lambda w: "
        "upper(w[1:1]) || lower(w[2:])), ' ')"
    )
    return f"""
    select {extra}, name,
      coalesce(k_desc, replace(replace(w_desc, '{{service}}', {title.format('stem')}), '{{slug}}',
        replace(lower(stem), '_', '-')), {title.format('name')} || ' configuration value') as description,
      coalesce(k_ex, replace(w_ex, '{{slug}}', replace(lower(stem), '_', '-')), '') as example
    from (select *, case when strpos(name, '_') > 0 then string_split(upper(name), '_')[-1] end as word,
            left(name, length(name) - length(string_split(name, '_')[-1]) - 1) as stem from {source})
    left join {_values(naming.KNOWN_NAMES)} kn(k_name, k_desc, k_ex) on upper(name) = k_name
    left join {_values(naming.LAST_WORDS)} lw(w_name, w_desc, w_ex) on word = w_name
    """


oracle(
    "describe_rules",
    _describe_sql("typed", "k"),
    TYPED,
)
oracle(
    "service_titles",
    """select k, 'S' || a || 'Bucket V2Api ' || ks || 'X' as title,
         's' || a || 'bucket-v2api-' || ks || 'x' as slug from f""",
)

# ------------------------------------------------------------------------- templates

oracle(
    "template_lines",
    """select repo, row_number() over (partition by repo order by ord, place) as line, kind from (
         select repo, ord, unnest(kinds) as kind, unnest(range(len(kinds))) as place from (
           select repo, ord, case style when 0 then ['key'] when 1 then ['blank', 'comment', 'key']
             when 2 then ['comment', 'key'] else ['blank', 'comment', 'blank', 'comment', 'other', 'key'] end as kinds
           from entry))""",
)
oracle("template_kv", "select repo, ord, key from entry")
oracle("template_values", "select repo, key, value, inline as inline_comment from entry")
oracle("template_comments", "select repo, key, comments from entry")
oracle("template_blanks", "select repo, key, blank as blank_line_before from entry")

# -------------------------------------------------------------------- reconciliation

oracle("merge_existing", "select repo, key, value from mrg where status = 'EXISTING'")
oracle("merge_stale", "select repo, key, value, comments from mrg where status = 'STALE'")
oracle(
    "merge_new",
    "select repo, key, value, comments, blank as blank_line_before from mrg where status = 'NEW'",
)
oracle(
    "merged",
    "select repo, place as ord, key, status, value, comments, blank as blank_line_before from ordered",
)
oracle(
    "diff_arrays",
    "select repo, status, key, row_number() over (partition by repo, status order by place) as ord "
    "from ordered",
)
UNDESCRIBED = f"""
wanted as (
  select m.repo, i.r, i.a, i.s, key as name, status = 'EXISTING' as existing, i.d, i.first_o
  from mrg m join inv i on m.repo = i.repo and m.key = i.name
  where status = 'NEW' or (status = 'EXISTING' and own_comments in ('', '{MARKER}'))
),
"""
oracle("undescribed", "select repo, name, existing from wanted", UNDESCRIBED)
DESCRIBED = UNDESCRIBED + f"""
texts as ({_describe_sql("wanted", "repo")}),
described as (
  select o.repo, place, key, status, value, inline, blank,
    case when t.name is null then comments
      else '{MARKER}' || {NL} || '#' || {NL} || '# Description: ' || description || {NL}
        || case when example = '' then '' else '# Example:     ' || example || {NL} end || '#'
      end as comments
  from ordered o left join texts t on o.repo = t.repo and o.key = t.name
),
"""
oracle("described_entries", "select repo, key, status, comments from described", DESCRIBED)
oracle(
    "render_template",
    f"""select repo, place as ord,
          case when blank and place > 1 then {NL} else '' end
          || case when comments = '' then '' else comments || {NL} end
          || key || '=' || value || case when inline is null then '' else ' ' || inline end as text
        from described""",
    DESCRIBED,
)

ORACLES["sinks"] = f"""
select repo, row_number() over (partition by repo order by ord, place) as ord, text from (
  select repo, ord, unnest(string_split(text, {NL})) as text, unnest(range(len(string_split(text, {NL})))) as place
  from ({ORACLES["render_template"]}))
"""
oracle(
    "generate_configured",
    f"""select repo, place as ord,
          case when blank and place > 1 then {NL} else '' end
          || case when comments = '' then '' else comments || {NL} end
          || key || '=' || value || case when inline is null then '' else ' ' || inline end as text
        from ordered""",
)
# -------------------------------------------------------------------------- verdicts

VERDICT = """
verdict as (
  select v.repo, v.n as scanned_files,
    count(*) filter (where status = 'NEW') as n_new,
    count(*) filter (where status = 'STALE') as n_stale,
    coalesce(string_agg(key, ',' order by place) filter (where status = 'NEW'), '') as new_vars,
    coalesce(string_agg(key, ',' order by place) filter (where status = 'STALE'), '') as stale_vars
  from visits v left join ordered o on v.repo = o.repo group by v.repo, v.n
),
"""
oracle(
    "check",
    """select repo, case when n_new > 0 then 'fail' else 'pass' end as status,
         case when n_new > 0 then 1 else 0 end as exit_code, n_new, n_stale, scanned_files,
         case when n_new > 0 then 1 when n_stale > 0 then 2 else 0 end as strict_exit_code
       from verdict""",
    VERDICT,
)
oracle(
    "check_configured",
    """select repo, case when n_new > 0 then 'fail' else 'pass' end as status,
         case when n_new > 0 then 1 when n_stale > 0 then 2 else 0 end as exit_code, n_new, n_stale, scanned_files
       from verdict""",
    VERDICT,
)
oracle(
    "check_stale",
    """select repo, case when n_new > 0 then 'fail' else 'pass' end as status,
         case when n_new > 0 then 1 when n_stale > 0 then 2 else 0 end as exit_code, n_new, n_stale, scanned_files
       from verdict""",
    VERDICT,
)
oracle(
    "check_json",
    """select repo, row_number() over (partition by repo order by section, place) as ord, text from (
         select repo, 0 as section, 0 as place, '{"status": "' || case when n_new > 0 then 'fail'
           else 'pass' end || '", "new_vars": [' as text from verdict
         union all select repo, 2, 0, '], "stale_vars": [' from verdict
         union all select repo, 4, 0, '], "scanned_files": ' || scanned_files || '}' from verdict
         union all select repo, case status when 'NEW' then 1 else 3 end, place,
           '"' || key || '"' || case when place = max(place) over (partition by repo, status)
             then '' else ',' end
           from ordered where status <> 'EXISTING')""",
    VERDICT,
)
oracle(
    "check_changes",
    """select repo, cast(max(bad) as int) as exit_code from (
         select distinct repo, 0 as bad from f
         union all
         select p.repo, 1 from (
           select repo, name from refs where k % 29 = 0 and r % 10 <> 0
           union all
           select repo, name from seen where repo not in (
             select repo from f where k % 29 = 0 and r % 10 <> 0)) p
         anti join entry e on e.repo = p.repo and e.key = p.name)
       group by repo""",
)
oracle(
    "check_stream",
    """select distinct p.repo, p.name from refs p anti join entry e
       on e.repo = p.repo and e.key = p.name""",
)
ORACLES["check_stream_events"] = ORACLES["check_stream"]
oracle(
    "drift_outputs",
    """select v.repo, list, ord, name, scanned_files, n_new > 0 as drift_detected
       from verdict v left join (
         select repo, list, unnest(range(1, len(names) + 1)) as ord, unnest(names) as name from (
           select repo, 'new_vars' as list, string_split(new_vars, ',') as names from verdict where new_vars <> ''
           union all
           select repo, 'stale_vars', string_split(stale_vars, ',') from verdict where stale_vars <> '')) n
       on v.repo = n.repo""",
    VERDICT,
)

# ---------------------------------------------------------------------- descriptions

oracle(
    "scrub_snippets",
    """select repo, path, line,
         case when valued and language = 'python' and form in (0, 1, 3)
           then replace(replace(snippet, ', "' || d || '"', ''), ', ''' || d || '''', '')
           else snippet end as scrubbed from refs""",
)
KEYS = """
keys as (
  select s.repo, s.name, any_value(i.a) as a,
    sha256(s.name || ':' || string_agg(s.snippet, ':' order by s.snippet) || ':'
      || coalesce(any_value(i.d), chr(0) || 'none' || chr(0))) as key
  from seen s join inv i on s.repo = i.repo and s.name = i.name group by s.repo, s.name
),
"""
oracle("cache_keys", "select repo, name, key from keys", KEYS)
BATCHES = UNDESCRIBED + KEYS + """
miss as (
  select *, (ord - 1) // 20 as b, repo || ':' || ((ord - 1) // 20) as batch_id from (
    select *, row_number() over (partition by repo order by existing, first_o) as ord
    from wanted where a not in (0, 4, 8))
),
said as (
  select repo, name,
    case when a in (1, 5, 9) then 'said ' || name else 'only' end as description,
    case when a in (1, 5, 9) then 'se' else '' end as example
  from miss where a in (1, 5, 9, 2, 6, 10) and b % 3 <> 2
),
"""
oracle(
    "cache_hits",
    """select repo, name, case when a in (0, 4, 8) then 'cached ' || name end as description,
         case when a in (0, 4, 8) then 'ce' end as example from wanted""",
    UNDESCRIBED,
)
oracle("prompt_batches", "select repo, name, ord, batch_id from miss", BATCHES)


def _text(lines) -> str:
    return f" || {NL} || ".join("'" + line.replace("'", "''") + "'" for line in lines)


oracle(
    "prompts",
    f"""select m.repo, batch_id, {_text(PROMPT_HEAD)} || {NL}
          || string_agg('  ' || m.name || ' — seen in: ' || seen_in, {NL} order by ord)
          || {NL} || {_text(PROMPT_TAIL)} as prompt
        from miss m join (
          select repo, name, string_agg(scrubbed, '; ' order by o) as seen_in from (
            select repo, name, o, case when valued and language = 'python' and form in (0, 1, 3)
              then replace(replace(snippet, ', "' || d || '"', ''), ', ''' || d || '''', '')
              else snippet end as scrubbed,
              row_number() over (partition by repo, name order by o) as nth from seen)
          where nth <= 3 group by repo, name) using (repo, name)
        group by m.repo, batch_id""",
    BATCHES,
)
oracle("parse_responses", "select repo, name, description, example from said", BATCHES)
oracle(
    "resolve_descriptions",
    """select w.repo, w.name,
         case when w.a in (0, 4, 8) then 'cached ' || w.name
           else coalesce(said.description, t.description) end as description,
         case when w.a in (0, 4, 8) then 'ce'
           else coalesce(said.example, t.example) end as example,
         case when w.a in (0, 4, 8) then 'cache' when said.name is not null then 'response'
           else 'rule' end as origin
       from wanted w
       join texts t on w.repo = t.repo and w.name = t.name
       left join said on w.repo = said.repo and w.name = said.name""",
    BATCHES + f"texts as ({_describe_sql('wanted', 'repo')}),",
)
oracle(
    "generate_described",
    f"""select o.repo, place as ord,
          case when blank and place > 1 then {NL} else '' end
          || case when w.name is not null then '{MARKER}' || {NL} || '#' || {NL} || '# Description: ' || w.description
              || {NL} || case when w.example = '' then '' else '# Example:     ' || w.example || {NL} end || '#' || {NL}
            when comments = '' then '' else comments || {NL} end
          || o.key || '=' || value || case when inline is null then '' else ' ' || inline end as text
        from ordered o left join (
          select w.repo, w.name,
            case when w.a in (0, 4, 8) then 'cached ' || w.name
              else coalesce(said.description, t.description) end as description,
            case when w.a in (0, 4, 8) then 'ce' else coalesce(said.example, t.example) end as example
          from wanted w
          join texts t on w.repo = t.repo and w.name = t.name
          left join said on w.repo = said.repo and w.name = said.name) w
        on o.repo = w.repo and o.key = w.name""",
    BATCHES + f"texts as ({_describe_sql('wanted', 'repo')}),",
)
oracle(
    "cache_upsert",
    """select distinct key, description, example from (
         select key, 'cached ' || name as description, 'ce' as example from keys where a in (0, 4, 8)
         union all
         select key, description, example from said join keys using (repo, name))""",
    BATCHES,
)

oracle(
    "cache_store",
    """select 'key' || k as key, case when k % 100 = 7 then 'last ' when k % 200 = 3 then 'newer '
         when k % 100 = 3 then 'new ' else 'old ' end || name as description, 'e' as example from f""",
)

# --------------------------------------------------------------------------- reports

REPORT = """
seen2 as (select *, row_number() over (partition by repo, name order by o) as nth,
            count(*) over (partition by repo, name) as total from seen where k % 71 <> 0),
inv2 as (
  select repo, s, name, min(o) as first_o, bool_or(required) as required,
    coalesce(arg_min(d, o) filter (where d <> ''), first(d order by o desc)) as d,
    arg_min(language, o) as language,
    case s when 0 then 'URL' when 1 then 'SECRET' when 2 then 'PORT' when 3 then 'BOOLEAN'
      when 4 then 'INTEGER' else 'STRING' end as kind
  from seen2 group by repo, s, name
),
"""
oracle(
    "report_json",
    f"""select repo, row_number() over (partition by repo order by section, first_o, part, o) as ord, text
        from (
          select v.repo, 0 as section, 0 as first_o, 0 as part, 0 as o,
            '{{' || {NL} || '  "findings": [' || case when exists (
              select 1 from inv2 i where i.repo = v.repo) then '' else '],' end as text from visits v where n > 0
          union all
          select repo, 1, first_o, 0, 0, '    {{' || {NL} || '      "name": "' || name || '",' || {NL}
            || '      "inferred_type": "' || kind || '",' || {NL}
            || '      "is_required": ' || case when required then 'true' else 'false' end || ',' || {NL}
            || '      "default_value": ' || coalesce('"' || d || '"', 'null') || ',' || {NL}
            || '      "language": "' || language || '",' || {NL} || '      "locations": ['
          from inv2
          union all
          select s.repo, 1, i.first_o, 1, s.o, '        {{' || {NL} || '          "file": "' || path || '",'
            || {NL} || '          "line": ' || line || ',' || {NL} || '          "column": ' || col || ','
            || {NL} || '          "snippet": "'
            || replace(replace(snippet, '"', chr(92) || '"'), chr(9), chr(92) || 't')
            || '"' || {NL} || '        }}' || case when nth = total then '' else ',' end
          from seen2 s join inv2 i on s.repo = i.repo and s.name = i.name
          union all
          select repo, 1, first_o, 2, 0, '      ]' || {NL} || '    }}' || case when first_o = max(first_o)
            over (partition by repo) then '' else ',' end from inv2
          union all
          select v.repo, 2, 0, 0, 0, case when exists (select 1 from inv2 i where i.repo = v.repo)
            then '  ],' || {NL} else '' end || '  "scanned_files": ' || n || ',' || {NL} || '  "errors": ['
            || case when exists (select 1 from f where f.repo = v.repo and {KEPT} and k % 71 = 0)
              then '' else ']' || {NL} || '}}' end from visits v where n > 0
          union all
          select repo, 3, 0, 0, nth, '    "File not found: ' || path || '"'
            || case when nth = total then '' else ',' end
          from (select repo, path, row_number() over (partition by repo order by parts) as nth,
                  count(*) over (partition by repo) as total from f where {KEPT} and k % 71 = 0)
          union all
          select distinct repo, 4, 0, 0, 0, '  ]' || {NL} || '}}' from f where {KEPT} and k % 71 = 0)""",
    REPORT,
)
oracle(
    "report_markdown",
    f"""select repo, row_number() over (partition by repo order by section, first_o, part, o) as ord, text
        from (
          select distinct repo, 0 as section, 0 as first_o, 0 as part, 0 as o,
            '| Name | Type | Required | Default | Locations |' || {NL}
            || '| --- | --- | --- | --- | --- |' || {NL} as text from f
          union all
          select repo, 1, first_o, 0, 0, '| ' || name || ' | ' || kind || ' | '
            || case when required then 'yes' else 'no' end || ' | ' || coalesce(d, '') || ' | ' from inv
          union all
          select s.repo, 1, i.first_o, 1, min(s.o), case when min(s.o) = i.first_o then '' else '<br>' end
            || string_agg(path || ':' || line, '<br>' order by line)
          from seen s join inv i on s.repo = i.repo and s.name = i.name group by s.repo, i.first_o, path
          union all
          select repo, 1, first_o, 2, 0, ' |' || {NL} from inv)""",
)

assert len(TYPED_SUFFIXES) > 30
