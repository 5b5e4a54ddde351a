"""DuckDB twin of the job-renaming chain (N family).

One CTE pipeline per version (``V2`` / ``V1``) rebuilds the jobs adapter and
the inline rule tables, then parses, matches, numbers and validates with
DuckDB list functions; each N key selects its columns from the last CTE.
"""

from __future__ import annotations

from pipelens.functions import names as N
from pipelens.sources import driver_tables as D


def _lit(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(_lit(v) for v in vals) + "]"


def _pick(vals, idx: str) -> str:
    return f"({_list(vals)})[({idx}) % {len(vals)} + 1]"


def _values(rows) -> str:
    return ", ".join("(" + ", ".join([str(i)] + [_lit(x) for x in r]) + ")"
                     for i, r in enumerate(rows))


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)


def clean(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


SKIP = _list(N.SCHEDULE_TOKENS + N.NOISE_TOKENS)


def cands(name: str, extra: str | None = None) -> str:
    extra_cond = f" AND c <> {extra}" if extra else ""
    return (f"list_filter(list_transform(string_split({name}, '_')[2:], lambda t: {clean('t')}), "
            f"lambda c: c <> '' AND NOT list_contains({SKIP}, c) AND length(c) >= 3{extra_cond})[1:2]")


def category(name: str) -> str:
    up = f"list_transform(string_split({name}, '_'), lambda t: upper(t))"
    parts = " ".join(f"WHEN list_has_any({up}, {_list(m)}) THEN {_lit(c)}"
                     for c, m in N.CATEGORY_MARKERS)
    return f"(CASE {parts} ELSE 'other' END)"


def _fmt(template: str, **cols: str) -> str:
    out = []
    rest = template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        i = rest.find("{")
        if i < 0:
            out.append(_lit(rest.replace("\0", "{").replace("\1", "}")))
            break
        if i:
            out.append(_lit(rest[:i].replace("\0", "{").replace("\1", "}")))
        j = rest.index("}", i)
        out.append(f"CAST({cols[rest[i + 1:j]]} AS VARCHAR)")
        rest = rest[j + 1:]
    return "(" + " || ".join(out) + ")"


JOB_TYPE = "CASE o_orderpriority " + " ".join(
    f"WHEN {_lit(p)} THEN {_lit(t)}" for p, t in D.PRIORITY_JOB_TYPES) + " END"

JOBS = f"""
jobs AS (
  SELECT o_orderkey AS input_order,
         {strip("coalesce(concat_ws('_', " + _pick(D.NAME_HEADS, 'o_orderkey') + ", "
                + _pick(D.NAME_SCHEDULES, 'o_orderkey // 10') + ", "
                + _pick(D.NAME_BODIES, 'o_orderkey // 90') + ", nullif("
                + _pick(D.NAME_TAILS, 'o_orderkey // 990') + ", '')), '')")} AS job_name,
         {strip("coalesce(" + JOB_TYPE + ", '')")} AS job_type,
         {strip("coalesce(" + _pick(D.APPLICATION_NAMES, 'o_custkey') + ", '')")} AS application_name
  FROM orders)"""


def _kv(name: str, rows) -> str:
    return f"""
{name} AS (
  SELECT upper({strip('o')}) AS k, arg_max(upper({strip('v')}), ord) AS v
  FROM (VALUES {_values(rows)}) t(ord, o, v) GROUP BY 1)"""


RULES = ",".join([
    _kv("r_app", D.RULES_APP), _kv("r_sched", D.RULES_SCHEDULE), _kv("r_ast", D.RULES_AS_TYPE),
    _kv("r_etl", D.RULES_ETL),
    f"""
subj AS (
  SELECT ord AS rule_order, lower({strip('mt')}) AS match_type, {strip('pat')} AS pattern,
         upper({strip('code')}) AS subject_code, lower({strip('cat')}) AS category,
         {cands(strip('pat'))} AS strip
  FROM (VALUES {_values(D.RULES_SUBJECT)}) t(ord, pat, mt, code, cat)),
r_exact AS (
  SELECT upper(pattern) AS k,
         arg_max({{'subject_code': subject_code, 'category': category, 'strip': strip}}, rule_order) AS t
  FROM subj WHERE match_type = 'exact' GROUP BY 1),
r_prefix AS (
  SELECT upper(pattern) AS k, length(pattern) AS plen,
         arg_min({{'subject_code': subject_code, 'category': category, 'strip': strip}}, rule_order) AS t
  FROM subj WHERE match_type = 'prefix' GROUP BY 1, 2),
r_regex AS (
  SELECT rule_order, pattern,
         {{'subject_code': subject_code, 'category': category, 'strip': []::VARCHAR[]}} AS t
  FROM subj WHERE match_type = 'regex')"""])


def _parse(version: int) -> str:
    if version >= 2:
        tk = ("CASE WHEN upper(raw_tk[1]) IN ('P', 'PR') THEN raw_tk[2:] "
              "WHEN starts_with(upper(raw_tk[1]), 'P-') THEN "
              "CASE WHEN substr(raw_tk[1], 3) = '' THEN raw_tk[2:] "
              "ELSE list_concat([substr(raw_tk[1], 3)], raw_tk[2:]) END ELSE raw_tk END")
    else:
        tk = "raw_tk"
    return f"""
p0 AS (SELECT *, string_split(job_name, '_') AS raw_tk FROM jobs),
p1 AS (SELECT *, (len(raw_tk) = 0 OR raw_tk[1] = '') AS empty_name, {tk} AS tk FROM p0),
p2 AS (SELECT *, len(tk) AS n, upper(tk[2]) AS t1, upper(tk[-1]) AS lastt,
              (NOT empty_name AND len(tk) >= 2) AS two FROM p1),
parsed AS (
  SELECT *,
    CASE WHEN empty_name OR n = 0 THEN '' ELSE upper(tk[1]) END AS app_prefix,
    CASE WHEN NOT two THEN '' WHEN starts_with(t1, 'ZZZ') THEN substr(t1, 4, 1) ELSE t1 END
      AS schedule_token,
    CASE WHEN two AND n > 2 AND lastt IN {tuple(N.OLD_TYPE_SUFFIXES)} THEN lastt ELSE '' END
      AS type_suffix,
    CASE WHEN NOT two THEN ''
         WHEN n > 2 AND lastt IN {tuple(N.OLD_TYPE_SUFFIXES)} THEN array_to_string(tk[3:-2], '_')
         ELSE array_to_string(tk[3:], '_') END AS suffix_body,
    coalesce(two AND starts_with(t1, 'ZZZ'), false) AS is_zzz
  FROM p2)"""


def _lookups(src: str) -> str:
    return f"""
looked AS (
  SELECT s.*, sc.v AS sched_raw, coalesce(sc.v, '') <> '' AS sched_hit,
         atp.v AS ast_raw, coalesce(atp.v, '') <> '' AS ast_hit,
         et.v AS etl_raw, coalesce(et.v, '') <> '' AS etl_hit,
         CASE WHEN coalesce(sc.v, '') <> '' THEN sc.v ELSE 'D' END AS schedule,
         CASE WHEN coalesce(atp.v, '') <> '' THEN atp.v ELSE 'C' END AS as_job_type,
         CASE WHEN coalesce(et.v, '') <> '' THEN et.v ELSE 'C' END AS etl_type
  FROM {src} s
  LEFT JOIN r_sched sc ON sc.k = upper(s.schedule_token)
  LEFT JOIN r_ast atp ON atp.k = upper(s.job_type)
  LEFT JOIN r_etl et ON et.k = upper(s.type_suffix)),
tiers AS (
  SELECT l.*, ex.t AS t_exact,
         (SELECT arg_max(p.t, p.plen) FROM r_prefix p WHERE starts_with(upper(l.job_name), p.k)) AS t_prefix,
         (SELECT arg_min(r.t, r.rule_order) FROM r_regex r
           WHERE regexp_matches(l.job_name, r.pattern, 'i')) AS t_regex
  FROM looked l LEFT JOIN r_exact ex ON ex.k = upper(l.job_name))"""


VIOLATIONS = "list_filter([" + ", ".join([
    f"CASE WHEN NOT regexp_full_match(app_code, '[A-Z0-9]{{5}}') THEN {_fmt(N.VIOLATION_APP, app_code='app_code')} END",
    f"CASE WHEN NOT regexp_full_match(instance, '[A-Z0-9]{{3}}') THEN {_fmt(N.VIOLATION_INSTANCE, instance='instance')} END",
    f"CASE WHEN schedule NOT IN {tuple(N.ALLOWED_SCHEDULES)} THEN {_fmt(N.VIOLATION_SCHEDULE, schedule='schedule')} END",
    f"CASE WHEN as_job_type NOT IN {tuple(N.ALLOWED_AS_TYPES)} THEN {_fmt(N.VIOLATION_AS_TYPE, as_job_type='as_job_type')} END",
    f"CASE WHEN NOT regexp_full_match(subject_code, '[A-Z0-9]{{6}}') THEN {_fmt(N.VIOLATION_SUBJECT, subject_code='subject_code')} END",
    f"CASE WHEN etl_type NOT IN {tuple(N.ALLOWED_ETL_TYPES)} THEN {_fmt(N.VIOLATION_ETL, etl_type='etl_type')} END",
    f"CASE WHEN NOT regexp_full_match(job_id, '[0-9]{{4}}') THEN {_fmt(N.VIOLATION_ID, job_id='job_id_num')} END",
    f"CASE WHEN length(new_job_name) > {N.MAX_NAME_LEN} THEN {_fmt(N.VIOLATION_LENGTH, length='length(new_job_name)')} END",
    f"CASE WHEN regexp_matches(upper(new_job_name), '[^A-Z0-9_]') THEN {_lit(N.VIOLATION_CHARS)} END",
]) + "], lambda x: x IS NOT NULL)"

ZFILL = ("CASE WHEN length(CAST(job_id_num AS VARCHAR)) < 4 THEN lpad(CAST(job_id_num AS VARCHAR), 4, '0') "
         "ELSE CAST(job_id_num AS VARCHAR) END")

NAME = ("upper(rpad(app_code, 5, 'X')) || '_' || upper(rpad(instance, 3, 'X')) || upper(rpad(env, 1, 'X')) "
        "|| upper(rpad(schedule, 1, 'X')) || upper(rpad(as_job_type, 1, 'X')) || '_' "
        "|| upper(rpad(subject_code, 6, 'X')) || '_' || upper(etl_type) || job_id")


def _finish(src: str, notes: list[str], exc: str, review: str) -> str:
    note_list = "list_filter([" + ", ".join(notes) + "], lambda x: x IS NOT NULL)"
    return f"""
named AS (
  SELECT *, CASE WHEN suffix <> '' THEN {NAME} || '_' || suffix ELSE {NAME} END AS new_job_name
  FROM (SELECT *, {ZFILL} AS job_id FROM {src})),
validated AS (SELECT *, {VIOLATIONS} AS viol FROM named),
final AS (
  SELECT *,
    CASE WHEN {exc} THEN 'EXCEPTION' WHEN {review} THEN 'NEEDS_REVIEW'
         WHEN len(viol) > 0 THEN 'NEEDS_REVIEW' ELSE 'SUCCESS' END AS status,
    array_to_string(list_concat({note_list}, viol), '; ') AS notes
  FROM validated)"""


def _ids(src: str, key2: str, start: str) -> str:
    return f"""
numbered AS (
  SELECT *, CAST({start} + row_number() OVER (PARTITION BY upper(subject_code), {key2}
                                              ORDER BY input_order) - 1 AS BIGINT) AS job_id_num
  FROM {src})"""


CAT_START = "CASE lower(category) " + " ".join(
    f"WHEN {_lit(k)} THEN {v}" for k, v in N.CATEGORY_ID_START.items()) + \
    f" ELSE {N.CATEGORY_ID_START['other']} END"

SUFFIX_V2 = f"""
suffixed AS (
  SELECT *, array_to_string(list_filter(string_split(regexp_replace(array_to_string(
              list_filter(s2, lambda p: NOT list_contains({_list(N.CATEGORY_STRIP)}, {clean('p')})),
              '_'), '\\bLOAD\\b', 'LD', 'gi'), '_'), lambda p: length({clean('p')}) > 1), '_')
           AS suffix_full
  FROM (SELECT *, CASE WHEN len(strip) > 0
                       THEN list_filter(s1, lambda p, i: NOT (list_contains(strip, {clean('p')})
                                          AND list_position(c1, {clean('p')}) = i))
                       ELSE s1 END AS s2
        FROM (SELECT *, list_transform(s1, lambda p: {clean('p')}) AS c1
              FROM (SELECT *, list_filter(string_split(suffix_body, '_'),
                                          lambda p: {clean('p')} <> {clean('app_code')}) AS s1
                    FROM numbered))))"""

V2 = "WITH " + ",".join(x.strip() for x in [JOBS, RULES, _parse(2), f"""
app AS (
  SELECT *, CASE WHEN trim(code0, 'X') = '' THEN substr({clean('app_prefix')} || 'XXXXX', 1, 5)
                 ELSE code0 END AS app_code,
            trim(code0, 'X') = '' AS app_exc,
            'E01' AS instance, 'P' AS env
  FROM (SELECT *, rpad({clean('application_name')}, 5, 'X') AS code0 FROM parsed))""",
    _lookups("app"), f"""
pairs AS (
  SELECT c[1] AS p0, c[2] AS p1, count(*) AS pair_count
  FROM (SELECT {cands('job_name')} AS c FROM jobs WHERE job_name <> '')
  WHERE len(c) = 2 AND length(c[1]) + length(c[2]) <= 6 GROUP BY 1, 2),
derived AS (
  SELECT t.*, p.pair_count,
         (len(dc) = 2 AND length(dc[1]) + length(dc[2]) <= 6 AND coalesce(p.pair_count, 0) >= 3)
           AS use_pair
  FROM (SELECT *, {cands('job_name', clean('app_code'))} AS dc FROM tiers) t
  LEFT JOIN pairs p ON p.p0 = t.dc[1] AND p.p1 = t.dc[2]),
subject AS (
  SELECT *, subj_t.subject_code AS subject_code, subj_t.category AS category, subj_t.strip AS strip
  FROM (SELECT *, (t_exact IS NULL AND t_prefix IS NULL AND t_regex IS NULL) AS is_derived,
               coalesce(t_exact, t_prefix, t_regex,
                 {{'subject_code': CASE WHEN d_comb = '' THEN 'UNKNWX' ELSE rpad(d_comb, 6, 'X') END,
                   'category': {category('job_name')},
                   'strip': CASE WHEN use_pair THEN dc[1:2] ELSE dc[1:1] END}}) AS subj_t
        FROM (SELECT *, CASE WHEN use_pair THEN dc[1] || dc[2]
                             WHEN len(dc) >= 1 THEN substr(dc[1], 1, 6) ELSE '' END AS d_comb
              FROM derived)))""",
    _ids("subject", "lower(category)", CAT_START), SUFFIX_V2, """
cut AS (SELECT *, substr(suffix_full, 1, 37) AS suffix,
               substr(subject_code, 1, 5) = app_code AS echo FROM suffixed)""",
    _finish("cut", [
        f"CASE WHEN app_exc THEN {_fmt(N.NOTE_APP_V2, application_name='application_name')} END",
        f"CASE WHEN NOT sched_hit THEN {_fmt(N.NOTE_SCHEDULE, schedule_token='upper(schedule_token)')} END",
        f"CASE WHEN NOT ast_hit THEN {_fmt(N.NOTE_AS_TYPE, job_type_key='upper(job_type)')} END",
        f"CASE WHEN is_derived THEN {_lit(N.NOTE_SUBJECT_DERIVED)} END",
        f"CASE WHEN echo THEN {_fmt(N.NOTE_ECHO, subject_code='subject_code', app_code='app_code')} END",
        f"CASE WHEN NOT etl_hit AND type_suffix <> '' THEN {_fmt(N.NOTE_ETL_UNKNOWN, type_suffix='upper(type_suffix)')} END",
        f"CASE WHEN NOT etl_hit AND type_suffix = '' THEN {_lit(N.NOTE_ETL_NONE)} END",
        f"CASE WHEN length(suffix_full) > 37 THEN {_fmt(N.NOTE_TRUNCATED, length='length(suffix_full)')} END",
    ], "app_exc", "(NOT sched_hit OR NOT ast_hit OR is_derived OR echo OR NOT etl_hit)")])

V1 = "WITH " + ",".join(x.strip() for x in [JOBS, RULES, _parse(1), """
app AS (
  SELECT p.*, coalesce(a.v, '') <> '' AS app_hit,
         CASE WHEN coalesce(a.v, '') <> '' THEN a.v ELSE upper(substr(p.app_prefix || 'XXXXX', 1, 5)) END
           AS app_code,
         'E01' AS instance, 'P' AS env
  FROM parsed p LEFT JOIN r_app a ON a.k = p.app_prefix)""",
    _lookups("app"), """
subject AS (
  SELECT *, subj_t.subject_code AS subject_code, subj_t.category AS category
  FROM (SELECT *, coalesce(t_exact, t_prefix, t_regex,
                           {'subject_code': 'UNKNWN', 'category': 'curated', 'strip': []::VARCHAR[]})
                    AS subj_t FROM tiers))""",
    _ids("subject", "(lower(category) = 'raw')",
         "CASE WHEN lower(category) = 'raw' THEN 1000 ELSE 3000 END"), """
cut AS (SELECT *, suffix_body AS suffix_full, substr(suffix_body, 1, 37) AS suffix FROM numbered)""",
    _finish("cut", [
        f"CASE WHEN NOT app_hit THEN {_fmt(N.NOTE_APP_V1, app_prefix='app_prefix')} END",
        f"CASE WHEN NOT sched_hit THEN {_fmt(N.NOTE_SCHEDULE, schedule_token='upper(schedule_token)')} END",
        f"CASE WHEN NOT ast_hit THEN {_fmt(N.NOTE_AS_TYPE, job_type_key='upper(job_type)')} END",
        f"CASE WHEN subject_code = 'UNKNWN' THEN {_lit(N.NOTE_SUBJECT_MISSING)} END",
        f"CASE WHEN NOT etl_hit AND type_suffix <> '' THEN {_fmt(N.NOTE_ETL_UNKNOWN, type_suffix='upper(type_suffix)')} END",
        f"CASE WHEN NOT etl_hit AND type_suffix = '' THEN {_lit(N.NOTE_ETL_NONE)} END",
        f"CASE WHEN length(suffix_full) > 37 THEN {_fmt(N.NOTE_TRUNCATED, length='length(suffix_full)')} END",
    ], "NOT app_hit", "(NOT sched_hit OR NOT ast_hit OR subject_code = 'UNKNWN' OR NOT etl_hit)")])

AUDIT = ("input_order, job_name AS old_job_name, new_job_name, status, notes, app_code, instance, env, "
         "schedule, as_job_type, subject_code, etl_type, job_id, suffix, job_type AS original_job_type")

SQL = {
    "job_rename_v2": V2 + f"\nSELECT {AUDIT} FROM final",
    "job_rename_v1": V1 + f"\nSELECT {AUDIT} FROM final",
    "fn_parse_name_v2": V2 + "\nSELECT input_order, app_prefix, schedule_token, type_suffix, suffix_body, "
                             "is_zzz FROM parsed",
    "fn_parse_name_v1": V1 + "\nSELECT input_order, app_prefix, schedule_token, type_suffix, suffix_body, "
                             "is_zzz FROM parsed",
    "fn_candidate_tokens": V2 + f"\nSELECT input_order, {cands('job_name')} AS candidates, dc AS "
                                "derivation_candidates FROM derived",
    "fn_category_from_tokens": V2 + f"\nSELECT input_order, {category('job_name')} AS token_category "
                                    "FROM jobs",
    "agg_token_pair_freq": V2 + "\nSELECT p0 AS token_a, p1 AS token_b, pair_count FROM pairs",
    "fn_derive_subject": V2 + "\nSELECT input_order, CASE WHEN d_comb = '' THEN 'UNKNWX' ELSE "
                              "rpad(d_comb, 6, 'X') END AS derived_subject, "
                              "CASE WHEN use_pair THEN dc[1:2] ELSE dc[1:1] END AS derived_strip, "
                              "coalesce(pair_count, 0) AS pair_count FROM (SELECT *, CASE WHEN use_pair "
                              "THEN dc[1] || dc[2] WHEN len(dc) >= 1 THEN substr(dc[1], 1, 6) ELSE '' "
                              "END AS d_comb FROM derived)",
    "fn_app_code_v2": V2 + "\nSELECT input_order, app_code, app_exc AS app_exception FROM app",
    "join_code_lookup": V2 + "\nSELECT input_order, schedule, sched_hit, as_job_type, ast_hit, etl_type, "
                             "etl_hit FROM looked",
    "join_rule_exact": V2 + "\nSELECT input_order, t_exact.subject_code AS exact_subject, "
                            "t_exact.category AS exact_category FROM tiers",
    "join_rule_longest_prefix": V2 + "\nSELECT input_order, t_prefix.subject_code AS prefix_subject, "
                                     "t_prefix.category AS prefix_category, t_prefix.strip AS prefix_strip "
                                     "FROM tiers",
    "join_rule_regex": V2 + "\nSELECT input_order, t_regex.subject_code AS regex_subject, "
                            "t_regex.category AS regex_category FROM tiers",
    "join_rule_tiers": V2 + "\nSELECT input_order, subject_code, category, strip, is_derived FROM subject",
    "win_first_match": V2 + "\nSELECT input_order, coalesce(t_exact, t_prefix, t_regex).subject_code AS "
                            "first_match_subject FROM tiers",
    "win_sequential_id_v2": V2 + "\nSELECT input_order, subject_code, category, job_id_num FROM numbered",
    "win_sequential_id_v1": V1 + "\nSELECT input_order, subject_code, category, job_id_num FROM numbered",
    "fn_guard_echo": V2 + "\nSELECT input_order, app_code, subject_code, echo FROM cut",
    "fn_clean_suffix": V2 + "\nSELECT input_order, suffix_body, suffix_full FROM cut",
    "fn_cut_suffix_v1": V1 + "\nSELECT input_order, suffix_full, suffix FROM cut",
    "fn_build_name": V2 + "\nSELECT input_order, new_job_name FROM named",
    "fn_validate_name": V2 + "\nSELECT input_order, new_job_name, viol AS violations FROM validated",
    "fn_status_notes": V2 + "\nSELECT input_order, status, notes FROM final",
    "agg_status_summary": V2 + """,
seed AS (SELECT * FROM (VALUES ('SUCCESS'), ('NEEDS_REVIEW'), ('EXCEPTION')) t(status)),
counts AS (SELECT status, count(*) AS n FROM final GROUP BY 1),
tot AS (SELECT count(*) AS total FROM final)
SELECT s.status, coalesce(c.n, 0) AS n,
       round(CAST(100.0 AS DOUBLE) * coalesce(c.n, 0) / greatest((SELECT total FROM tot), 1), 6) AS pct
FROM seed s LEFT JOIN counts c USING (status)
UNION ALL SELECT 'TOTAL', total, CAST(100.0 AS DOUBLE) FROM tot""",
    "topk_exceptions": V2 + """
SELECT input_order, job_name AS old_job_name, notes FROM final WHERE status = 'EXCEPTION'
ORDER BY input_order LIMIT 5""",
}

JOBS_RAW = f"""
jobs_raw AS (
  SELECT o_orderkey AS input_order,
         concat_ws('_', {_pick(D.NAME_HEADS, 'o_orderkey')}, {_pick(D.NAME_SCHEDULES, 'o_orderkey // 10')},
                   {_pick(D.NAME_BODIES, 'o_orderkey // 90')}, nullif({_pick(D.NAME_TAILS, 'o_orderkey // 990')}, ''))
           AS job_name,
         {JOB_TYPE} AS job_type, {_pick(D.APPLICATION_NAMES, 'o_custkey')} AS application_name
  FROM orders)"""

SQL["src_jobs_csv"] = "WITH " + JOBS_RAW.strip() + """
SELECT CAST(input_order AS VARCHAR) AS row, coalesce(job_name, '') AS job_name,
       coalesce(job_type, '') AS job_type, coalesce(application_name, '') AS application_name
FROM jobs_raw"""

SQL["sink_csv"] = V1 + """
SELECT input_order, job_name AS old_job_name, new_job_name, status, notes, app_code, instance, env,
       schedule, as_job_type, subject_code, etl_type, job_id, suffix, job_type AS original_job_type
FROM final"""

JOBS_RAW_SQL_REQUIRED = "WITH " + JOBS_RAW.strip() + """
SELECT coalesce(job_name, '') AS job_name, coalesce(job_type, '') AS job_type FROM jobs_raw"""
