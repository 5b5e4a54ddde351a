"""Column functions for job-name standardisation (N family, section 2.8).

All of them are native Catalyst expressions (split / filter / transform /
regexp / pad), so a renaming job is one codegen-friendly projection per row
plus two shuffles (pair counts and sequential ids).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for the same output.
# ---------------------------------------------------------------------------
ALLOWED_SCHEDULES = ["R", "H", "D", "W", "M", "Q", "Y", "A", "O"]
ALLOWED_AS_TYPES = ["F", "B", "C"]
ALLOWED_ETL_TYPES = ["A", "B", "C", "E", "EN", "F", "I", "L",
                     "MB", "M", "N", "P", "R", "S", "T", "V"]
OLD_TYPE_SUFFIXES = ["BX", "CM", "CMD", "FW"]
MAX_SUFFIX_LEN = 37
MAX_NAME_LEN = 64
SCHEDULE_TOKENS = ["D", "M", "A", "OD", "W", "H", "Q", "Y", "O", "R"]
NOISE_TOKENS = ["PROD", "DEV", "UAT", "LOAD", "EXT", "INT", "SRC",
                "BX", "BOX", "CM", "CMD", "FW", "PRLL", "HIST",
                "CONF", "SAN", "RAW", "DW", "DATA", "PROCESS"]
# category -> marker tokens, in precedence order
CATEGORY_MARKERS = [
    ("raw", ["RAW", "SAN", "SANITIZED"]),
    ("conformed", ["CONF", "CONFORMED"]),
    ("curated", ["CURATED", "FFP"]),
    ("streaming", ["KAFKA", "API", "STREAMING"]),
    ("ndm", ["NDM"]),
]
CATEGORY_ID_START = {"raw": 1000, "conformed": 2000, "curated": 3000,
                     "streaming": 4000, "ndm": 5000, "other": 6000}
CATEGORY_STRIP = ["RAW", "SAN", "SANITIZED", "CONF", "CONFORMED", "CURATED", "FFP",
                  "KAFKA", "API", "STREAMING", "NDM"]
LEADING_PLACEHOLDERS = ["P", "PR"]   # whole first token dropped (v2)
LEADING_DASH_PREFIX = "P-"           # stripped from the first token (v2)
# Note and violation texts ({name} = value of that field)
NOTE_APP_V2 = ("application_name '{application_name}' is empty or invalid — "
               "populate application_name in the source data")
NOTE_APP_V1 = "Unknown app prefix '{app_prefix}' — add to mappings/app_codes.csv"
NOTE_SCHEDULE = ("Unknown schedule token '{schedule_token}' — defaulting to 'D'; "
                 "add to mappings/schedule_codes.csv if intentional")
NOTE_AS_TYPE = ("Unknown AS job type column value '{job_type_key}' — defaulting to 'C'; "
                "add to mappings/as_job_types.csv")
NOTE_SUBJECT_DERIVED = ("Subject area auto-derived from job name tokens; "
                        "verify in subject_areas.csv")
NOTE_SUBJECT_MISSING = ("Subject area not found — add a matching pattern to "
                        "mappings/subject_areas.csv")
NOTE_ECHO = ("subject_code '{subject_code}' echoes app_code '{app_code}' — "
             "add a subject_areas.csv rule to assign a distinct subject")
NOTE_ETL_UNKNOWN = ("Unknown ETL suffix token '{type_suffix}' — defaulting to 'C'; "
                    "add to mappings/etl_job_types.csv")
NOTE_ETL_NONE = ("No recognised type suffix (BX/CM/CMD/FW) found in old name — "
                 "defaulting ETL type to 'C'")
NOTE_TRUNCATED = "Suffix truncated from {length} to 37 chars"
VIOLATION_APP = "app_code '{app_code}' must be exactly 5 uppercase alphanumeric chars"
VIOLATION_INSTANCE = "instance '{instance}' must be exactly 3 uppercase alphanumeric chars"
VIOLATION_SCHEDULE = ("schedule '{schedule}' not in allowed set "
                      "['A', 'D', 'H', 'M', 'O', 'Q', 'R', 'W', 'Y']")
VIOLATION_AS_TYPE = "as_job_type '{as_job_type}' not in {{F, B, C}}"
VIOLATION_SUBJECT = "subject_code '{subject_code}' must be exactly 6 uppercase alphanumeric chars"
VIOLATION_ETL = ("etl_type '{etl_type}' not in allowed set "
                 "['A', 'B', 'C', 'E', 'EN', 'F', 'I', 'L', 'M', 'MB', 'N', 'P', 'R', 'S', 'T', 'V']")
VIOLATION_ID = "job_id '{job_id}' must produce a 4-digit string in range 0000-9999"
VIOLATION_LENGTH = "new name length {length} exceeds 64 chars"
VIOLATION_CHARS = "new name contains characters outside [A-Z0-9_]"
STATUS_ORDER = ["SUCCESS", "NEEDS_REVIEW", "EXCEPTION"]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _arr(values: Iterable[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def fmt(template: str, **cols) -> Column:
    """Fill ``{name}`` placeholders of a fixed text with columns."""
    pieces: list[Column] = []
    rest = template.replace("{{", "\0").replace("}}", "\1")
    while rest:
        i = rest.find("{")
        if i < 0:
            pieces.append(F.lit(rest.replace("\0", "{").replace("\1", "}")))
            break
        if i:
            pieces.append(F.lit(rest[:i].replace("\0", "{").replace("\1", "}")))
        j = rest.index("}", i)
        pieces.append(_c(cols[rest[i + 1:j]]).cast("string"))
        rest = rest[j + 1:]
    return F.concat(*pieces)


def strip_ws(s) -> Column:
    """Python ``str.strip()``: drop leading / trailing whitespace."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def alnum_upper(s) -> Column:
    """Upper-case and keep only A-Z and 0-9."""
    return F.regexp_replace(F.upper(_c(s)), "[^A-Z0-9]", "")


def at(arr, i: int | Column) -> Column:
    """1-based element, negative from the end; null when out of range."""
    return F.try_element_at(_c(arr), i if isinstance(i, Column) else F.lit(i))


def tokens(name) -> Column:
    """``name.strip().split('_')`` (empty tokens kept)."""
    return F.split(strip_ws(name), "_", -1)


def _tail(arr: Column, start: int, drop_last: Column | int = 0) -> Column:
    """Python ``arr[start-1:]`` (1-based ``start``), optionally minus the last element."""
    n = F.size(arr) - F.lit(start - 1) - (drop_last if isinstance(drop_last, Column) else F.lit(drop_last))
    return F.slice(arr, start, F.greatest(n, F.lit(0)))


def _strip_placeholder(tk: Column) -> Column:
    """v2: drop a leading ``P`` / ``PR`` token, or the ``P-`` of the first token."""
    t0 = at(tk, 1)
    rest = _tail(tk, 2)
    dash_rest = F.substring(t0, 3, 1 << 20)
    return (F.when(F.upper(t0).isin(*LEADING_PLACEHOLDERS), rest)
            .when(F.upper(t0).startswith(LEADING_DASH_PREFIX),
                  F.when(dash_rest == "", rest).otherwise(F.concat(F.array(dash_rest), rest)))
            .otherwise(tk))


def parse_name(name, version: int = 2) -> Column:
    """``fn_parse_name_v1`` / ``fn_parse_name_v2`` -> struct(app_prefix,
    schedule_token, type_suffix, suffix_body, is_zzz)."""
    raw = tokens(name)
    empty = (F.size(raw) == 0) | (at(raw, 1) == "")
    tk = _strip_placeholder(raw) if version >= 2 else raw
    n = F.size(tk)
    gone = empty | (n == 0)
    t1 = F.upper(at(tk, 2))
    last = F.upper(at(tk, -1))
    is_zzz = (n >= 2) & t1.startswith("ZZZ")
    has_type = (n > 2) & last.isin(*OLD_TYPE_SUFFIXES)
    body = F.when(has_type, F.array_join(_tail(tk, 3, 1), "_")) \
        .otherwise(F.array_join(_tail(tk, 3), "_"))
    two = (~gone) & (n >= 2)
    return F.struct(
        F.when(gone, F.lit("")).otherwise(F.upper(at(tk, 1))).alias("app_prefix"),
        F.when(~two, F.lit("")).when(is_zzz, F.substring(t1, 4, 1)).otherwise(t1)
        .alias("schedule_token"),
        F.when(two & has_type, last).otherwise(F.lit("")).alias("type_suffix"),
        F.when(two, body).otherwise(F.lit("")).alias("suffix_body"),
        F.coalesce(two & is_zzz, F.lit(False)).alias("is_zzz"),
    )


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once: what a lambda or a
    higher-order function names twice, Spark evaluates twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def clean_tokens(s) -> Column:
    """Per-token ``alnum_upper`` of ``s.split('_')`` with one regex per row:
    deleting every char outside [A-Z0-9_] from the upper-cased string keeps
    the underscores, so the split lines up token by token."""
    return F.split(F.regexp_replace(F.upper(_c(s)), "[^A-Z0-9_]", ""), "_", -1)


def kept_tokens(name) -> Column:
    """All tokens after the first, alnum-upper, at least 3 long, that are no
    schedule or noise token."""
    return F.filter(let(clean_tokens(strip_ws(name)), lambda tk: _tail(tk, 2)),
                    lambda c: (F.length(c) >= 3) & ~c.isin(*SCHEDULE_TOKENS, *NOISE_TOKENS))


def first_candidates(kept, extra_skip: Column | None = None) -> Column:
    """The first two of :func:`kept_tokens` that are no extra-skip token."""
    kept = _c(kept)
    if extra_skip is not None:
        kept = let(extra_skip, lambda skip: F.filter(kept, lambda c: ~F.array_contains(skip, c)))
    return F.slice(kept, 1, 2)


def candidate_tokens(name, extra_skip: Column | None = None) -> Column:
    """``fn_candidate_tokens``: tokens after the first, alnum-upper, not a
    schedule / noise / extra-skip token, at least 3 long; first two."""
    return first_candidates(kept_tokens(name), extra_skip)


def category_from_tokens(name) -> Column:
    """``fn_category_from_tokens``: first category whose marker appears among
    the upper-cased raw tokens; otherwise ``other``."""
    up = F.split(F.upper(strip_ws(name)), "_", -1)
    out = F.lit("other")
    for cat, markers in reversed(CATEGORY_MARKERS):
        out = F.when(F.arrays_overlap(up, _arr(markers)), F.lit(cat)).otherwise(out)
    return out


def pair_fits(cands) -> Column:
    """Two candidates whose total length is at most 6."""
    c = _c(cands)
    return (F.size(c) == 2) & (F.length(at(c, 1)) + F.length(at(c, 2)) <= 6)


def derive_subject(cands, pair_count) -> Column:
    """``fn_derive_subject`` -> struct(subject_code, strip): the pair when it
    was seen at least 3 times and fits 6 chars, else the first token cut to 6;
    padded with X; ``UNKNWX`` when there is no candidate."""
    c = _c(cands)
    use_pair = pair_fits(c) & (F.coalesce(_c(pair_count), F.lit(0)) >= 3)
    combined = (F.when(use_pair, F.concat(at(c, 1), at(c, 2)))
                .when(F.size(c) >= 1, F.substring(at(c, 1), 1, 6))
                .otherwise(F.lit("")))
    subject = F.when(combined == "", F.lit("UNKNWX")).otherwise(F.rpad(combined, 6, "X"))
    strip = F.when(use_pair, F.slice(c, 1, 2)).otherwise(F.slice(c, 1, 1))
    return F.struct(subject.alias("subject_code"), strip.alias("strip"))


def app_code_v2(application_name, app_prefix) -> Column:
    """``fn_app_code_v2`` -> struct(app_code, is_exception)."""
    code = F.rpad(alnum_upper(application_name), 5, "X")
    bad = F.btrim(code, F.lit("X")) == ""
    fallback = F.substring(F.concat(alnum_upper(app_prefix), F.lit("XXXXX")), 1, 5)
    return F.struct(F.when(bad, fallback).otherwise(code).alias("app_code"),
                    bad.alias("is_exception"))


def drop_first_occurrences(parts, cleaned, remove) -> Column:
    """Keep parts whose cleaned form is not in ``remove``, except that only the
    first occurrence of each removable value is dropped."""
    p, c, r = _c(parts), _c(cleaned), _c(remove)
    keep = F.filter(
        F.arrays_zip(p.alias("p"), c.alias("c")),
        lambda z, i: ~(F.array_contains(r, z["c"]) & (F.array_position(c, z["c"]) == i + 1)))
    return F.transform(keep, lambda z: z["p"])


def clean_suffix(body, app_code, strip_tokens) -> Column:
    """``fn_clean_suffix`` (v2) -> the suffix before the 37-char cut.

    In order: drop the app-code token; drop each subject token once; drop
    category tokens; ``\\bLOAD\\b`` -> ``LD`` (``_`` is a word char, so LOAD
    between underscores stays); drop tokens with at most one alnum char."""
    strip = F.coalesce(_c(strip_tokens), F.array().cast("array<string>"))

    def without_strip(z: Column) -> Column:
        cleaned = F.transform(z, lambda t: t["c"])
        return F.when(F.size(strip) > 0, F.filter(
            z, lambda t, i: ~(F.array_contains(strip, t["c"])
                              & (F.array_position(cleaned, t["c"]) == i + 1)))).otherwise(z)

    z = F.arrays_zip(F.split(_c(body), "_", -1).alias("p"), clean_tokens(body).alias("c"))
    z = let(alnum_upper(app_code), lambda app: F.filter(z, lambda t: t["c"] != app))
    z = F.filter(let(z, without_strip), lambda t: ~t["c"].isin(*CATEGORY_STRIP))
    joined = F.regexp_replace(F.array_join(F.transform(z, lambda t: t["p"]), "_"),
                              r"(?i)\bLOAD\b", "LD")
    z = F.filter(let(joined, lambda s: F.arrays_zip(F.split(s, "_", -1).alias("p"), clean_tokens(s).alias("c"))),
                 lambda t: F.length(t["c"]) > 1)
    return F.array_join(F.transform(z, lambda t: t["p"]), "_")


def cut_suffix(suffix) -> Column:
    """``fn_cut_suffix_v1``: first 37 characters."""
    return F.substring(_c(suffix), 1, MAX_SUFFIX_LEN)


def zfill4(job_id) -> Column:
    """``str(n).zfill(4)``: pad to 4 only when shorter (``lpad`` would cut)."""
    s = _c(job_id).cast("string")
    return F.when(F.length(s) < 4, F.lpad(s, 4, "0")).otherwise(s)


def build_name(app_code, instance, env, schedule, as_job_type, subject_code,
               etl_type, job_id, suffix) -> Column:
    """``fn_build_name``: ``AAAAA_IIIPSC_SSSSSS_TTNNNN[_suffix]``."""
    head = F.concat(
        F.upper(F.rpad(_c(app_code), 5, "X")), F.lit("_"),
        F.upper(F.rpad(_c(instance), 3, "X")), F.upper(F.rpad(_c(env), 1, "X")),
        F.upper(F.rpad(_c(schedule), 1, "X")), F.upper(F.rpad(_c(as_job_type), 1, "X")),
        F.lit("_"), F.upper(F.rpad(_c(subject_code), 6, "X")), F.lit("_"),
        F.upper(_c(etl_type)), zfill4(job_id))
    return F.when(F.coalesce(_c(suffix), F.lit("")) != "",
                  F.concat(head, F.lit("_"), _c(suffix))).otherwise(head)


def validate_name(name, app_code, instance, schedule, as_job_type, subject_code,
                  etl_type, job_id) -> Column:
    """``fn_validate_name``: array of violation messages in check order."""
    uid = zfill4(job_id)
    checks = [
        (~_c(app_code).rlike("^[A-Z0-9]{5}$"), fmt(VIOLATION_APP, app_code=app_code)),
        (~_c(instance).rlike("^[A-Z0-9]{3}$"), fmt(VIOLATION_INSTANCE, instance=instance)),
        (~_c(schedule).isin(*ALLOWED_SCHEDULES), fmt(VIOLATION_SCHEDULE, schedule=schedule)),
        (~_c(as_job_type).isin(*ALLOWED_AS_TYPES), fmt(VIOLATION_AS_TYPE, as_job_type=as_job_type)),
        (~_c(subject_code).rlike("^[A-Z0-9]{6}$"), fmt(VIOLATION_SUBJECT, subject_code=subject_code)),
        (~_c(etl_type).isin(*ALLOWED_ETL_TYPES), fmt(VIOLATION_ETL, etl_type=etl_type)),
        (~uid.rlike("^[0-9]{4}$"), fmt(VIOLATION_ID, job_id=job_id)),
        (F.length(_c(name)) > MAX_NAME_LEN, fmt(VIOLATION_LENGTH, length=F.length(_c(name)))),
        (F.upper(_c(name)).rlike("[^A-Z0-9_]"), F.lit(VIOLATION_CHARS)),
    ]
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in checks]))


def status(is_exception, needs_review, violations) -> Column:
    """``fn_status_notes`` status: EXCEPTION > NEEDS_REVIEW > SUCCESS; any
    violation demotes SUCCESS to NEEDS_REVIEW."""
    base = (F.when(_c(is_exception), F.lit("EXCEPTION"))
            .when(_c(needs_review), F.lit("NEEDS_REVIEW")).otherwise(F.lit("SUCCESS")))
    return F.when((base == "SUCCESS") & (F.size(_c(violations)) > 0), F.lit("NEEDS_REVIEW")) \
        .otherwise(base)


def notes(note_cols: list[Column] | Column, violations) -> Column:
    """Notes (columns, or one array) then violations, joined by ``; `` (nulls skipped)."""
    found = note_cols if isinstance(note_cols, Column) else F.array_compact(F.array(*note_cols))
    return F.array_join(F.concat(found, _c(violations)), "; ")
