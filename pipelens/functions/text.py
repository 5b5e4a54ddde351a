"""String functions over query / plan text and lineage expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for the same results.
# Substrings counted in query text, with the output column for each.
PATTERN_COLUMNS = [
    ("UDF", "num_udf"),
    ("With", "num_cte"),
    ("Subquery", "num_subqueries"),
    ("Join", "num_joins"),
    ("CASE", "num_case_when"),
]
# Words never taken as column references after raw. / derv.
REF_STOP_WORDS = ["YEAR", "MONTH", "DAY", "CAST", "DATE", "CASE", "WHEN", "THEN",
                  "ELSE", "END", "IN", "AND", "OR", "NOT"]
# Pattern for raw.<column> and derv.<column> references (case-insensitive).
COLUMN_REF_PATTERN = r"(?i)\b(?:raw|derv)\.([a-zA-Z_][a-zA-Z0-9_]*)\b"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def count_occurrences(text, pattern: str) -> Column:
    """Non-overlapping, case-sensitive count of ``pattern``; null -> 0.

    ``(len(t) - len(replace(t, p, ''))) / len(p)`` equals Python's
    ``str.count`` for non-overlapping matches.
    """
    t = _c(text)
    n = (F.length(t) - F.length(F.replace(t, F.lit(pattern), F.lit("")))) / F.lit(len(pattern))
    return F.coalesce(n.cast("int"), F.lit(0))


def pattern_counts(text) -> dict[str, Column]:
    """``fn_pattern_counts``: the five counters of the query-feature job."""
    return {name: count_occurrences(text, pat) for pat, name in PATTERN_COLUMNS}


def contains_all(text, needles) -> Column:
    """True when every needle occurs; null text -> false."""
    t = _c(text)
    cond = F.lit(True)
    for n in needles:
        cond = cond & t.contains(n)
    return F.coalesce(cond, F.lit(False))


def join_strategy_changed(plan_text) -> Column:
    """``pred_join_strategy_changed``: plan has both SortMergeJoin and
    BroadcastHashJoin; null -> false."""
    return contains_all(plan_text, ["SortMergeJoin", "BroadcastHashJoin"])


def skew_join_applied(plan_json) -> Column:
    """``pred_skew_join``: the updated plan text mentions ``skew``."""
    return F.coalesce(_c(plan_json).contains("skew"), F.lit(False))


def column_refs(expression) -> Column:
    """``fn_column_refs``: distinct ``raw.x`` / ``derv.x`` names, stop words removed."""
    refs = F.regexp_extract_all(_c(expression), F.lit(COLUMN_REF_PATTERN), 1)
    stop = F.array(*[F.lit(w) for w in REF_STOP_WORDS])
    return F.array_distinct(F.filter(refs, lambda r: ~F.array_contains(stop, F.upper(r))))


def strip_derv(name) -> Column:
    """``fn_strip_derv``: lower-case and drop a leading ``derv_``."""
    return F.regexp_replace(F.lower(_c(name)), r"^derv_", "")


def truncate(text, n: int) -> Column:
    """``fn_truncate_logic``: first ``n`` characters."""
    return F.substring(_c(text), 1, n)


def sha256(text) -> Column:
    """``proj_query_meta`` hash of the query text."""
    return F.sha2(_c(text), 256)
