"""Rule-table joins (section 2.3): code lookups and the subject-area tiers.

Rule tables are small by nature, but "small" is checked, not assumed:
:func:`checked_broadcast` counts the rows and only then hints a broadcast.
Above the limit the join is left to AQE, which re-plans on the real sizes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipelens.functions import names as N
from pipelens.operators import graph

BROADCAST_ROW_LIMIT = 200_000
BROADCAST_BYTE_LIMIT = 64 << 20
# up to so many regex rules are tried on every name
FEW_PATTERNS = 64


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_ROW_LIMIT,
                      max_bytes: int = BROADCAST_BYTE_LIMIT) -> DataFrame:
    """Broadcast hint only when the frame has at most ``max_rows`` rows that
    take at most ``max_bytes`` as JSON text."""
    n, size = df.limit(max_rows + 1).agg(
        F.count("*"), F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= max_bytes else df


def kv_rules(df: DataFrame, old: str, new: str, order: str = "rule_order") -> DataFrame:
    """Key -> value rule table, keys and values trimmed and upper-cased;
    a key listed twice keeps its last value (file order)."""
    norm = df.select(N.strip_ws(F.upper(F.coalesce(F.col(old), F.lit("")))).alias("_key"),
                     N.strip_ws(F.upper(F.coalesce(F.col(new), F.lit("")))).alias("_value"),
                     F.col(order).alias("_order"))
    return norm.groupBy("_key").agg(F.max_by("_value", "_order").alias("_value"))


def code_lookup(df: DataFrame, key, rules: DataFrame, out: str) -> DataFrame:
    """``join_code_lookup``: add ``out`` = rule value for ``key`` (null when
    missing). Blank values are treated as missing by the callers."""
    k = F.col(key) if isinstance(key, str) else key
    r = checked_broadcast(rules).select(F.col("_key").alias(f"_{out}_k"),
                                        F.col("_value").alias(out))
    return df.join(r, k == F.col(f"_{out}_k"), "left").drop(f"_{out}_k")


def subject_rules(df: DataFrame, order: str = "rule_order") -> DataFrame:
    """Normalised subject rules: match_type lower, pattern trimmed, code upper,
    category lower, plus the strip candidates of the pattern."""
    s = lambda c: N.strip_ws(F.coalesce(F.col(c), F.lit("")))
    return df.select(
        F.col(order).alias("rule_order"),
        F.lower(s("match_type")).alias("match_type"),
        s("pattern").alias("pattern"),
        F.upper(s("subject_code")).alias("subject_code"),
        F.lower(s("category")).alias("category"),
        N.candidate_tokens(s("pattern")).alias("strip"))


def _tier_struct(prefix: str = "") -> F.Column:
    return F.struct(F.col(f"{prefix}subject_code").alias("subject_code"),
                    F.col(f"{prefix}category").alias("category"),
                    F.col(f"{prefix}strip").alias("strip"))


def match_exact(df: DataFrame, name, rules: DataFrame, out: str = "_exact") -> DataFrame:
    """``join_rule_exact``: whole upper-cased name equals the pattern; a
    pattern listed twice keeps its last rule."""
    ex = (rules.where(F.col("match_type") == "exact")
          .groupBy(F.upper("pattern").alias("_xk"))
          .agg(F.max_by(_tier_struct(), "rule_order").alias(out)))
    k = F.upper(F.col(name) if isinstance(name, str) else name)
    return df.join(checked_broadcast(ex), k == F.col("_xk"), "left").drop("_xk")


def match_longest_prefix(df: DataFrame, name, rules: DataFrame, out: str = "_prefix") -> DataFrame:
    """``join_rule_longest_prefix``: the longest matching prefix wins, equal
    length -> first in file.

    Prefix-length explode as equi-joins: for each distinct pattern length L
    (a handful) the name's first L characters are looked up in a broadcast
    hash table; the longest hit wins. No nested-loop join, no shuffle.
    """
    pr = (rules.where(F.col("match_type") == "prefix")
          .select(F.upper("pattern").alias("_pk"), F.length("pattern").alias("_pl"),
                  "rule_order", _tier_struct().alias("_t"))
          .groupBy("_pk", "_pl").agg(F.min_by("_t", "rule_order").alias("_t")))
    lengths = sorted({r[0] for r in pr.select("_pl").distinct().collect()}, reverse=True)
    up = F.upper(F.col(name) if isinstance(name, str) else name)
    hits = []
    small = checked_broadcast(pr)
    for i, L in enumerate(lengths):
        t = small.where(F.col("_pl") == L).select(F.col("_pk").alias(f"_pk{i}"),
                                                  F.col("_t").alias(f"_t{i}"))
        key = F.when(F.length(up) >= L, F.substring(up, 1, L)) if L > 0 else F.lit("")
        df = df.join(t, key == F.col(f"_pk{i}"), "left").drop(f"_pk{i}")
        hits.append(F.col(f"_t{i}"))
    best = F.coalesce(*hits) if hits else F.lit(None).cast(
        "struct<subject_code:string,category:string,strip:array<string>>")
    df = df.withColumn(out, best)
    return df.drop(*[f"_t{i}" for i in range(len(lengths))])


def sure_literal(pattern) -> F.Column:
    """The longest text that every match of a regex must hold, upper case; empty
    where none is sure. Groups, classes, escapes, and characters that a
    quantifier makes optional cut the pattern into pieces; alternatives, nested
    groups and nested classes make nothing sure."""
    p = F.col(pattern) if isinstance(pattern, str) else pattern
    cut, more = "\u0001", r"(?:[?*+]|\{[^}]*\})?[?+]?"
    plain = F.regexp_replace(p, r"(?s)\\." + more, cut)
    plain = F.regexp_replace(plain, r"\[[^\[\]]*\]" + more, cut)
    plain = F.regexp_replace(plain, r"\([^()]*\)" + more, cut)
    sure = ~p.rlike(r"\||\(\?|\\[QEx0-9uUcNpPk]|&&") & ~plain.rlike(r"[()\[\]]")
    plain = F.regexp_replace(plain, r"(?s).(?:[?*]|\{[^}]*\})[?+]?", cut)
    plain = F.regexp_replace(plain, r"(?s)(.)\+[?+]?", "$1" + cut)
    pieces = F.split(F.regexp_replace(plain, r"[.^$]", cut), cut)
    longest = F.element_at(F.array_sort(pieces, lambda x, y: F.length(x) - F.length(y)), -1)
    return F.when(sure, F.upper(longest)).otherwise("")


def _trigrams(text) -> F.Column:
    t = F.col(text) if isinstance(text, str) else text
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))),
                                        lambda i: F.substr(t, i, F.lit(3))))


def match_regex(df: DataFrame, name, rules: DataFrame, out: str = "_regex",
                few: int = FEW_PATTERNS, path: str | None = None) -> DataFrame:
    """``join_rule_regex``: first pattern in file order that matches anywhere,
    case-insensitive. The distinct names meet the rules once; the hit of the
    lowest order joins back on the name.

    Beyond ``few`` rules, a pattern with a sure literal of three characters or
    more is found by one trigram of it, the one that the fewest names hold: names
    are joined to the patterns by their trigrams, and only these candidates are
    matched. Patterns without such a literal meet every name.

    With ``path`` the hits are written there and counted first: a broadcast that
    is planned only when they are known comes after the rows have been shuffled."""
    nm = F.col(name) if isinstance(name, str) else name
    rx = rules.where(F.col("match_type") == "regex").select("rule_order", "pattern", F.struct(
        "subject_code", "category", F.array().cast("array<string>").alias("strip")).alias("_t"))
    names = df.select(nm.alias("_rx_name")).where(F.col("_rx_name").isNotNull()).distinct()
    matches = F.expr("_rx_name rlike concat('(?i)', pattern)")
    if rx.limit(few + 1).count() <= few:
        pairs = names.join(checked_broadcast(rx), matches)
    else:
        literal = rx.withColumn("_lit", sure_literal("pattern"))
        held = names.select("_rx_name", F.explode(_trigrams(F.upper("_rx_name"))).alias("_gram"))
        rarity = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_held"))
        # a trigram that no name holds drops its pattern: it cannot match
        grams = literal.where(F.length("_lit") >= 3).select(
            "rule_order", "pattern", "_t", "_lit", F.explode(_trigrams("_lit")).alias("_gram"))
        absent = F.coalesce("_held", F.lit(0))
        chosen = grams.join(rarity, "_gram", "left").groupBy("rule_order", "pattern", "_t", "_lit").agg(
            F.min_by("_gram", F.struct(absent, "_gram")).alias("_gram"))
        found = held.join(chosen, "_gram").where(F.contains(F.upper("_rx_name"), F.col("_lit")) & matches)
        rest = names.join(checked_broadcast(literal.where(F.length("_lit") < 3).select("rule_order", "pattern", "_t")), matches)
        pairs = found.select("_rx_name", "rule_order", "_t").unionByName(rest.select("_rx_name", "rule_order", "_t"))
    hits = pairs.groupBy("_rx_name").agg(F.min_by("_t", "rule_order").alias(out))
    if path is not None:
        hits, told = graph.materialize_observed(hits, path, rows=F.count(F.lit(1)))
        hits = graph.sized(hits, told["rows"])
    return df.join(hits, nm == F.col("_rx_name"), "left").drop("_rx_name")
