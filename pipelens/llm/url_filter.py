"""URL filters by a character language-model ratio (operator 12), DataFrame
functions only.

Rules of (verdict, host, path prefix) judge first, the longest that fits; the
method judges the rest. It learns from addresses (host and path): those that the
rules block, or whose host holds a word of ``rejected_words``, are rejected, all
others count as accepted (so an address is only blocked for being more like the
rejected ones than like the table at large). Of each class it trains a smoothed
variable-order Markov model over characters: interpolated Witten-Bell, where a
context of up to four characters counts as far as it was seen,

    P(c | x) = (n(xc) + t(x) P(c | x')) / (n(x) + t(x)),

with t(x) the number of different followers of x, and x' the context without
its first character; an unseen context leaves P(c | x'), and below the empty one
stands the uniform distribution over all characters of the table. An address
scores the mean over its characters, end included, of ln P_accepted - ln
P_rejected. The limit is calibrated on labelled addresses kept out of training:
of all limits that block at most ``max_false`` of the accepted ones, that with
the best share of rejected minus accepted blocked (the lowest of equal ones), in
the middle between the scores below and above it.

Addresses are made distinct first, so copies of a URL neither weigh more nor
make work. Models are tables of distinct five-character strings and their ends:
probabilities of both classes come from windows over a context's followers (no
more than the alphabet) and joins to the next shorter order. Scoring joins the
string table to the addresses' strings, broadcast where its counted rows are
few, else by a shuffled join, and sums per address before the shuffle. Log ratios
are rounded to whole millionths, so sums do not depend on their order.

Defined results: a null url, or one without ``://``, has empty host and path, no
rule and, like all addresses where a class has no training address, the verdict
allow; repeated rows, ties and rows with null ids each give a row; texts of any
length are scored whole; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import os
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pipelens.session import scratch_path


class Rule(NamedTuple):
    verdict: str  # allow or block
    host: str  # fits itself and its subdomains
    path: str  # fits paths that start with it


# The base rules.
RULES = [Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
# Words of hosts whose addresses count as rejected in training.
REJECTED_WORDS = ["adult", "bets", "casino", "porn", "poker", "spam", "viagra", "warez"]
#: Longest context; share of accepted held-out addresses that may be blocked;
#: scores are compared in steps of this many millionths; rows of a string table
#: that may be broadcast (five characters and a number: about 60 bytes a row).
ORDER, MAX_FALSE, STEP, BROADCAST_ROWS = 4, 0.01, 10_000, 500_000
#: First hexadecimal digits of an address's md5 that keep it out of training.
HELD_OUT = ("0", "1", "2")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BEGIN, END = "\x02", "\x03"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    split = r"^([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(rest, split, 1), UPPER, LOWER), F.regexp_extract(rest, split, 2)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule, or nulls."""
    if not rules:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    fits = [((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path) for r in rules]
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].host + rules[i].path), i))
    return tuple(F.coalesce(*[F.when(fits[i], F.lit(what(rules[i]))) for i in order])
                 for what in (lambda r: r.host + r.path, lambda r: r.verdict))


def _strings(address: Column, order: int) -> Column:
    """The order + 1 characters that end at each character and at the end."""
    def parts(ch: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(ch) - order - 1),
                           lambda i: F.concat(*[F.get(ch, i + j) for j in range(order + 1)]))
    # the lambda binds the characters once; a plain expression would split per use
    padded = F.concat(F.lit(BEGIN * order), address, F.lit(END))
    return F.transform(F.array(F.regexp_extract_all(padded, F.lit("(?s)(.)"))), parts)[0]


def _written(frame: DataFrame, root: str, name: str) -> DataFrame:
    path = os.path.join(root, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


def labelled_addresses(urls: DataFrame, rules: list[Rule], words: list[str], url_col: str) -> DataFrame:
    """Distinct (key, address, accepted, held_out); ``key`` stands for the
    address where that would be long."""
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = urls.select(host.alias("host"), path.alias("path")).distinct()
    rejected = F.lit(False)
    for word in words:
        rejected |= F.contains(F.col("host"), F.lit(word))
    verdict = longest_rule(F.col("host"), F.col("path"), rules)[1]
    address = F.concat("host", "path")
    return parsed.where(address != "").select(
        F.md5(address).alias("key"), address.alias("address"),
        (~rejected & (F.coalesce(verdict, F.lit("allow")) == "allow")).alias("accepted"),
        F.substring(F.md5(address), 1, 1).isin(*HELD_OUT).alias("held_out"))


def log_ratios(addresses: DataFrame, root: str, order: int = ORDER) -> DataFrame:
    """(gram, micro) for every string of the addresses: ln P_accepted - ln
    P_rejected of its last character after the others, in millionths."""
    trains = ~F.col("held_out")
    grams = _written(
        addresses.select((trains & F.col("accepted")).alias("a"), (trains & ~F.col("accepted")).alias("r"),
                         F.explode(_strings(F.col("address"), order)).alias("gram"))
        .groupBy("gram").agg(F.count_if("a").alias("a"), F.count_if("r").alias("r")), root, "strings")
    # one row; the number of different characters is all that this brings back
    p = grams.agg(F.count_distinct(F.right("gram", F.lit(1))).alias("n")).select(
        F.lit("").alias("tail"), (1.0 / F.greatest("n", F.lit(1))).alias("pa"), (1.0 / F.greatest("n", F.lit(1))).alias("pr"))
    for k in range(order + 1):
        context = Window.partitionBy(F.substring("gram", 1, k))
        level = grams.groupBy(F.right("gram", F.lit(k + 1)).alias("gram")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
        level = level.select("gram", F.right("gram", F.lit(k)).alias("tail") if k else F.lit("").alias("tail"), "a", "r",
                             *[f(c).over(context).alias(f"{n}{c}") for c in "ar" for n, f in (("n", F.sum), ("t", lambda c: F.count_if(F.col(c) > 0)))])
        mixed = [F.when(F.col(f"n{c}") > 0, (F.col(c) + F.col(f"t{c}") * F.col(f"p{c}")) / (F.col(f"n{c}") + F.col(f"t{c}")))
                 .otherwise(F.col(f"p{c}")).alias(f"p{c}") for c in "ar"]
        p = level.join(p, "tail").select("gram", *mixed)
        if k < order:
            p = p.withColumnRenamed("gram", "tail")
    return _written(p.select("gram", F.floor((F.log("pa") - F.log("pr")) * 1e6 + 0.5).cast("long").alias("micro")), root, "ratios")


def score_addresses(addresses: DataFrame, ratios: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, accepted, held_out, micro, chars) per address."""
    if ratios.count() <= BROADCAST_ROWS:
        ratios = F.broadcast(ratios)
    return (addresses.select("key", "accepted", "held_out", F.explode(_strings(F.col("address"), order)).alias("gram"))
            .join(ratios, "gram").groupBy("key")
            .agg(F.first("accepted").alias("accepted"), F.first("held_out").alias("held_out"),
                 F.sum("micro").alias("micro"), F.count("*").alias("chars"))
            .withColumn("step", F.floor(F.col("micro") / (F.col("chars") * STEP)).cast("long")))


def calibrated_limit(scored: DataFrame, max_false: float = MAX_FALSE) -> int | None:
    """Addresses whose score is below the limit's step are blocked; None if the
    held-out addresses cannot tell. Steps are no more than the log ratio's range."""
    steps = (scored.where("held_out").groupBy("step")
             .agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("r")))
    upto = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # any limit up to the next step blocks the same; the middle keeps away from both
    middle = F.floor((F.col("step") + 1 + F.coalesce(F.lead("step").over(Window.orderBy("step")), F.col("step") + 1)) / 2)
    best = (steps.select(middle.alias("limit"), F.sum("a").over(upto).alias("a"), F.sum("r").over(upto).alias("r"),
                         F.sum("a").over(everything).alias("all_a"), F.sum("r").over(everything).alias("all_r"))
            .where((F.col("all_a") > 0) & (F.col("all_r") > 0) & (F.col("a") <= max_false * F.col("all_a")))
            .orderBy((F.col("r") * F.col("all_a") - F.col("a") * F.col("all_r")).desc(), "limit").first())
    return None if best is None else int(best["limit"])


def filter_urls(pages: DataFrame, rules: list[Rule] | None = None, rejected_words: list[str] | None = None,
                max_false: float = MAX_FALSE, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: host, path, rule and verdict, the method's own verdict
    and its score (mean log ratio; null without an address)."""
    rules = RULES if rules is None else rules
    words = REJECTED_WORDS if rejected_words is None else rejected_words
    spark = pages.sparkSession
    root = scratch_path(spark, "url-filter")
    addresses = _written(labelled_addresses(pages, rules, words, url_col), root, "addresses")
    scored = _written(score_addresses(addresses, log_ratios(addresses, root)), root, "scored")
    trained = addresses.where("NOT held_out").agg(F.bool_or("accepted").alias("a"), F.bool_or(~F.col("accepted")).alias("r")).first()
    limit = calibrated_limit(scored, max_false) if trained["a"] and trained["r"] else None
    if limit is None and trained["a"] and trained["r"]:
        limit = 0  # nothing held out to calibrate by: the more likely class
    blocked = F.lit(False) if limit is None else F.coalesce(F.col("step") < limit, F.lit(False))
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    method = F.when(blocked, F.lit("block")).otherwise("allow")
    return (parsed.withColumn("key", F.md5(F.concat("host", "path")))
            .join(scored.select("key", "step", (F.col("micro") / (F.col("chars") * 1e6)).alias("score")), "key", "left")
            .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"),
                    method.alias("method_verdict"), "score"))
