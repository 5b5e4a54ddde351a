import random
import re

from pyspark.sql import functions as F

from pipelens.operators import rules as R

SURE = {"^LOAN.*FEE": "LOAN", "abc?d": "AB", "ab+cd": "CD", "a|bcd": "", "(abc)?def": "DEF", "(abc)def": "DEF", "[A-Z]{2}xyz_[0-9]+": "XYZ_",
        r"\d+load\.csv$": "LOAD", "x{2,3}yz": "YZ", "((a)b)c": "", "(?x)abc": "", "abc": "ABC", "ab.*?cde+f": "CDE", r"\bfoo\b": "FOO",
        "[[a]b]cde": "", r"\Qa.b\E": "", "": "", "a*": "", "ab++cde?": "CD", "é_ü": "É_Ü", r"a\x41bcd": "", "ab{0}cde": "CDE"}


def rule_rows(spark, patterns):
    return spark.createDataFrame([(i, p, "regex", f"S{i}", "c") for i, p in enumerate(patterns)],
                                 "rule_order int, pattern string, match_type string, subject_code string, category string")


def test_sure_literals(spark):
    frame = spark.createDataFrame([(p,) for p in SURE], "p string")
    assert {r.p: r.lit for r in frame.select("p", R.sure_literal("p").alias("lit")).collect()} == SURE


def test_many_regex_rules_find_the_same_first_match(spark):
    rng = random.Random(12)
    words = ["LOAN", "FEE", "CARD", "RAW", "load", "Txn", "KAFKA", "GL", "X", "DAILY", "ABC", "ab", "q_z"]
    parts = ["LOAN", "f.e", "CARD_?", "[RT]AW", "load+", "tx*n", "KAF(KA)?", "^GL", "daily$", r"a\wc", "(ab|cd)", "q_z{1,2}", r"\d\d", "."]
    patterns = ["".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(300)] + ["^$", "nevermatches", "z{9}", "LO"]
    names = {"_".join(rng.choices(words, k=rng.randrange(1, 5))) + rng.choice(["", "12", "_7"]) for _ in range(800)} | {"", "a", "ab"}
    frame = spark.createDataFrame([(n,) for n in sorted(names)] + [(None,)], "name string")
    compiled = [re.compile(p, re.IGNORECASE) for p in patterns]
    expected = {n: next((f"S{i}" for i, c in enumerate(compiled) if c.search(n)), None) for n in names} | {None: None}
    for few in (10, 10_000):
        got = {r.name: r["_regex"] and r["_regex"].subject_code for r in R.match_regex(frame, "name", rule_rows(spark, patterns), few=few).collect()}
        assert got == expected


def test_regex_rules_join_by_trigram(spark):
    """Rules with a literal meet names by an equi-join, not in a nested loop."""
    rules = rule_rows(spark, [f"JOB{i:05d}[A-Z]" for i in range(3000)])
    names = spark.range(20_000).select(F.format_string("p_job%05dX", "id").alias("name"))
    out = R.match_regex(names, "name", rules)
    assert out.where("_regex IS NOT NULL").count() == 3000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_gram" in plan


def test_written_regex_hits_are_broadcast(spark, tmp_path):
    """With hits written and counted, the jobs are not shuffled to meet them."""
    rules = rule_rows(spark, ["^LOAN", "FEE$"])
    names = spark.createDataFrame([("LOAN_A", 1), ("x_fee", 2), ("other", 3), (None, 4)], "name string, k int")
    out = R.match_regex(names, "name", rules, path=str(tmp_path / "hits"))
    assert {r.k: r._regex and r._regex.subject_code for r in out.collect()} == {1: "S0", 2: "S1", 3: None, 4: None}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "Aggregate" not in plan
