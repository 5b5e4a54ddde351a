import pytest
from pyspark.sql import functions as F

from pipelens.functions import names as N
from pipelens.operators import rules as R
from pipelens.plans import rename


def _one(spark, col, value="x"):
    return spark.createDataFrame([(value,)], "s string").select(col.alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("name,version,expect", [
    ("PR_TXNDW_OD_X_CMD", 1, ("PR", "TXNDW", "CMD", "OD_X", False)),
    ("PR_TXNDW_OD_X_CMD", 2, ("TXNDW", "OD", "CMD", "X", False)),
    ("P-TXNDW_D_LOAN_LOAD_BX", 2, ("TXNDW", "D", "BX", "LOAN_LOAD", False)),
    ("GEMMA_ZZZDAC_ORZZZZ_CH815_SNOW_RCSA_CONT_INST_XRE", 2,
     ("GEMMA", "D", "", "ORZZZZ_CH815_SNOW_RCSA_CONT_INST_XRE", True)),
    ("", 2, ("", "", "", "", False)),
    ("SOLO", 2, ("SOLO", "", "", "", False)),
    ("A_D_BX", 2, ("A", "D", "BX", "", False)),
])
def test_parse_goldens(spark, name, version, expect):
    df = spark.createDataFrame([(name,)], "n string")
    r = df.select(N.parse_name("n", version).alias("p")).collect()[0]["p"]
    assert (r.app_prefix, r.schedule_token, r.type_suffix, r.suffix_body, r.is_zzz) == expect


def test_longest_prefix_golden(spark):
    rules = spark.createDataFrame(
        [(0, "prefix", "AB", "S1", "raw"), (1, "prefix", "ABC", "S2", "raw")],
        "rule_order long, match_type string, pattern string, subject_code string, category string")
    sr = R.subject_rules(rules)
    jobs = spark.createDataFrame([(1, "abcd_D"), (2, "ABX"), (3, "Q")], "k long, job_name string")
    got = {r["k"]: (r["_prefix"]["subject_code"] if r["_prefix"] else None)
           for r in R.match_longest_prefix(jobs, "job_name", sr).collect()}
    assert got == {1: "S2", 2: "S1", 3: None}


def test_regex_first_in_file_order(spark):
    rules = spark.createDataFrame(
        [(0, "regex", "card", "C1", "raw"), (1, "regex", "CARDS?", "C2", "raw")],
        "rule_order long, match_type string, pattern string, subject_code string, category string")
    jobs = spark.createDataFrame([(1, "X_CARDS_Y"), (2, "none")], "k long, job_name string")
    got = {r["k"]: (r["_regex"]["subject_code"] if r["_regex"] else None)
           for r in R.match_regex(jobs, "job_name", R.subject_rules(rules)).collect()}
    assert got == {1: "C1", 2: None}


def test_derive_subject_goldens(spark):
    df = spark.createDataFrame([("MORTA_D_LOAN_FEE_BX", 0), ("MORTA_D_ABC_DEF_BX", 3),
                                ("MORTA_D_ABC_DEF_BX", 2)], "n string, cnt long")
    rows = df.select(N.derive_subject(N.candidate_tokens("n", F.array(F.lit("MORTA"))), "cnt")
                     .alias("d"), N.category_from_tokens("n").alias("cat")).collect()
    assert (rows[0]["d"].subject_code, rows[0]["d"].strip, rows[0]["cat"]) == ("LOANXX", ["LOAN"], "other")
    assert (rows[1]["d"].subject_code, sorted(rows[1]["d"].strip)) == ("ABCDEF", ["ABC", "DEF"])
    assert (rows[2]["d"].subject_code, rows[2]["d"].strip) == ("ABCXXX", ["ABC"])


def test_clean_suffix_goldens(spark):
    assert _one(spark, N.clean_suffix(F.lit("MORTA_LOAN_RAW_LOAD_X_DAILY"), F.lit("MORTA"),
                                      F.array(F.lit("LOAN")))) == "LOAD_DAILY"
    assert _one(spark, N.clean_suffix(F.lit("LOAD"), F.lit("MORTA"),
                                      F.array().cast("array<string>"))) == "LD"
    # each subject token is removed once only
    assert _one(spark, N.clean_suffix(F.lit("LOAN_X1_LOAN"), F.lit("MORTA"),
                                      F.array(F.lit("LOAN")))) == "X1_LOAN"


def test_build_name_golden(spark):
    name = N.build_name(F.lit("MORTA"), F.lit("E01"), F.lit("P"), F.lit("D"), F.lit("C"),
                        F.lit("LOANXX"), F.lit("B"), F.lit(6000), F.lit("DAILY"))
    assert _one(spark, name) == "MORTA_E01PDC_LOANXX_B6000_DAILY"
    assert _one(spark, N.zfill4(F.lit(12345))) == "12345"
    assert _one(spark, N.zfill4(F.lit(7))) == "0007"


def test_validate_and_status(spark):
    viol = N.validate_name(F.lit("MORTA_E01PDC_LOANXX_B6000"), F.lit("MORTA"), F.lit("E01"),
                           F.lit("Z"), F.lit("C"), F.lit("LOANXX"), F.lit("B"), F.lit(6000))
    v = _one(spark, viol)
    assert v == ["schedule 'Z' not in allowed set ['A', 'D', 'H', 'M', 'O', 'Q', 'R', 'W', 'Y']"]
    df = spark.createDataFrame([(False, False), (True, False)], "exc boolean, rev boolean")
    got = [r["s"] for r in df.select(N.status("exc", "rev", F.array(F.lit("v"))).alias("s")).collect()]
    assert got == ["NEEDS_REVIEW", "EXCEPTION"]


def _rules(spark, subject_rows):
    def frame(rows, schema):
        return spark.createDataFrame([(i,) + tuple(r) for i, r in enumerate(rows)],
                                     "rule_order long, " + schema)
    return rename.RuleSet(
        app=frame([("MORTA", "MORTA")], "old_prefix string, new_app_code string"),
        schedule=frame([("D", "D")], "old_schedule string, new_schedule string"),
        etl=frame([("BX", "B")], "old_suffix string, new_etl_code string"),
        as_type=frame([("CMD", "C")], "old_job_type string, new_as_type string"),
        subject=frame(subject_rows, "pattern string, match_type string, subject_code string, "
                                    "category string"))


def test_sequential_ids_v2_golden(spark):
    jobs = spark.createDataFrame(
        [(0, "MORTA_D_LOAN_RAW_BX", "CMD", "Morta"), (1, "MORTA_D_LOAN_RAW_X_BX", "CMD", "Morta"),
         (2, "MORTA_D_LOAN_RAW_Y_BX", "CMD", "Morta"), (3, "MORTA_D_LOAN_NDM_BX", "CMD", "Morta")],
        "input_order long, job_name string, job_type string, application_name string")
    out = rename.rename_v2(jobs, _rules(spark, [("ZZZNOMATCH", "exact", "X", "raw")]), "E01", "P")
    got = [r["job_id"] for r in out.orderBy("input_order").collect()]
    assert got == ["1000", "1001", "1002", "5000"]
    r0 = out.orderBy("input_order").collect()[0]
    assert r0["new_job_name"] == "MORTA_E01PDC_LOANXX_B1000"
    assert r0["status"] == "NEEDS_REVIEW"
    assert r0["notes"] == "Subject area auto-derived from job name tokens; verify in subject_areas.csv"


def test_rename_v2_exception_and_v1(spark):
    jobs = spark.createDataFrame([(0, "PR_MORTA_D_LOAN_BX", "CMD", "")],
                                 "input_order long, job_name string, job_type string, application_name string")
    rs = _rules(spark, [("MORTA_D", "prefix", "MORTAD", "raw")])
    v2 = rename.rename_v2(jobs, rs, "E01", "P").collect()[0]
    assert v2["status"] == "EXCEPTION" and v2["app_code"] == "MORTA"
    assert v2["notes"].startswith("application_name '' is empty or invalid")
    v1 = rename.rename_v1(jobs, rs, "E01", "P").collect()[0]
    assert v1["app_code"] == "PRXXX" and v1["status"] == "EXCEPTION"
    assert v1["subject_code"] == "UNKNWN" and v1["job_id"] == "3000"
    summary = {r["status"]: r["n"] for r in rename.status_summary(rename.rename_v2(jobs, rs, "E01", "P")).collect()}
    assert summary == {"SUCCESS": 0, "NEEDS_REVIEW": 0, "EXCEPTION": 1, "TOTAL": 1}


def test_bad_instance_code(spark):
    jobs = spark.createDataFrame([(0, "A_D", "", "")],
                                 "input_order long, job_name string, job_type string, application_name string")
    with pytest.raises(ValueError):
        rename.rename_v2(jobs, _rules(spark, []), "E0", "P")


def test_checked_broadcast_respects_limit(spark):
    df = spark.range(3)
    assert "broadcast" not in R.checked_broadcast(df, max_rows=1)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" in R.checked_broadcast(df, max_rows=10)._jdf.queryExecution().logical().toString().lower()


def test_many_regex_rules_after_repartition(spark):
    from pipelens.operators import rules as R
    table = R.subject_rules(spark.createDataFrame(
        [(i, f"^JOB{i}_", "regex", f"S{i}", "raw") for i in range(1000)] + [(2000, "7_", "regex", "LAST", "raw")],
        "rule_order long, pattern string, match_type string, subject_code string, category string"))
    jobs = spark.createDataFrame([(f"job{i}_x",) for i in range(0, 1000, 7)] + [("NONE_7_",), (None,)],
                                 "job_name string").repartition(7)
    got = {r.job_name: r._regex and r._regex.subject_code for r in R.match_regex(jobs, "job_name", table).collect()}
    assert got == {f"job{i}_x": f"S{i}" for i in range(0, 1000, 7)} | {"NONE_7_": "LAST", None: None}


def test_clean_suffix_names_each_step_once(spark):
    """A step named twice is evaluated twice by Spark; steps that build on each
    other then multiply."""
    df = spark.createDataFrame([("MORTA_LOAN_LOAD_A1_LOAN", "MORTA", ["LOAN"]), (None, "MORTA", None), ("A_BC", None, ["BC"])],
                               "body string, app string, strip array<string>")
    out = df.select(N.clean_suffix("body", "app", "strip").alias("r"))
    assert [r.r for r in out.collect()] == ["LOAD_A1_LOAN", None, ""]
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("upper(app") == 1 and plan.count(r"(?i)\bLOAD\b") == 1


def test_jobs_are_shuffled_for_the_numbering_only(spark):
    """Pair counts and regex hits are written and broadcast; the write of the
    jobs has no shuffle."""
    from pipelens.sources import driver_tables as D
    jobs = spark.createDataFrame([(i, f"TXNDW_D_AB{i % 3}_CDE_BX", "CMD", "Txn") for i in range(40)],
                                 "input_order long, job_name string, job_type string, application_name string")
    seen = []
    write, rename.materialize = rename.materialize, lambda df, path: (seen.append(df), write(df, path))[1]
    try:
        out = rename.rename_v2(jobs, D.rule_set(spark), "E01", "P")
    finally:
        rename.materialize = write
    assert out.count() == 40
    plan = seen[-1]._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join " in x]
    assert joins and all("strategy=broadcast" in x for x in joins)
