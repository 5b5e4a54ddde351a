"""CSV job lists and rule tables (``src_jobs_csv``, ``src_rule_csv``,
``src_required_cols``, ``src_drop_embedded_header``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pipelens.session import scratch_path

REQUIRED_JOB_COLUMNS = ["job_name", "job_type"]
RULE_FILES = {
    "app": ("app_codes.csv", ["old_prefix", "new_app_code"]),
    "schedule": ("schedule_codes.csv", ["old_schedule", "new_schedule"]),
    "subject": ("subject_areas.csv", ["pattern", "match_type", "subject_code", "category"]),
    "etl": ("etl_job_types.csv", ["old_suffix", "new_etl_code"]),
    "as_type": ("as_job_types.csv", ["old_job_type", "new_as_type"]),
}


def read_string_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All-string CSV with a header: names trimmed and lower-cased, nulls -> ''.
    ``input_order`` = position over all files by path (0, 1, 2, ...), however
    they are split. Without ``multi_line`` (no line breaks inside quotes) large
    files are read in parts."""
    raw = (spark.read.option("header", True).option("inferSchema", False)
           .option("multiLine", multi_line).option("escape", '"').csv(path))
    names = [c.strip().lower() for c in raw.columns]
    if "input_order" in names:
        return raw.toDF(*names).fillna("")
    placed = with_positions(raw, "input_order")
    return placed.toDF(*names, "input_order").fillna("", names)


def with_positions(files: DataFrame, out: str) -> DataFrame:
    """Rows of a file scan with their position over all files, by file path and
    place in the file.

    Rows of one split have consecutive ``monotonically_increasing_id`` values, so
    a row's place in its split is its id less the split's smallest. Rows are
    written once with file, split start and id; the splits' row counts, summed up
    in the order of (file, start), give each split's first position. The table of
    splits has one row per split, and no row is moved by a shuffle while it is
    small enough to broadcast."""
    spark = files.sparkSession
    path = scratch_path(spark, "positions")
    files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
                 F.monotonically_increasing_id().alias("_id")).write.parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("_file", "_start").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_n")).select(
        "_file", "_start", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_shift"))
    return rows.join(splits, ["_file", "_start"]).select(
        *files.columns, (F.col("_id") + F.col("_shift")).alias(out))


def require_columns(df: DataFrame, required=REQUIRED_JOB_COLUMNS) -> DataFrame:
    """``src_required_cols``: fail early when a column is missing."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"input CSV missing required columns: {missing}; found {df.columns}")
    return df


def drop_embedded_headers(df: DataFrame, col: str = "row") -> DataFrame:
    """``src_drop_embedded_header``: keep rows whose ``row`` is numeric
    (when that column exists)."""
    if col not in df.columns:
        return df
    return df.where(is_data_row(col))


def is_data_row(col: str = "row") -> F.Column:
    """True when ``col`` parses as a number (not NaN)."""
    v = F.expr(f"try_cast(trim(`{col}`) AS double)")
    return v.isNotNull() & ~F.isnan(v)


def read_jobs_csv(spark: SparkSession, path: str) -> DataFrame:
    """``src_jobs_csv``: the job list, checked and without embedded headers."""
    return drop_embedded_headers(require_columns(read_string_csv(spark, path)))


def read_rule_csvs(spark: SparkSession, folder: str):
    """``src_rule_csv``: the five rule tables of a mapping folder as a RuleSet
    (``rule_order`` = file position, so last-wins / first-wins rules hold)."""
    from pipelens.plans.rename import RuleSet
    tables = {}
    for key, (name, cols) in RULE_FILES.items():
        df = read_string_csv(spark, f"{folder}/{name}")
        df = require_columns(df, cols).withColumnRenamed("input_order", "rule_order")
        tables[key] = df.select("rule_order", *cols)
    return RuleSet(**tables)


def write_csv(df: DataFrame, path: str) -> None:
    """``sink_csv``: header CSV, whitespace kept as is."""
    (df.write.mode("overwrite").option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("escape", '"').csv(path))
