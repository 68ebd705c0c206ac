"""Readers with explicit schemas and checked writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Spellings of a missing value.
MISSING = ("", "na", "n/a", "null", "none", "unknown")

RAW_RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("source_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("time_to_competition_days", T.StringType()),
        T.StructField("sport", T.StringType()),
        T.StructField("source_type", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("synthetic", T.BooleanType()),
        T.StructField("deidentified", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_string(value: Column) -> Column:
    """The trimmed string; a spelling of a missing value becomes null."""
    t = F.trim(value)
    return F.when(~F.lower(t).isin(*MISSING), t)


def clean_int(value: Column) -> Column:
    """The whole part of a number written as text; anything else is null."""
    return clean_string(value).try_cast("double").try_cast("int")


def read_jsonl(spark: SparkSession, path: str, source_id: str, schema: T.StructType = RAW_RECORD) -> DataFrame:
    """Records of JSON lines. Blank lines are skipped; a record without an id gets source_id and its line number within its
    file (blank lines counted); unknown keys are dropped; lines that are no JSON give a record of nulls."""
    lines = _numbered(spark.read.text(path), ["value"])
    parsed = lines.where(F.trim("value") != "").select("line", F.from_json("value", schema).alias("r")).select("line", "r.*")
    return _typed(parsed, source_id)


def read_csv(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Records of a CSV file with a header; a text column is required."""
    rows = spark.read.option("header", True).option("multiLine", True).csv(path)
    if "text" not in rows.columns:
        raise ValueError("a text column is required")
    have = [F.col(f.name) if f.name in rows.columns else F.lit(None).cast("string").alias(f.name) for f in RAW_RECORD]
    own = rows.select(*have, "_metadata")
    return _typed(_numbered(own, [f.name for f in RAW_RECORD]), source_id)


def _numbered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of rows read from files, with their number from 0 within the file as `line`. Rows are counted by the blocks in
    which files are read, so a file may be split."""
    placed = rows.select(*columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    blocks = placed.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy("__file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    return placed.join(starts, ["__file", "__block"]).select(*columns, (F.col("__start") + F.col("__at") - F.col("__first")).alias("line"))


def _typed(rows: DataFrame, source_id: str) -> DataFrame:
    own_id = F.concat(F.lit(f"{source_id}-"), F.lpad(F.col("line").cast("string"), 6, "0"))
    return rows.select(
        F.coalesce(clean_string(F.col("record_id")), own_id).alias("record_id"),
        F.coalesce(clean_string(F.col("source_id")), F.lit(source_id)).alias("source_id"),
        "text",
        clean_int(F.col("time_to_competition_days")).alias("time_to_competition_days"),
        *(clean_string(F.col(c)).alias(c) for c in ("sport", "source_type", "language")),
        *(F.col(c).cast("boolean").alias(c) for c in ("synthetic", "deidentified")),
    )


def read_any(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """Reads .jsonl, .ndjson and .csv; other suffixes are refused."""
    low = path.lower()
    if low.endswith((".jsonl", ".ndjson")):
        return read_jsonl(spark, path, source_id)
    if low.endswith(".csv"):
        return read_csv(spark, path, source_id)
    raise ValueError(f"unknown suffix: {path}")


def violations(rows: DataFrame, key: str, checks: dict[str, Column]) -> DataFrame:
    """(key, reason) for every failed check of every row."""
    failed = F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())
    return rows.select(key, F.explode(failed).alias("reason"))


def write_source(rows: DataFrame, path: str, key: str = "record_id", forbidden: tuple[str, ...] = ("generation_spec",)) -> None:
    """Writes one partition folder for each source. Forbidden columns, null and repeated keys are refused before anything is written."""
    if bad := [c for c in forbidden if c in rows.columns]:
        raise ValueError(f"forbidden columns: {bad}")
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col(key).isNull() | (F.col("n") > 1))
    if not repeated.isEmpty():
        raise ValueError(f"null or repeated {key}")
    rows.write.mode("errorifexists").partitionBy("source_id").parquet(path)
