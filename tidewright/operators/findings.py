"""Detectors of identifiers and secrets in released text, with a canary that each of them must find first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.functions.text import silhouette

#: The detectors (kind, severity, pattern).
DETECTORS = (
    ("private_key", "HIGH", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    ("credential_assignment", "HIGH", r"(?i)[A-Za-z0-9_-]*(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*['\"]?(sk-[A-Za-z0-9._-]{16,}|gh[pousr]_[A-Za-z0-9]{20,}|[A-Za-z0-9+/]{32,}={0,2})"),
    ("email", "MEDIUM", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("windows_user_path", "LOW", r"[A-Za-z]:\\Users\\[A-Za-z0-9._-]+"),
    ("posix_home_path", "LOW", r"/(?:home|Users)/[A-Za-z0-9._-]+"),
    ("social_handle", "LOW", r"(?<![A-Za-z0-9._%+-])@[A-Za-z][A-Za-z0-9_]{4,}\b"),
    ("phone_number", "MEDIUM", r"(?<![\w.])\+?\d[\d\s().-]{7,}\d(?![\w.])"),
)
WAIVER = "pragma: allowlist secret"
#: A text on which every detector must fire.
CANARY = "\n".join((
    "-----BEGIN RSA PRIVATE KEY-----", "OPENROUTER_API_KEY = '" + "a1B2" * 9 + "'", "write to someone@example.org now", "C:\\Users\\someone\\file", "see /home/someone/file",
    "ask @someone_there about it", "call +44 20 7946 0958 today",
))


def _plausible_phone(hit: Column) -> Column:
    digits = F.length(F.regexp_replace(hit, "[^0-9]", ""))
    return digits.between(9, 15) & ~hit.rlike(r"\d\.\d") & ~F.trim(hit).rlike(r"^\d{4}-\d{2}-\d{2}$") & ~hit.contains("(")


def _findings(hits: Column, kind: str, severity: str, waived: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), silhouette(h).alias("evidence"), waived.alias("waived")))


def _of_line(line: Column) -> Column:
    """All findings of one line: (kind, severity, evidence, waived). Evidence is a silhouette, never the text."""
    found = []
    for kind, severity, pattern in DETECTORS:
        hits = F.regexp_extract_all(line, F.lit(pattern), F.lit(0))
        if kind == "phone_number":
            hits = F.filter(hits, _plausible_phone)
        if kind == "social_handle":  # decorators and entry types begin their line
            hits = F.when(line.rlike(r"^\s*@"), F.array().cast("array<string>")).otherwise(hits)
        found.append(_findings(hits, kind, severity, line.contains(WAIVER)))
    return F.concat(*found)


def scan(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, severity, evidence, waived) of every finding, line by line from 1. Only lines that hold a mark of some
    detector are read by all of them. Null texts have no lines."""
    marks = r"@|-----BEGIN|(?i:key|secret|token|passw)|:\\Users|/home/|/Users/|\d[\d\s().-]{7,}\d"
    lines = rows.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("at", "body")).where(F.col("body").rlike(marks))
    return lines.select(key, (F.col("at") + 1).cast("long").alias("line"), F.explode(_of_line(F.col("body"))).alias("f")).select(key, "line", "f.*")


def gated_scan(rows: DataFrame, key: str, text: str, canary: str = CANARY) -> DataFrame:
    """scan(), which fails where a detector doesn't fire on the canary: a clean result counts only from a scanner that can find."""
    spark = rows.sparkSession
    fired = {r["kind"] for r in scan(spark.createDataFrame([(0, canary)], "id int, body string"), "id", "body").select("kind").distinct().collect()}
    if silent := {k for k, _, _ in DETECTORS} - fired:
        raise RuntimeError(f"detectors that miss the canary: {', '.join(sorted(silent))}")
    return scan(rows, key, text)
