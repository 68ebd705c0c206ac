"""Queries on equal texts: null texts, null sources, and no text in a shuffle."""

from __future__ import annotations

import duckdb
import pytest

from tidewright.plans import catalog

catalog.load_all()
ROWS = [(1, "a b", "en", "s1"), (2, "a b", "en", "s0"), (3, "a b", "de", "s0"), (4, "a b", "de", "s2"), (5, None, "en", "s1"), (6, None, "en", "s0"), (7, "", "en", None), (8, "", "en", "s3"), (9, "", "en", "s4"), (10, "c", None, None), (11, "c", None, None)]


@pytest.mark.parametrize("name", ["l6_replayed_scores", "j8_exact_overlap"])
@pytest.mark.parametrize("n", [0, len(ROWS)])
def test_equal_texts_meet_by_digest(spark, tmp_path, name, n):
    docs = spark.createDataFrame(ROWS[:n], "doc_id long, text string, lang string, source string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in told.description]
    found = catalog.QUERIES[name](spark, str(tmp_path))
    assert sorted(tuple(r[c] for c in names) for r in found.collect()) == sorted(told.fetchall())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Exchange" in x and "partitioning(text" in x]
