"""Text functions, readers and fitted operators on hand-made rows."""

from __future__ import annotations

import json

import duckdb
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.functions import udfs
from tidewright.operators import duplicates, joins, learning, metrics, panel, sampling
from tidewright.plans import catalog
from tidewright.sources import readers


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "t string").select(make(F.col("t")).alias("v")).first()["v"]


def test_tokens_keep_placeholders(spark):
    assert one(spark, "[NAME] didn't GO", X.tokenise) == ["[NAME]", "didn't", "go"]


@pytest.mark.parametrize(
    "text, reason",
    [(None, "empty"), ("  ", "empty"), ("12345 67890 !!!!", "not_letters"), ("hello there", "too_short"), ("zzzz bbbb cccc dddd ffff", "not_words"), ("go on go on go on go on go on go on go on", "repetition"), ("lorem ipsum dolor amet elit tempor", "not_language"), ("I am ready for the race and I feel good about it", "ok")],
)
def test_admission(spark, text, reason):
    assert one(spark, text, X.admission) == reason


def test_junk_flags(spark):
    assert one(spark, "go go go (now", X.junk_flags) == ["unbalanced_brackets", "truncated_ending", "repeated_token_run"]
    assert one(spark, "[NAME]", X.junk_flags) == ["too_short", "no_alphabetic_content", "placeholder_only", "truncated_ending"]
    assert one(spark, "A healthy sentence, all of it.", X.junk_flags) == []


def test_normalise(spark):
    said = "“A” – b​\x07 ,c......\r\n\n\n\nd —e  f "
    assert one(spark, said, X.normalise) == '"A" - b,c...\n\nd — e f'
    again = one(spark, one(spark, said, X.normalise), X.normalise)
    assert again == '"A" - b,c...\n\nd — e f'


def test_language(spark):
    assert one(spark, "the cat and the dog are in the house", X.language)["language"] == "en"
    assert one(spark, "der hund und die katze sind in", X.language)["language"] == "de"
    assert one(spark, "one two", X.language)["language"] == "und"


@given(st.text(alphabet="ab.!? \n\"')", max_size=60))
def test_segment_offsets_are_exact(text):
    last = 0
    for s in udfs.segments(text):
        assert text[s["start"] : s["end"]] == s["text"] and s["start"] >= last
        last = s["end"]


def test_segments_skip_abbreviations_and_numbers():
    assert [s["text"] for s in udfs.segments('Dr. Ray ran 3.5 miles. "Good!" she said. J. Doe left')] == ["Dr. Ray ran 3.5 miles.", '"Good!"', "she said.", "J. Doe left"]
    assert udfs.segments(None) == udfs.segments("  ") == []


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"text": "x", "sport": " N/A ", "time_to_competition_days": "3.0", "other": 1}) + "\n\n" + json.dumps({"record_id": "r9", "text": "y", "time_to_competition_days": "soon"}) + "\n")
    got = {r["record_id"]: r for r in readers.read_any(spark, str(tmp_path / "a.jsonl"), "s").collect()}
    assert set(got) == {"s-000000", "r9"} and got["s-000000"]["time_to_competition_days"] == 3 and got["s-000000"]["sport"] is None and got["r9"]["time_to_competition_days"] is None
    (tmp_path / "b.csv").write_text("text,sport\nhello,row\n")
    assert readers.read_any(spark, str(tmp_path / "b.csv"), "s").first()["sport"] == "row"
    (tmp_path / "c.csv").write_text("a\n1\n")
    for bad in ("c.csv", "d.txt"):
        with pytest.raises(ValueError):
            readers.read_any(spark, str(tmp_path / bad), "s")


def test_writer_refuses_repeated_keys_and_forbidden_columns(spark, tmp_path):
    rows = spark.createDataFrame([("a", "s"), ("a", "s")], "record_id string, source_id string")
    with pytest.raises(ValueError):
        readers.write_source(rows, str(tmp_path / "x"))
    with pytest.raises(ValueError):
        readers.write_source(rows.withColumn("generation_spec", F.lit(1)), str(tmp_path / "x"))
    readers.write_source(rows.distinct(), str(tmp_path / "x"))
    assert spark.read.parquet(str(tmp_path / "x")).count() == 1


def test_similar_items_hold_every_row(spark):
    ten = [f"t{k}" for k in range(10)]
    texts = [" ".join(ten), " ".join(reversed(ten)), " ".join(ten + ten[:3]), " ".join(ten[:9]), "alone here", "", "", "twice twice", "twice"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = {r["id"]: (r["class_id"], r["copies"], r["links"]) for r in duplicates.similar_items(rows, "id", X.whitespace_tokens(F.col("t")), 0.9).collect()}
    assert got == {0: (0, 3, 3), 1: (0, 3, 3), 2: (0, 3, 3), 3: (3, 1, 3), 4: (4, 1, 0), 5: (None, 0, 0), 6: (None, 0, 0), 7: (7, 2, 1), 8: (7, 2, 1)}


def test_similar_pairs_at_the_threshold(spark):
    sets = [(1, "a b c d e f g h i"), (2, "a b c d e f g h i j"), (3, "a b c d e f g h x y"), (4, ""), (5, ""), (6, "a b c d e f g h i")]
    rows = spark.createDataFrame(sets, "id long, t string")
    got = {(r["a"], r["b"], round(r["jaccard"], 6)) for r in duplicates.similar_pairs(rows, "id", X.whitespace_tokens(F.col("t")), 0.9).collect()}
    assert got == {(1, 2, 0.9)}


def test_interval_overlap_takes_the_first_of_equal_ones(spark):
    left = spark.createDataFrame([("u", 1, 0.0, 10.0), ("u", 2, 50.0, 60.0)], "k string, id long, start double, end double")
    right = spark.createDataFrame([("u", 7, 2.0, 4.0), ("u", 8, 6.0, 8.0), ("u", 9, 9.0, 10.5)], "k string, rid long, rstart double, rend double")
    assert [tuple(r) for r in joins.interval_overlap(left, right, "k", 5.0).collect()] == [("u", 1, 7, 2.0)]


def test_strict_inner_refuses_lost_rows(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError):
        joins.strict_inner(a, b, "k")


def test_scores_of_nothing_are_zero(spark):
    rows = spark.createDataFrame([("x", 0, 0), ("y", 1, 1)], "label string, truth int, pred int")
    got = {r["label"]: r["f1"] for r in metrics.scores(metrics.confusion(rows, "label")).collect()}
    assert got == {"x": 0.0, "y": 1.0}


def test_constant_ranks_have_no_correlation(spark):
    rows = spark.createDataFrame([("a", 1.0, k) for k in range(5)] + [("b", float(k), k) for k in range(5)], "k string, x double, y long")
    assert {r["k"]: r["rho"] for r in panel.spearman(rows, "k", "x", "y").collect()} == {"a": None, "b": 1.0}


def test_permutation_finds_a_planted_trend_only(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    rows = [("up", f"e{e}", d, float(d + rng.normal())) for e in range(12) for d in range(8)] + [("flat", f"e{e}", d, float(rng.normal())) for e in range(12) for d in range(8)]
    got = {r["c"]: r["p"] for r in learning.permutation_null(spark.createDataFrame(rows, "c string, e string, t long, v double"), "c", "e", "t", "v", 200).collect()}
    assert 0 < got["up"] < 0.02 < got["flat"]


def test_temperature_of_overconfident_scores_is_above_one(spark):
    rows = spark.createDataFrame([(0.99, int(k % 4 > 0)) for k in range(400)] + [(0.01, int(k % 4 == 0)) for k in range(400)], "p double, y int")
    assert learning.fit_temperature(rows, "p", "y") == pytest.approx(4.1827, abs=0.05)


def test_each_payload_is_called_once(spark, tmp_path):
    import pandas as pd

    def call(values):
        with open(tmp_path / "calls", "a") as f:
            f.writelines("x\n" for _ in values)
        return pd.DataFrame({"n": values.str.len()})

    rows = spark.createDataFrame([(k, "ab" if k % 2 else "c") for k in range(10)], "id long, t string")
    got = learning.expensive_once(rows, F.col("t"), call, "n long").cache()
    assert {r["id"]: r["n"] for r in got.collect()} == {k: 2 if k % 2 else 1 for k in range(10)}
    assert len((tmp_path / "calls").read_text().split()) == 2


def test_splits_are_stable_and_disjoint(spark):
    rows = spark.range(1000).withColumnRenamed("id", "k")
    a, b = (sorted(map(tuple, sampling.random_split(rows.repartition(n), "k", 0.2, 1).collect())) for n in (2, 7))
    assert a == b and sum(side == "test" for _, side in a) == 200


def test_balanced_draw_fills_rare_strata_first(spark):
    pool = spark.createDataFrame([(k, "a" if k < 8 else "b") for k in range(10)], "id long, s string")
    assert learning.balanced_draw(pool, "id", ["s"], 4) == [0, 8, 1, 9]


def test_nearest_in_blocks_is_the_same(spark):
    rows = spark.createDataFrame([(k, [float(k % 7), float(k % 5), 1.0]) for k in range(60)], "rid long, v array<float>")
    q = rows.where("rid % 5 = 0").select(F.col("rid").alias("qid"), F.col("v").alias("q"))
    a, b = (sorted(map(tuple, joins.cosine_nearest(q, rows, n).collect())) for n in (100, 5))
    assert a == b and len(a) == 12


def test_a_detector_that_misses_the_canary_stops_the_scan(spark):
    from tidewright.operators import findings

    rows = spark.createDataFrame([(1, "mail a@b.org\n@dataclass\nvalue 0.5462333333 on 2026-08-16"), (2, "b@c.org  # pragma: allowlist secret"), (3, None)], "id int, body string")
    got = sorted((r["id"], r["line"], r["kind"], r["evidence"], r["waived"]) for r in findings.gated_scan(rows, "id", "body").collect())
    assert got == [(1, 1, "email", "a@a.aaa", False), (2, 1, "email", "a@a.aaa", True)]
    with pytest.raises(RuntimeError, match="phone_number"):
        findings.gated_scan(rows, "id", "body", findings.CANARY.replace("+44 20 7946 0958", "nobody"))


def test_response_verdicts_of_odd_answers(spark):
    from tidewright.operators import validation

    rows = [(None, "EMPTY_RESPONSE", None), ("``` {} ```", "MISSING_KEYS", None), ('{"abstain": false, "rationale": "x", "confidence": 0, "labels": []}', "OK", True), ('{"abstain": null, "rationale": "x", "confidence": 0, "labels": []}', "BAD_ABSTAIN", None), ("12", "NOT_AN_OBJECT", None)]
    table = spark.createDataFrame([(raw, code, abstain) for raw, code, abstain in rows], "raw string, code string, abstain boolean")
    for r in table.select("code", "abstain", validation.response_verdict(F.col("raw"), F.lit("text"), {"worry": ()}).alias("v")).collect():
        assert (r["v"]["code"], r["v"]["abstain"]) == (r["code"], r["abstain"])


def test_first_kept_of_a_chain(spark):
    from tidewright.plans.q_inventory import first_kept

    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)], "a long, b long")
    assert {r["id"]: r["kept"] for r in first_kept(pairs).collect()} == {1: True, 2: False, 3: True, 4: False, 10: True, 11: False, 12: False}


def test_row_numbers_of_a_large_stratum(spark):
    from tidewright.operators import sampling

    rows = spark.range(1000).selectExpr("id", "if(id < 900, 'big', null) as s", "id % 7 as v")
    got = sampling.row_numbers(rows, "s", [F.col("v"), F.col("id")]).collect()
    for s in ("big", None):
        mine = sorted((r["v"], r["id"]) for r in got if r["s"] == s)
        assert [(r["v"], r["id"]) for r in sorted((r for r in got if r["s"] == s), key=lambda r: r["rn"])] == mine
        assert {r["rn_of"] for r in got if r["s"] == s} == {len(mine)}


def test_a_ledger_batch_that_runs_again_replaces_its_own_rows(spark, tmp_path):
    from tidewright.streaming import streams

    rows = spark.createDataFrame([("2024-01-05", 1, 2.0), ("2024-01-06", 1, 3.0), ("2024-02-01", 1, 4.0), ("2024-02-01", None, 1.0)], "d string, user_id long, value double").withColumn("t", F.to_timestamp("d"))
    write = streams.ledger_sink(str(tmp_path / "ledger"))
    write(rows, 0)
    write(rows.where("value < 3"), 1)
    write(rows, 0)
    got = sorted((r["batch_id"], r["month"], r["user_id"] or 0, r["spend"]) for r in streams.read_ledger(spark, str(tmp_path / "ledger")).collect())
    assert got == [(0, "2024-01", 1, 5.0), (0, "2024-02", 0, 1.0), (0, "2024-02", 1, 4.0), (1, "2024-01", 1, 2.0), (1, "2024-02", 0, 1.0)]


def test_clusters_of_far_apart_shapes(spark):
    rows = spark.createDataFrame([(k, float(k % 3 * 100 + k % 2), 1.0) for k in range(60)] + [(60, None, 1.0)], "id long, a double, flat double")
    got = {r["id"]: r["cluster"] for r in learning.cluster_shapes(rows, ["a", "flat"], 3).collect()}
    assert len(got) == 60 and all(got[k] == got[k % 3] for k in got) and len(set(got.values())) == 3


def test_text_model_on_held_out_rows(spark):
    import random

    rng = random.Random(4)
    words = {0: "river stone cloud meadow".split(), 1: "engine bolt gear piston".split()}
    rows = [(k, " ".join(rng.choice(words[k % 2] if rng.random() < 0.4 else ["the", "and", "of", "it"]) for _ in range(12)), k % 2) for k in range(300)]
    d = spark.createDataFrame([*rows, (300, None, 0)], "id long, t string, y int")
    told = learning.tfidf_logistic(d.where("id < 200"), d.where("id >= 200"), "t", "y").collect()
    assert len(told) == 101 and sum(r["pred"] == r["y"] for r in told) >= 95
    assert all(0 <= r["prob"] <= 1 and (r["prob"] > 0.5) == (r["pred"] == 1) for r in told)
    one_class = learning.tfidf_logistic(d.where("y = 1"), d.where("id >= 290"), "t", "y").collect()
    assert {(r["prob"], r["pred"]) for r in one_class} == {(1.0, 1)}


def test_compatibility_folding_is_nfkc(spark):
    import unicodedata

    said = [None, "", "plain", "ﬁne Å ２０ ① ㎞", "e\u0301 x\u00b2"]
    rows = spark.createDataFrame(list(enumerate(said)), "id int, t string")
    got = {r["id"]: r["f"] for r in rows.select("id", udfs.fold_compatibility(rows, "t").alias("f")).collect()}
    assert got == {k: t if t is None else unicodedata.normalize("NFKC", t) for k, t in enumerate(said)}


def test_balanced_draw_agrees_with_the_plain_rule_on_the_documents(spark, sf):
    from tidewright.plans import catalog

    catalog.load_all()
    got = [r["doc_id"] for r in catalog.QUERIES["w10_balanced_draw"](spark, sf).orderBy("place").collect()]
    docs = {r["doc_id"]: (("lang", r["lang"]), ("source", r["source"]), ("band", "short" if r["n_chars"] < 1000 else "long")) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want, seen = [], {}
    while len(want) < 40:
        best = min((sum(seen.get(s, 0) for s in strata), k) for k, strata in docs.items() if k not in want)[1]
        want.append(best)
        for s in docs[best]:
            seen[s] = seen.get(s, 0) + 1
    assert got == want


def test_trajectories_on_equal_last_points_and_on_the_edge_of_two_roundings(spark):
    rows = [("a", 1, 1.0), ("a", 2, 5.0), ("a", 2, 5.0), ("b", 3, 2.0), ("b", 3, 2.0)]
    found = {r["k"]: r["last_step"] for r in panel.trajectories(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v").collect()}
    assert found == {"a": 4.0, "b": 0.0}  # of equal last points the first that has a step
    # series of sf0.1 whose slopes lie on the edge of two roundings; the SQL's sums decide
    con = duckdb.connect()
    some = "(user_id = 845 and event_type = 'purchase') or (user_id = 284 and event_type = 'click')"
    con.execute(f"create view events as select * from '/root/testdata/sf0.1/events.parquet' where {some}")
    want = {r[0]: r[3] for r in con.execute(catalog.ORACLES["w1_trajectories"]).fetchall()}
    e = spark.read.parquet("/root/testdata/sf0.1/events.parquet").where(some).withColumn("day", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000))
    assert {r["user_id"]: r["slope"] for r in panel.trajectories(e, ["user_id", "event_type"], "day", "value").collect()} == want and len(want) == 2


def test_slopes_of_long_series(spark, monkeypatch):
    rows = spark.createDataFrame([("a", t, float(t * t % 17)) for t in range(50)], "k string, t long, v double")
    found = panel.trajectories(rows, ["k"], "t", "v").first()
    monkeypatch.setattr(panel, "MOST_POINTS", 10)
    assert panel.trajectories(rows, ["k"], "t", "v").first() == found


def test_workers_hold_a_few_rows_as_objects(spark, monkeypatch):
    from tidewright import session

    rows = spark.createDataFrame([(k, None if k == 3 else f"I am Ann Lee. ﬁne day {k}! I doubt it.") for k in range(20)], "doc_id long, text string").coalesce(1)
    batch = rows.toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(session, "ROWS_AT_ONCE", 7)
    parts = list(session.in_slices(iter([batch, batch])))
    assert [p.num_rows for p in parts] == [7, 7, 6] * 2 and [r for p in parts[:3] for r in p.to_pylist()] == batch.to_pylist()
    kind = batch.schema.field("text").type
    assert session.array_in_slices(batch.column("text"), kind, lambda t: t).to_pylist() == batch.column("text").to_pylist()
    assert len(session.array_in_slices(batch.column("text").slice(0, 0), kind, lambda t: t)) == 0
    got = {r["doc_id"]: r["s"] for r in rows.select("doc_id", udfs.segmented(rows, "text").alias("s")).collect()}
    assert {k: [x.asDict() for x in s] for k, s in got.items()} == {r["doc_id"]: udfs.segments(r["text"]) for r in rows.collect()}


def test_permutation_sums_leave_a_task_once_a_channel(spark):
    rows = spark.createDataFrame([(c, e, t, float((e * 7 + t * 3) % 11)) for c in ("a", "b") for e in range(300) for t in range(5)], "c string, e long, t int, v double")
    found = learning.permutation_null(rows, "c", "e", "t", "v", repeats=50)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan and "MapInArrow" in plan and len(found.collect()) == 2
