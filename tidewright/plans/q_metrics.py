"""Queries that evaluate, score, sample and resample."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import lexicons as L
from tidewright.functions import text as X
from tidewright.operators import metrics, sampling
from tidewright.plans.catalog import query
from tidewright.plans.q_joins import _CUES, cue_hits
from tidewright.plans.q_text import docs_of
from tidewright.sources.readers import table


def predictions(spark, sf):
    """(doc_id, label, truth, pred, prob, band) in long form: length rules stand in for a system."""
    d = docs_of(spark, sf).select("doc_id", "n_chars", "lang").join(table(spark, sf, "labels"), "doc_id")
    one = lambda name, truth, cut, scale: F.struct(F.lit(name).alias("label"), F.col(truth).alias("truth"), (F.col("n_chars") > cut).cast("int").alias("pred"), F.round(F.least(F.lit(1.0), F.col("n_chars") / float(scale)), 6).alias("prob"))
    return d.select("doc_id", "lang", F.explode(F.array(one("quality", "quality", 500, 4000), one("toxic", "toxic", 2000, 9000))).alias("p")).select("doc_id", "lang", "p.*")


_P = """p as (select doc_id, lang, 'quality' as label, quality as truth, (n_chars > 500)::int as pred, round(least(1.0, n_chars / 4000), 6) as prob from documents join labels using (doc_id)
 union all select doc_id, lang, 'toxic', toxic, (n_chars > 2000)::int, round(least(1.0, n_chars / 9000), 6) from documents join labels using (doc_id)),
c as (select label, sum((truth = 1 and pred = 1)::int) as tp, sum((truth = 0 and pred = 1)::int) as fp, sum((truth = 1 and pred = 0)::int) as fn from p group by label),
f as (select *, case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end as f1 from c)"""


@query("a10_per_label_scores", f"with {_P} select label, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, round(case when tp + fp = 0 then 0 else tp / (tp + fp) end, 6) as precision, round(case when tp + fn = 0 then 0 else tp / (tp + fn) end, 6) as recall, round(f1, 6) as f1 from f")
def a10(spark, sf):
    s = metrics.scores(metrics.confusion(predictions(spark, sf), "label"))
    return s.select("label", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("a11_overall_scores", f"with {_P}, m as (select sum(tp) as tp, sum(fp) as fp, sum(fn) as fn from c), e as (select avg(ok) as s from (select doc_id, min((truth = pred)::int) as ok from p group by doc_id)) select round((select avg(f1) from f), 6) as macro_f1, round(2 * tp / (2 * tp + fp + fn), 6) as micro_f1, round(s, 6) as subset_accuracy from m, e")
def a11(spark, sf):
    return metrics.overall(predictions(spark, sf), "doc_id")


@query("a12_error_profile", f"with {_P} select label, lang, sum((truth = 0 and pred = 1)::int)::bigint as false_positives, sum((truth = 1 and pred = 0)::int)::bigint as false_negatives from p group by all")
def a12(spark, sf):
    c = metrics.confusion(predictions(spark, sf), "label", "lang")
    return c.select("label", "lang", F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"))


@query("t5_worst_records", f"with {_P} select doc_id, sum((truth <> pred)::int)::bigint as errors from p group by doc_id order by errors desc, doc_id limit 20")
def t5(spark, sf):
    return predictions(spark, sf).groupBy("doc_id").agg(F.sum((F.col("truth") != F.col("pred")).cast("long")).alias("errors")).orderBy(F.desc("errors"), "doc_id").limit(20)


@query("a13_multiset_overlap", "with t as (select item_id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') as w from benchmark), g as (select item_id, t, count(*) as n from (select item_id, unnest(w) as t from t) group by all), e as (select item_id, t, count(*) as n from (select item_id, unnest(list_transform(range(1, len(w) + 1), lambda i: case when i % 7 = 0 then '[x]' else w[i] end)) as t from t) group by all), j as (select coalesce(g.item_id, e.item_id) as item_id, coalesce(g.n, 0) as a, coalesce(e.n, 0) as b from g full join e on g.item_id = e.item_id and g.t = e.t) select item_id, sum(least(a, b))::bigint as tp, sum(greatest(b - a, 0))::bigint as fp, sum(greatest(a - b, 0))::bigint as fn from j group by item_id")
def a13(spark, sf):
    w = table(spark, sf, "benchmark").select("item_id", F.posexplode(X.whitespace_tokens(F.col("text"))).alias("i", "t"))
    side = lambda c, t: w.groupBy("item_id", t.alias("t")).agg(F.count(F.lit(1)).alias(c))
    j = side("a", F.col("t")).join(side("b", F.when((F.col("i") + 1) % 7 == 0, "[x]").otherwise(F.col("t"))), ["item_id", "t"], "full").na.fill(0, ["a", "b"])
    zero = F.lit(0)
    return j.groupBy("item_id").agg(F.sum(F.least("a", "b")).alias("tp"), F.sum(F.greatest(F.col("b") - F.col("a"), zero)).alias("fp"), F.sum(F.greatest(F.col("a") - F.col("b"), zero)).alias("fn"))


_R = "r as (select label, least(9, floor(prob * 10))::bigint as bin, count(*) as n, avg(prob) as confidence, avg(truth) as observed from p group by all)"


@query("a14_reliability", f"with {_P}, {_R} select bin, n, round(confidence, 6) as confidence, round(observed, 6) as observed from r where label = 'quality'")
def a14(spark, sf):
    r = metrics.reliability(predictions(spark, sf).where("label = 'quality'"), 10)
    return r.select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("observed", 6).alias("observed"))


@query("a14_calibration_error", f"with {_P}, {_R} select round(sum(n * abs(confidence - observed)) / sum(n), 6) as ece, round(max(abs(confidence - observed)), 6) as mce from r where label = 'quality'")
def a14e(spark, sf):
    r = metrics.reliability(predictions(spark, sf).where("label = 'quality'"), 10)
    return r.agg(F.round(F.sum(F.col("n") * F.col("gap")) / F.sum("n"), 6).alias("ece"), F.round(F.max("gap"), 6).alias("mce"))


@query("a23_cohen_kappa", "with r as (select quality as a, (n_chars > 500)::int as b from documents join labels using (doc_id)), t as (select count(*) as n, avg((a = b)::int) as po from r), m as (select sum(x * y) / (select n * n from t) as pe from (select a, count(*)::double as x from r group by a) l join (select b, count(*)::double as y from r group by b) q on a = b) select n, round(po, 6) as observed, round(pe, 6) as chance, round((po - pe) / (1 - pe), 6) as kappa from t, m")
def a23(spark, sf):
    r = docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id").select(F.col("quality").alias("a"), (F.col("n_chars") > 500).cast("int").alias("b"))
    return metrics.kappa(r, "a", "b")


_LEVELS = "r as (select l_orderkey, least(3, floor(l_discount * 100 / 3))::int as a, least(3, floor(l_tax * 100 / 2.5))::int as b from lineitem)"


@query("a24_weighted_kappa", f"with {_LEVELS}, o as (select count(*) as n, sum((a - b) ** 2 / 9) as o from r), e as (select sum((x.a - y.b) ** 2 / 9 * x.n * y.n) as e from (select a, count(*)::double as n from r group by a) x, (select b, count(*)::double as n from r group by b) y) select n, round(1 - o / (e / n), 6) as kappa from o, e")
def a24(spark, sf):
    level = lambda c, w: F.least(F.lit(3), F.floor(F.col(c) * 100 / w)).cast("int")
    return metrics.weighted_kappa(table(spark, sf, "lineitem").select(level("l_discount", 3).alias("a"), level("l_tax", 2.5).alias("b")), "a", "b", 4)


@query("a26_rollup_means", "select coalesce(l_returnflag, 'overall') as construct, round(avg(l_extendedprice), 4) as mean_price, count(*) as n from lineitem group by rollup (l_returnflag)")
def a26(spark, sf):
    return table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count(F.lit(1)).alias("n")).select(F.coalesce("l_returnflag", F.lit("overall")).alias("construct"), "mean_price", "n")


@query("a33_label_prevalence", f"with {_P} select label, round(avg(truth), 6) as prevalence, avg(truth) > 0.5 as majority from p group by label")
def a33(spark, sf):
    return predictions(spark, sf).groupBy("label").agg(F.round(F.avg("truth"), 6).alias("prevalence"), (F.avg("truth") > 0.5).alias("majority"))


@query("a37_system_vs_floor", f"with {_P}, z as (select label, sum(truth) as pos, count(*) as n from p group by label) select label, round(f1, 6) as f1, round(case when pos * 2 > n then 2.0 * pos / (pos + n) else 0.0 end, 6) as floor_f1 from f join z using (label)")
def a37(spark, sf):
    p = predictions(spark, sf)
    prior = p.groupBy("label").agg(F.sum("truth").alias("pos"), F.count(F.lit(1)).alias("n"))
    s = metrics.scores(metrics.confusion(p, "label"))
    floor = F.when(F.col("pos") * 2 > F.col("n"), 2.0 * F.col("pos") / (F.col("pos") + F.col("n"))).otherwise(0.0)
    return s.join(prior, "label", "left").select("label", F.round("f1", 6).alias("f1"), F.round(F.coalesce(floor, F.lit(0.0)), 6).alias("floor_f1"))


_GRID = [round(0.05 * k, 2) for k in range(1, 20)]


@query("m10_threshold_tuning", f"with {_P}, g as (select unnest({_GRID}) as threshold), k as (select label, threshold, sum((truth = 1 and prob >= threshold)::int) as tp, sum((truth = 0 and prob >= threshold)::int) as fp, sum((truth = 1 and prob < threshold)::int) as fn from p, g group by all), s as (select label, threshold::double as threshold, round(case when 2 * tp + fp + fn = 0 then 0 else 2 * tp / (2 * tp + fp + fn) end, 6) as f1 from k) select label, threshold, f1 from (select *, row_number() over (partition by label order by f1 desc, round(abs(threshold - 0.5), 6), threshold) as r from s) where r = 1")
def m10(spark, sf):
    return metrics.best_thresholds(predictions(spark, sf), _GRID)


@query("m9_class_weights", f"with {_P} select label, round(least(20.0, (count(*) - sum(truth)) / greatest(sum(truth), 1)), 6) as weight from p group by label")
def m9(spark, sf):
    n, pos = F.count(F.lit(1)), F.sum("truth")
    return predictions(spark, sf).groupBy("label").agg(F.round(F.least(F.lit(20.0), (n - pos) / F.greatest(pos, F.lit(1))), 6).alias("weight"))


@query("m3_temperature_scaling", f"with {_P} select doc_id, label, round(1 / (1 + exp(-ln(greatest(least(prob, 1 - 1e-12), 1e-12) / (1 - greatest(least(prob, 1 - 1e-12), 1e-12))) / 2.0)), 6) as scaled from p")
def m3(spark, sf):
    q = F.greatest(F.least(F.col("prob"), F.lit(1 - 1e-12)), F.lit(1e-12))
    return predictions(spark, sf).select("doc_id", "label", F.round(1 / (1 + F.exp(-F.log(q / (1 - q)) / 2.0)), 6).alias("scaled"))


_W = ", ".join(f"('{k}', {d}, {m})" for k, d, m in dict.fromkeys((k, d, m) for k, _, d, m in L.CUES))
_H = f"q(construct, cue) as (values {_CUES}), h as (select doc_id, construct, least(1.0, 0.4 * count(*))::double as p from documents, q where case when contains(cue, ' ') then contains(lower(text), cue) else regexp_matches(lower(text), '(^|[^0-9a-z_])' || cue) end group by all), w(construct, direction, magnitude) as (values {_W})"


def contributions(spark, sf, polar: int):
    """(doc_id, construct, weight, contribution) of the lexicon scorer; polar constructs get the policy's sign."""
    rows = [(k, d, float(m)) for k, d, m in dict.fromkeys((k, d, m) for k, _, d, m in L.CUES)]
    w = F.broadcast(spark.createDataFrame(rows, "construct string, direction int, magnitude double"))  # a fixed list
    h = cue_hits(docs_of(spark, sf).select("doc_id", F.lower("text").alias("low"))).withColumn("p", F.least(F.lit(1.0), 0.4 * F.col("hits")))
    sign = F.when(F.col("direction") == 0, polar).otherwise(F.col("direction"))
    return h.join(w, "construct").withColumn("weight", sign * F.col("magnitude")).withColumn("contribution", F.col("p") * F.col("weight"))


@query("m5_fused_index", f"with {_H} select doc_id, round(sum(p * direction * magnitude), 6) as raw_score, round(1 / (1 + exp(-sum(p * direction * magnitude))), 6) as index, round(round_even(100 / (1 + exp(-sum(p * direction * magnitude))), 0), 0)::int as percent from h join w using (construct) group by doc_id")
def m5(spark, sf):
    s = contributions(spark, sf, 0).groupBy("doc_id").agg(F.sum("contribution").alias("s"))
    index = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col("s")))))
    return s.select("doc_id", F.round("s", 6).alias("raw_score"), F.round(index, 6).alias("index"), F.bround(index * 100).cast("int").alias("percent"))


@query("t1_top_drivers", f"with {_H} select doc_id, construct, round(c, 6) as contribution from (select doc_id, construct, p * direction * magnitude as c, row_number() over (partition by doc_id order by abs(p * direction * magnitude) desc, construct) as k from h join w using (construct)) where k <= 2")
def t1(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.abs("contribution").desc(), "construct")
    return contributions(spark, sf, 0).withColumn("k", F.row_number().over(w)).where("k <= 2").select("doc_id", "construct", F.round("contribution", 6).alias("contribution"))


@query("c14_polarity_policies", f"with {_H}, s as (select doc_id, sum(p * direction * magnitude) as neutral, sum(p * case when direction = 0 then 1 else direction end * magnitude) as pessimistic, sum(p * case when direction = 0 then -1 else direction end * magnitude) as optimistic from h join w using (construct) group by doc_id) select doc_id, round(neutral, 6) as neutral, round(pessimistic, 6) as pessimistic, round(optimistic, 6) as optimistic from s")
def c14(spark, sf):
    c = contributions(spark, sf, 0)
    polar = F.col("p") * F.col("magnitude") * (F.col("direction") == 0).cast("int")
    return c.groupBy("doc_id").agg(F.round(F.sum("contribution"), 6).alias("neutral"), F.round(F.sum(F.col("contribution") + polar), 6).alias("pessimistic"), F.round(F.sum(F.col("contribution") - polar), 6).alias("optimistic"))


@query("a21_risk_sensitivity", f"with {_H}, x as (select construct, abs(p * case when direction = 0 then 1 else direction end * magnitude) as a, direction = 0 as unresolved from h join w using (construct)) select construct, round(sum(a) / (select sum(a) from x), 6) as share, round(avg(unresolved::int), 6) as unresolved from x group by construct")
def a21(spark, sf):
    g = contributions(spark, sf, 1).groupBy("construct").agg(F.sum(F.abs("contribution")).alias("a"), F.round(F.avg((F.col("direction") == 0).cast("int")), 6).alias("unresolved"))
    return g.select("construct", F.round(F.col("a") / F.sum("a").over(Window.partitionBy()), 6).alias("share"), "unresolved")


@query("a18_silence_summary", f"with {_H}, s as (select d.doc_id, d.lang, count(h.construct) as k from documents d left join h on h.doc_id = d.doc_id group by all) select lang, count(*) as n, sum((k = 0)::int)::bigint as silent from s group by lang")
def a18(spark, sf):
    d = docs_of(spark, sf)
    heard = cue_hits(d.select("doc_id", F.lower("text").alias("low"))).select("doc_id").distinct().withColumn("heard", F.lit(1))
    return d.join(heard, "doc_id", "left").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("heard").isNull().cast("long")).alias("silent"))


@query("a20_lower_median_member", "with s as (select source, doc_id, n_chars, row_number() over (partition by source order by n_chars desc, doc_id) as k, count(*) over (partition by source) as n, max(n_chars) over (partition by source) - min(n_chars) over (partition by source) as spread from documents) select source, n, spread, doc_id as median_doc from s where k = (n - 1) // 2 + 1")
def a20(spark, sf):
    d = docs_of(spark, sf).select("source", "doc_id", "n_chars")
    spread = d.groupBy(F.col("source").alias("s")).agg((F.max("n_chars") - F.min("n_chars")).alias("spread"))
    ranked = sampling.row_numbers(d, "source", [F.desc("n_chars"), F.col("doc_id")]).where(F.col("rn") == F.floor((F.col("rn_of") - 1) / 2) + 1)
    return ranked.join(spread, F.col("source").eqNullSafe(F.col("s"))).select("source", F.col("rn_of").alias("n"), "spread", F.col("doc_id").alias("median_doc"))


_U = lambda seed, key: f"('0x' || substr(md5('{seed}:' || cast({key} as varchar)), 1, 8))::bigint"


@query("p1_random_split", f"with r as (select doc_id, row_number() over (order by {_U(42, 'doc_id')}, doc_id) as k, count(*) over () as n from documents) select doc_id, case when k <= floor(n * 0.8) then 'train' else 'test' end as side from r")
def p1(spark, sf):
    return sampling.random_split(docs_of(spark, sf).select("doc_id"), "doc_id", 0.2, 42)


@query("p3_stratified_hold_out", f"with r as (select doc_id, source, row_number() over (partition by source order by {_U(3, 'doc_id')}, doc_id) as k, count(*) over (partition by source) as n from documents) select doc_id, source from r where k <= greatest(1, round_even(n * 0.1, 0))")
def p3(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "source").withColumn("u", X.draw(F.lit(3), F.col("doc_id")))
    return sampling.stratified(d, "source", [F.col("u"), F.col("doc_id")], F.greatest(F.lit(1), F.bround(F.col("rn_of") * 0.1))).select("doc_id", "source")


@query("p7_weighted_draw", f"with r as (select doc_id, source, round(-ln(({_U(9, 'doc_id')} + 1) / {float(2**32 + 1)}) / n_chars, 9) as e from documents where n_chars > 0) select doc_id, source from (select *, row_number() over (partition by source order by e, doc_id) as k from r) where k <= 3")
def p7(spark, sf):
    return sampling.weighted_draw(docs_of(spark, sf).select("doc_id", "source", "n_chars"), "doc_id", "source", F.col("n_chars"), 3, 9).select("doc_id", "source")


_EDGES = " + ".join(f"(u >= {e})::int" for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119))


@query("b1_bootstrap_mean", f"with x as (select doc_id, quality, r, ('0x' || substr(md5('42:' || cast(r as varchar) || ':' || cast(doc_id as varchar)), 1, 8))::bigint / {float(2**32)} as u from labels, range(200) t(r)), m as (select r, sum(({_EDGES}) * quality) / sum({_EDGES}) as m from x group by r), l as (select list_sort(list(m)) as ms from m) select round((select avg(quality) from labels), 6) as mean, round(ms[6], 6) as low, round(ms[196], 6) as high from l")
def b1(spark, sf):
    return sampling.poisson_bootstrap(table(spark, sf, "labels"), "doc_id", "quality", 200, 42)


@query("x14_training_fingerprint", "with m as (select md5(coalesce(text, '')) as m, count(*) as n from documents group by 1), a as (select substr(m, 1, 6) as p, sum(n) as n, sha256(string_agg(m || ':' || n, ',' order by m)) as h from m group by 1), b as (select substr(p, 1, 4) as p, sum(n) as n, sha256(string_agg(h, '' order by p)) as h from a group by 1), c as (select substr(p, 1, 2) as p, sum(n) as n, sha256(string_agg(h, '' order by p)) as h from b group by 1) select sha256(string_agg(h, '' order by p)) as fingerprint, sum(n)::bigint as n from c")
def x14(spark, sf):
    # order-independent, as a tree: different texts by six digits of their hash, then at most 256 hashes a node
    def node(rows, digits, item):
        parts = F.array_sort(F.collect_list(F.struct("p", item.alias("h"))))
        joined = F.array_join(F.transform(parts, lambda x: x["h"]), "," if digits == 6 else "")
        return rows.groupBy(F.substring("p", 1, digits).alias("q")).agg(F.sum("n").alias("n"), F.sha2(joined, 256).alias("h")).withColumnRenamed("q", "p")

    tree = docs_of(spark, sf).groupBy(F.md5(F.coalesce("text", F.lit(""))).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    tree = node(tree, 6, F.concat_ws(":", "p", F.col("n").cast("string")))
    for digits in (4, 2, 0):
        tree = node(tree, digits, F.col("h"))
    return tree.select(F.col("h").alias("fingerprint"), "n")


@query("f14_response_validation", "select event_id, case when props is null or props = '' then 'EMPTY_RESPONSE' when event_id % 9 = 0 then 'NOT_JSON' when event_id % 10 = 0 then 'MISSING_KEYS' when cast(json_extract(props, '$.k') as bigint) > 90 then 'BAD_INTENSITY' else 'OK' end as code from events")
def f14(spark, sf):
    raw = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("not json "), "props")).when(F.col("event_id") % 10 == 0, F.lit('{"x": 1}')).otherwise(F.col("props"))
    k = F.get_json_object("raw", "$.k")
    code = F.when(F.col("raw").isNull() | (F.col("raw") == ""), "EMPTY_RESPONSE").when(~F.col("raw").rlike(r"^\s*\{"), "NOT_JSON").when(k.isNull(), "MISSING_KEYS").when(k.try_cast("long") > 90, "BAD_INTENSITY").otherwise("OK")
    return table(spark, sf, "events").withColumn("raw", raw).select("event_id", code.alias("code"))


_Q = "list_filter([case when prob < 0.3 then 'low_confidence' end, case when label = 'toxic' and pred = 1 then 'clinical' end, case when truth <> pred then 'disagreement' end], lambda x: x is not null)"


@query("f17_review_queue", f"with {_P} select doc_id, label, unnest({_Q}) as reason from p")
def f17(spark, sf):
    return review_queue(predictions(spark, sf))


def review_queue(p):
    reasons = F.array(F.when(F.col("prob") < 0.3, "low_confidence"), F.when((F.col("label") == "toxic") & (F.col("pred") == 1), "clinical"), F.when(F.col("truth") != F.col("pred"), "disagreement"))
    return p.select("doc_id", "label", F.explode(F.filter(reasons, lambda x: x.isNotNull())).alias("reason"))


@query("a36_queue_summary", f"with {_P}, q as (select doc_id, unnest({_Q}) as reason from p) select reason, count(*) as n, count(distinct doc_id) as n_docs from q group by reason")
def a36(spark, sf):
    return review_queue(predictions(spark, sf)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query("a28_burden_hours", "select o_orderpriority as batch, count(*) as items, round(count(*) * 45 / 3600.0, 6) as hours, ceil(count(*) * 45 / 3600.0 / 1.5)::bigint as sittings from orders group by 1")
def a28(spark, sf):
    hours = F.count(F.lit(1)) * 45 / 3600.0
    return table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("batch")).agg(F.count(F.lit(1)).alias("items"), F.round(hours, 6).alias("hours"), F.ceil(hours / 1.5).alias("sittings"))


_C8 = f"q(construct, cue) as (values {_CUES}), h as (select conv_id, turn, construct, least(1.0, 0.4 * count(*))::double as p from conversations, q where case when contains(cue, ' ') then contains(lower(text), cue) else regexp_matches(lower(text), '(^|[^0-9a-z_])' || cue) end group by all)"


@query("c8_pairwise_compare", f"with {_C8} select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn - 1) as turn, round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))), 6) as delta from h a full join h b on a.conv_id = b.conv_id and a.turn + 1 = b.turn and a.construct = b.construct group by all")
def c8(spark, sf):
    """Each turn beside the next one of its conversation: the sum of differences over constructs."""
    t = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("doc_id"), F.lower("text").alias("low"))
    v = cue_hits(t).select("doc_id.conv_id", "doc_id.turn", "construct", F.least(F.lit(1.0), 0.4 * F.col("hits")).alias("p"))
    after = v.select("conv_id", (F.col("turn") - 1).alias("turn"), "construct", F.col("p").alias("q"))
    return v.join(after, ["conv_id", "turn", "construct"], "full").groupBy("conv_id", "turn").agg(F.round(F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))), 6).alias("delta"))
