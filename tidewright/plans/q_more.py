"""Further queries of the inventory: spans, sets, rates, plans and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import lexicons as L
from tidewright.functions import text as X
from tidewright.operators import cues, joins, metrics
from tidewright.plans.catalog import ORACLES, query
from tidewright.plans.q_joins import cue_hits
from tidewright.plans.q_metrics import _H, _P, contributions, predictions
from tidewright.plans.q_text import _ADMIT, TOK, WS, docs_of
from tidewright.sources.readers import table, violations


def N():
    return F.count(F.lit(1))


@query("s5_sources_without_provenance", "with p as (select distinct source from documents where lang = 'es') select source, count(*) as n from documents where source not in (select source from p) group by source union all select '(all)', count(*) from documents")
def s5(spark, sf):
    d = docs_of(spark, sf)
    p = d.where("lang = 'es'").select("source").distinct()
    return d.join(p, "source", "left_anti").groupBy("source").agg(N().alias("n")).unionByName(d.agg(F.lit("(all)").alias("source"), N().alias("n")).select("source", "n"))


@query("s6_duplicate_keys", "select l_orderkey, l_linenumber, count(*) as n from lineitem group by all having count(*) > 1")
def s6(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(N().alias("n")).where("n > 1")


@query("s12_refusal_log", "select doc_id, case when n_chars < 50 then 'MISSING_LICENCE_BASIS' else 'UNLISTED_CATEGORY' end as reason from documents where n_chars < 50 or lang not in ('en', 'de', 'fr')")
def s12(spark, sf):
    return docs_of(spark, sf).where((F.col("n_chars") < 50) | ~F.col("lang").isin("en", "de", "fr")).select("doc_id", F.when(F.col("n_chars") < 50, "MISSING_LICENCE_BASIS").otherwise("UNLISTED_CATEGORY").alias("reason"))


@query("s14_normalised_annotations", """select event_id, event_type as schema_name, cast(json_extract(props, '$.k') as bigint) as value from events where event_type <> 'view' union all select event_id, 'view', null from events where event_type = 'view'""")
def s14(spark, sf):
    parsed = F.from_json("props", "map<string, bigint>")
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("schema_name"), F.when(F.col("event_type") != "view", F.element_at(parsed, "k")).alias("value"))


@query("s15_candidate_rows", "select doc_id, lang, 'batch-1' as batch from documents where n_chars between 200 and 2000")
def s15(spark, sf):
    return docs_of(spark, sf).where(F.col("n_chars").between(200, 2000)).drop("source", "n_chars", "text").withColumn("batch", F.lit("batch-1"))


@query("s23_provenance_derivation", "select source as source_id, true as deidentified, count(*) as n, 'derived from raw; interim' as note from documents group by source")
def s23(spark, sf):
    raw = docs_of(spark, sf).groupBy(F.col("source").alias("source_id")).agg(N().alias("n"))
    return raw.withColumn("deidentified", F.lit(True)).withColumn("note", F.concat(F.lit("derived from raw"), F.lit("; interim")))


@query("f2_required_fields", "select c_custkey, unnest(list_filter([case when trim(c_name) = '' or c_name is null then 'c_name' end, case when c_mktsegment not in ('BUILDING', 'HOUSEHOLD', 'MACHINERY') then 'c_mktsegment' end, case when c_acctbal < 0 then 'c_acctbal' end], lambda x: x is not null)) as reason from customer")
def f2(spark, sf):
    checks = {"c_name": F.trim("c_name") == "", "c_mktsegment": ~F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD", "MACHINERY"), "c_acctbal": F.col("c_acctbal") < 0}
    return violations(table(spark, sf, "customer"), "c_custkey", checks)


@query("f4_minimised_columns", "select o_orderkey, o_orderstatus from orders")
def f4(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")


@query("f15_span_in_text", "select c.conv_id, c.turn, contains(c.text, substr(p.text, 1, 12)) as span_in_text from conversations c join conversations p on p.conv_id = c.conv_id and p.turn = c.turn - 1")
def f15(spark, sf):
    c = table(spark, sf, "conversations")
    p = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.substring("text", 1, 12).alias("span"))
    return c.join(p, ["conv_id", "turn"]).select("conv_id", "turn", F.col("text").contains(F.col("span")).alias("span_in_text"))


@query("f16_merged_poles", "select user_id, case when count(distinct event_type) filter (event_type in ('purchase', 'error')) = 2 then 'mixed' when count(*) filter (event_type = 'purchase') > 0 then 'purchase' when count(*) filter (event_type = 'error') > 0 then 'error' else 'none' end as pole from events group by user_id")
def f16(spark, sf):
    poles = F.collect_set(F.when(F.col("event_type").isin("purchase", "error"), F.col("event_type")))
    return table(spark, sf, "events").groupBy("user_id").agg(poles.alias("p")).select("user_id", F.when(F.size("p") == 2, "mixed").when(F.size("p") == 0, "none").otherwise(F.get("p", 0)).alias("pole"))


@query("f20_publication_refusals", "select source, count(*) as refused from documents where lang <> 'en' group by source")
def f20(spark, sf):
    return docs_of(spark, sf).where("lang <> 'en'").groupBy("source").agg(N().alias("refused"))


@query("a15_label_counts", f"with {_P} select label, count(distinct doc_id) as records, sum(truth)::bigint as positives, round(avg(truth), 6) as share from p group by label")
def a15(spark, sf):
    return predictions(spark, sf).groupBy("label").agg(F.countDistinct("doc_id").alias("records"), F.sum("truth").alias("positives"), F.round(F.avg("truth"), 6).alias("share"))


@query("a16_run_counters", f"with {_P} select count(*) as calls, round(avg((prob < 0.1)::int), 6) as abstained, round(avg((prob between 0.1 and 0.3)::int), 6) as escalated, sum(pred)::bigint as constructs from p")
def a16(spark, sf):
    p = predictions(spark, sf)
    return p.agg(N().alias("calls"), F.round(F.avg((F.col("prob") < 0.1).cast("int")), 6).alias("abstained"), F.round(F.avg(F.col("prob").between(0.1, 0.3).cast("int")), 6).alias("escalated"), F.sum("pred").alias("constructs"))


@query("a19_cloud_lanes", f"with {_H}, s as (select doc_id, sum(p * direction * magnitude) as raw from h join w using (construct) group by doc_id) select lang, count(*) as planted, count(raw) as scored, (count(*) - count(raw))::bigint as silent, round(quantile_cont(raw, 0.5), 6) as median_raw from documents left join s using (doc_id) group by lang")
def a19(spark, sf):
    s = contributions(spark, sf, 0).groupBy("doc_id").agg(F.sum("contribution").alias("raw"))
    return docs_of(spark, sf).join(s, "doc_id", "left").groupBy("lang").agg(N().alias("planted"), F.count("raw").alias("scored"), (N() - F.count("raw")).alias("silent"), F.round(F.percentile("raw", F.lit(0.5)), 6).alias("median_raw"))


@query("a22_overlap_buckets", "with d as (select d.doc_id, quality, len(list_intersect(list_distinct(string_split(lower(text), ' ')), ['the', 'of', 'and', 'la', 'der'])) >= 3 as high from documents d join labels using (doc_id)) select high, count(*) as n, round(avg(quality), 6) as assert_rate from d group by high")
def a22(spark, sf):
    shared = F.size(F.array_intersect(F.split(F.lower("text"), " "), X.among(("the", "of", "and", "la", "der"))))
    return docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy((shared >= 3).alias("high")).agg(N().alias("n"), F.round(F.avg("quality"), 6).alias("assert_rate"))


@query("a25_approval_rates", "select o_orderpriority as item_type, count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as approved, round(avg((o_orderstatus = 'F')::int) - (select avg((o_orderstatus = 'F')::int) from orders), 6) as margin from orders group by 1")
def a25(spark, sf):
    o = table(spark, sf, "orders").withColumn("ok", (F.col("o_orderstatus") == "F").cast("int"))
    control = F.broadcast(o.agg(F.avg("ok").alias("base")))  # one row
    return o.crossJoin(control).groupBy(F.col("o_orderpriority").alias("item_type")).agg(N().alias("n"), F.round(F.avg("ok"), 6).alias("approved"), F.round(F.avg("ok") - F.max("base"), 6).alias("margin"))


@query("a29_relabel_scope", f"with {_P} select label, count(*) as labels, count(distinct doc_id) as records, count(distinct text) as texts from p join documents using (doc_id) where truth <> pred group by label")
def a29(spark, sf):
    p = predictions(spark, sf).where("truth <> pred").join(docs_of(spark, sf).select("doc_id", F.md5("text").alias("t")), "doc_id")
    return p.groupBy("label").agg(N().alias("labels"), F.countDistinct("doc_id").alias("records"), F.countDistinct("t").alias("texts"))


@query("a30_phrase_prevalence", "with q(phrase) as (values ('of the'), ('in the'), ('de la'), ('und der')) select phrase, count(distinct doc_id) as n_docs from (select doc_id, ' ' || regexp_replace(lower(unnest(regexp_split_to_array(text, '[.!?]+\\s+'))), '[^a-z0-9]+', ' ', 'g') || ' ' as s from documents), q where contains(s, ' ' || phrase || ' ') group by phrase")
def a30(spark, sf):
    found = cues.phrase_hits(docs_of(spark, sf), "doc_id", F.split("text", r"[.!?]+\s+"), ["of the", "in the", "de la", "und der"])
    return found.groupBy("phrase").agg(F.countDistinct("doc_id").alias("n_docs"))


@query("a38_significance_words", f"with {_P}, b as (select label, avg((pred = truth)::int) as a, avg((1 = truth)::int) as z from p group by label) select label, case when a > z then 'above the floor' when a < z then 'below the floor' else 'at the floor' end as verdict from b")
def a38(spark, sf):
    b = predictions(spark, sf).groupBy("label").agg(F.avg((F.col("pred") == F.col("truth")).cast("int")).alias("a"), F.avg((F.col("truth") == 1).cast("int")).alias("z"))
    return b.select("label", F.when(F.col("a") > F.col("z"), "above the floor").when(F.col("a") < F.col("z"), "below the floor").otherwise("at the floor").alias("verdict"))


@query("t3_longest_words", f"with t as (select doc_id, {WS} as w from documents), x as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as i from t) select doc_id, i::int as i, word from (select *, row_number() over (partition by doc_id order by length(word) desc, i) as k from x) where k <= 2")
def t3(spark, sf):
    w = docs_of(spark, sf).select("doc_id", F.transform(X.whitespace_tokens(F.col("text")), lambda t, i: F.struct((-F.length(t)).alias("l"), (i + 1).alias("i"), t.alias("word"))).alias("w"))
    return w.select("doc_id", F.explode(F.slice(F.array_sort("w"), 1, 2)).alias("x")).select("doc_id", "x.i", "x.word")


@query("t6_runner_up_types", "select user_id, event_type, k::int as k from (select user_id, event_type, row_number() over (partition by user_id order by count(*) desc, event_type) as k from events group by user_id, event_type) where k <= 2")
def t6(spark, sf):
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(N().alias("n"))
    return c.withColumn("k", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).where("k <= 2").select("user_id", "event_type", "k")


@query("t10_peak_and_spread", "select conv_id, arg_max(turn, {'a': length(text), 'b': -turn}) as peak_turn, (max(length(text)) - min(length(text)))::bigint as spread from conversations group by conv_id")
def t10(spark, sf):
    n = F.length("text")
    return table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("turn", F.struct(n.alias("a"), (-F.col("turn")).alias("b"))).alias("peak_turn"), (F.max(n) - F.min(n)).cast("long").alias("spread"))


@query("u2_group_sets", "with a as (select list_distinct(list(event_type)) as s, user_id from events where value >= 50 group by user_id), b as (select list_distinct(list(event_type)) as s, user_id from events where value < 20 group by user_id) select a.user_id, len(list_distinct(list_concat(a.s, b.s)))::int as in_either, len(list_intersect(a.s, b.s))::int as in_both, len(list_filter(b.s, lambda x: not list_contains(a.s, x))) = 0 as subset from a join b using (user_id)")
def u2(spark, sf):
    e = table(spark, sf, "events")
    a = e.where("value >= 50").groupBy("user_id").agg(F.collect_set("event_type").alias("a"))
    b = e.where("value < 20").groupBy("user_id").agg(F.collect_set("event_type").alias("b"))
    return a.join(b, "user_id").select("user_id", F.size(F.array_union("a", "b")).alias("in_either"), F.size(F.array_intersect("a", "b")).alias("in_both"), (F.size(F.array_except("b", "a")) == 0).alias("subset"))


@query("u6_source_union", "select lang, count(*) as n from (select lang from documents where source = 'src1' union all select lang from documents where source = 'src2' union all select lang from documents where source = 'src3') group by lang")
def u6(spark, sf):
    d = docs_of(spark, sf)
    parts = [d.where(F.col("source") == s) for s in ("src1", "src2", "src3")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("lang").agg(N().alias("n"))


@query("x17_masked_words", f"select doc_id, md5(array_to_string(list_filter(w, lambda x, i: i % 3 <> 0), ' ')) as masked_md5 from (select doc_id, {WS} as w from documents)")
def x17(spark, sf):
    masked = F.array_join(F.filter(X.whitespace_tokens(F.col("text")), lambda x, i: (i + 1) % 3 != 0), " ")
    return docs_of(spark, sf).select("doc_id", F.md5(masked).alias("masked_md5"))


@query("x21_highlight", "select item_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' the ', ' <mark>the</mark> ')) as html_md5 from benchmark")
def x21(spark, sf):
    t = F.col("text")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" the ", " <mark>the</mark> ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return table(spark, sf, "benchmark").select("item_id", F.md5(t).alias("html_md5"))


@query("x22_url_identifiers", r"select page_id, nullif(regexp_extract(url, '/([a-z]{2})/([0-9]+)', 2), '') as number, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '') as page from pages")
def x22(spark, sf):
    one = lambda p, g: F.nullif(F.regexp_extract("url", p, g), F.lit(""))
    return table(spark, sf, "pages").select("page_id", one("/([a-z]{2})/([0-9]+)", 2).alias("number"), one("[?&]page=([0-9]+)", 1).alias("page"))


@query("x25_span_slices", "select doc_id, substr(text, 1, 20) as surface, n_chars < 20 as out_of_range from documents")
def x25(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.substring("text", 1, 20).alias("surface"), (F.col("n_chars") < 20).alias("out_of_range"))


@query("m6_load_index", "with v as (select user_id, avg(value) as v, count(*) filter (event_type = 'error') / count(*) as e from events group by user_id) select user_id, round(1 / (1 + exp(-(0.02 * (v - 50) + 2.0 * e))), 6) as load from v")
def m6(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("v"), F.avg((F.col("event_type") == "error").cast("int")).alias("e"))
    return v.select("user_id", F.round(1 / (1 + F.exp(-(0.02 * (F.col("v") - 50) + 2.0 * F.col("e")))), 6).alias("load"))


@query("m11_multi_hot", f"with {_P} select doc_id, array_to_string(list(pred order by label), '') as hot, coalesce(string_agg(label, ',' order by label) filter (prob >= 0.5), '') as decoded from p group by doc_id")
def m11(spark, sf):
    g = predictions(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("label", "pred", "prob"))).alias("x"))
    return g.select("doc_id", F.array_join(F.transform("x", lambda s: s["pred"].cast("string")), "").alias("hot"), F.array_join(F.transform(F.filter("x", lambda s: s["prob"] >= 0.5), lambda s: s["label"]), ",").alias("decoded"))


@query("m13_span_f1", "with s as (select event_id % 400 as a, event_id % 400 + 30 as b, event_id % 370 as c, event_id % 370 + 25 as d, event_id from events) select event_id, round(2.0 * greatest(0, least(b, d) - greatest(a, c)) / 55, 6) as f1 from s")
def m13(spark, sf):
    a, c = F.col("event_id") % 400, F.col("event_id") % 370
    return table(spark, sf, "events").select("event_id", F.round(2.0 * F.greatest(F.lit(0), F.least(a + 30, c + 25) - F.greatest(a, c)) / 55, 6).alias("f1"))


@query("m14_top_k_jaccard", "with r as (select label, dim, v, row_number() over (partition by label order by v desc, dim) as k from (select label, dim, avg(v) as v from (select label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as dim from embeddings) group by all)), t as (select label, list(dim) as s from r where k <= 10 group by label) select a.label as a, b.label as b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) as jaccard from t a join t b on a.label < b.label")
def m14(spark, sf):
    d = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", (F.col("dim") + 1).alias("dim")).agg(F.avg(F.col("v").cast("double")).alias("v"))
    t = d.withColumn("k", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("v"), "dim"))).where("k <= 10").groupBy("label").agg(F.collect_list("dim").alias("s"))
    a, b = t.select(F.col("label").alias("a"), F.col("s").alias("sa")), F.broadcast(t.select(F.col("label").alias("b"), F.col("s").alias("sb")))  # ten labels
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.round(X.jaccard(F.col("sa"), F.col("sb")), 6).alias("jaccard"))


@query("m16_tolerance_verdicts", "select o_orderkey, case when o_totalprice = t then 'exact' when abs(o_totalprice - t) <= 0.3 * o_totalprice then 'within' else 'refused' end as verdict from orders join (select l_orderkey, sum(l_extendedprice) as t from lineitem group by 1) on l_orderkey = o_orderkey")
def m16(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("t"))
    o = table(spark, sf, "orders").join(t, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select("o_orderkey", F.when(F.col("o_totalprice") == F.col("t"), "exact").when(F.abs(F.col("o_totalprice") - F.col("t")) <= 0.3 * F.col("o_totalprice"), "within").otherwise("refused").alias("verdict"))


@query("b2_proportion_interval", "select lang, count(*) as n, round(avg(quality), 6) as share, round(avg(quality) - 1.96 * sqrt(avg(quality) * (1 - avg(quality)) / count(*)), 6) as low, round(avg(quality) + 1.96 * sqrt(avg(quality) * (1 - avg(quality)) / count(*)), 6) as high from documents join labels using (doc_id) group by lang")
def b2(spark, sf):
    q = F.avg("quality")
    half = 1.96 * F.sqrt(q * (1 - q) / N())
    return docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("lang").agg(N().alias("n"), F.round(q, 6).alias("share"), F.round(q - half, 6).alias("low"), F.round(q + half, 6).alias("high"))


@query("b5_word_removal_curve", f"with t as (select doc_id, {WS} as w from documents), f as (select unnest([0.1, 0.2, 0.5]) as f), s as (select f, doc_id, len(list_filter(w, lambda x: x = 'the')) as a, len(list_filter(list_slice(w, 1 + ceil(f * len(w))::int, len(w)), lambda x: x = 'the')) as b from t, f) select f::double as fraction, round(avg(a - b), 6) as drop from s group by f")
def b5(spark, sf):
    w = docs_of(spark, sf).select(X.whitespace_tokens(F.col("text")).alias("w")).withColumn("f", F.explode(F.array(*map(F.lit, (0.1, 0.2, 0.5)))))
    lost = F.size(F.filter(F.slice("w", 1, F.ceil(F.col("f") * F.size("w")).cast("int")), lambda x: x == "the"))
    return w.groupBy(F.col("f").alias("fraction")).agg(F.round(F.avg(lost), 6).alias("drop"))


@query("p10_distinct_labels_by_source", "select source, array_to_string(list_sort(list_distinct(list(lang))), ',') as langs from documents group by source")
def p10(spark, sf):
    return docs_of(spark, sf).groupBy("source").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))


@query("l6_replayed_scores", f"with t as (select text, round(avg(len({TOK})), 6) as score from documents group by text) select d.doc_id, t.score from documents d join t on t.text = d.text")
def l6(spark, sf):
    # a text's score is its own, so equal texts meet by their digests; a null text meets nothing
    d = docs_of(spark, sf).where("text is not null").select("doc_id", F.unhex(F.sha2("text", 256)).alias("digest"), F.size(X.tokenise(F.col("text"))).alias("n"))
    cache = d.groupBy("digest").agg(F.round(F.avg("n"), 6).alias("score"))
    return joins.join_dealt(d.select("doc_id", "digest"), cache, "digest").select("doc_id", "score")


@query("l8_coverage_ledger", f"with {_H}, k as (select construct, count(*) as n from h group by construct) select w.construct, case when k.n is null then 'silent' when w.direction = 0 then 'inert' else 'evidenced' end as state from w left join k using (construct)")
def l8(spark, sf):
    rows = list(dict.fromkeys((k, d) for k, _, d, _ in L.CUES))
    k = cue_hits(docs_of(spark, sf).select("doc_id", F.lower("text").alias("low"))).select("construct").distinct().withColumn("seen", F.lit(True))
    return spark.createDataFrame(rows, "construct string, direction int").join(k, "construct", "left").select("construct", F.when(F.col("seen").isNull(), "silent").when(F.col("direction") == 0, "inert").otherwise("evidenced").alias("state"))


@query("c3_timed_events", "select conv_id, turn, round(60.0 * (instr(text, ' the ') + 2) / length(text), 6) as at_s from conversations where contains(text, ' the ')")
def c3(spark, sf):
    t = table(spark, sf, "conversations").where(F.col("text").contains(" the "))
    return t.select("conv_id", "turn", F.round(60.0 * (F.instr("text", " the ") + 2) / F.length("text"), 6).alias("at_s"))


@query("c6_audit_gate", "with f as (select count(*) filter (regexp_matches(text, '[0-9a-f]{24,}')) as high, count(*) filter (contains(text, '@')) as low from documents) select high, low, high = 0 as passed from f")
def c6(spark, sf):
    f = docs_of(spark, sf).agg(F.sum(F.col("text").rlike("[0-9a-f]{24,}").cast("long")).alias("high"), F.sum(F.col("text").contains("@").cast("long")).alias("low"))
    return f.withColumn("passed", F.col("high") == 0)


@query("c11_pass_ingest", f"with {_P}, x as (select doc_id, max((prob < 0.1)::int) as bad from p group by doc_id) select case when x.doc_id is null then 'skipped' when bad = 1 then 'error' else 'labelled' end as state, count(*) as n from documents left join x using (doc_id) group by 1")
def c11(spark, sf):
    x = predictions(spark, sf).groupBy("doc_id").agg(F.max((F.col("prob") < 0.1).cast("int")).alias("bad"))
    return docs_of(spark, sf).select("doc_id").join(x, "doc_id", "left").groupBy(F.when(F.col("bad").isNull(), "skipped").when(F.col("bad") == 1, "error").otherwise("labelled").alias("state")).agg(N().alias("n"))


@query("c13_gate_evaluation", f"{_ADMIT}, rel as ({ORACLES['f11_relevance']}) select lang, v.reason as gate, count(*) as n, sum(rel.on_topic::int)::bigint as on_topic from documents join v using (doc_id) join rel using (doc_id) group by all")
def c13(spark, sf):
    d = docs_of(spark, sf)
    one = d.select("lang", X.admission(F.col("text")).alias("gate"), (X.relevance(F.col("text")) >= 0.25).alias("on_topic"))
    return one.groupBy("lang", "gate").agg(N().alias("n"), F.sum(F.col("on_topic").cast("long")).alias("on_topic"))


@query("c15_ablation_verdict", f"with {_H}, s as (select doc_id, round(sum(p * direction * magnitude), 9) as a, count(*) as b from h join w using (construct) group by doc_id), r as (select rank() over (order by a) + (count(*) over (partition by a) - 1) / 2 as ra, rank() over (order by b) + (count(*) over (partition by b) - 1) / 2 as rb from s) select round(corr(ra, rb), 4) as rho, corr(ra, rb) >= 0.95 as barely_reorders from r")
def c15(spark, sf):
    """Spearman over all documents. Ranks come from counts by value, which are few, so no window holds all rows."""
    s = contributions(spark, sf, 0).groupBy("doc_id").agg(F.round(F.sum("contribution"), 9).alias("a"), N().alias("b"))

    def ranks(c):
        v = s.groupBy(c).agg(N().alias("n"))
        before = F.coalesce(F.sum("n").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return v.select(c, (before + (F.col("n") + 1) / 2).alias(f"r{c}"))

    r = s.join(ranks("a"), "a").join(ranks("b"), "b")
    rho = F.covar_pop("ra", "rb") / F.nullif(F.stddev_pop("ra") * F.stddev_pop("rb"), F.lit(0.0))
    return r.agg(F.round(rho, 4).alias("rho"), (rho >= 0.95).alias("barely_reorders"))


@query("a35_score_bundle", f"with {_P} select label, round(avg((pred = truth)::int), 6) as accuracy, round(sum(prob * truth) / greatest(sum(truth), 1), 6) as mean_prob_of_true from p group by label")
def a35(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy("label").agg(F.round(F.avg((F.col("pred") == F.col("truth")).cast("int")), 6).alias("accuracy"), F.round(metrics.ratio(F.sum(F.col("prob") * F.col("truth")), F.greatest(F.sum("truth"), F.lit(1))), 6).alias("mean_prob_of_true"))
