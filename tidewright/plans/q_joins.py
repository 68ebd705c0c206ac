"""Queries that join: context, leakage, similarity, ranges, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import lexicons as L
from tidewright.functions import text as X
from tidewright.operators import cues, duplicates, joins, panel, profiles
from tidewright.plans.catalog import query
from tidewright.plans.q_text import TOK, WS, docs_of, sql_list
from tidewright.sources.readers import table


@query("j1_parent_context", "select c.conv_id, c.turn, md5(p.context) as context_md5 from conversations c join (select conv_id, string_agg(text, ' ' order by turn) as context from conversations group by conv_id) p using (conv_id)")
def j1(spark, sf):
    c = table(spark, sf, "conversations")
    return c.join(profiles.parent_context(c, "conv_id", "turn", "text"), "conv_id").select("conv_id", "turn", F.md5("context").alias("context_md5"))


@query("a34_context_coverage", "with n as (select conv_id, count(*) as k, sum(len(regexp_extract_all(text, '[^ \t\n]+'))) as words from conversations group by conv_id) select sum(k)::bigint as items, sum(case when k > 1 then k else 0 end)::bigint as with_siblings, count(*) as parents, round(sum(k * words) / sum(k), 6) as mean_parent_words, round(sum(words) / sum(k), 6) as mean_words from n")
def a34(spark, sf):
    words = F.size(F.regexp_extract_all("text", F.lit("[^ \t\n]+"), F.lit(0)))
    n = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("k"), F.sum(words).alias("words"))
    return n.agg(F.sum("k").alias("items"), F.sum(F.when(F.col("k") > 1, F.col("k")).otherwise(0)).alias("with_siblings"), F.count(F.lit(1)).alias("parents"), F.round(F.sum(F.col("k") * F.col("words")) / F.sum("k"), 6).alias("mean_parent_words"), F.round(F.sum("words") / F.sum("k"), 6).alias("mean_words"))


@query("j2_label_lookup", "select doc_id, quality, toxic from documents left join labels using (doc_id)")
def j2(spark, sf):
    return docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "quality", "toxic")


@query("j3_build_items", "select l.doc_id, count(*) over (partition by d.source) as siblings, length(d.text)::bigint as parent_chars from labels l join documents d using (doc_id)")
def j3(spark, sf):
    both = joins.strict_inner(table(spark, sf, "labels"), docs_of(spark, sf).select("doc_id", "source", "text"), "doc_id")
    n = both.groupBy("source").agg(F.count(F.lit(1)).alias("siblings"))
    return both.join(n, "source").select("doc_id", "siblings", F.length("text").cast("long").alias("parent_chars"))


@query("j4_align_passes", "select a.doc_id, a.quality as first_pass, case when length(d.text) > 500 then 1 else 0 end as second_pass from labels a join documents d using (doc_id) where a.toxic = 0 and d.source <> 'src3'")
def j4(spark, sf):
    a = table(spark, sf, "labels").where("toxic = 0").select("doc_id", F.col("quality").alias("first_pass"))
    b = docs_of(spark, sf).where("source <> 'src3'").select("doc_id", (F.length("text") > 500).cast("int").alias("second_pass"))
    return a.join(b, "doc_id")


_SETS = f"sets as (select s, min(doc_id) as id from (select doc_id, list_sort(list_distinct({TOK})) as s from documents) where len(s) > 0 group by s)"
_PAIRS = f"with {_SETS}, pairs as (select a.id as a, b.id as b, len(list_intersect(a.s, b.s)) as i, len(a.s) as na, len(b.s) as nb from sets a join sets b on a.id < b.id and len(a.s) >= len(b.s) * 0.9 - 1e-9 and len(b.s) >= len(a.s) * 0.9 - 1e-9)"


@query("j5_near_duplicate_pairs", _PAIRS + " select a, b, round(i / (na + nb - i), 6) as jaccard from pairs where i / (na + nb - i) >= 0.9 - 1e-12")
def j5(spark, sf):
    return duplicates.similar_pairs(docs_of(spark, sf), "doc_id", X.tokenise(F.col("text")), 0.9).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_ITEMS = f"with d as (select doc_id, list_sort(list_distinct({TOK})) as s from documents), c as (select s, min(doc_id) as id, count(*) as n from d where len(s) > 0 group by s), p as (select a.id as a, b.n as n, len(list_intersect(a.s, b.s)) as i, len(a.s) as na, len(b.s) as nb from c a join c b on a.id <> b.id and len(a.s) >= len(b.s) * 0.9 - 1e-9 and len(b.s) >= len(a.s) * 0.9 - 1e-9), l as (select a, sum(n) as n from p where i / (na + nb - i) >= 0.9 - 1e-12 group by a)"


@query("j5_near_dup_items", _ITEMS + " select doc_id, c.id as class_id, coalesce(c.n, 0)::bigint as copies, coalesce(c.n - 1 + coalesce(l.n, 0), 0)::bigint as links from d left join c on d.s = c.s left join l on l.a = c.id")
def j5_items(spark, sf):
    return duplicates.similar_items(docs_of(spark, sf), "doc_id", X.tokenise(F.col("text")), 0.9)


@query("j6_memorisation_probe", f"with q as (select item_id, list_distinct({WS}) as qs from benchmark), r as (select doc_id, list_distinct({WS}) as rs from documents), p as (select item_id, doc_id, round(len(list_intersect(qs, rs)) / (len(qs) + len(rs) - len(list_intersect(qs, rs))), 9) as score from q, r) select item_id, doc_id, round(score, 6) as score from (select *, row_number() over (partition by item_id order by score desc, doc_id) as k from p) where k = 1")
def j6(spark, sf):
    q = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.array_distinct(X.whitespace_tokens(F.col("text"))).alias("qset"))
    r = docs_of(spark, sf).select(F.col("doc_id").alias("rid"), F.array_distinct(X.whitespace_tokens(F.col("text"))).alias("rset"))
    return joins.nearest_by_tokens(q, r).select(F.col("qid").alias("item_id"), F.col("rid").alias("doc_id"), F.round("score", 6).alias("score"))


@query("j6_embedding_nearest", "with e as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), p as (select a.vec_id as qid, b.vec_id as rid, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 9) as cosine from e a, e b where a.vec_id % 50 = 0 and a.vec_id <> b.vec_id) select qid, rid, round(cosine, 6) as cosine from (select *, row_number() over (partition by qid order by cosine desc, rid) as k from p) where k = 1")
def j6e(spark, sf):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return joins.cosine_nearest(q, e.select(F.col("vec_id").alias("rid"), F.col("embedding").alias("v"))).select("qid", "rid", F.round("cosine", 6).alias("cosine"))


_EX = ("the of and to in that was for with from", "der die und den von mit auf", "que los las por una con")


@query("j7_example_overlap", f"with d as (select doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) > 2)) as s from documents), e as (select list_filter(string_split(x, ' '), lambda t: length(t) > 2) as es from (values ('{_EX[0]}'), ('{_EX[1]}'), ('{_EX[2]}')) v(x)), m as (select doc_id, max(case when len(s) = 0 then 0 else len(list_intersect(s, es)) / (len(s) + len(es) - len(list_intersect(s, es))) end) as best from d, e group by doc_id) select doc_id, round(best, 6) as best, best >= 0.05 as high from m")
def j7(spark, sf):
    s = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)), lambda t: F.length(t) > 2))
    best = F.greatest(*(F.when(F.size("s") == 0, 0.0).otherwise(X.jaccard(F.col("s"), X.among(tuple(w for w in x.split() if len(w) > 2)))) for x in _EX))
    return docs_of(spark, sf).select("doc_id", s.alias("s")).select("doc_id", best.alias("b")).select("doc_id", F.round("b", 6).alias("best"), (F.col("b") >= 0.05).alias("high"))


@query("j8_exact_overlap", "select (select count(*) from documents d where exists (select 1 from documents e where e.text = d.text and e.source < d.source))::bigint as leaked, (select count(*) from documents) as n")
def j8(spark, sf):
    d = docs_of(spark, sf)
    # texts are equal if their digests are; the rows of a text are counted by source, so none is moved twice
    counted = d.groupBy(F.unhex(F.sha2("text", 256)).alias("digest"), "source").agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("digest").agg(F.min_by("n", "source").alias("of_first"), F.min("source").alias("first"), F.sum("n").alias("n"), F.sum(F.when(F.col("source").isNull(), F.col("n")).otherwise(0)).alias("unsourced"))
    later = F.when(F.col("digest").isNotNull() & F.col("first").isNotNull(), F.col("n") - F.col("of_first") - F.col("unsourced")).otherwise(0)
    return first.agg(F.coalesce(F.sum(later), F.lit(0)).alias("leaked"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def _grams(n):
    return f"case when len(t) >= {n} then list_distinct(list_transform(range(1, len(t) - {n - 2}), lambda i: array_to_string(t[i:i+{n - 1}], ' '))) else [] end"


@query("j9_ngram_leakage", " union all ".join(f"select {k} as size, item_id, count(*) as n, count(tr.g) as seen from (select item_id, unnest({_grams(k)}) as g from (select item_id, {WS} as t from benchmark)) x left join (select distinct unnest(g) as g from (select {_grams(k)} as g from (select {WS} as t from documents))) tr using (g) group by item_id" for k in (4, 6, 8)))
def j9(spark, sf):
    # one pass: grams of all sizes, each behind its size
    sized = lambda t, k: F.transform(X.ngrams(t, k), lambda g: F.concat(F.lit(f"{k}|"), g))
    grams = X.let(X.whitespace_tokens(F.col("text")), lambda t: F.concat(*(sized(t, k) for k in (4, 6, 8))))
    docs, cores = docs_of(spark, sf).select("text"), spark.sparkContext.defaultParallelism
    if docs.rdd.getNumPartitions() < cores:  # a small table in one file would be one task
        docs = docs.repartition(cores)
    found = joins.ngram_leakage(table(spark, sf, "benchmark"), docs, "item_id", grams, F.substring_index("g", "|", 1).cast("int").alias("size"))
    return found.select("size", "item_id", "n", "seen")


@query("j10_unseen_texts", "select doc_id from documents d where source <> 'src0' and not exists (select 1 from documents e where e.source = 'src0' and e.text = d.text)")
def j10(spark, sf):
    d = docs_of(spark, sf)
    return d.where("source <> 'src0'").join(d.where("source = 'src0'").select("text"), "text", "left_anti").select("doc_id")


_CUES = ", ".join(f"('{k}', '{c}')" for k, c, _, _ in L.CUES)


@query("j11_cue_prefix_match", f"with q(construct, cue) as (values {_CUES}) select doc_id, construct, count(*) as hits from documents, q where case when contains(cue, ' ') then contains(lower(text), cue) else regexp_matches(lower(text), '(^|[^0-9a-z_])' || cue) end group by all")
def j11(spark, sf):
    return cue_hits(docs_of(spark, sf).select("doc_id", F.lower("text").alias("low")))


def cue_hits(rows):
    """(doc_id, construct, hits): how many cues of each construct a text has; single words match at word starts."""
    return cues.cue_hits(rows, "doc_id", F.col("low"), [(k, c) for k, c, _, _ in L.CUES]).withColumnRenamed("name", "construct")


@query("j12_cue_substring_match", f"with q(construct, cue) as (values {_CUES}) select construct, count(distinct doc_id) as n_docs from documents, q where contains(lower(text), cue) group by construct")
def j12(spark, sf):
    found = cues.cue_hits(docs_of(spark, sf), "doc_id", F.lower("text"), [(k, c) for k, c, _, _ in L.CUES], at_word_starts=False)
    return found.groupBy(F.col("name").alias("construct")).agg(F.countDistinct("doc_id").alias("n_docs"))


@query("j13_interval_overlap", "with l as (select user_id, event_id as id, epoch_us(ts) // 1000000 as s, epoch_us(ts) // 1000000 + 7200 as e from events where event_type = 'click'), r as (select user_id, event_id as rid, epoch_us(ts) // 1000000 as rs, epoch_us(ts) // 1000000 + 3600 as re from events where event_type = 'view'), p as (select l.user_id, id, rid, rs, least(e, re) - greatest(s, rs) as o from l join r on l.user_id = r.user_id and s < re and rs < e) select user_id, id, rid, o::bigint as overlap from (select *, row_number() over (partition by user_id, id order by o desc, rs, rid) as k from p) where k = 1")
def j13(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.unix_seconds(F.col("ts").cast("timestamp")))
    l = e.where("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("t").alias("start"), (F.col("t") + 7200).alias("end"))
    r = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("rid"), F.col("t").alias("rstart"), (F.col("t") + 3600).alias("rend"))
    return joins.interval_overlap(l, r, "user_id", 7200.0)


@query("j14_band_lookup", "select case when o_totalprice <= 50000 then 'low' when o_totalprice <= 150000 then 'mid' when o_totalprice <= 300000 then 'high' else 'top' end as band, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def j14(spark, sf):
    band = joins.band_lookup(F.col("o_totalprice"), ((50000, "low"), (150000, "mid"), (300000, "high")), "top")
    return table(spark, sf, "orders").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


_NTS = "epoch_us(ts)"


@query("j15_trailing_interval", f"select event_id, count(*) over r as in_window, round(coalesce(case when count(*) over r >= 3 then avg(value) over r end, avg(value) over f), 6) as mean_value from (select *, {_NTS} as u from events) window r as (partition by user_id order by u range between 86400000000 preceding and current row), f as (partition by user_id order by u, event_id rows between 11 preceding and current row)")
def j15(spark, sf):
    e = table(spark, sf, "events").withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    r = Window.partitionBy("user_id").orderBy("u").rangeBetween(-86_400_000_000, 0)
    f = Window.partitionBy("user_id").orderBy("u", "event_id").rowsBetween(-11, 0)
    n = F.count(F.lit(1)).over(r)
    return e.select("event_id", n.alias("in_window"), F.round(F.coalesce(F.when(n >= 3, F.avg("value").over(r)), F.avg("value").over(f)), 6).alias("mean_value"))


@query("j16_decay_kernel", f"with e as (select *, {_NTS} / 1e6 as t from events) select a.event_id, round(least(1.0, greatest(0.0, sum(0.4 * exp(-(a.t - b.t) / 21600.0)))), 6) as arousal from e a join e b on a.user_id = b.user_id and b.t <= a.t and b.t >= a.t - 172800 and b.event_type in ('error', 'purchase') where a.event_type = 'view' group by a.event_id")
def j16(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    found = panel.decayed_sums(e, "user_id", "event_id", "t", F.col("event_type") == "view", F.col("event_type").isin("error", "purchase"), 21600.0, 172800.0)
    return found.select("event_id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.4 * F.col("decayed"))), 6).alias("arousal"))


@query("j18_top_contributions", "with r as (select l_orderkey, l_linenumber, l_extendedprice, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber, l_partkey, l_quantity) as k from lineitem) select o_orderkey, count(r.k) as n_spans, coalesce(string_agg(cast(l_linenumber as varchar), ',' order by k), '') as top from orders left join r on o_orderkey = l_orderkey and k <= 3 group by o_orderkey")
def j18(spark, sf):
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("l_extendedprice")).alias("p"), "l_linenumber", "l_partkey", "l_quantity"))), 1, 3)
    l = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(top.alias("top"))
    o = table(spark, sf, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.size("top"), F.lit(0)).cast("long").alias("n_spans"), F.coalesce(F.array_join(F.transform("top", lambda x: x["l_linenumber"].cast("string")), ","), F.lit("")).alias("top")).withColumn("n_spans", F.greatest("n_spans", F.lit(0).cast("long")))


@query("j19_composite_lookup", "with k as (select l_partkey, l_suppkey, count(*) as n from lineitem group by all) select p_partkey, s.s_suppkey, coalesce(k.n, 0) as n from part join supplier s on s.s_suppkey = p_partkey % 10 left join k on k.l_partkey = p_partkey and k.l_suppkey = s.s_suppkey")
def j19(spark, sf):
    k = table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    p = table(spark, sf, "part").join(table(spark, sf, "supplier"), F.col("s_suppkey") == F.col("p_partkey") % 10)
    return p.join(k, (F.col("l_partkey") == F.col("p_partkey")) & (F.col("l_suppkey") == F.col("s_suppkey")), "left").select("p_partkey", "s_suppkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("j20_declared_vs_produced", "with d as (select o_orderkey as k, round(o_totalprice) as expected from orders where o_orderstatus <> 'P'), p as (select l_orderkey as k, round(sum(l_extendedprice)) as actual from lineitem group by 1) select case when d.k is null then 'undeclared' when p.k is null then 'missing' when abs(expected - actual) <= 50000 then 'within' else 'differs' end as verdict, count(*) as n from d full join p on d.k = p.k group by 1")
def j20(spark, sf):
    d = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("k"), F.round("o_totalprice").alias("expected"))
    p = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice")).alias("actual"))
    verdict = F.when(F.col("expected").isNull(), "undeclared").when(F.col("actual").isNull(), "missing").when(F.abs(F.col("expected") - F.col("actual")) <= 50000, "within").otherwise("differs")
    return d.join(p, "k", "full").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("j21_coverage_map", "select r_name, n_name, count(distinct s_suppkey) as n_suppliers, count(distinct c_custkey) as n_customers from region join nation on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey left join (select c_custkey, c_nationkey from customer where c_acctbal < 0) c on c_nationkey = n_nationkey group by all")
def j21(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("ns"))
    c = table(spark, sf, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("nc"))
    both = n.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    ns, nc = F.coalesce("ns", F.lit(0)), F.coalesce("nc", F.lit(0))
    return both.select("r_name", "n_name", ns.alias("n_suppliers"), nc.alias("n_customers"))


@query("u1_label_set_difference", "select doc_id, array_to_string(list_sort(list_filter(['quality', 'toxic'], lambda x: (x = 'quality' and quality = 1 and n_chars <= 500) or (x = 'toxic' and toxic = 1 and n_chars <= 2000))), ',') as missed, array_to_string(list_filter(['quality', 'toxic'], lambda x: (x = 'quality' and quality = 0 and n_chars > 500) or (x = 'toxic' and toxic = 0 and n_chars > 2000)), ',') as spurious from documents join labels using (doc_id)")
def u1(spark, sf):
    d = docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id")
    named = lambda a, b: F.filter(F.array(F.when(a, "quality"), F.when(b, "toxic")), lambda x: x.isNotNull())
    truth, pred = named(F.col("quality") == 1, F.col("toxic") == 1), named(F.col("n_chars") > 500, F.col("n_chars") > 2000)
    return d.select("doc_id", F.array_join(F.array_sort(F.array_except(truth, pred)), ",").alias("missed"), F.array_join(F.array_sort(F.array_except(pred, truth)), ",").alias("spurious"))


@query("u3_multiset_intersection", f"with a as (select unnest({TOK}) as t from documents where lang = 'en'), b as (select unnest({TOK}) as t from benchmark) select t, count(*) as n from (select t from a intersect all select t from b) group by t")
def u3(spark, sf):
    tokens = lambda d: d.select(F.explode(X.tokenise(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    a, b = tokens(docs_of(spark, sf).where("lang = 'en'")), tokens(table(spark, sf, "benchmark"))
    return a.join(b.withColumnRenamed("n", "m"), "t").select("t", F.least("n", "m").alias("n"))


@query("u4_symmetric_difference", "select coalesce(a.doc_id, b.doc_id) as doc_id, a.doc_id is null as only_second from (select doc_id from labels) a full join (select doc_id from documents where lang <> 'en') b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null")
def u4(spark, sf):
    a = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("a"))
    b = docs_of(spark, sf).where("lang <> 'en'").select("doc_id", F.lit(True).alias("b"))
    return a.join(b, "doc_id", "full").where("a is null or b is null").select("doc_id", F.col("a").isNull().alias("only_second"))


@query("u5_taxonomy_diff", "with a as (select n_nationkey as k, n_name as name, n_regionkey as r from nation where n_nationkey < 20), b as (select n_nationkey as k, case when n_nationkey % 4 = 0 then '  ' || n_name || ' ' else n_name end as name, case when n_nationkey % 6 = 0 then n_regionkey + 1 else n_regionkey end as r from nation where n_nationkey > 3) select coalesce(a.k, b.k) as k, case when a.k is null then 'added' when b.k is null then 'removed' when trim(a.name) <> trim(b.name) or a.r <> b.r then 'changed' else 'same' end as change from a full join b on a.k = b.k")
def u5(spark, sf):
    n = table(spark, sf, "nation").withColumnRenamed("n_nationkey", "k")
    a = n.where("k < 20").select("k", F.struct(F.trim("n_name").alias("name"), F.col("n_regionkey").alias("r")).alias("a"))
    b = n.where("k > 3").select("k", F.struct(F.trim(F.when(F.col("k") % 4 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise(F.col("n_name"))).alias("name"), F.when(F.col("k") % 6 == 0, F.col("n_regionkey") + 1).otherwise(F.col("n_regionkey")).alias("r")).alias("b"))
    return a.join(b, "k", "full").select("k", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("change"))


@query("u7_train_union_held_out", "select doc_id from (select doc_id, text from documents where source = 'src1' union all select doc_id, text from documents where source in ('src2', 'src3')) t where text not in (select text from documents where source = 'src4')")
def u7(spark, sf):
    d = docs_of(spark, sf)
    train = d.where("source = 'src1'").unionByName(d.where("source in ('src2', 'src3')"))
    return train.join(d.where("source = 'src4'").select("text"), "text", "left_anti").select("doc_id")


@query("x24_phrase_in_sentence", "with s as (select doc_id, unnest(regexp_split_to_array(text, '[.!?]+\\s+')) as sentence from documents) select doc_id, count(*) as n from s where contains(' ' || regexp_replace(lower(sentence), '[^a-z0-9\\x{80}-\\x{10FFFF}]+', ' ', 'g') || ' ', ' of the ') group by doc_id")
def x24(spark, sf):
    found = cues.phrase_hits(docs_of(spark, sf), "doc_id", F.split("text", r"[.!?]+\s+"), ["of the"], r"[^a-z0-9\x{80}-\x{10FFFF}]+")
    return found.select("doc_id", "n")


@query("f13_eligible_pool", f"select min(doc_id) as doc_id from documents where len({TOK}) >= 20 and lang in ('en', 'de') group by text")
def f13(spark, sf):
    d = docs_of(spark, sf).where((F.size(X.tokenise(F.col("text"))) >= 20) & F.col("lang").isin("en", "de"))
    return d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("x26_content_words", f"select doc_id, len(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda t: length(t) > 2 and not list_contains({sql_list(L.FUNCTION_WORDS)}, t))))::bigint as n from documents")
def x26(spark, sf):
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z']+"), F.lit(0)), lambda t: (F.length(t) > 2) & ~t.isin(*L.FUNCTION_WORDS))
    return docs_of(spark, sf).select("doc_id", F.size(F.array_distinct(words)).cast("long").alias("n"))


@query("x22_url_parts", "select page_id, regexp_extract(url, '^([a-z]+)://', 1) as scheme, regexp_extract(url, '://([^/?#]*)', 1) as host, regexp_extract(url, '/([0-9]+)', 1) as number from pages")
def s20(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "/([0-9]+)", 1).alias("number"))


@query("s18_html_text", r"select page_id, length(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')))::bigint as n_chars, md5(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as text_md5 from pages")
def s18(spark, sf):
    t = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    return table(spark, sf, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), F.md5(t).alias("text_md5"))
