"""Queries over ordered rows: event panels, token streams, moving windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.operators import panel, sampling
from tidewright.plans.catalog import query
from tidewright.plans.q_text import TOK, docs_of
from tidewright.sources.readers import table


def events(spark, sf):
    return table(spark, sf, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("day", F.floor(F.col("us") / 86_400_000_000))


_E = "e as (select *, epoch_us(ts) as us, epoch_us(ts) // 86400000000 as day from events)"


@query("w1_trajectories", f"with {_E}, s as (select user_id, event_type, day, value, value - lag(value) over (partition by user_id, event_type order by day, value) as step from e) select user_id, event_type, count(*) as n, case when count(*) >= 4 then round(regr_slope(value, day), 6) end as slope, round(stddev_samp(value), 6) as volatility, round(arg_max(step, {{'a': day, 'b': value}}), 6) as last_step from s group by all")
def w1(spark, sf):
    return panel.trajectories(events(spark, sf), ["user_id", "event_type"], "day", "value")


@query("w4_series_position", f"with {_E} select event_id, row_number() over (partition by user_id, event_type order by us desc, event_id) as place from e")
def w4(spark, sf):
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("us"), "event_id")
    return events(spark, sf).select("event_id", F.row_number().over(w).cast("long").alias("place"))


@query("w5_spearman", f"with {_E}, r as (select event_type, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2 as ra, rank() over (partition by event_type order by day) + (count(*) over (partition by event_type, day) - 1) / 2 as rb from e) select event_type, round(corr(ra, rb), 6) as rho from r group by event_type")
def w5(spark, sf):
    return panel.spearman(events(spark, sf), "event_type", "value", "day")


@query("w6_moving_type_ratio", f"with t as (select doc_id, {TOK} as tok from documents), w as (select doc_id, unnest(list_transform(range(1, len(tok) - 48), lambda i: len(list_distinct(tok[i:i+49])))) as d from t where len(tok) >= 50) select doc_id, count(*) as windows, round(sum(d) / (count(*) * 50), 6) as mattr from w group by doc_id")
def w6(spark, sf):
    t = docs_of(spark, sf).select("doc_id", F.posexplode(X.tokenise(F.col("text"))).alias("at", "token"))
    return panel.moving_type_ratio(t, "doc_id", "at", "token", 50).select("doc_id", "windows", F.round("mattr", 6).alias("mattr"))


@query("a6_stream_type_ratio", f"with t as (select doc_id, {TOK} as tok from documents), s as (select doc_id, unnest(tok) as token, generate_subscripts(tok, 1) as i from t), d as (select count(distinct token) over w as d, row_number() over w as k from s window w as (order by doc_id, i rows between 49 preceding and current row)) select max(k) as tokens, count(*) filter (k >= 50) as windows, round(sum(d) filter (k >= 50) / (count(*) filter (k >= 50) * 50.0), 9) as mattr from d")
def a6(spark, sf):
    """One value for the corpus: its documents' tokens as one stream."""
    found = panel.stream_type_ratio(docs_of(spark, sf), [F.col("doc_id")], X.tokenise(F.col("text")), 50)
    return found.select("tokens", "windows", F.round("mattr", 9).alias("mattr"))


@query("w8_audit_sample", "select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by case when contains(text, '@') then 0 else 1 end, doc_id) as k from documents) where k <= 5")
def w8(spark, sf):
    w = Window.partitionBy("lang").orderBy(F.when(F.col("text").contains("@"), 0).otherwise(1), "doc_id")
    return docs_of(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 5").select("doc_id", "lang")


@query("w9_round_robin", "select doc_id, row_number() over (order by k, source) as place from (select doc_id, source, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k <= 3")
def w9(spark, sf):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    few = docs_of(spark, sf).withColumn("k", F.row_number().over(w)).where("k <= 3")
    return few.select("doc_id", F.row_number().over(Window.orderBy("k", "source")).cast("long").alias("place"))


@query("w12_holm", f"with {_E}, p as (select event_type, round(1 - abs(corr(value, day)), 6) / 20 as p from e group by event_type), r as (select *, row_number() over (order by p, event_type) as k, count(*) over () as m from p), o as (select *, p <= 0.25 / (m - k + 1) as ok from r) select event_type, round(p, 6) as p, min(ok::int) over (order by k) = 1 as rejected from o")
def w12(spark, sf):
    p = events(spark, sf).groupBy("event_type").agg((F.round(1 - F.abs(F.corr("value", "day")), 6) / 20).alias("p"))
    return panel.holm(p, "event_type", "p", 0.25).select("event_type", F.round("p", 6).alias("p"), "rejected")


_ISL = "select user_id, island::bigint as island, sign, count(*) as n, min(us)::bigint as first, max(us)::bigint as last from (select *, sum(new) over (partition by user_id order by us, us rows unbounded preceding) as island from (select *, case when lag(sign) over w is null or lag(sign) over w <> sign or us - lag(us) over w > 21600000000 then 1 else 0 end as new from (select *, value >= 50 as sign from e) window w as (partition by user_id order by us, us))) group by all"


@query("w13_signed_islands", f"with {_E} " + _ISL)
def w13(spark, sf):
    return panel.islands(events(spark, sf).withColumn("us2", F.col("us")), ["user_id"], "us", "us2", F.col("value") >= 50, 21_600_000_000)


@query("w14_sliding_windows", f"with {_E}, k as (select *, unnest([us // 1800000000, us // 1800000000 - 1]) * 1800000000 as start from e) select start::bigint as start_us, event_type, count(*) as n, round(avg(value), 6) as mean from k group by all")
def w14(spark, sf):
    e = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("t", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "event_type", "n", "mean")


@query("w15_tumbling_windows", f"with {_E} select (us // 3600000000 * 3600000000)::bigint as start_us, count(*) as n, round(sum(value), 4) as total from e group by 1")
def w15(spark, sf):
    g = table(spark, sf, "events").groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.unix_micros("w.start").alias("start_us"), "n", "total")


@query("w16_detrended_power", f"with {_E}, f as (select event_type, regr_slope(value, day) as b, regr_intercept(value, day) as a from e group by event_type) select event_type, round(avg((value - a - b * day) ** 2), 4) as power from e join f using (event_type) group by event_type")
def w16(spark, sf):
    e = events(spark, sf)
    f = F.broadcast(e.groupBy("event_type").agg(F.regr_slope("value", "day").alias("b"), F.regr_intercept("value", "day").alias("a")))  # one row a type
    r = F.col("value") - F.col("a") - F.col("b") * F.col("day")
    return e.join(f, "event_type").groupBy("event_type").agg(F.round(F.avg(r * r), 4).alias("power"))


@query("w17_interpolation", f"with {_E}, d as (select user_id, day, avg(value) as v from e group by all), n as (select *, lead(day) over w as d2, lead(v) over w as v2 from d window w as (partition by user_id order by day)) select user_id, day + i as day, round(v + (v2 - v) * i / (d2 - day), 6) as value from (select *, unnest(range(0, d2 - day)) as i from n where d2 is not null)")
def w17(spark, sf):
    d = events(spark, sf).groupBy("user_id", "day").agg(F.avg("value").alias("v"))
    w = Window.partitionBy("user_id").orderBy("day")
    n = d.withColumn("d2", F.lead("day").over(w)).withColumn("v2", F.lead("v").over(w)).where("d2 is not null")
    i = n.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("d2") - F.col("day") - 1)))
    return i.select("user_id", (F.col("day") + F.col("i")).alias("day"), F.round(F.col("v") + (F.col("v2") - F.col("v")) * F.col("i") / (F.col("d2") - F.col("day")), 6).alias("value"))


@query("w18_stride_sample", "with r as (select event_type, event_id, row_number() over (partition by event_type order by value, event_id) - 1 as k, count(*) over (partition by event_type) as n from events) select event_type, event_id from r where floor(k * 20 / n) > floor((k - 1) * 20 / n) or k = 0")
def w18(spark, sf):
    e = table(spark, sf, "events").select("event_type", "event_id", "value")
    r = sampling.row_numbers(e, "event_type", [F.col("value"), F.col("event_id")]).withColumn("k", F.col("rn") - 1).withColumn("n", F.col("rn_of"))
    return r.where((F.floor(F.col("k") * 20 / F.col("n")) > F.floor((F.col("k") - 1) * 20 / F.col("n"))) | (F.col("k") == 0)).select("event_type", "event_id")


@query("a27_monthly_spend", f"with {_E}, m as (select strftime(ts, '%Y-%m') as month, user_id, round(sum(value), 4) as spend from e where event_type = 'purchase' group by all) select month, user_id, spend, round(sum(spend) over (partition by user_id order by month), 4) as running, spend > 500 as over_cap from m")
def a27(spark, sf):
    m = table(spark, sf, "events").where("event_type = 'purchase'").groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "user_id").agg(F.round(F.sum("value"), 4).alias("spend"))
    w = Window.partitionBy("user_id").orderBy("month")
    return m.select("month", "user_id", "spend", F.round(F.sum("spend").over(w), 4).alias("running"), (F.col("spend") > 500).alias("over_cap"))


@query("a32_successive_differences", f"with {_E}, d as (select user_id, value - lag(value) over (partition by user_id order by us, event_id) as d from e) select user_id, round(sqrt(avg(d * d)), 6) as rmssd, count(d) as n from d group by user_id")
def a32(spark, sf):
    w = Window.partitionBy("user_id").orderBy("us", "event_id")
    d = events(spark, sf).withColumn("d", F.col("value") - F.lag("value").over(w))
    return d.groupBy("user_id").agg(F.round(F.sqrt(F.avg(F.col("d") * F.col("d"))), 6).alias("rmssd"), F.count("d").alias("n"))


@query("a32_band_power", f"with {_E}, h as (select event_type, us // 3600000000 % 24 as h, avg(value) as v from e group by all), k as (select unnest([1, 2, 3]) as k) select event_type, k, round(sum(v * cos(2 * pi() * k * h / 24)) ** 2 + sum(v * sin(2 * pi() * k * h / 24)) ** 2, 4) as power from h, k group by all")
def a32b(spark, sf):
    h = events(spark, sf).groupBy("event_type", (F.floor(F.col("us") / 3_600_000_000) % 24).alias("h")).agg(F.avg("value").alias("v"))
    s = h.withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("x", 2 * F.pi() * F.col("k") * F.col("h") / 24)
    power = F.pow(F.sum(F.col("v") * F.cos("x")), F.lit(2)) + F.pow(F.sum(F.col("v") * F.sin("x")), F.lit(2))
    return s.groupBy("event_type", "k").agg(F.round(power, 4).alias("power"))


@query("w15_session_windows", f"with {_E}, s as (select user_id, us, case when lag(us) over w is null or us - lag(us) over w >= 43200000000 then 1 else 0 end as new from e window w as (partition by user_id order by us)), g as (select user_id, us, sum(new) over (partition by user_id order by us rows unbounded preceding) as g from s) select user_id, min(us)::bigint as start_us, count(*) as n from g group by user_id, g")
def w15s(spark, sf):
    g = table(spark, sf, "events").withColumn("t", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("t", "12 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query("m18_month_dates", "select strftime(o_orderdate, '%Y-%m') as month, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by 1")
def m18(spark, sf):
    return table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("m15_json_fields", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, cast(json_extract(props, '$.k') as bigint) >= 50 as high from events")
def m15(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", k.alias("k"), (k >= 50).alias("high"))
