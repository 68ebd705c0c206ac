"""Queries on the text of documents: scalar functions, gates and corpus profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.functions import lexicons as L
from tidewright.functions import text as X
from tidewright.operators import duplicates, profiles
from tidewright.plans.catalog import query
from tidewright.sources.readers import clean_int, clean_string, table, violations


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


TOK = r"list_transform(regexp_extract_all(text, '\[[A-Z][A-Z_]*\]|[A-Za-z'']+'), lambda t: case when starts_with(t, '[') then t else lower(t) end)"
WS = r"list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '')"
_LANG_CASES = ", ".join(f"{{'s': -round(len(list_filter(w, lambda t: list_contains({sql_list(ws)}, t))) / greatest(len(w), 1), 9), 'code': '{code}'}}" for code, ws in L.STOPWORDS.items())
LANG_CTE = rf"w0 as (select *, regexp_extract_all(lower(text), '\p{{L}}+') as w from documents), w1 as (select *, list_sort([{_LANG_CASES}]) as ranked from w0)"


@query("x4_token_counts", f"select doc_id, len(t)::bigint as n_tokens, len(list_distinct(t))::bigint as n_types from (select doc_id, {TOK} as t from documents)")
def x4(spark, sf):
    t = docs_of(spark, sf).select("doc_id", X.tokenise(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_types"))


@query(
    "x5_language_verdict",
    f"with {LANG_CTE} select doc_id, case when len(w) >= 5 and -ranked[1].s >= 0.10 then ranked[1].code else 'und' end as language, case when len(w) >= 5 then round(-ranked[1].s, 6) else 0.0 end as score, case when len(w) >= 5 then round(ranked[2].s - ranked[1].s, 6) else 0.0 end as margin, len(w)::bigint as tokens from w1",
)
def x5(spark, sf):
    return docs_of(spark, sf).select("doc_id", X.language(F.col("text")).alias("v")).select("doc_id", "v.*")


@query(
    "f8_language_filter",
    f"with {LANG_CTE}, v as (select doc_id, lang, len(w) as n, ranked[1].code as code, -ranked[1].s as best, list_filter(ranked, lambda x: x.code = 'en')[1].s * -1 as en from w1) select lang, count(*) as n, sum(case when n >= 5 and code <> 'en' and best >= 0.20 and round(best - en, 9) >= 0.10 then 1 else 0 end)::bigint as excluded from v group by lang",
)
def f8(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    share = lambda code: F.round(X.listed(F.col("w"), L.STOPWORDS[code]) / F.greatest(F.size("w"), F.lit(1)), 9)
    v = docs_of(spark, sf).withColumn("w", words).withColumn("en", share("en")).withColumn("best", F.greatest(*(share(c) for c in L.STOPWORDS if c != "en")))
    out = (F.size("w") >= 5) & (F.col("best") > F.col("en")) & (F.col("best") >= 0.20) & (F.round(F.col("best") - F.col("en"), 9) >= 0.10)
    return v.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(out.cast("long")).alias("excluded"))


@query("x6_distinct_ngrams", f"select doc_id, len(list_distinct(g))::bigint as n_4grams from (select doc_id, case when len(t) >= 4 then list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i+3], ' ')) else [] end as g from (select doc_id, {WS} as t from documents))")
def x6(spark, sf):
    t = docs_of(spark, sf).select("doc_id", X.whitespace_tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size(F.array_distinct(F.transform(F.array("t"), lambda w: X.ngrams(w, 4))[0])).cast("long").alias("n_4grams"))


@query("x9_silhouettes", "select shape, count(*) as n from (select regexp_replace(regexp_replace(regexp_replace(substr(text, 1, 40), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g') as shape from documents) group by shape")
def x9(spark, sf):
    return docs_of(spark, sf).groupBy(X.silhouette(F.col("text")).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


_DAYS = r"""case when contains(low, 'tomorrow') or contains(low, 'night before') or contains(low, 'day before') then 1
 when contains(low, 'this weekend') or contains(low, 'in a few days') then 3 when contains(low, 'next week') or contains(low, 'week out') then 7
 when said <> '' and cast(said as int) <= 60 then cast(said as int) end"""


@query(
    "x10_days_until",
    rf"with t as (select event_id, event_type || ' ' || cast(event_id % 75 as varchar) || ' days ' || case event_id % 3 when 0 then 'out' when 1 then 'ago' else 'to go' end || case when event_id % 11 = 0 then ' next week' else '' end as low from events), u as (select *, regexp_extract(low, '(?:^|[^0-9a-z])([0-9]{{1,2}})\s+days?\s+(?:out|to go|until|before)', 1) as said from t) select event_id, {_DAYS} as days from u",
)
def x10(spark, sf):
    e = table(spark, sf, "events")
    said = F.concat("event_type", F.lit(" "), (F.col("event_id") % 75).cast("string"), F.lit(" days "), F.when(F.col("event_id") % 3 == 0, "out").when(F.col("event_id") % 3 == 1, "ago").otherwise("to go"), F.when(F.col("event_id") % 11 == 0, " next week").otherwise(""))
    return e.select("event_id", X.days_until(said).alias("days"))


@query("x11_hashed_ids", "select source || '_' || substr(sha256(source || ':' || cast(doc_id as varchar)), 1, 16) as hashed_id from documents")
def x11(spark, sf):
    return docs_of(spark, sf).select(F.concat("source", F.lit("_"), F.substring(F.sha2(F.concat_ws(":", "source", F.col("doc_id").cast("string")), 256), 1, 16)).alias("hashed_id"))


@query("x12_prompt_hashes", "select sha256('v1' || chr(1) || 'label the text' || chr(1) || text) as prompt_hash, count(*) as n from documents group by 1")
def x12(spark, sf):
    return docs_of(spark, sf).groupBy(F.sha2(F.concat_ws("\x01", F.lit("v1"), F.lit("label the text"), "text"), 256).alias("prompt_hash")).agg(F.count(F.lit(1)).alias("n"))


@query("x13_user_prompts", "with p as (select conv_id, string_agg(text, ' ' order by turn) as context from conversations group by conv_id) select c.conv_id, c.turn, md5(case when p.context = c.text then 'TEXT: ' || c.text else 'CONTEXT: ' || p.context || chr(10) || 'TEXT: ' || c.text end) as prompt_md5 from conversations c join p using (conv_id)")
def x13(spark, sf):
    c = table(spark, sf, "conversations")
    context = profiles.parent_context(c, "conv_id", "turn", "text")
    target = F.concat(F.lit("TEXT: "), "text")
    prompt = F.when(F.col("context") == F.col("text"), target).otherwise(F.concat(F.lit("CONTEXT: "), "context", F.lit("\n"), target))
    return c.join(context, "conv_id").select("conv_id", "turn", F.md5(prompt).alias("prompt_md5"))


@query("x15_token_cost", "select source, sum(greatest(1, length(text) // 4))::bigint as tokens, round(sum(greatest(1, length(text) // 4)) * 0.15 / 1e6, 6) as cost from documents group by source")
def x15(spark, sf):
    d = docs_of(spark, sf).withColumn("n", X.estimated_tokens(F.col("text")))
    return d.groupBy("source").agg(F.sum("n").alias("tokens"), F.round(F.sum("n") * 0.15 / 1e6, 6).alias("cost"))


@query("x16_lexical_diversity", f"select lang, round(avg(ttr), 6) as mean_ttr, count(distinct text) / count(*)::double as distinct_rate from (select lang, text, len(list_distinct(t)) / greatest(len(t), 1)::double as ttr from (select lang, text, {WS} as t from documents)) group by lang")
def x16(spark, sf):
    d = docs_of(spark, sf).withColumn("t", X.whitespace_tokens(F.col("text")))
    return d.groupBy("lang").agg(F.round(F.avg(X.type_token_ratio(F.col("t"))), 6).alias("mean_ttr"), (F.countDistinct("text") / F.count(F.lit(1))).alias("distinct_rate"))


_FOUR = "|".join(c + "{4,}" for c in "abcdefghijklmnopqrstuvwxyz") + "|''{4,}"
_ADMIT = rf"""with t0 as (select doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') as t from documents),
t1 as (select *, regexp_extract_all(lower(t), '[a-z'']+') as tok, regexp_extract_all(lower(t), '[^ \t\n\r\f\x0b]+') as every from t0),
v as (select doc_id, case when length(t) = 0 then 'empty' when length(regexp_replace(t, '[^\p{{L}}\s]', '', 'g')) / length(t) < 0.55 then 'not_letters'
 when len(tok) < 4 or length(t) < 16 then 'too_short'
 when len(list_filter(tok, lambda w: length(w) <= 20 and not regexp_matches(w, '{_FOUR}') and regexp_matches(w, '[aeiouy]'))) / len(tok) < 0.60 then 'not_words'
 when len(every) >= 8 and len(list_distinct(every)) / len(every) < 0.30 then 'repetition'
 when len(list_distinct(list_filter(tok, lambda w: list_contains({sql_list(L.FUNCTION_WORDS)}, w)))) < 2 then 'not_language' else 'ok' end as reason from t1)
"""


@query("f10_text_admission", _ADMIT + "select doc_id, reason from v")
def f10(spark, sf):
    return docs_of(spark, sf).select("doc_id", X.admission(F.col("text")).alias("reason"))


@query("f9_drop_reasons", _ADMIT + "select reason, count(*) as n from v group by reason")
def f9(spark, sf):
    return docs_of(spark, sf).groupBy(X.admission(F.col("text")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


_HIT = lambda ws: f"least(len(list_distinct(list_filter(tok, lambda t: list_contains({sql_list(ws)}, t)))), 3) / 3"


@query(
    "f11_relevance",
    rf"""with t as (select doc_id, text, regexp_extract_all(lower(text), '[a-z''\-]+') as tok, regexp_extract_all(text, '[A-Za-z]+') as words from documents)
select doc_id, round(s, 6) as score, s >= 0.25 as on_topic from (select doc_id, case when len(tok) = 0 then 0.0 else greatest(0.0, least(1.0,
 5.0 * len(list_filter(tok, lambda t: list_contains({sql_list(L.FIRST_PERSON)}, t))) / greatest(len(tok), 1) + 0.25 * {_HIT(L.SPORT_WORDS)} + 0.30 * {_HIT(L.STATE_WORDS)}
 - len(list_filter(words, lambda w: regexp_full_match(w, '[A-Z]{{2,}}'))) / greatest(len(words), 1) - 4.0 * length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(length(text), 1))) end as s from t)""",
)
def f11(spark, sf):
    d = docs_of(spark, sf).select("doc_id", X.relevance(F.col("text")).alias("s"))
    return d.select("doc_id", F.round("s", 6).alias("score"), (F.col("s") >= 0.25).alias("on_topic"))


_JUNK = rf"""j0 as (select *, {TOK} as tok, regexp_replace(text, '\s+$', '') as st from documents),
j1 as (select doc_id, lang, list_filter([case when len(tok) < 3 then 'too_short' end, case when not regexp_matches(regexp_replace(text, '\[[A-Z][A-Z_]*\]', '', 'g'), '[A-Za-z]') then 'no_alphabetic_content' end,
 case when len(tok) > 0 and len(list_filter(tok, lambda t: not starts_with(t, '['))) = 0 then 'placeholder_only' end,
 case when length(text) - length(replace(text, '[', '')) <> length(text) - length(replace(text, ']', '')) or length(text) - length(replace(text, '(', '')) <> length(text) - length(replace(text, ')', '')) then 'unbalanced_brackets' end,
 case when length(st) > 0 and not regexp_matches(st, '[.!?"'']$') then 'truncated_ending' end,
 case when len(list_filter(range(1, len(tok) - 1), lambda i: tok[i] = tok[i+1] and tok[i+1] = tok[i+2])) > 0 then 'repeated_token_run' end], lambda x: x is not null) as flags from j0)
"""


@query("f12_junk_flags", f"with {_JUNK} select doc_id, array_to_string(flags, ',') as flags from j1")
def f12(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.array_join(X.junk_flags(F.col("text")), ",").alias("flags"))


@query("f12_junk_profile", f"with {_JUNK} select flag, count(*) as n from (select unnest(flags) as flag from j1) group by flag")
def f12p(spark, sf):
    return docs_of(spark, sf).select(F.explode(X.junk_flags(F.col("text"))).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "f6_stated_minor_age",
    r"with t as (select user_id, 'I am ' || cast(user_id % 30 as varchar) || ' (' || cast(user_id % 23 as varchar) || 'm)' as said from (select distinct user_id from events)) select user_id, len(list_filter(list_concat(regexp_extract_all(said, '(?i)i am ([0-9]{1,2})', 1), regexp_extract_all(said, '\(([0-9]{1,2})\s*[mf]\)', 1)), lambda a: cast(a as int) between 13 and 17)) > 0 as minor from t",
)
def f6(spark, sf):
    said = F.concat(F.lit("I am "), (F.col("user_id") % 30).cast("string"), F.lit(" ("), (F.col("user_id") % 23).cast("string"), F.lit("m)"))
    ages = F.concat(F.regexp_extract_all(said, F.lit(r"(?i)i am ([0-9]{1,2})"), F.lit(1)), F.regexp_extract_all(said, F.lit(r"\(([0-9]{1,2})\s*[mf]\)"), F.lit(1)))
    return table(spark, sf, "events").select("user_id").distinct().select("user_id", F.exists(ages, lambda a: a.cast("int").between(13, 17)).alias("minor"))


@query("f7_first_cue", "select doc_id, list_filter(['license', 'token', 'que', 'the', 'und'], lambda c: contains(lower(text), c))[1] as cue from documents")
def f7(spark, sf):
    return docs_of(spark, sf).select("doc_id", F.get(F.filter(X.among(("license", "token", "que", "the", "und")), lambda c: F.lower("text").contains(c)), 0).alias("cue"))


@query(
    "f18_identifier_findings",
    r"""with f as (select doc_id, 'email' as kind, unnest(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')) as hit from documents
union all select doc_id, 'phone_number', hit from (select doc_id, unnest(regexp_extract_all(text, '\+[0-9][0-9 .-]{7,}[0-9]')) as hit from documents) where length(regexp_replace(hit, '[^0-9]', '', 'g')) between 9 and 15 and not regexp_matches(hit, '[0-9]\.[0-9]')
union all select doc_id, 'credential_assignment', unnest(regexp_extract_all(text, '(?i)[A-Za-z0-9_-]*(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*[''"]?[A-Za-z0-9+/]{32,}={0,2}')) from documents)
select kind, count(*) as n, count(distinct doc_id) as n_docs, min(regexp_replace(regexp_replace(regexp_replace(substr(hit, 1, 40), '[0-9]', '9', 'g'), '[A-Z]', 'A', 'g'), '[a-z]', 'a', 'g')) as example from f group by kind""",
)
def f18(spark, sf):
    d = docs_of(spark, sf)
    found = lambda kind, pattern: d.select("doc_id", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("hit"))
    phones = found("phone_number", r"\+[0-9][0-9 .-]{7,}[0-9]").where(F.length(F.regexp_replace("hit", "[^0-9]", "")).between(9, 15) & ~F.col("hit").rlike(r"[0-9]\.[0-9]"))
    every = found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}").unionByName(phones).unionByName(found("credential_assignment", r"(?i)[A-Za-z0-9_-]*(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*['\"]?[A-Za-z0-9+/]{32,}={0,2}"))
    return every.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"), F.min(X.silhouette(F.col("hit"))).alias("example"))


@query("f19_forbidden_wording", "select doc_id from documents where contains(replace(lower(text), 'not the', ''), 'the the')")
def f19(spark, sf):
    return docs_of(spark, sf).where(F.replace(F.lower("text"), F.lit("not the"), F.lit("")).contains("the the")).select("doc_id")


@query("f3_record_violations", "select doc_id, unnest(list_filter([case when length(trim(text)) = 0 then 'blank_text' end, case when n_chars < 100 then 'short' end, case when lang not in ('en', 'de', 'fr') then 'lang_not_allowed' end], lambda x: x is not null)) as reason from documents")
def f3(spark, sf):
    checks = {"blank_text": F.length(F.trim("text")) == 0, "short": F.col("n_chars") < 100, "lang_not_allowed": ~F.col("lang").isin("en", "de", "fr")}
    return violations(docs_of(spark, sf), "doc_id", checks)


_GATE = "case when source is null or trim(source) = '' then 'EMPTY_ID' when lang not in ('en', 'de', 'fr') then 'UNLISTED_CATEGORY' when source in ('src1', 'src2') then 'NOT_PERMITTED' when n_chars < 50 then 'MISSING_LICENCE_BASIS' else 'ADMITTED' end"


@query("f1_source_gate", f"select {_GATE} as reason_code, count(*) as n from documents group by 1")
def f1(spark, sf):
    gate = F.when(F.col("source").isNull() | (F.trim("source") == ""), "EMPTY_ID").when(~F.col("lang").isin("en", "de", "fr"), "UNLISTED_CATEGORY").when(F.col("source").isin("src1", "src2"), "NOT_PERMITTED").when(F.col("n_chars") < 50, "MISSING_LICENCE_BASIS").otherwise("ADMITTED")
    return docs_of(spark, sf).groupBy(gate.alias("reason_code")).agg(F.count(F.lit(1)).alias("n"))


@query("f5_harvest_filter", f"select case when len(t) < 25 then 'too_few_words' when len(t) > 400 then 'too_many_words' when contains(lower(text), 'token') then 'secret' when not contains(lower(text), 'the') then 'off_topic' else 'kept' end as reason, count(*) as n from (select text, {WS} as t from documents) group by 1")
def f5(spark, sf):
    n, low = F.size(X.whitespace_tokens(F.col("text"))), F.lower("text")
    reason = F.when(n < 25, "too_few_words").when(n > 400, "too_many_words").when(low.contains("token"), "secret").when(~low.contains("the"), "off_topic").otherwise("kept")
    return docs_of(spark, sf).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("s4_value_coercion", "select event_id, case when lower(trim(v)) in ('', 'na', 'n/a', 'null', 'none', 'unknown') then null else trim(v) end as clean, cast(trunc(try_cast(case when lower(trim(v)) in ('', 'na', 'n/a', 'null', 'none', 'unknown') then null else trim(v) end as double)) as int) as number from (select event_id, case event_id % 5 when 0 then ' N/A ' when 1 then '3.7' when 2 then ' 12' when 3 then 'abc' else 'Unknown' end as v from events)")
def s4(spark, sf):
    v = F.when(F.col("event_id") % 5 == 0, " N/A ").when(F.col("event_id") % 5 == 1, "3.7").when(F.col("event_id") % 5 == 2, " 12").when(F.col("event_id") % 5 == 3, "abc").otherwise("Unknown")
    return table(spark, sf, "events").select("event_id", clean_string(v).alias("clean"), clean_int(v).alias("number"))


@query("a1_coverage", "select 'text' as field, avg(case when text is not null then 1.0 else 0.0 end) as share from documents union all select 'lang', avg(case when lang is not null then 1.0 else 0.0 end) from documents union all select 'quality', round(avg(case when quality is not null then 1.0 else 0.0 end), 9) from documents left join labels using (doc_id)")
def a1(spark, sf):
    return profiles.coverage(docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left"), ["text", "lang", "quality"])


@query("a2_stratum_counts", "select lang, case when n_chars < 500 then 'short' when n_chars < 5000 then 'medium' else 'long' end as band, count(*) as n from documents group by all")
def a2(spark, sf):
    band = F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 5000, "medium").otherwise("long")
    return docs_of(spark, sf).groupBy("lang", band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("a3_describe_lengths", "select lang, count(*) as n, round(avg(n_chars), 6) as mean, round(coalesce(stddev_samp(n_chars), 0), 6) as sd, min(n_chars) as low, quantile_disc(n_chars, 0.25) as p25, quantile_disc(n_chars, 0.5) as p50, quantile_disc(n_chars, 0.75) as p75, quantile_disc(n_chars, 0.9) as p90, max(n_chars) as high from documents group by lang")
def a3(spark, sf):
    return profiles.describe(docs_of(spark, sf), "lang", "n_chars")


@query("a4_histogram", "with r as (select min(n_chars) as lo, (max(n_chars) - min(n_chars)) / 10.0 as w from documents) select cast(case when w = 0 then 0 else least(9, floor((n_chars - lo) / w)) end as bigint) as bin, count(*) as n from documents, r group by 1")
def a4(spark, sf):
    return profiles.histogram(docs_of(spark, sf), "n_chars", 10)


@query("a5_vocabulary", f"with t as (select unnest({TOK}) as token from documents), c as (select token, count(*) as n from t group by token) select sum(n)::bigint as tokens, count(*) as types, sum(case when n = 1 then 1 else 0 end)::bigint as hapax, round(count(*) / sum(n), 9) as ttr from c")
def a5(spark, sf):
    return profiles.vocabulary(docs_of(spark, sf).select(F.explode(X.tokenise(F.col("text"))).alias("token")))


@query("t4_top_tokens", f"select token, count(*) as n from (select unnest({TOK}) as token from documents) group by token order by n desc, token limit 25")
def t4(spark, sf):
    return docs_of(spark, sf).select(F.explode(X.tokenise(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(25)


@query("a7_exact_duplicate_profile", "with c as (select text, count(*) as n from documents group by text) select sum(n)::bigint as n, count(*) as n_distinct, sum(case when n > 1 then n else 0 end)::bigint as in_groups, max(n) as largest from c")
def a7(spark, sf):
    return duplicates.exact_profile(docs_of(spark, sf), "text")


@query("a8_deduplicate", "with j as (select doc_id, text, coalesce(cast(quality as varchar), '') || '/' || coalesce(cast(toxic as varchar), '') as lab from documents left join labels using (doc_id)), g as (select text, count(distinct lab) as k, min(doc_id) as keep from j group by text) select keep as doc_id from g where k = 1")
def a8(spark, sf):
    d = docs_of(spark, sf).join(table(spark, sf, "labels"), "doc_id", "left").withColumn("lab", F.concat_ws("/", F.coalesce(F.col("quality").cast("string"), F.lit("")), F.coalesce(F.col("toxic").cast("string"), F.lit(""))))
    return duplicates.collapse(d, "text", "doc_id", "lab").where("not ambiguous").select(F.col("kept").alias("doc_id"))


@query("a9_payload_plan", "with g as (select sha256(text) as payload, count(*) as n, min(doc_id) as first_id from documents group by 1) select count(*) as calls, (sum(n) - count(*))::bigint as copied, round((sum(n) - count(*)) / sum(n), 9) as saving, max(n) as fan_out from g")
def a9(spark, sf):
    return duplicates.payload_plan(docs_of(spark, sf), F.sha2("text", 256))


@query("w7_first_seen", "select min(doc_id) as doc_id from documents group by md5(text)")
def w7(spark, sf):
    w = Window.partitionBy(F.md5("text")).orderBy("doc_id")
    return docs_of(spark, sf).select("doc_id", F.row_number().over(w).alias("rn")).where("rn = 1").select("doc_id")


_NORM = rf"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{{9f}}{X.ZERO_WIDTH}]', '', 'g')"
_NORM = f"translate({_NORM}, '{(X.QUOTES + X.DASHES)}', '{"''" * 5 + '"' * 6 + '-' * 5}')"
_NORM = rf"replace(replace(regexp_replace(replace({_NORM}, '…', '...'), '\.{{4,}}', '...', 'g'), chr(13) || chr(10), chr(10)), chr(13), chr(10))"
_NORM = rf"regexp_replace(regexp_replace({_NORM}, '[{X.BLANK}]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
_NORM = rf"regexp_replace(regexp_replace({_NORM}, '[ \n]+([,.;:!?%])', '\1', 'g'), '[ \n]*—[ \n]*', ' — ', 'g')"
_NORM = rf"regexp_replace(regexp_replace({_NORM}, ' *\n *', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"


@query("x1_normalised", f"select doc_id, length(text)::bigint as original_length, length(norm)::bigint as normalised_length, text <> norm as changed, md5(norm) as norm_md5 from (select doc_id, text, {_NORM} as norm from documents)")
def x1(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "text", X.normalise(F.col("text")).alias("norm"))
    return d.select("doc_id", F.length("text").cast("long").alias("original_length"), F.length("norm").cast("long").alias("normalised_length"), (F.col("text") != F.col("norm")).alias("changed"), F.md5("norm").alias("norm_md5"))
