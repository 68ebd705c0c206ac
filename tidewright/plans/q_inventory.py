"""Queries of the inventory's stores, gates, findings, orders, text functions, pools and composites."""

from __future__ import annotations

import json

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewright.functions import text as X
from tidewright.functions import udfs
from tidewright.operators import duplicates, findings, sampling, validation
from tidewright.operators.graph import first_kept  # noqa: F401
from tidewright.plans.catalog import query
from tidewright.plans.q_metrics import _EDGES, _H, _P, _U, contributions, predictions
from tidewright.plans.q_text import TOK, docs_of
from tidewright.session import cut, scratch_folder
from tidewright.sources.readers import table


def N():
    return F.count(F.lit(1))


def _folder(spark, name):
    return scratch_folder(spark, name)


# ---- stores, loaders, readers


@query("s9_passes_round_trip", "select 'batch-' || (event_id % 3) as batch, event_type as annotator, count(*) as n, sum(value > 50)::bigint as positive from events group by all")
def s9(spark, sf):
    """Passes are written once, by batch and annotator, and read back; a second write to the folder would be an error."""
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("batch-"), F.col("event_id") % 3).alias("batch"), F.col("event_type").alias("annotator"), (F.col("value") > 50).cast("int").alias("label"))
    path = _folder(spark, "passes")
    e.write.partitionBy("batch", "annotator").mode("errorifexists").parquet(path)
    back = spark.read.schema("event_id long, label int, batch string, annotator string").parquet(path)
    return back.groupBy("batch", "annotator").agg(N().alias("n"), F.sum("label").alias("positive"))


@query("s17_consent_intake", "select case when event_id % 11 = 0 then 'NOT_JSON' when event_type not in ('signup', 'purchase') then 'NO_CONSENT' when cast(json_extract(props, '$.k') as bigint) < 5 then 'TOO_LITTLE' else 'ADMITTED' end as reason, count(*) as n from events group by 1")
def s17(spark, sf):
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct(F.col("event_type").isin("signup", "purchase").alias("consent"), F.get_json_object("props", "$.k").cast("long").alias("amount"))))
    v = table(spark, sf, "events").select(F.try_parse_json(raw).alias("v"))
    reason = F.when(F.col("v").isNull(), "NOT_JSON").when(~F.variant_get("v", "$.consent", "boolean"), "NO_CONSENT").when(F.variant_get("v", "$.amount", "long") < 5, "TOO_LITTLE").otherwise("ADMITTED")
    return v.groupBy(reason.alias("reason")).agg(N().alias("n"))


_REQ = "case s_suppkey % 4 when 0 then 'Pkg_' || s_suppkey || '==1.' || (s_suppkey % 7) when 1 then 'pkg-' || s_suppkey || '[x] >= 2.0 ; python_version > ''3''' when 2 then '# note ' || s_suppkey else 'pkg.' || s_suppkey end"


@query("s20_requirements", f"select lower(regexp_replace(regexp_extract(line, '^([A-Za-z0-9._-]+)', 1), '[-_.]+', '-', 'g')) as name, replace(regexp_extract(line, '((?:[=<>!~]=?|===)\\s*[0-9][0-9A-Za-z.*]*)', 1), ' ', '') as spec from (select {_REQ} as line from supplier) where line not like '#%'")
def s20(spark, sf):
    line = F.expr(_REQ.replace("''3''", "\\'3\\'").replace("'; ", "'; "))
    rows = table(spark, sf, "supplier").select(line.alias("line")).where(~F.col("line").startswith("#"))
    name = F.lower(F.regexp_replace(F.regexp_extract("line", r"^([A-Za-z0-9._-]+)", 1), "[-_.]+", "-"))
    return rows.select(name.alias("name"), F.replace(F.regexp_extract("line", r"((?:[=<>!~]=?|===)\s*[0-9][0-9A-Za-z.*]*)", 1), F.lit(" "), F.lit("")).alias("spec"))


_SCAN = r"""select page_id as id, length(html) as n, kind from pages, (values ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), ('posix_home_path', '/(?:home|Users)/[A-Za-z0-9._-]+')) d(kind, pattern) where regexp_matches(html, pattern)"""


@query("s21_tree_scan", f"select kind, count(distinct id) as n_files from ({_SCAN}) group by kind")
def s21(spark, sf):
    """A tree of files (here the pages, as bytes): what isn't UTF-8 is skipped, the rest is scanned by the detectors."""
    files = table(spark, sf, "pages").select("page_id", F.encode("html", "UTF-8").alias("content")).where(F.is_valid_utf8(F.col("content").cast("string")))
    found = findings.gated_scan(files.select("page_id", F.decode("content", "UTF-8").alias("body")), "page_id", "body")
    return found.where(F.col("kind").isin("email", "posix_home_path")).groupBy("kind").agg(F.countDistinct("page_id").alias("n_files"))


@query("s22_candidate_union", "select 'en' as split, doc_id from documents where lang = 'en' union all select 'other', doc_id from documents where lang in ('de', 'fr')")
def s22(spark, sf):
    """Splits are written as folders of a store; those asked for that exist are read as one, a missing one is skipped."""
    root = _folder(spark, "splits")
    d = docs_of(spark, sf)
    for split, rows in (("en", d.where("lang = 'en'")), ("other", d.where(F.col("lang").isin("de", "fr")))):
        rows.select("doc_id").write.parquet(f"{root}/{split}")
    files = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s for s in ("en", "other", "missing") if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{s}"))]
    parts = [spark.read.schema("doc_id long").parquet(f"{root}/{s}").select(F.lit(s).alias("split"), "doc_id") for s in there]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


@query("s24_upload_report", "select case when trim(coalesce(text, '')) = '' then 'no_text' when length(text) < 60 then 'refused' else 'admitted' end as verdict, count(*) as n from conversations group by 1")
def s24(spark, sf):
    verdict = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", "no_text").when(F.length("text") < 60, "refused").otherwise("admitted")
    return table(spark, sf, "conversations").groupBy(verdict.alias("verdict")).agg(N().alias("n"))


# ---- gates


@query("f21_numeric_fields", "select event_id, 'k' as field from events where json_type(props, '$.k') in ('BIGINT', 'UBIGINT', 'DOUBLE', 'INTEGER')")
def f21(spark, sf):
    v = table(spark, sf, "events").select("event_id", F.try_parse_json("props").alias("v"))
    fields = v.select("event_id", F.explode(F.map_entries(F.try_variant_get("v", "$", "map<string, variant>"))).alias("f"))
    return fields.where(F.schema_of_variant("f.value").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")).select("event_id", F.col("f.key").alias("field"))


@query("f22_fresh_tree", "select o_orderstatus as part, count(*) as n, sum((o_orderdate >= date '1997-01-01')::int)::bigint as newer from orders group by 1 having sum((o_orderdate >= date '1997-01-01')::int) > 0")
def f22(spark, sf):
    newer = F.sum((F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1997-01-01"))).cast("long"))
    return table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("part")).agg(N().alias("n"), newer.alias("newer")).where("newer > 0")


@query("f23_simulated_gate", "select event_id, case when event_type = 'error' then 'NOT_SIMULATED' else 'NO_CONSENT' end as reason from events where event_type = 'error' or (event_type = 'view' and value < 10)")
def f23(spark, sf):
    reason = F.when(F.col("event_type") == "error", "NOT_SIMULATED").when((F.col("event_type") == "view") & (F.col("value") < 10), "NO_CONSENT")
    return table(spark, sf, "events").select("event_id", reason.alias("reason")).where("reason is not null")


@query("f24_unstamped_labels", "select doc_id, case when d.source is null then 'NO_SOURCE' else 'NOT_GOLD' end as reason from labels left join documents d using (doc_id) where d.source is null or d.source in ('src1', 'src3')")
def f24(spark, sf):
    d = table(spark, sf, "labels").join(docs_of(spark, sf).select("doc_id", "source"), "doc_id", "left")
    return d.where(F.col("source").isNull() | F.col("source").isin("src1", "src3")).select("doc_id", F.when(F.col("source").isNull(), "NO_SOURCE").otherwise("NOT_GOLD").alias("reason"))


@query("f25_refusals", f"with {_P}, want(label) as (values ('quality'), ('toxic'), ('clarity'), ('constant')), g as (select label, truth from p union all select 'constant', 1) select want.label, case when count(truth) = 0 then 'EMPTY_GOLD' when min(truth) = max(truth) then 'UNCALIBRATABLE' else 'OK' end as verdict from want left join g using (label) group by want.label")
def f25(spark, sf):
    """Labels that are asked for, also those without any gold row or with one class alone."""
    p = predictions(spark, sf).select("label", "truth").unionByName(spark.createDataFrame([("constant", 1)], "label string, truth int"))
    counted = p.groupBy("label").agg(F.count("truth").alias("n"), F.min("truth").alias("low"), F.max("truth").alias("high"))
    want = spark.createDataFrame([(k,) for k in ("quality", "toxic", "clarity", "constant")], "label string")
    return want.join(counted, "label", "left").select("label", F.when(F.coalesce("n", F.lit(0)) == 0, "EMPTY_GOLD").when(F.col("low") == F.col("high"), "UNCALIBRATABLE").otherwise("OK").alias("verdict"))


_CONSTRUCTS = {"focus": ("focused", "distracted", "none"), "worry": ()}
_HEAD = '"abstain": false, "rationale": "r", "confidence": 0.9'


def _answer(*items: str) -> str:
    return "{" + _HEAD + ', "labels": [' + ", ".join(items) + "]}"


_GOOD = '{"construct": "worry", "value": "present", "intensity": 2, "evidence_spans": ["nervous"]}'
_WORRY = '{"construct": "worry", "value": "present", "intensity": 1'
#: One response for each code, and three that pass.
_RESPONSES = (
    ("EMPTY_RESPONSE", "  "), ("NOT_JSON", "{oops"), ("NOT_AN_OBJECT", "[1]"), ("MISSING_KEYS", '{"abstain": true}'),
    ("BAD_ABSTAIN", '{"abstain": "no", "rationale": "r", "confidence": 1, "labels": []}'), ("NO_RATIONALE", '{"abstain": true, "rationale": " ", "confidence": 1, "labels": []}'),
    ("BAD_CONFIDENCE", '{"abstain": true, "rationale": "r", "confidence": 1.5, "labels": []}'), ("BAD_LABELS", '{"abstain": true, "rationale": "r", "confidence": 1, "labels": {}}'),
    ("BAD_LABEL_ITEM", _answer("3")), ("UNKNOWN_CONSTRUCT", _answer('{"construct": "joy"}')), ("DUPLICATE_CONSTRUCT", _answer(_GOOD, _GOOD)), ("BAD_INTENSITY", _answer(_WORRY.replace("1", "5") + "}")),
    ("BAD_CATEGORICAL_VALUE", _answer('{"construct": "focus", "value": "high", "intensity": 1}')), ("BAD_GRADED_VALUE", _answer('{"construct": "worry", "value": "yes", "intensity": 1}')),
    ("BAD_SPANS", _answer(_WORRY + ', "evidence_spans": "nervous"}')), ("SPAN_NOT_IN_TEXT", _answer(_WORRY + ', "evidence_spans": ["calm"]}')), ("SCHEMA_VIOLATION", _answer(_WORRY + "}")),
    ("BAD_MODIFIER", _answer(_GOOD)[:-1] + ', "interpretation_modifier": "odd"}'), ("BAD_LOW_RESILIENCE", _answer(_GOOD)[:-1] + ', "low_resilience_explicit": 1}'),
    ("CONTRADICTORY_ABSTENTION", _answer(_GOOD).replace("false", "true")), ("OK", "```json\n" + _answer(_GOOD) + "\n```"), ("OK", _answer('{"construct": "focus", "value": "none", "intensity": 3}')), ("OK", _answer()),
)
_WANTED = ", ".join(f"({k}, '{code}')" for k, (code, _) in enumerate(_RESPONSES))


@query("f14_response_codes", f"select event_id, code from events join (values {_WANTED}) w(k, code) on k = event_id % {len(_RESPONSES)}")
def f14c(spark, sf):
    """All 20 reasons and the passing forms, one of them on each event's response."""
    answers = F.broadcast(spark.createDataFrame([(k, raw) for k, (_, raw) in enumerate(_RESPONSES)], "k long, raw string"))  # a fixed list
    e = table(spark, sf, "events").select("event_id", (F.col("event_id") % len(_RESPONSES)).alias("k")).join(answers, "k")
    return e.select("event_id", validation.response_verdict(F.col("raw"), F.lit("I am nervous today"), _CONSTRUCTS)["code"].alias("code"))


_LINES = "l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents)"
_F18 = rf"""with {_LINES}, f as (
select doc_id, 'private_key' as kind, 'HIGH' as severity, unnest(regexp_extract_all(line, '-----BEGIN [A-Z ]*PRIVATE KEY-----')) as hit from l
union all select doc_id, 'credential_assignment', 'HIGH', unnest(regexp_extract_all(line, '(?i)[A-Za-z0-9_-]*(?:api[_-]?key|secret|token|password|passwd)\s*[:=]\s*[''"]?(?:sk-[A-Za-z0-9._-]{{16,}}|gh[pousr]_[A-Za-z0-9]{{20,}}|[A-Za-z0-9+/]{{32,}}={{0,2}})')) from l
union all select doc_id, 'email', 'MEDIUM', unnest(regexp_extract_all(line, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{{2,}}\b')) from l
union all select doc_id, 'windows_user_path', 'LOW', unnest(regexp_extract_all(line, '[A-Za-z]:\\Users\\[A-Za-z0-9._-]+')) from l
union all select doc_id, 'posix_home_path', 'LOW', unnest(regexp_extract_all(line, '/(?:home|Users)/[A-Za-z0-9._-]+')) from l
union all select doc_id, 'social_handle', 'LOW', unnest(regexp_extract_all(line, '(?:^|[^A-Za-z0-9._%+-])(@[A-Za-z][A-Za-z0-9_]{{4,}})\b', 1)) from l where not regexp_matches(line, '^\s*@')
union all select doc_id, 'phone_number', 'MEDIUM', hit from (select doc_id, unnest(regexp_extract_all(line, '(?:^|[^\w.])(\+?\d[\d\s().-]{{7,}}\d)(?:[^\w.]|$)', 1)) as hit from l)
 where length(regexp_replace(hit, '[^0-9]', '', 'g')) between 9 and 15 and not regexp_matches(hit, '\d\.\d') and not regexp_full_match(trim(hit), '\d{{4}}-\d{{2}}-\d{{2}}') and not contains(hit, '('))"""


@query("f18_findings", _F18 + " select kind, severity, count(*) as n, count(distinct doc_id) as n_docs from f group by all")
def f18a(spark, sf):
    """All seven detectors, after each has fired on the canary."""
    found = findings.gated_scan(docs_of(spark, sf), "doc_id", "text").where("not waived")
    return found.groupBy("kind", "severity").agg(N().alias("n"), F.countDistinct("doc_id").alias("n_docs"))


_AGES = r"list_concat(list_concat(regexp_extract_all(said, '(?i)\bi(?:''m| am)\s+(\d{1,2})\b', 1), regexp_extract_all(said, '(?i)\b(\d{1,2})\s*[mf]\b', 1)), list_concat(regexp_extract_all(said, '(?i)\((\d{1,2})\s*[mf]\)', 1), regexp_extract_all(said, '(?i)\bage[d]?\s+(\d{1,2})\b', 1)))"
_SAID = "case user_id % 5 when 0 then 'I''m ' || (user_id % 30) when 1 then 'here ' || (user_id % 30) || 'f now' when 2 then 'aged ' || (user_id % 40) when 3 then 'my high school' else 'I am ' || (user_id % 60) || ' minutes' end"


@query("f6_possible_minor", f"with t as (select user_id, {_SAID} as said from (select distinct user_id from events)) select user_id, contains(lower(said), 'high school') or len(list_filter({_AGES}, lambda a: cast(a as int) between 13 and 17)) > 0 as minor from t")
def f6a(spark, sf):
    """A cue of the list, or an age from 13 to 17 by any of the four patterns."""
    said = F.expr(_SAID.replace("''m", "\\'m"))
    patterns = (r"(?i)\bi(?:'m| am)\s+(\d{1,2})\b", r"(?i)\b(\d{1,2})\s*[mf]\b", r"(?i)\((\d{1,2})\s*[mf]\)", r"(?i)\bage[d]?\s+(\d{1,2})\b")
    t = table(spark, sf, "events").select("user_id").distinct().select("user_id", said.alias("said"))
    ages = F.concat(*(F.regexp_extract_all("said", F.lit(p), F.lit(1)) for p in patterns))
    cues = F.exists(X.among(("high school", "my mum", "sixth form")), lambda c: F.lower("said").contains(c))
    return t.select("user_id", (cues | F.exists(ages, lambda a: a.cast("int").between(13, 17))).alias("minor"))


_HARVEST = "case when doc_id % 40 = 0 then 'NO_ID' when source = 'src5' then 'NSFW' when len(w) < 25 then 'TOO_SHORT' when len(w) > 400 then 'TOO_LONG' when contains(low, 'school') then 'POSSIBLE_MINOR' when contains(low, 'token') then 'HEALTH' when contains(low, 'license') or not contains(low, 'the') then 'NOT_ANTICIPATORY' else 'KEPT' end"


@query("f5_harvest_reasons", f"select {_HARVEST} as reason, count(*) as n from (select doc_id, source, lower(text) as low, list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '') as w from documents) group by 1")
def f5a(spark, sf):
    """All reasons of the chain in their order; a post cue vetoes an anticipatory one."""
    d = docs_of(spark, sf).select("doc_id", "source", F.lower("text").alias("low"), F.filter(F.split("text", r"\s+"), lambda t: t != "").alias("w"))
    has = lambda c: F.col("low").contains(c)
    reason = (
        F.when(F.col("doc_id") % 40 == 0, "NO_ID").when(F.col("source") == "src5", "NSFW").when(F.size("w") < 25, "TOO_SHORT").when(F.size("w") > 400, "TOO_LONG")
        .when(has("school"), "POSSIBLE_MINOR").when(has("token"), "HEALTH").when(has("license") | ~has("the"), "NOT_ANTICIPATORY").otherwise("KEPT")
    )
    return d.groupBy(reason.alias("reason")).agg(N().alias("n"))


_REASONS = "list_filter([case when prob < 0.3 then case when doc_id % 4 = 0 then 'escalated' else 'low_confidence' end end, case when n > 1 then 'many' end, case when lang = 'de' then 'clinical' end, case when label = 'toxic' and pred = 1 then 'burnout' end, case when prob >= 1 then 'span_is_whole_text' end], lambda x: x is not null)"


@query("f17_review_reasons", f"with {_P}, q as (select *, sum(pred) over (partition by doc_id) as n from p) select doc_id, label, unnest({_REASONS}) as reason from q union all select doc_id, 'none', 'parse_failure' from documents where doc_id % 97 = 0")
def f17a(spark, sf):
    """All five predicates, one row a reason, and the rows of failed parses."""
    p = predictions(spark, sf)
    asserted = p.groupBy("doc_id").agg(F.sum("pred").alias("n"))
    checks = (
        F.when(F.col("prob") < 0.3, F.when(F.col("doc_id") % 4 == 0, "escalated").otherwise("low_confidence")), F.when(F.col("n") > 1, "many"), F.when(F.col("lang") == "de", "clinical"),
        F.when((F.col("label") == "toxic") & (F.col("pred") == 1), "burnout"), F.when(F.col("prob") >= 1, "span_is_whole_text"),
    )
    rows = p.join(asserted, "doc_id").select("doc_id", "label", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("reason"))
    return rows.unionByName(docs_of(spark, sf).where("doc_id % 97 = 0").select("doc_id", F.lit("none").alias("label"), F.lit("parse_failure").alias("reason")))


_INVARIANTS = "list_filter([case when prob >= 0.5 and pred = 0 then 'PRESENT_WITHOUT_SPAN' end, case when n > 1 and label = 'toxic' then 'DUPLICATE_CONSTRUCT' end, case when lang = 'fr' and label = 'quality' and pred = 0 then 'MODIFIER_WITHOUT_ANXIETY' end, case when doc_id % 10 = 0 and pred = 1 then 'ESCALATED_WITH_LABELS' end, case when truth = 1 and prob < 0.05 then 'SPAN_NOT_IN_TEXT' end], lambda x: x is not null)"


@query("f15_schema_invariants", f"with {_P}, q as (select *, sum(pred) over (partition by doc_id) as n from p) select doc_id, label, unnest({_INVARIANTS}) as violation from q")
def f15a(spark, sf):
    p = predictions(spark, sf)
    n = p.groupBy("doc_id").agg(F.sum("pred").alias("n"))
    checks = {
        "PRESENT_WITHOUT_SPAN": (F.col("prob") >= 0.5) & (F.col("pred") == 0), "DUPLICATE_CONSTRUCT": (F.col("n") > 1) & (F.col("label") == "toxic"),
        "MODIFIER_WITHOUT_ANXIETY": (F.col("lang") == "fr") & (F.col("label") == "quality") & (F.col("pred") == 0), "ESCALATED_WITH_LABELS": (F.col("doc_id") % 10 == 0) & (F.col("pred") == 1),
        "SPAN_NOT_IN_TEXT": (F.col("truth") == 1) & (F.col("prob") < 0.05),
    }
    return p.join(n, "doc_id").select("doc_id", "label", F.explode(F.filter(F.array(*(F.when(c, k) for k, c in checks.items())), lambda x: x.isNotNull())).alias("violation"))


# ---- orders


@query("t2_top_spans", "select l_orderkey, list_slice(list_transform(list_sort(list({'s': -round(abs(l_discount - 0.05), 6), 'n': l_linenumber})), lambda x: x.n), 1, 3) as lines from lineitem where round(abs(l_discount - 0.05), 6) >= 0.02 group by l_orderkey")
def t2(spark, sf):
    score = F.round(F.abs(F.col("l_discount") - 0.05), 6)
    spans = table(spark, sf, "lineitem").where(score >= 0.02).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct((-score).alias("s"), F.col("l_linenumber").alias("n")))).alias("x"))
    return spans.select("l_orderkey", F.slice(F.transform("x", lambda s: s["n"]), 1, 3).alias("lines"))


@query("t7_squad_order", "select n_name, c_custkey, place from (select n_name, c_custkey, row_number() over (partition by n_name order by c_acctbal desc, c_custkey) as place from customer join nation on c_nationkey = n_nationkey) where place <= 11")
def t7(spark, sf):
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_name").orderBy(F.desc("c_acctbal"), "c_custkey")
    return c.select("n_name", "c_custkey", F.row_number().over(w).alias("place")).where("place <= 11")


@query("t8_widget_order", f"with {_P} select doc_id, label, row_number() over (partition by doc_id order by pred = 0, prob desc, label) as place from p")
def t8(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.col("pred") == 0, F.desc("prob"), "label")
    return predictions(spark, sf).select("doc_id", "label", F.row_number().over(w).alias("place"))


@query("t9_findings_by_severity", _F18 + " select severity, kind, n, row_number() over (order by case severity when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, kind) as place from (select severity, kind, count(*) as n from f group by all)")
def t9(spark, sf):
    c = findings.gated_scan(docs_of(spark, sf), "doc_id", "text").where("not waived").groupBy("severity", "kind").agg(N().alias("n"))
    rank = F.when(F.col("severity") == "HIGH", 0).when(F.col("severity") == "MEDIUM", 1).otherwise(2)
    return c.withColumn("place", F.row_number().over(Window.orderBy(rank, "kind")))  # one row a detector


# ---- text and scalar functions


@query("x8_placeholder_counts", r"select lang, sum(len(regexp_extract_all(regexp_replace(text, '[0-9]+', '[NUMBER]', 'g'), '\[[A-Z][A-Z_]*\]')))::bigint as n from documents group by lang")
def x8(spark, sf):
    masked = F.regexp_replace("text", "[0-9]+", "[NUMBER]")
    return docs_of(spark, sf).groupBy("lang").agg(F.sum(F.regexp_count(masked, F.lit(X.PLACEHOLDER))).alias("n"))


_SENTENCES = "[^.!?\\n]+[.!?]*"


@query("x18_sentence_around_span", f"with s as (select doc_id, unnest(regexp_extract_all(text, '{_SENTENCES}')) as sentence, generate_subscripts(regexp_extract_all(text, '{_SENTENCES}'), 1) as place from documents where contains(text, 'icense')) select doc_id, place::bigint as place, trim(sentence, ' ') as sentence from s where contains(sentence, 'icense')")
def x18(spark, sf):
    """Every sentence that holds the span, with its place in the text."""
    s = docs_of(spark, sf).where(F.col("text").contains("icense")).select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(_SENTENCES), F.lit(0))).alias("at", "sentence"))
    return s.where(F.col("sentence").contains("icense")).select("doc_id", (F.col("at") + 1).cast("long").alias("place"), F.trim("sentence").alias("sentence"))


@query("x19_realigned_offsets", r"with t as (select doc_id, regexp_extract_all(text, '[ \t\n\f\r]*[^ \t\n\f\r]+') as runs from documents), p as (select doc_id, unnest(runs) as run, generate_subscripts(runs, 1) as i from t), o as (select doc_id, i, sum(length(run)) over (partition by doc_id order by i) - length(ltrim(run, E' \t\n\f\r')) as start from p), g as (select doc_id, count(*) as n, md5(string_agg(start::bigint, ',' order by i)) as starts_md5 from o group by doc_id) select doc_id, coalesce(n, 0) as n, coalesce(starts_md5, md5('')) as starts_md5 from documents left join g using (doc_id)")
def x19(spark, sf):
    """Where each piece of a whole text begins: looked for from the end of the one before it, so every character is passed once."""
    return udfs.realigned(docs_of(spark, sf), "doc_id", "text").select("doc_id", F.size("starts").cast("long").alias("n"), F.md5(F.array_join("starts", ",")).alias("starts_md5"))


_PICK = lambda seed, key, n: f"({_U(seed, key)} % {n})"


@query("x20_template_fill", f"select doc_id, case {_PICK(11, 'doc_id', 2)} when 0 then 'A ' else 'One ' end || case {_PICK(12, 'doc_id', 3)} when 0 then 'text' when 1 then 'piece' else 'note' end || ' from ' || source || ' in ' || lang || '.' as line from documents")
def x20(spark, sf):
    pick = lambda seed, words: F.element_at(X.among(words), (X.draw(F.lit(seed), F.col("doc_id")) % len(words) + 1).cast("int"))
    return docs_of(spark, sf).select("doc_id", F.concat(pick(11, ("A ", "One ")), pick(12, ("text", "piece", "note")), F.lit(" from "), "source", F.lit(" in "), "lang", F.lit(".")).alias("line"))


@query("x27_rubric_prompt", "select 'Region ' || r_name || ': ' || string_agg(n_name, ', ' order by n_name) || '.' as prompt from nation join region on n_regionkey = r_regionkey group by r_name")
def x27(spark, sf):
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.groupBy("r_name").agg(F.array_sort(F.collect_list("n_name")).alias("names")).select(F.concat(F.lit("Region "), "r_name", F.lit(": "), F.array_join("names", ", "), F.lit(".")).alias("prompt"))


@query("x28_follow_up", "select p_partkey, 'How often have you seen ' || lower(p_name) || '?' as prompt from part")
def x28(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("How often have you seen "), F.lower("p_name"), F.lit("?")).alias("prompt"))


@query("m7_face_index", "select event_id, round(greatest(0.0, least(1.0, 0.6 * value / 100 + 0.6 * cast(json_extract(props, '$.k') as bigint) / 100 - 0.1)), 6) as face from events")
def m7(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select("event_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.6 * F.col("value") / 100 + 0.6 * k / 100 - 0.1)), 6).alias("face"))


@query("m12_fenced_json", "select event_id, cast(json_extract(props, '$.k') as bigint) as k from events")
def m12(spark, sf):
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" ``` "), "props", F.lit("```\n"))).otherwise(F.col("props"))
    return table(spark, sf, "events").select("event_id", F.from_json(validation.unfenced(fenced), "k long")["k"].alias("k"))


# ---- resamples


def _resampled(rows, key, sums, resamples, seed):
    """Sums over `resamples` Poisson-weighted resamples: every partition adds up for itself."""
    u = X.draw(F.lit(seed), F.col("r"), F.col(key)) / float(2**32)
    weight = sum((F.when(u >= e, 1).otherwise(0) for e in (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119)), F.lit(0))
    each = rows.select(key, *sums, F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("r")).withColumn("w", weight)
    return each.groupBy("r").agg(*(F.sum(F.col("w") * F.col(s)).alias(s) for s in sums), F.sum("w").alias("w"))


def _bounds(stats, value):
    listed = stats.groupBy().agg(F.array_sort(F.collect_list(value)).alias("s"))  # one number a resample
    return listed.select(F.round(F.get("s", 5), 6).alias("low"), F.round(F.get("s", 195), 6).alias("high"))


_BOOT = lambda seed: f"('0x' || substr(md5('{seed}:' || cast(r as varchar) || ':' || cast(doc_id as varchar)), 1, 8))::bigint / {float(2**32)}"


@query("b2_bootstrap_proportion", f"with x as (select toxic as v, r, {_BOOT(5)} as u from labels, range(200) t(r)), m as (select r, sum(({_EDGES}) * v) / sum({_EDGES}) as m from x group by r), l as (select list_sort(list(m)) as s from m) select round(s[6], 6) as low, round(s[196], 6) as high from l")
def b2(spark, sf):
    m = _resampled(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", ["toxic"], 200, 5)
    return _bounds(m, F.col("toxic") / F.col("w"))


@query("b3_f1_interval", f"with {_P}, q as (select doc_id, (truth = 1 and pred = 1)::int as tp, (truth <> pred)::int as wrong from p where label = 'quality'), x as (select tp, wrong, r, {_BOOT(6)} as u from q, range(200) t(r)), m as (select r, 2 * sum(({_EDGES}) * tp) / (2 * sum(({_EDGES}) * tp) + sum(({_EDGES}) * wrong)) as m from x group by r), l as (select list_sort(list(m)) as s from m) select round(s[6], 6) as low, round(s[196], 6) as high from l")
def b3(spark, sf):
    p = predictions(spark, sf).where("label = 'quality'")
    q = p.select("doc_id", ((F.col("truth") == 1) & (F.col("pred") == 1)).cast("int").alias("tp"), (F.col("truth") != F.col("pred")).cast("int").alias("wrong"))
    m = _resampled(q, "doc_id", ["tp", "wrong"], 200, 6)
    return _bounds(m, 2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong")))


@query("b6_rating_sheet", f"with i as (select doc_id, kind, {_U(9, 'doc_id || kind')} as u from labels, (values ('model'), ('control'), ('mismatch')) k(kind)) select row_number() over (order by u, doc_id, kind) as place, doc_id, kind from i")
def b6(spark, sf):
    """Three items for each rated text, in an order that tells nothing of their kind; ordered by ranges."""
    i = table(spark, sf, "labels").select("doc_id", F.explode(X.among(("model", "control", "mismatch"))).alias("kind"))
    i = i.withColumn("u", X.draw(F.lit(9), F.concat(F.col("doc_id").cast("string"), "kind"))).withColumn("sheet", F.lit(0))
    return sampling.row_numbers(i, "sheet", [F.col("u"), F.col("doc_id"), F.col("kind")]).select(F.col("rn").alias("place"), "doc_id", "kind")


# ---- pools


_NEAR = f"d as (select doc_id, list_sort(list_distinct({TOK})) as s from documents where lang in ('en', 'de') and n_chars >= 50), c as (select s, min(doc_id) as id from d where len(s) > 0 group by s), t as (select id, len(s) as n, unnest(s) as tok from c), sh as (select a.id as a, b.id as b, a.n as na, b.n as nb, count(*) as i from t a join t b on a.tok = b.tok and a.id < b.id group by all), pp as (select a, b from sh where i / (na + nb - i) >= 0.8 - 1e-12), nb as (select b as id, list(a) as smaller, row_number() over (order by b) as k from pp group by b)"


@query("p4_eligible_pool", f"with recursive {_NEAR}, r(k, dropped) as (select 0::bigint, []::bigint[] union all select r.k + 1, case when len(list_filter(smaller, lambda x: not list_contains(dropped, x))) > 0 then list_append(dropped, nb.id) else dropped end from r join nb on nb.k = r.k + 1) select c.id as doc_id from c where c.id not in (select unnest(dropped) from (select dropped from r order by k desc limit 1))")
def p4(spark, sf):
    """Admitted rows, equal token sets once, then near-duplicates: a row stays unless a kept one with a smaller id is like it."""
    d = docs_of(spark, sf).where(F.col("lang").isin("en", "de") & (F.col("n_chars") >= 50))
    tokens = X.tokenise(F.col("text"))
    return duplicates.first_of_similar(d, "doc_id", tokens, 0.8)


@query("p5_draw_coverage", f"with r as (select doc_id, lang, source, row_number() over (partition by lang, source order by {_U(21, 'doc_id')}, doc_id) as k from documents) select lang, count(*) as available, sum((k <= 3)::int)::bigint as drawn from r group by lang")
def p5(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "lang", F.concat_ws("|", "lang", "source").alias("cell"), X.draw(F.lit(21), F.col("doc_id")).alias("u"))
    ranked = sampling.row_numbers(d, "cell", [F.col("u"), F.col("doc_id")])
    return ranked.groupBy("lang").agg(N().alias("available"), F.sum((F.col("rn") <= 3).cast("long")).alias("drawn"))


_GROUPS = "g as (select user_id, list_sort(list_distinct(list(event_type || cast(day(ts) % 4 as varchar)))) as g from events group by user_id)"
_SIDES = lambda seed, share: f"list_transform(g, lambda x: ('0x' || substr(md5('{seed}:' || x), 1, 8))::bigint < {int(share * 2**32)})"


@query("p6_validation_carve", f"with {_GROUPS}, s as (select user_id, {_SIDES(31, 0.2)} as s from g), v as (select user_id, case when len(list_filter(s, lambda x: not x)) = 0 then 'test' when len(list_filter(s, lambda x: x)) = 0 then 'train' else 'discarded' end as side from s), c as (select sum((side = 'test')::int) as n from v) select user_id, case when c.n > 0 then side when {_U(32, 'user_id')} < {int(0.2 * 2**32)} then 'test' else 'train' end as side from v, c")
def p6(spark, sf):
    """A split by whole groups; where it leaves one side empty, a split by the rows' own draws."""
    g = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat("event_type", (F.dayofmonth("ts") % 4).cast("string")))).alias("g"))
    split = cut(sampling.group_disjoint_split(g, "user_id", F.col("g"), 0.2, 31))
    if split.where("side = 'test'").isEmpty():
        return split.select("user_id", F.when(X.draw(F.lit(32), F.col("user_id")) < int(0.2 * 2**32), "test").otherwise("train").alias("side"))
    return split


@query("p2_whole_group_split", f"with {_GROUPS}, s as (select user_id, {_SIDES(7, 0.5)} as s from g), v as (select user_id, case when len(list_filter(s, lambda x: not x)) = 0 then 'test' when len(list_filter(s, lambda x: x)) = 0 then 'train' else 'discarded' end as side from s), t as (select distinct round(value) as said from events join v using (user_id) where side = 'train') select user_id, side, (select count(*) from events e where e.user_id = v.user_id and (side <> 'test' or round(e.value) not in (select said from t)))::bigint as n from v")
def p2w(spark, sf):
    """All groups of a key decide its side; then the test side gives up the rows whose text (here a rounded value) train has."""
    e = table(spark, sf, "events").select("user_id", "event_type", "ts", F.round("value").alias("said"))
    g = e.groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat("event_type", (F.dayofmonth("ts") % 4).cast("string")))).alias("g"))
    side = cut(sampling.group_disjoint_split(g, "user_id", F.col("g"), 0.5, 7))
    rows = e.select("user_id", "said").join(side, "user_id")
    train = rows.where("side = 'train'").select("said").distinct()
    left = rows.where("side <> 'test'").unionByName(rows.where("side = 'test'").join(train, "said", "left_anti").select(*rows.columns))
    return side.join(left.groupBy("user_id").agg(N().alias("n")), "user_id", "left").select("user_id", "side", F.coalesce("n", F.lit(0)).alias("n"))


_SYN = (("red", "crimson"), ("green", "olive"), ("blue", "navy"), ("big", "large"), ("small", "tiny"))


@query("p9_substitutions", "with w as (select p_partkey, unnest(string_split(lower(p_name), ' ')) as token, generate_subscripts(string_split(lower(p_name), ' '), 1) as place from part), s(token, other) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in _SYN) + ") select p_partkey, place::bigint as place, token, other, token[1] in ('a', 'e', 'i', 'o', 'u') <> (other[1] in ('a', 'e', 'i', 'o', 'u')) as article_changes from w join s using (token)")
def p9(spark, sf):
    """Every place where a word of a group can stand for another, with a grammar probe: does the article before it change?"""
    w = table(spark, sf, "part").select("p_partkey", F.posexplode(F.split(F.lower("p_name"), " ")).alias("at", "token"))
    s = F.broadcast(spark.createDataFrame(list(_SYN), "token string, other string"))  # a fixed list
    vowel = lambda c: F.substring(c, 1, 1).isin("a", "e", "i", "o", "u")
    return w.join(s, "token").select("p_partkey", (F.col("at") + 1).cast("long").alias("place"), "token", "other", (vowel("token") != vowel("other")).alias("article_changes"))


@query("p11_two_sample_plan", f"with r as (select doc_id, source, {_U(51, 'source')} < {int(0.5 * 2**32)} as held from documents), k as (select doc_id, source, held, row_number() over (partition by held, source order by case when held then {_U(52, 'doc_id')} else {_U(53, 'doc_id')} end, doc_id) as k from r) select doc_id, case when held then 'evaluation' else 'development' end as pool from k where k <= 5")
def p11(spark, sf):
    """The evaluation pool is drawn from held-out groups, the development pool from the others with the next seed: no shared group."""
    d = docs_of(spark, sf).select("doc_id", "source", (X.draw(F.lit(51), F.col("source")) < int(0.5 * 2**32)).alias("held"))
    d = d.withColumn("u", F.when(F.col("held"), X.draw(F.lit(52), F.col("doc_id"))).otherwise(X.draw(F.lit(53), F.col("doc_id"))))
    ranked = sampling.row_numbers(d, "source", [F.col("u"), F.col("doc_id")]).where("rn <= 5")
    return ranked.select("doc_id", F.when(F.col("held"), "evaluation").otherwise("development").alias("pool"))


# ---- composites


@query("m5_context_index", f"with {_H}, s as (select doc_id, sum(p * direction * magnitude * case when construct like '%anxiety%' then case when doc_id % 3 = 0 then 0.5 when doc_id % 3 = 1 then 1.5 else 1.0 end else 1.0 end) as text_only from h join w using (construct) group by doc_id) select doc_id, round(text_only, 6) as text_score, round(text_only + 0.3 * n_chars / 20000, 6) as context_score, round(1 / (1 + exp(-text_only)), 6) as text_index, round(1 / (1 + exp(-(text_only + 0.3 * n_chars / 20000))), 6) as context_index from s join documents using (doc_id)")
def m5c(spark, sf):
    """The fused index twice: from the text alone, with the interpretation's factor on the anxiety terms, and with context weights."""
    factor = F.when(F.col("doc_id") % 3 == 0, 0.5).when(F.col("doc_id") % 3 == 1, 1.5).otherwise(1.0)
    c = contributions(spark, sf, 0).withColumn("c", F.col("contribution") * F.when(F.col("construct").contains("anxiety"), factor).otherwise(1.0))
    s = c.groupBy("doc_id").agg(F.sum("c").alias("t")).join(docs_of(spark, sf).select("doc_id", "n_chars"), "doc_id").withColumn("x", F.col("t") + 0.3 * F.col("n_chars") / 20000)
    index = lambda v: F.round(1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), F.col(v))))), 6)
    return s.select("doc_id", F.round("t", 6).alias("text_score"), F.round("x", 6).alias("context_score"), index("t").alias("text_index"), index("x").alias("context_index"))


@query("c4_facial_features", "select vec_id, case when len(embedding) >= 64 then round(greatest(-1, least(1, embedding[1]::double + embedding[64]::double)), 6) else round(greatest(-1, least(1, embedding[1]::double)), 6) end as tension from embeddings")
def c4(spark, sf):
    at = lambda k: F.get("embedding", k).cast("double")
    clamp = lambda v: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), v)), 6)
    return table(spark, sf, "embeddings").select("vec_id", F.when(F.size("embedding") >= 64, clamp(at(0) + at(63))).otherwise(clamp(at(0))).alias("tension"))


@query("c5_baseline_audit", "select event_id, unnest(list_filter([case when cast(json_extract(props, '$.k') as bigint) > 80 then 'CONFIRMED_SECRET' end, case when event_id % 10 = 0 then 'PATH_SEPARATOR' end, case when ts > timestamp '2024-01-20' then 'NEWER_THAN_BASELINE' end], lambda x: x is not null)) as reason from events where event_type = 'error'")
def c5(spark, sf):
    path = F.concat(F.lit("src"), F.when(F.col("event_id") % 10 == 0, "\\").otherwise("/"), F.col("event_id").cast("string"))
    checks = (F.when(F.get_json_object("props", "$.k").cast("long") > 80, "CONFIRMED_SECRET"), F.when(path.contains("\\"), "PATH_SEPARATOR"), F.when(F.col("ts") > F.to_timestamp_ntz(F.lit("2024-01-20")), "NEWER_THAN_BASELINE"))
    return table(spark, sf, "events").where("event_type = 'error'").select("event_id", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("reason"))


@query("c9_changelog_cost", "with o as (select p_brand as name, count(*) as n from part where p_size < 26 group by 1), w as (select p_brand as name, count(*) as n from part where p_size >= 25 group by 1) select coalesce(o.name, w.name) as name, case when o.name is null then 'added' when w.name is null then 'removed' when o.n <> w.n then 'changed' else 'same' end as change, case when o.name is null or w.name is null or o.n <> w.n then coalesce(o.n, 0) else 0 end::bigint as relabel from o full join w on o.name = w.name")
def c9(spark, sf):
    p = table(spark, sf, "part")
    o, w = (p.where(c).groupBy(F.col("p_brand").alias("name")).agg(N().alias(k)) for c, k in (("p_size < 26", "o"), ("p_size >= 25", "w")))
    both = o.join(w, "name", "full")
    change = F.when(F.col("o").isNull(), "added").when(F.col("w").isNull(), "removed").when(F.col("o") != F.col("w"), "changed").otherwise("same")
    return both.select("name", change.alias("change"), F.when(change != "same", F.coalesce("o", F.lit(0))).otherwise(0).cast("long").alias("relabel"))


@query("c10_project_export", "select conv_id, count(*) as n, sum(length(text))::bigint as chars from conversations group by conv_id")
def c10(spark, sf):
    """Items are exported as JSON lines, one for each conversation's turn, and read back as the tool would."""
    path = _folder(spark, "project")
    table(spark, sf, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), "text").write.json(path)
    back = spark.read.schema("conv_id long, id string, text string").json(path)
    return back.groupBy("conv_id").agg(N().alias("n"), F.sum(F.length("text")).alias("chars"))


@query("c16_method_agreement", "with t as (select l_orderkey, list_slice(list_transform(list_sort(list({'s': -l_extendedprice, 'n': l_linenumber})), lambda x: x.n), 1, 2) as a, list_slice(list_transform(list_sort(list({'s': -l_quantity, 'n': l_linenumber})), lambda x: x.n), 1, 2) as b from lineitem group by l_orderkey) select l_orderkey, round(len(list_distinct(list_intersect(a, b))) / len(list_distinct(list_concat(a, b))), 6) as agreement from t")
def c16(spark, sf):
    """Two attributions' top spans compared as sets."""
    top = lambda c: F.slice(F.transform(F.array_sort(F.collect_list(F.struct((-F.col(c)).alias("s"), F.col("l_linenumber").alias("n")))), lambda x: x["n"]), 1, 2)
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(top("l_extendedprice").alias("a"), top("l_quantity").alias("b"))
    return t.select("l_orderkey", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("agreement"))


@query("l7_sentence_ribbon", r"with s as (select doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) as said, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) as k from documents where lang = 'en') select doc_id, k::bigint as k, length(trim(said)) as n, round(len(list_filter(regexp_extract_all(lower(said), '[a-z]+'), lambda w: w in ('i', 'we', 'nervous', 'the'))) / len(regexp_extract_all(lower(said), '[a-z]+')), 6) as score from s where len(regexp_extract_all(lower(said), '[a-z]+')) >= 4")
def l7(spark, sf):
    """Each admitted sentence with its own score."""
    s = docs_of(spark, sf).where("lang = 'en'").select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))).alias("k", "said"))
    w = s.withColumn("w", F.regexp_extract_all(F.lower("said"), F.lit("[a-z]+"), F.lit(0))).where(F.size("w") >= 4)
    return w.select("doc_id", (F.col("k") + 1).cast("long").alias("k"), F.length(F.trim("said")).alias("n"), F.round(X.listed(F.col("w"), ("i", "we", "nervous", "the")) / F.size("w"), 6).alias("score"))


@query("a12_confusion_pairs", f"with {_P}, m as (select doc_id, label from p where truth = 1 and pred = 0), s as (select doc_id, label from p where truth = 0 and pred = 1) select m.label as missed, s.label as spurious, count(*) as n from m join s using (doc_id) group by all")
def a12(spark, sf):
    p = predictions(spark, sf)
    m, s = p.where("truth = 1 and pred = 0").select("doc_id", F.col("label").alias("missed")), p.where("truth = 0 and pred = 1").select("doc_id", F.col("label").alias("spurious"))
    return m.join(s, "doc_id").groupBy("missed", "spurious").agg(N().alias("n"))


@query("a35_score_set", f"with {_P}, a as (select label, round(f1, 6) as f1, (tp + fn)::bigint as support from f) select label, f1, support from a union all select '(macro)', round(avg(f1), 6), sum(support)::bigint from a")
def a35(spark, sf):
    c = predictions(spark, sf).groupBy("label").agg(
        F.sum(((F.col("truth") == 1) & (F.col("pred") == 1)).cast("long")).alias("tp"), F.sum((F.col("truth") != F.col("pred")).cast("long")).alias("wrong"), F.sum("truth").cast("long").alias("support"))
    a = c.select("label", F.round(F.when(2 * F.col("tp") + F.col("wrong") == 0, 0.0).otherwise(2 * F.col("tp") / (2 * F.col("tp") + F.col("wrong"))), 6).alias("f1"), "support")
    return a.unionByName(a.agg(F.lit("(macro)").alias("label"), F.round(F.avg("f1"), 6).alias("f1"), F.sum("support").alias("support")).select("label", "f1", "support"))


@query("a36_queue_totals", f"with {_P}, q as (select doc_id, unnest(list_filter([case when prob < 0.3 then 'low_confidence' end, case when truth <> pred then 'disagreement' end], lambda x: x is not null)) as reason from p) select reason, count(*) as n, count(distinct doc_id) as n_docs from q group by reason union all select '(all)', count(*), count(distinct doc_id) from q")
def a36(spark, sf):
    checks = F.array(F.when(F.col("prob") < 0.3, "low_confidence"), F.when(F.col("truth") != F.col("pred"), "disagreement"))
    q = predictions(spark, sf).select("doc_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("reason"))
    return q.rollup("reason").agg(N().alias("n"), F.countDistinct("doc_id").alias("n_docs")).withColumn("reason", F.coalesce("reason", F.lit("(all)")))


@query("a3_bootstrap_lengths", f"with x as (select n_chars as v, r, {_BOOT(8)} as u from documents, range(200) t(r)), m as (select r, sum(({_EDGES}) * v) / sum({_EDGES}) as m from x group by r), l as (select list_sort(list(m)) as s from m) select count(*) as n, round(avg(n_chars), 6) as mean, quantile_disc(n_chars, 0.25) as p25, quantile_disc(n_chars, 0.9) as p90, (select round(s[6], 6) from l) as low, (select round(s[196], 6) from l) as high from documents")
def a3(spark, sf):
    d = docs_of(spark, sf).select("doc_id", "n_chars")
    interval = _bounds(_resampled(d, "doc_id", ["n_chars"], 200, 8), F.col("n_chars") / F.col("w"))
    told = d.agg(N().alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.expr("percentile_disc(0.25) within group (order by n_chars)").cast("long").alias("p25"), F.expr("percentile_disc(0.9) within group (order by n_chars)").cast("long").alias("p90"))
    return told.crossJoin(interval)  # one row each
