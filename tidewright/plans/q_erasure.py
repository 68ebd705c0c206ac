"""Queries on erasure curves of the lexicon's scorer."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import lexicons as L
from tidewright.operators import faithfulness
from tidewright.plans.catalog import query
from tidewright.plans.q_text import docs_of

#: The lexicon's cues of one word, with what each adds to its construct's log-odds.
_WEIGHTS = [(k, c, d * m) for k, c, d, m in L.CUES if " " not in c and d]
_VALUES = ", ".join(f"('{k}', '{c}', {w}::double)" for k, c, w in _WEIGHTS)
_F = faithfulness.FRACTIONS
_ODDS = "1 / (1 + exp(-greatest(-700.0, least(700.0, {}))))"
_POINTS = {
    "comprehensiveness": "s - t", "sufficiency": "t", "random_comprehensiveness": "s - r", "random_sufficiency": "r",
}
_B5 = f"""with d as (select doc_id, regexp_extract_all(lower(text), '[^ \\t\\n\\x0b\\f\\r]+') as ws from documents),
t as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as i from d),
v(construct, cue, w) as (values {_VALUES}), c as (select distinct construct from v),
x as (select t.doc_id, c.construct, t.i, coalesce(v.w, 0.0) as w, ('0x' || substr(md5('42:' || t.doc_id || ':' || c.construct || ':' || t.i), 1, 8))::bigint as u from t cross join c left join v on v.construct = c.construct and v.cue = t.word),
k as (select *, row_number() over (partition by doc_id, construct order by w desc, i) as top, row_number() over (partition by doc_id, construct order by u, i) as anyr, count(*) over (partition by doc_id, construct) as n from x),
e as (select doc_id, construct, f, greatest(1, round_even(n * f, 0)::int) as k, n, sum(w) as s, sum(case when top <= greatest(1, round_even(n * f, 0)::int) then w else 0 end) as t, sum(case when anyr <= greatest(1, round_even(n * f, 0)::int) then w else 0 end) as r
    from k, (values {", ".join(f"({f}::double)" for f in _F)}) fr(f) where n > 1 group by all),
p as (select doc_id, construct, {", ".join(f"avg({_ODDS.format('s')} - {_ODDS.format(expr)}) as {name}" for name, expr in _POINTS.items())} from e where k < n group by all)
select construct, count(*) as n, round(avg(comprehensiveness), 6) as comprehensiveness, round(avg(sufficiency), 6) as sufficiency,
    round(avg(comprehensiveness - random_comprehensiveness), 6) as comprehensiveness_margin, round(avg(random_sufficiency - sufficiency), 6) as sufficiency_margin from p group by construct"""


@query("b5_erasure_curves", _B5)
def b5(spark, sf):
    """Areas over the erasure curves of the lexicon's scorer, by construct, and their margins over random words."""
    words = docs_of(spark, sf).select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0)).alias("ws"))
    placed = F.transform("ws", lambda w, i: F.struct(i.cast("int").alias("at"), w.alias("word")))
    cues = words.select("doc_id", F.size("ws").alias("n"), F.filter(placed, lambda p: p["word"].isin([c for _, c, _ in _WEIGHTS])).alias("cues"))
    # what is left of a document is its number of words and its cues; rows of one doc_id are one text, as in the SQL
    texts = cues.groupBy("doc_id").agg(F.collect_list("n").alias("ns"), F.flatten(F.collect_list("cues")).alias("cues"))
    texts = texts.select("doc_id", "cues", F.flatten(F.transform("ns", lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")))).alias("ats"))

    def of(construct: str):
        own = [(c, float(w)) for k, c, w in _WEIGHTS if k == construct]
        value = lambda word: F.coalesce(*(F.when(word == c, F.lit(w)) for c, w in own), F.lit(0.0))
        mine = F.filter("cues", lambda p: p["word"].isin([c for c, _ in own]))
        return F.struct(F.lit(construct).alias("construct"), F.transform(mine, lambda p: F.struct(p["at"].alias("at"), value(p["word"]).alias("w"))).alias("points"))

    each = texts.select("doc_id", "ats", F.explode(F.array(*(of(c) for c in dict.fromkeys(k for k, _, _ in _WEIGHTS)))).alias("c")).select("doc_id", "ats", "c.*")
    found = faithfulness.margins(faithfulness.curves_of_texts(each, ["doc_id", "construct"], "ats", "points", [F.col("doc_id"), F.col("construct")]), "construct")
    return found.select("construct", "n", *(F.round(c, 6).alias(c) for c in found.columns[2:]))
