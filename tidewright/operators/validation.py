"""Validation of structured answers and annotations: the first reason against each, as plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewright.functions.text import let

#: Reason codes of a label response, in the order in which they are looked for.
RESPONSE_CODES = (
    "EMPTY_RESPONSE", "NOT_JSON", "NOT_AN_OBJECT", "MISSING_KEYS", "BAD_ABSTAIN", "NO_RATIONALE", "BAD_CONFIDENCE", "BAD_LABELS",
    "BAD_LABEL_ITEM", "UNKNOWN_CONSTRUCT", "DUPLICATE_CONSTRUCT", "BAD_INTENSITY", "BAD_CATEGORICAL_VALUE", "BAD_GRADED_VALUE", "BAD_SPANS",
    "SPAN_NOT_IN_TEXT", "SCHEMA_VIOLATION", "BAD_MODIFIER", "BAD_LOW_RESILIENCE", "CONTRADICTORY_ABSTENTION",
)
#: The keys that a response must have, and the values of its modifier.
REQUIRED, MODIFIERS = ("abstain", "rationale", "confidence", "labels"), ("facilitative", "debilitative", "unclear")


def unfenced(raw: Column) -> Column:
    """A response without white space around it and without a code fence."""
    trimmed = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    return F.regexp_replace(trimmed, r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def _at(v: Column, key: str) -> Column:
    """The value under a key of an object; null only where the key is missing."""
    return F.variant_get(v, f"$.{key}", "variant")


def _type(v: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("MISSING"))


def _text(v: Column, key: str) -> Column:
    return F.trim(F.coalesce(F.try_variant_get(v, f"$.{key}", "string"), F.lit("")))


def _number(v: Column) -> Column:
    """The value as a number, null where it is none (true and false aren't numbers)."""
    return F.when(~_type(v).isin("BOOLEAN", "VOID", "OBJECT", "ARRAY", "MISSING"), F.try_variant_get(v, "$", "double"))


def _share(v: Column) -> Column:
    return F.coalesce(_number(v).between(0, 1), F.lit(False))


def _item_code(item: Column, earlier: Column, text: Column, constructs: dict[str, tuple[str, ...]]) -> Column:
    """struct(code, present) of one label entry: the first reason against it, and whether it asserts its construct."""
    name, value = _text(item, "construct"), _text(item, "value")
    graded = [c for c, labels in constructs.items() if not labels]
    listed = F.lit(False)
    for c, labels in constructs.items():
        if labels:
            listed = listed | ((name == c) & value.isin(*labels))
    intensity = _number(_at(item, "intensity"))
    whole = F.coalesce((intensity == F.floor(intensity)) & intensity.between(0, 3), F.lit(False))
    level = F.when(value.isin("none", "absent"), F.lit(0.0)).otherwise(intensity)
    kind = _type(_at(item, "evidence_spans"))
    spans = F.when(kind == "ARRAY", F.filter(F.try_variant_get(item, "$.evidence_spans", "array<string>"), lambda s: F.trim(s) != "")).otherwise(F.array().cast("array<string>"))

    def judged(s: Column) -> Column:
        absent = (level == 0) & (value.isin("none", "absent") | (F.size(s) == 0))
        code = (
            F.when(_type(item) != "OBJECT", "BAD_LABEL_ITEM")
            .when(~name.isin(*constructs), "UNKNOWN_CONSTRUCT")
            .when(F.array_contains(earlier, name), "DUPLICATE_CONSTRUCT")
            .when(~whole, "BAD_INTENSITY")
            .when(~name.isin(*graded) & ~listed, "BAD_CATEGORICAL_VALUE")
            .when(name.isin(*graded) & ~value.isin("present", "absent"), "BAD_GRADED_VALUE")
            .when(~kind.isin("ARRAY", "VOID", "MISSING"), "BAD_SPANS")
            .when(F.exists(s, lambda x: ~text.contains(x)), "SPAN_NOT_IN_TEXT")
            .when(_at(item, "confidence").isNotNull() & ~_share(_at(item, "confidence")), "BAD_CONFIDENCE")
            .when(~absent & ((level < 1) | (F.size(s) == 0)), "SCHEMA_VIOLATION")
        )
        return F.struct(code.alias("code"), (code.isNull() & ~absent).alias("present"))

    return let(spans, judged)


def response_verdict(raw: Column, text: Column, constructs: dict[str, tuple[str, ...]]) -> Column:
    """struct(code, abstain, n_labels) of a model's response on a text: OK or the first reason against it.

    constructs names the allowed labels of each construct (none for graded ones). An entry that says absent or none takes
    intensity 0 and isn't counted; a response without entries that assert something abstains, whether it says so or not.
    """

    def verdict(p: Column) -> Column:
        v, items = p["v"], p["items"]
        codes = F.filter(F.transform(items, lambda x: x["code"]), lambda c: c.isNotNull())
        present = F.size(F.filter(items, lambda x: x["present"]))
        abstain = F.try_variant_get(v, "$.abstain", "boolean")
        modifier = F.lower(_text(v, "interpretation_modifier"))
        missing = F.lit(False)
        for key in REQUIRED:
            missing = missing | _at(v, key).isNull()
        code = (
            F.when(p["body"] == "", "EMPTY_RESPONSE")
            .when(v.isNull(), "NOT_JSON")
            .when(_type(v) != "OBJECT", "NOT_AN_OBJECT")
            .when(missing, "MISSING_KEYS")
            .when(_type(_at(v, "abstain")) != "BOOLEAN", "BAD_ABSTAIN")
            .when(_text(v, "rationale") == "", "NO_RATIONALE")
            .when(~_share(_at(v, "confidence")), "BAD_CONFIDENCE")
            .when(_type(_at(v, "labels")) != "ARRAY", "BAD_LABELS")
            .when(F.size(codes) > 0, F.get(codes, 0))
            .when(~modifier.isin("", "null", "none", *MODIFIERS), "BAD_MODIFIER")
            .when(~_type(_at(v, "low_resilience_explicit")).isin("BOOLEAN", "MISSING"), "BAD_LOW_RESILIENCE")
            .when(abstain & (present > 0), "CONTRADICTORY_ABSTENTION")
            .otherwise("OK")
        )
        return let(code, lambda c: F.struct(c.alias("code"), F.when(c == "OK", abstain | (present == 0)).alias("abstain"), F.when(c == "OK", present).cast("long").alias("n_labels")))

    def itemised(body: Column) -> Column:
        def of(v: Column) -> Column:
            entries = F.when(_type(_at(v, "labels")) == "ARRAY", F.try_variant_get(v, "$.labels", "array<variant>")).otherwise(F.array().cast("array<variant>"))
            names = let(entries, lambda e: F.struct(e.alias("e"), F.transform(e, lambda x: _text(x, "construct")).alias("n")))
            items = let(names, lambda p: F.transform(p["e"], lambda x, i: _item_code(x, F.slice(p["n"], 1, i), text, constructs)))
            return F.struct(body.alias("body"), v.alias("v"), items.alias("items"))

        return let(F.try_parse_json(F.when(body != "", body)), of)

    return let(let(unfenced(raw), itemised), verdict)
