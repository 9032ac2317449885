"""JSON out of free-form replies, and texts from templates."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _bare(c: Column) -> Column:
    """Without code fences; else the outermost object or array in the text."""
    t = F.trim(F.regexp_replace(F.trim(c), r"(?i)^```(?:json)?\s*|\s*```$", ""))
    return F.when(t.rlike(r"^[\[{]"), t).otherwise(F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1))


def parse_messages(c: Column) -> Column:
    """Messages of a list, or of ``{"messages": [...]}``; items are strings or objects with text or message. None gives null."""
    t = _bare(c)
    lists = F.coalesce(F.get_json_object(t, "$.messages"), F.when(t.startswith("["), t))
    items = F.from_json(lists, "array<string>")

    def item(x):
        return F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.text"), F.get_json_object(x, "$.message"))).otherwise(x)

    out = F.filter(F.transform(items, lambda x: F.trim(item(x))), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(out) > 0, out)


def parse_verdicts(c: Column, n: int) -> Column:
    """Map of index to verdict; entries out of range or with other verdicts are skipped."""
    t = _bare(c)
    items = F.from_json(F.coalesce(F.get_json_object(t, "$.verdicts"), F.when(t.startswith("["), t)), "array<struct<i:int,verdict:string>>")
    good = F.filter(items, lambda x: x["i"].isNotNull() & (x["i"] >= 0) & (x["i"] < n) & F.lower(F.trim(x["verdict"])).isin("scam", "safe", "unsure"))
    pairs = F.transform(good, lambda x: F.struct(x["i"].alias("key"), F.lower(F.trim(x["verdict"])).alias("value")))
    # The last entry of an index wins.
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]))


def parse_explanation(c: Column) -> Column:
    """The explanation object of a reply, fenced or not; null unless every field is there with a known value and the right kind."""
    schema = "struct<verdict:string,risk_level:string,red_flags:array<string>,explanation:string,what_to_do:array<string>,matched_pattern:string>"
    o = F.from_json(_bare(c), schema)
    lists = F.get_json_object(_bare(c), "$.red_flags").startswith("[") & F.get_json_object(_bare(c), "$.what_to_do").startswith("[")
    good = o["verdict"].isin("safe", "suspicious", "scam") & o["risk_level"].isin("low", "medium", "high") & o["explanation"].isNotNull() & o["red_flags"].isNotNull() & o["what_to_do"].isNotNull() & lists
    return F.when(good, o)


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    for k, v in values.items():
        template = F.replace(template, F.lit("{" + k + "}"), F.coalesce(v.cast("string"), F.lit("")))
    return template


def safe_json(*cols: str) -> Column:
    """A JSON object in which NaN and infinities are null."""
    return F.to_json(F.struct(*[F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c) for c in cols]), {"ignoreNullFields": "false"})
