"""Verdicts from a model's score and the worst link, and their explanation, as one plan over all messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import cap_length, mask_text

#: From this probability on a flagged message is of high risk whatever its links.
CERTAIN = 0.8
# Sentence and advice per verdict; {pattern} is the name of a known pattern.
SENTENCES = {
    "en": {"scam": "This looks like a scam", "suspicious": "Parts of this message look suspicious", "safe": "Nothing here looks like a scam"},
    "hi": {"scam": "यह संदेश धोखाधड़ी लगता है", "suspicious": "इस संदेश के कुछ हिस्से संदिग्ध हैं", "safe": "इस संदेश में धोखाधड़ी नहीं दिखती"},
    "hinglish": {"scam": "Yeh message dhokha lagta hai", "suspicious": "Is message ke kuch hisse shak wale hain", "safe": "Is message mein dhokha nahi dikhta"},
}
WITH_PATTERN = {"en": " ({pattern}).", "hi": " ({pattern})।", "hinglish": " ({pattern})."}
ADVICE = {
    "scam": ["Open no link, call no number and give away no code or PIN.", "Send no money.", "Ask the firm itself, by its own app or site.", "Block and report the sender."],
    "suspicious": ["Open no link and give away nothing yet.", "Ask the sender by a way you already trust."],
    "safe": ["Nothing to do; ask the sender if in doubt."],
}


def verdict(is_scam: Column, probability: Column, worst_band: Column) -> Column:
    """struct(verdict, risk_level) by the fixed rules; a null score counts as not flagged, a null band as none."""
    flagged, band = F.coalesce(is_scam, F.lit(False)), F.coalesce(worst_band, F.lit("none"))

    def pair(v, r):
        return F.struct(F.lit(v).alias("verdict"), F.lit(r).alias("risk_level"))

    high = (probability >= CERTAIN) | band.isin("medium", "high")
    return (F.when(flagged & F.coalesce(high, F.lit(False)), pair("scam", "high")).when(flagged, pair("scam", "medium"))
            .when(band == "high", pair("suspicious", "high")).when(band == "medium", pair("suspicious", "medium")).otherwise(pair("safe", "low")))


def summary_sentence(language: Column, verdict_name: Column, pattern: Column) -> Column:
    """The sentence of a verdict in a language, with the pattern's name where there is one; other languages get English."""
    out = None
    for lang, by in SENTENCES.items():
        for v, s in by.items():
            full = F.when(pattern.isNull(), F.lit(s + ("।" if lang == "hi" else "."))).otherwise(F.replace(F.lit(s + WITH_PATTERN[lang]), F.lit("{pattern}"), pattern))
            hit = (F.when(language.isin("hi", "hinglish"), language).otherwise("en") == lang) & (verdict_name == v)
            out = F.when(hit, full) if out is None else out.when(hit, full)
    return out


def advice(verdict_name: Column) -> Column:
    out = None
    for v, items in ADVICE.items():
        a = F.array(*map(F.lit, items))
        out = F.when(verdict_name == v, a) if out is None else out.when(verdict_name == v, a)
    return out


def explain(rows: DataFrame, kb: DataFrame, key: str = "pos") -> DataFrame:
    """Adds explanation, red_flags, what_to_do and matched_pattern.

    ``rows`` hold verdict, language, reasons (array) and pattern_id. Red flags are the links' reasons and then those
    of the matched pattern; a pattern that the knowledge base does not hold counts as none. Null reasons are none.
    """
    # A side table of bounded size by its nature; the planner broadcasts it by its size.
    k = kb.select(F.col("id").alias("pattern_id"), F.col("name").alias("__name"), F.col("red_flags").alias("__flags"), F.col("what_to_do").alias("__todo"))
    j = rows.join(k, "pattern_id", "left")
    none = F.array().cast("array<string>")
    flags = F.concat(F.coalesce("reasons", none), F.coalesce("__flags", none))
    todo = F.when(F.col("__todo").isNotNull() & (F.col("__todo") != ""), F.array("__todo")).otherwise(advice(F.col("verdict")))
    return (j.withColumn("explanation", summary_sentence(F.col("language"), F.col("verdict"), F.col("__name"))).withColumn("red_flags", flags).withColumn("what_to_do", todo)
            .withColumn("matched_pattern", F.when(F.col("__name").isNotNull(), F.col("pattern_id"))).drop("pattern_id", "__name", "__flags", "__todo", "reasons"))


def sanitize(c: Column, most: int = 1_200) -> Column:
    """Links, codes and numbers masked, then cut to a length."""
    return cap_length(mask_text(c), most)


def sanitize_list(c: Column, items: int = 6, most: int = 200) -> Column:
    return F.transform(F.slice(c, 1, items), lambda x: sanitize(x, most))


def finalize(replies: DataFrame, settled: DataFrame, key: str = "pos") -> DataFrame:
    """Replies with the settled verdict, risk and pattern in place of their own, and sanitised texts.

    Rows without a reply come out with null texts; a reply can change no verdict.
    """
    own = settled.select(key, "verdict", "risk_level", "matched_pattern")
    r = replies.select(key, sanitize(F.col("explanation")).alias("explanation"), sanitize_list(F.col("red_flags")).alias("red_flags"), sanitize_list(F.col("what_to_do")).alias("what_to_do"))
    return own.join(r, key, "left")


def readiness(components: DataFrame) -> DataFrame:
    """(status): ok, degraded or unavailable from (component, ready); a null or missing one is not ready."""
    ready = {c: F.coalesce(F.bool_or((F.col("component") == c) & F.coalesce("ready", F.lit(False))), F.lit(False)) for c in ("classifier", "rag", "ocr")}
    return components.agg(*(v.alias(k) for k, v in ready.items())).select(
        F.when(~F.col("classifier"), "unavailable").when(~(F.col("rag") & F.col("ocr")), "degraded").otherwise("ok").alias("status"))
