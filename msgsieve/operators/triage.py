"""Which labels to review, validation of annotated rows, and the evaluation-only holdout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import materialize
from . import dedup, similarity, splits

# Wording of urgency and threat.
URGENCY = (
    r"(?i)turant|jaldi|urgent|immediately|abhi|aaj hi|warna|varna|otherwise|expire|blocked|suspend|band ho|cut ho|last date|within 24|asap|penalty|disconnect"
)
# What an annotation may hold.
SCAM_TYPES = ("fake_kyc", "lottery", "courier_customs", "job_offer", "electricity_bill", "loan_offer", "fake_bank_otp")
CHANNELS = ("sms", "whatsapp", "email")
LANGUAGES = "en hi hinglish ta_en te_en bn_en mr_en gu_en kn_en ml_en pa_en ta te bn mr gu kn ml pa other".split()
COLUMNS = ("text", "label", "scam_type", "language", "channel", "collected_from", "notes")


def rule_flag(text: Column, label: Column) -> Column:
    """A safe message that joins urgency with a link or a phone number, masked or not. Null is no flag."""
    return F.coalesce((label == "safe") & text.rlike(URGENCY) & tx.mask_text(text).rlike("<URL>|<PHONE>"), F.lit(False))


def latest_judgements(judgements: DataFrame, key: str = "row_id", order: str = "seq") -> DataFrame:
    """(key, judge): the last verdict of every row."""
    return judgements.groupBy(key).agg(F.max_by("verdict", order).alias("judge"))


def build_triage(rows: DataFrame, judgements: DataFrame, scores: DataFrame, control: int, seed: str = "control", key: str = "row_id") -> DataFrame:
    """Rows to review with judge, oof and reasons (oof, rule, judge, or control).

    ``scores`` (key, oof) are out-of-fold margins, positive for scam; ``judgements`` (key, judge) the last verdicts. A row is flagged where
    the margin or the judge contradicts its label, the judge is unsure, or the rule fires; ``control`` rows of the rest come with them.
    """
    j = rows.join(scores.select(key, "oof"), key, "left").join(judgements.select(key, "judge"), key, "left").withColumn("judge", F.coalesce("judge", F.lit("unjudged")))
    scam = F.col("label") == "scam"
    tests = {
        "oof": (scam & (F.col("oof") < 0)) | (~scam & (F.col("oof") > 0)),
        "rule": rule_flag(F.col("text"), F.col("label")),
        "judge": (F.col("judge") == "unsure") | (scam & (F.col("judge") == "safe")) | (~scam & (F.col("judge") == "scam")),
    }
    j = j.withColumn("reasons", F.array_join(F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()])), ","))
    j = materialize(j, "triage")
    # A top-k by hash: every partition keeps its own before they meet.
    rest = j.where("reasons = ''").orderBy(splits.hash_order(seed, key), key).limit(control).withColumn("reasons", F.lit("control"))
    return j.where("reasons <> ''").unionByName(rest)


def with_lines(df: DataFrame, file: str | None = None) -> DataFrame:
    """Adds line: the place of a row in its file, the header being line 1.

    Rows are numbered per partition of the scan and the partitions' counts are added up, so no task sees all rows.
    """
    d = materialize(df.withColumn("__id", F.monotonically_increasing_id()), "lines")
    part = F.shiftright("__id", 33)
    from pyspark.sql import Window

    counts = d.groupBy(part.alias("__part")).agg(F.count("*").alias("__c"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    d = d.withColumn("__part", part).join(before, "__part")
    return d.withColumn("line", (F.col("__id") - F.shiftleft("__part", 33) + F.col("__before") + 2).cast("long")).drop("__id", "__part", "__before")


def annotation_problems(rows: DataFrame, allowed: tuple[str, ...] = (), low: int = 5, high: int = 2_000) -> DataFrame:
    """(line, severity, problem): what blocks a row of annotations, and hints on its language.

    ``rows`` has COLUMNS as text and line. Example rows and blank rows are passed over; an empty text is its only problem.
    """
    d = rows.select("line", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS])
    d = d.where((F.lower("collected_from") != "example") & (F.concat(*COLUMNS) != ""))
    t, label, kind, lang, channel = F.col("text"), F.lower("label"), F.lower("scam_type"), F.lower("language"), F.lower("channel")
    pii = F.array_except(tx.pii_kinds(t), F.array(*map(F.lit, allowed)).cast("array<string>"))
    tests = [
        (F.length(t) < low, "text too short"), (F.length(t) > high, "text too long"), (~label.isin("scam", "safe"), "unknown label"),
        ((label == "scam") & ~kind.isin(*SCAM_TYPES, "other"), "unknown scam_type"), ((label == "safe") & ~kind.isin("", "none"), "scam_type of a safe row"),
        (~channel.isin(*CHANNELS), "unknown channel"), (~lang.isin(*LANGUAGES), "unknown language"), (F.size(pii) > 0, "personal information"),
    ]
    errors = F.when(t == "", F.array(F.lit("empty text"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in tests])))
    tag = tx.detect_language(t)
    hint = F.when((lang == "hinglish") & (tag == "hi"), "hinglish but Devanagari").when((lang == "hi") & (tag != "hi"), "hi but not Devanagari").when((lang == "en") & (tag == "hinglish_guess"), "en but Hindi in Latin letters")
    both = F.concat(F.transform(errors, lambda p: F.struct(F.lit("error").alias("severity"), p.alias("problem"))),
                    F.when(hint.isNotNull() & (t != ""), F.array(F.struct(F.lit("warning").alias("severity"), hint.alias("problem")))).otherwise(F.expr("cast(array() as array<struct<severity:string,problem:string>>)")))
    return d.select("line", F.explode(both).alias("p")).select("line", "p.severity", "p.problem")


def valid_annotations(rows: DataFrame, problems: DataFrame) -> DataFrame:
    """The rows without an error, values folded; other becomes unknown, safe rows have the type none."""
    bad = problems.where("severity = 'error'").select("line").distinct()
    d = rows.select("line", *[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in COLUMNS])
    d = d.where((F.lower("collected_from") != "example") & (F.concat(*COLUMNS) != "")).join(bad, "line", "left_anti")
    label, kind = F.lower("label"), F.lower("scam_type")
    return d.select("line", "text", label.alias("label"), F.when(label == "safe", "none").when(kind == "other", "unknown").otherwise(kind).alias("scam_type"),
                    F.lower("language").alias("language"), F.lower("channel").alias("channel"), "collected_from", "notes")


def build_holdout(rows: DataFrame, reference: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Valid annotations, masked, without copies of themselves or of ``reference`` (pos, text), raw texts dropped."""
    good = valid_annotations(rows, annotation_problems(rows))
    lines = good.withColumn("pos", -F.col("line")).withColumn("text", tx.preprocess_text(F.col("text"))).withColumn("is_synthetic", F.lit(False))
    lines = materialize(dedup.deduplicate(lines.where("trim(text) <> ''")), "holdout")
    near = materialize(similarity.remove_near_duplicates(lines, similarity.similar_pairs(lines, "pos", "text", threshold), "pos"), "holdout")
    seen = similarity.cross_near_duplicates(near, reference, "pos", "text", threshold).where("flagged").select("pos")
    return near.join(seen, "pos", "left_anti").withColumn("id", tx.make_id(F.col("text"))).drop("dedup_key", "pos", "is_synthetic")


def save_decisions(df: DataFrame, path: str) -> None:
    df.select("row_id", "action", "reason").write.mode("overwrite").csv(path, header=True, quoteAll=True)


def load_decisions(spark, path: str) -> DataFrame:
    """All columns as text, nulls as empty texts."""
    return spark.read.csv(path, header=True, schema="row_id string, action string, reason string", multiLine=True, escape='"').na.fill("")
