"""Joins of decisions, judgements, predictions and feedback with their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import casefold, collapse


def row_id(c):
    return F.substring(F.sha1(F.encode(c, "UTF-8")), 1, 12)


def apply_decisions(rows: DataFrame, decisions: DataFrame, text: str = "text_raw", topics: DataFrame | None = None, known: tuple[str, ...] = ()) -> DataFrame:
    """Synthetic rows keep, flip or lose their place by decision; rows without one are marked unreviewed.

    A null decision, or one that is no known action, counts as unreviewed. A safe row that becomes scam gets the topic it was
    written about (``topics``: text_key, topic) as its type if that is one of ``known``, else unknown.
    """
    d = decisions.where(F.col("action").isin("keep", "flip", "remove")).select("row_id", "action")
    j = rows.withColumn("row_id", F.when(F.col("is_synthetic"), row_id(F.col(text)))).join(d, "row_id", "left")
    j = j.withColumn("action", F.when(F.col("is_synthetic"), F.coalesce("action", F.lit("unreviewed"))).otherwise(F.lit("real")))
    j = j.withColumn("original_label", F.col("label"))
    other = F.when(F.col("label") == "scam", "safe").otherwise("scam")
    j = j.withColumn("label", F.when(F.col("action") == "flip", other).otherwise(F.col("label")))
    if topics is not None:
        j = j.withColumn("__k", collapse(casefold(F.col(text)))).join(topics.select(F.col("text_key").alias("__k"), F.col("topic").alias("__topic")), "__k", "left")
    topic = F.when(F.col("__topic").isin(*known), F.col("__topic")) if topics is not None else F.lit(None)
    kind = F.when(F.col("action") != "flip", F.col("scam_type")).when(F.col("label") == "scam", F.coalesce(topic, F.lit("unknown"))).otherwise(F.lit("none"))
    return j.withColumn("scam_type", kind).where(F.col("action") != "remove").drop("__k", "__topic")


def merge_overrides(draft: DataFrame, overrides: DataFrame, key: str = "row_id") -> DataFrame:
    """The override's row where there is one, else the draft's; new keys are added."""
    u = draft.withColumn("__p", F.lit(1)).unionByName(overrides.withColumn("__p", F.lit(0)), allowMissingColumns=True)
    return u.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__p"))).where("__r = 1").drop("__p", "__r")


def decision_problems(decisions: DataFrame, known: DataFrame, key: str = "row_id") -> DataFrame:
    """(problem, rows): unknown actions, unknown identifiers, identifiers decided twice."""
    bad = decisions.agg(F.count_if(F.col("action").isNull() | ~F.col("action").isin("keep", "flip", "remove")).alias("rows")).select(F.lit("unknown_action").alias("problem"), "rows")
    lost = decisions.join(known.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("rows")).select(F.lit("unknown_id").alias("problem"), "rows")
    twice = decisions.groupBy(key).count().where("count > 1").agg(F.count("*").alias("rows")).select(F.lit("duplicate_id").alias("problem"), "rows")
    return bad.unionByName(lost).unionByName(twice)


def decision_summary(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """(label, keep, flip, remove, unreviewed) per original label of the synthetic rows."""
    d = decisions.select("row_id", "action")
    j = rows.where("is_synthetic").select(row_id(F.col("text_raw")).alias("row_id"), "label").join(d, "row_id", "left").withColumn("action", F.coalesce("action", F.lit("unreviewed")))
    return j.groupBy("label").pivot("action", ["keep", "flip", "remove", "unreviewed"]).count().na.fill(0)


def agreement(review: DataFrame, key_frame: DataFrame, mine: str, theirs: str, key: str = "row_id") -> DataFrame:
    j = review.join(key_frame, key)
    return j.agg(F.count("*").alias("n"), F.count_if(F.col(mine) == F.col(theirs)).alias("agree"), F.avg((F.col(mine) == F.col(theirs)).cast("double")).alias("agreement"))


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join with a count of the keys that only one side has."""
    j = left.select(key, F.lit(1).alias("__l")).join(right.select(key, F.lit(1).alias("__r")), key, "full")
    return j.agg(F.count("*").alias("keys"), F.count_if(F.col("__l").isNull()).alias("only_right"), F.count_if(F.col("__r").isNull()).alias("only_left"))


def first_topic(batches: DataFrame) -> DataFrame:
    """(text_key, topic): of the batch that held the message first."""
    m = batches.select("topic", "created_at", "batch_no", F.posexplode("messages").alias("i", "m")).where(F.trim("m") != "")
    k = m.select(collapse(casefold(F.col("m"))).alias("text_key"), "topic", "created_at", "batch_no", "i")
    return k.groupBy("text_key").agg(F.min_by("topic", F.struct("created_at", "batch_no", "i")).alias("topic"))


def load_batches(batches: DataFrame, least: int = 15, most: int = 700) -> DataFrame:
    """(batch_key, i, message, reason): every message with why it is left out, null for those that stay.

    In this order: length, then repeats (the first by time stays).
    """
    m = batches.select("batch_key", "label", "topic", "created_at", "batch_no", F.posexplode("messages").alias("i", "message"))
    n = F.length(F.trim(F.coalesce("message", F.lit(""))))
    m = m.withColumn("bad", (n < least) | (n > most)).withColumn("k", collapse(casefold(F.coalesce("message", F.lit("")))))
    r = F.row_number().over(Window.partitionBy("k", "bad").orderBy("created_at", "batch_no", "batch_key", "i"))
    return m.withColumn("reason", F.when(F.col("bad"), "length").when(r > 1, "duplicate")).select("batch_key", "i", "message", "reason")


def pending(plan: DataFrame, done: DataFrame, key: str = "batch_key") -> DataFrame:
    return plan.join(done.select(key).distinct(), key, "left_anti")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """One row per prediction: the feedback created last, by identifier where times tie."""
    w = Window.partitionBy("prediction_id").orderBy(F.desc("created_at"), F.desc("id"))
    return feedback.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def feedback_agreement(feedback: DataFrame) -> DataFrame:
    return latest_feedback(feedback).groupBy("predicted_verdict").agg(
        F.count("*").alias("rows"), F.round(F.avg((F.col("user_verdict") == F.col("predicted_verdict")).cast("double")) * 100, 1).alias("agree_pct"))


def enrich_feedback(predictions: DataFrame, feedback: DataFrame, hours: int = 24) -> DataFrame:
    """Feedback within ``hours`` of its prediction; the same condition serves two streams with watermarks."""
    p, f = predictions.alias("p"), feedback.alias("f")
    on = F.expr(f"p.user_id = f.user_id and f.ts >= p.ts and f.ts < p.ts + interval {hours} hours")
    return p.join(f, on).select(F.col("p.event_id").alias("prediction"), F.col("f.event_id").alias("feedback"), F.col("p.user_id").alias("user_id"))


def pattern_lookup(feedback: DataFrame, kb: DataFrame) -> DataFrame:
    """Rows of feedback per knowledge-base pattern, patterns without any included."""
    n = feedback.groupBy(F.col("matched_pattern").alias("id")).agg(F.count("*").alias("rows"))
    return kb.select("id", "name", "category").join(n, "id", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
