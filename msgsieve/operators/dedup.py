"""Exact deduplication with conflict removal, validation, unions and other row operators on message tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..functions.text import dedup_key, make_id

MESSAGE_SCHEMA = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("label", T.StringType()), T.StructField("scam_type", T.StringType()), T.StructField("language", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("is_synthetic", T.BooleanType()), T.StructField("generator", T.StringType()), T.StructField("subtype", T.StringType()),
])
# The domains of the message table.
LABELS = ["scam", "safe"]
SUBTYPES = ["unspecified", "fraud", "promo", "service"]


def make_messages(df: DataFrame, source: str, is_synthetic: bool = False, language: str = "en", generator: str | None = None, subtype: str = "unspecified", scam_type: str = "unknown") -> DataFrame:
    """Text and label to the full message schema; safe rows have the type ``none``."""
    return df.select(
        "text", "label", F.when(F.col("label") == "scam", F.lit(scam_type)).otherwise(F.lit("none")).alias("scam_type"), F.lit(language).alias("language"), F.lit(source).alias("source"),
        F.lit(is_synthetic).alias("is_synthetic"), F.lit(generator).cast("string").alias("generator"), F.lit(subtype).alias("subtype"))


def empty_messages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], MESSAGE_SCHEMA)


def violations(df: DataFrame, key: str = "pos", labels=tuple(LABELS), subtypes=tuple(SUBTYPES)) -> DataFrame:
    """(rule, rows, first_key): one row per broken rule, in one pass over the table."""
    blank = F.col("text").isNull() | (F.trim("text") == "")
    rules = {
        "blank_text": blank, "unknown_label": F.col("label").isNull() | ~F.col("label").isin(*labels), "unknown_subtype": F.col("subtype").isNull() | ~F.col("subtype").isin(*subtypes),
        "null_source": F.col("source").isNull(), "null_language": F.col("language").isNull(),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return df.select(F.col(key).alias("k"), each.alias("rule")).groupBy("rule").agg(F.count("*").alias("rows"), F.min("k").alias("first_key"))


def require_valid(df: DataFrame, name: str, key: str = "pos") -> DataFrame:
    """``df`` itself, or an error that names the broken rules."""
    bad = violations(df, key).collect()
    if bad:
        raise ValueError(f"{name}: " + ", ".join(f"{r['rule']} ({r['rows']})" for r in bad))
    return df


def length_filter(df: DataFrame, max_chars: int = 10_000) -> DataFrame:
    """NUL removed and trimmed; blank texts and texts above ``max_chars`` dropped."""
    t = F.regexp_replace(F.translate("text", "\x00", ""), r"(?U)^\s+|\s+$", "")
    return df.withColumn("text", t).where((F.col("text") != "") & (F.length("text") <= max_chars))


def mark_duplicates(df: DataFrame, order: list[Column] | None = None, key: Column | None = None) -> DataFrame:
    """Adds dedup_key, conflict (its copies carry several labels) and copy_no (1 for the copy that stays).

    The kept copy is the first real row, then the first row at all, in the order of ``pos``.
    """
    order = order or [F.col("is_synthetic"), F.col("pos")]
    df = df.withColumn("dedup_key", key if key is not None else dedup_key(F.col("text")))
    w = Window.partitionBy("dedup_key")
    df = df.withColumn("conflict", F.min("label").over(w) != F.max("label").over(w))
    return df.withColumn("copy_no", F.row_number().over(w.orderBy(*order)))


def deduplicate(df: DataFrame, **kw) -> DataFrame:
    """One row per text; texts with two labels go altogether."""
    return mark_duplicates(df, **kw).where(~F.col("conflict") & (F.col("copy_no") == 1)).drop("conflict", "copy_no")


def dedup_report(df: DataFrame, **kw) -> DataFrame:
    """(source, loaded, conflict_rows, duplicates_removed, kept) per source."""
    m = mark_duplicates(df, **kw)
    dup = ~F.col("conflict") & (F.col("copy_no") > 1)
    return m.groupBy("source").agg(
        F.count("*").alias("loaded"), F.count_if("conflict").alias("conflict_rows"), F.count_if(dup).alias("duplicates_removed"), F.count_if(~F.col("conflict") & (F.col("copy_no") == 1)).alias("kept"))


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All frames in priority order, with source_priority."""
    out = None
    for i, (_, f) in enumerate(frames.items()):
        f = f.withColumn("source_priority", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def integrity(df: DataFrame, split: str = "split") -> DataFrame:
    """(check, rows): synthetic rows in test, and ids and keys that two splits share; all should be 0."""
    d = df.where(F.col(split).isNotNull()).select(F.col(split).alias("split"), "is_synthetic", make_id(F.col("text")).alias("id"), dedup_key(F.col("text")).alias("k"))
    synth = d.agg(F.count_if((F.col("split") == "test") & F.col("is_synthetic")).alias("rows")).select(F.lit("synthetic_in_test").alias("check"), "rows")
    out = synth
    for name, col in (("shared_ids", "id"), ("shared_keys", "k")):
        several = d.groupBy(col).agg((F.min("split") != F.max("split")).alias("both")).agg(F.count_if("both").alias("rows"))
        out = out.unionByName(several.select(F.lit(name).alias("check"), "rows"))
    return out
