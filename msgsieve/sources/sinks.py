"""Writers: fixed column orders, packs without raw text, keyed upserts, log lines of allowed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PROCESSED = ["id", "text", "label", "scam_type", "language", "source", "is_synthetic", "generator", "subtype", "urls", "text_raw"]
# The fields a training pack may hold, and those it never does.
PACK, FORBIDDEN = ["id", "text", "label", "source", "language", "is_synthetic", "subtype", "split", "raw_chars"], {"text_raw", "urls"}
LOG_FIELDS = ["event_id", "ts", "event_type", "value"]


def write_splits(df: DataFrame, path: str, columns: list[str] = PROCESSED) -> None:
    """Parquet by split, columns in fixed order."""
    df.where("split is not null").select(*columns, "split").write.mode("overwrite").partitionBy("split").parquet(path)


def write_level(df: DataFrame, path: str, level: str) -> None:
    """Kept and withheld rows of a level, apart."""
    df.withColumn("level", F.lit(level)).write.mode("overwrite").partitionBy("level", "split", "withheld").parquet(path)


def pack(df: DataFrame) -> DataFrame:
    """The whitelisted columns, with defaults, and the raw length in place of the raw text."""
    have = set(df.columns)
    raw = F.length("text_raw") if "text_raw" in have else F.length("text")
    cols = [raw.cast("long").alias("raw_chars") if c == "raw_chars" else (F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in PACK]
    return df.select(*cols)


def pack_problems(p: DataFrame) -> DataFrame:
    """(problem, rows): forbidden columns, unknown labels, blank texts, texts in two splits."""
    spark = p.sparkSession
    bad = [(c, 1) for c in p.columns if c in FORBIDDEN]
    out = spark.createDataFrame(bad, "problem string, rows long")
    one = p.agg(F.count_if(~F.col("label").isin("scam", "safe")).alias("unknown_label"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank_text"))
    out = out.unionByName(one.select(F.expr("stack(2, 'unknown_label', unknown_label, 'blank_text', blank_text) as (problem, rows)")))
    both = p.where("split is not null").groupBy("text").agg((F.min("split") != F.max("split")).alias("b")).agg(F.count_if("b").alias("rows"))
    return out.unionByName(both.select(F.lit("text_in_two_splits").alias("problem"), "rows"))


def upsert(current: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """``current`` with the batch's rows put in; the latest row of a key stays, the batch's on ties."""
    u = current.withColumn("__p", F.lit(0)).unionByName(batch.withColumn("__p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__p"))
    return u.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__p", "__r")


def log_lines(df: DataFrame, fields: list[str] = LOG_FIELDS) -> DataFrame:
    """JSON lines of the allowed fields only."""
    return df.select(F.to_json(F.struct(*fields)).alias("line"))


def write_release(df: DataFrame, path: str) -> None:
    """One CSV file for publication."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)
