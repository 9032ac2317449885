"""Readers with explicit schemas; unknown labels and blank texts are skipped, never guessed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.text import repair_latin1
from ..functions.urls import normalized
from ..session import path_exists

BATCH_SCHEMA = "key string, label string, topic string, scam_type string, language string, batch_no long, provider string, model string, created_at string, messages array<string>"
KB_ENTRY = "id string, name string, category string, how_it_works string, typical_phrases array<string>, red_flags array<string>, what_to_do string, languages array<string>, source_notes string"


def read_label_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of ``ham|spam <TAB> text`` lines; only the first tab splits, quotes are text."""
    p = F.split("value", "\t", 2)
    raw = spark.read.text(path).select(F.lower(F.trim(p[0])).alias("l"), F.trim(p[1]).alias("text"))
    return raw.where(F.col("l").isin("ham", "spam") & (F.col("text") != "")).select("text", F.when(F.col("l") == "spam", "scam").otherwise("safe").alias("label"))


def read_label_json(spark: SparkSession, path: str) -> DataFrame:
    """(text, label) of a JSON array of ``{text, label: 0 or 1}``."""
    raw = spark.read.schema("text string, label string").json(path, multiLine=True)
    n = F.expr("try_cast(label as double)")
    lab = F.when((n == 1) | (F.col("label") == "true"), "scam").when((n == 0) | (F.col("label") == "false"), "safe")
    return raw.select("text", lab.alias("label")).where(F.col("label").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def read_label_csv(spark: SparkSession, path: str, text: str, label: str, labels: dict[str, str], repair: bool = False, subtype: Callable[[Column], Column] | None = None) -> DataFrame:
    """(text, label[, subtype]) of two columns of a CSV; ``labels`` maps the file's labels."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False).select(F.col(f"`{text}`").alias("text"), F.trim(F.col(f"`{label}`")).alias("raw"))
    lab = F.coalesce(*[F.when(F.col("raw") == k, F.lit(v)) for k, v in labels.items()])
    t = repair_latin1(F.col("text")) if repair else F.col("text")
    out = raw.select(t.alias("text"), lab.alias("label")).where(F.col("label").isNotNull() & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    return out.withColumn("subtype", subtype(F.col("text"))) if subtype else out


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The append log of generated batches; damaged lines are left out."""
    return spark.read.schema(BATCH_SCHEMA).json(path, mode="DROPMALFORMED").where("key is not null")


def damaged_lines(spark: SparkSession, path: str) -> int:
    raw = spark.read.schema(BATCH_SCHEMA + ", _corrupt_record string").json(path, mode="PERMISSIVE").cache()
    try:
        return raw.where("_corrupt_record is not null").count()
    finally:
        raw.unpersist()


def read_strings_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, empty ones as ``""``, with or without a byte-order mark."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    return raw.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in raw.columns])


def read_review_csv(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet; a row of generic column names that a spreadsheet put on top is skipped."""
    raw = read_strings_csv(spark, path)
    if raw.columns and raw.columns[0] == "Column1":
        names = [str(v) for v in raw.first()]
        raw = raw.where(F.col(raw.columns[0]) != names[0]).toDF(*names)
    return raw


def read_blocklist_csv(spark: SparkSession, path: str) -> DataFrame:
    """(url, normalized) of a CSV with a column ``url``; a missing file is an empty list."""
    raw = spark.read.csv(path, header=True, inferSchema=False).select("url") if path_exists(spark, path) else spark.createDataFrame([], "url string")
    return raw.where("url is not null").select("url", normalized(F.col("url")).alias("normalized"))


def read_blocklist_text(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path) if path_exists(spark, path) else spark.createDataFrame([], "value string")
    return raw.select(F.trim("value").alias("url")).where("url <> ''").select("url", normalized(F.col("url")).alias("normalized"))


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(f"schema_version int, entries array<struct<{', '.join(f.replace(' ', ':', 1) for f in KB_ENTRY.split(', '))}>>").json(path, multiLine=True)
    return raw.select(F.explode("entries").alias("e")).select("e.*")


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    schema = "entries array<struct<text:string,language:string,label:string,expected_pattern_id:string,origin:string,source:string,notes:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("entries").alias("e")).select("e.*")
    return rows.withColumn("valid", F.col("text").isNotNull() & F.col("expected_pattern_id").isNotNull() & F.col("origin").isin("written", "real"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, format, expected, content) of the images of a folder; the format is read from the first bytes."""
    raw = spark.read.format("binaryFile").load(folder).where(F.lower("path").rlike(r"\.(png|jpe?g|webp)$"))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    h = F.hex(F.substring("content", 1, 12))
    kind = F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("FFD8FF"), "jpeg").when(h.startswith("52494646") & h.endswith("57454250"), "webp")
    expected = F.when(name.startswith("scam"), "scam").when(name.startswith("safe"), "safe")
    return raw.select("path", "length", kind.alias("format"), expected.alias("expected"), "content")


def verify_artifacts(spark: SparkSession, folder: str, locks: DataFrame) -> DataFrame:
    """(name, expected, found, ok) of files whose SHA-256 is pinned in ``locks`` (name, sha256)."""
    files = spark.read.format("binaryFile").load(folder).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    j = locks.join(files, "name", "left")
    return j.select("name", F.col("sha256").alias("expected"), "found", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("ok"))


def read_synthetic(spark: SparkSession, path: str) -> DataFrame:
    """Generated messages by what the path names: an audited Parquet table as it is, else a log of batches."""
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_batches(spark, path)
