"""The whole preprocessing job, from raw rows to audited splits."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F

from ..functions import text as tx
from ..operators import dedup, similarity, splits
from ..session import materialize, release
from ..sources.sinks import PROCESSED


def run_preprocessing(rows: DataFrame, holdout: DataFrame | None = None, threshold: float = 0.9, key: str = "pos", seed: str = "42") -> tuple[DataFrame, DataFrame]:
    """(splits, report): cleaned and masked, exact and near duplicates removed, the holdout kept out, split, trimmed.

    ``rows`` has the message columns with the input in ``text_raw``. ``holdout`` (key, text) is for evaluation only: nothing
    like it enters a split; its keys must differ from those of ``rows``. ``report`` is (step, rows). Every stage is a written table, so a lost executor
    costs a stage.
    """
    clean = rows.withColumn("__c", tx.clean_text(F.col("text_raw")))
    clean = clean.withColumn("text", tx.mask_text(F.col("__c"))).withColumn("urls", tx.extract_urls(F.col("__c"))).drop("__c", "split")
    clean = materialize(clean.where("trim(text) <> ''").withColumn("id", tx.make_id(F.col("text"))), "cleaned")
    steps = [("input", rows), ("cleaned", clean)]
    exact = materialize(dedup.deduplicate(clean).drop("dedup_key"), "exact")
    near = materialize(similarity.remove_near_duplicates(exact, materialize(similarity.similar_pairs(exact, key, "text", threshold), "pairs"), key), "near")
    steps += [("exact", exact), ("near", near)]
    kept = near
    if holdout is not None:
        seen = similarity.cross_near_duplicates(near, holdout, key, "text", threshold).where("flagged").select(key)
        kept = materialize(near.join(seen, key, "left_anti"), "kept")
    steps.append(("holdout", kept))
    parts = splits.stratified_split(splits.strata(kept), seed, key).drop("stratum")
    trimmed, _ = similarity.trim_cross_split(parts, key, "text", "split", threshold)
    steps.append(("trimmed", trimmed))
    report = None
    for name, part in steps:
        row = part.agg(F.count("*").alias("rows")).select(F.lit(name).alias("step"), "rows")
        report = row if report is None else report.unionByName(row)
    report = materialize(report, "report")
    release(clean, exact, near)
    return trimmed, report


def write_result(parts: DataFrame, report: DataFrame, path: str) -> None:
    """Splits in fixed column order, and the report (rows per step, split, label and source) as JSON lines."""
    parts.select(*PROCESSED, "split").write.mode("overwrite").partitionBy("split").parquet(f"{path}/splits")
    by = parts.groupBy("split", "label", "source").agg(F.count("*").alias("rows"), F.count_if("is_synthetic").alias("synthetic"))
    report.select(F.lit("step").alias("kind"), F.to_json(F.struct("step", "rows")).alias("value")).unionByName(
        by.select(F.lit("split").alias("kind"), F.to_json(F.struct(*by.columns)).alias("value"))).write.mode("overwrite").json(f"{path}/report")


def read_report(spark, path: str) -> list[dict]:
    """The report's entries; as many as steps, splits, labels and sources."""
    return [json.loads(r[0]) for r in spark.read.json(f"{path}/report").select("value").collect()]
