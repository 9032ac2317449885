"""The pN_ queries: each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import table
from . import bitslice, encoding, history, languages, mailparts, mixing, packing, pii, residue, winnow


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.near_duplicate_pairs(table(spark, sf_dir, "combined"))


def p1_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitslice.near_duplicate_classes(table(spark, sf_dir, "combined"))


def p2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.label_languages(table(spark, sf_dir, "combined"), table(spark, sf_dir, "lang_tags"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_cases(p2_labels(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding.damaged_rows(table(spark, sf_dir, "combined"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = winnow.split_overlaps(table(spark, sf_dir, "combined"))
    return pairs.select(F.least("a", "b").alias("pos_a"), F.greatest("a", "b").alias("pos_b"))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "combined")
    return winnow.overlap_report(df.where("split <> 'train'"), winnow.split_overlaps(df))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "combined")).select("pos", "pii_kind", "pii_key")


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact_messages(table(spark, sf_dir, "combined"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.seen_before(table(spark, sf_dir, "combined")).select("pos")


def p6_new_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, ingests = table(spark, sf_dir, "combined"), table(spark, sf_dir, "ingests")
    # One row per ingest: a list that fits the driver by its nature.
    new = sorted(r[0] for r in ingests.where("state = 'new'").select("ingest_no").collect())
    return history.check_new_batches(df, ingests.where("state = 'accepted'"), new)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mailparts.reduce_mails(table(spark, sf_dir, "combined")).where(F.size("parts") > 0).select("pos", "new_words")


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "container_specs"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p8_pack(spark, sf_dir), table(spark, sf_dir, "container_specs"))


#: Limits of the packing for instruction data: few segments, and loss on no more than seven tenths of a container.
SEGMENTS, LOSS_SHARE = 6, 0.7


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same documents under limits of which each closes containers: segments and loss-bearing tokens beside tokens."""
    specs = table(spark, sf_dir, "container_specs")
    packed = packing.pack_documents(table(spark, sf_dir, "documents"), specs, max_segments=SEGMENTS, max_loss_share=LOSS_SHARE)
    return packing.limits_report(packed, specs, SEGMENTS, LOSS_SHARE)


def p9_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plans"))[0]


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_plans"))[1]


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.find_residue(table(spark, sf_dir, "documents")).where("residue").select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_classes": p1_classes,
    "p2_found": p2_found,
    "p2_labels": p2_labels,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_new_batches": p6_new_batches,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p8_fill": p8_fill,
    "p8_limits": p8_limits,
    "p9_draw": p9_draw,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
}
