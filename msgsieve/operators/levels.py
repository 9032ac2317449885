"""Levels of a training set: audited labels, more rows, a policy for legitimate promotions, normalised text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..session import materialize
from . import audit, dedup, similarity, splits

LEGIT = ("promo", "service")


@dataclass(frozen=True)
class Level:
    """What a level adds; ``drop`` names the reasons of ``drop_reason`` that cost a row its place."""

    name: str
    audited: bool = False
    more: bool = False
    policy: str = "old"
    normalized: bool = False
    drop: tuple[str, ...] = ()


# The levels, each on top of the one before; L2b and L3b are the branches of policy A.
LEVELS = {v.name: v for v in (
    Level("L0"), Level("L1", True), Level("L2a", True, True, "D"), Level("L2b", True, True, "A"), Level("L3", True, True, "D", True), Level("L3b", True, True, "A", True),
    Level("L4", True, True, "D", True, ("web_crawl", "pipeline_notice")), Level("L5", True, True, "D", True, ("web_crawl", "pipeline_notice", "internal_mail")),
)}


def reference_rows(df: DataFrame, subtype: Column | None = None) -> DataFrame:
    """Rows with a split, original_label, and the subtype: fraud for synthetic scams, else ``subtype`` or the row's own."""
    own = F.coalesce(subtype if subtype is not None else F.col("subtype"), F.lit("unspecified"))
    kind = F.when(F.col("is_synthetic") & (F.col("label") == "scam"), "fraud").otherwise(own)
    return df.where("split is not null").withColumn("subtype", kind).withColumn("original_label", F.col("label"))


def apply_policy(df: DataFrame, policy: str, sources: list[str]) -> DataFrame:
    """Adds benchmark and withheld; A makes legitimate promotions of ``sources`` safe, D withholds them, old leaves them.

    Null subtypes and labels are no promotions.
    """
    if policy not in ("old", "D", "A"):
        raise ValueError(f"unknown policy {policy}")
    legit = F.coalesce(F.col("source").isin(sources) & (F.col("original_label") == "scam") & F.col("subtype").isin(*LEGIT), F.lit(False))
    out = df.withColumn("benchmark", legit).withColumn("withheld", F.col("benchmark") & F.lit(policy == "D"))
    if policy == "A":
        out = out.withColumn("label", F.when(F.col("benchmark"), "safe").otherwise(F.col("label")))
        out = out.withColumn("scam_type", F.when(F.col("benchmark"), "none").otherwise(F.col("scam_type")))
    return out


def training_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("withheld"))


def selection_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("is_synthetic") & ~F.col("withheld"))


def describe(df: DataFrame) -> DataFrame:
    """(split, field, value, rows): rows by label and source, withheld and benchmark rows of every split."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in (
        ("rows", F.lit("all")), ("label", F.col("label")), ("source", F.col("source")), ("withheld", F.col("withheld")), ("benchmark", F.col("benchmark")))])
    return df.select("split", F.explode(pairs).alias("p")).groupBy("split", "p.field", "p.value").agg(F.count("*").alias("rows"))


def assign_splits(df: DataFrame, seed: str = "42", key: str = "pos") -> DataFrame:
    """Train, val and test of exact sizes, stratified by label and subtype; small strata are merged."""
    plain = df.withColumn("__source", F.col("source")).withColumn("source", F.col("subtype"))
    s = splits.stratified_split(splits.strata(plain), seed, key, real_only_test=False)
    return s.withColumn("source", F.col("__source")).drop("__source", "stratum")


def new_source(raw: DataFrame, reference: DataFrame, key: str = "pos", threshold: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(rows, counts): a further source cleaned, deduplicated in itself and against the reference, split.

    ``raw`` has the columns of the message table, its text in ``text_raw``, and keys that the reference does not use.
    """
    clean = raw.withColumn("text", tx.preprocess_text(F.col("text_raw"))).withColumn("id", tx.make_id(F.col("text"))).where("trim(text) <> ''")
    clean = materialize(clean, "cleaned")
    exact = materialize(dedup.deduplicate(clean), "exact")
    near = materialize(similarity.remove_near_duplicates(exact, similarity.similar_pairs(exact, key, "text", threshold, similarity.NEAR_CHARS), key), "near")
    seen = similarity.cross_near_duplicates(near, reference, key, "text", threshold, chars=similarity.NEAR_CHARS).where("flagged").select(key)
    kept = materialize(assign_splits(near.join(seen, key, "left_anti").drop("split").withColumn("original_label", F.col("label")), key=key), "kept")
    counts = None
    for step, part in (("cleaned", clean), ("exact", exact), ("near", near), ("kept", kept)):
        row = part.agg(F.count("*").alias("rows")).select(F.lit(step).alias("step"), "rows")
        counts = row if counts is None else counts.unionByName(row)
    return kept, counts


def renormalize(df: DataFrame, drop: tuple[str, ...] = (), key: str = "pos", threshold: float = 0.9) -> DataFrame:
    """The text made anew from ``text_raw``, normalised, masked, deduplicated inside every split and trimmed across them."""
    reason = tx.drop_reason(F.col("text_raw"), *(d in drop for d in ("web_crawl", "pipeline_notice", "internal_mail")))
    kept = df.where(reason.isNull()) if drop else df
    norm = tx.clean_text(tx.normalize_text(F.col("text_raw")))
    kept = kept.withColumn("__n", norm).withColumn("text", tx.mask_text(F.col("__n"))).withColumn("urls", tx.extract_urls(F.col("__n"))).drop("__n")
    kept = kept.withColumn("id", tx.make_id(F.col("text"))).where("trim(text) <> ''")
    # One pass over all splits: the split is part of the key, so nothing is compared across them.
    within = F.concat_ws("|", "split", tx.dedup_key(F.col("text")))
    exact = materialize(dedup.deduplicate(kept, key=within), "exact")
    pairs = similarity.similar_pairs(exact, key, "text", threshold)
    side = exact.select(F.col(key), F.col("split"))
    same = pairs.join(side.select(F.col(key).alias("i"), F.col("split").alias("si")), "i").join(side.select(F.col(key).alias("j"), F.col("split").alias("sj")), "j").where("si = sj")
    near = materialize(similarity.remove_near_duplicates(exact, materialize(same.select("i", "j", "sim"), "pairs"), key), "near")
    return similarity.trim_cross_split(near, key, "text", "split", threshold)[0]


def build_level(level: Level | str, reference: DataFrame, more: DataFrame | None, decisions: DataFrame, sources: list[str]) -> DataFrame:
    """All rows of a level with split, benchmark and withheld."""
    level = LEVELS[level] if isinstance(level, str) else level
    df = reference
    if level.audited:
        before = df.withColumn("__label", F.col("original_label"))
        df = audit.apply_decisions(before, decisions).withColumn("original_label", F.col("__label")).drop("__label", "row_id")
        flipped = F.col("action") == "flip"
        df = df.withColumn("subtype", F.when(flipped & (F.col("label") == "scam"), "fraud").when(flipped, "unspecified").otherwise(F.col("subtype"))).drop("action")
    if level.more:
        if more is None:
            raise ValueError("the level needs further rows")
        df = df.unionByName(more, allowMissingColumns=True)
    df = apply_policy(df, level.policy, sources)
    return renormalize(df, level.drop) if level.normalized else df


def choose_level(results: DataFrame) -> DataFrame:
    """(chosen, criterion_met): the first level on the path that passes, else the fewest fingerprints, then the higher signal share, then the earlier.

    ``results`` has place, level, passed, fingerprints and signal_share; no rows give no choice.
    """
    best = F.min_by("level", F.struct((~F.col("passed")).cast("int"), F.when(F.col("passed"), F.col("place")).otherwise(F.col("fingerprints")),
                                      F.when(F.col("passed"), 0.0).otherwise(-F.col("signal_share")), "place"))
    return results.agg(best.alias("chosen"), F.coalesce(F.bool_or("passed"), F.lit(False)).alias("criterion_met"), F.count("*").alias("n")).where("n > 0").drop("n")
