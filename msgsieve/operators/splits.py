"""Strata, exact-size splits, folds, samples and orders that are random but repeatable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import ranked


def hash_order(seed: str, key: str = "pos") -> Column:
    """A repeatable random order that any SQL engine can follow."""
    return F.md5(F.concat(F.lit(seed), F.lit(":"), F.col(key).cast("string")))


def strata(df: DataFrame, least: int = 10) -> DataFrame:
    """Adds stratum: label and source; small ones become ``label|other``, then the label's largest, then the label."""
    first = F.concat_ws("|", "label", "source")
    c = df.withColumn("__s", first).withColumn("__n", F.count("*").over(Window.partitionBy("__s")))
    c = c.withColumn("__s", F.when(F.col("__n") < least, F.concat_ws("|", "label", F.lit("other"))).otherwise(F.col("__s")))
    sizes = c.groupBy("label", "__s").agg(F.count("*").alias("__n"))
    top = sizes.where(~F.col("__s").endswith("|other")).groupBy("label").agg(F.max_by("__s", F.struct("__n", "__s")).alias("__top"))
    c = c.drop("__n").join(F.broadcast(sizes), ["label", "__s"]).join(F.broadcast(top), "label", "left")
    merged = F.when(F.col("__n") < 2, F.coalesce("__top", F.col("label"))).otherwise(F.col("__s"))
    return c.withColumn("stratum", merged).drop("__s", "__n", "__top")


def stratified_split(df: DataFrame, seed: str = "42", key: str = "pos", val: float = 0.15, test: float = 0.15, by: str = "stratum", real_only_test: bool = True) -> DataFrame:
    """Adds split with exact sizes: round-half-even of the share of all rows, spread over strata by largest remainder.

    Test rows are taken from real rows only if ``real_only_test``.
    """
    per = df.groupBy(by).agg(F.count("*").alias("n"), F.count_if(~F.col("is_synthetic")).alias("real"))
    all_rows = per.agg(F.sum("n").alias("all"), F.sum("real").alias("all_real"))
    base = per.crossJoin(F.broadcast(all_rows))
    pool = F.col("real") if real_only_test else F.col("n")
    pool_all = F.col("all_real") if real_only_test else F.col("all")
    for name, share in (("test", test), ("val", val)):
        want = F.bround(F.lit(share) * F.col("all")).cast("long")
        ideal = want * (pool if name == "test" else F.col("n")) / (pool_all if name == "test" else F.col("all"))
        base = base.withColumn(f"{name}_floor", F.floor(ideal)).withColumn(f"{name}_rest", ideal - F.floor(ideal)).withColumn(f"{name}_want", want)
        short = F.col(f"{name}_want") - F.sum(f"{name}_floor").over(Window.partitionBy())
        rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(f"{name}_rest"), by))
        base = base.withColumn(f"{name}_n", F.col(f"{name}_floor") + (rank <= short).cast("long"))
    quota = base.select(by, "test_n", "val_n")
    o = hash_order(seed, key)
    d = df.withColumn("__o", o)
    real = ~F.col("is_synthetic") if real_only_test else F.lit(True)
    d = ranked(d.withColumn("__real", real), [by, "__real"], F.col("__o"), "__r")
    d = d.join(F.broadcast(quota), by)
    d = d.withColumn("__test", F.col("__real") & (F.col("__r") <= F.col("test_n")))
    d = ranked(d, [by, "__test"], o, "__v")
    split = F.when(F.col("__test"), "test").when(F.col("__v") <= F.col("val_n"), "val").otherwise("train")
    return d.withColumn("split", split).drop("__o", "__r", "__real", "__test", "__v", "test_n", "val_n")


def folds(df: DataFrame, k: int = 5, seed: str = "folds", key: str = "pos", by: str = "label") -> DataFrame:
    """Adds fold: 0 to k-1, balanced within ``by``."""
    return ranked(df, [by], hash_order(seed, key), "__r").withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r")


def sample_per_group(df: DataFrame, n: int, by: list[str], seed: str = "sample", key: str = "pos") -> DataFrame:
    r = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(seed, key)))
    return df.withColumn("__r", r).where(F.col("__r") <= n).drop("__r")


def round_robin_sample(df: DataFrame, n: int, label: str = "label", over: str = "language", seed: str = "robin", key: str = "pos") -> DataFrame:
    """``n`` rows, half per label, languages taking turns."""
    r = F.row_number().over(Window.partitionBy(label, over).orderBy(hash_order(seed, key)))
    d = df.withColumn("__turn", r)
    q = F.row_number().over(Window.partitionBy(label).orderBy("__turn", over))
    return d.withColumn("__q", q).where(F.col("__q") <= n // 2).drop("__turn", "__q")


def quota_sample(df: DataFrame, action: str, n: int, seed: str = "review", key: str = "row_id") -> DataFrame:
    """A third flips, a third removals, the rest keeps; what a group lacks is filled from the left-overs."""
    quota = F.when(F.col(action).isin("flip", "remove"), n // 3).otherwise(n - 2 * (n // 3))
    d = ranked(df, [action], hash_order(seed, key), "__r").withColumn("__first", F.col("__r") <= quota)
    # A top-n: every partition keeps its own before they meet.
    return d.orderBy(F.desc("__first"), hash_order(seed, key), key).limit(n).drop("__first", "__r")


def length_batches(df: DataFrame, length: str, batch: int, mega: int = 50, seed: str = "batches", key: str = "pos") -> DataFrame:
    """Adds batch: rows of similar length together, inside random groups of ``mega`` batches.

    The groups are hash buckets, so that no order over all rows is needed.
    """
    d = df.withColumn("__h", F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("double"))
    groups = d.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / (batch * mega))).alias("g"))
    d = d.crossJoin(F.broadcast(groups)).withColumn("__g", F.floor(F.col("__h") / 4294967296.0 * F.col("g")))
    r = F.row_number().over(Window.partitionBy("__g").orderBy(length, key))
    return d.withColumn("batch", F.concat_ws("-", F.col("__g").cast("string"), F.floor((r - 1) / batch).cast("string"))).drop("__h", "__g", "g")
