"""Ranks and running sums over groups of any size: buckets are summed first, only inside a bucket rows are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, null equal to null; the right keys go."""
    r = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return left.join(r, on, "left").drop(*[f"__r_{k}" for k in keys])


def ranked(df: DataFrame, by: list[str], order: Column, out: str = "__rank", digits: int = 2) -> DataFrame:
    """Adds the place (from 1) of a row in its group by an order of hexadecimal hashes, such as ``hash_order``.

    The first ``digits`` of the hash make 16**digits buckets of about equal size per group.
    """
    d = df.withColumn("__o", order).withColumn("__b", F.substring("__o", 1, digits))
    sums = d.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)) if by else F.sum("__n").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__base", F.coalesce(before, F.lit(0))).drop("__n")
    inner = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__o"))
    return join_null_safe(d.withColumn("__in", inner), sums, [*by, "__b"]).withColumn(out, F.col("__base") + F.col("__in")).drop("__o", "__b", "__base", "__in")


def score_bucket(score: Column, half: int = 8192) -> Column:
    """A bucket that rises with the score, one of 2 * ``half`` for any range of scores."""
    return F.floor(score / (1 + F.abs(score)) * half)
