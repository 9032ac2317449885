"""Binary-classification metrics as exact window queries; undefined values are null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ranks import join_null_safe, score_bucket


def _one(by: list[str]):
    return Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))


def _buckets(s: DataFrame, by: list[str], score: str) -> tuple[DataFrame, DataFrame]:
    """Distinct scores with their bucket, and per group a table of at most 16,384 buckets with sums and the highest score."""
    s = s.withColumn("__b", score_bucket(F.col(score)))
    return s, s.groupBy(*by, "__b").agg(F.sum("p").alias("__p"), F.sum("c").alias("__c"), F.max(score).alias("__top"))


def confusion(df: DataFrame, threshold: float = 0.5, y: str = "y", score: str = "score", by: list[str] | None = None, strict: bool = False) -> DataFrame:
    """tn, fp, fn, tp, n, n_scam, precision, recall, f1; a row is flagged from the threshold on, or above it if ``strict``."""
    by = by or []
    flag = F.col(score) > threshold if strict else F.col(score) >= threshold
    pos = F.col(y) == 1
    g = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(pos).alias("n_scam"), F.count_if(pos & flag).alias("tp"), F.count_if(~pos & flag).alias("fp"), F.count_if(pos & ~flag).alias("fn"), F.count_if(~pos & ~flag).alias("tn"))
    p = F.when((F.col("n_scam") > 0) & (F.col("tp") + F.col("fp") > 0), F.col("tp") / (F.col("tp") + F.col("fp"))).when(F.col("n_scam") > 0, F.lit(0.0))
    r = F.when(F.col("n_scam") > 0, F.col("tp") / F.col("n_scam"))
    f = F.when(F.col("n_scam") > 0, 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn")))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", f)


def _counts(df: DataFrame, by: list[str], y: str, score: str, weight: str | None) -> DataFrame:
    """(by, score, p, c): positives and rows of every distinct score, weighted if a weight is named."""
    if weight is None:
        return df.groupBy(*by, score).agg(F.sum(y).alias("p"), F.count("*").alias("c"))
    return df.where(F.col(weight) > 0).groupBy(*by, score).agg(F.sum(F.col(y) * F.col(weight)).alias("p"), F.sum(weight).alias("c"))


def roc_auc(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Mann-Whitney with ties counted half, from one aggregate per distinct score."""
    by = by or []
    s = _counts(df, by, y, score, weight)
    s, small = _buckets(s, by, score)
    low = F.sum(F.col("__c") - F.col("__p")).over(_one(by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    small = small.select(*by, "__b", F.coalesce(low, F.lit(0)).alias("__base"))
    inner = F.sum(F.col("c") - F.col("p")).over(Window.partitionBy(*by, "__b").orderBy(score).rowsBetween(Window.unboundedPreceding, -1))
    s = join_null_safe(s.withColumn("__in", F.coalesce(inner, F.lit(0))), small, [*by, "__b"])
    below = F.col("__base") + F.col("__in")
    s = s.withColumn("u", F.col("p") * (below + (F.col("c") - F.col("p")) / 2))
    g = s.groupBy(*by).agg(F.sum("u").alias("u"), F.sum("p").alias("n1"), F.sum(F.col("c") - F.col("p")).alias("n0"))
    return g.select(*by, F.when((F.col("n1") > 0) & (F.col("n0") > 0), F.col("u") / (F.col("n1") * F.col("n0"))).alias("roc_auc"))


def curve(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """(score, tp, flagged, positives, precision, recall, f1, next_lower) at every distinct score."""
    by = by or []
    s = _counts(df, by, y, score, weight)
    s, small = _buckets(s, by, score)
    down = _one(by).orderBy(F.desc("__b"))
    base = down.rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*by, "__b", F.coalesce(F.sum("__p").over(base), F.lit(0)).alias("__tp"), F.coalesce(F.sum("__c").over(base), F.lit(0)).alias("__flagged"), F.sum("__p").over(_one(by)).alias("positives"), F.lead("__top").over(down).alias("__next"))
    w = Window.partitionBy(*by, "__b").orderBy(F.desc(score))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("__ip", F.sum("p").over(upto)).withColumn("__ic", F.sum("c").over(upto)).withColumn("__lead", F.lead(score).over(w))
    s = join_null_safe(s, small, [*by, "__b"])
    s = s.withColumn("tp", F.col("__tp") + F.col("__ip")).withColumn("flagged", F.col("__flagged") + F.col("__ic")).withColumn("next_lower", F.coalesce("__lead", "__next"))
    s = s.drop("__b", "__ip", "__ic", "__lead", "__tp", "__flagged", "__next")
    s = s.withColumn("precision", F.col("tp") / F.col("flagged")).withColumn("recall", F.when(F.col("positives") > 0, F.col("tp") / F.col("positives")))
    return s.withColumn("f1", F.when(F.col("positives") > 0, 2 * F.col("tp") / (F.col("flagged") + F.col("positives"))))


def average_precision(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Step sum of precision over recall."""
    by = by or []
    c = curve(df, y, score, by, weight)
    return c.groupBy(*by).agg(F.when(F.max("positives") > 0, F.sum(F.col("p") * F.col("precision")) / F.max("positives")).alias("average_precision"))


def best_f1_threshold(df: DataFrame, y: str = "y", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """(threshold, f1): highest F1, ties to the higher score, halfway to the next lower score; one class gives 0."""
    by = by or []
    c = curve(df, y, score, by)
    mid = F.coalesce((F.col(score) + F.col("next_lower")) / 2, F.col(score))
    g = c.groupBy(*by).agg(F.max_by(F.struct(mid.alias("m"), F.col("f1").alias("f")), F.struct("f1", score)).alias("b"), F.max("positives").alias("np"), F.sum("c").alias("n"))
    one = (F.col("np") == 0) | (F.col("np") == F.col("n"))
    return g.select(*by, F.when(one, 0.0).otherwise(F.col("b.m")).alias("threshold"), F.when(~one, F.col("b.f")).alias("f1"))


def recall_threshold(df: DataFrame, target: float, y: str = "y", score: str = "score") -> DataFrame:
    """(target, threshold): the highest threshold that keeps ``target`` of the positives, halfway to the next lower score."""
    c = curve(df, y, score)
    need = F.ceil(F.lit(target) * F.col("positives") - 1e-9)
    mid = F.coalesce((F.col(score) + F.col("next_lower")) / 2, F.col(score))
    return c.where(F.col("tp") >= need).agg(F.max_by(mid, F.col(score)).alias("threshold")).select(F.lit(float(target)).alias("target"), "threshold")


def operating_points(df: DataFrame, targets: list[float], y: str = "y", score: str = "score") -> DataFrame:
    """(target, threshold, precision, recall, flag_rate) per recall target."""
    c = curve(df, y, score).withColumn("all", F.sum("c").over(Window.partitionBy(F.lit(1))))
    t = F.explode(F.array(*[F.lit(float(x)) for x in targets])).alias("target")
    each = c.select("*", t).where(F.col("tp") >= F.ceil(F.col("target") * F.col("positives") - 1e-9))
    mid = F.coalesce((F.col(score) + F.col("next_lower")) / 2, F.col(score))
    best = each.groupBy("target").agg(F.max_by(F.struct(mid.alias("threshold"), "precision", "recall", (F.col("flagged") / F.col("all")).alias("flag_rate")), F.col(score)).alias("b"))
    return best.select("target", "b.threshold", "b.precision", "b.recall", "b.flag_rate")


def flag_rates(df: DataFrame, threshold: float, by: str = "source", score: str = "score", strict: bool = False) -> DataFrame:
    """(by, rows, flag_rate) per group and, with a null group, in total."""
    flag = F.col(score) > threshold if strict else F.col(score) >= threshold
    return df.rollup(by).agg(F.count("*").alias("rows"), F.avg(flag.cast("double")).alias("flag_rate"))


def group_metrics(df: DataFrame, by: str, threshold: float = 0.5, min_rows: int = 1, y: str = "y", score: str = "score") -> DataFrame:
    """All metrics per group of ``min_rows`` or more."""
    m = confusion(df, threshold, y, score, [by]).where(F.col("n") >= min_rows)
    return m.join(roc_auc(df, y, score, [by]), by).join(average_precision(df, y, score, [by]), by)


def cell_weights(df: DataFrame) -> DataFrame:
    """Adds weight: every cell of source and label counts the same, mean 1."""
    cell = F.count("*").over(Window.partitionBy("source", "label"))
    cells = df.select("source", "label").distinct().agg(F.count("*").alias("__k"))
    n = df.agg(F.count("*").alias("__n"))
    return df.crossJoin(F.broadcast(cells.crossJoin(n))).withColumn("weight", F.col("__n") / (F.col("__k") * cell)).drop("__k", "__n")


def _resampled(df: DataFrame, cols: list[str], replicas: int, seed: str, key: str) -> DataFrame:
    """Every row with its number of copies (__w) in every replica (__rep), a Poisson draw from a hash of both."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("__rep"), F.col(key)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    p, acc, cases = 0.36787944117144233, 0.0, None
    for k in range(0, 7):
        acc += p
        p /= k + 1
        cases = F.when(u < acc, k) if cases is None else cases.when(u < acc, k)
    return df.select(*cols, key, F.explode(F.sequence(F.lit(1), F.lit(replicas))).alias("__rep")).withColumn("__w", cases.otherwise(7))


def bootstrap(df: DataFrame, threshold: float, replicas: int = 200, seed: str = "boot", key: str = "pos", y: str = "y", score: str = "score") -> DataFrame:
    """(metric, low, high): percentile intervals of precision, recall, F1, ROC AUC and average precision by the Poisson bootstrap.

    Every row draws its number of copies per replica from a hash, so replicas
    need no shuffle of rows: they are summed per replica and score before they move.
    """
    each = _resampled(df, [y, score], replicas, seed, key)
    s = _counts(each, ["__rep"], y, score, "__w")
    flag = F.col(score) >= threshold
    tp, fp, fn = (F.sum(F.when(c, v).otherwise(0)) for c, v in ((flag, F.col("p")), (flag, F.col("c") - F.col("p")), (~flag, F.col("p"))))
    m = s.groupBy("__rep").agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    m = m.select(F.expr("stack(3, 'precision', try_divide(tp, tp + fp), 'recall', try_divide(tp, tp + fn), 'f1', try_divide(2 * tp, 2 * tp + fp + fn)) as (metric, v)"))
    auc = roc_auc(each, y, score, ["__rep"], "__w").select(F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("v"))
    ap = average_precision(each, y, score, ["__rep"], "__w").select(F.lit("average_precision").alias("metric"), F.col("average_precision").alias("v"))
    return m.unionByName(auc).unionByName(ap).groupBy("metric").agg(F.percentile("v", 0.025).alias("low"), F.percentile("v", 0.975).alias("high"))


def paired_bootstrap(df: DataFrame, score_a: str, score_b: str, threshold_a: float, threshold_b: float, replicas: int = 200, seed: str = "pair", key: str = "pos", y: str = "y") -> DataFrame:
    """(metric, diff_low, diff_high, share_a_better) of precision, recall and F1 on the same resampled rows."""
    each = _resampled(df, [y, score_a, score_b], replicas, seed, key)
    pos, w = F.col(y) == 1, F.col("__w")

    def sums(score, t, tag):
        flag = F.col(score) >= t
        return [F.sum(F.when(c, w).otherwise(0)).alias(f"{n}_{tag}") for n, c in (("tp", pos & flag), ("fp", ~pos & flag), ("fn", pos & ~flag))]

    s = each.groupBy("__rep").agg(*sums(score_a, threshold_a, "a"), *sums(score_b, threshold_b, "b"))
    rate = {"precision": "try_divide(tp_{0}, tp_{0} + fp_{0})", "recall": "try_divide(tp_{0}, tp_{0} + fn_{0})", "f1": "try_divide(2 * tp_{0}, 2 * tp_{0} + fp_{0} + fn_{0})"}
    parts = ", ".join(f"'{m}', {e.format('a')} - {e.format('b')}" for m, e in rate.items())
    d = s.select(F.expr(f"stack(3, {parts}) as (metric, d)"))
    return d.groupBy("metric").agg(F.percentile("d", 0.025).alias("diff_low"), F.percentile("d", 0.975).alias("diff_high"), F.avg((F.col("d") > 0).cast("double")).alias("share_a_better"))
