"""Corpus statistics: counts, shares, lengths, cross tables, distinctive words, funnels, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

# Words left out of the distinctive-word tables.
STOP_WORDS = (
    "a about above after again all am an and any are as at be because been before being below between both but by can could did do does doing down during each few for from further had has "
    "have having he her here hers him his how i if in into is it its itself just me more most my no nor not now of off on once only or other our out over own same she should so some such "
    "than that the their them then there these they this those through to too under until up very was we were what when where which while who whom why will with you your yours"
).split()


def class_counts(df: DataFrame) -> DataFrame:
    """(label, rows, share) for both labels in fixed order, 0 where there are none."""
    spark = df.sparkSession
    dim = spark.createDataFrame([(0, "safe"), (1, "scam")], "ord int, label string")
    c = df.groupBy("label").agg(F.count("*").alias("rows"))
    total = df.agg(F.count("*").alias("n"))
    return F.broadcast(dim).join(c, "label", "left").crossJoin(F.broadcast(total)).select(
        "label", F.coalesce("rows", F.lit(0)).alias("rows"), F.when(F.col("n") > 0, F.coalesce("rows", F.lit(0)) / F.col("n")).alias("share"))


def scam_rate_by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("source").agg(
        F.count("*").alias("rows"), F.count_if(F.col("label") == "scam").alias("scam_rows"), F.avg(F.col("is_synthetic").cast("double")).alias("synthetic_share"),
        F.avg((F.col("label") == "scam").cast("double")).alias("scam_rate"))


def length_stats(df: DataFrame, text: str = "text_raw") -> DataFrame:
    """(source, label, rows, median, mean, p95, max): exact, interpolated percentiles."""
    n = F.length(text)
    return df.groupBy("source", "label").agg(
        F.count("*").alias("rows"), F.round(F.percentile(n, 0.5), 1).alias("median"), F.round(F.avg(n), 1).alias("mean"), F.round(F.percentile(n, 0.95), 1).alias("p95"), F.max(n).cast("long").alias("max"))


def language_counts(df: DataFrame) -> DataFrame:
    p = df.groupBy("language").pivot("label", ["safe", "scam"]).agg(F.count(F.lit(1))).na.fill(0, ["safe", "scam"])
    return p.withColumn("total", F.col("safe") + F.col("scam"))


def masked_token_rates(df: DataFrame) -> DataFrame:
    each = {t: F.avg(F.contains(F.col("text"), F.lit(f"<{t}>")).cast("double")).alias(t.lower() + "_rate") for t in ("URL", "OTP", "PHONE")}
    return df.groupBy("label").agg(*each.values())


def top_words(df: DataFrame, n: int = 20, min_df: int = 5, alpha: float = 0.5) -> DataFrame:
    """(side, word, log_odds, scam_df, safe_df): the words that tell the classes apart most, by smoothed log-odds of document frequency."""
    words = F.array_except(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))
    w = df.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.count_if(F.col("label") == "scam").alias("scam_df"), F.count_if(F.col("label") == "safe").alias("safe_df"))
    sizes = df.agg(F.count_if(F.col("label") == "scam").alias("ns"), F.count_if(F.col("label") == "safe").alias("nf"))
    w = w.where(F.col("scam_df") + F.col("safe_df") >= min_df).crossJoin(F.broadcast(sizes))
    odds = lambda a, m: F.log((F.col(a) + alpha) / (F.col(m) - F.col(a) + alpha))
    w = w.withColumn("log_odds", F.round(odds("scam_df", "ns") - odds("safe_df", "nf"), 9)).select("word", "log_odds", "scam_df", "safe_df")
    scam = w.orderBy(F.desc("log_odds"), "word").limit(n).withColumn("side", F.lit("scam"))
    safe = w.orderBy(F.asc("log_odds"), "word").limit(n).withColumn("side", F.lit("safe"))
    return scam.unionByName(safe)


def summary(df: DataFrame) -> DataFrame:
    """(field, value, rows): value counts of all describing columns in one pass over the table."""
    cols = ["source", "label", "language", "scam_type", "is_synthetic", "generator"]
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p")
    return df.select(pairs).groupBy("p.field", "p.value").agg(F.count("*").alias("rows")).select("field", "value", "rows")


def split_report(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count("*").alias("rows"), F.count_if(F.col("label") == "scam").alias("scam"), F.count_if(F.col("label") == "safe").alias("safe"), F.countDistinct("source").alias("sources"), F.count_if("is_synthetic").alias("synthetic"))


def majority_share(df: DataFrame, by: str = "source") -> DataFrame:
    """What always guessing the largest group gets right."""
    return df.groupBy(by).agg(F.count("*").alias("c")).agg((F.max("c") / F.sum("c")).alias("majority_share"))


def length_histogram(df: DataFrame, text: str = "text_raw", bins: int = 35, low: float = 0.0, high: float = 5.0) -> DataFrame:
    """(source, label, bin, rows, density) over log10 of the length."""
    x = F.log10(F.greatest(F.length(text), F.lit(1)).cast("double"))
    b = F.least(F.floor((x - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    g = df.groupBy("source", "label", b.alias("bin")).agg(F.count("*").alias("rows"))
    n = F.sum("rows").over(Window.partitionBy("source", "label"))
    return g.withColumn("density", F.col("rows") / n / ((high - low) / bins))


def batch_progress(batches: DataFrame) -> DataFrame:
    """(generator, label, messages, share) of a log of generated batches; a batch logged twice counts once."""
    first = batches.groupBy("batch_key").agg(F.min_by(F.struct("provider", "model", "label", F.size("messages").alias("n")), F.struct("created_at", "batch_no")).alias("b"))
    g = first.select(F.concat_ws("/", "b.provider", "b.model").alias("generator"), "b.label", F.greatest("b.n", F.lit(0)).alias("n"))
    g = g.groupBy("generator", "label").agg(F.sum("n").cast("long").alias("messages"))
    return g.withColumn("share", F.col("messages") / F.sum("messages").over(Window.partitionBy(F.lit(1))))


# Words that tell of a scam, and words that tell of a corpus instead.
SIGNALS = "account alert arrest bank blocked bonus call card cash claim click congratulations customs draw fee free gift immediately kyc loan lottery offer otp password pay payment prize refund reward share suspended update urgent verify win winner won".split()
FINGERPRINTS = "ect enron forwarded hou hpl http kaminski original sender subject url vince wrote".split()


def feature_categories(top: DataFrame, signals: list[str] = SIGNALS, fingerprints: list[str] = FINGERPRINTS, word: str = "word") -> DataFrame:
    """(side, n, signal, fingerprint, format, other, signal_share): what the top features of each side are.

    A feature of several words takes its worst kind: a fingerprint before a format mark before a signal. Sides without features have no row.
    """
    words = F.split(F.lower(word), " ")

    def any_of(values):
        return F.arrays_overlap(words, F.array(*map(F.lit, values)))

    kind = F.when(any_of(fingerprints), "fingerprint").when(F.col(word).rlike(r"\d|^(?:url|otp|phone|cur|year)$"), "format").when(any_of(signals), "signal").otherwise("other")
    g = top.withColumn("__k", kind).groupBy("side").agg(F.count("*").alias("n"), *(F.count_if(F.col("__k") == k).alias(k) for k in ("signal", "fingerprint", "format", "other")))
    return g.withColumn("signal_share", F.col("signal") / F.col("n"))


def passes_audit(categories: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(passed): no fingerprint on either side, and enough signals on the scam side; no rows do not pass."""
    share = F.max(F.when(F.col("side") == "scam", F.col("signal_share")))
    return categories.agg(F.coalesce((F.sum("fingerprint") == 0) & (share >= least_share), F.lit(False)).alias("passed"))
