"""Text features fitted on train rows, linear models on them, and scoring by a join of weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import normalize_text, preprocess_text, sigmoid
from ..session import materialize, spread
from .similarity import char_wb, with_bigrams


def model_input(df: DataFrame, text: str = "text", chars: int = 2_000) -> DataFrame:
    return df.withColumn("model_text", F.substring(text, 1, chars))


def terms_of(kind: str, text: Column) -> Column:
    """Terms of a kind: word (1-2-grams) or char (2-5-grams inside words)."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return with_bigrams(words) if kind == "word" else char_wb(text)


def fit_vocabulary(train: DataFrame, kind: str = "word", min_df: int = 2, text: str = "model_text", key: str = "pos") -> DataFrame:
    """(term, idf) of the train rows only."""
    n = train.agg(F.count("*").alias("n"))
    df = train.select(key, F.explode(F.array_distinct(terms_of(kind, F.col(text)))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df)
    return df.crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def transform(df: DataFrame, vocabulary: DataFrame, kind: str = "word", text: str = "model_text", key: str = "pos") -> DataFrame:
    """(key, term, w): sublinear tf-idf of known terms, every row of length 1."""
    tf = df.select(key, F.explode(terms_of(kind, F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))
    x = tf.join(vocabulary, "term").withColumn("x", (1 + F.log("tf")) * F.col("idf"))
    return x.withColumn("w", F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy(key)))).select(key, "term", "w")


def fit_centroids(features: DataFrame, labels: DataFrame, key: str = "pos") -> DataFrame:
    """(term, weight): mean vector of scam minus mean vector of safe rows; a linear model in one aggregation."""
    n = labels.agg(F.count_if(F.col("label") == "scam").alias("a"), F.count_if(F.col("label") == "safe").alias("b"))
    j = features.join(labels.select(key, "label"), key)
    s = j.groupBy("term").agg(F.sum(F.when(F.col("label") == "scam", F.col("w")).otherwise(0.0)).alias("x"), F.sum(F.when(F.col("label") == "safe", F.col("w")).otherwise(0.0)).alias("y"))
    return s.crossJoin(F.broadcast(n)).select("term", (F.col("x") / F.greatest(F.col("a"), F.lit(1)) - F.col("y") / F.greatest(F.col("b"), F.lit(1))).alias("weight"))


def term_counts(df: DataFrame, text: Column, key: str = "pos", kind: str = "word") -> DataFrame:
    """(key, term, tf) with terms as 64-bit hashes, combined before the shuffle."""
    return spread(df.select(key, text.alias("__t"))).select(key, F.explode(F.transform(terms_of(kind, F.col("__t")), lambda t: F.xxhash64(t))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def fit_linear(train: DataFrame, text: Column, key: str = "pos", kind: str = "word", min_df: int = 2, weight: str | None = None) -> DataFrame:
    """(term, idf, weight): hashed terms of the train rows, and the difference of the classes' mean unit vectors.

    One pass makes the counts; documents without known terms count in the means with a zero vector. ``weight``
    names a column by which rows count in the means, for balanced classes or cells.
    """
    tf = materialize(term_counts(train, text, key, kind), "counts")
    w = F.coalesce(F.col(weight), F.lit(0.0)) if weight else F.lit(1.0)
    side = train.select(key, F.when(F.col("label") == "scam", w).otherwise(0.0).alias("__a"), F.when(F.col("label") == "safe", w).otherwise(0.0).alias("__b"))
    n = side.agg(F.count("*").alias("n"), F.sum("__a").alias("a"), F.sum("__b").alias("b"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(idf, "term").select(key, "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm")).join(side, key)
    s = x.join(norm, key).groupBy("term").agg(F.first("idf").alias("idf"), F.sum(F.col("x") / F.col("norm") * F.col("__a")).alias("sa"), F.sum(F.col("x") / F.col("norm") * F.col("__b")).alias("sb"))
    unit = F.when(F.col("a") > 0, F.col("sa") / F.col("a")).otherwise(0.0) - F.when(F.col("b") > 0, F.col("sb") / F.col("b")).otherwise(0.0)
    return s.crossJoin(F.broadcast(n)).select("term", "idf", unit.alias("weight"))


def score_linear(rows: DataFrame, model: DataFrame, text: Column, key: str = "pos", kind: str = "word", bias: float = 0.0) -> DataFrame:
    """(key, margin) of every row: one join with the model, one aggregation; rows without known terms get the bias."""
    x = term_counts(rows, text, key, kind).join(model, "term").select(key, ((1 + F.log("tf")) * F.col("idf")).alias("x"), "weight")
    m = x.groupBy(key).agg((F.sum(F.col("x") * F.col("weight")) / F.sqrt(F.sum(F.col("x") * F.col("x")))).alias("m"))
    return rows.select(key).join(m, key, "left").select(key, (F.coalesce("m", F.lit(0.0)) + bias).alias("margin"))


def prepared(c: Column, chars: int = 2_000) -> Column:
    """The text a model reads: normalised, cleaned, masked, cut. Null and texts that are blank then give null."""
    t = F.substring(preprocess_text(normalize_text(c)), 1, chars)
    return F.when(F.trim(t) != "", t)


def predict(rows: DataFrame, model: DataFrame, threshold: float | Column, text: str = "text_raw", key: str = "pos") -> DataFrame:
    """(key, margin, scam_probability, is_scam) of raw rows; rows that are blank after cleaning have nulls.

    The flag compares the margin with the threshold; the probability is a sigmoid of their difference.
    """
    ready = spread(rows.select(key, text)).select(key, prepared(F.col(text)).alias("__t"))
    threshold = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    m = score_linear(ready.where("__t is not null"), model, F.col("__t"), key)
    return rows.select(key).join(m, key, "left").select(key, "margin", sigmoid(F.col("margin") - threshold).alias("scam_probability"), (F.col("margin") >= threshold).alias("is_scam"))


def score(features: DataFrame, weights: DataFrame, rows: DataFrame, bias: float = 0.0, key: str = "pos") -> DataFrame:
    """(key, margin): rows without known terms get the bias."""
    m = features.join(weights, "term").groupBy(key).agg(F.sum(F.col("w") * F.col("weight")).alias("m"))
    return rows.select(key).join(m, key, "left").select(key, (F.coalesce("m", F.lit(0.0)) + bias).alias("margin"))


def top_weights(weights: DataFrame, n: int = 30) -> DataFrame:
    """(side, term, weight): the largest and the most negative."""
    a = weights.orderBy(F.desc("weight"), "term").limit(n).withColumn("side", F.lit("scam"))
    return a.unionByName(weights.orderBy("weight", "term").limit(n).withColumn("side", F.lit("safe")))


def hashed_vectors(df: DataFrame, kind: str = "word", width: int = 1 << 18, text: str = "model_text") -> DataFrame:
    """Adds features: a sparse vector of hashed terms, for Spark's own learners."""
    from pyspark.ml.feature import HashingTF

    return HashingTF(numFeatures=width, inputCol="terms", outputCol="features").transform(df.withColumn("terms", terms_of(kind, F.col(text)))).drop("terms")


def fit_logistic(train: DataFrame, c: float = 1.0, weight: str | None = None, family: str = "auto", label: str = "y"):
    """L2 logistic regression; ``c`` is the inverse strength per row."""
    from pyspark.ml.classification import LogisticRegression

    n = train.count()
    lr = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False, maxIter=50, family=family)
    return (lr.setWeightCol(weight) if weight else lr).fit(train)


def grid_search(train: DataFrame, val: DataFrame, cs: list[float], label: str = "y") -> list[tuple[float, float]]:
    """(c, F1 at the tuned threshold) per candidate, best first; the test split is never seen."""
    from pyspark.ml.functions import vector_to_array

    from .metrics import best_f1_threshold

    out = []
    for c in cs:
        model = fit_logistic(train, c, label=label)
        scored = model.transform(val).select(F.col(label).alias("y"), vector_to_array("probability")[1].alias("score"))
        row = best_f1_threshold(scored).first()
        out.append((c, row["f1"] if row and row["f1"] is not None else float("nan")))
    return sorted(out, key=lambda r: (-(r[1] if r[1] == r[1] else -1), r[0]))


def leave_one_source_out(df: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """Train rows of the other sources, and test rows of ``source`` (its validation rows if it is synthetic)."""
    train = df.where((F.col("split") == "train") & (F.col("source") != source))
    held = df.where((F.col("source") == source) & (F.col("split") == F.when(F.col("is_synthetic"), "val").otherwise("test")))
    return train, held
