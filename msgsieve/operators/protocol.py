"""The evaluation protocol around the linear models: tuning, held-out sources, shortcuts, variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, release
from . import features, heldout, metrics, splits


def class_weights(df: DataFrame, column: str = "weight") -> DataFrame:
    """Adds n / (2 * class size), so that both labels weigh the same."""
    n = df.groupBy("label").agg(F.count("*").alias("__c"))
    total = df.agg(F.count("*").alias("__n"))
    return df.join(n, "label").crossJoin(F.broadcast(total)).withColumn(column, F.col("__n") / (2 * F.col("__c"))).drop("__n", "__c")


def audit_model(train: DataFrame, text: Column, key: str = "pos") -> DataFrame:
    """Words only, balanced: (term, idf, weight) of the model whose weights are read by people."""
    return features.fit_linear(class_weights(train), text, key, "word", weight="weight")


def tune(train: DataFrame, val: DataFrame, text: Column, kinds: tuple[str, ...] = ("word", "char"), key: str = "pos") -> tuple[str, DataFrame, float, float]:
    """(kind, model, threshold, f1) of the feature kind with the best F1 on the validation rows; earlier kinds win ties. The test rows play no part."""
    best = None
    for kind in kinds:
        model = materialize(features.fit_linear(train, text, key, kind), "model")
        scored = features.score_linear(val, model, text, key, kind).join(val.select(key, (F.col("label") == "scam").cast("int").alias("y")), key)
        row = metrics.best_f1_threshold(scored.withColumnRenamed("margin", "score")).first()
        f1 = row["f1"] if row["f1"] is not None else -1.0
        if best is None or f1 > best[3]:
            best = (kind, model, float(row["threshold"]), f1)
    return best


def run_protocol(df: DataFrame, text: Column, key: str = "pos", source: str = "source") -> DataFrame:
    """(stage, source, n, precision, recall, f1, roc_auc): tuned on validation rows, tested once, then every source held out.

    ``df`` has split, label, is_synthetic and source; rows without a split take no part. Sources are as many as
    corpora were merged; all are fitted together (``heldout``). Keys are unique.
    """
    used = df.where(F.col("split").isin("train", "val", "test"))
    sources = [r[0] for r in used.where("split = 'train'").select(source).where(F.col(source).isNotNull()).distinct().orderBy(source).collect()]
    best = None
    for kind in ("word", "char"):
        docs = heldout.documents(used, text, kind, sources, key, source)
        m = heldout.margins(docs, 0, key)
        val = m.withColumnRenamed("margin", "score").join(used.where("split = 'val' and not is_synthetic").select(key, (F.col("label") == "scam").cast("int").alias("y")), key)
        row = metrics.best_f1_threshold(val).first()
        f1 = row["f1"] if row["f1"] is not None else -1.0
        if best is None or f1 > best[2]:
            release(*(best or ())[:1])
            best = (docs, float(row["threshold"]), f1)
        else:
            release(docs)
        release(m)
    docs, threshold, _ = best
    m = heldout.margins(docs, len(sources), key)
    y = (F.col("label") == "scam").cast("int").alias("y")
    rows = materialize(used.where("split <> 'train'").select(key, "split", "is_synthetic", source, y).join(m, key), "rows")
    release(docs, m)

    def report(stage: str, held: DataFrame, score: str, name: str | None) -> DataFrame:
        s = held.select("y", F.col(score).alias("score"))
        c = metrics.confusion(s, threshold).crossJoin(metrics.roc_auc(s))
        return c.select(F.lit(stage).alias("stage"), F.lit(name).alias("source"), "n", "precision", "recall", "f1", "roc_auc")

    out = report("test", rows.where("split = 'test'"), "margin", None)
    for name in sources:
        held = rows.where((F.col(source) == name) & (F.col("split") == F.when(F.col("is_synthetic"), "val").otherwise("test")))
        out = out.unionByName(report("held_out", held, "held_margin", name))
    return out


def oof_scores(df: DataFrame, text: Column, k: int = 5, key: str = "pos") -> DataFrame:
    """(key, oof): margins of every row by a model that never saw its fold."""
    f = materialize(splits.folds(df, k, key=key), "folds")
    out = None
    for i in range(k):
        model = materialize(features.fit_linear(f.where(F.col("fold") != i), text, key), "model")
        s = features.score_linear(f.where(F.col("fold") == i), model, text, key).withColumnRenamed("margin", "oof")
        out = s if out is None else out.unionByName(s)
    return out


def source_identifiability(train: DataFrame, val: DataFrame, text: Column, key: str = "pos", source: str = "source") -> DataFrame:
    """(accuracy, majority, excess): how well the text alone tells the source.

    One model for all sources: mean unit vectors per source, the nearest wins, ties to the first name. Only real rows and sources of the training rows count.
    """
    real = train.where("not is_synthetic").where(F.col(source).isNotNull())
    tf = materialize(features.term_counts(real, text, key), "counts")
    n = real.agg(F.count("*").alias("n"))
    idf = tf.groupBy("term").agg(F.count("*").alias("df")).where("df >= 2").crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    x = tf.join(idf, "term").select(key, "term", "idf", ((1 + F.log("tf")) * F.col("idf")).alias("x"))
    norm = x.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    size = real.groupBy(source).agg(F.count("*").alias("rows"))
    mean = x.join(norm, key).join(real.select(key, source), key).groupBy(source, "term").agg(F.sum(F.col("x") / F.col("norm")).alias("s"), F.first("idf").alias("idf")).join(size, source)
    mean = mean.select(source, "term", "idf", (F.col("s") / F.col("rows")).alias("weight"))
    known = val.join(size.select(source), source, "left_semi")
    d = features.term_counts(known, text, key).join(mean.withColumnRenamed(source, "__guess"), "term").groupBy(key, "__guess").agg(F.sum((1 + F.log("tf")) * F.col("idf") * F.col("weight")).alias("d"))
    top = d.groupBy(key).agg(F.min_by("__guess", F.struct(-F.col("d"), "__guess")).alias("guess"))
    acc = known.select(key, source).join(top, key, "left").agg(F.avg((F.coalesce(F.col("guess"), F.lit("")) == F.col(source)).cast("double")).alias("accuracy"), F.count("*").alias("n"))
    base = known.groupBy(source).count().agg(F.max("count").alias("m"))
    return acc.crossJoin(base).select("accuracy", (F.col("m") / F.col("n")).alias("majority"), (F.col("accuracy") - F.col("m") / F.col("n")).alias("excess"))


def shortcut_check(scored: DataFrame, threshold: float = 0.0, source: str = "source") -> DataFrame:
    """(source, group, n, trained_on, held_out): flag rates by a model that saw the source and by one that did not.

    ``scored`` has score_in, score_out and benchmark (legitimate promotions). A row is flagged above the threshold.
    """
    group = F.when(F.coalesce("benchmark", F.lit(False)), "promo_service").otherwise("other")

    def rate(c):
        return F.avg((F.col(c) > threshold).cast("double"))

    return scored.groupBy(source, group.alias("group")).agg(F.count("*").alias("n"), rate("score_in").alias("trained_on"), rate("score_out").alias("held_out"))


def needs_mitigation(results: DataFrame) -> DataFrame:
    """Adds trigger to (source, auc, auc_in): below 0.75, or more than 0.15 under the score within the distribution. Null scores trigger nothing."""
    return results.withColumn("trigger", F.coalesce((F.col("auc") < 0.75) | (F.col("auc_in") - F.col("auc") > 0.15), F.lit(False)))


def best_variant(rates: DataFrame) -> DataFrame:
    """(variant): the highest mean of top1 and top3, the first of equals; ``rates`` has place, variant, top1, top3."""
    return rates.agg(F.min_by("variant", F.struct(-(F.col("top1") + F.col("top3")) / 2, "place")).alias("variant"))


def variant_agreement(a: DataFrame, b: DataFrame, threshold: float = 0.5, key: str = "pos", score: str = "score") -> DataFrame:
    """(n, agreement, max_difference) of two models' scores on the rows that both have."""
    j = a.select(key, F.col(score).alias("p")).join(b.select(key, F.col(score).alias("q")), key)
    return j.agg(F.count("*").alias("n"), F.avg(((F.col("p") >= threshold) == (F.col("q") >= threshold)).cast("double")).alias("agreement"), F.max(F.abs(F.col("p") - F.col("q"))).alias("max_difference"))


def rejoin(scores: DataFrame, more: DataFrame, name: str, key: str = "pos") -> DataFrame:
    """``scores`` with another model's score of the same rows; rows it lacks have null."""
    return scores.join(more.select(key, F.col("score").alias(name)), key, "left")


def shortcut_baselines(train: DataFrame, test: DataFrame, key: str = "pos", source: str = "source", text: str = "text_raw") -> DataFrame:
    """(baseline, roc_auc) of two scores that read no words: the source's scam rate in training, and the length's.

    Lengths are binned by tenths of their logarithm; a source or bin that training lacks gets the overall rate.
    """
    size = F.floor(F.log10(F.greatest(F.length(text), F.lit(1))) * 10).cast("int")
    y = (F.col("label") == "scam").cast("int")
    rate = train.agg(F.avg(y).alias("__r"))
    out = None
    for name, by in (("source", F.col(source).cast("string")), ("length", size.cast("string"))):
        table = train.groupBy(by.alias("__g")).agg(F.avg(y).alias("score"))
        s = test.select(by.alias("__g"), y.alias("y")).join(table, "__g", "left").crossJoin(F.broadcast(rate)).select("y", F.coalesce("score", "__r").alias("score"))
        row = metrics.roc_auc(s).select(F.lit(name).alias("baseline"), "roc_auc")
        out = row if out is None else out.unionByName(row)
    return out


def generation_plan(spark, languages: dict[str, int], topics: list[str], extra: str, scale: float = 1.0) -> DataFrame:
    """(label, topic, language, batch_no): every language's number of batches for every topic and label, and safe ones of an everyday topic.

    The whole plan is a product of small lists that the caller states.
    """
    lang = spark.createDataFrame(list(languages.items()), "language string, w int")
    n = F.greatest(F.lit(1), F.bround(F.col("w") * scale).cast("int")) if scale > 0 else F.lit(0)
    pairs = [(label, t) for t in topics for label in ("scam", "safe")] + [("safe", extra)]
    kinds = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(t).alias("topic")) for a, t in pairs])
    d = lang.select("language", F.explode(F.sequence(F.lit(0), n - 1)).alias("batch_no"), kinds.alias("k")) if scale > 0 else lang.select("language", F.lit(0).alias("batch_no"), kinds.alias("k")).limit(0)
    return d.select(F.explode("k").alias("k"), "language", "batch_no").select("k.label", "k.topic", "language", "batch_no")
