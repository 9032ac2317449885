"""Exact nearest-pattern retrieval over embeddings, hit rates and the choice of a threshold."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import path_exists

def nearest(queries: DataFrame, entries: DataFrame, k: int = 3, confident: float = 0.49, qid: str = "vec_id", eid: str = "entry_id", vec: str = "embedding",
            block_bytes: int = 32 << 20, apart: bool = False) -> DataFrame:
    """(qid, rank, eid, similarity, confident): the ``k`` nearest entries by cosine, ties by entry.

    A stated set of queries against all entries, in blocks: a block of queries of at most ``block_bytes`` is sent to the
    workers and every entry is read once per block; each task keeps the ``k`` best of a query before they meet.
    Neither side is gathered whole. A null or zero vector has no neighbours. With ``apart`` an entry of a query's own identifier is passed over.
    """
    spark = queries.sparkSession
    kinds = dict(queries.dtypes)[qid], dict(entries.dtypes)[eid]
    good = queries.where(F.col(vec).isNotNull()).select(qid, vec)
    size = good.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    blocks = max(1, -(-(size["n"] or 0) * (size["d"] or 1) * 8 // block_bytes))
    out = None
    for b in range(blocks):
        part = good if blocks == 1 else good.where(F.pmod(F.xxhash64(qid), F.lit(blocks)) == b)
        pdf = part.toPandas().sort_values(qid, ignore_index=True)
        x = np.array([np.asarray(v, dtype=np.float64) for v in pdf[vec]]) if len(pdf) else np.zeros((0, 1))
        norm = np.linalg.norm(x, axis=1)
        data = spark.sparkContext.broadcast((pdf[qid].to_numpy()[norm > 0], x[norm > 0] / norm[norm > 0][:, None]))

        def run(batches: Iterator[pd.DataFrame], data=data) -> Iterator[pd.DataFrame]:
            ids, base = data.value
            best = None
            for e in batches:
                e = e[e[vec].notna()]
                if not len(e) or not len(ids):
                    continue
                y = np.array([np.asarray(v, dtype=np.float64) for v in e[vec]])
                n = np.linalg.norm(y, axis=1, keepdims=True)
                own, y = e[eid].to_numpy()[n[:, 0] > 0], (y / np.where(n == 0, 1, n))[n[:, 0] > 0]
                for lo in range(0, len(ids), 1024):
                    s = np.round(base[lo : lo + 1024] @ y.T, 9)
                    if apart:
                        s[ids[lo : lo + 1024][:, None] == own[None, :]] = -np.inf
                    keep = min(k, s.shape[1])
                    # All that tie with the last place stay, so that ties are settled by entry over all tasks.
                    least = np.partition(s, -keep, axis=1)[:, -keep] if keep else np.zeros(len(s))
                    r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                    found = pd.DataFrame({qid: ids[lo : lo + 1024][r], eid: own[c], "similarity": s[r, c]})
                    best = found if best is None else pd.concat([best, found], ignore_index=True)
                if best is not None and len(best) > 64 * k * len(ids):
                    best = best.sort_values([qid, "similarity", eid], ascending=[True, False, True]).groupby(qid).head(k)
            if best is not None:
                yield best.sort_values([qid, "similarity", eid], ascending=[True, False, True]).groupby(qid).head(k)

        found = entries.select(eid, vec).mapInPandas(run, f"{qid} {kinds[0]}, {eid} {kinds[1]}, similarity double")
        out = found if out is None else out.unionByName(found)
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(qid).orderBy(F.desc("similarity"), eid))
    top1 = F.max("similarity").over(Window.partitionBy(qid))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("confident", top1 >= confident)


def hit_rates(matches: DataFrame, truth: DataFrame, qid: str = "vec_id", eid: str = "entry_id", expected: str = "expected") -> DataFrame:
    """(n, top1, top3) over queries that have an expected entry; null rates for none."""
    j = truth.where(F.col(expected).isNotNull()).join(matches.groupBy(qid).agg(F.min(F.when(F.lit(True), F.struct("rank", eid))).alias("first"), F.collect_set(eid).alias("all")), qid, "left")
    g = j.agg(F.count("*").alias("n"), F.count_if(F.col("first")[eid] == F.col(expected)).alias("a"), F.count_if(F.array_contains("all", F.col(expected))).alias("b"))
    return g.select("n", F.when(F.col("n") > 0, F.col("a") / F.col("n")).alias("top1"), F.when(F.col("n") > 0, F.col("b") / F.col("n")).alias("top3"))


def threshold_sweep(records: DataFrame, candidates: list[float], sim: str = "similarity", correct: str = "correct") -> DataFrame:
    """(threshold, accept_rate, precision, score): every candidate; score is the mean of the rates that exist."""
    each = records.select("*", F.explode(F.array(*map(F.lit, candidates))).alias("threshold"))
    ok = F.col(sim) >= F.col("threshold")
    g = each.groupBy("threshold").agg(F.avg(ok.cast("double")).alias("accept_rate"), F.try_divide(F.count_if(ok & F.col(correct)), F.count_if(ok)).alias("precision"))
    return g.withColumn("score", F.when(F.col("precision").isNull(), F.col("accept_rate")).otherwise((F.col("accept_rate") + F.col("precision")) / 2))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(threshold, score) of the best candidate, ties to the higher one; candidates without a score take no part."""
    return sweep.where("score is not null").agg(F.max(F.struct("score", "threshold")).alias("b")).where("b is not null").select("b.threshold", "b.score")


def hit_rates_by(matches: DataFrame, truth: DataFrame, by: str, qid: str = "vec_id", eid: str = "entry_id", expected: str = "expected") -> DataFrame:
    """(by, n, top1, top3) per origin and over all (null); queries whose expected entry is null or ``no_match`` count nowhere."""
    t = truth.where(F.col(expected).isNotNull() & (F.col(expected).cast("string") != "no_match"))
    m = matches.groupBy(qid).agg(F.min(F.struct("rank", eid)).alias("first"), F.collect_set(eid).alias("all"))
    j = t.join(m, qid, "left").select(by, (F.col("first")[eid] == F.col(expected)).alias("a"), F.array_contains("all", F.col(expected)).alias("b"))
    return j.rollup(by).agg(F.count("*").alias("n"), (F.count_if("a") / F.count("*")).alias("top1"), (F.count_if("b") / F.count("*")).alias("top3"))


def refresh_collection(kb: DataFrame, vectors, path: str) -> bool:
    """Writes the vectors of a knowledge base again only if its content changed; True if it did.

    ``vectors`` makes (id, embedding) of the documents. A manifest beside the table holds the hash of the
    content it was made from; a missing manifest counts as changed, any other error is raised.
    """
    spark = kb.sparkSession
    docs = compose_documents(kb)
    now = docs.agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.sha2(F.concat_ws("|", "id", "document"), 256)))), 256).alias("h")).first()[0]
    if path_exists(spark, f"{path}/manifest") and [r[0] for r in spark.read.text(f"{path}/manifest").collect()] == [now]:
        return False
    vectors(docs).write.mode("overwrite").parquet(f"{path}/vectors")
    spark.createDataFrame([(now,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return True


def compose_documents(kb: DataFrame) -> DataFrame:
    """(id, document): name, phrases and how it works, a line each."""
    parts = F.concat(F.array("name"), F.coalesce("typical_phrases", F.array().cast("array<string>")), F.array("how_it_works"))
    return kb.select("id", F.array_join(F.array_compact(parts), "\n").alias("document"))


def kb_problems(kb: DataFrame) -> DataFrame:
    """(problem, rows) of a knowledge base: blank names, empty lists, identifiers that are no snake case or not unique."""
    rules = {
        "bad_id": F.col("id").isNull() | ~F.col("id").rlike("^[a-z][a-z0-9_]*$"), "blank_name": F.trim(F.coalesce("name", F.lit(""))) == "",
        "no_phrases": F.coalesce(F.size("typical_phrases"), F.lit(-1)) <= 0, "no_flags": F.coalesce(F.size("red_flags"), F.lit(-1)) <= 0,
    }
    each = kb.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("problem")).groupBy("problem").agg(F.count("*").alias("rows"))
    twice = kb.groupBy("id").count().where("count > 1").select(F.lit("duplicate_id").alias("problem"), F.col("count").alias("rows"))
    return each.unionByName(twice)
