"""The linear model of ``features`` fitted for all rows and without each of several groups at once.

Documents are read once. Terms of many documents are known to every task, so their counts, lengths and weights are
arrays in it; the others meet by shuffle, with one column a model. The models are those of ``fit_linear``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize, partitions_for, release, spread
from .similarity import _flat, _frequent

_DOC = "part string, src int, y int, terms array<long>, tf array<int>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _add(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Hashes of sequences with one more element; their length counts."""
    return _mix(h * np.uint64(0x9E3779B97F4A7C15) + x.astype(np.uint64) + np.uint64(1))


def word_terms(words: list[str], row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every word and every pair of neighbours."""
    code, names = pd.factorize(np.array(words, dtype=object))
    h = pd.util.hash_array(np.asarray(names, dtype=object))[code] if len(code) else np.zeros(0, np.uint64)
    on = np.flatnonzero(row[1:] == row[:-1])
    return np.concatenate([row, row[on]]), np.concatenate([_add(h, np.zeros(len(h))), _add(_add(h[on], np.ones(len(on))), h[on + 1])]).view(np.int64)


def char_terms(words: list[str], row: np.ndarray, low: int = 2, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the character n-grams inside words padded with blanks; every different word is cut once."""
    code, names = pd.factorize(np.array(words, dtype=object))
    size = np.fromiter(map(len, names), np.int64, len(names)) + 2
    flat = np.frombuffer("".join(f" {w} " for w in names).encode("utf-32-le"), np.uint32)
    word, end = np.repeat(np.arange(len(names)), size), np.repeat(np.cumsum(size), size)
    of, hashes, h = [], [], np.zeros(len(flat), np.uint64)
    for n in range(1, high + 1):
        on = np.arange(len(flat)) + n <= end
        h = _add(h, np.append(flat[n - 1 :], np.zeros(n - 1, np.uint32)))
        if n >= low:
            of.append(word[on])
            hashes.append(h[on])
    of, hashes = (np.concatenate(of), np.concatenate(hashes)) if of else (word, h)
    order = np.argsort(of, kind="stable")
    hashes, n = hashes[order], np.bincount(of, minlength=len(names))
    first, n = (np.cumsum(n) - n)[code], n[code]
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.repeat(row, n), hashes[at].view(np.int64)


def documents(df: DataFrame, text: Column, kind: str, sources: list, key: str = "pos", source: str = "source") -> DataFrame:
    """The written (key, part, src, y, terms, tf): split, place of the source (0: none or not listed), 1 scam, 0 safe, -1 neither."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)) if kind == "word" else F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")
    src = F.coalesce(F.array_position(F.array(*map(F.lit, sources)), F.col(source)).cast("int"), F.lit(0)) if sources else F.lit(0)
    y = F.when(F.col("label") == "scam", 1).when(F.col("label") == "safe", 0).otherwise(-1)
    base = spread(df).select(key, F.col("split").alias("part"), src.alias("src"), y.alias("y"), words.alias("words"))
    make = word_terms if kind == "word" else char_terms

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), 1_000):
                pdf = batch.iloc[lo : lo + 1_000]
                lists = [() if w is None else w for w in pdf["words"]]
                size = np.fromiter(map(len, lists), np.int64, len(lists))
                row, h = make([w for ws in lists for w in ws], np.repeat(np.arange(len(lists)), size))
                names, code = np.unique(h, return_inverse=True)
                cell, tf = np.unique(row * max(len(names), 1) + code, return_counts=True)
                row, code = np.divmod(cell, max(len(names), 1))
                cut = np.searchsorted(row, np.arange(len(pdf) + 1))
                terms, tf = names[code], tf.astype(np.int32)
                yield pdf.drop(columns="words").assign(terms=[terms[s:e] for s, e in zip(cut[:-1], cut[1:])], tf=[tf[s:e] for s, e in zip(cut[:-1], cut[1:])])

    return materialize(base.mapInPandas(run, f"{key} {dict(base.dtypes)[key]}, {_DOC}"), "documents")


def _find(hot: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``hot``, whether it is there)."""
    at = np.minimum(np.searchsorted(hot, flat), max(len(hot) - 1, 0))
    return at, hot[at] == flat if len(hot) else np.zeros(len(flat), bool)


def _idf(per: np.ndarray, n: np.ndarray, min_df: int) -> np.ndarray:
    """Inverse frequencies (terms, models) from documents by source; 0 for terms that a model does not know."""
    df = per.sum(axis=1, keepdims=True) - np.concatenate([np.zeros((len(per), 1)), per[:, 1:] + per[:, :1]], axis=1)
    return np.where(df >= min_df, np.log((1 + n) / (1 + df)) + 1, 0.0)


def margins(docs: DataFrame, sources: int, key: str = "pos", min_df: int = 2, share: float = 1e-3, least: int = 100) -> DataFrame:
    """(key, margin, held_margin) of the rows outside train: by the model of all train rows, and by that of the rows of all other sources.

    ``docs`` are written ``documents`` and ``sources`` is how many places they know, or 0 for the model of all rows alone. Train rows without a source count in the model of all rows only;
    the held margin of rows without a place is null. Terms of more than ``share`` and ``least`` train rows are known to every task.
    """
    spark, models = docs.sparkSession, sources + 1
    if not sources:
        docs = docs.withColumn("src", F.lit(0))
    train = docs.where("part = 'train'")
    per = train.groupBy("src", "y").count().toPandas()

    def total(on: pd.Series) -> np.ndarray:
        c = np.bincount(per["src"][on], per["count"][on], models)
        return c.sum() - np.concatenate([[0.0], c[1:] + c[0]])

    n, a, b = total(per["y"] >= -1), total(per["y"] == 1), total(per["y"] == 0)
    hot = _frequent(train, share, least, int(n[0]))[0]
    hot_b = spark.sparkContext.broadcast(hot)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            at, on = _find(hot_b.value, flat)
            cell, c = np.unique(at[on] * models + pdf["src"].to_numpy()[row[on]], return_counts=True)
            yield pd.DataFrame({"cell": cell, "n": c})

    df = np.zeros(len(hot) * models)
    if len(hot):
        cells = train.select("src", "terms").mapInPandas(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        df[cells["cell"]] = cells["n"]
    idf_b = spark.sparkContext.broadcast(_idf(df.reshape(-1, models), n, min_df))
    kind = dict(docs.dtypes)[key]
    idfs, sums = [f"i{m}" for m in range(models)], [f"v{m}" for m in range(models)]

    def cold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            keep = ~_find(hot_b.value, flat)[1]
            yield pdf[[key, "part", "src"]].iloc[row[keep]].assign(term=flat[keep], tf=_flat(pdf["tf"], np.int32)[0][keep])

    def weighed(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True)
        term = pdf["term"].to_numpy()
        group = np.cumsum(np.concatenate(([False], term[1:] != term[:-1])))
        of = (pdf["part"] == "train").to_numpy()
        per = np.bincount(group[of] * models + pdf["src"].to_numpy()[of], minlength=(int(group[-1]) + 1) * models).reshape(-1, models)
        idf = _idf(per, n, min_df)
        known = idf.any(axis=1)[group]
        return pd.concat([pdf[[key, "term", "tf"]][known].reset_index(drop=True), pd.DataFrame(idf[group[known]], columns=idfs)], axis=1)

    def by_term(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            term = pdf["term"].to_numpy()
            cut = int(np.searchsorted(term, term[-1]))
            if cut or (parts and parts[-1]["term"].iloc[-1] != term[-1]):
                yield weighed([*parts, pdf.iloc[:cut]])
                parts = []
            parts.append(pdf.iloc[cut:])
        if parts:
            yield weighed(parts)

    number = docs.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    shuffled = docs.mapInPandas(cold, f"{key} {kind}, part string, src int, term long, tf int").repartition(partitions_for(spark, number, 4_000_000), "term").sortWithinPartitions("term")
    rare = materialize(shuffled.mapInPandas(by_term, f"{key} {kind}, term long, tf int, " + ", ".join(f"{c} double" for c in idfs)), "rare")

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            at, on = _find(hot_b.value, flat)
            cut = np.searchsorted(row[on], np.arange(len(pdf) + 1))
            at, tf = at[on].astype(np.int32), _flat(pdf["tf"], np.int32)[0][on]
            yield pdf[[key, "src", "y"]].assign(at=[at[s:e] for s, e in zip(cut[:-1], cut[1:])], tfs=[tf[s:e] for s, e in zip(cut[:-1], cut[1:])])

    side = np.stack([np.zeros(models), np.zeros(models), np.zeros(models)])
    side[1], side[0] = np.where(a > 0, 1 / np.maximum(a, 1), 0.0), -np.where(b > 0, 1 / np.maximum(b, 1), 0.0)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """What the train rows of a partition add to the weights of terms; hot ones are summed here."""
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True)
        one = pdf["y"].notna().to_numpy()
        doc, names = pd.factorize(pdf[key])
        d, r = pdf[one], pdf[~one]
        at, row = _flat(d["at"], np.int32)
        u, row, idf = 1 + np.log(_flat(d["tfs"], np.int32)[0]), doc[one][row], idf_b.value
        trained = np.zeros(len(names), bool)
        trained[doc[one]] = True
        r, rdoc = r[trained[doc[~one]]], doc[~one][trained[doc[~one]]]
        ru = 1 + np.log(r["tf"].to_numpy(float))
        src, y = np.zeros(len(names), np.int64), np.full(len(names), -1)
        src[doc[one]], y[doc[one]] = d["src"], d["y"]
        hot_sum, rare_sum = np.zeros((models, len(idf))), {}
        for m in range(models):
            x, rx = u * idf[at, m] if len(idf) else u * 0.0, ru * r[f"i{m}"].to_numpy(float)
            norm = np.sqrt(np.bincount(row, x * x, len(names)) + np.bincount(rdoc, rx * rx, len(names)))
            k = np.where((norm > 0) & (m == 0 or (src != 0) & (src != m)), side[y, m] / np.maximum(norm, 1e-300), 0.0)
            hot_sum[m] = np.bincount(at, x * k[row], len(idf))
            rare_sum[f"v{m}"] = rx * k[rdoc]
        yield pd.DataFrame({"hot": np.full(len(idf), True), "term": np.arange(len(idf)), **{f"v{m}": hot_sum[m] for m in range(models)}})
        yield pd.DataFrame({"hot": np.full(len(r), False), "term": r["term"].astype(np.int64), **rare_sum})

    every = train.mapInPandas(placed, f"{key} {kind}, src int, y int, at array<int>, tfs array<int>").withColumn("term", F.lit(0).cast("long"))  # a null among them would round all to doubles
    both = every.unionByName(rare, allowMissingColumns=True).repartition(partitions_for(spark, number, 4_000_000), key)
    added = materialize(both.mapInPandas(shares, "hot boolean, term long, " + ", ".join(f"{c} double" for c in sums)), "shares")
    summed = added.groupBy("hot", "term").agg(*[F.sum(c).alias(c) for c in sums])
    top = np.zeros((len(hot), models))
    if len(hot):
        t = summed.where("hot").toPandas()
        top[t["term"]] = t[sums].to_numpy()
    top_b = spark.sparkContext.broadcast(top)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Products and squared lengths of the hot terms, by the model of all rows and by the one without the row's source."""
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            at, on = _find(hot_b.value, flat)
            at, row, u = at[on], row[on], 1 + np.log(_flat(pdf["tf"], np.int32)[0][on])
            out = pdf[[key]].copy()
            for name, m in (("0", np.zeros(len(pdf), np.int64)), ("1", pdf["src"].to_numpy())):
                x = u * idf_b.value[at, m[row]] if len(at) else u
                out["p" + name] = np.bincount(row, x * top_b.value[at, m[row]], len(pdf)) if len(at) else 0.0
                out["q" + name] = np.bincount(row, x * x, len(pdf)).astype(float)
            yield out

    held = docs.where("part <> 'train'")
    u = 1 + F.log("tf")
    weights = summed.where("not hot").drop("hot")
    src = F.col("src")
    x0, x1 = u * F.col("i0"), u * F.get(F.array(*idfs), src)
    j = rare.join(held.select(key, "src"), key).join(weights, "term").select(key, (x0 * F.col("v0")).alias("p0"), (x0 * x0).alias("q0"), (x1 * F.get(F.array(*sums), src)).alias("p1"), (x1 * x1).alias("q1"))
    s = j.unionByName(held.select(key, "src", "terms", "tf").mapInPandas(scored, f"{key} {kind}, p0 double, q0 double, p1 double, q1 double"))
    s = s.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("p0", "q0", "p1", "q1")])

    def margin(p: str, q: str) -> Column:
        return F.when(F.col(q) > 0, F.col(p) / F.sqrt(q)).otherwise(0.0)

    out = held.select(key, "src").join(s, key, "left").select(key, margin("p0", "q0").alias("margin"), F.when(src > 0, margin("p1", "q1")).alias("held_margin"))
    out = materialize(out, "margins")
    release(rare, added)
    return out
