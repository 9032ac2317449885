"""TF-IDF, the exact cosine similarity join by prefix filtering, and what is built on it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType

from ..functions.text import casefold, dedup_key
from ..session import materialize, partitions_for, release, spread
from .graph import connected_components

#: Characters of the folded text by the definition of the jobs that state a prefix.
NEAR_CHARS = 3_000
#: Buckets by which vectors without a candidate are told.
BUCKETS = 1 << 20


def near_tokens(text: Column, chars: int | None = None) -> Column:
    """Words of two letters or digits or more of the folded text, or of its first ``chars`` characters; digit runs count as one 0, marks divide words."""
    t = F.regexp_replace(casefold(text), r"(?U)\d+", "0")
    if chars:
        t = F.substring(t, 1, chars)
    return F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def with_bigrams(words: Column) -> Column:
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(words, F.when(F.size(words) > 1, pairs).otherwise(F.array().cast("array<string>")))


def char_wb(text: Column, low: int = 2, high: int = 5) -> Column:
    """Character n-grams inside words padded with blanks; a padded word shorter than n counts once as itself."""
    words = F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: w != "")

    def grams(w):
        p = F.concat(F.lit(" "), w, F.lit(" "))
        out = F.array().cast("array<string>")
        for n in range(low, high + 1):
            g = F.transform(F.sequence(F.lit(1), F.greatest(F.length(p) - n + 1, F.lit(1))), lambda i: F.substring(p, i, F.lit(n)))
            out = F.concat(out, g) if n == low else F.when(F.length(p) >= n, F.concat(out, g)).otherwise(out)
        return out

    return F.flatten(F.transform(words, grams))


def term_table(df: DataFrame, ident: str, terms: Column) -> DataFrame:
    """(doc, terms, tf): the distinct terms of a document as 64-bit hashes, and how often it has each.

    One row per identifier: rows that share one are one document.
    """
    base = spread(df).select(F.col(ident).alias("doc"), F.transform(terms, lambda t: F.xxhash64(t)).alias("terms"))
    if not df.groupBy(ident).count().where("count > 1").isEmpty():
        base = base.groupBy("doc").agg(F.flatten(F.collect_list("terms")).alias("terms"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            order = np.lexsort((flat, row))
            flat, row = flat[order], row[order]
            first = np.flatnonzero(np.concatenate(([True], (flat[1:] != flat[:-1]) | (row[1:] != row[:-1])))) if len(flat) else np.zeros(0, np.int64)
            tf = np.diff(np.append(first, len(flat))).astype(np.int32)
            cut = np.searchsorted(row[first], np.arange(len(pdf) + 1))
            yield pd.DataFrame({"doc": pdf["doc"], "terms": [flat[first[s:e]] for s, e in zip(cut[:-1], cut[1:])], "tf": [tf[s:e] for s, e in zip(cut[:-1], cut[1:])]})

    return base.mapInPandas(run, f"doc {dict(base.dtypes)['doc']}, terms array<long>, tf array<int>")


def _flat(arrays: pd.Series, kind=np.int64) -> tuple[np.ndarray, np.ndarray]:
    """(values, row) of arrays; null arrays have none."""
    arrays = [np.asarray(a if a is not None else (), kind) for a in arrays]
    size = np.fromiter(map(len, arrays), np.int64, len(arrays))
    return (np.concatenate(arrays) if arrays else np.zeros(0, kind)), np.repeat(np.arange(len(arrays)), size)


def _frequent(terms: DataFrame, share: float, least: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted terms, documents) of the terms of more than ``least`` and of more than ``share`` of the ``n`` documents.

    Such a term holds its share in at least one batch, so only terms that do are counted over all. At most
    (terms of a document) / ``share`` reach the driver.
    """
    spark = terms.sparkSession

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, c = np.unique(_flat(pdf["terms"])[0], return_counts=True)
            yield pd.DataFrame({"term": t[c > share * len(pdf)]})

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            t, c = np.unique(_flat(pdf["terms"])[0], return_counts=True)
            on = np.isin(t, known.value, kind="sort")
            yield pd.DataFrame({"term": t[on], "n": c[on]})

    none = np.zeros(0, np.int64)
    if n <= least:
        return none, none
    known = spark.sparkContext.broadcast(terms.select("terms").mapInPandas(likely, "term long").distinct().toPandas()["term"].to_numpy(np.int64))
    found = terms.select("terms").mapInPandas(counted, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") > max(least, int(share * n))).toPandas().sort_values("term")
    return found["term"].to_numpy(np.int64), found["n"].to_numpy(np.int64)


def _occurrences(hot_b, frequent: bool):
    """(doc, df, term, tf) of the terms in ``hot_b`` or of all others, whose df is 0 as yet."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        terms, df = hot_b.value
        for pdf in batches:
            flat, row = _flat(pdf["terms"])
            tf, _ = _flat(pdf["tf"], np.int32)
            at = np.minimum(np.searchsorted(terms, flat), max(len(terms) - 1, 0))
            on = terms[at] == flat if len(terms) else np.zeros(len(flat), bool)
            keep = on if frequent else ~on
            yield pd.DataFrame({"doc": pdf["doc"].to_numpy()[row[keep]], "df": df[at[keep]] if frequent else np.zeros(int(keep.sum()), np.int64), "term": flat[keep], "tf": tf[keep]})

    return run


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sets df of occurrences in the order of their terms; terms of one document, which no other shares, become 0."""

    def count(parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        term = pdf["term"].to_numpy()
        start = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1])))
        size = np.diff(np.append(start, len(term)))
        df = np.repeat(size, size)
        return pdf.assign(df=df, term=np.where(df == 1, 0, term))

    parts: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        term = pdf["term"].to_numpy()
        cut = int(np.searchsorted(term, term[-1]))
        if cut or (parts and parts[-1]["term"].iloc[-1] != term[-1]):
            yield count([*parts, pdf.iloc[:cut]])
            parts = []
        parts.append(pdf.iloc[cut:])
    if parts:
        yield count(parts)


def _pack(threshold: float, n: int):
    """Sparse unit vectors of the documents of a partition: terms ascending, weights, the rare end, and bounds of what follows it."""
    levels = max(n, 1).bit_length() + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        c = {k: np.concatenate([p[k].to_numpy() for p in parts]) for k in ("doc", "df", "term", "tf")}
        del parts
        order = np.lexsort((c["term"], c["df"], c["doc"]))
        doc, term, df = c["doc"][order], c["term"][order], c["df"][order]
        x = (1 + np.log(c["tf"][order])) * (np.log((1 + n) / (1 + df)) + 1)
        start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        size = np.diff(np.append(start, len(doc)))
        of = np.repeat(np.arange(len(start)), size)
        w = x / np.sqrt(np.add.reduceat(x * x, start))[of]
        # Squared length from a term to the document's end, in the order from rare to frequent.
        total = np.cumsum((w * w)[::-1])[::-1]
        rest = total - np.append(total, 0.0)[start + size][of]
        need = rest >= threshold * threshold - 1e-9
        shared = df > 1
        # Length of the part with a df above 1, 2, 4, ..., and the last of these up to which all terms are in the rare end.
        level = np.ceil(np.log2(df)).astype(np.int64)
        above = np.bincount(of * levels + level, w * w, len(start) * levels).reshape(-1, levels)
        above = np.cumsum(above[:, ::-1], axis=1)[:, ::-1]
        above = np.sqrt(np.maximum(np.concatenate([above[:, 1:], np.zeros((len(start), 1))], axis=1), 0.0)).astype(np.float32)
        k = np.full(len(start), levels - 1)
        out = np.flatnonzero(shared & ~need)
        np.minimum.at(k, of[out], np.floor(np.log2(df[out] - 1)).astype(np.int64))
        ends = np.append(np.searchsorted(of[shared], np.arange(len(start))), int(shared.sum()))
        prefix = np.flatnonzero(shared & need)
        pre = np.append(np.searchsorted(of[prefix], np.arange(len(start))), len(prefix))
        rare, rw = term[prefix], w[prefix].astype(np.float32)
        by_term = np.lexsort((term, of))
        by_term = by_term[shared[by_term]]
        t, v = term[by_term], w[by_term]
        for lo in range(0, len(start), 10_000):
            d = range(lo, min(lo + 10_000, len(start)))
            yield pd.DataFrame({"doc": doc[start[d.start : d.stop]], "terms": [t[ends[i] : ends[i + 1]] for i in d], "w": [v[ends[i] : ends[i + 1]] for i in d],
                                "rare": [rare[pre[i] : pre[i + 1]] for i in d], "rw": [rw[pre[i] : pre[i + 1]] for i in d], "k": k[d.start : d.stop].astype(np.int32), "above": list(above[d.start : d.stop])})

    return run


def vectors(terms: DataFrame, docs: DataFrame, threshold: float, share: float = 1e-3, least: int = 1_000) -> DataFrame:
    """(doc, terms, w, rare, rw, k, above): every document's unit vector, sublinear tf times smooth idf, terms ascending.

    ln((1+n)/(1+df))+1 and 1+ln(tf), n being the rows of ``docs`` (doc); documents without terms have no row, and terms that one document alone
    has are left out after they counted in its length. ``rare`` holds the terms, from rare to frequent, until what is left of the vector is shorter than
    ``threshold``, ``rw`` their weights; ``above[k]`` is the length of the terms of a df above 2**k, up to which ``rare`` has all. ``terms`` is a written ``term_table``.
    Terms of more than ``share`` and ``least`` documents are known to every task, the others meet by shuffle to be counted.
    """
    spark = terms.sparkSession
    n = docs.count()
    held, every = terms.agg(F.count("*"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    hot = spark.sparkContext.broadcast(_frequent(terms, share, least, held))
    kind = f"doc {dict(terms.dtypes)['doc']}, df long, term long, tf int"
    parts = partitions_for(spark, every, 2_000_000)
    rare = terms.mapInPandas(_occurrences(hot, False), kind).repartition(parts, "term").sortWithinPartitions("term").mapInPandas(_counted, kind)
    x = rare.unionByName(terms.mapInPandas(_occurrences(hot, True), kind)) if len(hot.value[0]) else rare
    return x.repartition(parts, "doc").mapInPandas(_pack(threshold, n), f"doc {dict(terms.dtypes)['doc']}, terms array<long>, w array<double>, rare array<long>, rw array<float>, k int, above array<float>")


def tfidf(df: DataFrame, ident: str, terms: Column, threshold: float) -> DataFrame:
    """The written vectors of texts, see ``vectors``."""
    table = materialize(term_table(df, ident, terms), "terms")
    out = materialize(vectors(table, df.select(F.col(ident).alias("doc")), threshold), "vectors")
    release(table)
    return out


@F.pandas_udf(DoubleType())
def _dot(a: pd.Series, wa: pd.Series, b: pd.Series, wb: pd.Series) -> pd.Series:
    """Dot products of sparse vectors with terms in ascending order: one merge per pair."""
    out = np.empty(len(a))
    for i, (x, p, y, q) in enumerate(zip(a, wa, b, wb)):
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        on = y[at] == x
        out[i] = float(np.dot(p[on], q[at[on]]))
    return pd.Series(out)


def candidates(vec: DataFrame, threshold: float, sides: DataFrame | None = None) -> DataFrame:
    """(i, j) of all pairs i < j that may have the cosine ``threshold``, see ``cosine_pairs``."""
    prefix = vec.select("doc", F.explode(F.arrays_zip("rare", "rw")).alias("p")).select("doc", F.col("p.rare").alias("term"), F.col("p.rw").alias("w"))
    cond = "a.term = b.term and a.doc < b.doc"
    if sides is not None:
        prefix = prefix.join(sides, "doc")
        cond += " and a.side <> b.side"
    cand = prefix.alias("a").join(prefix.alias("b"), F.expr(cond)).groupBy(F.col("a.doc").alias("i"), F.col("b.doc").alias("j")).agg(F.sum(F.col("a.w").cast("double") * F.col("b.w")).alias("met"))
    bound = vec.select("doc", "k", "above")
    cand = cand.join(bound.toDF("i", "ki", "ai"), "i").join(bound.toDF("j", "kj", "aj"), "j")
    k = F.least("ki", "kj")
    # Up to the smaller k both rare ends are whole; beyond it the product of the lengths bounds the rest. Weights and lengths are rounded to 32 bits.
    return cand.where(F.col("met") + F.get("ai", k).cast("double") * F.get("aj", k) >= threshold - 1e-5).select("i", "j")


def cosine_pairs(vec: DataFrame, threshold: float, sides: DataFrame | None = None) -> DataFrame:
    """The written (i, j, sim) of all pairs i < j with cosine ``threshold`` or more; exact.

    A pair that reaches the threshold shares a term of the rare end of both vectors: what is left of
    either is too short. Documents and then terms break ties of frequency, so both cut alike. The products under the rare ends and the lengths
    of what follows bound a candidate's cosine from above; what may reach the threshold is
    verified with the full dot product, merged from sorted arrays. ``vec`` is a written table of ``vectors`` for this
    threshold; ``sides`` (doc, side) restricts the pairs to documents of different sides.
    """
    cand = materialize(candidates(vec, threshold, sides), "candidates")
    # Only vectors of candidates travel: documents of a bucket without any stay. The number of buckets bounds the broadcast.
    bucket = F.pmod(F.xxhash64("doc"), F.lit(BUCKETS))
    held = cand.select(F.col("i").alias("doc")).union(cand.select("j")).select(bucket.alias("bucket")).distinct()
    flat = vec.select("doc", "terms", "w").withColumn("bucket", bucket).join(F.broadcast(held), "bucket", "left_semi").drop("bucket")
    both = cand.join(flat.toDF("i", "ti", "wi"), "i").join(flat.toDF("j", "tj", "wj"), "j")
    out = materialize(both.select("i", "j", _dot("ti", "wi", "tj", "wj").alias("sim")).where(F.col("sim") >= threshold - 1e-12), "similar")
    del both, flat, held
    release(cand)
    return out


def similar_pairs(df: DataFrame, ident: str, text: str, threshold: float = 0.8, chars: int | None = None) -> DataFrame:
    """The written pairs of documents by the cosine of word 1-2-grams, of the whole text unless ``chars`` states a prefix."""
    vec = tfidf(df.select(ident, text), ident, with_bigrams(near_tokens(F.col(text), chars)), threshold)
    out = cosine_pairs(vec, threshold)
    release(vec)
    return out


def near_duplicate_clusters(df: DataFrame, pairs: DataFrame, ident: str = "pos") -> DataFrame:
    """Adds cluster (the smallest identifier in it), cluster_size, mixed_labels and copy_no (1 for the first real row)."""
    comp = connected_components(pairs, "i", "j")
    c = df.join(comp.withColumnRenamed("node", ident), ident, "left").withColumn("cluster", F.coalesce("component", F.col(ident))).drop("component")
    w = Window.partitionBy("cluster")
    return (c.withColumn("cluster_size", F.count("*").over(w)).withColumn("mixed_labels", F.min("label").over(w) != F.max("label").over(w))
            .withColumn("copy_no", F.row_number().over(w.orderBy("is_synthetic", ident))))


def remove_near_duplicates(df: DataFrame, pairs: DataFrame, ident: str = "pos") -> DataFrame:
    c = near_duplicate_clusters(df, pairs, ident)
    return c.where(~F.col("mixed_labels") & (F.col("copy_no") == 1)).drop("cluster", "cluster_size", "mixed_labels", "copy_no")


def near_duplicate_report(clusters: DataFrame) -> DataFrame:
    several = F.col("cluster_size") > 1
    return clusters.agg(
        F.count("*").alias("rows"), F.count_if(several & (F.col("copy_no") == 1)).alias("clusters"), F.max("cluster_size").alias("largest"), F.count_if("mixed_labels").alias("mixed_label_rows"),
        F.count_if(~F.col("mixed_labels") & (F.col("copy_no") > 1)).alias("removed"))


def sensitivity(pairs: DataFrame, thresholds=(0.80, 0.90, 0.95)) -> DataFrame:
    """(threshold, pairs, removed) from one pair table made at the lowest threshold."""
    out = None
    for t in thresholds:
        p = pairs.where(F.col("sim") >= t - 1e-12)
        comp = connected_components(p, "i", "j")
        row = comp.agg((F.count("*") - F.countDistinct("component")).alias("removed")).crossJoin(p.agg(F.count("*").alias("pairs")))
        row = row.select(F.lit(float(t)).alias("threshold"), "pairs", "removed")
        out = row if out is None else out.unionByName(row)
    return out


def near_terms(df: DataFrame, ident: str, text: str, chars: int | None = None) -> DataFrame:
    """The written (doc, terms, tf) of a table, for ``cross_near_duplicates`` of any parts of it; of whole texts unless ``chars`` states a prefix."""
    return materialize(term_table(df.select(ident, text), ident, with_bigrams(near_tokens(F.col(text), chars))), "terms")


def cross_near_duplicates(new: DataFrame, reference: DataFrame, ident: str, text: str, threshold: float = 0.9, terms: DataFrame | None = None, chars: int | None = None) -> DataFrame:
    """(ident, exact, max_sim, flagged) for every row of ``new`` against ``reference``.

    The vectors are fitted on both together. Identifiers must differ between the two. ``terms`` (see ``near_terms``)
    of a table that holds both saves reading the texts again; without it ``chars`` may state a prefix.
    """
    sides = reference.select(F.col(ident).alias("doc"), F.lit(0).alias("side")).unionByName(new.select(F.col(ident).alias("doc"), F.lit(1).alias("side")))
    if terms is None:
        terms = near_terms(reference.select(ident, text).unionByName(new.select(ident, text)), ident, text, chars)
    own = materialize(terms.join(sides.select("doc"), "doc", "left_semi"), "terms")
    vec = materialize(vectors(own, sides, threshold), "vectors")
    release(own)
    p = cosine_pairs(vec, threshold, sides)
    release(vec)
    flat = p.select(F.col("i").alias("doc"), "sim").union(p.select("j", "sim"))
    best = flat.join(sides.where("side = 1"), "doc", "left_semi").groupBy("doc").agg(F.max("sim").alias("max_sim"))
    keys = reference.select(F.xxhash64(dedup_key(F.col(text))).alias("k")).distinct().withColumn("exact", F.lit(True))
    rows = new.select(F.col(ident), F.xxhash64(dedup_key(F.col(text))).alias("k")).join(keys, "k", "left").join(best.withColumnRenamed("doc", ident), ident, "left")
    exact = F.coalesce("exact", F.lit(False))
    return rows.select(ident, exact.alias("exact"), "max_sim", (exact | F.col("max_sim").isNotNull()).alias("flagged"))


def trim_cross_split(df: DataFrame, ident: str = "pos", text: str = "text", split: str = "split", threshold: float = 0.9, max_rounds: int = 10) -> tuple[DataFrame, int]:
    """Val and test rows that resemble another split are removed to a fixed point; train is never trimmed.

    Order: val against train, test against train, test against val; vectors are
    fitted anew each time.
    """
    now = materialize(df, "splits")
    terms = near_terms(now, ident, text)
    removed = 0
    size = {"train": 0, "val": 0, "test": 0}  # rows removed so far
    clean = {}
    for _ in range(max_rounds):
        hit = 0
        for held, ref in (("val", "train"), ("test", "train"), ("test", "val")):
            if clean.get((held, ref)) == (size[held], size[ref]):
                continue  # nothing was found, and neither has changed since
            flags = cross_near_duplicates(now.where(F.col(split) == held), now.where(F.col(split) == ref), ident, text, threshold, terms).where("flagged")
            bad = materialize(flags.select(ident), "leaks")
            n = bad.count()
            if n:
                left = materialize(now.join(bad, ident, "left_anti"), "splits")
                release(now)
                now = left
                size[held] += n
            else:
                clean[held, ref] = size[held], size[ref]
            release(bad)
            hit += n
        removed += hit
        if not hit:
            break
    release(terms)
    return now, removed


def leakage_audit(df: DataFrame, ident: str = "pos", text: str = "text", split: str = "split", threshold: float = 0.9, chars: int | None = None) -> DataFrame:
    """(held, reference, rows, near_duplicates, max_similarity) per pair of splits."""
    out = None
    terms = near_terms(df, ident, text, chars)
    for held, ref in (("val", "train"), ("test", "train"), ("test", "val")):
        r = cross_near_duplicates(df.where(F.col(split) == held), df.where(F.col(split) == ref), ident, text, threshold, terms)
        row = r.agg(F.count("*").alias("rows"), F.count_if("flagged").alias("near_duplicates"), F.round(F.max("max_sim"), 4).alias("max_similarity"))
        row = row.select(F.lit(held).alias("held"), F.lit(ref).alias("reference"), "rows", "near_duplicates", "max_similarity")
        out = row if out is None else out.unionByName(row)
    return out
