"""The same or nearly the same records across splits (problem 4).

Texts become sequences of word hashes; a rolling hash, the sum over every three words, runs
over them, and of each window of such hashes the smallest is kept (winnowing). Texts of up to 32
words keep every hash, those of up to 48 the smallest of every four, longer ones of every eight, so that
any run of ten words two texts share leaves a common fingerprint. The fingerprints are
joined across the splits, every text once. Under one that very many texts hold, a
stock phrase, all are compared pair by pair (see ``crowds``). One common fingerprint is enough for a pair to be followed up.
A sketch whose distance never exceeds the difference of two word sets keeps
pairs apart that cannot be similar. The common fingerprints of the others are
seeds: they are chained along a diagonal, the chains are extended by alignment,
and pairs are reported with the coverage of both records.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, release
from .bitslice import odd_sketch
from .crowds import hot_rows, meet, wide_sketches
from .words import flatten, hot_keys, is_common, mix, word_array

GRAM = 3
#: (most words of a text, window): short texts have few fingerprints to lose.
WINDOWS = ((32, 1), (48, 4), (1 << 62, 8))
TRAIN, EVAL = 1, 2
_FP = "key long, h long, n int, s0 long, s1 long"
_LAST = np.uint64(2**64 - 1)


def fingerprints(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word position, key) of the kept fingerprints of every row with a word.

    A row of fewer than GRAM words is one gram, one of few grams one window.
    """
    lens = np.diff(offsets)
    total = len(flat)
    x = mix(flat.view(np.uint64), 11)
    row = np.repeat(np.arange(len(lens)), lens)
    inside = np.arange(total) - offsets[:-1][row]
    left = lens[row] - inside  # words from here to the end
    g = x.copy()
    for j in range(1, GRAM):
        nxt = np.zeros(total, np.uint64)
        nxt[:-j] = x[j:]
        g += np.where(left > j, nxt, np.uint64(0))
    starts = (left >= GRAM) | (inside == 0)
    rank = mix(g, 13) >> np.uint64(1)
    rank[~starts] = _LAST
    window = np.zeros(len(lens), np.int64)
    low = 0
    for most, w in WINDOWS:
        window[(lens > low) & (lens <= most)] = w
        low = most
    best, where = rank.copy(), np.arange(total)
    for j in range(1, max(w for _, w in WINDOWS)):
        nxt = np.full(total, _LAST)
        nxt[:-j] = rank[j:]
        better = (left > j) & (window[row] > j) & (nxt <= best) & (nxt != _LAST)
        best = np.where(better, nxt, best)
        where = np.where(better, np.arange(total) + j, where)
    # Only full windows count, but a short text has one window.
    grams = np.maximum(lens - GRAM + 1, 1)
    full = inside <= np.maximum(grams - window, 0)[row]
    at = np.unique(where[full & starts])
    return row[at], inside[at], mix(g[at], 19).view(np.int64)


def _rows(hot_b):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            flat, offsets, _ = flatten(pdf["words"])
            sets, bounds, _ = flatten([np.unique(w) for w in pdf["words"]])
            sk = odd_sketch(sets, bounds).view(np.int64)
            i, p, key = fingerprints(flat, offsets)
            if hot_b is not None:
                cold = ~is_common(key, hot_b.value[0])
                i, p, key = i[cold], p[cold], key[cold]
            yield pd.DataFrame({"key": key, "h": pdf["h"].to_numpy()[i], "n": pdf["n"].to_numpy(np.int32)[i], "s0": sk[i, 0], "s1": sk[i, 1]}).drop_duplicates(["key", "h"])

    return run


def _crowded(hot_b):
    """Rows of the texts' stock phrases for ``meet``."""

    def rows(side: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                i, _, key = fingerprints(*flatten(pdf["words"])[:2])
                on = is_common(key, hot_b.value[0])
                i, key = i[on], key[on]
                if len(i):
                    sk = wide_sketches(*flatten([np.unique(w) for w in pdf["words"]])[:2])
                    yield hot_rows(key, pdf["h"].to_numpy()[i], pdf["n"].to_numpy()[i], side, [sk[j] for j in i], hot_b.value)

        return run

    return rows


def longest_chain(pa: np.ndarray, pb: np.ndarray) -> list[tuple[int, int]]:
    """The longest chain of seeds that rise in both records."""
    seeds = sorted(set(zip(pa.tolist(), pb.tolist())), key=lambda s: (s[0], -s[1]))
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(seeds)
    for i, (_, y) in enumerate(seeds):
        lo, hi = 0, len(tails)
        while lo < hi:
            mid = (lo + hi) // 2
            if tails[mid] < y:
                lo = mid + 1
            else:
                hi = mid
        back[i] = at[lo - 1] if lo else -1
        if lo == len(tails):
            tails.append(y)
            at.append(i)
        else:
            tails[lo], at[lo] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(seeds[i])
        i = back[i]
    return out[::-1]


def chains(pa: np.ndarray, pb: np.ndarray) -> list[list[tuple[int, int]]]:
    """Collinear chains until no seeds are left: moved parts make chains of their own."""
    left = set(zip(pa.tolist(), pb.tolist()))
    out = []
    while left:
        a, b = np.array([s[0] for s in left]), np.array([s[1] for s in left])
        c = longest_chain(a, b)
        out.append(c)
        left -= set(c)
        used_a, used_b = {s[0] for s in c}, {s[1] for s in c}
        left = {s for s in left if s[0] not in used_a and s[1] not in used_b}
    return out


def extend(wa: np.ndarray, wb: np.ndarray, found: list[list[tuple[int, int]]]) -> tuple[float, float]:
    """Coverage of both records: seeds grown word by word, over single changed words."""
    ca, cb = np.zeros(len(wa), bool), np.zeros(len(wb), bool)
    for chain in found:
        for x, y in chain:
            for d in (1, -1):
                i, j = (x, y) if d == 1 else (x - 1, y - 1)
                while 0 <= i < len(wa) and 0 <= j < len(wb):
                    if wa[i] == wb[j]:
                        if ca[i] and cb[j] and (i, j) != (x, y):
                            break
                        ca[i] = cb[j] = True
                        i, j = i + d, j + d
                        continue
                    for si, sj in ((1, 1), (1, 0), (0, 1)):
                        u, v = i + si * d, j + sj * d
                        u2, v2 = u + d, v + d
                        if 0 <= u2 < len(wa) and 0 <= v2 < len(wb) and wa[u] == wb[v] and wa[u2] == wb[v2]:
                            i, j = u, v
                            break
                    else:
                        break
    return float(ca.mean()) if len(ca) else 0.0, float(cb.mean()) if len(cb) else 0.0


def common_seeds(fa: tuple[np.ndarray, np.ndarray], fb: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Word positions in both records of every pair of equal fingerprints, given as (positions, keys)."""
    (pa, ka), (pb, kb) = fa, fb
    order = np.argsort(kb, kind="stable")
    lo, hi = np.searchsorted(kb[order], ka), np.searchsorted(kb[order], ka, "right")
    n = hi - lo
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    return np.repeat(pa, n), pb[order][at]


def _align(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kept = []
            for ha, hb, wa, wb in zip(pdf["ha"], pdf["hb"], pdf["wa"], pdf["wb"]):
                sa, sb = set(wa.tolist()), set(wb.tolist())
                both = len(sa & sb)
                sim = both / (len(sa) + len(sb) - both)
                if sim >= threshold - 1e-12:
                    kept.append((ha, hb, sim, wa, wb))
            out, prints = [], []
            if kept:
                row, at, key = fingerprints(*flatten([w for k in kept for w in k[3:]])[:2])
                cut = np.searchsorted(row, np.arange(2 * len(kept) + 1))
                prints = [(at[s:e], key[s:e]) for s, e in zip(cut[:-1], cut[1:])]
            for (ha, hb, sim, wa, wb), fa, fb in zip(kept, prints[::2], prints[1::2]):
                c = chains(*common_seeds(fa, fb))
                out.append((ha, hb, sim, *extend(wa, wb, c), sum(map(len, c))))
            yield pd.DataFrame(out, columns=["ha", "hb", "similarity", "cover_a", "cover_b", "seeds"]).astype(
                {"ha": "int64", "hb": "int64", "similarity": float, "cover_a": float, "cover_b": float, "seeds": "int32"})

    return run


def split_overlaps(df: DataFrame, ident: str = "pos", text: str = "text", split: str = "split", train: str = "train",
                   others: tuple[str, ...] = ("val", "test"), threshold: float = 0.7, share: float = 1e-4, least: int = 256) -> DataFrame:
    """(a, b, similarity, cover_a, cover_b, seeds): train row a, other row b.

    One row per pair of a train row and a row of the other splits whose word
    sets are similar to ``threshold`` or more. Copies of one text have the
    similarity and coverage 1. Rows without a split, and null, blank or
    wordless texts, overlap with nothing. ``share`` and ``least`` say which
    fingerprints count as stock phrases: at most (fingerprints per text) / ``share``,
    which bounds what is sent to the workers. They change the work, not the pairs.
    """
    spark = df.sparkSession
    side = F.when(F.col(split) == train, F.lit(TRAIN)).when(F.col(split).isin(*others), F.lit(EVAL))
    base = df.select(F.col(ident).alias("i"), side.cast("byte").alias("side"), word_array(F.col(text)).alias("words")).where("side is not null")
    # Words are hashed to 32 bits: two different words of a pair look alike once in 2**32 times, and the texts travel at half the size.
    base = base.select("i", "side", F.xxhash64("words").alias("h"), F.transform("words", lambda w: F.hash(w)).alias("words"))
    base = materialize(base.withColumn("n", F.size(F.array_distinct("words"))).where("n > 0"), "texts")
    m = materialize(base.select("i", "h", "side"), "members")
    # Every text once a side: with copies a fingerprint would be met as often as the product of its copies.
    once = materialize(base.groupBy("h", "side").agg(F.first("n").alias("n"), F.first("words").alias("words")), "once")
    release(base)
    of = {v: once.where(f"side = {v}") for v in (TRAIN, EVAL)}
    count = once.count()
    hot = spark.sparkContext.broadcast(hot_keys(once.mapInPandas(_rows(None), _FP), "key", share, least, count))
    # The distance of two odd sketches never exceeds the difference of the sets, so nothing similar is passed over.
    slope = (1 - threshold) / (1 + threshold)
    near = f"bit_count(x.s0 ^ y.s0) + bit_count(x.s1 ^ y.s1) <= {slope} * (x.n + y.n) + 1e-9 and least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9"
    # A plain join: a crowded key makes a skewed partition, which the adaptive plan splits.
    x, y = (of[v].mapInPandas(_rows(hot), _FP) for v in (TRAIN, EVAL))
    pairs = x.alias("x").join(y.alias("y"), F.expr(f"x.key = y.key and x.h <> y.h and {near}")).select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb"))
    if len(hot.value[0]):
        pairs = pairs.unionByName(meet(of[TRAIN], of[EVAL], _crowded(hot), threshold, int(hot.value[1].sum())))
    pairs = materialize(pairs.distinct(), "seeded")
    full = pairs.join(of[TRAIN].select(F.col("h").alias("ha"), F.col("words").alias("wa")), "ha")
    full = full.join(of[EVAL].select(F.col("h").alias("hb"), F.col("words").alias("wb")), "hb")
    aligned = materialize(full.mapInPandas(_align(threshold), "ha long, hb long, similarity double, cover_a double, cover_b double, seeds int"), "aligned")
    release(pairs, once)
    left = m.where(f"side = {TRAIN}").select(F.col("i").alias("a"), F.col("h").alias("ha"))
    right = m.where(f"side = {EVAL}").select(F.col("i").alias("b"), F.col("h").alias("hb"))
    one = F.lit(1.0)
    same = left.join(right, F.col("ha") == F.col("hb")).select("a", "b", one.alias("similarity"), one.alias("cover_a"), one.alias("cover_b"), F.lit(0).alias("seeds"))
    return same.unionByName(aligned.join(left, "ha").join(right, "hb").select("a", "b", "similarity", "cover_a", "cover_b", "seeds"))


def overlap_report(df: DataFrame, overlaps: DataFrame, ident: str = "pos", split: str = "split", source: str = "source") -> DataFrame:
    """(split, source, rows, overlapped_rows, pairs, mean_coverage) of the rows outside train.

    Coverage is a record's best over its pairs. Every split and source of ``df`` has a row.
    """
    per = overlaps.groupBy(F.col("b").alias(ident)).agg(F.count("*").alias("k"), F.max("cover_b").alias("c"))
    return (
        df.where(F.col(split).isNotNull()).select(ident, split, source).join(per, ident, "left")
        .groupBy(split, source)
        .agg(F.count("*").alias("rows"), F.count("k").alias("overlapped_rows"), F.coalesce(F.sum("k"), F.lit(0)).alias("pairs"), F.avg("c").alias("mean_coverage"))
    )
