"""Words of a text, as hashes, and which of them are common in the corpus."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_EDGES = r"(?U)(?<!\S)[^\p{L}\p{M}\p{N}\s]+|[^\p{L}\p{M}\p{N}\s]+(?!\S)"


def word_array(text: Column) -> Column:
    """The pieces between white space in order, without case and outer punctuation.

    Null and blank texts give an empty array; pieces of punctuation alone vanish.
    """
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _EDGES, "")
    return F.filter(F.split(t, r"(?U)\s+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    """``word_array`` as 64-bit hashes, order and repeats kept."""
    return F.transform(word_array(text), lambda w: F.xxhash64(w))


def set_hash(words: Column) -> Column:
    """One hash of a set of word hashes, the same for every order."""
    return F.xxhash64(F.array_sort(words))


def common_words(sets: DataFrame, words: str, share: float, rows: int) -> np.ndarray:
    """Sorted hashes of the words that stand in more than ``share`` of the rows.

    ``sets`` holds arrays of distinct word hashes. Every word is counted over all
    rows, combined before the shuffle. At most (mean words per row) / ``share`` words
    can qualify, whatever the number of rows, so the result that reaches the
    driver is bounded.
    """
    least = max(2, int(np.ceil(share * rows)))
    hot = sets.select(F.explode(words).alias("w")).groupBy("w").count().where(F.col("count") > least).select("w")
    return np.sort(hot.toPandas()["w"].to_numpy(np.int64))


def is_common(flat: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Which hashes stand in a sorted array."""
    if not len(common):
        return np.zeros(len(flat), bool)
    return common[np.minimum(np.searchsorted(common, flat), len(common) - 1)] == flat


def hot_keys(keys: DataFrame, key: str, share: float, least: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, counts) of the keys that more than ``least`` rows, and more than ``share`` of all, hold.

    At most (mean keys per row) / ``share`` keys can qualify, whatever the number of rows.
    """
    found = keys.groupBy(key).count().where(F.col("count") > max(least, int(share * rows))).toPandas().sort_values(key)
    return found[key].to_numpy(np.int64), found["count"].to_numpy(np.int64)


def split_hot(row: np.ndarray, key: np.ndarray, flat: np.ndarray, offsets: np.ndarray, hot: np.ndarray, bands: int = 8, minima: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(index into ``row``, key): keys outside ``hot`` as they are, hot ones ``bands`` times.

    A piece of text that very many rows hold says little, so rows meet under it
    only where they also agree in the rest: every band joins the key with
    ``minima`` smallest hashes of the row's own words. Two rows of similarity j
    miss each other under a hot key with probability (1 - j**minima)**bands, drawn anew for every key: a first
    pass, after which the caller compares what found no partner with all rows of its hot keys.
    """
    on = is_common(key, hot)
    cold, at = np.flatnonzero(~on), np.flatnonzero(on)
    if not len(at):
        return cold, key[cold]
    out_i, out_k = [cold], [key[cold]]
    # Bounded pieces: a hot key of a long row reads all its words.
    size = np.diff(offsets)[row[at]]
    cuts = np.unique(np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + (1 << 20), 1 << 20)))
    for lo, hi in zip(cuts, [*cuts[1:], len(at)]):
        i, n = at[lo:hi], size[lo:hi]
        if not len(i):
            continue
        first = np.cumsum(n) - n
        word = np.repeat(offsets[row[i]] - first, n) + np.arange(int(n.sum()))
        own = mix(key[i].view(np.uint64), 47)
        x = mix(flat[word].view(np.uint64) ^ np.repeat(own, n), 5)
        for b in range(bands):
            k = own ^ np.uint64(b + 1)
            for m in range(minima):
                y = mix(x, 100 + b * minima + m)
                k = mix(k ^ np.minimum.reduceat(y, first), 7)
            out_i.append(i)
            out_k.append(k.view(np.int64))
    return np.concatenate(out_i), np.concatenate(out_k)


def flatten(arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A Series of int64 arrays as (flat values, offsets, lengths)."""
    arrays = [np.asarray(a if a is not None else (), dtype=np.int64) for a in arrays]
    lens = np.fromiter((len(a) for a in arrays), dtype=np.int64, count=len(arrays))
    flat = np.concatenate(arrays) if len(arrays) else np.zeros(0, np.int64)
    return flat, np.concatenate(([0], np.cumsum(lens))).astype(np.int64), lens


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (2**64 - 1))) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def verify_sets(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Keeps the (ha, hb) whose exact Jaccard similarity reaches ``threshold``."""
    need = pairs.select(F.col("ha").alias("h")).union(pairs.select("hb")).distinct()
    w = sets.select("h", "words").join(need, "h", "left_semi").dropDuplicates(["h"])
    both = pairs.join(w.select(F.col("h").alias("ha"), F.col("words").alias("wa")), "ha")
    both = both.join(w.select(F.col("h").alias("hb"), F.col("words").alias("wb")), "hb")
    inter = F.size(F.array_intersect("wa", "wb"))
    sim = inter / (F.size("wa") + F.size("wb") - inter)
    return both.select("ha", "hb", sim.alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
