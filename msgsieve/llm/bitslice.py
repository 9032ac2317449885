"""Near-duplicate records by bit-sliced comparison of set sketches (problem 1).

Every distinct word set gets a 128-bit odd sketch: bit i is the parity of the
words that hash to i. The Hamming distance of two odd sketches never exceeds
the size of the sets' symmetric difference, and sets with a Jaccard similarity
of t or more differ in at most (1-t)/(1+t) * (|A|+|B|) words. Comparing the
distance with that radius therefore drops no true pair.

Records meet in blocks: minwise band keys, in which the words common in the
corpus weigh little. Inside a block the sketches are stored as vertical bit
planes; XOR of the planes with the planes shifted by s records compares every
record with the one s places on, 64 pairs per machine word. Carry-save counters
add up the planes, and after each group of planes the words in which every pair
has passed its radius are abandoned. Survivors are verified on the word sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize, partitions_for
from ..operators.graph import connected_components
from .words import common_words, flatten, is_common, mix as _mix, set_hash, verify_sets, word_hashes

BITS = 128
PLANES_PER_STEP = 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def odd_sketch(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(n, 2) uint64: parities of the words' bits."""
    x = _mix(flat.view(np.uint64), 77)
    bit = np.uint64(1) << (x & np.uint64(63))
    high = (x >> np.uint64(6)) & np.uint64(1) == 1
    n = len(offsets) - 1
    out = np.zeros((n, 2), np.uint64)
    some = np.flatnonzero(offsets[1:] > offsets[:-1])
    if len(some):
        at = offsets[:-1][some]
        out[some, 0] = np.bitwise_xor.reduceat(np.where(high, np.uint64(0), bit), at)
        out[some, 1] = np.bitwise_xor.reduceat(np.where(high, bit, np.uint64(0)), at)
    return out


def min_keys(x: np.ndarray, at: np.ndarray, drop: np.ndarray | np.uint64, bands: int, rows: int, seed: int) -> np.ndarray:
    """(n, bands) keys of ``rows`` minima each; ``drop`` is the shift that sets a word's weight."""
    keys = np.zeros((len(at), bands), np.uint64)
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 2**63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    for b in range(bands):
        k = np.full(len(at), np.uint64(seed + b))
        for r in range(rows):
            y = x * factors[b * rows + r]
            y ^= y >> np.uint64(31)
            y *= _ODD
            y >>= drop
            k = _mix(k ^ np.minimum.reduceat(y, at), 3 + r)
        keys[:, b] = k
    return keys


def band_keys(flat: np.ndarray, offsets: np.ndarray, common: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every band of every row, by row; every row must hold at least one word.

    Every row gets as many bands again over evenly weighted words, of ``rows`` + 2
    minima each: the words of a message with very many copies are common, and
    only what was edited is rare, so that weights alone tell copies apart.
    """
    x = _mix(flat.view(np.uint64), 1)
    known = is_common(flat, common)
    at, n = offsets[:-1], len(offsets) - 1
    # Common words weigh 1/64: the top 6 bits of a rare word's draw are cleared.
    keys = min_keys(x, at, np.where(known, np.uint64(32), np.uint64(38)), bands, rows, 20240229)
    even = min_keys(x, at, np.uint64(32), bands, rows + 2, 20240301)
    return np.repeat(np.arange(n), 2 * bands), np.concatenate([keys, even], axis=1).ravel().view(np.int64)


def _planes(bits: np.ndarray, n: int, width: int) -> np.ndarray:
    """(width, words) uint64 from an (n, width) array of 0/1 bytes."""
    words = -(-n // 64)
    full = np.zeros((width, words * 64), np.uint8)
    full[:, :n] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view(np.uint64)


def _number_planes(values: np.ndarray, width: int) -> np.ndarray:
    v = values.astype(np.int64)
    return _planes(((v[:, None] >> np.arange(width)) & 1).astype(np.uint8), len(v), width)


def _shifted(planes: np.ndarray, s: int, words: np.ndarray) -> np.ndarray:
    """Planes in which lane i holds what lane i+s held, for the words asked for."""
    q, r = divmod(s, 64)
    total = planes.shape[1]

    def at(w):
        return np.where(w < total, planes[:, np.minimum(w, total - 1)], np.uint64(0))

    low = at(words + q)
    return low if not r else (low >> np.uint64(r)) | (at(words + q + 1) << np.uint64(64 - r))


def _within(counter: list[np.ndarray], radius: np.ndarray) -> np.ndarray:
    """Lanes whose bit-sliced count is at most their bit-sliced radius."""
    less = np.zeros_like(counter[0])
    equal = ~less
    for j in range(len(counter) - 1, -1, -1):
        less |= equal & ~counter[j] & radius[j]
        equal &= ~(counter[j] ^ radius[j])
    return less | equal


def sliced_pairs(key: np.ndarray, ident: np.ndarray, sketch: np.ndarray, size: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of records of one key that may reach ``threshold``.

    All arrays are sorted by key. No pair within the radius is left out.
    """
    n = len(key)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    run = np.repeat(new[1:], np.diff(new)) - np.arange(n)  # records from here to the block's end
    bits = np.unpackbits(np.ascontiguousarray(sketch).view(np.uint8).reshape(n, BITS // 8), axis=1, bitorder="little")
    planes = _planes(bits, n, BITS)
    width = BITS.bit_length()
    slope = (1 - threshold) / (1 + threshold)
    left, right = [], []
    for s in range(1, int(run.max())):
        a = np.flatnonzero(run > s)
        small, large = np.minimum(size[a], size[a + s]), np.maximum(size[a], size[a + s])
        a = a[small >= threshold * large - 1e-9]
        if not len(a):
            continue
        lanes = np.zeros(planes.shape[1] * 64, np.uint8)
        lanes[a] = 1
        valid = np.packbits(lanes, bitorder="little").view(np.uint64)
        words = np.flatnonzero(valid)
        alive = valid[words]
        cells = (words[:, None] * 64 + np.arange(64)).ravel()
        near, far = np.minimum(cells, n - 1), np.minimum(cells + s, n - 1)
        limit = np.minimum(np.floor(slope * (size[near].astype(np.int64) + size[far]) + 1e-9), (1 << width) - 1)
        radius = list(_number_planes(limit, width))
        diff = planes[:, words] ^ _shifted(planes, s, words)
        counter = [np.zeros(len(words), np.uint64) for _ in range(width)]
        for start in range(0, BITS, PLANES_PER_STEP):
            for p in range(start, start + PLANES_PER_STEP, 3):
                # Carry-save: three planes make a sum and a carry.
                x = diff[p]
                y = diff[p + 1] if p + 1 < start + PLANES_PER_STEP else None
                z = diff[p + 2] if p + 2 < start + PLANES_PER_STEP else None
                if y is None:
                    total, carry = x, None
                elif z is None:
                    total, carry = x ^ y, x & y
                else:
                    u = x ^ y
                    total, carry = u ^ z, (x & y) | (u & z)
                for first, add in ((0, total), (1, carry)):
                    for j in range(first, width):
                        if add is None or (j > first + 1 and not add.any()):
                            break
                        counter[j], add = counter[j] ^ add, counter[j] & add
            alive &= _within(counter, radius)
            keep = np.flatnonzero(alive)
            if not len(keep):
                break
            if len(keep) < len(alive):
                alive, words, diff = alive[keep], words[keep], diff[:, keep]
                counter, radius = [c[keep] for c in counter], [r[keep] for r in radius]
        if alive.any():
            on = np.unpackbits(alive.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
            i = (words[:, None] * 64 + np.arange(64))[on]
            left.append(i)
            right.append(i + s)
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


_BAND = "key long, h long, s0 long, s1 long, n int"


def _band_rows(common_b, bands: int, rows: int, hot_b, sample: int = 1):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common, hot = common_b.value, hot_b.value if hot_b is not None else None
        seen: set[int] = set()
        for pdf in batches:
            pdf = pdf[pdf["n"] > 0].drop_duplicates("h")
            pdf = pdf[~pdf["h"].isin(seen)]
            if sample > 1:
                pdf = pdf[pdf["h"] % sample == 0]
            seen.update(pdf["h"])
            if not len(pdf):
                continue
            flat, offsets, lens = flatten(pdf["words"])
            idx, k = band_keys(flat, offsets, common, bands, rows)
            sk = odd_sketch(flat, offsets).view(np.int64)
            h = pdf["h"].to_numpy()
            if hot is not None and len(hot[0]):
                k, idx = _spread(k, h[idx], idx, hot)
            yield pd.DataFrame({"key": k, "h": h[idx], "s0": sk[idx, 0], "s1": sk[idx, 1], "n": lens[idx].astype(np.int32)})

    return run


def _spread(k: np.ndarray, h: np.ndarray, idx: np.ndarray, hot) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hot keys go to the cells (salt, *) and (*, salt) of a grid over the key."""
    keys, grid = hot
    at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
    g = np.where(keys[at] == k, grid[at], 1)
    out_k, out_i = [k[g == 1]], [idx[g == 1]]
    for cells in np.unique(g[g > 1]):
        on = g == cells
        salt = (_mix(h[on].view(np.uint64), 5) % np.uint64(cells)).astype(np.int64)
        for other in range(int(cells)):
            a, b = np.minimum(salt, other), np.maximum(salt, other)
            out_k.append(_mix((k[on] ^ (a * 1_000_003 + b + 1)).view(np.uint64), 9).view(np.int64))
            out_i.append(idx[on])
    return np.concatenate(out_k), np.concatenate(out_i)


def _meet(threshold: float, chunk: int = 1 << 16):
    """Pairs of the records of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [p for p in batches if len(p)]
        if not parts:
            return
        cols = {c: np.concatenate([p[c].to_numpy() for p in parts]) for c in ("key", "h", "s0", "s1", "n")}
        del parts
        # Most keys are one row's alone: they go before the full sort.
        order = np.argsort(cols["key"])
        key = cols["key"][order]
        same = np.concatenate(([False], key[1:] == key[:-1]))
        order = order[same | np.concatenate((same[1:], [False]))]
        cols = {c: v[order] for c, v in cols.items()}
        if not len(order):
            return
        order = np.lexsort((cols["h"], cols["key"]))
        cols = {c: v[order] for c, v in cols.items()}
        key, h = cols["key"], cols["h"]
        first = np.concatenate(([True], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
        same = np.concatenate(([False], key[1:] == key[:-1]))
        lonely = ~(same | np.concatenate((same[1:], [False])))
        keep = np.flatnonzero(first & ~lonely)
        cols = {c: v[keep] for c, v in cols.items()}
        key = cols["key"]
        if not len(key):
            return
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        at, n = 0, len(key)
        found_a, found_b = [], []
        while at < n:
            end = n
            if n - at > chunk:
                j = np.searchsorted(starts, at + chunk, side="right")
                end = int(starts[j]) if j < len(starts) else n
            sl = slice(at, end)
            sk = np.stack([cols["s0"][sl], cols["s1"][sl]], axis=1)
            i, j = sliced_pairs(key[sl], cols["h"][sl], sk, cols["n"][sl], threshold)
            found_a.append(cols["h"][sl][i])
            found_b.append(cols["h"][sl][j])
            at = end
        a, b = np.concatenate(found_a), np.concatenate(found_b)
        if len(a):
            # The records are sorted by h inside a key, so a < b.
            yield pd.DataFrame({"ha": a, "hb": b}).drop_duplicates()

    return run


def word_sets(df: DataFrame, ident: str, text: str) -> DataFrame:
    """(ident, h, words, n): distinct word hashes of every row with a text."""
    w = F.array_distinct(word_hashes(F.col(text)))
    return df.select(ident, w.alias("words")).select(ident, set_hash(F.col("words")).alias("h"), "words", F.size("words").alias("n"))


def similar_sets(
    sets: DataFrame, threshold: float = 0.7, bands: int = 32, rows: int = 3, common_share: float = 0.002, hot_rows: int = 4096
) -> DataFrame:
    """(ha, hb, similarity): pairs of different word sets, ha < hb, verified on the sets.

    ``sets`` comes from ``word_sets``, written out. ``bands``/``rows`` fix the
    blocks: two sets whose weighted similarity is s miss each other in all of
    them with probability (1 - s**rows)**bands, and two of similarity j in as many evenly weighted ones
    with (1 - j**(rows + 2))**bands. Keys that a sample of the sets
    shows to hold more than ``hot_rows`` sets are spread over a grid of cells,
    so that no task gets a whole hot key; the sample steers the layout only.
    Sets without words form no pair.
    """
    spark = sets.sparkSession
    total = sets.count()
    common = spark.sparkContext.broadcast(common_words(sets, "words", common_share, total))
    source = sets.select("h", "words", "n")
    sample = max(1, total // 20_000)
    least = max(hot_rows, total // 10_000) / sample
    hot = (
        source.mapInPandas(_band_rows(common, bands, rows, None, sample), _BAND)
        .groupBy("key").count().where(F.col("count") >= max(least, 8)).toPandas().sort_values("key")
    )
    grid = np.ceil(np.sqrt(hot["count"].to_numpy() * sample / hot_rows)).astype(np.int64) + 1
    hot_b = spark.sparkContext.broadcast((hot["key"].to_numpy(np.int64), grid))
    cells = source.mapInPandas(_band_rows(common, bands, rows, hot_b), _BAND)
    # A task holds the keys of its partition at once, so their number follows the input.
    cells = cells.repartition(partitions_for(spark, total * 2 * bands, 4_000_000), "key")
    pairs = materialize(cells.mapInPandas(_meet(threshold), "ha long, hb long").distinct(), "pairs")
    return verify_sets(pairs, sets, threshold)


def near_duplicate_pairs(df: DataFrame, ident: str = "pos", text: str = "text", threshold: float = 0.7, **kw) -> DataFrame:
    """(ident_a, ident_b), a < b: all pairs of rows that are the same or nearly so.

    Rows with null, blank or wordless texts pair with nothing. Rows of one word
    set are similar with 1. Extra columns are ignored; repeated identifiers
    would pair rows of one identifier and are left out of such pairs.
    """
    sets = materialize(word_sets(df, ident, text), "sets")
    near = similar_sets(sets, threshold, **kw)
    m = sets.where("n > 0").select(F.col(ident).alias("i"), "h")
    copies = m.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    same = m.join(copies, "h", "left_semi")
    own = same.alias("x").join(same.alias("y"), F.expr("x.h = y.h and x.i < y.i")).select(F.col("x.i").alias("a"), F.col("y.i").alias("b"))
    cross = (
        near.join(m.select(F.col("h").alias("ha"), F.col("i").alias("x")), "ha")
        .join(m.select(F.col("h").alias("hb"), F.col("i").alias("y")), "hb")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .where("a < b")
    )
    return own.unionByName(cross).select(F.col("a").alias(f"{ident}_a"), F.col("b").alias(f"{ident}_b"))


def near_duplicate_classes(df: DataFrame, ident: str = "pos", text: str = "text", threshold: float = 0.7, **kw) -> DataFrame:
    """One row per row of ``df``: (ident, class_id, class_rows, links).

    ``links`` counts the row's links to rows of other texts; ``class_id`` is the smallest identifier of
    the class. Copies of one word set share class and links without being
    paired. A row without words is its own class.
    """
    sets = materialize(word_sets(df, ident, text), "sets")
    near = materialize(similar_sets(sets, threshold, **kw), "near")
    weight = sets.where("n > 0").groupBy("h").agg(F.count("*").alias("c"))
    both = near.select(F.col("ha").alias("h"), F.col("hb").alias("o")).union(near.select("hb", "ha"))
    links = both.join(weight.withColumnRenamed("h", "o"), "o").groupBy("h").agg(F.sum("c").alias("other"))
    comp = connected_components(near, "ha", "hb")
    rows = (
        sets.select(ident, "h", "n")
        .join(comp.withColumnRenamed("node", "h"), "h", "left")
        .join(links, "h", "left")
    )
    group = F.when(F.col("n") > 0, F.coalesce("component", "h"))
    rows = rows.select(ident, group.alias("g"), F.coalesce("other", F.lit(0)).cast("long").alias("links"))
    size = rows.where("g is not null").groupBy("g").agg(F.min(ident).alias("class_id"), F.count("*").alias("class_rows"))
    return rows.join(size, "g", "left").select(
        ident, F.coalesce("class_id", F.col(ident)).alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"), "links"
    )
