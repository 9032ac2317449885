"""All similar pairs under keys that very many texts hold.

A band or a prefix of rare words passes over pairs or keeps nearly all of them here: texts made of stock phrases share their
common words too. So a crowd's texts are compared pair by pair, as odd sketches in tiles that fit the cache, ordered by the
number of words, so that tiles of sizes too far apart fall away. A sketch's distance never exceeds the difference of the sets,
so nothing similar is passed over. The work grows with the square of a crowd, at a few nanoseconds a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import partitions_for
from .words import mix

#: Words that a sketch of 128 bits keeps apart; longer texts have sketches of twice, four times, ... the bits.
WORDS = 80
#: Rows of a crowd in one cell of its grid.
CELL = 65_536
_ROW = "key long, h long, n int, side byte, sk binary"


def wide_sketches(flat: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """Odd sketches of rows of distinct words, of 128 bits for every ``WORDS`` words in powers of two; empty rows have none set."""
    lens = np.diff(offsets)
    level = np.ceil(np.log2(np.maximum(lens / WORDS, 1))).astype(np.int64)
    bits = 128 << level
    end = np.cumsum(bits)
    row = np.repeat(np.arange(len(lens)), lens)
    at = (mix(flat.view(np.uint64), 83) & (bits[row] - 1).astype(np.uint64)).astype(np.int64) + (end - bits)[row]
    odd = np.packbits((np.bincount(at, minlength=int(end[-1]) if len(end) else 0) & 1).astype(np.uint8), bitorder="little").tobytes()
    return [odd[e - b : e] for e, b in zip((end // 8).tolist(), (bits // 8).tolist())]


def hot_rows(key: np.ndarray, h: np.ndarray, n: np.ndarray, side: int, sk: list[bytes], hot: tuple[np.ndarray, np.ndarray], rank: np.ndarray | None = None) -> pd.DataFrame:
    """Rows for ``meet`` of keys that all stand in ``hot`` (sorted keys, counts): a large crowd is cut into a grid whose cells cover all pairs."""
    blocks = np.maximum(-(-hot[1][np.searchsorted(hot[0], key)] // CELL), 1)
    own = (mix(h.view(np.uint64), 89) % blocks.astype(np.uint64)).astype(np.int64)
    i = np.repeat(np.arange(len(key)), blocks)
    other = np.arange(len(i)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cell = own[i] * blocks[i] + other if side else other * blocks[i] + own[i]
    k = np.where(blocks[i] == 1, key[i], mix(key[i].view(np.uint64) ^ mix(cell.astype(np.uint64), 97), 101).view(np.int64))
    out = pd.DataFrame({"key": k, "h": h[i], "n": n[i].astype(np.int32), "side": np.full(len(i), side, np.int8), "sk": np.array(sk, dtype=object)[i] if len(i) else np.zeros(0, object)})
    if rank is not None:
        out["rank"] = rank[i].astype(np.int32)
    return out.drop_duplicates(["key", "h"])


def _levels(n: np.ndarray, sk: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows by rising size, their sketches as words) for every length of sketch."""
    size = np.fromiter(map(len, sk), np.int64, len(sk))
    out = []
    for s in np.unique(size):
        at = np.flatnonzero(size == s)
        at = at[np.argsort(n[at], kind="stable")]
        out.append((at, np.frombuffer(b"".join(sk[at]), np.uint64).reshape(len(at), -1)))
    return out


def _fold(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


def close_pairs(n0: np.ndarray, sk0: np.ndarray, n1: np.ndarray, sk1: np.ndarray, threshold: float, tile: tuple[int, int] = (256, 1024), ranks: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row of the first, row of the second) of all pairs whose sketches and sizes allow the similarity ``threshold``, with ``ranks`` of both only where the second's is lower."""
    slope = (1 - threshold) / (1 + threshold)
    left, right = [], []
    for i0, s0 in _levels(n0, sk0):
        for i1, s1 in _levels(n1, sk1):
            width = min(s0.shape[1], s1.shape[1])
            a, b, na, nb = _fold(s0, width), np.ascontiguousarray(_fold(s1, width).T), n0[i0], n1[i1]
            for x in range(0, len(a), tile[0]):
                u, nu = a[x : x + tile[0]], na[x : x + tile[0]]
                lo, hi = np.searchsorted(nb, threshold * nu[0] - 1e-6), np.searchsorted(nb, nu[-1] / threshold + 1e-6, "right")
                for y in range(lo, hi, tile[1]):
                    v, nv = b[:, y : min(y + tile[1], hi)], nb[y : min(y + tile[1], hi)]
                    d = np.bitwise_count(u[:, :1] ^ v[0])
                    if width > 2:
                        d = d.astype(np.uint16)
                    for k in range(1, width):
                        d += np.bitwise_count(u[:, k : k + 1] ^ v[k])
                    p, q = np.divmod(np.flatnonzero(d <= slope * (int(nu[-1]) + int(nv[-1])) + 1e-9), len(nv))
                    if len(p):
                        on = (d[p, q] <= slope * (nu[p] + nv[q]) + 1e-9) & (np.minimum(nu[p], nv[q]) >= threshold * np.maximum(nu[p], nv[q]) - 1e-9)
                        if ranks is not None:
                            on &= ranks[0][i0[x + p]] > ranks[1][i1[y + q]]
                        left.append(i0[x + p[on]])
                        right.append(i1[y + q[on]])
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _meet(threshold: float, ranked: bool = False):
    def groups(parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = {k: np.concatenate([p[k].to_numpy() for p in parts]) for k in ("key", "h", "n", "side", "sk", *["rank"] * ranked)}
        start = np.flatnonzero(np.concatenate(([True], c["key"][1:] != c["key"][:-1])))
        for s, e in zip(start, [*start[1:], len(c["key"])]):
            one = c["side"][s:e] == 1
            x, y = np.flatnonzero(~one) + s, np.flatnonzero(one) + s
            if len(x) and len(y):
                p, q = close_pairs(c["n"][x], c["sk"][x], c["n"][y], c["sk"][y], threshold, ranks=(c["rank"][x], c["rank"][y]) if ranked else None)
                p, q = x[p], y[q]
                on = c["h"][p] != c["h"][q]
                if on.any():
                    yield pd.DataFrame({"ha": c["h"][p[on]], "hb": c["h"][q[on]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            key = pdf["key"].to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if parts and (cut or parts[-1]["key"].iloc[-1] != key[-1]):
                yield from groups([*parts, pdf.iloc[:cut]])
                parts = []
            elif cut:
                yield from groups([pdf.iloc[:cut]])
            parts.append(pdf.iloc[cut:])
        if parts:
            yield from groups(parts)

    return run


def meet(first: DataFrame, second: DataFrame, rows: Callable, threshold: float, number: int, ranked: bool = False) -> DataFrame:
    """(ha, hb), with repeats: pairs of a text of ``first`` and one of ``second`` that share a hot key and may be similar.

    ``rows(side)`` gives the ``hot_rows`` of texts; ``number`` is about how many there are. ``ranked`` rows have a
    rank: only pairs whose second text has the lower one count.
    """
    kind = _ROW + ", rank int" * ranked
    both = first.mapInPandas(rows(0), kind).unionByName(second.mapInPandas(rows(1), kind))
    cores = first.sparkSession.sparkContext.defaultParallelism
    parts = max(2 * cores, partitions_for(first.sparkSession, number, 500_000))
    return both.repartition(parts, "key").sortWithinPartitions("key").mapInPandas(_meet(threshold, ranked), "ha long, hb long")
