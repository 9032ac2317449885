"""Batches against everything accepted before (problem 6).

Two tables bucketed by their hash hold the history: the normalised content of
every text (with its words) by content hash, and the hashes of its paragraphs
by paragraph hash. A message is mostly one physical paragraph, so paragraphs
are content-defined: they end after words picked by their own hash and hold
at least a few words, which makes them survive edits elsewhere in the text.

A batch is taken bucket by bucket: a semi-join on the content hash finds full
copies, the hashes of what is new are appended, and a join on the paragraph hash finds the
texts of earlier ingests that share paragraphs. A sketch beside the hash keeps
pairs apart that cannot be similar; those whose word sets reach the threshold
are near copies. The history is never shuffled or hashed again. A batch may hold several ingests, which are then
checked against each other as well, in their order.

A paragraph of very many texts is a stock phrase; its texts meet first where they also
agree in the smallest hashes of their words, still under the paragraph's own key. What
is crowded even so, a message with very many copies, is laid out in blocks: a
batch meets the first block of every crowd, and what has found no match there
meets all the others. What then still has no match is compared with every earlier text of its
stock phrases, pair by pair (``crowds``), so a stock phrase hides no match either.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from ..session import materialize, release, remove_path, shared_dir
from .bitslice import odd_sketch
from .crowds import hot_rows, meet, wide_sketches
from .words import flatten, hot_keys, is_common, mix, split_hot, word_hashes

_TEXT = "h long, ingest int, n int, words array<long>, s0 long, s1 long"
_PARAGRAPH = "key long, h long, ingest int, n int, w int, s0 long, s1 long"
_STOCK = "key long, h long, ingest int, n int, sk binary"
_COLS = ["key", "h", "ingest", "n", "w", "s0", "s1"]


def paragraphs(flat: np.ndarray, offsets: np.ndarray, every: int = 3, least: int = 3, short: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, words) of the content-defined paragraphs; every row must hold a word.

    A word ends a paragraph if its hash falls into one of ``every`` classes and ``least`` words
    stand in it; the last word of a row always does. One edit could break all few paragraphs of a short
    text: in rows of up to ``short`` words a paragraph of ``least`` words also begins at every word.
    """
    lens = np.diff(offsets)
    row = np.repeat(np.arange(len(lens)), lens)
    x = mix(flat.view(np.uint64), 23)
    last = np.zeros(len(flat), bool)
    last[offsets[1:] - 1] = True
    stop = np.flatnonzero((x % np.uint64(every) == 0) | last)
    # An end too close to the one before is passed over: all rows take a step at a time.
    keep = np.zeros(len(stop), bool)
    at = np.searchsorted(stop, offsets[:-1] + least - 1)
    end = np.searchsorted(stop, offsets[1:] - 1)
    at = np.minimum(at, end)
    while len(at):
        keep[at] = True
        on = at < end
        at, end = at[on], end[on]
        at = np.minimum(np.searchsorted(stop, stop[at] + least), end)
    stop = stop[keep]
    start = np.concatenate(([0], stop[:-1] + 1))
    inside = np.arange(len(flat)) - np.repeat(start, np.diff(np.append(start, len(flat))))
    placed = mix(x ^ mix(inside.astype(np.uint64), 29), 31)
    key = np.add.reduceat(placed, start)
    rows, words = row[start], stop - start + 1
    at = np.flatnonzero(np.repeat(lens <= short, lens) & (offsets[1:][row] - np.arange(len(flat)) >= least))
    if len(at):
        more = np.zeros(len(at), np.uint64)
        for j in range(least):
            more += mix(x[at + j] ^ mix(np.full(len(at), j, np.uint64), 29), 31)
        rows, key, words = np.concatenate([rows, row[at]]), np.concatenate([key, more]), np.concatenate([words, np.full(len(at), least)])
    return rows, key.view(np.int64), words.astype(np.int32)


def _hash_rows(hot_b):
    """Paragraph keys of texts: one row per key of a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["n"] > 0]
            if not len(pdf):
                continue
            flat, offsets, _ = flatten(pdf["words"])
            r, k, w = paragraphs(flat, offsets)
            at, key = (np.arange(len(r)), k) if hot_b is None else split_hot(r, k, flat, offsets, hot_b.value)
            of = {c: pdf[c].to_numpy()[r[at]] for c in ("h", "ingest", "n", "s0", "s1")}
            yield pd.DataFrame({"key": key, "w": w[at], **of})[_COLS].drop_duplicates(["key", "h"])

    return run


def _stock_rows(hot_b):
    """The texts of stock phrases: one row per phrase of a text, with a sketch as wide as ``crowds`` wants it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf[pdf["n"] > 0]
            if not len(pdf):
                continue
            r, k, _ = paragraphs(*flatten(pdf["words"])[:2])
            on = is_common(k, hot_b.value)
            sk = np.array(wide_sketches(*flatten([np.unique(w) for w in pdf["words"]])[:2]), dtype=object)
            of = {c: pdf[c].to_numpy()[r[on]] for c in ("h", "ingest", "n")}
            yield pd.DataFrame({"key": k[on], **of, "sk": sk[r[on]]}).drop_duplicates(["key", "h"])

    return run


def _crowded(counts_b):
    """``_stock_rows`` as rows for ``meet``, ranked by their ingest."""

    def rows(side: int):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    yield hot_rows(pdf["key"].to_numpy(), pdf["h"].to_numpy(), pdf["n"].to_numpy(), side, pdf["sk"].tolist(), counts_b.value, pdf["ingest"].to_numpy())

        return run

    return rows


@F.pandas_udf(DoubleType())
def _coverage(a: pd.Series, b: pd.Series) -> pd.Series:
    """The share of the first text's words in paragraphs that both texts have, at most 1."""
    both = []
    for words in (a, b):
        flat, offsets, lens = flatten(words)
        r, k, w = paragraphs(flat, offsets)
        both.append(pd.DataFrame({"r": r, "k": k, "w": w}).drop_duplicates(["r", "k"]))
        size = lens if len(both) == 1 else size
    shared = both[0].merge(both[1][["r", "k"]], on=["r", "k"])
    return pd.Series(np.minimum(np.bincount(shared["r"], shared["w"], len(a)) / size, 1.0))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        flat, offsets, _ = flatten([np.unique(w) for w in pdf["words"]])
        sk = odd_sketch(flat, offsets).view(np.int64)
        yield pdf.assign(s0=sk[:, 0], s1=sk[:, 1])


def _cell(key: np.ndarray, append: int | np.ndarray, block: np.ndarray) -> np.ndarray:
    """The key of a block of a crowd; block 0 stays under the crowd's own key."""
    other = mix(key.view(np.uint64) ^ mix(np.asarray(append, np.uint64) * np.uint64(1 << 40) + block.astype(np.uint64), 71), 73).view(np.int64)
    return np.where(block == 0, key, other)


def _placed(crowd_b, append: int):
    """Rows of crowded keys go to the block their text's hash picks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, blocks = crowd_b.value
        for pdf in batches:
            if len(keys) and len(pdf):
                k = pdf["key"].to_numpy()
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                on = keys[at] == k
                block = np.where(on, mix(pdf["h"].to_numpy().view(np.uint64), 79) % blocks[at].astype(np.uint64), np.uint64(0))
                pdf = pdf.assign(key=_cell(k, append, block))
            yield pdf[_COLS]

    return run


def _probes(crowds_b, most: int = 1 << 18):
    """The keys of all further blocks of the crowds a text belongs to."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            k = pdf["key"].to_numpy()
            for append, keys, blocks in crowds_b.value:
                at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
                on = np.flatnonzero(keys[at] == k)
                more = blocks[at[on]] - 1
                cuts = np.unique(np.searchsorted(np.cumsum(more), np.arange(0, int(more.sum()) + most, most)))
                for lo, hi in zip(cuts, [*cuts[1:], len(on)]):
                    i, m = on[lo:hi], more[lo:hi]
                    if len(i):
                        block = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m) + 1
                        i = np.repeat(i, m)
                        yield pdf.iloc[i].assign(key=_cell(k[i], append, block))[_COLS]

    return run


def prepare(df: DataFrame, ident: str = "pos", text: str = "text", ingest: str = "ingest_no") -> DataFrame:
    """(i, ingest, h, n, words): rows as ``AcceptedHistory`` takes them; rows without an ingest are left out."""
    w = df.where(F.col(ingest).isNotNull()).select(F.col(ident).alias("i"), F.col(ingest).cast("int").alias("ingest"), word_hashes(F.col(text)).alias("words"))
    return w.select("i", "ingest", F.xxhash64("words").alias("h"), F.size(F.array_distinct("words")).alias("n"), "words")


class AcceptedHistory:
    """Hash tables of all accepted texts, bucketed, appended batch by batch.

    ``share`` and ``least`` say which paragraphs of the first load count as stock
    phrases; that list is fixed as long as the tables live, so that texts keep
    their keys. It holds at most (mean paragraphs per text) / ``share`` keys.
    A later stock phrase is met under its plain key: slower, with the same result.
    ``block`` is the size of a crowd's blocks. ``buckets`` is set at the first load: one for every core, and more
    where they would hold over two million paragraphs.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, share: float = 1e-4, least: int = 256, block: int = 1024, path: str | None = None):
        self.spark, self.buckets, self.share, self.least, self.block = spark, buckets, share, least, block
        self.path = path or f"{shared_dir(spark)}/msgsieve/history-{uuid.uuid4().hex}"
        self.name = "history_" + uuid.uuid4().hex[:12]
        self.appends = 0
        self.hot = None
        self.crowds: list[tuple[int, np.ndarray, np.ndarray]] = []

    def _append(self, df: DataFrame, kind: str, key: str) -> None:
        w = df.repartition(self.buckets, key).write.bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.path}/{kind}")
        w.mode("append").format("parquet").saveAsTable(f"{self.name}_{kind}")

    def table(self, kind: str) -> DataFrame:
        return self.spark.table(f"{self.name}_{kind}")

    def _fresh(self, batch: DataFrame) -> DataFrame:
        """The batch's texts that the history does not hold in full, once each, with their first ingest."""
        texts = batch.where("n > 0").groupBy("h").agg(F.min("ingest").alias("ingest"), F.first("n").alias("n"), F.first("words").alias("words"))
        if self.appends:
            texts = texts.join(self.table("content").select("h"), "h", "left_anti")
        return materialize(texts.mapInPandas(_sketches, _TEXT), "fresh")

    def _met(self, fresh: DataFrame, keys: DataFrame, threshold: float) -> DataFrame:
        """(h, similarity, coverage) of the fresh texts that a text of an earlier ingest is near to.

        ``coverage`` is the share of the text's words in paragraphs shared with the best match among those met.
        """
        # The distance of two odd sketches never exceeds the difference of the sets, so nothing similar is passed over.
        slope = (1 - threshold) / (1 + threshold)
        near = f"bit_count(x.s0 ^ y.s0) + bit_count(x.s1 ^ y.s1) <= {slope} * (x.n + y.n) + 1e-9 and least(x.n, y.n) >= {threshold} * greatest(x.n, y.n) - 1e-9"
        shared = keys.alias("x").join(self.table("paragraphs").alias("y"), F.expr(f"x.key = y.key and x.ingest > y.ingest and {near}"))
        return self._best(fresh, shared.select(F.col("x.h").alias("ha"), F.col("y.h").alias("hb")).distinct(), threshold)

    def _best(self, fresh: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
        """(h, similarity, coverage) of the fresh texts ``ha`` that have a text ``hb`` of the history as similar as ``threshold``."""
        full = pairs.join(fresh.select(F.col("h").alias("ha"), F.col("words").alias("wa")), "ha")
        full = full.join(self.table("content").select(F.col("h").alias("hb"), F.col("words").alias("wb")), "hb")
        both = F.size(F.array_intersect("wa", "wb"))
        sim = both / (F.size(F.array_distinct("wa")) + F.size(F.array_distinct("wb")) - both)
        found = full.select(F.col("ha").alias("h"), "wa", "wb", sim.alias("similarity")).where(f"similarity >= {threshold} - 1e-12")
        found = found.select("h", "similarity", _coverage("wa", "wb").alias("coverage"))
        best = found.groupBy("h").agg(F.max(F.struct("similarity", "coverage")).alias("m"))
        return best.select("h", "m.similarity", "m.coverage")

    def _rest(self, fresh: DataFrame, near: DataFrame, threshold: float) -> DataFrame | None:
        """As ``_met``, of the texts of stock phrases that are not in ``near``, against all earlier texts of these phrases."""
        fresh.mapInPandas(_stock_rows(self.hot), _STOCK).write.mode("append").parquet(f"{self.path}/stock")
        stock = self.spark.read.schema(_STOCK).parquet(f"{self.path}/stock")
        # Stock phrases are bounded by ``share``.
        sums = stock.groupBy("key").agg(F.count("*").alias("n"), F.min("ingest").alias("first")).toPandas().sort_values("key")
        if not len(sums):
            return None
        left = materialize(fresh.where(F.col("ingest") > int(sums["first"].min())).join(near, "h", "left_anti").mapInPandas(_stock_rows(self.hot), _STOCK), "left")
        last = left.agg(F.max("ingest")).first()[0]
        if last is None:
            release(left)
            return None
        counts = self.spark.sparkContext.broadcast((sums["key"].to_numpy(np.int64), sums["n"].to_numpy(np.int64)))
        pairs = materialize(meet(left, stock.where(F.col("ingest") < last), _crowded(counts), threshold, int(sums["n"].sum()), True).distinct(), "met")
        out = materialize(self._best(fresh, pairs, threshold), "near")
        release(left, pairs)
        return out

    def take(self, batch: DataFrame, threshold: float = 0.7) -> DataFrame:
        """(i, ingest, full, similarity, coverage): appends a batch and gives its rows that an earlier ingest already holds.

        ``full`` rows are copies of an accepted text, with similarity and coverage 1. Rows of one
        ingest do not count as copies of each other. Rows without words match nothing. Every row that a text of an earlier
        ingest with a paragraph in common is similar to is found; in a crowd the similarity and coverage are those of the best text it met.
        """
        first = not self.appends
        fresh = self._fresh(batch)
        if first:
            rows = fresh.count()
            self.buckets = self.buckets or max(self.spark.sparkContext.defaultParallelism, -(-rows * 24 // 2_000_000))
            plain = fresh.mapInPandas(_hash_rows(None), _PARAGRAPH)
            self.hot = self.spark.sparkContext.broadcast(hot_keys(plain, "key", self.share, self.least, rows)[0])
        keys = materialize(fresh.mapInPandas(_hash_rows(self.hot), _PARAGRAPH), "paragraphs")
        # A crowd is bounded by share as the stock phrases are; smaller groups stay in one block.
        crowd = hot_keys(keys, "key", self.share, self.block, fresh.count())
        crowd = (crowd[0], -(-crowd[1] // self.block))
        placed = keys.mapInPandas(_placed(self.spark.sparkContext.broadcast(crowd), self.appends), _PARAGRAPH) if len(crowd[0]) else keys
        self._append(fresh.select("h", "ingest", "words"), "content", "h")
        self._append(placed, "paragraphs", "key")
        if len(crowd[0]):
            self.crowds.append((self.appends, *crowd))
        self.appends += 1
        near = materialize(self._met(fresh, keys, threshold), "near")
        if self.crowds:
            left = keys.join(near, "h", "left_anti")
            probes = left.mapInPandas(_probes(self.spark.sparkContext.broadcast(self.crowds)), _PARAGRAPH)
            more = materialize(near.unionByName(self._met(fresh, probes, threshold)), "near")
            release(near)
            near = more
        if len(self.hot.value):
            rest = self._rest(fresh, near, threshold)
            if rest is not None:
                more = materialize(near.unionByName(rest), "near")
                release(near, rest)
                near = more
        state = fresh.select("h", F.col("ingest").alias("first")).join(near, "h", "left")
        hit = batch.where("n > 0").select("i", "ingest", "h").join(state, "h", "left").where("first is null or ingest > first or similarity is not null")
        full = F.col("first").isNull() | (F.col("ingest") > F.col("first"))
        hit = hit.select("i", "ingest", full.alias("full"), *(F.when(full, 1.0).otherwise(F.col(c)).alias(c) for c in ("similarity", "coverage")))
        out = materialize(hit, "hits")
        release(near, fresh, keys)
        return out

    def drop(self) -> None:
        for kind in ("content", "paragraphs"):
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}_{kind}")
            remove_path(self.spark, f"{self.path}/{kind}")
        remove_path(self.spark, f"{self.path}/stock")


def check_ingests(df: DataFrame, batches: list[list[int]], ident: str = "pos", text: str = "text", ingest: str = "ingest_no", threshold: float = 0.7, **kw) -> DataFrame:
    """(ident, ingest, full, similarity, coverage): rows of which an earlier ingest holds the same or nearly the same text.

    Every list of ``batches`` is one load: checked against all loads before it, and its ingests against
    each other. Rows without an ingest, or of an ingest in no batch, take no part. No batches give no rows.
    """
    spark = df.sparkSession
    ready = prepare(df, ident, text, ingest)
    path = f"{shared_dir(spark)}/msgsieve/ingests-{uuid.uuid4().hex}"
    ready.write.partitionBy("ingest").parquet(path)
    base = spark.read.schema(ready.select("i", "h", "n", "words", "ingest").schema).parquet(path)
    history = AcceptedHistory(spark, **kw)
    hits = [history.take(base.where(F.col("ingest").isin(*b)), threshold) for b in batches]
    if not hits:
        return base.select(F.col("i").alias(ident), "ingest", F.lit(True).alias("full"), F.lit(1.0).alias("similarity"), F.lit(1.0).alias("coverage")).limit(0)
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    history.drop()
    remove_path(spark, path)
    return out.withColumnRenamed("i", ident)


def loads(rows: dict[int, int], fill: float = 0.25) -> list[list[int]]:
    """The ingests in order, taken together until a load holds ``fill`` of the rows before it.

    The number of loads, and so of passes over the tables, grows with the logarithm of the rows and not with the number of ingests.
    """
    out: list[list[int]] = []
    before = now = 0
    for n in sorted(rows):
        if not out or now >= fill * before:
            out.append([])
            before, now = before + now, 0
        out[-1].append(n)
        now += rows[n]
    return out


def seen_before(df: DataFrame, ident: str = "pos", text: str = "text", ingest: str = "ingest_no", threshold: float = 0.7, **kw) -> DataFrame:
    """(ident, ingest, full, similarity, coverage): rows of which an earlier ingest holds the same or nearly the same text.

    The ingests are taken in order, in ``loads``. Rows without an ingest or without words match nothing.
    """
    count = df.where(F.col(ingest).isNotNull()).groupBy(F.col(ingest).cast("int")).count().collect()
    return check_ingests(df, loads({r[0]: r[1] for r in count}), ident, text, ingest, threshold, **kw)


def check_new_batches(df: DataFrame, accepted: DataFrame, batches: list[int], ingest: str = "ingest_no", **kw) -> DataFrame:
    """As ``seen_before`` for ``batches``, each a load of its own, after the ingests of ``accepted``, which are loaded at once."""
    old = sorted(r[0] for r in accepted.where(F.col(ingest).isNotNull()).select(F.col(ingest).cast("int")).distinct().collect())
    out = check_ingests(df, [old] * bool(old) + [[b] for b in batches], ingest=ingest, **kw)
    return out.where(F.col("ingest").isin(*batches)) if batches else out.limit(0)
