"""Filling fixed-capacity containers (problem 8).

Vector bin packing by the dot-product heuristic: every container has a limit on
tokens, on segments and on loss-bearing tokens (those after a text's first
line). The next item, or pair of items, is the one whose demand has the largest
dot product with what the container has left. Items are spread by hash over shards that a
task can hold; containers a shard leaves badly filled are opened again and
packed in a further round over fewer shards.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import materialize
from .tokens import DEFAULT, count_tokens


class _Sizes:
    """A multiset of items by size and then loss, with the largest size not above a bound."""

    def __init__(self, size: np.ndarray, loss: np.ndarray):
        self.sizes = sorted(set(size.tolist()))
        self.items: list[list[tuple[int, int]]] = [[] for _ in self.sizes]
        slot = {s: j for j, s in enumerate(self.sizes)}
        for l, i in sorted(zip(loss.tolist(), range(len(size)))):
            self.items[slot[int(size[i])]].append((l, i))
        self.below = list(range(len(self.sizes)))  # the next slot at or below that has items
        self.left = len(size)

    def _find(self, j: int) -> int:
        while j >= 0 and self.below[j] != j:
            nxt = self.below[j]
            if nxt >= 0:
                self.below[j] = self.below[nxt] if self.below[nxt] >= -1 else nxt
            j = nxt
        return j

    def largest(self, bound: int) -> int:
        """Slot of the largest size within the bound, or -1."""
        return self._find(bisect_right(self.sizes, bound) - 1)

    def next_below(self, slot: int) -> int:
        return self._find(slot - 1) if slot > 0 else -1

    def most(self, slot: int, carry: int, other: tuple[int, int] | None = None) -> tuple[int, int] | None:
        """The (loss, item) of a size with the most loss within ``carry``, apart from ``other``."""
        at = bisect_right(self.items[slot], (carry, 1 << 62)) - 1
        if at >= 0 and self.items[slot][at] == other:
            at -= 1
        return self.items[slot][at] if at >= 0 else None

    def take(self, slot: int, item: tuple[int, int]) -> None:
        stack = self.items[slot]
        stack.pop(bisect_left(stack, item))
        self.left -= 1
        if not stack:
            self.below[slot] = slot - 1


def pack(size: np.ndarray, loss: np.ndarray, capacity: int, max_segments: int, max_loss: int, look: int = 48) -> np.ndarray:
    """Container number of every item within all three limits.

    An item that alone bears more loss than ``max_loss`` breaks that limit wherever it goes: it has a container of its own.
    """
    out = np.full(len(size), -1, np.int64)
    alone = np.flatnonzero(loss > max_loss)
    out[alone] = np.arange(len(alone))
    ids = np.flatnonzero(loss <= max_loss)
    pool = _Sizes(size[ids], loss[ids])
    box = len(alone)
    while pool.left:
        room, segments, carry = capacity, max_segments, max_loss
        slot = pool.largest(room)
        first = True
        while slot >= 0 and segments > 0:
            best, score = None, -1.0
            s, seen = slot, 0
            while s >= 0 and (seen < (1 if first else look) or best is None):
                # Of one size, the item with the most loss that fits has the largest dot product.
                a = pool.most(s, carry)
                if a is not None:
                    t, l = pool.sizes[s], a[0]
                    # One item alone, and with the largest partner that still fits beside it.
                    dot = t / capacity * room / capacity + segments / max_segments / max_segments + l / max_loss * carry / max_loss
                    if dot > score:
                        best, score = ((s, a),), dot
                    if not first and segments > 1:
                        p = pool.largest(min(room - t, t))
                        b = pool.most(p, carry - l, a if p == s else None) if p >= 0 else None
                        if b is None and p == s:
                            p = pool.next_below(p)
                            b = pool.most(p, carry - l) if p >= 0 else None
                        if b is not None:
                            dot = (t + pool.sizes[p]) / capacity * room / capacity + 2 * segments / max_segments / max_segments + (l + b[0]) / max_loss * carry / max_loss
                            if dot > score + 1e-12:
                                best, score = ((s, a), (p, b)), dot
                seen += 1
                s = pool.next_below(s)
            if best is None:
                break
            for s, item in best:
                pool.take(s, item)
                out[ids[item[1]]] = box
                room, segments, carry = room - pool.sizes[s], segments - 1, carry - item[0]
            first = False
            slot = pool.largest(room)
        box += 1
    return out


_PLACED = "spec_id int, doc_id {kind}, part int, tokens long, loss long, shard int, box long"


def pack_documents(df: DataFrame, specs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = DEFAULT, max_segments: int | None = None,
                   max_loss_share: float = 1.0, shard_boxes: int = 1500, full: float = 0.995, max_rounds: int = 4) -> DataFrame:
    """(spec_id, ident, part, tokens, loss, container): where every document goes, per capacity.

    A document above the capacity is cut into full parts and a rest; no other
    is divided. ``max_segments`` defaults to a segment for every 16 tokens of
    capacity. Documents without tokens, null or empty, need no container and
    have no row; repeated identifiers are packed as documents of their own. Loss-bearing tokens may fill
    ``max_loss_share`` of a capacity; a part that alone bears more has a container of its own.
    Specs without a positive capacity are left out.
    """
    kind = dict(df.dtypes)[ident]
    sized = materialize(count_tokens(df, text, [ident], vocabulary), "sizes")
    spec = specs.where("capacity_tokens > 0").select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    items = sized.where("tokens > 0").crossJoin(F.broadcast(spec))
    parts = F.ceil(F.col("tokens") / F.col("capacity")).cast("int")
    items = items.select("spec_id", "capacity", F.col(ident).alias("doc_id"), "tokens", "head_tokens", F.posexplode(F.sequence(F.lit(1), parts)).alias("part", "_n"))
    start = F.col("part") * F.col("capacity")
    own = F.least(F.col("capacity"), F.col("tokens") - start)
    head = F.greatest(F.lit(0), F.least(own, F.col("head_tokens") - start))
    items = items.select("spec_id", "capacity", "doc_id", "part", own.cast("long").alias("tokens"), (own - head).cast("long").alias("loss"))
    # One capacity at a time is too slow for many; all are packed together, each in its own shards.
    total = {r["spec_id"]: (r["t"], r["capacity"]) for r in items.groupBy("spec_id", "capacity").agg(F.sum("tokens").alias("t")).collect()}
    done = None
    left = items
    for rnd in range(max_rounds):
        shards = {s: max(1, math.ceil(t / (c * shard_boxes))) for s, (t, c) in total.items()}
        count = F.create_map(*[x for s, n in shards.items() for x in (F.lit(s), F.lit(n))]) if shards else F.create_map(F.lit(0), F.lit(1))
        shard = F.pmod(F.xxhash64("doc_id", "part", F.lit(rnd)), count[F.col("spec_id")]).cast("int")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            cap = int(pdf["capacity"].iloc[0])
            pdf = pdf.sort_values(["tokens", "doc_id", "part"], ascending=[False, True, True], ignore_index=True)
            most = max_segments or max(1, cap // 16)
            carry = max(1, int(cap * max_loss_share))
            pdf["box"] = pack(pdf["tokens"].to_numpy(), pdf["loss"].to_numpy(), cap, most, carry)
            return pdf[["spec_id", "doc_id", "part", "tokens", "loss", "shard", "box"]]

        placed = left.withColumn("shard", shard).groupBy("spec_id", "shard").applyInPandas(run, _PLACED.format(kind=kind))
        placed = materialize(placed, "placed")
        fill = placed.groupBy("spec_id", "shard", "box").agg(F.sum("tokens").alias("filled")).join(F.broadcast(spec), "spec_id")
        keep = F.col("filled") >= full * F.col("capacity")
        several = any(n > 1 for n in shards.values())
        if rnd == max_rounds - 1 or not several:
            keep = F.lit(True)
        marked = placed.join(fill.select("spec_id", "shard", "box", "capacity", keep.alias("keep")), ["spec_id", "shard", "box"])
        code = F.lit(rnd) * F.lit(1 << 56) + F.col("shard").cast("long") * F.lit(1 << 24) + F.col("box")
        good = marked.where("keep").select("spec_id", F.col("doc_id").alias(ident), "part", "tokens", "loss", code.alias("container"))
        done = good if done is None else done.unionByName(good)
        if rnd == max_rounds - 1 or not several:
            return done
        left = marked.where("not keep").select("spec_id", "capacity", "doc_id", "part", "tokens", "loss")
        total = {r["spec_id"]: (r["t"], r["capacity"]) for r in left.groupBy("spec_id", "capacity").agg(F.sum("tokens").alias("t")).collect()}
        if not total:
            return done
    return done


def limits_report(packed: DataFrame, specs: DataFrame, max_segments: int, max_loss_share: float) -> DataFrame:
    """(spec_id, containers, full_tokens, full_segments, full_loss, broken): how many containers each limit closes, and how many break one.

    A limit closes a container that has no room for another segment, or for a twentieth more tokens or loss. A part that alone exceeds the limit of loss does not count as broken.
    """
    spec = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.sum("loss").alias("l")).join(F.broadcast(spec), "spec_id")
    carry = F.greatest(F.lit(1), F.floor(F.col("capacity") * max_loss_share))
    broken = (F.col("t") > F.col("capacity")) | (F.col("n") > max_segments) | ((F.col("l") > carry) & (F.col("n") > 1))
    return boxes.groupBy("spec_id").agg(F.count("*").alias("containers"), F.count_if(F.col("t") >= 0.95 * F.col("capacity")).alias("full_tokens"), F.count_if(F.col("n") == max_segments).alias("full_segments"),
                                        F.count_if(F.col("l") >= 0.95 * carry).alias("full_loss"), F.count_if(broken).alias("broken"))


def fill_report(packed: DataFrame, specs: DataFrame) -> DataFrame:
    """(spec_id, capacity, documents, containers, least_containers, fill, unused_tokens) per capacity."""
    boxes = packed.groupBy("spec_id", "container").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    per = boxes.groupBy("spec_id").agg(F.sum("n").alias("parts"), F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    spec = specs.select(F.col("spec_id").cast("int").alias("spec_id"), F.col("capacity_tokens").cast("long").alias("capacity"))
    room = F.col("containers") * F.col("capacity")
    return F.broadcast(spec).join(per, "spec_id").select(
        "spec_id", "capacity", "parts", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least_containers"),
        (F.col("tokens") / room).alias("fill"), (room - F.col("tokens")).alias("unused_tokens"))
