"""Mixing sources to target weights (problem 9).

A plan's size is cut into slots of equal tokens. Slot i takes the golden-ratio
point frac(i * phi) through the cumulative weights of the plan, which gives
every source its share with low discrepancy in any stretch of the schedule.
Slots are ranked per source and joined with the source's blocks: its documents
in an order shuffled anew for every pass, cut into equal tokens. A source has
at most ``max_repeats`` passes; slots beyond them stay empty and are reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize
from .tokens import DEFAULT, count_tokens

#: The golden ratio's fractional part, the step of the schedule.
PHI = 0.6180339887498949


def prefix_sums(df: DataFrame, by: list[str], order: str, value: str, out: str, bits: int = 10) -> DataFrame:
    """Adds the sum of ``value`` over the rows of ``by`` before a row in the order of a 64-bit hash.

    Two levels: rows are bucketed by the top bits of the hash, buckets are summed
    before they are accumulated, and only inside a bucket rows are sorted; no
    task gets a whole group.
    """
    b = df.withColumn("__b", F.shiftright(order, 64 - bits).cast("int"))
    sums = b.groupBy(*by, "__b").agg(F.sum(value).alias("__s"))
    upto = F.sum("__s").over(Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("__base", F.coalesce(upto, F.lit(0))).drop("__s")
    inner = F.sum(value).over(Window.partitionBy(*by, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return b.withColumn("__in", F.coalesce(inner, F.lit(0))).join(sums, [*by, "__b"]).withColumn(out, (F.col("__base") + F.col("__in")).cast("long")).drop("__b", "__in", "__base")


def schedule(plans: DataFrame, slots: DataFrame) -> DataFrame:
    """(plan_id, slot, source, rank): the source of every slot and its number among the source's slots.

    ``slots`` holds (plan_id, slots). Ranks are counted in chunks of slots first.
    """
    w = Window.partitionBy("plan_id").orderBy("source")
    weights = plans.withColumn("high", F.sum("target_share").over(w)).withColumn("total", F.sum("target_share").over(Window.partitionBy("plan_id")))
    last = F.row_number().over(Window.partitionBy("plan_id").orderBy(F.desc("source"))) == 1
    weights = weights.select("plan_id", "source", F.try_divide(F.col("high") - F.col("target_share"), F.col("total")).alias("low"), F.when(last, 1.0).otherwise(F.try_divide(F.col("high"), F.col("total"))).alias("high"))
    chunk = 1 << 12
    chunks = slots.where("slots > 0").select("plan_id", "slots", F.explode(F.sequence(F.lit(0), F.floor((F.col("slots") - 1) / chunk))).alias("chunk"))
    first = F.col("chunk") * chunk
    each = chunks.select("plan_id", "chunk", F.explode(F.sequence(first, F.least(first + chunk, F.col("slots")) - 1)).alias("slot"))
    point = (F.col("slot") + 1) * F.lit(PHI)
    each = each.withColumn("u", point - F.floor(point))
    # A plan has few sources, so every slot meets its plan's weights only.
    placed = each.join(F.broadcast(weights), "plan_id").where("u >= low and u < high").select("plan_id", "chunk", "slot", "source")
    per = placed.groupBy("plan_id", "source", "chunk").count()
    before = F.sum("count").over(Window.partitionBy("plan_id", "source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    per = per.withColumn("base", F.coalesce(before, F.lit(0))).drop("count")
    inner = F.row_number().over(Window.partitionBy("plan_id", "source", "chunk").orderBy("slot")) - 1
    return placed.withColumn("r", inner).join(per, ["plan_id", "source", "chunk"]).select("plan_id", "slot", "source", (F.col("base") + F.col("r")).alias("rank"))


def mix_sources(df: DataFrame, plans: DataFrame, ident: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = DEFAULT,
                block_tokens: int = 1024, seed: int = 20240229, fill_rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(draw, shares).

    draw: (plan_id, slot, source, ident, use_no, tokens) - a document's
    ``use_no``-th use in the plan, in the slot it starts in. shares: one row per
    plan and source with target and actual tokens and shares, uses, and whether
    the cap of repeats stopped it short. A source without documents is drawn 0
    tokens. Null sources and texts without tokens are never drawn; null or
    negative shares count as 0 and ``max_repeats`` below 1 allows no use.
    """
    sized = materialize(count_tokens(df.where(F.col(source).isNotNull()), text, [ident, source], vocabulary).where("tokens > 0")
                        .select(F.col(ident).alias("i"), F.col(source).alias("source"), "tokens"), "sizes")
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"), F.count("*").alias("documents"))
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("all_tokens"))
    p = plans.select("plan_id", "source", F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0)).alias("target_share"),
                     F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)).alias("max_repeats"), "budget_share")
    budget = p.groupBy("plan_id").agg(F.max("budget_share").alias("b")).crossJoin(total)
    budget = materialize(budget.select("plan_id", F.round(F.col("b") * F.col("all_tokens")).cast("long").alias("budget")), "budget")
    slots = budget.select("plan_id", F.ceil(F.col("budget") / block_tokens).cast("long").alias("slots"))
    ranked = materialize(schedule(p, slots), "schedule")
    size = ranked.groupBy("plan_id", "source").agg(F.count("*").alias("k"))
    want = p.join(size, ["plan_id", "source"], "left").join(have, "source", "left").join(budget, "plan_id")
    whole = F.sum("target_share").over(Window.partitionBy("plan_id"))
    want = want.withColumn("wanted", F.when(whole > 0, F.try_divide(F.col("target_share"), whole) * F.col("budget")).otherwise(0.0))
    want = materialize(want.withColumn("passes", F.least(F.col("max_repeats").cast("long"), F.ceil(F.try_divide(F.col("wanted"), F.col("have"))))), "wanted")
    # One row per document and pass; the order of every pass is shuffled anew.
    plan_rows = want.where("have > 0 and passes > 0").select("plan_id", "source", "have", "wanted", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes") - 1)).alias("use"))
    uses = sized.join(F.broadcast(plan_rows), "source").withColumn("o", F.xxhash64("i", "plan_id", "use", F.lit(seed)))
    placed = prefix_sums(uses, ["plan_id", "source", "use"], "o", "tokens", "at")
    placed = placed.withColumn("at", F.col("at") + F.col("use") * F.col("have"))
    # Whole documents up to the wanted tokens; then the largest unused ones that still fit into what is left.
    placed = materialize(placed.select("plan_id", "source", "i", "use", "tokens", "at", "wanted"), "uses")
    inside = F.col("at") + F.col("tokens") <= F.col("wanted")
    drawn = placed.where(inside)
    rest = placed.where(~inside)
    for _ in range(fill_rounds):
        gap = drawn.groupBy("plan_id", "source").agg(F.sum("tokens").alias("__t"))
        gap = want.where("wanted > 0").select("plan_id", "source", "wanted").join(gap, ["plan_id", "source"], "left").select("plan_id", "source", (F.col("wanted") - F.coalesce("__t", F.lit(0))).alias("__gap"))
        fits = rest.join(F.broadcast(gap), ["plan_id", "source"]).where("tokens <= __gap")
        pick = fits.groupBy("plan_id", "source").agg(F.max(F.struct("tokens", "use", "i", "at", "wanted")).alias("p")).select("plan_id", "source", "p.i", "p.use", "p.tokens", "p.at", "p.wanted")
        pick = materialize(pick, "fill")
        drawn = drawn.unionByName(pick)
        rest = rest.join(F.broadcast(pick.select("plan_id", "source", "i", "use")), ["plan_id", "source", "i", "use"], "left_anti")
    # What fills a gap stands in the source's last slot.
    drawn = drawn.withColumn("rank", F.floor(F.least("at", "wanted") / block_tokens))
    # Slots grow with the data: both sides are shuffled, nothing is broadcast.
    drawn = drawn.join(size, ["plan_id", "source"]).withColumn("rank", F.least("rank", F.col("k") - 1))
    draw = drawn.join(ranked.hint("merge"), ["plan_id", "source", "rank"]).select("plan_id", "slot", "source", F.col("i").alias(ident), (F.col("use") + 1).alias("use_no"), "tokens")
    got = drawn.groupBy("plan_id", "source").agg(F.sum("tokens").alias("got"), F.count("*").alias("uses"), F.max(F.col("use") + 1).alias("most_uses"))
    zero = F.lit(0).cast("long")
    shares = want.join(got, ["plan_id", "source"], "left").select(
        "plan_id", "source", "target_share", "max_repeats", "budget", (F.col("target_share") * F.col("budget")).alias("target_tokens"),
        F.coalesce("got", zero).alias("drawn_tokens"), F.coalesce("uses", zero).alias("uses"), F.coalesce("most_uses", zero).alias("most_uses"),
        F.try_divide(F.coalesce("got", zero), F.col("budget")).alias("share_of_budget"),
        F.try_divide(F.coalesce("got", zero), F.sum(F.coalesce("got", zero)).over(Window.partitionBy("plan_id"))).alias("actual_share"),
        (F.coalesce(F.col("have"), zero) * F.col("max_repeats") < F.col("wanted")).alias("stopped_short"))
    return draw, shares
