"""Stateful and streaming operators; every one has a batch twin over the same logic."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import list_names, path_exists, remove_path


def decide(times: list[float], now: float, limit: int, window: float) -> tuple[bool, float, list[float]]:
    """One request against the accepted times of its key: (accepted, retry after, times kept).

    A rejected request is not recorded; limit 0 accepts all.
    """
    if limit <= 0:
        return True, 0.0, times
    kept = [t for t in times if t > now - window]
    if len(kept) >= limit:
        return False, kept[0] + window - now, kept
    return True, 0.0, [*kept, now]


def rate_limit(requests: DataFrame, limit: int, window: float = 60.0, bucket: str = "event_type", client: str = "user_id", ts: str = "ts", ident: str = "event_id") -> DataFrame:
    """(ident, accepted, retry_after): sliding log per bucket and client, in the order of time.

    A key's requests are handled in order because every decision depends on
    those before it. A hot client would fill one task, so requests arrive sorted and are
    streamed through; the state is at most ``limit`` times per key.
    """
    kind = dict(requests.dtypes)[ident]
    cols = requests.select(F.col(bucket).cast("string").alias("b"), F.col(client).cast("string").alias("c"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(ident).alias("i"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = None, []
        for pdf in batches:
            out = []
            for b, c, t, i in zip(pdf["b"], pdf["c"], pdf["t"], pdf["i"]):
                if (b, c) != key:
                    key, times = (b, c), []
                ok, wait, times = decide(times, t, limit, window)
                out.append((i, ok, round(wait, 6)))
            yield pd.DataFrame(out, columns=[ident, "accepted", "retry_after"])

    ordered = cols.where("t is not null").repartition("b", "c").sortWithinPartitions("b", "c", "t", "i")
    return ordered.mapInPandas(run, f"{ident} {kind}, accepted boolean, retry_after double")


def rate_limit_stream(requests: DataFrame, limit: int, window: float = 60.0, bucket: str = "event_type", client: str = "user_id", ts: str = "ts", ident: str = "event_id", evict: bool = True) -> DataFrame:
    """The limiter on a stream: accepted times are the state of a key and time out with the window.

    A stream that is to end by itself runs without eviction, because open
    timeouts keep it going.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        times = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["t", "i"])
        out = []
        for t, i in zip(rows["t"], rows["i"]):
            ok, wait, times = decide(times, t, limit, window)
            out.append((i, ok, round(wait, 6)))
        state.update((times,))
        if evict:
            state.setTimeoutDuration(int(window * 1000) + 1)
        yield pd.DataFrame(out, columns=[ident, "accepted", "retry_after"])

    kind = dict(requests.dtypes)[ident]
    cols = requests.select(F.col(bucket).cast("string").alias("b"), F.col(client).cast("string").alias("c"), F.col(ts).cast("timestamp").cast("double").alias("t"), F.col(ident).alias("i"))
    return cols.groupBy("b", "c").applyInPandasWithState(run, f"{ident} {kind}, accepted boolean, retry_after double", "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if evict else GroupStateTimeout.NoTimeout)


def cached_predictions(predictions: DataFrame, lookups: DataFrame, hours: int = 24, key: str = "user_id") -> DataFrame:
    """(lookup, prediction): the newest prediction of the key that has not expired; expiry counts from the prediction."""
    j = lookups.alias("l").join(predictions.alias("p"), F.expr(f"l.{key} = p.{key} and p.ts <= l.ts and l.ts < p.ts + interval {hours} hours"))
    return j.groupBy(F.col("l.event_id").alias("lookup")).agg(F.max_by("p.event_id", F.struct("p.ts", "p.event_id")).alias("prediction"))


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Native extension: tumbling or sliding counts per event type; ``late`` sets the watermark on a stream."""
    e = events.withWatermark("ts", late) if late else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    g = e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Native extension: sessions of a user."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def _latest(spark, path: str, before: int) -> tuple[int, dict[int, int]]:
    """(epoch, bucket -> epoch that wrote it) of the last finished version before an epoch; (-1, {}) if there is none."""
    done = [int(n[1:]) for n in list_names(spark, f"{path}/manifest") if n.startswith("e") and path_exists(spark, f"{path}/manifest/{n}/_SUCCESS")]
    last = max((e for e in done if e < before), default=-1)
    return last, {r["bucket"]: r["epoch"] for r in spark.read.parquet(f"{path}/manifest/e{last}").collect()} if last >= 0 else {}


def upsert_stream(stream: DataFrame, path: str, key: str, order: str, checkpoint: str, once: bool = False, buckets: int = 64, keep: int = 2):
    """Latest-wins table of a stream; ``once`` ends it with what is there. ``read_upserted`` reads it.

    The table lies in ``buckets`` by the hash of its key. A micro-batch merges and writes only the buckets it
    touches, under its epoch; a small manifest then names the epoch of every bucket and makes the version
    valid. A repeated epoch starts from the version before it, so nothing is lost or doubled. Epochs that none of the
    last ``keep`` manifests name are removed. Errors are raised; only a table without any version starts empty.
    """
    from ..sources.sinks import upsert

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        own = batch.withColumn("__bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")).persist()
        touched = sorted(r[0] for r in own.select("__bucket").distinct().collect())
        _, at = _latest(spark, path, epoch)
        current = None
        for b in touched:
            if b in at:
                part = spark.read.schema(batch.schema).parquet(f"{path}/v{at[b]}/__bucket={b}").withColumn("__bucket", F.lit(b))
                current = part if current is None else current.unionByName(part)
        merged = upsert(current if current is not None else own.limit(0), own, key, order)
        merged.write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/v{epoch}")
        now = at | {b: epoch for b in touched}
        spark.createDataFrame(sorted(now.items()), "bucket int, epoch long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/e{epoch}")
        own.unpersist()
        manifests = sorted((int(n[1:]) for n in list_names(spark, f"{path}/manifest") if n.startswith("e")), reverse=True)
        named = {e for m in manifests[:keep] for e in _latest(spark, path, m + 1)[1].values()}
        for n in list_names(spark, path):
            if n[0] == "v" and n[1:].isdigit() and int(n[1:]) not in named and int(n[1:]) != epoch:
                remove_path(spark, f"{path}/{n}")
        for m in manifests[keep:]:
            remove_path(spark, f"{path}/manifest/e{m}")

    w = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def read_upserted(spark, path: str, schema) -> DataFrame:
    """The newest finished version of the table of ``upsert_stream``; empty if there is none."""
    _, at = _latest(spark, path, 1 << 62)
    paths = [f"{path}/v{e}/__bucket={b}" for b, e in sorted(at.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def analyze_stream(messages: DataFrame, score) -> DataFrame:
    """Scores each message of a stream: ``score`` is any map from messages to rows without state, as on a table."""
    if not messages.isStreaming:
        raise ValueError("a stream is expected")
    return score(messages)
