"""Sliding-window admission: at most `most` accepted requests of a key within `window_us`.

A request is rejected if `most` accepted ones are in the window; an entry exactly one window old
still counts, and only accepted requests are remembered. A rejection says how long to wait:
until the oldest leaves. The batch form is a fold over stretches of requests; the streaming form
keeps at most `most` times for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def admit(requests: DataFrame, window_us: int = 60_000_000, most: int = 8) -> DataFrame:
    """requests (key, id, t in microseconds): (key, id, accepted, retry_after_us).

    After a pause longer than the window nothing is remembered, so each key falls into
    stretches that are folded on their own.
    """
    w = Window.partitionBy("key").orderBy("t", "id")
    x = requests.withColumn("gap", F.col("t") - F.lag("t").over(w))
    x = x.withColumn("stretch", F.sum(F.coalesce((F.col("gap") > window_us).cast("int"), F.lit(0))).over(w))
    lists = x.groupBy("key", "stretch").agg(F.array_sort(F.collect_list(F.struct("t", "id"))).alias("r"))
    empty = F.struct(F.array().cast("array<bigint>").alias("kept"), F.array().cast("array<struct<id:bigint,accepted:boolean,retry_after_us:bigint>>").alias("out"))

    def step(acc, r):
        live = F.filter(acc["kept"], lambda t: t >= r["t"] - window_us)
        ok = F.size(live) < most
        wait = F.when(~ok, F.array_min(live) + window_us - r["t"])
        row = F.struct(r["id"].cast("long").alias("id"), ok.alias("accepted"), wait.cast("long").alias("retry_after_us"))
        return F.struct(F.when(ok, F.array_append(live, r["t"])).otherwise(live).alias("kept"), F.array_append(acc["out"], row).alias("out"))

    return lists.select("key", F.inline(F.aggregate("r", empty, step)["out"]))


def admit_stream(requests: DataFrame, window_us: int = 60_000_000, most: int = 8) -> DataFrame:
    """The same over a stream of (key, id, t), in order of t within a batch and across batches."""

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(["t", "id"])
        rows = []
        for t, i in zip(pdf.t.tolist(), pdf.id.tolist(), strict=True):
            kept = [k for k in kept if k >= t - window_us]
            ok = len(kept) < most
            rows.append((key[0], i, ok, None if ok else kept[0] + window_us - t))
            if ok:
                kept.append(t)
        state.update((kept,))
        yield pd.DataFrame(rows, columns=["key", "id", "accepted", "retry_after_us"]).astype({"retry_after_us": "Int64"})

    return requests.groupBy("key").applyInPandasWithState(run, "key long, id long, accepted boolean, retry_after_us long", "kept array<long>", "append", "NoTimeout")


def windowed_counts(events: DataFrame, size: str = "1 day", late: str | None = "1 hour") -> DataFrame:
    """(start, event_type, n, total) of events (ts TIMESTAMP, event_type, value) by tumbling window.

    With `late`, a stream drops events later than that; a batch keeps everything.
    """
    if late and events.isStreaming:
        events = events.withWatermark("ts", late)
    g = events.groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    """(user_id, start, n) of events by sessions that a pause of gap ends."""
    g = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def page_log(pages: DataFrame, path: str, checkpoint: str):
    """Appends a stream of graded pages as JSON lines, each exactly once; returns the query."""
    return pages.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
