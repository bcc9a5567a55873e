"""The quota ledger: use within sliding windows, admission in order, and use by minute as a stream."""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY, MINUTE = 86_400_000_000, 60_000_000  # microseconds


def usage(ledger: DataFrame, key: str) -> DataFrame:
    """Tokens used before and at each row, of the last 24 hours (edge included) and of the last 60 seconds (edge excluded). ledger: key, event_id, at, tokens."""
    by = Window.partitionBy(key).orderBy("at")
    return ledger.withColumn("used_24h", F.round(F.sum("tokens").over(by.rangeBetween(-DAY, 0)), 4)).withColumn("used_60s", F.round(F.sum("tokens").over(by.rangeBetween(-MINUTE + 1, 0)), 4))


def admitted(ledger: DataFrame, key: str, calls: int, tokens: float) -> DataFrame:
    """Which requests are admitted, one after another: a refused one uses nothing.

    A key's requests come sorted by time and are never held together: what is carried is the admitted ones of the last day,
    at most `calls` of them. One key is one task, as each decision needs the one before. ledger: key, event_id, at, tokens.
    """
    kind = ledger.schema[key].dataType.simpleString()

    def run(batches):
        owner, live = None, deque()
        for batch in batches:
            out = []
            for who, at, used in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if who != owner:
                    owner = who
                    live.clear()
                while live and live[0][0] < at - DAY:
                    live.popleft()
                ok = len(live) < calls and sum(u for t, u in live if t > at - MINUTE) + used <= tokens
                if ok:
                    live.append((at, used))
                out.append(ok)
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out)], names=[key, "event_id", "admitted"])

    rows = ledger.select(key, "at", "event_id", F.col("tokens").cast("double"))
    return rows.repartition(key).sortWithinPartitions(key, "at", "event_id", "tokens").mapInArrow(run, f"`{key}` {kind}, event_id {ledger.schema['event_id'].dataType.simpleString()}, admitted boolean")


def by_minute(events: DataFrame, late: str = "24 hours") -> DataFrame:
    """Calls and tokens for each user and minute; works on a stream, where rows later than `late` are dropped."""
    return events.withWatermark("ts", late).groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count("*").alias("calls"), F.sum("value").alias("tokens")).select("user_id", F.col("w.start").alias("minute"), "calls", "tokens")


def stream_to_memory(spark, path: str, schema, name: str):
    """Start the ledger of a Parquet folder as a stream into a table in memory."""
    events = spark.readStream.schema(schema).parquet(path)
    return by_minute(events).writeStream.outputMode("update").format("memory").queryName(name).trigger(availableNow=True).start()
