"""Counters of a running stream: metrics that each micro-batch observes on its way, gathered by a query listener into a table."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def per_key(name: str, key: str, keys: list, counters: dict[str, Column]) -> list[Column]:
    """Aggregates for observe(): each counter of each of a fixed list of keys, named name/key/counter. Counters are conditions to count, or numbers to sum."""
    out = []
    for k in keys:
        own = F.col(key) == F.lit(k)
        out += [F.coalesce(F.sum(F.when(own, c.cast("long"))), F.lit(0)).alias(f"{name}/{k}/{n}") for n, c in counters.items()]
    return out


def latest(name: str, key: str, keys: list, value: str, order: str) -> list[Column]:
    """Aggregates for observe(): each key's last value by order, null where the batch has none; named name/key/value=."""
    return [F.max_by(F.when(F.col(key) == F.lit(k), F.col(value)), F.when(F.col(key) == F.lit(k), F.col(order))).cast("long").alias(f"{name}/{k}/{value}=") for k in keys]


class Counters(StreamingQueryListener):
    """Gathers what the queries of one name observe: some numbers a micro-batch, whatever its rows. A batch that is run again replaces its own numbers."""

    def __init__(self, query_name: str):
        self.query_name, self.rows, self.ended = query_name, {}, threading.Event()
        self.run_ids: set = set()

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        if event.name == self.query_name:
            self.run_ids.add(event.runId)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        if p.name == self.query_name:
            for row in p.observedMetrics.values():
                for label, value in row.asDict().items():
                    if "/" in label:
                        name, key, counter = label.split("/")
                        self.rows[p.batchId, name, key, counter] = value

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if event.runId in self.run_ids:
            self.ended.set()

    def table(self, spark: SparkSession) -> DataFrame:
        """(batch_id, name, key, counter, value) of all micro-batches so far."""
        return spark.createDataFrame([(*k, v) for k, v in sorted(self.rows.items())], "batch_id long, name string, key string, counter string, value long")


def totals(table: DataFrame) -> DataFrame:
    """(key, counter, value): sums over the batches, and the last known value of those named with '='."""
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("batch_id")))
    return table.groupBy("key", "counter").agg(F.sum("value").alias("sum"), last.alias("last")).select("key", F.rtrim("counter", F.lit("=")).alias("counter"), F.when(F.col("counter").endswith("="), F.col("last")).otherwise(F.col("sum")).alias("value"))


def counted_run(stream: DataFrame, counters: Counters, folder: str, wait_s: float = 60.0) -> None:
    """Runs a stream that observes metrics until its source is exhausted, and waits for the last of its messages to the listener."""
    spark = stream.sparkSession
    spark.streams.addListener(counters)
    try:
        query = stream.writeStream.queryName(counters.query_name).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        if query.exception():
            raise query.exception()
        if not counters.ended.wait(wait_s):
            raise RuntimeError("the stream's counters did not arrive")
    finally:
        spark.streams.removeListener(counters)


def block_samples(samples: DataFrame, blocks: DataFrame, late: str, longest: str) -> DataFrame:
    """Samples (ts) with the blocks (started, ended) that they lie in, as a join of two streams on `slot` and time.

    A block lasts `longest` at most, so its state goes once the watermark of both streams, `late` behind, has passed its start by that; a sample's
    state goes with the watermark.
    """
    s, b = samples.withWatermark("ts", late).alias("s"), blocks.withWatermark("started", late).alias("b")
    inside = (F.col("s.slot") == F.col("b.slot")) & (F.col("s.ts") >= F.col("b.started")) & (F.col("s.ts") <= F.col("b.started") + F.expr(f"interval {longest}")) & (F.col("s.ts") <= F.col("b.ended"))
    return s.join(b, inside).drop(F.col("b.slot"))
