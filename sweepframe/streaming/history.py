"""Bounded per-sensor history over arriving messages: as a stateful stream, and as a batch twin for stored logs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

OUT = "sensor long, arrival_seq long, reset string, depth int, history array<long>"
#: Results that leave a task together.
STEP = 10_000
STATE = "last long, kept array<long>"


def batch_history(messages: DataFrame, depth: int, gap_us: int) -> DataFrame:
    """(sensor, arrival_seq, reset, depth): how many earlier messages each has as its history.

    History restarts where the stamp isn't after the previous arrival's (time_regression) or is over gap_us after it (gap; 0 turns that off).
    Nothing is dropped for lateness.
    """
    w = Window.partitionBy("sensor").orderBy("arrival_seq")
    before = F.lag("stamp_us").over(w)
    reset = F.when(F.col("stamp_us") <= before, "time_regression").when((F.lit(gap_us) > 0) & (F.col("stamp_us") - before > gap_us), "gap")
    rows = messages.withColumn("reset", reset).withColumn("_session", F.count("reset").over(w))
    place = F.row_number().over(Window.partitionBy("sensor", "_session").orderBy("arrival_seq"))
    return rows.select("sensor", "arrival_seq", "reset", F.least(F.lit(depth), place - 1).alias("depth"))


def batch_members(messages: DataFrame, depth: int, gap_us: int) -> DataFrame:
    """(sensor, arrival_seq, history): the numbers of the messages that each has as its history, nearest first."""
    own = batch_history(messages, depth, gap_us)
    w = Window.partitionBy("sensor").orderBy("arrival_seq").rowsBetween(-depth, -1)
    kept = F.reverse(F.collect_list("arrival_seq").over(w))
    return own.select("sensor", "arrival_seq", F.slice(kept, F.lit(1), F.col("depth")).alias("history"))


def counters(messages: DataFrame, depth: int, gap_us: int) -> DataFrame:
    """Per sensor what a node counts, for messages with n_points (valid ones), n_filtered and transform (known or not).

    A message without a valid point is rejected before it enters the history; one whose transform is missing isn't published but stays in it.
    """
    total = messages.groupBy("sensor").agg(F.count("*").alias("received"), F.count_if(F.col("n_points") == 0).alias("rejected_invalid"), F.sum(F.when(F.col("n_points") > 0, F.col("n_filtered")).otherwise(0)).alias("filtered_points"))
    valid = messages.where("n_points > 0")
    rows = batch_history(valid, depth, gap_us).join(valid.select("sensor", "arrival_seq", "transform"), ["sensor", "arrival_seq"])
    per = rows.groupBy("sensor").agg(F.count_if(~F.col("transform")).alias("transform_failures"), F.count_if("transform").alias("published"), F.count("reset").alias("resets"), F.max_by("depth", "arrival_seq").alias("depth"))
    return total.join(per, "sensor")


def stream_history(messages: DataFrame, depth: int, gap_us: int) -> DataFrame:
    """The same over a stream, with the kept messages' numbers, nearest first. State holds at most `depth` numbers a sensor, no points.

    Of a micro-batch a task holds two numbers a message; results leave it STEP at a time.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kept = state.get if state.exists else (None, [])
        parts = [(b["arrival_seq"].to_numpy(), b["stamp_us"].to_numpy()) for b in batches]
        seq, stamp = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(seq, kind="stable")
        seq, stamp = seq[order], stamp[order]
        before = np.concatenate([[stamp[0] if last is None else last], stamp[:-1]])
        back, gap = stamp <= before, (stamp - before > gap_us) & (gap_us > 0)
        if last is None:
            back[0] = gap[0] = False
        # The kept numbers, oldest first, then the new ones; each one's history begins where the last reset was.
        every = np.concatenate([np.array(list(kept)[::-1], np.int64), seq])
        place = np.arange(len(every) - len(seq), len(every))
        start = np.maximum.accumulate(np.where(back | gap, place, 0))
        state.update((int(stamp[-1]), every[max(start[-1], len(every) - depth) :][::-1].tolist()))
        size = np.minimum(depth, place - start)
        for at in range(0, len(seq), STEP):
            rows = slice(at, at + STEP)
            reset = np.where(back[rows], "time_regression", np.where(gap[rows], "gap", None))
            history = [every[p - n : p][::-1].tolist() for p, n in zip(place[rows].tolist(), size[rows].tolist(), strict=True)]
            yield pd.DataFrame({"sensor": key[0], "arrival_seq": seq[rows], "reset": reset, "depth": size[rows].astype(np.int32), "history": history})

    return messages.select("sensor", "arrival_seq", "stamp_us").groupBy("sensor").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def keep_last(messages: DataFrame, depth: int, keys: list[str], order: str) -> DataFrame:
    """The newest rows of each key, as a queue of that depth holds them under overload."""
    return messages.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).where(F.col("_k") <= depth).drop("_k")


def windowed_latency(messages: DataFrame, width: str, late: str | None = None) -> DataFrame:
    """Counts and latency per tumbling window, batch or stream (with a watermark of `late`)."""
    rows = messages.withWatermark("ts", late) if late else messages
    return rows.groupBy(F.window("ts", width)).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("max")).select(F.col("window.start").alias("start"), "n", "mean", "max")


def replay(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stored sequence as a stream, oldest files first, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(path)
