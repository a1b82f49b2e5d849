"""Live transforms of arriving sweeps: sweeps and transform records as two streams that meet in one keyed state.

A sweep is settled in the order of arrival, as soon as every edge of the transform tree has a record at or after its time, or when it has waited for
`wait_us` of the watermark; a transform that isn't known by then rejects this sweep's output alone, and the sweep stays in the history of later ones.
Its pose is worked out once, when it is settled. State of a sensor: the records of the last `cache_us` and one before them for each edge, the sweeps that
wait, and the poses of at most `depth` sweeps; no points.

Event time is the time of arrival, so a stamp that goes back loses nothing: it restarts the history, as a gap does.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
RECORD = "edge int, ts_ns long, tx double, ty double, tz double, qw double, qx double, qy double, qz double"
OUT = "sensor string, frame_index long, history_rank int, source_index long, relative array<double>, accepted boolean, reset string"


def interpolated_matrix(records: list[tuple], ts: int) -> np.ndarray | None:
    """The 4x4 transform at ts of records (ts, translation, quaternion w x y z) in order of ts: of one at that time, or between two neighbours, linear in
    translation and spherical in rotation; None outside their time."""
    k = bisect.bisect_left(records, (ts,))
    if k == len(records):
        return None
    if records[k][0] == ts:
        place, turn = np.array(records[k][1:4]), np.array(records[k][4:8])
    elif k == 0:
        return None
    else:
        (t0, *a), (t1, *b) = records[k - 1], records[k]
        share = (ts - t0) / (t1 - t0)
        place = (1 - share) * np.array(a[:3]) + share * np.array(b[:3])
        p, q = np.array(a[3:]), np.array(b[3:])
        dot = float(p @ q)
        p, dot = (-p, -dot) if dot < 0 else (p, dot)
        theta = np.arccos(min(1.0, dot))
        turn = (1 - share) * p + share * q if dot > 0.9995 else (np.sin((1 - share) * theta) * p + np.sin(share * theta) * q) / np.sin(theta)
    w, x, y, z = turn / np.linalg.norm(turn)
    out = np.eye(4)
    out[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    out[:3, 3] = place
    return out


class SweepTransforms(StatefulProcessor):
    """Keyed by sensor; rows are sweeps (frame_index, ts_ns) or records (edge, ts_ns, translation, quaternion)."""

    def __init__(self, depth: int, edges: int, gap_ns: int, wait_us: int, cache_us: int):
        self.depth, self.edges, self.gap_ns, self.wait_us, self.cache_us = depth, edges, gap_ns, wait_us, cache_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.records = handle.getListState("records", RECORD)
        self.waiting = handle.getListState("waiting", "frame_index long, ts_ns long, arrived_us long")
        self.kept = handle.getListState("kept", "frame_index long, ts_ns long, pose array<double>")
        self.last = handle.getValueState("last", "ts_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = pd.concat(list(rows)).sort_values(["arrived_us", "ts_ns"], kind="stable")
        sweeps, records = new[new["edge"].isna() & new["frame_index"].notna()], new[new["edge"].notna()]
        known = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        known += [(int(r[0]), int(r[1]), *r[2:]) for r in records[["edge", "ts_ns", "tx", "ty", "tz", "qw", "qx", "qy", "qz"]].itertuples(index=False, name=None)]
        queue = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        for frame, ts, arrived in sweeps[["frame_index", "ts_ns", "arrived_us"]].astype("int64").itertuples(index=False, name=None):
            queue.append((frame, ts, arrived))
            self.handle.registerTimer((arrived + self.wait_us) // 1000)
        yield self.settle(key, known, queue, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        known = [tuple(r) for r in self.records.get()] if self.records.exists() else []
        queue = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        yield self.settle(key, known, queue, timerValues)

    def settle(self, key: tuple, known: list[tuple], queue: list[tuple], timer_values: object) -> pd.DataFrame:
        """Settles what can be settled from the front of the queue; writes the state."""
        now = timer_values.getCurrentWatermarkInMs() * 1000
        by_edge = [sorted(r[1:] for r in known if r[0] == k) for k in range(self.edges)]
        kept = [(r[0], r[1], list(r[2]) if r[2] is not None else None) for r in self.kept.get()] if self.kept.exists() else []
        last = self.last.get()[0] if self.last.exists() else None
        out = []
        while queue:
            frame, ts, arrived = queue[0]
            if not all(e and e[-1][0] >= ts for e in by_edge) and now < arrived + self.wait_us:
                break
            queue.pop(0)
            reset = None if last is None else "time_regression" if ts <= last else "gap" if self.gap_ns > 0 and ts - last > self.gap_ns else None
            kept, last = [] if reset else kept, ts
            pose = self.pose(by_edge, ts)
            rows = []
            for rank, (source, _, at) in enumerate([(frame, ts, pose), *kept]):
                relative = None if pose is None or at is None else (np.linalg.inv(np.reshape(pose, (4, 4))) @ np.reshape(at, (4, 4))).ravel().tolist()
                rows.append((key[0], frame, rank, source, relative))
            accepted = all(r[4] is not None for r in rows)
            out += [(*r, accepted, reset) for r in rows]
            kept = [(frame, ts, pose), *kept][: self.depth]
        # Records that no waiting or later sweep can need go, but for the last one of each edge before that time.
        horizon = min([q[1] for q in queue], default=last if last is not None else 0) - self.cache_us * 1000
        fresh = []
        for k, own in enumerate(by_edge):
            before = [r for r in own if r[0] < horizon]
            fresh += [(k, *r) for r in (before[-1:] + [r for r in own if r[0] >= horizon])]
        self.records.put(fresh) if fresh else self.records.clear()
        self.waiting.put(queue) if queue else self.waiting.clear()
        if kept:
            self.kept.put(kept)
        if last is not None:
            self.last.update((last,))
        return pd.DataFrame(out, columns=["sensor", "frame_index", "history_rank", "source_index", "relative", "accepted", "reset"])

    def pose(self, by_edge: list[list[tuple]], ts: int) -> list[float] | None:
        """The product of all edges' transforms at ts, 16 numbers; None where one isn't known."""
        out = np.eye(4)
        for own in by_edge:
            found = interpolated_matrix(own, ts)
            if found is None:
                return None
            out = out @ found
        return out.ravel().tolist()

    def close(self) -> None:
        pass


def sweep_transforms(sweeps: DataFrame, records: DataFrame, edges: int, depth: int, gap_ns: int = 0, wait_us: int = 200_000, cache_us: int = 10_000_000, late: str = "10 seconds") -> DataFrame:
    """OUT for each settled sweep and each of its history, nearest first, of two streams.

    sweeps: (sensor string, frame_index, ts_ns, arrived timestamp), where a null frame_index only moves the time on; records: (sensor, edge, ts_ns, tx, ty, tz,
    qw, qx, qy, qz, arrived). Edges are numbered from the fixed frame outwards. The session needs the RocksDB state store (PROVIDER).
    """
    none = [F.lit(None).cast(k.split()[1]).alias(k.split()[0]) for k in RECORD.split(", ") if not k.startswith("ts_ns")]
    s = sweeps.select("sensor", F.col("frame_index").cast("long").alias("frame_index"), "ts_ns", "arrived", *none)
    r = records.select("sensor", F.lit(None).cast("long").alias("frame_index"), "ts_ns", "arrived", F.col("edge").cast("int").alias("edge"), "tx", "ty", "tz", "qw", "qx", "qy", "qz")
    both = s.unionByName(r).withColumn("arrived_us", F.unix_micros("arrived")).withWatermark("arrived", late)
    return both.groupBy("sensor").transformWithStateInPandas(SweepTransforms(depth, edges, gap_ns, wait_us, cache_us), OUT, "append", "EventTime")


def run_to_end(stream: DataFrame, folder: str, conf: tuple[tuple[str, str], ...] = (PROVIDER,)) -> DataFrame:
    """What a stream appends until its sources are exhausted, as a table below folder, which also has its checkpoint."""
    spark = stream.sparkSession
    before = {k: spark.conf.get(k, None) for k, _ in conf}
    for k, v in conf:
        spark.conf.set(k, v)
    try:
        query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    if query.exception():
        raise query.exception()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
