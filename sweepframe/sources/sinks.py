"""Detections as message-shaped records and markers, point payloads, scan files and resumable ledgers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions.geometry import yaw_quaternion
from sweepframe.operators.boxes import PALETTE


def detection_messages(dets: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """One row per frame with an ordered array of records; frames without detections keep an empty one."""
    record = F.struct((-F.col("score")).alias("_order"), "det_id", F.struct(F.col("cx").alias("x"), F.col("cy").alias("y")).alias("position"), yaw_quaternion(F.col("yaw")).alias("orientation"), F.struct("object_type", "score").alias("hypothesis"))
    rows = dets.groupBy(*keys).agg(F.sort_array(F.collect_list(record)).alias("detections"))
    out = frames.join(rows, keys, "left")
    empty = F.array().cast(rows.schema["detections"].dataType)
    return out.withColumn("detections", F.transform(F.coalesce("detections", empty), lambda x: x.dropFields("_order")))


def markers(dets: DataFrame, keys: list[str]) -> DataFrame:
    """A box and a label marker per detection, and one row per frame that clears earlier ones."""
    colours = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, "rgb", strict=True))) for p in PALETTE))
    colour = F.element_at(colours, (F.pmod(F.hash("object_type"), F.lit(len(PALETTE))) + 1).cast("int"))
    kinds = F.array(F.struct(F.lit("box").alias("kind"), F.lit("").alias("text")), F.struct(F.lit("label").alias("kind"), F.format_string("%s %.2f", "object_type", "score").alias("text")))
    rows = dets.select(*keys, "det_id", "cx", "cy", "len", "wid", colour.alias("colour"), F.explode(kinds).alias("m")).select(*keys, "det_id", "cx", "cy", "len", "wid", "colour", "m.kind", "m.text")
    clear = dets.select(*keys).distinct().withColumn("kind", F.lit("delete_all"))
    return rows.unionByName(clear, allowMissingColumns=True)


#: States of a piece of work in the order in which they are reached.
STATES = ["PENDING", "RUNNING", "FAILED", "COMPLETE"]


def ledger_states(expected: DataFrame, entries: DataFrame, keys: list[str]) -> DataFrame:
    """keys, status and identity of each expected piece by the last of its entries (keys, seq, status, identity); PENDING without any. Once complete, it stays so."""
    last = entries.groupBy(*keys).agg(F.max(F.struct((F.col("status") == "COMPLETE").alias("done"), "seq", "status", "identity")).alias("_e"))
    return expected.join(last, keys, "left").select(*keys, F.coalesce("_e.status", F.lit("PENDING")).alias("status"), F.col("_e.identity").alias("identity"))


def ledger_totals(states: DataFrame) -> DataFrame:
    return states.groupBy("condition", "status").agg(F.count("*").alias("n"))


def resumable(states: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """What a resumed run with this identity does: pieces that are pending or were running. Failed pieces block their condition, and so do pieces of another
    identity; complete ones are never run again."""
    bad = (F.col("status") == "FAILED") | (F.col("identity").isNotNull() & (F.col("identity") != identity))
    blocked = states.where(bad).select("condition").distinct()
    return states.where(F.col("status").isin("PENDING", "RUNNING")).join(F.broadcast(blocked), "condition", "left_anti").select(*keys)


def append_results(results: DataFrame, path: str) -> None:
    """Results of pending work, a folder per condition; a repeated write replaces only the conditions that it holds."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("condition").parquet(path)


def payloads(points: DataFrame, keys: list[str], fields: tuple[str, ...] = ("x", "y", "z", "time_lag"), order: tuple[str, ...] = ("row_idx",)) -> DataFrame:
    """Points of each frame as a little-endian float payload with its layout. A group is one frame."""
    step = 4 * len(fields)

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        own = {k: pa.array([v.as_py()], rows.schema.field(k).type) for k, v in zip(keys, key, strict=True)}
        order_of = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order])
        data = np.empty((len(rows), len(fields)), "<f4")
        for i, f in enumerate(fields):
            data[:, i] = rows.column(f).take(order_of).to_numpy()
        n = len(data)
        numbers = {"height": 1, "width": n}, {"point_step": step, "row_step": step * n}
        ints = [{k: pa.array([v], pa.int32()) for k, v in part.items()} for part in numbers]
        return pa.table(own | ints[0] | {"is_bigendian": pa.array([False])} | ints[1] | {"data": pa.array([data.data.cast("B")], pa.binary())})

    kinds = dict(points.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", height int, width int, is_bigendian boolean, point_step int, row_step int, data binary"
    out = points.select(*keys, *dict.fromkeys((*fields, *order))).groupBy(*keys).applyInArrow(pack, schema)
    layout = F.array(*(F.struct(F.lit(f).alias("name"), F.lit(4 * i).alias("offset"), F.lit(7).alias("datatype"), F.lit(1).alias("count")) for i, f in enumerate(fields)))
    return out.withColumn("fields", layout)


def write_files(rows: DataFrame, path: str, suffix: str = ".bin") -> None:
    """rows (drive_id, frame_index, data binary) as path/<drive_id>/<frame_index><suffix>. path must be a folder that all executors share."""
    from sweepframe.sources.binary import ScanWriter

    rows.sparkSession.dataSource.register(ScanWriter)
    rows.select("drive_id", "frame_index", "data").write.format("scan_files").option("suffix", suffix).mode("append").save(path)


def streamed(points: DataFrame, path: str, fields: tuple[str, ...], kind: str, suffix: str) -> None:
    """One file per frame, path/<drive_id>/<frame_index><suffix>, of its points in the order of row_idx. They come to the writer in that order, a batch at a time,
    and how many a frame has comes with them, so a task's memory in Python follows neither frame nor file."""
    from sweepframe.sources.binary import FrameWriter

    keys = ["drive_id", "frame_index"]
    whole = Window.partitionBy(*keys).orderBy("row_idx").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = points.select(*keys, "row_idx", *dict.fromkeys(fields)).withColumn("n_points", F.count("*").over(whole)).sortWithinPartitions(*keys, "row_idx")
    points.sparkSession.dataSource.register(FrameWriter)
    rows.write.format("frame_files").option("fields", ",".join(fields)).option("kind", kind).option("suffix", suffix).mode("append").save(path)


def write_tiles(points: DataFrame, path: str) -> None:
    """One LAS tile per frame, path/<drive_id>/<frame_index>.las, of points x, y, z, label."""
    streamed(points, path, ("x", "y", "z", "label"), "las", ".las")


def write_scans(points: DataFrame, path: str, fields: tuple[str, ...] = ("x", "y", "z", "remission")) -> None:
    """One binary file per frame, path/<drive_id>/<frame_index>.bin. path must be a folder that all executors share."""
    streamed(points, path, fields, "float", ".bin")

