"""Oriented boxes: candidate pairs, cells under boxes, greedy one-to-one matching and pair errors."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.functions import geometry as G
from sweepframe.operators import matching as K

FRAME = ["drive_id", "frame_index"]
#: What each object type counts as.
ROLES = {"Car": ("target", "Car"), "Pedestrian": ("target", "Pedestrian"), "Van": ("neighbour_ignore", "Car"), "Person (sitting)": ("neighbour_ignore", "Pedestrian")}
#: Marker colours, red, green and blue.
PALETTE = [(0.12, 0.47, 0.71), (1.0, 0.5, 0.05), (0.17, 0.63, 0.17), (0.84, 0.15, 0.16), (0.58, 0.4, 0.74), (0.55, 0.34, 0.29), (0.89, 0.47, 0.76), (0.5, 0.5, 0.5), (0.74, 0.74, 0.13), (0.09, 0.75, 0.81)]


def role(object_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (r, _) in ROLES.items():
        out = F.when(object_type == k, r).otherwise(out)
    return F.coalesce(out, F.lit("unmapped"))


def class_name(object_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, (_, c) in ROLES.items():
        out = F.when(object_type == k, c).otherwise(out)
    return out


def eligible(state: Column, occlusion: Column, truncation: Column) -> Column:
    return (state == 2) & occlusion.isin(0, 1) & truncation.isin(0, 1)


def invalid_reason(score: Column, length: Column, width: Column, name: Column) -> Column:
    """The first rule that a detection breaks, or null."""
    return F.when(score.isNull() | F.isnan(score), "score_not_finite").when((score < 0) | (score > 1), "score_range").when((length <= 0) | (width <= 0), "size").when(name.isNull() | (name == ""), "class")


def model_box(x: Column, y: Column, z: Column, height: Column, width: Column, length: Column, yaw: Column) -> list[Column]:
    """A tracklet pose (bottom centre, height/width/length) as a model box: centre, length/width/height, yaw turned by a quarter and wrapped."""
    return [-y, x, z + height / 2, length, width, height, G.wrap(yaw + math.pi / 2)]


def cells_of_boxes(boxes: DataFrame, size: float, side: float = 50.0, keys: list[str] = FRAME) -> DataFrame:
    """(keys, track_id, px, py) of grid cells that a footprint touches: the cells of its bounding square, then a separating-axis test."""
    reach_x = F.col("len") / 2 * F.abs(F.cos("yaw")) + F.col("wid") / 2 * F.abs(F.sin("yaw"))
    reach_y = F.col("len") / 2 * F.abs(F.sin("yaw")) + F.col("wid") / 2 * F.abs(F.cos("yaw"))

    def run(c: str, reach: Column) -> Column:
        # One cell more below, as a footprint that ends on a line touches the cell below it.
        return F.sequence((F.floor((F.col(c) - reach + side) / size) - 1).cast("int"), F.floor((F.col(c) + reach + side) / size).cast("int"))

    out = boxes.withColumn("px", F.explode(run("cx", reach_x))).withColumn("py", F.explode(run("cy", reach_y)))
    mid = [(F.col(c) + 0.5) * size - side for c in ("px", "py")]
    return out.where(G.axes_overlap(F.col("cx"), F.col("cy"), F.col("len"), F.col("wid"), F.col("yaw"), *mid, size / 2)).select(*keys, "track_id", "px", "py")


def pairs(dets: DataFrame, boxes: DataFrame, keys: list[str], oriented: bool = False, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] = G.oriented_overlap) -> DataFrame:
    """det_id, track_id and iou > 0 within keys. Both sides of a group meet in a kernel that measures equal footprints once and hands its pairs on a block at a time,
    so a task holds a group's rows, never its pairs.

    measure: the variant for oriented boxes, G.oriented_overlap (parity) or G.clipped_overlap (evaluation).
    """
    overlap = G.screened(measure) if oriented else G.aligned_overlap
    place = ["cx", "cy", "len", "wid", *(["yaw"] if oriented else [])]
    left = dets.select(*keys, F.lit(True).alias("_det"), "det_id", "score", *place)
    both = left.unionByName(boxes.select(*keys, F.lit(False).alias("_det"), "track_id", *place), allowMissingColumns=True)
    kinds = dict(both.dtypes)

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        a, b = (t.filter(m).combine_chunks() for m in (t.column("_det"), pc.invert(t.column("_det"))))
        if not len(a) or not len(b) or not all(k.is_valid for k in key):
            return
        for i, j, v in K.near_rows(footprint_rows(a, oriented), footprint_rows(b, oriented), overlap):
            if len(i):
                out = group_table(key, keys, {"det_id": a.column("det_id").take(i), "score": a.column("score").take(i), "track_id": b.column("track_id").take(j), "iou": pa.array(v)})
                yield from out.combine_chunks().to_batches()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, "det_id", "score", "track_id")) + ", iou double"
    return dealt(both, keys).groupBy(*keys).applyInArrow(run, schema)


def greedy(frame: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """One group's matches, plainly (`match` doesn't list single pairs): predictions by falling score take their best free box; ties go to smaller ids."""
    taken, rows = set(), []
    order = frame.drop_duplicates("det_id").sort_values(["score", "det_id"], ascending=[False, True])
    near = {k: list(zip(-g["iou"], g["track_id"], strict=True)) for k, g in frame[frame["iou"].notna()].groupby("det_id")}
    ignored = dict(zip(frame["det_id"], frame["ignore_iou"], strict=True))
    for det, score in zip(order["det_id"], order["score"], strict=True):
        free = sorted(p for p in near.get(det, []) if p[1] not in taken)
        best, track = (-free[0][0], free[0][1]) if free else (0.0, None)
        if track is not None and best >= threshold:
            taken.add(track)
            rows.append((det, score, track, best, "true_positive"))
        else:
            rows.append((det, score, None, best, "ignored" if ignored[det] >= threshold else "false_positive"))
    return pd.DataFrame(rows, columns=["det_id", "score", "track_id", "iou", "disposition"])


def match(dets: DataFrame, targets: DataFrame, ignores: DataFrame, keys: list[str], threshold: float, oriented: bool = False) -> DataFrame:
    """(keys, det_id, score, track_id, iou, disposition) per detection, an id that a group has several times once, with its highest score. iou: the overlap with
    the best target that was free. Detections and boxes of a group (a frame and class) meet in a kernel, whose pairs never leave it.
    """
    overlap = G.screened(G.oriented_overlap) if oriented else G.aligned_overlap
    place = ["cx", "cy", "len", "wid", *(["yaw"] if oriented else [])]
    kinds = dict(dets.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by([("score", "descending"), *((c, "ascending") for c in ("det_id", *place))])
        ids = left.column("det_id").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
        left = left.take(np.sort(np.unique(ids, return_index=True)[1]))
        if not len(left) or not all(k.is_valid for k in key):
            right = right.slice(0, 0)
        own, box, target = footprint_rows(left, oriented), footprint_rows(right, oriented), right.column("target").to_pandas().to_numpy(bool)
        tracks = right.column("track_id").combine_chunks().filter(pa.array(target))
        ranks = pc.rank(tracks, tiebreaker="dense").to_numpy().astype(np.int64) - 1
        taken, best = (np.array(x) for x in K.Near(own, box[target], ranks, overlap).take(np.arange(len(left)), threshold))
        hit = taken >= 0
        ignore, _ = K.best_other(own, box[~target], np.zeros(int((~target).sum()), np.int64), overlap)
        state = pa.array(["true_positive", "ignored", "false_positive"]).take(pa.array(np.where(hit, 0, np.where(ignore >= threshold, 1, 2)), pa.int64()))
        track = tracks.take(pa.array(np.unique(ranks, return_index=True)[1], pa.int64())).take(pa.array(taken, pa.int64(), mask=~hit))
        return group_table(key, keys, {"det_id": left.column("det_id"), "score": left.column("score"), "track_id": track, "iou": pa.array(best, pa.float64()), "disposition": state})

    left = dets.select(*keys, F.col("det_id").cast("long").alias("det_id"), F.col("score").cast("double").alias("score"), *place)
    right, other = (df.select(*keys, F.lit(t).alias("target"), F.col("track_id").cast("long").alias("track_id"), *place) for df, t in ((targets, True), (ignores, False)))
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", det_id long, score double, track_id long, iou double, disposition string"
    return dealt(left, keys).groupBy(*keys).cogroup(dealt(right.unionByName(other), keys).groupBy(*keys)).applyInArrow(run, schema)


def match_counts(records: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """True and false positives and misses per keys; targets without a detection count."""
    n = targets.groupBy(*keys).agg(F.count("*").alias("n_targets"))
    found = records.groupBy(*keys).agg(*(F.count_if(F.col("disposition") == k).alias(a) for k, a in (("true_positive", "tp"), ("false_positive", "fp"), ("ignored", "ignored"))))
    out = found.join(n, keys, "full").fillna(0)
    return out.withColumn("fn", F.col("n_targets") - F.col("tp")).drop("n_targets")


def pair_errors(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """Displacements, relative size, direction and score differences of matched boxes, and whether their classes are equal."""
    dx, dy, dz = (a[c] - b[c] for c in ("cx", "cy", "cz"))
    return {
        "xy_error": F.hypot(dx, dy), "z_error": F.abs(dz), "error_3d": F.sqrt(dx * dx + dy * dy + dz * dz),
        "length_error": F.abs(a["len"] - b["len"]) / a["len"], "width_error": F.abs(a["wid"] - b["wid"]) / a["wid"], "height_error": F.abs(a["hgt"] - b["hgt"]) / a["hgt"],
        "yaw_degrees": G.heading_degrees(a["yaw"], b["yaw"]), "axis_degrees": G.axis_degrees(a["yaw"], b["yaw"]), "flip": G.is_flip(a["yaw"], b["yaw"]),
        "score_error": F.abs(a["score"] - b["score"]), "class_equal": a["object_type"] == b["object_type"],
    }


def detection_order() -> list[Column]:
    """The canonical order of detections: falling score, then class, place and size."""
    return [F.desc("score"), F.asc("object_type"), F.asc("cx"), F.asc("cy"), F.asc("len"), F.asc("wid"), F.asc("det_id")]


def footprint_rows(t: pa.Table, oriented: bool) -> np.ndarray:
    """Rows of centre, length, width (and direction) of a group; null as NaN, which overlaps with nothing."""
    return np.stack([t.column(c).to_pandas().to_numpy(float) for c in ("cx", "cy", "len", "wid", *(["yaw"] if oriented else []))], axis=1)


def group_table(key: tuple, keys: list[str], columns: dict[str, pa.Array]) -> pa.Table:
    """columns beside the group's key."""
    n = len(next(iter(columns.values())))
    return pa.table({k: pa.repeat(v, n) for k, v in zip(keys, key, strict=True)} | columns)


def dealt(df: DataFrame, keys: list[str]) -> DataFrame:
    """df by keys, in at least two parts a core: a group's kernel takes long for the few bytes that it reads, so parts must not be put together by their size."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


def best_partners(frame: pd.DataFrame) -> pd.DataFrame:
    """One group's pairs, plainly (parity_matches doesn't list single pairs): references in their order take the free candidate of highest overlap; ties go to the candidate that is earlier in its own order."""
    taken, rows, done = set(), [], None
    order = sorted(zip(frame["place"], -frame["iou"], frame["other_place"], frame["det_id"], frame["other_id"], strict=True))
    for place, negative, _, det, other in order:
        if place != done and other not in taken:
            done = place
            taken.add(other)
            rows.append((det, other, -negative))
    return pd.DataFrame(rows, columns=["det_id", "other_id", "iou"])


def parity_matches(reference: DataFrame, candidate: DataFrame, keys: list[str], threshold: float = 0.5, oriented: bool = True) -> DataFrame:
    """(keys, det_id, other_id, iou, kind): matches of two backends' detections of a frame and class, then what either has alone (missing, extra).

    Both sides have unique det_id and the columns of the canonical order. References in their order take the free candidate of highest overlap; ties go to the one
    that is earlier in its own order. A group is one frame and class, whose pairs stay inside its kernel.
    """

    def placed(df: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*detection_order()))
        return df.select(*keys, F.col("det_id").cast("long").alias("det_id"), "cx", "cy", "len", "wid", *(["yaw"] if oriented else []), place.alias("place"))

    reference, candidate = dealt(reference, keys), dealt(candidate, keys)
    measure = G.screened(G.oriented_overlap, threshold) if oriented else G.aligned_overlap
    kinds = dict(reference.dtypes)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = [t.column("det_id").to_numpy() for t in (left, right)]
        place = [t.column("place").to_numpy().astype(np.int64) for t in (left, right)]
        taken, best = np.full(len(left), -1), np.zeros(len(left))
        if len(left) and len(right) and all(k.is_valid for k in key):
            order = np.argsort(place[0], kind="stable")
            near = K.Near(footprint_rows(left, oriented), footprint_rows(right, oriented), place[1], measure, threshold)
            taken[order], best[order] = near.take(order, threshold)
        at = np.zeros(len(right) + 1, np.int64)
        at[place[1]] = np.arange(len(right))
        hit = taken >= 0
        other = at[taken[hit]]
        alone = np.setdiff1d(np.arange(len(right)), other)
        n = [int(hit.sum()), int((~hit).sum()), len(alone)]
        none = [pa.nulls(k, pa.int64()) for k in n]
        return group_table(key, keys, {
            "det_id": pa.concat_arrays([pa.array(ids[0][hit]), pa.array(ids[0][~hit]), none[2]]), "other_id": pa.concat_arrays([pa.array(ids[1][other]), none[1], pa.array(ids[1][alone])]),
            "iou": pa.concat_arrays([pa.array(best[hit]), pa.nulls(n[1] + n[2], pa.float64())]), "kind": pa.concat_arrays([pa.repeat(v, k) for v, k in zip(("match", "missing", "extra"), n, strict=True)]),
        })

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", det_id long, other_id long, iou double, kind string"
    return placed(reference).groupBy(*keys).cogroup(placed(candidate).groupBy(*keys)).applyInArrow(run, schema)
