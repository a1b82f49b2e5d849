"""Reproducible picks of frames: first unused by role, nearest to targets, and spread over the range of a value."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_unused(frames: DataFrame, roles: dict[str, tuple[Column, Column]], keys: list[str], index: str) -> DataFrame:
    """(keys, index, role): for each role in turn the first frame in its order that fits and that no earlier role took.

    roles: name -> (condition, order as a struct). One anti-join a role; roles are few and fixed.
    """
    chosen = None
    for name, (fits, order) in roles.items():
        left = frames if chosen is None else frames.join(chosen.select(*keys, index), [*keys, index], "left_anti")
        pick = left.where(fits).groupBy(*keys).agg(F.min_by(index, order).alias(index)).withColumn("role", F.lit(name))
        chosen = pick if chosen is None else chosen.unionByName(pick)
    return chosen


def nearest_to(frames: DataFrame, value: str, targets: list[float], band: float, keys: list[str], index: str) -> DataFrame:
    """For each target the unused frame nearest to it within a band; ties go to the smaller index."""
    off = {t: F.abs(F.col(value) - t) for t in targets}
    return first_unused(frames, {f"target_{t:g}": (off[t] <= band, F.struct(off[t], F.col(index))) for t in targets}, keys, index)


def display_picks(frames: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pick): six frames of a run (keys, n, lost, recall, iou, change): the best, the worst and the lower median by recall and median overlap (-1
    where there is none), the highest overflow, of those without overflow the one nearest to it in size, and the largest change against its pair.

    Ties go to the smaller key. One pass picks all but the fifth and the median.
    """
    iou, at = F.coalesce("iou", F.lit(-1.0)), F.struct(*keys)
    orders = {"best": F.struct(-F.col("recall"), -iou, *keys), "worst": F.struct("recall", iou, *keys), "overflow": F.struct(-F.col("lost"), *keys), "paired": F.struct(-F.col("change"), *keys)}
    top = frames.agg(*(F.min_by(at, v).alias(k) for k, v in orders.items()), F.min_by("n", orders["overflow"]).alias("_n"), F.count("*").alias("_c"))
    picks = top.select(F.explode(F.array(*(F.struct(F.col(k).alias("at"), F.lit(k).alias("pick")) for k in orders))).alias("r")).select("r.at.*", "r.pick")
    sized = frames.where("lost = 0").withColumn("_one", F.lit(1)).join(F.broadcast(top.select("_n", F.lit(1).alias("_one"))), "_one")
    near = sized.agg(F.min_by(at, F.struct(F.abs(F.col("n") - F.col("_n")), *keys)).alias("at")).where("at is not null").select("at.*", F.lit("no_overflow").alias("pick"))
    # The lower median's recall comes from counts of recalls; only frames of that recall are ranked.
    middle = frames.agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY recall)").alias("_m"))
    marked = frames.join(F.broadcast(middle), F.col("recall") <= F.col("_m"))
    below = marked.agg(F.count_if(F.col("recall") < F.col("_m")).alias("_b")).join(F.broadcast(top.select("_c")))
    tied = marked.where(F.col("recall") == F.col("_m")).withColumn("_k", F.row_number().over(Window.partitionBy("recall").orderBy(iou, *keys)))
    median = tied.join(F.broadcast(below), F.col("_k") + F.col("_b") == F.floor((F.col("_c") - 1) / 2) + 1).select(*keys, F.lit("median").alias("pick"))
    return picks.unionByName(near).unionByName(median)


def spanning(frames: DataFrame, value: str, count: int, keys: list[str], index: str) -> DataFrame:
    """`count` frames per key: nearest-rank quantiles of the value from 0 to 100 %, then again and again the frame farthest from those chosen.

    A group has one row per frame of a drive.
    """

    def pick(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values([value, index]).reset_index(drop=True)
        n = len(rows)
        chosen = list(dict.fromkeys(max(0, math.ceil(q * n / (count - 1)) - 1) for q in range(count))) if n else []
        while len(chosen) < min(count, n):
            values = rows[value].to_numpy()
            left = [k for k in range(n) if k not in set(chosen)]
            chosen.append(max(left, key=lambda k: (min(abs(values[k] - values[c]) for c in chosen), -int(rows[index][k]))))
        out = rows.loc[chosen, [index, value]].assign(pick=range(len(chosen)))
        for name, v in zip(keys, key, strict=True):
            out[name] = v
        return out[[*keys, index, value, "pick"]]

    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, index, value]) + ", pick long"
    return frames.select(*keys, index, value).groupBy(*keys).applyInPandas(pick, schema)


def reconstruction_frames(motion: DataFrame) -> DataFrame:
    """(drive_id, frame_index): 24 frames of each drive of (drive_id, frame_index, motion): five at the start, sixteen spread evenly, then of those not yet taken
    the one of lowest motion, of the motion nearest to the middle rank, and of highest motion. Ties go to the smaller index, at the highest to the larger.

    One row a frame is all that is ranked; ranks are within a drive.
    """
    last = motion.groupBy("drive_id").agg(F.max("frame_index").alias("last"))
    spread = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda r: F.floor((r * (F.col("last") - 11)) / 15) + 11)
    fixed = F.array(*(F.lit(k).cast("long") for k in (0, 1, 2, 5, 10)))
    taken = last.select("drive_id", F.explode(F.array_union(fixed, spread)).alias("frame_index")).distinct()
    w = Window.partitionBy("drive_id")
    ranked = motion.where("frame_index >= 11").withColumn("k", F.row_number().over(w.orderBy("motion", "frame_index")) - 1).withColumn("n", F.count("*").over(w))
    for order in (F.col("k"), F.struct(F.abs(2 * F.col("k") - (F.col("n") - 1)), "frame_index"), -F.col("k")):
        free = ranked.join(taken, ["drive_id", "frame_index"], "left_anti")
        taken = taken.unionByName(free.groupBy("drive_id").agg(F.min_by("frame_index", order).alias("frame_index")))
    return taken
