"""spark-submit job: audit of a point dataset as a JSON report with sorted keys.

    spark-submit -m sweepframe.jobs.audit --points TABLE --out FOLDER [--split NAME] [--normalization min_xyz] [--max-samples N] [--patch-size METRES]
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sweepframe.operators import points as P


def report(points: DataFrame, max_samples: int | None = None, normalization: str | None = None, patch_size: float | None = None) -> DataFrame:
    """One row per drive: coordinate statistics, label coverage and, with a patch size, grid totals."""
    if max_samples is not None:
        rank = F.row_number().over(Window.partitionBy("drive_id").orderBy("frame_index"))
        points = points.join(points.select(*P.FRAME).distinct().withColumn("_k", rank).where(F.col("_k") <= max_samples).drop("_k"), P.FRAME, "left_semi")
    grid = points
    if normalization == "min_xyz":
        points = P.min_xyz(points)
    out = P.coordinate_stats(points, ["drive_id"]).join(P.mapping_coverage(P.map_labels(points, P.TILE_CLASSES), ["drive_id"]), "drive_id")
    if patch_size:
        cells = P.grid_partition(grid, patch_size).groupBy("drive_id").agg(F.sum("occupied").alias("patches"), F.sum("empty").alias("empty_patches"))
        out = out.join(cells, "drive_id")
    return out


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--points", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--split")
    p.add_argument("--normalization", choices=["min_xyz"])
    p.add_argument("--max-samples", type=int)
    p.add_argument("--patch-size", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("audit").getOrCreate()
    points = spark.read.parquet(a.points)
    points = points.where(F.col("split") == a.split) if a.split else points
    out = report(points, a.max_samples, a.normalization, a.patch_size)
    out.select(F.to_json(F.struct(*sorted(out.columns))).alias("value")).write.mode("overwrite").text(a.out)


if __name__ == "__main__":
    main()
