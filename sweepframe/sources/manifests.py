"""Discovery of scans, labels and drives as joins of file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, length) of files below a folder; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path", "length")


def scan_manifest(spark: SparkSession, root: str, splits: dict[str, str]) -> DataFrame:
    """Scans below root/sequences/<id>/velodyne with their labels' paths and their split; sequences outside `splits` are left out."""
    named = spark.createDataFrame(sorted(splits.items()), "sequence string, split string")

    def found(folder: str, suffix: str, column: str) -> DataFrame:
        files = listing(spark, f"{root}/sequences", f"*{suffix}").where(F.col("path").contains(f"/{folder}/"))
        return files.select(F.regexp_extract("path", rf"sequences/(\d+)/{folder}/", 1).alias("sequence"), F.regexp_extract("path", rf"(\d+){suffix}$", 1).cast("long").alias("frame_index"), F.col("path").alias(column))

    pairs = found("velodyne", ".bin", "scan_path").join(found("labels", ".label", "label_path"), ["sequence", "frame_index"], "full")
    return pairs.join(F.broadcast(named), "sequence")


def pair_scans(scans: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status: paired, orphan_label or missing_label."""
    both = scans.withColumn("_s", F.lit(1)).join(labels.withColumn("_l", F.lit(1)), keys, "full")
    return both.select(*keys, F.when(F.col("_s").isNull(), "orphan_label").when(F.col("_l").isNull(), "missing_label").otherwise("paired").alias("status"))


def contiguity(frames: DataFrame) -> DataFrame:
    """Per drive: whether distinct frames are numbered 0, 1, ... without a gap."""
    out = frames.groupBy("drive_id").agg(F.count("*").alias("frames"), F.min("frame_index").alias("first"), F.max("frame_index").alias("last"))
    return out.withColumn("contiguous", (F.col("first") == 0) & (F.col("frames") == F.col("last") + 1))


def tiles(spark: SparkSession, root: str, split: str, suffixes: tuple[str, ...] = (".las", ".laz")) -> DataFrame:
    """(place, path, rel_path, readable) of the tiles of a split's own folder, in the order of their lower-cased relative paths; compressed ones aren't readable here."""
    files = listing(spark, f"{root.rstrip('/')}/{split}")
    rel = F.regexp_extract("path", rf"/({split}/.*)$", 1)
    found = files.select("path", rel.alias("rel_path")).where(F.lower("path").rlike("(" + "|".join(s.replace(".", "[.]") for s in suffixes) + ")$"))
    place = F.row_number().over(Window.orderBy(F.lower("rel_path"), "rel_path"))  # one row per file of a folder
    return found.select(place.alias("place"), "path", "rel_path", F.lower("path").endswith(".las").alias("readable"))
