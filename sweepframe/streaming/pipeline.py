"""From arriving point-cloud messages to model-ready points, micro-batch by micro-batch, with a sink that may be run again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.functions.numeric import ns_to_us
from sweepframe.operators import sweeps as S
from sweepframe.sources.binary import decode_messages

FRAME = ["drive_id", "frame_index"]


class ModelPointSink:
    """step is for foreachBatch of a stream of messages (drive_id, frame_index, ts_ns and the fields of a point cloud); points() is the result so far.

    A micro-batch deals its messages out, decodes them into a table of points by batch, finds the history of its frames among all frames so far, and moves the
    points of just the batches that hold these into its frames by the given static poses. How each sweep moves is stored first: that is a few rows a frame,
    which Spark broadcasts where they are few, so points are read where they lie. Each write replaces the whole folder of its batch, and the ledger's
    entry comes last: a batch that was cut short is written again, one that is in the ledger is left alone. So a restart changes no row.
    A frame's history is what had arrived by the end of its batch.
    """

    def __init__(self, poses: DataFrame, folder: str, depth: int, radius: float = 1.0, before_commit: Callable[[int], None] | None = None):
        self.poses, self.folder, self.depth, self.radius, self.before_commit = poses, folder, depth, radius, before_commit
        poses.sparkSession.createDataFrame([(0,)], "frames long").write.mode("ignore").parquet(f"{folder}/ledger/batch=-1")

    def batches(self) -> list[int]:
        """The batches that are whole."""
        ledger = self.poses.sparkSession.read.schema("frames long, batch long").parquet(f"{self.folder}/ledger")
        return sorted(r["batch"] for r in ledger.where("batch >= 0").select("batch").collect())

    def step(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id in self.batches():
            return
        spark = batch.sparkSession
        at = {name: f"{self.folder}/{name}/batch={batch_id}" for name in ("points", "frames", "moves", "out", "ledger")}
        decode_messages(batch.repartition(2 * spark.sparkContext.defaultParallelism), FRAME).write.mode("overwrite").parquet(at["points"])
        batch.select(*FRAME, ns_to_us(F.col("ts_ns")).alias("ts_us")).write.mode("overwrite").parquet(at["frames"])
        own = spark.read.parquet(at["frames"])
        frames = spark.read.schema(own.schema.add("batch", "long")).parquet(f"{self.folder}/frames").where(F.col("batch") <= batch_id)
        index = S.history_index(frames, self.depth).join(own.select(*FRAME), FRAME, "left_semi")
        moves = S.moves(S.sweep_transforms(index, self.poses), frames.drop("batch")).join(frames.select("drive_id", F.col("frame_index").alias("source_index"), "batch"), ["drive_id", "source_index"])
        moves.write.mode("overwrite").parquet(at["moves"])
        moves = spark.read.schema(moves.schema).parquet(at["moves"])
        needed = [r["batch"] for r in moves.select("batch").distinct().collect()]  # numbers of micro-batches, a few for each of this one's frames
        points = spark.read.schema(spark.read.parquet(at["points"]).schema.add("batch", "long")).parquet(f"{self.folder}/points").where(F.col("batch").isin(needed))
        model = S.moved_points(points.drop("batch"), moves.drop("batch"), self.radius)
        model.write.mode("overwrite").parquet(at["out"])
        if self.before_commit:
            self.before_commit(batch_id)
        own.agg(F.count("*").alias("frames")).write.mode("overwrite").parquet(at["ledger"])

    def points(self) -> DataFrame:
        """The model points of whole batches."""
        spark = self.poses.sparkSession
        schema = "drive_id string, frame_index long, history_rank int, src_row_idx long, x float, y float, z float, time_lag float, batch long"
        return spark.read.schema(schema).parquet(f"{self.folder}/out").where(F.col("batch").isin(self.batches())).drop("batch")


def run(messages: DataFrame, sink: ModelPointSink) -> DataFrame:
    """The model points of a stream of messages, until its source is exhausted."""
    query = messages.writeStream.foreachBatch(sink.step).option("checkpointLocation", f"{sink.folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return sink.points()
