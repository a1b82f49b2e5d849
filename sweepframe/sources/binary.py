"""Binary point files: float records, packed labels, LAS tiles and point-cloud messages.

Files are read by Spark's binaryFile source, so any file system that Spark knows will do, and decoded in Arrow batches of bounded size.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import NativeFile
from pyarrow.fs import FileSystem, FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage

from sweepframe.sources.ranges import file_system

STEP = 1 << 16
#: Bytes of a point field by its datatype code.
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 2, 5: 4, 6: 4, 7: 4, 8: 8}


def decoded(spark: SparkSession, path: str, glob: str, read: Callable[[memoryview], dict[str, np.ndarray]], schema: str) -> DataFrame:
    """(path, row_idx, ...) for each record of each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                columns = read(memoryview(content.as_buffer()))
                n = len(next(iter(columns.values())))
                for a in range(0, n, STEP):
                    m = min(STEP, n - a)
                    arrays = [pa.array([name.as_py()] * m), pa.array(np.arange(a, a + m))] + [pa.array(v[a : a + m]) for v in columns.values()]
                    yield pa.RecordBatch.from_arrays(arrays, names=["path", "row_idx", *columns])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return files.select("path", "content").mapInArrow(run, f"path string, row_idx long, {schema}")


def read_points(spark: SparkSession, path: str, fields: tuple[str, ...] = ("x", "y", "z", "remission"), glob: str = "*.bin", strict: bool = False) -> DataFrame:
    """Little-endian float32 records. A size that isn't whole records fails the job; so do empty files and non-finite values where strict."""
    width = 4 * len(fields)

    def read(data: memoryview) -> dict[str, np.ndarray]:
        if len(data) % width or strict and not data:
            raise ValueError(f"{len(data)} bytes are not whole records of {width}")
        rows = np.frombuffer(data, "<f4").reshape(-1, len(fields))
        if strict and not np.isfinite(rows).all():
            raise ValueError("a record holds a non-finite value")
        return {f: np.ascontiguousarray(rows[:, k]) for k, f in enumerate(fields)}

    return decoded(spark, path, glob, read, ", ".join(f"{f} float" for f in fields))


def read_labels(spark: SparkSession, path: str, glob: str = "*.label") -> DataFrame:
    """Packed 32-bit labels with their halves: semantic class and instance."""

    def read(data: memoryview) -> dict[str, np.ndarray]:
        if len(data) % 4:
            raise ValueError(f"{len(data)} bytes are not whole labels")
        return {"packed": np.frombuffer(data, "<u4").astype(np.int64)}

    out = decoded(spark, path, glob, read, "packed long")
    return out.withColumns({"semantic_id": F.col("packed").bitwiseAND(F.lit(65535)).cast("int"), "instance_id": F.shiftrightunsigned("packed", 16).cast("int")})


#: A record of LAS point format 0.
LAS_RECORD = np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user_data", "u1"), ("point_source", "<u2")])


def las_head(count: int, scale: float = 0.001) -> bytes:
    """The header of a LAS 1.2 tile of so many records of point format 0."""
    head = bytearray(227)
    head[:4], head[24:26] = b"LASF", b"\x01\x02"
    head[94:100] = (227).to_bytes(2, "little") + (227).to_bytes(4, "little")
    head[105:111] = LAS_RECORD.itemsize.to_bytes(2, "little") + count.to_bytes(4, "little")
    head[131:179] = np.array([scale] * 3 + [0.0] * 3, "<f8").tobytes()
    return bytes(head)


def las_records(xyz: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> bytes:
    rows = np.zeros(len(xyz), LAS_RECORD)
    rows["xyz"], rows["classification"] = np.rint(xyz / scale), classification
    return rows.tobytes()


def las_tile(xyz: np.ndarray, classification: np.ndarray, scale: float = 0.001) -> bytes:
    """A LAS 1.2 tile of point format 0."""
    return las_head(len(xyz), scale) + las_records(xyz, classification, scale)


def read_las(spark: SparkSession, path: str, glob: str = "*.las", fields: tuple[str, ...] = ("x", "y", "z", "intensity", "classification")) -> DataFrame:
    """LAS 1.0-1.3 tiles of point formats 0-3: scaled coordinates and the wanted fields; others aren't built."""
    kinds = {"x": "double", "y": "double", "z": "double", "intensity": "int", "classification": "int", "user_data": "int", "point_source": "int", "gps_time": "double", "red": "int", "green": "int", "blue": "int"}

    def read(data: memoryview) -> dict[str, np.ndarray]:
        if data[:4] != b"LASF":
            raise ValueError("no LAS file")
        start = int.from_bytes(data[96:100], "little")
        kind, size, count = data[104], int.from_bytes(data[105:107], "little"), int.from_bytes(data[107:111], "little")
        if kind > 3:
            raise ValueError(f"point format {kind} is not supported")
        scale = np.frombuffer(data, "<f8", 6, 131)
        parts = [("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user_data", "u1"), ("point_source", "<u2")]
        parts += [("gps_time", "<f8")] if kind in (1, 3) else []
        parts += [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")] if kind in (2, 3) else []
        layout = np.dtype(parts)
        if layout.itemsize < size:
            layout = np.dtype([*parts, ("rest", f"V{size - layout.itemsize}")])
        if len(data) < start + count * size:
            raise ValueError(f"{count} points are declared, fewer are there")
        rows = np.frombuffer(data, layout, count, start)
        out = {}
        for f in fields:
            if f in ("x", "y", "z"):
                k = "xyz".index(f)
                out[f] = rows["xyz"][:, k] * scale[k] + scale[3 + k]
            elif f in (layout.names or ()):
                v = rows[f] & 31 if f == "classification" else rows[f]
                out[f] = v.astype(np.float64 if f == "gps_time" else np.int32)
            else:
                out[f] = np.zeros(count, np.float64 if f == "gps_time" else np.int32)
        return out

    return decoded(spark, path, glob, read, ", ".join(f"{f} {kinds[f]}" for f in fields))


def layout_problem(message: DataFrame) -> DataFrame:
    """message with `problem`: the first broken rule of its layout, or null."""
    sizes = F.create_map(*(F.lit(v) for kv in FIELD_BYTES.items() for v in kv))
    names = F.transform("fields", lambda f: f["name"])
    over = F.exists("fields", lambda f: f["offset"] + F.coalesce(F.try_element_at(sizes, f["datatype"]), F.lit(1 << 20)) * f["count"] > F.col("point_step"))
    problem = (
        F.when((F.col("height") <= 0) | (F.col("width") <= 0) | (F.col("point_step") <= 0), "dimensions")
        .when(F.col("row_step") < F.col("width") * F.col("point_step"), "row_step")
        .when(F.octet_length("data") != F.col("height") * F.col("row_step"), "length")
        .when(F.size(F.array_distinct(names)) != F.size(names), "duplicate_field")
        .when(over, "field_overflow")
    )
    return message.withColumn("problem", problem)


def decode_messages(messages: DataFrame, keys: list[str], fields: tuple[str, ...] = ("x", "y", "z"), on_non_finite: str = "drop") -> DataFrame:
    """(keys, row_idx, fields) of point-cloud messages, batch or stream; rows with non-finite values are dropped, or fail the job with 'raise'."""
    kinds = dict(messages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One message at a time, as a batch may hold many large payloads.
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                at = {f["name"]: f for f in row["fields"]}
                missing = [f for f in fields if f not in at or at[f]["datatype"] != 7 or at[f]["count"] != 1]
                if missing:
                    raise ValueError(f"no float fields {missing}")
                order = ">" if row["is_bigendian"] else "<"
                kind = np.dtype({"names": list(fields), "formats": [f"{order}f4"] * len(fields), "offsets": [at[f]["offset"] for f in fields], "itemsize": row["point_step"]})
                data = np.ndarray((row["height"], row["width"]), kind, row["data"], strides=(row["row_step"], row["point_step"])).reshape(-1)
                for low in range(0, max(1, len(data)), STEP):
                    columns = [data[f][low : low + STEP].astype(np.float32) for f in fields]
                    good = np.all([np.isfinite(c) for c in columns], axis=0)
                    if on_non_finite == "raise" and not good.all():
                        raise ValueError("a point holds a non-finite value")
                    n = int(good.sum())
                    arrays = [pa.repeat(pa.scalar(row[k], batch.schema.field(k).type), n) for k in keys] + [pa.array(low + np.flatnonzero(good))] + [pa.array(c[good]) for c in columns]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "row_idx", *fields])

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", row_idx long, " + ", ".join(f"{f} float" for f in fields)
    return messages.select(*keys, "height", "width", "fields", "is_bigendian", "point_step", "row_step", "data").mapInArrow(run, schema)


class ScanWriter(DataSource):
    """Sink of (drive_id, frame_index, data): one file per row in a folder of a file system that Arrow knows; another one is an error. Files appear whole, by
    moving, so a repeated task replaces what a lost one left. Option suffix names their kind."""

    @classmethod
    def name(cls) -> str:
        return "scan_files"

    def writer(self, schema, overwrite):  # noqa: ANN001, ANN201
        return _Writer(self.options["path"], self.options.get("suffix", ".bin"))


@contextmanager
def whole_file(where: FileSystem, base: str, drive_id: str, frame_index: int, suffix: str) -> Iterator[NativeFile]:
    """A stream into <base>/<drive_id>/<frame_index><suffix>, which appears by moving once all is written."""
    folder = f"{base.rstrip('/')}/{drive_id}"
    where.create_dir(folder, recursive=True)
    name = f"{folder}/{frame_index:010d}{suffix}"
    part = f"{name}.part{uuid.uuid4().hex}"
    with where.open_output_stream(part) as f:
        yield f
    if not isinstance(where, LocalFileSystem) and where.get_file_info(name).type != FileType.NotFound:
        where.delete_file(name)
    where.move(part, name)


class _Writer(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        file_system(path)  # fails here, not on the executors
        self.path, self.suffix = path, suffix

    def write(self, iterator):  # noqa: ANN001, ANN201
        where, base = file_system(self.path)
        for row in iterator:
            with whole_file(where, base, row["drive_id"], row["frame_index"], self.suffix) as f:
                f.write(row["data"])
        return WriterCommitMessage()


class FrameWriter(DataSource):
    """Sink of points (drive_id, frame_index, n_points, fields) that come frame by frame in their order: one file per frame, as ScanWriter's. Options: fields,
    kind ('float' or 'las', whose fields are x, y, z and a class) and suffix."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def writer(self, schema, overwrite):  # noqa: ANN001, ANN201
        return _FrameWriter(self.options["path"], self.options["suffix"], self.options["fields"].split(","), self.options["kind"] == "las")


class _FrameWriter(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str, fields: list[str], las: bool):
        file_system(path)  # fails here, not on the executors
        self.path, self.suffix, self.fields, self.las = path, suffix, fields, las

    def pieces(self, batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
        """((drive_id, frame_index, n_points), rows) of runs of one frame."""
        for batch in batches:
            keys = [batch.column(batch.schema.get_field_index(c)) for c in ("drive_id", "frame_index", "n_points")]
            ends = pc.run_end_encode(keys[0]).run_ends.to_pylist() + pc.run_end_encode(keys[1]).run_ends.to_pylist()
            low = 0
            for end in sorted(set(ends)):
                yield tuple(k[low].as_py() for k in keys), batch.slice(low, end - low)
                low = end

    def encoded(self, rows: pa.RecordBatch) -> bytes:
        columns = [rows.column(rows.schema.get_field_index(f)).to_numpy(zero_copy_only=False) for f in self.fields]
        if self.las:
            return las_records(np.stack(columns[:3], axis=1).astype(float), columns[3])
        return np.stack(columns, axis=1).astype("<f4").tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        where, base = file_system(self.path)
        for (drive, frame, n), pieces in itertools.groupby(self.pieces(iterator), key=lambda p: p[0]):
            written = 0
            with whole_file(where, base, drive, frame, self.suffix) as f:
                if self.las:
                    f.write(las_head(n))
                for _, rows in pieces:
                    f.write(self.encoded(rows))
                    written += rows.num_rows
                if written != n:
                    raise ValueError(f"{written} of {n} points of a frame came together")
        return WriterCommitMessage()
