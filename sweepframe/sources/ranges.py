"""Point files as a Spark data source that reads ranges of records: one large tile gives several tasks, and predicates decide which files are opened.

Files lie as <folder>/<drive_id>/<frame_index>.<suffix>, or anywhere below a folder; both ids come from the path. A file is cut into ranges of bytes,
and a task reads the records that begin in its range, a bounded number at a time, so its memory follows neither the file nor the range. Predicates on drive_id
and frame_index are pushed into the listing; a file that they rule out is never opened. Folders may be in any file system that Arrow knows (local, hdfs, s3,
gs, abfs); others are an error.
"""

from __future__ import annotations

import operator
import posixpath
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Records that a task decodes at a time.
STEP = 1 << 16
#: Tasks beyond one a file: ranges get longer rather than more.
TASKS = 512
KINDS = {"x": "double", "y": "double", "z": "double", "intensity": "int", "classification": "int", "user_data": "int", "point_source": "int", "gps_time": "double", "red": "int", "green": "int", "blue": "int"}
KEYS = "path string, drive_id string, frame_index long, row_idx long"
COMPARED = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path in it."""
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass
class Layout:
    """Where the records of a file are, and what is in one."""

    start: int
    count: int
    record: np.dtype
    scale: np.ndarray | None = None


def las_layout(head: bytes) -> Layout:
    """The layout that a LAS header declares: versions 1.0 to 1.4, point formats 0 to 3 and 6 to 8."""
    if head[:4] != b"LASF":
        raise ValueError("no LAS file")
    start, kind, size = int.from_bytes(head[96:100], "little"), head[104], int.from_bytes(head[105:107], "little")
    count = int.from_bytes(head[107:111], "little")
    if head[25] >= 4:
        count = int.from_bytes(head[247:255], "little") or count
    place, colours = [("xyz", "<i4", 3), ("intensity", "<u2")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
    if kind in (0, 1, 2, 3):
        parts = [*place, ("flags", "u1"), ("classification", "u1"), ("angle", "i1"), ("user_data", "u1"), ("point_source", "<u2")]
        parts += [("gps_time", "<f8")] if kind in (1, 3) else []
        parts += colours if kind in (2, 3) else []
    elif kind in (6, 7, 8):
        parts = [*place, ("flags", "<u2"), ("classification", "u1"), ("user_data", "u1"), ("angle", "<i2"), ("point_source", "<u2"), ("gps_time", "<f8")]
        parts += colours if kind in (7, 8) else []
        parts += [("near_infrared", "<u2")] if kind == 8 else []
    else:
        raise ValueError(f"point format {kind} is not supported")
    record = np.dtype(parts)
    if record.itemsize > size:
        raise ValueError(f"records of {size} bytes are too short for point format {kind}")
    if record.itemsize < size:
        record = np.dtype([*parts, ("rest", f"V{size - record.itemsize}")])
    return Layout(start, count, record, np.frombuffer(head, "<f8", 6, 131))


def las_column(rows: np.ndarray, name: str, layout: Layout) -> np.ndarray:
    if name in ("x", "y", "z"):
        k = "xyz".index(name)
        return rows["xyz"][:, k] * layout.scale[k] + layout.scale[3 + k]
    if name not in (layout.record.names or ()):
        return np.zeros(len(rows), np.float64 if name == "gps_time" else np.int32)
    short = name == "classification" and "near_infrared" not in layout.record.names and layout.record["flags"].itemsize == 1
    return (rows[name] & 31 if short else rows[name]).astype(np.float64 if name == "gps_time" else np.int32)


@dataclass
class Range(InputPartition):
    path: str
    size: int
    low: int
    high: int


class PointFiles(DataSource):
    """Options: path, format ('las' or 'float'), fields, rangeBytes (64 MB; longer where that would be over TASKS ranges)."""

    @classmethod
    def name(cls) -> str:
        return "point_files"

    def schema(self) -> str:
        fields, las = self.options["fields"].split(","), self.options.get("format", "las") == "las"
        return ", ".join([KEYS, *(f"{f} {KINDS[f] if las else 'float'}" for f in fields)])

    def reader(self, schema) -> RangeReader:  # noqa: ANN001
        return RangeReader(dict(self.options))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.fields, self.las = options["path"], options["fields"].split(","), options.get("format", "las") == "las"
        self.range_bytes = int(options.get("rangebytes", options.get("rangeBytes", 64 << 20)))
        self.wanted: list[tuple[str, object]] = []

    def pushFilters(self, filters) -> Iterator:  # noqa: ANN001, N802
        """Takes what compares drive_id or frame_index with values; Spark applies the rest."""
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column not in ("drive_id", "frame_index") or type(f) not in (*COMPARED, In):
                yield f
            elif isinstance(f, In):
                self.wanted.append((column, lambda v, values=frozenset(f.value): v in values))
            else:
                self.wanted.append((column, lambda v, compare=COMPARED[type(f)], value=f.value: compare(v, value)))

    def listed(self) -> Iterator[fs.FileInfo]:
        where, base = file_system(self.path)
        suffix = ".las" if self.las else ".bin"
        for info in where.get_file_info(fs.FileSelector(base, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(suffix):
                ids = dict(zip(("drive_id", "frame_index"), ids_of(info.path), strict=True))
                if all(ids[c] is not None and test(ids[c]) for c, test in self.wanted):
                    yield info

    def partitions(self) -> list[Range]:
        """Ranges of rangeBytes, or of what gives some TASKS of them where there would be more: the number of tasks doesn't grow with the bytes."""
        files = sorted(self.listed(), key=lambda i: i.path)
        step = max(self.range_bytes, -(-sum(i.size for i in files) // TASKS))
        return [Range(i.path, i.size, a, min(i.size, a + step)) for i in files for a in range(0, max(1, i.size), step)]

    def layout(self, file, size: int) -> Layout:  # noqa: ANN001
        if self.las:
            out = las_layout(file.read(min(size, 375)))
            if size < out.start + out.count * out.record.itemsize:
                raise ValueError(f"{out.count} points are declared, fewer are there")
            return out
        record = np.dtype([(f, "<f4") for f in self.fields])
        if size % record.itemsize:
            raise ValueError(f"{size} bytes are not whole records of {record.itemsize}")
        return Layout(0, size // record.itemsize, record)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.path)
        drive, frame = ids_of(partition.path)
        with where.open_input_file(partition.path) as file:
            layout = self.layout(file, partition.size)
            width = layout.record.itemsize
            # Records whose first byte is in the range; row_idx counts within the file.
            first, end = (min(layout.count, max(0, -(-(at - layout.start) // width))) for at in (partition.low, partition.high))
            file.seek(layout.start + first * width)
            for at in range(first, end, STEP):
                n = min(STEP, end - at)
                rows = np.frombuffer(file.read(n * width), layout.record, n)
                columns = [pa.array(las_column(rows, f, layout) if self.las else np.ascontiguousarray(rows[f])) for f in self.fields]
                keys = [pa.array([v] * n, kind) for v, kind in ((partition.path, pa.string()), (drive, pa.string()), (frame, pa.int64()))]
                yield pa.RecordBatch.from_arrays([*keys, pa.array(np.arange(at, at + n)), *columns], names=["path", "drive_id", "frame_index", "row_idx", *self.fields])


def ids_of(path: str) -> tuple[str | None, int | None]:
    """drive_id and frame_index of <drive_id>/<frame_index>.<suffix>."""
    folder, name = posixpath.split(path)
    number = name.split(".")[0]
    return posixpath.basename(folder) or None, int(number) if number.isdigit() else None


def read_ranges(spark: SparkSession, path: str, fields: tuple[str, ...], kind: str = "las", range_bytes: int = 64 << 20) -> DataFrame:
    """KEYS and the asked fields of each record of all files below path. The session's switch for pushing filters into Python sources is set, as it's off by default."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PointFiles)
    return spark.read.format("point_files").option("path", path).option("fields", ",".join(fields)).option("format", kind).option("rangeBytes", str(range_bytes)).load()
