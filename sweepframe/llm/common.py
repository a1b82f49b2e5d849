"""Shared pieces of the training-data operators: scratch tables, connected components and vectorised word shingles."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step holds; the arrays beside it take some 60 times as much.
STEP_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only on a single machine whose session names none (tests)."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_filter(df: DataFrame, ids: DataFrame, column: str, most: int = 2_000_000) -> DataFrame:
    """Rows of df whose column is in ids (a written table with a column of that name).

    The ids are counted first: up to `most` (16 MB) they are broadcast, so df isn't shuffled; beyond, it is a shuffled semi-join.
    """
    small = ids.count() <= most
    return df.join(F.broadcast(ids) if small else ids.hint("merge"), column, "left_semi")


def key_filter(df: DataFrame, keys: DataFrame, column: str, most: int = 2_000_000, hot: int = 1_000_000) -> DataFrame:
    """Rows of df whose column is in keys (a written table of that column and n, how often it counts), however many rows share a key.

    Up to `most` keys are broadcast. Beyond, those with n >= hot are, whose number is bounded by the rows of df over hot, and only rows of
    the others are shuffled by key, so no key with many rows meets in one task.
    """
    if keys.count() <= most:
        return df.join(F.broadcast(keys.select(column)), column, "left_semi")
    often = F.broadcast(keys.where(F.col("n") >= hot).select(column))
    return df.join(often, column, "left_semi").union(df.join(often, column, "left_anti").join(keys.where(F.col("n") < hot).select(column).hint("merge"), column, "left_semi"))


def key_join(df: DataFrame, keys: DataFrame, on: list[str], least: int = 1_000, most: int = 1_000_000) -> DataFrame:
    """df joined with keys (a written table, one row per key, n: how many rows of df have it), however many rows share a key.

    Keys with n >= least are broadcast and their rows not shuffled; `least` is raised where needed so that these are at most `most` keys, as their
    counts add up to no more than the rows of df. Rows of other keys are shuffled. df is read twice where there are such keys.
    """
    total = keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    least = max(least, -(-total // most))
    hot, rare = keys.where(F.col("n") >= least), keys.where(F.col("n") < least)
    if hot.isEmpty():
        return df.join(keys, on)
    return df.join(F.broadcast(hot), on).unionByName(df.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rare, on))


#: Neighbours from which an end of edges counts as a hub.
HUB = 20_000


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) for each id in edges (a, b): component is the smallest id reachable.

    Alternates large-star and small-star steps, which keep the number of edges and end in a star around each smallest id.
    Each round is written to the shared folder, so the lineage stays short. Degrees and smallest neighbours are pre-aggregated; the rows of
    hubs, of which there are at most the edges over HUB, get theirs from a broadcast table and are not shuffled, so a component
    with a third of all rows is no single task.
    """

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def known(rows: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
        """rows with the columns of low (one row per u)."""
        if hubs is None:
            return rows.join(low, "u")
        return rows.join(F.broadcast(low.join(F.broadcast(hubs), "u", "left_semi")), "u").unionByName(rows.join(F.broadcast(hubs), "u", "left_anti").join(low, "u"))

    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    before = mark(e)
    for _ in range(rounds):
        # Large star: every larger neighbour of a node is linked to the smallest neighbour.
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        hubs = None
        if before[0] > HUB:
            low = written(low, name)
            often = max(HUB, before[0] // 500_000)
            hubs = low.where(F.col("n") > often).select("u")
            hubs = None if hubs.isEmpty() else hubs
        large = known(both, low.drop("n"), hubs).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: every node and its smaller neighbours are linked to the smallest of them; a hub here was one above.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")
        e = written(known(large, low, hubs).select(moved).select("x.u", "x.v").where("u <> v").distinct(), name)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.col("v").alias("component")), F.struct(F.col("v").alias("id"), F.col("v").alias("component")))).alias("x")).select("x.*").distinct()


# ---------------------------------------------------------------------------------------------------------------- shingles

_MASK = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 1 << 64)
_rng = np.random.default_rng(20240229)
#: A random value per byte; A-Z have those of a-z, separators 0.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_P, _P_INVERSE)):
            x = np.full(n, np.uint64(base))
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def runs_of(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most` bytes each, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash per lower-cased word of all rows, number of words per row).

    A row longer than a step is taken in blocks that end at separators, so memory follows the block or the longest word.
    """
    hashes, starts = [], []
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + STEP_BYTES)
        if end < n:
            cut = np.flatnonzero(_SEPARATOR[data[at:end]])
            if len(cut):
                end = at + int(cut[-1]) + 1
            else:
                while end < n and not _SEPARATOR[data[end]]:
                    more = np.flatnonzero(_SEPARATOR[data[end : end + STEP_BYTES]])
                    end = end + int(more[0]) if len(more) else min(n, end + STEP_BYTES)
        block = data[at:end]
        sep = _SEPARATOR[block]
        first, last = ~sep, ~sep
        first[1:] &= sep[:-1]
        last[:-1] &= sep[1:]
        edge = offsets[(offsets > at) & (offsets < end)] - at
        first[edge] = ~sep[edge]
        last[edge - 1] = ~sep[edge - 1]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        if len(s):
            up, down = powers(len(block))
            total = np.add.accumulate(_BYTE[block] * up)
            h = total[e] - total[s] + _BYTE[block[s]] * up[s]
            hashes.append(mix(h * down[s] + (e - s + 1).astype(np.uint64)))
            starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), offsets))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of `width` words; one for each place where a run fits."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(width))
    for k in range(width):
        out += words[k : k + n] * _PLACE[k]
    return mix(out)


def shingle_rows(column: pa.Array, width: int = 5) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, the shingle hashes of each row in text order) for steps of bounded size.

    A row with fewer words than `width` has its whole word sequence as one shingle, a row without words none.
    """
    data, offsets = texts_of(column)
    for i, j in runs_of(offsets):
        words, counts = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        ends = np.cumsum(counts)
        whole = window_hashes(words, width)
        rows = []
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            rows.append(whole[end - n : end - width + 1] if n >= width else window_hashes(words[end - n : end], n) if n else whole[:0])
        yield i, rows


def signatures(sets: list[np.ndarray], size: int, seed: int = 7) -> np.ndarray:
    """MinHash values (len(sets), size) as uint32; rows of empty sets hold the largest value."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, size, dtype=np.uint64)
    lengths = np.array([len(s) for s in sets])
    out = np.full((len(sets), size), np.uint32(0xFFFFFFFF))
    full = np.flatnonzero(lengths)
    if not len(full):
        return out
    flat = np.concatenate([sets[k] for k in full])
    begins = np.concatenate(([0], np.cumsum(lengths[full])[:-1]))
    for k in range(size):
        out[full, k] = np.minimum.reduceat(flat * factors[k] + shifts[k], begins) >> np.uint64(32)
    return out
