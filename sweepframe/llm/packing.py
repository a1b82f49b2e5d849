"""Operator 11: packing of tokenised documents into sequences of equal size, as a cutting-stock problem by column generation.

A document is the ids of its whole text and an end id. Of each document, sequences are filled whole as far as it goes; what is left over, shorter than a
sequence, is an item. Items are counted by length. A linear program over patterns (lengths that add up to one sequence exactly) leaves the fewest
items without a pattern; its columns are priced by the knapsack problem of the dual values, solved by dynamic programming over the exact fill. Patterns are
rounded down, then one more of each is taken while the items last. Ranked items of each length take the places of the rounded patterns; the
others lie end to end and are cut at the sequences' ends, and the last, partly filled sequence becomes one sequence for each power of two of its
length. So no sequence has padding (a sequence as long as a power of two isn't padded).

The program sees the histogram alone, at most one count for each length below the sequence size, whatever the number of documents. An item's rank comes from
running numbers within a task and the tasks' counts before it, so no length with many items meets in one task.

Defined results: a null or empty text is its end id alone; repeated rows, also of one id, are packed each on their own; texts of any length are cut; of equal
items the order of the input files decides; extra columns, whatever their names, are left out unless kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sweepframe.llm.chunks import Chunks, Lists, byte_tokenizer, id_lists
from sweepframe.llm.common import written

TOKENS = "_part int, _row long, _n long, _full long, _rest int, _rank long, _ids binary"
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: Most rows of (task, length, items before) that are broadcast (24 MB); beyond, they meet the items by a shuffle.
MOST_COUNTS = 1_000_000


# ------------------------------------------------------------------------------------------------------------- the program


def priced(lengths: np.ndarray, y: np.ndarray, size: int, most: int) -> list[tuple[float, np.ndarray]]:
    """Up to `most` different patterns of exactly `size` with the highest sums of y, best first, as (sum, count per length); one for each last length."""
    best, last = np.full(size + 1, -np.inf), np.full(size + 1, -1)
    best[0] = 0
    fits = np.searchsorted(lengths, np.arange(size + 1), "right")
    for c in range(1, size + 1):
        k = fits[c]
        if k:
            sums = best[c - lengths[:k]] + y[:k]
            last[c] = at = int(sums.argmax())
            best[c] = sums[at]
    sums = best[size - lengths] + y
    found, seen = [], set()
    for at in np.argsort(-sums, kind="stable")[:most]:
        if sums[at] == -np.inf:
            break
        counts, c = np.zeros(len(lengths), np.int64), size - lengths[at]
        counts[at] += 1
        while c:
            counts[last[c]] += 1
            c -= lengths[last[c]]
        if (key := counts.tobytes()) not in seen:
            seen.add(key)
            found.append((float(sums[at]), counts))
    return found


def relaxed(lengths: np.ndarray, b: np.ndarray, size: int, tolerance: float, columns: int, patience: int = 8) -> list[tuple[float, np.ndarray]]:
    """The linear program by the revised simplex method: (times, pattern) of the patterns in use.

    It ends when the tokens without a pattern are within tolerance (a share of all) of none or of the least there can be, or didn't get fewer by that in
    `patience` rounds of pricing. Items without a pattern cost their tokens; of equal sums, larger items and those that many wait of come first.
    """
    m, total = len(lengths), float(b @ lengths)
    price = lengths - 0.5
    inverse, x, cost = np.eye(m), b.astype(float), price.copy()
    basis: list[np.ndarray | int] = list(range(m))  # a pattern, or the length whose items have none
    near, lefts = tolerance * total, [float("inf")] * patience

    def enter(column: np.ndarray, own: float, what: np.ndarray | int) -> None:
        used = np.flatnonzero(column)
        d = inverse[:, used] @ column[used]
        if own - cost @ d > -1e-6:
            return
        up = np.flatnonzero(d > 1e-9)
        ratios = x[up] / d[up]
        row = up[np.lexsort((-d[up], np.round(ratios, 9)))[0]]
        step = max(0.0, x[row] / d[row])
        x[:] -= step * d
        x[row] = step
        inverse[row] /= d[row]
        d[row] = 0
        some = np.flatnonzero(np.abs(d) > 1e-12)
        inverse[some] -= np.outer(d[some], inverse[row])
        cost[row], basis[row] = own, what

    while True:
        y = cost @ inverse
        lefts.append(float(cost @ x))
        if lefts[-1] <= near or lefts[-1 - patience] - lefts[-1] <= near:
            break
        waiting = np.zeros(m)
        for k, p in enumerate(basis):
            if isinstance(p, int):
                waiting[p] = x[k]
        found = priced(lengths, y + 0.4 * np.log1p(waiting) / np.log1p(max(1.0, waiting.max())), size, columns)
        if not any(y @ counts > 1e-6 for _, counts in found) or found[0][0] * total / size <= near:
            # Each pattern changes the cost by at most the best sum, and there can't be more patterns than the tokens fill.
            found = priced(lengths, y, size, columns)
            if not found or found[0][0] <= 1e-6 or found[0][0] * total / size <= near:
                break
        for _, counts in found:
            enter(counts, 0.0, counts)
        for k in np.argsort(price - cost @ inverse)[:columns].tolist():
            enter(np.eye(1, m, k)[0], price[k], k)
    return [(float(x[k]), p) for k, p in enumerate(basis) if not isinstance(p, int)]


def cutting_stock(histogram: dict[int, int], size: int, tolerance: float = 1e-2, columns: int = 24) -> tuple[list[tuple[int, dict[int, int]]], dict[int, int]]:
    """Whole numbers of patterns, each as (times, {length: count}), and how many items of each length have none."""
    lengths = np.array(sorted(k for k, n in histogram.items() if n), np.int64)
    left = np.array([histogram[k] for k in lengths.tolist()], np.int64)
    taken: dict[bytes, list] = {}
    if len(lengths):
        used = relaxed(lengths, left, size, tolerance, columns)
        used.sort(key=lambda p: (-(p[0] % 1), p[1].tobytes()))
        for x, counts in used:
            n = int(min(x + 1e-7, (left[counts > 0] // counts[counts > 0]).min()))
            left -= n * counts
            taken[counts.tobytes()] = [n, counts]
        for _, counts in used:
            if (left >= counts).all():
                left -= counts
                taken[counts.tobytes()][0] += 1
    patterns = [(n, {int(lengths[k]): int(counts[k]) for k in np.flatnonzero(counts)}) for n, counts in taken.values() if n]
    return patterns, {int(k): int(n) for k, n in zip(lengths, left, strict=True) if n}


def places(histogram: dict[int, int], full: int, size: int, tolerance: float) -> tuple[list[tuple], int, int]:
    """Where ranked items go: rows (length, first rank, rank after the last, items a sequence, first sequence, offset of the first, place on the tape or null); the tape's first sequence and its length.

    Items with a place on the tape lie there one after the other. Sequences of whole pieces come first, then those of patterns, then the tape.
    """
    patterns, left = cutting_stock(histogram, size, tolerance)
    rows, rank, sequence = [(size, 0, full, 1, 0, 0, None)] if full else [], dict.fromkeys(histogram, 0), full
    for n, counts in patterns:
        offset = 0
        for length, k in counts.items():
            rows.append((length, rank[length], rank[length] + n * k, k, sequence, offset, None))
            rank[length] += n * k
            offset += k * length
        sequence += n
    tape = 0
    for length, n in left.items():
        rows.append((length, rank[length], rank[length] + n, 1, 0, 0, tape))
        tape += n * length
    return rows, sequence, tape


# ------------------------------------------------------------------------------------------------------------- on documents


def tokenised(docs: DataFrame, path: str, size: int = 1024, end: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, with each document's ids (32 bits each, little-endian), their number, and running numbers within its task: of whole pieces before it, and of its rest among those of that length."""
    if clash := set(keep) & {"_part", "_row", "_n", "_full", "_rest", "_rank", "_ids", "_text", *T.StructType.fromDDL(PIECE).names}:
        raise ValueError(f"columns {sorted(clash)} are results here")
    schema = T.StructType([*(docs.schema[k] for k in keep), *T.StructType.fromDDL(TOKENS)])
    into = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_tokenizer(path, special=True)
        chunks = Chunks(lambda found: [id_lists(encode(found))], words=True)
        part, row, full, ranks = TaskContext.get().partitionId(), 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            for i, j, counts, codes in chunks.steps(batch.column(len(keep))):
                lists = chunks.lists[0] if len(codes) else Lists(np.zeros(0, np.uint32), np.zeros(0))
                bounds = np.concatenate(([0], np.cumsum(lists.sizes[codes])))[np.concatenate(([0], np.cumsum(counts)))]
                # The end id goes behind each document's last.
                ids = np.insert(lists.take(codes).astype("<u4"), bounds[1:], end)
                bounds = bounds + np.arange(len(bounds))
                n = np.diff(bounds)
                whole, rest = n // size, n % size
                order = np.argsort(rest, kind="stable")
                firsts = np.searchsorted(rest[order], rest[order])
                rank = np.empty(len(rest), np.int64)
                rank[order] = np.arange(len(rest)) - firsts + ranks[rest[order]]
                ranks += np.bincount(rest, minlength=size)
                own = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer((bounds * 4).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids))])
                columns = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                columns += [pa.array(np.full(j - i, part), pa.int32()), pa.array(row + np.arange(j - i)), pa.array(n), pa.array(full + np.cumsum(whole) - whole)]
                columns += [pa.array(rest, pa.int32()), pa.array(rank), own.cast(pa.binary())]
                row += j - i
                full += int(whole.sum())
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(into, columns, strict=True)]))

    return docs.select(*keep, docs[text].alias("_text")).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0, tolerance: float = 1e-2, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """A row per piece: the kept columns, start, length, ids (32 bits each, little-endian), doc_tokens, sequence_id from 0, offset; path is the tokenizer's file, which every worker has.

    The ids are written once to the shared folder; they aren't shuffled as long as the tasks' counts are few enough to be broadcast.
    """
    spark = docs.sparkSession
    tokens = written(tokenised(docs, path, size, end, text, keep), "tokens")
    counts = tokens.groupBy("_part", F.col("_rest").alias("_kind")).agg(F.count("*").alias("n")).where("_kind > 0")
    counts = written(counts.union(tokens.groupBy("_part").agg(F.lit(size).alias("_kind"), F.sum(F.expr(f"_n div {size}")).alias("n")).where("n > 0")), "counts")
    histogram = {r["_kind"]: r["n"] for r in counts.groupBy("_kind").agg(F.sum("n").alias("n")).collect()}  # at most one row a length
    rows, tape_at, tape = places({k: n for k, n in histogram.items() if k < size}, histogram.get(size, 0), size, tolerance)
    slots = spark.createDataFrame(rows, "_kind int, _low long, _high long, _each long, _sequence long, _at long, _tape long").coalesce(1)

    before = counts.select("_part", "_kind", (F.sum("n").over(Window.partitionBy("_kind").orderBy("_part")) - F.col("n")).alias("_before"))
    few = counts.count() <= MOST_COUNTS
    whole = F.expr(f"transform(sequence(1L, _n div {size}), k -> struct((k - 1) * {size} as start, {size} as kind, _full + k - 1 as rank))")
    rest = F.expr("struct(_n - _rest as start, _rest as kind, _rank as rank)")
    items = F.filter(F.concat(F.when(F.col("_n") >= size, whole).otherwise(F.array().cast("array<struct<start:bigint,kind:int,rank:bigint>>")), F.array(rest)), lambda p: p["kind"] > 0)
    pieces = tokens.select(*keep, "_part", "_n", "_ids", F.explode(items).alias("p")).select(*keep, "_part", "_n", "_ids", F.col("p.start").alias("start"), F.col("p.kind").alias("_kind"), F.col("p.rank").alias("_rank"))
    pieces = pieces.join(F.broadcast(before) if few else before, ["_part", "_kind"]).withColumn("_rank", F.col("_rank") + F.col("_before"))
    # Patterns and lengths bound the slots, whatever the number of documents.
    pieces = pieces.join(F.broadcast(slots), (pieces["_kind"] == slots["_kind"]) & (F.col("_rank") >= F.col("_low")) & (F.col("_rank") < F.col("_high"))).drop(slots["_kind"])

    placed = F.struct(F.lit(0).cast("long").alias("skip"), F.col("_kind").cast("long").alias("length"), (F.col("_sequence") + F.expr("(_rank - _low) div _each")).alias("sequence_id"), (F.col("_at") + F.expr("(_rank - _low) % _each") * F.col("_kind")).alias("offset"))
    pieces = pieces.withColumn("_from", F.col("_tape") + (F.col("_rank") - F.col("_low")) * F.col("_kind")).withColumn("_to", F.col("_from") + F.col("_kind"))
    pieces = pieces.withColumn("c", F.explode(F.when(F.col("_tape").isNull(), F.array(placed)).otherwise(on_tape(tape_at, tape, size))))
    ids = F.substring("_ids", (F.lit(4) * (F.col("start") + F.col("c.skip")) + 1).cast("int"), (F.lit(4) * F.col("c.length")).cast("int"))
    return pieces.select(*keep, (F.col("start") + F.col("c.skip")).alias("start"), F.col("c.length").alias("length"), ids.alias("ids"), F.col("_n").alias("doc_tokens"), F.col("c.sequence_id").alias("sequence_id"), F.col("c.offset").alias("offset"))


def on_tape(first: int, tape: int, size: int) -> Column:
    """The pieces of an item that lies at _from to _to on the tape: cut where whole sequences end, and in the last one where its powers of two do."""
    whole, ends = tape // size, []
    at, sequence = whole * size, first + whole
    for k in range(size.bit_length(), -1, -1):
        if (tape - whole * size) >> k & 1:
            ends.append((at, at + (1 << k), sequence))
            at, sequence = at + (1 << k), sequence + 1
    tail = ", ".join(f"struct({a}L as low, {b}L as high, {s}L as sequence)" for a, b, s in ends)
    own = f"transform(sequence(_from div {size}, (_to - 1) div {size}), k -> struct(k * {size} as low, (k + 1) * {size} as high, {first} + k as sequence))"
    spans = f"filter({own}, s -> s.high <= {whole * size})" + (f" || filter(array({tail}), s -> s.low < _to and s.high > _from)" if tail else "")
    return F.expr(
        f"transform({spans}, s -> struct(greatest(s.low, _from) - _from as skip, least(s.high, _to) - greatest(s.low, _from) as length, "
        "s.sequence as sequence_id, greatest(s.low, _from) - s.low as offset))"
    )


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids binary, lengths array<long>): the joined ids of each sequence and the lengths of its pieces in order, as a training job reads them; a sequence bounds each group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.expr("aggregate(p.ids, cast('' as binary), (a, b) -> concat(a, b))").alias("ids"), F.col("p.length").alias("lengths"))
