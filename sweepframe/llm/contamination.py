"""Operator 4: benchmark items inside documents by size-partitioned MinHash containment search, verified exactly.

Items are partitioned by size: class u holds items of more than u / 2 and at most u shingles. For each class a document is cut into
blocks of u shingles, and each two adjacent blocks are one window, so an item that a document holds lies whole inside a window of
comparable size and both sides' MinHash values are alike enough (Jaccard 0.18 at least at containment 0.75), however long the document.
Plain signatures of whole long documents would face Jaccard values of 0.001, at which no bounded signature finds anything.
A window and an item of its class that agree in one of `size` coordinates are candidates: with 64 coordinates an item at containment
0.75 is missed with probability 4e-6 at worst, and hits of different windows of a document add up, so scattered items are found too.
Candidates are then verified by the exact containment of the item's shingles in the whole document's.

Items are taken in blocks of at most `block_bytes` of text, each broadcast with its size bounded so; documents are scanned once per
block and never shuffled. Benchmarks are small beside a corpus: one scan serves some 40,000 items, and each further block costs one scan, which is less than
to shuffle the 64 coordinates of all windows of all documents.

Defined results: null and empty texts, and items without words, match nothing. An item with fewer words than `width` is one shingle, its
word sequence, and matches where a document has these words in a row. Each (document, item) pair is returned once, whatever copies or ties there are.
Empty tables give no pairs; extra columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import runs_of, texts_of, window_hashes, word_hashes, written


class Items:
    """Sketches of a block of items, by size class."""

    def __init__(self, rows: list[tuple[int, str]], width: int, size: int):
        rng = np.random.default_rng(11)
        self.width = width
        self.factors = rng.integers(1, 1 << 63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shifts = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        self.ids, self.sets, self.short, classes = [], [], {}, {}
        data, offsets = texts_of(pa.array([t or "" for _, t in rows], pa.string()))
        words, counts = word_hashes(data, offsets)
        ends = np.cumsum(counts)
        for (i, _), end, n in zip(rows, ends.tolist(), counts.tolist(), strict=True):
            if n == 0:
                continue
            own = words[end - n : end]
            k = len(self.ids)
            self.ids.append(i)
            self.sets.append(np.unique(window_hashes(own, min(n, width))))
            if n < width:
                self.short.setdefault(n, []).append(k)
            else:
                classes.setdefault(1 << math.ceil(math.log2(len(self.sets[k]))), []).append(k)
        #: Of each class: per coordinate the items' sorted values, and the items in that order.
        self.classes = {}
        for u, own in classes.items():
            values = np.stack([[int((self.sets[k] * a + b).min() >> np.uint64(32)) for a, b in zip(self.factors, self.shifts, strict=True)] for k in own], axis=1).astype(np.uint32)
            order = np.argsort(values, axis=1, kind="stable")
            self.classes[u] = np.take_along_axis(values, order, axis=1), np.array(own)[order]

    def candidates(self, shingles: np.ndarray, counts: np.ndarray) -> set[tuple[int, int]]:
        """(row, item) pairs of which a window and the item agree in a coordinate; counts: shingles per row."""
        found: set[tuple[int, int]] = set()
        if not self.classes or not len(shingles):
            return found
        ends = np.cumsum(counts)
        begins = ends - counts
        plans = []
        for u, (values, owners) in self.classes.items():
            blocks = -(-counts // u)
            row = np.repeat(np.arange(len(counts)), blocks)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            plans.append((begins[row] + nth * u, row, row[1:] == row[:-1], values, owners))
        for c in range(len(self.factors)):
            hashed = ((shingles * self.factors[c] + self.shifts[c]) >> np.uint64(32)).astype(np.uint32)
            for starts, row, joined, values, owners in plans:
                low = np.minimum.reduceat(hashed, starts)
                # The window of a block and the next of the same row; a row's last block stands for itself.
                low[:-1][joined] = np.minimum(low[:-1], low[1:])[joined]
                own = values[c]
                at = np.searchsorted(own, low)
                at[at == len(own)] = 0
                for w in np.flatnonzero(own[at] == low).tolist():
                    k = int(at[w])
                    while k < len(own) and own[k] == low[w]:
                        found.add((int(row[w]), int(owners[c][k])))
                        k += 1
        return found


def held_items(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[pa.RecordBatch]:
    width = items.width
    for batch in batches:
        data, offsets = texts_of(batch.column(1))
        ids = batch.column(0).to_pylist()
        out = []
        for i, j in runs_of(offsets):
            words, n_words = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            ends = np.cumsum(n_words)
            counts = np.maximum(n_words - width + 1, 0)
            whole = window_hashes(words, width)
            inside = np.ones(len(whole), bool)  # windows that run over the end of a row don't count
            for k in range(1, width):
                past = ends - k
                inside[past[(past >= 0) & (past < len(whole))]] = False
            shingles = whole[inside]
            sets: dict[int, np.ndarray] = {}
            firsts = np.cumsum(counts) - counts
            for row, k in sorted(items.candidates(shingles, counts)):
                if row not in sets:
                    sets[row] = np.unique(shingles[firsts[row] : firsts[row] + counts[row]])
                out.append((ids[i + row], items.ids[k], len(items.sets[k]), int(np.isin(items.sets[k], sets[row], assume_unique=True).sum())))
            for n, own in items.short.items():
                runs = window_hashes(words, n)
                for k in own:
                    for at in np.flatnonzero(runs == items.sets[k][0]).tolist():
                        row = int(np.searchsorted(ends, at, "right"))
                        if at + n <= ends[row]:
                            out.append((ids[i + row], items.ids[k], 1, 1))
        rows = list(dict.fromkeys(out))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "item_id", "n_shingles", "n_common"])


def contained_items(docs: DataFrame, items: DataFrame, percent: int = 75, width: int = 5, size: int = 64, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) for each item with at least `percent` of its shingles in the document."""
    spark = docs.sparkSession
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, math.ceil(total / block_bytes))
    out = None
    for b in range(blocks):
        own = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(Items([(r["item_id"], r["text"]) for r in own.collect()], width, size))
        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda it, s=shared: held_items(it, s.value), "doc_id long, item_id long, n_shingles long, n_common long")
        out = found if out is None else out.union(found)
    return out.where(f"100 * n_common >= {percent} * n_shingles").withColumn("containment", F.col("n_common") / F.col("n_shingles"))


def clean_documents(docs: DataFrame, items: DataFrame, most: int = 2_000_000, **settings) -> DataFrame:
    """The documents that hold no item, with their columns. Ids of those that do are counted: up to `most` they are broadcast, so texts aren't shuffled."""
    found = written(contained_items(docs, items, **settings).select("doc_id").distinct(), "contaminated")
    return docs.join(F.broadcast(found) if found.count() <= most else found, "doc_id", "left_anti").select(*docs.columns)
