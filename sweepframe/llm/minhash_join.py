"""Operator 7: near-duplicates by an inverted join over MinHash coordinates.

Each text's set of word shingles gets a signature of `size` MinHash values. A text is posted under each (coordinate, value) pair;
a pair of texts is a candidate if it collides in at least `match` coordinates, and a link if its full sets meet the threshold.

* Texts with equal sets are one class: only its smallest id takes part, so exact copies cost nothing.
* Prefix filter: coordinates are taken rarest value first. Two texts with `match` collisions share one of the first
  size - match + 1 of each. Values that one text alone has come first and need no posting, so most texts drop out at once.
* Skip merging: a posting is not expanded into its pairs. Each of its texts is first compared with one leader of the posting, the text whose values
  are shared most, as an original is by its near copies; what links joins a component, and a posting whose texts are all in one component is skipped. Only pairs
  from different components of a posting are compared after that, so a group of thousands of near copies costs a few comparisons a text
  and no link between different components is lost.
* Full sets are compared as sorted 64-bit shingle hashes.

With 64 coordinates and 32 matches a pair at similarity 0.75 is missed with probability 5e-6 (binomial tail), above it more rarely.

Defined results: null texts and texts without words have an empty set, link with nothing and are kept; a text with fewer words than
`width` has its word sequence as one shingle; repeated ids are not expected (doc_id is the key); extra columns are left alone; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import components, id_filter, key_join, shingle_rows, signatures, written


def sketches(docs: DataFrame, size: int, width: int) -> DataFrame:
    """(id, n_shingles, set_a, set_b, signature) per text; set_a and set_b are a 128-bit digest of the set, null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in shingle_rows(batch.column(1), width):
                sets = [np.unique(r) for r in rows]
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                values = signatures(sets, size).view(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(rows)).cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                        pa.array([d and int.from_bytes(d[8:], "little", signed=True) for d in digests], pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, size * (len(rows) + 1), size, dtype=np.int32)), pa.array(values.ravel())),
                    ],
                    names=["id", "n_shingles", "set_a", "set_b", "signature"],
                )

    return docs.mapInArrow(run, "id long, n_shingles long, set_a long, set_b long, signature array<int>")


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, members): the sorted 64-bit shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, rows in shingle_rows(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(rows)).cast(pa.int64()), pa.array([np.unique(r).tobytes() for r in rows], pa.binary())], names=["id", "members"])

    return docs.mapInArrow(run, "id long, members binary")


def full_pairs(sets: DataFrame, at: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of texts in different components (id, at) that may meet the threshold, by prefix and positional filters on full sets.

    Shingles are ranked rarest first; texts that meet the threshold share one of the first |x| - ceil(percent |x|) + 1 of each, at ranks that leave
    room for enough others. Texts outside the largest component of a shingle meet all of it, so one large component is no square.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                x = [np.frombuffer(m.as_buffer(), np.int64) for m in part.column(1)]
                sizes = np.array([len(s) for s in x])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column(0).to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(np.concatenate(x))], names=["id", "size", "shingle"])

    held = sets.mapInArrow(run, "id long, size long, shingle long")
    often = held.groupBy("shingle").agg(F.count("*").alias("n")).where("n > 1")
    ranked = held.join(often, "shingle").groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "shingle"))).alias("s"))
    # Shingles of one text alone rank first; ranks count from 0.
    ranked = ranked.select("id", "size", (F.col("size") - F.size("s")).alias("alone"), F.posexplode("s").alias("i", "x"))
    ranked = ranked.select("id", "size", (F.col("alone") + F.col("i")).alias("rank"), F.col("x.shingle").alias("shingle")).where(f"rank <= size - ceil({percent} * size / 100)")
    ranked = written(ranked.join(at, "id"), "ranked")
    parts = ranked.groupBy("shingle", "at").agg(F.count("*").alias("n"))
    major = parts.groupBy("shingle").agg(F.max_by("at", F.struct("n", "at")).alias("major"), F.count("*").alias("parts")).where("parts > 1").drop("parts")
    ranked = written(ranked.join(major, "shingle"), "mixed")
    x = ranked.where("at <> major").select("shingle", F.col("id").alias("a"), F.col("at").alias("a_at"), F.col("size").alias("p"), F.col("rank").alias("p_rank"))
    y = ranked.select("shingle", F.col("id").alias("b"), F.col("at").alias("b_at"), "major", F.col("size").alias("q"), F.col("rank").alias("q_rank"))
    able = F.expr(f"a_at <> b_at and (b_at = major or a < b) and 100 * least(p, q) >= {percent} * greatest(p, q) and {100 + percent} * least(p - p_rank, q - q_rank) >= {percent} * (p + q)")
    return x.alias("x").join(y.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & able).select("a", "b").distinct()


def links_of(pairs: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose full sets meet 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                small, large = sorted((len(x), len(y)))
                if 100 * small < percent * large:
                    keep.append(False)
                    continue
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (small + large - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("id").alias("a"), F.col("members").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    return written(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), name)


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, size: int = 64, match: int = 32, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id, kept): component_id is the smallest id reachable over links, kept marks it."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    sketch = written(sketches(docs, size, width), "sketches")
    classes = sketch.where("set_a is not null").groupBy("set_a", "set_b").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = sketch.join(classes.select(F.col("rep").alias("id")), "id", "left_semi")

    # Postings under (coordinate, value); values of one text alone can't collide.
    posted = reps.select("id", F.posexplode("signature").alias("c", "v")).select("id", (F.shiftleft(F.col("c").cast("long"), 32) + F.col("v").cast("long")).alias("value"))
    often = posted.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    ranked = posted.join(often, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "value"))).alias("values"))
    # The other coordinates of a text, size - size(values), are rarer and fill the prefix first.
    ranked = ranked.withColumn("weight", F.expr("aggregate(values, 0L, (s, p) -> s + p.n)"))
    prefix = ranked.select("id", "weight", F.explode(F.expr(f"slice(values, 1, greatest(0, {size - match + 1} - ({size} - size(values))))")).alias("p")).select("id", "weight", F.col("p.value").alias("value"))
    prefix = written(prefix, "prefixes")
    ids = written(prefix.select("id").distinct(), "shared")
    sets = written(full_sets(id_filter(docs, ids, "id"), width), "sets")
    signed = written(id_filter(sketch.select("id", "signature"), ids, "id"), "signed")

    def colliding(pairs: DataFrame) -> DataFrame:
        """Distinct pairs with enough collisions, and their number."""
        both = pairs.join(signed.select(F.col("id").alias("a"), F.col("signature").alias("x")), "a").join(signed.select(F.col("id").alias("b"), F.col("signature").alias("y")), "b")
        return both.select("a", "b", F.expr("aggregate(zip_with(x, y, (p, q) -> if(p = q, 1, 0)), 0, (s, t) -> s + t)").alias("hits")).where(f"hits >= {match}")

    # Each text against the leaders of its postings, of them the one with most collisions.
    leaders = prefix.groupBy("value").agg(F.max(F.struct("weight", (-F.col("id")).alias("o"), "id")).alias("l"), F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    near = prefix.join(leaders, "value").where("id <> l.id").select(F.col("id").alias("a"), F.col("l.id").alias("b")).distinct()
    links = links_of(colliding(near).groupBy("a").agg(F.max_by("b", F.struct("hits", "b")).alias("b")), sets, percent, "links")
    at = written(components(links), "at")

    # Texts of postings that still hold several components are compared on their full sets.
    placed = prefix.select("id", "value").join(at, "id", "left").withColumn("at", F.coalesce("component", "id"))
    mixed = placed.groupBy("value").agg(F.min("at").alias("low"), F.max("at").alias("high")).where("low < high").select("value")
    open_ = written(placed.join(mixed, "value", "left_semi").select("id", "at").distinct(), "open")
    rest = written(full_pairs(id_filter(sets, open_.select("id"), "id"), open_, percent), "rest")
    links = at.select(F.col("id").alias("a"), F.col("component").alias("b")).union(links_of(rest, sets, percent, "links"))

    joined = components(links)
    named = classes.join(joined.withColumnRenamed("id", "rep"), "rep", "left").select("set_a", "set_b", "n", F.coalesce("component", "rep").alias("component_id"))
    columns = [F.col("id").alias(key), "n_shingles"]
    filled = key_join(sketch.where("set_a is not null").select("id", "n_shingles", "set_a", "set_b"), written(named, "named"), ["set_a", "set_b"]).select(*columns, "component_id")
    out = filled.union(sketch.where("set_a is null").select(*columns, F.col("id").alias("component_id")))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
