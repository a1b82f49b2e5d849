"""Operator 1: near-duplicate embeddings by NN-descent.

A graph of nearest neighbours is built and refined. Each vector keeps its `k` nearest known others; in a round each vector's neighbourhood (its neighbours and
those it is a neighbour of) is compared with itself, so that neighbours of neighbours find each other, until hardly any list changes. Lists start from
random-hyperplane tables, whose cells put most near pairs together. Neighbours below `floor` lead to no link within a step or two and aren't kept, so the many
vectors without near ones cost nothing after the start.

* A list whose entries are all links is saturated: there may be more. Such lists are enlarged to everything: the saturated vectors are compared with each
  other in blocks, within and across components, which count links and emit at most one pair each. Blocks are left uncompared only where their centres
  and radii prove that no link can be between them.
* Recall is audited: bounded samples of vectors are compared with all others, and while fewer than `recall` of their links are known (copies not counted,
  of all their links as well as on average of each vector's), further tables are added and the graph is refined again. Where too few sampled vectors have
  links to tell, tables are added until a lone pair at the threshold shares a cell with that probability. A recall that stays below is an error.
* Only threshold edges are kept: cosine >= threshold in double precision.

Vectors with the same direction to the last bit are one class with a count. A cell or a neighbourhood with many members is dealt into salted blocks of at
most BLOCK vectors, so one very common vector is no single task.

Defined results: vectors that are null, zero or hold null or non-finite components link with nothing and are kept; vectors of different lengths don't link;
ties go to smaller ids; repeated rows (same direction) link with each other; an empty table gives an empty result; extra columns are left alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import components, written

#: Vectors in a block of a comparison, which bounds memory.
BLOCK = 512
#: Rows of hot cells and the like, up to which they are broadcast.
MOST_BROADCAST = 100_000
#: Vectors in a block of saturated ones, centres of such blocks that are compared at once, and directions by whose angles centres are binned.
PART, CENTRES, PIVOTS = 4096, 1024, 3
#: The audit: vectors with links that are evidence enough, samples asked at most, and turns of further tables before it is an error.
LINKED, ASKED, TURNS = 100, 8, 12
PAIRS = "id long, n long, s double"


def unit_vectors(table: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): directions of usable vectors as array<double>, scaled by the largest component first so that no square overflows or vanishes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths().fill_null(0))
            for size in np.unique(sizes[sizes > 0]).tolist():
                part = batch.filter(pa.array(sizes == size))
                x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
                top = np.abs(x).max(axis=1)
                good = np.isfinite(top) & (top > 0)
                x = x[good] / top[good, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None] + 0.0
                vs = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, size, dtype=np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), vs], names=["id", "v"])

    # Nulls among the components become NaN, so such vectors go as well.
    return table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null").mapInArrow(run, "id long, v array<double>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def in_cells(cells: DataFrame, work: Callable[[np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """work(ids, vectors) for each cell of (cell, id, v); the cells of a task come sorted, so one at a time is held."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            whole = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            cell = whole.column(0).to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            yield from results(whole.slice(0, int(cuts[-1])), cuts)
            rest = whole.slice(int(cuts[-1]))
        if rest is not None:
            yield from results(rest, np.array([0, len(rest)]))

    def results(rows: pa.Table, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(rows):
            return
        rows = rows.combine_chunks()
        ids, x = rows.column(1).to_numpy(), matrix(rows.column(2).combine_chunks())
        out = [work(ids[a:b], x[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True) if b - a > 1]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=names)

    return cells.select("cell", "id", "v").repartition("cell").sortWithinPartitions("cell").mapInArrow(run, schema)


def nearest(k: int, floor: float) -> Callable[[np.ndarray, np.ndarray], tuple]:
    def work(ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        s = x @ x.T
        s[ids[:, None] == ids[None, :]] = -2
        m = min(k, len(ids) - 1)
        top = np.argpartition(-s, m - 1, axis=1)[:, :m] if m < len(ids) - 1 else np.argsort(-s, axis=1)[:, :m]
        values = np.take_along_axis(s, top, 1)
        rows, columns = np.nonzero(values >= floor)
        return ids[rows], ids[top[rows, columns]], values[rows, columns]

    return work


def best_lists(pairs: DataFrame, k: int) -> DataFrame:
    """(id, near array<struct<s, n>>), the k best of (id, n, s). Lists are cut in two steps, so that a hub's many finds don't meet at once."""

    def top(near: str) -> F.Column:
        return F.expr(f"slice(array_sort({near}, (a, b) -> case when a.s > b.s then -1 when a.s < b.s then 1 when a.n < b.n then -1 when a.n > b.n then 1 else 0 end), 1, {k})")

    first = pairs.groupBy("id", "n").agg(F.max("s").alias("s"))
    part = first.groupBy("id", F.pmod(F.xxhash64("n"), F.lit(16)).alias("part")).agg(F.collect_list(F.struct("s", "n")).alias("near")).select("id", top("near").alias("near"))
    return part.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near")).select("id", top("near").alias("near"))


def dealt(placed: DataFrame, bucket: str) -> DataFrame:
    """placed with a column cell: its bucket, in salted blocks where the bucket has over BLOCK rows."""
    hot = placed.groupBy(bucket).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK)
    hot = written(hot, "hot")
    hot = F.broadcast(hot) if hot.count() <= MOST_BROADCAST else hot
    salt = F.coalesce(F.pmod(F.xxhash64(bucket, "id"), F.ceil(F.col("size") / BLOCK)), F.lit(0))
    return placed.join(hot, bucket, "left").withColumn("cell", F.xxhash64(bucket, salt)).drop("size")


def table_bits(rows: int) -> int:
    return int(min(40, max(1, np.ceil(np.log2(max(2, rows / 32))))))


def table_cells(vectors: DataFrame, dimension: int, rows: int, tables: int, seed: int) -> DataFrame:
    """Cells of random-hyperplane tables, of about 32 vectors each."""
    bits = table_bits(rows)
    planes = np.random.default_rng(seed).standard_normal((dimension, tables * bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = (matrix(batch.column(1)) @ planes > 0).reshape(-1, tables, bits)
            codes = side @ (1 << np.arange(bits, dtype=np.int64)) * tables + np.arange(tables)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.FixedSizeListArray.from_arrays(pa.array(codes.ravel()), tables).cast(pa.list_(pa.int64()))], names=["id", "codes"])

    codes = written(vectors.select("id", "v").mapInArrow(run, "id long, codes array<long>"), "codes")
    placed = dealt(codes.select("id", F.explode("codes").alias("code")), "code")
    return placed.select("id", "cell").join(vectors, "id")


def neighbourhood_cells(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cells around each vector: it, its neighbours and those it is a neighbour of; the latter in blocks where they are many, each with the former."""
    ahead = lists.select("id", F.explode("near.n").alias("n"))
    blocks = ahead.groupBy(F.col("n").alias("at")).agg(F.ceil(F.count("*") / 64).cast("int").alias("blocks"))
    own = lists.select(F.col("id").alias("at"), F.array_append(F.col("near.n"), F.col("id")).alias("ids")).join(blocks, "at", "left")
    own = own.select("at", F.explode("ids").alias("id"), F.coalesce("blocks", F.lit(1)).alias("blocks")).select("at", "id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    back = ahead.select(F.col("n").alias("at"), "id").join(blocks, "at").select("at", "id", F.pmod(F.xxhash64("id"), "blocks").cast("int").alias("block"))
    return own.union(back).distinct().select(F.xxhash64("at", "block").alias("cell"), "id").join(vectors, "id")


def within_reach(blocks: DataFrame, threshold: float) -> DataFrame:
    """(component, part, o_component, o_part): pairs of blocks that can hold a link, whatever their components.

    Angles are a metric: vectors of two blocks are at least the angle of their centres less both radii apart, and the centres' angles to a fixed direction
    differ by no more than their own angle. So centres meet by equality on bins of their angles to a few directions, as wide as the largest reach, with
    the bins beside them; of these pairs the ones whose centres are beyond the threshold are left out. Neither leaves out a link.
    """

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for ids, vs in zip(batch.column(2), batch.column(3), strict=True):
                x = np.asarray(vs.values).reshape(len(ids), -1)
                c = x.mean(axis=0)
                c /= max(np.linalg.norm(c), 1e-300)
                centres.append(c)
                radii.append(float(np.arccos(np.clip(x @ c, -1, 1)).max()))
            angles = [np.arccos(np.clip(c @ directions(len(c)), -1, 1)).tolist() for c in centres]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(centres, pa.list_(pa.float64())), pa.array(radii, pa.float64()), pa.array(angles, pa.list_(pa.float64()))], names=["component", "part", "c", "r", "angles"])

    def directions(size: int) -> np.ndarray:
        d = np.random.default_rng(17).standard_normal((size, PIVOTS))
        return d / np.linalg.norm(d, axis=0)

    centres = written(blocks.select("component", "part", "ids", "vs").mapInArrow(centred, "component long, part int, c array<double>, r double, angles array<double>"), "centres")
    reach = float(2 * (centres.agg(F.max("r")).first()[0] or 0.0) + np.arccos(threshold) + 1e-6)
    bins = F.transform("angles", lambda x: F.floor(x / reach).cast("int"))
    placed = centres.withColumn("bins", bins).withColumn("cell", F.xxhash64("bins"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("chunks"))
    placed = placed.join(sizes, "cell").withColumn("no", F.pmod(F.xxhash64("component", "part"), "chunks").cast("int"))
    chunk = [F.collect_list("component").alias("component"), F.collect_list("part").alias("part"), F.flatten(F.collect_list("c")).alias("c"), F.collect_list("r").alias("r")]
    chunks = written(placed.groupBy("cell", "no", "bins").agg(*chunk), "chunks")
    steps = F.array(*(F.array(*(F.lit(int(k)) for k in step)) for step in np.ndindex(*[3] * PIVOTS)))
    near = chunks.select(F.explode(F.transform(steps, lambda step: F.xxhash64(F.zip_with("bins", step, lambda b, k: b + k - 1)))).alias("cell"), *(F.col(k).alias(f"o_{k}") for k in ("component", "part", "c", "r")))
    near = near.join(sizes, "cell").withColumn("no", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    both = chunks.select("cell", "no", "component", "part", "c", "r").join(near.drop("chunks"), ["cell", "no"]).drop("cell", "no")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                a, p, x, r, b, q, y, s = (np.asarray(z.values) for z in row)
                angle = np.arccos(np.clip(x.reshape(len(a), -1) @ y.reshape(len(b), -1).T, -1, 1))
                i, j = np.nonzero(angle <= r[:, None] + s[None, :] + np.arccos(threshold) + 1e-6)
                yield pa.RecordBatch.from_arrays([pa.array(z) for z in (a[i], p[i], b[j], q[j])], names=["component", "part", "o_component", "o_part"])

    return both.mapInArrow(run, "component long, part int, o_component long, o_part int")


def saturated_links(saturated: DataFrame, at: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """((id, times, others), (a, b)) of the saturated vectors (id, v, copies): links with others of them in any component, copies counted and not, and a link
    for each two blocks of different components that have any, which merges these.

    Blocks are large, as the vectors that move are the square of the blocks' number; a pair is compared BLOCK rows at a time. Pairs are spread over all their
    four columns before vectors join them, so no component is one task.
    """
    placed = saturated.join(at, "id")
    sizes = placed.groupBy("component").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = placed.join(sizes, "component").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    blocks = written(placed.groupBy("component", "part").agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"), F.collect_list("copies").alias("copies")), "blocks")
    pairs = written(within_reach(blocks, threshold), "block-pairs")
    right = blocks.toDF("o_component", "o_part", "o_ids", "o_vs", "o_copies")
    both = pairs.join(blocks.drop("copies"), ["component", "part"]).join(right, ["o_component", "o_part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, x, b, y, c, same in zip(*(batch.column(k) for k in range(6)), strict=True):
                a, b, c = (np.asarray(z.values) for z in (a, b, c))
                x, y = np.asarray(x.values).reshape(len(a), -1), np.asarray(y.values).reshape(len(b), -1)
                apart, told = not same.as_py(), False
                for at in range(0, len(a), BLOCK):
                    own = a[at : at + BLOCK]
                    links = (x[at : at + BLOCK] @ y.T >= threshold) & (own[:, None] != b[None, :])
                    other, none = np.zeros(len(own), np.int64), np.ones(len(own), bool)
                    if apart and not told and links.any():
                        told, i = True, int(links.any(axis=1).argmax())
                        other[i], none[i] = b[int(links[i].argmax())], False
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array((links @ c).astype(np.int64)), pa.array(links.sum(axis=1)), pa.array(other, mask=none)], names=["id", "times", "others", "other"])

    found = both.select("ids", "vs", "o_ids", "o_vs", "o_copies", (F.col("component") == F.col("o_component")).alias("same")).mapInArrow(run, "id long, times long, others long, other long")
    found = written(found.where("times > 0"), "saturated-links")
    across = found.where("other is not null").select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    return found.select("id", "times", "others"), across


def audit(vectors: DataFrame, rows: int, threshold: float, sample: int) -> tuple[dict[int, int], bool]:
    """(links with other vectors, by comparing with all of them, of each sampled vector that has any; whether they are evidence enough).

    Samples of some `sample` vectors are asked until LINKED of them have links, ASKED samples at most. Copies aren't counted.
    """
    parts = max(1, -(-rows // sample))
    true: dict[int, int] = {}
    for part in range(min(parts, ASKED)):
        asked = vectors.where(F.pmod(F.xxhash64("id", F.lit("audit")), F.lit(parts)) == part).select("id", "v").collect()
        ids, y = np.array([r["id"] for r in asked]), np.array([r["v"] for r in asked])

        def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray = ids, y: np.ndarray = y) -> Iterator[pa.RecordBatch]:
            n = np.zeros(len(ids), np.int64)
            for batch in batches:
                own, x = batch.column(0).to_numpy(), matrix(batch.column(1))
                for a in range(0, len(own), BLOCK):
                    n += ((x[a : a + BLOCK] @ y.T >= threshold) & (own[a : a + BLOCK, None] != ids)).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0], pa.int64()), pa.array(n[n > 0])], names=["id", "n"])

        if asked:
            true |= {r["id"]: r["n"] for r in vectors.select("id", "v").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
        if len(true) >= LINKED:
            break
    return true, len(true) >= LINKED or parts <= ASKED


def recall_of(true: dict[int, int], found: dict[int, int]) -> float:
    """The lesser of the share of the links found and the mean share per vector, so that a few vectors with many links don't outweigh the others."""
    got = {i: min(n, found.get(i, 0)) for i, n in true.items()}
    return min(sum(got.values()) / sum(true.values()), sum(got[i] / n for i, n in true.items()) / len(true)) if true else 1.0


def graph(vectors: DataFrame, dimension: int, rows: int, threshold: float, k: int, tables: int, rounds: int, floor: float, recall: float, sample: int) -> tuple[DataFrame, DataFrame]:
    """((id, times), (a, b)): numbers of linked vectors, copies counted, and edges. vectors: (id, v, copies) of one dimension."""
    true, enough = audit(vectors, rows, threshold, sample)
    asked = vectors.sparkSession.createDataFrame([(i,) for i in true], "id long")
    plain = vectors.select("id", "v")
    together = (1 - np.arccos(threshold) / np.pi) ** table_bits(rows)
    lists, reached = None, 0.0
    for turn in range(TURNS):
        pairs = in_cells(table_cells(plain, dimension, rows, tables, 100 + turn), nearest(k, floor), PAIRS)
        old = None if lists is None else lists.select("id", F.explode("near").alias("x")).select("id", "x.n", "x.s")
        lists = written(best_lists(pairs if old is None else pairs.union(old), k), "lists")
        for _ in range(rounds):
            known = lists.select("id", F.explode("near").alias("x")).select("id", "x.n", "x.s")
            nxt = written(best_lists(in_cells(neighbourhood_cells(lists, plain), nearest(k, floor), PAIRS).union(known), k), "lists")
            changed = nxt.select("id", F.explode("near.n").alias("n")).join(known, ["id", "n"], "left_anti").count()
            lists = nxt
            if changed <= 0.001 * known.count():
                break
        # Without evidence enough, the tables must put a lone pair at the threshold into one cell often enough.
        reached = 1 - (1 - together) ** (tables * (turn + 1))
        if not enough and reached < recall:
            continue
        edges = lists.select("id", F.explode("near").alias("x")).where(F.col("x.s") >= threshold)
        edges = written(edges.select(F.least("id", "x.n").alias("a"), F.greatest("id", "x.n").alias("b")).distinct(), "edges")
        full = lists.where((F.size("near") == k) & (F.element_at("near", -1)["s"] >= threshold)).select("id")
        full = written(vectors.join(full, "id", "left_semi"), "saturated")
        at = components(edges)
        marked = full.select(F.col("id"), F.lit(True).alias("full"))
        # A link between two saturated vectors may be in neither's list and is counted by comparing their blocks, any other from the lists.
        sided = edges.join(marked.toDF("a", "a_full"), "a", "left").join(marked.toDF("b", "b_full"), "b", "left").where("a_full is null or b_full is null")
        copies = vectors.select("id", "copies")
        many, across = saturated_links(full, at, threshold)
        edges = edges.union(across)
        ends = sided.select(F.col("a").alias("n"), F.col("b").alias("id")).union(sided.select(F.col("b").alias("n"), F.col("a").alias("id")))
        times = ends.join(copies, "id").select(F.col("n").alias("id"), F.col("copies").alias("times"), F.lit(1).cast("long").alias("others")).union(many)
        times = written(times.groupBy("id").agg(F.sum("times").alias("times"), F.sum("others").alias("others")), "times")
        reached = recall_of(true, {r["id"]: r["others"] for r in times.join(F.broadcast(asked), "id").select("id", "others").collect()} if true else {})
        if reached >= recall:
            return times.select("id", "times"), edges
    raise RuntimeError(f"recall {reached:.3f} is below {recall} after {TURNS * tables} tables")


def linked(table: DataFrame, threshold: float = 0.95, k: int = 12, tables: int = 16, rounds: int = 6, floor: float = 0.6, recall: float = 0.97, sample: int = 1000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    raw = written(unit_vectors(table, key, vector), "directions")
    classes = raw.groupBy(F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    members = written(raw.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2")).join(classes, ["h1", "h2"]).select("id", "rep", "copies"), "classes")
    vectors = written(raw.join(members.where("id = rep").select("id", "copies"), "id"), "vectors")
    times, edges = None, None
    for row in vectors.groupBy(F.size("v").alias("d")).count().collect():  # lengths of vectors: one in a sound table
        t, e = graph(vectors.where(F.size("v") == row["d"]), row["d"], row["count"], threshold, k, tables, rounds, floor, recall, sample)
        times, edges = (t, e) if times is None else (times.union(t), edges.union(e))
    out = table.select(F.col(key).cast("long").alias("id")).join(members, "id", "left")
    if times is not None:
        out = out.join(times.withColumnRenamed("id", "rep"), "rep", "left").join(components(edges).withColumnRenamed("id", "rep"), "rep", "left")
    else:
        out = out.withColumn("times", F.lit(0)).withColumn("component", F.lit(None).cast("long"))
    return out.select(
        F.col("id").alias(key),
        F.coalesce(F.coalesce("times", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component", "rep", "id").alias("component_id"),
        F.coalesce(F.coalesce("component", "rep") == F.col("id"), F.lit(True)).alias("kept"),
    )


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS id, vec_id AS other FROM embeddings UNION SELECT reach.id, links.b FROM reach JOIN links ON reach.other = links.a),
low AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN low ON vec_id = id LEFT JOIN n ON vec_id = a
"""
