"""Operator 6: removal of repeated byte strings by sparse suffix sorting (deep-shallow).

A byte goes if a string of `length` bytes that covers it also starts elsewhere in the corpus, same document included.

* Anchors: each window of `length` bytes has as its anchor the smallest (by hash, then leftmost) of its strings of `gram` bytes. Equal windows have
  equal anchors at equal offsets, so only suffixes at anchors need sorting, about one in 120 bytes, and only those whose anchor string occurs twice.
* Suffixes with equal anchor strings (their first `gram` bytes, the bucket of a shallow first pass) meet in one group of a shuffle, with `length` bytes
  to the right and `length - gram` to the left. Each group is sorted deep-shallow: multikey quicksort on eight-byte words down to SHALLOW bytes, then blind tries
  for what still shares a long prefix. The bytes to the left, reversed, are sorted alike. The sorted orders with their common prefix lengths tell for each
  suffix which windows around its anchor occur again: two suffixes share the window at offset o if they agree on o bytes to the left and length - o to the right.
* Runs of a short period would make every period an anchor; a run of a length plus a period repeats itself and is removed outright, and keeps anchors only near its ends.
* Texts that are equal as a whole are one class, of which one text takes part; texts of several copies go altogether.
* A group of over `most` contexts is split by longer strings (`split_groups`). Contexts that share the window at offset o agree on o bytes to the left and
  length - o to the right; so for each of RANGES ranges of offsets [low, high) those contexts meet that agree on the low bytes to the left and the length - high + 1
  to the right which all its windows hold, clipped to the bytes that any of them needs. Equal clipped contexts are one with a count before they meet, so
  a passage in a third of all texts is a few contexts with large counts. Groups that still have more different ones are split by single windows.

Nothing depends on where Spark puts a row; each cut of the lineage is a table in the shared folder. Defined results: null and texts shorter than `length` lose
nothing; ties and repeats are what is removed; an empty table gives an empty result; doc_id is the key; extra columns are left alone. Passages shorter than
`length` stay, however many words they have.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import STEP_BYTES, id_filter, key_filter, key_join, mix, powers, runs_of, texts_of, written

LENGTH, GRAM, MOST = 400, 160, 50_000
#: Ranges of offsets by which the groups of very frequent anchor strings are split.
RANGES = 16
#: Depth in bytes at which blind tries take over, and the group size from which classes are refined offset by offset.
SHALLOW, PAIRWISE = 32, 24
#: Periods up to this length count as short.
PERIOD = 64
_BYTES = np.random.default_rng(400).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


# ------------------------------------------------------------------------------------------------------------------ anchors


def string_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """64-bit hash of each string of `length` bytes."""
    up, down = powers(len(data))
    total = np.concatenate((np.zeros(1, np.uint64), np.add.accumulate(_BYTES[data] * up)))
    return mix((total[length:] - total[:-length]) * down[: len(data) - length + 1])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` neighbours, by prefix and suffix minima of blocks."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of all windows inside rows; data is at most a step long."""
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    hashes = string_hashes(data, gram)
    bits = np.uint64(max(1, len(data).bit_length()))
    place = (np.uint64(1) << bits) - np.uint64(1)
    least = sliding_least((hashes & ~place) | np.arange(len(hashes), dtype=np.uint64), length - gram + 1)
    whole = np.ones(len(least), bool)
    for end in offsets[1:-1].tolist():  # windows over the end of a row
        whole[max(0, end - length + 1) : end] = False
    at = least[whole] & place
    at = at[np.concatenate(([True], at[1:] != at[:-1]))] if len(at) else at
    at = np.unique(at).astype(np.int64)
    return at, hashes[at]


def thinned(at: np.ndarray, hashes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(anchors of one row to keep, stretches that repeat themselves): the inside of runs with a short period needs no anchors."""
    keep, runs = np.ones(len(at), bool), []
    if len(at) < 8:
        return keep, runs
    step = np.diff(at)
    same = (hashes[1:] == hashes[:-1]) & (step <= PERIOD)
    k = 0
    for k0 in np.flatnonzero(same & np.concatenate(([True], ~same[:-1] | (step[1:] != step[:-1])))).tolist():
        if k0 < k:
            continue
        k = k0
        while k < len(same) and same[k] and step[k] == step[k0]:
            k += 1
        a, b, p = int(at[k0]), int(at[k]) + gram, int(step[k0])
        if b - a >= length + p:
            runs.append((a, b))
            keep[k0 : k + 1] &= (at[k0 : k + 1] < a + 2 * length + p) | (at[k0 : k + 1] >= b - 2 * length)
    return keep, runs


def anchor_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, pos, hash, upto): anchors, and with a null hash the stretches [pos, upto) that repeat themselves."""

    def pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for i, j in runs_of(offsets):
            if offsets[j] - offsets[i] <= STEP_BYTES:
                at, hashes = anchors_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                cuts = np.searchsorted(at, offsets[i : j + 1] - offsets[i])
                for k in range(i, j):
                    a, b = cuts[k - i], cuts[k - i + 1]
                    yield k, at[a:b] - (offsets[k] - offsets[i]), hashes[a:b]
            else:  # a long row in overlapping pieces
                found = []
                for a in range(int(offsets[i]), int(offsets[j]), STEP_BYTES - length):
                    part = data[a : min(a + STEP_BYTES, offsets[j])]
                    at, hashes = anchors_of(part, np.array([0, len(part)]), length, gram)
                    found.append((at + a - offsets[i], hashes))
                at, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
                yield i, at, np.concatenate([f[1] for f in found])[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            out: list[list] = [[], [], [], []]
            for k, at, hashes in pieces(*texts_of(batch.column(1))):
                keep, runs = thinned(at, hashes, length, gram)
                n = int(keep.sum())
                out[0].append(np.full(n + len(runs), ids[k]))
                out[1].append(np.concatenate((at[keep], [a for a, _ in runs])))
                out[2].append(np.concatenate((hashes[keep].view(np.int64), np.zeros(len(runs), np.int64))))
                out[3].append(np.concatenate((np.zeros(n, np.int64), [b for _, b in runs])))
            if out[0]:
                x = [np.concatenate(c).astype(np.int64) for c in out]
                yield pa.RecordBatch.from_arrays([pa.array(x[0]), pa.array(x[1]), pa.array(x[2], mask=x[3] > 0), pa.array(x[3])], names=["id", "pos", "hash", "upto"])

    return docs.select("id", "text").mapInArrow(run, "id long, pos long, hash long, upto long")


# ------------------------------------------------------------------------------------------------------- deep-shallow sorting


def common(a: bytes, b: bytes, low: int = 0) -> int:
    """Length of the common prefix, known to be at least low."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    high = n
    while high - low > 1:
        mid = (low + high) >> 1
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """(order, common prefix length of each string with the one before it in the order); equal strings stand side by side."""
    order: list[int] = []
    shared: list[int] = []

    def put(k: int, depth: int) -> None:
        order.append(k)
        shared.append(depth)

    def multikey(own: list[int], depth: int) -> None:
        """Sorts strings that share depth bytes; what the first shares with the string put before it is for the caller to say."""
        while True:
            if len(own) == 1:
                put(own[0], 0)
                return
            if depth >= SHALLOW:
                blind_trie(own, depth)
                return
            words = [strings[k][depth : depth + 8] for k in own]
            pivot = sorted((words[0], words[len(words) >> 1], words[-1]))[1]
            less = [k for k, w in zip(own, words, strict=True) if w < pivot]
            equal = [k for k, w in zip(own, words, strict=True) if w == pivot]
            more = [k for k, w in zip(own, words, strict=True) if w > pivot]
            if (less or more) or len(pivot) < 8:
                break
            depth += 8
        for part in (less, equal, more):
            at = len(order)
            if part is equal and len(pivot) < 8:  # they end here, and so are equal
                for k in equal:
                    put(k, len(strings[k]))
            elif part:
                multikey(part, depth + 8 if part is equal else depth)
            if part and at:
                shared[at] = common(strings[order[at - 1]], strings[order[at]])

    def blind_trie(own: list[int], depth: int) -> None:
        """Strings go one by one into a trie that holds branching depths and bytes only; a walk without comparing ends at a leaf, one
        comparison with it tells where the string branches off."""
        # A node is (depth, {next byte, or -1 at the end: node}), a leaf (None, list of equal strings).
        tree: tuple = (None, [own[0]])
        for k in own[1:]:
            s, node = strings[k], tree
            while node[0] is not None:
                node = node[1].get(s[node[0]] if node[0] < len(s) else -1) or next(iter(node[1].values()))
            other = strings[node[1][0]]
            d = common(other, s, depth)
            if d == len(s) == len(other):
                node[1].append(k)
                continue
            above, key, node = None, None, tree
            while node[0] is not None and node[0] < d:
                above, key = node, s[node[0]]
                node = node[1][key]
            here, leaf = s[d] if d < len(s) else -1, (None, [k])
            if node[0] == d:
                node[1][here] = leaf
                continue
            branch = (d, {(other[d] if d < len(other) else -1): node, here: leaf})
            if above is None:
                tree = branch
            else:
                above[1][key] = branch
        stack = [(tree, 0)]
        while stack:
            node, share = stack.pop()
            if node[0] is None:
                for n, k in enumerate(node[1]):
                    put(k, len(strings[k]) if n else share)
            else:
                kids = [node[1][c] for c in sorted(node[1])]
                stack.extend((kid, node[0] if n else share) for n, kid in reversed(list(enumerate(kids))))

    multikey(list(range(len(strings))), 0)
    return order, shared


def repeats_in_group(left: list[bytes], right: list[bytes], length: int, gram: int) -> list[tuple[int, int]]:
    """Of each suffix: how many bytes left and right of its anchor lie in windows that another suffix of the group shares; (0, 0) for none.

    left is reversed, so both sides are read away from the anchor.
    """
    n = len(right)
    order, shared = deep_shallow([r[gram:] for r in right])
    if n <= PAIRWISE:
        best = [(0, 0)] * n
        for x in range(n):
            least = length
            for y in range(x + 1, n):
                least = min(least, shared[y] + gram)
                i, j = order[x], order[y]
                back = common(left[i], left[j])
                if least + back >= length:
                    for k in (i, j):
                        best[k] = max(best[k][0], back), max(best[k][1], least)
        return best
    back_order, back_shared = deep_shallow(left)
    ahead, behind = np.array(shared) + gram, np.array(back_shared)
    order, back_order = np.array(order), np.array(back_order)
    low, high = np.full(n, length + 1), np.full(n, -1)
    classes = np.empty((2, n), np.int64)
    for o in range(length - gram + 1):
        # Suffixes with o equal bytes to the left and length - o to the right; one with fewer bytes than that is alone.
        classes[0, order] = np.cumsum(np.concatenate(([0], ahead[1:] < length - o)))
        classes[1, back_order] = np.cumsum(np.concatenate(([0], behind[1:] < o)))
        both = classes[0] * n + classes[1]
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        again = counts[inverse] > 1
        low[again] = np.minimum(low[again], o)
        high[again] = np.maximum(high[again], o)
    return [(int(h), length - int(a)) if h >= 0 else (0, 0) for a, h in zip(low, high, strict=True)]


# ------------------------------------------------------------------------------------------------------------------ the operator


def contexts(placed: DataFrame, length: int, gram: int) -> DataFrame:
    """(hash, id, pos, before, after) for rows (id, text, marks array<struct<pos, hash>>); before is reversed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text = memoryview((batch.column(1)[k].as_buffer()))
                marks = batch.column(2)[k].values
                at, hashes = marks.field("pos").to_pylist(), marks.field("hash")
                ident = batch.column(0)[k].as_py()
                for a in range(0, len(at), 2000):
                    own = at[a : a + 2000]
                    before = [bytes(text[max(0, p - length + gram) : p])[::-1] for p in own]
                    after = [bytes(text[p : p + length]) for p in own]
                    yield pa.RecordBatch.from_arrays([hashes.slice(a, 2000), pa.array([ident] * len(own), pa.int64()), pa.array(own, pa.int64()), pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["hash", "id", "pos", "before", "after"])

    return placed.select("id", "text", "marks").mapInArrow(run, "hash long, id long, pos long, before binary, after binary")


def sorted_groups(rows: DataFrame, length: int, gram: int) -> DataFrame:
    """(id, begin, end) of repeated stretches around anchors; each hash's rows meet in one task, in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple[int, int, int]] = []

        def close() -> None:
            if len(held) > 1:
                for (_, i, p, _, _), (back, ahead) in zip(held, repeats_in_group([h[3] for h in held], [h[4] for h in held], length, gram), strict=True):
                    if ahead:
                        out.append((i, p - back, p + ahead))
            held.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and held[0][0] != row[0]:
                    close()
                held.append(row)
            if len(out) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "begin", "end"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["id", "begin", "end"])

    return rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "id long, begin long, end long")


def window_repeats(rows: DataFrame, length: int) -> DataFrame:
    """(id, begin, end) of windows that stand in several places, for contexts (id, pos, before, after): a group is one window, so its count tells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, pos, before, after in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = np.frombuffer(before[::-1] + after, np.uint8)
                if len(data) >= length:
                    n = min(len(before), len(data) - length) + 1
                    hashes = string_hashes(data, length)[:n].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, ident)), pa.array(np.arange(n) + pos - len(before)), pa.array(hashes)], names=["id", "begin", "window"])

    # One and the same window may be seen from two anchors: distinct places count.
    windows = written(rows.select("id", "pos", "before", "after").mapInArrow(run, "id long, begin long, window long").distinct(), "windows")
    again = written(windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1"), "again")
    return key_filter(windows, again, "window").select("id", "begin", (F.col("begin") + length).alias("end"))


def split_groups(rows: DataFrame, length: int, gram: int, most: int) -> DataFrame:
    """(id, begin, end) of repeated stretches around anchors of very frequent strings, for contexts as of `contexts`."""
    edges = np.unique(np.linspace(0, length - gram + 1, RANGES + 1).astype(int)).tolist()
    ranges = F.array(*(F.struct(F.lit(a).alias("low"), F.lit(b).alias("high")) for a, b in zip(edges, edges[1:], strict=False)))
    x = rows.select("*", F.explode(ranges).alias("r")).select("*", "r.low", "r.high").drop("r")
    x = x.where((F.octet_length("before") >= F.col("low")) & (F.octet_length("after") >= length + 1 - F.col("high")))
    held = F.xxhash64("hash", "low", F.substring("before", F.lit(1), F.col("low")), F.substring("after", F.lit(1), length + 1 - F.col("high")))
    clipped = [F.substring("before", F.lit(1), F.col("high") - 1).alias("before"), F.substring("after", F.lit(1), length - F.col("low")).alias("after")]
    x = x.select(held.alias("hash"), "low", "high", *clipped, "id", "pos")
    places = written(x.withColumn("context", F.xxhash64("hash", "before", "after")), "places")
    kinds = written(places.groupBy("hash", "low", "high", "context").agg(F.count("*").alias("n"), F.first("before").alias("before"), F.first("after").alias("after")), "kinds")
    big = written(kinds.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most), "big-groups")  # at most the contexts over `most`
    small = kinds.join(F.broadcast(big.select("hash")), "hash", "left_anti") if big.count() <= 1_000_000 else kinds.join(big.select("hash"), "hash", "left_anti")
    # Different contexts are compared; one that stands in several places repeats all its windows.
    compared = sorted_groups(small.select("hash", F.col("context").alias("id"), F.lit(0).cast("long").alias("pos"), "before", "after"), length, gram)
    back = F.least(F.col("high") - 1, F.octet_length("before"))
    ahead = length - F.greatest("low", length - F.octet_length("after"))
    copied = small.where("n > 1").select(F.col("context").alias("id"), (-back).cast("long").alias("begin"), ahead.cast("long").alias("end"))
    spans = compared.union(copied).groupBy("id").agg(F.min("begin").alias("back"), F.max("end").alias("ahead")).withColumnRenamed("id", "context")
    spans = written(spans.join(kinds.select("context", "n"), "context"), "spans")
    found = key_join(places.select("context", "id", "pos"), spans, ["context"]).select("id", (F.col("pos") + F.col("back")).alias("begin"), (F.col("pos") + F.col("ahead")).alias("end"))
    if not big.isEmpty():
        found = found.union(window_repeats(key_filter(places, big, "hash"), length))
    return found


SPANS = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))


def merged_cuts(cut: DataFrame) -> DataFrame:
    """(id, n_removed, n_spans, kept_sha256, spans) for rows (id, text, cuts array<struct<begin, end>>)."""

    def one(text: memoryview, cuts: list[tuple[int, int]]) -> tuple[int, int, str, list[dict[str, int]]]:
        spans: list[list[int]] = []
        for a, b in sorted(cuts):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        digest, at = hashlib.sha256(), 0
        for a, b in spans:
            digest.update(text[at:a])
            at = b
        digest.update(text[at:])
        return sum(b - a for a, b in spans), len(spans), digest.hexdigest(), [{"begin": a, "end": b} for a, b in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = []
                for text, cuts in zip(part.column(1), part.column(2), strict=True):
                    pairs = zip(cuts.values.field("begin").to_pylist(), cuts.values.field("end").to_pylist(), strict=True)
                    rows.append(one(memoryview(text.as_buffer()), list(pairs)))
                n, k, digests, spans = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(digests), pa.array(spans, SPANS)], names=["id", "n_removed", "n_spans", "kept_sha256", "spans"])

    return cut.select("id", "text", "cuts").mapInArrow(run, "id long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin: long, end: long>>")


def repeated_strings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans): what remains of each text without the bytes of repeated strings, and the spans that go."""
    docs = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    info = written(docs.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    classes = written(info.groupBy("sha").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1"), "classes")
    copies = written(key_join(info, classes, ["sha"]).select("id", "rep"), "copies")
    spare = copies.where("id <> rep").select("id")
    spare = F.broadcast(spare) if spare.count() <= 2_000_000 else spare
    unique = docs.where(F.octet_length("text") >= length).join(spare, "id", "left_anti")

    anchors = written(anchor_rows(unique, length, gram), "anchors")
    often = written(anchors.where("hash is not null").groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "often")
    marks = key_join(anchors.select("id", "pos", "hash"), often, ["hash"]).groupBy("id").agg(F.collect_list(F.struct("pos", "hash", "n")).alias("marks"))
    marks = written(marks, "marks")

    def near(pick: str) -> DataFrame:
        own = marks.select("id", F.expr(f"filter(marks, m -> {pick})").alias("marks")).where("size(marks) > 0")
        return contexts(id_filter(docs, marks.select("id"), "id").join(own, "id"), length, gram)

    found = sorted_groups(near(f"m.n <= {most}"), length, gram).union(anchors.where("hash is null").select("id", F.col("pos").alias("begin"), F.col("upto").alias("end")))
    if not often.where(f"n > {most}").isEmpty():
        found = found.union(split_groups(near(f"m.n > {most}"), length, gram, most))
    cuts = written(found.groupBy("id").agg(F.collect_list(F.struct("begin", "end")).alias("cuts")), "cuts")
    cut = written(merged_cuts(id_filter(docs, cuts.select("id"), "id").join(cuts, "id")), "kept")

    whole = F.col("again") & (F.col("n_bytes") >= length)
    out = info.join(copies.select("id", F.lit(True).alias("again")), "id", "left").withColumn("again", F.coalesce("again", F.lit(False))).join(cut, "id", "left")
    return out.select(
        F.col("id").alias(key),
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).cast("long").alias("begin"), F.col("n_bytes").alias("end")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<begin: long, end: long>>"))).alias("spans"),
    )
