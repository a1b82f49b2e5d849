"""Operator 13: alignment of two tokenizers by sparse products of token-byte incidence matrices.

A is a byte-level BPE, B a SentencePiece model. For the chunks of a text (llm/chunks.py; both tokenizers end a token where a chunk ends) the rows of the
incidence matrices A and B are tokens and their columns bytes. Gustavson's row products give A·Bᵀ, whose entries are the overlap links of tokens, each with
its number of shared bytes. In row order two successive links share a token unless both tokenizers end one there, so the links fall into groups. The product
of the incidence of A's ids with groups and of groups with B's ids gives the shared-group links: for each pair of ids, how many pairs of their tokens share a group.
Matrices are in compressed rows, built here of numpy arrays; products take their rows in blocks of a bounded number of terms. Each distinct chunk is worked
out once per worker.

Over the corpus a pair of ids counts the documents that hold it linked. Counts are pre-aggregated before they are shuffled; pairs of many documents meet the
documents' links by broadcast, at most a million of them, the others by shuffle.

Defined results: texts that are null or empty, or whose tokens don't give back a space and the text byte for byte (a text with U+2581), have no tokens: zeros
and an empty groups text. Strings of special tokens are plain text. Repeated rows, also of one id, count as documents of their own; ties for an A id's
highest count all are best; texts of any length are taken whole; extra columns, whatever their names, are left out unless kept; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sweepframe.llm.chunks import Chunks, Lists, byte_tokenizer, id_lists, ragged
from sweepframe.llm.common import key_join, written

COUNTED = "n_a long, n_b long, n_groups long, n_links long"
#: Most terms that a block of rows of a product holds.
MOST_TERMS = 2_000_000


# ---------------------------------------------------------------------------------------------------------- sparse matrices


class Rows:
    """A sparse matrix in compressed rows: the columns and values of row k are at bounds[k] to bounds[k + 1]."""

    def __init__(self, bounds: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.bounds, self.columns, self.values = bounds, columns, values

    @classmethod
    def summed(cls, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, n_rows: int, n_columns: int) -> Rows:
        """The matrix of these entries, those of one place added."""
        key = rows * n_columns + columns
        if len(key) and (key[1:] < key[:-1]).any():
            order = np.argsort(key, kind="stable")
            key, values = key[order], values[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        sums = np.add.reduceat(values, first) if len(key) else values
        rows, columns = key[first] // n_columns, key[first] % n_columns
        return cls(np.searchsorted(rows, np.arange(n_rows + 1)), columns, sums)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def products(a: Rows, b: Rows, n_columns: int) -> Iterator[tuple[int, Rows]]:
    """a·b by Gustavson's rows: each row of a adds up the rows of b that its entries name. Gives (first row, rows) in blocks of at most MOST_TERMS terms, or of one row."""
    sizes = np.diff(b.bounds)[a.columns]
    terms = np.concatenate(([0], np.cumsum(sizes)))[a.bounds]
    at, n = 0, len(a.bounds) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(terms, terms[at] + MOST_TERMS, "right")) - 1)
        own = slice(a.bounds[at], a.bounds[end])
        places = ragged(b.bounds[a.columns[own]], sizes[own])
        rows = np.repeat(np.repeat(np.arange(end - at), np.diff(a.bounds[at : end + 1])), sizes[own])
        yield at, Rows.summed(rows, b.columns[places], np.repeat(a.values[own], sizes[own]) * b.values[places], end - at, n_columns)
        at = end


def incidence(sizes: np.ndarray) -> Rows:
    """Tokens by bytes, for tokens of these sizes side by side."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return Rows(bounds, np.arange(bounds[-1]), np.ones(bounds[-1], np.int64))


def turned(tokens: Rows) -> Rows:
    """The transpose of an incidence: bytes by tokens, one token a byte."""
    n = len(tokens.columns)
    return Rows(np.arange(n + 1), tokens.row_of(), np.ones(n, np.int64))


# ------------------------------------------------------------------------------------------------------------------- tokens


def byte_entries(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer file: its printable alphabet stands for bytes, in the order that puts the printable ones of Latin-1 first."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    out = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        out[i] = bytes(byte_of.get(c, 0) for c in entry) if all(c in byte_of for c in entry) else entry.encode()
    return out


def piece_entries(model: object) -> list[bytes]:
    """The bytes of each piece of a SentencePiece model: U+2581 is a space, byte pieces are their byte, control pieces are none."""
    out = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        out.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else piece.replace("▁", " ").encode())
    return out


def _lists(entries: list[bytes]) -> Lists:
    return Lists(np.frombuffer(b"".join(entries), np.uint8), np.array([len(e) for e in entries]))


class Aligner:
    """Of many chunks, each beginning with a space: the results that documents are added up from."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.encode = byte_tokenizer(byte_path, special=False)
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size()) if not self.model.is_byte(i)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("only models whose pieces have space marks in front are supported")
        self.a_bytes, self.b_bytes = _lists(byte_entries(byte_path)), _lists(piece_entries(self.model))
        self.digits = _lists([str(i).encode() for i in range(max(len(self.a_bytes.sizes), len(self.b_bytes.sizes)))])

    def tokens(self, chunks: list[bytes]) -> tuple[Lists, Lists, np.ndarray]:
        """The ids of A and of B for each chunk, none where a chunk isn't given back; and which are."""
        a = id_lists(self.encode(chunks))
        b = id_lists(self.model.encode([c[1:].decode("utf-8", "replace") for c in chunks], num_threads=1))
        whole = np.frombuffer(b"".join(chunks), np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        fine = np.ones(len(chunks), bool)
        for ids, table in ((a, self.a_bytes), (b, self.b_bytes)):
            sizes = table.sizes[ids.flat]
            lengths = np.diff(np.concatenate(([0], np.cumsum(sizes)))[np.concatenate(([0], np.cumsum(ids.sizes)))], prepend=0)[1:]
            same = lengths == np.diff(ends, prepend=0)
            keep = np.flatnonzero(same)
            got = table.take(Lists(ids.flat, ids.sizes).take(keep))
            own = whole[ragged((ends - np.diff(ends, prepend=0))[keep], np.diff(ends, prepend=0)[keep])]
            wrong = np.flatnonzero(got != own)
            same[keep[np.searchsorted(np.cumsum(lengths[keep]), wrong, "right")]] = False
            fine &= same
        kept = np.flatnonzero(fine)
        return (*(Lists(x.take(kept), np.where(fine, x.sizes, 0)) for x in (a, b)), fine)

    def __call__(self, chunks: list[bytes]) -> list[Lists]:
        """(given back, tokens of A, of B, groups, links), the groups as text with a ';' behind each, linked pairs (A id times 65,536 plus B id) and their numbers of links."""
        a, b, fine = self.tokens(chunks)
        n = len(chunks)
        a_rows, b_rows = incidence(self.a_bytes.sizes[a.flat]), incidence(self.b_bytes.sizes[b.flat])
        left, right = [], []
        for first, rows in products(a_rows, turned(b_rows), len(b.flat)):
            left.append(rows.row_of() + first)
            right.append(rows.columns)
        left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
        # A group begins where neither token goes on.
        new = np.append(True, (left[1:] != left[:-1]) & (right[1:] != right[:-1]))[: len(left)]
        group = np.cumsum(new) - 1
        n_groups = int(group[-1]) + 1 if len(group) else 0
        group_a, group_b = np.zeros(len(a.flat), np.int64), np.zeros(len(b.flat), np.int64)
        group_a[left], group_b[right] = group, group
        chunk_a = np.repeat(np.arange(n), a.sizes)
        chunk_of = np.zeros(n_groups, np.int64)
        chunk_of[group_a] = chunk_a
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        stats = np.zeros((n, 5), np.int64)
        stats[:, 0], stats[:, 1], stats[:, 2] = fine, a.sizes, b.sizes
        stats[:, 3] = np.bincount(chunk_of, minlength=n)
        np.add.at(stats[:, 4], chunk_of, in_a * in_b)

        # Ids of a chunk by groups, and groups by ids.
        key, row_a = np.unique((chunk_a << 16) + a.flat, return_inverse=True)
        by_group = Rows.summed(row_a, group_a, np.ones(len(row_a), np.int64), len(key), max(1, n_groups))
        of_group = Rows.summed(group_b, b.flat.astype(np.int64), np.ones(len(group_b), np.int64), n_groups, 1 << 16)
        pairs, times, per_chunk = [], [], np.zeros(n, np.int64)
        for first, rows in products(by_group, of_group, 1 << 16):
            own = key[rows.row_of() + first]
            pairs.append(((own & 0xFFFF) << 16) + rows.columns)
            times.append(rows.values)
            per_chunk += np.bincount(own >> 16, minlength=n)
        pairs, times = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (pairs, times))
        return [Lists(stats.ravel(), np.full(n, 5)), self.shown(a, b, group_a, group_b, chunk_of, n), Lists(pairs.astype(np.uint32), per_chunk), Lists(times.astype(np.int32), per_chunk)]

    def shown(self, a: Lists, b: Lists, group_a: np.ndarray, group_b: np.ndarray, chunk_of: np.ndarray, n: int) -> Lists:
        """The groups of each chunk as text: ids of A, '|', ids of B, ';'."""
        sides = np.concatenate((group_a * 2, group_b * 2 + 1))
        order = np.argsort(sides, kind="stable")
        sides, ids = sides[order], np.concatenate((a.flat, b.flat))[order].astype(np.int64)
        sizes = self.digits.sizes[ids] + 1
        ends = np.cumsum(sizes)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = self.digits.take(ids)
        later = np.append(sides[1:], -1)
        out[ends - 1] = np.where(later == sides, ord(","), np.where(sides % 2 == 0, ord("|"), ord(";")))
        return Lists(out, np.bincount(chunk_of[sides >> 1], weights=sizes, minlength=n).astype(np.int64))


@cache
def _aligner(byte_path: str, piece_path: str) -> Chunks:
    return Chunks(Aligner(byte_path, piece_path), words=False, most=250_000, step=1 << 20)


# ---------------------------------------------------------------------------------------------------------------- documents


def aligned(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The kept columns, _row (a number of the row), n_a, n_b, n_groups, n_links, groups (as `a1,a2|b1;a3|b2`; its SHA-256 if digest is set), links array<struct<pair long, times int>>.

    A pair is the A id times 65,536 plus the B id; times, how many of its tokens share a group. Paths are the tokenizers' files, which every worker has.
    """
    added = f"_row long, {COUNTED}, groups string, links array<struct<pair:bigint,times:bigint>>"
    if clash := set(keep) & {*T.StructType.fromDDL(added).names, "_text"}:
        raise ValueError(f"columns {sorted(clash)} are results here")
    schema = T.StructType([*(docs.schema[k] for k in keep), *T.StructType.fromDDL(added)])
    into = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = _aligner(byte_path, piece_path)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i, j, counts, codes in chunks.steps(batch.column(len(keep))):
                n = j - i
                stats, shown, pairs, times = chunks.lists
                rows = np.repeat(np.arange(n), counts)
                sums = np.zeros((n, 5), np.int64)
                sums[:] = np.diff(np.concatenate((np.zeros((1, 5), np.int64), np.cumsum(stats.flat.reshape(-1, 5)[codes], axis=0)))[np.concatenate(([0], np.cumsum(counts)))], axis=0)
                lost = sums[:, 0] < counts
                sums[lost] = 0
                ends = np.concatenate(([0], np.cumsum(shown.sizes[codes])))[np.concatenate(([0], np.cumsum(counts)))].tolist()
                whole = memoryview(np.ascontiguousarray(shown.take(codes)))
                texts = [bytes(whole[x : y - 1]) if sums[k, 1] else b"" for k, (x, y) in enumerate(zip(ends[:-1], ends[1:], strict=True))]
                texts = [hashlib.sha256(t).hexdigest() if t and digest else t.decode() for t in texts]
                # Chunks of a document once each, then their pairs.
                key, often = np.unique((rows * len(stats.sizes) + codes)[~lost[rows]], return_counts=True)
                code, own = key % len(stats.sizes), key // len(stats.sizes)
                sizes = pairs.sizes[code]
                key = (np.repeat(own, sizes) << 32) + pairs.take(code).astype(np.int64)
                value = np.repeat(often, sizes) * times.take(code)
                linked = Rows.summed(key >> 32, key & 0xFFFFFFFF, value, n, 1 << 32)
                links = pa.ListArray.from_arrays(pa.array(linked.bounds, pa.int32()), pa.StructArray.from_arrays([pa.array(linked.columns), pa.array(linked.values)], ["pair", "times"]))
                columns = [batch.column(k).slice(i, n) for k in range(len(keep))] + [pa.array(row + np.arange(n))]
                columns += [pa.array(sums[:, k]) for k in range(1, 5)] + [pa.array(texts, pa.string()), links]
                row += n
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(into, columns, strict=True)]))

    # A missing or empty text is no text of a single space: it stays empty here.
    lead = F.when(F.coalesce(F.length(docs[text]), F.lit(0)) > 0, F.concat(F.lit(" "), docs[text])).otherwise("")
    return docs.select(*keep, lead.alias("_text")).mapInArrow(run, schema)


def pair_counts(alignments: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of `aligned` hold each linked pair, and whether that is the highest number of its A id; written to the shared folder."""
    counts = written(alignments.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pairs")
    best = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("n").alias("most"))  # one row an id of A at most
    return written(counts.join(F.broadcast(best), F.shiftright("pair", 16) == best["a"]).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digest: bool = False) -> DataFrame:
    """The kept columns, n_a, n_b, n_groups, n_links, n_best, count_sum and groups of each document; see aligned() and pair_counts()."""
    if clash := set(keep) & {"n_best", "count_sum"}:
        raise ValueError(f"columns {sorted(clash)} are results here")
    found = written(aligned(docs, byte_path, piece_path, text, keep, digest), "aligned")
    links = found.select("_row", F.explode("links").alias("x")).select("_row", "x.pair", "x.times")
    sums = key_join(links, pair_counts(found), ["pair"]).groupBy("_row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("n_best", "count_sum")]
    return found.drop("links").join(sums, "_row", "left").select(*keep, "n_a", "n_b", "n_groups", "n_links", *zero, "groups")
