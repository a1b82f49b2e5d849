"""Packing: every id in one piece, no gap and no overlap in any sequence, ids as the library gives them, patterns and ranks on odd histograms."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import packing
from sweepframe.llm.chunks import Chunks, byte_tokenizer, id_lists
from sweepframe.llm.queries import QUERIES, tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


def texts():
    r = random.Random(11)
    words = [f"w{k}{'abcdefgh'[k % 8]}" for k in range(400)]
    found = [None, "", " ", "\n", "x" * 5000, "é日😀 <|endoftext|> ▁ \x00", "a" * 3, "a" * 3, "a <|endoftext|>", "It's  1,234.5\n\nhe'll go 　 on", "word " * 400_000]
    return found + [" ".join(r.choice(words) for _ in range(int(r.lognormvariate(4, 1)))) for _ in range(300)]


def library(values):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    return [[*e.ids, 0] for e in tokenizer.encode_batch([v or "" for v in values], add_special_tokens=False)]


def held(pieces, want, size):
    """Checks pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) against each document's ids; gives the padding and the number of pieces."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert p.length > 0 and len(p.ids) == 4 * p.length
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(want)
    for k, ids in want.items():
        own = sorted(by_doc[k], key=lambda p: p.start)
        assert [p.start for p in own] == [sum(q.length for q in own[:j]) for j in range(len(own))]
        assert np.frombuffer(b"".join(bytes(p.ids) for p in own), "<u4").tolist() == ids and {p.doc_tokens for p in own} == {len(ids)}
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == [sum(q.length for q in own[:j]) for j in range(len(own))]
        n = sum(p.length for p in own)
        assert n <= size
        padding += 0 if n & (n - 1) == 0 else size - n
    return padding, len(pieces)


def test_pack_whole_documents(spark):
    values = texts()
    docs = spark.createDataFrame([(k, v, 1, "c") for k, v in enumerate(values)], "doc_id long, text string, length long, sequence_id string").repartition(5)
    want = dict(enumerate(library(values)))
    got = packing.pack(docs, PATH).collect()
    padding, n = held(got, want, 1024)
    least = sum(-(-len(v) // 1024) for v in want.values())
    assert padding == 0 and n <= least + -(-sum(map(len, want.values())) // 1024) + 11
    assert sorted({p.sequence_id for p in got}) == list(range(len({p.sequence_id for p in got})))
    whole = packing.sequences(packing.pack(docs, PATH)).collect()
    assert sum(len(s.ids) for s in whole) == 4 * sum(map(len, want.values())) and all(4 * sum(s.lengths) == len(s.ids) for s in whole)


@pytest.mark.parametrize("size", [8, 64])
def test_pack_other_sizes_and_one_hot_length(spark, size):
    values = ["a b c"] * 400 + ["", None] * 50 + ["one two three four five six seven"] * 31
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(7)
    padding, _ = held(packing.pack(docs, PATH, size=size).collect(), dict(enumerate(library(values))), size)
    assert padding == 0


def test_pack_repeated_rows_empty_tables_and_shuffled_counts(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "one two"), (1, "one two"), (1, "three"), (2, None)], "doc_id long, text string")
    got = packing.pack(docs, PATH).collect()
    assert sum(p.length for p in got) == 3 + 3 + 2 + 1
    monkeypatch.setattr(packing, "MOST_COUNTS", 0)
    assert sorted(packing.pack(docs, PATH).collect()) == sorted(got)
    empty = packing.pack(docs.where("false"), PATH)
    assert empty.count() == 0 and empty.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    with pytest.raises(ValueError):
        packing.pack(docs.withColumn("offset", F.lit(1)), PATH, keep=("doc_id", "offset"))
    assert packing.pack(docs.withColumn("source", F.lit("s")), PATH, keep=("doc_id", "source")).where("source = 's'").count() == len(got)


def test_query_digests(spark):
    rows = QUERIES["op11_packing"](spark, "/root/testdata/sf0.001").collect()
    texts_of = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    want = dict(zip(texts_of, library(texts_of.values()), strict=True))
    for r in rows:
        own = want[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
    assert sum(r.length for r in rows) == sum(map(len, want.values()))


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {512: 7}, {1: 100_000}, {600: 1_000, 424: 5}, {k: 1 for k in range(1, 1024, 7)}, {k: 50 + k for k in range(1, 1024, 31)}])
def test_patterns(histogram):
    patterns, left = packing.cutting_stock(histogram, 1024)
    total = defaultdict(int, left)
    for n, counts in patterns:
        assert n > 0 and sum(k * m for k, m in counts.items()) == 1024
        for k, m in counts.items():
            total[k] += n * m
    assert dict(total) == histogram
    rows, first, tape = packing.places(histogram, 3, 1024, 1e-2)
    for length, n in histogram.items():  # each rank once
        spans = sorted((r[1], r[2]) for r in rows if r[0] == length)
        assert [s[0] for s in spans] == [0, *(s[1] for s in spans[:-1])] and spans[-1][1] == n
    assert first == 3 + sum(n for n, _ in patterns) and tape == sum(k * n for k, n in left.items())


def test_pricing_is_the_knapsack_optimum():
    r = random.Random(1)
    for _ in range(20):
        lengths = np.array(sorted(r.sample(range(1, 25), 6)))
        y = np.array([r.uniform(-3, 9) for _ in lengths])
        best = {0: 0.0}
        for c in range(1, 25):
            best[c] = max((best[c - k] + v for k, v in zip(lengths.tolist(), y, strict=True) if k <= c and best[c - k] > -1e300), default=-1e301)
        found = packing.priced(lengths, y, 24, 5)
        assert not found and best[24] < -1e300 or abs(found[0][0] - best[24]) < 1e-9 and all(c @ lengths == 24 and abs(c @ y - v) < 1e-9 for v, c in found)


@pytest.mark.parametrize("special", [True, False])
def test_chunks_give_the_librarys_ids(special):
    r = random.Random(5)
    parts = [" ", " ", " ", "a", "b", "'s", "é", " ", " ", "　", "\n", "\t", ".", "1", "<|endoftext|>", "世", "😀", "\u0085", "\x1c", "'", "▁", "​", "à", "don't", ",", "×", "?"]
    values = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(4000)]
    encode = byte_tokenizer(PATH, special)
    chunks = Chunks(lambda found: [id_lists(encode(found))], words=True)
    ((_, _, counts, codes),) = chunks.steps(pa.array(values))
    ids = [chunks.lists[0].take(c).tolist() for c in np.split(codes, np.cumsum(counts)[:-1])]
    assert ids == encode([v.encode() for v in values])
