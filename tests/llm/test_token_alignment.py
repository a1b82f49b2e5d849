"""Token alignment against a plain version that walks each text's two token lists, with odd texts, ties and clashing names."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import token_alignment as ta
from sweepframe.llm.queries import QUERIES, tokenizer_file

A, B = tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


def plain(texts):
    """Per text (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tokenizer.encode_special_tokens = True
    a_bytes, b_bytes = ta.byte_entries(A), ta.piece_entries(model)
    rows, held, best = [], Counter(), defaultdict(int)
    for t in texts:
        want = (" " + t).encode() if t else b""
        a = tokenizer.encode(" " + t, add_special_tokens=False).ids if t else []
        b = model.encode(t) if t else []
        if b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
            a = b = []
        ends = [set(np.cumsum([len(table[i]) for i in ids]).tolist()) for ids, table in ((a, a_bytes), (b, b_bytes))]
        groups, i, j, x, y, one, other = [], 0, 0, 0, 0, [], []
        for end in sorted(ends[0] & ends[1]):
            while x < end:
                one.append(a[i])
                x += len(a_bytes[a[i]])
                i += 1
            while y < end:
                other.append(b[j])
                y += len(b_bytes[b[j]])
                j += 1
            groups.append((one, other))
            one, other = [], []
        links = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        held.update(links.keys())
        rows.append((len(a), len(b), groups, links))
    for (p, _), n in held.items():
        best[p] = max(best[p], n)
    out = []
    for n_a, n_b, groups, links in rows:
        text = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((n_a, n_b, len(groups), sum(links.values()), sum(n for k, n in links.items() if held[k] == best[k[0]]), sum(n * held[k] for k, n in links.items()), text))
    return out


@pytest.fixture(scope="module")
def texts():
    r = random.Random(3)
    words = [f"w{k}{'abcdefgh'[k % 8]}ton" for k in range(200)] + ["it's", "été", "straße", "12,345.67", "don't", "(so)", "end.\nNext"]
    odd = [None, "", " ", "  a", "a ", "\n", "x" * 3000, "xy" * 900, "é日😀 <s> <|endoftext|> \x00", "a▁b", "▁", "　a\u0085b c", "世界 hello 世界", "word " * 100_000, "same text", "same text"]
    return odd + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(150)]


def test_align_equals_plain_version(spark, texts):
    want = plain(texts)
    docs = spark.createDataFrame([(k, t, 1, "c") for k, t in enumerate(texts)], "doc_id long, text string, n_a long, pair string").repartition(4)
    got = {r[0]: tuple(r[1:]) for r in ta.align(docs, A, B).collect()}
    assert got == dict(enumerate(want))
    hashed = {r.doc_id: r.groups for r in ta.align(docs, A, B, digest=True).collect()}
    assert hashed == {k: hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "" for k, w in enumerate(want)}


def test_small_blocks_and_hot_pairs(spark, texts, monkeypatch):
    """Products in blocks of a few terms, and pairs of every row, many of them hot, give the same."""
    values = texts[14:40] + ["same text"] * 1500
    docs = spark.createDataFrame(list(enumerate(values)), "doc_id long, text string").repartition(3)
    got = {r[0]: tuple(r[1:]) for r in ta.align(docs, A, B).collect()}
    assert got == dict(enumerate(plain(values)))
    aligner = ta.Aligner(A, B)
    chunks = [b" " + t.encode() for t in ("hello", "etc.,etc.", "x" * 300, "unbelievable\nthing")]
    whole = aligner(chunks)
    monkeypatch.setattr(ta, "MOST_TERMS", 3)
    for one, other in zip(whole, aligner(chunks), strict=True):
        assert one.flat.tolist() == other.flat.tolist() and one.sizes.tolist() == other.sizes.tolist()


def test_products():
    r = np.random.default_rng(4)
    for _ in range(10):
        x, y = r.integers(0, 3, (7, 9)), r.integers(0, 3, (9, 5))
        rows = [ta.Rows.summed(*np.nonzero(m), m[np.nonzero(m)], *m.shape) for m in (x, y)]
        out = np.zeros((7, 5), int)
        for first, part in ta.products(*rows, 5):
            out[part.row_of() + first, part.columns] = part.values
        assert (out == x @ y).all()


def test_edges(spark):
    docs = spark.createDataFrame([(1, "one"), (1, "one"), (1, None), (None, "two")], "doc_id long, text string")
    got = ta.align(docs, A, B)
    assert got.count() == 4 and got.where("n_a = 0").count() == 1
    assert ta.align(docs.where("false"), A, B).count() == 0
    with pytest.raises(ValueError):
        ta.align(docs.withColumn("groups", F.lit(1)), A, B, keep=("doc_id", "groups"))
    assert ta.align(docs.withColumn("lang", F.lit("en")), A, B, keep=("doc_id", "lang")).where("lang = 'en'").count() == 4


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    want = {d.doc_id: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest() if w[-1] else "") for d, w in zip(docs, plain([d.text for d in docs]), strict=True)}
    assert {r[0]: tuple(r[1:]) for r in QUERIES["op13_token_alignment"](spark, "/root/testdata/sf0.001").collect()} == want
