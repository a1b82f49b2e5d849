"""The training-data operators against brute force, exact round trips and planted cases, with nulls, empty texts, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sweepframe.llm import arc_warc, compression_quality, contamination, license_digest, line_templates, minhash_join, nn_descent, piece_bpe, repeated_strings, string_kernel
from sweepframe.llm.common import components, key_join
from sweepframe.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
random.seed(4)
WORDS = [f"w{k}{'abcdefgh'[k % 8]}" for k in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def base(spark):
    a = prose(80, 1)
    near = a.split()
    near[40] = "changed"
    texts = [a, " ".join(near), a, None, "", "   \n", "one two", "One TWO", prose(80, 2), "x" * 50_000, "é日😀 <s> ▁ \x00"]
    return docs(spark, texts).withColumn("id", F.lit("clash")).withColumn("signature", F.lit(1))


def test_components(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, 101), (101, 100), (200, 200), (300, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(51)} == {0} and got[300] == 0 and got[101] == got[100] == 100 and 200 not in got
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_key_join_with_hot_keys(spark):
    rows = [(k, 0 if k % 3 == 0 else k % 7, 1) for k in range(200)] + [(200, None, 1), (201, 99, 1)]
    df = spark.createDataFrame(rows, "id long, k long, other long")
    counts = Counter(k for _, k, _ in rows if k is not None and k != 99)
    keys = spark.createDataFrame([(k, n, -k) for k, n in counts.items()], "k long, n long, minus long")
    want = Counter((i, k, counts[k], -k) for i, k, _ in rows if k in counts)
    for least, most in ((1_000, 1_000_000), (50, 1_000_000), (1, 3), (1, 1_000_000)):
        got = key_join(df, keys, ["k"], least, most)
        assert Counter((r.id, r.k, r.n, r.minus) for r in got.collect()) == want
    assert key_join(df, keys.limit(0), ["k"]).count() == 0


def brute_near(texts):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(t) for t in texts]
    low = list(range(len(texts)))
    for _ in texts:
        for a in range(len(texts)):
            for b in range(len(texts)):
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    low[a] = min(low[a], low[b])
    return {k: (len(sets[k]), low[k]) for k in range(len(texts))}


def test_minhash_join(spark, base):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.near_duplicates(base).collect()}
    assert got == brute_near([r.text for r in base.orderBy("doc_id").collect()])
    original = prose(60, 9).split()
    family = []
    for k in range(40):  # near copies of one text that aren't all near to each other
        w = list(original)
        for j in random.Random(k).sample(range(60), k % 6):
            w[j] = f"edit{k}x{j}"
        family.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash_join.near_duplicates(docs(spark, family)).collect()}
    assert got == brute_near(family)
    assert minhash_join.near_duplicates(docs(spark, []).where("false")).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + length] for d in data for s in range(len(d) - length + 1))
    out = {}
    for k, d in enumerate(data):
        gone = np.zeros(len(d), bool)
        for s in range(len(d) - length + 1):
            if seen[d[s : s + length]] > 1:
                gone[s : s + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        out[k] = (len(d), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("most", [50_000, 2])
def test_repeated_strings(spark, most):
    shared = "".join(random.choice("abcd") for _ in range(300))
    texts = [None, "", "a", "ab" * 90, "Q" * 200, shared, shared, "é" + shared[20:180] + "x", "y" + shared[60:120] + "z" + shared[60:120], shared[:70] + "Q" * 90]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings.repeated_strings(docs(spark, texts), 40, 16, most).collect()}
    assert got == brute_repeats(texts, 40)


def window_brute(texts, length):
    """Bytes that go from each text, by counting windows."""
    seen = Counter(hash(t[a : a + length]) for t in texts for a in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 1, int)
        for a in range(len(t) - length + 1):
            if seen[hash(t[a : a + length])] > 1:
                gone[a] += 1
                gone[a + length] -= 1
        out.append(int((np.cumsum(gone)[:-1] > 0).sum()))
    return out


@pytest.mark.parametrize("most", [50_000, 3])
def test_repeated_strings_of_400_bytes(spark, most):
    """At the production length: a hot passage in different surroundings, short periods, a text beyond one step, an empty table."""
    r = random.Random(8)
    passage = "".join(r.choice("abcdefgh ") for _ in range(700))
    texts = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(40))) + passage[r.randrange(60) : 700 - r.randrange(60)] + "".join(r.choice("xyz") for _ in range(r.randrange(40))) for _ in range(40)]
    texts += ["ab" * 500, "q" * 399, "q" * 401, passage[:399], "é" * 300]
    data = [t.encode() for t in texts]
    got = {x.doc_id: x.n_removed for x in repeated_strings.repeated_strings(docs(spark, texts), most=most).collect()}
    assert [got[k] for k in range(len(texts))] == window_brute(data, 400)
    assert repeated_strings.repeated_strings(docs(spark, []).where("false")).count() == 0


def test_repeated_strings_in_a_long_text(spark):
    r = random.Random(5)
    long = "".join(r.choice("abcdefghijklmnop") for _ in range(1_300_000))
    got = {x.doc_id: (x.n_removed, x.n_spans) for x in repeated_strings.repeated_strings(docs(spark, [long, long[1_000_000:1_100_000], "z" + long[50:500]])).collect()}
    assert got == {0: (100_450, 2), 1: (100_000, 1), 2: (450, 1)}


def test_deep_shallow_sorting():
    for seed in range(200):
        r = random.Random(seed)
        stem = "".join(r.choice("ab") for _ in range(60))
        strings = [(stem[: r.randrange(61)] + "".join(r.choice("abc") for _ in range(r.randrange(5)))).encode() for _ in range(r.randrange(1, 25))]
        order, shared = repeated_strings.deep_shallow(strings)
        assert [strings[k] for k in order] == sorted(strings)
        assert all(strings[order[k]][: shared[k]] == strings[order[k - 1]][: shared[k]] for k in range(1, len(order)))


def test_encoding_is_the_librarys(spark, base):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in base.collect()}
    for r in piece_bpe.encode(base, vocabulary()).collect():
        assert r.ids == model.encode(texts[r.doc_id]) and r.decoded == model.decode(r.ids)
    for r in piece_bpe.encode_digests(base, vocabulary()).collect():
        ids = model.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    encoder = piece_bpe.Encoder(vocabulary())
    for seed in range(300):
        r = random.Random(seed)
        text = "".join(r.choice(["the", " ", "  ", "ing", "\n", "é", "😀", "1", "▁", "q"]) for _ in range(r.randrange(25)))
        ids = [r.randrange(3, 600) for _ in range(6)]
        assert encoder.encode(text) == model.encode(text) and encoder.decode(ids) == model.decode(ids)


def test_contamination(spark):
    items = [(k, prose(12 + 7 * k, 100 + k)) for k in range(6)] + [(90, "tiny one"), (91, None), (92, "")]
    texts = [None, "", prose(900, 5) + " " + items[3][1].upper() + " " + prose(900, 6), prose(40, 7), "so TINY\tone here", items[0][1], " ".join(items[5][1].split()[:30]), prose(5000, 8) + "\n" + items[1][1]]
    found = contamination.contained_items(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id) for r in found.collect()}

    def grams(t, n):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}

    want = set()
    for k, t in enumerate(texts):
        for i, x in items:
            n = min(5, len((x or "").split()))
            if n and len(grams(x, n) & grams(t, n)) >= 0.75 * len(grams(x, n)):
                want.add((k, i))
    assert got == want and (2, 3) in got and (7, 1) in got
    assert contamination.contained_items(docs(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_line_templates(spark):
    texts = [f"{prose(60, k)}\nVisit page {k} of the site today\n{prose(50, 500 + k)}" for k in range(12)]
    texts += [texts[0]] * 15 + [None, "", "Visit page 7 of the site today", prose(30, 77)]
    rows = {r.doc_id: r for r in line_templates.drop_lines(docs(spark, texts)).collect()}
    assert all(rows[k].n_dropped == 1 and "Visit" not in rows[k].text and rows[k].n_chars == len(rows[k].text) for k in range(27))
    # Exact copies alone make no line recur, a document of nothing else loses all, null stays null.
    assert prose(60, 0) in rows[0].text and (rows[29].n_dropped, rows[29].text) == (1, "") and rows[27].text is None and rows[28].text == ""
    assert line_templates.drop_lines(docs(spark, texts).where("false")).count() == 0


def test_line_templates_that_are_most_of_their_texts(spark):
    r = random.Random(5)
    boiler = [f"Read all about the weather and the {w} of the day in the paper of the town number {{}}" for w in ("sports", "news")]
    # One or two boilerplate lines and a short own one; one boilerplate line alone; near copies of a text of lines and of a text of one line.
    owns = [f"{chr(97 + k % 26) * 5}{chr(97 + k // 26) * 4} mine" for k in range(40)]
    mostly = [f"{boiler[0].format(k)}\n{w}" if k % 2 else f"{boiler[0].format(k)}\n{w}\n{boiler[1].format(k)}" for k, w in enumerate(owns)]
    alone = [boiler[0].format(99), "Nothing else at all\nhere"]
    text = [prose(12, 900 + k) for k in range(8)]
    family = []
    for k in range(60):
        lines = list(text)
        for at in r.sample(range(8), k % 3):
            words = lines[at].split()
            words[r.randrange(12)] = f"edit{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyz'[k % 3]}"
            lines[at] = " ".join(words)
        family.append("\n".join(lines))
    single = [prose(40, 950).replace("w", "v", k % 7) for k in range(30)]
    texts = mostly + alone + family + single
    got = {x.doc_id: x for x in line_templates.drop_lines(docs(spark, texts)).collect()}
    assert [got[k].text for k in range(40)] == owns and got[40].text == "" and got[41].text == texts[41]
    assert all(got[k].text == texts[k] for k in range(42, len(texts)))
    assert {k: v.text for k, v in got.items()} == plain_lines(list(enumerate(texts)))


def test_license_digest(spark):
    full = license_digest.KNOWN[0][1]
    texts = [f"Copyright (c) 2020 A. Person\n{full.upper()}", full.replace("License", "Licence") + "\n", "words\n  released under the MIT-License!\nmore", "Released under the MIT License and more", None, ""]
    rows = {r.doc_id: (r.license_id, r.notices, r.n_notices) for r in license_digest.license_scan(docs(spark, texts), license_digest.known_licenses(spark)).collect()}
    assert [rows[k][0] for k in range(6)] == ["MIT", "MIT", None, None, None, None]
    assert rows[2] == (None, "MIT", 1) and rows[3] == (None, "", 0) and rows[4] == (None, "", 0)


def test_archives_round_trip(spark):
    rows = [(0, "http://a/ b", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (1, None, None), (2, "u", ""), (3, "u", "same"), (4, "v", "same"), (7, "w", "same"), (8, "x", "line\nfiledesc://x\n1 0 y\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.number: r for r in arc_warc.round_trip(pages).collect()}
    first = {}
    for i, _, html in rows:
        data = (html or "").encode()
        first.setdefault(data, i)
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(data), arc_warc.base32(data))
        assert (r.warc_type, r.refers_to) == (("response", None) if first[data] == i else ("revisit", first[data]))
        assert r.warc_type == "revisit" or r.payload == (html or "")
    assert got[0].target_uri == "http://a/%20b" and got[4].refers_to_id == got[3].record_id
    assert arc_warc.round_trip(pages.where("false")).count() == 0
    bad = b"filedesc://a 0.0.0.0 20240101000000 text/plain 9\n9 0 x\nabc\n"
    with pytest.raises(ValueError):
        list(arc_warc.parse_arc([bad]))


def test_archives_as_files(spark, tmp_path, monkeypatch):
    """Small files with a member per record, version blocks as warcinfo, block digests, and errors where a digest or a referent doesn't fit."""
    import glob
    import gzip

    monkeypatch.setattr(arc_warc, "FILE_RECORDS", 3)
    pages = spark.createDataFrame([(k, f"http://h/{k}", "x" * 200 if k % 2 else f"page {k}") for k in range(10)], "number long, url string, payload string")
    arc, warc = f"{tmp_path}/arc", f"{tmp_path}/warc"
    arc_warc.write_arc(pages.coalesce(1), arc, 2)
    files = glob.glob(f"{arc}/part-*")
    assert len(files) == 5 and all(gzip.decompress(open(f, "rb").read()).startswith(b"filedesc:") for f in files)
    arc_warc.convert(spark, arc, warc)
    rows = arc_warc.read_warc(spark, warc).collect()
    infos = {r.record_id for r in rows if r.warc_type == "warcinfo"}
    assert len(infos) == 5 and {r.warcinfo_id for r in rows if r.number is not None} == infos and len({r.warc_date for r in rows}) > 5
    text = b"".join(gzip.decompress(open(f, "rb").read()) for f in glob.glob(f"{warc}/part-*"))
    assert text.count(b"WARC-Block-Digest: sha1:") == 15 and text.count(b"WARC/1.1") == 15
    back = {r.number: r for r in arc_warc.resolved(arc_warc.read_warc(spark, warc)).collect()}
    assert all((back[k].refers_to, back[k].payload_bytes) == ((1, 200) if k % 2 and k > 1 else (None, 200 if k % 2 else 6)) for k in range(10))
    with pytest.raises(ValueError, match="block digest"):
        list(arc_warc._warc_rows("f", [text.replace(b"page 4", b"page 5")]))
    lost = arc_warc.read_warc(spark, warc).where("number is null or number <> 1")
    with pytest.raises(Exception, match="no response fits"):
        arc_warc.resolved(lost).collect()


def test_nn_descent(spark):
    r = np.random.default_rng(0)
    x = r.standard_normal((120, 16))
    x[60:90] = x[0] + 0.02 * r.standard_normal((30, 16))  # more near ones than a list holds
    x[91] = x[90]
    x[93] = 2 * x[92]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(200, None), (201, [0.0] * 16), (202, [float("nan")] * 16), (203, [1.0, 2.0]), (204, [2.0, 4.0])]
    got = {g.vec_id: (g.n_links, g.component_id, g.kept) for g in nn_descent.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(120, dtype=bool)
    assert all(got[k][0] == near[k].sum() for k in range(120))
    assert {got[k][1] for k in [0, *range(60, 90)]} == {0} and got[91][1] == 90 and got[93][1] == 92
    assert all(got[k] == (0, k, True) for k in (200, 201, 202)) and got[204][1] == 203


def test_nn_descent_saturated_clusters(spark):
    """Two clusters of more members than a list holds, linked with each other but nearer within, and a third one apart."""
    r = np.random.default_rng(3)
    x = 0.01 * r.standard_normal((90, 16))
    x[:, 0] += 1
    x[30:60, 1] += 0.2
    x[60:, 2] += 5
    got = {g.vec_id: (g.n_links, g.component_id) for g in nn_descent.linked(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.95) & ~np.eye(90, dtype=bool)
    assert near[:30, 30:60].all() and not near[:60, 60:].any()
    assert got == {k: (near[k].sum(), 0 if k < 60 else 60) for k in range(90)}


def test_nn_descent_audit(spark, monkeypatch):
    """Links with copies don't outweigh missed ones: tables that find none of the lone pairs are an error, not a result."""
    r = np.random.default_rng(6)
    x = np.repeat(r.standard_normal((20, 16)), 2, axis=0)
    x[1::2] += 0.02 * r.standard_normal((20, 16))
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(100 + k, x[0].tolist()) for k in range(300)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {g.vec_id: g.n_links for g in nn_descent.linked(table).collect()}
    assert all(got[k] == 1 for k in range(2, 40)) and got[0] == got[100] == 301
    kept = nn_descent.nearest

    def only_first(k, floor):
        work = kept(k, floor)

        def some(ids, v):
            a, b, s = work(ids, v)
            return tuple(c[(a < 2) & (b < 2)] for c in (a, b, s))

        return some

    monkeypatch.setattr(nn_descent, "nearest", only_first)
    monkeypatch.setattr(nn_descent, "TURNS", 1, raising=False)
    with pytest.raises(RuntimeError):
        nn_descent.linked(table)


LABELS = "doc_id long, quality int, toxic int"


def labelled(spark, n=400):
    r = random.Random(1)
    texts, labels = [], []
    for k in range(n):
        t, toxic, good = prose(40, 1000 + k).replace("0", "o").replace("1", "l"), k % 3 == 0, k % 4 != 0
        w = t.split()
        if toxic:
            w.insert(r.randrange(40), "blockhead")
        texts.append(" ".join(w) if good else " ".join(x.upper() + "!!" for x in w))
        labels.append((k, int(good), int(toxic)))
    return docs(spark, texts + [None, ""]), spark.createDataFrame(labels, LABELS)


def test_quality(spark):
    d, labels = labelled(spark)
    rows = compression_quality.score_quality(d, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held) and all(0 <= r.score <= 1 for r in rows)
    none = compression_quality.score_quality(d, labels.where("false")).collect()
    assert {r.score for r in none} == {0.5}


def test_toxicity(spark):
    d, labels = labelled(spark)
    rows = string_kernel.score_toxicity(d, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(r.predicted == truth[r.doc_id] for r in held)
    others = docs(spark, ["you b-l-o-c-k-h-e-a-d there", "a b l o c k h e a d", "such a blockxhead", "a plain text", None, ""])
    got = [r.predicted for r in string_kernel.score_toxicity(others, labels.join(d, "doc_id").select("doc_id", "quality", "toxic").where("false")).orderBy("doc_id").collect()]
    assert len(set(got)) == 1
    machine = string_kernel.Machine([(r.doc_id, r.text, truth[r.doc_id]) for r in d.collect() if r.doc_id in truth], 64)
    s = machine.scores([r.text or "" for r in others.orderBy("doc_id").collect()], [{}, {}])
    assert s[:3].min() > 0.5 > s[3:].max()


def test_toxicity_of_many_late_insults(spark):
    """Seventy-five insults, each at the end of long documents."""
    r = random.Random(11)

    def word(n):
        return "".join(r.choice("bcdfghjklmnpqrstvxzaeiou") for _ in range(n))

    insults, n = [word(8) for _ in range(75)], 4500
    texts = [" ".join(word(9) for _ in range(8)) + " FILL" + ("" if k % 3 else insults[k // 3 % 75]) for k in range(n)]
    long = docs(spark, texts).withColumn("text", F.expr("replace(text, 'FILL', repeat('calm ', 4200))"))
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0)) for k in range(n)], LABELS)
    rows = [x for x in string_kernel.score_toxicity(long, labels).collect() if x.held_out]
    assert len(rows) > 700 and sum(x.predicted == (x.doc_id % 3 == 0) for x in rows) >= 0.94 * len(rows)


def test_string_kernel_is_the_sum_over_subsequences():
    def brute(a, b):
        def weights(t):
            out = Counter()
            for i in range(len(t)):
                for j in range(i + 1, len(t)):
                    for k in range(j + 1, min(len(t), i + string_kernel.SPAN)):
                        out[t[i] + t[j] + t[k]] += string_kernel.DECAY ** (k - i + 1)
            return out

        x, y = weights(a), weights(b)
        return sum(x[u] * y[u] for u in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    words = ["idiot", "idxiot", "banana", "mississippi", "abcabcabc"]
    got = string_kernel.kernel_values(words, string_kernel.landmark_table(words))
    for i, a in enumerate(words):
        for j, b in enumerate(words):
            assert got[i, j] == pytest.approx(brute(a, b), abs=1e-5)


CLASHING = ["id", "n_tokens", "ids_sha256", "decoded_sha256", "held_out", "score", "predicted", "n_lines", "n_dropped", "text_key", "pos", "tokens", "leaf", "template", "signature", "component_id", "kept", "n_bytes", "spans", "cuts", "license_id", "notices", "item_id", "n_common", "y", "half", "bag"]


def operators(spark):
    _, labels = labelled(spark, 60)
    items = spark.createDataFrame([(1, prose(30, 4242))], "item_id long, text string")
    return {
        "op2": lambda d: compression_quality.score_quality(d, labels), "op4": lambda d: contamination.contained_items(d, items), "op5": lambda d: line_templates.drop_lines(d).select("doc_id", "text"),
        "op6": lambda d: repeated_strings.repeated_strings(d), "op7": lambda d: minhash_join.near_duplicates(d), "op8": lambda d: piece_bpe.encode_digests(d, vocabulary()),
        "op9": lambda d: string_kernel.score_toxicity(d, labels), "op10": lambda d: license_digest.license_scan(d, license_digest.known_licenses(spark)),
        "clean": lambda d: contamination.clean_documents(d, items).select("doc_id", "text"),
    }


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and blank texts, repeats, near copies and a text beyond one step."""
    d, _ = labelled(spark, 60)
    texts = [r.text for r in d.orderBy("doc_id").collect()] + ["   \n ", prose(30, 4242), prose(60, 1), prose(60, 1), prose(60, 1) + " end", "\n".join(prose(40, 9000 + k) for k in range(6000))]
    assert len(texts[-1]) > 1 << 20
    return docs(spark, texts)


@pytest.mark.parametrize("name", ["op2", "op4", "op5", "op6", "op7", "op8", "op9", "op10", "clean"])
def test_clashing_names_odd_texts_and_empty_tables(spark, odd, name):
    run = operators(spark)[name]
    plain = sorted(map(str, run(odd).collect()))
    clash = odd.select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    assert sorted(map(str, run(clash).collect())) == plain and (name == "op4" or len(plain) >= 60)
    assert run(odd.where("false")).count() == 0


def test_embeddings_empty_and_hot(spark):
    kind = "vec_id long, embedding array<double>, id string, v int, cell long"
    assert nn_descent.linked(spark.createDataFrame([], kind)).count() == 0
    r = np.random.default_rng(2)
    rows = [(k, [1.0, 0.0, 0.0, 0.0], "clash", 1, 2) for k in range(700)] + [(700 + k, r.standard_normal(4).tolist(), None, None, None) for k in range(3)] + [(900, [1.0, None, 0.0, 0.0], "x", 1, 1)]
    got = {x.vec_id: (x.n_links, x.component_id) for x in nn_descent.linked(spark.createDataFrame(rows, kind)).collect()}
    assert all(got[k][0] >= 699 and got[k][1] == 0 for k in range(700)) and got[900] == (0, 900)


def test_components_with_a_hub(spark, monkeypatch):
    from sweepframe.llm import common

    monkeypatch.setattr(common, "HUB", 20)
    edges = [(0, k) for k in range(1, 200)] + [(500, k) for k in range(150, 300)] + [(1000 + k, 1001 + k) for k in range(40)]
    got = {r.id: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in [*range(300), 500]} == {0} and {got[1000 + k] for k in range(41)} == {1000}


def test_quality_is_the_size_difference(spark):
    """Scores against a plain recomputation: dictionaries of the same rows, sizes block by block, pooled neighbours."""
    import zlib

    import zstandard

    d, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in d.collect()}
    learn = sorted(k for k in truth if zlib.crc32(str(k).encode()) % 5)
    half = {k: zlib.crc32(f"{k}/dictionary".encode()) % 2 for k in learn}
    blocks = {y: [texts[k][a : a + 512] for k in learn if half[k] and truth[k] == y for a in range(0, len(texts[k]), 512)] for y in (0, 1)}
    made = [zstandard.ZstdCompressionDict(compression_quality.trained(blocks[y])) for y in (0, 1)]

    def difference(data):
        sizes = [sum(len(zstandard.ZstdCompressor(level=3, dict_data=m, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data[a : a + 512])) for a in range(0, len(data), 512)) for m in made]
        return (sizes[0] - sizes[1]) / max(1, len(data))

    rest = sorted((difference(texts[k]), truth[k]) for k in learn if not half[k])
    # The isotonic fit as the largest of smallest means; rows of equal fit are one pool.
    fit = [max(min(np.mean([y for _, y in rest[i : j + 1]]) for j in range(k, len(rest))) for i in range(k + 1)) for k in range(len(rest))]
    pools = {}
    for (x, y), f in zip(rest, fit, strict=True):
        pools.setdefault(round(f, 9), []).append((x, y))
    curve = [(np.mean([x for x, _ in p]), (sum(y for _, y in p) + 0.5) / (len(p) + 1)) for _, p in sorted(pools.items())]
    got = {r.doc_id: r.score for r in compression_quality.score_quality(d, labels).collect()}
    assert all(abs(got[k] - np.interp(difference(t), *zip(*curve))) < 1e-9 for k, t in texts.items())
    assert all((got[k] > 0.5) == (truth[k] == 1) for k in truth)
    # Too little to train on: the texts themselves are the dictionary.
    assert compression_quality.trained([b"a few words", b"and some more"]) == b"a few wordsand some more"


def plain_lines(rows, least=10, depth=3, percent=70, share=50):
    """Line dedup by dictionaries: {doc_id: text}."""
    lines = [(i, t, n, re.findall(r"[^\s]+", re.sub(r"[^\s0-9]*[0-9][^\s]*", "<*>", x)), len(x)) for i, t in rows if t is not None for n, x in enumerate(t.split("\n"))]
    lines = [(i, t, n, w, size, (len(w), tuple(w[:depth]))) for i, t, n, w, size in lines if w]

    def often(pairs):
        texts = {}
        for key, t in pairs:
            texts.setdefault(key, set()).add(t)
        return {k for k, v in texts.items() if len(v) >= least}

    leaves = often((x[5], x[1]) for x in lines)
    lines = [x for x in lines if x[5] in leaves]
    fixed = often(((x[5], k, w), x[1]) for x in lines for k, w in enumerate(x[3]) if w != "<*>")
    named = []
    for i, t, n, w, size, leaf in lines:
        own = tuple((k, v) for k, v in enumerate(w) if (leaf, k, v) in fixed)
        if any(re.search(r"[^\W\d_]", v) for _, v in own) and 100 * len(own) >= percent * sum(v != "<*>" for v in w):
            named.append((i, t, n, size, (leaf, own)))
    found = [x for x in named if x[4] in often((y[4], y[1]) for y in named)]
    chars = Counter()
    for i, _, _, size, _ in found:
        chars[i] += size
    dropped = often((x[4], x[1]) for x in found if 100 * chars[x[0]] <= share * len(x[1]))
    have, own = {}, {}
    for x in found:
        have.setdefault(x[4], set()).add(x[1])
        own.setdefault(x[0], []).append(x)
    company = []
    for i, mine in own.items():
        order = sorted({x[4] for x in mine}, key=lambda t: (-len(have[t]), min(x[2] for x in mine if x[4] == t)))
        for t in order:
            others, places = [o for o in order if o != t], {x[2] for x in mine if x[4] == t}
            rest = sorted(x for n, x in enumerate(mine[0][1].split("\n")) if n not in places and x.split())
            if len(others) > 1 or rest:
                company.append((t, ("template", others[0]) if len(others) > 1 else ("rest", *rest)))
    dropped |= often(company)
    gone = {(x[0], x[2]) for x in found if x[4] in dropped}
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone) for i, t in rows}


def test_pipeline_against_plain_versions(spark, tmp_path):
    """Each stage on its own input, with extra columns that clash with results."""
    import public_tokenizers
    import sentencepiece

    import corpus_pipeline

    d, labels = labelled(spark, 160)
    item = prose(30, 4242)
    texts = [(r.doc_id, r.text + f"\nVisit page {r.doc_id} of the site today" if r.text and r.doc_id % 4 == 1 else r.text) for r in d.collect() if r.doc_id < 160] + [(300, None), (301, "")]
    texts += [(200 + k, prose(50, 77) + " w" * (k % 3)) for k in range(14)] + [(220, prose(20, 78) + " " + item)]
    full = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts], DOCS).select("*", *(F.lit("clash").alias(c) for c in CLASHING))
    labels.where("doc_id < 160").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    full.write.parquet(f"{tmp_path}/documents.parquet")
    stages, at, columns = dict(corpus_pipeline.STAGES), full, full.columns

    def texts_of(df):
        return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}

    def step(name):
        out = stages[name](spark, at, str(tmp_path))
        assert out.columns == columns
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        return spark.read.parquet(path)

    before, at = texts_of(at), step("toxicity")
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    scores = string_kernel.score_toxicity(full.select("doc_id", "text"), labels.where("doc_id < 160"))
    assert texts_of(at) == {r.doc_id: before[r.doc_id] for r in scores.where("predicted = 0").collect()} and not toxic & set(texts_of(at))
    before, at = texts_of(at), step("line_dedup")
    assert texts_of(at) == plain_lines(sorted(before.items())) and any(texts_of(at)[k] != before[k] for k in before)
    before, at = texts_of(at), step("near_dedup")
    ids = sorted(before)
    low = brute_near([before[k] for k in ids])
    assert set(texts_of(at)) == {ids[k] for k, (_, c) in low.items() if c == k} and 213 not in texts_of(at)
    before, at = texts_of(at), step("decontamination")
    assert set(texts_of(at)) == set(before) - {220}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    before = texts_of(at)
    rows = stages["encoding"](spark, at, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(before) and {300, 301} <= set(before)
    for r in rows:
        own = model.encode(before[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(model.decode(own).encode()).hexdigest())
    empty = full.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d, labels = labelled(spark, 200)
    rows = d.where("doc_id < 200").collect()
    item = prose(30, 4242)
    rows += [(200 + k, prose(50, 77), "en", "s", 1) for k in range(3)] + [(210, prose(20, 78) + " " + item, "en", "s", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels.where("doc_id < 200").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert not toxic & set(kept) and 200 in kept and not {201, 202, 210} & set(kept) and min(kept.values()) > 0
    assert len([k for k in kept if k < 200]) == 200 - len([k for k in toxic if k < 200])
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "encoding"]
