"""Operator 8: exact merge-type (BPE) SentencePiece encoding and decoding by backtracking.

Encoding never runs the merge queue over a text. An Aho-Corasick automaton over the pieces finds the longest piece that starts at
each place; tokens are laid from left to right, and a token may follow another only if re-merging the two side by side gives just
these two again (kept in a table of pairs). Where no token fits, the last one is replaced by its next shorter prefix, and a bitfield
remembers the places from which no way on was found. A sequence whose neighbours are all compatible is the merge result.

Pieces never cross from other characters into a space mark, so a text is the sequence of its chunks (space marks and what follows
them) and each distinct chunk is encoded, and its ids decoded, once per Python worker, in a table of bounded size.

Defined results: null and empty texts give no ids and the text ''. Characters outside the vocabulary become byte pieces. Copies,
ties of equal scores (the leftmost pair merges first) and texts of any length are handled alike; extra columns, whatever their names, are left out
unless they are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

MARK = "▁"
#: Most chunks (twice so many in all) and token pairs that a worker remembers, about 200 MB.
MOST_CHUNKS, MOST_PAIRS = 400_000, 300_000


def load_vocabulary(path: str) -> dict:
    """Pieces with scores, byte pieces and flags of a SentencePiece BPE model file with the identity normaliser."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    if any(model.decode(model.encode(t)) != t for t in ("ab \u212b ", " A\u030a  ", "\ufb01 \u2460\t\u00b2  x", "\u3000\uff21\n")):
        raise ValueError("only models with the identity normaliser are supported")
    normal, special, scores, data = {}, {}, {}, {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            data[int(piece[3:5], 16)] = i
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            special[i] = " ⁇ " if model.is_unknown(i) else ""
        else:
            normal[piece], scores[piece] = i, model.get_score(i)
    if len(data) != 256 or any(MARK in p.lstrip(MARK) for p in normal):
        raise ValueError("a model with byte pieces, and none that runs into a space mark, is needed")
    return {"ids": normal, "scores": scores, "bytes": data, "special": special, "last_merge": last_merges(scores)}


def merged(text: str, scores: dict[str, float], down_to: int = 1) -> list[str]:
    """The plain merge procedure, for short strings: the best-scored adjacent pair first, the leftmost of equals."""
    parts = list(text)
    while len(parts) > down_to:
        best, at = None, -1
        for k in range(len(parts) - 1):
            score = scores.get(parts[k] + parts[k + 1])
            if score is not None and (best is None or score > best):
                best, at = score, k
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def last_merges(scores: dict[str, float]) -> dict[str, tuple[str, str]]:
    """The two parts of each piece's last merge, for pieces that merging gives and whose parts have merged before them."""
    found = {}
    for p in scores:
        if len(p) > 1 and len(parts := merged(p, scores, 2)) == 2 and all(len(x) == 1 or scores.get(x, 0) > scores[p] for x in parts):
            found[p] = (parts[0], parts[1])
    return found


class Encoder:
    """encode(text) and decode(ids) for one vocabulary, with bounded tables of what was seen.

    Tokens are numbers here: the pieces by their ids, then every other single character as it is met.
    """

    def __init__(self, vocabulary: dict):
        import ahocorasick

        self.ids, self.scores, self.bytes, self.last_merge = (vocabulary[k] for k in ("ids", "scores", "bytes", "last_merge"))
        self.pieces = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.pieces.add_word(p, i)
        self.pieces.make_automaton()
        self.shown = {i: p.replace(MARK, " ").encode() for p, i in self.ids.items()}
        self.shown |= {i: bytes([b]) for b, i in self.bytes.items()}
        self.shown |= {i: s.encode() for i, s in vocabulary["special"].items()}
        self.raw = set(self.bytes.values())
        #: Of each token: its text, its length, the ids it stands for joined by commas, the next shorter token it begins with (or -1).
        top = max(self.shown) + 1
        self.text, self.size, self.joined, self.shorter = [""] * top, [0] * top, [""] * top, [-1] * top
        self.token_of = dict(self.ids)
        for p, i in self.ids.items():
            self.text[i], self.size[i], self.joined[i] = p, len(p), str(i)
        for p, i in self.ids.items():
            if len(p) > 1:
                cut = next((k for k in range(len(p) - 1, 1, -1) if p[:k] in self.ids), 1)
                self.shorter[i] = self.token(p[:cut])
        # Of each token, which may follow it; of -1, which may begin.
        self.pairs: dict[int, dict[int, bool]] = {}
        self.seen = 0
        self.edges: dict[tuple[int, str], tuple[list[str], list[float]] | None] = {}
        # Chunks seen of late, and those of the time before: the ids of each joined by commas, and the text that these decode to.
        self.chunks: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        # A character of no piece parts chunks as well; line ends are worth it.
        alone = "\n" if not any("\n" in p for p in self.ids) else ""
        self.cut = re.compile(f" +[^ {alone}]*|[^ {alone}]+" + (f"|{alone}" if alone else "")).findall

    def token(self, piece: str) -> int:
        """The number of a piece or of a single character."""
        i = self.token_of.get(piece)
        if i is None:
            i = self.token_of[piece] = len(self.text)
            self.text.append(piece)
            self.size.append(1)
            self.shorter.append(-1)
            self.joined.append(",".join(str(self.bytes[b]) for b in piece.encode()))
        return i

    def edge(self, token: str, side: int) -> tuple[list[str], list[float]] | None:
        """The symbols at one edge of a token while it is merged, each with the score of the merge that takes it up; None if unknown."""
        key = (side, token)
        if key not in self.edges:
            symbols, ends, x = [token], [float("-inf")], token
            while len(x) > 1 and x in self.last_merge:
                ends.append(self.scores[x])
                x = self.last_merge[x][side]
                symbols.append(x)
            self.edges[key] = (symbols[::-1], ends[::-1]) if len(x) == 1 else None
        return self.edges[key]

    def compatible(self, left: int, right: int) -> bool:
        """True if merging the characters of both tokens side by side gives just these two again; of one token, after -1."""
        if self.seen >= MOST_PAIRS:
            self.seen = 0
            for row in self.pairs.values():
                row.clear()
        self.seen += 1
        x, y = self.text[left] if left >= 0 else "", self.text[right]
        a, b = x and self.edge(x, 1), self.edge(y, 0)
        known = self.merges_apart(*a, *b) if a and b else merged(x + y, self.scores) == ([x, y] if x else [y])
        self.pairs.setdefault(left, {})[right] = known
        return known

    def merges_apart(self, xs: list[str], x_ends: list[float], ys: list[str], y_ends: list[float]) -> bool:
        """Re-merges both sides of a boundary in order of score; False if a merge across it comes first somewhere."""
        i = j = 0
        while True:
            across = self.scores.get(xs[i] + ys[j])
            if across is not None and across > x_ends[i] and across >= y_ends[j]:
                return False
            if i == len(xs) - 1 and j == len(ys) - 1:
                return True
            if x_ends[i] >= y_ends[j]:
                i += 1
            else:
                j += 1

    def tokens(self, chunk: str) -> list[int]:
        """The tokens of a chunk, found by backtracking."""
        longest = [-1] * len(chunk)
        size = self.size
        for end, i in self.pieces.iter(chunk):
            longest[end - size[i] + 1] = i
        if -1 in longest:
            longest = [self.token(c) if i < 0 else i for i, c in zip(longest, chunk, strict=True)]
        pairs, shorter = self.pairs, self.shorter
        failed = 0  # bit k: no way on from place k
        out: list[int] = []
        at, last, token, n = 0, -1, longest[0], len(chunk)
        row = pairs.setdefault(-1, {})
        while True:
            fits = row.get(token)
            if fits is None:
                fits = self.compatible(last, token)
            if fits:
                end = at + size[token]
                if not (failed and failed >> end & 1):
                    out.append(token)
                    if end == n:
                        return out
                    row = pairs.get(token)
                    if row is None:
                        row = pairs[token] = {}
                    at, last, token = end, token, longest[end]
                    continue
            while shorter[token] < 0:
                failed |= 1 << at
                token = out.pop()
                at -= size[token]
                last = out[-1] if out else -1
                row = pairs[last]
            token = shorter[token]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space mark that encoding puts in front goes, byte runs that aren't UTF-8 become U+FFFD each."""
        out, run, first = [], bytearray(), True
        for i in ids:
            if i in self.raw:
                run += self.shown[i]
                continue
            if run:
                out.append(broken(bytes(run)))
                run = bytearray()
            s = self.shown[i].decode()
            out.append(s[1:] if first and not out and s[:1] == " " else s)
            first = first and s == ""
        if run:
            out.append(broken(bytes(run)))
        return "".join(out)

    def chunk(self, text: str) -> tuple[str, str]:
        """The ids of a chunk, joined by commas, and what they decode to within a text."""
        known = self.older.get(text)
        if known is None:
            joined = ",".join([self.joined[t] for t in self.tokens(text.replace(" ", MARK))])
            known = joined, broken(b"".join([self.shown[int(i)] for i in joined.split(",")]))
        if len(text) <= 64:
            if len(self.chunks) >= MOST_CHUNKS:
                self.chunks, self.older = {}, self.chunks
            self.chunks[text] = known
        return known

    def parts(self, text: str) -> list[tuple[str, str]]:
        """(ids joined by commas, what they decode to) of each chunk of a text. Characters never run over a chunk's end, so neither do runs of byte pieces."""
        if not text:
            return []
        known, chunk = self.chunks.get, self.chunk
        return [known(c) or chunk(c) for c in self.cut(" " + text.replace(MARK, " "))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(",")]

    def digests(self, text: str) -> tuple[int, str, str]:
        """(number of ids, SHA-256 of the ids joined by commas, SHA-256 of the decoded text)."""
        parts = self.parts(text)
        ids, decoded = ",".join([p[0] for p in parts]).encode(), "".join([p[1] for p in parts])[1:]
        return ids.count(b",") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def broken(data: bytes) -> str:
    """UTF-8 with each byte that fits no character as U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            for size in (1, 2, 3, 4):
                try:
                    out.append(data[at : at + size].decode())
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)


_encoders: dict[str, Encoder] = {}


def over_texts(docs: DataFrame, vocabulary: dict, text: str, kept: tuple[str, ...], added: str, row: Callable[[Encoder, str], tuple]) -> DataFrame:
    """The kept columns of docs, and the added ones (a schema) as row(encoder, text) gives them. No shuffle. Kept columns can't have names of added ones."""
    new = T.StructType.fromDDL(added)
    if set(kept) & set(new.names):
        raise ValueError(f"columns {sorted(set(kept) & set(new.names))} are results here")
    schema = T.StructType([*(docs.schema[k] for k in kept), *new])
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # 32,000 pieces of at most 16 characters: about 1 MB
    key = hashlib.sha256(repr(sorted(vocabulary["scores"].items())).encode()).hexdigest()
    into = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _encoders:
            _encoders.clear()
            _encoders[key] = Encoder(shared.value)
        encoder = _encoders[key]
        for batch in batches:
            column = batch.column(len(kept))
            for at in range(0, batch.num_rows, 1000):
                rows = [row(encoder, t or "") for t in column.slice(at, 1000).to_pylist()]
                columns = [batch.column(k).slice(at, 1000) for k in range(len(kept))]
                columns += [pa.array([r[k] for r in rows], into.field(len(kept) + k).type) for k in range(len(into) - len(kept))]
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema([pa.field(f.name, c.type) for f, c in zip(into, columns, strict=True)]))

    return docs.select(*kept, docs[text].alias("_text")).mapInArrow(run, schema)


def encode(docs: DataFrame, vocabulary: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids array<int> and decoded string of each text."""

    def row(encoder: Encoder, value: str) -> tuple:
        ids = encoder.encode(value)
        return ids, encoder.decode(ids)

    return over_texts(docs, vocabulary, text, keep, "ids array<int>, decoded string", row)


def encode_digests(docs: DataFrame, vocabulary: dict, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """As encode(), with the number and the digests of ids and decoded text instead of both, so that they needn't leave the worker."""
    return over_texts(docs, vocabulary, text, keep, "n_tokens long, ids_sha256 string, decoded_sha256 string", Encoder.digests)
