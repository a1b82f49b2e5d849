"""Operator 9: toxicity by a support vector machine with the subsequence string kernel, on Nyström landmarks.

The kernel of two strings sums, over all three-letter subsequences that both have, decay ** (span in one + span in the other), and is
normalised by its values on each string with itself. Gaps and inserted letters only weaken a match ("idxiot"); letters set apart by spaces
are joined first. Case, accents, signs between letters and usual digit-for-letter swaps are folded. Subsequences that span more than SPAN letters
weigh less than decay ** SPAN, 0.2 %, and are left out; units longer than PIECE are taken in overlapping pieces, of which the most alike counts.

Training reads a bounded number of labelled documents (`most_rows` toxic and three times as many clean ones), whole; the driver gets the different
units of each. A toxic document has toxic words, but which ones isn't labelled. Landmarks are strings inside units (words, joined letters) that more toxic
documents hold than clean ones and more than chance allows, picked one by one until the units are explained, and frequent other units; where there are no such strings,
the units themselves that more toxic documents have. The machine is fitted on Nyström features (kernel values with the landmarks times K ** -1/2): for
toxicity speak all units of those strings that more toxic documents have than clean ones (RATIOS times as many: both a strict and a loose
machine are made, and the one whose calibration fits the labels better stays), against it a sample of `negatives` others; then twice again with the
units that scored highest in each labelled document (as in mi-SVM), so each has its say. A document's value is made of its highest units: the
highest, and the means of three and of five, mapped to 0..1 by logistic calibration over all training documents, so several words that are doubtful alone count together.

As the kernel is a sum over subsequences, landmarks and weights collapse into one table with a weight per three letters (64 ** 3 floats,
1 MB, broadcast); a unit then costs a walk over its own subsequences, and each worker remembers a bounded number of units.

Defined results: null scores as the empty text, which has the lowest value; with labels of one class or none every text has the smoothed share
of label 1; copies have equal scores; extra columns are left alone.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.learning import held_out, logistic, training_texts

DECAY, SPAN, PIECE = 0.6, 12, 32
#: Units that a worker remembers, twice over.
MOST_UNITS = 400_000
SPACED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")
SENTENCE = re.compile(r"[.!?\n]+\s+|\n+")
LOWEST = -2.0
#: How many times as many toxic documents as clean ones have what speaks for toxicity; the machine whose calibration fits the labels better stays.
RATIOS = (20, 1)
#: A document is judged by the means of so many of its highest values.
TOPS = (1, 3, 5)
#: Digits and signs that stand for letters.
SWAPS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}


def _folded() -> dict[int, str | None]:
    """Latin letters without their accents; what is no letter goes."""
    out: dict[int, str | None] = {}
    for c in range(0x3000):
        x = SWAPS.get(chr(c)) or unicodedata.normalize("NFKD", chr(c).lower())[:1]
        if "a" <= x <= "z":
            out[c] = x
        elif not chr(c).isalnum():
            out[c] = None
    return out


FOLDED = _folded()
_TRIPLES = {}


def triples(length: int) -> list[tuple[int, int, int, float]]:
    if length not in _TRIPLES:
        _TRIPLES[length] = [(i, j, k, DECAY ** (k - i + 1)) for i in range(length) for k in range(i + 2, min(length, i + SPAN)) for j in range(i + 1, k)]
    return _TRIPLES[length]


def coded(units: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the unit, codes (n, length)) of folded units by length: 1-26 for Latin letters, 27-63 for all others; long ones come in pieces."""
    sizes = np.array([len(u) for u in units])
    points = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where((points >= 97) & (points <= 122), points - 96, 27 + points % 37)
    begin = np.cumsum(sizes) - sizes
    owner = np.arange(len(units))
    long = sizes > PIECE
    if long.any():
        at = [np.arange(0, n - PIECE // 2, PIECE // 2) for n in sizes[long].tolist()]
        extra = np.concatenate(at)
        whole = np.repeat(owner[long], [len(x) for x in at])
        owner = np.concatenate((owner[~long], whole))
        begin, sizes = np.concatenate((begin[~long], begin[whole] + extra)), np.concatenate((sizes[~long], np.minimum(PIECE, sizes[whole] - extra)))
    for n in np.unique(sizes[sizes >= 3]).tolist():
        own = np.flatnonzero(sizes == n)
        for a in range(0, len(own), 20_000):
            part = own[a : a + 20_000]
            yield owner[part], codes[begin[part][:, None] + np.arange(n)]


def self_kernel(x: np.ndarray) -> np.ndarray:
    """The unnormalised kernel of each row with itself: equal subsequences are summed after a sort."""
    n, length = x.shape
    rows = triples(length)
    keys = np.empty((n, len(rows)), np.int64)
    for c, (i, j, k, _) in enumerate(rows):
        keys[:, c] = (x[:, i] << 12) + (x[:, j] << 6) + x[:, k]
    values = np.array([r[3] for r in rows])
    order = np.argsort(keys, axis=1)
    keys, values = np.take_along_axis(keys, order, 1), values[order]
    new = np.ones(keys.shape, bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    sums = np.add.reduceat(values.ravel(), np.flatnonzero(new.ravel()))
    return np.add.reduceat(sums * sums, np.searchsorted(np.flatnonzero(new.ravel()), np.arange(n) * len(rows)))


def weighed(x: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum over the subsequences of each row of decay ** span * table[subsequence]; table may have columns."""
    total = np.zeros((len(x), *table.shape[1:]))
    length = x.shape[1]
    for i in range(length):
        for j in range(i + 1, min(length, i + SPAN - 1)):
            pair = (x[:, i] << 12) + (x[:, j] << 6)
            for k in range(j + 1, min(length, i + SPAN)):
                total += DECAY ** (k - i + 1) * table[pair + x[:, k]]
    return total


class Machine:
    """A trained model: values(units) and scores(texts)."""

    def __init__(self, rows: list[tuple[int, str, int]], landmarks: int, negatives: int = 4000, seed: int = 5):
        n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
        self.prior = (n[1] + 1) / (n[0] + n[1] + 2)
        self.table, self.loss = None, float("inf")
        if min(n) == 0:
            return
        known: dict[str, str] = {}  # one string for equal units of all documents
        bags = [[known.setdefault(u, u) for u in bag_of(t)] for _, t, _ in rows]
        del known
        clean = Counter(u for b, (_, _, y) in zip(bags, rows, strict=True) if not y for u in b)
        toxic = Counter(u for b, (_, _, y) in zip(bags, rows, strict=True) if y for u in b)
        y = np.array([y for _, _, y in rows])
        best = None
        for ratio in RATIOS:
            if self.learn(bags, y, clean, toxic, ratio, landmarks, negatives, seed) and (best is None or self.loss < best[0]):
                best = self.loss, self.table, self.bias, self.calibration
        self.table = None
        if best is not None:
            _, self.table, self.bias, self.calibration = best

    def learn(self, bags: list[list[str]], y: np.ndarray, clean: Counter, toxic: Counter, ratio: float, landmarks: int, negatives: int, seed: int) -> bool:
        """Fits table, bias and calibration and sets loss; False where nothing speaks for toxicity."""
        speaks = {u for u, t in toxic.items() if t > ratio * clean[u]}
        n = int((y == 0).sum()), int((y == 1).sum())
        insults = telling_strings([b for b, k in zip(bags, y, strict=True) if k], clean, n, landmarks // 2, ratio) or [u for u, _ in toxic.most_common() if u in speaks][: landmarks // 2]
        if not insults:
            return False
        holds = re.compile("|".join(map(re.escape, insults))).search
        often = [u for u, _ in clean.most_common(landmarks // 2) if u not in speaks]
        chosen = list(dict.fromkeys(insults + often))
        columns = landmark_table(chosen)
        names = sorted(set().union(*bags))
        first = list(dict.fromkeys(insults + [u for u in names if u in speaks and holds(u)]))
        positive, rng = first, np.random.default_rng(seed)
        negative = list(dict.fromkeys(often + [names[k] for k in rng.permutation(len(names)) if names[k] in clean and names[k] not in speaks][:negatives]))
        for _ in range(3):
            self.fit(positive + negative, np.repeat([1.0, -1.0], [len(positive), len(negative)]), chosen, columns)
            values = dict(zip(names, self.values(names), strict=True))
            best = [max(b, key=values.__getitem__) if b else None for b in bags]
            # The labels choose again: of each labelled document the unit that speaks most for toxicity stands for it.
            negative = list(dict.fromkeys([u for u, k in zip(best, y, strict=True) if u is not None and not k and u not in speaks] + negative))
            witness = {u for u, k in zip(best, y, strict=True) if u is not None and k and values[u] > 0}
            positive = list(dict.fromkeys(first + sorted(witness & speaks)))
        tops = np.array([highest([values[u] for u in b]) for b in bags])
        self.calibration = logistic(tops, y)
        self.loss = float(np.log1p(np.exp(np.clip(-(2 * y - 1) * (tops @ self.calibration), -30, 30))).mean())
        return bool(self.calibration[1:].sum() > 0)

    def fit(self, units: list[str], y: np.ndarray, chosen: list[str], columns: np.ndarray) -> None:
        """A squared-hinge machine on the Nyström features of the units, folded into a weight per subsequence."""
        gram = kernel_values(chosen, columns)
        gram = (gram + gram.T) / 2
        lam, vec = np.linalg.eigh(gram)
        root = vec / np.sqrt(np.maximum(lam, 1e-3)) @ vec.T
        x = np.column_stack([kernel_values(units, columns) @ root, np.ones(len(units))])
        weight = np.where(y > 0, (y < 0).sum() / max(1, (y > 0).sum()), 1.0) ** 0.5
        w, ridge = np.zeros(x.shape[1]), np.eye(x.shape[1]) * 0.1
        ridge[-1, -1] = 1e-6
        for _ in range(40):
            near = y * (x @ w) < 1
            step = np.linalg.solve((x[near] * weight[near, None]).T @ x[near] + ridge, x[near].T @ (weight[near] * (x[near] @ w - y[near])) + ridge @ w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        weights = root @ w[:-1]
        # By parts, as a product of single with double precision copies what it reads.
        self.table = np.concatenate([part @ weights for part in np.array_split(columns, 64)])
        self.bias = float(w[-1])

    def values(self, units: list[str]) -> np.ndarray:
        """The machine's value of each unit; of the highest piece for long ones; LOWEST without letters."""
        out = np.full(len(units), LOWEST)
        if units:
            for owner, x in coded(units):
                np.maximum.at(out, owner, weighed(x, self.table) / np.sqrt(self_kernel(x)) + self.bias)
        return out

    def scores(self, texts, seen: list[dict[str, float]]) -> np.ndarray:
        """Scores of texts; seen: two tables of known units, newer first."""
        if self.table is None:
            return np.full(len(texts), self.prior)
        tops = np.zeros((len(texts), 1 + len(TOPS)))
        for a in range(0, len(texts), 200):
            bags = [set(units_of(t)) for t in texts[a : a + 200]]
            missing = set().union(*bags).difference(seen[0])
            known = {u: seen[1][u] for u in missing if u in seen[1]}
            new = list(missing.difference(known))
            known |= zip(new, self.values([folded(u) for u in new]).tolist(), strict=True)
            if len(seen[0]) > MOST_UNITS:
                seen[:] = {}, seen[0]
                known |= {u: seen[1][u] for b in bags for u in b if u not in known}
            seen[0].update(known)
            value = seen[0].__getitem__
            for k, b in enumerate(bags):
                # Units that are folded alike are one.
                tops[a + k] = highest({folded(u): value(u) for u in nlargest(4 * TOPS[-1], b, key=value)}.values())
        return 1 / (1 + np.exp(-np.clip(tops @ self.calibration, -30, 30)))


def highest(values: Iterable[float]) -> list[float]:
    """1, and the means of the highest values of a document, TOPS of them; a document that has fewer has LOWEST for the others."""
    top = [max(v, LOWEST) for v in nlargest(TOPS[-1], values)]
    top += [LOWEST] * (TOPS[-1] - len(top))
    return [1.0, *(sum(top[:n]) / n for n in TOPS)]


def bag_of(text: str) -> list[str]:
    """The different folded units of a text's sentences, sorted. The bag of its members, one a line, is the same."""
    return sorted({f for s in SENTENCE.split(text) for u in units_of(s) if len(f := folded(u)) >= 3})


def folded(unit: str) -> str:
    return unit.translate(FOLDED)


def telling_strings(toxic: list[list[str]], clean: Counter, n: tuple[int, int], most: int, ratio: float) -> list[str]:
    """Strings of 4 to 8 letters inside units of toxic documents, in over `ratio` times as many of their units as of clean ones and more often than chance allows, none inside a unit that an earlier one explains.

    Documents of equal units count once.
    """
    distinct = {tuple(b): b for b in toxic if b}
    times = Counter(u for b in distinct.values() for u in b)
    held: Counter = Counter()
    for u, t in times.items():
        for s in inner(u):
            held[s] += t
    held = Counter({s: t for s, t in held.items() if t > 2})
    against: Counter = Counter()
    for u, c in clean.items():
        for s in inner(u):
            if s in held:
                against[s] += c
    share, least = len(distinct) / (len(distinct) + n[0]), np.log(len(held) + 2)

    def gain(s: str) -> float:
        t, c = held[s], against[s]
        return t * np.log(t / (t + c) / share) + (c * np.log(c / (t + c) / (1 - share)) if c else 0.0) if t > ratio * c else 0.0

    inside: dict[str, list[str]] = {}
    for u in times:
        for s in inner(u):
            if s in held:
                inside.setdefault(s, []).append(u)
    found: list[str] = []
    live = {s for s in held if gain(s) > least}
    explained: set[str] = set()
    while live and len(found) < most:
        best = max(live, key=lambda s: (gain(s), len(s), s))
        found.append(best)
        for u in inside[best]:
            if u not in explained:
                explained.add(u)
                for s in inner(u):
                    if s in held:
                        held[s] -= times[u]
        live = {s for s in live if gain(s) > least}
    return found


def inner(unit: str) -> set[str]:
    return {unit[i : i + k] for k in range(4, 9) for i in range(len(unit) - k + 1)}


def units_of(text: str) -> list[str]:
    """Lower-cased words, and letters set apart by spaces as one word each."""
    text = text.lower()
    out = text.split()
    if SPACED.search(text):
        out += ["".join(m.group().split()) for m in SPACED.finditer(text)]
    return out


def landmark_table(chosen: list[str]) -> np.ndarray:
    """(64 ** 3, landmarks): the normalised weight of each subsequence in each landmark."""
    out = np.zeros((64**3, len(chosen)), np.float32)
    for owner, x in coded(chosen):
        norm = np.sqrt(self_kernel(x))
        for i, j, k, w in triples(x.shape[1]):
            np.add.at(out, ((x[:, i] << 12) + (x[:, j] << 6) + x[:, k], owner), w / norm)
    return out


def kernel_values(units: list[str], columns: np.ndarray) -> np.ndarray:
    """Normalised kernel values (units, landmarks); of long units the highest of any piece."""
    out = np.zeros((len(units), columns.shape[1]))
    for owner, x in coded(units):
        for a in range(0, len(x), 500):
            part = x[a : a + 500]
            np.maximum.at(out, owner[a : a + 500], weighed(part, columns) / np.sqrt(self_kernel(part))[:, None])
    return out


_seen: dict[int, list[dict[str, float]]] = {}


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, most_rows: int = 1500, landmarks: int = 256, negatives: int = 4000, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("held_out", "score", "predicted")
) -> DataFrame:
    """The kept columns, and held_out, score and predicted of each document under the given names, which no kept column may have."""
    if set(keep) & set(names):
        raise ValueError(f"columns {sorted(set(keep) & set(names))} are results here")

    def bag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(["\n".join(bag_of(t)) for t in texts], dtype=object)

    rows = training_texts(docs, labels, label, (3 * most_rows, most_rows)).select("doc_id", F.pandas_udf(bag, "string")("text").alias("bag"), "y")
    machine = Machine(sorted(tuple(r) for r in rows.collect()), landmarks, negatives)  # 4 * most_rows bags at most
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    key = hash(machine.table.tobytes()) if machine.table is not None else 0

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if key not in _seen:
            _seen.clear()
            _seen[key] = [{}, {}]
        for texts in batches:
            yield pd.Series(shared.value.scores(texts.fillna("").tolist(), _seen[key]))

    value = F.pandas_udf(score, "double")(F.col("text")).alias(names[1])
    scored = docs.select(*keep, held_out().alias(names[0]), value)
    return scored.select("*", (F.col(names[1]) >= threshold).cast("int").alias(names[2]))
