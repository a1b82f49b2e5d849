"""Operator 2: quality by compression with dictionaries of good and bad text.

Two zstandard dictionaries are trained on labelled texts, one of each class. A text is compressed with both in blocks of `block` bytes, so
that no long text becomes its own dictionary; the difference of the two sizes over the text's bytes goes through a monotone (isotonic) calibration that is
fitted on labelled texts kept out of the dictionaries. Nothing else is an input of the score.

The fit sees a bounded sample: at most `most_rows` rows a class (a documented parameter), and whole texts of them. The texts of one half are the training
material of the dictionaries, all of their blocks; the other half, which calibrates, is compressed whole in Spark, and only its sizes come to the driver. Below some
kilobytes of text a class there is nothing to train on, and a class's texts are the dictionary themselves (its last 112 KB). Scoring takes whole texts, in one pass without a shuffle; what is broadcast are two dictionaries of at most 112 KB.

Defined results: null scores as the empty text, which has no difference; with labels of one class or none, every text has the smoothed share of
label 1; copies have equal scores; extra columns are left alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sweepframe.llm.common import written
from sweepframe.llm.learning import held_out, training_texts

DICTIONARY = 112 << 10
#: Bytes of a zstandard frame that hold no content: magic number and descriptors.
FRAME = 4


class Compressors:
    """Sizes of texts under the dictionaries of bad and of good text."""

    def __init__(self, dictionaries: list[bytes], block: int, level: int):
        self.dictionaries, self.block, self.level = dictionaries, block, level

    def differences(self, texts) -> Iterator[float]:
        """The normalised size difference of each text: bytes that the good dictionary saves over the bad one, per byte of text."""
        import zstandard

        made = []
        for data in self.dictionaries:
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=self.level)
            made.append(zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress)
        bad, good = made
        for t in texts:
            data, x, y = t.encode(), 0, 0
            for a in range(0, len(data), self.block):
                piece = data[a : a + self.block]
                x += len(bad(piece)) - FRAME
                y += len(good(piece)) - FRAME
            yield (x - y) / max(1, len(data))


def trained(pieces: list[bytes]) -> bytes:
    """A trained dictionary, or the pieces themselves where there are too few to train on."""
    import zstandard

    total = sum(map(len, pieces))
    try:
        return zstandard.train_dictionary(min(DICTIONARY, max(2048, total // 8)), pieces).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY:]


def blocks_of(text: str, block: int) -> list[bytes]:
    data = text.encode()
    return [data[k : k + block] for k in range(0, len(data), block)]


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(differences, shares of label 1) of the isotonic regression of y on x, to be interpolated: neighbours out of order are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    x, y, n = np.array(pools).T
    return x / n, (y + 0.5) / (n + 1)


def fitted(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, block: int, level: int) -> tuple[float, Compressors | None, tuple | None]:
    """(share of label 1, compressors, calibration); the latter two are None where labels of one class are all there is."""
    rows = written(training_texts(docs, labels, label, (most_rows, most_rows)).withColumn("half", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit("/dictionary"))) % 2), "quality-rows")
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    prior = (n.get(1, 0) + 1) / (sum(n.values()) + 2)

    def blocks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([blocks_of(t, block) for t in texts], dtype=object)

    # Half of 2 * most_rows texts.
    pieces: dict[int, list[bytes]] = {0: [], 1: []}
    for r in rows.where("half = 1").select("doc_id", "y", F.pandas_udf(blocks, "array<binary>")("text").alias("blocks")).orderBy("doc_id", "y").collect():
        pieces[r["y"]] += map(bytes, r["blocks"])
    if not all(pieces.values()):
        return prior, None, None
    compressors = Compressors([trained(pieces[0]), trained(pieces[1])], block, level)
    rest = rows.where("half = 0").select("doc_id", "y", F.pandas_udf(compressed(compressors), "double")("text").alias("d")).orderBy("doc_id", "y").collect()
    if len({r["y"] for r in rest}) < 2:
        return prior, None, None
    return prior, compressors, calibration(np.array([r["d"] for r in rest]), np.array([r["y"] for r in rest]))


def compressed(compressors: Compressors) -> Callable[[Iterator[pd.Series]], Iterator[pd.Series]]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(compressors.differences(texts.fillna(""))), dtype=float)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, most_rows: int = 3000, block: int = 512, level: int = 3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, label, most_rows, block, level))

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        prior, compressors, curve = shared.value
        for texts in batches:
            if compressors is None:
                yield pd.Series(np.full(len(texts), prior))
            else:
                yield pd.Series(np.interp(list(compressors.differences(texts.fillna(""))), *curve))

    scored = docs.select("doc_id", held_out().alias("held_out"), F.pandas_udf(score, "double")(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
