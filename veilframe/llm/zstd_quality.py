"""A quality classifier by compression.

One zstandard dictionary is built from good and one from bad labelled text. A
text is cut into pieces of `PIECE` bytes, all of them are compressed with
either dictionary, and the normalised difference of the summed sizes says which
kind of text it repeats. A logistic curve, fitted on labelled texts that built
neither dictionary and weighted by the share of the labels, turns it into a
probability.

Fit: at most `rows` labelled rows a class, those of the least hash, with their
whole texts. The model is those two dictionaries and some dozen numbers, a bounded
broadcast. Scoring reads whole texts in one map without a shuffle.

Defined results: null and empty texts have difference 0 and the score of that;
with labels of one class only, or none, the score is the labels' share of good
or 0.5; labels that are null or contradict each other count as they stand, rows
without a text in the sample are left out; rows of documents are independent;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import arrow_map, col, field, text_bytes

PIECE = 256
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
ROWS = 1_500
THRESHOLD = 0.3
#: The share of the logistic curve in the score.
TILT = 0.03


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float
    fallback: float
    steps: tuple[tuple[float, ...], tuple[float, ...]] = ((), ())
    piece: int = PIECE
    level: int = LEVEL


class Sizes:
    """The normalised difference of compressed sizes."""

    def __init__(self, model: Model):
        self.piece = model.piece
        self.ends = [self._compressor(d, model.level) for d in (model.good, model.bad)] if model.good and model.bad else []

    @staticmethod
    def _compressor(data: bytes, level: int):
        d = zstandard.ZstdCompressionDict(data)
        d.precompute_compress(level=level)
        return zstandard.ZstdCompressor(dict_data=d, level=level, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def difference(self, text: bytes) -> float:
        """Over 0 if the good dictionary saves more."""
        if not self.ends or not text:
            return 0.0
        good, bad, n = *self.ends, self.piece
        pieces = [text[i : i + n] for i in range(0, len(text), n)]
        a, b = sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)
        return (b - a) / (len(text) * max(a, b)) ** 0.5


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve of greatest likelihood, by Newton steps with a slight pull to 0."""
    scale = max(float(np.abs(x).max()), 1e-9)
    z = np.stack([x / scale, np.ones(len(x))], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (y - p)) - 1e-3 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w = w + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return float(w[0] / scale), float(w[1])


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Centres and means of the steps of the best rising fit: neighbours that fall are pooled."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for a, b, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([a * w, b * w, w])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top, strict=True)]
    return tuple(p[0] / p[2] for p in pools), tuple(p[1] / p[2] for p in pools)


def probability(model: Model, x: np.ndarray) -> np.ndarray:
    if not model.good:
        return np.full(len(x), model.fallback)
    slope = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -500, 500)))
    return (1 - TILT) * np.interp(x, *model.steps) + TILT * slope


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_id: str, label_col: str, rows: int, folds: int, fold: int):
    """The bounded sample as (label, bytes), in hash order, and the share of label 1 among all labels of the folds learned from."""
    known = labels.select(col(label_id).alias("lid"), col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("lid").isNotNull() & ~held_out(F.col("lid"), folds, fold))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        some = known.where(F.col("y") == y).withColumn("h", F.xxhash64("lid")).orderBy("h", "lid").limit(rows)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where(F.col("text") != "")
    # One text of each id, the least, so that repeated ids bring no more rows than were chosen.
    chosen = chosen.distinct()
    rows_ = texts.join(F.broadcast(chosen), F.col("id") == F.col("lid")).groupBy("y", "h", "lid").agg(F.min("text").alias("text")).select("y", "h", "text").collect()
    rows_.sort(key=lambda r: (r["h"], r["text"]))
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.5
    return [(r["y"], r["text"].encode()) for r in rows_], share


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id: str = "doc_id",
    label_col: str = "quality",
    folds: int = 5,
    fold: int = 0,
    rows: int = ROWS,
    dictionary_bytes: int = DICTIONARY_BYTES,
) -> Model:
    pairs, share = sample(docs, labels, id_col, text_col, label_id, label_col, rows, folds, fold)
    own: dict[int, list[bytes]] = {0: [], 1: []}
    rest: list[tuple[int, bytes]] = []
    for i, (y, text) in enumerate(pairs):
        own[y].append(text) if i % 3 else rest.append((y, text))
    books = []
    for y in (1, 0):
        pieces = [t[i : i + PIECE] for t in own[y] for i in range(0, len(t), PIECE) if len(t) - i >= 8]
        try:
            books.append(zstandard.train_dictionary(dictionary_bytes, pieces, level=LEVEL).as_bytes())
        except zstandard.ZstdError:  # too few pieces to train on: they are the dictionary
            books.append(b"".join(pieces)[-dictionary_bytes:])
    model = Model(books[0], books[1], 0.0, 0.0, share)
    y = np.array([r[0] for r in rest], np.float64)
    if len(set(y.tolist())) < 2 or not all(books):
        return Model(b"", b"", 0.0, 0.0, share)
    sizes = Sizes(model)
    x = np.array([sizes.difference(t) for _, t in rest])
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    model.slope, model.offset = logistic(x, y, weight)
    model.steps = isotonic(x, y, weight)
    return model


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, difference, score, predicted) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel():
        m = shared.value
        sizes = Sizes(m)

        def work(part):
            x = np.array([sizes.difference(t) for t in text_bytes(part.column(text_col))])
            p = probability(m, x)
            return [pa.array(x), pa.array(p), pa.array((p >= threshold).astype(np.int32))]

        return work

    return arrow_map(docs, [id_col], text_col, kernel, [field("difference", T.DoubleType()), field("score", T.DoubleType()), field("predicted", T.IntegerType())])


def keep_good(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of `docs`, all columns, that are not rejected: the score travels with the row."""
    names = docs.columns
    row = docs.select(F.struct(*[col(c) for c in names]).alias("row"), col(text_col).alias("text"))
    return score(row, model, id_col="row", text_col="text", threshold=threshold).where("predicted = 1").select(*[F.col("row").getField(c).alias(c) for c in names])
