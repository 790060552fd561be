"""Language identification by a byte convolutional network in numpy.

Text is cut into windows of `LENGTH` bytes. Bytes are embedded, filters of
several widths run over them, each filter's greatest response in the window is
kept, and a softmax layer names the language. A document's score for a language
is the mean log probability over all its windows, weighted by their bytes and
normed again, so whole texts count.

Training is plain numpy on the driver, on a sample of whole labelled texts: about
`rows` in all, dealt evenly over the languages, those of the least hash of each;
of more than `rows` languages the commonest are learned. The model is some
thousand numbers. Prediction is one map without a shuffle; filters are
applied as tables of byte responses, in batches of windows.

Defined results: a text that is null or has no letter is `und` with score 1;
with no labelled text at all every text is `und`; one known language is given
to every text with letters; rows are independent, so repeated or null ids give
a row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field as attribute

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import arrow_map, col, field

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 12
EMBEDDING = 8
ROWS = 1_000
EPOCHS = 8
BATCH = 2_048


def cut(text: bytes, length: int = LENGTH) -> np.ndarray:
    """All windows of a text, a row each, the last filled up with zeros."""
    n = max(1, -(-len(text) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, length)


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray
    filters: dict[int, np.ndarray]  # width: (width, embedding, filters)
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray
    tables: dict = attribute(default_factory=dict)

    @classmethod
    def random(cls, languages: list[str], seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        n = len(WIDTHS) * FILTERS
        make = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
        return cls(
            languages,
            make(256, EMBEDDING, scale=0.5),
            {w: make(w, EMBEDDING, FILTERS, scale=(w * EMBEDDING) ** -0.5) for w in WIDTHS},
            {w: np.zeros(FILTERS, np.float32) for w in WIDTHS},
            make(n, len(languages), scale=n**-0.5),
            np.zeros(len(languages), np.float32),
        )

    def responses(self, x: np.ndarray, width: int) -> np.ndarray:
        """(windows, places, filters): each offset adds its table's row for the byte there."""
        places = x.shape[1] - width + 1
        tables = self.tables.get(width)
        if tables is None:
            tables = [np.ascontiguousarray(self.embed @ self.filters[width][j]) for j in range(width)]
        out = tables[0][x[:, :places]]
        for j in range(1, width):
            out += tables[j][x[:, j : j + places]]
        return out

    def pooled(self, x: np.ndarray, where: dict | None = None) -> np.ndarray:
        best = []
        for w in WIDTHS:
            r = self.responses(x, w)
            if where is not None:
                where[w] = r.argmax(axis=1)
            best.append(np.maximum(r.max(axis=1) + self.bias[w], 0))
        return np.concatenate(best, axis=1)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.pooled(x) @ self.dense + self.dense_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def fix(self) -> Network:
        self.tables = {w: [np.ascontiguousarray(self.embed @ self.filters[w][j]) for j in range(w)] for w in WIDTHS}
        return self

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The language number of each text and its probability."""
        rows = [cut(t) for t in texts]
        counts = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.concatenate(rows)
        logs = np.concatenate([self.log_probabilities(flat[i : i + BATCH]) for i in range(0, len(flat), BATCH)])
        weight = (flat != 0).sum(axis=1) + 1e-6
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(logs * weight[:, None], starts, axis=0) / np.add.reduceat(weight, starts)[:, None]
        p = np.exp(mean - mean.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return p.argmax(axis=1), p.max(axis=1)


def train(texts: list[bytes], languages: list[str], *, epochs: int = EPOCHS, seed: int = 1, rate: float = 0.01, batch: int = 256) -> Network:
    """Adam on the cross entropy of windows, each language weighted alike."""
    names = sorted(set(languages))
    net = Network.random(names, seed)
    if len(names) < 2:
        return net.fix()
    number = {n: i for i, n in enumerate(names)}
    rows = [cut(t) for t in texts]
    x = np.concatenate(rows)
    y = np.repeat([number[n] for n in languages], [len(r) for r in rows])
    weight = (1 / np.bincount(y))[y]
    weight = (weight / weight.mean()).astype(np.float32)
    rng = np.random.default_rng(seed)
    values = {"embed": net.embed, "dense": net.dense, "dense_bias": net.dense_bias} | {("f", w): net.filters[w] for w in WIDTHS} | {("b", w): net.bias[w] for w in WIDTHS}
    first, second, t = {k: np.zeros_like(v) for k, v in values.items()}, {k: np.zeros_like(v) for k, v in values.items()}, 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            xb, where = x[pick], {}
            h = net.pooled(xb, where)
            z = h @ net.dense + net.dense_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= weight[pick][:, None] / len(pick)
            grads = {"dense": h.T @ p, "dense_bias": p.sum(axis=0), "embed": np.zeros_like(net.embed)}
            back = (p @ net.dense.T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                g = back[:, i * FILTERS : (i + 1) * FILTERS].astype(np.float32)
                grads["b", w] = g.sum(axis=0)
                gf = np.zeros_like(net.filters[w])
                for j in range(w):
                    byte = np.take_along_axis(xb, where[w] + j, axis=1)
                    e = net.embed[byte]  # (rows, filters, embedding)
                    gf[j] = np.einsum("nfe,nf->ef", e, g)
                    np.add.at(grads["embed"], byte, g[:, :, None] * net.filters[w][j].T[None])
                grads["f", w] = gf
            t += 1
            for k, v in values.items():
                first[k] = 0.9 * first[k] + 0.1 * grads[k]
                second[k] = 0.999 * second[k] + 0.001 * grads[k] ** 2
                v -= (rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net.fix()


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % folds == fold, F.lit(False))


def fit(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    folds: int = 4,
    fold: int = 2,
    rows: int = ROWS,
) -> Network | None:
    """The network learned outside the fold; None if nothing is labelled."""
    known = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).cast("string").alias("lang"))
    known = known.where(F.col("lang").isNotNull() & ~held_out(F.col("id"), folds, fold))
    largest = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(rows)
    counts = {r["lang"]: r["n"] for r in largest.collect()}
    if not counts:
        return None
    each = max(1, rows // len(counts))
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(min(1.0, 2 * each / n)))])
    h = F.xxhash64("id", F.lit("language"))
    some = known.where((F.pmod(h, F.lit(1_000_000)) / 1_000_000 < F.coalesce(share[F.col("lang")], F.lit(0.0))) & (F.col("text") != ""))
    # About twice as many as are taken, so that no language falls short by chance; the limit only guards the driver.
    found = some.select("lang", h.alias("h"), "text").orderBy("h", "text").limit(4 * rows).collect()
    taken: dict[str, int] = {}
    chosen = []
    for r in found:
        if taken.get(r["lang"], 0) < each and any(map(str.isalpha, r["text"])):
            taken[r["lang"]] = taken.get(r["lang"], 0) + 1
            chosen.append(r)
    return train([r["text"].encode() for r in chosen], [r["lang"] for r in chosen]) if chosen else None


def identify(docs: DataFrame, network: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def kernel():
        net = shared.value

        def work(part):
            texts = [t or "" for t in part.column(text_col).to_pylist()]
            lang, p = ["und"] * len(texts), np.ones(len(texts))
            lettered = [i for i, t in enumerate(texts) if any(map(str.isalpha, t))] if net else []
            if lettered:
                best, sure = net.predict([texts[i].encode() for i in lettered])
                for i, b in zip(lettered, best.tolist(), strict=True):
                    lang[i] = net.languages[b]
                p[lettered] = sure
            return [pa.array(lang, pa.string()), pa.array(p)]

        return work

    return arrow_map(docs, [id_col], text_col, kernel, [field("lang_pred", T.StringType()), field("score", T.DoubleType())], limit=2 << 20)
