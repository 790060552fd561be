"""A sequence tagger for persons and places, trained on labelled lines.

An averaged perceptron over words: a tag's score is the sum of weights of the
word's features (its letters, shape and ending, and those of its neighbours) and
of the tag before it, and a line gets the sequence of highest score by Viterbi.
Training is on a bounded number of lines on the driver; the weights, a table of
fixed size, are broadcast, and lines are tagged in Arrow batches.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.cluster import ship

#: Outside, and the first and further words of each entity.
ENTITIES = ("PERSON", "LOCATION")
TAGS = ("O", *(f"{p}-{e}" for e in ENTITIES for p in "BI"))
#: Features share this many weights a tag.
SLOTS = 1 << 16
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*|[^\w\s]|_")
FOUND = "array<struct<entity:string,match:string,score:double,start:int>>"

#: Whether a tag may follow another: a further word needs a word of its entity before it.
ALLOWED = np.array([[not b.startswith("I-") or (a[2:] == b[2:] and a != "O") for b in TAGS] for a in TAGS])
OPENS = np.array([not t.startswith("I-") for t in TAGS])


def words_of(text: str) -> list[tuple[str, int]]:
    """Words and marks with where they start."""
    return [(m[0], m.start()) for m in WORD.finditer(text)]


def shape(word: str) -> str:
    kinds = "".join("X" if c.isupper() else "x" if c.islower() else "9" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1\1", kinds)


def slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SLOTS


def features(words: list[str]) -> list[list[int]]:
    """The weights that each word of a line uses."""
    low, shapes = ["<", *(w.lower() for w in words), ">"], ["<", *map(shape, words), ">"]
    out = []
    for i in range(1, len(words) + 1):
        own = [
            "b", f"w{low[i]}", f"s{shapes[i]}", f"e{low[i][-3:]}", f"p{low[i - 1]}", f"n{low[i + 1]}", f"q{shapes[i - 1]}", f"r{shapes[i + 1]}",
            f"sp{shapes[i]} {low[i - 1]}", f"sn{shapes[i]} {low[i + 1]}", f"ss{shapes[i - 1]} {shapes[i]} {shapes[i + 1]}",
        ]
        out.append([slot(f) for f in own])
    return out


@dataclass
class Tagger:
    """Weights of features (SLOTS, tags) and of one tag after another."""

    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, lines: list[list[int]]) -> np.ndarray:
        return self.weights[np.array(lines)].sum(1) if lines else np.zeros((0, len(TAGS)))

    def path(self, scores: np.ndarray) -> list[int]:
        """The tags of highest score."""
        if not len(scores):
            return []
        moves = np.where(ALLOWED, self.steps, -np.inf)
        best, back = np.where(OPENS, scores[0], -np.inf), []
        for row in scores[1:]:
            ways = best[:, None] + moves
            back.append(ways.argmax(0))
            best = ways.max(0) + row
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return out[::-1]

    def tag(self, text: str) -> list[dict]:
        """(entity, match, score, start) of each entity in a line."""
        words = words_of(text)
        scores = self.emissions(features([w for w, _ in words]))
        path, out = self.path(scores), []
        for i, t in enumerate(path):
            if TAGS[t].startswith("B-"):
                end = i + 1
                while end < len(path) and TAGS[path[end]] == f"I-{TAGS[t][2:]}":
                    end += 1
                start, stop = words[i][1], words[end - 1][1] + len(words[end - 1][0])
                margin = float(np.mean([scores[k][path[k]] - scores[k][0] for k in range(i, end)]))
                out.append({"entity": TAGS[t][2:], "match": text[start:stop], "score": 1 / (1 + float(np.exp(-np.clip(margin, -30, 30)))), "start": start})
        return out

    def found(self, spark: SparkSession) -> Callable[[Column], Column]:
        """Entities of a column of lines."""
        ship(spark)
        shared = spark.sparkContext.broadcast(self)

        @F.pandas_udf(FOUND)
        def tagged(texts: pd.Series) -> pd.Series:
            model = shared.value
            return pd.Series([[] if t is None else model.tag(t) for t in texts])

        return tagged


def tags_of(text: str, entities: list[tuple[str, int, int]]) -> tuple[list[str], list[int]]:
    """The words of a line and their tags by labelled ranges (entity, start, length)."""
    words = words_of(text)
    tags = [0] * len(words)
    for entity, start, length in entities:
        first = True
        for i, (w, at) in enumerate(words):
            if start <= at and at + len(w) <= start + length and entity in ENTITIES:
                tags[i] = TAGS.index(f"{'B' if first else 'I'}-{entity}")
                first = False
    return [w for w, _ in words], tags


def train(lines: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = 4, seed: int = 1) -> Tagger:
    """The mean of the weights after each line, so late lines do not weigh more."""
    weights, steps = np.zeros((SLOTS, len(TAGS))), np.zeros((len(TAGS), len(TAGS)))
    sums, step_sums = np.zeros_like(weights), np.zeros_like(steps)
    data = [(features(words), tags) for words, tags in (tags_of(t, e) for t, e in lines) if words]
    order, now = np.random.default_rng(seed), 1
    for _ in range(epochs):
        for k in order.permutation(len(data)).tolist():
            rows, want = data[k]
            model = Tagger(weights, steps)
            got = model.path(model.emissions(rows))
            for i, (a, b) in enumerate(zip(want, got, strict=True)):
                if a != b:
                    for t, by in ((a, 1.0), (b, -1.0)):
                        np.add.at(weights, (rows[i], t), by)
                        np.add.at(sums, (rows[i], t), by * now)
                if i and (want[i - 1], a) != (got[i - 1], b):
                    for x, y, by in ((want[i - 1], a, 1.0), (got[i - 1], b, -1.0)):
                        steps[x, y] += by
                        step_sums[x, y] += by * now
            now += 1
    return Tagger((weights - sums / now).astype(np.float32), (steps - step_sums / now).astype(np.float32))


def fit(labelled: DataFrame, *, rows: int = 4_000, epochs: int = 4) -> Tagger:
    """From (text, entities: array<struct<entity, start, length>>): at most `rows` lines, by a hash of their texts."""
    chosen = labelled.where("text IS NOT NULL").orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    return train([(r["text"], [(e["entity"], e["start"], e["length"]) for e in r["entities"] or ()]) for r in chosen], epochs)
