"""Quality rules: how far a document's character classes and common words diverge from its language.

References (`fit`): for each language, the histogram of character classes and
that of common words over all documents that carry the language, summed in the
tasks and then by key. The common words are learned: those that make up at least
`COMMON_SHARE` of a language's words, so each language has at most 1 /
COMMON_SHARE of them; all other words share one class. A language with few
documents or words is no reference, so a rare or wrong label cannot vouch for
itself. Documents are compared with every reference by Jensen-Shannon distance
(base 2, so 0 to 1) and the nearest counts; histograms of too few characters or
words are not judged.

A task sends the words that make up at least `TASK_SHARE` of its own, so a count
falls short of the truth by no more than twice that share of a language's words.

Defined results: a null or blank text has no words and fails the base rules;
rows without language only lack a part in the references; without any
reference nothing diverges; rows are independent, so repeated or null ids give
a row each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Sequence
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import arrow_map, begin, col, end, field, ship, slices, stored, text_bytes

CLASSES = ("lower", "upper", "letter", "digit", "blank", "mark", "symbol", "control")
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x09\x0a\x0b\x0c\x0d\x20"
EDGE = "".join(chr(b) for b in range(128) if not chr(b).isalnum())

COMMON_SHARE = 0.005
TASK_SHARE = 1e-4
#: Languages that a task tallies at once.
TASK_LANGS = 64
#: Distinct words that a task holds of a language before the rare ones are dropped.
SUMMARY_WORDS = 100_000
REFERENCE_DOCS = 10
REFERENCE_WORDS = 2_000
MIN_CHARS = 200
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.30
#: The bound on the distance of common words is WORD_DISTANCE + WORD_NOISE / sqrt(words): short texts scatter more.
WORD_DISTANCE = 0.26
WORD_NOISE = 1.0


class References(dict):
    """Language to (class counts, counts of the common words and of all others); `words` are the common ones."""

    words: tuple[str, ...] = ()


@cache
def class_table() -> np.ndarray:
    """The class of each code point, by its general category; the symbols of the rules are symbols."""
    kinds = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "L": "letter", "M": "letter", "N": "digit", "Z": "blank", "P": "mark", "S": "symbol", "C": "control"}
    number = {k: CLASSES.index(v) for k, v in kinds.items()}
    of = {c: number.get(c, number[c[0]]) for c in set(map(unicodedata.category, map(chr, range(0x110000))))}
    out = np.fromiter((of[unicodedata.category(chr(i))] for i in range(0x110000)), np.uint8, 0x110000)
    out[list(SYMBOLS)] = CLASSES.index("symbol")
    out[list(BLANKS)] = CLASSES.index("blank")
    return out


_ASCII = bytes(range(128))


def class_counts(text: str) -> np.ndarray:
    """The number of code points of each class; ASCII ones are counted as bytes, which most are."""
    data = text.encode("utf-8", "surrogatepass")
    table = class_table()
    out = np.bincount(table[:128], np.bincount(np.frombuffer(data, np.uint8), minlength=256)[:128], len(CLASSES))
    if not text.isascii():
        rest = data.translate(None, _ASCII).decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass")
        out += np.bincount(table[np.frombuffer(rest, np.uint32)], minlength=len(CLASSES))
    return out


def bare(found: Counter[str]) -> Counter[str]:
    """The words without ASCII marks at their edges."""
    out: Counter[str] = Counter()
    for w, n in found.items():
        out[w.strip(EDGE)] += n
    return out


def word_counts(text: str) -> Counter[str]:
    """The lower-case words without ASCII marks at their edges."""
    return bare(Counter(text.lower().split()))


class Places(dict):
    """The place of a word in the histogram, by the word as it stands: that of its common form, or the last."""

    def __init__(self, common: Sequence[str]):
        super().__init__()
        self.number = {w: i for i, w in enumerate(common)}

    def __missing__(self, word: str) -> int:
        if len(self) > SUMMARY_WORDS:
            self.clear()
        self[word] = place = self.number.get(word.strip(EDGE), len(self.number))
        return place

    def counts(self, text: str) -> np.ndarray:
        """How often each common word stands, and last all others."""
        words = text.lower().split()
        return np.bincount(np.fromiter(map(self.__getitem__, words), np.int64, len(words)), minlength=len(self.number) + 1).astype(np.float64)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of histogram p to each row of q; both need not be normed."""
    p = p / p.sum()
    q = q / q.sum(axis=1, keepdims=True)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        right = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.sqrt(np.maximum(0, (left + right) / 2))


class Tally:
    """Of one language in one task: documents, words, class counts, and the counts of all but the rarest words."""

    def __init__(self):
        self.docs = self.total = 0
        self.classes, self.words = np.zeros(len(CLASSES)), Counter()

    def add(self, text: str) -> None:
        words = text.lower().split()
        self.docs += 1
        self.total += len(words)
        self.classes += class_counts(text)
        self.words.update(words)  # as they stand; their edges come off once, in the end
        if len(self.words) > SUMMARY_WORDS:
            self.words = Counter({w: n for w, n in self.words.items() if n > max(1, TASK_SHARE * self.total)})

    def rows(self) -> list[tuple[str, str, float]]:
        """(kind, word or class, number)"""
        out = [("docs", "", float(self.docs)), ("words", "", float(self.total))]
        out += [("class", c, v) for c, v in zip(CLASSES, self.classes.tolist(), strict=True)]
        return out + [("word", w, float(n)) for w, n in bare(self.words).items() if n >= TASK_SHARE * self.total and w]


def fit(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", common_share: float = COMMON_SHARE, reference_docs: int = REFERENCE_DOCS, reference_words: int = REFERENCE_WORDS
) -> References:
    """References over all documents: a row a task, language and common word or class is shuffled."""
    ship(docs.sparkSession)
    rows = docs.select(col(lang_col).cast("string").alias("lang"), col(text_col).alias("text")).where(F.col("lang").isNotNull())

    def tally(batches):
        begin()
        found: dict[str, Tally] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                    if lang not in found and len(found) == TASK_LANGS:  # sums go on from a new tally
                        yield told(found)
                        found.clear()
                    found.setdefault(lang, Tally()).add(text or "")
        yield told(found)
        end()

    def told(found):
        out = [(lang, *r) for lang, t in found.items() for r in t.rows()]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.float64()))], names=["lang", "kind", "name", "n"])

    sums = stored(rows.mapInArrow(tally, "lang string, kind string, name string, n double").groupBy("lang", "kind", "name").agg(F.sum("n").alias("n")))
    # Values of the language column that too few documents or words have are no references, and nothing of them is collected.
    count = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("n")))
    totals = sums.where("kind IN ('docs', 'words')").groupBy(F.col("lang").alias("of")).agg(count("docs").alias("docs"), count("words").alias("total"))
    totals = totals.where((F.col("docs") >= reference_docs) & (F.col("total") >= reference_words)).select("of", "total")
    # Words that are rare in one language may be common in another, so a name counts if it is common anywhere.
    sums = sums.join(totals, F.col("lang") == F.col("of")).withColumn("share", F.when(F.col("kind") == "word", F.col("n") / F.greatest("total", F.lit(1.0))).otherwise(1.0))
    wanted = sums.withColumn("most", F.max("share").over(Window.partitionBy("kind", "name"))).where(F.col("most") >= common_share)
    found: dict[str, dict[tuple[str, str], float]] = {}
    for r in wanted.select("lang", "kind", "name", "n").toLocalIterator():
        found.setdefault(r["lang"], {})[r["kind"], r["name"]] = r["n"]
    found = dict(sorted(found.items()))
    out = References()
    out.words = tuple(sorted({name for v in found.values() for (kind, name), n in v.items() if kind == "word" and n >= common_share * v["words", ""]}))
    for lang, v in found.items():
        common = [v.get(("word", w), 0.0) for w in out.words]
        out[lang] = ([v["class", c] for c in CLASSES], [*common, max(0.0, v["words", ""] - sum(common))])
    return out


_FACTORS = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 1 << 64) for i in range(64)], np.uint64)


def repeated(lists: list[list[bytes]], width: int = 8) -> list[int]:
    """For each text, its words in `width`-word windows that it holds twice or more.

    Hashes only propose windows; their words decide.
    """
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    ids: dict[bytes, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for w in chain.from_iterable(lists)), np.int64, int(counts.sum()))
    doc = np.repeat(np.arange(len(lists)), counts)
    n = len(flat) - width + 1
    out = np.zeros(len(lists), np.int64)
    if n < 1:
        return out.tolist()
    whole = doc[:n] == doc[width - 1 :]
    key = doc[:n].astype(np.uint64) * _FACTORS[-1]
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * _FACTORS[-2]
    mixed ^= mixed >> np.uint64(29)
    for i in range(width):
        key = key + mixed[i : n + i] * _FACTORS[i]
    at = np.nonzero(whole)[0]
    order = np.argsort(key[at], kind="stable")
    at = at[order]
    same = np.diff(key[at]) == 0
    at = at[np.concatenate([same, [False]]) | np.concatenate([[False], same])] if len(at) else at
    rows = [(d, *w) for d, w in zip(doc[at].tolist(), flat[at[:, None] + np.arange(width)].tolist(), strict=True)]
    seen = Counter(rows)
    sure = at[[seen[r] > 1 for r in rows]] if len(at) else at
    covered = np.zeros(len(flat) + 1, np.int64)
    np.add.at(covered, sure, 1)
    np.add.at(covered, sure + width, -1)
    np.add.at(out, doc[np.cumsum(covered[:-1]) > 0], 1)
    return out.tolist()


def judge(
    docs: DataFrame,
    references: dict[str, tuple[list[float], list[float]]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_words: int = MIN_WORDS,
    max_class_distance: float = MAX_CLASS_DISTANCE,
    word_distance: float = WORD_DISTANCE,
    word_noise: float = WORD_NOISE,
) -> DataFrame:
    """The base counts, both distances (null where too short to judge), base_failed and kept."""
    classes = np.array([r[0] for r in references.values()]).reshape(-1, len(CLASSES))
    names_ = getattr(references, "words", ())
    common = np.array([r[1] for r in references.values()]).reshape(-1, len(names_) + 1)

    def kernel():
        places = Places(names_)

        def one(text: str, words: list[bytes]):
            chars, found = class_counts(text), places.counts(text)
            a = float(distance(chars, classes).min()) if len(classes) and chars.sum() >= min_chars else None
            b = float(distance(found, common).min()) if len(common) and len(words) >= min_words and found.sum() else None
            return a, b

        def work(part):
            texts = text_bytes(part.column(text_col))
            lists = [t.split() for t in texts]
            rows = []
            for text, words, again in zip(texts, lists, repeated(lists), strict=True):
                solid = text.translate(None, BLANKS)
                lines = [x for x in text.split(b"\n") if x.strip(BLANKS)]
                a, b = one(text.decode("utf-8", "replace"), words)
                failed = len(words) < 20 or 100 * again > 30 * len(words)
                fits = (a is None or a <= max_class_distance) and (b is None or b <= word_distance + word_noise / len(words) ** 0.5)
                rows.append((len(words), len(solid.decode("utf-8", "replace")), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), again, failed, not failed and fits, a, b))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            return [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]

        return work

    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    fields = [field(n, T.LongType()) for n in names] + [field(n, T.BooleanType()) for n in ("base_failed", "kept")] + [field(n, T.DoubleType()) for n in ("class_distance", "word_distance")]
    return arrow_map(docs, [id_col], text_col, kernel, fields)
