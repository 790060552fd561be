"""Edit-based similarity: Indel ratio, partial ratio and token-set ratio, 0 to 100.

`indel` is a SQL expression for short strings. Long texts go through one Arrow
function: a bit-parallel scan with k errors, made for all texts of a batch at
once, rejects nearly all of them, and only what it keeps is scored window by
window.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.cluster import ship_active
from veilframe.functions.text import long_enough, quote


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each letter of a."""
    full = (1 << len(a)) - 1
    place: dict[str, int] = {}
    for i, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << i
    s = full
    for c in b:
        u = s & place.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string to a window of the longer, cut-off windows at both ends included."""
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 100.0 if not b else 0.0
    m, n = len(a), len(b)
    best = max(ratio(a, b[max(0, i) : min(n, i + m)]) for i in range(1 - m, n))
    return max(best, max(ratio(b, a[max(0, i) : min(m, i + n)]) for i in range(1 - n, m))) if m == n else best


def token_set_ratio(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 100.0
    one, two = (f"{both} {left}".strip(), f"{both} {right}".strip())
    best = ratio(one, two)
    return max(best, ratio(both, one), ratio(both, two)) if both else best


def pieces(term: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces that make up the term; none if it is too short for them."""
    size = len(term) // (k + 1)
    return [(i * size, term[i * size : (i + 1) * size if i < k else len(term)]) for i in range(k + 1)] if size else []


class Needle:
    """A term, scanned for with at most k letters inserted or left out.

    Of k + 1 pieces of the term one stands verbatim in every window that fits, so only the surroundings of
    pieces are scanned.
    """

    def __init__(self, term: str, threshold: float):
        self.term, self.threshold = term, threshold
        self.k = min(len(term), floor(2 * len(term) * (1 - threshold) + 1e-9))
        self.place: dict[str, int] = {}
        for i, c in enumerate(term):
            self.place[c] = self.place.get(c, 0) | 1 << i
        self.words = set(term.split())
        self.pieces = pieces(term, self.k)

    def near(self, text: str) -> list[tuple[int, int]]:
        """Ranges of text around pieces, merged."""
        m, k, found = len(self.term), self.k, []
        for offset, piece in self.pieces:
            at = text.find(piece)
            while at >= 0:
                found.append(at - offset - k)
                at = text.find(piece, at + 1)
        out: list[tuple[int, int]] = []
        for start in sorted(found):
            start, end = max(0, start), start + m + 2 * k
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], max(end, out[-1][1]))
            else:
                out.append((start, end))
        return out

    def ends(self, text: str) -> list[int]:
        """Where the scan ends a match."""
        k, m, place = self.k, len(self.term), self.place
        rows = [(1 << j) - 1 for j in range(k + 1)]
        last, out = 1 << (m - 1), []
        for at, c in enumerate(text):
            mask = place.get(c, 0)
            before = rows[0]
            rows[0] = now = ((before << 1) | 1) & mask
            for j in range(1, k + 1):
                old = rows[j]
                rows[j] = now = (((old << 1) | 1) & mask) | before | (now << 1) | ((1 << j) - 1)
                before = old
            if now & last:
                out.append(at)
        return out

    def partial(self, text: str) -> float:
        """partial_ratio if it reaches the threshold, else something below it."""
        m, n = len(self.term), len(text)
        if n <= m:
            return partial_ratio(self.term, text)
        best = 0.0
        starts: set[int] = set()
        for begin, stop in self.near(text) if self.pieces else [(0, n)]:
            for end in self.ends(text[begin:stop]):
                starts.update(range(max(1 - m, begin + end - m - self.k), min(n - 1, begin + end + self.k) + 1))
        for i in starts:
            best = max(best, ratio(self.term, text[max(0, i) : min(n, i + m)]))
            if best >= 100:
                break
        return best

    def same_words(self, text: str) -> bool:
        """Whether token_set_ratio reaches the threshold; only strings of like lengths are compared letter by letter."""
        words = set(text.split())
        if not words or not self.words:
            return False
        both = self.words & words
        if both and (len(both) == len(words) or len(both) == len(self.words)):
            return True
        base = " ".join(sorted(both))
        one, two = (f"{base} {' '.join(sorted(w - both))}".strip() for w in (self.words, words))
        t, size = self.threshold, len(base)
        if both and max(2 * size / (size + len(one)), 2 * size / (size + len(two))) >= t:
            return True
        return 2 * min(len(one), len(two)) >= t * (len(one) + len(two)) and ratio(one, two) >= 100 * t

    def fits(self, text: str) -> bool:
        return self.same_words(text) or self.partial(text) >= 100 * self.threshold


def scan(texts: list[str], needle: Needle, length: int = 256) -> np.ndarray:
    """Whether each text may hold the term with k errors; none that does is left out.

    The texts stand on end, parted by a letter of no term, and are cut into rows of `length` letters that overlap by
    the longest match; a step moves all rows on by a letter.
    """
    m, k = len(needle.term), needle.k
    if not 0 < m < 64:
        return np.ones(len(texts), bool)
    ends = np.cumsum([len(t) + 1 for t in texts])
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    overlap = m + k
    n = -(-len(codes) // length)
    masks = np.zeros(overlap + n * length, np.uint64)
    here = masks[overlap : overlap + len(codes)]
    for letter, bits in needle.place.items():
        here[codes == ord(letter)] = bits
    columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(masks, (overlap + length, n), (8, 8 * length)))
    one, last = np.uint64(1), np.uint64(1 << (m - 1))
    first = [np.uint64((1 << j) - 1) for j in range(k + 1)]
    rows = [np.full(n, f) for f in first]
    found = np.zeros(len(texts), bool)
    for step, mask in enumerate(columns):
        before = rows[0]
        rows[0] = now = ((before << one) | one) & mask
        for j in range(1, k + 1):
            old = rows[j]
            rows[j] = now = (((old << one) | one) & mask) | before | (now << one) | first[j]
            before = old
        hit = np.nonzero(now & last)[0]
        if len(hit) and step >= overlap:
            found[np.minimum(np.searchsorted(ends, hit * length + step - overlap, side="right"), len(texts) - 1)] = True
    return found


def fuzzy_hit(text: Column, terms: list[str], threshold: float) -> Column:
    """Whether any term scores at least the threshold by token-set or partial ratio; text is lower-cased before."""

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        values = texts.tolist()
        out = np.zeros(len(values), bool)
        sizes = [0 if t is None else len(t.strip()) for t in values]
        for term in terms:
            needle, least = Needle(term, threshold), max(0.5 * len(term), 3.0)
            left = [i for i, n in enumerate(sizes) if n >= least and not out[i]]
            own = [values[i] for i in left]
            near = scan(own, needle).tolist() if own else ()
            for i, t, maybe in zip(left, own, near, strict=True):
                if (maybe or len(t) <= len(term)) and needle.partial(t) >= 100 * threshold or needle.same_words(t):
                    out[i] = True
        return pd.Series(out)

    ship_active()
    return hit(text)


def scores(text: Column, term: str) -> Column:
    """struct<token_set, partial>: both scores of a lower-case text, in full."""

    @F.pandas_udf("struct<token_set:double,partial:double>")
    def both(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else (token_set_ratio(term, t), partial_ratio(term, t)) for t in texts]
        return pd.DataFrame(rows, columns=["token_set", "partial"])

    ship_active()
    return both(text)


def may_fit(text: Column, terms: list[str], threshold: float) -> Column:
    """A lossless condition on built-ins before `fuzzy_hit`: a piece of a term verbatim, a shared word, or few and short distinct words.

    Counts of shared letter groups were measured too: on lines of some hundred letters they let a quarter pass and
    cost more than the scan of all.
    """
    ks = [min(len(t), floor(2 * len(t) * (1 - threshold) + 1e-9)) for t in terms]
    longest = max(max(len(t), floor(len(t) * (2 - threshold) / max(threshold, 1e-9)) + 1) for t in terms)
    enough = F.lit(False)
    for t in terms:
        enough = enough | long_enough(text, t)
    verbatim = sorted({quote(p) for t, k in zip(terms, ks, strict=True) for _, p in pieces(t, k)})
    if not all(pieces(t, k) for t, k in zip(terms, ks, strict=True)):
        return enough
    words = "|".join(sorted({quote(w) for t in terms for w in t.split()}))
    distinct = F.array_distinct(F.split(F.trim(text), r"\s+"))
    few = (F.size(distinct) <= longest // 2 + 1) & (F.length(F.array_join(distinct, " ")) <= longest)
    return enough & ((F.length(text) <= longest) | text.rlike("|".join(verbatim)) | text.rlike(rf"(?:^|\s)(?:{words})(?:\s|$)") | few)


def indel(a: Column, b: Column) -> Column:
    """The Indel ratio in SQL, a row of the table of lengths at a time; for short strings."""
    x, y = F.split(a, ""), F.split(b, "")
    zero = F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0))

    def step(row, c):
        def cell(acc, j):
            up = F.get(row, j)
            diagonal = F.get(row, j - 1) + F.when(F.get(y, j - 1) == c, 1).otherwise(0)
            return F.concat(acc, F.array(F.greatest(up, diagonal, F.element_at(acc, -1))))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(F.lit(0)), cell)

    common = F.when((a == "") | (b == ""), F.lit(0)).otherwise(F.element_at(F.aggregate(x, zero, step), -1))
    return F.when(F.length(a) + F.length(b) == 0, F.lit(100.0)).otherwise(F.lit(200.0) * common / (F.length(a) + F.length(b)))
