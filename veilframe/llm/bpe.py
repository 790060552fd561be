"""BPE encoding and decoding with a pair occurrence index.

The distinct pre-tokens of a slice are laid out in one array of symbols. An
index maps every mergeable pair to all its positions in that array; active
ranks leave a heap in ascending order, each is applied to all its positions,
and the lists of the pairs that a merge makes or breaks are brought up to date.
Merged pre-tokens stay in a bounded worker cache.

The tokenizer is read on the driver from the path given and broadcast, a few
megabytes whatever the corpus holds. Nothing is shuffled.

Defined results: a null text is encoded as an empty one (no ids, decoded "");
a null id array decodes to ""; ids may be null or repeat, rows are independent;
an empty table gives an empty table; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.common import arrow_map, begin, col, end, field, remembers, ship

#: Pre-tokens that a worker keeps; a full cache is emptied, which costs time only.
CACHE_WORDS = 300_000
SLICE = 2 << 20
#: New pre-tokens that one index holds; their letters are Python numbers while it works.
INDEX_WORDS = 30_000

_LETTERS = "a-zªµºß-öø-ſ"
_NUMBERS = "0-9²³¹¼-¾"
_BLANK = "\t-\r \x85\xa0"
#: The pre-token rule over the characters for which Python's own tables surely agree with the library's.
_SIMPLE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANK}{_LETTERS}{_NUMBERS}]+")
_NOT_SIMPLE = re.compile("[^\x00-ſ‐-‧‰-⁞₠-₿]")


def byte_letters() -> list[str]:
    """The visible letter for each byte: printable ones stand for themselves, the rest follow from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class PairIndex:
    """Merge rules as ids, and the index that applies them to many words at once."""

    def __init__(self, spec: str):
        data = json.loads(spec)
        model = data["model"]
        vocab = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.token = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        letters = byte_letters()
        self.letter_byte = {c: b for b, c in enumerate(letters)}
        first = [vocab[c] for c in letters] + [vocab[c + suffix] for c in letters]
        self.base = np.array(first, np.int64)
        code = {t: i for i, t in enumerate(first)}
        self.rules = []
        self.rank = {}
        self.start_rank = np.full((512, 512), -1, np.int32)
        for r, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y = vocab[a], vocab[b]
            self.rules.append((x, y, vocab[a + b]))
            if self.rank.setdefault(x << 20 | y, r) == r and x in code and y in code:
                self.start_rank[code[x], code[y]] = r

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words on end, and the number of each word's."""
        if not words:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        code = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        code[ends - 1] += 256
        n = len(code)
        rank = self.start_rank[code[:-1], code[1:]]
        rank[ends[:-1] - 1] = -1
        at = np.nonzero(rank >= 0)[0]
        at = at[np.argsort(rank[at], kind="stable")]
        ranks, cuts = np.unique(rank[at], return_index=True)
        index = {int(r): p.tolist() for r, p in zip(ranks, np.split(at, cuts[1:]), strict=True)} if len(at) else {}
        heap = list(index)  # ascending, so a heap already
        symbols = [*self.base[code].tolist(), -1]  # the last one bounds every word
        following = np.arange(1, n + 1)
        following[ends - 1] = n
        before = np.arange(-1, n)
        before[(ends - sizes)] = -1
        after, before = [*following.tolist(), n], before.tolist()
        known, rules = self.rank.get, self.rules
        while heap:
            r = heapq.heappop(heap)
            a, b, made = rules[r]
            places = index.pop(r)
            places.sort()
            for i in places:
                if symbols[i] != a:
                    continue
                j = after[i]
                if symbols[j] != b:
                    continue
                k = after[j]
                symbols[i], symbols[j] = made, -2
                after[i] = k
                before[k] = i
                h = before[i]
                for left, q in ((i, known(made << 20 | symbols[k])), (h, known(symbols[h] << 20 | made))):
                    if q is not None:
                        if q in index:
                            index[q].append(left)
                        else:
                            index[q] = [left]
                            heapq.heappush(heap, q)
        out = np.array(symbols[:-1], np.int32)
        live = out >= 0
        total = np.cumsum(live)[ends - 1]
        return out[live], np.diff(total, prepend=0)


class Codec:
    """Texts to ids and back, as the library for the same file gives them."""

    def __init__(self, spec: str, cache_words: int = CACHE_WORDS):
        self.spec, self.limit = spec, cache_words
        self.pairs = PairIndex(spec)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.pairs.specials, key=len, reverse=True))) + ")")
        self.library = None
        self.forget()

    def forget(self) -> None:
        self.known = {" " + t: i for i, t in enumerate(self.pairs.specials)}  # no pre-token begins with a blank
        self.ids = np.array(list(self.pairs.specials.values()), np.int32)
        self.sizes = np.ones(len(self.known), np.int32)
        self.starts = np.arange(len(self.known), dtype=np.int64)

    def pre_tokens(self, text: str) -> list[str]:
        if "<|" in text:
            parts = self.split.split(text)
            return [w for i, x in enumerate(parts) for w in ((" " + x,) if i % 2 else self._plain(x))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if text.isascii() or not _NOT_SIMPLE.search(text):
            return _SIMPLE.findall(text.lower())
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        lib, byte = self.library, self.pairs.letter_byte
        shown = lib.pre_tokenizer.pre_tokenize_str(lib.normalizer.normalize_str(text))
        return [bytes(byte[c] for c in w).decode("utf-8", "surrogateescape") for w, _ in shown]

    def learn(self, words: set[str]) -> None:
        """Encode the words that the cache lacks."""
        missing = words.difference(self.known)
        if missing and len(self.known) + len(missing) > self.limit:
            self.forget()
            missing = words.difference(self.known)
        if not missing:
            return
        new = list(missing)
        parts = [self.pairs.encode([w.encode("utf-8", "surrogateescape") for w in new[i : i + INDEX_WORDS]]) for i in range(0, len(new), INDEX_WORDS)]
        ids, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
        self.ids = np.concatenate([self.ids, ids])
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int32)])

    def look_up(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The cache place of every pre-token on end, and each text's number of them."""
        words = [self.pre_tokens(t) for t in texts]
        self.learn(set().union(*words))
        counts = np.fromiter(map(len, words), np.int64, len(words))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(words)), np.int64, int(counts.sum())), counts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids on end (int32), and where each text's begin and the last ends."""
        at, counts = self.look_up(texts)
        sizes = self.sizes[at]
        ends = np.cumsum(sizes, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        where = np.repeat(self.starts[at] - (ends - sizes), sizes) + np.arange(total)
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids[where], bounds

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by one blank, as the library does without a decoder; unknown ids are left out."""
        token = self.pairs.token
        try:
            return " ".join(map(token.__getitem__, ids))
        except KeyError:
            return " ".join(token[i] for i in ids if i in token)


_CODECS: dict[int, Codec] = {}
remembers("bpe", _CODECS.clear)


def codec_for(spec: str) -> Codec:
    """One codec a worker process and file, so the cache outlives a task."""
    if (key := hash(spec)) not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(spec)
    return _CODECS[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """(id, token_ids array<int>) of every whole text, and under the name `decoded`, if given, what the ids decode to."""
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(tokenizer_path))

    def kernel():
        codec = codec_for(spec.value)

        def work(part):
            ids, bounds = codec.encode([t or "" for t in part.column(text_col).to_pylist()])
            arrays = [pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                arrays.append(pa.array((codec.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)), pa.string()))
            return arrays

        return work

    fields = [field(out, T.ArrayType(T.IntegerType()))] + ([field(decoded, T.StringType())] if decoded else [])
    return arrow_map(docs, [id_col], text_col, kernel, fields, limit=SLICE, owner="bpe")


def decode(encoded: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", ids_col: str = "token_ids", out: str = "text") -> DataFrame:
    """(id, text) of every id array."""
    spark = encoded.sparkSession
    ship(spark)
    spec = spark.sparkContext.broadcast(read_spec(tokenizer_path))
    chosen = encoded.select(col(id_col), col(ids_col))
    schema = T.StructType([chosen.schema[0], field(out, T.StringType())])

    def run(batches):
        begin("bpe")
        codec = codec_for(spec.value)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                texts = [codec.decode([i for i in ids or () if i is not None]) for ids in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=schema.names)
        end()

    return chosen.mapInArrow(run, schema)
