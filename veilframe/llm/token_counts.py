"""Token counts by a two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and their lengths in tokens,
packed into one block of bytes, broadcast and only read. Tier two is a bounded
cache in each worker, filled by encoding what tier one misses. No pre-token is
ever shuffled.

The table is a statistic of all documents: each task counts its words in a
summary of bounded size that can fall short by a stated share, takes them apart
into pre-tokens and packs the `table_words` commonest into one binary row. Rows
are merged `MERGED` at a time, each merge a task that gives one row of the same
bounded size, until so few are left that the driver adds them up. The table only
saves work: a pre-token that it lacks is encoded exactly, so the counts do not
depend on it.

Defined results: a null text counts as empty (0 bytes, 0 tokens); rows are
independent, so repeated or null ids give a row each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from veilframe.llm.bpe import CACHE_WORDS, INDEX_WORDS, SLICE, Codec, codec_for, read_spec
from veilframe.llm.common import arrow_map, begin, col, end, field, remembers, ship, stored

TABLE_WORDS = 32_768
#: Distinct words that a task's summary holds before those of less than this share of its words so far are dropped.
SUMMARY_WORDS = 100_000
SUMMARY_SHARE = 1e-5
#: Packed summaries that one task merges, and that the driver gets at most.
MERGED = 16


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """Words on end, each closed by a line feed, and their lengths in two bytes each."""
    words = [w for w in lengths if "\n" not in w and lengths[w] < 1 << 16]
    return "".join(w + "\n" for w in words).encode("utf-8", "surrogateescape"), np.array([lengths[w] for w in words], np.uint16).tobytes()


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    words = table[0].decode("utf-8", "surrogateescape").split("\n")[:-1]
    return dict(zip(words, np.frombuffer(table[1], np.uint16).tolist(), strict=True))


def summary(texts: Iterable[str], counts: Counter, seen: int) -> int:
    """Count the lower-case words; a full summary drops the rarest. Gives the number of words so far."""
    for t in texts:
        words = t.lower().split()
        counts.update(words)
        seen += len(words)
        if len(counts) > SUMMARY_WORDS:
            least = max(1, seen * SUMMARY_SHARE)
            while len(counts) > SUMMARY_WORDS // 2:
                for w in [w for w, n in counts.items() if n <= least]:
                    del counts[w]
                least *= 2
    return seen


def pack_counts(counts: Counter, table_words: int) -> bytes:
    """The commonest words and their numbers, compressed; ties by the word."""
    top = sorted(((-n, w) for w, n in counts.items() if "\n" not in w))[:table_words]
    words = "".join(w + "\n" for _, w in top).encode("utf-8", "surrogateescape")
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(words), *[-n for n, _ in top]], np.int64).tobytes() + words)


def unpack_counts(packed: bytes) -> Counter:
    data = zstandard.ZstdDecompressor().decompress(packed)
    size = int(np.frombuffer(data[:8], np.int64)[0])
    words = data[len(data) - size :].decode("utf-8", "surrogateescape").split("\n")[:-1]
    return Counter(dict(zip(words, np.frombuffer(data[8 : len(data) - size], np.int64).tolist(), strict=True)))


def added(packed: Iterable[bytes]) -> Counter:
    out = Counter()
    for p in packed:
        out.update(unpack_counts(p))
    return out


def frequent_lengths(docs: DataFrame, spec: str, *, text_col: str, table_words: int, merged: int = MERGED) -> tuple[bytes, bytes]:
    """The packed table: the commonest pre-tokens of all documents."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(spec)
    schema = "packed binary"

    def row(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pack_counts(counts, table_words)], pa.binary())], names=["packed"])

    def tally(batches):
        begin("bpe")
        words, seen = Counter(), 0
        for b in batches:
            seen = summary((t or "" for t in b.column(0).to_pylist()), words, seen)
        codec, counts = codec_for(shared.value), Counter()
        for w, n in words.items():
            for p in codec.pre_tokens(w):
                if p[0] != " ":
                    counts[p] += n
        if counts:
            yield row(counts)
        end()

    def merge(batches):
        begin("bpe")
        counts = added(p for b in batches for p in b.column(0).to_pylist())
        if counts:
            yield row(counts)
        end()

    summaries = stored(docs.select(col(text_col).alias("text")).mapInArrow(tally, schema))
    while (n := summaries.count()) > merged:
        summaries = stored(summaries.repartition(-(-n // merged)).mapInArrow(merge, schema))
    counts = added(r["packed"] for r in summaries.collect())
    chosen = [w for _, w in sorted((-n, w) for w, n in counts.items())[:table_words]]
    sizes = Codec(spec, cache_words=2 * table_words).pairs.encode([w.encode("utf-8", "surrogateescape") for w in chosen])[1]
    return pack(dict(zip(chosen, sizes.tolist(), strict=True)))


class Table(dict):
    """Tier one: what it lacks is asked of the cache."""

    def __init__(self, lengths: dict[str, int], cache: dict[str, int]):
        super().__init__(lengths)
        self.cache = cache

    def __missing__(self, word: str) -> int:
        return self.cache[word]


class Counts:
    """The two tiers in a worker."""

    def __init__(self, codec: Codec, table: dict[str, int], cache_words: int = CACHE_WORDS):
        self.codec, self.limit = codec, cache_words
        self.specials = {" " + t: 1 for t in codec.pairs.specials}
        self.cache: dict[str, int] = dict(self.specials)
        self.table = Table(table, self.cache)

    def count(self, texts: list[str]) -> list[int]:
        words = [self.codec.pre_tokens(t) for t in texts]
        unknown = set().union(*words).difference(self.table)
        missing = unknown.difference(self.cache)
        if missing and len(self.cache) + len(missing) > self.limit:
            self.cache.clear()
            self.cache.update(self.specials)
            missing = unknown.difference(self.cache)
        new = list(missing)
        for i in range(0, len(new), INDEX_WORDS):
            part = new[i : i + INDEX_WORDS]
            sizes = self.codec.pairs.encode([w.encode("utf-8", "surrogateescape") for w in part])[1]
            self.cache.update(zip(part, sizes.tolist(), strict=True))
        size = self.table.__getitem__
        return [sum(map(size, w)) for w in words]


_COUNTS: dict[int, Counts] = {}
remembers("bpe", _COUNTS.clear)


def counts_for(spec: str, table: tuple[bytes, bytes]) -> Counts:
    if (key := hash((spec, table))) not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = Counts(codec_for(spec), unpack(table))
    return _COUNTS[key]


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
    table_words: int = TABLE_WORDS,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text."""
    sc, spec = docs.sparkSession.sparkContext, read_spec(tokenizer_path)
    shared = sc.broadcast((spec, frequent_lengths(docs, spec, text_col=text_col, table_words=table_words)))

    def kernel():
        counts = counts_for(*shared.value)

        def work(part):
            texts = part.column(text_col)
            n = pa.array(counts.count([t or "" for t in texts.to_pylist()]), pa.int64())
            return [pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), n, pc.greater(n, limit)]

        return work

    fields = [field("n_bytes", T.LongType()), field("n_tokens", T.LongType()), field("over_limit", T.BooleanType())]
    return arrow_map(docs, [id_col], text_col, kernel, fields, limit=SLICE, owner="bpe")
