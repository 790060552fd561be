"""Benchmark decontamination over a distributed positional inverted index.

Index (`build_index`): documents are dealt into shards of a bounded number of
text bytes; for each, the positions of every term, sorted by term, are stored as
a row of a table in the shared folder. The index does not depend on the
benchmark, no posting is shuffled and no term can be a hot key.

Search (`search`): the benchmark is read in blocks of at most `block_words`
words, one at a time, and each is broadcast to the index's shards, so memory is
bounded by that parameter whatever the benchmark holds. For every window whose
terms a shard has, the posting list of its rarest term gives the starts; the
lists of the second rarest and then of the others, shifted by their offsets, are
intersected with them, for all windows of a shard at once. What remains are
exact phrase matches (every term in its place) and proximity matches (every term
within `slop` words of its place).

Words: A-Z lower-cased, then runs of digits, letters a-z and characters from
U+0080 on. A window is `width` consecutive words of an item; a shorter item
that has words is one window.

Defined results: null or wordless texts have no words, no spans and no items;
null or wordless benchmark rows have no windows; repeated item ids count once;
a window without item id marks words but names no item; rows of documents are
independent, so repeated or null ids give a row each; empty tables on either
side give no matches; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import begin, col, end, ship, slices, stored, text_bytes

WIDTH = 10
SLOP = 2
BLOCK_WORDS = 500_000
SHARD_BYTES = 4 << 20
#: Postings of rarest terms that are looked at together.
PAIRS = 1 << 20

#: For each byte: A-Z to a-z; digits, letters and bytes from 0x80 on stay; others become a blank.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


class Numbers(dict):
    """A number for each term, in order of first sight."""

    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Block:
    """The windows of some benchmark items, each distinct one once, over a vocabulary of their own."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], width: int):
        vocabulary = Numbers()
        self.width = width
        self.names = sorted({name for name, _ in items if name is not None})
        number = {name: i for i, name in enumerate(self.names)} | {None: -1}
        rows, owners = [np.zeros((0, width), np.int32)], [np.zeros(0, np.int64)]
        for name, words in items:
            ids = np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words))
            if 0 < len(ids) < width:
                ids = np.concatenate([ids, np.full(width - len(ids), -1, np.int32)])
            if len(ids):
                rows.append(np.lib.stride_tricks.sliding_window_view(ids, width))
                owners.append(np.full(len(rows[-1]), number[name]))
        self.windows, window = np.unique(np.concatenate(rows), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([window.reshape(-1), np.concatenate(owners)], axis=1), axis=0)
        pairs = pairs[pairs[:, 1] >= 0]
        #: Items of each window, on end.
        self.owners, self.first = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.windows) + 1))
        self.terms = b"\n".join(vocabulary)


def blocks(benchmark: DataFrame, id_col: str, text_col: str, width: int, block_words: int) -> Iterator[Block]:
    """One block at a time; at least one, if only an empty one."""
    items: list[tuple[str | None, list[bytes]]] = []
    total = 0
    for name, text in benchmark.select(col(id_col).cast("string"), col(text_col)).toLocalIterator():
        words = words_of((text or "").encode())
        if total and total + len(words) > block_words:
            yield Block(items, width)
            items, total = [], 0
        items.append((name, words))
        total += len(words)
    yield Block(items, width)


class Shard:
    """The postings of some texts: terms, and for each the ascending places where it stands."""

    def __init__(self, terms: list[bytes], sizes: np.ndarray, places: np.ndarray, counts: np.ndarray, gap: int):
        self.terms, self.sizes, self.places, self.counts, self.gap = terms, sizes, places, counts, gap
        self.base = np.cumsum(counts + gap) - counts

    @classmethod
    def of(cls, texts: list[bytes], gap: int) -> Shard:
        lists = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, lists), np.int64, len(lists))
        numbers = Numbers()
        ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int32, int(counts.sum()))
        out = cls(list(numbers), np.bincount(ids, minlength=len(numbers)), ids[:0], counts, gap)
        where = np.arange(len(ids)) + np.repeat(out.base - (np.cumsum(counts) - counts), counts)
        out.places = where[np.argsort(ids, kind="stable")]
        return out

    def pack(self) -> tuple[bytes, bytes, bytes]:
        zip_ = zstandard.ZstdCompressor(level=1).compress
        steps = np.diff(self.places, prepend=0)  # down to the next term's first place where a list ends
        return zip_(b"\n".join(self.terms)), zip_(self.sizes.astype(np.int32).tobytes()), zip_(steps.astype(np.int32).tobytes())

    @classmethod
    def unpack(cls, terms: bytes, sizes: bytes, postings: bytes, counts: list[int], gap: int) -> Shard:
        open_ = zstandard.ZstdDecompressor().decompress
        joined = open_(terms)
        places = np.cumsum(np.frombuffer(open_(postings), np.int32), dtype=np.int64)
        return cls(joined.split(b"\n") if joined else [], np.frombuffer(open_(sizes), np.int32).astype(np.int64), places, np.array(counts, np.int64), gap)

    def search(self, block: Block, slop: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Each text's spans in exact windows, and (text, item) pairs of exact and of proximity matches."""
        number = dict(zip(self.terms, range(len(self.terms)), strict=True))
        local = np.array([number.get(w, -1) for w in block.terms.split(b"\n")], np.int64)
        begins = np.concatenate([[0], np.cumsum(self.sizes)])
        extent = int(self.base[-1] + self.counts[-1] + self.gap + 1) if len(self.counts) else 1
        keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * extent + self.places  # ascending: by term, then by place
        n = (block.windows >= 0).sum(axis=1)
        terms = np.where(block.windows >= 0, local[block.windows], -2)
        some = np.nonzero((terms != -1).all(axis=1) & (n > 0))[0]
        terms, n = terms[some], n[some]
        most = np.iinfo(np.int64).max
        freq = np.where(terms >= 0, self.sizes[terms], most)
        rarest = freq.argmin(axis=1)
        rows = np.arange(len(some))
        count = freq[rows, rarest]
        freq[rows, rarest] = most - 1
        second = freq.argmin(axis=1)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        total = np.cumsum(count)
        cut = 0
        while cut < len(some):
            stop = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, side="right")))
            part = np.arange(cut, stop)
            own = np.repeat(part, count[part])
            at = np.arange(len(own)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            starts = self.places[begins[terms[own, rarest[own]]] + at] - rarest[own]
            for step in range(block.width):  # the second rarest, then the others from left to right
                o = second[own] if step == 0 else np.full(len(own), step - 1)
                o = np.where((o >= n[own]) | (o == rarest[own]), rarest[own], o)
                low = terms[own, o] * extent + starts + o
                k = np.minimum(np.searchsorted(keys, low - slop), len(keys) - 1)
                near = np.abs(keys[k] - low) <= slop
                own, starts = own[near], starts[near]
                if not len(own):
                    break
            # The last offset, which the steps above leave out for windows of the full width.
            if len(own):
                o = n[own] - 1
                low = terms[own, o] * extent + starts + o
                k = np.minimum(np.searchsorted(keys, low - slop), len(keys) - 1)
                near = np.abs(keys[k] - low) <= slop
                own, starts = own[near], starts[near]
            if len(own):
                hits.append((own, starts, rarest[own]))
            cut = stop
        empty = np.zeros((0, 2), np.int64)
        if not hits:
            return [empty] * len(self.counts), empty, empty
        own, starts, anchor = (np.concatenate(x) for x in zip(*hits, strict=True))
        here = np.full(extent + block.width, -1, np.int64)
        here[self.places] = np.repeat(np.arange(len(self.sizes)), self.sizes)
        offsets = np.arange(block.width)
        exact = ((here[np.maximum(starts, 0)[:, None] + offsets] == terms[own]) | (offsets >= n[own][:, None])).all(axis=1)
        covered = np.zeros(extent + 1, np.int64)
        np.add.at(covered, starts[exact], 1)
        np.add.at(covered, starts[exact] + n[own[exact]], -1)
        edges = np.diff((np.cumsum(covered) > 0).astype(np.int8), prepend=0, append=0)
        spans = np.stack([np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]], axis=1)
        doc = np.searchsorted(self.base, spans[:, 0], side="right") - 1
        spans = spans - self.base[doc][:, None]
        cuts = np.searchsorted(doc, np.arange(len(self.counts) + 1))
        text = np.searchsorted(self.base, starts + anchor, side="right") - 1
        return [spans[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], self._items(block, some[own[exact]], text[exact]), self._items(block, some[own[~exact]], text[~exact])

    @staticmethod
    def _items(block: Block, windows: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Distinct (text, item) pairs, from one pair a window and text."""
        pairs = np.unique(np.stack([texts, windows], axis=1), axis=0)
        many = block.first[pairs[:, 1] + 1] - block.first[pairs[:, 1]]
        at = np.repeat(block.first[pairs[:, 1]] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
        return np.unique(np.stack([np.repeat(pairs[:, 0], many), block.owners[at]], axis=1), axis=0)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Touching or overlapping spans as one, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
SPAN_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def gap_of(width: int, slop: int) -> int:
    """Empty places between texts, so that no window reaches from one into another."""
    return width + 2 * slop + 1


def build_index(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", gap: int = gap_of(WIDTH, SLOP), shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The stored postings: a row a shard (shard, ids, counts, terms, sizes, postings)."""
    ship(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    binary = [T.StructField(c, T.BinaryType()) for c in ("terms", "sizes", "postings")]
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("counts", T.ArrayType(T.IntegerType())), *binary])

    def run(batches):
        begin()
        n = TaskContext.get().partitionId() << 32
        for part in gathered(batches, shard_bytes):
            shard = Shard.of(text_bytes(part.column("text")), gap)
            ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("id"))
            packed = [pa.array([x], pa.binary()) for x in shard.pack()]
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), ids, pa.array([shard.counts.tolist()], pa.list_(pa.int32())), *packed], names=schema.names)
            n += 1
        end()

    return stored(rows.mapInArrow(run, schema))


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches put together until they hold about `limit` text bytes."""
    held, size = [], 0
    for batch in batches:
        for part in slices(batch, "text", limit):
            own = part.column("text").nbytes
            if held and size + own > limit:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


def search(index: DataFrame, block: Block, *, slop: int = SLOP, gap: int = gap_of(WIDTH, SLOP)) -> DataFrame:
    """(shard, at, id, n_words, spans, items, near_items) of every text of the index, for one block."""
    ship(index.sparkSession)
    shared = index.sparkSession.sparkContext.broadcast(block)
    strings = T.ArrayType(T.StringType())
    schema = T.StructType([
        T.StructField("shard", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("id", index.schema["ids"].dataType.elementType), T.StructField("n_words", T.LongType()),
        T.StructField("spans", SPAN), T.StructField("items", strings), T.StructField("near_items", strings),
    ])

    def run(batches):
        begin()
        known = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                row = part.drop_columns(["ids"]).to_pylist()[0]
                shard = Shard.unpack(row["terms"], row["sizes"], row["postings"], row["counts"], gap)
                spans, items, near = shard.search(known, slop)
                hit: list[set[str]] = [set() for _ in shard.counts]
                close: list[set[str]] = [set() for _ in shard.counts]
                for pairs, out in ((items, hit), (near, close)):
                    for text, item in pairs.tolist():
                        out[text].add(known.names[item])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), row["shard"])),
                        pa.array(np.arange(len(hit), dtype=np.int32)),
                        part.column("ids").flatten(),
                        pa.array(shard.counts),
                        pa.array([[{"start": a, "end": b} for a, b in s.tolist()] for s in spans], SPAN_ARROW),
                        pa.array([sorted(x) for x in hit], pa.list_(pa.string())),
                        pa.array([sorted(y - x) for x, y in zip(hit, close, strict=True)], pa.list_(pa.string())),
                    ],
                    names=schema.names,
                )
        end()

    return index.mapInArrow(run, schema)


def with_matches(found: DataFrame) -> DataFrame:
    return found.where((F.size("spans") > 0) | (F.size("near_items") > 0))


def united(index: DataFrame, found: list[DataFrame]) -> DataFrame:
    """The results of all blocks as one row a text; only texts with a match in a block are gathered."""
    ship(index.sparkSession)
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    every = with_matches(every).groupBy("shard", "at").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items", "near_items")])
    every = every.select("shard", "at", "spans", F.array_sort(F.array_distinct("items")).alias("items"), F.array_sort(F.array_except("near_items", "items")).alias("near_items"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("spans", SPAN), *every.schema[3:]])

    def run(batches):
        for b in batches:
            spans = [[{"start": x, "end": y} for x, y in merged([(s["start"], s["end"]) for s in row])] for row in b.column("spans").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("at"), pa.array(spans, SPAN_ARROW), b.column("items"), b.column("near_items")], names=schema.names)

    texts = index.select("shard", F.posexplode(F.arrays_zip("ids", "counts")).alias("at", "row")).select("shard", "at", F.col("row.ids").alias("id"), F.col("row.counts").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    out = texts.join(every.mapInArrow(run, schema), ["shard", "at"], "left")
    return out.select("id", "n_words", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"), F.coalesce("items", none).alias("items"), F.coalesce("near_items", none).alias("near_items"))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    slop: int = SLOP,
    block_words: int = BLOCK_WORDS,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(id, n_words, spans, items, near_items): merged word spans that exact windows cover, ids of the
    items with exact windows and of those with proximity matches only, both sorted as strings."""
    gap = gap_of(width, slop)
    index = build_index(docs, id_col=id_col, text_col=text_col, gap=gap, shard_bytes=shard_bytes)
    parts = blocks(benchmark, item_col, item_text_col, width, block_words)
    block, found = next(parts), []
    for following in parts:  # each block's matches are written before the next is read
        found.append(stored(with_matches(search(index, block, slop=slop, gap=gap))))
        block = following
    last = search(index, block, slop=slop, gap=gap)
    out = united(index, [*found, last]) if found else last
    return out.select(F.col("id").alias(id_col), "n_words", "spans", "items", "near_items")


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The matches with n_hit, the number of words in spans."""
    found = matches(docs, benchmark, **options)
    return found.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]))


def clean(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, without any exact match.

    Rows are told apart by the md5 of their text, which alone decides, so ids may be null or repeat; the hashes of
    contaminated texts are stored, and joined in the way that their size allows.
    """
    key = F.md5(F.coalesce(col(text_col), F.lit("")))
    name = "text_md5"
    while name in set(map(str.lower, docs.columns)):
        name += "_"
    hashed = docs.select(key.alias("key"), col(text_col).alias("text"))
    options.pop("id_col", None)
    found = matches(hashed, benchmark, id_col="key", text_col="text", **options)
    gone = stored(found.where(F.size("spans") > 0).select(F.col("key").alias(name)).distinct())
    return docs.join(gone, key == F.col(name), "left_anti")
