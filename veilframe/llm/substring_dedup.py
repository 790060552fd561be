"""Substring dedup with repeated-phrase automata.

Confirm: every text gives its seeds, the least of each run of `WIDTH - PHRASE +
1` hashes of `PHRASE` consecutive words, so two equal windows of `WIDTH` words
hold the same seed. A seed that occurs twice in all documents is a recurring
phrase; it is owned by the least document that has it, found by a grouped
minimum that is combined on the map side.

Compile: phrases are dealt into shards by their owner, so the phrases of one
passage, or of one copied document, share a shard. A shard's Aho-Corasick
automaton is compiled from the words of its owners, whatever documents it will
read; shards follow `SHARD_BYTES` of text.

Locate: every document that has a phrase of a shard is streamed whole through
that shard's automaton, whose letters are the words themselves. It alone says
where phrases occur: no position and no hash of a streamed text is used. Each
window of `WIDTH` words around an occurrence is a candidate. All occurrences of
a repeated window meet in the shard of its least seed, and what a shard takes
for a repeat is one, so the union over shards is exact. The first in (document,
start) order stays, the others cover words to remove.

Common phrases, of more documents than a task reads, have shards of their own,
and only documents go there in which more words around one recur. Such a shard is
split into slots, each with the automaton and a bounded part of the documents;
slots agree on the first by a grouped minimum, to which a slot gives a window
once, only in the shard of its least seed and only if what it holds around that
recurs. Other shards that very many documents stream through are dealt out by
owners, whose phrases stay together, and exchange nothing; only where a part is
still read by too many is it split into slots too.

Windows of a slot are compared word by word, those of different slots by 128
bits of digest. A phrase whose 64-bit hash an unlike phrase shares could be
missed: of n recurring phrases about n * n / 2**65 pairs do by chance.

Defined results: null and wordless texts have no words and lose none; rows
without id are passed through whole and count as no earlier occurrence; rows
that repeat an id are taken as one document after another in the order of a
hash of their texts, rows equal in both share one result; an empty table gives
an empty table; columns other than those carried are ignored.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.cluster import merging
from veilframe.llm.common import FAN, arrow_map, begin, checkpoint, col, end, field, join_groups, ship, slices, stored, text_bytes
from veilframe.llm.shingles import WORDS, mix, sliding, windows

WIDTH = 20
PHRASE = 8
#: Words beside a phrase: a window of `WIDTH` words around one holds so many before it or so many after it.
SIDE = (WIDTH - PHRASE) // 2
SHARD_BYTES = 2 << 20
#: Text that a slot of a split shard reads, as far as documents are of like length.
SLOT_BYTES = 4 << 20

DIGITS = 3


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all texts on end, each text's first place and its number of words."""
    flat, counts = WORDS.of([t.split() for t in texts])
    return flat, np.cumsum(counts) - counts, counts


def whole(n: int, starts: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Where a run of `width` words from each of the first n places lies in one text."""
    owner = np.repeat(np.arange(len(counts)), counts)[:n]
    return (starts + counts)[owner] - np.arange(n) >= width


def least_seeds(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the phrase hash, for each window its least one, and which windows are whole."""
    g = windows(flat, PHRASE)
    least = sliding(g, WIDTH - PHRASE + 1)
    return g, least, whole(len(least), starts, counts, WIDTH)


def sides_of(hashes: np.ndarray) -> np.ndarray:
    """For each place a short hash of the words of a phrase and of `SIDE` more."""
    return windows(hashes, PHRASE + SIDE).astype(np.uint32).view(np.int32)


def seeds(docs: DataFrame) -> DataFrame:
    """(k, id, mark, n, left, right) from rows (id, mark, text): each seed of a text once for the words around it, n = 2 if it occurs there again.

    `left` and `right` are hashes of it with the `SIDE` words before or after it, null where the text has fewer.
    """
    sides = [T.StructField(c, T.IntegerType()) for c in ("left", "right")]
    schema = T.StructType([T.StructField("k", T.LongType()), docs.schema["id"], docs.schema["mark"], T.StructField("n", T.IntegerType()), *sides])

    def kernel(part):
        flat, starts, counts = layout(text_bytes(part.column("text")))
        g, least, ok = least_seeds(flat, starts, counts)
        if not ok.any():
            return None
        span = WIDTH - PHRASE + 1
        most = sliding(np.concatenate([np.zeros(span - 1, np.uint64), np.where(ok, least, 0), np.zeros(span - 1, np.uint64)]), span, np.maximum)
        at = np.nonzero(most == g[: len(most)])[0]
        doc = np.searchsorted(starts, at, side="right") - 1
        around = sides_of(flat)
        has = at - SIDE >= starts[doc], at + PHRASE + SIDE <= (starts + counts)[doc]
        left, right = np.where(has[0], around[at - SIDE], 0), np.where(has[1], around[np.minimum(at, len(around) - 1)], 0)
        order = np.lexsort((right, left, g[at], doc))
        k, doc, left, right, has = g[at][order], doc[order], left[order], right[order], [h[order] for h in has]
        new = np.concatenate([[True], np.any([np.diff(x) != 0 for x in (k, doc, left, right, *has)], axis=0)])
        first = np.nonzero(new)[0]
        n = np.minimum(np.diff(np.concatenate([first, [len(k)]])), 2)
        owner = pa.array(doc[first])
        return [pa.array(k[first].view(np.int64)), part.column("id").take(owner), part.column("mark").take(owner), pa.array(n.astype(np.int32)), *(pa.array(x[first], mask=~h[first]) for x, h in zip((left, right), has, strict=True))]

    ship(docs.sparkSession)

    def run(batches):
        begin("words")
        for batch in batches:
            for part in slices(batch, "text"):
                if (out := kernel(part)) is not None:
                    yield pa.RecordBatch.from_arrays(out, names=schema.names)
        end()

    return docs.mapInArrow(run, schema)


def numbered(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """The words of all texts on end as numbers, each text's first place, its number of words, and the word of each number."""
    numbers: dict[bytes, int] = {}
    lists = [[numbers.setdefault(w, len(numbers)) for w in t.split()] for t in texts]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter(chain.from_iterable(lists), np.int32, int(counts.sum()))
    return flat, np.cumsum(counts) - counts, counts, list(numbers)


def located(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    """For each place, whether one of the phrases that begin at `phrases` occurs there.

    A word is three letters, the digits of its number, each place with letters of its own: an automaton's
    node looks through its branches one by one, so their number has to be small.
    """
    distinct, words = np.unique(flat, return_inverse=True)
    base = int(np.ceil((len(distinct) + 1) ** (1 / DIGITS))) + 1
    shift = np.repeat(np.arange(len(counts)), counts) + 1  # letters 0 before each text
    letters = np.zeros((len(flat) + len(counts) + 1, DIGITS), np.uint32)
    for i in range(DIGITS):
        letters[np.arange(len(flat)) + shift, i] = words // base**i % base + 1 + i * base
    text = letters.tobytes().decode("utf-32-le", "surrogatepass")
    automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    size = PHRASE * DIGITS
    for phrase in {text[at : at + size] for at in (DIGITS * (phrases + shift[phrases])).tolist()}:
        automaton.add_word(phrase)
    automaton.make_automaton()
    hit = np.zeros(len(letters), bool)
    ends = np.fromiter((end for end, _ in automaton.iter(text)), np.int64)
    hit[(ends + 1) // DIGITS - PHRASE] = True
    return hit[np.arange(len(flat)) + shift]


def compiled(texts: list[bytes], starts: np.ndarray, owned: list[np.ndarray | None]) -> np.ndarray:
    """The places of the phrases that the texts own, which they know by hash."""
    places = [np.zeros(0, np.int64)]
    for text, start, ks in zip(texts, starts.tolist(), owned, strict=True):
        if ks is not None:
            g = windows(WORDS.of([text.split()])[0], PHRASE)
            places.append(start + np.nonzero(np.isin(g, ks))[0])
    return np.concatenate(places)


def firsts(flat: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Whether no window of `width` words before one in `at` has the same words; sorted by hash, compared by words."""
    if not len(at):
        return np.zeros(0, bool)
    hashes = windows(mix(flat.astype(np.uint64) + np.uint64(1)), width)[at]
    order = np.argsort(hashes, kind="stable")
    new = np.concatenate([[True], np.diff(hashes[order]) != 0])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
    out, odd = np.zeros(len(at), bool), []
    out[order[new]] = True
    columns = np.arange(width)
    for i in range(0, len(at), 50_000):
        own, of = order[i : i + 50_000], head[i : i + 50_000]
        unlike = (flat[at[own][:, None] + columns] != flat[at[of][:, None] + columns]).any(1)
        odd += hashes[own[unlike]].tolist()
    if odd:  # unlike windows of one hash
        seen = set()
        for i in np.nonzero(np.isin(hashes, np.array(odd, np.uint64)))[0].tolist():
            words = flat[at[i] : at[i] + width].tobytes()
            out[i] = words not in seen
            seen.add(words)
    return out


def shared_ones(flat: np.ndarray, at: np.ndarray, words: list[bytes], ks: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which windows in `at` other slots may have: all occurrences of a repeated window meet where its least seed is, so that is one of the phrases ks.

    Of common phrases `known` has what they are with words before or after them, as far as it occurs again; what a window holds of that has to be there.
    """
    hashes = WORDS.of([words])[0][flat]
    g = windows(hashes, PHRASE)
    least = sliding(g, WIDTH - PHRASE + 1)[at]
    out = np.isin(least, ks)
    if known is None:
        return out
    again, fits = np.isin(sides_of(hashes), known), np.zeros(len(at), bool)
    for i in range(WIDTH - PHRASE + 1):
        fit = g[at + i] == least
        if i >= SIDE:
            fit &= again[at + i - SIDE]
        if i + PHRASE + SIDE <= WIDTH:
            fit &= again[at + i]
        fits |= fit
    return out & fits


def slot_windows(table: pa.Table, split: bool) -> tuple | None:
    """Of a slot with rows (id, mark, packed, ks, known, stream), in order: which row and place each candidate window has, how to get its digest, whether it is the slot's first, and of those of a split shard whether other slots need it."""
    open_ = zstandard.ZstdDecompressor().decompress
    texts = [open_(z) for z in table.column("packed").to_pylist()]
    owned = [None if ks is None else np.array(ks, np.int64).view(np.uint64) for ks in table.column("ks").to_pylist()]
    flat, starts, counts, words = numbered(texts)
    phrases = compiled(texts, starts, owned)
    if len(flat) < WIDTH or not len(phrases):
        return None
    found = np.cumsum(np.concatenate([[0], located(flat, starts, counts, phrases)]))
    span = WIDTH - PHRASE + 1
    n = len(flat) - WIDTH + 1
    doc = np.repeat(np.arange(len(counts)), counts)
    reads = np.array(table.column("stream").to_pylist(), bool)
    at = np.nonzero((found[span : span + n] > found[:n]) & whole(n, starts, counts, WIDTH) & reads[doc[:n]])[0]

    def digest(i: int) -> bytes:
        return blake2b(b" ".join([words[w] for w in flat[at[i] : at[i] + WIDTH].tolist()]), digest_size=16).digest()

    first = firsts(flat, at, WIDTH)
    heads = np.nonzero(first)[0] if split else at[:0]
    if len(heads):
        known = [x for x in table.column("known").to_pylist() if x is not None]
        heads = heads[shared_ones(flat, at[heads], words, np.concatenate([ks for ks in owned if ks is not None]), np.array(sum(known, []), np.int32) if known else None)]
    return doc[at], at - starts[doc[at]], digest, first, heads


def windows_of(table: pa.Table) -> tuple | None:
    """The same of a slot that is a whole shard, which exchanges nothing."""
    found = slot_windows(table, False)
    return None if found is None else found[:4]


def found_rows(routed: DataFrame) -> DataFrame:
    """(k, id, mark, at, length): spans to remove with k null, and with it a window's first place in a slot of a split shard."""
    schema = T.StructType([T.StructField("k", T.BinaryType()), routed.schema["id"], routed.schema["mark"], T.StructField("at", T.IntegerType()), T.StructField("length", T.IntegerType())])

    def work(table: pa.Table) -> pa.Table:
        begin("words")
        table = table.sort_by([("id", "ascending"), ("mark", "ascending")])
        found = slot_windows(table, table.num_rows > 0 and table.column("slots")[0].as_py() > 1)
        if found is None:
            none = pa.array([], pa.int32())
            return pa.Table.from_arrays([pa.array([], pa.binary()), table.column("id").slice(0, 0), table.column("mark").slice(0, 0), none, none], names=schema.names)
        doc, at, digest, first, heads = found
        late = np.nonzero(~first)[0]
        new = np.concatenate([[True], (np.diff(at[late]) != 1) | (np.diff(doc[late]) != 0)]) if len(late) else np.zeros(0, bool)
        runs = late[new]
        sizes = np.diff(np.concatenate([np.nonzero(new)[0], [len(late)]])) + WIDTH - 1 if len(late) else runs
        take = np.concatenate([runs, heads])
        k = pa.array([None] * len(runs) + [digest(i) for i in heads.tolist()], pa.binary())
        row = pa.array(doc[take])
        length = np.concatenate([sizes, np.full(len(heads), WIDTH)]).astype(np.int32)
        return pa.Table.from_arrays([k, table.column("id").take(row), table.column("mark").take(row), pa.array(at[take].astype(np.int32)), pa.array(length)], names=schema.names)

    return routed.groupBy("shard", "slot").applyInArrow(work, schema)


_WORD = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def cut(text: bytes, gone: np.ndarray) -> bytes:
    """The text without the words marked, each taken with the blanks after it."""
    parts = _WORD.findall(text)
    return b"".join(p for p, g in zip(parts, gone.tolist(), strict=True) if not g)


def marked(docs: DataFrame, id_col: str, text_col: str, carry: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Rows (id, mark, text, rest), and of those with an id each distinct (id, mark, text) once.

    `mark` is a hash of the text where the id repeats, else 0.
    """
    rest = F.struct(F.lit(0).alias("_"), *[col(c) for c in carry]).alias("rest")
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text"), rest)
    again = checkpoint(rows.where("id IS NOT NULL").groupBy("id").count().where("count > 1").select(F.col("id").alias("again")))
    if again.isEmpty():
        rows = rows.select("id", F.lit(0).cast("long").alias("mark"), "text", "rest")
        return rows, rows.where("id IS NOT NULL").select("id", "mark", "text")
    joined = rows.join(again, F.col("id") == F.col("again"), "left")
    mark = F.when(F.col("again").isNotNull(), F.xxhash64(F.coalesce("text", F.lit("")))).otherwise(F.lit(0).cast("long"))
    rows = joined.select("id", mark.alias("mark"), "text", "rest")
    once = joined.where("id IS NOT NULL").select("id", mark.alias("mark"), "text")
    return rows, once.groupBy("id", "mark").agg(F.first("text").alias("text"))


def routes(found: DataFrame, shards: int, per_slot: int) -> DataFrame:
    """(id, mark, shard, slot, slots, ks, known, stream): what each slot reads, the phrases ks that a document owns there, what `known` says of common ones.

    Phrases that occur in more than `per_slot` documents go into shards of their own, and of those documents only the ones go there in which as many words
    before or after the phrase are the same as elsewhere. A shard of others that more documents read is dealt out again by owners, whose
    phrases stay together, so it has nothing to exchange; where one owner alone is read by more, slots do.
    """
    recurring = found.groupBy("k").agg(F.min(F.struct("id", "mark")).alias("owner"), F.sum("n").alias("total"), F.count("*").alias("places")).where("total > 1")
    lot = F.pmod(F.xxhash64("owner.id", "owner.mark"), F.lit(shards)) + F.when(F.col("places") > per_slot, shards).otherwise(0)
    deal = F.pmod(F.xxhash64(F.lit("deal"), "owner.id", "owner.mark"), F.lit(1 << 16)).cast("int")
    recurring = stored(recurring.select("k", F.col("owner.id").alias("oid"), F.col("owner.mark").alias("omark"), "places", lot.alias("lot"), deal.alias("deal")))
    rare, common = recurring.where(F.col("lot") < shards), recurring.where(F.col("lot") >= shards)
    read = join_groups(found.select("k", "id", "mark"), rare.select("k", "places", "lot", "deal"), ["k"], "places", ["id", "mark"])
    read = stored(read.select("id", "mark", "lot", "deal").distinct())
    # Common phrases are at most one for `per_slot` seeds: a table of some kB here, which a plan may broadcast.
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("words")) for i, c in enumerate(("left", "right"))]))
    around = found.join(stored(common.select("k", "lot")), "k").select("id", "mark", "lot", "k", "n", sides.alias("at"))
    around = stored(around.select("id", "mark", "lot", "k", "n", "at.*").where("words IS NOT NULL"))
    again = around.groupBy("k", "side", "words").agg(F.sum("n").alias("total"), F.count("*").alias("places")).where("total > 1")
    again = stored(again.select("k", "side", "words", "places"))
    near = join_groups(around, again, ["k", "side", "words"], "places", ["id", "mark"])
    near = near.groupBy("id", "mark", "lot").agg(F.lit(0).alias("deal"), F.collect_set("words").alias("known"))
    recurring = rare.unionByName(common.join(merging(again.select("k").distinct()), "k", "left_semi"))
    many = read.groupBy("lot").agg(F.countDistinct("id", "mark").alias("count")).where(F.col("count") > per_slot)
    # Twice as many parts as would hold the documents: owners are unlike in what reads them.
    parts = stored(many.select("lot", F.ceil(2 * F.col("count") / per_slot).cast("int").alias("parts")))

    def beside(rows: DataFrame, pieces: DataFrame, key: str, name: str) -> DataFrame:
        """The rows with the number of pieces of their key, dealt out, as a key may have very many."""
        pieces = pieces.select("*", F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("fan"))
        rows = rows.withColumn("fan", F.pmod(F.xxhash64("id", "mark"), F.lit(FAN)).cast("int"))
        return rows.join(pieces, [key, "fan"], "left").withColumn(name, F.coalesce(name, F.lit(1))).drop("fan")

    shard = (F.col("lot") + 2 * shards * F.pmod("deal", "parts")).alias("shard")
    read = read.withColumn("known", F.lit(None).cast("array<int>")).unionByName(near)
    read = stored(beside(read, parts, "lot", "parts").groupBy("id", "mark", shard).agg(F.max("known").alias("known")))
    owners = recurring.groupBy(F.col("oid").alias("id"), F.col("omark").alias("mark"), "lot", "deal").agg(F.collect_list("k").alias("ks"))
    owners = beside(owners, parts, "lot", "parts").select("id", "mark", shard, "ks")
    split = read.groupBy("shard").count().where(F.col("count") > per_slot)
    split = split.select("shard", F.ceil(F.col("count") / per_slot).cast("int").alias("slots"))
    streams = beside(read, split, "shard", "slots").withColumn("slot", F.pmod(F.xxhash64("mark", "id"), F.col("slots")).cast("int"))
    sources = beside(owners, split, "shard", "slots").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)))
    names = ["id", "mark", "shard", "slot", "slots"]
    streams = streams.select(*names, F.lit(None).cast("array<bigint>").alias("ks"), "known", F.lit(True).alias("stream"))
    sources = sources.select(*names, "ks", F.lit(None).cast("array<int>").alias("known"), F.lit(False).alias("stream"))
    return streams.unionByName(sources).groupBy(*names).agg(*[F.max(c).alias(c) for c in ("ks", "known", "stream")])


def repeated_spans(once: DataFrame, *, shard_bytes: int = SHARD_BYTES, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(id, mark, spans): the word ranges (at, length) that each document of (id, mark, text) loses, if it loses any."""
    total, rows = once.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    shards = max(1, -(-(total or 0) // shard_bytes))
    per_slot = max(1, slot_bytes * max(1, rows) // max(1, total or 0))
    plan = routes(stored(seeds(once)), shards, per_slot)

    def packing():
        zip_ = zstandard.ZstdCompressor(level=3).compress
        return lambda part: [pa.array([zip_(t) for t in text_bytes(part.column("text"))], pa.binary())]

    packed = arrow_map(once, ["id", "mark"], "text", packing, [field("packed", T.BinaryType())])
    found = stored(found_rows(plan.join(packed, ["id", "mark"])))
    heads = found.where("k IS NOT NULL")
    place = F.struct("id", "mark", "at")
    best = heads.groupBy("k").agg(F.min(place).alias("best"), F.count("*").alias("n")).where("n > 1").select("k", "best")
    late = heads.join(best, "k").where(place != F.col("best"))
    spans = found.where("k IS NULL").drop("k").unionByName(late.select("id", "mark", "at", "length"))
    return spans.groupBy("id", "mark").agg(F.collect_list(F.struct("at", "length")).alias("spans"))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), shard_bytes: int = SHARD_BYTES, slot_bytes: int = SLOT_BYTES) -> DataFrame:
    """(id, carried columns, n_words, n_removed, kept_words, text): `text` keeps the blanks between kept
    words, kept_words has one blank each."""
    rows, once = marked(docs, id_col, text_col, carry)
    spans = repeated_spans(once, shard_bytes=shard_bytes, slot_bytes=slot_bytes)
    joined = rows.join(merging(spans), ["id", "mark"], "left").select("id", "rest", "text", "spans")

    def kernel():
        def work(part):
            texts, marks = text_bytes(part.column("text")), []
            for t, found in zip(texts, part.column("spans").to_pylist(), strict=True):
                edges = np.zeros(len(t.split()) + 1, np.int64)
                for s in found or ():
                    edges[s["at"]] += 1
                    edges[s["at"] + s["length"]] -= 1
                marks.append(np.cumsum(edges[:-1]) > 0)
            kept = [b" ".join([w for w, g in zip(t.split(), m.tolist(), strict=True) if not g]) for t, m in zip(texts, marks, strict=True)]
            left = [cut(t, m) if m.any() else t for t, m in zip(texts, marks, strict=True)]
            numbers = [pa.array([len(m) for m in marks], pa.int64()), pa.array([int(m.sum()) for m in marks], pa.int64())]
            return [*numbers, *(pa.array(x, pa.binary()).cast(pa.string()) for x in (kept, left))]

        return work

    fields = [field("n_words", T.LongType()), field("n_removed", T.LongType()), field("kept_words", T.StringType()), field("left", T.StringType())]
    out = arrow_map(joined, ["id", "rest"], "text", kernel, fields, more=["spans"])
    return out.select(F.col("id").alias(id_col), *[F.col("rest").getField(c).alias(c) for c in carry], "n_words", "n_removed", "kept_words", F.col("left").alias("text"))
