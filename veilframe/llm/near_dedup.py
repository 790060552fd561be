"""Near-duplicate groups: fast similarity sketching, banding and exact verification.

Sketch: in round i every shingle of a set is hashed into one of `T` bins and
offers its hash; a bin keeps the least offer of the first round that reaches
it. Rounds go on until every bin is filled, and from round `T` on round i fills
bin i - T with the whole set, so every coordinate fills. The agreement of two
sketches is concentrated about the Jaccard similarity as with one independent
hash a coordinate.

Documents of one shingle set form a class, whose least document stands for it.
Bands of `ROWS` of the first coordinates are the buckets. Each member of a
bucket is paired with the bucket's least one and verified on both full sets;
pairs that pass are links. Where a bucket then still spans several components,
its members outside the bucket's largest component meet all its members, in
blocks of bounded size that compare whole sketches: pairs of different
components that the sketches put no more than `SLACK` under the threshold are
verified too. So copies and near copies cost one pair each, no bucket is cut
short and blocks emit no pair that has no chance. What a bucket can lose is a
link that its sketches put further under the threshold than `SLACK`.

A pair of similarity 0.75 misses all 32 bands of 4 with a chance of about
(1 - 0.75**4)**32 = 5e-6, and `SLACK` is four deviations of the estimate.

Components come from alternating large-star and small-star steps over links,
each step a grouped minimum and a join, checkpointed.

Defined results: rows without words or text have 0 shingles and a component of
their own; a row without id has component null, links to nothing and is kept;
rows that repeat an id get the component of their own text's class each, and
count as one document where links are concerned (`keep_one` takes each text of a
repeated id as a document of its own); an empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from veilframe.llm import common
from veilframe.llm.common import FAN, arrow_map, begin, checkpoint, col, end, field, join_groups, ship, stored, text_bytes
from veilframe.llm.shingles import LOWER, WORDS, mix, shingle_sets

T = 512
ROWS = 4
BANDS = 32
SHINGLE = 5
PERCENT = 75
#: Sketches estimate a similarity of 0.75 with a deviation of (0.75 * 0.25 / T) ** 0.5 = 0.019.
SLACK = 0.077
#: Members of a bucket that a block compares, on either side, and rows that a task gets to build blocks from.
BLOCK = 1024
SLOT_ROWS = 4096
#: Pairs of one least document that a part gets.
HEAD_PAIRS = 512


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """A row of T coordinates of 16 bits for each set; empty sets give zeros."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    none = np.iinfo(np.uint64).max
    bins = np.full((len(sets), T), none, np.uint64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    for i in range(2 * T):
        if not len(values):
            break
        h = mix(values ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        at = h % np.uint64(T) if i < T else np.full(len(h), i - T, np.uint64)
        offer = (np.uint64(i) << np.uint64(54)) | (h >> np.uint64(10))  # 10 bits for rounds up to 2 * T - 1
        np.minimum.at(bins.reshape(-1), owner * T + at.astype(np.int64), offer)
        open_ = (bins == none).any(axis=1)[owner]
        values, owner = values[open_], owner[open_]
    out = (mix(bins) & np.uint64(0xFFFF)).astype(np.uint16)
    out[sizes == 0] = 0
    return out


def sets_of(texts: list[bytes], width: int = SHINGLE) -> list[np.ndarray]:
    return shingle_sets(*WORDS.of([t.translate(LOWER).split() for t in texts]), width)


def describe(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, set_id, bands, fine): set_id is a 128-bit hash of the whole set; bands, the first coordinates, and
    fine, a byte of each other one, are null without a set."""

    def kernel():
        def work(part):
            sets = sets_of(text_bytes(part.column(text_col)))
            sketch = sketches(sets)
            bands = np.ascontiguousarray(sketch[:, : BANDS * ROWS]).view(np.int64)
            fine = sketch[:, BANDS * ROWS :].astype(np.uint8)
            full = [len(s) > 0 for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([b.tolist() if x else None for b, x in zip(bands, full, strict=True)], pa.list_(pa.int64())),
                pa.array([f.tobytes() if x else None for f, x in zip(fine, full, strict=True)], pa.binary()),
            ]

        return work

    fields = [field("n_shingles", T_.LongType()), field("set_id", T_.BinaryType()), field("bands", T_.ArrayType(T_.LongType())), field("fine", T_.BinaryType())]
    return arrow_map(docs, [id_col], text_col, kernel, fields, limit=2 << 20, owner="words").withColumnRenamed(id_col, "doc_id")


def turned(pairs: DataFrame) -> DataFrame:
    """The pairs, with sides changed where only `b` is in more than `HEAD_PAIRS` of them."""
    hot = lambda c: pairs.groupBy(c).count().where(F.col("count") > HEAD_PAIRS).select(F.col(c).alias(f"hot_{c}"))
    seconds = stored(hot("b"))
    if seconds.isEmpty():
        return pairs
    known = pairs.join(seconds, F.col("b") == F.col("hot_b"), "left").join(stored(hot("a")), F.col("a") == F.col("hot_a"), "left")
    turn = F.col("hot_b").isNotNull() & F.col("hot_a").isNull()
    return known.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("b"))


def verify(pairs: DataFrame, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Those pairs (a, b) whose full sets reach the threshold, either side first. The text of one side joins at a time.

    A document of more than `HEAD_PAIRS` pairs, as the least of a large group or one that many others meet, stands in them
    as `a`; such pairs are dealt into parts, each with a copy of its text, so no task gets the texts of a whole group.
    """
    ship(docs.sparkSession)
    pairs = turned(pairs)
    # Only texts of the pairs are dealt out: few ids reach all scans as a table of known size, many join where the texts go anyway.
    wanted = stored(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).where(F.col("id").isNotNull()).join(wanted, "id", "left_semi")
    many = pairs.groupBy("a").count().where(F.col("count") > HEAD_PAIRS)
    # A table of known size, so that the join with all texts shuffles them only if it is large.
    many = stored(many.select(F.col("a").alias("many"), F.ceil(F.col("count") / HEAD_PAIRS).cast("int").alias("parts"), F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("fan")))
    other = texts.withColumnsRenamed({"id": "b", "text": "tb"})
    names = ["a", "b", "ta", "tb"]
    if many.isEmpty():
        few, split = pairs, None
    else:
        fan = F.pmod(F.xxhash64("b"), F.lit(FAN)).cast("int")
        placed = pairs.join(many, (F.col("a") == F.col("many")) & (fan == F.col("fan")), "left")
        few = placed.where("parts IS NULL").select("a", "b")
        split = placed.where("parts IS NOT NULL").select("a", "b", F.pmod(F.xxhash64(F.lit(1), "b"), "parts").cast("int").alias("part"))
    # Both sides of the pairs read one exchange of the texts by id.
    both = few.join(other, "b").join(texts.withColumnsRenamed({"id": "a", "text": "ta"}), "a").select(*names)
    if split is not None:
        heads = texts.join(many.where("fan = 0").select("many", "parts"), F.col("id") == F.col("many"))
        heads = heads.select(F.col("id").alias("a"), F.col("text").alias("ta"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        both = both.unionByName(split.join(other, "b").join(heads, ["a", "part"]).select(*names))
    schema = T_.StructType([pairs.schema["a"], pairs.schema["b"]])

    def run(batches):
        begin("words")
        last, own = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                left, right = text_bytes(part.column("ta")), text_bytes(part.column("tb"))
                keep = []
                for x, s in zip(left, sets_of(right), strict=True):
                    if x != last:
                        last, own = x, sets_of([x])[0]
                    common = len(np.intersect1d(own, s, assume_unique=True))
                    keep.append(100 * common >= PERCENT * (len(own) + len(s) - common) > 0)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
        end()

    return both.mapInArrow(run, schema).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): the least node that it reaches."""
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    state, total = None, edges.count()
    while True:
        # A hub has an edge to each node of its component, so both joins deal out its edges, if there are as many at all.
        meet = join_groups if total > common.HEAVY_ROWS else lambda rows, groups, on, *_: rows.join(groups, on)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = meet(both.where("v > u"), least, ["u"], "n", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = meet(large, low, ["u"], "n", ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpoint(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state, total = now, now[0]
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))


def agreement(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The share of equal coordinates of every sketch (bands, fine) of x with every one of y."""
    out = np.zeros((len(x[0]), len(y[0])), np.int32)
    for a, b in zip(x, y, strict=True):
        step = max(1, (32 << 20) // max(1, b.nbytes))
        for i in range(0, len(a), step):
            out[i : i + step] += np.count_nonzero(a[i : i + step, None, :] == b[None], axis=2)
    return out / T


def order(id_):
    """What an id is sorted by: of a struct, its fields."""
    return tuple(id_.values()) if isinstance(id_, dict) else id_


def numbered(ids: list) -> np.ndarray:
    """A number for each distinct id."""
    seen: dict = {}
    return np.array([seen.setdefault(order(x), len(seen)) for x in ids], np.int64)


def chances(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) worth a verification from rows (slot, band, key, i, j, few, doc_id, part, bands, fine): blocks of a bucket.

    A pair is emitted in the first band that it shares only.
    """
    ship(rows.sparkSession)
    schema = T_.StructType([T_.StructField("a", rows.schema["doc_id"].dataType), T_.StructField("b", rows.schema["doc_id"].dataType)])

    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("band", "key", "i", "j")])
        n = table.num_rows
        where = np.stack([table.column(c).to_numpy() for c in ("band", "key", "i", "j")])
        cuts = np.concatenate([[0], np.nonzero((np.diff(where, axis=1) != 0).any(axis=0))[0] + 1, [n]])
        few = np.array(table.column("few").to_pylist(), bool)
        ids, part = table.column("doc_id").to_pylist(), numbered(table.column("part").to_pylist())
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(n, BANDS)
        fine = np.frombuffer(b"".join(table.column("fine").to_pylist()), np.uint8).reshape(n, T - BANDS * ROWS)
        coarse = bands.view(np.uint16).reshape(n, BANDS * ROWS)
        left, right = [], []
        for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            own = np.arange(start, end)
            x, y = own[few[start:end]], own[~few[start:end]]
            if not len(x) or not len(y):
                continue
            share = agreement((coarse[x], fine[x]), (coarse[y], fine[y]))
            p, q = np.nonzero((share >= PERCENT / 100 - SLACK) & (part[x][:, None] != part[y][None]))
            same = bands[x[p]] == bands[y[q]]
            new = same.argmax(axis=1) == where[0, start] if len(p) else np.zeros(0, bool)
            for u, v in zip(x[p[new]].tolist(), y[q[new]].tolist(), strict=True):
                u, v = sorted((ids[u], ids[v]), key=order)
                left.append(u)
                right.append(v)
        kind = table.schema.field("doc_id").type
        return pa.Table.from_arrays([pa.array(left, kind), pa.array(right, kind)], names=["a", "b"])

    return rows.groupBy("slot").applyInArrow(work, schema)


def links(docs: DataFrame, described: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, components): set_id to its least document and number of rows, and the component of each class that has links."""
    least = [F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("fine").alias("fine"), F.count("*").alias("copies")]
    classes = checkpoint(described.where("bands IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(*least))
    members = classes.select("doc_id", F.posexplode("bands").alias("band", "key"))
    buckets = stored(members.groupBy("band", "key").agg(F.min("doc_id").alias("head"), F.count("*").alias("n")).where("n > 1"))
    shared = checkpoint(join_groups(members, buckets, ["band", "key"], "n", ["doc_id"]))
    first = checkpoint(shared.where("doc_id <> head").select(F.col("head").alias("a"), F.col("doc_id").alias("b")).distinct())
    found = checkpoint(verify(first, docs, id_col=id_col, text_col=text_col))
    parts = components(found)
    # What the bucket heads leave open: buckets of three or more that span components.
    placed = shared.where("n > 2").join(parts, F.col("doc_id") == F.col("node"), "left").withColumn("part", F.coalesce("component", "doc_id"))
    sizes = placed.groupBy("band", "key", "part").agg(F.count("*").alias("size"))
    mixed = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "part"))["part"].alias("main"), F.count("*").alias("parts"), F.sum("size").alias("members"))
    mixed = stored(mixed.where("parts > 1"))
    placed = checkpoint(join_groups(placed, mixed, ["band", "key"], "members", ["doc_id"]).select("band", "key", "n", "doc_id", "part", "main"))
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    outside = placed.where("part <> main")
    few = outside.select("band", "key", own.alias("i"), every.alias("j"), F.lit(True).alias("few"), "doc_id", "part")
    # Members go to the blocks of the bucket that hold an outsider, and no others.
    held = outside.groupBy("band", "key").agg(F.collect_set(own).alias("held"), F.max("n").alias("all"))
    full = join_groups(placed, held, ["band", "key"], "all", ["doc_id"])
    full = full.select("band", "key", F.explode("held").alias("i"), own.alias("j"), F.lit(False).alias("few"), "doc_id", "part")
    slots = max(1, -(-2 * placed.count() // SLOT_ROWS))
    rows = few.unionByName(full).join(classes.select("doc_id", "bands", "fine"), "doc_id")
    rows = rows.withColumn("slot", F.pmod(F.xxhash64("band", "key", "i", "j"), F.lit(slots)))
    rest = checkpoint(chances(rows).distinct().join(first, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        found = found.unionByName(verify(rest, docs, id_col=id_col, text_col=text_col))
        parts = components(found)
    return classes.select("set_id", F.col("doc_id").alias("head"), "copies"), parts


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    described = checkpoint(describe(docs, id_col=id_col, text_col=text_col))
    classes, parts = links(docs, described, id_col=id_col, text_col=text_col)
    heads = classes.join(parts, F.col("head") == F.col("node"), "left").select("set_id", "copies", F.coalesce("component", "head").alias("component_id"))
    classed = F.col("bands").isNotNull() & F.col("doc_id").isNotNull()
    grouped = join_groups(described.where(classed).select("doc_id", "n_shingles", "set_id"), heads, ["set_id"], "copies", ["doc_id"])
    # Rows without set or id have no class to be joined with, however many they are.
    single = described.where(~classed).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    out = grouped.select("doc_id", "n_shingles", "component_id").unionByName(single)
    return out.select(F.col("doc_id").alias(id_col), "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", repeats: bool = True) -> DataFrame:
    """The rows of `docs`, all columns, that stay. Where an id repeats, each of its texts is a document of its own;
    of rows equal in id and text all stay, or one if `repeats` is false."""
    taken = set(map(str.lower, docs.columns))
    name, key = "gone_id", "row_key"
    while name in taken:
        name += "_"
    while key in taken:
        key += "_"
    again = checkpoint(docs.select(col(id_col).alias(name)).where(F.col(name).isNotNull()).groupBy(name).count().where("count > 1").select(name))
    if again.isEmpty():
        gone = near_duplicates(docs, id_col=id_col, text_col=text_col).where("NOT kept").select(col(id_col).alias(name)).distinct()
        return docs.join(gone, col(id_col) == F.col(name), "left_anti")
    mark = F.when(F.col(name).isNotNull(), F.xxhash64(F.coalesce(col(text_col), F.lit("")))).otherwise(F.lit(0).cast("long"))
    keyed = docs.join(again, col(id_col) == F.col(name), "left")
    keyed = keyed.withColumn(key, F.when(col(id_col).isNotNull(), F.struct(col(id_col).alias("id"), mark.alias("mark")))).drop(name)
    gone = near_duplicates(keyed, id_col=key, text_col=text_col).where("NOT kept").select(F.col(key).alias(name)).distinct()
    kept = keyed.join(gone, F.col(key) == F.col(name), "left_anti")
    if not repeats:
        many = F.coalesce(F.col(key)["mark"] != 0, F.lit(False))
        kept = kept.where(~many).unionByName(kept.where(many).dropDuplicates([key]))
    return kept.select(*[col(c) for c in docs.columns])
