"""Vector code compression: product codes from codebooks refined by Yinyang Lloyd.

Vectors become integers and are cut into equal parts; each part position has a
codebook, and a vector's code is the index of the nearest entry in each. Every
comparison that decides is made on integers.

Rounds: the first assignment compares all entries and leaves with each part an
upper bound of the distance to its own entry and, for each group of entries, a
lower bound of the distance to the others there. Groups are clusters of the
first codebook's entries. When entries move, the upper bound grows by the own
entry's drift and a group's lower bound falls by the largest drift in it. Only
where some group's bound falls to the upper bound is the own distance made
exact, and only groups whose bound still fails are scanned. Bounds carry a
margin over rounding and a group is passed over only if all of it is strictly
farther, so an entry at the same distance is always compared, in integers, and
ties go to the lower index.

Spark: the first assignment is stored as one table; a round sends only sums and
counts of its tasks, one row an entry, to a grouped sum, so the driver gets
`parts * entries` rows whatever the input. Later rounds repeat the bounded steps
over the stored table, which cost far less than writing all bounds again.

Defined results: rows whose vector is null or holds a null or a component that
is not finite are dropped. The vector length is that of the least id whose kept
vector can be cut into `parts`; kept rows of another length, or with a component
of 2**27 or more after scaling, fit no codebook: they stay, with null code and
error. Equal ids are rows of their own, in the order of their vectors; rows
without an id come last; fewer rows than `entries` give smaller codebooks; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import begin, col, end, field, join_groups, ship, stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
GROUP = 10
#: Components stay under this after scaling, so squared distances fit 64 bits.
MOST = 1 << 27
#: What a bound may be off by: 32-bit floats hold it with 2**-24 of its value.
MARGIN = 1e-6


@dataclass
class Move:
    """Codebooks after a round and how far each entry has come, up to rounding."""

    entries: np.ndarray  # parts, entries, width
    drift: np.ndarray  # parts, entries


def groups_of(entries: np.ndarray, per_group: int = GROUP, rounds: int = 5) -> np.ndarray:
    """A group for each entry: clusters of the entries of a part, at least one."""
    parts, k, _ = entries.shape
    n = max(1, k // per_group)
    out = np.zeros((parts, k), np.int64)
    for p in range(parts):
        points = entries[p].astype(float)
        centres = points[np.linspace(0, k - 1, n).astype(int)]
        for _ in range(rounds):
            out[p] = ((points[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([points[out[p] == g].mean(0) if (out[p] == g).any() else centres[g] for g in range(n)])
    return out


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of (n, width) integers to (k, width) entries."""
    return ((x[:, None] - entries[None]) ** 2).sum(2)


def lower(roots: np.ndarray) -> np.ndarray:
    return (roots * (1 - MARGIN) - MARGIN).astype(np.float32)


def upper(roots: np.ndarray) -> np.ndarray:
    return (roots * (1 + MARGIN) + MARGIN).astype(np.float32)


def least_in_groups(roots: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    out = np.full((len(roots), n), np.inf)
    for g in range(n):
        if (group == g).any():
            out[:, g] = roots[:, group == g].min(1)
    return out


def first_assignment(x: np.ndarray, entries: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own, near, far) of (n, parts, width): the entry of each part, the bound of its distance and of each group's others."""
    n, parts, _ = x.shape
    own, near = np.zeros((n, parts), np.uint8), np.zeros((n, parts), np.float32)
    far = np.zeros((n, parts, int(group.max()) + 1), np.float32)
    for p in range(parts):
        d = squares(x[:, p], entries[p])
        own[:, p] = a = d.argmin(1)
        roots = np.sqrt(d.astype(float))
        near[:, p] = upper(roots[np.arange(n), a])
        roots[np.arange(n), a] = np.inf
        far[:, p] = lower(least_in_groups(roots, group[p], far.shape[2]))
    return own, near, far


def reassign(x: np.ndarray, own: np.ndarray, near: np.ndarray, far: np.ndarray, move: Move, group: np.ndarray) -> int:
    """Bring (own, near, far) to the moved entries, in place; gives the number of distances computed."""
    asked = 0
    for p in range(x.shape[1]):
        entries, drift, g = move.entries[p], move.drift[p], group[p]
        most = np.array([drift[g == i].max(initial=0) for i in range(far.shape[2])])
        near[:, p] = upper(near[:, p] + drift[own[:, p]])
        far[:, p] = lower(far[:, p] - most)
        rows = np.nonzero(far[:, p].min(1) <= near[:, p])[0]
        if not len(rows):
            continue
        old = own[rows, p].astype(np.int64)
        best = ((x[rows, p] - entries[old]) ** 2).sum(1)
        asked += len(rows)
        tight = upper(np.sqrt(best.astype(float)))
        near[rows, p] = tight
        chosen, first = old.copy(), best.copy()
        scanned = far[rows, p] <= tight[:, None]
        found: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i in range(far.shape[2]):
            here, members = np.nonzero(scanned[:, i])[0], np.nonzero(g == i)[0]
            if not len(here) or not len(members):
                continue
            d = squares(x[rows[here], p], entries[members])
            asked += d.size
            at = d.argmin(1)
            value, index = d[np.arange(len(here)), at], members[at]
            better = (value < best[here]) | ((value == best[here]) & (index < chosen[here]))
            best[here[better]], chosen[here[better]] = value[better], index[better]
            found.append((i, here, members, d))
        for i, here, members, d in found:
            roots = np.sqrt(d.astype(float))
            roots[members[None] == chosen[here][:, None]] = np.inf
            far[rows[here], p, i] = lower(roots.min(1))
        # An entry that is left counts among the others of its group from now on.
        left = np.nonzero(chosen != old)[0]
        at = (rows[left], p, g[old[left]])
        far[at] = np.minimum(far[at], lower(np.sqrt(first[left].astype(float))))
        own[rows, p] = chosen
        near[rows, p] = upper(np.sqrt(best.astype(float)))
    return asked


def distances(x: np.ndarray, own: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of each part to its own entry."""
    return ((x - entries[np.arange(x.shape[1]), own]) ** 2).sum(2)


def tallies(x: np.ndarray, own: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    for p in range(x.shape[1]):
        np.add.at(sums[p], own[:, p], x[:, p])
        counts[p] += np.bincount(own[:, p], minlength=counts.shape[1])


class State:
    """Arrow batches of the stored table as arrays."""

    names = ("vector", "own", "near", "far")

    def __init__(self, shape: tuple[int, int], n_groups: int):
        self.parts, self.width, self.n_groups = *shape, n_groups

    def load(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        own = lambda name, kind: np.frombuffer(b"".join(batch.column(name).to_pylist()), kind)
        n = batch.num_rows
        return (
            own("vector", np.int32).reshape(n, self.parts, self.width).astype(np.int64), own("own", np.uint8).reshape(n, self.parts).copy(),
            own("near", np.float32).reshape(n, self.parts).copy(), own("far", np.float32).reshape(n, self.parts, self.n_groups).copy(),
        )

    @staticmethod
    def pack(array: np.ndarray) -> pa.Array:
        return pa.array([row.tobytes() for row in array], pa.binary())


@dataclass
class Codes:
    """Rows (id, label, code, error) and the codebooks (parts, entries, width)."""

    rows: DataFrame
    codebooks: np.ndarray

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, vector, fits): finite vectors, scaled and floored; `fits` is false where a component is too large."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    rows = vectors.select(col(id_col).alias("id"), col(label_col).alias("label"), col(vector_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("vector").isNotNull() & F.forall("vector", finite))
    whole = F.transform("vector", lambda x: F.floor(x * float(scale)))
    fits = F.forall("vector", lambda x: F.abs(x * float(scale)) < MOST - 1)
    return rows.select("id", "label", F.when(fits, whole.cast("array<int>")).alias("vector"))


def first_codebooks(rows: DataFrame, parts: int, entries: int) -> np.ndarray | None:
    """Those of the least ids; the length is that of the first, the same for all."""
    able = rows.where((F.size("vector") > 0) & (F.size("vector") % parts == 0))
    order = [F.col("id").asc_nulls_last(), F.col("vector")]
    first = able.orderBy(*order).select("vector").first()
    if first is None:
        return None
    length = len(first[0])
    chosen = able.where(F.size("vector") == length).orderBy(*order).limit(entries).select("vector").collect()
    return np.array([r[0] for r in chosen], np.int64).reshape(len(chosen), parts, length // parts).transpose(1, 0, 2)


def grouped_sums(state: DataFrame, shape: tuple[int, int, int], stepper) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts of the parts of each entry, added up in the tasks first."""
    parts, k, width = shape
    schema = T.StructType([field("part", T.IntegerType()), field("entry", T.IntegerType()), field("n", T.LongType()), *[field(f"s{i}", T.LongType()) for i in range(width)]])

    def run(batches):
        begin("codes")
        sums, counts = np.zeros(shape, np.int64), np.zeros((parts, k), np.int64)
        step = stepper()
        for batch in batches:
            if batch.num_rows:
                x, own = step(batch)[:2]
                tallies(x, own, sums, counts)
        p, e = np.nonzero(counts)
        columns = [p.astype(np.int32), e.astype(np.int32), counts[p, e], *[sums[p, e, i] for i in range(width)]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=schema.names)
        end()

    sums, counts = np.zeros(shape, np.int64), np.zeros((parts, k), np.int64)
    names = schema.names[2:]
    for r in state.mapInArrow(run, schema).groupBy("part", "entry").agg(*[F.sum(c).alias(c) for c in names]).collect():
        counts[r["part"], r["entry"]] = r["n"]
        sums[r["part"], r["entry"]] = [r[c] for c in names[1:]]
    return sums, counts


def encode(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Codes:
    """Refine the codebooks for `rounds` and assign every part a last time."""
    if not 0 < entries <= 256:
        raise ValueError("an index has two hex digits")
    spark = vectors.sparkSession
    ship(spark)
    rows = kept(vectors, id_col, vector_col, label_col, scale)
    start = first_codebooks(rows, parts, entries)
    if start is None:
        return Codes(rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64))
    shape = start.shape
    width, group = shape[2], groups_of(start)
    fitting = F.size("vector") == parts * width
    layout = State((parts, width), int(group.max()) + 1)
    shared = spark.sparkContext.broadcast((start, group))
    schema = T.StructType([rows.schema["id"], rows.schema["label"], *[field(c, T.BinaryType()) for c in State.names]])

    def assign(batches):
        begin("codes")
        first, of = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, parts, width)
            own, near, far = first_assignment(x.astype(np.int64), first, of)
            packed = [layout.pack(a.reshape(b.num_rows, -1)) for a in (x.astype(np.int32), own, near, far)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), *packed], names=schema.names)
        end()

    state = stored(rows.where(fitting).mapInArrow(assign, schema))
    moves: list[Move] = []

    def stepper(done: list[Move]):
        sent = spark.sparkContext.broadcast((done, group))

        def build():
            def step(batch):
                x, own, near, far = layout.load(batch)
                for m in sent.value[0]:
                    reassign(x, own, near, far, m, sent.value[1])
                return x, own

            return step

        return build

    now = start
    for _ in range(rounds):
        sums, counts = grouped_sums(state, shape, stepper(list(moves)))
        then = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], now)
        moves.append(Move(then, upper(np.sqrt(((then - now) ** 2).sum(2).astype(float))).astype(float)))
        now = then
    step_all, last = stepper(moves), spark.sparkContext.broadcast(now)
    out = T.StructType([rows.schema["id"], rows.schema["label"], field("code", T.StringType()), field("error", T.LongType())])

    def finish(batches):
        begin("codes")
        step = step_all()
        for b in batches:
            if b.num_rows:
                x, own = step(b)
                error = distances(x, own, last.value).sum(1)
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in own], pa.string()), pa.array(error)], names=out.names)
        end()

    other = rows.where(F.col("vector").isNull() | ~fitting).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return Codes(state.mapInArrow(finish, out).unionByName(other), now)


def decode(codes: DataFrame, codebooks: np.ndarray, *, code_col: str = "code", scale: int = SCALE, to: str = "decoded") -> DataFrame:
    """The vectors that the codes stand for, at the lower end of each component's step; null for a null code."""
    ship(codes.sparkSession)
    shared = codes.sparkSession.sparkContext.broadcast(codebooks)
    schema = T.StructType([*codes.schema.fields, field(to, T.ArrayType(T.DoubleType()))])

    def run(batches):
        for b in batches:
            made = []
            for code in b.column(code_col).to_pylist():
                own = None if code is None else np.frombuffer(bytes.fromhex(code), np.uint8)
                made.append(None if own is None else (shared.value[np.arange(len(own)), own].ravel() / scale).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.float64()))], names=schema.names)

    return codes.mapInArrow(run, schema)


def label_errors(codes: Codes) -> DataFrame:
    """(id, label, code, error, label_error): the errors added up over equal labels, nulls together, and given back to their rows."""
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("-"))
    rows = codes.rows.withColumn("key", key)
    sums = rows.groupBy("key").agg(F.sum("error").alias("label_error"), F.count("*").alias("n"))
    return join_groups(rows, sums, ["key"], "n", ["id", "code"]).drop("key", "n")
