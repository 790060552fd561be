"""Conversation structure repair: the cheapest edits that give a conversation its turn order.

A row is blank, a duplicate, truncated or sound; a repaired conversation is
empty or has user and assistant in turn, after one system row at most. Edits:
Keep 0, Rerole to user or assistant 3, Delete 4, Insert an empty user or
assistant row 3; blank rows and duplicates must go, a truncated row that stays
costs 3 more. Of the cheapest edits those whose initials come first in ASCII
order are taken.

Search: A* on the edit lattice, whose nodes are (rows done, state of the turn
order). The heuristic is the suffix sum of deletions that are mandatory (4) and
of charges for truncation that no edit avoids (3); it never exceeds the rest of
a path, so the first visit of a node is its best. The queue is keyed (cost plus
heuristic, audit), so ties fall to the least audit. An insertion is written
with the edit of the row that follows it, so no audit of a row's edits is the
beginning of another and audits of one length in rows compare piece by piece.

Segments: a long conversation is searched a segment at a time, from each state
that it can be entered in to each that it can be left in. Costs and ranks of
audits between states are folded over the segments in order, a few bytes each,
which is exact by the property above; the chosen audits are then applied to the
segments side by side.

Defined results: null roles and texts count as one blank; a role's initial is
its first character, and an empty role fits nowhere; rows are taken by turn,
nulls first, then role, then text; equal rows stand side by side and all but
the first are duplicates; rows without an id are one conversation; turns are
whole numbers; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from heapq import heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import col, field, join_groups
from veilframe.llm.turns import SEGMENT_BYTES, SEGMENT_ROWS, arrow_rows, counted, folded, segments

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
STATES = (START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT)
#: The role that has to follow in each state, and the state after it; a system row may only open a conversation.
FOLLOWS = {START: ("user", AFTER_USER), AFTER_SYSTEM: ("user", AFTER_USER), AFTER_USER: ("assistant", AFTER_ASSISTANT), AFTER_ASSISTANT: ("user", AFTER_USER)}
#: Insertions that close a conversation.
CLOSING = {START: "", AFTER_SYSTEM: "II", AFTER_USER: "I", AFTER_ASSISTANT: ""}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}


def after_keeping(state: int, initial: str) -> int | None:
    role, then = FOLLOWS[state]
    if initial == role[0]:
        return then
    return AFTER_SYSTEM if initial == "s" and state == START else None


def moves(state: int, initial: str, fault: str):
    """(edits, cost, state after) of one row, insertions before it included.

    A deletion stands before insertions: the same cost, and its letter comes first.
    """
    yield "D", DELETE, state
    if fault in ("blank", "duplicate"):
        return
    stays = TRUNCATED if fault == "truncated" else 0
    for inserted in range(3):
        role, then = FOLLOWS[state]
        before, cost = "I" * inserted, INSERT * inserted + stays
        if (kept := after_keeping(state, initial)) is not None:
            yield before + "K", cost, kept
        yield before + "R", cost + REROLE, then
        state = then


def search(rows: list[tuple[str, str]], entry: int) -> dict[int, tuple[int, str]]:
    """State at the end: (cost, audit), the cheapest and then the least, of rows (initial, fault) entered in `entry`."""
    rest = [0]
    for _, fault in reversed(rows):
        rest.append(rest[-1] + {"blank": DELETE, "duplicate": DELETE, "truncated": min(TRUNCATED, DELETE)}.get(fault, 0))
    rest.reverse()
    heap, closed, found = [(rest[0], "", 0, entry)], set(), {}
    while heap and len(found) < len(STATES):
        key, audit, i, state = heappop(heap)
        if (i, state) in closed:
            continue
        closed.add((i, state))
        if i == len(rows):
            found[state] = (key, audit)
            continue
        for edits, cost, then in moves(state, *rows[i]):
            if (i + 1, then) not in closed:
                heappush(heap, (key - rest[i] + cost + rest[i + 1], audit + edits, i + 1, then))
    return found


class Choice:
    """Costs and the order of audits by state, carried over a conversation's segments; then the way back."""

    def __init__(self):
        self.cost, self.order = {START: 0}, [START]
        self.where = array("q")
        self.back = bytearray()

    def add(self, row: dict) -> None:
        best: dict[int, tuple[int, int, int, int]] = {}
        for m in row["matrix"]:
            if m["entry"] in self.cost:
                key = (self.cost[m["entry"]] + m["cost"], self.order.index(m["entry"]), m["rank"], m["entry"])
                best[m["exit"]] = min(key, best.get(m["exit"], key))
        self.cost = {x: k[0] for x, k in best.items()}
        self.order = sorted(best, key=lambda x: best[x][1:3])
        self.where.extend((row["part"], row["seg"]))
        self.back += bytes(best[x][3] if x in best else 0 for x in STATES)

    def rows(self):
        left = min(self.cost, key=lambda x: (self.cost[x] + INSERT * len(CLOSING[x]), self.order.index(x)))
        total, closing = self.cost[left] + INSERT * len(CLOSING[left]), CLOSING[left]
        for i in range(len(self.where) // 2 - 1, -1, -1):
            entry = self.back[4 * i + left]
            part, seg = self.where[2 * i : 2 * i + 2]
            yield {"part": part, "seg": seg, "entry": entry, "exit": left, "closing": closing, "cost": total}
            left, closing, total = entry, "", 0


def faulty(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, n, fault, again): distinct rows with the first copy's fault, and whether its role and text were seen in an earlier turn."""
    rows = counted(turns, id_col, turn_col, role_col, text_col, " ")
    said = F.sha2(F.concat(F.coalesce(F.col("conv").cast("string"), F.lit("-")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    rows = rows.withColumn("said", said)
    # A struct of the turn, as its null is the least.
    first = rows.groupBy("said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("sayings"))
    rows = join_groups(rows, first, ["said"], "sayings", ["turn"])
    text, spaces = F.col("text"), r"[\x20\x09-\x0D]"
    fault = (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(~F.col("first.turn").eqNullSafe(F.col("turn")), "duplicate").when(~text.rlike(rf"[.!?]{spaces}*\z"), "truncated").otherwise("")
    )
    return rows.select("conv", "turn", "role", "text", "n", fault.alias("fault"))


MATRIX = T.ArrayType(T.StructType([field("entry", T.IntegerType()), field("exit", T.IntegerType()), field("cost", T.LongType()), field("rank", T.IntegerType()), field("audit", T.StringType())]))
EDITS = T.ArrayType(T.StructType([field("edit", T.StringType()), field("turn", T.LongType()), field("role", T.StringType()), field("text", T.StringType()), field("fault", T.StringType())]))


def first_faults(turns: list[dict]) -> list[tuple[str, str]]:
    """(initial, fault) of each row; later copies of a row are duplicates."""
    return [(t["role"][:1], "duplicate" if t["copy"] and t["fault"] != "blank" else t["fault"]) for t in turns]


def matrix(turns: list[dict], opens: bool) -> list[dict]:
    rows, out = first_faults(turns), []
    for entry in (START,) if opens else STATES:
        found = search(rows, entry)
        for rank, x in enumerate(sorted(found, key=lambda x: found[x][1])):
            out.append({"entry": entry, "exit": x, "cost": found[x][0], "rank": rank, "audit": found[x][1]})
    return out


def applied(turns: list[dict], entry: int, audit: str) -> list[dict]:
    """Each letter of the audit with the row that it leaves; a deleted row's role and text are the old ones."""
    out, state, at, faults = [], entry, 0, first_faults(turns)
    for edit in audit:
        role, then = FOLLOWS[state]
        if edit == "I":
            out.append({"edit": edit, "turn": None, "role": role, "text": "", "fault": ""})
            state = then
            continue
        t = turns[at]
        initial, fault = faults[at]
        at += 1
        out.append({"edit": edit, "turn": t["turn"], "role": role if edit == "R" else t["role"], "text": t["text"], "fault": fault})
        if edit != "D":
            state = then if edit == "R" else after_keeping(state, initial)
    return out


def repair(
    turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """(conv, part, seg, cost, audit, edits, turns): segments in order, with the edits of their rows; cost is the conversation's, on its last segment."""
    rows = faulty(turns, id_col, turn_col, role_col, text_col)
    searched = segments(rows, ("fault",), also=(field("matrix", MATRIX), matrix), size=segment_rows, size_bytes=segment_bytes)
    narrow = searched.select("conv", "part", "seg", F.transform("matrix", lambda m: m.dropFields("audit")).alias("matrix"))
    kinds = {"part": T.IntegerType(), "seg": T.LongType(), "entry": T.IntegerType(), "exit": T.IntegerType(), "closing": T.StringType(), "cost": T.LongType()}
    chosen = folded(narrow, T.StructType([field(k, t) for k, t in kinds.items()]), Choice)
    own = F.filter("matrix", lambda m: (m["entry"] == F.col("entry")) & (m["exit"] == F.col("exit")))[0]["audit"]
    joined = searched.join(chosen, ["part", "seg"]).select("conv", "part", "seg", "entry", "cost", F.concat(own, "closing").alias("audit"), "turns")

    def edit(rows):
        for r in rows:
            yield {k: v for k, v in r.items() if k != "entry"} | {"edits": applied(r["turns"], r["entry"], r["audit"])}

    schema = T.StructType([f for f in joined.schema if f.name != "entry"] + [field("edits", EDITS)])
    return arrow_rows(joined, schema, edit)


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """(conv, part, seg, at, edit, turn, role, text): the rows that are left, in the order of (part, seg, at)."""
    rows = repaired.select("conv", "part", "seg", F.posexplode("edits").alias("at", "e"))
    return rows.select("conv", "part", "seg", "at", "e.edit", "e.turn", "e.role", "e.text").where("edit <> 'D'")


class Summary:
    """What a conversation's segments come to, added up in order."""

    def __init__(self):
        self.conv, self.hash, self.some, self.audit = None, hashlib.sha256(), False, []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0)
        self.least = self.last = self.initial = None
        self.distinct = 0

    def add(self, r: dict) -> None:
        self.conv = r["conv"]
        for k in ("blank", "duplicate", "truncated", "illegal", "cost"):
            self.counts[k] += r[k]
        self.counts["illegal"] += self.initial is not None and self.initial + r["first_initial"] not in LEGAL
        self.initial = r["last_initial"]
        if r["least"] is not None:
            self.distinct += r["distinct"] - (r["least"] == self.last)
            self.least = r["least"] if self.least is None else self.least
            self.last = r["most"]
        self.audit.append(r["audit"])
        if r["left"] is not None:
            self.hash.update(("\n" * self.some + r["left"]).encode("utf-8", "surrogatepass"))
            self.some = True

    def rows(self):
        gaps = self.last - self.least + 1 - self.distinct if self.least is not None else 0
        yield {"conv": self.conv, "gaps": gaps, **self.counts, "audit": "".join(self.audit), "repaired_sha256": self.hash.hexdigest()}


SUMMARY = {k: T.LongType() for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")} | {"audit": T.StringType(), "repaired_sha256": T.StringType()}


def summaries(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation with rows.

    A segment is counted where it is; a conversation's digest needs its rows in order, so its segments are streamed.
    """
    left = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    fault = lambda k: F.size(F.filter("edits", lambda e: e["fault"] == k)).cast("long").alias(k)
    initials = F.transform("turns", lambda t: F.substring(t["role"], 1, 1))
    pairs = F.transform(F.slice(initials, 2, F.size(initials)), lambda x, i: F.concat(F.get(initials, i), x))
    known = F.filter(F.transform("turns", lambda t: t["turn"]), lambda t: t.isNotNull())
    segment = repaired.select(
        "conv", "part", "seg", "audit", F.coalesce("cost", F.lit(0)).alias("cost"),
        *map(fault, ("blank", "duplicate", "truncated")),
        F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long").alias("illegal"),
        F.get(initials, F.lit(0)).alias("first_initial"), F.element_at(initials, -1).alias("last_initial"),
        F.array_min(known).alias("least"), F.array_max(known).alias("most"), F.size(F.array_distinct(known)).cast("long").alias("distinct"),
        F.when(F.size(left) > 0, F.array_join(left, "\n")).alias("left"),
    )
    conv = repaired.schema["conv"]
    return folded(segment, T.StructType([conv, *[field(k, t) for k, t in SUMMARY.items()]]), Summary)


def report(turns: DataFrame, ids: DataFrame | None = None, *, id_col: str = "conv_id", **options) -> DataFrame:
    """The summary of every conversation of `turns`, and of those of `ids` that have no rows."""
    out = summaries(repair(turns, id_col=id_col, **options))
    if ids is None:
        return out.withColumnRenamed("conv", id_col)
    every = ids.select(col(id_col).alias("own")).distinct()
    joined = every.join(out, F.col("own").eqNullSafe(F.col("conv")), "left")
    empty = {k: F.lit(0) for k in SUMMARY} | {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256().hexdigest())}
    return joined.select(F.col("own").alias(id_col), *[F.coalesce(F.col(k), empty[k]).alias(k) for k in SUMMARY])


def damaged(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns with faults planted by a hash of (conversation, turn): of 20 rows one is dropped, one emptied, one loses its sentence ends, one is repeated, one becomes the user's."""
    word = lambda c: F.coalesce(col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(word(id_col), F.lit(":"), word(turn_col)).cast("binary")) % 20
    rows = turns.select(col(id_col), col(turn_col), word(role_col).alias(role_col), word(text_col).alias(text_col), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace(col(text_col), "[.!?]", "")).otherwise(col(text_col))
    role = F.when(F.col("_kind") == 4, "user").otherwise(col(role_col))
    times = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select(col(id_col), col(turn_col), role.alias(role_col), text.alias(text_col), times.alias("_time")).drop("_time")
