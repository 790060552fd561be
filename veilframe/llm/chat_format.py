"""Chat formatting by a finite-state machine over roles and a declarative template.

A template names the control strings, the roles whose text is trained on and
the machine: which roles may follow in each state, and in which it may end. A
turn becomes text segments, each with its loss flag; only the text of a role
that is trained on has it, never the marks around it. A turn that the machine
does not allow is formatted as well and marked illegal: a known role takes the
machine to that role's state, an unknown one leaves it where it is.

Escapes: in texts and roles every `<`, backslashes and `|` get one backslash
more, so no control string can be read in them; in roles a backslash is doubled
before, and a line break becomes a backslash and n. Both are undone by `read`,
which gives back the turns and the trained text from the formatted text and its
loss spans alone.

A long conversation is cut into segments (see turns.py), which are formatted
side by side; the state that a segment is entered in is folded over them.

Defined results: a null text or role is empty; rows are taken by turn, nulls
first, then role, then text, equal rows one after another; rows without an id
are one conversation; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm.common import col
from veilframe.llm.common import field as column
from veilframe.llm.turns import SEGMENT_BYTES, SEGMENT_ROWS, counted, folded, segments

START = "start"


@dataclass(frozen=True)
class Template:
    """Control strings begin with `<|`, so the escapes keep them out of texts."""

    opening: str = "<|im_start|>"
    after_role: str = "\n"
    closing: str = "<|im_end|>"
    between: str = "\n"
    trained: tuple[str, ...] = ("assistant",)
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        if not (self.opening.startswith("<|") and self.closing.startswith("<|")):
            raise ValueError("control strings begin with <|")
        if self.after_role != "\n":
            raise ValueError("a role ends with its line")
        if not {r for rs in self.follows.values() for r in rs} <= set(self.follows) or not set(self.ends) <= set(self.follows):
            raise ValueError("every role of the machine is one of its states")


CHATML = Template()


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


class States:
    """The state that each segment is entered in; a segment is given when it is known whether it is the last."""

    def __init__(self):
        self.state, self.held = START, None

    def add(self, row: dict):
        if self.held:
            yield self.held | {"closes": False}
        self.held = {"part": row["part"], "seg": row["seg"], "entry": self.state}
        self.state = row["last_known"] or self.state

    def rows(self):
        yield self.held | {"closes": True}


def format_turns(
    turns: DataFrame, template: Template = CHATML, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    segment_rows: int = SEGMENT_ROWS, segment_bytes: int = SEGMENT_BYTES,
) -> DataFrame:
    """(conv, part, seg, at, turn, role, legal, ends, segments): each turn in the order of (part, seg, at) with its text segments and loss flags.

    `ends` is null but on a conversation's last turn, where it says whether the machine may end there.
    """
    rows = counted(turns, id_col, turn_col, role_col, text_col, "")
    cut = segments(rows, size=segment_rows, size_bytes=segment_bytes)
    known = F.filter(F.transform("turns", lambda t: t["role"]), lambda r: r.isin(*template.follows) & (r != START))
    narrow = cut.select("conv", "part", "seg", F.try_element_at(known, F.lit(-1)).alias("last_known"))
    schema = T.StructType([column("part", T.IntegerType()), column("seg", T.LongType()), column("entry", T.StringType()), column("closes", T.BooleanType())])
    entered = folded(narrow, schema, States)
    # The state before a turn is the last known role before it, so a segment's states are a running choice over its rows.
    is_state = lambda r: r.isin(*[s for s in template.follows if s != START])
    step = lambda states, t: F.concat(states, F.array(F.when(is_state(t["role"]), t["role"]).otherwise(F.element_at(states, -1))))
    joined = cut.join(entered, ["part", "seg"]).withColumn("states", F.aggregate("turns", F.array("entry"), step))
    allowed = [f"{s}\n{r}" for s, rs in template.follows.items() for r in rs]
    legal = lambda t, i: F.concat(F.get("states", i), F.lit("\n"), t["role"]).isin(*allowed)
    ends = lambda i: F.when(F.col("closes") & (i == F.size("turns") - 1), F.element_at("states", -1).isin(*template.ends))
    judged = F.transform("turns", lambda t, i: F.struct(t.alias("t"), legal(t, i).alias("legal"), ends(i).alias("ends")))
    each = joined.select("conv", "part", "seg", F.posexplode(judged).alias("at", "j")).select("conv", "part", "seg", "at", "j.*")
    text = lambda c: c.alias("text")
    plain = lambda c: F.struct(text(c), F.lit(False).alias("loss"))
    out = F.array(
        plain(F.concat(F.lit(template.opening), escape_role(F.col("t.role")), F.lit(template.after_role))),
        F.struct(text(escape(F.col("t.text"))), F.col("t.role").isin(*template.trained).alias("loss")),
        plain(F.lit(template.closing + template.between)),
    )
    return each.select("conv", "part", "seg", "at", F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), "legal", "ends", out.alias("segments"))


def formatted(turns: DataFrame) -> DataFrame:
    """(conv, part, seg, at, text, spans, legal, ends): each turn's formatted text and the ranges (start, length) that are trained on, in code points."""
    size = F.transform("segments", lambda s: F.length(s["text"]))
    start = lambda i: F.aggregate(F.slice(size, F.lit(1), i), F.lit(0), lambda a, b: a + b)
    placed = F.transform("segments", lambda s, i: F.struct(start(i).alias("start"), F.length(s["text"]).alias("length"), s["loss"].alias("loss")))
    spans = F.transform(F.filter(placed, lambda p: p["loss"]), lambda p: p.dropFields("loss"))
    return turns.select("conv", "part", "seg", "at", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("text"), spans.alias("spans"), "legal", "ends")


def read(text: str, spans: list[dict], template: Template = CHATML) -> tuple[list[tuple[str, str]], list[str]]:
    """The turns (role, text) and the trained texts of formatted text."""
    found, at = [], 0
    while at < len(text):
        if not text.startswith(template.opening, at):
            raise ValueError(f"no turn at {at}")
        line = text.index(template.after_role, at + len(template.opening))
        end = text.index(template.closing, line)
        found.append((unescape_role(text[at + len(template.opening) : line]), unescape(text[line + len(template.after_role) : end])))
        at = end + len(template.closing + template.between)
    return found, [unescape(text[s["start"] : s["start"] + s["length"]]) for s in spans]


class Digest:
    """What is read back of a conversation, turn by turn."""

    def __init__(self, template: Template):
        self.template, self.conv = template, None
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = self.illegal = 0
        self.valid = False

    def add(self, row: dict) -> None:
        self.conv = row["conv"]
        turns, trained = read(row["text"], row["spans"], self.template)
        for role, text in turns:
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        for text in trained:
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.n_turns += len(turns)
        self.formatted_chars += len(row["text"])
        self.illegal += not row["legal"]
        self.valid = self.illegal == 0 and bool(row["ends"])

    def rows(self):
        yield {
            "conv": self.conv, "n_turns": self.n_turns, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
            "formatted_chars": self.formatted_chars, "illegal_turns": self.illegal, "valid": self.valid,
        }


DIGEST = {"n_turns": T.LongType(), "turns_sha256": T.StringType(), "loss_chars": T.LongType(), "loss_sha256": T.StringType(), "formatted_chars": T.LongType(), "illegal_turns": T.LongType(), "valid": T.BooleanType()}


def digests(turns: DataFrame, template: Template = CHATML, *, id_col: str = "conv_id", **options) -> DataFrame:
    """A row a conversation, of what is read back from its formatted text, with the number of illegal turns and whether the machine accepts it.

    A digest needs its turns in order, so they are streamed to it one by one.
    """
    own = formatted(format_turns(turns, template, id_col=id_col, **options))
    out = folded(own, T.StructType([own.schema["conv"], *[column(k, t) for k, t in DIGEST.items()]]), lambda: Digest(template), order=("part", "seg", "at"))
    return out.withColumnRenamed("conv", id_col)


def with_probe(turns: DataFrame, text: str, *, conv_id: int = -1) -> DataFrame:
    """(conv_id, turn, role, text) and one more conversation whose user and assistant both say `text`."""
    spark = turns.sparkSession
    kinds = {f.name: f.dataType for f in turns.schema}
    probe = spark.createDataFrame([(conv_id, i, r, text) for i, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    names = ("conv_id", "turn", "role", "text")
    return turns.select(*[col(c) for c in names]).unionByName(probe.select(*[F.col(c).cast(kinds[c]).alias(c) for c in names]))
