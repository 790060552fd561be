"""Conversations as ordered segments of bounded size.

Turns are dealt out by ranges of (conversation, turn, role, text), so one
conversation may hold any share of all rows and is still cut over many tasks.
Each task cuts its sorted rows into segments of one conversation, of at most
`SEGMENT_ROWS` rows and about `SEGMENT_BYTES` of text; (part, seg) orders them.
Operators work on segments side by side, and what has to pass from one segment
to the next goes through `folded`, which reads a few bytes a segment in order.

Defined order: by turn, nulls first, then role, then text; equal rows stand
side by side. Rows without a conversation id are one conversation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from veilframe.llm.common import begin, col, end, field, ship, stored

SEGMENT_ROWS = 256
SEGMENT_BYTES = 64 << 10
#: Copies of one row that stand together when rows are dealt out.
COPIES = 1_000

_NONE = object()


def counted(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, blank: str) -> DataFrame:
    """(conv, turn, role, text, n): equal rows in one, counted before they are shuffled; a null role or text becomes `blank`."""
    text = lambda c: F.coalesce(col(c).cast("string"), F.lit(blank))
    rows = turns.select(col(id_col).alias("conv"), col(turn_col).cast("long").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"))
    return rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))


def arrow_rows(df: DataFrame, schema: T.StructType, work: Callable[[Iterator[dict]], Iterator[dict]], *, batch: int = 200) -> DataFrame:
    """The rows of each task, in their order, through `work`."""
    ship(df.sparkSession)
    arrow = to_arrow_schema(schema)

    def run(batches):
        begin("turns")
        out = []
        for row in work(r for b in batches for r in b.to_pylist()):
            out.append(row)
            if len(out) == batch:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        end()

    return df.mapInArrow(run, schema)


def segments(
    rows: DataFrame, more: tuple[str, ...] = (), *, also: tuple[T.StructField, Callable[[list[dict], bool], object]] | None = None, size: int = SEGMENT_ROWS, size_bytes: int = SEGMENT_BYTES
) -> DataFrame:
    """(conv, part, seg, opens, turns) of rows (conv, turn, role, text, n, more), stored.

    `turns` has (turn, role, text, copy, more) in order, copy counting equal rows from 0; `opens` says that the segment is
    surely its conversation's first. `also` names a column made of a segment's (turns, opens).
    """
    block = F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES))).alias("block")
    rows = rows.select("conv", "turn", "role", "text", "n", *more, block)
    keys = [F.col(c).asc_nulls_first() for c in ("conv", "turn", "role", "text", "block")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    here = F.sequence(F.col("block") * COPIES, F.least(F.col("n"), (F.col("block") + 1) * COPIES) - 1)
    chosen = ordered.withColumn("copy", F.explode(here)).select("conv", F.struct("turn", "role", "text", "copy", *more).alias("row"))
    schema = T.StructType(
        [chosen.schema["conv"], field("part", T.IntegerType()), field("seg", T.LongType()), field("opens", T.BooleanType()), field("turns", T.ArrayType(chosen.schema["row"].dataType))]
        + ([also[0]] if also else [])
    )

    def segment(**known):
        return known | ({also[0].name: also[1](known["turns"], known["opens"])} if also else {})

    def cut(rows):
        part, seg, held, weight, conv, opens = TaskContext.get().partitionId(), 0, [], 0, _NONE, False
        for r in rows:
            new = r["conv"] != conv
            if held and (new or len(held) >= size or weight >= size_bytes):
                yield segment(conv=conv, part=part, seg=seg, opens=opens, turns=held)
                seg, held, weight, opens = seg + 1, [], 0, new
            conv = r["conv"]
            held.append(r["row"])
            weight += len(r["row"]["text"]) + len(r["row"]["role"])
        if held:
            yield segment(conv=conv, part=part, seg=seg, opens=opens, turns=held)

    return stored(arrow_rows(chosen, schema, cut))


def folded(df: DataFrame, schema: T.StructType, start: Callable[[], object], order: tuple[str, ...] = ("part", "seg")) -> DataFrame:
    """Rows (conv, order, ...) of each conversation in order through an object of `start`: `add(row)` for each, then `rows()`; either may give rows.

    A conversation is streamed, never gathered; what the object keeps of it is its own affair.
    """
    ordered = df.repartition("conv").sortWithinPartitions("conv", *order)

    def work(rows):
        conv, state = _NONE, None
        for r in rows:
            if r["conv"] != conv:
                if state is not None:
                    yield from state.rows()
                conv, state = r["conv"], start()
            yield from state.add(r) or ()
        if state is not None:
            yield from state.rows()

    return arrow_rows(ordered, schema, work)

