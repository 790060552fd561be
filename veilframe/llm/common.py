"""What the operators of this subpackage share.

Python runs over Arrow batches only, of at most `BATCH_ROWS` rows: the session's
bound is lowered to that before a plan is made. A batch is cut into slices of a
bounded number of text bytes; one very long text makes a slice of its own and
is never cut. Workers live through many tasks, so what an operator remembers in
one is dropped when another operator starts there, and free memory is given
back at the end of each task.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe import cluster
from veilframe.cluster import FAN, HEAVY_ROWS, checkpoint, checkpoint_dir, stored  # noqa: F401 - the operators take them from here

SLICE_BYTES = 4 << 20
BATCH_ROWS = 1_000


def col(name: str) -> Column:
    """The column of this very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors and bound what reaches Python at once."""
    bound_batches(spark)
    cluster.ship(spark)


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, by: list[str], *, heavy: int | None = None) -> DataFrame:
    return cluster.join_groups(rows, groups, on, size, by, heavy=HEAVY_ROWS if heavy is None else heavy)


def bound_batches(spark: SparkSession) -> None:
    """No Arrow batch of this session holds more than BATCH_ROWS rows; a lower bound of its own stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


#: What operators remember in a worker process: the owner, and how to forget it.
_MEMORIES: list[tuple[str, Callable[[], None]]] = []


def remembers(owner: str, forget: Callable[[], None]) -> None:
    _MEMORIES.append((owner, forget))


def begin(owner: str = "") -> None:
    """A task of this owner starts: all other owners forget."""
    if pa.default_memory_pool().backend_name != "system":
        pa.set_memory_pool(pa.system_memory_pool())
    for name, forget in _MEMORIES:
        if name != owner:
            forget()


def end() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_bytes(column: pa.Array) -> list[bytes]:
    """Each text in UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row ranges of at most `limit` text bytes, or one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def arrow_map(
    df: DataFrame,
    keep: Iterable[str],
    text: str,
    kernel: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]],
    fields: list[T.StructField],
    *,
    limit: int = SLICE_BYTES,
    more: Iterable[str] = (),
    owner: str = "",
) -> DataFrame:
    """`keep` unchanged and, for each row, what the kernel makes of `text` and `more`.

    The kernel is built once a task and called for each slice; `owner` names whose memory it uses.
    """
    ship(df.sparkSession)
    keep = list(keep)
    chosen = df.select(*[col(c) for c in dict.fromkeys([*keep, text, *more])])
    schema = T.StructType([chosen.schema[c] for c in keep] + fields)
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(owner)
        work = kernel()
        for batch in batches:
            for part in slices(batch, text, limit):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *work(part)], names=names)
        end()

    return chosen.mapInArrow(run, schema)


def field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind, True)
