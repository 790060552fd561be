"""What plans need of the cluster: the package on every executor, shared folders, joins on hot keys."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Narrow rows of one key (some MB) beyond which a join deals them out, and the copies of the key's row that they then meet.
HEAVY_ROWS = 65_536
FAN = 64


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context: functions of ours are pickled by name."""
    sc = spark.sparkContext
    if getattr(sc, "_veilframe_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(), "veilframe_pkg.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    sc.addPyFile(target)
    sc._veilframe_shipped = True


def ship_active() -> None:
    """For functions of columns, which know no session."""
    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, a temporary one in local mode only."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp()
    sc.setCheckpointDir(named)
    current = sc._jsc.sc().getCheckpointDir().get()
    delete_at_end(spark, current)  # a folder of this context alone
    return current


def delete_at_end(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage; the copy lies where every executor can read it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the checkpoint folder, deleted when the driver ends: smaller than a checkpoint."""
    spark = df.sparkSession
    name = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(name)
    delete_at_end(spark, name)
    return spark.read.schema(df.schema).parquet(name)


def merging(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by a merge, never sent to the driver and all executors.

    A plan takes a table for as large as its compressed files, and ten such MB of narrow rows are some hundred in a hash table.
    """
    return df.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, by: list[str], *, heavy: int | None = None) -> DataFrame:
    """Inner join of `rows` with `groups`, which has in `size` the number of rows of its key, the same in all rows of a key.

    Rows of keys that have more than `heavy` (HEAVY_ROWS if none) are dealt out by a hash of `by` and meet one of `FAN` copies of the key's rows, so no
    task gets all rows of a key. The copies are at most FAN / heavy of the rows; a table of known size, broadcast only if small.
    """
    heavy = HEAVY_ROWS if heavy is None else heavy
    values = F.struct(*[c for c in groups.columns if c not in on])
    copies = F.explode(F.sequence(F.lit(0), F.lit(FAN - 1))).alias("_fan")
    many = stored(groups.where(F.col(size) > heavy).select(*on, values.alias("_many"), copies))
    if many.isEmpty():
        return rows.join(merging(groups), on)
    dealt = rows.withColumn("_fan", F.pmod(F.xxhash64(F.lit("fan"), *by), F.lit(FAN)).cast("int")).join(many, [*on, "_fan"], "left")
    # Dealt rows have their group already; a salt of their own spreads them over the exchange of the other join.
    salt = F.when(F.col("_many").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(F.lit("salt"), *by), F.lit(1 << 30)).cast("int"))
    few = groups.where(F.col(size) <= heavy).select(*on, F.lit(0).alias("_salt"), values.alias("_few"))
    joined = dealt.withColumn("_salt", salt).join(merging(few), [*on, "_salt"], "left")
    found = joined.select(*rows.columns, F.coalesce("_many", "_few").alias("_group")).where("_group IS NOT NULL")
    return found.select(*rows.columns, "_group.*")


def grams(text: Column, size: int) -> Column:
    """Each run of `size` letters, in order; none of a shorter text."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.substr(text, i, F.lit(size)))
