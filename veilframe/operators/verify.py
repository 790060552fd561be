"""Verification: what a second detection still finds, less what was meant to stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.cluster import merging
from veilframe.functions import text as X
from veilframe.operators.detect import detect_all
from veilframe.operators.tagger import Tagger
from veilframe.profile import Profile


def drop_kept_suffixes(survivors: DataFrame, originals: DataFrame) -> DataFrame:
    """Survivors whose letters and digits are not the kept end of an original of their document."""
    kept = originals.where("preserve_last > 0").select("doc_id", F.right(X.alphanumerics(F.col("text")), F.col("preserve_last")).alias("_kept")).where("_kept <> ''").distinct()
    own = survivors.withColumn("_own", X.alphanumerics(F.col("text")))
    return own.join(merging(kept.withColumnRenamed("doc_id", "_doc")), (F.col("doc_id") == F.col("_doc")) & (F.col("_own") == F.col("_kept")), "left_anti").drop("_own")


def verify(redacted: DataFrame, profile: Profile, originals: DataFrame | None = None, threshold: float = 0.5, tagger: Tagger | None = None) -> DataFrame:
    """The surviving detections."""
    found = detect_all(redacted.select("doc_id", "page_num", "ord", "text", "bbox", "block_type"), profile, threshold, tagger=tagger)
    return found if originals is None else drop_kept_suffixes(found, originals)


def summary(documents: DataFrame, survivors: DataFrame) -> DataFrame:
    """(doc_id, passed, survivor_count, survivors in order) of every document."""
    by_doc = survivors.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("page_num", "ord", "entity_type", "text"))).alias("survivors"))
    out = documents.select("doc_id").distinct().join(merging(by_doc), "doc_id", "left")
    return out.select("doc_id", F.col("n").isNull().alias("passed"), F.coalesce("n", F.lit(0)).cast("long").alias("survivor_count"), F.coalesce("survivors", F.array()).alias("survivors"))


def preview(survivors, n: int = 5, width: int = 40):
    """The first texts of a survivor array, cut for display."""
    return F.transform(F.slice(survivors, 1, n), lambda s: F.left(s["text"], F.lit(width)))
