"""Aggregates, orders and unions over detections, results and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as X


def by_page(detections: DataFrame) -> DataFrame:
    """(doc_id, page_num, n, items in order)."""
    return detections.groupBy("doc_id", "page_num").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "entity_type", "text"))).alias("items"))


def by_class(detections: DataFrame) -> DataFrame:
    """(doc_id, pages, profile_hits, entity_hits): the detector says which class a hit is of."""
    return detections.groupBy("doc_id").agg(
        F.count_distinct("page_num").alias("pages"),
        F.count_if(F.col("detector") == "profile").alias("profile_hits"),
        F.count_if(F.col("detector") == "entity").alias("entity_hits"),
    )


def bbox_union(df: DataFrame, *keys: str) -> DataFrame:
    b = F.col("bbox")
    box = F.struct(F.min(b["x0"]).alias("x0"), F.min(b["y0"]).alias("y0"), F.max(b["x1"]).alias("x1"), F.max(b["y1"]).alias("y1"))
    return df.groupBy(*keys).agg(box.alias("bbox"))


def failures(rows: DataFrame) -> DataFrame:
    """(doc_id, path, category, message, mitigation) of rows with an error_kind."""
    category, mitigation = X.error_class(F.col("error_kind"), F.col("error"))
    return rows.where("error_kind IS NOT NULL").select("doc_id", "path", category.alias("category"), F.col("error").alias("message"), mitigation.alias("mitigation"))


def batch_totals(results: DataFrame, errors: DataFrame) -> DataFrame:
    """One row: ok, errored, total_detections, exit_code (0 all well, 1 some failed, 2 all failed)."""
    rows = results.select(F.lit(1).alias("ok"), F.lit(0).alias("err"), F.col("detections").cast("long").alias("d"))
    rows = rows.unionByName(errors.select(F.lit(0).alias("ok"), F.lit(1).alias("err"), F.lit(0).cast("long").alias("d")))
    total = rows.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum("err"), F.lit(0)).alias("errored"), F.coalesce(F.sum("d"), F.lit(0)).alias("total_detections"))
    return total.withColumn("exit_code", exit_code(F.col("ok"), F.col("errored")))


def exit_code(ok: Column, errored: Column) -> Column:
    return F.when(errored == 0, 0).when(ok > 0, 1).otherwise(2)
