"""Redaction of span text, and the guards on boxes.

A hit hides its whole span; a hit on a match with a kept suffix, or in `match`
mode any hit, hides the range of its own characters. Hidden characters become
full blocks, so lengths and places stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe import model
from veilframe.cluster import merging
from veilframe.functions import text as X

BLOCK = "█"
MAX_AREA = 0.30
MAX_HEIGHTS = 4.0
DEFAULT_HEIGHT = 12.0
KEY = ["doc_id", "page_num", "ord"]


def blank(text: Column) -> Column:
    return F.repeat(F.lit(BLOCK), F.length(text))


def blank_ranges(text: Column, ranges: Column) -> Column:
    """The text with every range (start, end) blanked; ranges may overlap and are sorted."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(s, r):
        start, end = F.greatest(r["start"], s["at"]), F.greatest(r["end"], s["at"])
        return F.struct(end.alias("at"), F.concat(s["out"], F.substr(text, s["at"] + 1, start - s["at"]), F.repeat(F.lit(BLOCK), end - start)).alias("out"))

    return F.aggregate(ranges, state, step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text))))


def hidden_range(granularity: str) -> Column:
    """(start, end) of what a detection hides: all of its match, or less its kept suffix; end is null where the whole span goes."""
    part = X.hidden_length(F.col("text"), F.col("preserve_last"))
    size = F.coalesce(part, F.col("size")) if granularity == "match" else part
    return F.struct(F.col("start"), (F.col("start") + size).alias("end"))


def redact_spans(spans: DataFrame, detections: DataFrame, granularity: str = "span") -> DataFrame:
    """Spans with their text redacted and `hits`, the number of detections on each.

    Hits hide ranges of the text that they were found in, so hits that overlap hide all that either covers.
    """
    by_span = detections.groupBy(*KEY).agg(F.count("*").alias("hits"), F.array_sort(F.collect_set(hidden_range(granularity))).alias("found"))
    whole = F.exists("found", lambda r: r["end"].isNull())
    out = spans.join(merging(by_span), KEY, "left")
    text = F.when(F.col("found").isNull(), F.col("text")).when(whole, blank(F.col("text"))).otherwise(blank_ranges(F.col("text"), F.col("found")))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in spans.columns], F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def exposed(redacted: DataFrame, detections: DataFrame, granularity: str = "span") -> DataFrame:
    """Detections of which the redacted spans still show something that was to be hidden, with what they show as their text."""
    hits = detections.withColumn("_range", hidden_range(granularity))
    now = redacted.select(*KEY, F.col("text").alias("_now"))
    start = F.when(F.col("_range.end").isNull(), F.lit(0)).otherwise(F.col("_range.start"))
    size = F.when(F.col("_range.end").isNull(), F.length("_now")).otherwise(F.col("_range.end") - F.col("_range.start"))
    shown = hits.join(merging(now), KEY).withColumn("_shown", F.substr("_now", start + 1, size))
    shown = shown.where(F.translate("_shown", BLOCK, "") != "")
    return shown.select(*[F.col("_shown").alias("text") if c == "text" else F.col(c) for c in detections.columns])


def median_heights(spans: DataFrame) -> DataFrame:
    """(doc_id, page_num, median_height), exact and interpolated; 12 where nothing has a height."""
    return spans.groupBy("doc_id", "page_num").agg(F.coalesce(F.median(F.col("bbox.y1") - F.col("bbox.y0")), F.lit(DEFAULT_HEIGHT)).alias("median_height"))


def guarded(detections: DataFrame, spans: DataFrame, pages: DataFrame | None = None, heights: DataFrame | None = None) -> DataFrame:
    """Detections with `rejected`: null, `area` (over 30 % of the page) or `height` (over four median lines); `heights` of the spans, if known."""
    out = detections.join(merging(median_heights(spans) if heights is None else heights), ["doc_id", "page_num"], "left")
    area = F.lit(model.PAGE_WIDTH * model.PAGE_HEIGHT)
    if pages is not None:
        out = out.join(pages.select("doc_id", "page_num", (F.col("width") * F.col("height")).alias("_area")), ["doc_id", "page_num"], "left")
        area = F.coalesce(F.col("_area"), area)
    b = F.col("bbox")
    height, line = b["y1"] - b["y0"], F.coalesce("median_height", F.lit(DEFAULT_HEIGHT))
    reason = F.when((b["x1"] - b["x0"]) * height > MAX_AREA * area, "area").when((line > 0) & (height > MAX_HEIGHTS * line), "height")
    return out.select(*detections.columns, reason.alias("rejected"))


def redact_guarded(spans: DataFrame, detections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    kept = guarded(detections, spans, pages).where("rejected IS NULL").drop("rejected")
    return redact_spans(spans, kept)
