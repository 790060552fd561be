"""The relational part of the recognition path: word tables, confidence, guards, terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe import model
from veilframe.cluster import merging
from veilframe.profile import Profile, ocr_terms

MIN_CONFIDENCE = 60
DPI = 300


def with_confidence(raw: DataFrame) -> DataFrame:
    """Rows whose confidence is a whole number; others are skipped."""
    return raw.withColumn("conf", F.expr("try_cast(conf AS INT)")).where("conf IS NOT NULL")


def to_points(raw: DataFrame, dpi: int = DPI) -> DataFrame:
    """Pixel boxes as boxes in points."""
    k = 72.0 / dpi
    box = F.struct((F.col("left") * k).alias("x0"), (F.col("top") * k).alias("y0"), ((F.col("left") + F.col("width")) * k).alias("x1"), ((F.col("top") + F.col("height")) * k).alias("y1"))
    return raw.select("doc_id", "page_num", "ord", "text", "conf", "height", box.alias("bbox"))


def word_heights(raw: DataFrame) -> DataFrame:
    """(doc_id, page_num, median_px) over sure, non-blank words of some height."""
    sure = with_confidence(raw).where((F.col("conf") >= MIN_CONFIDENCE) & (F.trim("text") != "") & (F.col("height") > 0))
    return sure.groupBy("doc_id", "page_num").agg(F.median("height").alias("median_px"))


def ocr_words(raw: DataFrame, dpi: int = DPI) -> DataFrame:
    """Sure, non-blank words in points whose boxes pass both guards."""
    sure = with_confidence(raw).where((F.col("conf") >= MIN_CONFIDENCE) & (F.trim("text") != ""))
    placed = to_points(sure, dpi).join(merging(word_heights(raw)), ["doc_id", "page_num"], "left")
    b = F.col("bbox")
    area = (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])
    line = F.coalesce(F.col("median_px"), F.lit(12.0)) * (72.0 / dpi)
    fits = (area <= 0.30 * model.PAGE_WIDTH * model.PAGE_HEIGHT) & ((line <= 0) | (b["y1"] - b["y0"] <= 4.0 * line))
    return placed.where(fits).select("doc_id", "page_num", "ord", F.trim("text").alias("text"), "conf", "bbox")


def low_confidence(raw: DataFrame) -> DataFrame:
    """(doc_id, page_num, words, low) a page."""
    return with_confidence(raw).where(F.trim("text") != "").groupBy("doc_id", "page_num").agg(F.count_if(F.col("conf") >= MIN_CONFIDENCE).alias("words"), F.count_if(F.col("conf") < MIN_CONFIDENCE).alias("low"))


def restricted(raw: DataFrame, image_pages: DataFrame, force: bool = False) -> DataFrame:
    """Words of image pages only, or of all if forced."""
    return raw if force else raw.join(merging(image_pages), ["doc_id", "page_num"], "left_semi")


def page_results(words: DataFrame) -> DataFrame:
    """(doc_id, page_num, words array in order)."""
    return words.groupBy("doc_id", "page_num").agg(F.array_sort(F.collect_list(F.struct("ord", "text", "conf", "bbox"))).alias("words"))


def matches(words: DataFrame, profile: Profile) -> DataFrame:
    """Words equal to a term of the profile, in either case. The terms are a literal list, so no join is made."""
    terms = ocr_terms(profile)
    return words.where(F.lower("text").isin(terms) if terms else F.lit(False))


def term_set(profiles: DataFrame) -> DataFrame:
    """(term) of rows in the profile schema: words of names, and phones, e-mails, SSNs and accounts whole, each once in lower case."""
    s = F.col("subject")
    words = F.flatten(F.transform(F.concat(F.array(s["display_name"]), s["aliases"]), lambda n: F.split(n, r"\s+")))
    values = F.concat(words, s["phones"], s["emails"], s["ssns"], F.transform(s["account_numbers"], lambda a: a["value"]))
    return profiles.select(F.explode(values).alias("v")).select(F.lower(F.trim("v")).alias("term")).where("term <> ''").distinct()


def match_terms(words: DataFrame, terms: DataFrame) -> DataFrame:
    """Words equal to any of a table of terms (term), in either case: an equi-join that Spark plans by size."""
    return words.join(terms.select(F.lower("term").alias("_term")).distinct(), F.lower("text") == F.col("_term"), "left_semi")


def detections(words: DataFrame) -> DataFrame:
    """Matched words as detections, score by confidence."""
    return words.select(
        "doc_id", "page_num", "ord", "text", F.lit("OCR").alias("entity_type"), (F.col("conf") / 100.0).alias("score"), "bbox", F.lit(0).alias("preserve_last"), F.lit("ocr").alias("detector"),
        F.lit(0).alias("start"), F.length("text").alias("size"),
    )


def paint_counts(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "page_num").agg(F.count("*").alias("painted"))
