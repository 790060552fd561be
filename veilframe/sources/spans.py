"""Documents, pages and spans: where every plan begins.

A span is a line of text with a place. Text tables carry no layout, so lines get
a fixed one: 14 points apart, 12 high, 6 points a character, on a page of 612 x
792 points.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import model
from veilframe.cluster import ship_active

FORMATS = ("parquet", "orc", "json", "csv", "text", "binaryFile")


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema=None, **options) -> DataFrame:
    """A table in any built-in format; text formats want a schema, so nothing is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"format {fmt!r} is none of {FORMATS}")
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def collect_inputs(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """(path, size, modified) of the files below a folder whose name fits, or of one file whatever its name, by path."""
    reader = spark.read.format("binaryFile")
    jvm = spark._jvm.org.apache.hadoop.fs
    where = jvm.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return spark.createDataFrame([], "path string, size long, modified timestamp")
    if fs.getFileStatus(where).isDirectory():
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(path).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")).orderBy("path")


def parsed_with(parser: Callable[[bytes], str]):
    """A parser of one document as a function of columns: (text, error), an exception being the error."""

    @F.pandas_udf("struct<text:string,error:string>")
    def parse(content: pd.Series) -> pd.DataFrame:
        rows = []
        for c in content:
            try:
                rows.append((None if c is None else parser(bytes(c)), None))
            except Exception as e:  # noqa: BLE001 - whatever a parser raises is the document's error
                rows.append((None, str(e) or type(e).__name__))
        return pd.DataFrame(rows, columns=["text", "error"])

    ship_active()
    return parse


def open_documents(files: DataFrame, parser: Callable[[bytes], str] | None = None) -> DataFrame:
    """(path, text, error_kind, error, file_hash) of binaryFile rows: UTF-8 text is read, other content goes to the parser or is an error, never an exception."""
    content = F.col("content")
    head = F.substring(content, 1, 5).cast("string")
    encrypted = head.startswith("%PDF") & F.contains(content, F.lit(b"/Encrypt"))
    binary = head.startswith("%PDF") | (F.is_valid_utf8(content.cast("string")) == F.lit(False))
    if parser is None:
        error = F.when(encrypted, "document is encrypted").when(head.startswith("%PDF"), "no parser for this format is configured").when(binary, "content is not text")
        text = F.when(error.isNull(), content.cast("string"))
    else:
        files = files.withColumn("_parsed", parsed_with(parser)(F.when(binary & ~encrypted, content)))
        error = F.when(encrypted, "document is encrypted").otherwise(F.col("_parsed.error"))
        text = F.when(error.isNull(), F.when(binary, F.col("_parsed.text")).otherwise(content.cast("string")))
    return files.select("path", text.alias("text"), F.when(error.isNotNull(), "extraction").alias("error_kind"), error.alias("error"), F.sha2(content, 256).alias("file_hash"))


def place(ord_: Column, text: Column) -> Column:
    top = F.lit(72.0) + F.lit(14.0) * ord_
    return F.struct(F.lit(72.0).alias("x0"), top.alias("y0"), (F.lit(72.0) + F.lit(6.0) * F.length(text)).alias("x1"), (top + 12.0).alias("y1"))


def lines(df: DataFrame, doc: str, text: str, page: str | None = None) -> DataFrame:
    """The non-blank lines of every text, in order, as spans. One row makes its own: no shuffle."""
    page_num = F.col(page).cast("int") if page else F.lit(0)
    out = df.select(F.col(doc).alias("doc_id"), page_num.alias("page_num"), F.posexplode(F.split(F.col(text), "\n")).alias("ord", "line"))
    out = out.withColumn("text", F.trim("line")).where("text <> ''")
    return out.select("doc_id", "page_num", "ord", "text", place(F.col("ord"), F.col("line")).alias("bbox"), F.lit(0).alias("block_type"))


def document_spans(documents: DataFrame) -> DataFrame:
    return lines(documents, "doc_id", "text")


def span_documents(spans: DataFrame) -> DataFrame:
    """(doc_id, text): the spans put back as lines, with blank ones where lines are missing between them."""
    rows = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "ord", "text"))).alias("s"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0).alias("at"), F.lit("").alias("text"))

    def step(acc, s):
        same = acc["page"] == s["page_num"]
        gap = F.when(same, F.repeat(F.lit("\n"), s["ord"] - acc["at"])).otherwise(F.concat(F.when(acc["text"] == "", "").otherwise("\f"), F.repeat(F.lit("\n"), s["ord"])))
        return F.struct(s["page_num"].alias("page"), s["ord"].alias("at"), F.concat(acc["text"], gap, s["text"]).alias("text"))

    return rows.select("doc_id", F.aggregate("s", start, step, lambda a: a["text"]).alias("text"))


def conversation_spans(conversations: DataFrame) -> DataFrame:
    """Documents of several pages: a turn is a page."""
    return lines(conversations, "conv_id", "text", "turn")


def html_text(html: Column) -> Column:
    """Scripts and styles out, other tags as line breaks; references stay."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<!--.*?-->", " "), r"<[^>]*>", "\n")


def html_spans(pages: DataFrame) -> DataFrame:
    return lines(pages.select("page_id", html_text(F.col("html")).alias("text")), "page_id", "text")


def assemble(chars: Column) -> Column:
    """A span from array<struct<c, bbox>>: its stripped text and the box around all letters; null if blank."""
    text = F.trim(F.array_join(F.transform(chars, lambda c: c["c"]), ""))
    low = lambda k: F.array_min(F.transform(chars, lambda c: c["bbox"][k]))
    high = lambda k: F.array_max(F.transform(chars, lambda c: c["bbox"][k]))
    box = F.struct(low("x0").alias("x0"), low("y0").alias("y0"), high("x1").alias("x1"), high("y1").alias("y1"))
    return F.when(text != "", F.struct(text.alias("text"), box.alias("bbox")))


def preflight(pages: DataFrame) -> DataFrame:
    """(doc_id, chars, has_images, needs_ocr) from pages (doc_id, text, has_images): what decides before any work."""
    out = pages.groupBy("doc_id").agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.bool_or("has_images").alias("has_images"))
    return out.withColumn("needs_ocr", (F.col("chars") < 50) & F.col("has_images"))


def is_image_page(text: Column, min_chars: int = 50) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) < min_chars


def as_spans(df: DataFrame) -> DataFrame:
    """Any frame cast to the span schema."""
    return df.select(*[F.col(f.name).cast(f.dataType) for f in model.SPANS])
