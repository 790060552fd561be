"""The corpus pipeline: quality classifier, MinHash near-dedup, substring dedup, decontamination, BPE.

Every stage works on all rows its predecessor kept. All but the last return the
columns of documents, others are left out; the last returns each text's token
ids and what they decode to.

Defined results: a null or empty text is scored as empty and, if kept, never a
near duplicate, never cut or contaminated, and has no tokens; rows without id
are documents of their own that near dedup keeps; where an id repeats, each of
its texts counts as a document and rows equal in both leave one; labels and
benchmark items may be null or missing, then they reject and match nothing;
empty tables give empty results; a text that loses all its words stays as an
empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontam, near_dedup, substring_dedup, zstd_quality
from veilframe.llm.common import checkpoint

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go."""
    return zstd_quality.keep_good(docs, zstd_quality.fit(docs, table(spark, sf_dir, "labels"))).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, and one row of each id and text."""
    return near_dedup.keep_one(docs, repeats=False).select(*COLUMNS)


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds are cut from the texts; n_chars follows."""
    out = substring_dedup.remove_repeats(docs, carry=("lang", "source"))
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an exact benchmark window go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, token_ids, decoded) of each text."""
    row = docs.select(F.struct("doc_id", "lang", "source").alias("row"), "text")
    out = bpe.encode(row, public_tokenizers.path(TOKENIZER), id_col="row", decoded="decoded")
    return out.select("row.doc_id", "row.lang", "row.source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "decoded")


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_dedup_stage),
    ("decontamination", decontamination),
    ("bpe", tokenise),
]

#: No stage but decontamination can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the checkpoint folder before the next reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
