"""Structured Streaming around the batch plans: new documents in, redacted spans and audit rows out.

The reference has no streams; these are the same operators on unbounded input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilframe.operators import detect
from veilframe.plans.engine import Engine
from veilframe.profile import Profile
from veilframe.sources import spans as sources


def detect_stream(documents: DataFrame, profile: Profile) -> DataFrame:
    """Pattern and account hits of a stream of documents, without state."""
    spans = sources.document_spans(documents)
    hits = detect.detect_accounts(spans, profile.subject.account_numbers)
    return hits.unionByName(detect.detect_patterns(spans, profile.subject.custom_patterns))


def redact_documents(spark: SparkSession, path: str, schema, profile: Profile, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch of new files runs the whole plan and appends to `out`; a batch written twice replaces itself."""

    def batch(docs: DataFrame, epoch: int) -> None:
        run = Engine(profile).run(sources.document_spans(docs))
        for name, df in (("spans", run.spans), ("results", run.results)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/epoch={epoch}")

    docs = spark.readStream.schema(schema).parquet(path)
    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def hits_by_window(events: DataFrame, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Counts of audit events by time and subject; late ones are dropped after the delay."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("runs"))


__all__ = ["detect_stream", "hits_by_window", "redact_documents"]
