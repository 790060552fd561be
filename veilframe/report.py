"""Reports as column expressions, and the writers for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import text as X
from veilframe.sources.files import write_files

#: Titles, table heads and labels of the reports, here and in the functions below.
TITLE, BATCH_TITLE, FOOTER = "# Redaction Report", "# Redaction Batch Summary", "*Generated by veilframe*"
SURVIVORS = "array<string>"


def verification_line(passed: Column, survivors: Column) -> Column:
    failed = F.concat(F.lit("❌ Failed — "), F.size(survivors).cast("string"), F.lit(" PII item(s) survived redaction"))
    return F.when(passed.isNull(), "N/A (skipped)").when(passed, "✅ Passed — no PII survivors detected").otherwise(failed)


def survivor_array(json: Column) -> Column:
    return F.coalesce(F.from_json(json, SURVIVORS), F.array().cast(SURVIVORS))


def markdown() -> Column:
    """The report of an audit row."""
    s = survivor_array(F.col("verification_survivors_json"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    listed = F.concat(F.lit("\n## Survivors\n\n"), F.array_join(F.transform(s, lambda x: F.concat(F.lit("- `"), x, F.lit("`"))), "\n"), F.lit("\n"))
    parts = [
        F.lit(f"{TITLE}\n\n**File:** "), text("original_filename"), F.lit("\n**Output:** "), text("output_filename"), F.lit("\n**Profile:** "), text("profile_name"), F.lit("\n"),
        F.when(text("subject_id") != "", F.concat(F.lit("**Subject:** "), text("subject_id"))).otherwise(""), F.lit("\n**Processed:** "), F.coalesce(X.iso(F.col("processed_at")), F.lit("")),
        F.lit("\n**Duration:** "), text("duration_ms"), F.lit(" ms\n\n## Summary\n\n| Metric | Value |\n|--------|-------|\n| Pages processed | "), text("pages_processed"),
        F.lit(" |\n| Items detected | "), text("items_detected"), F.lit(" |\n| Items redacted | "), text("items_redacted"), F.lit(" |\n| Verification | "),
        verification_line(F.col("verification_passed"), s), F.lit(" |\n"), F.when(F.size(s) > 0, listed).otherwise(""), F.lit(f"\n---\n{FOOTER}"),
    ]
    return F.concat(*parts)


def json() -> Column:
    """The twelve fields of an audit row, nulls included; the file's hash stays out."""
    fields = "original_filename output_filename profile_name subject_id processed_at duration_ms pages_processed items_detected items_redacted verification_passed verification_survivors notes".split()
    values = {"processed_at": X.iso(F.col("processed_at")), "verification_survivors": survivor_array(F.col("verification_survivors_json"))}
    return F.to_json(F.struct(*[values.get(f, F.col(f)).alias(f) for f in fields]), {"ignoreNullFields": "false"})


def output_path(path: Column, output: str | None = None, batch: bool = False) -> Column:
    """Where a redacted file goes: beside the input, or below `redacted` in a batch."""
    folder = F.regexp_extract(path, r"^(.*/)?[^/]*$", 1)
    name = F.concat(F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(.)\.[^.]*$", "$1"), F.lit("_redacted.pdf"))
    if output is not None:
        return F.concat(F.lit(output.rstrip("/") + "/redacted/"), name) if batch else F.lit(output)
    return F.concat(folder, F.lit("redacted/") if batch else F.lit(""), name)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def batch_rows(results: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, line): a table row for each result and each failure."""
    ok = results.select("doc_id", F.concat(F.lit("| ✓ | "), base_name(F.col("input")), F.lit(" | "), base_name(F.col("output")), F.lit(" | "), F.col("detections").cast("string"), F.lit(" | "), X.verification_icon(F.col("verification_passed")), F.lit(" |")).alias("line"))
    bad = errors.select("doc_id", F.concat(F.lit("| ✗ | "), base_name(F.col("path")), F.lit(" | — | — | ["), F.col("category"), F.lit("] "), F.col("mitigation"), F.lit(" |")).alias("line"))
    return ok.unionByName(bad)


def batch_markdown(results: DataFrame, errors: DataFrame, run_ts: str) -> DataFrame:
    """Lines (pos, doc_id, line) of the summary. Rows stay rows, so no task holds the whole report."""
    each = results.select(F.lit(1).alias("ok"), F.lit(0).alias("err")).unionByName(errors.select(F.lit(0).alias("ok"), F.lit(1).alias("err")))
    counts = each.agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum("err"), F.lit(0)).alias("err"))
    head = counts.select(F.lit(0).alias("pos"), F.lit(None).cast("long").alias("doc_id"), F.concat(
        F.lit(f"{BATCH_TITLE}\n\n**Run:** {run_ts}  **Total:** "), (F.col("ok") + F.col("err")).cast("string"), F.lit("  **OK:** "), F.col("ok").cast("string"), F.lit("  **Errors:** "), F.col("err").cast("string"),
        F.lit("\n\n| Status | File | Output | Detections | Verification |\n|--------|------|--------|------------|--------------|"),
    ).alias("line"))
    body = batch_rows(results, errors).select(F.when(F.col("line").startswith("| ✓"), 1).otherwise(2).alias("pos"), "doc_id", "line")
    foot = counts.select(F.lit(3).alias("pos"), F.lit(None).cast("long").alias("doc_id"), F.lit(f"\n---\n{FOOTER}").alias("line"))
    return head.unionByName(body).unionByName(foot)


def batch_json(results: DataFrame, errors: DataFrame) -> DataFrame:
    """(doc_id, line): results and failures as JSON lines."""
    check = F.when(F.col("verification_passed").isNotNull(), F.struct(F.col("verification_passed").alias("passed"), "survivors"))
    ok = results.select("doc_id", F.to_json(F.struct("input", "output", "detections", check.alias("verification")), {"ignoreNullFields": "false"}).alias("line"))
    bad = errors.select("doc_id", F.to_json(F.struct("path", "category", "message", "mitigation"), {"ignoreNullFields": "false"}).alias("line"))
    return ok.unionByName(bad)


def report_files(records: DataFrame) -> DataFrame:
    """(name, content): both reports of every record, named after its output; where records share a name, the document's id tells them apart, or the file's hash."""
    told = F.hex("doc_id") if "doc_id" in records.columns else F.left("file_hash", F.lit(12))
    stem = F.regexp_replace(base_name(F.col("output_filename")), r"(.)\.[^.]*$", "$1")
    rows = records.withColumn("_stem", stem)
    shared = rows.groupBy(F.col("_stem").alias("_again")).count().where("count > 1").select("_again")
    own = F.when(F.col("_again").isNull(), F.col("_stem")).otherwise(F.concat("_stem", F.lit("-"), told))
    file = lambda end, content: F.struct(F.concat(own, F.lit(end)).alias("name"), content.alias("content"))
    each = rows.join(shared, F.col("_stem") == F.col("_again"), "left").select(F.explode(F.array(file(".report.md", markdown()), file(".report.json", json()))).alias("f"))
    return each.select("f.name", "f.content")


def write_reports(records: DataFrame, path: str) -> None:
    """A file .report.md and one .report.json for every record; a job that fails leaves none."""
    write_files(report_files(records), path, overwrite=True)


def write_batch_summary(results: DataFrame, errors: DataFrame, folder: str, run_ts: str) -> tuple[str, str]:
    """Text files {run_ts}_batch-summary.md and .json in the folder, as Spark writes them."""
    md, js = (f"{folder.rstrip('/')}/{run_ts}_batch-summary.{e}" for e in ("md", "json"))
    batch_markdown(results, errors, run_ts).orderBy("pos", "doc_id").select("line").write.mode("overwrite").text(md)
    batch_json(results, errors).orderBy("doc_id").select("line").write.mode("overwrite").text(js)
    return md, js
