"""Files read in even shares and written one a document."""

import os

import pytest
from pyspark.sql import functions as F

from veilframe.sources import files


def test_shares_are_even():
    many = [(f"s{i}", 2_000 + i % 7) for i in range(10_000)] + [(f"l{i}", 40 << 20) for i in range(3)]
    parts = files.shares(many)
    weights = [sum(n + files.OPEN_BYTES for _, n in p.files) for p in parts]
    assert sorted(f for p in parts for f in p.files) == sorted(many)
    assert max(weights) <= files.SHARE_BYTES * 1.3 + files.OPEN_BYTES and min(weights) >= files.SHARE_BYTES * 0.5
    assert sum(any(n > 1 << 20 for _, n in p.files) for p in parts) == 3
    assert files.shares([]) == [] and len(files.shares([("a", 0)])) == 1


def test_reading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("é one\ntwo")
    (tmp_path / "sub" / "b.txt").write_text("b")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "locked.txt").write_bytes(b"%PDF-1 /Encrypt")
    (tmp_path / "_hidden.txt").write_text("no")
    (tmp_path / "gone.txt").symlink_to(tmp_path / "nowhere")
    found = {os.path.basename(r["path"]): r for r in files.read_documents(spark, str(tmp_path), glob="*.txt").collect()}
    assert found["a.txt"]["text"] == "é one\ntwo" and found["b.txt"]["text"] == "b" and found["a.txt"]["size"] == 10
    assert {k: r["error"] for k, r in found.items() if r["error"]} == {"bad.txt": "content is not text", "locked.txt": "document is encrypted"}
    assert all(r["error_kind"] == "extraction" and r["text"] is None for r in found.values() if r["error"])
    assert files.read_documents(spark, str(tmp_path / "a.txt")).count() == 1
    assert files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_a_file_that_goes_is_a_row(tmp_path):
    (tmp_path / "a").write_text("x")
    share = files.Share([(str(tmp_path / "a"), 1), (str(tmp_path / "gone"), 1)])
    rows = list(files.rows_of(str(tmp_path), share, None))
    assert rows[0][2] == "x" and rows[1][2] is None and rows[1][3] == "extraction" and "gone" in rows[1][4]
    assert list(files.rows_of(str(tmp_path), files.Share([(str(tmp_path / "a"), 1)]), None))[0][4] is None


def test_many_small_files_and_few_large(spark, tmp_path):
    for i in range(300):
        (tmp_path / f"s{i}").write_text("small")
    for i in range(3):
        (tmp_path / f"l{i}").write_text("x" * 500_000)
    rows = files.read_documents(spark, str(tmp_path), share_bytes=1 << 20).select(F.spark_partition_id().alias("p"), "size")
    weights = [r["w"] for r in rows.groupBy("p").agg(F.sum(F.col("size") + files.OPEN_BYTES).alias("w")).collect()]
    assert len(weights) > 10 and max(weights) < 1.5 * min(weights)


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()

    def run():
        query = files.stream_documents(spark, str(src), settles=0).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
        query.awaitTermination()
        return sorted(r["text"] for r in spark.read.parquet(str(out)).collect())

    (src / "a").write_text("a")
    assert run() == ["a"]
    (src / "b").write_text("b")
    (src / "c").write_text("c")
    assert run() == ["a", "b", "c"]


def rows(spark, n, bad=-1):
    name = F.when(F.col("id") == bad, "x/y").otherwise(F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".md")))
    return spark.range(0, n, 1, 4).select(name.alias("name"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("content"))


def test_writing(spark, tmp_path):
    out = tmp_path / "out"
    files.write_files(rows(spark, 50), str(out))
    assert sorted(os.listdir(out)) == sorted(f"d{i}.md" for i in range(50)) and (out / "d7.md").read_text() == "é 7"
    files.write_files(rows(spark, 3), str(out), overwrite=True)
    assert sorted(os.listdir(out)) == ["d0.md", "d1.md", "d2.md"]


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = tmp_path / "out"
    files.write_files(rows(spark, 2), str(out))
    with pytest.raises(Exception, match="no name of a file"):
        files.write_files(rows(spark, 40, bad=39), str(out))
    with pytest.raises(Exception, match="same file"):
        files.write_files(rows(spark, 4).unionAll(rows(spark, 4)), str(out))
    assert sorted(os.listdir(out)) == ["d0.md", "d1.md"]


def test_a_report_for_each_document(spark, sf, tmp_path):
    from veilframe import report
    from veilframe.plans import queries as q

    records = q.runs(spark, sf).where("id < 6").withColumn("file_hash", F.sha2(F.col("id").cast("string"), 256))
    same = records.withColumn("file_hash", F.sha2(F.col("id").cast("string"), 512)).where("id = 3")
    report.write_reports(records.unionByName(same), str(tmp_path / "r"))
    names = sorted(os.listdir(tmp_path / "r"))
    n = records.count()
    assert len(names) == 2 * n + 2 and sum(x.endswith(".report.md") for x in names) == n + 1 and sum(x.startswith("3_redacted-") for x in names) == 4
    own = records.where("id = 4").select(report.markdown().alias("m"), report.json().alias("j")).first()
    assert (tmp_path / "r" / "4_redacted.report.md").read_text() == own["m"] and (tmp_path / "r" / "4_redacted.report.json").read_text() == own["j"]


def test_reports_of_files_of_one_name(spark, tmp_path, monkeypatch):
    """Files of one name and content keep a report each, with the hash of their content in the log."""
    import hashlib

    from veilframe import cli
    from veilframe.audit import AuditLog

    monkeypatch.setenv("VEILFRAME_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "p.yaml").write_text("subject:\n  display_name: Jane Corpus\n")
    for d in ("a", "b"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "x.txt").write_text("Jane Corpus was here")
    assert cli.main(["run", str(tmp_path / "in"), "--glob", "*.txt", "-p", str(tmp_path / "p.yaml"), "-o", str(tmp_path / "out"), "-q", "--reports"]) == 0
    assert len(os.listdir(tmp_path / "out" / "reports")) == 4
    rows = AuditLog(spark, cli.audit_path()).runs().collect()
    assert {r["file_hash"] for r in rows} == {hashlib.sha256(b"Jane Corpus was here").hexdigest()} and {r["pages_processed"] for r in rows} == {1}
