"""Profiles, vault, audit log, reports, sources, streaming and the command line."""

import json
import os

import pytest
from pyspark.sql import functions as F

from veilframe import cli, model, profile, report, vault
from veilframe.audit import AuditLog
from veilframe.errors import ProfileError, SecurityError, VaultError
from veilframe.sources import spans as sources
from veilframe.streaming import runs

GOOD = "version: 1\nsubject:\n  display_name: Jane Corpus\n  account_numbers:\n    # none yet\n  phones: ['12345']\n  custom_patterns:\n    - {name: N, regex: '77'}\n"


@pytest.fixture
def good(tmp_path):
    p = tmp_path / "jane.yaml"
    p.write_text(GOOD)
    return p


def test_profile_loads_and_saves(good, tmp_path, spark):
    p = profile.load_profile(good)
    assert p.subject.account_numbers == [] and p.detection.match_threshold == 0.85
    profile.save_profile(p, tmp_path / "x" / "y.yaml")
    assert profile.load_profile(tmp_path / "x" / "y.yaml") == p
    assert profile.profile_frame(spark, p).first()["subject"]["display_name"] == "Jane Corpus"


@pytest.mark.parametrize(
    "text", [None, "a: [", "- 1", "version: 1\nsubject: {}", "subject: {display_name: ' '}", "version: 2\nsubject: {display_name: a}", "subject: {display_name: a}\ndetection: {match_threshold: 1.5}", "subject: {display_name: a, custom_patterns: [{name: n, regex: '[unclosed'}]}"]
)
def test_bad_profiles(tmp_path, text):
    path = tmp_path / "p.yaml"
    if text is not None:
        path.write_text(text)
    with pytest.raises(ProfileError):
        profile.load_profile(path)


def test_masks_and_template(good, tmp_path):
    p = profile.parse_profile({"subject": {"display_name": "Jane Q Corpus", "aliases": ["JC"], "phones": ["12345678"], "ssns": ["1"], "account_numbers": [{"value": "99998888"}]}})
    m = profile.mask_profile(p)["subject"]
    assert (m["display_name"], m["aliases"], m["phones"], m["ssns"], m["account_numbers"][0]["value"]) == ("J*** Q C***", ["J***"], ["****5678"], ["1"], "****8888")
    path = tmp_path / "t.yaml"
    path.write_text(profile.template("Ann"))
    assert profile.load_profile(path).subject.display_name == "Ann"
    assert profile.ocr_terms(p) == ["1", "12345678", "99998888", "corpus", "jane", "jc", "q"]


@pytest.fixture
def store(spark, tmp_path):
    return vault.Vault(spark, tmp_path / "v" / "p.vault", vault.FileKeys(tmp_path / "key"))


def test_vault(store, good):
    p = profile.load_profile(good)
    assert store.open() == vault.empty_payload()
    store.add_profile("a", p, notes="n")
    with pytest.raises(VaultError):
        store.add_profile("a", p)
    assert store.get_profile("a") == p and store.get_profile("zz") is None
    store.rename_profile("a", "b")
    for pair in (("a", "c"), ("b", "b")):
        with pytest.raises(VaultError):
            store.rename_profile(*pair)
    with pytest.raises(VaultError):
        store.update_profile("a", p)
    store.update_profile("b", p)
    assert [e["client_id"] for e in store.list_profiles()] == ["b"]
    blob = store.path.read_bytes()
    assert blob.startswith(vault.MAGIC) and b"Jane" not in blob
    store.path.write_bytes(blob[:-1] + bytes([blob[-1] ^ 1]))
    with pytest.raises(VaultError, match="tampered"):
        store.open()
    store.path.write_bytes(b"NOTAVALT" + blob[8:])
    with pytest.raises(VaultError, match="not a vault"):
        store.open()
    store.path.write_bytes(b"x")
    with pytest.raises(VaultError, match="short"):
        store.open()
    store.path.write_bytes(blob)
    os.chmod(store.path, 0o644)
    with pytest.raises(SecurityError):
        store.open()
    os.chmod(store.path, 0o600)
    store.delete_profile("b")
    store.delete_profile("b")
    assert store.list_profiles() == []


def test_nonces_differ(store):
    assert len({store.seal(b"x")[8:20] for _ in range(5)}) == 5


def test_short_key(spark, tmp_path):
    (tmp_path / "key").write_text("00")
    os.chmod(tmp_path / "key", 0o600)
    with pytest.raises(VaultError, match="32"):
        vault.Vault(spark, tmp_path / "x", vault.FileKeys(tmp_path / "key")).save({})


def test_migration(store, good):
    assert vault.migrate_profile(store, good, dry_run=True) == "added" and store.list_profiles() == []
    assert vault.migrate_profile(store, good, keep_source=True) == "added" and good.exists()
    assert vault.migrate_profile(store, good) == "updated" and not good.exists()


def record(spark, n, subject="s", passed=True, survivors="[]"):
    base = spark.range(n).select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name != "id" else F.col("id") for f in model.AUDIT])
    return base.withColumns({"subject_id": F.lit(subject), "processed_at": F.timestamp_seconds(F.col("id") * 60), "verification_passed": F.lit(passed), "verification_survivors_json": F.lit(survivors), "original_filename": F.lit("a.pdf"), "items_detected": F.lit(2).cast("long"), "duration_ms": F.lit(5).cast("long")})


def test_audit_log(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    assert log.runs().count() == 0 and log.subjects().count() == 0
    log.create()
    log.log_runs(record(spark, 5))
    log.log_runs(record(spark, 20, "", False, '["secret"]'))
    assert [r["id"] for r in log.recent(limit=3).collect()] == sorted((r["id"] for r in log.runs().collect()), reverse=True)[:3]
    assert log.recent().count() == 20 and log.recent("s").count() == 5
    assert [(r["id"], r["document_count"]) for r in log.subjects().collect()] == [("s", 5)]
    assert "secret" not in "".join(r["verification_survivors_json"] for r in log.runs().collect())
    log.add_subject("s", "New name")
    log.add_subject("t")
    assert {(r["id"], r["display_name"], r["document_count"]) for r in log.subjects_by_use().collect()} == {("s", "New name", 5), ("t", "t", 0)}
    assert log.subject("none").count() == 0
    assert log.run(log.recent().first()["id"]).count() == 1


def test_reports(spark, tmp_path):
    one = record(spark, 1, passed=False, survivors='["x", "y"]')
    text = one.select(report.markdown()).first()[0]
    assert "**Subject:** s" in text and "❌ Failed — 2 PII" in text and "- `x`\n- `y`" in text and text.endswith(report.FOOTER)
    skipped = record(spark, 1, "").withColumn("verification_passed", F.lit(None).cast("boolean"))
    assert "N/A (skipped)" in skipped.select(report.markdown()).first()[0]
    data = json.loads(one.select(report.json()).first()[0])
    assert len(data) == 12 and data["verification_survivors"] == ["x", "y"] and data["notes"] is None and "file_hash" not in data
    results = spark.createDataFrame([(1, "/a/b.pdf", "/a/b_redacted.pdf", 3, True, 0)], "doc_id long, input string, output string, detections long, verification_passed boolean, survivors long")
    errors = spark.createDataFrame([(2, "/a/c.pdf", "CORRUPT", "bad", "export again")], model.FAILURES)
    md, js = report.write_batch_summary(results, errors, str(tmp_path / "r"), "2024-01-02-0304")
    lines = "\n".join(r[0] for r in spark.read.text(md).collect())
    assert "**Total:** 2  **OK:** 1  **Errors:** 1" in lines and "| ✗ | c.pdf | — | — | [CORRUPT] export again |" in lines
    assert spark.read.json(js).count() == 2


def test_collect_inputs(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for n in ("d/b.pdf", "d/e/a.pdf", "d/c.txt"):
        (tmp_path / n).write_text("x")
    assert [r["path"].rsplit("/", 1)[1] for r in sources.collect_inputs(spark, str(tmp_path / "d")).collect()] == ["b.pdf", "a.pdf"]
    assert sources.collect_inputs(spark, str(tmp_path / "d" / "c.txt")).count() == 1
    assert sources.collect_inputs(spark, str(tmp_path / "none")).count() == 0


def test_open_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hé")
    (tmp_path / "b.pdf").write_bytes(b"%PDF-1.4 /Encrypt")
    (tmp_path / "c.bin").write_bytes(b"\xff\xfe\x00")
    rows = {r["path"][-5:]: (r["text"], r["error"]) for r in sources.open_documents(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert rows["a.txt"] == ("hé", None) and rows["b.pdf"] == (None, "document is encrypted") and rows["c.bin"] == (None, "content is not text")


def test_stream(spark, tmp_path, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.limit(40).repartition(2).write.parquet(str(tmp_path / "in"))
    p = profile.parse_profile({"subject": {"display_name": " x", "custom_patterns": [{"name": "N", "regex": r"\b[0-9]{16}\b"}]}})
    q = runs.redact_documents(spark, str(tmp_path / "in"), docs.schema, p, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "results")).count() == 40
    assert not runs.detect_stream(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), p).isStreaming is False
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.write.parquet(str(tmp_path / "ev"))
    out = runs.hits_by_window(spark.readStream.schema(events.schema).parquet(str(tmp_path / "ev")))
    q = out.writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(runs) from hits").first()[0] == events.count()


def test_command_line(spark, tmp_path, monkeypatch, capsys, good):
    monkeypatch.setenv("VEILFRAME_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    inputs = tmp_path / "docs"
    inputs.mkdir()
    (inputs / "a.txt").write_text("Dear Jane Corpus\nnumber 77\nplain")
    (inputs / "b.txt").write_text("nothing here")
    assert cli.main(["init"]) == 0
    assert cli.main(["dry-run", str(inputs), "--profile", str(good), "--json"]) == 0
    assert len(json.loads(capsys.readouterr().out.split("\n", 1)[1])) == 2
    assert cli.main(["verify", str(inputs), "--profile", str(good)]) == 1
    assert cli.main(["run", str(inputs), "--profile", str(good), "--output", str(tmp_path / "out"), "--subject", "jane", "--reports"]) == 0
    text = [r["text"] for r in spark.read.parquet(str(tmp_path / "out" / "spans")).collect()]
    assert "plain" in text and not any("77" in t or "Corpus" in t for t in text)
    assert cli.main(["log"]) == 0 and "a.txt" in capsys.readouterr().out
    assert cli.main(["subject", "show", "jane"]) == 0 and cli.main(["subject", "show", "nobody"]) == 1
    assert cli.main(["report", "99999999"]) == 1
    assert cli.main(["vault"]) == 0
    assert cli.main(["profile", "add", "jane", "--from", str(good), "--keep-source"]) == 0
    assert cli.main(["profile", "add", "jane", "--from", str(good)]) == 1
    capsys.readouterr()
    assert cli.main(["profile", "show", "jane"]) == 0 and "J*** C***" in capsys.readouterr().out
    assert cli.main(["profile", "rename", "jane", "ann"]) == 0
    assert cli.main(["verify", str(inputs), "--client", "ann"]) == 1
    assert cli.main(["profile", "delete", "ann", "--yes"]) == 0
    assert cli.main(["profile", "template", "--output", str(tmp_path / "t.yaml")]) == 0
    assert cli.main(["run", str(inputs), "--profile", str(tmp_path / "missing.yaml")]) == 1


def test_secrets_stay_out_of_plans(spark, store, good, monkeypatch):
    """No frame is made to seal or open a vault: key and profile cannot stand in a plan."""
    from pyspark.sql import SparkSession

    for name in ("range", "createDataFrame", "sql"):
        monkeypatch.setattr(SparkSession, name, lambda *a, **b: pytest.fail("a plan was made"))
    store.add_profile("a", profile.load_profile(good))
    assert store.get_profile("a").subject.display_name == "Jane Corpus"
    assert (store.path.with_suffix(".salt").stat().st_mode & 0o777, store.path.with_suffix(".salt").stat().st_size) == (0o600, 32)


def test_vault_format_is_that_of_the_columns(spark, store):
    blob, key = store.seal("{\"ä\": 1}".encode()), store.keys.get_or_create_master_key()
    payload, error = vault.decrypt(F.lit(blob), F.lit(key))
    assert spark.range(1).select(payload, error).first()[:] == ('{"ä": 1}', None)
    other = spark.range(1).select(vault.encrypt(F.lit("text"), F.lit(key), F.lit(b"x" * 12))).first()[0]
    assert store.unseal(bytes(other)) == "text"


def test_ids_of_runs_are_consecutive(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.log_runs(record(spark, 7).repartition(3))
    log.log_runs(record(spark, 0))
    log.log_runs(record(spark, 50).repartition(5))
    assert sorted(r["id"] for r in log.runs().collect()) == list(range(1, 58))


def test_a_broken_write_leaves_the_subjects(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.add_subject("a")
    log.add_subject("b")
    half = tmp_path / "audit" / "subjects" / "v000000000009"
    half.mkdir()
    (half / "part-0.parquet").write_bytes(b"PAR1")
    assert {r["id"] for r in log.subjects().collect()} == {"a", "b"}
    log.add_subject("c")
    assert {r["id"] for r in AuditLog(spark, str(tmp_path / "audit")).subjects().collect()} == {"a", "b", "c"}


def read_files(df):
    return {f.split("/audit/")[1] for f in df.inputFiles()}


def test_a_run_is_looked_up_in_one_file(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    for n in (30, 1, 40):
        log.log_runs(record(spark, n, "").repartition(4))
    files = log.manifest()["runs"]
    assert log.manifest()["last"] == 71 and len(files) >= 7
    assert sorted(i for f in files for i in range(f["first"], f["last"] + 1)) == list(range(1, 72))
    for id_ in (1, 30, 31, 32, 71):
        assert len(read_files(log.run(id_))) == 1 and [r["id"] for r in log.run(id_).collect()] == [id_]
    assert log.run(72).count() == 0
    assert [r["id"] for r in log.recent(limit=12).collect()] == list(range(71, 59, -1))
    assert len(read_files(log.recent(limit=12))) < len(files)


def test_only_touched_buckets_are_written(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.log_runs(record(spark, 300).withColumn("subject_id", F.concat(F.lit("s"), F.col("id").cast("string"))))
    before = log.manifest()["buckets"]
    log.log_runs(record(spark, 4, "s7"))
    after = log.manifest()["buckets"]
    changed = [k for k in after if after[k] != before.get(k)]
    assert len(before) > 50 and len(changed) == 1
    counts = {r["id"]: r["document_count"] for r in log.subjects().collect()}
    assert len(counts) == 300 and counts["s7"] == 5 and sum(counts.values()) == 304
    assert len({f.rsplit("/", 1)[0] for f in log.subject("s7").inputFiles()}) == 1 and log.subject("s7").first()["document_count"] == 5


def test_two_writers_cannot_both_win(spark, tmp_path):
    one, other = AuditLog(spark, str(tmp_path / "audit")), AuditLog(spark, str(tmp_path / "audit"))
    one.create()
    real, met = one._merged, []

    def meanwhile(*a):
        if not met:  # another run is logged while this one is at work
            met.append(other.log_runs(record(spark, 3, "x")))
        return real(*a)

    one._merged = meanwhile
    one.log_runs(record(spark, 2, "x"))
    assert sorted(r["id"] for r in one.runs().collect()) == [1, 2, 3, 4, 5]
    assert one.subject("x").first()["document_count"] == 5 and one.manifest()["last"] == 5


def test_a_half_written_manifest_is_passed_over(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    log.log_runs(record(spark, 2, "a"))
    (tmp_path / "audit" / "manifests" / "000000000007.json").write_text('{"last": 9, "ru')
    assert log.manifest()["last"] == 2
    log.log_runs(record(spark, 1, "a"))
    assert log.manifest()["number"] == 8 and log.subject("a").first()["document_count"] == 3


SHOUT = """def shout(content):
    if b"broken" in content:
        raise ValueError("cannot parse")
    return content[5:].decode("latin-1").upper()
"""


@pytest.fixture(scope="module")
def shout(spark, tmp_path_factory):
    """A parser in a module that driver and workers can import."""
    path = tmp_path_factory.mktemp("parser") / "shouting.py"
    path.write_text(SHOUT)
    spark.sparkContext.addPyFile(str(path))
    return cli.loaded_parser("shouting:shout")


def test_parser_of_binary_documents(spark, tmp_path, shout):
    for name, content in {"a.pdf": b"%PDF-hello", "b.pdf": b"%PDF-broken", "c.pdf": b"%PDF-1 /Encrypt", "d.txt": b"plain", "e.bin": b"\xff\xfe\xfd\xfc\xfbx"}.items():
        (tmp_path / name).write_bytes(content)
    files = spark.read.format("binaryFile").load(str(tmp_path))
    rows = {r["path"][-5:]: (r["text"], r["error_kind"], r["error"]) for r in sources.open_documents(files, shout).collect()}
    assert rows == {"a.pdf": ("HELLO", None, None), "b.pdf": (None, "extraction", "cannot parse"), "c.pdf": (None, "extraction", "document is encrypted"), "d.txt": ("plain", None, None), "e.bin": ("X", None, None)}


def test_spans_back_to_documents(spark):
    docs = spark.createDataFrame([(1, "a\n\n b \nc\n"), (2, "\nx"), (3, " \n")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in sources.span_documents(sources.document_spans(docs)).collect()} == {1: "a\n\nb\nc", 2: "\nx"}
    turns = spark.createDataFrame([(1, 0, "a"), (1, 1, "\nb")], "conv_id long, turn int, text string")
    assert sources.span_documents(sources.conversation_spans(turns)).first()["text"] == "a\f\nb"


def test_run_options(spark, tmp_path, monkeypatch, capsys, good, shout):
    monkeypatch.setenv("VEILFRAME_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    inputs = tmp_path / "docs"
    inputs.mkdir()
    (inputs / "a.txt").write_text("Dear Jane Corpus\nplain")
    (inputs / "b.pdf").write_bytes(b"%PDF-number 77")
    path = sources.open_documents(spark.read.format("binaryFile").load(str(inputs / "a.txt"))).select(F.xxhash64("path")).first()[0]
    words = [(path, 0, 0, "corpus", "91", 10.0, 10.0, 60.0, 12.0), (path, 0, 1, "other", "95", 90.0, 10.0, 60.0, 12.0)]
    spark.createDataFrame(words, model.OCR_RAW).write.parquet(str(tmp_path / "words"))
    base = ["run", str(inputs), "-p", str(good), "--glob", "*", "--parser", "shouting:shout", "--json"]

    def results(*more):
        out = str(tmp_path / f"out{len(list(tmp_path.iterdir()))}")
        capsys.readouterr()
        cli.main([*base, "-o", out, *more])
        rows = json.loads(capsys.readouterr().out)
        return {os.path.basename(r["input"]): r for r in rows}, out

    plain, out = results()
    assert {k: v["detections"] for k, v in plain.items()} == {"a.txt": 1, "b.pdf": 1} and plain["a.txt"]["verification_passed"] is True
    assert os.path.isdir(f"{out}/redacted-reports") and spark.read.parquet(f"{out}/documents").count() == 2
    forced, _ = results("--ocr-words", str(tmp_path / "words"), "--force-ocr", "-q")
    assert forced["a.txt"]["detections"] == 2
    none, out = results("--ocr-words", str(tmp_path / "words"), "--force-ocr", "--no-ocr", "--no-verify", "--no-report")
    assert none["a.txt"]["detections"] == 1 and none["a.txt"]["verification_passed"] is None and not os.path.exists(f"{out}/redacted-reports")
    assert cli.main(["run", str(inputs), "-p", str(tmp_path / "missing.yaml"), "--debug"]) == 1 and "Traceback" in capsys.readouterr().err
    assert cli.main(["verify", str(inputs), "-p", str(good), "--json"]) == 1
    assert json.loads(capsys.readouterr().out) == {"passed": False, "survivors": ["Dear Jane Corpus"], "duration_ms": pytest.approx(0, abs=1e9)}


def test_survivors_are_logged(spark, tmp_path, monkeypatch, good):
    """What a failed verification finds reaches the audit row, hashed, and the report's count."""
    from veilframe.plans import engine

    monkeypatch.setenv("VEILFRAME_HOME", str(tmp_path / "home"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "a.txt").write_text("number 77 and 77\nplain")
    monkeypatch.setattr(engine.redact, "redact_spans", lambda spans, *a: spans.withColumn("hits", F.lit(0)))
    cli.main(["run", str(tmp_path / "a.txt"), "-p", str(good), "-o", str(tmp_path / "out"), "-q"])
    row = AuditLog(spark, cli.audit_path()).recent().first()
    assert row["verification_passed"] is False and len(json.loads(row["verification_survivors_json"])) == 2 and "77" not in json.loads(row["verification_survivors_json"])
    assert "2 PII item(s) survived" in AuditLog(spark, cli.audit_path()).run(row["id"]).select(report.markdown()).first()[0]
