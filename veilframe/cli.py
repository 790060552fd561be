"""The command line: run, dry-run, verify, log, report, subject, vault, profile, init, version.

Inputs are folders or files of text or Parquet documents; the work itself is
done by the same plans as in a program.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import subprocess
import sys
import tempfile
import textwrap
import time
import traceback
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from itertools import chain
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import model, report
from veilframe.audit import AuditLog
from veilframe.errors import ProfileError, VaultError, VeilError
from veilframe.operators import summaries
from veilframe.plans.engine import Engine, checkpoint
from veilframe.profile import Profile, load_profile, mask_profile, parse_profile, template
from veilframe.sources import spans as sources
from veilframe.vault import Vault, key_provider, migrate_profile, secure_wipe

VERSION = "0.1.0"


def home() -> Path:
    return Path(os.environ.get("VEILFRAME_HOME", Path.home() / ".veilframe"))


def audit_path() -> str:
    return os.environ.get("VEILFRAME_DB", str(home() / "audit"))


def profile_path() -> Path:
    return Path(os.environ.get("VEILFRAME_PROFILE", home() / "profile.yaml"))


def session() -> SparkSession:
    spark = SparkSession.builder.appName("veilframe").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def open_vault(spark: SparkSession) -> Vault:
    return Vault(spark, home() / "profiles.vault", key_provider(home()))


def chosen_profile(spark: SparkSession, args: argparse.Namespace) -> Profile:
    if getattr(args, "client", None):
        profile = open_vault(spark).get_profile(args.client)
        if profile is None:
            raise VaultError(f"no profile {args.client}")
        return profile
    return load_profile(args.profile or profile_path())


def loaded_parser(name: str | None):
    """The function that `module:function` names."""
    if not name:
        return None
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def documents(spark: SparkSession, path: str, glob: str, parser=None, images: DataFrame | None = None) -> DataFrame:
    """(doc_id, path, text, has_images, error_kind, error, file_hash); ids are hashes of paths, so nothing is sorted in one task.

    Documents with recognised words in `images` have pictures.
    """
    docs = _documents(spark, path, glob, parser)
    if images is None:
        return docs
    seen = images.select(F.col("doc_id").alias("_seen")).distinct()
    return docs.join(seen, F.col("doc_id") == F.col("_seen"), "left").withColumn("has_images", F.col("_seen").isNotNull()).drop("_seen")


def _documents(spark: SparkSession, path: str, glob: str, parser) -> DataFrame:
    if path.endswith(".parquet"):
        docs = sources.read(spark, path)
        return docs.select("doc_id", F.concat(F.lit(path + "#"), F.col("doc_id").cast("string")).alias("path"), "text", F.lit(False).alias("has_images"), F.lit(None).cast("string").alias("error_kind"), F.lit(None).cast("string").alias("error"), F.sha2("text", 256).alias("file_hash"))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if os.path.isdir(path) else reader).load(path)
    opened = sources.open_documents(files, parser)
    return opened.select(F.xxhash64("path").alias("doc_id"), "path", "text", F.lit(False).alias("has_images"), "error_kind", "error", "file_hash")


def show(rows: Iterable[dict]) -> int:
    """The rows as a JSON list, written as they come; gives their number."""
    n = 0
    for n, row in enumerate(rows, 1):
        print("[" if n == 1 else ",")
        print(textwrap.indent(json.dumps(row, indent=2, default=str, ensure_ascii=False), "  "), end="")
    print("\n]" if n else "[]")
    return n


def stream(df: DataFrame) -> Iterator[dict]:
    """Rows a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def banner(quiet: bool) -> None:
    if not quiet:
        print(f"veilframe {VERSION}: find, hide and verify personal data")


def cmd_run(args) -> int:
    banner(args.quiet or args.json)
    spark = session()
    profile = chosen_profile(spark, args)
    began = time.monotonic()
    words = spark.read.schema(model.OCR_RAW).parquet(args.ocr_words) if args.ocr_words and not args.no_ocr else None
    docs = documents(spark, args.path, args.glob, loaded_parser(args.parser), words)
    engine = Engine(profile, threshold=args.threshold, contacts=args.contacts, guards=args.guards, granularity=args.granularity, force_ocr=args.force_ocr)
    run = engine.run_batch(docs, allow_ocr=not args.no_ocr, ocr_raw=words, check=not args.no_verify)
    out = args.output or f"{args.path.rstrip('/')}_redacted"
    run.spans.write.mode("overwrite").parquet(f"{out}/spans")
    paths = docs.select("doc_id", F.col("path").alias("input"), "file_hash")
    pages = run.spans.groupBy("doc_id").agg(F.max("page_num").alias("last_page"))
    results = run.results.join(paths, "doc_id").join(pages, "doc_id", "left").withColumn("output", report.output_path(F.col("input"), args.output, True))
    sources.span_documents(run.spans).join(results.select("doc_id", "output"), "doc_id").write.mode("overwrite").parquet(f"{out}/documents")
    totals = summaries.batch_totals(results, run.errors).first()
    now = datetime.now(UTC)
    left = run.survivors.groupBy(F.col("doc_id").alias("_doc")).agg(F.array_sort(F.collect_list("text")).alias("left"))
    records = results.join(left, F.col("doc_id") == F.col("_doc"), "left").select(
        "doc_id", "file_hash", report.base_name(F.col("input")).alias("original_filename"), report.base_name(F.col("output")).alias("output_filename"), F.lit(now).alias("processed_at"),
        F.lit(profile.name or profile.subject.display_name).alias("profile_name"), F.lit(args.subject or "").alias("subject_id"), (F.coalesce("last_page", F.lit(0)) + 1).alias("pages_processed"), F.col("detections").alias("items_detected"),
        F.col("detections").alias("items_redacted"), "verification_passed", F.coalesce(F.to_json("left"), F.lit("[]")).alias("verification_survivors_json"), F.lit(int(1000 * (time.monotonic() - began))).alias("duration_ms"), F.lit("").alias("notes"),
    )
    AuditLog(spark, audit_path()).log_runs(records)
    if args.reports and not args.no_report:
        report.write_reports(records, f"{out}/reports")
    if not args.no_report:
        report.write_batch_summary(results, run.errors, f"{out}/redacted-reports", now.strftime("%Y-%m-%d-%H%M"))
    if args.json:
        show(chain(stream(results.drop("file_hash", "last_page")), (r | {"error": True} for r in stream(run.errors))))
    elif not args.quiet:
        print(f"{totals['ok']} processed, {totals['errored']} errored, {totals['total_detections']} detections -> {out}")
        for r in stream(run.errors):
            print(f"  {r['path']} [{r['category']}] {r['message']} -> {r['mitigation']}", file=sys.stderr)
    return totals["exit_code"]


def cmd_dry_run(args) -> int:
    spark = session()
    found = Engine(chosen_profile(spark, args), args.threshold).dry_run(sources.document_spans(documents(spark, args.path, args.glob, loaded_parser(args.parser)).where("error IS NULL")))
    if args.json:
        show(stream(found))
        return 0
    n = 0
    for n, r in enumerate(stream(found), 1):
        print(f"{r['file']}  {r['page']:>4}  {r['entity_type']:<20} {r['score']:>5.2f}  {r['text'][:40]}")
    print(f"{n} detection(s)." if n else "No PII detected.")
    return 0 if n else 1


def cmd_verify(args) -> int:
    spark = session()
    began = time.monotonic()
    out = Engine(chosen_profile(spark, args), args.threshold).verify(sources.document_spans(documents(spark, args.path, args.glob, loaded_parser(args.parser)).where("error IS NULL")))
    left = checkpoint(out.where("NOT passed").select("doc_id", F.explode("survivors").alias("s")).select("doc_id", "s.page_num", "s.entity_type", "s.text"))
    n = left.count()
    if args.json:
        print(f'{{"passed": {json.dumps(not n)}, "duration_ms": {int(1000 * (time.monotonic() - began))}, "survivors":')
        show(r["text"] for r in stream(left))
        print("}")
    else:
        print("clean" if not n else f"{n} survivor(s)")
        for r in left.limit(5).collect():
            print(f"  {r['doc_id']} page {r['page_num']}: [{r['entity_type']}] {r['text'][:40]}")
    return 1 if n else 0


def cmd_log(args) -> int:
    rows = list(stream(AuditLog(session(), audit_path()).recent(args.subject or None, args.limit)))
    if args.json:
        show(rows)
    elif not rows:
        print("No audit log entries found.")
    else:
        for r in rows:
            mark = {None: "-", True: "✅", False: "❌"}[r["verification_passed"]]
            print(f"{r['id']:>4}  {(r['original_filename'] or '')[:28]:<30} {(r['subject_id'] or '')[:13]:<15} {r['items_detected']:>4} {mark}  {r['processed_at']}")
    return 0


def cmd_report(args) -> int:
    row = AuditLog(session(), audit_path()).run(args.id).select(report.markdown()).first()
    print(row[0] if row else f"No run {args.id}.")
    return 0 if row else 1


def cmd_subject(args) -> int:
    log = AuditLog(session(), audit_path())
    if args.action == "add":
        log.add_subject(args.id, args.name or args.id)
        return 0
    n = show(stream(log.subjects_by_use() if args.action == "list" else log.subject(args.id)))
    return 0 if n or args.action == "list" else 1


def cmd_init(args) -> int:
    home().mkdir(parents=True, exist_ok=True)
    AuditLog(session(), audit_path()).create()
    print(f"ready: {home()}")
    known = f"{profile_path()} is in use; a vault keeps profiles sealed" if profile_path().exists() else "no profile yet: `profile template --output FILE` writes one to fill in"
    print(f"{known}: `profile add CLIENT --from FILE`", file=sys.stderr)
    return 0


def cmd_vault(args) -> int:
    vault = open_vault(session())
    if not vault.path.exists():
        vault.save(vault.open())
    print(vault.path)
    return 0


def cmd_profile(args) -> int:
    if args.action == "template":
        text = template(args.name or "")
        Path(args.output).write_text(text, encoding="utf-8") if args.output else print(text, end="")
        return 0
    vault = open_vault(session())
    if args.action in ("add", "import"):
        if args.action == "add" and not args.dry_run and vault.get_profile(args.client or Path(args.source).stem):
            raise VaultError(f"profile {args.client} exists")
        print(migrate_profile(vault, args.source, args.client, args.dry_run, args.keep_source))
    elif args.action == "list":
        show(vault.list_profiles())
    elif args.action == "show":
        profile = vault.get_profile(args.client)
        if profile is None:
            raise VaultError(f"no profile {args.client}")
        if args.reveal and not (sys.stdin.isatty() and input("Show values in clear? [y/N] ").lower() == "y"):
            raise VaultError("values are shown in clear on a terminal only")
        print(json.dumps(profile.model_dump() if args.reveal else mask_profile(profile), indent=2, default=str, ensure_ascii=False))
    elif args.action == "delete":
        if not args.yes and input(f"Delete {args.client}? [y/N] ").lower() != "y":
            return 1
        vault.delete_profile(args.client)
    elif args.action == "rename":
        vault.rename_profile(args.client, args.new)
    elif args.action == "edit":
        edit_profile(vault, args.client)
    return 0


def edit_profile(vault: Vault, client: str) -> None:
    """The profile in an editor; what comes back is validated before it is stored, and the copy is wiped."""
    import yaml

    profile = vault.get_profile(client)
    if profile is None:
        raise VaultError(f"no profile {client}")
    fd, name = tempfile.mkstemp(suffix=".yaml")
    try:
        with os.fdopen(fd, "w", encoding="utf-8") as f:
            f.write(yaml.safe_dump(profile.model_dump(), allow_unicode=True, sort_keys=False))
        subprocess.run([os.environ.get("EDITOR", "vi"), name], check=True)
        vault.update_profile(client, parse_profile(yaml.safe_load(Path(name).read_text(encoding="utf-8"))))
    finally:
        secure_wipe(name)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="veilframe")
    top.add_argument("-V", "--version", action="version", version=VERSION)
    sub = top.add_subparsers(dest="command", required=True)
    for name, f in (("run", cmd_run), ("dry-run", cmd_dry_run), ("verify", cmd_verify)):
        p = sub.add_parser(name)
        p.set_defaults(call=f)
        p.add_argument("path")
        p.add_argument("-p", "--profile")
        p.add_argument("-c", "--client")
        p.add_argument("-t", "--threshold", type=float, default=0.5)
        p.add_argument("--glob", default="*.txt")
        p.add_argument("--parser", help="module:function from the bytes of a document to its text")
        p.add_argument("--json", action="store_true")
        p.add_argument("--debug", action="store_true")
        if name == "run":
            p.add_argument("-o", "--output")
            p.add_argument("-s", "--subject", default="")
            p.add_argument("-q", "--quiet", action="store_true")
            p.add_argument("--granularity", choices=("span", "match"), default="span")
            p.add_argument("--ocr-words", help="Parquet table of recognised words")
            p.add_argument("--reports", "--per-file-reports", action="store_true")
            for flag in ("--contacts", "--guards", "--force-ocr", "--no-ocr", "--no-verify", "--no-report"):
                p.add_argument(flag, action="store_true")
    p = sub.add_parser("log")
    p.set_defaults(call=cmd_log)
    p.add_argument("-s", "--subject", default="")
    p.add_argument("-n", "--limit", type=int, default=20)
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("report")
    p.set_defaults(call=cmd_report)
    p.add_argument("id", type=int)
    p = sub.add_parser("subject")
    p.set_defaults(call=cmd_subject)
    p.add_argument("action", choices=("add", "list", "show"))
    p.add_argument("id", nargs="?", default="")
    p.add_argument("-n", "--name", default="")
    sub.add_parser("init").set_defaults(call=cmd_init)
    sub.add_parser("vault").set_defaults(call=cmd_vault)
    sub.add_parser("version").set_defaults(call=lambda a: print(VERSION) or 0)
    p = sub.add_parser("profile")
    p.set_defaults(call=cmd_profile)
    p.add_argument("action", choices=("add", "list", "template", "show", "delete", "rename", "import", "edit"))
    p.add_argument("client", nargs="?")
    p.add_argument("new", nargs="?")
    p.add_argument("--from", dest="source")
    p.add_argument("--name")
    p.add_argument("--output")
    for flag in ("--keep-source", "--dry-run", "--reveal", "--yes"):
        p.add_argument(flag, action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.call(args)
    except (VeilError, ProfileError) as e:
        if getattr(args, "debug", False):
            traceback.print_exc()
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
