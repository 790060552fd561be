"""The audit log: append-only runs and the subjects they belong to, as Parquet files under a manifest.

Texts that survived are stored as hashes unless asked otherwise, so the log
holds no personal data. Runs get consecutive ids and lie in files by id; the
manifest has the last id and each file's first and last, so a run is looked up
in one file, the newest are read from the end, and no append scans the log.
Subjects lie in buckets by a hash of their id; a run rewrites only the buckets
that it touches. A write leaves its files beside the others and then creates the
next manifest, which fails if another writer has done so: that write starts
again from the other's state. A driver that dies on the way leaves the manifest
before, and its files are read by none.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import model

BUCKETS = 64
#: Writes that may come first before one gives up.
TRIES = 20


class Lost(Exception):
    """Another writer has created the manifest that this one was to create."""


class AuditLog:
    """The log below one folder. A missing log reads as an empty one."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # Files and manifests.

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _files(self):
        return self._path("manifests").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        fs, folder = self._files(), self._path("manifests")
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def _load(self, number: int) -> dict | None:
        stream = self._files().open(self._path(f"manifests/{number:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        except ValueError:  # a writer died in it
            return None
        finally:
            stream.close()

    def manifest(self) -> dict:
        """The newest whole one: its number, the last id, the files of the runs (path, first, last) and of the buckets."""
        for number in reversed(self._numbers()):
            if (found := self._load(number)) is not None:
                return found | {"number": number}
        return {"number": 0, "last": 0, "runs": [], "buckets": {}}

    def _commit(self, before: dict, after: dict) -> None:
        """Create the manifest after `before`, or lose to who has."""
        number = max(self._numbers(), default=0) + 1
        if self.manifest()["number"] != before["number"]:
            raise Lost
        fs = self._files()
        try:
            out = fs.create(self._path(f"manifests/{number:012d}.json"), False)
        except Exception as e:
            if "already exists" in str(e) or "FileAlreadyExists" in str(e):
                raise Lost from e
            raise
        out.write(bytearray(json.dumps({k: after[k] for k in ("last", "runs", "buckets")}).encode()))
        out.close()
        # What neither this manifest nor the one before names is gone for good.
        used = {*after["buckets"].values(), *before["buckets"].values()}
        for old in self._numbers():
            if old < before["number"]:
                for path in {*((self._load(old) or {}).get("buckets", {})).values()} - used:
                    fs.delete(self._path(path), True)
                fs.delete(self._path(f"manifests/{old:012d}.json"), False)

    def _change(self, work: Callable[[dict], dict]) -> None:
        for _ in range(TRIES):
            before = self.manifest()
            try:
                return self._commit(before, before | work(before))
            except Lost:
                continue
        raise RuntimeError(f"other writers came first {TRIES} times")

    def create(self) -> None:
        """A manifest, if there is none."""
        if not self._numbers():
            self._change(lambda m: {})

    # Reading.

    def _read(self, schema, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def runs(self) -> DataFrame:
        return self._read(model.AUDIT, [f["path"] for f in self.manifest()["runs"]])

    def subjects(self) -> DataFrame:
        return self._subjects(self.manifest()["buckets"])

    def _subjects(self, buckets: dict[str, str]) -> DataFrame:
        return self._read(model.SUBJECTS, sorted(buckets.values()))

    def recent(self, subject: str | None = None, limit: int = 20) -> DataFrame:
        """The newest runs; without a subject only the last files that hold as many are read."""
        if subject:
            return recent_runs(self.runs(), subject, limit)
        chosen, held = [], 0
        for f in sorted(self.manifest()["runs"], key=lambda f: -f["last"]):
            if held >= limit:
                break
            chosen.append(f["path"])
            held += f["last"] - f["first"] + 1
        return recent_runs(self._read(model.AUDIT, chosen), None, limit)

    def run(self, id_: int) -> DataFrame:
        """One run, from the one file that holds its id."""
        return run_by_id(self._read(model.AUDIT, [f["path"] for f in self.manifest()["runs"] if f["first"] <= id_ <= f["last"]]), id_)

    def subjects_by_use(self) -> DataFrame:
        return subjects_by_use(self.subjects())

    def subject(self, id_: str) -> DataFrame:
        """One subject, from the one bucket that may hold it."""
        bucket = str(self.spark.range(1).select(bucket_of(F.lit(id_))).first()[0])
        return subject_by_id(self._subjects({k: v for k, v in self.manifest()["buckets"].items() if k == bucket}), id_)

    # Writing.

    def log_runs(self, records: DataFrame, keep_texts: bool = False) -> None:
        """Append the records under new ids and bring the subjects of theirs up to date."""
        survivors = F.col("verification_survivors_json")
        hashed = F.to_json(F.transform(F.from_json(survivors, "array<string>"), lambda s: F.sha2(s, 256)))
        rows = records.withColumn("id", F.lit(None).cast("long")).withColumn("verification_survivors_json", survivors if keep_texts else hashed)
        rows = rows.select(*[F.col(f.name).cast(f.dataType) for f in model.AUDIT])
        staged = f"_staged-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{staged}")

        def work(m: dict) -> dict:
            name = f"documents/{uuid.uuid4().hex}"
            numbered(self._read(model.AUDIT, [staged]), m["last"]).write.parquet(f"{self.path}/{name}")
            own = self._read(model.AUDIT, [name])
            of = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
            files = [{"path": f"{name}/{r['f']}", "first": r["a"], "last": r["b"]} for r in own.groupBy(of.alias("f")).agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("a").collect()]
            last = max((f["last"] for f in files), default=m["last"])
            return {"last": last, "runs": [*m["runs"], *files], "buckets": m["buckets"] | self._merged(m, own.where("subject_id <> ''"), "subject_id", upsert_subjects)}

        try:
            self._change(work)
        finally:
            self._files().delete(self._path(staged), True)

    def add_subject(self, id_: str, display_name: str = "") -> None:
        """A new subject without documents, or another name for a known one."""
        row = self.spark.range(1).select(F.lit(id_).alias("id"), F.lit(display_name or id_).alias("display_name"), F.current_timestamp().alias("now"))
        self._change(lambda m: {"buckets": m["buckets"] | self._merged(m, row, "id", add_subjects)})

    def _merged(self, m: dict, rows: DataFrame, key: str, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> dict[str, str]:
        """New files of the buckets that the rows touch, merged with what these held."""
        touched = sorted(r[0] for r in rows.select(bucket_of(F.col(key))).distinct().collect())
        if not touched:
            return {}
        old = self._subjects({k: v for k, v in m["buckets"].items() if int(k) in touched})
        name = f"subjects/{uuid.uuid4().hex}"
        merge(old, rows).withColumn("bucket", bucket_of(F.col("id"))).repartition(F.col("bucket")).write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return {str(b): f"{name}/bucket={b}" for b in touched}


def bucket_of(id_) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(BUCKETS)).cast("int")


def numbered(rows: DataFrame, last: int) -> DataFrame:
    """The rows of a written table with ids from last + 1 on, without gaps: each partition starts after those before it."""
    part, within = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    counts = dict(rows.groupBy(part.alias("p")).count().collect())
    starts, at = [], last + 1
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(at)]
        at += counts[p]
    return rows.withColumn("id", (F.create_map(*starts)[part] + within).cast("long")) if starts else rows


def recent_runs(runs: DataFrame, subject: str | None = None, limit: int = 20) -> DataFrame:
    """The newest runs, of one subject if named: the filter reaches the scan, the rest is a top-k."""
    rows = runs.where(F.col("subject_id") == subject) if subject else runs
    return rows.orderBy(F.col("id").desc()).limit(limit)


def run_by_id(runs: DataFrame, id_: int) -> DataFrame:
    return runs.where(F.col("id") == id_)


def subject_by_id(subjects: DataFrame, id_: str) -> DataFrame:
    return subjects.where(F.col("id") == id_)


def subjects_by_use(subjects: DataFrame) -> DataFrame:
    """Every subject, the one used last first."""
    return subjects.orderBy(F.col("last_used_at").desc_nulls_last(), "id")


def upsert_subjects(subjects: DataFrame, runs: DataFrame) -> DataFrame:
    """Subjects after the runs: counts go up by one a run, new ones begin with the first. Runs without subject are left out."""
    new = runs.where("subject_id <> ''").groupBy(F.col("subject_id").alias("id")).agg(F.count("*").alias("n"), F.min("processed_at").alias("first"), F.max("processed_at").alias("last"))
    out = subjects.join(new, "id", "full_outer")
    return out.select(
        "id",
        F.coalesce("display_name", "id").alias("display_name"),
        F.coalesce("created_at", "first").alias("created_at"),
        F.greatest("last_used_at", "last").alias("last_used_at"),
        (F.coalesce("document_count", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("document_count"),
    )


def add_subjects(subjects: DataFrame, named: DataFrame) -> DataFrame:
    """Subjects after naming (id, display_name, now): counts stay, names are replaced."""
    new = named.select("id", F.col("display_name").alias("_name"), F.col("now").alias("_now"))
    out = subjects.join(new, "id", "full_outer")
    return out.select(
        "id", F.coalesce("_name", "display_name").alias("display_name"), F.coalesce("created_at", "_now").alias("created_at"), F.coalesce("last_used_at", "_now").alias("last_used_at"),
        F.coalesce("document_count", F.lit(0)).cast("long").alias("document_count"),
    )
