"""Files of documents as data sources of Spark's own: read in even shares, written one a document.

`veilframe_documents` reads the files below a folder as rows, in batch or as a
stream. Files are dealt into partitions by size, the largest first to the
lightest partition, and each file counts for what opening it costs as well, so
three large files and ten thousand small ones make tasks of like size. A file
that cannot be read or parsed is a row with an error, never a failed task.

`veilframe_files` writes each row (name, content) as a file of its own. Tasks
write below a hidden folder of the job; their commit messages name what they
wrote, and only a job that succeeds moves it in place. A job that fails removes
the folder, whatever its tasks had written.

Paths and URIs go through Arrow's file systems, so tasks reach what Arrow does.
"""

from __future__ import annotations

import fnmatch
import heapq
import importlib
import posixpath
import time
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from veilframe.cluster import ship

READS, WRITES = "veilframe_documents", "veilframe_files"
SCHEMA = "path string, size long, text string, error_kind string, error string"
#: Bytes that a partition should read, and what opening a file counts for.
SHARE_BYTES, OPEN_BYTES = 32 << 20, 64 << 10
#: Seconds that a stream leaves a file before it takes it, so that no other can get an earlier time.
SETTLES = 2.0


@dataclass
class Share(InputPartition):
    files: list[tuple[str, int]]


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str, glob: str) -> list[tuple[str, int, int]]:
    """(path, size, time in ns) of the files below a folder whose name fits, or of one file; hidden ones are left out."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(info.path, info.size, info.mtime_ns or 0)]
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda p: any(x.startswith((".", "_")) for x in posixpath.relpath(p, root).split("/"))
    return sorted((i.path, i.size, i.mtime_ns or 0) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob) and not hidden(i.path))


def shares(files: list[tuple[str, int]], share: int = SHARE_BYTES, cost: int = OPEN_BYTES) -> list[Share]:
    """The files in partitions of like weight; a file over the share is one alone."""
    total = sum(size + cost for _, size in files)
    n = max(1, min(len(files), -(-total // share)))
    heap: list[tuple[int, int]] = [(0, i) for i in range(n)]
    out: list[list[tuple[str, int]]] = [[] for _ in range(n)]
    for path, size in sorted(files, key=lambda f: (-f[1], f[0])):
        weight, i = heap[0]
        out[i].append((path, size))
        heapq.heapreplace(heap, (weight + size + cost, i))
    return [Share(f) for f in out if f]


def parsed(content: bytes, parser: str | None) -> tuple[str | None, str | None]:
    """(text, error): UTF-8 text as it is, other content by the parser."""
    binary = content.startswith(b"%PDF")
    if not binary:
        try:
            return content.decode("utf-8"), None
        except UnicodeDecodeError:
            pass
    if binary and b"/Encrypt" in content:
        return None, "document is encrypted"
    if not parser:
        return None, "no parser for this format is configured" if binary else "content is not text"
    module, _, name = parser.partition(":")
    return getattr(importlib.import_module(module), name)(content), None


def rows_of(root: str, share: Share | None, parser: str | None) -> Iterator[tuple]:
    """Spark asks for one partition, None, where there are no files."""
    system, _ = opened(root)
    for path, size in share.files if share else ():
        try:
            with system.open_input_stream(path) as f:
                text, error = parsed(f.read(), parser)
        except Exception as e:  # noqa: BLE001 - whatever reading or parsing raises is the document's error
            text, error = None, str(e) or type(e).__name__
        yield path, size, text, "extraction" if error else None, error


class Files:
    """What batch and stream readers share."""

    def __init__(self, options: dict[str, str]):
        self.path, self.glob, self.parser = options["path"], options.get("glob", "*"), options.get("parser") or None
        self.share = int(options.get("sharebytes", SHARE_BYTES))
        self.settles = float(options.get("settles", SETTLES))


class DocumentReader(Files, DataSourceReader):
    def partitions(self):
        return shares([(p, n) for p, n, _ in listed(self.path, self.glob)], self.share)

    def read(self, partition):
        return rows_of(self.path, partition, self.parser)


class DocumentStream(Files, DataSourceStreamReader):
    """New files by the time of their last change; the offset is the last time taken."""

    def initialOffset(self) -> dict:
        return {"ns": -1}

    def latestOffset(self) -> dict:
        before = time.time_ns() - int(self.settles * 1e9)
        return {"ns": max((t for _, _, t in listed(self.path, self.glob) if t <= before), default=-1)}

    def partitions(self, start: dict, end: dict):
        return shares([(p, n) for p, n, t in listed(self.path, self.glob) if start["ns"] < t <= end["ns"]], self.share)

    def read(self, partition):
        return rows_of(self.path, partition, self.parser)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class Documents(DataSource):
    @classmethod
    def name(cls) -> str:
        return READS

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return DocumentReader(self.options)

    def streamReader(self, schema):
        return DocumentStream(self.options)


@dataclass
class Wrote(WriterCommitMessage):
    folder: str
    names: list[str]


class FileWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator) -> Wrote:
        system, root = opened(self.path)
        task = TaskContext.get()
        folder = f"{root}/{self.job}/{task.partitionId()}-{task.taskAttemptId()}"
        names = []
        for row in iterator:
            name = row["name"]
            if not name or name.startswith((".", "_")) or "/" in name:
                raise ValueError(f"{name!r} is no name of a file")
            if not names:
                system.create_dir(folder, recursive=True)
            with system.open_output_stream(f"{folder}/{name}") as f:
                f.write((row["content"] or "").encode("utf-8", "surrogatepass"))
            names.append(name)
        return Wrote(folder, names)

    def commit(self, messages) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        moves = [(f"{m.folder}/{n}", f"{root}/{n}") for m in messages if m for n in m.names]
        if len({to for _, to in moves}) < len(moves):
            self.abort(messages)
            raise ValueError("two rows name the same file")
        old = set() if not self.overwrite else {p for p, *_ in listed(self.path, "*")} - {to for _, to in moves}
        with ThreadPoolExecutor(16) as pool:
            list(pool.map(lambda m: system.move(*m), moves))
            list(pool.map(system.delete_file, old))
        self.clear(system, root)

    def abort(self, messages) -> None:
        self.clear(*opened(self.path))

    def clear(self, system, root: str) -> None:
        if system.get_file_info(f"{root}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{self.job}")


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return WRITES

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool):
        if not {"name", "content"} <= set(schema.names):
            raise ValueError("rows to write have a name and a content")
        return FileWriter(self.options["path"], overwrite)


def registered(spark: SparkSession) -> SparkSession:
    ship(spark)
    spark.dataSource.register(Documents)
    spark.dataSource.register(DocumentFiles)
    return spark


def read_documents(spark: SparkSession, path: str, *, glob: str = "*", parser: str = "", share_bytes: int = SHARE_BYTES) -> DataFrame:
    """(path, size, text, error_kind, error) of every file."""
    return registered(spark).read.format(READS).options(path=path, glob=glob, parser=parser, shareBytes=share_bytes).load()


def stream_documents(spark: SparkSession, path: str, *, glob: str = "*", parser: str = "", settles: float = SETTLES) -> DataFrame:
    return registered(spark).readStream.format(READS).options(path=path, glob=glob, parser=parser, settles=settles).load()


def write_files(rows: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """Each row (name, content) as a file of that name; `overwrite` removes the files that the folder had before."""
    registered(rows.sparkSession)
    rows.select("name", "content").write.format(WRITES).mode("overwrite" if overwrite else "append").option("path", path).save()
