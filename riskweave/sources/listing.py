"""Folders as tables of paths, listed by the executors, and the contents of files by path.

Spark's own file source passes over every file and folder whose name begins with an underscore or a dot, which source trees are full of.  This
data source lists any name: the driver opens folders, the widest level at a time, until there are enough for every task, and each task walks its own
in the order of paths.  What is not wanted is never listed (ignored folders, dot names) nor kept (other suffixes or names), and a task that
has given as many paths as are wanted in all stops.  Nothing is opened here: contents are read for the paths that are left in the end.

Files are reached through Arrow's file systems, which the executors must be able to use (local and mounted folders, HDFS, object stores).
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

FORMAT = "riskweave_folder"
#: Folders that the driver hands out: about so many, after it has opened at most so many itself.
TASKS, OPENED_BY_DRIVER = 64, 32
BATCH_ROWS = 2_000
#: Contents are handed on when so many bytes have come together.
BATCH_BYTES = 16 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path there."""
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", path))
    return fs.LocalFileSystem(), path


@dataclass(frozen=True)
class Wanted:
    """What a walk gives: files whose path from the root matches, in folders that are not ignored; dot names only if asked for."""

    pattern: str
    ignored: frozenset[str]
    dots: bool
    limit: int | None

    def entries(self, system: fs.FileSystem, folder: str) -> list[tuple[str, bool]]:
        """(path, whether it is a folder) of a folder's entries in the order of the paths below; linked folders aren't entered."""
        out, local = [], isinstance(system, fs.LocalFileSystem)
        for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
            is_folder = x.type == fs.FileType.Directory
            if not self.dots and x.base_name.startswith("."):
                continue
            if is_folder and (x.base_name in self.ignored or local and os.path.islink(x.path)):
                continue
            if is_folder or x.type == fs.FileType.File:
                out.append((f"{x.path}/" if is_folder else x.path, is_folder))
        return sorted(out)

    def walk(self, system: fs.FileSystem, folder: str, root: str) -> Iterator[str]:
        """The files below a folder in the order of their paths; one list of entries a level is held."""
        match = re.compile(self.pattern).search
        for path, is_folder in self.entries(system, folder):
            if is_folder:
                yield from self.walk(system, path.rstrip("/"), root)
            elif match(path[len(root) :]):
                yield path


class FolderPart(InputPartition):
    def __init__(self, paths: list[tuple[str, bool]]):
        self.paths = paths


class FolderReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        limit = options.get("limit")
        self.wanted = Wanted(options.get("pattern", ""), frozenset(filter(None, options.get("ignored", "").split("/"))), options.get("dots", "false") == "true", int(limit) if limit else None)

    def _root(self) -> tuple[fs.FileSystem, str]:
        system, path = opened(self.root)
        return system, path.rstrip("/") or "/"

    def partitions(self) -> list[FolderPart]:
        system, root = self._root()
        units, opened_ = [(f"{root}/", True)], 0
        while opened_ < OPENED_BY_DRIVER and len(units) < TASKS and any(f for _, f in units):
            k = next(i for i, (_, is_folder) in enumerate(units) if is_folder)
            widest = min((i for i, (_, is_folder) in enumerate(units) if is_folder), key=lambda i: (units[i][0].count("/"), i), default=k)
            units[widest : widest + 1] = self.wanted.entries(system, units[widest][0].rstrip("/") or "/")
            opened_ += 1
        # neighbours go together, so that a task's paths are in order; what is listed already takes no task of its own
        folders = sum(is_folder for _, is_folder in units)
        size, parts, held = max(1, -(-folders // TASKS)), [[]], 0
        for unit in units:
            if unit[1] and held == size:
                parts.append([])
                held = 0
            parts[-1].append(unit)
            held += unit[1]
        return [FolderPart(x) for x in parts]

    def read(self, part: FolderPart) -> Iterator[pa.RecordBatch]:
        system, root = self._root()
        match, rows, given = re.compile(self.wanted.pattern).search, [], 0
        base = f"{root.rstrip('/')}/"

        def batch() -> pa.RecordBatch:
            return pa.record_batch([pa.array(rows, pa.string())], ["path"])

        for path, is_folder in part.paths:
            found = self.wanted.walk(system, path.rstrip("/") or "/", base) if is_folder else [path] if match(path[len(base) :]) else []
            for x in found:
                rows.append(x)
                given += 1
                if given == self.wanted.limit:
                    yield batch()
                    return
                if len(rows) == BATCH_ROWS:
                    yield batch()
                    rows.clear()
        yield batch()


class FolderSource(DataSource):
    """Options: path; pattern, a regular expression that is looked for in paths below it; ignored, names of folders with slashes between; dots, true to
    list names that begin with a dot; limit, of the paths that a task gives, which are its first."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)


def listed(spark: SparkSession, root: str, pattern: str, ignored: tuple[str, ...] = (), dots: bool = False, limit: int | None = None) -> DataFrame:
    """path of the files below root whose path from there has the pattern; with a limit only the first so many by path."""
    spark.dataSource.register(FolderSource)
    options = {"path": root, "pattern": pattern, "ignored": "/".join(ignored), "dots": str(dots).lower()} | ({"limit": str(limit)} if limit else {})
    found = spark.read.format(FORMAT).options(**options).load()
    return found if limit is None else found.orderBy("path").limit(limit)


def contents(paths: DataFrame, root: str) -> DataFrame:
    """paths(path, ...) with their bytes as content; files that can't be read (any more) are left out.  root names the file system."""
    names = paths.columns

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = opened(root)
        for batch in batches:
            rows, held, size = [], [], 0

            def made() -> pa.RecordBatch:
                kept = batch.take(pa.array(rows, pa.int64()))
                return pa.record_batch([*kept.columns, pa.array(held, pa.binary())], [*names, "content"])

            for k, path in enumerate(batch.column(names.index("path")).to_pylist()):
                try:
                    with system.open_input_stream(path) as stream:
                        data = stream.read()
                except OSError:
                    continue
                rows.append(k)
                held.append(data)
                size += len(data)
                if size >= BATCH_BYTES:
                    yield made()
                    rows, held, size = [], [], 0
            yield made()

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInArrow(read, f"{kind}, content binary")


def written_files(files: DataFrame, root: str) -> int:
    """Writes files(path below root, text), one file a row, by the tasks that hold them; how many there are."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                target = f"{base.rstrip('/')}/{path}"
                system.create_dir(target.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(target) as stream:
                    stream.write(text.encode())
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select("path", "text").mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
