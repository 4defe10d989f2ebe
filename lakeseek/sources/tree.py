"""File trees as a data source: batch and streaming, with names that Spark's own file readers hide.

The tree must be on a file system that every executor sees at the same path.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions import paths
from ..functions.text import has_nul

SCHEMA = "path string, real_path string, ord long, size long, mtime_ns long, content binary"
MAX_BYTES = 2_000_000
FILES_PER_TASK = 500


def walk(root: str, skip: tuple[str, ...] = paths.SKIP_DIRS) -> Iterator[str]:
    """Files below the root in a fixed order; links to directories are not followed, skipped names not entered."""
    for directory, dirs, files in os.walk(root, followlinks=False):
        dirs[:] = sorted(d for d in dirs if d not in skip)
        for name in sorted(files):
            yield os.path.join(directory, name)


class Group(InputPartition):
    def __init__(self, files: list[tuple[int, str]]):
        self.files = files


def read_rows(root: str, files: list[tuple[int, str]], max_bytes: int):
    """Rows of the files; with a max_bytes of 0 without content."""
    for i, path in files:
        try:
            stat = os.stat(path)
            if not stat.st_size:
                continue
            content = b""
            if stat.st_size <= max_bytes:
                with open(path, "rb") as f:
                    content = f.read()
            yield os.path.relpath(path, root).replace(os.sep, "/"), os.path.realpath(path), i, stat.st_size, stat.st_mtime_ns, content
        except OSError:  # broken links, files that went meanwhile
            continue


class TreeReader(DataSourceReader):
    def __init__(self, root: str, max_bytes: int, skip: tuple[str, ...]):
        self.root, self.max_bytes, self.skip = root, max_bytes, skip

    def partitions(self):
        files = list(enumerate(walk(self.root, self.skip)))
        return [Group(files[a : a + FILES_PER_TASK]) for a in range(0, len(files), FILES_PER_TASK)] or [Group([])]

    def read(self, partition):
        yield from read_rows(self.root, partition.files, self.max_bytes)


def changed_at(path: str) -> int | None:
    """When a file was written, or moved to where it is; None if it is gone."""
    try:
        stat = os.stat(path)
    except OSError:
        return None
    return max(stat.st_mtime_ns, stat.st_ctime_ns)


class TreeStream(DataSourceStreamReader):
    """Files changed since the offset, which is the latest time of change seen; deletions need a listing.

    The driver sees names and times only: files are read by the tasks that are given their names.
    """

    def __init__(self, root: str, max_bytes: int, skip: tuple[str, ...]):
        self.root, self.max_bytes, self.skip = root, max_bytes, skip

    def initialOffset(self):
        return {"time": 0}

    def latestOffset(self):
        return {"time": max([0, *(t for t in map(changed_at, walk(self.root, self.skip)) if t)])}

    def partitions(self, start, end):
        files = [(i, p) for i, p in enumerate(walk(self.root, self.skip)) if start["time"] < (changed_at(p) or 0) <= end["time"]]
        return [Group(files[a : a + FILES_PER_TASK]) for a in range(0, len(files), FILES_PER_TASK)] or [Group([])]

    def read(self, partition):
        yield from read_rows(self.root, partition.files, self.max_bytes)


class TreeSource(DataSource):
    """spark.read.format("tree").option("path", root): options path, maxBytes, skip (a JSON list)."""

    @classmethod
    def name(cls):
        return "tree"

    def schema(self):
        return SCHEMA

    def _options(self):
        skip = self.options.get("skip")
        return self.options["path"], int(self.options.get("maxBytes", MAX_BYTES)), tuple(json.loads(skip)) if skip else paths.SKIP_DIRS

    def reader(self, schema):
        return TreeReader(*self._options())

    def streamReader(self, schema):
        return TreeStream(*self._options())


IGNORE_FILE = ".lakeseekignore"


def ignore_patterns(root: str, name: str = IGNORE_FILE) -> list[str]:
    """Lines of the ignore file without blanks and comments; none if it cannot be read."""
    try:
        with open(os.path.join(root, name), encoding="utf-8") as f:
            return [x for x in (line.strip() for line in f) if x and not x.startswith("#")]
    except (OSError, UnicodeDecodeError):
        return []


def add_ignored(root: str, patterns: list[str], name: str = IGNORE_FILE) -> list[str]:
    """Appends the patterns that the ignore file lacks, and returns them."""
    new = [p for p in dict.fromkeys(patterns) if p not in ignore_patterns(root, name)]
    if new:
        path = os.path.join(root, name)
        with open(path, "a+", encoding="utf-8") as f:
            f.seek(0)
            text = f.read()
            f.write(("" if not text or text.endswith("\n") else "\n") + "".join(f"{p}\n" for p in new))
    return new


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None, skip=None, max_bytes: int = MAX_BYTES, defaults: bool = True) -> DataFrame:
    """Files of a tree that can be indexed: not empty, not excluded unless included, once for each real path."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("tree").option("path", root).option("maxBytes", str(max_bytes))
    if skip is not None:
        reader = reader.option("skip", json.dumps(list(skip)))
    return select_files(reader.load(), root, exclude, include, defaults)


def names(spark: SparkSession, root: str, **options) -> DataFrame:
    """The files that `scan` finds, without their content."""
    return scan(spark, root, max_bytes=0, **options).drop("content")


def select_files(files: DataFrame, root: str, exclude=None, include=None, defaults: bool = True) -> DataFrame:
    patterns = [*(paths.DEFAULT_EXCLUDES if defaults else ()), IGNORE_FILE, *ignore_patterns(root), *(exclude or ())]
    out = paths.excluded(F.col("path"), patterns) if patterns else F.lit(False)
    if include:
        out = out & ~paths.excluded(F.col("path"), include)
    kept = files.where(~out)
    return kept if kept.isStreaming else first_of_links(kept)


def first_of_links(files: DataFrame) -> DataFrame:
    """One row for each real file: the first by the order of the walk."""
    first = Window.partitionBy("real_path").orderBy("ord")
    return files.withColumn("__r", F.row_number().over(first)).where("__r = 1").drop("__r")


def indexable(files: DataFrame, max_bytes: int = MAX_BYTES, detect: bool = True) -> DataFrame:
    """Files with a `reason` for being left out, or null: too large, a NUL byte, or a MIME type that is not text."""
    mime = paths.mime_of(F.col("content"))
    reason = F.when(F.col("size") > max_bytes, "too_large").when(has_nul(F.col("content")), "binary")
    if detect:
        reason = reason.when(~paths.is_text_mime(mime), "mime")
    return files.withColumns({"mime": mime, "reason": reason})


def git_branch(root: str) -> str:
    """The checked-out branch; detached-<hash> without one, default without a repository. Read from .git, no command."""
    head = os.path.join(root, ".git", "HEAD")
    try:
        with open(head, encoding="utf-8") as f:
            text = f.read().strip()
    except OSError:
        return "default"
    return text.removeprefix("ref: refs/heads/") if text.startswith("ref: refs/heads/") else f"detached-{text[:8]}"


def git_branches(root: str) -> set[str]:
    """Local branches, packed ones too, and default."""
    base = os.path.join(root, ".git", "refs", "heads")
    out = {"default"} | {os.path.relpath(os.path.join(d, n), base).replace(os.sep, "/") for d, _, names in os.walk(base) for n in names}
    try:
        with open(os.path.join(root, ".git", "packed-refs"), encoding="utf-8") as f:
            out |= {line.split()[1].removeprefix("refs/heads/") for line in f if " refs/heads/" in line}
    except OSError:
        pass
    return out


def git_root(path: str) -> str | None:
    path = os.path.abspath(path)
    while not os.path.exists(os.path.join(path, ".git")):
        up = os.path.dirname(path)
        if up == path:
            return None
        path = up
    return path
