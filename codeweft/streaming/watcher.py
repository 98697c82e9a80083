"""A working tree as a stream: polled with back-off, a batch for what has changed since the one before."""

from __future__ import annotations

import os
import subprocess
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from codeweft.streaming.traces import next_interval

BASE_MS, TICK = 5_000, "250 milliseconds"
#: Paths that a task looks at.
_PATHS = 1_000


def _git(root: str, *words: str) -> list[str] | None:
    """What git says, split at NUL; None where it fails or there is none."""
    try:
        told = subprocess.run(["git", "-C", root, *words], capture_output=True, text=True, check=False)
    except OSError:
        return None
    return [x for x in told.stdout.split("\0") if x] if told.returncode == 0 else None


def _stamp(path: str) -> str:
    try:
        found = os.stat(path)
        return f"{found.st_size}:{found.st_mtime_ns}"
    except OSError:
        return "gone"


def tree_state(root: str) -> dict | None:
    """HEAD and the files that differ from it, each with size and time, so that a second edit of a file is seen too; None
    where git can't tell."""
    status = _git(root, "status", "--porcelain", "--no-renames", "--untracked-files=all", "-z")
    if status is None:
        return None
    head = _git(root, "rev-parse", "--verify", "-q", "HEAD")
    return {"head": head[0].strip() if head else "", "files": {p: _stamp(os.path.join(root, p)) for p in sorted(x[3:] for x in status)}}


def between(root: str, start: dict, end: dict) -> list[str]:
    """Paths that may differ between two states: by commits, by edits, and those whose edits were taken back."""
    edited = {p for p in {*start["files"], *end["files"]} if start["files"].get(p) != end["files"].get(p)}
    if start["head"] != end["head"]:
        told = _git(root, "diff", "--name-only", "--no-renames", "-z", start["head"], end["head"]) if start["head"] and end["head"] else None
        edited.update(told if told is not None else _git(root, "ls-files", "-z") or [])
    return sorted(edited)


class _Paths(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class _TreeReader(DataSourceStreamReader):
    """An offset is the state of the tree. Asked sooner than the interval allows it answers as before; the interval doubles while nothing
    changes, as next_interval() says. A batch that is repeated after a failure lists the same paths as they are by then."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root, self.base = os.path.realpath(options["path"]), int(options.get("baseMs", BASE_MS))
        self.since, self.last, self.interval, self.due = options.get("since"), None, self.base, 0.0

    def initialOffset(self) -> dict:
        if self.since is not None:
            return {"head": self.since, "files": {}}
        now = tree_state(self.root)
        return {"head": now["head"] if now else "", "files": {}}

    def latestOffset(self) -> dict:
        if self.last is None or time.monotonic() * 1000 >= self.due:
            before, now = self.last, tree_state(self.root)
            self.last = now or before or self.initialOffset()
            clean = now is not None and not now["files"]
            self.interval = self.base if before is None else next_interval(self.interval, now is not None and now != before, clean, self.base)
            self.due = time.monotonic() * 1000 + self.interval
        return self.last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        paths = between(self.root, start, end)
        return [_Paths(paths[k : k + _PATHS]) for k in range(0, len(paths), _PATHS)] or [_Paths([])]

    def read(self, partition: _Paths) -> Iterator[tuple]:
        for path in partition.paths:
            yield path, not os.path.isfile(os.path.join(self.root, path))


class TreeSource(DataSource):
    """`spark.readStream.format("worktree").load(path)`: rows (path, deleted). Options: since (a commit to begin at; else what is edited
    by now and all that follows), baseMs (least milliseconds between two looks)."""

    @classmethod
    def name(cls) -> str:
        return "worktree"

    def schema(self) -> str:
        return "path string, deleted boolean"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TreeReader(self.options)


def tree_changes(spark: SparkSession, root: str, since: str | None = None, base_ms: int = BASE_MS) -> DataFrame:
    """The stream of changed paths of a git working tree, which driver and executors must see."""
    spark.dataSource.register(TreeSource)
    reader = spark.readStream.format("worktree").option("baseMs", base_ms)
    return (reader if since is None else reader.option("since", since)).load(root)
