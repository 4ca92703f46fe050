"""What a logged history consists of: commit marks of batches, and snapshots of the compacted table.

Below the history's folder, ``_commits/<batch>`` says that a batch is whole, and ``_snapshots/<number>`` names the compacted table and
the last batch folded into it. Both are written beside and renamed, so a reader sees all of one or nothing. Only Hadoop's file system is
used, so the folder may lie in any store that Spark writes to. A mark or a snapshot is a line, whatever the history's size.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import SparkSession

COMMITS, SNAPSHOTS = "_commits", "_snapshots"


@dataclass(frozen=True)
class Snapshot:
    """Compacted table (a folder's name below the history) and the last batch it holds."""

    number: int = 0
    table: str | None = None
    upto: int = -1


class Files:
    """A few calls of the file system that holds ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._jvm = root.rstrip("/"), spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        """Names of what lies in a folder, without hidden and half-written files."""
        path = self._path(folder)
        if not self._fs.exists(path):
            return []
        return [n for n in (s.getPath().getName() for s in self._fs.listStatus(path)) if not n.startswith(".")]

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def put(self, name: str, line: str) -> bool:
        """Write a file whole, under a name of its own first; False if there is one of that name."""
        folder, _, last = name.rpartition("/")
        half = self._path(f"{folder}/.{last}-{uuid.uuid4().hex}")
        out = self._fs.create(half, False)
        out.write(bytearray(line.encode()))
        out.close()
        done = not self.exists(name) and self._fs.rename(half, self._path(name))
        if not done:
            self._fs.delete(half, False)
        return done

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Manifest:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.files = Files(spark, root)

    def commit(self, batch: int) -> None:
        """Make a batch part of the history; doing so again changes nothing."""
        if not self.files.exists(f"{COMMITS}/{batch}"):
            self.files.put(f"{COMMITS}/{batch}", "")

    def snapshot(self) -> Snapshot:
        """The newest snapshot."""
        numbers = sorted(int(n) for n in self.files.names(SNAPSHOTS))
        return Snapshot(**json.loads(self.files.read(f"{SNAPSHOTS}/{numbers[-1]}"))) if numbers else Snapshot()

    def newer(self, upto: int) -> list[int]:
        """Committed batches after ``upto``."""
        return sorted(b for b in map(int, self.files.names(COMMITS)) if b > upto)

    def advance(self, last: Snapshot, table: str, upto: int) -> Snapshot:
        """Put a new snapshot after ``last``; another writer that did so first wins."""
        new = Snapshot(last.number + 1, table, upto)
        if not self.files.put(f"{SNAPSHOTS}/{new.number}", json.dumps(vars(new))):
            raise RuntimeError(f"snapshot {new.number} was written by another compaction; read the history anew")
        return new
