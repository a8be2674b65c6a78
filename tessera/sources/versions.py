"""Versions of a table made of immutable files: what belongs to it is named by a small list, and a new list is put in by a rename."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Versions:
    """Lists of entries (JSON) below root, one file for each version; readers take the last, so a writer that stops changes nothing.

    Two writers at once are not merged: the later one finds its version taken and fails, with its files unnamed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.folder = spark, root.rstrip("/"), f"{root.rstrip('/')}/_versions"

    def path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def numbers(self) -> list[int]:
        fs, folder = self.path(self.folder)
        if not fs.exists(folder):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _file(self, number: int) -> str:
        return f"{self.folder}/{number:012d}.json"

    def read(self, number: int | None = None) -> tuple[int, dict]:
        """The last version (or one by its number) and its list; 0 and an empty list where there is none."""
        number = max(self.numbers(), default=0) if number is None else number
        if not number:
            return 0, {}
        fs, p = self.path(self._file(number))
        stream = fs.open(p)
        try:
            return number, json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, entries: dict) -> int:
        """Put in the version that follows `after`."""
        fs, fresh = self.path(f"{self.folder}/{uuid.uuid4().hex}.tmp")
        _, to = self.path(self._file(after + 1))
        out = fs.create(fresh, False)
        try:
            out.write(bytearray(json.dumps(entries, sort_keys=True).encode()))
        finally:
            out.close()
        if fs.exists(to) or not fs.rename(fresh, to):
            fs.delete(fresh, False)
            raise RuntimeError(f"version {after + 1} of {self.root} was written by another")
        return after + 1

    def forget(self, keep: int = 1) -> list[dict]:
        """Drop all but the last `keep` lists and return those that stay."""
        numbers = self.numbers()
        for number in numbers[:-keep]:
            fs, p = self.path(self._file(number))
            fs.delete(p, False)
        return [self.read(n)[1] for n in numbers[-keep:]]

    def sweep(self, folder: str, named: set[str]) -> int:
        """Delete what lies in a folder below root and is not named; returns how much that was."""
        fs, p = self.path(f"{self.root}/{folder}")
        gone = [s.getPath() for s in (fs.listStatus(p) if fs.exists(p) else []) if s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return len(gone)
