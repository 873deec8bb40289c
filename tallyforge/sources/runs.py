"""A result store in which only the latest run may write, over plain files (S-11, K-07).

A store is a folder with a log of numbered entries. An entry is made by creating a file that must not exist, so of two
writers who have seen the same log one fails and looks again: beginning a run and committing one are both a
compare-and-set of the log's head. A run that isn't the latest is refused, and what it wrote is removed.
Readers take the last commit that the log has: whole commits, never a part of one. Data are written before the entry that
names them, so a driver that is lost in between leaves files that no reader sees.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


class StaleRun(RuntimeError):
    """A later run has begun."""


@dataclass
class RunStore:
    spark: SparkSession
    folder: str

    def _path(self, *parts: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder.rstrip("/"), *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _log(self) -> list[dict]:
        """All entries in order."""
        fs, at = self._files(), self._path("log")
        if not fs.exists(at):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.getPath().getName().endswith(".json"))
        utils = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        out = []
        for name in names:
            stream = fs.open(self._path("log", name))
            try:
                out.append(json.loads(bytes(utils.toByteArray(stream)).decode() or "null"))
            finally:
                stream.close()
        return [x for x in out if x]

    def _append(self, place: int, entry: dict) -> bool:
        """Whether the entry became the one at a place; false if there is one already."""
        fs = self._files()
        try:
            out = fs.create(self._path("log", f"{place:012}.json"), False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass()) or "already exists" in str(e.java_exception.getMessage()):
                return False
            raise
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        return True

    def _latest(self, log: list[dict]) -> int:
        return max((x["run"] for x in log), default=0)

    def begin(self) -> int:
        """The number of a new run, which makes all earlier ones stale."""
        while True:
            log = self._log()
            run = self._latest(log) + 1
            if self._append(len(log), {"run": run}):
                return run

    def commit(self, run: int, results: DataFrame) -> str:
        """Makes the results of a run the store's; raises StaleRun, and leaves nothing behind, if a later one has begun."""
        if self._latest(self._log()) != run:
            raise StaleRun(f"run {run} is not the latest")
        data = f"data/run-{run:06}-{uuid.uuid4().hex}"
        results.write.parquet(str(self._path(data)))
        while True:
            log = self._log()
            if self._latest(log) != run:
                self._files().delete(self._path(data), True)
                raise StaleRun(f"run {run} is not the latest")
            if self._append(len(log), {"run": run, "data": data}):
                return data

    def read(self) -> DataFrame | None:
        """The last commit's rows; None if there is none."""
        commits = [x["data"] for x in self._log() if "data" in x]
        return self.spark.read.parquet(str(self._path(commits[-1]))) if commits else None

    def swept(self) -> int:
        """Removes data that no entry names, of runs that are no longer the latest; how many."""
        log, fs, at = self._log(), self._files(), self._path("data")
        named = {x["data"].split("/")[1] for x in log if "data" in x}
        gone = 0
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name not in named and int(name.split("-")[1]) < self._latest(log):
                gone += bool(fs.delete(s.getPath(), True))
        return gone
