"""The commit log of a metric store: numbered records, each created by exactly one run.

A record is a small file ``_commits/NNNNNNNNNNNN``. A run reads the last record, and creates the next number in the
file system's exclusive mode; if another run was faster, it looks again. So numbers have no gaps and no double owners,
and each record carries the newest version up to it, which makes the log the only place where
versions are handed out. ``_commits/of-R`` names the number of run R, for runs that are repeated.

Spark's readers skip folders that begin with an underscore. Work is done on the driver, one small file per
run; it does not grow with the data.
"""

from __future__ import annotations

import json
import os
import re
import time
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession

#: How long a record may stay empty before its writer counts as lost.
LOST_SECONDS = 10.0


@dataclass(frozen=True)
class Record:
    number: int
    run: str
    version: int
    #: The newest version of this and all earlier records.
    newest: int

    @property
    def folder(self) -> str:
        return f"{self.number:012d}-{self.run}"


class _Files:
    """The few file operations, through Hadoop's file system of the store's path."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.root = path.rstrip("/")
        base = self.jvm.org.apache.hadoop.fs.Path(self.root)
        self.fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        self.local = self.fs.getUri().getScheme() == "file"
        self.log = f"{self.root}/_commits"

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.log}/{name}" if name else self.log)

    def create(self, name: str, text: str) -> bool:
        """Create a file with this content; False if it is there already."""
        self.fs.mkdirs(self.path(""))
        if self.local:
            # Hadoop's local file system looks first and creates then; the system call does both at once.
            try:
                with open(os.path.join(self.path("").toUri().getPath(), name), "x", encoding="utf-8") as f:
                    f.write(text)
                return True
            except FileExistsError:
                return False
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as e:
            if self.fs.exists(self.path(name)):
                return False
            raise e
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        at = self.jvm.org.apache.hadoop.fs.Path(folder)
        if not self.fs.exists(at):
            return []
        found = self.jvm.org.apache.spark.deploy.SparkHadoopUtil.get().globPath(self.fs, self.jvm.org.apache.hadoop.fs.Path(at, "*")).mkString("\n")
        return [p.rsplit("/", 1)[1] for p in found.split("\n") if p]


def _record(files: _Files, number: int) -> Record:
    """Record ``number``; one that was never filled carries on what was before it."""
    began = time.monotonic()
    while not (text := files.read(f"{number:012d}")):
        if time.monotonic() - began > LOST_SECONDS:
            before = _record(files, number - 1) if number else None
            return Record(number, "", -1, before.newest if before else -1)
        time.sleep(0.05)
    return Record(**json.loads(text))


def _last(files: _Files) -> Record | None:
    numbers = [int(n) for n in files.names(files.log) if re.fullmatch(r"\d{12}", n)]
    return _record(files, max(numbers)) if numbers else None


def reserve(spark: SparkSession, path: str, run: str, version: int | None) -> Record:
    """The record of this run: its own if it has one, else a new one with ``version`` or the next that nobody has."""
    if not re.fullmatch(r"[\w.-]+", run):
        raise ValueError(f"run_id {run!r} is not a folder name")
    files = _Files(spark, path)
    if known := files.read(f"of-{run}"):
        record = _record(files, int(known))
        if version is not None and version != record.version:
            raise ValueError(f"run {run} has version {record.version}, not {version}")
        return record
    while True:
        last = _last(files)
        number, newest = (last.number + 1, last.newest) if last else (0, -1)
        chosen = newest + 1 if version is None else int(version)
        record = Record(number, run, chosen, max(newest, chosen))
        if files.create(f"{number:012d}", json.dumps(asdict(record))):
            files.create(f"of-{run}", str(number))
            return record


def newest_version(spark: SparkSession, path: str) -> int:
    """The newest version of the log, -1 before the first."""
    last = _last(_Files(spark, path))
    return last.newest if last else -1


def run_folders(spark: SparkSession, path: str) -> list[str]:
    """The run ids that have data, in the order of the log."""
    files = _Files(spark, path)
    return sorted(n.removeprefix("run_id=") for n in files.names(files.root) if n.startswith("run_id="))


def delete_runs(spark: SparkSession, path: str, folders: list[str]) -> None:
    files = _Files(spark, path)
    for folder in folders:
        files.fs.delete(files.jvm.org.apache.hadoop.fs.Path(f"{files.root}/run_id={folder}"), True)
