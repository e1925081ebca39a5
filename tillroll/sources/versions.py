"""Versions of the layer tables: one small file each, which names what the version holds.

A writer first writes all its data to new folders, which no reader looks at, and then puts the
file of the next number in place by a rename that replaces nothing: of two writers one gets the
number, the other learns that it came second. A reader takes the file of the highest number and
sees exactly what it names, before as after a later commit. This rests on the store: a rename
must be one step and must fail on an existing target, as it is on HDFS.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another commit has changed what this one was about to replace."""


@dataclass(frozen=True)
class Version:
    """``pieces`` and ``silver`` name the folders that count, ``next_id`` the first line id not
    given out yet, ``streams`` the last micro-batch of each stream; ``edit`` and ``counts`` say
    which edit this version brought."""

    number: int = 0
    pieces: str | None = None
    silver: str | None = None
    next_id: int = 1
    streams: dict[str, int] = field(default_factory=dict)
    edit: str | None = None
    counts: dict[str, int] | None = None


class VersionLog:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _store(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def latest(self) -> Version:
        """The version of the highest number; number 0, without data, before any commit."""
        store = self._store()
        if not store.exists(self._path()):
            return Version()
        names = [s.getPath().getName() for s in store.listStatus(self._path())]
        names = [n for n in names if n.endswith(".json") and n[0].isdigit()]
        return self._read(max(names)) if names else Version()

    def _read(self, name: str) -> Version:
        stream = self._store().open(self._path(name))
        try:
            text = self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        finally:
            stream.close()
        return Version(**json.loads(bytes(text).decode()))

    def of_edit(self, edit: str) -> Version | None:
        """The version that brought an edit."""
        latest = self.latest()
        if not latest.number:
            return None
        found = self.spark.read.schema("number long, edit string").json(f"{self.folder}/*.json")
        row = found.where(found["edit"] == edit).first()
        return self._read(f"{row['number']:012d}.json") if row else None

    def put(self, version: Version) -> bool:
        """Commit; False where the number is taken."""
        new, own = self._path(f"_{uuid.uuid4().hex}"), self._path(f"{version.number:012d}.json")
        out = self._store().create(new)
        out.write(json.dumps(asdict(version)).encode())
        out.close()
        placed = False
        try:
            placed = self.place(new, own)
        finally:
            if not placed:
                self._store().delete(new, False)
        return placed

    def exists(self, path: str) -> bool:
        return self._store().exists(self.spark._jvm.org.apache.hadoop.fs.Path(path))

    def place(self, new, own) -> bool:
        """Rename a file or folder to one that is not there yet; False where it is."""
        jvm = self.spark._jvm
        new, own = (jvm.org.apache.hadoop.fs.Path(p) if isinstance(p, str) else p for p in (new, own))
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            new.toUri(), self.spark._jsc.hadoopConfiguration()
        )
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark._sc._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(context.makeQualified(new), context.makeQualified(own), options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in error.java_exception.getClass().getName():
                return False
            raise
        return True
