"""Versions of a stage: written beside the current one, then made current in one step.

A stage is a folder.  ``v-…`` folders in it hold the data of one version each, and
``_versions/N`` is a small file that names the folder, format and schema of version N; the
highest complete one is current.  A version is written in full before its file is created, and
that file is only ever created, never replaced: whoever reads sees a whole version, and a
writer that stops half-way leaves the current one as it was.

A reader leaves a mark in ``_readers/N`` while it may still read version N.  Older versions
without a mark go when a new one is published; marks and data nobody has finished count as
abandoned after ``ABANDONED_H`` hours.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

ABANDONED_H = 7 * 24
#: Digits of a version number in file names.
_DIGITS = 12


class StageConflict(RuntimeError):
    """Someone else has published a version since the one this change was made from."""


class VersionedStage:
    def __init__(self, spark: SparkSession, path: str):
        self._spark = spark
        self._path = path
        context = spark.sparkContext
        self._jvm = context._jvm
        self._files = self._at(path).getFileSystem(context._jsc.hadoopConfiguration())

    # --- reading --------------------------------------------------------------------

    def current(self) -> int | None:
        """Number of the current version; None where the folder holds none."""
        return max(self.versions(), default=None)

    def versions(self) -> list[int]:
        return sorted(n for n in self._numbers() if self._entry(n) is not None)

    def read(self, version: int | None = None) -> tuple[DataFrame, int, str]:
        """A version as a frame, its number, and the mark that keeps it: see :meth:`release`."""
        while True:
            number = self.current() if version is None else version
            entry = None if number is None else self._entry(number)
            if entry is None:
                raise FileNotFoundError(f"{self._path} has no version {'' if number is None else number}")
            mark = f"{self._path}/_readers/{number:0{_DIGITS}d}/{uuid.uuid4().hex}"
            self._create(mark, "")
            self._files.deleteOnExit(self._at(mark))
            # A writer removes the entry first and looks for marks again: whoever comes too late
            # finds the entry gone.
            if self._entry(number) is not None:
                return self._frame(entry), number, mark
            self.release(mark)

    def release(self, mark: str) -> None:
        self._files.delete(self._at(mark), False)
        self._files.cancelDeleteOnExit(self._at(mark))

    def folder(self, version: int) -> str:
        return f"{self._path}/{self._entry(version)['folder']}"

    def _frame(self, entry: dict) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        return self._spark.read.schema(schema).format(entry["format"]).load(f"{self._path}/{entry['folder']}")

    # --- writing --------------------------------------------------------------------

    def publish(self, df: DataFrame, fmt: str = "parquet", expect: int | None = None, keep: int = 1) -> int:
        """Write ``df``, which may read this very stage, and make it the current version.

        With ``expect`` only if that is still the current version.  ``keep`` versions before it
        stay in any case.
        """
        folder = f"v-{uuid.uuid4().hex}"
        df.write.format(fmt).save(f"{self._path}/{folder}")
        entry = json.dumps({"folder": folder, "format": fmt, "schema": df.schema.jsonValue()})
        while True:
            current = self.current()
            if expect is not None and current != expect:
                self._files.delete(self._at(f"{self._path}/{folder}"), True)
                raise StageConflict(f"{self._path} is at version {current}, not {expect}")
            # Beyond entries that were never completed, too.
            number = 1 + max(self._numbers(), default=0)
            if self._create(self._entry_path(number), entry):
                break
        self.remove_unread(keep)
        return number

    def remove_unread(self, keep: int = 1, abandoned_h: float = ABANDONED_H) -> list[int]:
        """Remove versions that no reader has marked, but for the current one and ``keep`` before
        it, and data of writers that never finished; the numbers removed."""
        gone = []
        for number in self.versions()[: -1 - keep]:
            if self._marked(number, abandoned_h):
                continue
            entry = self._entry(number)
            self._files.delete(self._at(self._entry_path(number)), False)
            if self._marked(number, abandoned_h):
                self._create(self._entry_path(number), json.dumps(entry))
                continue
            self._files.delete(self._at(f"{self._path}/{entry['folder']}"), True)
            self._files.delete(self._at(f"{self._path}/_readers/{number:0{_DIGITS}d}"), True)
            gone.append(number)
        known = {self._entry(n)["folder"] for n in self.versions()}
        for status in self._listed(self._path):
            name = status.getPath().getName()
            if name.startswith("v-") and name not in known and self._age_h(status) > abandoned_h:
                self._files.delete(status.getPath(), True)
        return gone

    # --- files ----------------------------------------------------------------------

    def _at(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _entry_path(self, number: int) -> str:
        return f"{self._path}/_versions/{number:0{_DIGITS}d}"

    def _listed(self, path: str) -> list:
        place = self._at(path)
        return list(self._files.listStatus(place)) if self._files.exists(place) else []

    def _numbers(self) -> list[int]:
        names = (status.getPath().getName() for status in self._listed(f"{self._path}/_versions"))
        return [int(name) for name in names if name.isdigit()]

    def _entry(self, number: int) -> dict | None:
        """What a version's file says; None if it is not there or not complete."""
        place = self._at(self._entry_path(number))
        if not self._files.exists(place):
            return None
        stream = self._files.open(place)
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text) if text.endswith("}") else None

    def _create(self, path: str, text: str) -> bool:
        """Write a file that must not be there; whether it was not."""
        place = self._at(path)
        if self._files.exists(place):
            return False
        try:
            stream = self._files.create(place, False)
        except Exception as refused:  # the JVM's exception has no class of its own here
            if "Exist" in str(refused):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        return True

    def _marked(self, number: int, abandoned_h: float) -> bool:
        marks = self._listed(f"{self._path}/_readers/{number:0{_DIGITS}d}")
        return any(self._age_h(status) <= abandoned_h for status in marks)

    def _age_h(self, status) -> float:
        return (time.time() - status.getModificationTime() / 1000) / 3600
