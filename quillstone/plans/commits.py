"""Small files in a shared folder that make larger ones visible: written beside their place and renamed, so a reader sees all of one or none."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._path(f"{self.path}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies in a folder below."""
        return sorted(f.getPath().getName() for f in self._fs.listStatus(self._at(name))) if self.exists(name) else []

    def read(self, name: str) -> dict | None:
        """A JSON file, None where there is none."""
        if not self.exists(name):
            return None
        s = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(s.readAllBytes()).decode())
        finally:
            s.close()

    def write(self, name: str, value: dict, replace: bool = False) -> bool:
        """Writes a JSON file at once. False, without a change, if it is there and not to be replaced."""
        if self.exists(name) and not replace:
            return False
        beside = self._at(f"{name}.{time.time_ns()}.writing")
        s = self._fs.create(beside, True)
        s.write(bytearray(json.dumps(value).encode()))
        s.close()
        if replace:
            self._fs.delete(self._at(name), False)
        done = self._fs.rename(beside, self._at(name))
        if not done:
            self._fs.delete(beside, False)
        return done

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


def reused(spark: SparkSession, folder: str, name: str, seconds: float, make: Callable[[], DataFrame], now: Callable[[], float] = time.time) -> tuple[DataFrame, bool]:
    """A report, and whether it is an earlier one: what `make` gave is kept in the folder with its time and given again for so many seconds; then a new one takes its place, at once.

    The rows that a pointer named before stay until the next time, for those that still read them.
    """
    f = Folder(spark, folder)
    last = f.read(f"{name}.json")
    if last and 0 <= now() - last["at"] < seconds:
        return spark.read.parquet(f"{f.path}/{last['rows']}"), True
    rows = f"{name}-{time.time_ns()}"
    make().write.parquet(f"{f.path}/{rows}")
    f.write(f"{name}.json", {"at": now(), "rows": rows, "before": last and last["rows"]}, replace=True)
    if last and last["before"]:
        f.delete(last["before"])
    return spark.read.parquet(f"{f.path}/{rows}"), False
