"""Tables in whole versions: data folders that never change, and numbered manifests that name the folders of a version.

A version is written aside and counts once its manifest has its number. Manifests are renamed into place and never replaced, so a
reader sees one whole version, a failed write leaves the one before, and of two writers of a number one fails.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

MANIFESTS = "_versions"


class VersionConflict(RuntimeError):
    """Another writer has published since the version that this one builds on."""


class VersionedTable:
    """A table of named parts; each version says which data folder holds each part. Parts not given anew are carried over."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # files, through the file system that Spark reads with

    def _hadoop(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _manifest(self, version: int) -> str:
        return f"{self.path}/{MANIFESTS}/{version:010d}.json"

    def versions(self) -> list[int]:
        """Numbers of the versions whose manifests are kept, ascending."""
        fs, where = self._hadoop(f"{self.path}/{MANIFESTS}")
        if not fs.exists(where):
            return []
        names = (status.getPath().getName() for status in fs.listStatus(where))
        return sorted(int(n[:10]) for n in names if re.fullmatch(r"\d{10}\.json", n))

    def manifest(self, version: int | None = None) -> dict | None:
        """The content of a manifest, the newest by default; None where nothing has been published."""
        if version is None:
            known = self.versions()
            if not known:
                return None
            version = known[-1]
        return json.loads("\n".join(r[0] for r in self.spark.read.text(self._manifest(version)).collect()))

    # reading

    def folders(self, version: int | None = None, parts: list[str] | None = None) -> list[str]:
        found = (self.manifest(version) or {"parts": {}})["parts"]
        return [f"{self.path}/{found[p]}" for p in sorted(found) if parts is None or p in parts]

    def read(self, version: int | None = None, parts: list[str] | None = None) -> DataFrame | None:
        """Rows of a version, or of some of its parts; None where it has none of them."""
        manifest = self.manifest(version)
        if manifest is None:
            return None
        wanted = [p for p in sorted(manifest["parts"]) if parts is None or p in parts]
        if not wanted:
            return None
        schema = StructType.fromJson(manifest["schema"])
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{manifest['parts'][p]}" for p in wanted])

    # writing

    def write(self, df: DataFrame) -> str:
        """`df` in a new data folder that no version names yet."""
        folder = f"data/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return folder

    def write_parts(self, df: DataFrame, column: str, kind: str) -> dict[str, str]:
        """`df` by the values of a column: the data folder of each part `kind=value`, from one job."""
        folder = f"data/{uuid.uuid4().hex}"
        by = df.withColumn("_part", F.col(column).cast("string")).hint("rebalance", "_part")
        by.write.partitionBy("_part").parquet(f"{self.path}/{folder}")
        fs, where = self._hadoop(f"{self.path}/{folder}")
        names = [status.getPath().getName() for status in fs.listStatus(where) if status.isDirectory()]
        return {f"{kind}={n.split('=', 1)[1]}": f"{folder}/{n}" for n in names}

    def drop(self, folder: str) -> None:
        fs, where = self._hadoop(f"{self.path}/{folder}")
        fs.delete(where, True)

    def commit(self, parts: Mapping[str, str | None], schema: StructType, after: int | None = None, keep: int = 2) -> int:
        """Publishes the version after `after` (the newest by default): its parts are those of `after`, with `parts` put in place (a
        part given as None goes). The data folders that the last `keep` versions do not name are removed; returns the number."""
        before = self.manifest(after) if after != 0 else None
        number = (before["version"] if before else 0) + 1
        named = {**(before["parts"] if before else {}), **parts}
        content = {"version": number, "parts": {p: f for p, f in named.items() if f}, "schema": json.loads(schema.json())}
        fs, target = self._hadoop(self._manifest(number))
        _, aside = self._hadoop(f"{self.path}/{MANIFESTS}/.{uuid.uuid4().hex}")
        out = fs.create(aside, False)
        out.write(bytearray(json.dumps(content), "utf-8"))
        out.close()
        if fs.exists(target) or not fs.rename(aside, target):
            fs.delete(aside, False)
            raise VersionConflict(f"{self.path}: version {number} has been published by another writer")
        self._expire(keep)
        return number

    def _expire(self, keep: int) -> None:
        known = self.versions()
        old, live = known[:-keep], known[-keep:]
        used = {folder for v in live for folder in self.manifest(v)["parts"].values()}
        for v in old:
            for folder in set(self.manifest(v)["parts"].values()) - used:
                self.drop(folder)
            fs, where = self._hadoop(self._manifest(v))
            fs.delete(where, False)


def read_published(spark: SparkSession, path: str) -> DataFrame:
    """The newest whole version of a published table."""
    df = VersionedTable(spark, path).read()
    if df is None:
        raise FileNotFoundError(f"nothing has been published under {path}")
    return df
