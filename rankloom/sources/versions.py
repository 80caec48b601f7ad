"""Versioned tables: immutable parts, numbered manifests, merge on read.

A manifest lists a version's parts, each with the version it came with. A writer
writes its part under a name of its own, then puts the next manifest in place
without replacing any: where another writer was faster, it reads that version and
tries the one after. So readers see whole versions only and two writers can't lose
rows of each other.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.sources.shared import _path, read_text, remove, write_text

VERSION = "_version"


class VersionedTable:
    """A table under ``root`` whose rows are told apart by ``key``; without a key rows are only added."""

    def __init__(self, spark: SparkSession, root: str, key: list[str] | None = None):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def versions(self) -> list[int]:
        folder, fs = _path(self.spark, f"{self.root}/manifests")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def current(self) -> int:
        """The newest version; 0 before the first one."""
        return max(self.versions(), default=0)

    def parts(self, version: int) -> list[dict]:
        return json.loads(read_text(self.spark, f"{self.root}/manifests/{version:08}.json"))["parts"] if version else []

    def add(self, df: DataFrame) -> int:
        """A version with these rows in place of those of the same key; returns its number."""
        part = f"{self.root}/parts/{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(part)
        while True:
            base = self.current()
            if self._put(base + 1, [*self.parts(base), {"path": part, "version": base + 1}]):
                return base + 1

    def compact(self) -> int:
        """A version of one part with the same rows; tried anew if another writer was faster."""
        while True:
            base = self.current()
            part = f"{self.root}/parts/{uuid.uuid4().hex}"
            self.read(base).write.option("compression", "zstd").parquet(part)
            if self._put(base + 1, [{"path": part, "version": base + 1}]):
                return base + 1
            remove(self.spark, part)

    def _put(self, version: int, parts: list[dict]) -> bool:
        """False if the version is there already."""
        target = f"{self.root}/manifests/{version:08}.json"
        made = write_text(self.spark, f"{self.root}/manifests/.{uuid.uuid4().hex}", json.dumps({"version": version, "parts": parts}))
        jvm = self.spark.sparkContext._jvm
        (source, fs), (place, _) = _path(self.spark, made), _path(self.spark, target)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(source).toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(place), none)
        except Exception as e:
            remove(self.spark, made)
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest; of rows of one key the latest counts, of one version the least by content."""
        version = self.current() if version is None else version
        parts = self.parts(version)
        if not parts:
            raise FileNotFoundError(f"{self.root} has no version")
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [self.spark.read.parquet(p["path"]).withColumn(VERSION, F.lit(p["version"])) for p in parts])
        if not self.key:
            return rows.drop(VERSION)
        columns = [c for c in rows.columns if c != VERSION]
        latest = F.max_by(F.struct(*columns), F.struct(F.col(VERSION), F.xxhash64(*columns)))
        return rows.groupBy(*self.key).agg(latest.alias("_row")).select("_row.*")
