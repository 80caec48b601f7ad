"""Tables and small files in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``. A temporary one is made only
where none is set and all tasks run on this machine.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

OWN = "rankloom.shared.dir"


def shared_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(OWN, None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set(OWN, root)
    return root.rstrip("/")


@dataclass
class Stored:
    """A table written once; its plan starts at the files, so it is a recovery point."""

    frame: DataFrame
    path: str

    def dropped(self) -> None:
        remove(self.frame.sparkSession, self.path)


_kept: list[Stored] = []


def stored(df: DataFrame, name: str) -> Stored:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/rankloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """A stored table that a lazy result still reads; it goes when the interpreter ends."""
    out = stored(df, name)
    _kept.append(out)
    return out.frame


@atexit.register
def _release() -> None:
    while _kept:
        try:
            _kept.pop().dropped()
        except Exception:  # the session is gone; so is the means to delete
            return


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file, moved into place when whole, so that readers never see a part of it."""
    part, fs = _path(spark, f"{path}.{uuid.uuid4().hex[:8]}.part")
    target, _ = _path(spark, path)
    out = fs.create(part, True)
    try:
        out.write(text.encode("utf-8"))
    finally:
        out.close()
    if fs.exists(target):
        fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not put {path} in place")
    return path


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()
