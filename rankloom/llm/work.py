"""Shared-folder tables that cut lineage, and small frame helpers.

Intermediate results that several jobs read are written as Parquet under the
folder named by ``spark.checkpoint.dir``. That folder is shared by all
executors, so a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one is set only where none is configured and all tasks run on this machine."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("rankloom.work.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("rankloom.work.dir", root)
    return qualified(spark, root).rstrip("/")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the file system that Spark resolves it to, so that tasks that open files themselves take the same one."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/rankloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def table(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a recovery point with a known size."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def drop(stored: DataFrame) -> None:
    """Delete a table made by :func:`table` that no later plan reads."""
    path = stored._stored_at
    _delete(stored.sparkSession, path)
    _made[:] = [x for x in _made if x[1] != path]


def path_size(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getContentSummary(p).getLength()


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release() -> None:
    """Delete every table made so far. Results that still read them become unreadable."""
    while _made:
        spark, path = _made.pop()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone; so is the means to delete
            return


atexit.register(release)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the key and the text (null: empty), whatever else the table holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
