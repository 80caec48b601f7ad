"""Idempotent incremental ingestion: file stream, state by key, error side output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def ingest(spark: SparkSession, landing: str, schema: str, key: list[str], good: str, bad: str, checkpoint: str, status: str = "status"):
    """Take what is new in the landing folder, once per file; rows whose key is stored already are left out.

    The keys stored so far are the stream's state, dealt by key and kept on disk, so
    a batch touches its own keys only, however much is stored; nothing that was
    written is read again. Of several good rows of a key in one batch one is
    kept. A batch that runs again after a failure starts from the state before it and
    replaces its own folders. Good and bad rows are two streams over the same files,
    with a checkpoint each; both have ended when this returns.
    """
    known = spark.conf.get(STATE, None)
    if known is None or "HDFSBackedStateStoreProvider" in known:
        spark.conf.set(STATE, ROCKS)
    try:
        rows = spark.readStream.schema(schema).json(landing)
        has_status = status in rows.columns
        ok = F.coalesce(F.col(status) == "ok", F.lit(False)) if has_status else F.lit(True)
        started = [run(rows.where(ok).dropDuplicates(key), good, f"{checkpoint}/good")]
        if has_status:
            started.append(run(rows.where(~ok), bad, f"{checkpoint}/bad"))
        for query in started:
            query.awaitTermination()
    finally:
        if known is None:
            spark.conf.unset(STATE)
        else:
            spark.conf.set(STATE, known)
    return started[0]


def run(rows: DataFrame, folder: str, checkpoint: str):
    """A query that writes each batch to a folder of its own."""

    def batch(df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/batch={n}")

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
