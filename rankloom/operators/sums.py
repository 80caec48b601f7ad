"""Sums of arrays that many tasks hand on."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECT = 16  # tasks whose arrays go to the driver as they are


def add_up(parts: Iterable[bytes]) -> np.ndarray | None:
    total = None
    for raw in parts:
        x = np.frombuffer(raw)
        total = x.copy() if total is None else total + x
    return total


def sum_of(parts: DataFrame, tasks: int | None = None) -> np.ndarray | None:
    """The sum of the double arrays in ``payload``, a row a task; those of many tasks (or of a number not known) meet in groups of tasks first."""
    if tasks is None or tasks > DIRECT:
        groups = DIRECT if tasks is None else int(tasks**0.5) + 1
        merged = lambda pdf: pd.DataFrame({"payload": [add_up(pdf["payload"]).tobytes()]})
        parts = parts.groupBy(F.pmod(F.spark_partition_id(), F.lit(groups)).alias("g")).applyInPandas(merged, "payload binary")
    return add_up(r.payload for r in parts.collect())
