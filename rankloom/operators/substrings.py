"""Names that hold one another, by an index of whole names.

A name of n characters that stands inside another is one of its pieces of n
characters. So the pieces of every name of the lengths that the other side has are
joined to the other side's names by hash: what meets is a match but for collisions
of the hash, which a comparison drops. Nothing is compared that shares no piece.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def inside(hay: DataFrame, needles: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, hay, needle: the needles of each group that stand inside a hay of the group. Columns: on, ``text``; distinct, not empty."""
    lengths = needles.select(*on, F.length("text").alias("_n")).distinct()
    sized = hay.withColumnRenamed("text", "hay").join(lengths, list(on)).where(F.col("_n") <= F.length("hay"))
    pieces = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("hay") - F.col("_n") + 1), lambda i: F.xxhash64(F.substr("hay", i, F.col("_n")))))
    hashed = needles.select(*on, F.col("text").alias("needle"), F.xxhash64("text").alias("_h"))
    met = sized.select(*on, "hay", F.explode(pieces).alias("_h")).join(hashed, [*on, "_h"])
    return met.where(F.contains("hay", "needle")).select(*on, "hay", "needle")


def holding(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """on, a, b: texts of the two sides of which one holds the other, or that are equal. Columns: on, ``text``."""
    a, b = (df.where(F.col("text") != "").select(*on, "text").distinct() for df in (left, right))
    one = inside(a, b, on).select(*on, F.col("hay").alias("a"), F.col("needle").alias("b"))
    two = inside(b, a, on).select(*on, F.col("needle").alias("a"), F.col("hay").alias("b"))
    return one.unionByName(two).distinct()
