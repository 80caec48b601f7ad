"""Joins that neither gather a frequent key in one task nor shuffle rows that can't match.

``lookup`` joins rows to a table of one row a key. Keys that own more rows than a
task's fair share are few by definition (rows / share of them at most), so they
are broadcast; the others are joined by a shuffle.

``maybe`` tells rows apart by a bitmap of the keys' hashes, which is broadcast and
never larger than ``MOST_BITS``: a row whose bit isn't set has no key in the table
for certain and needs no join. With very many keys the bitmap says "maybe" more
often, never wrongly "no", so results stay exact at any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, LEAST_BITS, MOST_BITS = 64, 1 << 15, 1 << 28
LEAST_SHARE = 64


def fair_share(n: int, df: DataFrame) -> int:
    """Rows a task gets where ``n`` rows are dealt evenly."""
    return max(LEAST_SHARE, n // int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup(rows: DataFrame, found: DataFrame, key: str, share: int, how: str = "left") -> DataFrame:
    """``rows`` joined to ``found`` (one row a key, with ``n``, the number of rows that have it) on ``key``.

    ``found`` may leave out keys; ``how`` is left or inner. Rows of a null key find nothing.
    """
    values = [c for c in found.columns if c not in (key, "n")]
    hot = F.broadcast(found.where(F.col("n") > share).select(key, F.struct(*values).alias("_hot")))
    marked = rows.join(hot, key, "left")
    of_hot = marked.where(F.col("_hot").isNotNull()).select(*rows.columns, *(F.col(f"_hot.{v}").alias(v) for v in values))
    others = marked.where(F.col("_hot").isNull()).drop("_hot")
    cold = found.where(F.col("n") <= share).select(key, *values)
    of_cold = others.where(F.col(key).isNotNull()).join(cold, key, how).select(*rows.columns, *values)
    out = of_hot.unionByName(of_cold)
    if how == "inner":
        return out
    kinds = dict(found.dtypes)
    return out.unionByName(others.where(F.col(key).isNull()).select(*rows.columns, *(F.lit(None).cast(kinds[v]).alias(v) for v in values)))


def maybe(rows: DataFrame, hashed: Column, keys: DataFrame, key_hash: Column, n: int) -> DataFrame:
    """``rows`` with ``_maybe``: false only where no key of the stored table ``keys`` (``n`` rows) has the row's hash."""
    bits = LEAST_BITS
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    at = F.pmod(key_hash, F.lit(bits))
    bitmap = keys.select(F.shiftright(at, 15).alias("_bucket"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("_bit")).groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    own = F.pmod(hashed, F.lit(bits))
    marked = rows.withColumns({"_bucket": F.shiftright(own, 15), "_bit": own.bitwiseAND(F.lit((1 << 15) - 1)).cast("int")}).join(F.broadcast(bitmap), "_bucket", "left")  # MOST_BITS at most
    is_set = F.expr("shiftright(cast(conv(hex(substring(_bitmap, _bit div 8 + 1, 1)), 16, 10) AS int), _bit % 8) & 1 = 1")
    return marked.select(*rows.columns, F.coalesce(is_set, F.lit(False)).alias("_maybe"))


def largest_counts(counted: DataFrame, n_col: str, most: int) -> DataFrame:
    """The rows of the largest counts, ``most`` of them at most: all whose count is above a bound that a histogram of the counts' sizes gives."""
    step = F.floor(F.log2(F.col(n_col)) * 8)
    sizes = sorted(((r["step"], r["count"]) for r in counted.groupBy(step.alias("step")).count().collect()), reverse=True)  # a row for each eighth of a power of two
    total, least = 0, None
    for at, n in sizes:
        if total + n > most:
            break
        total, least = total + n, at
    return counted.where(step >= least) if least is not None else counted.where(F.lit(False))
