"""Fingerprints of tables that don't depend on row order and can be merged.

Each row is hashed to 256 bits, cut into eight numbers of 32 bits; a table's fingerprint is
the sum of each of these over its rows. Sums of parts are the sum of the whole, a repeated row
counts twice, and to find another multiset of rows with the same sums means to solve a
knapsack of 256 bits of SHA-256.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS = 8


def row_text(columns: Sequence[str]) -> Column:
    """The columns as one text in which each value has its length before it, so that no two
    rows give the same text; NULL is told from an empty text."""
    cells = [F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (F.col(f"`{name}`").cast("string") for name in columns)]
    return F.concat(*cells)


def fingerprint(rows: DataFrame, text: Column, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_rows, limbs) of the rows of each group, ``limbs`` as text."""
    hashed = rows.select(*groups, F.sha2(text, 256).alias("__h"))
    limb = lambda i: F.conv(F.substring("__h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = [F.coalesce(F.sum(limb(i)), F.lit(0)).cast("string") for i in range(LIMBS)]
    return hashed.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_rows"), F.array(*sums).alias("limbs"))


def merged(parts: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """The fingerprints of the parts as one for each group."""
    sums = [F.coalesce(F.sum(F.col("limbs")[i].cast("decimal(38,0)")), F.lit(0)).cast("string") for i in range(LIMBS)]
    return parts.groupBy(*groups).agg(F.sum("n_rows").alias("n_rows"), F.array(*sums).alias("limbs"))


def digest(limbs: Column, more: str = "") -> Column:
    return F.sha2(F.concat(F.array_join(limbs, ":"), F.lit(more)), 256)
