"""Shared storage, text and span helpers of the operators in this subpackage."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.sources.staging import remove_tables, settle, stage

__all__ = ["ascii_lower", "join_groups_of", "numbered", "partitions", "remove_tables", "settle", "spans_text", "stage", "table", "tokenizer_path"]


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def numbered(rows: DataFrame) -> DataFrame:
    """The rows with a number ``rid`` of their own, written once so that it stays theirs."""
    return stage(rows.withColumn("rid", F.monotonically_increasing_id()), "numbered")


#: A group of more rows is joined in parts.
HOT = 1_000_000


def join_groups_of(rows: DataFrame, groups: DataFrame, key: str, size: str, most: int | None = None) -> DataFrame:
    """Each row (with ``rid``) with its group's row. The rows of a group larger than ``most``
    (``HOT``) are dealt to parts, to each of which the group's row is repeated. The list of
    such groups, by a hash of their keys, is broadcast: its sizes add up to the rows, so it
    has at most one row for ``most`` of them."""
    hashed, most = F.xxhash64(key).alias("key_hash"), most or HOT
    hot = stage(groups.where(F.col(size) > most).groupBy(hashed).agg(F.max(F.ceil(F.col(size) / most)).cast("int").alias("parts")), "hot-groups")
    parts = lambda df: df.select("*", hashed).join(F.broadcast(hot), "key_hash", "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("key_hash")
    left = parts(rows).withColumn("salt", F.pmod("rid", F.col("parts")).cast("int")).drop("parts")
    right = parts(groups).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return left.join(right, [key, "salt"]).drop("salt")


def ascii_lower(c):
    """Lower-case A-Z only. ``lower`` does the same on pure ASCII text and is much faster
    than ``translate``, so the choice is made row by row."""
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, upper, low))


def spans_text(spans: list[tuple[int, int, str]], kinds: tuple[str, ...]) -> str:
    """``kind:start:end`` by start, then kind as listed, joined by commas."""
    order = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda x: (x[0], order[x[2]], x[1])))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Path of a vocabulary file of the installed collection of public tokenizers."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
