"""Reading and writing receptor tables, caches and exports."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.functions.fingerprints import digest, fingerprint, merged, row_text
from clonoform.functions.scalars import natural_key
from clonoform.operators.canonical import SCHEMA_VERSION, canonicalize, validate_receptors


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A delimited table with a header, all text: tabs if the name holds ``.tsv``, else
    commas; gzip is recognised by its ending."""
    sep = "\t" if ".tsv" in path.rsplit("/", 1)[-1].lower() else ","
    return spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)


def select_rows(df: DataFrame, *, key: str, columns: Sequence[str] | None = None, selected: DataFrame | None = None, max_rows: int | None = None, order_by: str | None = None, check: bool = True) -> DataFrame:
    """Chosen columns of chosen rows. ``selected`` (key, ordinal) asks for rows by name, in
    that order (column ``ordinal``); unknown names raise. ``max_rows`` takes a prefix by
    ``order_by`` instead. Column pruning and the semi join reach the scan."""
    if selected is not None and max_rows is not None:
        raise ValueError("give names or a prefix, not both")
    unknown = [c for c in columns or [] if c not in df.columns]
    if unknown:
        raise ValueError(f"unknown columns {unknown}")
    out = df.select(*dict.fromkeys([key, *(columns or df.columns), *([order_by] if order_by else [])]))
    if selected is not None:
        if check:
            missing = [r[0] for r in selected.join(df.select(key), key, "left_anti").select(key).limit(10).collect()]
            if missing:
                raise ValueError(f"unknown row names: {missing}")
        return selected.select(key, "ordinal").join(out, key)
    if max_rows is not None:
        if order_by is None:
            raise ValueError("a prefix needs order_by")
        return out.orderBy(order_by).limit(max_rows)
    return out


def cache_manifest(receptors: DataFrame, cells: DataFrame) -> DataFrame:
    """The counts that a cache's manifest holds."""
    chains = receptors.groupBy("chain").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("productive")).alias("productive"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    counts = chains.agg(total("n").alias("receptor_row_count"), F.count("chain").alias("chain_count"), total("productive").alias("productive_row_count"))
    counts = counts.join(receptors.agg(F.count_distinct("cell_id").alias("receptor_cell_count")), F.lit(True)).select("receptor_row_count", "receptor_cell_count", "chain_count", "productive_row_count")
    return counts.join(cells.agg(F.count(F.lit(1)).alias("metadata_row_count")), F.lit(True))


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


#: The tables of a cache and the column that each is partitioned by.
CACHE_TABLES = {"receptors": "chain", "cells": None}
#: Fixed value: the folder name that Spark gives to NULL in a partition column.
NULL_PART = "__HIVE_DEFAULT_PARTITION__"


def _part(column: str | None) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(NULL_PART)) if column else F.lit("")


def _parts_of(spark: SparkSession, path: str, name: str, parts: Sequence[str] | None = None) -> DataFrame:
    """(name, part, n_rows, limbs) of a cache's table as it is now; of some parts, only these
    are read."""
    column = CACHE_TABLES[name]
    df = spark.read.parquet(f"{path}/{name}")
    if parts is not None and column:
        chosen = [p for p in parts if p != NULL_PART]
        keep = F.col(column).isin(chosen) if chosen else F.lit(False)
        df = df.where(keep | F.col(column).isNull() if NULL_PART in parts else keep)
    text = row_text(sorted(df.columns))
    return fingerprint(df.withColumn("part", _part(column)), text, ["part"]).select(F.lit(name).alias("name"), "part", "n_rows", "limbs")


def _files_of(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, part, file, length, modified) of a cache's table; no content is read."""
    column = CACHE_TABLES[name]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(f"{path}/{name}")
    part = F.url_decode(F.regexp_extract("path", rf"/{column}=([^/]*)/", 1)) if column else F.lit("")
    return files.select(F.lit(name).alias("name"), part.alias("part"), F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.col("modificationTime").cast("double").alias("modified"))


def write_cache(path: str, receptors: DataFrame, cells: DataFrame, force: bool = False) -> dict:
    """Validate and write both tables and a manifest: counts and fingerprints in total, one
    fingerprint for each partition, and the size and time of each file. An existing cache
    raises unless ``force``."""
    spark = receptors.sparkSession
    validate_receptors(receptors, strict=True)
    unknown = receptors.select("cell_id").join(cells.select("cell_id"), "cell_id", "left_anti").distinct().limit(10).collect()
    if unknown:
        raise ValueError(f"receptor cells are absent from the metadata: {[r[0] for r in unknown]}")
    mode = "overwrite" if force else "errorifexists"
    receptors.write.mode(mode).partitionBy("chain").parquet(f"{path}/receptors")
    cells.write.mode(mode).parquet(f"{path}/cells")
    for name in CACHE_TABLES:
        _parts_of(spark, path, name).write.mode("overwrite").parquet(f"{path}/manifest-parts/{name}")
        _files_of(spark, path, name).write.mode("overwrite").parquet(f"{path}/manifest-files/{name}")
    manifest = {"schema_version": SCHEMA_VERSION}
    for name in CACHE_TABLES:
        r = merged(spark.read.parquet(f"{path}/manifest-parts/{name}")).select("n_rows", digest(F.col("limbs")).alias("content")).first()
        manifest[name] = {"n_rows": r["n_rows"] or 0, "content": r["content"]}
    manifest["counts"] = cache_manifest(spark.read.parquet(f"{path}/receptors"), spark.read.parquet(f"{path}/cells")).first().asDict()
    _write_text(spark, f"{path}/manifest", json.dumps(manifest, sort_keys=True))
    return manifest


def changed_parts(spark: SparkSession, path: str, name: str) -> list[str]:
    """The partitions of a cache's table whose files aren't those that were written: another
    name, size or time."""
    keys = ["name", "part", "file"]
    now, then = (df.select(*keys, F.struct("length", "modified").alias(c)) for df, c in ((_files_of(spark, path, name), "now"), (spark.read.parquet(f"{path}/manifest-files/{name}"), "then")))
    odd = now.join(then, keys, "full").where(~F.col("now").eqNullSafe(F.col("then")))
    return sorted(r["part"] for r in odd.select("part").distinct().collect())


def validate_cache(spark: SparkSession, path: str, deep: bool = False) -> list[str]:
    """What is wrong with a cache; empty if nothing is. Only partitions whose files changed
    are read again, or all of them if ``deep``."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        return [f"no manifest: {type(e).__name__}"]
    out = [] if manifest.get("schema_version") == SCHEMA_VERSION else ["schema version differs"]
    for name in CACHE_TABLES:
        try:
            known = spark.read.parquet(f"{path}/manifest-parts/{name}")
            parts = None if deep else changed_parts(spark, path, name)
            if parts == []:
                continue
            fresh = _parts_of(spark, path, name, parts)
            if parts is not None:
                fresh = fresh.unionByName(known.where(~F.col("part").isin(parts)))
            r = merged(fresh).select(F.coalesce("n_rows", F.lit(0)).alias("n_rows"), digest(F.col("limbs")).alias("content")).first()
        except Exception as e:
            out.append(f"{name} can't be read: {type(e).__name__}")
            continue
        if r["n_rows"] != manifest[name]["n_rows"]:
            out.append(f"{name} has {r['n_rows']} rows instead of {manifest[name]['n_rows']}")
        elif r["content"] != manifest[name]["content"]:
            out.append(f"{name} differs in content")
    return out


def read_cache(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Both tables of a valid cache; an invalid one raises."""
    wrong = validate_cache(spark, path)
    if wrong:
        raise ValueError("invalid receptor cache: " + "; ".join(wrong))
    return canonicalize(spark.read.parquet(f"{path}/receptors")), spark.read.parquet(f"{path}/cells")


def export_matrix(long: DataFrame, path: str, *, row: str, column: str = "rfu_label", value: str = "value", sep: str = ",", most_columns: int = 10_000) -> list[str]:
    """Pivot a long table and write it as delimited text; the columns are in natural order.
    Column names are listed on the driver, at most ``most_columns``."""
    levels = [r[0] for r in long.select(column).where(F.col(column).isNotNull()).distinct().orderBy(natural_key(F.col(column))).limit(most_columns + 1).collect()]
    if len(levels) > most_columns:
        raise ValueError(f"more than {most_columns} columns; export the long table")
    long.groupBy(row).pivot(column, levels).agg(F.first(value)).na.fill(0).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return levels


#: Alternative names of the figures in run manifests; dots go down a level.
MANIFEST_FIELDS = {
    "receptor_rows": ("receptor_row_count", "original_row_count", "qc.selected_receptor_row_count"),
    "eligible_rows": ("eligible_row_count", "eligible_rows"),
    "unique_queries": ("unique_query_count", "unique_queries"),
}


def combine_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each run manifest (JSON): the first non-null of several names for each
    figure, and receptor rows over unique queries."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.input_file_name().alias("file"))
    get = lambda names: F.coalesce(*[F.get_json_object("value", f"$.{n}") for n in names]).cast("long")
    out = text.select("file", *[get(n).alias(k) for k, n in MANIFEST_FIELDS.items()])
    return out.withColumn("deduplication_ratio", F.try_divide(F.col("receptor_rows").cast("double"), F.col("unique_queries")))
