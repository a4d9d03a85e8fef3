"""Registered queries and the SQL that must give the same rows.

Every query reads the given tables through the fixture views. Doubles are rounded to six
digits and counts are long on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.functions import scalars as S
from clonoform.sources.fixtures import view, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Doubles to six digits without a negative zero; whole numbers to long."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("double", "float") or kind.startswith("decimal"):
            c = F.round(c.cast("double"), 6) + F.lit(0.0)
        elif kind in ("tinyint", "smallint", "int"):
            c = c.cast("long")
        out.append(c.alias(name))
    return df.select(*out)


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: plain(f(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def final(source: str, spec: str) -> str:
    """SELECT of ``name:kind`` columns: i for a count, d for a double, others as they are."""
    out = []
    for item in spec.split():
        name, _, kind = item.partition(":")
        out.append({"i": f"CAST({name} AS BIGINT) AS {name}", "d": f"round(CAST({name} AS DOUBLE), 6) + 0.0 AS {name}", "": name}[kind])
    return f"SELECT {', '.join(out)} FROM ({source}) final_rows"


# --- SQL shared by several oracles --------------------------------------------------------
MISSING = "('', 'nan', 'none', 'na', '<na>')"
TRUE = "('true', 't', '1', 'yes', 'y', 'productive')"
FALSE = "('false', 'f', '0', 'no', 'n', 'nonproductive', 'unproductive')"


def sql_text(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) NOT IN {MISSING} THEN trim({c}) END"


def sql_flag(c: str) -> str:
    return f"CASE WHEN lower(trim({c})) IN {TRUE} THEN true WHEN lower(trim({c})) IN {FALSE} THEN false END"


def sql_chain(c: str) -> str:
    t = f"replace(replace(upper(trim({c})), '-', ''), '_', '')"
    whens = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.CHAIN_ALIASES.items())
    return f"CASE WHEN lower({t}) NOT IN {MISSING} THEN CASE {t} {whens} ELSE {t} END END"


def sql_name(prefix: str, number: str) -> str:
    """The prefix and a number of at least eight digits."""
    return f"'{prefix}' || CASE WHEN {number} < 10000000 THEN lpad(CAST({number} AS VARCHAR), 8, '0') ELSE CAST({number} AS VARCHAR) END"


def sql_natural(c: str) -> str:
    """Order of names that are letters and one number."""
    return f"lower(regexp_replace({c}, '[0-9]+', '')), CAST(regexp_extract({c}, '[0-9]+') AS INT)"


def sql_shannon(n: str) -> str:
    return f"CASE WHEN ln(sum({n})) - sum({n} * ln({n})) / sum({n}) > 1e-12 THEN ln(sum({n})) - sum({n} * ln({n})) / sum({n}) ELSE 0.0 END"


V = with_views
WITH_CONTIGS, WITH_ASSIGNED = V("contigs"), V("assigned", "contigs", "cells")
CANON = f"""canon AS (SELECT {sql_text("barcode")} AS cell_id, {sql_chain("chain")} AS chain, {sql_text("cdr3")} AS cdr3aa, {sql_text("v_gene")} AS v_call,
 {sql_flag("productive")} AS productive, {sql_flag("is_cell")} AS is_cell, {sql_flag("high_confidence")} AS high_confidence, umis, reads, raw_clonotype_id, source_order FROM contigs)"""


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "contigs")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "cells")


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "assigned")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assigned rows that have a sample."""
    return assigned(spark, sf_dir).where("sample_id is not null")
