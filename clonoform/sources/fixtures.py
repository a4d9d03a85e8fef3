"""Receptor-shaped views over the TPC-H-like tables, for the registered queries.

One SQL text serves Spark and the oracle, where it becomes common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONTIGS = """
SELECT 'cell_' || CAST(l_orderkey AS VARCHAR(20)) AS barcode,
 'contig_' || CAST(l_orderkey AS VARCHAR(20)) || '_' || CAST(k AS VARCHAR(20)) AS contig_id,
 CAST(l_orderkey AS BIGINT) * 100 + k AS source_order,
 CASE WHEN l_linestatus = 'F' AND l_suppkey % 5 = 0 THEN 'alpha'
      WHEN l_suppkey % 7 = 0 THEN 'TCR-B' ELSE 'TRB' END AS chain,
 CASE WHEN l_partkey % 29 = 0 THEN 'nan'
      ELSE CASE WHEN l_partkey % 17 = 0 THEN 'ASS' ELSE 'CASS' END
        || substr('ACDEFGHIKLMNPQRSTVWY', CAST(l_partkey % 20 AS INT) + 1, 1)
        || substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(l_partkey / 20) % 20 AS INT) + 1, 1)
        || CASE WHEN l_partkey % 3 = 0 THEN 'G' ELSE '' END
        || substr('ACDEFGHIKLMNPQRSTVWY', CAST(floor(l_partkey / 400) % 20 AS INT) + 1, 1)
        || CASE WHEN l_partkey % 2 = 0 THEN 'EQYF' ELSE 'NTQW' END END AS cdr3,
 'TRBV' || CAST(l_suppkey % 30 + 1 AS VARCHAR(20)) AS v_gene,
 CASE l_returnflag WHEN 'R' THEN 'False' WHEN 'A' THEN 'true' ELSE '1' END AS productive,
 CASE WHEN l_discount < 0.01 THEN 'false' ELSE 'true' END AS is_cell,
 CASE WHEN l_tax < 0.01 THEN 'false' ELSE 'true' END AS high_confidence,
 CAST(l_quantity AS INT) AS umis, CAST(l_linenumber * 10 AS INT) AS reads,
 CASE WHEN l_suppkey % 11 = 0 THEN NULL
      ELSE 'clonotype_' || CAST(l_partkey AS VARCHAR(20)) END AS raw_clonotype_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey
        ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate,
                 l_quantity, l_discount, l_tax) AS k FROM {lineitem}) t"""

CELLS = """
SELECT 'cell_' || CAST(o_orderkey AS VARCHAR(20)) AS cell_id,
 'donor_' || CAST(o_custkey % 60 AS VARCHAR(20)) AS donor_id,
 'sample_' || CAST(o_custkey % 60 AS VARCHAR(20)) || '_' || CAST(year(o_orderdate) AS VARCHAR(20)) AS sample_id,
 CAST(year(o_orderdate) AS INT) AS timepoint,
 o_orderpriority AS cell_type,
 CASE WHEN o_custkey % 60 < 30 THEN 'A' ELSE 'B' END AS cohort
FROM {orders}"""

ASSIGNED = """
SELECT c.barcode AS cell_id, c.source_order, 'TRB' AS chain, nullif(c.cdr3, 'nan') AS cdr3aa, c.v_gene AS v_call,
 CASE WHEN c.productive = 'False' THEN false ELSE true END AS productive,
 c.raw_clonotype_id AS clonotype_id,
 CASE WHEN c.cdr3 LIKE 'C%' THEN 'RFU' || CAST((ascii(substr(c.cdr3, 5, 1)) * 7 + ascii(substr(c.cdr3, 6, 1)) * 3
      + length(c.cdr3)) % 40 + 1 AS VARCHAR(20)) END AS rfu_label,
 CASE WHEN c.cdr3 LIKE 'C%' THEN CAST((ascii(substr(c.cdr3, 5, 1)) * 13
      + ascii(substr(c.cdr3, 7, 1)) * 17) % 100 AS DOUBLE) / 100 END AS rfu_score,
 CASE WHEN c.cdr3 LIKE 'C%' THEN (ascii(substr(c.cdr3, 5, 1)) * 13
      + ascii(substr(c.cdr3, 7, 1)) * 17) % 100 >= 60 END AS pass_thr,
 m.donor_id, m.sample_id, m.timepoint, m.cell_type, m.cohort
FROM {contigs} c LEFT JOIN {cells} m ON c.barcode = m.cell_id
WHERE c.chain <> 'alpha'"""

WIDE_FIELDS = (("locus", "chain"), ("junction_aa", "cdr3"), ("v_call", "v_gene"), ("productive", "productive"), ("duplicate_count", "umis"), ("consensus_count", "reads"))
WELLS_WIDE = (
    "\nSELECT barcode AS cell_id,\n "
    + ",\n ".join(f"max(CASE WHEN s = {s} THEN {source} END) AS ir_vdj_{s}_{field}" for s in (1, 2) for field, source in WIDE_FIELDS)
    + "\nFROM (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY source_order) AS s FROM {contigs}) t\nWHERE s <= 2 GROUP BY barcode"
)

EVIDENCE = """
SELECT DISTINCT cdr3, v_gene, 'EP' || CAST(ascii(substr(cdr3, 5, 1)) % 6 AS VARCHAR(20)) AS epitope, 'release-1' AS release_label
FROM {contigs} WHERE cdr3 LIKE 'C%' AND ascii(substr(cdr3, 6, 1)) % 4 = 0
UNION
SELECT DISTINCT cdr3, v_gene, 'EP9' AS epitope, 'release-1' AS release_label
FROM {contigs} WHERE cdr3 LIKE 'C%' AND ascii(substr(cdr3, 6, 1)) % 12 = 0"""

VIEWS = {"contigs": CONTIGS, "cells": CELLS, "assigned": ASSIGNED, "wells_wide": WELLS_WIDE, "evidence_ref": EVIDENCE}
USES = {"contigs": (), "cells": (), "assigned": ("contigs", "cells"), "wells_wide": ("contigs",), "evidence_ref": ("contigs",)}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture views over the tables of a folder."""
    if name == "contigs":
        return spark.sql(CONTIGS, lineitem=load(spark, sf_dir, "lineitem"))
    if name == "cells":
        return spark.sql(CELLS, orders=load(spark, sf_dir, "orders"))
    return spark.sql(VIEWS[name], **{x: view(spark, sf_dir, x) for x in USES[name]})


def with_views(*wanted: str) -> str:
    """The views and what they use, as the start of an oracle query."""
    order = [v for v in VIEWS if v in wanted or any(v in USES[w] for w in wanted)]
    tables = {x: x for x in ("lineitem", "orders", *VIEWS)}
    return "WITH " + ",\n".join(f"{v} AS ({VIEWS[v].format(**tables)})" for v in order)


def trimer_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trimer, vec: the letters' codes, modulo the size of the table, select embeddings; a
    third of the trimers is absent."""
    letter = lambda i: F.substr(F.lit("ACDEFGHIKLMNPQRSTVWY"), (i + 1).cast("int"), F.lit(1))
    code, vectors = F.col("id"), load(spark, sf_dir, "embeddings")
    size = vectors.agg(F.count(F.lit(1)).alias("size"))
    codes = spark.range(8000).where(code % 3 != 0).join(F.broadcast(size), F.lit(True)).select(
        F.concat(letter(F.floor(code / 400)), letter(F.floor(code / 20) % 20), letter(code % 20)).alias("trimer"),
        (code % F.col("size")).alias("vec_id"),
    )
    return codes.join(vectors, "vec_id").select("trimer", F.col("embedding").cast("array<double>").alias("vec"))


def centroid_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rfu_id, vec, cluster_size of all embeddings."""
    rows = load(spark, sf_dir, "embeddings")
    return rows.select((F.col("vec_id") + 1).cast("int").alias("rfu_id"), F.col("embedding").cast("array<double>").alias("vec"), (F.col("vec_id") % 7 + 1).cast("long").alias("cluster_size"))
