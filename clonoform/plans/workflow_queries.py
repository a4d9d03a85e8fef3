"""Queries that write tables to the shared folder and return what is read back: delimited text,
caches, exports and whole workflows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.operators import adapters, canonical, metrics
from clonoform.plans import workflows
from clonoform.plans.base import CANON, WITH_ASSIGNED, WITH_CONTIGS, V, assigned, cells, contigs, final, query, sampled
from clonoform.plans.receptor_queries import AIRR, CELLRANGER, CELLRANGER_ROWS, CHOSEN, FIRST_ROW, RECEPTOR_COLUMNS, ROW_NAME, SCORES, SLOTS, THRESHOLD, WELLS, WIDE, cellranger, scorers, wide
from clonoform.sources import tables as io
from clonoform.sources.fixtures import VIEWS
from clonoform.sources.staging import new_path, stage


@query("delimited_roundtrip", final(f"{WITH_CONTIGS}, {CANON} SELECT cell_id, chain, cdr3aa, v_call, productive, umis AS umi_count, source_order FROM canon", "cell_id chain cdr3aa v_call productive umi_count:i source_order:i"))
def _(spark, sf_dir):
    path = new_path(spark, "contigs.tsv")
    contigs(spark, sf_dir).write.option("header", True).option("sep", "\t").option("compression", "gzip").csv(path)
    text = io.read_delimited(spark, path)
    names = [F.col("barcode").alias("cell_id"), "chain", F.col("cdr3").alias("cdr3aa"), F.col("v_gene").alias("v_call"), "productive", F.col("umis").alias("umi_count"), F.col("source_order").cast("long").alias("source_order"), F.lit("").alias("input_row_id")]
    rows = canonical.canonicalize(text.select(*names), "fixture", "source_order")
    return rows.select("cell_id", "chain", "cdr3aa", "v_call", "productive", F.col("umi_count").cast("long").alias("umi_count"), "source_order")


@query("cache_roundtrip", final(CELLRANGER_ROWS, "input_row_id cell_id chain cdr3aa v_call productive source_row_id umi_count:i read_count:i clonotype_id"))
def _(spark, sf_dir):
    out, path = cellranger(spark, sf_dir), new_path(spark, "cache")
    io.write_cache(path, out.receptors, out.cell_metadata)
    return io.read_cache(spark, path)[0].select(*RECEPTOR_COLUMNS)


@query(
    "matrix_export",
    final(
        f"""{WITH_ASSIGNED}, n AS (SELECT cohort, rfu_label, count(*) AS value FROM assigned WHERE cohort IS NOT NULL AND rfu_label IS NOT NULL GROUP BY ALL)
 SELECT cohort, rfu_label, coalesce(value, 0) AS value FROM (SELECT DISTINCT cohort FROM n) g CROSS JOIN (SELECT DISTINCT rfu_label FROM n) r LEFT JOIN n USING (cohort, rfu_label)""",
        "cohort rfu_label value:i",
    ),
)
def _(spark, sf_dir):
    path = new_path(spark, "matrix.tsv")
    levels = io.export_matrix(metrics.aggregate_rfu(assigned(spark, sf_dir), "cohort", normalize=False), path, row="cohort", sep="\t")
    wide = io.read_delimited(spark, path)
    return wide.unpivot(["cohort"], levels, "rfu_label", "value").withColumn("value", F.col("value").cast("long"))


def _receptor_workflow(spark, sf_dir, **options) -> dict[str, DataFrame]:
    return workflows.receptor_workflow(contigs(spark, sf_dir), "cellranger", new_path(spark, "workflow"), order_by="source_order", **options)


@query("offline_workflow", final(f"{CELLRANGER} SELECT cell_id, cdr3aa, CASE WHEN cdr3aa LIKE 'C%' THEN 'skipped_backend' ELSE 'ineligible_sequence' END AS assignment_status FROM chosen WHERE best = 1", "cell_id cdr3aa assignment_status"))
def _(spark, sf_dir):
    return _receptor_workflow(spark, sf_dir)["per_row"].select("cell_id", "cdr3aa", "assignment_status")


@query("receptor_workflow", final(f"{SCORES}, {CHOSEN} SELECT cell_id, chosen.cdr3aa AS cdr3aa, rfu_id, rfu_label, rfu_score, pass_thr FROM chosen LEFT JOIN scored ON chosen.cdr3aa = scored.cdr3aa WHERE best = 1", "cell_id cdr3aa rfu_id:i rfu_label rfu_score:d pass_thr"))
def _(spark, sf_dir):
    out = _receptor_workflow(spark, sf_dir, scorers=scorers(spark, sf_dir), threshold=THRESHOLD)
    return out["per_row"].select("cell_id", "cdr3aa", "rfu_id", "rfu_label", "rfu_score", "pass_thr")


@query("dataset_report", final(f"{WITH_ASSIGNED} SELECT cohort, rfu_label, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cohort) AS value FROM assigned WHERE cohort IS NOT NULL AND rfu_label IS NOT NULL GROUP BY cohort, rfu_label", "cohort rfu_label value:d"))
def _(spark, sf_dir):
    out = workflows.dataset_report(contigs(spark, sf_dir), cells(spark, sf_dir), assigned(spark, sf_dir), new_path(spark, "report"), group="cohort")
    return out["rfu_by_cohort"]


@query("downstream_analysis", final(f"{WITH_ASSIGNED} SELECT sample_id, rfu_label, count(DISTINCT cell_id) AS n, count(DISTINCT cell_id) AS value FROM assigned WHERE sample_id IS NOT NULL AND rfu_label IS NOT NULL AND cdr3aa IS NOT NULL AND cell_id IS NOT NULL GROUP BY sample_id, rfu_label", "sample_id rfu_label n:i value:d"))
def _(spark, sf_dir):
    metadata = cells(spark, sf_dir)
    rows = sampled(spark, sf_dir).drop(*[c for c in metadata.columns if c != "cell_id"])
    out = workflows.downstream_analysis(rows, metadata, new_path(spark, "downstream"), sample="sample_id", phenotype_key="cohort", order_by="source_order")
    return out["pseudobulk_counts"]


# --- registry, named tables, prefixes, run manifests ------------------------------------------------
NAMED = "input_row_id cell_id chain cdr3aa v_call productive umi_count:i read_count:i"


@query("named_tables", final(f"{AIRR} SELECT {ROW_NAME} AS input_row_id, cell_id, chain, cdr3aa, v_call, productive, umis AS umi_count, reads AS read_count FROM chosen WHERE best = 1", NAMED))
def _(spark, sf_dir):
    """The receptors of one table of several, checked against the cells of another."""
    source = {"airr": contigs(spark, sf_dir).drop("raw_clonotype_id"), "cells": cells(spark, sf_dir)}
    made = adapters.prepare_receptors(source, "airr", receptors="airr", cells="cells", order_by="source_order", chain="TRB")
    return made.receptors.select(*[c.split(":")[0] for c in NAMED.split()])




@query(
    "adapter_registry",
    final(
        f"""{WELLS.replace("chosen", "wells_chosen")}, {CANON}, {AIRR.split(f"{CANON}, ")[1].replace("chosen", "airr_chosen")}, {CHOSEN},
 n AS (SELECT 'cellranger_vdj' AS adapter, count(*) AS n_rows, count(DISTINCT cell_id) AS n_cells FROM chosen WHERE best = 1
 UNION ALL SELECT name, count(*), count(DISTINCT cell_id) FROM airr_chosen, (SELECT unnest(['generic_airr_dataframe', 'scirpy_airr']) AS name) a WHERE best = 1 GROUP BY name
 UNION ALL SELECT 'wells_tcr_ir', count(*), count(DISTINCT cell_id) FROM wells_chosen WHERE best = 1) SELECT * FROM n""",
        "adapter n_rows:i n_cells:i",
    ),
)
def _(spark, sf_dir):
    """What each registered adapter makes of its kind of source."""
    out, own = None, stage(contigs(spark, sf_dir), "contigs")
    slots = stage(spark.sql(VIEWS["wells_wide"], contigs=own), "wells-wide")
    for name in adapters.list_receptor_adapters():
        source = slots if name == "wells_tcr_ir" else own
        options = {} if name == "wells_tcr_ir" else {"order_by": "source_order"}
        made = adapters.prepare_receptors(source, name, chain="TRB", **options)
        one = made.qc.select(F.lit(name).alias("adapter"), F.col("selected_receptor_row_count").alias("n_rows"), F.col("selected_cell_count").alias("n_cells"))
        out = one if out is None else out.unionByName(one)
    return out


@query("prefix_read", final(f"{V('cells')} SELECT cell_id, sample_id, o FROM (SELECT *, CAST(substr(cell_id, 6) AS BIGINT) AS o FROM cells) t ORDER BY o LIMIT 500", "cell_id sample_id o:i"))
def _(spark, sf_dir):
    """The first 500 cells in source order, as for a trial run."""
    own = cells(spark, sf_dir).withColumn("o", F.substr("cell_id", F.lit(6)).cast("long"))
    return io.select_rows(own, key="cell_id", columns=["sample_id"], max_rows=500, order_by="o")


_TRB = f"{WITH_CONTIGS}, {CANON}, runs AS (SELECT source_order % 7 AS run, count(*) AS receptor_rows, count(*) FILTER (WHERE cdr3aa LIKE 'C%') AS eligible_rows, count(DISTINCT cdr3aa) FILTER (WHERE cdr3aa LIKE 'C%') AS unique_queries FROM canon GROUP BY 1)"


@query("run_manifests", final(f"{_TRB} SELECT receptor_rows, CASE WHEN run % 2 = 0 THEN eligible_rows END AS eligible_rows, unique_queries, receptor_rows * 1.0 / nullif(unique_queries, 0) AS deduplication_ratio FROM runs", "receptor_rows:i eligible_rows:i unique_queries:i deduplication_ratio:d"))
def _(spark, sf_dir):
    """One manifest a run, under the names of two formats, read back as rows."""
    rows = contigs(spark, sf_dir).select((F.col("source_order") % 7).alias("run"), F.when(F.lower(F.trim("cdr3")) != "nan", F.trim("cdr3")).alias("cdr3aa"))
    ok = F.col("cdr3aa").startswith("C")
    n = rows.groupBy("run").agg(F.count(F.lit(1)).alias("rows"), F.count_if(ok).alias("eligible"), F.count_distinct(F.when(ok, F.col("cdr3aa"))).alias("unique"))
    flat = F.to_json(F.struct(F.col("rows").alias("receptor_row_count"), F.col("eligible").alias("eligible_row_count"), F.col("unique").alias("unique_query_count")))
    nested = F.to_json(F.struct(F.struct(F.col("rows").alias("selected_receptor_row_count")).alias("qc"), F.col("unique").alias("unique_queries")))
    path = new_path(spark, "runs")
    n.select("run", F.when(F.col("run") % 2 == 0, flat).otherwise(nested).alias("value")).repartition(F.col("run")).write.partitionBy("run").text(path)
    return io.combine_manifests(spark, f"{path}/run=*/*.txt").drop("file")


WELLS_CTE = "wells_wide AS " + WIDE.split("wells_wide AS ", 1)[1]


# --- further workflows --------------------------------------------------------------------------------
@query(
    "atlas_workflow",
    final(
        f"""{SCORES}, {WELLS_CTE}, {SLOTS}, picked AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dup DESC NULLS LAST, con DESC NULLS LAST, slot_order) AS best FROM slots WHERE chain = 'TRB' AND productive)
 SELECT cell_id, picked.cdr3aa AS cdr3aa, picked.v_call, source_slot, rfu_id, rfu_score, pass_thr FROM picked LEFT JOIN scored ON picked.cdr3aa = scored.cdr3aa WHERE best = 1""",
        "cell_id cdr3aa v_call source_slot rfu_id:i rfu_score:d pass_thr",
    ),
)
def _(spark, sf_dir):
    own = wide(spark, sf_dir).withColumn("place", F.substr("cell_id", F.lit(6)).cast("long"))
    out = workflows.atlas_workflow(own, new_path(spark, "atlas"), scorers=scorers(spark, sf_dir), order_by="place", columns=["place"], threshold=THRESHOLD)
    return out["per_row"].select("cell_id", "cdr3aa", "v_call", "source_slot", "rfu_id", "rfu_score", "pass_thr")


@query("two_files", final(f"{V('contigs', 'cells')} SELECT m.cell_id, coalesce(t.chain, '') AS chain, coalesce(nullif(t.cdr3, ''), '') AS cdr3aa, coalesce(t.v_gene, '') AS v_call, coalesce(lower(t.productive) IN ('true', 't', '1', 'yes', 'productive'), false) AS productive FROM cells m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY CAST(upper(chain) = 'TRB' AS INT) DESC, CAST(lower(productive) IN ('true', 't', '1', 'yes', 'productive') AS INT) DESC, source_order) AS best FROM contigs) t ON t.barcode = m.cell_id AND t.best = 1", "cell_id chain cdr3aa v_call productive"))
def _(spark, sf_dir):
    """Receptors written in source order to a folder of files of different sizes, and cells."""
    tcr, meta = new_path(spark, "tcr.csv"), new_path(spark, "meta.csv")
    rows = contigs(spark, sf_dir).select("barcode", "chain", "cdr3", "v_gene", "productive", "source_order")
    rows.repartitionByRange("source_order").sortWithinPartitions("source_order").drop("source_order").write.option("header", True).csv(tcr)
    cells(spark, sf_dir).select("cell_id", "sample_id").write.option("header", True).csv(meta)
    return workflows.prepare_two_files(spark, tcr, meta)[0]


@query("attached_summary", final(f"{WITH_ASSIGNED}, {CANON}, f AS (SELECT * FROM {FIRST_ROW} t WHERE k = 1 AND cell_id IN (SELECT cell_id FROM canon WHERE chain = 'TRB' AND productive)), j AS (SELECT m.cohort, f.rfu_label FROM cells m LEFT JOIN f ON m.cell_id = f.cell_id) SELECT cohort, rfu_label, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY cohort) AS value FROM j WHERE cohort IS NOT NULL AND rfu_label IS NOT NULL GROUP BY cohort, rfu_label", "cohort rfu_label value:d"))
def _(spark, sf_dir):
    best = adapters.primary_chain(assigned(spark, sf_dir), [])
    results = best.select("cell_id", "rfu_label", "rfu_score")
    airr = contigs(spark, sf_dir).select(F.col("barcode").alias("cell_id"), "chain", F.col("cdr3").alias("cdr3aa"), F.col("v_gene").alias("v_call"), "productive", "source_order")
    out = workflows.attached_summary(airr, cells(spark, sf_dir).select("cell_id", "cohort"), results, new_path(spark, "attached"), order_by="source_order", groupby="cohort")
    return out["rfu_by_cohort"]
