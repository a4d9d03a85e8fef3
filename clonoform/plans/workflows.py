"""End-to-end workflows: compositions of the operators that write one Parquet table each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.functions import scalars as S
from clonoform.functions.grouped import row_name, row_numbers
from clonoform.operators import adapters, assign, canonical, metrics, phenotype, quality, samples
from clonoform.sources import tables as io
from clonoform.sources.staging import stage


def write_tables(tables: dict[str, DataFrame], out: str, force: bool = False) -> dict[str, DataFrame]:
    """Write each table below ``out``; existing ones raise unless ``force``. Read back."""
    for name, df in tables.items():
        df.write.mode("overwrite" if force else "errorifexists").parquet(f"{out}/{name}")
    spark = next(iter(tables.values())).sparkSession
    return {name: spark.read.parquet(f"{out}/{name}") for name in tables}


def downstream_analysis(rows: DataFrame, metadata: DataFrame, out: str, *, sample: str, phenotype_key: str, order_by: str, force: bool = False) -> dict[str, DataFrame]:
    """Per-row results and cell metadata to repertoire and RFU metrics, pseudobulk counts and
    CLR, two overlaps and the phenotype coupling."""
    joined = stage(quality.metadata_join(rows, metadata), "downstream-rows")  # all tables read it
    if joined.where(F.col(sample).isNull()).limit(1).count():
        raise ValueError(f"requested labels are missing for some rows: {[sample]}")
    counts = samples.pseudobulk(joined, sample=sample, phenotypes=[phenotype_key])
    clr = samples.pseudobulk(joined, sample=sample, normalize="clr", check=False)
    tables = {
        "repertoire_metrics": metrics.repertoire_metrics(joined, groupby=sample, weighting="cell", order_by=order_by),
        "rfu_metrics": metrics.rfu_metrics(joined, groupby=phenotype_key, weighting="cell", order_by=order_by, sample=sample),
        "pseudobulk_counts": counts.matrix,
        "pseudobulk_clr": clr.matrix,
        "sample_metadata": counts.sample_metadata,
        "sample_qc": counts.qc,
        "rfu_metadata": counts.rfu_metadata,
        "phenotype_coupling": phenotype.phenotype_coupling(joined, phenotype=phenotype_key, sample=sample),
    }
    written = write_tables(tables, out, force)
    pairs = {f"overlap_{m}": samples.overlap(written["pseudobulk_counts"], written["sample_metadata"], sample=sample, metric=m) for m in ("jaccard", "cosine")}
    return written | write_tables(pairs, out, force)


def offline_tables(receptors: DataFrame, order_by: str) -> assign.RfuTables:
    """Query ids and statuses without any assignment: eligible rows are ``skipped_backend``."""
    queries = stage(assign.counted_queries(receptors, order_by), "offline-queries")
    rows = receptors.withColumn("eligibility_status", S.eligibility(F.col("cdr3aa"))).join(queries.select("cdr3aa", "unique_sequence_id"), "cdr3aa", "left")
    status = F.when(F.col("cdr3aa").isNull(), "missing_sequence").when(F.col("eligibility_status") == "eligible", "skipped_backend").otherwise("ineligible_sequence")
    rows = rows.withColumn("reference_coverage_status", status).withColumn("assignment_status", status)
    sequences = queries.select("unique_sequence_id", "cdr3aa", F.col("v_call").alias("query_v_call"), "multiplicity")
    return assign.RfuTables(sequences, rows, rows.select(*[c for c in assign.MAPPING if c in rows.columns]))


def receptor_workflow(source: DataFrame, adapter: str, out: str, *, order_by: str, scorers: list | None = None, threshold: float = 0.6, groupby: Sequence[str] = (), metadata: DataFrame | None = None, force: bool = False, **options) -> dict[str, DataFrame]:
    """Source rows through an adapter to receptors, the sequence map, per-sequence and per-row
    results and, with assignments and groups, RFU metrics. Without scorers it is offline."""
    made = adapters.prepare_receptors(source, adapter, order_by=order_by, chain="TRB", **options)
    canonical.validate_receptors(made.receptors, strict=True)
    receptors = write_tables({"receptors": made.receptors}, out, force)
    own = receptors["receptors"].withColumn("source_order", F.substring("input_row_id", 5, 20).cast("long"))
    out_tables = offline_tables(own, "source_order") if scorers is None else assign.call_rfus(own, scorers, threshold=threshold)
    rows = out_tables.per_row if metadata is None else quality.metadata_join(out_tables.per_row, metadata)
    tables = {"sequence_map": out_tables.mapping, "per_sequence": out_tables.per_sequence, "per_row": rows, "qc": made.qc}
    if scorers is not None and groupby:
        tables["rfu_metrics"] = metrics.rfu_metrics(rows, groupby=groupby, weighting="cell", order_by="source_order")
    return receptors | write_tables(tables, out, force)


def atlas_workflow(wide: DataFrame, out: str, *, scorers: list, order_by: str, columns: Sequence[str] = (), primary: bool = True, max_cells: int | None = None, threshold: float = 0.6, force: bool = False) -> dict[str, DataFrame]:
    """A wide single-cell table to features, receptors, the sequence map, per-sequence and
    per-row results, with the adapter's report and the wanted cell ``columns``.

    Only the slot columns, ``columns`` and the numeric source order are read. ``max_cells``
    takes the first cells in that order, for a trial run. Rows are numbered slot by slot in
    source order. Nothing to extract raises.
    """
    if max_cells is not None and max_cells <= 0:
        raise ValueError("max_cells must be positive")
    slots = [c for c in wide.columns if "ir_vdj_" in c.lower()]
    own = stage(io.select_rows(wide, key="cell_id", columns=[*slots, *[c for c in columns if c not in slots]], max_rows=max_cells, order_by=order_by), "atlas-cells")
    made = adapters.adapt_wells(own, order_by=order_by, chain="TRB", primary=primary)
    place = F.col("source_order").cast("long") + (F.col("slot_order") - 1).cast("long") * (1 << 61)
    numbered = row_numbers(made.receptors.withColumn("__place", place), "__place").withColumn("input_row_id", row_name("row_"))
    rows = numbered.withColumn("source_order", F.col("__row")).drop("__place", "__row", "slot_order")
    if rows.isEmpty():
        raise ValueError("the wide table has no productive TRB rows")
    found = assign.call_rfus(rows, scorers, threshold=threshold)
    tables = {
        "extracted": rows.select("cell_id", "cdr3aa", F.col("v_call").alias("trbv"), F.col("source_slot").alias("chain_slot")),
        "receptors": rows.drop("source_order"),
        "cells": own.select(*dict.fromkeys(["cell_id", *columns])),
        "adapter_qc": made.qc,
        "sequence_map": found.mapping,
        "per_sequence": found.per_sequence,
        "per_row": found.per_row,
    }
    return write_tables(tables, out, force)


def attached_summary(airr: DataFrame, cells: DataFrame, results: DataFrame, out: str, *, order_by: str, groupby: str, force: bool = False) -> dict[str, DataFrame]:
    """Features of an AIRR-like table with results made elsewhere: the cells with what is
    attached to them, the global and the grouped summary and the group x RFU table, which is
    written as delimited text too."""
    results = stage(results, "attached-results")
    written = write_tables({"features": adapters.extract_features(airr, order_by=order_by)}, out, force)
    written |= write_tables({"attached": quality.attach_results(cells, written["features"], results)}, out, force)
    attached = written["attached"]
    tables = {
        "rfu_summary": metrics.rfu_summary(attached),
        f"rfu_summary_by_{groupby}": metrics.rfu_summary(attached, groupby),
        f"rfu_by_{groupby}": metrics.aggregate_rfu(attached, groupby),
    }
    written |= write_tables(tables, out, force)
    io.export_matrix(written[f"rfu_by_{groupby}"], f"{out}/rfu_matrix", row=groupby, sep="\t")
    return written


def dataset_report(airr: DataFrame, cells: DataFrame, assigned: DataFrame, out: str, *, group: str, cell_type: str | None = None, force: bool = False) -> dict[str, DataFrame]:
    """AIRR check, global and grouped summaries and RFU tables of a dataset."""
    tables = {
        "airr_qc": quality.validate_airr(airr, cells),
        "rfu_summary": metrics.rfu_summary(assigned),
        f"rfu_summary_by_{group}": metrics.rfu_summary(assigned, group),
        f"rfu_by_{group}": metrics.aggregate_rfu(assigned, group),
    }
    if cell_type:
        tables[f"rfu_by_{cell_type}"] = metrics.aggregate_rfu(assigned, cell_type)
    return write_tables(tables, out, force)


#: Aliases of the two-file preparation; names are compared without punctuation.
PREPARED = {
    "cell_id": ("cell_id", "cell", "barcode", "cellid"),
    "chain": ("chain", "locus"),
    "cdr3aa": ("cdr3aa", "junction_aa", "cdr3_aa", "cdr3"),
    "v_call": ("v_call", "v_gene", "trbv", "v"),
    "productive": ("productive",),
}


def prepare_two_files(spark: SparkSession, receptors_path: str, metadata_path: str, **overrides: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(representative AIRR row of each cell, cell metadata, report) from two delimited files.
    ``overrides`` name a receptor column outright. The file order is the source order; the
    files of a folder follow each other in the natural order of their names."""
    squeeze = lambda name: "".join(c for c in name.lower() if c.isalnum())
    tcr, meta = io.read_delimited(spark, receptors_path), io.read_delimited(spark, metadata_path)

    def find(df: DataFrame, target: str) -> str | None:
        if target in overrides:
            return overrides[target]
        own = {squeeze(c): c for c in df.columns}
        return next((own[squeeze(a)] for a in PREPARED[target] if squeeze(a) in own), None)

    found = {t: find(tcr, t) for t in PREPARED}
    missing = [t for t in ("cell_id", "chain", "cdr3aa", "v_call") if not found[t]]
    key = find(meta, "cell_id") if "cell_id" not in overrides else next((c for c in meta.columns if squeeze(c) in map(squeeze, PREPARED["cell_id"])), None)
    if missing or key is None:
        raise ValueError(f"columns not found: {missing or ['metadata cell_id']}")
    # Spark packs files by size: a row's place is its file, the block of the file, and its place
    # among the rows of the task that reads the block, which follow each other. So blocks are
    # counted and their names compared once a file; the rows needn't be sorted
    files = spark.read.format("binaryFile").load(receptors_path).select(F.col("_metadata.file_path").alias("__file"))
    order = row_numbers(files, [S.natural_key(F.col("__file")), F.col("__file")]).select("__file", F.col("__row").alias("__place"))
    place = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__in_task")]
    placed = tcr.select(*[(F.col(f"`{c}`") if c else F.lit(None).cast("string")).alias(t) for t, c in found.items()], *place)
    placed = stage(placed.join(F.broadcast(order), "__file").drop("__file"), "placed-rows")
    sizes = placed.groupBy("__place", "__block").agg(F.count(F.lit(1)).alias("__n"), F.min("__in_task").alias("__low"))
    # a row a block
    before = sizes.select("__place", "__block", (F.sum("__n").over(Window.orderBy("__place", "__block")) - F.col("__n") - F.col("__low")).alias("__before"))
    numbered = placed.join(F.broadcast(before), ["__place", "__block"])
    rows = numbered.select(*found, (F.col("__before") + F.col("__in_task")).alias("source_order"))
    cells = meta.withColumnRenamed(key, "cell_id")
    return adapters.representative_rows(rows, cells, "source_order"), cells, quality.prepare_report(rows, cells)
