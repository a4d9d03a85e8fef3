"""Queries over receptors: scalars, canonical rows, adapters, quality reports, assignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.functions import scalars as S
from clonoform.functions.grouped import row_name, row_numbers
from clonoform.operators import adapters, assign, canonical, quality, samples
from clonoform.plans.base import CANON, WITH_ASSIGNED, WITH_CONTIGS, V, assigned, cells, contigs, final, plain, query, sql_chain, sql_flag, sql_name, sql_natural, sql_text
from clonoform.sources import tables as io
from clonoform.sources.fixtures import centroid_reference, trimer_reference, view

#: Of the fixture reference, so that both outcomes occur.
THRESHOLD = 0.25


ROW_NAME = sql_name("row_", "row_number() OVER (ORDER BY source_order) - 1")


# --- scalars and canonical rows ---------------------------------------------------------------
@query("normalize_chain", final(f"{WITH_CONTIGS} SELECT chain, {sql_chain('chain')} AS chain_out, count(*) AS n FROM contigs GROUP BY chain", "chain chain_out n:i"))
def _(spark, sf_dir):
    return contigs(spark, sf_dir).groupBy("chain", S.normalize_chain(F.col("chain")).alias("chain_out")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_productive", final(f"{WITH_CONTIGS} SELECT productive, {sql_flag('productive')} AS productive_out, count(*) AS n FROM contigs GROUP BY productive", "productive productive_out n:i"))
def _(spark, sf_dir):
    return contigs(spark, sf_dir).groupBy("productive", S.normalize_productive(F.col("productive")).alias("productive_out")).agg(F.count(F.lit(1)).alias("n"))


@query("normalize_text", final(f"{WITH_CONTIGS} SELECT cdr3, {sql_text('cdr3')} AS cdr3_out, count(*) AS n FROM contigs GROUP BY cdr3", "cdr3 cdr3_out n:i"))
def _(spark, sf_dir):
    return contigs(spark, sf_dir).groupBy("cdr3", S.normalize_text(F.col("cdr3")).alias("cdr3_out")).agg(F.count(F.lit(1)).alias("n"))


@query("eligibility", final(f"{WITH_CONTIGS}, {CANON} SELECT CASE WHEN cdr3aa LIKE 'C%' THEN 'eligible' ELSE 'ineligible_cdr3_not_starting_c' END AS status, count(*) AS n, count(DISTINCT cdr3aa) AS n_sequences FROM canon GROUP BY 1", "status n:i n_sequences:i"))
def _(spark, sf_dir):
    rows = contigs(spark, sf_dir).select(S.normalize_text(F.col("cdr3")).alias("cdr3aa"))
    return rows.groupBy(S.eligibility(F.col("cdr3aa")).alias("status")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cdr3aa").alias("n_sequences"))


@query("natural_order", final(f"{WITH_ASSIGNED} SELECT rfu_label, row_number() OVER (ORDER BY {sql_natural('rfu_label')}) AS place FROM (SELECT DISTINCT rfu_label FROM assigned WHERE rfu_label IS NOT NULL) t", "rfu_label place:i"))
def _(spark, sf_dir):

    labels = assigned(spark, sf_dir).where("rfu_label is not null").select("rfu_label").distinct()
    return row_numbers(labels, [S.natural_key(F.col("rfu_label"))]).select("rfu_label", (F.col("__row") + 1).alias("place"))


def _aligned_sql() -> str:
    gap, n = "(16 - length(cdr3aa))", "length(cdr3aa)"
    left = f"CAST(floor({gap} / 2.0) AS INT)"
    centre = f"repeat('-', {left}) || cdr3aa || repeat('-', {gap} - {left})"
    ends = f"CASE WHEN cdr3aa LIKE 'C%' AND (cdr3aa LIKE '%F' OR cdr3aa LIKE '%W') THEN substr(cdr3aa, 1, {n} - 1) || repeat('-', {gap}) || substr(cdr3aa, {n}, 1) ELSE {centre} END"
    return final(f"{WITH_ASSIGNED} SELECT cdr3aa, cdr3aa || repeat('-', {gap}) AS on_left, repeat('-', {gap}) || cdr3aa AS on_right, {centre} AS centred, {ends} AS ends FROM (SELECT DISTINCT cdr3aa FROM assigned WHERE cdr3aa IS NOT NULL) t", "cdr3aa on_left on_right centred ends")


@query("align_cdr3", _aligned_sql())
def _(spark, sf_dir):
    own = assigned(spark, sf_dir).where("cdr3aa is not null").select("cdr3aa").distinct()
    modes = {"on_left": "left", "on_right": "right", "centred": "center", "ends": "conserved_ends"}
    return own.select("cdr3aa", *[S.align(F.col("cdr3aa"), F.lit(16), m).alias(k) for k, m in modes.items()])


def canonical_contigs(spark, sf_dir) -> DataFrame:
    names = [F.col("barcode").alias("cell_id"), "chain", F.col("cdr3").alias("cdr3aa"), F.col("v_gene").alias("v_call"), "productive", "source_order"]
    return canonical.canonicalize(contigs(spark, sf_dir).select(*names), "fixture", "source_order")


@query("canonical_receptors", final(f"{WITH_CONTIGS}, {CANON} SELECT {ROW_NAME} AS input_row_id, cell_id, chain, cdr3aa, v_call, productive, CAST(source_order AS VARCHAR) AS source_row_id FROM canon", "input_row_id cell_id chain cdr3aa v_call productive source_row_id"))
def _(spark, sf_dir):
    return canonical_contigs(spark, sf_dir).select("input_row_id", "cell_id", "chain", "cdr3aa", "v_call", "productive", "source_row_id")


@query(
    "validate_receptors",
    final(
        f"""{WITH_CONTIGS}, {CANON} SELECT count(*) AS row_count, count(DISTINCT cell_id) AS unique_cell_count, count(*) FILTER (WHERE cdr3aa IS NULL) AS missing_cdr3aa_count,
 count(DISTINCT chain) AS chain_count, count(*) FILTER (WHERE productive) AS productive_true, count(*) FILTER (WHERE NOT productive) AS productive_false,
 CASE WHEN count(*) FILTER (WHERE cdr3aa IS NULL) > 0 THEN 1 ELSE 0 END AS error_count, 'TRA,TRB' AS recognized_chains, 'error' AS status FROM canon""",
        "row_count:i unique_cell_count:i missing_cdr3aa_count:i productive_true:i productive_false:i error_count:i recognized_chains status",
    ),
)
def _(spark, sf_dir):
    return canonical.validate_receptors(canonical_contigs(spark, sf_dir), strict=False).select("row_count", "unique_cell_count", "missing_cdr3aa_count", "productive_true", "productive_false", "error_count", "recognized_chains", "status")


# --- adapters -------------------------------------------------------------------------------------
RANKED = "row_number() OVER (PARTITION BY cell_id ORDER BY {} source_order) AS best"
CHOSEN = f"""kept AS (SELECT * FROM canon WHERE cell_id IS NOT NULL AND chain IS NOT NULL AND cdr3aa IS NOT NULL AND is_cell AND high_confidence),
 chosen AS (SELECT *, {RANKED.format("umis DESC, reads DESC,")} FROM kept WHERE chain = 'TRB' AND productive)"""
CELLRANGER = f"{WITH_CONTIGS}, {CANON}, {CHOSEN}"


def cellranger(spark, sf_dir, **options) -> adapters.AdapterResult:
    return adapters.adapt_cellranger(contigs(spark, sf_dir), order_by="source_order", chain="TRB", **options)


CELLRANGER_ROWS = f"{CELLRANGER} SELECT {ROW_NAME} AS input_row_id, cell_id, chain, cdr3aa, v_call, productive, CAST(source_order AS VARCHAR) AS source_row_id, umis AS umi_count, reads AS read_count, raw_clonotype_id AS clonotype_id FROM chosen WHERE best = 1"
RECEPTOR_COLUMNS = ["input_row_id", "cell_id", "chain", "cdr3aa", "v_call", "productive", "source_row_id", "umi_count", "read_count", "clonotype_id"]


@query("cellranger_adapter", final(CELLRANGER_ROWS, "input_row_id cell_id chain cdr3aa v_call productive source_row_id umi_count:i read_count:i clonotype_id"))
def _(spark, sf_dir):
    return cellranger(spark, sf_dir).receptors.select(*RECEPTOR_COLUMNS)


@query("cellranger_primary_chain", final(f"{CELLRANGER} SELECT cell_id, cdr3aa, umis, source_order FROM chosen WHERE best = 1", "cell_id cdr3aa umis:i source_order:i"))
def _(spark, sf_dir):
    rows = canonical_contigs(spark, sf_dir).drop("input_row_id").join(contigs(spark, sf_dir).select("source_order", "umis", "reads", "is_cell", "high_confidence"), "source_order")
    ok = S.normalize_productive(F.col("is_cell")) & S.normalize_productive(F.col("high_confidence")) & F.col("productive") & (F.col("chain") == "TRB") & F.col("cdr3aa").isNotNull()
    return adapters.primary_chain(rows.where(ok), [S.numeric_rank(F.col("umis")), S.numeric_rank(F.col("reads"))]).select("cell_id", "cdr3aa", "umis", "source_order")


@query("cellranger_contigs", final(f"{WITH_CONTIGS}, {CANON} SELECT cell_id, chain, cdr3aa, v_call, productive, is_cell, high_confidence, umis AS umi_count, reads AS read_count FROM canon", "cell_id chain cdr3aa v_call productive is_cell high_confidence umi_count:i read_count:i"))
def _(spark, sf_dir):
    rows = contigs(spark, sf_dir)
    picked = canonical.pick_columns(rows, {t: (s,) for s, t in adapters.CELLRANGER_NAMES.items()})
    named = rows.select(*[F.col(c).alias(t) for t, c in picked.items() if c], "productive", "is_cell", "high_confidence", "source_order", F.lit("").alias("input_row_id"))
    out = canonical.canonicalize(named, "cellranger_vdj", "source_order")
    flags = [S.normalize_productive(F.col(c)).alias(c) for c in ("is_cell", "high_confidence")]
    return out.select("cell_id", "chain", "cdr3aa", "v_call", "productive", *flags, "umi_count", "read_count")


@query(
    "cellranger_qc",
    final(
        f"""{CELLRANGER} SELECT (SELECT count(*) FROM canon) AS source_row_count, (SELECT count(*) FROM canon WHERE cell_id IS NOT NULL AND chain IS NOT NULL AND cdr3aa IS NOT NULL) AS rows_after_required_value_filter,
 (SELECT count(*) FROM canon WHERE cell_id IS NOT NULL AND chain IS NOT NULL AND cdr3aa IS NOT NULL AND is_cell) AS rows_after_is_cell_filter, (SELECT count(*) FROM kept) AS rows_after_high_confidence_filter,
 (SELECT count(*) FROM chosen) AS rows_before_primary_selection, count(*) AS selected_receptor_row_count, count(DISTINCT cell_id) AS selected_cell_count, count(*) FILTER (WHERE productive) AS productive_row_count FROM chosen WHERE best = 1""",
        "source_row_count:i rows_after_required_value_filter:i rows_after_is_cell_filter:i rows_after_high_confidence_filter:i rows_before_primary_selection:i selected_receptor_row_count:i selected_cell_count:i productive_row_count:i",
    ),
)
def _(spark, sf_dir):
    return cellranger(spark, sf_dir).qc


@query("cellranger_metadata", final(f"{WITH_CONTIGS} SELECT barcode AS cell_id, min(source_order // 100) AS order_number FROM contigs GROUP BY barcode", "cell_id order_number:i"))
def _(spark, sf_dir):
    rows = contigs(spark, sf_dir).select(F.col("barcode").alias("cell_id"), F.floor(F.col("source_order") / 100).alias("order_number"))
    return adapters.metadata_from_rows(rows, ["order_number"])


AIRR = f"{WITH_CONTIGS}, {CANON}, chosen AS (SELECT *, {RANKED.format('umis DESC, reads DESC,')} FROM canon WHERE chain = 'TRB' AND productive)"


def airr(spark, sf_dir, **options) -> adapters.AdapterResult:
    return adapters.adapt_airr(contigs(spark, sf_dir).drop("raw_clonotype_id"), order_by="source_order", chain="TRB", **options)


@query("airr_adapter", final(f"{AIRR} SELECT {ROW_NAME} AS input_row_id, cell_id, chain, cdr3aa, v_call, productive, umis AS umi_count, reads AS read_count FROM chosen WHERE best = 1", "input_row_id cell_id chain cdr3aa v_call productive umi_count:i read_count:i"))
def _(spark, sf_dir):
    return airr(spark, sf_dir).receptors.select("input_row_id", "cell_id", "chain", "cdr3aa", "v_call", "productive", "umi_count", "read_count")


@query("airr_primary_chain", final(f"{WITH_CONTIGS}, {CANON} SELECT cell_id, cdr3aa, productive, source_order FROM (SELECT *, {RANKED.format('CAST(coalesce(productive, false) AS INT) DESC, umis DESC, reads DESC,')} FROM canon) t WHERE best = 1", "cell_id cdr3aa productive source_order:i"))
def _(spark, sf_dir):
    rows = canonical_contigs(spark, sf_dir).join(contigs(spark, sf_dir).select("source_order", "umis", "reads"), "source_order")
    ranks = [F.coalesce("productive", F.lit(False)).cast("int"), S.numeric_rank(F.col("umis")), S.numeric_rank(F.col("reads"))]
    return adapters.primary_chain(rows, ranks).select("cell_id", "cdr3aa", "productive", "source_order")


@query("airr_qc", final(f"{AIRR} SELECT (SELECT count(*) FROM canon) AS source_row_count, (SELECT count(*) FROM chosen) AS rows_before_primary_selection, count(*) AS selected_receptor_row_count, count(DISTINCT cell_id) AS selected_cell_count, count(*) FILTER (WHERE productive) AS productive_row_count FROM chosen WHERE best = 1", "source_row_count:i rows_before_primary_selection:i selected_receptor_row_count:i selected_cell_count:i productive_row_count:i"))
def _(spark, sf_dir):
    return airr(spark, sf_dir).qc


@query("extract_trb", final(f"{AIRR} SELECT cell_id, cdr3aa, v_call AS trbv FROM chosen WHERE best = 1", "cell_id cdr3aa trbv"))
def _(spark, sf_dir):
    return adapters.extract_features(contigs(spark, sf_dir), order_by="source_order")


@query("prepare_receptors", final(f"{CELLRANGER} SELECT chain, count(*) AS n_rows FROM chosen WHERE best = 1 GROUP BY chain", "chain n_rows:i"))
def _(spark, sf_dir):
    return adapters.chain_counts(adapters.prepare_receptors(contigs(spark, sf_dir), "cellranger", order_by="source_order", chain="TRB").receptors)


WIDE = V("wells_wide", "contigs")
SLOTS = "slots AS (" + " UNION ALL ".join(
    f"SELECT cell_id, {sql_chain(f'ir_vdj_{s}_locus')} AS chain, {sql_text(f'ir_vdj_{s}_junction_aa')} AS cdr3aa, {sql_text(f'ir_vdj_{s}_v_call')} AS v_call, {sql_flag(f'ir_vdj_{s}_productive')} AS productive, ir_vdj_{s}_duplicate_count AS dup, ir_vdj_{s}_consensus_count AS con, {s} AS slot_order, 'VDJ_{s}' AS source_slot FROM wells_wide WHERE {sql_text(f'ir_vdj_{s}_junction_aa')} IS NOT NULL AND ir_vdj_{s}_v_call IS NOT NULL"
    for s in (1, 2)
) + ")"
WELLS = f"{WIDE}, {SLOTS}, chosen AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dup DESC NULLS LAST, con DESC NULLS LAST, slot_order) AS best FROM slots WHERE chain = 'TRB' AND productive)"


def wide(spark, sf_dir) -> DataFrame:
    return view(spark, sf_dir, "wells_wide")


@query("wells_unpivot", final(f"{WIDE}, {SLOTS} SELECT * FROM slots", "cell_id chain cdr3aa v_call productive source_slot"))
def _(spark, sf_dir):
    return adapters.unpivot_slots(wide(spark, sf_dir)).select("cell_id", S.normalize_chain(F.col("chain")).alias("chain"), "cdr3aa", "v_call", "productive", "source_slot")


@query("wells_primary_chain", final(f"{WELLS} SELECT cell_id, source_slot FROM chosen WHERE best = 1", "cell_id source_slot"))
def _(spark, sf_dir):
    return adapters.adapt_wells(wide(spark, sf_dir)).receptors.select("cell_id", "source_slot")


@query("wells_adapter", final(f"{WELLS} SELECT cell_id, chain, cdr3aa, v_call, productive, source_slot, CAST(dup AS VARCHAR) AS duplicate_count FROM chosen WHERE best = 1", "cell_id chain cdr3aa v_call productive source_slot duplicate_count"))
def _(spark, sf_dir):
    return adapters.adapt_wells(wide(spark, sf_dir)).receptors.select("cell_id", "chain", "cdr3aa", "v_call", "productive", "source_slot", "duplicate_count")


@query("wells_qc", final(f"{WELLS} SELECT (SELECT count(*) FROM wells_wide) AS source_row_count, (SELECT count(*) FROM chosen) AS rows_before_primary_selection, count(*) AS selected_receptor_row_count, count(DISTINCT cell_id) AS selected_cell_count, count(*) FILTER (WHERE productive) AS productive_row_count, count(*) FILTER (WHERE cdr3aa NOT LIKE 'C%') AS non_c_rows FROM chosen WHERE best = 1", "source_row_count:i rows_before_primary_selection:i selected_receptor_row_count:i selected_cell_count:i productive_row_count:i non_c_rows:i"))
def _(spark, sf_dir):
    return adapters.adapt_wells(wide(spark, sf_dir)).qc


@query("extract_wells", final(f"{V('wells_wide', 'contigs', 'cells')} SELECT cell_id, {sql_text('ir_vdj_1_junction_aa')} AS cdr3aa, {sql_text('ir_vdj_1_v_call')} AS trbv FROM wells_wide WHERE upper(ir_vdj_1_locus) = 'TRB' AND lower(ir_vdj_1_productive) IN ('true', 't', '1', 'yes') AND {sql_text('ir_vdj_1_junction_aa')} IS NOT NULL AND cell_id IN (SELECT cell_id FROM cells)", "cell_id cdr3aa trbv"))
def _(spark, sf_dir):
    return adapters.extract_wide_features(wide(spark, sf_dir), cells(spark, sf_dir))


@query("unknown_barcodes", final(f"{V('contigs', 'cells')} SELECT DISTINCT barcode AS cell_id FROM contigs WHERE barcode NOT IN (SELECT cell_id FROM cells WHERE cohort = 'A')", "cell_id"))
def _(spark, sf_dir):
    return adapters.unknown_barcodes(contigs(spark, sf_dir).select(F.col("barcode").alias("cell_id")), cells(spark, sf_dir).where("cohort = 'A'"))


@query("representative_airr", final(f"{V('contigs', 'cells')} SELECT m.cell_id, coalesce(t.chain, '') AS chain, coalesce(t.cdr3, '') AS cdr3aa, coalesce(t.v_gene, '') AS v_call, coalesce(lower(t.productive) IN ('true', 't', '1', 'yes', 'productive'), false) AS productive FROM cells m LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY barcode ORDER BY CAST(upper(chain) = 'TRB' AS INT) DESC, CAST(lower(productive) IN ('true', 't', '1', 'yes', 'productive') AS INT) DESC, source_order) AS best FROM contigs) t ON t.barcode = m.cell_id AND t.best = 1", "cell_id chain cdr3aa v_call productive"))
def _(spark, sf_dir):
    rows = contigs(spark, sf_dir).select(F.col("barcode").alias("cell_id"), "chain", F.col("cdr3").alias("cdr3aa"), F.col("v_gene").alias("v_call"), "productive", "source_order")
    return adapters.representative_rows(rows, cells(spark, sf_dir), "source_order")


# --- quality ------------------------------------------------------------------------------------
@query("validate_airr", final(f"""{V('contigs', 'cells')} SELECT 'airr' AS airr_key, 'TRB' AS chain, (SELECT count(*) FROM cells) AS n_obs_cells, count(*) AS n_airr_rows, count(DISTINCT barcode) AS n_airr_cells,
 count(DISTINCT barcode) FILTER (WHERE barcode IN (SELECT cell_id FROM cells)) AS n_overlap_cells, count(DISTINCT barcode) FILTER (WHERE barcode IN (SELECT cell_id FROM cells)) * 1.0 / count(DISTINCT barcode) AS barcode_overlap_rate,
 true AS has_cell_id_col, true AS has_chain_col, true AS has_cdr3_col, true AS has_v_col, true AS has_productive_col, count(*) FILTER (WHERE upper(chain) = 'TRB') AS n_chain_rows,
 count(*) FILTER (WHERE upper(chain) = 'TRB' AND lower(productive) IN ('true', 't', '1', 'yes')) AS n_productive_chain_rows, 'ok' AS status FROM contigs""", "airr_key chain n_obs_cells:i n_airr_rows:i n_airr_cells:i n_overlap_cells:i barcode_overlap_rate:d has_cell_id_col has_chain_col has_cdr3_col has_v_col has_productive_col n_chain_rows:i n_productive_chain_rows:i status"))
def _(spark, sf_dir):
    return quality.validate_airr(contigs(spark, sf_dir), cells(spark, sf_dir))


@query("metadata_join", final(f"{V('contigs', 'cells')} SELECT sample_id, cell_type, count(*) AS n_rows, count(DISTINCT barcode) AS n_cells FROM contigs LEFT JOIN cells ON barcode = cell_id GROUP BY ALL", "sample_id cell_type n_rows:i n_cells:i"))
def _(spark, sf_dir):
    rows = quality.metadata_join(contigs(spark, sf_dir).withColumnRenamed("barcode", "cell_id"), cells(spark, sf_dir))
    return rows.groupBy("sample_id", "cell_type").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cell_id").alias("n_cells"))


@query("join_qc", final(f"{V('contigs', 'cells')}, a AS (SELECT DISTINCT barcode AS c FROM contigs), b AS (SELECT DISTINCT cell_id AS c FROM cells) SELECT (SELECT count(*) FROM a) AS n_row_cells, (SELECT count(*) FROM b) AS n_metadata_cells, (SELECT count(*) FROM a JOIN b USING (c)) AS n_overlap_cells, (SELECT count(*) FROM a ANTI JOIN b USING (c)) AS n_rows_only, (SELECT count(*) FROM b ANTI JOIN a USING (c)) AS n_metadata_only", "n_row_cells:i n_metadata_cells:i n_overlap_cells:i n_rows_only:i n_metadata_only:i"))
def _(spark, sf_dir):
    return quality.join_qc(contigs(spark, sf_dir).withColumnRenamed("barcode", "cell_id"), cells(spark, sf_dir))


@query("prepare_report", final(f"{V('contigs', 'cells')} SELECT (SELECT count(*) FROM cells) AS n_metadata_rows, count(*) AS n_tcr_rows, count(DISTINCT barcode) AS n_cells_with_tcr, count(DISTINCT barcode) FILTER (WHERE barcode IN (SELECT cell_id FROM cells)) AS n_overlap_cells, count(*) FILTER (WHERE upper(chain) = 'TRB' AND lower(productive) IN ('true', 't', '1', 'yes', 'productive')) AS n_productive_trb_rows, count(DISTINCT barcode) FILTER (WHERE barcode IN (SELECT cell_id FROM cells)) * 1.0 / count(DISTINCT barcode) AS barcode_overlap_rate FROM contigs", "n_metadata_rows:i n_tcr_rows:i n_cells_with_tcr:i n_overlap_cells:i n_productive_trb_rows:i barcode_overlap_rate:d"))
def _(spark, sf_dir):
    return quality.prepare_report(contigs(spark, sf_dir).withColumnRenamed("barcode", "cell_id"), cells(spark, sf_dir))


FIRST_ROW = "(SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY source_order) AS k FROM assigned)"


@query("attach_results", final(f"{WITH_ASSIGNED}, f AS (SELECT * FROM {FIRST_ROW} t WHERE k = 1) SELECT m.cell_id, f.cdr3aa AS trb_cdr3aa, f.v_call AS trbv, f.rfu_label, f.rfu_score FROM cells m LEFT JOIN f ON m.cell_id = f.cell_id", "cell_id trb_cdr3aa trbv rfu_label rfu_score:d"))
def _(spark, sf_dir):
    best = adapters.primary_chain(assigned(spark, sf_dir), [])
    features = best.select("cell_id", "cdr3aa", "v_call")
    results = best.select("cell_id", F.col("rfu_label").alias("label"), F.col("rfu_score").cast("string").alias("score"))
    return quality.attach_results(cells(spark, sf_dir).select("cell_id"), features, results)


@query("selective_read", final(f"{V('cells')} SELECT cell_id, sample_id, ordinal FROM cells JOIN (SELECT cell_id AS c, row_number() OVER (ORDER BY cell_id) AS ordinal FROM cells WHERE cell_type = '1-URGENT') w ON c = cell_id", "cell_id sample_id ordinal:i"))
def _(spark, sf_dir):

    own = cells(spark, sf_dir)
    wanted = row_numbers(own.where("cell_type = '1-URGENT'").select("cell_id"), [F.col("cell_id")]).select("cell_id", (F.col("__row") + 1).alias("ordinal"))
    return io.select_rows(own, key="cell_id", columns=["sample_id"], selected=wanted)


@query("cache_manifest", final(f"{CELLRANGER} SELECT count(*) AS receptor_row_count, count(DISTINCT cell_id) AS receptor_cell_count, count(DISTINCT chain) AS chain_count, count(*) FILTER (WHERE productive) AS productive_row_count, count(DISTINCT cell_id) AS metadata_row_count FROM chosen WHERE best = 1", "receptor_row_count:i receptor_cell_count:i chain_count:i productive_row_count:i metadata_row_count:i"))
def _(spark, sf_dir):
    out = cellranger(spark, sf_dir)
    return io.cache_manifest(out.receptors, out.cell_metadata)


# --- assignment -----------------------------------------------------------------------------------
TRB_ROWS = f"""{WITH_CONTIGS}, {CANON}, trb AS (SELECT * FROM canon WHERE chain = 'TRB'),
 uniq AS (SELECT cdr3aa, arg_min(v_call, source_order) AS v_call, min(source_order) AS first_order FROM trb WHERE cdr3aa LIKE 'C%' GROUP BY cdr3aa),
 named AS (SELECT *, {sql_name('sequence_', 'row_number() OVER (ORDER BY first_order) - 1')} AS unique_sequence_id FROM uniq)"""
LETTER = "(instr('ACDEFGHIKLMNPQRSTVWY', substr(tri, {}, 1)) - 1)"
SCORES = f"""{TRB_ROWS}, tris AS (SELECT cdr3aa, substr(cdr3aa, CAST(i + 2 AS INT), 3) AS tri FROM (SELECT cdr3aa, unnest(range(1, length(cdr3aa) - 7)) AS i FROM named) t),
 codes AS (SELECT cdr3aa, {LETTER.format(1)} * 400 + {LETTER.format(2)} * 20 + {LETTER.format(3)} AS code FROM tris),
 dims AS (SELECT cdr3aa, d, avg(x) AS x FROM (SELECT cdr3aa, unnest(range(1, 65)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM codes JOIN embeddings ON vec_id = code % (SELECT count(*) FROM embeddings) WHERE code % 3 <> 0) t GROUP BY cdr3aa, d),
 qr AS (SELECT cdr3aa, d, rank() OVER (PARTITION BY cdr3aa ORDER BY x) + (count(*) OVER (PARTITION BY cdr3aa, x) - 1) / 2.0 AS r FROM dims),
 cents AS (SELECT CAST(vec_id + 1 AS INT) AS rfu_id, unnest(range(1, 65)) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
 cr AS (SELECT rfu_id, d, rank() OVER (PARTITION BY rfu_id ORDER BY x) + (count(*) OVER (PARTITION BY rfu_id, x) - 1) / 2.0 AS r FROM cents),
 rho AS (SELECT cdr3aa, rfu_id, round(corr(qr.r, cr.r), 9) AS rho FROM qr JOIN cr USING (d) GROUP BY cdr3aa, rfu_id),
 top AS (SELECT cdr3aa, rfu_id, rho AS rfu_score FROM (SELECT *, row_number() OVER (PARTITION BY cdr3aa ORDER BY rho DESC, rfu_id) AS k FROM rho WHERE rho IS NOT NULL AND NOT isnan(rho)) t WHERE k = 1),
 scored AS (SELECT named.*, rfu_id, 'RFU' || CAST(rfu_id AS VARCHAR) AS rfu_label, rfu_score, rfu_score >= {THRESHOLD} AS pass_thr FROM named LEFT JOIN top USING (cdr3aa)),
 per_row AS (SELECT trb.*, s.unique_sequence_id, s.rfu_id, s.rfu_label, s.rfu_score, s.pass_thr, CASE WHEN trb.cdr3aa LIKE 'C%' THEN 'eligible' ELSE 'ineligible_cdr3_not_starting_c' END AS eligibility_status,
  CASE WHEN trb.cdr3aa IS NULL THEN 'missing_sequence' WHEN trb.cdr3aa NOT LIKE 'C%' THEN 'ineligible_sequence' WHEN rfu_id IS NULL THEN 'upstream_unassigned' WHEN coalesce(pass_thr, false) THEN 'covered' ELSE 'below_threshold' END AS reference_coverage_status,
  CASE WHEN trb.cdr3aa IS NULL OR trb.cdr3aa NOT LIKE 'C%' THEN 'ineligible_cdr3_not_starting_c' WHEN rfu_id IS NULL THEN 'upstream_unassigned' WHEN coalesce(pass_thr, false) THEN 'assigned_threshold_pass' ELSE 'assigned_below_threshold' END AS rfu_status
  FROM trb LEFT JOIN scored s ON trb.cdr3aa = s.cdr3aa)"""
STATUS = "CASE reference_coverage_status WHEN 'covered' THEN 'nearest_threshold_qualified' WHEN 'below_threshold' THEN 'nearest_below_threshold' ELSE reference_coverage_status END"


#: Rows with the same source order, or without one, are numbered by their other values.
ID_ORDER = ("source_order", "barcode", "chain", "cdr3", "v_gene", "productive")
ROW_ID = sql_name("row_", f"row_number() OVER (ORDER BY {', '.join(f'contigs.{c} NULLS FIRST' for c in ID_ORDER)}) - 1")
#: ``SCORES`` with the row ids of the whole canonical table.
ID_SCORES = SCORES.replace(CANON, CANON.replace("canon AS (SELECT ", f"canon AS (SELECT {ROW_ID} AS input_row_id, "))


def trb(spark, sf_dir, numbered: bool = False) -> DataFrame:
    """Canonical rows of chain TRB. ``numbered``: with their ids in the table of all chains, for
    which all rows are sorted and written once; else without ids."""
    rows = contigs(spark, sf_dir).select(*ID_ORDER)
    if numbered:
        rows = row_numbers(rows, [F.col(c) for c in ID_ORDER]).withColumn("input_row_id", row_name("row_")).drop("__row")
    else:
        rows = rows.withColumn("input_row_id", F.lit(None).cast("string"))
    named = rows.withColumnsRenamed({"barcode": "cell_id", "cdr3": "cdr3aa", "v_gene": "v_call"})
    own = canonical.canonicalize(named, "fixture", "source_order").where("chain = 'TRB'")
    return own if numbered else own.drop("input_row_id")


def scorers(spark, sf_dir) -> list:
    return assign.spearman_scorers(trimer_reference(spark, sf_dir), centroid_reference(spark, sf_dir))


def rfu_tables(spark, sf_dir, numbered: bool = False) -> assign.RfuTables:
    return assign.call_rfus(trb(spark, sf_dir, numbered), scorers(spark, sf_dir), threshold=THRESHOLD)


@query("unique_queries", final(f"{TRB_ROWS} SELECT unique_sequence_id, cdr3aa, v_call FROM named", "unique_sequence_id cdr3aa v_call"))
def _(spark, sf_dir):
    return assign.unique_queries(trb(spark, sf_dir)).select("unique_sequence_id", "cdr3aa", "v_call")


@query("dedup_stats", final(f"{TRB_ROWS} SELECT count(*) AS original_rows, count(*) FILTER (WHERE cdr3aa LIKE 'C%') AS eligible_rows, count(DISTINCT cdr3aa) FILTER (WHERE cdr3aa LIKE 'C%') AS unique_queries, count(DISTINCT cdr3aa) FILTER (WHERE cdr3aa LIKE 'C%') * 1.0 / count(*) FILTER (WHERE cdr3aa LIKE 'C%') AS deduplication_ratio FROM trb", "original_rows:i eligible_rows:i unique_queries:i deduplication_ratio:d"))
def _(spark, sf_dir):
    return assign.dedup_stats(trb(spark, sf_dir))


@query("embed_sequences", final(f"{SCORES}, n AS (SELECT cdr3aa, count(*) AS n_trimers FROM codes WHERE code % 3 <> 0 GROUP BY cdr3aa) SELECT cdr3aa, n_trimers, sum(x) AS total, max(x) AS highest FROM dims JOIN n USING (cdr3aa) GROUP BY cdr3aa, n_trimers", "cdr3aa n_trimers:i total:d highest:d"))
def _(spark, sf_dir):
    out = assign.embed_sequences(assign.unique_queries(trb(spark, sf_dir)), trimer_reference(spark, sf_dir))
    return out.select("cdr3aa", "n_trimers", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x).alias("total"), F.array_max("vec").alias("highest"))


@query("assign_rfu", final(f"{SCORES} SELECT unique_sequence_id, cdr3aa, rfu_id, rfu_label, rfu_score, pass_thr FROM scored", "unique_sequence_id cdr3aa rfu_id:i rfu_label rfu_score:d pass_thr"))
def _(spark, sf_dir):
    queries = assign.unique_queries(trb(spark, sf_dir)).select("unique_sequence_id", "cdr3aa")
    return assign.assign(queries, scorers(spark, sf_dir), THRESHOLD).select("unique_sequence_id", "cdr3aa", "rfu_id", "rfu_label", "rfu_score", "pass_thr")


@query("incremental_assign", final(f"{SCORES} SELECT cdr3aa, rfu_id, rfu_score, pass_thr, length(cdr3aa) % 2 = 0 AS reused FROM scored", "cdr3aa rfu_id:i rfu_score:d pass_thr reused"))
def _(spark, sf_dir):
    queries, score = assign.unique_queries(trb(spark, sf_dir)).select("cdr3aa"), scorers(spark, sf_dir)
    old = assign.assign(queries.where("length(cdr3aa) % 2 = 0"), score, THRESHOLD).select(F.lit("r1").alias("reference_id"), "cdr3aa", "rfu_id", "rfu_score")
    other = old.select(F.lit("r0").alias("reference_id"), "cdr3aa", F.lit(0).alias("rfu_id"), F.lit(9.0).alias("rfu_score"))
    return assign.assign_incremental(queries, old.unionByName(other), score, "r1", THRESHOLD).select("cdr3aa", "rfu_id", "rfu_score", "pass_thr", "reused")


@query("reconstruct_rows", final(f"{SCORES} SELECT source_order, cell_id, cdr3aa, unique_sequence_id, rfu_id, rfu_score, pass_thr, rfu_status FROM per_row", "source_order:i cell_id cdr3aa unique_sequence_id rfu_id:i rfu_score:d pass_thr rfu_status"))
def _(spark, sf_dir):
    rows = trb(spark, sf_dir)
    done = assign.assign(assign.unique_queries(rows).select("unique_sequence_id", "cdr3aa"), scorers(spark, sf_dir), THRESHOLD)
    return assign.reconstruct(rows, done).select("source_order", "cell_id", "cdr3aa", "unique_sequence_id", "rfu_id", "rfu_score", "pass_thr", "rfu_status")


@query("assignment_status", final(f"{SCORES} SELECT rfu_status, reference_coverage_status, {STATUS} AS assignment_status, count(*) AS n FROM per_row GROUP BY ALL", "rfu_status reference_coverage_status assignment_status n:i"))
def _(spark, sf_dir):
    return rfu_tables(spark, sf_dir).per_row.groupBy("rfu_status", "reference_coverage_status", "assignment_status").agg(F.count(F.lit(1)).alias("n"))


@query("per_sequence", final(f"{SCORES} SELECT unique_sequence_id, cdr3aa, v_call AS query_v_call, (SELECT count(*) FROM trb WHERE trb.cdr3aa = scored.cdr3aa) AS multiplicity, rfu_id, rfu_label, rfu_score, pass_thr FROM scored", "unique_sequence_id cdr3aa query_v_call multiplicity:i rfu_id:i rfu_label rfu_score:d pass_thr"))
def _(spark, sf_dir):
    return rfu_tables(spark, sf_dir).per_sequence.select("unique_sequence_id", "cdr3aa", "query_v_call", "multiplicity", "rfu_id", "rfu_label", "rfu_score", "pass_thr")


@query("sequence_map", final(f"{ID_SCORES} SELECT input_row_id, unique_sequence_id, cell_id, chain, cdr3aa, v_call, 'fixture' AS source_adapter, CAST(source_order AS VARCHAR) AS source_row_id, eligibility_status, reference_coverage_status, {STATUS} AS assignment_status FROM per_row", " ".join(assign.MAPPING)))
def _(spark, sf_dir):
    return rfu_tables(spark, sf_dir, numbered=True).mapping


@query("threshold_misses", final(f"{SCORES} SELECT count(*) AS n_rows, count(DISTINCT cdr3aa) AS n_sequences FROM per_row WHERE rfu_id IS NOT NULL AND NOT pass_thr", "n_rows:i n_sequences:i"))
def _(spark, sf_dir):
    return assign.threshold_misses(rfu_tables(spark, sf_dir).per_row)


CELL_SAMPLES = "cells AS (SELECT 'cell_' || CAST(o_orderkey AS VARCHAR) AS cell_id, 'sample_' || CAST(o_custkey % 60 AS VARCHAR) || '_' || CAST(year(o_orderdate) AS VARCHAR) AS sample_id FROM orders)"


@query("abundance_per_10k", final(f"{SCORES}, {CELL_SAMPLES}, n AS (SELECT sample_id, rfu_id, count(*) AS n_rows FROM per_row LEFT JOIN cells USING (cell_id) WHERE rfu_id IS NOT NULL GROUP BY ALL) SELECT sample_id, rfu_id, n_rows, n_rows * 10000.0 / sum(n_rows) OVER (PARTITION BY sample_id) / ((rfu_id - 1) % 7 + 1) AS abundance FROM n", "sample_id rfu_id:i n_rows:i abundance:d"))
def _(spark, sf_dir):
    rows = quality.metadata_join(rfu_tables(spark, sf_dir).per_row, cells(spark, sf_dir).select("cell_id", "sample_id"), check=False)
    return assign.abundance_per_10k(rows, "sample_id", centroid_reference(spark, sf_dir)).select("sample_id", "rfu_id", "n_rows", "abundance")


@query(
    "flagship",
    final(
        f"""{SCORES}, {CHOSEN}, {CELL_SAMPLES} SELECT sample_id, rfu_label, count(DISTINCT chosen.cell_id) AS n, count(DISTINCT chosen.cell_id) AS value
 FROM chosen JOIN scored ON chosen.cdr3aa = scored.cdr3aa LEFT JOIN cells ON chosen.cell_id = cells.cell_id WHERE best = 1 AND rfu_id IS NOT NULL GROUP BY sample_id, rfu_label""",
        "sample_id rfu_label n:i value:d",
    ),
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs to primary receptors, to RFUs, to a sample x RFU table of cells."""
    own = cellranger(spark, sf_dir).receptors.withColumn("source_order", F.col("source_row_id").cast("long"))
    out = assign.call_rfus(own, scorers(spark, sf_dir), threshold=THRESHOLD).per_row
    rows = quality.metadata_join(out, cells(spark, sf_dir), check=False)
    return plain(samples.pseudobulk(rows, sample="sample_id", check=False).matrix)
