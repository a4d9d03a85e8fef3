"""Quality reports over AIRR tables, metadata joins and preparation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions import scalars as S
from clonoform.functions.grouped import ratio
from clonoform.operators.canonical import pick_columns

#: Aliases of the AIRR check.
CHECK_ALIASES = {
    "cell": ("cell_id", "cell", "barcode", "cellid"),
    "chain": ("chain", "locus"),
    "cdr3": ("cdr3aa", "junction_aa", "cdr3_aa", "cdr3"),
    "v": ("v_call", "v_gene", "trbv", "v"),
    "productive": ("productive",),
}


#: The columns of the AIRR check's report that count, in order.
CHECK_COUNTS = ("n_airr_rows", "n_airr_cells", "n_overlap_cells")
CHECK_FLAGS = {"has_cell_id_col": "cell", "has_chain_col": "chain", "has_cdr3_col": "cdr3", "has_v_col": "v", "has_productive_col": "productive"}


def validate_airr(table: DataFrame | None, cells: DataFrame, chain: str = "TRB", strict: bool = False, airr_key: str = "airr") -> DataFrame:
    """One row about an AIRR-like table and the cells that it should belong to. The chain
    text is compared as it is, upper-cased, without chain aliases.

    ``table`` is None where there is no such table (``missing_airr_key``), and anything but a
    DataFrame is ``invalid_airr``. The other statuses are ``missing_required_columns``,
    ``no_chain_rows``, ``barcode_mismatch`` and ``ok``. With ``strict`` the first three raise.
    """
    n = cells.agg(F.count(F.lit(1)).alias("n_obs_cells"))
    if not isinstance(table, DataFrame):
        status = "missing_airr_key" if table is None else "invalid_airr"
        if strict:
            raise ValueError(f"{airr_key}: {status}")
        return _airr_report(n, airr_key, chain, {}, F.lit(status))
    found = pick_columns(table, CHECK_ALIASES)
    missing = [k for k in ("cell", "chain", "cdr3", "v") if found[k] is None]
    if missing and strict:
        raise ValueError(f"AIRR table missing required columns: {missing}")
    get = lambda k: F.col(f"`{found[k]}`").cast("string")
    on_chain = F.coalesce(F.upper(get("chain")) == chain.upper(), F.lit(False)) if found["chain"] else F.lit(False)
    good = S.truthy(get("productive")) if found["productive"] else F.lit(False)
    own = table.agg(F.count(F.lit(1)).alias("n_airr_rows"), F.count_if(on_chain).alias("n_chain_rows"), F.count_if(on_chain & good).alias("n_productive_chain_rows"))
    ids = table.select(get("cell").alias("cell_id")).where("cell_id is not null").distinct() if found["cell"] else table.select(F.lit("").alias("cell_id")).limit(0)
    known = cells.select(F.col("cell_id").cast("string").alias("cell_id")).distinct().withColumn("known", F.lit(True))
    both = ids.join(known, "cell_id", "left").agg(F.count(F.lit(1)).alias("n_airr_cells"), F.count_if("known").alias("n_overlap_cells"))
    status = F.when(F.col("n_chain_rows") == 0, "no_chain_rows").when((F.col("n_airr_cells") > 0) & (F.col("n_overlap_cells") == 0), "barcode_mismatch").otherwise("ok")
    one = own.join(both, F.lit(True)).join(n, F.lit(True))  # one row each
    return _airr_report(one, airr_key, chain, found, F.lit("missing_required_columns") if missing else status)


def _airr_report(one: DataFrame, airr_key: str, chain: str, found: dict, status) -> DataFrame:
    """The report's columns in order, with zero for what ``one`` doesn't count."""
    count = lambda c: F.col(c) if c in one.columns else F.lit(0).cast("long").alias(c)
    shared, all_cells = (count(c) for c in ("n_overlap_cells", "n_airr_cells"))
    return one.select(
        F.lit(airr_key).alias("airr_key"),
        F.lit(chain).alias("chain"),
        "n_obs_cells",
        *[count(c) for c in CHECK_COUNTS],
        F.coalesce(ratio(shared, all_cells), F.lit(0.0)).alias("barcode_overlap_rate"),
        *[F.lit(found.get(k) is not None).alias(c) for c, k in CHECK_FLAGS.items()],
        count("n_chain_rows"),
        count("n_productive_chain_rows"),
        status.alias("status"),
    )


def metadata_join(rows: DataFrame, metadata: DataFrame, labels: Sequence[str] = (), check: bool = True) -> DataFrame:
    """Rows with their cell's metadata, left and many-to-one. Checked: unique non-null
    metadata keys, no column in both, and (after the join) non-null ``labels``."""
    clash = [c for c in metadata.columns if c in rows.columns and c != "cell_id"]
    if clash:
        raise ValueError(f"metadata columns are already present: {clash}")
    if check:
        odd = metadata.groupBy("cell_id").count().where("cell_id is null or count > 1").limit(1).count()
        if odd:
            raise ValueError("metadata cell_id must be unique and non-null")
    out = rows.join(metadata, "cell_id", "left")
    if check and labels:
        nulls = out.where(" or ".join(f"`{c}` is null" for c in labels)).limit(1).count()
        if nulls:
            raise ValueError(f"requested labels are missing for some rows: {list(labels)}")
    return out


def join_qc(rows: DataFrame, metadata: DataFrame) -> DataFrame:
    """Cells on either side, in both, and on one side only."""
    a = rows.where("cell_id is not null").select("cell_id").distinct().withColumn("a", F.lit(1))
    b = metadata.where("cell_id is not null").select("cell_id").distinct().withColumn("b", F.lit(1))
    return a.join(b, "cell_id", "full").agg(
        F.count("a").alias("n_row_cells"),
        F.count("b").alias("n_metadata_cells"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_overlap_cells"),
        F.count_if(F.col("b").isNull()).alias("n_rows_only"),
        F.count_if(F.col("a").isNull()).alias("n_metadata_only"),
    )


def prepare_report(receptors: DataFrame, metadata: DataFrame) -> DataFrame:
    """Row counts, cell overlap and productive TRB rows of a two-file preparation."""
    good = (F.upper("chain") == "TRB") & S.truthy_productive(F.col("productive"))
    own = receptors.agg(F.count(F.lit(1)).alias("n_tcr_rows"), F.count_if(good).alias("n_productive_trb_rows"))
    counts = join_qc(receptors, metadata).select(F.col("n_row_cells").alias("n_cells_with_tcr"), "n_overlap_cells")
    n = metadata.agg(F.count(F.lit(1)).alias("n_metadata_rows"))
    out = own.join(counts, F.lit(True)).join(n, F.lit(True))
    return out.withColumn("barcode_overlap_rate", F.coalesce(ratio(F.col("n_overlap_cells"), F.col("n_cells_with_tcr")), F.lit(0.0)))


#: Tolerated names of result columns.
LABELS, SCORES = ("rfu_label", "label", "RFU", "rfu"), ("rfu_score", "score", "COR", "cor", "distance", "dist", "prob")


def attach_results(cells: DataFrame, features: DataFrame, results: DataFrame, check: bool = True) -> DataFrame:
    """All cells with CDR3, V call, label and numeric score of the cells that have them."""
    label = next((c for c in LABELS if c in results.columns), None)
    score = next((c for c in SCORES if c in results.columns), None)
    cdr3 = next((c for c in ("cdr3aa", "trb_cdr3aa", "cdr3_aa", "cdr3") if c in features.columns), None)
    v = next((c for c in ("trbv", "v_call", "trbv_call", "v_gene", "vgene") if c in features.columns), None)
    if label is None or cdr3 is None or v is None:
        raise ValueError("results need a label column, features a CDR3 and a V column")
    if check:
        for df in (features, results):
            if df.groupBy("cell_id").count().where("count > 1").limit(1).count():
                raise ValueError("cells must be unique in features and results")
    f = features.select("cell_id", F.col(cdr3).cast("string").alias("trb_cdr3aa"), F.col(v).cast("string").alias("trbv"))
    number = F.col(score).cast("string").try_cast("double") if score else F.lit(None).cast("double")
    r = results.select("cell_id", F.col(label).cast("string").alias("rfu_label"), number.alias("rfu_score"))
    return cells.join(f.join(r, "cell_id", "left"), "cell_id", "left")
