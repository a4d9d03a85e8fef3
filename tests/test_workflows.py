"""Workflows end to end on the fixture views and on tiny files."""

import gzip

import pytest
from pyspark.sql import functions as F

from clonoform.operators import assign
from clonoform.plans import workflows
from clonoform.sources.fixtures import centroid_reference, trimer_reference, view


def test_downstream_analysis(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "assigned").where("sample_id is not null and cast(substr(cell_id, 6) as int) < 400")
    own = rows.drop("donor_id", "sample_id", "timepoint", "cell_type", "cohort")
    out = workflows.downstream_analysis(own, view(spark, sf_dir, "cells"), str(tmp_path / "o"), sample="sample_id", phenotype_key="cohort", order_by="source_order")
    assert set(out) == {"repertoire_metrics", "rfu_metrics", "pseudobulk_counts", "pseudobulk_clr", "sample_metadata", "sample_qc", "rfu_metadata", "phenotype_coupling", "overlap_jaccard", "overlap_cosine"}
    n = out["sample_metadata"].count()
    assert out["overlap_jaccard"].count() == n * (n + 1) // 2 and out["rfu_metrics"].count() > 0
    with pytest.raises(Exception):
        workflows.write_tables({"sample_qc": out["sample_qc"]}, str(tmp_path / "o"))


def test_receptor_workflow(spark, sf_dir, tmp_path):
    source = view(spark, sf_dir, "contigs").where("cast(substr(barcode, 6) as int) < 300")
    off = workflows.receptor_workflow(source, "cellranger", str(tmp_path / "off"), order_by="source_order")
    assert {r[0] for r in off["per_row"].select("assignment_status").distinct().collect()} >= {"skipped_backend"}
    scorers = assign.spearman_scorers(trimer_reference(spark, sf_dir), centroid_reference(spark, sf_dir))
    on = workflows.receptor_workflow(source, "cellranger", str(tmp_path / "on"), order_by="source_order", scorers=scorers, threshold=0.25, groupby=["cohort"], metadata=view(spark, sf_dir, "cells"))
    assert on["per_sequence"].count() == off["per_sequence"].count() == on["per_sequence"].agg(F.count_distinct("cdr3aa")).first()[0]
    assert on["per_row"].count() == on["receptors"].count() and on["rfu_metrics"].count() > 0


def test_dataset_report(spark, sf_dir, tmp_path):
    rows = view(spark, sf_dir, "assigned")
    out = workflows.dataset_report(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "cells"), rows, str(tmp_path / "r"), group="cohort", cell_type="cell_type")
    assert out["airr_qc"].first()["status"] == "ok" and out["rfu_summary"].first()["n_cells"] == rows.count()


def test_two_file_preparation(spark, tmp_path):
    with gzip.open(tmp_path / "tcr.csv.gz", "wt") as f:
        f.write("Bar-code,locus,junction_aa,v_gene,productive\nc1,TRA,CAVF,V0,true\nc1,TRB,CASSF,V1,true\nc9,TRB,CASSW,V2,false\n")
    with gzip.open(tmp_path / "meta.csv.gz", "wt") as f:
        f.write("cell_id,sample\nc1,s1\nc2,s1\n")
    airr, cells, report = workflows.prepare_two_files(spark, str(tmp_path / "tcr.csv.gz"), str(tmp_path / "meta.csv.gz"))
    assert {tuple(r) for r in airr.collect()} == {("c1", "TRB", "CASSF", "V1", True), ("c2", "", "", "", False)}
    r = report.first()
    assert (r["n_metadata_rows"], r["n_tcr_rows"], r["n_cells_with_tcr"], r["n_overlap_cells"], r["barcode_overlap_rate"], r["n_productive_trb_rows"]) == (2, 3, 2, 1, 0.5, 1)
    with pytest.raises(ValueError):
        workflows.prepare_two_files(spark, str(tmp_path / "meta.csv.gz"), str(tmp_path / "meta.csv.gz"))


def test_source_order_is_the_order_of_files(spark, tmp_path):
    """Small files are packed together by size; the order of their rows is that of their names."""
    (tmp_path / "tcr.csv").mkdir()
    sizes = {"0.csv": 10, "1.csv": 4_000, "2.csv": 50, "10.csv": 7}
    want, n = [], 0
    for name, rows in sizes.items():
        lines = [f"c{n + i},TRB,CASS{i},V1,true" for i in range(rows)]
        (tmp_path / "tcr.csv" / name).write_text("cell_id,chain,cdr3,v_gene,productive\n" + "\n".join(lines) + "\n")
        want += [f"c{n + i}" for i in range(rows)]
        n += rows
    (tmp_path / "meta.csv").write_text("cell_id\nc1\n")
    held = {}
    original = workflows.adapters.representative_rows
    workflows.adapters.representative_rows = lambda rows, cells, order: held.update(rows=rows, order=order) or original(rows, cells, order)
    try:
        workflows.prepare_two_files(spark, str(tmp_path / "tcr.csv"), str(tmp_path / "meta.csv"))
    finally:
        workflows.adapters.representative_rows = original
    got = held["rows"].orderBy(held["order"]).select("cell_id", "source_order").collect()
    assert [r["cell_id"] for r in got] == want and [r["source_order"] for r in got] == list(range(n))


def test_atlas_workflow(spark, sf_dir, tmp_path):
    wide = view(spark, sf_dir, "wells_wide").withColumn("place", F.substr("cell_id", F.lit(6)).cast("long")).withColumn("expression", F.lit(1))
    scorers = assign.spearman_scorers(trimer_reference(spark, sf_dir), centroid_reference(spark, sf_dir))
    some = workflows.atlas_workflow(wide, str(tmp_path / "a"), scorers=scorers, order_by="place", columns=["place"], max_cells=200)
    assert some["cells"].count() == 200 and some["cells"].columns == ["cell_id", "place"]
    rows = some["per_row"]
    assert rows.count() == some["receptors"].count() == some["extracted"].count() == rows.select("input_row_id").distinct().count() > 0
    assert some["per_sequence"].count() == rows.where("cdr3aa like 'C%'").select("cdr3aa").distinct().count()
    both = workflows.atlas_workflow(wide.where("place < 200"), str(tmp_path / "b"), scorers=scorers, order_by="place", primary=False)
    ids = both["receptors"].join(wide.select("cell_id", "place"), "cell_id").orderBy("source_slot", "place").select("input_row_id").collect()
    assert [r[0] for r in ids] == sorted(r[0] for r in ids)
    with pytest.raises(ValueError):
        workflows.atlas_workflow(wide.where("cell_id is null"), str(tmp_path / "c"), scorers=scorers, order_by="place")
    with pytest.raises(ValueError):
        workflows.atlas_workflow(wide, str(tmp_path / "d"), scorers=scorers, order_by="place", max_cells=0)


def test_attached_summary(spark, tmp_path):
    rows = [("c1", "TRB", "CASSF", "V1", "true", 1), ("c2", "TRB", "CASSW", "V2", "true", 2), ("c3", "TRA", "CAVF", "V3", "true", 3), ("c4", "TRB", "CASSY", "V4", "false", 4)]
    airr = spark.createDataFrame(rows, "cell_id string, chain string, cdr3aa string, v_call string, productive string, n long")
    cells = spark.createDataFrame([("c1", "s1"), ("c2", "s1"), ("c3", "s2"), ("c4", "s2")], "cell_id string, sample string")
    results = spark.createDataFrame([("c1", "RFU10", 0.9), ("c2", "RFU2", 0.7)], "cell_id string, rfu_label string, rfu_score double")
    out = workflows.attached_summary(airr, cells, results, str(tmp_path / "x"), order_by="n", groupby="sample")
    assert {r["cell_id"]: r["trbv"] for r in out["attached"].collect()} == {"c1": "V1", "c2": "V2", "c3": None, "c4": None}
    assert out["rfu_summary"].first()["assignment_rate"] == 0.5
    assert {(r["sample"], r["n_assigned"]) for r in out["rfu_summary_by_sample"].collect()} == {("s1", 2), ("s2", 0)}
    text = [p.read_text() for p in (tmp_path / "x" / "rfu_matrix").glob("*.csv")]
    assert any("sample\tRFU2\tRFU10" in t and "s1\t0.5\t0.5" in t for t in text)
