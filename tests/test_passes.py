"""How often the operators read their source: a source is a whole lineage, and each pass over it
costs a sort of all rows."""

import pytest
from pyspark.sql import functions as F

from clonoform.functions.grouped import row_numbers
from clonoform.operators import adapters, assign, canonical, metrics, phenotype
from clonoform.plans import workflows
from clonoform.plans.base import assigned, cells, contigs


@pytest.fixture
def counted(spark):
    """A frame and the number of times that its rows were read."""

    def count(df):
        seen, size = spark.sparkContext.accumulator(0), df.count()

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema), lambda: seen.value / size

    return count


def small(df):
    return df.where("source_order < 40000")


def test_cellranger_reads_its_source_for_flags_rows_and_report_only(spark, sf_dir, counted):
    source, passes = counted(small(contigs(spark, sf_dir)))
    made = adapters.adapt_cellranger(source, order_by="source_order", chain="TRB")
    assert passes() <= 2.01
    made.receptors.count(), made.cell_metadata.count()
    assert passes() <= 2.01
    assert made.qc.first()["selected_receptor_row_count"] == made.receptors.count() and passes() <= 3.01


def test_report_alone_numbers_no_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(adapters, "row_numbers", lambda *a: pytest.fail("rows were numbered"))
    assert adapters.adapt_cellranger(small(contigs(spark, sf_dir)), order_by="source_order", chain="TRB").qc.first()["selected_cell_count"] > 0
    assert adapters.adapt_airr(small(contigs(spark, sf_dir)), order_by="source_order", chain="TRB").qc.first()["selected_cell_count"] > 0


def test_validation_copies_no_rows(spark, sf_dir):
    rows = canonical.canonicalize(small(contigs(spark, sf_dir)).select(F.col("barcode").alias("cell_id"), "chain", F.col("cdr3").alias("cdr3aa"), F.col("v_gene").alias("v_call"), "productive", "source_order", F.col("contig_id").alias("input_row_id")), "x", "source_order")
    report = canonical.validation_report(rows)
    assert "Expand" not in report._jdf.queryExecution().optimizedPlan().toString()
    assert report.first()["unique_cell_count"] == rows.select("cell_id").distinct().count()


def test_coupling_matrix_and_call_read_their_rows_once(spark, sf_dir, counted):
    rows, passes = counted(small(assigned(spark, sf_dir)))
    phenotype.phenotype_coupling(rows, phenotype="cell_type", sample="sample_id").count()
    assert passes() <= 1.01
    rows, passes = counted(small(assigned(spark, sf_dir)))
    phenotype.sequence_matrix(rows, rfu="RFU7", weighting="cell").count()
    assert passes() <= 1.01
    rows, passes = counted(small(assigned(spark, sf_dir)).select("cell_id", "chain", "cdr3aa", "v_call", "source_order"))
    assign.call_rfus(rows, [lambda b: iter(())]).per_sequence.count()
    assert passes() <= 1.01


def test_first_calls_need_no_sort_of_all_rows(spark):
    rows = spark.createDataFrame([("CA", "V2", 5), ("CA", "V1", 7), ("CA", "V1", 9), ("CB", None, 1), ("CB", "V1", 2), ("XA", "V1", 0)], "cdr3aa string, v_call string, source_order long")
    got = {r["cdr3aa"]: tuple(r) for r in assign.counted_queries(rows).collect()}
    assert got == {"CB": ("sequence_00000000", "CB", None, 1, 2), "CA": ("sequence_00000001", "CA", "V2", 5, 3)}


def test_downstream_and_attached_read_their_rows_once(spark, sf_dir, tmp_path, counted):
    metadata = cells(spark, sf_dir)
    rows, passes = counted(small(assigned(spark, sf_dir)).where("sample_id is not null").drop(*[c for c in metadata.columns if c != "cell_id"]))
    workflows.downstream_analysis(rows, metadata, str(tmp_path / "a"), sample="sample_id", phenotype_key="cohort", order_by="source_order")
    assert passes() <= 1.01
    results, passes = counted(adapters.primary_chain(small(assigned(spark, sf_dir)), []).select("cell_id", "rfu_label", "rfu_score"))
    airr = small(contigs(spark, sf_dir)).withColumnRenamed("barcode", "cell_id").withColumnRenamed("cdr3", "cdr3aa").withColumnRenamed("v_gene", "v_call")
    workflows.attached_summary(airr, metadata.select("cell_id", "cohort"), results, str(tmp_path / "b"), order_by="source_order", groupby="cohort")
    assert passes() <= 1.01


def test_two_files_are_numbered_without_a_sort_of_the_rows(spark, tmp_path, monkeypatch):
    sorted_rows = []
    monkeypatch.setattr(workflows, "row_numbers", lambda df, by: sorted_rows.append(df.count()) or row_numbers(df, by))
    spark.range(500).select(F.concat(F.lit("c"), "id").alias("barcode"), F.lit("TRB").alias("chain"), F.lit("CAA").alias("cdr3"), F.lit("V1").alias("v_gene")).repartition(3).write.option("header", True).csv(str(tmp_path / "tcr.csv"))
    spark.range(500).select(F.concat(F.lit("c"), "id").alias("cell_id")).write.option("header", True).csv(str(tmp_path / "meta.csv"))
    assert workflows.prepare_two_files(spark, str(tmp_path / "tcr.csv"), str(tmp_path / "meta.csv"))[0].count() == 500
    assert sum(sorted_rows) <= 3  # files


def test_units_that_count_themselves_carry_no_unit(spark):
    rows = spark.createDataFrame([("s", "c1", "CA", "k1", "v1", 1), ("s", "c2", "CA", "k1", "v1", 2), ("s", "c2", "CB", None, "v2", 3)], "s string, cell string, cdr3 string, k string, v string, o long")
    for weighting, want in (("cell", {"clonotype": [2], "sequence": [1, 2], "gene": [1, 2], "cell": [1, 1]}), ("unique_sequence", {"clonotype": [1], "sequence": [1, 1], "gene": [1, 1], "cell": [1, 1]})):
        counts = metrics._unit_counts(rows, ["s"], weighting, "cell", "cdr3", "k", "v", "o")
        got = {k: sorted(r["n"] for r in counts.where(F.col("kind") == k).collect()) for k in want}
        assert got == want
