"""Scalars, canonical rows, adapters, quality and storage on small hand-made frames."""

import json

import pytest
from pyspark.sql import functions as F

from clonoform.functions import scalars as S
from clonoform.functions.grouped import row_name, row_numbers
from clonoform.operators import adapters, canonical, quality
from clonoform.sources import tables as io


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_normalization(spark):
    assert apply(spark, [" beta ", "TCR-A", "tr_b", "nan", "", None, "X1"], S.normalize_chain) == ["TRB", "TRA", "TRB", None, None, None, "X1"]
    assert apply(spark, ["True", "0", "unproductive", "1.0", None, " yes "], S.normalize_productive) == [True, False, False, None, None, True]
    assert apply(spark, [" CASSF ", "NaN", "<NA>", "none", None], S.normalize_text) == ["CASSF", None, None, None, None]
    assert apply(spark, ["T", "productive", None], S.truthy) == [True, False, False]
    assert apply(spark, ["3", "x", None], S.numeric_rank) == [3.0, float("-inf"), float("-inf")]


def test_natural_order(spark):
    names = ["RFU10", "rfu2", "RFU1b", "5-LOW", "12-x", "RFU1"]
    got = [r[0] for r in column(spark, names).orderBy(S.natural_key(F.col("v"))).select("v").collect()]
    assert got == ["5-LOW", "12-x", "RFU1", "RFU1b", "rfu2", "RFU10"]


def test_alignment_and_trimers(spark):
    assert apply(spark, ["CAF", "CASSW", "AAA"], lambda c: S.align(c, F.lit(5))) == ["CA--F", "CASSW", "-AAA-"]
    assert apply(spark, ["CAF"], lambda c: S.align(c, F.lit(6), "center")) == ["-CAF--"]
    assert apply(spark, ["CASSLGQETQYF", "CASS"], S.trimers) == [["SSL", "SLG", "LGQ", "GQE"], []]
    with pytest.raises(ValueError):
        S.align(F.lit("C"), F.lit(2), "odd")


def receptors(spark):
    rows = [("c1", "beta", "CASSF", "V1", "yes", 1), ("c2", "TRB", "nan", "V2", "no", 2), ("c2", "TRA", "CAVF", None, None, 3)]
    return spark.createDataFrame(rows, "cell_id string, chain string, cdr3aa string, v_call string, productive string, source_order long")


def test_row_ids_stay_apart_beyond_eight_digits(spark):
    names = spark.createDataFrame([(n,) for n in (0, 9_999_999, 10_000_000, 99_999_999, 100_000_000, 100_000_001)], "__row long").select(row_name("row_")).collect()
    assert [r[0] for r in names] == ["row_00000000", "row_09999999", "row_10000000", "row_99999999", "row_100000000", "row_100000001"]


def test_aliases_go_by_preference_not_by_column_order(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "barcode int, `Cell_ID ` int, LOCUS int, locus int")
    found = canonical.pick_columns(df, {"cell": ("cell_id", "barcode"), "chain": ("chain", "locus"), "v": ("v_call",)})
    assert found == {"cell": "Cell_ID ", "chain": "locus", "v": None}


def test_airr_check_statuses(spark):
    cells = spark.createDataFrame([("c1",), ("c2",)], "cell_id string")
    table = spark.createDataFrame([("c1", "trb", "CASSF", "V1", "productive"), ("c1", "TRB", "CASSF", "V1", "yes"), ("c9", "TRA", "CAF", "V2", "T")], "barcode string, locus string, cdr3 string, v_gene string, productive string")
    got = lambda t, **k: quality.validate_airr(t, cells, **k).first()
    r = got(table)
    assert (r["status"], r["n_chain_rows"], r["n_productive_chain_rows"], r["n_airr_cells"], r["n_overlap_cells"], r["barcode_overlap_rate"]) == ("ok", 2, 1, 2, 1, 0.5)
    assert got(table, chain="IGH")["status"] == "no_chain_rows"
    assert got(table.withColumn("barcode", F.lit("zz")))["status"] == "barcode_mismatch"
    assert got(table.drop("cdr3"))["status"] == "missing_required_columns"
    for odd, status in ((None, "missing_airr_key"), (5, "invalid_airr")):
        r = got(odd)
        assert (r["status"], r["n_obs_cells"], r["n_airr_rows"], r["has_v_col"]) == (status, 2, 0, False)
        with pytest.raises(ValueError):
            quality.validate_airr(odd, cells, strict=True)
    assert len(got(table)) == len(got(None)) == 15


def test_named_tables_enforce_containment(spark):
    airr = receptors(spark).withColumn("locus", F.col("chain"))
    cells = spark.createDataFrame([("c1",)], "cell_id string")
    known = cells.union(spark.createDataFrame([("c2",)], "cell_id string"))
    tables = {"airr": airr.drop("locus"), "some": cells, "all": known}
    run = lambda **k: adapters.prepare_receptors(tables, "airr", order_by="source_order", productive_only=False, **k)
    assert run(receptors="airr", cells="all").provenance["cells"] == "all"
    assert run(receptors="airr").provenance["cells"] == "airr"
    with pytest.raises(ValueError, match="absent"):
        run(receptors="airr", cells="some")
    with pytest.raises(KeyError):
        run(receptors="x")
    with pytest.raises(ValueError):
        run(cells="all")
    with pytest.raises(ValueError):
        run(receptors="airr", cells="all", metadata=cells)
    with pytest.raises(TypeError):
        adapters.prepare_receptors(airr, "airr", receptors="airr", order_by="source_order")
    wide = spark.createDataFrame([("c1", "TRB", "CASSF", "V1", "true"), ("c2", "TRB", "CASSW", "V2", "true")], "cell_id string, ir_vdj_1_locus string, ir_vdj_1_junction_aa string, ir_vdj_1_v_call string, ir_vdj_1_productive string")
    with pytest.raises(ValueError, match="absent"):
        adapters.prepare_receptors({"w": wide, "some": cells}, "wells", receptors="w", cells="some")


def test_canonical_rows(spark):
    out = canonical.canonicalize(receptors(spark), "x", "source_order").orderBy("source_order").collect()
    assert [r["input_row_id"] for r in out] == ["row_00000000", "row_00000001", "row_00000002"]
    assert [(r["chain"], r["cdr3aa"], r["productive"]) for r in out] == [("TRB", "CASSF", True), ("TRB", None, False), ("TRA", "CAVF", None)]
    report = canonical.validate_receptors(canonical.canonicalize(receptors(spark), "x", "source_order"), strict=False).first()
    assert (report["status"], report["missing_cdr3aa_count"], report["recognized_chains"]) == ("error", 1, "TRA,TRB")
    with pytest.raises(ValueError):
        canonical.validate_receptors(canonical.canonicalize(receptors(spark), "x", "source_order"))
    with pytest.raises(ValueError):
        canonical.canonicalize(receptors(spark))


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 100_003).alias("k")).repartition(5)
    got = row_numbers(df, "k", buckets=8).orderBy("k").collect()
    assert [r["__row"] for r in got] == list(range(1000))
    assert row_numbers(df.limit(0), "k").count() == 0
    with pytest.raises(ValueError):
        row_numbers(df.select(F.col("k").cast("string").alias("k")), "k")


CONTIGS = [
    ("b1", "true", "true", "TRB", "V1", "True", "CASSF", 5, 50, 1),
    ("b1", "true", "true", "TRB", "V2", "True", "CASSW", 9, 10, 2),
    ("b1", "true", "true", "TRA", "V3", "True", "CAVF", 99, 10, 3),
    ("b2", "false", "true", "TRB", "V1", "True", "CASSG", 5, 50, 4),
    ("b3", "true", "false", "TRB", "V1", "True", "CASSH", 5, 50, 5),
    ("b4", "true", "true", "TRB", "V1", "False", "CASSI", 5, 50, 6),
    ("b5", "true", "true", "TRB", "V1", "True", None, 5, 50, 7),
]


def contigs(spark, rows=CONTIGS):
    return spark.createDataFrame(rows, "Barcode string, is_cell string, high_confidence string, chain string, v_gene string, productive string, cdr3 string, umis int, reads int, ord long")


def test_cellranger(spark):
    out = adapters.prepare_receptors(contigs(spark), "cellranger", order_by="ord", chain="TRB")
    assert [(r["cell_id"], r["cdr3aa"]) for r in out.receptors.collect()] == [("b1", "CASSW")]
    qc = out.qc.first().asDict()
    assert [qc[c] for c in ("source_row_count", "rows_after_required_value_filter", "rows_after_is_cell_filter", "rows_after_high_confidence_filter", "rows_before_primary_selection", "selected_receptor_row_count")] == [7, 6, 5, 4, 2, 1]
    every = adapters.adapt_cellranger(contigs(spark), order_by="ord", productive_only=False, primary=False, filter_is_cell=False, filter_high_confidence=False)
    assert every.receptors.count() == 6
    labelled = contigs(spark).withColumn("site", F.when(F.col("ord") != 2, F.lit("skin")))
    cells = adapters.adapt_cellranger(labelled, order_by="ord", chain="TRB", metadata_columns=["site"]).cell_metadata
    assert [tuple(r) for r in cells.collect()] == [("b1", "skin")]
    with pytest.raises(ValueError, match="conflicting"):
        adapters.adapt_cellranger(labelled, order_by="ord", chain="TRB", metadata_columns=["umis"])
    with pytest.raises(ValueError, match="missing"):
        adapters.adapt_cellranger(labelled, order_by="ord", metadata_columns=["none"])
    with pytest.raises(ValueError, match="invalid booleans"):
        adapters.adapt_cellranger(contigs(spark, [(*CONTIGS[0][:1], "maybe", *CONTIGS[0][2:])]), order_by="ord")
    with pytest.raises(ValueError, match="absent"):
        adapters.adapt_cellranger(contigs(spark), order_by="ord", metadata=spark.createDataFrame([("zz",)], "cell_id string"))
    with pytest.raises(ValueError, match="missing required"):
        adapters.adapt_cellranger(contigs(spark).drop("cdr3"), order_by="ord")


def test_airr_and_features(spark):
    out = adapters.adapt_airr(contigs(spark), order_by="ord", chain="TRB")
    assert {r["cell_id"] for r in out.receptors.collect()} == {"b1", "b2", "b3", "b5"}
    assert {(r["cell_id"], r["cdr3aa"]) for r in adapters.extract_features(contigs(spark), order_by="ord").collect()} >= {("b1", "CASSW")}
    with pytest.raises(ValueError, match="missing columns"):
        adapters.adapt_airr(contigs(spark).drop("v_gene"), order_by="ord")
    with pytest.raises(ValueError, match="unknown"):
        adapters.prepare_receptors(contigs(spark), "none")
    assert adapters.list_receptor_adapters() == ["cellranger_vdj", "generic_airr_dataframe", "scirpy_airr", "wells_tcr_ir"]


def test_wide_slots(spark):
    names = [f"ir_vdj_{s}_{f}" for s in (1, 2) for f in ("locus", "junction_aa", "v_call", "productive", "duplicate_count")]
    rows = [("w1", "TRB", "CASSF", "V1", "true", "3", "beta", "CASSW", "V2", "true", "8"), ("w2", "TRB", "nan", "V1", "true", "3", None, None, None, None, None)]
    df = spark.createDataFrame(rows, "cell_id string, " + ", ".join(f"{n} string" for n in names))
    out = adapters.adapt_wells(df)
    assert [(r["cell_id"], r["source_slot"], r["cdr3aa"]) for r in out.receptors.collect()] == [("w1", "VDJ_2", "CASSW")]
    none = df.drop("ir_vdj_1_productive", "ir_vdj_2_productive")
    assert adapters.adapt_wells(none, primary=False).receptors.count() == 2
    features = adapters.extract_wide_features(df, spark.createDataFrame([("w1",), ("w2",)], "cell_id string"))
    assert [tuple(r) for r in features.collect()] == [("w1", "CASSF", "V1")]
    with pytest.raises(ValueError):
        adapters.extract_wide_features(df.union(df), df.select("cell_id"))


def test_quality(spark):
    cells = spark.createDataFrame([("b1", "s1"), ("b9", "s2")], "cell_id string, sample string")
    r = quality.validate_airr(contigs(spark), cells).first()
    assert (r["n_obs_cells"], r["n_airr_cells"], r["n_overlap_cells"], r["barcode_overlap_rate"], r["status"]) == (2, 5, 1, 0.2, "ok")
    assert quality.validate_airr(contigs(spark), cells, chain="IGH").first()["status"] == "no_chain_rows"
    assert quality.validate_airr(contigs(spark).drop("cdr3"), cells).first()["status"] == "missing_required_columns"
    assert quality.validate_airr(contigs(spark), cells.where("cell_id = 'b9'")).first()["status"] == "barcode_mismatch"
    with pytest.raises(ValueError):
        quality.validate_airr(contigs(spark).drop("cdr3"), cells, strict=True)
    rows = contigs(spark).withColumnRenamed("Barcode", "cell_id")
    assert quality.metadata_join(rows, cells).where("sample is not null").count() == 3
    with pytest.raises(ValueError, match="unique"):
        quality.metadata_join(rows, cells.union(cells))
    with pytest.raises(ValueError, match="already present"):
        quality.metadata_join(rows, cells.withColumn("umis", F.lit(1)))
    with pytest.raises(ValueError, match="missing"):
        quality.metadata_join(rows, cells, ["sample"])
    features = spark.createDataFrame([("b1", "CASSF", "V1")], "cell_id string, cdr3 string, v_gene string")
    results = spark.createDataFrame([("b1", "RFU1", "0.5")], "cell_id string, label string, COR string")
    got = {r["cell_id"]: (r["rfu_label"], r["rfu_score"]) for r in quality.attach_results(cells.select("cell_id"), features, results).collect()}
    assert got == {"b1": ("RFU1", 0.5), "b9": (None, None)}


def test_cache_round_trip(spark, tmp_path):
    out = adapters.adapt_cellranger(contigs(spark), order_by="ord", chain="TRB", primary=False)
    path = str(tmp_path / "cache")
    io.write_cache(path, out.receptors, out.cell_metadata)
    back, cells = io.read_cache(spark, path)
    assert back.count() == 2 and cells.count() == 1
    with pytest.raises(Exception):
        io.write_cache(path, out.receptors, out.cell_metadata)
    io.write_cache(path, out.receptors, out.cell_metadata, force=True)
    spark.createDataFrame([("other",)], "cell_id string").write.mode("overwrite").parquet(f"{path}/cells")
    assert io.validate_cache(spark, path) == ["cells differs in content"]
    with pytest.raises(ValueError):
        io.read_cache(spark, path)
    assert io.validate_cache(spark, str(tmp_path / "none"))[0].startswith("no manifest")


def test_only_changed_partitions_of_a_cache_are_read(spark, tmp_path):
    import os

    rows = [(f"b{i}", "true", "true", "TRB" if i % 2 else "TRG", "V1", "True", "CASSF", 5, 50, i) for i in range(40)]
    out = adapters.adapt_cellranger(contigs(spark, rows), order_by="ord", primary=False, productive_only=False)
    path = str(tmp_path / "cache")
    io.write_cache(path, out.receptors, out.cell_metadata)
    assert [io.changed_parts(spark, path, name) for name in io.CACHE_TABLES] == [[], []] and io.validate_cache(spark, path, deep=True) == []
    # a file that nothing says was changed isn't read: its content may be spoilt unseen
    quiet = next((tmp_path / "cache/receptors/chain=TRG").glob("*.parquet"))
    stat, whole = quiet.stat(), quiet.read_bytes()
    quiet.write_bytes(b"x" * len(whole))
    os.utime(quiet, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert io.validate_cache(spark, path) == []
    # another partition's change is seen, and only that partition is read
    read = spark.read.parquet(f"{path}/receptors/chain=TRB")
    trb = spark.createDataFrame(read.collect(), read.schema)
    assert trb.count() == 20
    trb.limit(19).write.mode("overwrite").parquet(f"{path}/receptors/chain=TRB")
    assert io.changed_parts(spark, path, "receptors") == ["TRB"] and io.changed_parts(spark, path, "cells") == []
    assert io.validate_cache(spark, path) == ["receptors has 39 rows instead of 40"]
    trb.write.mode("overwrite").parquet(f"{path}/receptors/chain=TRB")
    assert io.validate_cache(spark, path) == []
    assert io.validate_cache(spark, path, deep=True) != []
    quiet.write_bytes(whole)
    assert io.validate_cache(spark, path, deep=True) == []


def test_export_read_and_manifests(spark, tmp_path):
    long = spark.createDataFrame([("s1", "RFU10", 1.0), ("s1", "RFU2", 2.0), ("s2", "RFU2", 3.0)], "sample string, rfu_label string, value double")
    assert io.export_matrix(long, str(tmp_path / "m.tsv"), row="sample", sep="\t") == ["RFU2", "RFU10"]
    back = {r["sample"]: (r["RFU2"], r["RFU10"]) for r in io.read_delimited(spark, str(tmp_path / "m.tsv")).collect()}
    assert back == {"s1": ("2.0", "1.0"), "s2": ("3.0", "0.0")}
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/a.json").write_text(json.dumps({"receptor_row_count": 10, "unique_query_count": 5}))
    (tmp_path / "runs/b.json").write_text(json.dumps({"qc": {"selected_receptor_row_count": 9}, "unique_queries": 3}, indent=1))
    got = sorted((r["receptor_rows"], r["unique_queries"], r["deduplication_ratio"]) for r in io.combine_manifests(spark, str(tmp_path / "runs/*.json")).collect())
    assert got == [(9, 3, 3.0), (10, 5, 2.0)]


def test_selective_read(spark):
    df = spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("c", 5, 6)], "k string, x int, y int")
    wanted = spark.createDataFrame([("c", 0), ("a", 1)], "k string, ordinal int")
    assert [tuple(r) for r in io.select_rows(df, key="k", columns=["y"], selected=wanted).orderBy("ordinal").collect()] == [("c", 0, 6), ("a", 1, 2)]
    assert [r["k"] for r in io.select_rows(df, key="k", max_rows=2, order_by="x").collect()] == ["a", "b"]
    for bad in ({"selected": spark.createDataFrame([("z", 0)], "k string, ordinal int")}, {"columns": ["z"]}, {"selected": wanted, "max_rows": 1}, {"max_rows": 1}):
        with pytest.raises(ValueError):
            io.select_rows(df, key="k", **bad)
