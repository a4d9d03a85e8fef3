"""Assignment, metrics, samples, phenotypes and sequences on small hand-calculated frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clonoform.operators import assign, longitudinal, metrics, phenotype, robustness, samples, tables

ROWS = [
    ("c1", "s1", "A", "CAF", "RFU1", True, "k1", 1),
    ("c2", "s1", "A", "CAF", "RFU1", False, "k1", 2),
    ("c2", "s1", "A", "CSF", "RFU1", None, "k2", 3),
    ("c3", "s1", "A", "CTF", "RFU2", True, None, 4),
    ("c4", "s2", "B", "CAF", "RFU1", True, None, 5),
    ("c5", "s2", "B", "CGGF", "RFU10", False, None, 6),
    ("c6", "s2", "B", None, None, None, None, 7),
    ("c7", "s3", None, "CXF", None, None, None, 8),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "cell_id string, sample string, phenotype string, cdr3aa string, rfu_label string, pass_thr boolean, clonotype_id string, ord long")


def by(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r.asDict() for r in df.collect()}


def test_rfu_metrics(rows):
    got = by(metrics.rfu_metrics(rows, groupby="phenotype", weighting="cell", order_by="ord", donor="sample"), "phenotype", "rfu_label")
    r = got["A", "RFU1"]
    assert (r["rfu_cell_count"], r["unique_cdr3_richness"], r["multiplicity"]) == (2, 2, 1.5)
    assert r["rfu_cell_abundance"] == pytest.approx(2 / 3) and r["sequence_convergence_ratio"] == pytest.approx(2 / 3)
    assert r["clonotype_entropy"] == pytest.approx(-(2 / 3) * math.log(2 / 3) - (1 / 3) * math.log(1 / 3))
    assert r["dominant_clonotype_fraction"] == pytest.approx(2 / 3) and r["threshold_pass_rate"] == 0.5
    assert (r["donor_count"], r["group_donor_count"], r["donor_prevalence"]) == (1, 1, 1.0)
    assert set(got) == {("A", "RFU1"), ("A", "RFU2"), ("B", "RFU1"), ("B", "RFU10")}
    strict = by(metrics.rfu_metrics(rows, groupby="phenotype", weighting="unique_sequence", order_by="ord", assignment_policy="threshold_pass"), "phenotype", "rfu_label")
    assert set(strict) == {("A", "RFU1"), ("A", "RFU2"), ("B", "RFU1")} and strict["A", "RFU1"]["weighted_abundance"] == 0.5
    for bad in ({"weighting": "x"}, {"groupby": []}, {"assignment_policy": "x"}):
        with pytest.raises(ValueError):
            metrics.rfu_metrics(rows, **{"groupby": "phenotype", "weighting": "cell", "order_by": "ord"} | bad)


def test_repertoire_metrics(rows):
    got = by(metrics.repertoire_metrics(rows, groupby="sample", weighting="cell", order_by="ord"), "sample")
    a, b, c = got["s1"], got["s2"], got["s3"]
    assert (a["diversity_identity"], a["clonotype_richness"], a["receptor_bearing_row_count"]) == ("clonotype_id", 2, 4)
    assert a["dominant_clonotype_fraction"] == pytest.approx(2 / 3) and a["simpson_diversity"] == pytest.approx(4 / 9)
    assert (b["clonotype_fallback"], b["clonotype_richness"], b["unique_cdr3_richness"], b["mean_cdr3aa_length"]) == (True, None, 2, 3.5)
    assert b["gini_clonality"] == pytest.approx(0) and c["shannon_entropy"] == 0
    with pytest.raises(ValueError):
        metrics.repertoire_metrics(rows, groupby="sample", weighting="rows", order_by="ord")


def test_summary(rows):
    scored = rows.withColumn("rfu_score", F.col("ord") / 10)
    got = by(metrics.rfu_summary(scored, "phenotype"), "phenotype")
    assert (got["A"]["n_cells"], got["A"]["top_rfu"], got["A"]["top_rfu_count"], got["A"]["median_rfu_score"]) == (4, "RFU1", 3, 0.25)
    assert got["B"]["top_rfu"] == "RFU1" and got[None]["n_assigned"] == 0 and got[None]["top_rfu"] is None
    assert metrics.rfu_summary(scored).first()["n_unique_rfu"] == 3


def matrix(spark):
    return spark.createDataFrame([("a", "x", 1.0), ("b", "x", 1.0), ("b", "y", 2.0)], "sample string, rfu_label string, value double")


@pytest.mark.parametrize(
    ("metric", "value"),
    [
        ("jaccard", 0.5), ("sorensen_dice", 2 / 3), ("overlap_coefficient", 1.0), ("cosine", 1 / math.sqrt(5)), ("bray_curtis_dissimilarity", 0.5),
        ("bray_curtis_similarity", 0.5), ("weighted_jaccard", 1 / 3),
        ("jensen_shannon_distance", math.sqrt(0.5 * (math.log(1 / (2 / 3)) + (1 / 3) * math.log((1 / 3) / (2 / 3)) + (2 / 3) * math.log(2)))),
    ],
)
def test_overlap(spark, metric, value):
    people = spark.createDataFrame([("a",), ("b",), ("z",)], "sample string")
    got = {(r[0], r[1]): r[2] for r in samples.overlap(matrix(spark), people, sample="sample", metric=metric).collect()}
    assert got["a", "b"] == pytest.approx(value) and len(got) == 6
    assert got["z", "z"] is None
    assert got["a", "a"] == pytest.approx(0 if samples.direction(metric) == "distance" else 1)
    with pytest.raises(ValueError):
        samples.overlap(matrix(spark).withColumn("value", F.lit(-1.0)), people, sample="sample")
    with pytest.raises(ValueError):
        samples.overlap(matrix(spark), people, sample="sample", normalize="proportion")


def test_pseudobulk(rows, spark):
    out = samples.pseudobulk(rows, sample="sample", phenotypes=["phenotype"])
    assert {(r["sample"], r["rfu_label"], r["n"]) for r in out.matrix.collect()} == {("s1", "RFU1", 2), ("s1", "RFU2", 1), ("s2", "RFU1", 1), ("s2", "RFU10", 1)}
    assert out.sample_metadata.count() == 3 and by(out.qc, "sample")["s3"]["passes_minimum"] is False
    one = samples.pseudobulk(rows, sample="sample", min_prevalence=1)
    share = samples.pseudobulk(rows, sample="sample", min_prevalence=1.0)
    assert one.rfu_metadata.count() == 3 and share.rfu_metadata.count() == 0
    clr = by(samples.densify(samples.pseudobulk(rows, sample="sample", normalize="clr"), "sample"), "sample", "rfu_label")
    mean = (math.log(2.5) + math.log(1.5) + math.log(0.5)) / 3
    assert clr["s1", "RFU1"]["value"] == pytest.approx(math.log(2.5) - mean) and clr["s1", "RFU10"]["value"] == pytest.approx(math.log(0.5) - mean)
    for bad, error in (({"min_prevalence": True}, TypeError), ({"min_prevalence": 1.5}, ValueError), ({"normalize": "x"}, ValueError), ({"pseudocount": 0}, ValueError)):
        with pytest.raises(error):
            samples.pseudobulk(rows, sample="sample", **bad)
    with pytest.raises(ValueError, match="conflicting"):
        samples.pseudobulk(rows.withColumn("p", F.col("cell_id")), sample="sample", phenotypes=["p"])


def test_coupling(rows):
    got = by(phenotype.phenotype_coupling(rows, phenotype="phenotype", sample="sample"), "rfu_label", "phenotype")
    r = got["RFU1", "A"]
    assert (r["total_abundance"], r["phenotype_specific_abundance"], r["dominant_phenotype"], r["sample_recurrence_count"]) == (3, 2, "A", 2)
    assert r["sample_prevalence"] == pytest.approx(2 / 3) and got["RFU2", "B"]["phenotype_specific_abundance"] == 0
    assert got["RFU2", "A"]["phenotype_specificity"] == 1.0 and len(got) == 6


def test_sequence_matrix(spark):
    rows = spark.createDataFrame([("c1", "CAF", "R", "k1"), ("c2", "CAF", "R", "k1"), ("c3", "cassw", "R", "k1")], "cell_id string, cdr3aa string, rfu_label string, clonotype_id string")
    got = {(r["position"], r["residue"]): r["frequency"] for r in phenotype.sequence_matrix(rows, rfu="R").collect()}
    assert got[1, "C"] == 1 and got[3, "-"] == 0.5 and got[5, "F"] == 0.5 and len(got) == 5 * 21
    cell = {(r["position"], r["residue"]): r["frequency"] for r in phenotype.sequence_matrix(rows, rfu="R", weighting="cell", include_gap=False).collect()}
    assert cell[5, "F"] == pytest.approx(2 / 3) and cell[3, "S"] == 1 and len(cell) == 5 * 20
    with pytest.raises(ValueError, match="invalid"):
        phenotype.sequence_matrix(rows.withColumn("cdr3aa", F.lit("CX1")))
    with pytest.raises(ValueError, match="clonotype"):
        phenotype.sequence_matrix(rows.withColumn("clonotype_id", F.lit(None).cast("string")), weighting="clonotype")


def reference(spark, rng):
    letters = "ACDE"
    trimers = [a + b + c for a in letters for b in letters for c in letters][:50]
    t = spark.createDataFrame([(x, rng.normal(size=8).tolist()) for x in trimers], "trimer string, vec array<double>")
    c = spark.createDataFrame([(i + 1, rng.normal(size=8).tolist()) for i in range(6)], "rfu_id int, vec array<double>")
    return t, c


def test_assignment_equals_plain_spearman(spark):
    rng = np.random.default_rng(2)
    t, c = reference(spark, rng)
    seqs = ["CA" + "".join(rng.choice(list("ACDE"), rng.integers(3, 9))) + "EQYF" for _ in range(40)] + ["CAEEEEQYF", "CASF", "CAWWWWWEQYF"]
    rows = spark.createDataFrame([(s, f"V{i}", i) for i, s in enumerate(seqs + seqs[:5] + ["ASSF", None])], "cdr3aa string, v_call string, source_order long").withColumn("chain", F.lit("TRB"))
    out = assign.call_rfus(rows, assign.spearman_scorers(t, c), threshold=0.3)
    vectors = {r["trimer"]: r["vec"] for r in t.collect()}
    centres = {r["rfu_id"]: pd.Series(r["vec"]).rank() for r in c.collect()}
    got = by(out.per_sequence, "cdr3aa")
    assert set(got) == {s for s in seqs}
    for s, r in got.items():
        known = [vectors[s[i : i + 3]] for i in range(2, len(s) - 6) if s[i : i + 3] in vectors]
        if not known:
            assert r["rfu_id"] is None and r["assignment_status"] == "upstream_unassigned"
            continue
        mine = pd.Series(np.mean(known, axis=0)).rank()
        rho = {i: round(float(np.corrcoef(mine, x)[0, 1]), 9) for i, x in centres.items()}
        best = max(rho, key=lambda i: (rho[i], -i))
        assert (r["rfu_id"], r["rfu_label"]) == (best, f"RFU{best}") and r["rfu_score"] == pytest.approx(rho[best]) and r["pass_thr"] == (rho[best] >= 0.3)
    assert got[seqs[0]]["multiplicity"] == 2 and got[seqs[0]]["query_v_call"] == "V0"
    split = assign.spearman_scorers(t, c, most_numbers=400)
    assert len(split) == 1
    blocks = [assign._scorer(t, t.collect(), c.where(f"rfu_id % 3 = {k}"), 2, 4) for k in range(3)]
    assert by(assign.score(out.per_sequence, blocks), "cdr3aa") == by(assign.score(out.per_sequence, split), "cdr3aa")
    assert out.per_row.count() == rows.count() and out.mapping.where("assignment_status = 'missing_sequence'").count() == 1
    with pytest.raises(ValueError):
        assign.call_rfus(rows, assign.spearman_scorers(t, c), chain="TRA")


def test_reconstruction_refuses_wrong_results(spark):
    rows = spark.createDataFrame([("CAF", 1)], "cdr3aa string, source_order long")
    fields = "cdr3aa string, unique_sequence_id string, rfu_id int, rfu_label string, rfu_score double, pass_thr boolean"
    for bad in ([], [("CAF", "a", 1, "RFU1", 0.5, True)] * 2, [("CAF", "a", 1, "RFU1", 0.5, True), ("CGF", "b", 1, "RFU1", 0.5, True)]):
        with pytest.raises(ValueError):
            assign.reconstruct(rows, spark.createDataFrame(bad, fields))


def test_incremental_assignment_reuses_scores(spark):
    t, c = reference(spark, np.random.default_rng(2))
    queries = spark.createDataFrame([("CAACDEEQYF",), ("CAEDCAAEQYF",)], "cdr3aa string")
    store = spark.createDataFrame([("r", "CAACDEEQYF", 99, 0.9)], "reference_id string, cdr3aa string, rfu_id int, rfu_score double")
    got = by(assign.assign_incremental(queries, store, assign.spearman_scorers(t, c), "r"), "cdr3aa")
    assert (got["CAACDEEQYF"]["rfu_id"], got["CAACDEEQYF"]["reused"], got["CAEDCAAEQYF"]["reused"]) == (99, True, False)
    fresh = by(assign.assign_incremental(queries, store, assign.spearman_scorers(t, c), "r", force=True), "cdr3aa")
    assert fresh["CAACDEEQYF"]["rfu_id"] != 99 and not fresh["CAACDEEQYF"]["reused"]


def test_tables(spark):
    dense = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0), ("b", "y", 2.0)], "sample string, rfu_label string, value double")
    got = by(tables.rfu_zscore(dense), "sample", "rfu_label")
    assert (got["a", "x"]["z"], got["b", "x"]["z"], got["a", "y"]["z"]) == (-1.0, 1.0, 0.0)
    hist = by(tables.score_histogram(dense.select(F.col("value").alias("rfu_score")), 2), "bin")
    assert (hist[0]["n"], hist[1]["n"]) == (1, 3)
    assert [r[0] for r in tables.top_rfus(dense.withColumn("rfu_label", F.concat(F.lit("RFU"), F.when(F.col("rfu_label") == "x", 10).otherwise(2))), 1).collect()] == ["RFU2"]
    with pytest.raises(ValueError):
        tables.rfu_zscore(dense, 0)


def test_results_do_not_depend_on_order(rows):
    a = metrics.repertoire_metrics(rows, groupby="sample", weighting="clonotype", order_by="ord")
    b = metrics.repertoire_metrics(robustness.shuffled(rows, "cell_id", 3), groupby="sample", weighting="clonotype", order_by="ord")
    assert by(a, "sample") == by(b, "sample")


def test_longitudinal_checks(spark):
    rows = spark.createDataFrame([("s1", "d1", 1), ("s1", "d2", 1)], "sample string, donor string, time int")
    with pytest.raises(ValueError):
        longitudinal.design(rows, sample="sample", donor="donor", time="time")
    with pytest.raises(ValueError):
        longitudinal.design(rows.withColumn("time", F.lit("v1")), sample="sample", donor="donor", time="time")
    boot = longitudinal.donor_bootstrap(rows.withColumn("x", F.lit(2.0)), donor="donor", value="x", replicates=9)
    assert {r["statistic"] for r in boot.collect()} == {2.0} and boot.count() == 9
    assert longitudinal.interval(boot).first()["low"] == 2.0


def test_comparators(rows):
    assert robustness.list_comparators() == ["cdr3", "cdr3_length", "clonotype", "rfu", "v_gene"]
    got = by(robustness.representation(rows, "cdr3_length", "sample"), "sample", "feature")
    assert got["s2", "4"]["value"] == 0.5
    with pytest.raises(ValueError):
        robustness.representation(rows, "none")
    with pytest.raises(ValueError):
        robustness.register_comparator("rfu", lambda r, s: r)


def test_overlap_is_alike_however_rfus_are_cut(spark, monkeypatch):
    cells = [(f"s{i}", f"RFU{j}", float((i * 7 + j * 3) % 5)) for i in range(9) for j in range(4)]
    matrix = spark.createDataFrame(cells, "s string, rfu_label string, value double")
    own = matrix.select("s").distinct()
    whole = {m: sorted(map(tuple, samples.overlap(matrix, own, sample="s", metric=m).collect())) for m in ("cosine", "jensen_shannon_distance")}
    monkeypatch.setattr(samples, "MOST_TOGETHER", 2)
    for m, want in whole.items():
        got = sorted(map(tuple, samples.overlap(matrix, own, sample="s", metric=m).collect()))
        assert [r[:2] for r in got] == [r[:2] for r in want] and len(got) == 45
        assert all(a[2] == b[2] or abs(a[2] - b[2]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_trimers_too_wide_to_broadcast_are_joined(spark):
    rng = np.random.default_rng(3)
    names = [a + b + c for a in "SLGQ" for b in "SLGQ" for c in "LGQE"]
    trimers = spark.createDataFrame([(n, rng.normal(size=8).tolist()) for n in names], "trimer string, vec array<double>")
    centroids = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(1, 12)], "rfu_id int, vec array<double>")
    queries = spark.createDataFrame([(q,) for q in ("CASSLGQETQYF", "CASSLLGGEETQYF", "CAF", "CASS\u00e9GQETQYF", "CAWWWWWETQYF")], "cdr3aa string")
    small = assign.spearman_scorers(trimers, centroids)
    wide = assign.spearman_scorers(trimers, centroids, most_numbers=40)
    assert isinstance(wide[0], assign.WideScorer) and len(wide) == 3
    a, b = (sorted(map(tuple, assign.score(queries, s).collect()), key=str) for s in (small, wide))
    assert a == b and sum(r[1] is not None for r in a) >= 2
