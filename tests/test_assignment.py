"""Assignment: exact pruning of centroids, and the store of known scores."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clonoform.operators import assign


# --- nearest centroid with pruning -----------------------------------------------------------
def _brute(queries, ids, centres):
    best, value = [], []
    for lo in range(0, len(queries), 50):
        rho = np.round(queries[lo : lo + 50] @ centres.T, 9)
        rho[np.isnan(rho)] = -np.inf
        top = rho.max(axis=1)
        best += [int(ids[r == t].min()) for r, t in zip(rho, top, strict=True)]
        value += top.tolist()
    return best, value


@pytest.mark.parametrize(("n", "spread", "most"), [(1, 0.1, 2.0), (7, 0.1, 2.0), (2_000, 0.15, 0.25), (200_000, 0.15, 0.1), (3_000, 9.0, 1.1)])
def test_pruned_search_equals_brute_force(n, spread, most):
    rng = np.random.default_rng(n)
    seeds = rng.standard_normal((max(1, math.isqrt(n)), 32))
    rows = seeds[rng.integers(0, len(seeds), n)] + spread * rng.standard_normal((n, 32))
    rows[n // 2] = rows[0]  # a tie
    centres, ids = assign.unit_ranks(rows), rng.permutation(n) + 1
    queries = assign.unit_ranks(np.vstack([seeds[rng.integers(0, len(seeds), 150)] + spread * rng.standard_normal((150, 32)), rows[:1]]))
    index = assign.CentroidIndex.build(ids, centres)
    best, value, compared = index.search(queries)
    want, score = _brute(queries, ids, centres)
    assert best.tolist() == want and value.tolist() == score
    assert compared <= most * n * len(queries)


def test_search_without_directions():
    flat = assign.unit_ranks(np.ones((3, 4)))
    index = assign.CentroidIndex.build(np.array([1, 2, 3]), flat)
    assert len(index.ids) == 0 and np.isnan(index.search(flat)[1]).all()
    own = assign.unit_ranks(np.arange(8.0).reshape(2, 4))
    best, value, _ = assign.CentroidIndex.build(np.array([5, 4]), own).search(np.vstack([flat[:1], own[:1]]))
    assert best.tolist() == [-1, 4] and np.isnan(value[0]) and value[1] == 1.0


def test_share_of_comparisons(spark):
    rng = np.random.default_rng(8)
    seeds = rng.standard_normal((30, 16))
    rows = [(f"C{i}", [float(x) for x in seeds[i % 30] + 0.1 * rng.standard_normal(16)]) for i in range(300)]
    vectors = spark.createDataFrame(rows, "cdr3aa string, vec array<double>")
    centroids = spark.createDataFrame([(i + 1, v) for i, (_, v) in enumerate(rows)] * 1, "rfu_id int, vec array<double>")
    got = assign.comparison_share(vectors, centroids).first()
    assert (got["n_queries"], got["n_centroids"]) == (300, 300) and got["share"] < 0.5


def test_incremental_reads_the_store_once(spark):
    queries = spark.createDataFrame([("q1", "CA"), ("q2", "CB"), ("q3", "CA")], "unique_sequence_id string, cdr3aa string")
    store = spark.createDataFrame([("r", "CA", 3, 0.7), ("r", "CA", 3, 0.7), ("old", "CB", 9, 0.9), ("r", "CZ", 1, 0.1)], "reference_id string, cdr3aa string, rfu_id int, rfu_score double")

    def two(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([2] * len(b), pa.int32()), pa.array([0.5] * len(b))], assign.SCORED.names)

    for force, want in ((False, [("q1", 3, True), ("q2", 2, False), ("q3", 3, True)]), (True, [("q1", 2, False), ("q2", 2, False), ("q3", 2, False)])):
        got = assign.assign_incremental(queries, store, [two], "r", force=force).collect()
        assert sorted((r["unique_sequence_id"], r["rfu_id"], r["reused"]) for r in got) == want


def test_a_large_store_is_filtered_by_the_batch(spark, tmp_path):
    spark.range(50_000).select(F.lit("r").alias("reference_id"), F.concat(F.lit("C"), F.col("id")).alias("cdr3aa"), F.lit(1).alias("rfu_id"), F.lit(0.5).alias("rfu_score")).write.parquet(str(tmp_path / "store"))
    spark.range(20).select(F.concat(F.lit("C"), F.col("id")).alias("cdr3aa")).write.parquet(str(tmp_path / "batch"))
    store, batch = spark.read.parquet(str(tmp_path / "store")), spark.read.parquet(str(tmp_path / "batch"))
    conf = {"spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1k", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        known = assign.known_scores(store, batch)
        plan, n = known._jdf.queryExecution().optimizedPlan().toString(), known.count()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert "might_contain" in plan and n == 20
