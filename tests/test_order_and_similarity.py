"""Order statistics, Gini and bounded similarity, held against plain computations."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clonoform.functions.fingerprints import digest, fingerprint, merged, row_text
from clonoform.functions.grouped import ranks, running_sums
from clonoform.functions.order_statistics import exact_quantiles, gini
from clonoform.operators import coverage, robustness, samples, similarity, tables

QS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.95, "e": 1.0}


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_quantiles_of_groups(spark, ranges):
    rng = np.random.default_rng(ranges)
    rows = [("hot", float(x)) for x in rng.normal(size=900)] + [("ties", float(x)) for x in rng.integers(0, 3, 100)] + [(None, 4.0), ("one", -0.0), ("one", 0.0), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: [r[c] for c in QS] for r in exact_quantiles(df, ["g"], "v", QS, ranges).collect()}
    assert set(got) == {"hot", "ties", None, "one"}
    for g, values in got.items():
        own = [v for k, v in rows if k == g and v is not None]
        assert values == pytest.approx(np.quantile(own, list(QS.values())).tolist())
    whole = exact_quantiles(df, [], "v", {"m": 0.5}, ranges).collect()
    assert [r["m"] for r in whole] == pytest.approx([float(np.median([v for _, v in rows if v is not None]))])
    assert exact_quantiles(df.limit(0), ["g"], "v", QS).collect() == []


def test_quantiles_must_be_shares(spark):
    with pytest.raises(ValueError, match="between 0 and 1"):
        exact_quantiles(spark.createDataFrame([(1, 1.0)], "g long, v double"), ["g"], "v", {"x": 1.5})


def test_one_group_is_ordered_in_ranges(spark):
    """No task orders more of a group than its range, and other ranges aren't ordered."""
    df = spark.range(20_000).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("v"))
    out = exact_quantiles(df, ["g"], "v", {"m": 0.5}, 16)
    assert out.first()["m"] == 9_999.5
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "median" not in plan


def test_gini_of_counts(spark):
    rng = np.random.default_rng(4)
    rows = [("a", int(n)) for n in rng.integers(1, 9, 200)] + [("b", 5)] * 7 + [(None, 3), (None, 9), ("z", 0)]
    got = {r["g"]: r["gini"] for r in gini(spark.createDataFrame(rows, "g string, n long"), ["g"], "n").collect()}
    for g, value in got.items():
        own = np.array([n for k, n in rows if k == g])
        want = np.abs(own[:, None] - own).sum() / (2 * len(own) * own.sum()) if own.sum() else 0.0
        assert value == pytest.approx(want, abs=1e-12)


# --- similar samples ------------------------------------------------------------------------
def matrix_of(spark, seed=1, n=60, rfus=300):
    rng = np.random.default_rng(seed)
    odds = 1 / np.arange(1, rfus + 1)
    rows = {}
    for s in range(n):
        if s % 4 and s > 4:  # near an earlier one
            own = dict(rows[s - s % 4])
            for r in rng.choice(sorted(own), max(1, len(own) // 8), replace=False):
                own[r] += int(rng.integers(1, 4))
        else:
            own = {int(r): int(rng.integers(1, 6)) for r in rng.choice(rfus, rng.integers(5, 40), replace=False, p=odds / odds.sum())}
        rows[s] = own
    data = [(f"s{s:03d}", f"RFU{r}", float(x)) for s, own in rows.items() for r, x in own.items()] + [("zzz", "RFU9999", 2.0), ("empty", "RFU1", 0.0)]
    return spark.createDataFrame(data, "sample string, rfu_label string, value double")


@pytest.fixture(scope="module")
def whole(spark):
    m = matrix_of(spark).cache()
    names = m.select("sample").distinct()
    return m, {k: {(r[0], r[1]): r[2] for r in samples.overlap(m, names, sample="sample", metric=k).collect()} for k in samples.OVERLAPS}


@pytest.mark.parametrize(("metric", "strict"), [(m, True) for m in samples.OVERLAPS] + [("jaccard", False), ("jensen_shannon_distance", False)])
def test_bounded_pairs_are_those_of_all_pairs(spark, whole, metric, strict):
    m, full = whole
    far = similarity.NOTHING_SHARED.get(metric, 0.0)
    distance = samples.direction(metric) == "distance"
    bound = (0.25 if strict else 0.79) if distance else (0.75 if strict else 0.1)
    df = similarity.similar_samples(m, sample="sample", metric=metric, bound=bound)
    got = {(r[0], r[1]): r[2] for r in df.collect()}
    want = {k: v for k, v in full[metric].items() if v is not None and (v <= bound if distance else v >= bound)}
    assert set(got) == set(want) and len(want) > 60
    assert all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError, match="exclude"):
        similarity.similar_samples(m, sample="sample", metric=metric, bound=far)


def test_crowded_rfus_are_joined_in_parts(spark, whole, monkeypatch):
    m, full = whole
    monkeypatch.setattr(samples, "MOST_TOGETHER", 4)
    got = {(r[0], r[1]): r[2] for r in similarity.similar_samples(m, sample="sample", metric="cosine", bound=0.5).collect()}
    assert set(got) == {k for k, v in full["cosine"].items() if v is not None and v >= 0.5}
    again = {(r[0], r[1]): r[2] for r in samples.overlap(m, m.select("sample"), sample="sample", metric="cosine").collect()}
    assert again.keys() == full["cosine"].keys() and all(v is None and full["cosine"][k] is None or math.isclose(v, full["cosine"][k], abs_tol=1e-9) for k, v in again.items())


@pytest.mark.parametrize("metric", ["jaccard", "cosine", "jensen_shannon_distance"])
def test_few_pairs_are_compared(spark, metric):
    m = matrix_of(spark, 3, 120, 3_000)
    x, totals = samples.abundances(m, sample="sample")
    share = similarity.least_share(metric, 0.2 if metric == "jensen_shannon_distance" else 0.7)
    own = similarity._prefixes(x, totals, metric, share)
    pairs = similarity._candidates(own, own, metric, share).where("a < b").count()
    assert pairs < 0.2 * 121 * 120 / 2


@pytest.mark.parametrize("metric", ["cosine", "overlap_coefficient", "jensen_shannon_distance"])
def test_nearest_samples_are_those_of_all_pairs(spark, whole, metric):
    m, full = whole
    sign = 1 if samples.direction(metric) == "distance" else -1
    near = {}
    for (a, b), v in full[metric].items():
        if a != b and v is not None and "empty" not in (a, b):
            near.setdefault(a, []).append((sign * round(v, 9), b))
            near.setdefault(b, []).append((sign * round(v, 9), a))
    got = similarity.nearest_samples(m, sample="sample", metric=metric, k=4).collect()
    assert {(r["query"], r["rank"]): r["other"] for r in got} == {(q, i + 1): o for q, own in near.items() for i, (_, o) in enumerate(sorted(own)[:4])}
    assert len(got) == 4 * 61


def test_nearest_of_few_samples(spark):
    m = spark.createDataFrame([("a", "RFU1", 1.0), ("b", "RFU1", 3.0), ("c", "RFU2", 1.0)], "sample string, rfu_label string, value double")
    got = {(r["query"], r["other"]): (r["rank"], round(r["value"], 6)) for r in similarity.nearest_samples(m, sample="sample", metric="jaccard", k=9).collect()}
    assert got == {("a", "b"): (1, 1.0), ("a", "c"): (2, 0.0), ("b", "a"): (1, 1.0), ("b", "c"): (2, 0.0), ("c", "a"): (1, 0.0), ("c", "b"): (2, 0.0)}
    assert similarity.nearest_samples(m.limit(0), sample="sample", k=2).collect() == []
    with pytest.raises(ValueError, match="positive"):
        similarity.nearest_samples(m, sample="sample", k=0)


# --- ranks, fingerprints, sparse z-scores -------------------------------------------------------
@pytest.mark.parametrize("buckets", [1, 7])
def test_ranks_of_groups(spark, buckets):
    rows = [("hot" if i % 10 else None, f"k{i * 7 % 100:03d}") for i in range(100)]
    got = ranks(spark.createDataFrame(rows, "g string, k string"), ["g"], ["k"], buckets).collect()
    for g in ("hot", None):
        own = sorted(k for h, k in rows if h == g)
        assert {r["k"]: r["__rank"] for r in got if r["g"] == g} == {k: i + 1 for i, k in enumerate(own)}


def test_fingerprints_merge(spark):
    rows = [(i % 3, f"t{i}", None if i % 5 else i) for i in range(60)]
    df = spark.createDataFrame(rows, "part int, t string, n int")
    text = row_text(["t", "n"])
    whole = fingerprint(df, text).first()
    assert whole == fingerprint(df.repartition(7).orderBy("t"), text).first()
    assert merged(fingerprint(df, text, ["part"])).first() == whole
    assert fingerprint(df.union(df.limit(1)), text).first()["limbs"] != whole["limbs"]
    ids = {fingerprint(spark.createDataFrame([r], "t string, n int"), text).select(digest(F.col("limbs"))).first()[0] for r in [("a", None), ("a-", None), (None, 1), ("", 1), ("a1:", None), ("a", 1)]}
    assert len(ids) == 6
    assert merged(fingerprint(df.limit(0), text, ["part"])).first()["limbs"] == ["0"] * 8
    limbs = [sum(int(hashlib.sha256(f"{len(t)}:{t}{'-' if n is None else f'{len(str(n))}:{n}'}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for _, t, n in rows) for i in range(8)]
    assert whole["limbs"] == [str(x) for x in limbs]


def test_frozen_reference_from_parts(spark):
    rows = [(i, [i / 7, -i / 3], i % 2) for i in range(9)]
    df = spark.createDataFrame(rows, "rfu_id int, vec array<double>, half int")
    whole = coverage.reference_fingerprint(df, "p").first()
    assert coverage.frozen_id(coverage.reference_parts(df, ["half"]), "p").first() == whole
    assert coverage.reference_fingerprint(df, "q").first() != whole and whole["n_rfus"] == 9


@pytest.mark.parametrize("top", [2, None])
def test_zscores_of_sparse_entries(spark, top):
    sparse = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 3.0), ("a", "y", 2.0), ("b", "y", 2.0), ("c", "y", 2.0), ("c", "w", 0.5)], "sample string, rfu_label string, value double")
    names = sparse.select("sample").distinct()
    dense = names.join(sparse.select("rfu_label").distinct(), F.lit(True)).join(sparse, ["sample", "rfu_label"], "left").na.fill(0.0, ["value"])
    order = lambda df: sorted((r["sample"], r["rfu_label"], r["value"], round(r["z"], 12)) for r in df.collect())
    assert order(tables.sparse_zscore(sparse, names, sample="sample", top_n=top)) == order(tables.rfu_zscore(dense, top))


@pytest.mark.parametrize("buckets", [1, 3, 20])
def test_running_sums_of_groups(spark, buckets):
    rows = [("hot", i, (i * 7) % 11) for i in range(300)] + [(None, 1, 5), (None, 2, None), ("none", 1, None), ("one", 9, 4)]
    got = {(r["g"], r["k"]): (r["__upto"], r["__total"]) for r in running_sums(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"], "v", buckets).collect()}
    for g, k, _ in rows:
        own = [v for h, j, v in rows if h == g and v is not None]
        upto = [v for h, j, v in rows if h == g and j <= k and v is not None]
        if g != "none":
            assert got[g, k] == (sum(upto), sum(own))
    assert got["none", 1][1] is None and len(got) == len(rows)


# --- samples that hold most rows -----------------------------------------------------------------
def test_subsample_of_a_large_sample(spark):
    rows = [("hot", i) for i in range(3_000)] + [("few", i) for i in range(3)] + [(None, i) for i in range(40)]
    df = spark.createDataFrame(rows, "s string, u long")
    got = [tuple(r) for r in robustness.subsample(df, sample="s", unit="u", n=25, seed=4).collect()]
    order = lambda u: (hashlib.md5(f"4|{u}".encode()).hexdigest(), u)
    want = [(s, u) for s in ("hot", "few", None) for u in sorted((u for t, u in rows if t == s), key=order)[:25]]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert robustness.subsample(df, sample="s", unit="u", n=0).count() == 0
    assert robustness.subsample(df.limit(0), sample="s", unit="u", n=5).count() == 0


@pytest.mark.parametrize("together", [7, 100, 10_000])
def test_resampling_is_alike_however_samples_are_cut(spark, together):
    rng = np.random.default_rng(3)
    rows = [("hot", f"f{i:03}", int(n)) for i, n in enumerate(rng.geometric(0.2, 200))] + [("hot", "zero", 0), ("one", "f000", 4), ("empty", "f000", 0), (None, "f000", 2)]
    df = spark.createDataFrame(rows, "s string, f string, n long")
    got = {(r["__seed"], r["s"], r["f"]): r["n"] for r in robustness._resampled(df, "s", "f", "n", 60, [5, 6], together).collect()}
    want: dict = {}
    for seed in (5, 6):
        for s in ("hot", "one"):
            own = sorted((f, n) for t, f, n in rows if t == s)
            ends = np.cumsum([n for _, n in own])
            for draw in range(1, 61):
                at = int(hashlib.md5(f"{seed}|{s}|{draw}".encode()).hexdigest()[:13], 16) / (1 << 52)
                f = own[int(np.searchsorted(ends / ends[-1], at, side="right"))][0]
                want[seed, s, f] = want.get((seed, s, f), 0) + 1
    assert got == want
