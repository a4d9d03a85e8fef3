"""Similar samples without comparing all pairs: bounds and nearest neighbours.

The RFUs of a sample are ordered from the rarest on. Two samples whose metric is within a bound
share a certain part of either one's mass, so the first RFU that they share comes before what
is left of the sample falls below that part. Only these prefixes are joined; the pairs that meet,
and whose totals allow the bound, are then compared on all of their RFUs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.operators.samples import OVERLAPS, abundances, direction, in_parts, pair_value, shared_sums
from clonoform.sources.staging import stage

#: What the value of two samples without a common RFU is.
NOTHING_SHARED = {"bray_curtis_dissimilarity": 1.0, "jensen_shannon_distance": math.sqrt(math.log(2.0))}
#: Against rounding, by which a part of the mass may seem a little smaller than it is.
SLACK = 1e-9
#: The bounds that ``nearest_samples`` tries one after the other, as shares of what lies
#: between the metric's value for equal samples and that for samples with nothing in common.
STEPS = (0.8, 0.5, 0.2)


def least_share(metric: str, bound: float) -> float:
    """The least part of a sample's mass that a sample within the bound shares with it.

    Jaccard (plain and weighted): the overlap is at least t times the union, hence t of each.
    Dice and Bray-Curtis: 2 o >= t (x + y) and y >= o give o >= t / (2 - t) x. Overlap
    coefficient: t of the smaller. Cosine: by Cauchy-Schwarz the squares of the shared part
    are at least t squared of all. Jensen-Shannon: d squared is at least half the squared
    total variation (Pinsker's inequality for both halves), so shares have 1 - sqrt(2) d in common.
    """
    if metric in ("jaccard", "weighted_jaccard", "overlap_coefficient"):
        share = bound
    elif metric == "cosine":
        share = bound * bound
    elif metric == "jensen_shannon_distance":
        share = 1 - math.sqrt(2.0) * bound
    else:
        t = 1 - bound if metric == "bray_curtis_dissimilarity" else bound
        share = t / (2 - t)
    return max(share, 0.0)


def _mass(metric: str) -> tuple[Column, Column]:
    """An entry's mass and the sample's."""
    if metric in ("jaccard", "sorensen_dice", "overlap_coefficient"):
        return F.lit(1.0), F.col("k").cast("double")
    return (F.col("x") * F.col("x"), F.col("q")) if metric == "cosine" else (F.col("x"), F.col("t"))


def _prefixes(x: DataFrame, totals: DataFrame, metric: str, share: float) -> DataFrame:
    """The entries with their sample's totals and whether they are in its prefix."""
    mass, total = _mass(metric)
    often = x.groupBy("r").agg(F.count(F.lit(1)).alias("often"))
    # a sample has at most one entry for each RFU of the reference
    rest = Window.partitionBy("s").orderBy(F.desc("often"), F.desc("r")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = x.join(often, "r").join(totals, "s")
    return both.withColumn("prefix", F.sum(mass).over(rest) >= total * (share - SLACK)).drop("often")


def _within(metric: str, bound: float) -> Column:
    return F.col("value") <= bound if direction(metric) == "distance" else F.col("value") >= bound


def _candidates(left: DataFrame, right: DataFrame, metric: str, share: float) -> DataFrame:
    """Pairs (a, b) whose prefixes meet and whose totals allow the bound."""
    a, b = (df.select(F.col("s").alias(n), "r", *[F.col(c).alias(f"{c}{n}") for c in ("t", "k", "prefix")]) for df, n in ((left, "a"), (right, "b")))
    c = F.col
    meets = c("prefixa") & c("prefixb")
    if metric == "overlap_coefficient":  # only the smaller one's mass is bounded
        meets = F.when(c("ka") < c("kb"), c("prefixa")).when(c("ka") > c("kb"), c("prefixb")).otherwise(c("prefixa") | c("prefixb"))
    else:
        a, b = a.where("prefixa"), b.where("prefixb")
    size = "k" if metric in ("jaccard", "sorensen_dice") else "t"
    sized = F.lit(True)
    if metric not in ("overlap_coefficient", "cosine", "jensen_shannon_distance"):
        sized = F.least(f"{size}a", f"{size}b") >= F.greatest(f"{size}a", f"{size}b") * (share - SLACK)
    a, b = in_parts(a, b, "r")
    return a.join(b, ["r", "part"]).where(meets & sized).select("a", "b").distinct()


def _compared(pairs: DataFrame, x: DataFrame, totals: DataFrame, metric: str) -> DataFrame:
    """a, b, value of the given pairs, from all of their RFUs."""
    one = lambda n: x.select(F.col("s").alias(n), "r", F.col("x").alias(f"x{n}"))
    own = lambda n: totals.select(F.col("s").alias(n), *[F.col(c).alias(f"{c}{n}") for c in "tkq"])
    sized = pairs.join(own("a"), "a").join(own("b"), "b")
    keys = ["a", "b", *[f"{c}{n}" for n in "ab" for c in "tkq"]]
    shared = sized.join(one("a"), "a").join(one("b"), ["b", "r"]).groupBy(*keys).agg(*shared_sums())
    return shared.select("a", "b", pair_value(metric).alias("value"))


def _check(metric: str, bound: float | None = None) -> None:
    if metric not in OVERLAPS:
        raise ValueError(f"metric must be one of {OVERLAPS}")
    nothing = NOTHING_SHARED.get(metric, 0.0)
    if bound is not None and not (bound < nothing if direction(metric) == "distance" else bound > nothing):
        raise ValueError(f"samples with nothing in common have {metric} {nothing:.4g}; the bound must exclude them")


def similar_samples(matrix: DataFrame, *, sample: str, metric: str = "jaccard", bound: float, rfu: str = "rfu_label", value: str = "value", min_abundance: float = 1, normalize: str = "count") -> DataFrame:
    """(sample_a, sample_b, value) of the pairs a <= b whose similarity is at least ``bound``
    (whose distance is at most ``bound``): those rows of ``overlap``, without comparing all
    pairs. A bound that samples with nothing in common meet raises."""
    _check(metric, bound)
    x, totals = abundances(matrix, sample=sample, rfu=rfu, value=value, min_abundance=min_abundance, normalize=normalize)
    share = least_share(metric, bound)
    own = stage(_prefixes(x, totals, metric, share), "overlap-prefixes")
    pairs = _candidates(own, own, metric, share).where("a <= b")
    return _compared(pairs, x, totals, metric).where(_within(metric, bound)).select(F.col("a").alias("sample_a"), F.col("b").alias("sample_b"), "value")


def nearest_samples(matrix: DataFrame, *, sample: str, metric: str = "cosine", k: int = 5, rfu: str = "rfu_label", value: str = "value", min_abundance: float = 1, normalize: str = "count") -> DataFrame:
    """(query, other, value, rank): the ``k`` nearest other samples of each sample that has
    entries, by value to nine digits and then by name.

    Bounds are loosened step by step: a sample with k others strictly within a bound is done,
    only the rest go on. At the last step samples share any RFU; what is missing then are
    samples with nothing in common, in the order of names.
    """
    _check(metric)
    if k < 1:
        raise ValueError("k must be positive")
    x, totals = abundances(matrix, sample=sample, rfu=rfu, value=value, min_abundance=min_abundance, normalize=normalize)
    far, best = NOTHING_SHARED.get(metric, 0.0), 0.0 if direction(metric) == "distance" else 1.0
    order = F.round("value", 9) if direction(metric) == "distance" else -F.round("value", 9)
    top = Window.partitionBy("query").orderBy(order, "other")
    todo, out = totals.select("s"), None
    for step in (*STEPS, None):
        bound = far if step is None else far + step * (best - far)
        share = 0.0 if step is None else least_share(metric, bound)
        own = stage(_prefixes(x, totals, metric, share), "overlap-prefixes")
        pairs = _candidates(own.join(todo, "s", "left_semi"), own, metric, share).where("a <> b")
        found = _compared(pairs, x, totals, metric).select(F.col("a").alias("query"), F.col("b").alias("other"), "value")
        if step is None:
            names = F.broadcast(totals.select(F.col("s").alias("other")).orderBy("other").limit(2 * k + 1))
            rest = todo.join(names, F.col("s") != F.col("other")).select(F.col("s").alias("query"), "other", F.lit(far).alias("value"))
            found = found.unionByName(rest).groupBy("query", "other").agg((F.min if best < far else F.max)("value").alias("value"))
        # beyond the bound by more than what rounding to nine digits could hide
        sure = F.lit(True) if step is None else _within(metric, bound + (1e-8 if best > far else -1e-8))
        found = stage(found.where(sure).withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= k), "nearest-samples")
        done = found if step is None else found.join(found.where(F.col("rank") == k).select("query"), "query", "left_semi")
        out = done if out is None else out.unionByName(done)
        if step is not None:
            todo = stage(todo.join(found.where(F.col("rank") == k).select(F.col("query").alias("s")), "s", "left_anti"), "samples-to-do")
            if todo.isEmpty():
                break
    return out
