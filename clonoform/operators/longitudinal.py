"""Donors over time: design, matrices, similarity, dynamics, resampling. Definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.functions.grouped import join_groups, ranks, ratio, require, row_numbers
from clonoform.functions.order_statistics import exact_quantiles
from clonoform.sources.staging import stage


def seeded(*parts):
    """A hash that orders rows at random but alike everywhere: md5 of the joined parts."""
    return F.md5(F.concat_ws("|", *[p if not isinstance(p, (str, int)) else F.lit(str(p)) for p in parts]))


def design(rows: DataFrame, *, sample: str, donor: str, time: str, check: bool = True) -> DataFrame:
    """One row for each sample: donor, time, visit number and number of visits of the donor.
    Two donors or times for a sample, or text times, raise; repeated (donor, time) pairs are
    counted in ``n_same_visit``."""
    require(rows, [sample, donor, time], "longitudinal design")
    if dict(rows.dtypes)[time] == "string":
        raise ValueError("times must be numeric or explicitly ordered")
    own = rows.where(F.col(sample).isNotNull()).groupBy(sample).agg(F.min(donor).alias(donor), F.min(time).alias(time), F.count_distinct(donor).alias("__d"), F.count_distinct(time).alias("__t"))
    if check:
        odd = own.where("__d > 1 or __t > 1").limit(5).collect()
        if odd:
            raise ValueError(f"samples with two donors or times: {[r[0] for r in odd]}")
    w = Window.partitionBy(donor)
    return own.select(
        sample,
        donor,
        time,
        F.dense_rank().over(w.orderBy(time)).cast("long").alias("visit"),
        F.size(F.collect_set(time).over(w)).cast("long").alias("n_visits"),
        F.count(F.lit(1)).over(Window.partitionBy(donor, time)).alias("n_same_visit"),
    )


def longitudinal_matrix(matrix: DataFrame, plan: DataFrame, *, sample: str, donor: str, time: str) -> DataFrame:
    """The sparse sample x RFU matrix with each sample's donor and time; nothing imputed."""
    return matrix.join(plan.select(sample, donor, time), sample)


def missing_visits(plan: DataFrame, *, donor: str, time: str) -> DataFrame:
    """Donor and time pairs without a sample, over the times that occur at all."""
    grid = plan.select(donor).distinct().join(plan.select(time).distinct(), F.lit(True))
    return grid.join(plan.select(donor, time).distinct(), [donor, time], "left_anti")


def similarity_pairs(pairs: DataFrame, plan: DataFrame, *, sample: str, donor: str, time: str) -> DataFrame:
    """Pairs of different samples with their donors, whether these agree, and the time gap."""
    left = plan.select(F.col(sample).alias("sample_a"), F.col(donor).alias("donor_a"), F.col(time).alias("time_a"))
    right = plan.select(F.col(sample).alias("sample_b"), F.col(donor).alias("donor_b"), F.col(time).alias("time_b"))
    both = pairs.where("sample_a < sample_b").join(left, "sample_a").join(right, "sample_b")
    return both.select("sample_a", "sample_b", "value", "donor_a", "donor_b", (F.col("donor_a") == F.col("donor_b")).alias("same_donor"), F.abs(F.col("time_a") - F.col("time_b")).alias("time_gap"))


def summarize_similarity(pairs: DataFrame) -> DataFrame:
    """Mean, exact median and number of pairs within a donor and between donors."""
    own = stage(pairs.select("same_donor", "value"), "pair-values")
    out = own.groupBy("same_donor").agg(F.count("value").alias("n_pairs"), F.avg("value").alias("mean_value"))
    return join_groups(out, exact_quantiles(own, ["same_donor"], "value", {"median_value": 0.5}), ["same_donor"])


def _first_of_donor(ranked: DataFrame, k: int) -> DataFrame:
    out = ranked.groupBy("query").agg(F.count(F.lit(1)).alias("n_ranked"), F.min(F.when(F.col("same_donor"), F.col("rank"))).cast("long").alias("first_rank"))
    return out.withColumn("reciprocal_rank", F.coalesce(1.0 / F.col("first_rank"), F.lit(0.0))).withColumn("hit", F.coalesce(F.col("first_rank") <= k, F.lit(False)))


def donor_retrieval(pairs: DataFrame, k: int = 5) -> DataFrame:
    """For each query sample with a defined similarity: rank of the first sample of its
    donor (ties by sample name), its reciprocal, and whether it is among the first k. It ranks
    every pair; ``donor_retrieval_of`` needs only the nearest."""
    both = pairs.select(F.col("sample_a").alias("query"), F.col("sample_b").alias("other"), "value", "same_donor").unionByName(pairs.select(F.col("sample_b").alias("query"), F.col("sample_a").alias("other"), "value", "same_donor"))
    w = Window.partitionBy("query").orderBy(F.desc(F.round("value", 9)), "other")
    return _first_of_donor(both.where("value is not null").withColumn("rank", F.row_number().over(w)), k)


def donor_retrieval_of(nearest: DataFrame, plan: DataFrame, *, sample: str, donor: str, k: int = 5) -> DataFrame:
    """``donor_retrieval`` among each sample's nearest (``similarity.nearest_samples``):
    ranks beyond these are not known, so such samples have no first rank."""
    names = plan.select(F.col(sample).alias("__s"), F.col(donor).alias("__d"))
    query, other = (names.select(F.col("__s").alias(n), F.col("__d").alias(f"__{n}")) for n in ("query", "other"))
    both = nearest.join(query, "query").join(other, "other")
    return _first_of_donor(both.withColumn("same_donor", F.col("__query") == F.col("__other")), k)


def dynamics(long: DataFrame, plan: DataFrame, *, donor: str, time: str, rfu: str = "rfu_label") -> DataFrame:
    """Class of each donor and RFU over the donor's visits: persistent (all), emerging
    (absent at first, present at last), lost (the reverse), transient, or single_visit."""
    visits = plan.groupBy(donor).agg(F.count_distinct(time).alias("n_visits"), F.min(time).alias("__first"), F.max(time).alias("__last"))
    seen = long.where("value > 0").groupBy(donor, rfu).agg(F.count_distinct(time).alias("n_present"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
    both = seen.join(visits, donor)
    at_first, at_last = F.col("first_time") == F.col("__first"), F.col("last_time") == F.col("__last")
    kind = (
        F.when(F.col("n_visits") == 1, "single_visit")
        .when(F.col("n_present") == F.col("n_visits"), "persistent")
        .when(~at_first & at_last, "emerging")
        .when(at_first & ~at_last, "lost")
        .otherwise("transient")
    )
    return both.select(donor, rfu, "n_present", "n_visits", "first_time", "last_time", kind.alias("trajectory"))


def compartment_pairs(plan: DataFrame, *, sample: str, donor: str, time: str, compartment: str) -> DataFrame:
    """Samples of one donor and time in two compartments, a < b."""
    a = plan.select(donor, time, F.col(sample).alias("sample_a"), F.col(compartment).alias("compartment_a"))
    b = plan.select(donor, time, F.col(sample).alias("sample_b"), F.col(compartment).alias("compartment_b"))
    return a.join(b, [donor, time]).where("compartment_a < compartment_b")


def uniform(h) -> object:
    """A number in [0, 1) from the first 13 hex digits of a hash."""
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(1 << 52)


def donor_bootstrap(values: DataFrame, *, donor: str, value: str, replicates: int = 200, seed: int = 0) -> DataFrame:
    """Donor-block bootstrap of the mean of donor means: replicate, statistic. A replicate
    draws as many donors as there are, with replacement. Draws are made in parallel and
    counted by replicate and donor before they meet the donors' means."""
    means = values.where(F.col(donor).isNotNull()).groupBy(donor).agg(F.avg(value).alias("m"))
    numbered = row_numbers(means, [F.col(donor)]).select(F.col("__row").alias("slot"), "m")
    n = numbered.count()
    draws = means.sparkSession.range(replicates * n).select((F.floor(F.col("id") / max(n, 1)) + 1).cast("int").alias("replicate"), (F.col("id") % max(n, 1)).alias("draw"))
    pick = F.floor(uniform(seeded(seed, F.col("replicate").cast("string"), F.col("draw").cast("string"))) * n)
    drawn = draws.groupBy("replicate", pick.alias("slot")).agg(F.count(F.lit(1)).alias("w")).join(numbered, "slot")
    return drawn.groupBy("replicate").agg(ratio(F.sum(F.col("w") * F.col("m")), F.sum(F.when(F.col("m").isNotNull(), F.col("w")))).alias("statistic"))


def interval(statistics: DataFrame, level: float = 0.95) -> DataFrame:
    """Mean and percentile interval of bootstrap statistics."""
    low = (1 - level) / 2
    return statistics.agg(F.count(F.lit(1)).alias("n_replicates"), F.avg("statistic").alias("mean"), F.percentile("statistic", F.lit(low)).alias("low"), F.percentile("statistic", F.lit(1 - low)).alias("high"))


def shuffled_labels(units: DataFrame, *, unit: str, block: str, label: str, replicates: int, seed: int) -> DataFrame:
    """unit, block, labels: of each unit the labels that it gets in the replicates (a vector
    with a label each), shuffled inside its block.

    The i-th unit of a block gets the label of the block's unit with the i-th hash. Ranks
    come from sorted ranges, so a large block fills many tasks, and what meets by place is
    one row a unit, whatever the replicates.
    """
    own = units.select(unit, block, label)
    places = ranks(own.select(unit, block), [block], [unit])
    each = own.select(block, F.col(label).alias("__label"), unit, F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("__r"))
    hashed = each.withColumn("__h", seeded(seed, F.col("__r").cast("string"), F.col(unit)))
    by_hash = ranks(hashed, ["__r", block], ["__h", unit])
    vectors = by_hash.groupBy(block, "__rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__label"))), lambda x: x["__label"]).alias("labels"))
    return join_groups(places, vectors, [block, "__rank"], "inner").select(unit, block, "labels")


def permute_labels(units: DataFrame, *, unit: str, block: str, label: str, replicates: int = 20, seed: int = 0) -> DataFrame:
    """replicate, unit, block, label: labels shuffled inside each block, alike everywhere."""
    vectors = shuffled_labels(units, unit=unit, block=block, label=label, replicates=replicates, seed=seed)
    return vectors.select(unit, block, F.posexplode("labels").alias("__r", label)).select((F.col("__r") + 1).alias("replicate"), unit, block, label)


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(ratio(F.sum(value), F.count(value)).alias("mean_value"))
