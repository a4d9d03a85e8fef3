"""Subsampling, resampling and stability of representations. The definitions are ours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.functions.grouped import join_groups, ranks, ratio, running_sums
from clonoform.operators.longitudinal import seeded, uniform


#: So many features and draws of a sample meet in one part of its running total.
MOST_TOGETHER = 10_000


def subsample(rows: DataFrame, *, sample: str, unit: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each sample, chosen by a seeded hash of a unique row id.

    Where a sample's n-th row stands comes from sorted ranges of ids and hashes alone; rows
    are kept up to there, so no task holds a sample, and a smaller sample is kept whole.
    """
    if n < 1:
        return rows.limit(0)
    place = F.struct(seeded(seed, F.col(unit).cast("string")).alias("__h"), F.col(unit).alias("__u"))
    ids = rows.select(sample, place.alias("__place")).select(sample, "__place.__h", "__place.__u")
    last = ranks(ids, [sample], ["__h", "__u"]).where(F.col("__rank") == n).select(sample, F.struct("__h", "__u").alias("__last"))
    return join_groups(rows, last, [sample]).where(F.col("__last").isNull() | (place <= F.col("__last"))).drop("__last")


def multinomial_resample(counts: DataFrame, *, sample: str, feature: str, value: str, depth: int, seed: int = 0) -> DataFrame:
    """(sample, feature, n): ``depth`` seeded draws from each sample's abundances. This is
    not a downsampling of reads.

    A draw takes the feature whose share of the sample's running total it falls into. The
    running total comes from sorted ranges and is cut into parts by the sample's size. Draws
    and features of a part stand in one table by position, and a window carries the feature
    forward to the draws behind it, so the work grows with draws plus features, not with their
    product, and a large sample fills many tasks. A sample without abundances gets no rows.
    """
    return _resampled(counts, sample, feature, value, depth, [seed]).drop("__seed")


def _resampled(counts: DataFrame, sample: str, feature: str, value: str, depth: int, seeds: Sequence[int], together: int = MOST_TOGETHER) -> DataFrame:
    """(__seed, sample, feature, n) for each of the seeds, from one pass over the counts."""
    named = counts.where(F.col(sample).isNotNull()).select(sample, F.col(feature).alias("__feature"), F.col(value).alias("__value"))
    summed = running_sums(named, [sample], ["__feature"], "__value")
    sizes = summed.groupBy(sample).agg(F.ceil((F.count(F.lit(1)) + depth) / together).cast("int").alias("__parts"))
    each = F.explode(F.array(*[F.lit(s) for s in seeds])).alias("__seed")
    share = lambda c: F.round(ratio(c, F.col("__total")), 12)
    ladder = summed.select(sample, "__feature", share(F.col("__upto") - F.col("__value")).alias("__at"), share(F.col("__upto")).alias("__high")).where("__at < __high").join(sizes, sample)
    part = lambda c: F.floor(c * F.col("__parts")).cast("int")
    # a feature stands in every part that its share of the total reaches into
    parts = F.explode(F.sequence(part(F.col("__at")), F.least(part(F.col("__high")), F.col("__parts") - 1))).alias("__part")
    steps = ladder.select(sample, parts, "__at", F.lit(0).alias("__draw"), F.struct("__feature", "__high").alias("__step")).select("*", each)
    draws = sizes.select(sample, "__parts", each).select(sample, "__parts", "__seed", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("__draw"))
    at = uniform(seeded(F.col("__seed").cast("string"), F.col(sample), F.col("__draw").cast("string")))
    placed = draws.withColumn("__at", at).select(sample, part(F.col("__at")).alias("__part"), "__at", "__draw", F.lit(None).cast(steps.schema["__step"].dataType).alias("__step"), "__seed")
    # a feature's row stands before the draws at its own place
    behind = Window.partitionBy(sample, "__seed", "__part").orderBy("__at", "__draw").rowsBetween(Window.unboundedPreceding, 0)
    hit = steps.unionByName(placed).withColumn("__step", F.last("__step", True).over(behind)).where("__draw > 0 and __at < __step.__high")
    return hit.groupBy("__seed", sample, F.col("__step.__feature").alias(feature)).agg(F.count(F.lit(1)).alias("n"))


def shuffled(rows: DataFrame, unit: str, seed: int = 0) -> DataFrame:
    """The same rows in another, seeded physical order; results must not change."""
    return rows.repartition(seeded(seed, F.col(unit).cast("string"))).sortWithinPartitions(seeded(seed + 1, F.col(unit).cast("string")))


def threshold_sensitivity(rows: DataFrame, thresholds: Sequence[float], score: str = "rfu_score") -> DataFrame:
    """Pass rate of scored rows, and RFUs and sequences that still occur, by threshold."""
    cuts = F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold")
    wide = rows.where(F.col(score).isNotNull()).select("rfu_label", "cdr3aa", score, cuts)
    ok = F.col(score) >= F.col("threshold")
    out = wide.groupBy("threshold").agg(F.count(F.lit(1)).alias("n_scored"), F.count_if(ok).alias("n_pass"), F.count_distinct(F.when(ok, F.col("rfu_label"))).alias("n_rfus"), F.count_distinct(F.when(ok, F.col("cdr3aa"))).alias("n_sequences"))
    return out.withColumn("pass_rate", ratio(F.col("n_pass"), F.col("n_scored")))


def leave_one_donor_out(rows: DataFrame, donor: str = "donor_id", rfu: str = "rfu_label") -> DataFrame:
    """Assigned rows and distinct RFUs without each donor: the totals less what only the
    donor has, so that rows aren't repeated for every donor left out."""
    own = rows.where(F.col(donor).isNotNull() & F.col(rfu).isNotNull())
    by = own.groupBy(donor, rfu).agg(F.count(F.lit(1)).alias("n"))
    donors = by.groupBy(rfu).agg(F.count(F.lit(1)).alias("n_donors"))
    mine = by.join(donors, rfu).groupBy(donor).agg(F.sum("n").alias("own_rows"), F.count_if(F.col("n_donors") == 1).alias("own_rfus"))
    total = by.agg(F.sum("n").alias("all_rows"), F.count_distinct(rfu).alias("all_rfus"))
    out = mine.join(F.broadcast(total), F.lit(True))
    return out.select(F.col(donor).alias("left_out"), (F.col("all_rows") - F.col("own_rows")).alias("n_rows"), (F.col("all_rfus") - F.col("own_rfus")).alias("n_rfus"))


def cosine(a: DataFrame, b: DataFrame, keys: Sequence[str], feature: str, left: str, right: str) -> DataFrame:
    """Cosine of two sparse vectors by key."""
    both = a.join(b, [*keys, feature], "full").na.fill(0, [left, right])
    x, y = F.col(left).cast("double"), F.col(right).cast("double")
    return both.groupBy(*keys).agg(ratio(F.sum(x * y), F.sqrt(F.sum(x * x)) * F.sqrt(F.sum(y * y))).alias("cosine"))


def stability(counts: DataFrame, *, sample: str, feature: str, value: str, depth: int, replicates: int = 3, seed: int = 0) -> DataFrame:
    """Cosine of each sample's vector with its resampled vector, for each replicate."""
    seeds = {seed + r: r for r in range(1, replicates + 1)}
    other = _resampled(counts, sample, feature, value, depth, list(seeds)).withColumnRenamed("n", "__y")
    base = counts.select(sample, feature, F.col(value).alias("__x"), F.explode(F.array(*[F.lit(s) for s in seeds])).alias("__seed"))
    out = cosine(base, other, ["__seed", sample], feature, "__x", "__y")
    return out.select((F.col("__seed") - seed).alias("replicate"), sample, "cosine")


def _counted(rows: DataFrame, sample: str, feature) -> DataFrame:
    named = rows.select(sample, feature.cast("string").alias("feature")).where(F.col("feature").isNotNull() & F.col(sample).isNotNull())
    counts = named.groupBy(sample, "feature").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy(sample).agg(F.sum("n").alias("__t"))
    return counts.join(totals, sample).select(sample, "feature", ratio(F.col("n"), F.col("__t")).alias("value"))


#: name -> function (rows, sample) giving long (sample, feature, value) shares.
COMPARATORS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "rfu": lambda rows, s: _counted(rows, s, F.col("rfu_label")),
    "cdr3": lambda rows, s: _counted(rows, s, F.col("cdr3aa")),
    "clonotype": lambda rows, s: _counted(rows, s, F.col("clonotype_id")),
    "v_gene": lambda rows, s: _counted(rows, s, F.col("v_call")),
    "cdr3_length": lambda rows, s: _counted(rows, s, F.length("cdr3aa")),
}


def register_comparator(name: str, function: Callable[[DataFrame, str], DataFrame]) -> None:
    if name in COMPARATORS:
        raise ValueError(f"comparator {name!r} exists")
    COMPARATORS[name] = function


def list_comparators() -> list[str]:
    return sorted(COMPARATORS)


def representation(rows: DataFrame, name: str, sample: str = "sample_id") -> DataFrame:
    if name not in COMPARATORS:
        raise ValueError(f"unknown comparator {name!r}; known: {list_comparators()}")
    return COMPARATORS[name](rows, sample)
