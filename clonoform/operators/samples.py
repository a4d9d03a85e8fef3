"""Sample x RFU abundances in sparse long form, and overlap of samples."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoform.functions.grouped import assigned_rows, ratio, require
from clonoform.sources.staging import stage, stage_columns

NORMALIZATIONS = ("count", "proportion", "counts_per_1000", "clr")
#: So many samples of an RFU meet all others in one part of the self join.
MOST_TOGETHER = 1_000
OVERLAPS = ("jaccard", "sorensen_dice", "overlap_coefficient", "cosine", "bray_curtis_similarity", "bray_curtis_dissimilarity", "weighted_jaccard", "jensen_shannon_distance")


class Pseudobulk(NamedTuple):
    """``matrix``: sample, rfu, n, value, without zeros (``clr`` needs ``densify``)."""

    matrix: DataFrame
    sample_metadata: DataFrame
    rfu_metadata: DataFrame
    qc: DataFrame
    normalize: str


def sample_metadata(rows: DataFrame, sample: str, phenotypes: Sequence[str] = (), check: bool = True) -> DataFrame:
    """One value of each phenotype for each sample. Conflicts and NULL samples raise."""
    require(rows, [sample, *phenotypes], "sample metadata")
    out = rows.groupBy(sample).agg(F.count(F.lit(1)).alias("__n"), *[F.min(c).alias(c) for c in phenotypes], *[F.count_distinct(c).alias(f"__{c}") for c in phenotypes])
    if check:
        clash = F.lit(False)
        for c in phenotypes:
            clash = clash | (F.col(f"__{c}") > 1)
        odd = out.where(F.col(sample).isNull() | clash).limit(5).collect()
        if odd:
            raise ValueError(f"NULL sample or conflicting labels: {[r.asDict() for r in odd]}")
    return out.select(sample, *phenotypes)


def sample_qc(rows: DataFrame, sample: str, *, assignment_policy: str = "nearest", min_cells: int = 1, min_sequences: int = 1, cell: str = "cell_id", cdr3: str = "cdr3aa", rfu: str = "rfu_label", passed: str = "pass_thr") -> DataFrame:
    """Input rows, assigned rows, cells, sequences and whether the minimums are met."""
    ok = F.col(rfu).isNotNull() & F.col(cdr3).isNotNull() & F.col(cell).isNotNull()
    if assignment_policy == "threshold_pass":
        ok = ok & F.coalesce(F.col(passed), F.lit(False))
    out = rows.groupBy(sample).agg(
        F.count(F.lit(1)).alias("input_row_count"),
        F.count_if(ok).alias("assigned_row_count"),
        F.count_distinct(F.when(ok, F.col(cell))).alias("unique_cell_count"),
        F.count_distinct(F.when(ok, F.col(cdr3))).alias("unique_sequence_count"),
    )
    return out.withColumn("passes_minimum", (F.col("unique_cell_count") >= min_cells) & (F.col("unique_sequence_count") >= min_sequences))


def pseudobulk(rows: DataFrame, *, sample: str, phenotypes: Sequence[str] = (), assignment_policy: str = "nearest", weighting: str = "cell", normalize: str = "count", min_cells: int = 1, min_sequences: int = 1, min_prevalence: int | float = 1, pseudocount: float = 0.5, rfu_levels: DataFrame | None = None, cell: str = "cell_id", cdr3: str = "cdr3aa", rfu: str = "rfu_label", passed: str = "pass_thr", check: bool = True) -> Pseudobulk:
    """Distinct cells (or sequences) of each sample and RFU, filtered and normalised.

    ``min_prevalence`` is a number of samples if it is an int and a fraction of all samples
    if it is a float in [0, 1]. ``rfu_levels`` (a frame with the RFU column) keeps declared
    RFUs without rows in ``rfu_metadata``. Samples without rows stay in the metadata.
    """
    if weighting not in ("cell", "unique_sequence"):
        raise ValueError("weighting must be 'cell' or 'unique_sequence'")
    if normalize not in NORMALIZATIONS:
        raise ValueError(f"normalize must be one of {NORMALIZATIONS}")
    if min_cells < 0 or min_sequences < 0 or pseudocount <= 0:
        raise ValueError("minimums must not be negative and the pseudocount must be positive")
    if isinstance(min_prevalence, bool) or not isinstance(min_prevalence, (int, float)):
        raise TypeError("min_prevalence must be a number of samples or a fraction")
    if min_prevalence < 0 or isinstance(min_prevalence, float) and min_prevalence > 1 and not min_prevalence.is_integer():
        raise ValueError("min_prevalence must not be negative; fractions must be at most 1")
    kept = [sample, cell, cdr3, rfu, *phenotypes, *[passed] * (assignment_policy == "threshold_pass")]
    require(rows, kept, "pseudobulk")
    rows = stage_columns(rows, kept, "pseudobulk-rows")
    meta = sample_metadata(rows, sample, phenotypes, check)
    qc = sample_qc(rows, sample, assignment_policy=assignment_policy, min_cells=min_cells, min_sequences=min_sequences, cell=cell, cdr3=cdr3, rfu=rfu, passed=passed)
    work = assigned_rows(rows, assignment_policy, rfu, passed).where(F.col(cdr3).isNotNull() & F.col(cell).isNotNull())
    if min_cells > 1 or min_sequences > 1:
        work = work.join(qc.where("passes_minimum").select(sample), sample, "left_semi")
    counts = work.groupBy(sample, rfu).agg(F.count_distinct(cell if weighting == "cell" else cdr3).alias("n"))
    prevalence = counts.groupBy(rfu).agg(F.count(F.lit(1)).alias("sample_prevalence_count"), F.sum("n").alias("total_abundance"))
    n_samples = meta.agg(F.count(F.lit(1)).alias("__samples"))
    if rfu_levels is not None:
        prevalence = prevalence.join(rfu_levels.select(rfu).distinct(), rfu, "full").na.fill(0, ["sample_prevalence_count", "total_abundance"])
    fraction = isinstance(min_prevalence, float) and min_prevalence <= 1
    need = F.ceil(F.lit(float(min_prevalence)) * F.col("__samples")) if fraction else F.lit(int(min_prevalence))
    keep = F.col("sample_prevalence_count") >= need
    if rfu_levels is not None:
        keep = keep | (F.col("sample_prevalence_count") == 0)
    kept = prevalence.join(F.broadcast(n_samples), F.lit(True)).where(keep)
    rfu_metadata = kept.select(rfu, "total_abundance", "sample_prevalence_count", ratio(F.col("sample_prevalence_count"), F.col("__samples")).alias("sample_prevalence"))
    if rfu_levels is not None or fraction or min_prevalence > 1:
        counts = counts.join(rfu_metadata.select(rfu), rfu, "left_semi")
    if normalize == "count":
        matrix = counts.withColumn("value", F.col("n").cast("double"))
    elif normalize == "clr":
        levels = rfu_metadata.agg(F.count(F.lit(1)).alias("__k"))
        logs = F.log(F.col("n") + F.lit(float(pseudocount)))
        sums = counts.groupBy(sample).agg(F.sum(logs).alias("__logs"), F.count(F.lit(1)).alias("__nonzero"))
        joined = counts.join(sums, sample).join(F.broadcast(levels), F.lit(True))
        mean = (F.col("__logs") + (F.col("__k") - F.col("__nonzero")) * F.log(F.lit(float(pseudocount)))) / F.col("__k")
        matrix = joined.withColumn("value", logs - mean).select(sample, rfu, "n", "value")
    else:
        totals = counts.groupBy(sample).agg(F.sum("n").alias("__total"))
        scale = 1000.0 if normalize == "counts_per_1000" else 1.0
        matrix = counts.join(totals, sample).select(sample, rfu, "n", (F.col("n") * scale / F.col("__total")).alias("value"))
    return Pseudobulk(matrix, meta, rfu_metadata, qc, normalize)


def densify(bulk: Pseudobulk, sample: str, rfu: str = "rfu_label", pseudocount: float = 0.5) -> DataFrame:
    """Every sample with every kept RFU. Zeros are 0, or under ``clr`` what zero counts
    give: the log of the pseudocount less the sample's mean. For export: its size is the
    number of samples times the number of RFUs, both of which are dimension tables."""
    grid = bulk.sample_metadata.select(sample).join(bulk.rfu_metadata.select(rfu), F.lit(True))
    full = grid.join(bulk.matrix, [sample, rfu], "left").na.fill(0, ["n"])
    if bulk.normalize != "clr":
        return full.na.fill(0.0, ["value"])
    logs = F.log(F.col("n") + F.lit(float(pseudocount)))
    mean = full.groupBy(sample).agg(F.avg(logs).alias("__mean"))
    return full.join(mean, sample).select(sample, rfu, "n", (logs - F.col("__mean")).alias("value"))


def abundances(matrix: DataFrame, *, sample: str, rfu: str = "rfu_label", value: str = "value", min_abundance: float = 1, normalize: str = "count") -> tuple[DataFrame, DataFrame]:
    """The entries (s, r, x) at or above the floor and the totals of the samples that have
    any (s, t sum, k number, q sum of squares), both written once."""
    if min_abundance < 0:
        raise ValueError("min_abundance must not be negative")
    if normalize == "proportion" and min_abundance >= 1:
        raise ValueError("a floor of 1 removes every share; give min_abundance for proportions")
    named = matrix.select(F.col(sample).alias("s"), F.col(rfu).alias("r"), F.col(value).cast("double").alias("x"))
    entries = stage(named.where("x <> 0"), "overlap-entries")
    if entries.where("x < 0").limit(1).count():
        raise ValueError("overlap needs non-negative abundances")
    x = entries.where(F.col("x") >= min_abundance)
    return x, stage(x.groupBy("s").agg(F.sum("x").alias("t"), F.count(F.lit(1)).alias("k"), F.sum(F.col("x") * F.col("x")).alias("q")), "overlap-totals")


def in_parts(left: DataFrame, right: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part`` to join on beside the key: where a key has many rows on the
    left, each of these goes to one part, and the key's rows on the right go to all of them."""
    many = F.count(F.lit(1))
    crowded = stage(left.groupBy(key).agg(F.ceil(many / MOST_TOGETHER).cast("int").alias("__parts")).where("__parts > 1"), "crowded-keys")
    if crowded.isEmpty():
        return left.withColumn("part", F.lit(0)), right.withColumn("part", F.lit(0))
    parts = F.coalesce("__parts", F.lit(1))
    a = left.join(crowded, key, "left").withColumn("part", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("__parts")
    b = right.join(crowded, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    return a, b


def shared_sums() -> list[Column]:
    """What a pair's shared RFUs add up to, of rows with xa, xb and the totals ta, tb."""
    pa, pb = F.col("xa") / F.col("ta"), F.col("xb") / F.col("tb")
    mid = (pa + pb) / 2
    return [
        F.count(F.lit(1)).alias("i"),
        F.sum(F.col("xa") * F.col("xb")).alias("dot"),
        F.sum(F.least("xa", "xb")).alias("low"),
        F.sum(pa * F.log(pa / mid) + pb * F.log(pb / mid)).alias("js"),
        F.sum(pa).alias("pa"),
        F.sum(pb).alias("pb"),
    ]


def pair_value(metric: str) -> Column:
    """A metric of a pair from its shared sums and both samples' totals."""
    c = F.col
    sums = c("ta") + c("tb")
    js = 0.5 * (c("js") + F.log(F.lit(2.0)) * ((1 - c("pa")) + (1 - c("pb"))))
    values = {
        "jaccard": ratio(c("i"), c("ka") + c("kb") - c("i")),
        "sorensen_dice": ratio(2 * c("i"), c("ka") + c("kb")),
        "overlap_coefficient": ratio(c("i"), F.least("ka", "kb")),
        "cosine": ratio(c("dot"), F.sqrt("qa") * F.sqrt("qb")),
        "bray_curtis_similarity": 1 - ratio(sums - 2 * c("low"), sums),
        "bray_curtis_dissimilarity": ratio(sums - 2 * c("low"), sums),
        "weighted_jaccard": ratio(c("low"), sums - c("low")),
        "jensen_shannon_distance": F.when((c("ta") > 0) & (c("tb") > 0), F.sqrt(F.when(js > 1e-12, js).otherwise(0.0))),
    }
    return values[metric]


def overlap(matrix: DataFrame, samples: DataFrame, *, sample: str, metric: str = "jaccard", rfu: str = "rfu_label", value: str = "value", min_abundance: float = 1, normalize: str = "count") -> DataFrame:
    """(sample_a, sample_b, value) for each pair a <= b of ``samples``.

    The sparse matrix is written once. Shared RFUs come from its self join on the RFU, with
    the RFUs of many samples cut into parts; the rest of each metric from totals of the
    samples. Values below ``min_abundance`` count as zero. NULL
    where a metric is undefined. Negative values raise, as does the floor of 1 on shares.
    The result is every pair of samples: with many of them ask ``similarity.similar_samples``
    for the pairs within a bound, or ``similarity.nearest_samples``.
    """
    if metric not in OVERLAPS:
        raise ValueError(f"metric must be one of {OVERLAPS}")
    x, totals = abundances(matrix, sample=sample, rfu=rfu, value=value, min_abundance=min_abundance, normalize=normalize)
    own = stage(x.join(totals.select("s", "t"), "s"), "overlap-rows")
    a, b = in_parts(*(own.select(F.col("s").alias(n), "r", F.col("x").alias(f"x{n}"), F.col("t").alias(f"t{n}")) for n in "ab"), "r")
    shared = a.join(b, ["r", "part"]).where("a <= b").groupBy("a", "b").agg(*shared_sums())
    own = samples.select(F.col(sample).alias("s")).distinct().join(totals, "s", "left").na.fill(0)
    left, right = (own.select(*[F.col(c).alias(f"{c}{n}") for c in own.columns]) for n in "ab")
    # the result itself is every pair of samples
    pairs = left.join(right, F.col("sa") <= F.col("sb")).join(shared, (F.col("sa") == F.col("a")) & (F.col("sb") == F.col("b")), "left").na.fill(0, ["i", "dot", "low", "js", "pa", "pb"])
    return pairs.select(F.col("sa").alias("sample_a"), F.col("sb").alias("sample_b"), pair_value(metric).alias("value"))


def direction(metric: str) -> str:
    return "distance" if metric in ("bray_curtis_dissimilarity", "jensen_shannon_distance") else "similarity"
