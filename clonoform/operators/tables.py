"""Tables behind the usual figures: top RFUs, z-scores, histograms, comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions.grouped import ratio
from clonoform.functions.scalars import natural_key
from clonoform.sources.staging import stage


def _positive(n: int | None, name: str) -> None:
    if n is not None and n < 1:
        raise ValueError(f"{name} must be positive or None")


def top_rfus(table: DataFrame, n: int = 20, rfu: str = "rfu_label", value: str = "value") -> DataFrame:
    """The n RFUs of the largest total (ties: natural order)."""
    totals = table.groupBy(rfu).agg(F.sum(value).alias("total"))
    return totals.orderBy(F.desc("total"), natural_key(F.col(rfu))).limit(max(int(n), 1))


def rfu_zscore(dense: DataFrame, top_n: int | None = 50, rfu: str = "rfu_label", value: str = "value") -> DataFrame:
    """Dense values of the top RFUs (by absolute total, ties by text), standardised for each
    RFU over samples with the population deviation; zero deviation gives 0."""
    _positive(top_n, "top_n")
    own = dense
    if top_n is not None:
        totals = dense.groupBy(rfu).agg(F.abs(F.sum(F.abs(value))).alias("__t"))
        own = dense.join(totals.orderBy(F.desc("__t"), rfu).limit(top_n).select(rfu), rfu, "left_semi")
    stats = own.groupBy(rfu).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__sd"))
    z = F.when(F.col("__sd") > 1e-12, (F.col(value) - F.col("__m")) / F.col("__sd")).otherwise(0.0)
    return own.join(stats, rfu).withColumn("z", z).drop("__m", "__sd")


def sparse_zscore(matrix: DataFrame, samples: DataFrame, *, sample: str, top_n: int | None = 50, rfu: str = "rfu_label", value: str = "value") -> DataFrame:
    """``rfu_zscore`` of a sparse matrix in which zeros are left out: (sample, rfu, value, z)
    of all ``samples``. Means and deviations come from the entries, with what the zeros add;
    only the chosen RFUs meet all samples. RFUs without entries aren't chosen."""
    _positive(top_n, "top_n")
    own = stage(matrix.select(sample, rfu, F.col(value).cast("double").alias("value")).where("value <> 0"), "sparse-entries")
    names = stage(samples.select(sample).distinct(), "sample-names")
    n = F.lit(float(names.count()))
    sums = own.groupBy(rfu).agg(F.sum(F.abs("value")).alias("__t"), (F.sum("value") / n).alias("__m"))
    chosen = sums if top_n is None else sums.orderBy(F.desc("__t"), rfu).limit(top_n)
    some = own.join(chosen if top_n is None else F.broadcast(chosen), rfu)
    gap = F.col("value") - F.col("__m")
    stats = some.groupBy(rfu, "__m").agg(F.sqrt((F.sum(gap * gap) + (n - F.count(F.lit(1))) * F.col("__m") * F.col("__m")) / n).alias("__sd"))
    full = names.join(stats if top_n is None else F.broadcast(stats), F.lit(True)).join(own, [sample, rfu], "left").na.fill(0.0, ["value"])
    return full.select(sample, rfu, "value", F.when(F.col("__sd") > 1e-12, gap / F.col("__sd")).otherwise(0.0).alias("z"))


def phenotype_top(coupling: DataFrame, phenotype: str, top_n: int | None = 50, min_prevalence: float = 0.0, rfu: str = "rfu_label", value: str = "phenotype_specific_proportion") -> DataFrame:
    """Coupling values of RFUs seen in a share of phenotypes, then of the largest totals."""
    _positive(top_n, "top_n")
    sums = coupling.groupBy(rfu).agg(F.sum(F.abs(value)).alias("__t"), F.avg((F.col(value) > 0).cast("double")).alias("__p")).where(F.col("__p") >= min_prevalence)
    kept = sums if top_n is None else sums.orderBy(F.desc(F.round("__t", 9)), rfu).limit(top_n)
    return coupling.join(kept.select(rfu), rfu, "left_semi").select(rfu, phenotype, value)


def convergence_top(metrics: DataFrame, n: int, abundance: str = "cell_abundance", richness: str = "convergence_richness", order: tuple[str, ...] = ("rfu_label",)) -> DataFrame:
    """The n rows to annotate: abundance, then richness, then the given order."""
    if n < 0:
        raise ValueError("n must not be negative")
    return metrics.orderBy(F.desc(abundance), F.desc(richness), *order).limit(n)


def antigen_table(abundance: DataFrame, top_rfus: int | None = 20, top_antigens: int | None = 20, rfu: str = "rfu_label", antigen: str = "epitope", value: str = "antigen_abundance") -> DataFrame:
    """(rfu, antigen, value) of the top RFUs and antigens, with zeros (ties by text)."""
    _positive(top_rfus, "top_rfus")
    _positive(top_antigens, "top_antigens")
    rows = abundance.where(F.col(rfu).isNotNull() & F.col(antigen).isNotNull())

    def top(c: str, n: int | None) -> DataFrame:
        t = rows.groupBy(c).agg(F.sum(value).alias("__t")).orderBy(F.desc("__t"), c)
        return (t if n is None else t.limit(n)).select(c)

    sums = rows.groupBy(rfu, antigen).agg(F.sum(value).alias(value))
    grid = top(rfu, top_rfus).join(top(antigen, top_antigens), F.lit(True))
    return grid.join(sums, [rfu, antigen], "left").na.fill(0, [value])


def score_histogram(rows: DataFrame, bins: int = 50, score: str = "rfu_score") -> DataFrame:
    """bin, low, high, n of all non-null scores: equal widths, last edge inclusive. Every
    bin is listed; equal scores are one half to either side."""
    scores = rows.select(F.col(score).cast("double").alias("x")).where("x is not null")
    edges = scores.agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a is not null")
    edges = edges.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    at = F.least(F.floor((F.col("x") - F.col("a")) * bins / (F.col("b") - F.col("a"))), F.lit(bins - 1))
    counts = scores.join(F.broadcast(edges), F.lit(True)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    listed = edges.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    step = (F.col("b") - F.col("a")) / bins
    return listed.join(counts, "bin", "left").select("bin", (F.col("a") + F.col("bin") * step).alias("low"), (F.col("a") + (F.col("bin") + 1) * step).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def metric_comparison(left: DataFrame, right: DataFrame, *, sample: str, left_metric: str, right_metric: str, check: bool = True) -> DataFrame:
    """Two metrics of the samples that both tables have; repeated samples raise."""
    if check:
        for df in (left, right):
            if df.groupBy(sample).count().where("count > 1").limit(1).count():
                raise ValueError("samples must be unique in both tables")
    return left.select(sample, F.col(left_metric).alias("left_value")).join(right.select(sample, F.col(right_metric).alias("right_value")), sample)


def shares(df: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """Add each row's share of its group's total."""
    totals = df.groupBy(*groups).agg(F.sum(value).alias("__total"))
    return df.join(totals, groups).withColumn(name, ratio(F.col(value), F.col("__total"))).drop("__total")
