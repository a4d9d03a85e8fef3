"""Reference coverage, frozen references and cohort transfer. The definitions are ours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions.fingerprints import digest, fingerprint, merged
from clonoform.functions.grouped import join_groups, names, ratio, require
from clonoform.functions.order_statistics import exact_quantiles
from clonoform.functions.scalars import coverage_status
from clonoform.sources.staging import stage

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95)


def with_status(rows: DataFrame, rfu: str = "rfu_label") -> DataFrame:
    return rows.withColumn("reference_coverage_status", coverage_status(F.col("cdr3aa"), F.col(rfu), F.col("pass_thr")))


def reference_coverage(rows: DataFrame, *, groupby: str | Sequence[str], cell: str = "cell_id") -> DataFrame:
    """Counts of each coverage status, exact score quantiles, and covered shares of unique
    eligible sequences and of their cells, for each group."""
    groups = names(groupby)
    require(rows, [*groups, "reference_coverage_status", "rfu_score", "cdr3aa", cell], "reference coverage")
    is_ = lambda s: F.col("reference_coverage_status") == s
    eligible = ~is_("missing_sequence") & ~is_("ineligible_sequence")
    distinct = lambda c, x: F.count_distinct(F.when(c, F.col(x)))
    rows = stage(rows.select(*dict.fromkeys([*groups, "reference_coverage_status", "rfu_score", "cdr3aa", cell])), "coverage-rows")
    quantiles = exact_quantiles(rows, groups, "rfu_score", {f"score_q{round(q * 100):02d}": q for q in QUANTILES})
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(eligible).alias("n_eligible"),
        F.count_if(is_("covered") | is_("below_threshold")).alias("n_assigned"),
        F.count_if(is_("covered")).alias("n_covered"),
        F.count_if(is_("below_threshold")).alias("n_below_threshold"),
        F.count_if(is_("upstream_unassigned")).alias("n_unassigned"),
        F.count_if(is_("ineligible_sequence")).alias("n_ineligible"),
        F.count_if(is_("missing_sequence")).alias("n_missing"),
        distinct(eligible, "cdr3aa").alias("n_sequences"),
        distinct(is_("covered"), "cdr3aa").alias("n_covered_sequences"),
        distinct(eligible, cell).alias("n_cells"),
        distinct(is_("covered"), cell).alias("n_covered_cells"),
    )
    out = join_groups(out, quantiles, groups)
    return out.withColumn("sequence_coverage", ratio(F.col("n_covered_sequences"), F.col("n_sequences"))).withColumn("cell_coverage", ratio(F.col("n_covered_cells"), F.col("n_cells")))


def reference_parts(centroids: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(groups, n_rows, limbs) of the rounded centroids; parts of a reference can be merged."""
    row = F.concat_ws("|", F.col("rfu_id").cast("string"), F.array_join(F.transform("vec", lambda x: F.floor(x * 1_000_000 + 0.5).cast("long").cast("string")), ","))
    return fingerprint(centroids, row, groups)


def reference_fingerprint(centroids: DataFrame, parameters: str = "") -> DataFrame:
    """One row: number of centroids and a digest of their rounded vectors and the parameters,
    whatever their order. It is a sum over row hashes, so no task sees all rows, and it is
    also that of ``frozen_id`` of the reference's parts."""
    return frozen_id(reference_parts(centroids), parameters)


def frozen_id(parts: DataFrame, parameters: str = "") -> DataFrame:
    """The id of the reference whose parts these are (``reference_parts``)."""
    return merged(parts).select(F.coalesce("n_rows", F.lit(0)).alias("n_rfus"), digest(F.col("limbs"), "|" + parameters).alias("reference_id"))


def transfer_cohort(rows: DataFrame, reference_rfus: DataFrame, *, cohort: str = "cohort", sample: str = "sample_id") -> DataFrame:
    """Already assigned rows of each cohort: sizes, coverage and share of the reference's
    RFUs that it shows. Nothing is refitted."""
    n = reference_rfus.select("rfu_label").distinct().agg(F.count(F.lit(1)).alias("n_reference_rfus"))
    out = rows.where(F.col(cohort).isNotNull()).groupBy(cohort).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(sample).alias("n_samples"),
        F.count("rfu_label").alias("n_assigned"),
        F.count_if("pass_thr").alias("n_covered"),
        F.count_distinct("rfu_label").alias("n_observed_rfus"),
    )
    out = out.join(F.broadcast(n), F.lit(True))
    return out.withColumn("coverage", ratio(F.col("n_covered"), F.col("n_rows"))).withColumn("rfu_share", ratio(F.col("n_observed_rfus"), F.col("n_reference_rfus")))


def harmonize_metadata(metadata: DataFrame, mapping: DataFrame, field: str, *, cohort: str = "cohort") -> DataFrame:
    """For each cohort and target value: rows mapped, rows without a mapping and rows without
    a value. ``mapping``: cohort, field, source_value, target_value; only it decides."""
    rules = mapping.where(F.col("field") == field).select(F.col(cohort), F.col("source_value").alias(field), "target_value")
    if rules.groupBy(cohort, field).count().where("count > 1").limit(1).count():
        raise ValueError("a cohort and source value has two targets")
    both = metadata.join(rules, [cohort, field], "left")
    return both.groupBy(cohort, "target_value").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(field).isNotNull() & F.col("target_value").isNull()).alias("n_unmapped"),
        F.count_if(F.col(field).isNull()).alias("n_missing"),
    )


def heldout_roles(roles: DataFrame, *, cohort: str = "cohort", check: bool = True) -> DataFrame:
    """Number of cohorts and samples in each role; a cohort with two roles raises."""
    if check:
        odd = roles.groupBy(cohort).agg(F.count_distinct("role").alias("n")).where("n > 1").limit(5).collect()
        if odd:
            raise ValueError(f"cohorts with more than one role: {[r[0] for r in odd]}")
    return roles.groupBy("role").agg(F.count_distinct(cohort).alias("n_cohorts"), F.count(F.lit(1)).alias("n_samples"))
