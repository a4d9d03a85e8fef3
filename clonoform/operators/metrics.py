"""Grouped descriptive metrics of assigned rows and of repertoires."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from clonoform.functions.grouped import assigned_rows, chain_rows, entropy, join_groups, names, ratio, require
from clonoform.functions.order_statistics import exact_quantiles
from clonoform.functions.scalars import natural_key
from clonoform.sources.staging import stage_columns


def rfu_summary(rows: DataFrame, groupby: str | None = None) -> DataFrame:
    """Cells, assigned cells, rate, distinct RFUs, mean and exact median score and the most
    frequent RFU (ties: natural order) of each group or of all rows. NULL is a group."""
    groups = [groupby] if groupby else []
    require(rows, [*groups, "rfu_label", "rfu_score"], "RFU summary")
    has = F.col("rfu_label").isNotNull()
    score = F.when(has, F.col("rfu_score").cast("double"))
    rows = stage_columns(rows, [*groups, "rfu_label", "rfu_score"], "summary-rows")
    out = rows.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(has).alias("n_assigned"),
        F.count_distinct("rfu_label").alias("n_unique_rfu"),
        F.avg(score).alias("mean_rfu_score"),
    )
    median = exact_quantiles(rows.where(has), groups, "rfu_score", {"median_rfu_score": 0.5})
    counts = rows.where(has).groupBy(*groups, "rfu_label").agg(F.count(F.lit(1)).alias("n"))
    top = counts.groupBy(*groups).agg(F.min(F.struct((-F.col("n")).alias("minus"), natural_key(F.col("rfu_label")).alias("key"), F.col("rfu_label"))).alias("t"))
    top = top.select(*groups, F.col("t.rfu_label").alias("top_rfu"), (-F.col("t.minus")).alias("top_rfu_count"))
    both = out
    for part in (top, median):  # without groups they have a row at most
        both = join_groups(both, part, groups) if groups else both.join(part, F.lit(True), "left")
    rate = F.coalesce(ratio(F.col("n_assigned"), F.col("n_cells")), F.lit(0.0))
    return both.select(*groups, "n_cells", "n_assigned", rate.alias("assignment_rate"), "n_unique_rfu", "mean_rfu_score", "median_rfu_score", "top_rfu", F.coalesce("top_rfu_count", F.lit(0)).alias("top_rfu_count"))


def aggregate_rfu(rows: DataFrame, groupby: str, normalize: bool = True) -> DataFrame:
    """Long form of the group x RFU table: counts, or shares of the group's assigned rows.
    Rows without group or RFU don't count."""
    require(rows, [groupby, "rfu_label"], "RFU aggregation")
    counts = rows.where(F.col(groupby).isNotNull() & F.col("rfu_label").isNotNull()).groupBy(groupby, "rfu_label").agg(F.count(F.lit(1)).alias("value"))
    if not normalize:
        return counts
    totals = counts.groupBy(groupby).agg(F.sum("value").alias("__total"))
    return counts.join(totals, groupby).select(groupby, "rfu_label", ratio(F.col("value"), F.col("__total")).alias("value"))


def rfu_metrics(rows: DataFrame, *, groupby: str | Sequence[str], weighting: str, order_by: str, cell: str = "cell_id", cdr3: str = "cdr3aa", rfu: str = "rfu_label", passed: str = "pass_thr", donor: str | None = None, sample: str | None = None, chain: str | None = None, assignment_policy: str = "nearest") -> DataFrame:
    """Convergence, abundance and prevalence of each observed group and RFU.

    Cell and sequence totals count assigned rows; donor and sample totals count all rows of
    the chain. The pass rate takes the first row (by ``order_by``) of each cell or sequence.
    NULL is a group; NULL cells don't count.
    """
    groups = names(groupby)
    if weighting not in ("cell", "unique_sequence"):
        raise ValueError("weighting must be 'cell' or 'unique_sequence'")
    extra = {k: c for k, c in (("donor", donor), ("sample", sample)) if c}
    require(rows, [*groups, cell, cdr3, rfu, passed, order_by, *extra.values()], "RFU metrics")
    frame = stage_columns(chain_rows(rows, chain), [*groups, cell, cdr3, rfu, passed, order_by, *extra.values()], "metric-rows")
    work = assigned_rows(frame, assignment_policy, rfu, passed).where(F.col(cdr3).isNotNull())
    keys = [*groups, rfu]
    pairs = work.where(F.col(cell).isNotNull()).select(*keys, cdr3, cell).distinct()
    clones = pairs.groupBy(*keys, cdr3).agg(F.count(F.lit(1)).alias("__n"))
    shape = clones.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("unique_cdr3_richness"),
        F.sum("__n").alias("__pairs"),
        entropy(F.col("__n")).alias("clonotype_entropy"),
        ratio(F.max("__n"), F.sum("__n")).alias("dominant_clonotype_fraction"),
    )
    counts = work.groupBy(*keys).agg(F.count_distinct(cell).alias("rfu_cell_count"), *[F.count_distinct(c).alias(f"{k}_count") for k, c in extra.items()])
    unit = cell if weighting == "cell" else cdr3
    flags = work.groupBy(*keys, unit).agg(F.min_by(F.struct(F.col(passed).alias("p")), order_by).alias("f"))
    rate = flags.groupBy(*keys).agg(F.avg(F.col("f.p").cast("double")).alias("threshold_pass_rate"))
    totals = work.groupBy(*groups).agg(F.count_distinct(cell).alias("__cells"), F.count_distinct(cdr3).alias("__sequences"))
    out = join_groups(join_groups(join_groups(counts, shape, keys, "inner"), rate, keys), totals, groups)
    if extra:
        out = join_groups(out, frame.groupBy(*groups).agg(*[F.count_distinct(c).alias(f"group_{k}_count") for k, c in extra.items()]), groups)
    cells, richness = F.col("rfu_cell_count"), F.col("unique_cdr3_richness")
    share = {"cell": ratio(cells, F.col("__cells")), "unique_sequence": ratio(richness, F.col("__sequences"))}
    many = ratio(F.col("__pairs"), richness)
    return out.select(
        *keys,
        F.lit(weighting).alias("weighting"),
        F.lit(assignment_policy).alias("assignment_policy"),
        cells,
        share["cell"].alias("rfu_cell_abundance"),
        richness,
        share["unique_sequence"].alias("sequence_convergence_ratio"),
        many.alias("multiplicity"),
        share[weighting].alias("weighted_abundance"),
        "clonotype_entropy",
        "dominant_clonotype_fraction",
        F.col("threshold_pass_rate").alias("rfu_threshold_pass_rate"),
        cells.alias("cell_abundance"),
        richness.alias("convergence_richness"),
        many.alias("mean_sequence_multiplicity"),
        share["unique_sequence"].alias("normalized_convergence"),
        F.col("dominant_clonotype_fraction").alias("dominant_sequence_fraction"),
        "threshold_pass_rate",
        *[c for k in extra for c in (F.col(f"{k}_count"), ratio(F.col(f"{k}_count"), F.col(f"group_{k}_count")).alias(f"{k}_prevalence"), F.col(f"group_{k}_count"))],
    )


def _unit_counts(rows: DataFrame, groups: Sequence[str], weighting: str, cell: str, cdr3: str, clonotype: str, v: str, order_by: str) -> DataFrame:
    """(groups, kind, n): for each clonotype, sequence, gene and cell of a group its distinct
    cells, sequences or clonotypes (NULL units don't count). Each row is unfolded into what
    it counts for, so one aggregation serves all.

    Under clonotype weighting there are two more kinds, for groups in which no clonotype
    weighs a kind: sequences that weigh one each, and genes by their sequences' first row.
    """
    kinds = {"clonotype": clonotype, "sequence": cdr3, "gene": v, "cell": cell}
    unit = {"cell": cell, "unique_sequence": cdr3, "clonotype": clonotype}[weighting]
    # a unit counts once for itself, and of cells only the number is wanted: neither carries units
    units = {k: F.lit("") if c == unit or k == "cell" else F.col(unit).cast("string") for k, c in kinds.items()}
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("kind"), F.col(c).cast("string").alias("key"), units[k].alias("unit")) for i, (k, c) in enumerate(kinds.items())])).alias("__e")
    long = rows.select(*groups, each).where("__e.key is not null").select(*groups, "__e.*")
    counts = long.groupBy(*groups, "kind", "key").agg(F.count_distinct("unit").alias("n"))
    counts = counts.select(*groups, F.element_at(F.array(*[F.lit(k) for k in kinds]), F.col("kind").cast("int") + 1).alias("kind"), "n")
    if weighting != "clonotype":
        return counts
    one = F.struct("kind", "n")
    alone = F.struct(F.lit("sequence_first").alias("kind"), F.lit(1).cast("long").alias("n"))
    counts = counts.select(*groups, F.explode(F.when(F.col("kind") == "sequence", F.array(one, alone)).otherwise(F.array(one))).alias("__k")).select(*groups, "__k.*")
    first = rows.where(F.col(v).isNotNull()).groupBy(*groups, cdr3).agg(F.min_by(v, order_by).alias("__v"))
    return counts.unionByName(first.groupBy(*groups, "__v").agg(F.count(F.lit(1)).alias("n")).select(*groups, F.lit("gene_first").alias("kind"), "n"))


def _shapes(counts: DataFrame, groups: Sequence[str]) -> DataFrame:
    """(groups, kind, keys, total, entropy, squares, top, gini) from how often each count
    occurs, of which there are few."""
    often = counts.groupBy(*groups, "kind", "n").agg(F.count(F.lit(1)).alias("c"))
    places = often.withColumn("upto", F.sum("c").over(Window.partitionBy(*groups, "kind").orderBy("n")))
    n, c = F.col("n").cast("double"), F.col("c").cast("double")
    total, keys = F.sum(n * c), F.sum(c)
    spread = F.log(total) - F.sum(F.when(n > 0, c * n * F.log(n))) / total
    even = 2 * F.sum(c * (F.col("upto") - (c - 1) / 2) * n) / (keys * total) - (keys + 1) / keys
    return places.groupBy(*groups, "kind").agg(
        F.sum("c").alias("keys"),
        total.alias("total"),
        F.coalesce(F.when(spread > 1e-12, spread), F.lit(0.0)).alias("entropy"),
        F.when(total > 0, F.sum(n * n * c) / (total * total)).alias("squares"),
        ratio(F.max("n"), total).alias("top"),
        F.coalesce(F.when(total > 0, even), F.lit(0.0)).alias("gini"),
    )


def repertoire_metrics(rows: DataFrame, *, groupby: str | Sequence[str], weighting: str, order_by: str, cell: str = "cell_id", cdr3: str = "cdr3aa", clonotype: str = "clonotype_id", v: str = "v_call", productive: str = "productive", chain: str | None = None) -> DataFrame:
    """Diversity, dominance, length and V usage of each group.

    A group without any clonotype falls back to sequences and says so. The productive
    fraction counts all rows of the group, the rest rows with a CDR3. NULL is a group.
    """
    groups = names(groupby)
    if weighting not in ("cell", "unique_sequence", "clonotype"):
        raise ValueError("weighting must be 'cell', 'unique_sequence' or 'clonotype'")
    require(rows, [*groups, cell, cdr3, order_by], "repertoire metrics")
    for c, kind in ((clonotype, "string"), (v, "string"), (productive, "boolean")):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(kind))
    frame = stage_columns(chain_rows(rows, chain), [*groups, cell, cdr3, clonotype, v, productive, order_by], "repertoire-rows")
    has = F.col(cdr3).isNotNull()
    n = F.length(cdr3)
    shapes = _shapes(_unit_counts(frame.where(has), groups, weighting, cell, cdr3, clonotype, v, order_by), groups)
    # the group's own figures and one row a kind meet in one aggregation, where NULL is a group
    base = frame.groupBy(*groups).agg(
        F.count_if(has).alias("rows"),
        F.avg(n).alias("mean_length"),
        F.median(n).alias("median_length"),  # few different lengths
        F.avg(F.col(productive).cast("double")).alias("productive"),
    )
    both = base.withColumn("kind", F.lit("base")).unionByName(shapes, allowMissingColumns=True)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c))).alias(f"{kind}_{c}")
    kinds = ("clonotype", "sequence", "gene", *("sequence_first", "gene_first") * (weighting == "clonotype"))
    wide = both.groupBy(*groups).agg(
        *[of("base", c) for c in ("rows", "mean_length", "median_length", "productive")],
        of("cell", "keys"),
        *[of(k, c) for k in kinds for c in ("keys", "total", "entropy", "squares", "top", "gini")],
    )
    col = F.col
    known = F.coalesce(col("clonotype_keys") > 0, F.lit(False))

    def sequence(c: str):
        return F.when(col("sequence_total") > 0, col(f"sequence_{c}")).otherwise(col(f"sequence_first_{c}")) if weighting == "clonotype" else col(f"sequence_{c}")

    def gene(c: str):
        return F.when(col("gene_total") > 0, col(f"gene_{c}")).otherwise(col(f"gene_first_{c}")) if weighting == "clonotype" else col(f"gene_{c}")

    clone = lambda c: F.when(known, col(f"clonotype_{c}")).otherwise(sequence(c))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    count = lambda c: F.coalesce(c, F.lit(0))
    return wide.select(
        *groups,
        F.lit(weighting).alias("weighting"),
        F.when(known, "clonotype_id").otherwise("cdr3aa_sequence").alias("diversity_identity"),
        (~known).alias("clonotype_fallback"),
        col("base_rows").alias("receptor_bearing_row_count"),
        count(col("cell_keys")).alias("unique_cell_count"),
        count(col("sequence_keys")).alias("unique_cdr3_richness"),
        F.when(known, col("clonotype_keys")).alias("clonotype_richness"),
        count(col("sequence_keys")).alias("sequence_based_clonotype_richness"),
        zero(clone("entropy")).alias("shannon_entropy"),
        zero(1 - clone("squares")).alias("simpson_diversity"),
        zero(F.try_divide(F.lit(1.0), clone("squares"))).alias("inverse_simpson_diversity"),
        zero(sequence("top")).alias("dominant_cdr3_fraction"),
        F.when(known, col("clonotype_top")).alias("dominant_clonotype_fraction"),
        col("base_mean_length").alias("mean_cdr3aa_length"),
        col("base_median_length").alias("median_cdr3aa_length"),
        col("base_productive").alias("productive_fraction"),
        count(gene("keys")).alias("trbv_richness"),
        gene("top").alias("top_trbv_fraction"),
        zero(clone("gini")).alias("gini_clonality"),
    )
