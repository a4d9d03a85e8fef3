"""Coupling of RFUs with phenotypes, and position frequencies of sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions.grouped import assigned_rows, entropy, join_groups, ratio, require
from clonoform.functions.scalars import AMINO_ACIDS, align, natural_key
from clonoform.sources.staging import stage, stage_columns


def phenotype_coupling(rows: DataFrame, *, phenotype: str, sample: str | None = None, assignment_policy: str = "nearest", weighting: str = "cell", min_abundance: int = 1, cell: str = "cell_id", cdr3: str = "cdr3aa", rfu: str = "rfu_label", passed: str = "pass_thr") -> DataFrame:
    """Each RFU with every phenotype: abundance, specificity, dominance, recurrence.

    Entropy is normalised by the number of phenotypes in all rows. The dominant phenotype
    of a tie is the first in natural order. Recurrence counts samples of assigned rows;
    its denominators count samples of all rows.
    """
    if weighting not in ("cell", "unique_sequence"):
        raise ValueError("weighting must be 'cell' or 'unique_sequence'")
    if min_abundance < 1:
        raise ValueError("min_abundance must be at least 1")
    require(rows, [phenotype, cell, cdr3, rfu, *([sample] if sample else [])], "phenotype coupling")
    rows = stage_columns(rows, [phenotype, cell, cdr3, rfu, *([passed] if assignment_policy == "threshold_pass" else []), *([sample] if sample else [])], "coupling-rows")
    levels = rows.where(F.col(phenotype).isNotNull()).select(phenotype).distinct()
    work = assigned_rows(rows, assignment_policy, rfu, passed).where(F.col(phenotype).isNotNull() & F.col(cell).isNotNull() & F.col(cdr3).isNotNull())
    counts = work.groupBy(rfu, phenotype).agg(F.count_distinct(cell if weighting == "cell" else cdr3).alias("n"))
    if sample:  # a distinct count of its own: two at once would copy each row for both
        seen = stage(work.select(*dict.fromkeys([rfu, phenotype, sample])).distinct(), "coupling-samples")
        counts = counts.join(seen.groupBy(rfu, phenotype).agg(F.count(sample).alias("own_samples")), [rfu, phenotype])
    counts = stage(counts, "coupling-counts")
    whole = counts.groupBy(rfu).agg(
        F.sum("n").alias("total_abundance"),
        entropy(F.col("n")).alias("phenotype_entropy"),
        F.max("n").alias("__max"),
        F.count(F.lit(1)).alias("represented_phenotype_count"),
        F.min(F.struct((-F.col("n")).alias("m"), natural_key(F.col(phenotype)).alias("k"), F.col(phenotype).alias("p"))).alias("__top"),
    ).where(F.col("total_abundance") >= min_abundance)
    if sample:
        whole = whole.join(seen.groupBy(rfu).agg(F.count_distinct(sample).alias("sample_recurrence_count")), rfu)
    size = levels.agg(F.count(F.lit(1)).alias("__k"))
    # one row for an RFU and a phenotype: both are dimension tables
    grid = whole.join(F.broadcast(size), F.lit(True)).join(levels, F.lit(True))
    out = grid.join(counts, [rfu, phenotype], "left").na.fill(0, ["n", *(["own_samples"] if sample else [])])
    k = F.col("__k")
    normal = F.when(k > 1, F.col("phenotype_entropy") / F.log(k.cast("double"))).otherwise(0.0)
    columns = [
        F.col(rfu),
        F.col(phenotype),
        F.lit(weighting).alias("weighting"),
        F.lit(assignment_policy).alias("assignment_policy"),
        F.col("total_abundance"),
        F.col("n").alias("phenotype_specific_abundance"),
        ratio(F.col("n"), F.col("total_abundance")).alias("phenotype_specific_proportion"),
        F.col("phenotype_entropy"),
        normal.alias("normalized_phenotype_entropy"),
        (1 - normal).alias("phenotype_specificity"),
        F.col("__top.p").alias("dominant_phenotype"),
        ratio(F.col("__max"), F.col("total_abundance")).alias("dominant_phenotype_fraction"),
        F.col("represented_phenotype_count"),
    ]
    if sample:
        known = stage(rows.select(*dict.fromkeys([phenotype, sample])).distinct(), "phenotype-samples")
        everyone = known.agg(F.count_distinct(sample).alias("__all"))
        each = known.where(F.col(phenotype).isNotNull()).groupBy(phenotype).agg(F.count_distinct(sample).alias("__each"))
        out = join_groups(out.join(F.broadcast(everyone), F.lit(True)), each, [phenotype])
        columns += [
            F.col("sample_recurrence_count"),
            ratio(F.col("sample_recurrence_count"), F.col("__all")).alias("sample_prevalence"),
            F.col("own_samples").alias("phenotype_sample_recurrence_count"),
            ratio(F.col("own_samples"), F.col("__each")).alias("phenotype_sample_prevalence"),
        ]
    return out.select(*columns)


def sequence_weights(rows: DataFrame, weighting: str, sequence: str, cell: str, clonotype: str) -> DataFrame:
    """(sequence, weight): 1 for a distinct sequence; its number of cells; or 1 over the
    number of sequences of each of its clonotypes."""
    if weighting == "unique_sequence":
        return rows.select(sequence).distinct().withColumn("weight", F.lit(1.0))
    if weighting == "cell":
        require(rows, [cell], "cell weighting")
        return rows.select(sequence, cell).distinct().groupBy(sequence).agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if weighting != "clonotype":
        raise ValueError("weighting must be 'unique_sequence', 'cell' or 'clonotype'")
    require(rows, [clonotype], "clonotype weighting")
    if rows.where(F.col(clonotype).isNull()).limit(1).count():
        raise ValueError("clonotype weighting needs a clonotype in every row")
    pairs = rows.select(clonotype, sequence).distinct()
    sizes = pairs.groupBy(clonotype).agg(F.count(F.lit(1)).alias("__n"))
    return pairs.join(sizes, clonotype).groupBy(sequence).agg(F.sum(1.0 / F.col("__n")).alias("weight"))


def sequence_matrix(rows: DataFrame, *, rfu: str | None = None, sequence: str = "cdr3aa", rfu_col: str = "rfu_label", weighting: str = "unique_sequence", cell: str = "cell_id", clonotype: str = "clonotype_id", alignment: str = "conserved_ends", include_gap: bool = True) -> DataFrame:
    """(position, residue, frequency) of the aligned sequences, every residue at every
    position. Without gaps they don't count in the denominator."""
    require(rows, [sequence, *([rfu_col] if rfu is not None else [])], "sequence matrix")
    own = rows if rfu is None else rows.where(F.col(rfu_col) == rfu)
    own = own.withColumn(sequence, F.upper(F.trim(F.col(sequence).cast("string")))).where(f"`{sequence}` <> ''")
    needed = {"unique_sequence": [], "cell": [cell], "clonotype": [clonotype]}.get(weighting, [])
    require(own, needed, f"{weighting} weighting")
    own = stage(own.select(*dict.fromkeys([sequence, *needed])), "matrix-rows")
    bad = own.where(~F.col(sequence).rlike(f"^[{AMINO_ACIDS}]+$")).select(sequence).distinct().limit(5).collect()
    if bad:
        raise ValueError(f"invalid amino-acid sequences: {[r[0] for r in bad]}")
    weights = stage(sequence_weights(own, weighting, sequence, cell, clonotype), "matrix-weights")
    width = weights.agg(F.max(F.length(sequence)).alias("width"))
    spread = weights.join(F.broadcast(width), F.lit(True))
    letters = F.split(align(F.col(sequence), F.col("width"), alignment), "")
    alphabet = list(AMINO_ACIDS) + ["-"] * include_gap
    sums = spread.select("weight", F.posexplode(letters).alias("at", "residue")).where(F.col("residue").isin(*alphabet)).groupBy((F.col("at") + 1).alias("position"), "residue").agg(F.sum("weight").alias("w"))
    whole = sums.groupBy("position").agg(F.sum("w").alias("t"))
    grid = width.select(F.explode(F.sequence(F.lit(1), "width")).alias("position"), F.array(*[F.lit(x) for x in alphabet]).alias("rs")).select("position", F.explode("rs").alias("residue"))
    return grid.join(sums, ["position", "residue"], "left").join(whole, "position", "left").select("position", "residue", F.coalesce(ratio(F.col("w"), F.col("t")), F.lit(0.0)).alias("frequency"))
