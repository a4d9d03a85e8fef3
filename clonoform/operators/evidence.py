"""Antigen evidence from a local reference of known sequences. The definitions are ours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions import scalars as S
from clonoform.functions.grouped import entropy, ratio, require
from clonoform.operators.longitudinal import shuffled_labels
from clonoform.sources.staging import stage


def normalize_evidence_cdr3(c):
    """Trimmed upper-case CDR3, NULL unless made of the twenty residues."""
    t = F.upper(F.trim(c.cast("string")))
    return F.when(t.rlike(f"^[{S.AMINO_ACIDS}]+$"), t)


def normalize_v_gene(c):
    """Trimmed upper-case V gene without its allele."""
    return F.nullif(F.regexp_replace(F.upper(F.trim(c.cast("string"))), r"\*.*$", ""), F.lit(""))


def v_allele(c):
    return F.nullif(F.regexp_extract(F.upper(F.trim(c.cast("string"))), r"\*(.*)$", 1), F.lit(""))


def load_evidence(rows: DataFrame, release: str | None = None) -> DataFrame:
    """cdr3, v_gene, epitope, release_label of a reference table; the release is explicit."""
    require(rows, ["cdr3", "v_gene", "epitope"], "evidence reference")
    if release is None and "release_label" not in rows.columns:
        raise ValueError("the evidence reference needs a release label")
    label = F.lit(release) if release else F.col("release_label")
    return rows.select(normalize_evidence_cdr3(F.col("cdr3")).alias("cdr3"), normalize_v_gene(F.col("v_gene")).alias("v_gene"), "epitope", label.alias("release_label"))


def evidence_report(reference: DataFrame) -> DataFrame:
    """Rows, distinct rows, missing sequences, distinct sequences and epitopes, and an order-free
    content fingerprint, by release."""
    key = F.concat_ws("|", *[F.coalesce(F.col(c), F.lit("")) for c in ("cdr3", "v_gene", "epitope")])
    part = F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long")
    return reference.groupBy("release_label").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_distinct(key).alias("n_distinct_rows"),
        F.count_if(F.col("cdr3").isNull()).alias("n_missing_cdr3"),
        F.count_distinct("cdr3").alias("n_sequences"),
        F.count_distinct("epitope").alias("n_epitopes"),
        F.sum(part.cast("decimal(38,0)")).cast("string").alias("fingerprint"),
    )


def annotate(sequences: DataFrame, reference: DataFrame) -> DataFrame:
    """One row for each match of a sequence (cdr3aa, query_v_call) and an epitope: tier ``cdr3_v``
    if some matching entry also has its V gene, else ``cdr3``."""
    same = F.max((normalize_v_gene(F.col("query_v_call")) == F.col("v_gene")).cast("int"))
    both = sequences.join(reference.withColumnRenamed("cdr3", "cdr3aa"), "cdr3aa")
    return both.groupBy("cdr3aa", "rfu_label", "query_v_call", "epitope").agg(F.count(F.lit(1)).alias("n_entries"), F.when(same == 1, "cdr3_v").otherwise("cdr3").alias("tier"))


def summarize_evidence(matches: DataFrame) -> DataFrame:
    """Each matched sequence with its epitopes; several epitopes stay ambiguous."""
    out = matches.groupBy("cdr3aa").agg(F.array_join(F.array_sort(F.collect_set("epitope")), ",").alias("epitopes"), F.count_distinct("epitope").alias("n_epitopes"))
    return out.withColumn("ambiguous", F.col("n_epitopes") > 1)


def antigen_abundance(matches: DataFrame, grouping: str = "rfu_label") -> DataFrame:
    """Distinct sequences of each group and epitope, and their share within the group."""
    counts = matches.where(F.col(grouping).isNotNull()).groupBy(grouping, "epitope").agg(F.count_distinct("cdr3aa").alias("antigen_abundance"))
    totals = counts.groupBy(grouping).agg(F.sum("antigen_abundance").alias("__t"))
    return counts.join(totals, grouping).select(grouping, "epitope", "antigen_abundance", ratio(F.col("antigen_abundance"), F.col("__t")).alias("within_rfu_proportion"))


def antigen_coherence(matches: DataFrame, sequences: DataFrame, grouping: str = "rfu_label") -> DataFrame:
    """Purity (largest share), entropy of shares and matched fraction of each group."""
    shares = antigen_abundance(matches, grouping)
    shape = shares.groupBy(grouping).agg(F.max("within_rfu_proportion").alias("antigen_purity"), entropy(F.col("antigen_abundance")).alias("antigen_entropy"), F.count(F.lit(1)).alias("n_epitopes"))
    matched = matches.groupBy(grouping).agg(F.count_distinct("cdr3aa").alias("matched_sequences"))
    total = sequences.groupBy(grouping).agg(F.count_distinct("cdr3aa").alias("total_sequences"))
    out = shape.join(matched, grouping).join(total, grouping)
    return out.withColumn("matched_fraction", ratio(F.col("matched_sequences"), F.col("total_sequences")))


def global_coherence(coherence: DataFrame) -> DataFrame:
    """Mean purity and entropy, weighted by matched sequences."""
    w = F.col("matched_sequences")
    return coherence.agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(w).alias("matched_sequences"),
        ratio(F.sum(w * F.col("antigen_purity")), F.sum(w)).alias("weighted_purity"),
        ratio(F.sum(w * F.col("antigen_entropy")), F.sum(w)).alias("weighted_entropy"),
    )


def _purity(rows: DataFrame, keys: list[str], grouping: str) -> DataFrame:
    """Matched-count-weighted purity: sum over groups of the largest count over all counts,
    each weighted by its matched sequences. A row counts once for its epitope and once for
    its group."""
    each = F.explode(F.array(F.struct(F.lit(True).alias("own"), F.col("epitope")), F.struct(F.lit(False).alias("own"), F.lit(None).cast("string").alias("epitope")))).alias("__e")
    counts = rows.select(*keys, grouping, "cdr3aa", each).groupBy(*keys, grouping, "__e.own", "__e.epitope").agg(F.count_distinct("cdr3aa").alias("n"))
    own = F.when(F.col("own"), F.col("n"))
    groups = counts.groupBy(*keys, grouping).agg((F.max(own) / F.sum(own)).alias("purity"), F.max(F.when(~F.col("own"), F.col("n"))).alias("w"))
    return groups.groupBy(*keys).agg(ratio(F.sum(F.col("purity") * F.col("w")), F.sum("w")).alias("statistic"))


def permutation_test(matches: DataFrame, stratum: str, replicates: int = 20, seed: int = 0) -> DataFrame:
    """Weighted purity against size-preserving permutations: RFU labels of the matched
    sequences are shuffled inside strata. observed, replicates at or above, p value.

    The matches are read once. A sequence carries the vector of its labels in all replicates,
    which is only unfolded where the counts begin.
    """
    own = stage(matches.where("rfu_label is not null").select("cdr3aa", "rfu_label", "epitope", F.col(stratum).alias("stratum")).distinct(), "matched-sequences")
    sequences = stage(own.groupBy("cdr3aa").agg(F.min("rfu_label").alias("rfu_label"), F.min("stratum").alias("stratum")), "shuffled-sequences")
    observed = _purity(own, [], "rfu_label").select(F.col("statistic").alias("observed"))
    vectors = shuffled_labels(sequences, unit="cdr3aa", block="stratum", label="rfu_label", replicates=replicates, seed=seed).select("cdr3aa", "labels")
    pairs = own.select("cdr3aa", "epitope").distinct().join(vectors, "cdr3aa")
    null = _purity(pairs.select("cdr3aa", "epitope", F.posexplode("labels").alias("replicate", "rfu_label")), ["replicate"], "rfu_label")
    out = null.join(F.broadcast(observed), F.lit(True)).groupBy("observed").agg(F.count(F.lit(1)).alias("n_replicates"), F.count_if(F.round("statistic", 9) >= F.round("observed", 9)).alias("n_at_least"), F.avg("statistic").alias("null_mean"))
    return out.withColumn("p_value", (F.col("n_at_least") + 1) / (F.col("n_replicates") + 1))


def compare_groupings(matches: DataFrame) -> DataFrame:
    """The weighted purity under the RFU and under simple groupings."""
    rows = matches.withColumn("v_gene", F.col("query_v_call")).withColumn("cdr3_length", F.length("cdr3aa").cast("string")).withColumn("v_and_length", F.concat_ws("|", "query_v_call", F.length("cdr3aa").cast("string")))
    rows = stage(rows.select("cdr3aa", "epitope", "rfu_label", "v_gene", "cdr3_length", "v_and_length"), "grouped-matches")
    out = None
    for name in ("rfu_label", "v_gene", "cdr3_length", "v_and_length"):
        one = _purity(rows.where(F.col(name).isNotNull()), [], name).select(F.lit(name).alias("grouping"), "statistic")
        out = one if out is None else out.unionByName(one)
    return out


def antigen_context(matches: DataFrame, rows: DataFrame, *, level: str, sample: str = "sample_id", donor: str = "donor_id") -> DataFrame:
    """Samples, donors and cells with a matched sequence, by RFU, epitope and metadata level."""
    keys = matches.select("cdr3aa", "rfu_label", "epitope").distinct()
    both = rows.where(F.col(level).isNotNull()).select("cdr3aa", "cell_id", level, sample, donor).join(keys, "cdr3aa")
    return both.groupBy("rfu_label", "epitope", level).agg(F.count_distinct(sample).alias("n_samples"), F.count_distinct(donor).alias("n_donors"), F.count_distinct("cell_id").alias("n_cells"))
