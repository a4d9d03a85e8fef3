"""Queries over assigned rows: metrics, samples, phenotypes, tables, and our definitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.functions.fingerprints import digest
from clonoform.functions.grouped import entropy, ratio
from clonoform.functions.order_statistics import gini
from clonoform.operators import coverage, evidence, longitudinal, metrics, phenotype, robustness, samples, similarity, tables
from clonoform.plans.base import WITH_ASSIGNED, V, assigned, cells, contigs, final, query, sampled, sql_natural, sql_shannon
from clonoform.sources.fixtures import centroid_reference, load, view
from clonoform.sources.staging import stage

A = WITH_ASSIGNED
S = f"{A}, s AS (SELECT * FROM assigned WHERE sample_id IS NOT NULL)"

# --- statistics and summaries -------------------------------------------------------------------


@query("entropy", final(f"{A} SELECT cell_type, {sql_shannon('n')} AS entropy FROM (SELECT cell_type, rfu_label, count(*) AS n FROM assigned WHERE rfu_label IS NOT NULL GROUP BY ALL) t GROUP BY cell_type", "cell_type entropy:d"))
def _(spark, sf_dir):
    counts = assigned(spark, sf_dir).where("rfu_label is not null").groupBy("cell_type", "rfu_label").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("cell_type").agg(entropy(F.col("n")).alias("entropy"))


@query("gini", final(f"{A} SELECT sample_id, 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n) AS i FROM (SELECT sample_id, cdr3aa, count(*) AS n FROM assigned WHERE cdr3aa IS NOT NULL GROUP BY ALL) t) u GROUP BY sample_id", "sample_id gini:d"))
def _(spark, sf_dir):
    counts = assigned(spark, sf_dir).where("cdr3aa is not null").groupBy("sample_id", "cdr3aa").agg(F.count(F.lit(1)).alias("n"))
    return gini(counts, ["sample_id"], "n")


def _summary_sql(group: str | None) -> str:
    g, by, on = (f"{group}, ", f"GROUP BY {group}", f"t.{group} IS NOT DISTINCT FROM u.{group}") if group else ("", "", "true")
    part = f"PARTITION BY {group} " if group else ""
    top = f"SELECT {g}rfu_label, n, row_number() OVER ({part}ORDER BY n DESC, {sql_natural('rfu_label')}) AS k FROM (SELECT {g}rfu_label, count(*) AS n FROM assigned WHERE rfu_label IS NOT NULL GROUP BY ALL) c"
    return final(
        f"""{A} SELECT {f't.{group}, ' if group else ''}n_cells, n_assigned, n_assigned * 1.0 / n_cells AS assignment_rate, n_unique_rfu, mean_rfu_score, median_rfu_score, u.rfu_label AS top_rfu, coalesce(u.n, 0) AS top_rfu_count
 FROM (SELECT {g}count(*) AS n_cells, count(rfu_label) AS n_assigned, count(DISTINCT rfu_label) AS n_unique_rfu, avg(rfu_score) FILTER (WHERE rfu_label IS NOT NULL) AS mean_rfu_score, median(rfu_score) FILTER (WHERE rfu_label IS NOT NULL) AS median_rfu_score FROM assigned {by}) t
 LEFT JOIN (SELECT * FROM ({top}) v WHERE k = 1) u ON {on}""",
        f"{group + ' ' if group else ''}n_cells:i n_assigned:i assignment_rate:d n_unique_rfu:i mean_rfu_score:d median_rfu_score:d top_rfu top_rfu_count:i",
    )


@query("rfu_summary", _summary_sql("cell_type"))
def _(spark, sf_dir):
    return metrics.rfu_summary(assigned(spark, sf_dir), "cell_type")


@query("rfu_summary_global", _summary_sql(None))
def _(spark, sf_dir):
    return metrics.rfu_summary(assigned(spark, sf_dir))


AGGREGATE = f"{A}, c AS (SELECT sample_id, rfu_label, count(*) AS n FROM assigned WHERE sample_id IS NOT NULL AND rfu_label IS NOT NULL GROUP BY ALL)"


@query("aggregate_rfu", final(f"{AGGREGATE} SELECT sample_id, rfu_label, n * 1.0 / sum(n) OVER (PARTITION BY sample_id) AS value FROM c", "sample_id rfu_label value:d"))
def _(spark, sf_dir):
    return metrics.aggregate_rfu(assigned(spark, sf_dir), "sample_id")


@query("aggregate_rfu_counts", final(f"{AGGREGATE} SELECT sample_id, rfu_label, n AS value FROM c", "sample_id rfu_label value:i"))
def _(spark, sf_dir):
    return metrics.aggregate_rfu(assigned(spark, sf_dir), "sample_id", normalize=False)


METRIC_COLUMNS = "cell_type rfu_label weighting assignment_policy rfu_cell_count:i rfu_cell_abundance:d unique_cdr3_richness:i sequence_convergence_ratio:d multiplicity:d weighted_abundance:d clonotype_entropy:d dominant_clonotype_fraction:d rfu_threshold_pass_rate:d cell_abundance:i convergence_richness:i mean_sequence_multiplicity:d normalized_convergence:d dominant_sequence_fraction:d threshold_pass_rate:d donor_count:i donor_prevalence:d group_donor_count:i sample_count:i sample_prevalence:d group_sample_count:i"


def _metrics_sql(weighting: str, policy: str) -> str:
    unit = "cell_id" if weighting == "cell" else "cdr3aa"
    share = "cells * 1.0 / all_cells" if weighting == "cell" else "richness * 1.0 / all_sequences"
    keep = "rfu_label IS NOT NULL AND cdr3aa IS NOT NULL" + (" AND coalesce(pass_thr, false)" if policy == "threshold_pass" else "")
    return final(
        f"""{A}, w AS (SELECT * FROM assigned WHERE {keep}),
 totals AS (SELECT cell_type, count(DISTINCT cell_id) AS all_cells, count(DISTINCT cdr3aa) AS all_sequences FROM w GROUP BY cell_type),
 meta AS (SELECT cell_type, count(DISTINCT donor_id) AS group_donor_count, count(DISTINCT sample_id) AS group_sample_count FROM assigned GROUP BY cell_type),
 clones AS (SELECT cell_type, rfu_label, cdr3aa, count(DISTINCT cell_id) AS n FROM w GROUP BY ALL),
 shape AS (SELECT cell_type, rfu_label, count(*) AS richness, sum(n) AS pairs, {sql_shannon('n')} AS entropy, max(n) * 1.0 / sum(n) AS dominant FROM clones GROUP BY ALL),
 cnt AS (SELECT cell_type, rfu_label, count(DISTINCT cell_id) AS cells, count(DISTINCT donor_id) AS donor_count, count(DISTINCT sample_id) AS sample_count FROM w GROUP BY ALL),
 flags AS (SELECT cell_type, rfu_label, avg(CAST(p AS DOUBLE)) AS rate FROM (SELECT cell_type, rfu_label, pass_thr AS p, row_number() OVER (PARTITION BY cell_type, rfu_label, {unit} ORDER BY source_order) AS k FROM w) t WHERE k = 1 GROUP BY ALL)
 SELECT cnt.cell_type, cnt.rfu_label, '{weighting}' AS weighting, '{policy}' AS assignment_policy, cells AS rfu_cell_count, cells * 1.0 / all_cells AS rfu_cell_abundance, richness AS unique_cdr3_richness, richness * 1.0 / all_sequences AS sequence_convergence_ratio,
 pairs * 1.0 / richness AS multiplicity, {share} AS weighted_abundance, entropy AS clonotype_entropy, dominant AS dominant_clonotype_fraction, rate AS rfu_threshold_pass_rate, cells AS cell_abundance, richness AS convergence_richness, pairs * 1.0 / richness AS mean_sequence_multiplicity,
 richness * 1.0 / all_sequences AS normalized_convergence, dominant AS dominant_sequence_fraction, rate AS threshold_pass_rate, donor_count, donor_count * 1.0 / nullif(group_donor_count, 0) AS donor_prevalence, group_donor_count, sample_count, sample_count * 1.0 / nullif(group_sample_count, 0) AS sample_prevalence, group_sample_count
 FROM cnt JOIN shape ON cnt.cell_type IS NOT DISTINCT FROM shape.cell_type AND cnt.rfu_label = shape.rfu_label JOIN flags ON cnt.cell_type IS NOT DISTINCT FROM flags.cell_type AND cnt.rfu_label = flags.rfu_label
 JOIN totals ON cnt.cell_type IS NOT DISTINCT FROM totals.cell_type JOIN meta ON cnt.cell_type IS NOT DISTINCT FROM meta.cell_type""",
        METRIC_COLUMNS,
    )


def _metrics(spark, sf_dir, weighting: str, policy: str) -> DataFrame:
    return metrics.rfu_metrics(assigned(spark, sf_dir), groupby="cell_type", weighting=weighting, order_by="source_order", donor="donor_id", sample="sample_id", chain="trb", assignment_policy=policy)


for _name, _weighting, _policy in (("rfu_metrics_cell", "cell", "nearest"), ("rfu_metrics_sequence", "unique_sequence", "nearest"), ("rfu_metrics_threshold", "cell", "threshold_pass")):
    query(_name, _metrics_sql(_weighting, _policy))(lambda spark, sf_dir, w=_weighting, p=_policy: _metrics(spark, sf_dir, w, p))


REPERTOIRE_COLUMNS = "sample_id weighting diversity_identity clonotype_fallback receptor_bearing_row_count:i unique_cell_count:i unique_cdr3_richness:i clonotype_richness:i sequence_based_clonotype_richness:i shannon_entropy:d simpson_diversity:d inverse_simpson_diversity:d dominant_cdr3_fraction:d dominant_clonotype_fraction:d mean_cdr3aa_length:d median_cdr3aa_length:d productive_fraction:d trbv_richness:i top_trbv_fraction:d gini_clonality:d"


def _repertoire_sql(weighting: str) -> str:
    def counts(identity: str) -> str:
        unit = {"cell": "cell_id", "unique_sequence": "cdr3aa", "clonotype": "clonotype_id"}[weighting]
        plain_counts = f"SELECT sample_id, {identity} AS identity, count(DISTINCT {unit}) AS n FROM kept WHERE {identity} IS NOT NULL GROUP BY ALL"
        if weighting != "clonotype":
            return plain_counts
        some = f"(SELECT sample_id AS sid, bool_or(clonotype_id IS NOT NULL) AS any_known FROM kept WHERE {identity} IS NOT NULL GROUP BY ALL)"
        first = f"SELECT sample_id, identity, count(*) AS n FROM (SELECT sample_id, cdr3aa, arg_min({identity}, source_order) AS identity FROM kept WHERE {identity} IS NOT NULL GROUP BY ALL) f GROUP BY ALL"
        return f"SELECT c.* FROM ({plain_counts}) c JOIN {some} x ON c.sample_id IS NOT DISTINCT FROM x.sid WHERE any_known UNION ALL SELECT c.* FROM ({first}) c JOIN {some} x ON c.sample_id IS NOT DISTINCT FROM x.sid WHERE NOT any_known"

    return final(
        f"""{A}, base AS (SELECT sample_id, count(cdr3aa) AS rows_, count(DISTINCT cell_id) FILTER (WHERE cdr3aa IS NOT NULL) AS cells_, count(DISTINCT cdr3aa) AS seqs_, count(DISTINCT clonotype_id) FILTER (WHERE cdr3aa IS NOT NULL) AS clones_,
 avg(length(cdr3aa)) AS mean_, median(length(cdr3aa)) AS median_, avg(CAST(productive AS INT)) AS prod_, bool_or(cdr3aa IS NOT NULL AND clonotype_id IS NOT NULL) AS has_ FROM assigned GROUP BY sample_id),
 kept AS (SELECT a.*, CASE WHEN has_ THEN clonotype_id ELSE cdr3aa END AS ident FROM assigned a JOIN base b ON a.sample_id IS NOT DISTINCT FROM b.sample_id WHERE cdr3aa IS NOT NULL),
 ci AS ({counts('ident')}), cs AS ({counts('cdr3aa')}), cv AS ({counts('v_call')}),
 shape AS (SELECT sample_id, {sql_shannon('n')} AS sh, 1 - sum(n * n) * 1.0 / (sum(n) * sum(n)) AS si, sum(n) * sum(n) * 1.0 / sum(n * n) AS inv, max(n) * 1.0 / sum(n) AS dom FROM ci GROUP BY ALL),
 g AS (SELECT sample_id, 2.0 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n) AS i FROM ci) t GROUP BY ALL),
 sd AS (SELECT sample_id, max(n) * 1.0 / sum(n) AS dom FROM cs GROUP BY ALL), vd AS (SELECT sample_id, count(*) AS genes, max(n) * 1.0 / sum(n) AS dom FROM cv GROUP BY ALL)
 SELECT base.sample_id, '{weighting}' AS weighting, CASE WHEN has_ THEN 'clonotype_id' ELSE 'cdr3aa_sequence' END AS diversity_identity, NOT coalesce(has_, false) AS clonotype_fallback, rows_ AS receptor_bearing_row_count, cells_ AS unique_cell_count, seqs_ AS unique_cdr3_richness,
 CASE WHEN has_ THEN clones_ END AS clonotype_richness, seqs_ AS sequence_based_clonotype_richness, coalesce(sh, 0) AS shannon_entropy, coalesce(si, 0) AS simpson_diversity, coalesce(inv, 0) AS inverse_simpson_diversity, coalesce(sd.dom, 0) AS dominant_cdr3_fraction,
 CASE WHEN has_ THEN shape.dom END AS dominant_clonotype_fraction, mean_ AS mean_cdr3aa_length, median_ AS median_cdr3aa_length, prod_ AS productive_fraction, coalesce(genes, 0) AS trbv_richness, vd.dom AS top_trbv_fraction, coalesce(gini, 0) AS gini_clonality
 FROM base LEFT JOIN shape ON base.sample_id IS NOT DISTINCT FROM shape.sample_id LEFT JOIN g ON base.sample_id IS NOT DISTINCT FROM g.sample_id LEFT JOIN sd ON base.sample_id IS NOT DISTINCT FROM sd.sample_id LEFT JOIN vd ON base.sample_id IS NOT DISTINCT FROM vd.sample_id""",
        REPERTOIRE_COLUMNS,
    )


for _name, _weighting in (("repertoire_cell", "cell"), ("repertoire_sequence", "unique_sequence"), ("repertoire_clonotype", "clonotype")):
    query(_name, _repertoire_sql(_weighting))(lambda spark, sf_dir, w=_weighting: metrics.repertoire_metrics(assigned(spark, sf_dir), groupby="sample_id", weighting=w, order_by="source_order"))


# --- samples -------------------------------------------------------------------------------------
BULK = f"{S}, b AS (SELECT sample_id, rfu_label, count(DISTINCT cell_id) AS n FROM s WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL GROUP BY ALL)"


def bulk(spark, sf_dir, **options) -> samples.Pseudobulk:
    return samples.pseudobulk(sampled(spark, sf_dir), sample="sample_id", **options)


ELIGIBLE = "ok AS (SELECT sample_id FROM s WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL GROUP BY sample_id HAVING count(DISTINCT cell_id) >= 4 AND count(DISTINCT cdr3aa) >= 10)"


@query("pseudobulk_counts", final(f"{BULK}, {ELIGIBLE} SELECT sample_id, rfu_label, n, n AS value FROM b WHERE sample_id IN (SELECT sample_id FROM ok)", "sample_id rfu_label n:i value:d"))
def _(spark, sf_dir):
    return bulk(spark, sf_dir, min_cells=4, min_sequences=10).matrix


@query("pseudobulk_sequence", final(f"{S} SELECT sample_id, rfu_label, count(DISTINCT cdr3aa) AS n, count(DISTINCT cdr3aa) AS value FROM s WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL AND coalesce(pass_thr, false) GROUP BY ALL", "sample_id rfu_label n:i value:d"))
def _(spark, sf_dir):
    return bulk(spark, sf_dir, weighting="unique_sequence", assignment_policy="threshold_pass").matrix


PREVALENT = "keep AS (SELECT rfu_label FROM b GROUP BY rfu_label HAVING count(*) >= ceil(0.25 * (SELECT count(DISTINCT sample_id) FROM s)))"


@query("pseudobulk_prevalence", final(f"{BULK}, {PREVALENT} SELECT sample_id, rfu_label, n FROM b WHERE rfu_label IN (SELECT rfu_label FROM keep)", "sample_id rfu_label n:i"))
def _(spark, sf_dir):
    return bulk(spark, sf_dir, min_prevalence=0.25).matrix.drop("value")


for _name, _kind, _scale in (("pseudobulk_proportion", "proportion", "1.0"), ("pseudobulk_per_1000", "counts_per_1000", "1000.0")):
    query(_name, final(f"{BULK} SELECT sample_id, rfu_label, n, n * {_scale} / sum(n) OVER (PARTITION BY sample_id) AS value FROM b", "sample_id rfu_label n:i value:d"))(lambda spark, sf_dir, k=_kind: bulk(spark, sf_dir, normalize=k).matrix)

GRID = "grid AS (SELECT sample_id, rfu_label, coalesce(n, 0) AS n FROM (SELECT DISTINCT sample_id FROM s) x CROSS JOIN (SELECT DISTINCT rfu_label FROM b) y LEFT JOIN b USING (sample_id, rfu_label))"


@query("pseudobulk_clr", final(f"{BULK}, {GRID} SELECT sample_id, rfu_label, n, ln(n + 0.5) - avg(ln(n + 0.5)) OVER (PARTITION BY sample_id) AS value FROM grid", "sample_id rfu_label n:i value:d"))
def _(spark, sf_dir):
    return samples.densify(bulk(spark, sf_dir, normalize="clr"), "sample_id")


@query("pseudobulk_zero_levels", final(f"{BULK} SELECT rfu_label, coalesce(sum(n), 0) AS total_abundance, count(sample_id) AS sample_prevalence_count, count(sample_id) * 1.0 / (SELECT count(DISTINCT sample_id) FROM s) AS sample_prevalence FROM (SELECT 'RFU' || CAST(unnest(range(1, 61)) AS VARCHAR) AS rfu_label) l LEFT JOIN b USING (rfu_label) GROUP BY rfu_label", "rfu_label total_abundance:i sample_prevalence_count:i sample_prevalence:d"))
def _(spark, sf_dir):
    levels = spark.range(1, 61).select(F.concat(F.lit("RFU"), F.col("id").cast("string")).alias("rfu_label"))
    return bulk(spark, sf_dir, rfu_levels=levels, min_prevalence=1).rfu_metadata


@query("sample_metadata", final(f"{S} SELECT sample_id, min(donor_id) AS donor_id, min(cohort) AS cohort, min(timepoint) AS timepoint FROM s GROUP BY sample_id", "sample_id donor_id cohort timepoint:i"))
def _(spark, sf_dir):
    return samples.sample_metadata(sampled(spark, sf_dir), "sample_id", ["donor_id", "cohort", "timepoint"])


@query("rfu_metadata", final(f"{BULK} SELECT rfu_label, sum(n) AS total_abundance, count(*) AS sample_prevalence_count, count(*) * 1.0 / (SELECT count(DISTINCT sample_id) FROM s) AS sample_prevalence FROM b GROUP BY rfu_label", "rfu_label total_abundance:i sample_prevalence_count:i sample_prevalence:d"))
def _(spark, sf_dir):
    return bulk(spark, sf_dir).rfu_metadata


@query("sample_qc", final(f"{S}, q AS (SELECT sample_id, count(*) AS input_row_count, count(*) FILTER (WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL) AS assigned_row_count, count(DISTINCT cell_id) FILTER (WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL) AS unique_cell_count, count(DISTINCT cdr3aa) FILTER (WHERE rfu_label IS NOT NULL) AS unique_sequence_count FROM s GROUP BY sample_id) SELECT *, unique_cell_count >= 4 AND unique_sequence_count >= 10 AS passes_minimum FROM q", "sample_id input_row_count:i assigned_row_count:i unique_cell_count:i unique_sequence_count:i passes_minimum"))
def _(spark, sf_dir):
    return samples.sample_qc(sampled(spark, sf_dir), "sample_id", min_cells=4, min_sequences=10)


PAIRS = f"{BULK}, {GRID}, p AS (SELECT a.sample_id AS sample_a, b.sample_id AS sample_b, a.n AS x, b.n AS y, sum(a.n) OVER w AS tx, sum(b.n) OVER w AS ty FROM grid a JOIN grid b ON a.rfu_label = b.rfu_label AND a.sample_id <= b.sample_id WINDOW w AS (PARTITION BY a.sample_id, b.sample_id))"
HALF = "(x * 1.0 / tx + y * 1.0 / ty) / 2"
JS = f"0.5 * sum(CASE WHEN x > 0 THEN x * 1.0 / tx * ln(x * 1.0 / tx / ({HALF})) ELSE 0 END + CASE WHEN y > 0 THEN y * 1.0 / ty * ln(y * 1.0 / ty / ({HALF})) ELSE 0 END)"
OVERLAP_SQL = {
    "overlap_jaccard": ("jaccard", "count(*) FILTER (WHERE x > 0 AND y > 0) * 1.0 / nullif(count(*) FILTER (WHERE x > 0 OR y > 0), 0)"),
    "overlap_dice": ("sorensen_dice", "count(*) FILTER (WHERE x > 0 AND y > 0) * 2.0 / nullif(count(*) FILTER (WHERE x > 0) + count(*) FILTER (WHERE y > 0), 0)"),
    "overlap_coefficient": ("overlap_coefficient", "count(*) FILTER (WHERE x > 0 AND y > 0) * 1.0 / nullif(least(count(*) FILTER (WHERE x > 0), count(*) FILTER (WHERE y > 0)), 0)"),
    "overlap_cosine": ("cosine", "sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0)"),
    "overlap_braycurtis": ("bray_curtis_dissimilarity", "sum(abs(x - y)) * 1.0 / nullif(sum(x + y), 0)"),
    "overlap_braycurtis_sim": ("bray_curtis_similarity", "1 - sum(abs(x - y)) * 1.0 / nullif(sum(x + y), 0)"),
    "overlap_wjaccard": ("weighted_jaccard", "sum(least(x, y)) * 1.0 / nullif(sum(greatest(x, y)), 0)"),
    "overlap_jsd": ("jensen_shannon_distance", f"CASE WHEN max(tx) > 0 AND max(ty) > 0 THEN sqrt(CASE WHEN {JS} > 1e-12 THEN {JS} ELSE 0 END) END"),
}


def overlaps(spark, sf_dir, metric: str) -> DataFrame:
    own = bulk(spark, sf_dir)
    return samples.overlap(own.matrix, own.sample_metadata, sample="sample_id", metric=metric)


for _name, (_metric, _expression) in OVERLAP_SQL.items():
    query(_name, final(f"{PAIRS} SELECT sample_a, sample_b, {_expression} AS value FROM p GROUP BY sample_a, sample_b", "sample_a sample_b value:d"))(lambda spark, sf_dir, m=_metric: overlaps(spark, sf_dir, m))

#: Bounded overlaps: the overlap whose SQL is filtered, and the bound.
BOUNDED = {
    "similar_jaccard": ("overlap_jaccard", 0.55),
    "similar_dice": ("overlap_dice", 0.8),
    "similar_coefficient": ("overlap_coefficient", 0.85),
    "similar_cosine": ("overlap_cosine", 0.75),
    "similar_braycurtis": ("overlap_braycurtis", 0.4),
    "similar_wjaccard": ("overlap_wjaccard", 0.45),
    "similar_jsd": ("overlap_jsd", 0.35),
}
for _name, (_full, _bound) in BOUNDED.items():
    _metric, _expression = OVERLAP_SQL[_full]
    _test = f"value {'<=' if samples.direction(_metric) == 'distance' else '>='} {_bound}"
    query(_name, final(f"{PAIRS}, v AS (SELECT sample_a, sample_b, {_expression} AS value FROM p GROUP BY sample_a, sample_b) SELECT * FROM v WHERE {_test}", "sample_a sample_b value:d"))(
        lambda spark, sf_dir, m=_metric, b=_bound: similarity.similar_samples(bulk(spark, sf_dir).matrix, sample="sample_id", metric=m, bound=b)
    )

for _name, _full in (("nearest_cosine", "overlap_cosine"), ("nearest_jsd", "overlap_jsd")):
    _metric, _expression = OVERLAP_SQL[_full]
    _order = "round(value, 9)" + " DESC" * (samples.direction(_metric) == "similarity")
    query(
        _name,
        final(
            f"""{PAIRS}, v AS (SELECT sample_a, sample_b, {_expression} AS value FROM p WHERE sample_a < sample_b GROUP BY sample_a, sample_b),
 d AS (SELECT sample_a AS query, sample_b AS other, value FROM v WHERE value IS NOT NULL UNION ALL SELECT sample_b, sample_a, value FROM v WHERE value IS NOT NULL)
 SELECT *, row_number() OVER (PARTITION BY query ORDER BY {_order}, other) AS rank FROM d QUALIFY rank <= 5""",
            "query other value:d rank:i",
        ),
    )(lambda spark, sf_dir, m=_metric: similarity.nearest_samples(bulk(spark, sf_dir).matrix, sample="sample_id", metric=m, k=5))


# --- phenotypes and sequences ------------------------------------------------------------------------
COUPLING = f"""{A}, w AS (SELECT * FROM assigned WHERE rfu_label IS NOT NULL AND cell_type IS NOT NULL AND cdr3aa IS NOT NULL), levels AS (SELECT DISTINCT cell_type FROM assigned WHERE cell_type IS NOT NULL),
 c AS (SELECT rfu_label, cell_type, count(DISTINCT cell_id) AS n, count(DISTINCT sample_id) AS own FROM w GROUP BY ALL),
 t AS (SELECT rfu_label, sum(n) AS total, {sql_shannon('n')} AS h, max(n) AS top, count(*) AS seen, arg_min(cell_type, (-n, lower(cell_type))) AS dom FROM c GROUP BY rfu_label),
 r AS (SELECT rfu_label, count(DISTINCT sample_id) AS rec FROM w GROUP BY rfu_label), e AS (SELECT cell_type, count(DISTINCT sample_id) AS each_ FROM assigned WHERE cell_type IS NOT NULL GROUP BY cell_type),
 o AS (SELECT rfu_label, cell_type, 'cell' AS weighting, 'nearest' AS assignment_policy, total AS total_abundance, coalesce(n, 0) AS phenotype_specific_abundance, coalesce(n, 0) * 1.0 / total AS phenotype_specific_proportion, h AS phenotype_entropy,
  h / ln((SELECT count(*) FROM levels)) AS normalized_phenotype_entropy, 1 - h / ln((SELECT count(*) FROM levels)) AS phenotype_specificity, dom AS dominant_phenotype, top * 1.0 / total AS dominant_phenotype_fraction, seen AS represented_phenotype_count,
  rec AS sample_recurrence_count, rec * 1.0 / (SELECT count(DISTINCT sample_id) FROM assigned) AS sample_prevalence, coalesce(own, 0) AS phenotype_sample_recurrence_count, coalesce(own, 0) * 1.0 / each_ AS phenotype_sample_prevalence
  FROM t CROSS JOIN levels JOIN r USING (rfu_label) JOIN e USING (cell_type) LEFT JOIN c USING (rfu_label, cell_type))"""
COUPLING_COLUMNS = "rfu_label cell_type weighting assignment_policy total_abundance:i phenotype_specific_abundance:i phenotype_specific_proportion:d phenotype_entropy:d normalized_phenotype_entropy:d phenotype_specificity:d dominant_phenotype dominant_phenotype_fraction:d represented_phenotype_count:i"
RECURRENCE_COLUMNS = "rfu_label cell_type sample_recurrence_count:i sample_prevalence:d phenotype_sample_recurrence_count:i phenotype_sample_prevalence:d"


@query("phenotype_coupling", final(f"{COUPLING} SELECT * FROM o", COUPLING_COLUMNS))
def _(spark, sf_dir):
    return phenotype.phenotype_coupling(assigned(spark, sf_dir), phenotype="cell_type")


@query("phenotype_recurrence", final(f"{COUPLING} SELECT * FROM o", RECURRENCE_COLUMNS))
def _(spark, sf_dir):
    return phenotype.phenotype_coupling(assigned(spark, sf_dir), phenotype="cell_type", sample="sample_id").select(*[c.split(":")[0] for c in RECURRENCE_COLUMNS.split()])


def _matrix_sql(weighting: str) -> str:
    weights = {
        "unique_sequence": "SELECT DISTINCT cdr3aa, 1.0 AS weight FROM r",
        "cell": "SELECT cdr3aa, count(DISTINCT cell_id) * 1.0 AS weight FROM r GROUP BY cdr3aa",
        "clonotype": "SELECT cdr3aa, sum(1.0 / k) AS weight FROM (SELECT cdr3aa, count(*) OVER (PARTITION BY clonotype_id) AS k FROM (SELECT DISTINCT clonotype_id, cdr3aa FROM r) d) u GROUP BY cdr3aa",
    }[weighting]
    more = " AND clonotype_id IS NOT NULL" if weighting == "clonotype" else ""
    return final(
        f"""{A}, r AS (SELECT * FROM assigned WHERE rfu_label = 'RFU7' AND cdr3aa IS NOT NULL{more}), wt AS ({weights}), m AS (SELECT max(length(cdr3aa)) AS width FROM wt),
 al AS (SELECT weight, width, substr(cdr3aa, 1, length(cdr3aa) - 1) AS head, cdr3aa, width - length(cdr3aa) AS gap FROM wt, m),
 aligned AS (SELECT weight, width, CASE WHEN cdr3aa LIKE '%F' OR cdr3aa LIKE '%W' THEN head || repeat('-', gap) || substr(cdr3aa, length(cdr3aa), 1) ELSE repeat('-', CAST(floor(gap / 2.0) AS INT)) || cdr3aa || repeat('-', gap - CAST(floor(gap / 2.0) AS INT)) END AS a FROM al),
 parts AS (SELECT position, substr(a, CAST(position AS INT), 1) AS residue, weight FROM (SELECT a, weight, unnest(range(1, width + 1)) AS position FROM aligned) t),
 sums AS (SELECT position, residue, sum(weight) AS w FROM parts GROUP BY ALL)
 SELECT position, residue, coalesce(w / sum(w) OVER (PARTITION BY position), 0) AS frequency FROM (SELECT unnest(range(1, width + 1)) AS position FROM m) p CROSS JOIN (SELECT unnest(string_split('A,C,D,E,F,G,H,I,K,L,M,N,P,Q,R,S,T,V,W,Y,-', ',')) AS residue) l LEFT JOIN sums USING (position, residue)""",
        "position:i residue frequency:d",
    )


for _name, _weighting in (("sequence_matrix_unique", "unique_sequence"), ("sequence_matrix_cell", "cell"), ("sequence_matrix_clonotype", "clonotype")):
    query(_name, _matrix_sql(_weighting))(lambda spark, sf_dir, w=_weighting: phenotype.sequence_matrix(assigned(spark, sf_dir).where("clonotype_id is not null") if w == "clonotype" else assigned(spark, sf_dir), rfu="RFU7", weighting=w))


# --- tables behind figures -----------------------------------------------------------------------------
@query("top_rfus", final(f"{BULK} SELECT rfu_label, sum(n) AS total FROM b GROUP BY rfu_label ORDER BY total DESC, {sql_natural('rfu_label')} LIMIT 10", "rfu_label total:d"))
def _(spark, sf_dir):
    return tables.top_rfus(bulk(spark, sf_dir).matrix, 10)


@query("rfu_zscore", final(f"{BULK}, {GRID}, t AS (SELECT rfu_label FROM b GROUP BY rfu_label ORDER BY sum(n) DESC, rfu_label LIMIT 15) SELECT sample_id, rfu_label, n AS value, CASE WHEN stddev_pop(n) OVER w > 1e-12 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END AS z FROM grid WHERE rfu_label IN (SELECT rfu_label FROM t) WINDOW w AS (PARTITION BY rfu_label)", "sample_id rfu_label value:d z:d"))
def _(spark, sf_dir):
    own = bulk(spark, sf_dir)
    return tables.sparse_zscore(own.matrix, own.sample_metadata, sample="sample_id", top_n=15)


@query("phenotype_top", final(f"{COUPLING}, k AS (SELECT rfu_label FROM o GROUP BY rfu_label HAVING avg(CAST(phenotype_specific_proportion > 0 AS INT)) >= 0.5 ORDER BY round(sum(phenotype_specific_proportion), 9) DESC, rfu_label LIMIT 10) SELECT * FROM o WHERE rfu_label IN (SELECT rfu_label FROM k)", "rfu_label cell_type phenotype_specific_proportion:d"))
def _(spark, sf_dir):
    return tables.phenotype_top(phenotype.phenotype_coupling(assigned(spark, sf_dir), phenotype="cell_type"), "cell_type", 10, 0.5)


@query("convergence_top", final(f"{A}, w AS (SELECT * FROM assigned WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL) SELECT cell_type, rfu_label, count(DISTINCT cell_id) AS cell_abundance, count(DISTINCT cdr3aa) AS convergence_richness FROM w GROUP BY ALL ORDER BY 3 DESC, 4 DESC, cell_type, rfu_label LIMIT 12", "cell_type rfu_label cell_abundance:i convergence_richness:i"))
def _(spark, sf_dir):
    return tables.convergence_top(_metrics(spark, sf_dir, "cell", "nearest"), 12, order=("cell_type", "rfu_label")).select("cell_type", "rfu_label", "cell_abundance", "convergence_richness")


@query("score_histogram", final(f"{A}, e AS (SELECT min(rfu_score) AS a, max(rfu_score) AS b FROM assigned), c AS (SELECT least(floor((rfu_score - a) * 20 / (b - a)), 19) AS bin, count(*) AS n FROM assigned, e WHERE rfu_score IS NOT NULL GROUP BY 1) SELECT g.bin, a + g.bin * (b - a) / 20 AS low, a + (g.bin + 1) * (b - a) / 20 AS high, coalesce(n, 0) AS n FROM (SELECT unnest(range(0, 20)) AS bin) g CROSS JOIN e LEFT JOIN c ON c.bin = g.bin", "bin:i low:d high:d n:i"))
def _(spark, sf_dir):
    return tables.score_histogram(assigned(spark, sf_dir), 20)


@query("metric_comparison", final(f"{S} SELECT sample_id, count(DISTINCT cdr3aa) AS left_value, count(DISTINCT rfu_label) AS right_value FROM s GROUP BY sample_id", "sample_id left_value:i right_value:i"))
def _(spark, sf_dir):
    rows = stage(sampled(spark, sf_dir).select("sample_id", "cell_id", "cdr3aa", "clonotype_id", "v_call", "productive", "source_order", "rfu_label", "rfu_score"), "sampled-rows")  # both read it
    left = metrics.repertoire_metrics(rows, groupby="sample_id", weighting="cell", order_by="source_order")
    right = metrics.rfu_summary(rows, "sample_id")
    return tables.metric_comparison(left, right, sample="sample_id", left_metric="unique_cdr3_richness", right_metric="n_unique_rfu")


# --- coverage and transfer --------------------------------------------------------------------------------
STATUS = "CASE WHEN cdr3aa IS NULL THEN 'missing_sequence' WHEN cdr3aa NOT LIKE 'C%' THEN 'ineligible_sequence' WHEN rfu_label IS NULL THEN 'upstream_unassigned' WHEN coalesce(pass_thr, false) THEN 'covered' ELSE 'below_threshold' END"
QUANTILE_SQL = ", ".join(f"quantile_cont(rfu_score, {q}) AS score_q{round(q * 100):02d}" for q in coverage.QUANTILES)
QUANTILE_COLUMNS = " ".join(f"score_q{round(q * 100):02d}:d" for q in coverage.QUANTILES)


@query(
    "reference_coverage",
    final(
        f"""{A}, x AS (SELECT *, {STATUS} AS st FROM assigned), y AS (SELECT cohort, count(*) AS n_rows, count(*) FILTER (WHERE st NOT IN ('missing_sequence', 'ineligible_sequence')) AS n_eligible, count(*) FILTER (WHERE st IN ('covered', 'below_threshold')) AS n_assigned,
 count(*) FILTER (WHERE st = 'covered') AS n_covered, count(*) FILTER (WHERE st = 'below_threshold') AS n_below_threshold, count(*) FILTER (WHERE st = 'upstream_unassigned') AS n_unassigned, count(*) FILTER (WHERE st = 'ineligible_sequence') AS n_ineligible, count(*) FILTER (WHERE st = 'missing_sequence') AS n_missing,
 {QUANTILE_SQL}, count(DISTINCT cdr3aa) FILTER (WHERE st NOT IN ('missing_sequence', 'ineligible_sequence')) AS n_sequences, count(DISTINCT cdr3aa) FILTER (WHERE st = 'covered') AS n_covered_sequences, count(DISTINCT cell_id) FILTER (WHERE st NOT IN ('missing_sequence', 'ineligible_sequence')) AS n_cells, count(DISTINCT cell_id) FILTER (WHERE st = 'covered') AS n_covered_cells
 FROM x GROUP BY cohort) SELECT *, n_covered_sequences * 1.0 / n_sequences AS sequence_coverage, n_covered_cells * 1.0 / n_cells AS cell_coverage FROM y""",
        f"cohort n_rows:i n_eligible:i n_assigned:i n_covered:i n_below_threshold:i n_unassigned:i n_ineligible:i n_missing:i {QUANTILE_COLUMNS} n_sequences:i n_covered_sequences:i n_cells:i n_covered_cells:i sequence_coverage:d cell_coverage:d",
    ),
)
def _(spark, sf_dir):
    return coverage.reference_coverage(coverage.with_status(assigned(spark, sf_dir)), groupby="cohort")


_ROW = "sha256(CAST(vec_id + 1 AS VARCHAR) || '|' || array_to_string(list_transform(CAST(embedding AS DOUBLE[]), lambda x: CAST(CAST(floor(x * 1000000 + 0.5) AS BIGINT) AS VARCHAR)), ','))"
_LIMBS = " || ':' || ".join(f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS VARCHAR)" for i in range(8))


@query("reference_fingerprint", f"SELECT count(*) AS n_rfus, sha256({_LIMBS} || '|threshold=0.25') AS reference_id FROM (SELECT {_ROW} AS h FROM embeddings) t")
def _(spark, sf_dir):
    return coverage.reference_fingerprint(centroid_reference(spark, sf_dir), "threshold=0.25")


@query("reference_parts", f"SELECT cluster_size, count(*) AS n_rfus, sha256({_LIMBS}) AS part_id FROM (SELECT vec_id % 7 + 1 AS cluster_size, {_ROW} AS h FROM embeddings) t GROUP BY cluster_size")
def _(spark, sf_dir):
    parts = coverage.reference_parts(centroid_reference(spark, sf_dir), ["cluster_size"])
    return parts.select("cluster_size", F.col("n_rows").alias("n_rfus"), digest(F.col("limbs")).alias("part_id"))


@query("transfer_cohort", final(f"{A} SELECT cohort, count(*) AS n_rows, count(DISTINCT sample_id) AS n_samples, count(rfu_label) AS n_assigned, count(*) FILTER (WHERE pass_thr) AS n_covered, count(DISTINCT rfu_label) AS n_observed_rfus, (SELECT count(*) FROM embeddings) AS n_reference_rfus, count(*) FILTER (WHERE pass_thr) * 1.0 / count(*) AS coverage, count(DISTINCT rfu_label) * 1.0 / (SELECT count(*) FROM embeddings) AS rfu_share FROM assigned WHERE cohort IS NOT NULL GROUP BY cohort", "cohort n_rows:i n_samples:i n_assigned:i n_covered:i n_observed_rfus:i n_reference_rfus:i coverage:d rfu_share:d"))
def _(spark, sf_dir):
    labels = centroid_reference(spark, sf_dir).select(F.concat(F.lit("RFU"), F.col("rfu_id").cast("string")).alias("rfu_label"))
    return coverage.transfer_cohort(assigned(spark, sf_dir), labels)


RULES = [("A", "cell_type", "1-URGENT", "high"), ("A", "cell_type", "2-HIGH", "high"), ("B", "cell_type", "1-URGENT", "top"), ("B", "cell_type", "5-LOW", "low")]
RULES_SQL = ", ".join(str(r) for r in RULES)


@query("harmonize_metadata", final(f"{V('cells')}, m AS (SELECT * FROM (VALUES {RULES_SQL}) v(cohort, field, cell_type, target_value)) SELECT cells.cohort, target_value, count(*) AS n_rows, count(*) FILTER (WHERE cells.cell_type IS NOT NULL AND target_value IS NULL) AS n_unmapped, count(*) FILTER (WHERE cells.cell_type IS NULL) AS n_missing FROM cells LEFT JOIN m USING (cohort, cell_type) GROUP BY ALL", "cohort target_value n_rows:i n_unmapped:i n_missing:i"))
def _(spark, sf_dir):
    mapping = spark.createDataFrame(RULES, "cohort string, field string, source_value string, target_value string")
    return coverage.harmonize_metadata(cells(spark, sf_dir), mapping, "cell_type")


@query("heldout_roles", final(f"{V('cells')} SELECT CASE WHEN cohort = 'A' THEN 'discovery' ELSE 'validation' END AS role, count(DISTINCT cohort) AS n_cohorts, count(DISTINCT sample_id) AS n_samples FROM cells GROUP BY 1", "role n_cohorts:i n_samples:i"))
def _(spark, sf_dir):
    roles = cells(spark, sf_dir).select("cohort", "sample_id", F.when(F.col("cohort") == "A", "discovery").otherwise("validation").alias("role")).distinct()
    return coverage.heldout_roles(roles)


# --- donors over time ----------------------------------------------------------------------------------------
PLAN = f"{S}, plan AS (SELECT sample_id, min(donor_id) AS donor_id, min(timepoint) AS timepoint FROM s GROUP BY sample_id)"
KEYS = {"sample": "sample_id", "donor": "donor_id", "time": "timepoint"}


def plan(spark, sf_dir) -> DataFrame:
    return longitudinal.design(sampled(spark, sf_dir), **KEYS)


@query("longitudinal_design", final(f"{PLAN} SELECT plan.*, dense_rank() OVER (PARTITION BY donor_id ORDER BY timepoint) AS visit, n_visits, count(*) OVER (PARTITION BY donor_id, timepoint) AS n_same_visit FROM plan JOIN (SELECT donor_id, count(DISTINCT timepoint) AS n_visits FROM plan GROUP BY donor_id) v USING (donor_id)", "sample_id donor_id timepoint:i visit:i n_visits:i n_same_visit:i"))
def _(spark, sf_dir):
    return plan(spark, sf_dir)


@query("longitudinal_matrix", final(f"{BULK}, plan AS (SELECT sample_id, min(donor_id) AS donor_id, min(timepoint) AS timepoint FROM s GROUP BY sample_id) SELECT donor_id, timepoint, sample_id, rfu_label, n AS value FROM b JOIN plan USING (sample_id)", "donor_id timepoint:i sample_id rfu_label value:d"))
def _(spark, sf_dir):
    return longitudinal.longitudinal_matrix(bulk(spark, sf_dir).matrix, plan(spark, sf_dir), **KEYS).drop("n")


@query("longitudinal_missing", final(f"{PLAN} SELECT d.donor_id, t.timepoint FROM (SELECT DISTINCT donor_id FROM plan) d CROSS JOIN (SELECT DISTINCT timepoint FROM plan) t ANTI JOIN plan USING (donor_id, timepoint)", "donor_id timepoint:i"))
def _(spark, sf_dir):
    return longitudinal.missing_visits(plan(spark, sf_dir), donor="donor_id", time="timepoint")


@query("longitudinal_gaps", """WITH plan AS (SELECT DISTINCT o_custkey AS customer, year(o_orderdate) AS timepoint FROM orders) SELECT d.customer, CAST(t.timepoint AS BIGINT) AS timepoint FROM (SELECT DISTINCT customer FROM plan) d CROSS JOIN (SELECT DISTINCT timepoint FROM plan) t ANTI JOIN plan USING (customer, timepoint)""")
def _(spark, sf_dir):
    """Visits by customer: no customer orders in every year, at any scale."""
    visits = load(spark, sf_dir, "orders").select(F.concat_ws("_", "o_custkey", F.year("o_orderdate")).alias("sample_id"), F.col("o_custkey").alias("customer"), F.year("o_orderdate").alias("timepoint"))
    own = longitudinal.design(visits, sample="sample_id", donor="customer", time="timepoint")
    return longitudinal.missing_visits(own, donor="customer", time="timepoint")


def similar(spark, sf_dir) -> DataFrame:
    return longitudinal.similarity_pairs(overlaps(spark, sf_dir, "cosine"), plan(spark, sf_dir), **KEYS)


SIMILAR = f"""{PAIRS}, plan AS (SELECT sample_id, min(donor_id) AS donor_id, min(timepoint) AS timepoint FROM s GROUP BY sample_id),
 v AS (SELECT sample_a, sample_b, sum(x * y) / nullif(sqrt(sum(x * x)) * sqrt(sum(y * y)), 0) AS value FROM p WHERE sample_a < sample_b GROUP BY ALL),
 sim AS (SELECT v.*, a.donor_id AS donor_a, b.donor_id AS donor_b, a.donor_id = b.donor_id AS same_donor, abs(a.timepoint - b.timepoint) AS time_gap FROM v JOIN plan a ON sample_a = a.sample_id JOIN plan b ON sample_b = b.sample_id)"""


@query("longitudinal_similarity", final(f"{SIMILAR} SELECT * FROM sim", "sample_a sample_b value:d donor_a donor_b same_donor time_gap:i"))
def _(spark, sf_dir):
    return similar(spark, sf_dir)


@query("longitudinal_similarity_summary", final(f"{SIMILAR} SELECT same_donor, count(value) AS n_pairs, avg(value) AS mean_value, median(value) AS median_value FROM sim GROUP BY same_donor", "same_donor n_pairs:i mean_value:d median_value:d"))
def _(spark, sf_dir):
    return longitudinal.summarize_similarity(similar(spark, sf_dir))


@query("donor_retrieval", final(f"{SIMILAR}, both_ AS (SELECT sample_a AS query, sample_b AS other, value, same_donor FROM sim UNION ALL SELECT sample_b, sample_a, value, same_donor FROM sim), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(value, 9) DESC, other) AS r FROM both_ WHERE value IS NOT NULL), f AS (SELECT query, count(*) AS n_ranked, min(r) FILTER (WHERE same_donor) AS first_rank FROM k GROUP BY query) SELECT *, coalesce(1.0 / first_rank, 0) AS reciprocal_rank, coalesce(first_rank <= 5, false) AS hit FROM f", "query n_ranked:i first_rank:i reciprocal_rank:d hit"))
def _(spark, sf_dir):
    return longitudinal.donor_retrieval(similar(spark, sf_dir))


@query("donor_retrieval_nearest", final(f"{SIMILAR}, both_ AS (SELECT sample_a AS query, sample_b AS other, value, same_donor FROM sim UNION ALL SELECT sample_b, sample_a, value, same_donor FROM sim), k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(value, 9) DESC, other) AS r FROM both_ WHERE value IS NOT NULL), f AS (SELECT query, count(*) AS n_ranked, min(r) FILTER (WHERE same_donor) AS first_rank FROM k WHERE r <= 5 GROUP BY query) SELECT *, coalesce(1.0 / first_rank, 0) AS reciprocal_rank, first_rank IS NOT NULL AS hit FROM f", "query n_ranked:i first_rank:i reciprocal_rank:d hit"))
def _(spark, sf_dir):
    nearest = similarity.nearest_samples(bulk(spark, sf_dir).matrix, sample="sample_id", metric="cosine", k=5)
    return longitudinal.donor_retrieval_of(nearest, plan(spark, sf_dir), sample="sample_id", donor="donor_id", k=5)


@query("longitudinal_dynamics", final(f"""{PLAN}, b AS (SELECT sample_id, rfu_label, count(*) AS n FROM s WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL GROUP BY ALL), vis AS (SELECT donor_id, count(DISTINCT timepoint) AS n_visits, min(timepoint) AS t0, max(timepoint) AS t1 FROM plan GROUP BY donor_id),
 seen AS (SELECT donor_id, rfu_label, count(DISTINCT timepoint) AS n_present, min(timepoint) AS first_time, max(timepoint) AS last_time FROM b JOIN plan USING (sample_id) GROUP BY ALL)
 SELECT seen.*, n_visits, CASE WHEN n_visits = 1 THEN 'single_visit' WHEN n_present = n_visits THEN 'persistent' WHEN first_time <> t0 AND last_time = t1 THEN 'emerging' WHEN first_time = t0 AND last_time <> t1 THEN 'lost' ELSE 'transient' END AS trajectory FROM seen JOIN vis USING (donor_id)""", "donor_id rfu_label n_present:i n_visits:i first_time:i last_time:i trajectory"))
def _(spark, sf_dir):
    long = longitudinal.longitudinal_matrix(bulk(spark, sf_dir).matrix, plan(spark, sf_dir), **KEYS)
    return longitudinal.dynamics(long, plan(spark, sf_dir), donor="donor_id", time="timepoint")


COMPARTMENT = "donor_id || '_' || CAST(timepoint AS VARCHAR(10)) || '_' || cell_type"


@query("compartment_comparison", final(f"""{A}, u AS (SELECT *, {COMPARTMENT} AS unit FROM assigned WHERE donor_id IS NOT NULL), k AS (SELECT DISTINCT unit, donor_id, timepoint, cell_type FROM u), b AS (SELECT unit, rfu_label, count(DISTINCT cell_id) AS n FROM u WHERE rfu_label IS NOT NULL AND cdr3aa IS NOT NULL GROUP BY ALL), q AS (SELECT unit, sqrt(sum(n * n)) AS len FROM b GROUP BY unit),
 d AS (SELECT x.unit AS ua, y.unit AS ub, sum(x.n * y.n) AS dot FROM b x JOIN b y ON x.rfu_label = y.rfu_label AND x.unit < y.unit GROUP BY ALL)
 SELECT i.donor_id, i.timepoint, i.cell_type AS compartment_a, j.cell_type AS compartment_b, CASE WHEN qa.len > 0 AND qb.len > 0 THEN coalesce(dot, 0) / (qa.len * qb.len) END AS value FROM k i JOIN k j ON i.donor_id = j.donor_id AND i.timepoint = j.timepoint AND i.cell_type < j.cell_type
 LEFT JOIN q qa ON qa.unit = i.unit LEFT JOIN q qb ON qb.unit = j.unit LEFT JOIN d ON ua = i.unit AND ub = j.unit""", "donor_id timepoint:i compartment_a compartment_b value:d"))
def _(spark, sf_dir):
    rows = assigned(spark, sf_dir).where("donor_id is not null").withColumn("unit", F.concat_ws("_", "donor_id", F.col("timepoint").cast("string"), "cell_type"))
    own = samples.pseudobulk(rows, sample="unit", phenotypes=["donor_id", "timepoint", "cell_type"])
    pairs = longitudinal.compartment_pairs(own.sample_metadata, sample="unit", donor="donor_id", time="timepoint", compartment="cell_type")
    x = own.matrix.select("unit", "rfu_label", "value")
    size = x.groupBy("unit").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("len"))
    a = x.select(F.col("unit").alias("sample_a"), "rfu_label", F.col("value").alias("xa"))
    b = x.select(F.col("unit").alias("sample_b"), "rfu_label", F.col("value").alias("xb"))
    dots = pairs.join(a, "sample_a").join(b, ["sample_b", "rfu_label"]).groupBy("sample_a", "sample_b").agg(F.sum(F.col("xa") * F.col("xb")).alias("dot"))
    la, lb = size.select(F.col("unit").alias("sample_a"), F.col("len").alias("la")), size.select(F.col("unit").alias("sample_b"), F.col("len").alias("lb"))
    out = pairs.join(la, "sample_a", "left").join(lb, "sample_b", "left").join(dots, ["sample_a", "sample_b"], "left")
    value = F.when(F.col("la").isNotNull() & F.col("lb").isNotNull(), ratio(F.coalesce("dot", F.lit(0.0)), F.col("la") * F.col("lb")))
    return out.select("donor_id", "timepoint", "compartment_a", "compartment_b", value.alias("value"))


def _uniform_sql(parts: str) -> str:
    return f"(CAST(('0x' || substr(md5({parts}), 1, 13)) AS BIGINT) / 4503599627370496.0)"


@query("donor_bootstrap", final(f"""{A}, m AS (SELECT donor_id, avg(rfu_score) AS m FROM assigned WHERE donor_id IS NOT NULL GROUP BY donor_id), r AS (SELECT *, row_number() OVER (ORDER BY donor_id) - 1 AS slot FROM m), n AS (SELECT count(*) AS n FROM r),
 d AS (SELECT replicate, draw, n FROM (SELECT unnest(range(1, 51)) AS replicate) x CROSS JOIN n CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS draw) y), p AS (SELECT replicate, CAST(floor({_uniform_sql("'7|' || CAST(replicate AS VARCHAR) || '|' || CAST(draw AS VARCHAR)")} * n) AS BIGINT) AS slot FROM d)
 SELECT replicate, avg(m) AS statistic FROM p JOIN r USING (slot) GROUP BY replicate""", "replicate:i statistic:d"))
def _(spark, sf_dir):
    return longitudinal.donor_bootstrap(assigned(spark, sf_dir), donor="donor_id", value="rfu_score", replicates=50, seed=7)


@query("label_permutation", final(f"""{PLAN}, reps AS (SELECT sample_id, donor_id, CAST(timepoint AS VARCHAR) AS label, replicate FROM plan CROSS JOIN (SELECT unnest(range(1, 6)) AS replicate) x),
 a AS (SELECT replicate, donor_id, sample_id, row_number() OVER (PARTITION BY replicate, donor_id ORDER BY sample_id) AS i FROM reps), b AS (SELECT replicate, donor_id, label, row_number() OVER (PARTITION BY replicate, donor_id ORDER BY md5('3|' || CAST(replicate AS VARCHAR) || '|' || sample_id)) AS i FROM reps)
 SELECT replicate, donor_id, sample_id, label FROM a JOIN b USING (replicate, donor_id, i)""", "replicate:i donor_id sample_id label"))
def _(spark, sf_dir):
    units = plan(spark, sf_dir).select("sample_id", "donor_id", F.col("timepoint").cast("string").alias("label"))
    return longitudinal.permute_labels(units, unit="sample_id", block="donor_id", label="label", replicates=5, seed=3)


# --- antigen evidence ------------------------------------------------------------------------------------------
EV = f"""{V('assigned', 'evidence_ref', 'contigs', 'cells')}, seqs AS (SELECT cdr3aa, min(rfu_label) AS rfu_label, arg_min(v_call, source_order) AS query_v_call FROM assigned WHERE cdr3aa IS NOT NULL GROUP BY cdr3aa),
 mt AS (SELECT cdr3aa, rfu_label, query_v_call, epitope, count(*) AS n_entries, CASE WHEN bool_or(upper(query_v_call) = v_gene) THEN 'cdr3_v' ELSE 'cdr3' END AS tier FROM seqs JOIN evidence_ref ON cdr3aa = cdr3 GROUP BY ALL)"""


def sequences(spark, sf_dir) -> DataFrame:
    return assigned(spark, sf_dir).where("cdr3aa is not null").groupBy("cdr3aa").agg(F.min("rfu_label").alias("rfu_label"), F.min_by("v_call", "source_order").alias("query_v_call"))


def matches(spark, sf_dir) -> DataFrame:
    return evidence.annotate(sequences(spark, sf_dir), evidence.load_evidence(view(spark, sf_dir, "evidence_ref")))


@query("evidence_reference", final(f"{V('evidence_ref', 'contigs')} SELECT release_label, count(*) AS n_rows, count(DISTINCT cdr3 || '|' || v_gene || '|' || epitope) AS n_distinct_rows, count(*) FILTER (WHERE cdr3 IS NULL) AS n_missing_cdr3, count(DISTINCT cdr3) AS n_sequences, count(DISTINCT epitope) AS n_epitopes, CAST(sum(CAST(('0x' || substr(md5(cdr3 || '|' || v_gene || '|' || epitope), 1, 12)) AS BIGINT)) AS VARCHAR) AS fingerprint FROM evidence_ref GROUP BY release_label", "release_label n_rows:i n_distinct_rows:i n_missing_cdr3:i n_sequences:i n_epitopes:i fingerprint"))
def _(spark, sf_dir):
    return evidence.evidence_report(evidence.load_evidence(view(spark, sf_dir, "evidence_ref")))


@query("normalize_v_gene", final(f"{V('contigs')} SELECT raw, 'TRBV' || substr(raw, 5, 99) AS full_name, regexp_replace(upper(trim(raw)), '[*].*$', '') AS gene, nullif(regexp_extract(upper(trim(raw)), '[*](.*)$', 1), '') AS allele FROM (SELECT DISTINCT CASE WHEN v_gene LIKE '%1' THEN ' trbv' || substr(v_gene, 5, 9) || '*01 ' ELSE v_gene END AS raw FROM contigs) t", "raw gene allele"))
def _(spark, sf_dir):
    raw = F.when(F.col("v_gene").endswith("1"), F.concat(F.lit(" trbv"), F.substring("v_gene", 5, 9), F.lit("*01 "))).otherwise(F.col("v_gene"))
    own = contigs(spark, sf_dir).select(raw.alias("raw")).distinct()
    return own.select("raw", evidence.normalize_v_gene(F.col("raw")).alias("gene"), evidence.v_allele(F.col("raw")).alias("allele"))


@query("evidence_annotate", final(f"{EV} SELECT * FROM mt", "cdr3aa rfu_label query_v_call epitope n_entries:i tier"))
def _(spark, sf_dir):
    return matches(spark, sf_dir)


@query("evidence_summary", final(f"{EV} SELECT cdr3aa, string_agg(DISTINCT epitope, ',' ORDER BY epitope) AS epitopes, count(DISTINCT epitope) AS n_epitopes, count(DISTINCT epitope) > 1 AS ambiguous FROM mt GROUP BY cdr3aa", "cdr3aa epitopes n_epitopes:i ambiguous"))
def _(spark, sf_dir):
    return evidence.summarize_evidence(matches(spark, sf_dir))


AB = f"{EV}, ab AS (SELECT rfu_label, epitope, count(DISTINCT cdr3aa) AS n FROM mt WHERE rfu_label IS NOT NULL GROUP BY ALL), sh AS (SELECT *, n * 1.0 / sum(n) OVER (PARTITION BY rfu_label) AS p FROM ab)"


@query("antigen_abundance", final(f"{AB} SELECT rfu_label, epitope, n AS antigen_abundance, p AS within_rfu_proportion FROM sh", "rfu_label epitope antigen_abundance:i within_rfu_proportion:d"))
def _(spark, sf_dir):
    return evidence.antigen_abundance(matches(spark, sf_dir))


@query("antigen_table", final(f"{AB}, r AS (SELECT rfu_label FROM ab GROUP BY rfu_label ORDER BY sum(n) DESC, rfu_label LIMIT 8), e AS (SELECT epitope FROM ab GROUP BY epitope ORDER BY sum(n) DESC, epitope LIMIT 4) SELECT rfu_label, epitope, coalesce(n, 0) AS antigen_abundance FROM r CROSS JOIN e LEFT JOIN ab USING (rfu_label, epitope)", "rfu_label epitope antigen_abundance:i"))
def _(spark, sf_dir):
    return tables.antigen_table(evidence.antigen_abundance(matches(spark, sf_dir)), 8, 4)


COH = f"{AB}, co AS (SELECT sh.rfu_label, max(p) AS antigen_purity, {sql_shannon('n')} AS antigen_entropy, count(*) AS n_epitopes FROM sh GROUP BY 1), mc AS (SELECT rfu_label, count(DISTINCT cdr3aa) AS matched_sequences FROM mt GROUP BY 1), tc AS (SELECT rfu_label, count(DISTINCT cdr3aa) AS total_sequences FROM seqs GROUP BY 1), coh AS (SELECT co.*, matched_sequences, total_sequences, matched_sequences * 1.0 / total_sequences AS matched_fraction FROM co JOIN mc USING (rfu_label) JOIN tc USING (rfu_label))"


@query("antigen_coherence", final(f"{COH} SELECT * FROM coh", "rfu_label antigen_purity:d antigen_entropy:d n_epitopes:i matched_sequences:i total_sequences:i matched_fraction:d"))
def _(spark, sf_dir):
    return evidence.antigen_coherence(matches(spark, sf_dir), sequences(spark, sf_dir))


@query("antigen_coherence_global", final(f"{COH} SELECT count(*) AS n_groups, sum(matched_sequences) AS matched_sequences, sum(matched_sequences * antigen_purity) / sum(matched_sequences) AS weighted_purity, sum(matched_sequences * antigen_entropy) / sum(matched_sequences) AS weighted_entropy FROM coh", "n_groups:i matched_sequences:i weighted_purity:d weighted_entropy:d"))
def _(spark, sf_dir):
    return evidence.global_coherence(evidence.antigen_coherence(matches(spark, sf_dir), sequences(spark, sf_dir)))


def _purity_sql(rows: str, keys: str, grouping: str) -> str:
    k = f"{keys}, " if keys else ""
    using = f"({k}{grouping})"
    return f"SELECT {k}sum(purity * w) / sum(w) AS statistic FROM (SELECT {k}{grouping}, max(n) * 1.0 / sum(n) AS purity FROM (SELECT {k}{grouping}, epitope, count(DISTINCT cdr3aa) AS n FROM {rows} GROUP BY ALL) c GROUP BY ALL) g JOIN (SELECT {k}{grouping}, count(DISTINCT cdr3aa) AS w FROM {rows} GROUP BY ALL) z USING {using}" + (f" GROUP BY {keys}" if keys else "")


@query("antigen_permutation", final(f"""{EV}, own AS (SELECT DISTINCT cdr3aa, rfu_label, epitope FROM mt WHERE rfu_label IS NOT NULL), sq AS (SELECT cdr3aa, min(rfu_label) AS rfu_label, min(query_v_call) AS stratum FROM mt WHERE rfu_label IS NOT NULL GROUP BY cdr3aa), reps AS (SELECT sq.*, replicate FROM sq CROSS JOIN (SELECT unnest(range(1, 11)) AS replicate) x),
 pa AS (SELECT replicate, stratum, cdr3aa, row_number() OVER (PARTITION BY replicate, stratum ORDER BY cdr3aa) AS i FROM reps), pb AS (SELECT replicate, stratum, rfu_label, row_number() OVER (PARTITION BY replicate, stratum ORDER BY md5('5|' || CAST(replicate AS VARCHAR) || '|' || cdr3aa)) AS i FROM reps),
 sx AS (SELECT replicate, cdr3aa, rfu_label, epitope FROM pa JOIN pb USING (replicate, stratum, i) JOIN (SELECT DISTINCT cdr3aa, epitope FROM own) o USING (cdr3aa)), nul AS ({_purity_sql('sx', 'replicate', 'rfu_label')}), ob AS ({_purity_sql('own', '', 'rfu_label')})
 SELECT ob.statistic AS observed, count(*) AS n_replicates, count(*) FILTER (WHERE round(nul.statistic, 9) >= round(ob.statistic, 9)) AS n_at_least, avg(nul.statistic) AS null_mean, (count(*) FILTER (WHERE round(nul.statistic, 9) >= round(ob.statistic, 9)) + 1.0) / (count(*) + 1) AS p_value FROM nul, ob GROUP BY ob.statistic""", "observed:d n_replicates:i n_at_least:i null_mean:d p_value:d"))
def _(spark, sf_dir):
    return evidence.permutation_test(matches(spark, sf_dir), "query_v_call", replicates=10, seed=5)


GROUPINGS = {"rfu_label": "rfu_label", "v_gene": "query_v_call", "cdr3_length": "CAST(length(cdr3aa) AS VARCHAR)", "v_and_length": "query_v_call || '|' || CAST(length(cdr3aa) AS VARCHAR)"}


@query("antigen_groupings", final(f"{EV}, " + ", ".join(f"m{i} AS (SELECT *, {e} AS g FROM mt WHERE {e} IS NOT NULL)" for i, e in enumerate(GROUPINGS.values())) + " " + " UNION ALL ".join(f"SELECT '{name}' AS grouping_name, statistic FROM ({_purity_sql(f'm{i}', '', 'g')}) q{i}" for i, name in enumerate(GROUPINGS)), "grouping_name statistic:d"))
def _(spark, sf_dir):
    return evidence.compare_groupings(matches(spark, sf_dir)).withColumnRenamed("grouping", "grouping_name")


@query("antigen_context", final(f"{EV} SELECT k.rfu_label, epitope, cell_type, count(DISTINCT sample_id) AS n_samples, count(DISTINCT donor_id) AS n_donors, count(DISTINCT cell_id) AS n_cells FROM assigned a JOIN (SELECT DISTINCT cdr3aa, rfu_label, epitope FROM mt) k USING (cdr3aa) WHERE cell_type IS NOT NULL GROUP BY ALL", "rfu_label epitope cell_type n_samples:i n_donors:i n_cells:i"))
def _(spark, sf_dir):
    return evidence.antigen_context(matches(spark, sf_dir), assigned(spark, sf_dir), level="cell_type")


# --- robustness and comparators -----------------------------------------------------------------------------------
@query("subsample", final(f"{S} SELECT sample_id, source_order, cdr3aa FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY md5('11|' || CAST(source_order AS VARCHAR)), source_order) AS i FROM s) t WHERE i <= 25", "sample_id source_order:i cdr3aa"))
def _(spark, sf_dir):
    return robustness.subsample(sampled(spark, sf_dir), sample="sample_id", unit="source_order", n=25, seed=11).select("sample_id", "source_order", "cdr3aa")


def _resample_sql(seed: int, depth: int) -> str:
    u = _uniform_sql(f"'{seed}|' || sample_id || '|' || CAST(draw AS VARCHAR)")
    return f"SELECT sample_id, rfu_label, count(*) AS n FROM (SELECT sample_id, {u} AS u FROM (SELECT sample_id, unnest(range(1, {depth + 1})) AS draw FROM (SELECT DISTINCT sample_id FROM b) k) j) d JOIN lad USING (sample_id) WHERE u >= low AND u < high GROUP BY ALL"


LADDER = f"{BULK}, lad AS (SELECT sample_id, rfu_label, round((sum(n) OVER (PARTITION BY sample_id ORDER BY rfu_label ROWS UNBOUNDED PRECEDING) - n) * 1.0 / sum(n) OVER (PARTITION BY sample_id), 12) AS low, round(sum(n) OVER (PARTITION BY sample_id ORDER BY rfu_label ROWS UNBOUNDED PRECEDING) * 1.0 / sum(n) OVER (PARTITION BY sample_id), 12) AS high FROM b)"


@query("multinomial_resample", final(f"{LADDER} {_resample_sql(13, 40)}", "sample_id rfu_label n:i"))
def _(spark, sf_dir):
    return robustness.multinomial_resample(bulk(spark, sf_dir).matrix.select("sample_id", "rfu_label", "n"), sample="sample_id", feature="rfu_label", value="n", depth=40, seed=13)


@query("stability", final(f"{LADDER}, " + ", ".join(f"r{r} AS ({_resample_sql(17 + r, 40)})" for r in (1, 2)) + " " + " UNION ALL ".join(f"SELECT {r} AS replicate, sample_id, coalesce(sum(b.n * r{r}.n), 0) / (sqrt(sum(b.n * b.n)) * sqrt(sum(coalesce(r{r}.n * r{r}.n, 0)))) AS cosine FROM b LEFT JOIN r{r} USING (sample_id, rfu_label) GROUP BY sample_id" for r in (1, 2)), "replicate:i sample_id cosine:d"))
def _(spark, sf_dir):
    return robustness.stability(bulk(spark, sf_dir).matrix.select("sample_id", "rfu_label", "n"), sample="sample_id", feature="rfu_label", value="n", depth=40, replicates=2, seed=17)


@query("order_invariance", final(f"{BULK} SELECT sample_id, rfu_label, n FROM b", "sample_id rfu_label n:i"))
def _(spark, sf_dir):
    rows = robustness.shuffled(sampled(spark, sf_dir), "source_order", seed=23)
    return samples.pseudobulk(rows, sample="sample_id").matrix.drop("value")


@query("threshold_sensitivity", final(f"{A} SELECT threshold, count(*) AS n_scored, count(*) FILTER (WHERE rfu_score >= threshold) AS n_pass, count(DISTINCT rfu_label) FILTER (WHERE rfu_score >= threshold) AS n_rfus, count(DISTINCT cdr3aa) FILTER (WHERE rfu_score >= threshold) AS n_sequences, count(*) FILTER (WHERE rfu_score >= threshold) * 1.0 / count(*) AS pass_rate FROM assigned CROSS JOIN (SELECT unnest([0.2, 0.4, 0.6, 0.8, 0.95]) AS threshold) t WHERE rfu_score IS NOT NULL GROUP BY threshold", "threshold:d n_scored:i n_pass:i n_rfus:i n_sequences:i pass_rate:d"))
def _(spark, sf_dir):
    return robustness.threshold_sensitivity(assigned(spark, sf_dir), [0.2, 0.4, 0.6, 0.8, 0.95])


@query("leave_one_donor_out", final(f"{A}, w AS (SELECT * FROM assigned WHERE donor_id IS NOT NULL AND rfu_label IS NOT NULL), c AS (SELECT donor_id, rfu_label, count(*) AS n FROM w GROUP BY ALL) SELECT d.donor_id AS left_out, sum(c.n) AS n_rows, count(DISTINCT c.rfu_label) AS n_rfus FROM (SELECT DISTINCT donor_id FROM w) d JOIN c ON c.donor_id <> d.donor_id GROUP BY d.donor_id", "left_out n_rows:i n_rfus:i"))
def _(spark, sf_dir):
    return robustness.leave_one_donor_out(assigned(spark, sf_dir))


for _name, _kind, _feature in (("comparator_vgene", "v_gene", "v_call"), ("comparator_length", "cdr3_length", "CAST(length(cdr3aa) AS VARCHAR)"), ("comparator_cdr3", "cdr3", "cdr3aa"), ("comparator_clonotype", "clonotype", "clonotype_id"), ("comparator_rfu", "rfu", "rfu_label")):
    query(_name, final(f"{S} SELECT sample_id, feature, n * 1.0 / sum(n) OVER (PARTITION BY sample_id) AS value FROM (SELECT sample_id, {_feature} AS feature, count(*) AS n FROM s WHERE {_feature} IS NOT NULL GROUP BY ALL) t", "sample_id feature value:d"))(lambda spark, sf_dir, k=_kind: robustness.representation(assigned(spark, sf_dir), k))
