"""Assignment of CDR3 sequences to receptor functional units (RFUs)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoform.functions import scalars as S
from clonoform.functions.grouped import chain_rows, row_name, row_numbers
from clonoform.sources.staging import stage

SCORED = T.StructType([T.StructField("cdr3aa", T.StringType()), T.StructField("rfu_id", T.IntegerType()), T.StructField("rfu_score", T.DoubleType())])
#: What goes to every task: at most so many numbers of centroids at once, and of trimers
#: (of which there are at most 20**3).
MOST_NUMBERS = 4_000_000

Scorer = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class RfuTables(NamedTuple):
    per_sequence: DataFrame
    per_row: DataFrame
    mapping: DataFrame


def unique_queries(rows: DataFrame, order_by: str = "source_order", deduplicate: bool = True) -> DataFrame:
    """unique_sequence_id, cdr3aa, v_call of the eligible sequences (those that start with
    C): one for each CDR3, with the V call of its first row, numbered by first row. Without
    deduplication one for each row."""
    eligible = rows.where(F.col("cdr3aa").startswith("C"))
    if deduplicate:
        return counted_queries(rows, order_by).drop("multiplicity")
    return _numbered(eligible.select("cdr3aa", "v_call", F.col(order_by).alias("first_order")))


def counted_queries(rows: DataFrame, order_by: str = "source_order") -> DataFrame:
    """``unique_queries`` with the number of rows of each as ``multiplicity``. Rows are first
    counted by sequence and V call, which needs no sort of all rows; the least text by an order
    would."""
    calls = rows.where(F.col("cdr3aa").startswith("C")).groupBy("cdr3aa", "v_call").agg(F.min(order_by).alias("first_order"), F.count(F.lit(1)).alias("multiplicity"))
    return _numbered(calls.groupBy("cdr3aa").agg(F.min_by("v_call", "first_order").alias("v_call"), F.min("first_order").alias("first_order"), F.sum("multiplicity").alias("multiplicity")))


def _numbered(found: DataFrame) -> DataFrame:
    numbered = row_numbers(found, "first_order").withColumn("unique_sequence_id", row_name("sequence_"))
    return numbered.select("unique_sequence_id", "cdr3aa", "v_call", "first_order", *[c for c in found.columns if c == "multiplicity"])


def embed_sequences(queries: DataFrame, trimers: DataFrame, start: int = 2, end: int = 4) -> DataFrame:
    """cdr3aa, n_trimers, vec: the mean vector of a sequence's trimers that the reference
    knows; sequences without any don't appear. A relational form of what the scorer does."""
    parts = queries.select("cdr3aa").distinct().select("cdr3aa", F.explode(S.trimers(F.col("cdr3aa"), start, end)).alias("trimer"))
    known = parts.join(trimers, "trimer")
    counts = known.groupBy("cdr3aa").agg(F.count(F.lit(1)).alias("n_trimers"))
    dims = known.select("cdr3aa", F.posexplode("vec").alias("dim", "x")).groupBy("cdr3aa", "dim").agg(F.avg("x").alias("x"))
    vectors = dims.groupBy("cdr3aa").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"]).alias("vec"))
    return counts.join(vectors, "cdr3aa")


def unit_ranks(rows: np.ndarray) -> np.ndarray:
    """Average ranks of each row, centred and scaled to length one; constant rows are NaN.
    The dot product of two such rows is their Spearman correlation."""
    ranks = pd.DataFrame(rows).rank(axis=1).to_numpy()
    ranks -= ranks.mean(axis=1, keepdims=True)
    norm = np.linalg.norm(ranks, axis=1, keepdims=True)
    with np.errstate(invalid="ignore", divide="ignore"):
        return ranks / norm


class WideScorer(NamedTuple):
    """A scorer for trimer vectors that are too wide to broadcast: Spark joins the trimers and
    averages their vectors; ``run`` maps batches of (cdr3aa, vec) to ``SCORED``."""

    trimers: DataFrame
    start: int
    end: int
    run: Scorer


def spearman_scorers(trimers: DataFrame, centroids: DataFrame, start: int = 2, end: int = 4, most_numbers: int = MOST_NUMBERS) -> list[Scorer | WideScorer]:
    """Batch functions cdr3aa -> (cdr3aa, rfu_id, rfu_score): the centroid of the highest
    Spearman correlation, rounded to 9 digits; the smallest id wins a tie; NULL without a
    defined correlation. Groups of centroids that can't hold the nearest aren't compared.

    Centroids are broadcast in blocks of at most ``most_numbers`` numbers, one scorer for
    each; ``assign`` takes the best of the blocks, so any reference can be used. Trimers are
    broadcast up to the same size and joined beyond it, with the same result.
    """
    numbers = F.coalesce(F.sum(F.size("vec").cast("long")), F.lit(0)).alias("n")
    wide = trimers.agg(numbers).first()["n"] > most_numbers
    known = [] if wide else trimers.select("trimer", "vec").collect()
    blocks = max(1, -(-centroids.agg(numbers).first()["n"] // most_numbers))
    runs = [_scorer(trimers, None if wide else known, centroids.where(F.pmod(F.col("rfu_id"), F.lit(blocks)) == k), start, end) for k in range(blocks)]
    return [WideScorer(trimers, start, end, r) for r in runs] if wide else runs


def _codes(points: np.ndarray) -> np.ndarray:
    """A number for each three code points in a row."""
    p = points.astype(np.int64)
    return p[:-2] | p[1:-1] << 21 | p[2:] << 42


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _mean_vectors(texts: list[str], codes: np.ndarray, vectors: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts with known trimers, mean vector of each)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    if len(owner) < 3 or not len(codes):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    code = _codes(_points("".join(texts)))
    inside = np.flatnonzero((place[:-2] >= start) & (place[:-2] < sizes[owner[:-2]] - end - 2))
    at = np.minimum(np.searchsorted(codes, code[inside]), len(codes) - 1)
    found = codes[at] == code[inside]
    hits, owner = at[found], owner[inside[found]]
    if not len(hits):
        return np.zeros(0, np.int64), np.zeros((0, 0))
    rows, first, many = np.unique(owner, return_index=True, return_counts=True)
    return rows, np.add.reduceat(vectors[hits], first, axis=0) / many[:, None]


class CentroidIndex(NamedTuple):
    """Centroids on the unit sphere in groups around pivots.

    The Spearman correlation of two rows is the cosine of the angle between their unit ranks,
    and angles obey the triangle inequality: with a query at angle a to a pivot whose group
    lies at angles ``near`` to ``far`` of it, no centroid of the group is nearer to the query
    than a - far or near - a. Groups are consecutive rows from ``first`` on, ordered by id.
    """

    ids: np.ndarray
    centres: np.ndarray
    pivots: np.ndarray
    first: np.ndarray
    near: np.ndarray
    far: np.ndarray

    @classmethod
    def build(cls, ids: np.ndarray, centres: np.ndarray) -> CentroidIndex:
        """As many groups as the square root of the centroids. Rows without a direction
        (NaN) are left out: nothing correlates with them."""
        ok = np.isfinite(centres).all(axis=1)
        ids, centres = ids[ok], centres[ok]
        order = np.argsort(ids, kind="stable")
        ids, centres = ids[order], centres[order]
        k = math.isqrt(len(ids))
        if not k:
            return cls(ids, centres, centres[:0], np.zeros(1, np.int64), np.zeros(0), np.zeros(0))
        pivots = centres[:: max(1, len(ids) // k)][:k]
        group = (centres @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, group, centres)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-12, sums / np.maximum(norm, 1e-12), pivots)
        cosine = centres @ pivots.T
        group = cosine.argmax(axis=1)
        by = np.argsort(group, kind="stable")
        group, own = group[by], np.arccos(np.clip(cosine[by, group[by]], -1, 1))
        names, first = np.unique(group, return_index=True)
        return cls(ids[by], centres[by], pivots[names], np.append(first, len(by)), np.minimum.reduceat(own, first), np.maximum.reduceat(own, first))

    def search(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The id of each unit row's nearest centroid (ties of nine digits: the smallest id),
        its correlation, and how many pairs were compared, pivots included. Rows without a
        direction get NaN."""
        best, value = np.full(len(queries), -1, np.int64), np.full(len(queries), -np.inf)
        known = np.flatnonzero(np.isfinite(queries).all(axis=1))
        groups = len(self.pivots)
        compared = len(known) * groups
        if len(known) and groups:
            angle = np.arccos(np.clip(queries[known] @ self.pivots.T, -1, 1))
            bound = np.cos(np.maximum(np.maximum(angle - self.far, self.near - angle), 0))
            # each query's likeliest groups first, then whatever its best can't rule out
            likely = np.zeros(bound.shape, bool)
            np.put_along_axis(likely, np.argpartition(-bound, min(2, groups - 1), axis=1)[:, :3], True, axis=1)
            for turn in (True, False):
                for g in range(groups):
                    rows = known[(likely[:, g] == turn) & (bound[:, g] >= value[known] - 2e-9)]
                    if not len(rows):
                        continue
                    own = slice(self.first[g], self.first[g + 1])
                    rho = np.round(queries[rows] @ self.centres[own].T, 9)
                    compared += rho.size
                    top = rho.argmax(axis=1)
                    score, ids = rho[np.arange(len(rows)), top], self.ids[own][top]
                    better = (score > value[rows]) | (score == value[rows]) & (ids < best[rows])
                    best[rows[better]], value[rows[better]] = ids[better], score[better]
        value[~np.isfinite(value)] = np.nan
        return best, value, compared


def _scorer(trimers: DataFrame, known: list | None, centroids: DataFrame, start: int, end: int) -> Scorer:
    spark = trimers.sparkSession
    units = centroids.select("rfu_id", "vec").collect()
    ids = np.array([r["rfu_id"] for r in units], np.int64)
    centres = unit_ranks(np.array([r["vec"] for r in units], np.float64)) if units else np.zeros((0, 1))
    codes = np.array([_codes(_points(r["trimer"]))[0] for r in known or []], np.int64)
    order = np.argsort(codes, kind="stable")
    vectors = np.array([known[i]["vec"] for i in order], np.float64) if known else np.zeros((0, 0))
    joined = known is None
    shared = spark.sparkContext.broadcast((codes[order], vectors, CentroidIndex.build(ids, centres)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, vectors, index = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                texts = batch.column(0).slice(lo, 2_000)
                if joined:
                    own = batch.column(1).slice(lo, 2_000).to_pylist()
                    rows = np.array([i for i, v in enumerate(own) if v is not None], np.int64)
                    mean = np.array([own[i] for i in rows.tolist()], np.float64)
                else:
                    rows, mean = _mean_vectors([t or "" for t in texts.to_pylist()], codes, vectors, start, end)
                best = np.full(len(texts), -1, np.int64)
                score = np.full(len(texts), np.nan)
                if len(rows) and len(index.ids):
                    best[rows], score[rows], _ = index.search(unit_ranks(mean))
                none = np.isnan(score)
                yield pa.RecordBatch.from_arrays([texts, pa.array(best, pa.int32(), mask=none), pa.array(score, pa.float64(), mask=none)], SCORED.names)

    return run


def comparison_share(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """How much of the comparisons of all ``vectors`` (cdr3aa, vec) with all centroids a
    search makes: n_queries, n_centroids, n_compared (pivots included), share. The centroids
    are one block, so keep them below ``MOST_NUMBERS`` numbers."""
    units = centroids.select("rfu_id", "vec").collect()
    centres = unit_ranks(np.array([r["vec"] for r in units], np.float64)) if units else np.zeros((0, 1))
    shared = vectors.sparkSession.sparkContext.broadcast(CentroidIndex.build(np.array([r["rfu_id"] for r in units], np.int64), centres))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [v for v in batch.column(0).to_pylist() if v is not None]
            compared = shared.value.search(unit_ranks(np.array(own, np.float64)))[2] if own else 0
            yield pa.RecordBatch.from_arrays([pa.array([len(own)], pa.int64()), pa.array([compared], pa.int64())], ["n_queries", "n_compared"])

    out = vectors.select("vec").mapInArrow(run, "n_queries long, n_compared long").agg(F.sum("n_queries").alias("n_queries"), F.lit(len(units)).cast("long").alias("n_centroids"), F.sum("n_compared").alias("n_compared"))
    return out.withColumn("share", F.try_divide(F.col("n_compared").cast("double"), F.col("n_queries") * F.col("n_centroids")))


def score(queries: DataFrame, scorers: list[Scorer | WideScorer]) -> DataFrame:
    """(cdr3aa, rfu_id, rfu_score) of each query: the best over all scorers."""
    spread = queries.select("cdr3aa").repartition(F.col("cdr3aa")).distinct()
    wide = next((s for s in scorers if isinstance(s, WideScorer)), None)
    vectors = None
    if wide is not None:
        vectors = stage(spread.join(embed_sequences(spread, wide.trimers, wide.start, wide.end).select("cdr3aa", "vec"), "cdr3aa", "left"), "query-vectors")
    parts = [vectors.mapInArrow(s.run, SCORED) if isinstance(s, WideScorer) else spread.mapInArrow(s, SCORED) for s in scorers]
    if len(parts) == 1:
        return parts[0]
    best = F.max(F.when(F.col("rfu_id").isNotNull(), F.struct("rfu_score", (-F.col("rfu_id")).alias("minus")))).alias("b")
    return reduce(DataFrame.unionByName, parts).groupBy("cdr3aa").agg(best).select("cdr3aa", (-F.col("b.minus")).alias("rfu_id"), F.col("b.rfu_score").alias("rfu_score"))


def assign(queries: DataFrame, scorers: list[Scorer | WideScorer], threshold: float = 0.6) -> DataFrame:
    """Score unique queries and add label and threshold flag (inclusive). A scorer is any
    batch function with the schema of ``SCORED``."""
    return queries.join(score(queries, scorers), "cdr3aa").select("*", S.rfu_label(F.col("rfu_id")).alias("rfu_label"), (F.col("rfu_score") >= threshold).alias("pass_thr"))


def known_scores(store: DataFrame, batch: DataFrame) -> DataFrame:
    """The store's rows for the staged sequences of a batch, in one scan of the store. The
    comparison, which holds for every text, marks the batch as the selective side, for which
    Spark puts a Bloom filter of it on the scan of a large store."""
    return store.join(batch.where(F.col("cdr3aa") >= ""), "cdr3aa", "left_semi")


def assign_incremental(queries: DataFrame, store: DataFrame, scorers: list[Scorer | WideScorer], reference_id: str, threshold: float = 0.6, force: bool = False) -> DataFrame:
    """Reuse stored scores of the same reference and compute only the rest. ``store`` holds
    reference_id, cdr3aa, rfu_id, rfu_score; the ``reused`` flag tells the two apart. A store
    too large to shuffle is filtered in its scan by a Bloom filter of the batch
    (``spark.sql.optimizer.runtime.bloomFilter``, on by default from 10 GB)."""
    own = store.where((F.col("reference_id") == reference_id) & F.lit(not force)).select("cdr3aa", "rfu_id", "rfu_score")
    batch = stage(queries.select("cdr3aa").distinct(), "batch")
    known = known_scores(own, batch).dropDuplicates(["cdr3aa"]).withColumn("reused", F.lit(True))
    both = stage(queries.join(known, "cdr3aa", "left"), "known-scores")
    rest = both.where("reused is null").drop("rfu_id", "rfu_score", "reused")
    new = rest.join(score(rest, scorers), "cdr3aa").withColumn("reused", F.lit(False))
    return both.where("reused").unionByName(new).select("*", S.rfu_label(F.col("rfu_id")).alias("rfu_label"), (F.col("rfu_score") >= threshold).alias("pass_thr"))


def reconstruct(rows: DataFrame, assignments: DataFrame, check: bool = True) -> DataFrame:
    """Every row with its sequence's assignment and the three statuses. With ``check``,
    assignments must have one row for each eligible sequence and none else."""
    keyed = assignments.select("cdr3aa", "unique_sequence_id", "rfu_id", "rfu_label", "rfu_score", "pass_thr")
    if check:
        want = rows.where(F.col("cdr3aa").startswith("C")).select("cdr3aa").distinct()
        got = keyed.groupBy("cdr3aa").agg(F.count(F.lit(1)).alias("n"))
        odd = want.withColumn("wanted", F.lit(True)).join(got, "cdr3aa", "full").where("wanted is null or n is null or n > 1").limit(1).count()
        if odd:
            raise ValueError("the scorer did not return exactly one result for every eligible query")
    return _with_statuses(rows.withColumn("eligibility_status", S.eligibility(F.col("cdr3aa"))).join(keyed, "cdr3aa", "left"))


def _with_statuses(both: DataFrame) -> DataFrame:
    c, i, p = F.col("cdr3aa"), F.col("rfu_id"), F.col("pass_thr")
    coverage = S.coverage_status(c, i, p)
    return both.select(
        "*",
        S.rfu_status(c, i, p).alias("rfu_status"),
        i.alias("rfu_id_nearest"),
        F.col("rfu_label").alias("rfu_label_nearest"),
        p.alias("rfu_pass_threshold"),
        coverage.alias("reference_coverage_status"),
        S.assignment_status(coverage).alias("assignment_status"),
    )


SEQUENCE_RESULTS = ("rfu_id", "rfu_label", "rfu_score", "pass_thr", "rfu_status", "rfu_id_nearest", "rfu_label_nearest", "rfu_pass_threshold", "reference_coverage_status", "assignment_status")


def per_sequence(per_row: DataFrame, order_by: str = "source_order") -> DataFrame:
    """One row for each eligible sequence: first V call, multiplicity and assignment."""
    kept = SEQUENCE_RESULTS
    calls = per_row.where("eligibility_status = 'eligible'").groupBy("unique_sequence_id", "cdr3aa", "v_call", *kept).agg(F.min(order_by).alias("__first"), F.count(F.lit(1)).alias("__n"))
    out = calls.groupBy("unique_sequence_id", "cdr3aa").agg(F.min_by(F.struct("v_call", *kept), "__first").alias("f"), F.sum("__n").alias("multiplicity"))
    return out.select("unique_sequence_id", "cdr3aa", F.col("f.v_call").alias("query_v_call"), "multiplicity", *[F.col(f"f.{c}") for c in kept])


MAPPING = ("input_row_id", "unique_sequence_id", "cell_id", "chain", "cdr3aa", "v_call", "source_adapter", "source_row_id", "eligibility_status", "reference_coverage_status", "assignment_status")


def call_rfus(receptors: DataFrame, scorers: list[Scorer | WideScorer], *, chain: str = "TRB", threshold: float = 0.6, order_by: str = "source_order") -> RfuTables:
    """Assign all rows of a chain (only TRB has a reference): the three result tables."""
    if chain.strip().upper() != "TRB":
        raise ValueError("RFU assignment supports chain TRB only")
    rows = chain_rows(receptors, "TRB")
    # all three tables read it; its size on disk lets Spark broadcast it instead of sorting the rows
    done = stage(assign(counted_queries(rows, order_by).drop("first_order"), scorers, threshold), "assigned-sequences")
    per_row = reconstruct(rows, done, check=False)
    sequences = _with_statuses(done).select("unique_sequence_id", "cdr3aa", F.col("v_call").alias("query_v_call"), "multiplicity", *SEQUENCE_RESULTS)
    return RfuTables(sequences, per_row, per_row.select(*[c for c in MAPPING if c in per_row.columns]))


def threshold_misses(per_row: DataFrame) -> DataFrame:
    """Assigned below the threshold: number of rows and of unique sequences."""
    missed = per_row.where("rfu_id is not null and not pass_thr")
    return missed.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("cdr3aa").alias("n_sequences"))


def abundance_per_10k(per_row: DataFrame, sample: str, cluster_sizes: DataFrame | None = None) -> DataFrame:
    """RFU counts per 10,000 encoded rows of a sample, low scores included; with cluster
    sizes also divided by the size of the RFU's reference cluster."""
    counts = per_row.where("rfu_id is not null").groupBy(sample, "rfu_id").agg(F.count(F.lit(1)).alias("n_rows"))
    totals = counts.groupBy(F.col(sample).alias("__s")).agg(F.sum("n_rows").alias("__total"))
    out = counts.join(totals, F.col(sample).eqNullSafe(F.col("__s"))).withColumn("abundance", F.col("n_rows") * 10000.0 / F.col("__total")).drop("__s", "__total")
    if cluster_sizes is None:
        return out
    return out.join(cluster_sizes.select("rfu_id", "cluster_size"), "rfu_id").withColumn("abundance", F.col("abundance") / F.col("cluster_size")).drop("cluster_size")


def dedup_stats(rows: DataFrame) -> DataFrame:
    """Row, eligible row and unique query counts, and unique over eligible."""
    ok = F.col("cdr3aa").startswith("C")
    out = rows.agg(F.count(F.lit(1)).alias("original_rows"), F.count_if(ok).alias("eligible_rows"), F.count_distinct(F.when(ok, F.col("cdr3aa"))).alias("unique_queries"))
    return out.withColumn("deduplication_ratio", F.try_divide(F.col("unique_queries").cast("double"), F.col("eligible_rows")))
