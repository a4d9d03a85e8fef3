"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clonoform.llm.common import stage


def held_out():
    """Documents that only test: crc32 of the doc_id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def buckets(texts: list[str | None], bits: int = 16, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each character n-gram of the letters of each lower-cased text, and the
    number of n-grams per text. N-grams never cross texts; characters other than letters
    count as a space."""
    flat, sizes = [], []
    for t in texts:
        points = np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32)
        points = np.where(_letters(points), points, np.uint32(32))
        keep = np.ones(len(points), bool)
        keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
        points = points[keep].astype(np.uint64)
        n = 0
        if len(points) and (points != 32).any():
            code = np.zeros(len(points), np.uint64)
            for order in range(1, max(orders) + 1):
                code = (code[: len(points) - order + 1] * np.uint64(0x9E3779B1) + points[order - 1 :] + np.uint64(1)) if len(points) >= order else code[:0]
                if order in orders:
                    mixed = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
                    flat.append(mixed.astype(np.int32))
                    n += len(mixed)
        sizes.append(n)
    return (np.concatenate(flat) if flat else np.zeros(0, np.int32)), np.asarray(sizes, np.int64)


_LETTER = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.array([chr(c).isalpha() for c in range(0x110000)])
    return _LETTER[points]


class Model(NamedTuple):
    """Naive Bayes of a block of languages: names, log priors, and log probabilities by
    bucket and language."""

    languages: list[str]
    priors: np.ndarray
    logs: np.ndarray


#: So many languages are scored at once: 256 KB each in every worker.
LANGUAGES = 256


def train(docs: DataFrame, bits: int = 16, rows: int = 20_000, languages: int = LANGUAGES) -> Iterator[Model]:
    """Models of at most ``languages`` languages each, from the labelled documents that aren't
    held out.

    N-grams are counted in at most about ``rows`` documents per language, the ones with the
    smallest hash of doc_id: a bounded sample that doesn't depend on how the table is stored.
    Priors are the languages' shares of all labelled documents. Counts are added up in Spark;
    the driver receives the counts of a block of languages at a time.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # one row a language, numbered in order
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("size"))
    numbered = stage(sizes.select("*", (F.row_number().over(Window.orderBy("lang")) - 1).alias("place")), "languages")
    unit = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    sample = known.select("lang", "text", unit.alias("unit")).join(numbered, "lang").where(F.col("unit") * F.col("size") < rows).select("place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, texts = batch.column(0).to_numpy(), batch.column(1)
            for lo in range(0, len(places), 1_000):
                found, many = buckets(texts.slice(lo, 1_000).to_pylist(), bits)
                both, n = np.unique(np.repeat(places[lo : lo + 1_000].astype(np.int64), many) << bits | found, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both >> bits, pa.int32()), pa.array(both & (1 << bits) - 1, pa.int32()), pa.array(n, pa.int64())], ["place", "bucket", "n"])

    counted = stage(sample.mapInArrow(run, "place int, bucket int, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n")), "ngram-counts")
    every, total = numbered.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    for lo in range(0, every, languages):
        inside = F.col("place").between(lo, lo + languages - 1)
        names = numbered.where(inside).orderBy("place").collect()
        counts = np.zeros((1 << bits, len(names)), np.float64)
        got = counted.where(inside).toPandas()
        counts[got["bucket"], got["place"] - lo] = got["n"]
        smooth = counts + 0.5
        priors = np.log(np.array([r["size"] / total for r in names]))
        yield Model([r["lang"] for r in names], priors, np.log(smooth / smooth.sum(axis=0)).astype(np.float32))


#: A text's n-grams overlap and aren't independent: for the score they weigh as an eighth of
#: their number, and as so many in all, at most.
MOST_EVIDENCE = 8.0


def log_scores(model: Model, texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of the texts with letters, log prior plus log likelihood of each language,
    times a factor of the text that keeps long texts from saturating)."""
    found, sizes = buckets(texts, bits)
    live = np.flatnonzero(sizes)
    if not len(live):
        return live, np.zeros((0, len(model.languages)))
    first = np.concatenate([[0], np.cumsum(sizes[live])[:-1]])
    like = np.stack([np.add.reduceat(model.logs[found, k], first, dtype=np.float64) for k in range(len(model.languages))], axis=1)
    return live, (model.priors + like) * np.minimum(1 / 8, MOST_EVIDENCE / sizes[live])[:, None]


#: Between passes: the best log score and the log of the sum of all languages' scores.
RUNNING = [T.StructField("lang_pred", T.StringType()), T.StructField("__best", T.DoubleType()), T.StructField("__sum", T.DoubleType())]


def predict(docs: DataFrame, bits: int = 16, rows: int = 20_000, languages: int = LANGUAGES) -> DataFrame:
    """The documents, with all of their columns, and lang_pred and score; see
    ``identify_languages``. A pass of the documents for each block of languages, so one for
    as many as there usually are; the pass that scores a text keeps its row."""
    place = docs.columns.index("text")
    spark, out = docs.sparkSession, None
    wide = T.StructType([*docs.schema.fields, *RUNNING])
    for model in train(docs, bits, rows, languages):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    live, scores = log_scores(model, part.column(place).to_pylist(), bits)
                    names, best, total = [None] * part.num_rows, np.full(part.num_rows, -np.inf), np.full(part.num_rows, -np.inf)
                    old = part.num_columns > len(wide) - len(RUNNING)
                    if old:
                        names = part.column(part.num_columns - 3).to_pylist()
                        best, total = (part.column(part.num_columns - k).to_numpy(zero_copy_only=False).copy() for k in (2, 1))
                    for i, row in zip(live.tolist(), scores, strict=True):
                        k = int(row.argmax())
                        if row[k] > best[i]:
                            names[i], best[i] = model.languages[k], row[k]
                        total[i] = np.logaddexp(total[i], np.logaddexp.reduce(row))
                    columns = part.columns[: len(wide) - len(RUNNING)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(names, pa.string()), pa.array(best), pa.array(total)], wide.names)

        out = (docs if out is None else stage(out, "language-scores")).mapInArrow(run, wide)
    if out is None:
        return docs.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    score = F.when(F.col("lang_pred").isNotNull(), F.exp(F.col("__best") - F.col("__sum"))).otherwise(0.0)
    return out.select(*docs.columns, F.coalesce("lang_pred", F.lit("und")).alias("lang_pred"), F.least(score, F.lit(1.0)).alias("score"))


def identify_languages(docs: DataFrame, bits: int = 16, rows: int = 20_000, languages: int = LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every whole text.

    Learns from text and non-null lang of the documents that aren't held out. The score is a
    tempered posterior of the predicted language (n-grams overlap, so an eighth of their
    evidence counts, and at most that of ``MOST_EVIDENCE``); the first in order wins a tie.
    ``und`` with score 0 if the text is null or has no letter, or if there is nothing to learn from. Any number
    of languages can be told apart. Null ``doc_id`` isn't held out. Repeated rows are scored
    each; an empty table gives no rows; other columns are ignored.
    """
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return predict(plain, bits, rows, languages).select("doc_id", "held_out", "lang_pred", "score")
