"""The corpus pipeline: documents in, packed token sequences out.

Each stage gets what its predecessor kept, written as Parquet and read again, and decides
on all of it. All but the last return the columns of documents. Language and contamination are
decided in the pass that reads the text; the two deduplications name the rows that go, by row
number, so rows without a doc_id or with the same one are told apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clonoform.llm.common import numbered, remove_tables, settle, stage, table, tokenizer_path
from clonoform.llm.decontamination import uncontaminated
from clonoform.llm.exact_dedup import exact_duplicates
from clonoform.llm.language_id import predict
from clonoform.llm.packing import pack_documents
from clonoform.llm.simhash_dedup import near_duplicates

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: So many row numbers (8 bytes each) are broadcast at most; more are joined by a shuffle.
MOST_BROADCAST = 1_000_000


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose ``rid`` isn't among ``gone``."""
    gone = stage(gone.select("rid"), "rows-to-drop")
    few = gone.count() <= MOST_BROADCAST
    return rows.join(F.broadcast(gone) if few else gone, "rid", "left_anti").select(COLUMNS)


def language_identification(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (no text, no letter) go; a missing ``lang`` is
    filled with the predicted one."""
    told = predict(docs.select(COLUMNS)).where("lang_pred <> 'und'")
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(COLUMNS)


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays, the one with the largest doc_id."""
    rows = numbered(docs.select(COLUMNS))
    return _without(rows, exact_duplicates(rows, row="rid").where("not kept"))


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    rows = numbered(docs.select(COLUMNS))
    return _without(rows, near_duplicates(rows, row="rid").where("not first"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return uncontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens, packed."""
    return pack_documents(docs, tokenizer_path(), end_id=0, capacity=2048)


STAGES = [
    ("language_identification", language_identification),
    ("exact_deduplication", exact_deduplication),
    ("near_deduplication", near_deduplication),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: The stages aren't expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed rows of the last stage. A stage's own tables go once its result is written,
    and its result once the next one's is; tables of other runs and queries stay."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, step in STAGES[:-1]:
        docs, own = settle(lambda step=step, docs=docs: step(spark, docs, sf_dir), name)
        remove_tables(spark, before)
        before = own
    return STAGES[-1][1](spark, docs, sf_dir)
