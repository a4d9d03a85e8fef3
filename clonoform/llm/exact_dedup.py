"""Exact deduplication by recipes of content-defined chunks. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import ascii_lower, join_groups_of, stage

#: A chunk ends where the text itself says so (one of some letter pairs after a space), but
#: not before ``low`` and not after ``high`` characters.
CHUNK = r"(?s).{%d,%d}?(?:[ \n][b-df-hj][aeiou]|\z)|.{1,%d}"
#: So many colliding hashes are handled by name; with more, no hash is trusted.
MOST_DOUBTFUL = 1_000


def _chunks(text, low: int, high: int):
    return F.regexp_extract_all(text, F.lit(CHUNK % (low, high, high)), F.lit(0))


def exact_duplicates(docs: DataFrame, low: int = 256, high: int = 8192, row: str | None = None) -> DataFrame:
    """Group whole texts that are identical after lower-casing A-Z.

    Every text is cut into content-defined chunks. Chunks are deduplicated under a 64-bit
    hash and verified: a hash that stands for two different chunks loses its role, and
    its chunks are named by their SHA-256 instead. A text's recipe is the ordered list of
    its chunk identifiers. Recipes, not texts, are grouped and joined, so the text of a
    chunk moves once, after map-side deduplication, and never with its document.

    Returns one row per input row: doc_id, keep_id (largest doc_id of the group),
    group_size, kept, text_sha256. Null text counts as empty. Null ``doc_id`` counts as
    smaller than any. If rows repeat the kept doc_id, exactly one of them is kept. An
    empty table gives no rows; other columns are ignored, but for ``row``: the name of a
    column that numbers the rows, which is returned too.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("body"),
        (F.col(row) if row else F.lit(None)).cast("long").alias("rid"),
    )
    chunks = base.select(F.explode(_chunks(F.col("body"), low, high)).alias("chunk"))
    dictionary = chunks.select(F.xxhash64("chunk").alias("h"), "chunk").distinct()
    doubtful = stage(dictionary.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "doubtful-chunks")
    pieces = _chunks(F.col("body"), low, high)
    rows = base.select(
        "doc_id",
        "rid",
        F.length("body").alias("n_chars"),
        F.sha2("body", 256).alias("text_sha256"),
        F.transform(pieces, lambda c: F.hex(F.xxhash64(c))).alias("recipe"),
        F.transform(pieces, lambda c: F.sha2(c, 256)).alias("names"),
    )
    bad = [r["h"] for r in doubtful.select(F.hex("h").alias("h")).limit(MOST_DOUBTFUL + 1).collect()]
    if len(bad) > MOST_DOUBTFUL:  # name every chunk in full
        rows = rows.withColumn("recipe", F.col("names"))
    elif bad:  # name the chunks of these hashes in full
        doubted = F.array(*[F.lit(h) for h in bad])
        rows = rows.withColumn("recipe", F.transform("recipe", lambda c, i: F.when(F.array_contains(doubted, c), F.get("names", i)).otherwise(c)))
    rows = rows.drop("names")
    rows = stage(rows if row else rows.withColumn("rid", F.monotonically_increasing_id()), "recipes")
    groups = stage(
        rows.groupBy("recipe").agg(F.max(F.struct("doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("group_size")),
        "recipe-groups",
    )
    return join_groups_of(rows, groups, "recipe", "group_size").select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("best.rid")).alias("kept"),
        "text_sha256",
        *([F.col("rid").alias(row)] if row else []),
    )
