"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints that differ in at most two of 64 bits agree in one of two 32-bit segments up
to one bit. Each fingerprint is indexed under its 2 x 32 one-wildcard segment variants;
equal keys give candidates, which are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import join_groups_of, stage

#: Keys with more distinct fingerprints than this aren't paired but refined, and refined keys
#: with more than ``REFINED`` aren't paired either; see ``links``. Pairing n costs n - 1 rows
#: for each two of them and refining three for each, so few are paired.
BUCKET, REFINED = 4, 2


def simhash(text: bytes | None, words: int = 3) -> int:
    """64-bit SimHash over XXH64 (seed 42) of word shingles, repeats included; ASCII letters
    lower-cased, words between ASCII white space; no words: zero."""
    import xxhash

    parts = (text or b"").lower().split()
    if not parts:
        return 0
    whole, n = b" ".join(parts), len(parts)
    if n < words:
        hashes = [xxhash.xxh64_intdigest(whole, 42)]
    else:
        size = np.fromiter(map(len, parts), np.int64, n)
        ends = np.cumsum(size + 1) - 1
        starts, stops = (ends - size)[: n - words + 1].tolist(), ends[words - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(whole[a:b], 42) for a, b in zip(starts, stops, strict=True)]
    raw, total = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), np.zeros(64, np.int64)
    for lo in range(0, len(raw), 8192):
        total += np.unpackbits(raw[lo : lo + 8192], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(raw), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, fp (64 bits in a signed long) and rid (``row``, or NULL) of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for lo in range(0, len(ids), 500):
                found = np.array([simhash(t, words) for t in texts.slice(lo, 500).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 500), pa.array(found, pa.int64()), batch.column(2).slice(lo, 500)], ["doc_id", "fp", "rid"])

    rid = (F.col(row) if row else F.lit(None)).cast("long").alias("rid")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rid).mapInArrow(run, "doc_id long, fp long, rid long")


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): the wildcard's place and segment in the upper bits, the segment with the
    wildcard bit cleared in the lower 32."""
    places = F.explode(F.sequence(F.lit(0), F.lit(63))).alias("place")
    p, fp = F.col("place"), F.col("fp")
    segment = F.when(p < 32, fp.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned(fp, 32))
    cleared = segment.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(p, F.lit(32)))))
    return prints.select("fp", places).select(F.call_function("shiftleft", p.cast("long"), F.lit(32)).bitwiseOR(cleared).alias("key"), "fp")


def _refined(crowded: DataFrame) -> DataFrame:
    """(key, fp): each key with one of three parts of the other segment. Fingerprints that
    differ in at most two bits agree in one of the parts."""
    other = F.when(F.shiftright("key", 32) < 32, F.shiftrightunsigned("fp", 32)).otherwise(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)))
    parts = [F.lit(n << 11).bitwiseOR(F.shiftright(other, low).bitwiseAND(F.lit((1 << wide) - 1))) for n, (low, wide) in enumerate(((0, 11), (11, 11), (22, 10)))]
    return crowded.select(F.explode(F.array(*[F.shiftleft("key", 13).bitwiseOR(p.cast("long")) for p in parts])).alias("key"), "fp")


def _stars(crowded: DataFrame) -> DataFrame:
    """Links of the fingerprints that share an overfull key, without pairing them.

    All fingerprints that agree in all but two given bits are linked to each other, so a
    star to the smallest loses no link. A fingerprint in an overfull key has all of its links
    through that key among those that it shares 62 bits with: it is indexed under all
    C(64, 2) two-bit deletions, exactly and with no cap.
    """
    two = [(1 << i) | (1 << j) for i in range(64) for j in range(i)]
    signed = [m - (1 << 64) if m >> 63 else m for m in two]
    masks = F.array(*[F.lit(m).cast("long") for m in signed])
    keyed = crowded.select("fp", F.posexplode(masks).alias("place", "mask")).select("place", F.col("fp").bitwiseAND(F.bitwise_not(F.col("mask"))).alias("rest"), "fp")
    stars = stage(keyed, "deletions")
    least = stage(stars.groupBy("place", "rest").agg(F.min("fp").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "stars")
    return stars.join(least, ["place", "rest"]).where("fp <> least").select(F.least("fp", "least").alias("a"), F.greatest("fp", "least").alias("b")).distinct()


def _by_size(index: DataFrame, most: int, name: str) -> tuple[DataFrame, DataFrame]:
    """(the lists of fingerprints of keys with two to ``most``, the index rows of keys with
    more)."""
    shared = stage(index.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), f"{name}-shared")
    few = index.join(shared.where(F.col("n") <= most).select("key"), "key")
    many = stage(index.join(shared.where(F.col("n") > most).select("key"), "key").select("key", "fp"), f"{name}-crowded")
    return few.groupBy("key").agg(F.sort_array(F.collect_list("fp")).alias("fps")).select("fps"), many


def links(prints: DataFrame, bits: int = 2) -> DataFrame:
    """(a, b), a < b: the distinct fingerprints that differ in at most two bits, or for
    crowded keys links that connect the same fingerprints.

    Fingerprints under one key are paired and verified, up to ``BUCKET`` of them. Those of a
    fuller key are told apart by parts of the other segment. At 5 x 10**10 distinct
    fingerprints, 100 TB of 2 kB texts, a key (there are 2**31 for a place) holds 23 on
    average, so all are refined, to 192 rows for a fingerprint; a refined key then holds 0.02,
    so what is left in full refined keys are groups of near copies. Only their fingerprints
    pay for two-bit deletions, 2016 rows each.
    """
    if bits != 2:
        raise ValueError("two segments with one wildcard find at most 2 differing bits")
    index = stage(_variants(prints), "variants")
    lists, crowded = _by_size(index, BUCKET, "keys")
    done = crowded.isEmpty()
    if not done:
        more, crowded = _by_size(stage(_refined(crowded), "refined"), REFINED, "refined-keys")
        lists = lists.unionByName(more)
        done = crowded.isEmpty()
    first = lists.select(F.posexplode("fps").alias("i", "a"), "fps")
    pairs = first.select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(max(BUCKET, REFINED)))).alias("b")).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()
    return pairs if done else pairs.unionByName(_stars(stage(crowded.select("fp").distinct(), "crowded"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for each node that has an edge.

    Each round orders the nodes anew at random (by a hash of round and node), hooks every node
    to the first of itself and its neighbours, follows the hooks once more and contracts the
    edges. Whatever the graph, and also on a chain in ascending order, a round leaves at most
    three quarters of the nodes on average, so the rounds grow with the logarithm of the nodes.
    """
    edges = stage(edges.where("a <> b").select("a", "b"), "edges")
    both = edges.select("a").unionByName(edges.select(F.col("b").alias("a"))).distinct()
    roots = stage(both.select(F.col("a").alias("node"), F.col("a").alias("root")), "roots")
    number = 0
    while not edges.isEmpty():
        number += 1
        place = lambda c: F.struct(F.xxhash64(F.lit(number), c).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = ways.groupBy("a").agg(F.min(place("b")).alias("near"))
        hook = stage(first.where(F.col("near") < place("a")).select("a", F.col("near.node").alias("to")), "hooks")
        nxt = hook.select(F.col("a").alias("to"), F.col("to").alias("further"))
        hook = stage(hook.join(nxt, "to", "left").select("a", F.coalesce("further", "to").alias("to")), "followed")

        def moved(df: DataFrame, column: str, hook: DataFrame = hook) -> DataFrame:
            h = hook.select(F.col("a").alias(column), "to")
            return df.join(h, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")

        roots = stage(moved(roots, "root"), "roots")
        step = moved(moved(edges, "a"), "b").where("a <> b")
        edges = stage(step.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    least = roots.groupBy("root").agg(F.min("node").alias("least"))
    return roots.join(least, "root").select("node", F.col("least").alias("root"))


def near_duplicates(docs: DataFrame, bits: int = 2, words: int = 3, row: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each document.

    component_id is the smallest doc_id reachable over links of at most ``bits`` differing
    bits. Texts without words have fingerprint zero and are linked like any other. Null
    text counts as empty. A null ``doc_id`` belongs to its component but is never its
    smallest id, unless all are null. Repeated rows give one row each; an empty table gives
    no rows; other columns are ignored, but for ``row``: the name of a column that numbers
    the rows, which is returned too, with ``first``, true for one row of each component, of
    the smallest doc_id.
    """
    own = fingerprints(docs, words, row)
    own = stage(own if row else own.withColumn("rid", F.monotonically_increasing_id()), "fingerprints")
    head = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "rid")
    least = stage(own.groupBy("fp").agg(F.min(head).alias("head"), F.count(F.lit(1)).alias("size")), "distinct-fingerprints")
    roots = stage(components(links(least.select("fp"), bits)), "roots")
    rooted = stage(least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    names = stage(rooted.groupBy("root").agg(F.min("head").alias("top")), "components")
    classes = stage(rooted.join(names, "root").select("fp", "size", "top"), "classes")
    return join_groups_of(own, classes, "fp", "size").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("top.doc_id").alias("component_id"),
        *([F.col("rid").alias(row), (F.col("rid") == F.col("top.rid")).alias("first")] if row else []),
    )
