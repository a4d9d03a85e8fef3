"""Ranked lexical search: every item against all documents, over trees of document vectors.

A document is restricted to the items' terms. Its terms, most frequent first, are a path, and the
documents of a task share these paths in a trie (an FP-tree), whose small subtrees are leaves
that hold documents. Each subtree knows the largest count of each of its terms and its least
length term m, so no document in it scores higher than these two allow. For each item the trees
are searched depth first, the better child first, and a subtree whose bound is below the score
of the item's last place so far isn't entered.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappush, heappushpop
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonoform.llm.common import stage

#: Separators are the ASCII characters that are neither letters nor digits.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))
#: Documents in a leaf of the tree at most, and terms of documents in a tree.
LEAF, TREE_TERMS = 32, 2_000_000
#: So many bytes of item text are searched for in one pass over the documents.
BLOCK_BYTES = 2_000_000
#: So many documents give the first floors of the items' last places, where there are more.
PILOT = 1_000_000
VECTORS = "doc_id long, n long, terms binary, counts binary"
FOUND = "item int, doc_id long, score long"


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Per document with a term: how many terms it has, and those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(vocabulary.value.split())}
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                out: list[tuple] = []
                some = batch.slice(lo, 512)
                for doc, text in zip(some.column(0).to_pylist(), some.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    own = terms_of(text)
                    if own:
                        known = np.array([i for i in map(number.get, own) if i is not None], "<u4")
                        terms, counts = np.unique(known, return_counts=True)
                        out.append((doc, len(own), terms.astype("<u4").tobytes(), counts.astype("<u4").tobytes()))
                columns = list(zip(*out, strict=True)) if out else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], [c.split()[0] for c in VECTORS.split(", ")])

    return docs.mapInArrow(run, VECTORS)


def _frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """In how many documents each term of the vocabulary is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = np.zeros(size, np.int64)
        for batch in batches:
            inside += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<u4"), minlength=size)
        some = np.flatnonzero(inside)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(inside[some], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in vectors.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r["term"]] = r["n"]
    return out


def weight_of(n: int, inside: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * inside + 1)))


def part_score(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a score without its weight: more for more of it, less for larger m."""
    return 1_000_000_000 * count // (1000 * count + 20 * m)


class Search(NamedTuple):
    """What a task needs: the place of each term in frequency order, the weight by place, the
    items' terms as places, the documents' number and total length, and a floor by item."""

    place: np.ndarray
    weight: np.ndarray
    items: list[np.ndarray]
    total_terms: int
    n: int
    depth: int
    floors: dict[int, int]


class DocumentTree:
    """The trie of some documents, given by their places (``terms``), ``counts``, the starts
    of their rows in these (``first``), ``m`` and ``ids``.

    Documents are kept in the order of their paths, so a subtree is a range ``low`` to
    ``high`` of them. The bounds are kept by term: ``node`` and ``bound`` from ``start`` on are
    the subtrees that hold a term and what it adds to a score there at most, without weight.
    """

    def __init__(self, terms: np.ndarray, counts: np.ndarray, first: np.ndarray, m: np.ndarray, ids: list, size: int, leaf: int = LEAF):
        raw = terms.astype(">u4").tobytes()
        paths = [raw[4 * a : 4 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        order = sorted(range(len(paths)), key=paths.__getitem__)
        self.ids = [ids[i] for i in order]
        lengths = np.diff(first)[order]
        self.first = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(first[:-1][order] - self.first[:-1], lengths) + np.arange(self.first[-1])
        self.terms, counts, m = terms[at], counts[at].astype(np.int64), m[order]
        self.share = part_score(counts, np.repeat(m, lengths))
        self._grow(leaf)
        self._bounds(counts, m, lengths, size)

    def _grow(self, leaf: int) -> None:
        """Cut the ranges of documents where their paths part."""
        self.low, self.high, self.children, self.level = [0], [len(self.ids)], [[]], [0]
        todo = [(0, 0)]
        while todo:
            k, depth = todo.pop()
            lo, hi = self.low[k], self.high[k]
            if hi - lo <= leaf:
                continue
            a, b = (self.terms[self.first[i] : self.first[i + 1]] for i in (lo, hi - 1))
            same = min(len(a), len(b))
            apart = np.flatnonzero(a[depth:same] != b[depth:same])
            depth = depth + int(apart[0]) if len(apart) else same
            at = self.first[lo:hi] + depth
            step = np.where(at < self.first[lo + 1 : hi + 1], self.terms[np.minimum(at, len(self.terms) - 1)].astype(np.int64), -1)
            cuts = [0, *(np.flatnonzero(np.diff(step)) + 1).tolist(), hi - lo]
            if len(cuts) == 2:  # the same path: cut by place
                cuts = [*range(0, hi - lo, leaf), hi - lo]
            start = 0
            for i in range(1, len(cuts)):
                # small neighbours share a leaf
                if i < len(cuts) - 1 and cuts[i + 1] - cuts[start] <= leaf:
                    continue
                self.children[k].append(len(self.low))
                todo.append((len(self.low), depth))
                self.low.append(lo + cuts[start])
                self.high.append(lo + cuts[i])
                self.level.append(self.level[k] + 1)
                self.children.append([])
                start = i

    def _bounds(self, counts: np.ndarray, m: np.ndarray, lengths: np.ndarray, size: int) -> None:
        """From the leaves up, the largest counts and the least m of each subtree."""
        nodes, parent = len(self.low), np.zeros(len(self.low), np.int64)
        for k, below in enumerate(self.children):
            parent[below] = k
        level = np.array(self.level)
        leaves = np.array([k for k in range(nodes) if not self.children[k]])
        leaves = leaves[np.argsort(np.array(self.low)[leaves])]
        starts = np.array(self.low)[leaves]
        least = np.full(nodes, np.iinfo(np.int64).max)
        least[leaves] = np.minimum.reduceat(m, starts)
        of_doc = np.repeat(leaves, np.diff(np.append(starts, len(m))))
        key, most = np.repeat(of_doc, lengths) * size + self.terms, counts
        kept = []
        for depth in range(int(level.max()), -1, -1):
            own = np.flatnonzero(level == depth)
            here = level[key // size] == depth
            by = np.argsort(key[here], kind="stable")
            k, c = key[here][by], most[here][by]
            start = np.flatnonzero(np.diff(k, prepend=-1))
            k, c = k[start], np.maximum.reduceat(c, start) if len(start) else c
            kept.append((k, c))
            if depth:
                np.minimum.at(least, parent[own], least[own])
                key = np.concatenate([key[~here], parent[k // size] * size + k % size])
                most = np.concatenate([most[~here], c])
        key, most = (np.concatenate(x) for x in zip(*kept, strict=True))
        by = np.argsort(key % size, kind="stable")
        self.node = key[by] // size
        self.bound = part_score(most[by], least[self.node])
        self.start = np.searchsorted(key[by] % size, np.arange(size + 1))

    def search(self, terms: np.ndarray, weight: np.ndarray, best: list, depth: int, floor: int) -> int:
        """Add the documents that belong to the item's best to the heap ``best`` of (score,
        minus id, id); returns how many documents were scored. ``weight`` is zero but for the
        item's terms."""
        bound = np.zeros(len(self.low), np.int64)
        for t in terms.tolist():
            own = slice(self.start[t], self.start[t + 1])
            bound[self.node[own]] += weight[t] * self.bound[own]
        bounds, todo, scored = bound.tolist(), [0], 0
        least = best[0][0] if len(best) == depth else floor
        while todo:
            k = todo.pop()
            if bounds[k] < least:
                continue
            if self.children[k]:
                todo += sorted((c for c in self.children[k] if bounds[c] >= least), key=bounds.__getitem__)
                continue
            lo, hi = self.low[k], self.high[k]
            at = slice(self.first[lo], self.first[hi])
            scores = np.add.reduceat(weight[self.terms[at]] * self.share[at], self.first[lo:hi] - self.first[lo])
            scored += hi - lo
            for i in np.flatnonzero(scores >= least).tolist():
                doc = self.ids[lo + i]
                entry = int(scores[i]), -(1 << 64) if doc is None else -doc, doc
                if len(best) < depth:
                    heappush(best, entry)
                else:
                    heappushpop(best, entry)
            least = max(least, best[0][0]) if len(best) == depth else least
        return scored


def _search(vectors: DataFrame, search: Broadcast, tree_terms: int, leaf: int) -> DataFrame:
    """The best documents of each item in each task: item, doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Search = search.value
        best: list[list] = [[] for _ in s.items]
        held: list[tuple] = []

        def look() -> None:
            terms = np.frombuffer(b"".join(h[2] for h in held), "<u4")
            counts = np.frombuffer(b"".join(h[3] for h in held), "<u4")
            lengths = np.array([len(h[2]) // 4 for h in held])
            places = s.place[terms]
            by = np.lexsort((places, np.repeat(np.arange(len(held)), lengths)))
            m = 50 + np.array([50 * h[1] * s.n // s.total_terms for h in held], np.int64)
            tree = DocumentTree(places[by], counts[by], np.concatenate([[0], np.cumsum(lengths)]), m, [h[0] for h in held], len(s.place), leaf)
            weight = np.zeros(len(s.place), np.int64)
            for item, own in enumerate(s.items):
                weight[own] = s.weight[own]
                tree.search(own, weight, best[item], s.depth, max(1, s.floors.get(item, 1)))
                weight[own] = 0

        size = 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if row[2]:
                    held.append(row)
                    size += len(row[2]) // 4
                if size >= tree_terms:
                    look()
                    held, size = [], 0
        if held:
            look()
        for lo in range(0, len(best), 1000):
            out = [(lo + i, doc, score) for i, b in enumerate(best[lo : lo + 1000]) for score, _, doc in b]
            columns = list(zip(*out, strict=True)) if out else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32(), pa.int64(), pa.int64()], strict=True)], ["item", "doc_id", "score"])

    return vectors.mapInArrow(run, FOUND)


def _best(found: DataFrame, depth: int) -> DataFrame:
    """The best rows of each item with their rank. Each of 16 parts of an item's rows keeps
    its best first, so what meets in a task doesn't grow with the documents."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    parts = found.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(16)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= depth)
    return parts.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= depth)


def rank_documents(docs: DataFrame, items: DataFrame, depth: int = 50, block_bytes: int = BLOCK_BYTES, tree_terms: int = TREE_TERMS, leaf: int = LEAF, pilot: int = PILOT) -> DataFrame:
    """item_id, rank, doc_id, score: the ``depth`` best documents of each item.

    All texts are read whole, once for each ``block_bytes`` of item text; the counts that
    weights and lengths use are those of all documents. Trees hold the vectors of a task, about
    ``tree_terms`` terms each; the last place so far carries over from tree to tree. With more
    than ``pilot`` documents, that many are searched first: the score of their last place is a
    floor under the true one, so other tasks return little.

    Null and empty texts have no terms: such documents are found by no item and such items
    find none. Equal scores go by ascending ``doc_id``, nulls last; repeated documents are
    ranked each, as are items that repeat an ``item_id``, each with ranks of its own; empty
    tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tests = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    out = None
    for k in range(blocks):
        # at most about block_bytes
        asked = [(r["item_id"], sorted(set(terms_of((r["text"] or "").encode())))) for r in tests.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        found = _block(own, asked, depth, tree_terms, leaf, pilot)
        names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(asked)], "item int, item_id long")
        found = found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = found if out is None else out.unionByName(found)
    return out


def _block(docs: DataFrame, asked: list[tuple], depth: int, tree_terms: int, leaf: int, pilot: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    vocabulary = sorted({t for _, ts in asked for t in ts})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = stage(_vectors(docs, context.broadcast(b" ".join(vocabulary))), "term-vectors")
    n, total = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    inside = _frequencies(vectors, len(vocabulary))
    order = np.argsort(-inside, kind="stable")
    place = np.empty(len(vocabulary), np.uint32)
    place[order] = np.arange(len(vocabulary), dtype=np.uint32)
    weight = np.array([weight_of(n, x) for x in inside[order].tolist()], np.int64)
    places = [np.sort(place[[number[t] for t in ts]]) if ts else np.zeros(0, np.uint32) for _, ts in asked]
    search, filled = Search(place, weight, places, max(total, 1), n, depth, {}), vectors.where(F.octet_length("terms") > 0)
    if n > pilot:
        some = filled.where(F.pmod(F.xxhash64("doc_id", "n", "terms"), F.lit(-(-n // pilot))) == 0)
        last = _best(_search(some, context.broadcast(search), tree_terms, leaf), depth).where(F.col("rank") == depth)
        search = search._replace(floors={r["item"]: r["score"] for r in last.select("item", "score").collect()})
    return _best(_search(filled, context.broadcast(search), tree_terms, leaf), depth)
