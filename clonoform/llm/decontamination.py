"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every
training passage with block-max WAND, then verified on question and answer.

The index holds each term's postings, ordered by item and cut at blocks of items, with the
largest weight of each term in each block. A batch of passages is searched at a time. The
terms of a passage are ordered by their largest weight; those before the pivot, where the sum
of the largest weights reaches the threshold, can't reach it alone, so only the posting lists
from the pivot on name blocks. A block is skipped unless the block maxima of all of the
passage's terms reach the threshold, and only then are its postings added up. No bound is
below the score, so every item above the threshold is found.
"""

from __future__ import annotations

import math
import pickle
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Mapping
from itertools import repeat
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clonoform.llm.common import stage

#: ASCII letters lower-cased; other ASCII but digits a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence (or what follows "Answer:") is its answer, what stands
    before it its question; an item of one sentence is both."""
    marked = re.split(r"(?i)\banswer\s*:", text, maxsplit=1)
    if len(marked) == 2 and all(map(str.strip, marked)):
        return marked[0], marked[1]
    ends = [m.end() for m in re.finditer(r"[.!?]\s+", text.strip())]
    return (text.strip()[: ends[-1]], text.strip()[ends[-1] :]) if ends else (text, text)


class Item:
    """What verification needs of an item: its weights by word and its shingles."""

    def __init__(self, item_id: int | None, text: str, size: int):
        question, answer = question_and_answer(text)
        self.item_id, self.words = item_id, words(text.encode())
        cut = len(self.words) - len(words(answer.encode())) if question != answer else 0
        self.shingles = self._shingles(self.words, size)
        # a shingle belongs to the part that its last word is in
        first_end = min(size, len(self.words)) - 1
        self.answer = frozenset(s for i, s in enumerate(self.shingles) if i + first_end >= cut)
        self.question = frozenset(s for i, s in enumerate(self.shingles) if i + first_end < cut) or self.answer
        self.whole = frozenset(self.shingles)

    @staticmethod
    def _shingles(ws: list[bytes], size: int) -> list[tuple[bytes, ...]]:
        return [tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))] if ws else []


class Corpus(NamedTuple):
    """What weights need to know of all items: how many have words, their words in total, the
    longest, and in how many each word occurs."""

    n: int
    total: int
    longest: int
    inside: Mapping[bytes, int]


#: An index with at most so many pairs of a term and a block has a table of their entries.
MOST_DIRECT = 8_000_000


class Bm25Index:
    """Postings of items. A weight is a term's BM25 weight in an item over the item's whole
    weight, so 1 is an item found in full. Items are sorted by whole weight and cut into
    blocks, so that a block's maxima are close bounds. ``corpus`` describes all items where
    these are a part of them; without it these are all.

    Arrays, all sorted by term and then by item: ``first`` is where a term's (term, block)
    entries start, ``key`` names an entry (term x blocks + block), ``top`` is its largest
    weight, and ``start`` is where its postings ``item`` and ``weight`` start.
    """

    def __init__(self, items: list[tuple[int | None, str | None]], size: int = 5, block: int | None = None, k1: float = 1.2, b: float = 0.75, corpus: Corpus | None = None):
        texts = [(i, t, Counter(ws)) for i, t, ws in ((i, t, words((t or "").encode())) for i, t in items) if ws]
        n, self.size, self.k1, self.b = len(texts), size, k1, b
        own = Counter(w for _, _, c in texts for w in c)
        lengths = [c.total() for _, _, c in texts]
        self.corpus = corpus or Corpus(n, sum(lengths), max(lengths, default=0), own)
        self.idf = {w: math.log1p((self.corpus.n - self.corpus.inside[w] + 0.5) / (self.corpus.inside[w] + 0.5)) for w in own}
        self.longest = self.corpus.longest
        self.terms = {w: i + 1 for i, w in enumerate(sorted(own))}
        weights = [self._weights(c) for _, _, c in texts]
        whole = [math.fsum(w.values()) for w in weights]
        order = sorted(range(n), key=lambda k: (whole[k], texts[k][0] is None, texts[k][0] or 0, texts[k][1]))
        self.texts = [texts[k][:2] for k in order]
        self.per = block or max(8, -(-n // 1024))
        self.blocks = max(1, -(-n // self.per))
        term = np.fromiter((self.terms[w] for k in order for w in weights[k]), np.int64)
        item = np.repeat(np.arange(n), [len(weights[k]) for k in order])
        weight = np.fromiter((x / whole[k] for k in order for x in weights[k].values()), np.float64)
        by = np.argsort(term, kind="stable")
        self.item, self.weight = item[by].astype(np.int32), weight[by]
        keys = term[by] * self.blocks + self.item // self.per
        self.key, start = np.unique(keys, return_index=True)
        self.start = np.append(start, len(keys))
        # rounded up, so that a bound never falls below a score
        self.top = np.nextafter(np.maximum.reduceat(self.weight, start).astype(np.float32), np.float32(2)) if n else np.zeros(0, np.float32)
        self.first = np.searchsorted(self.key, np.arange(len(self.terms) + 2) * self.blocks)
        self.most = np.zeros(len(self.terms) + 1, np.float32)
        if n:
            self.most[1:] = np.maximum.reduceat(self.top, self.first[1:-1])
        self._fill()

    def _fill(self) -> None:
        """What isn't written: where an entry is, for an index so small that all pairs of term
        and block fit (else it is searched for), and the items unpacked so far."""
        self.entry = np.full((len(self.terms) + 1) * self.blocks, -1, np.int32) if (len(self.terms) + 1) * self.blocks <= MOST_DIRECT else None
        if self.entry is not None:
            self.entry[self.key] = np.arange(len(self.key))
        self._items: dict[int, tuple[Item, dict[bytes, float]]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("entry", "_items")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._fill()

    def _weights(self, counts: Counter) -> dict[bytes, float]:
        norm = self.k1 * (1 - self.b + self.b * counts.total() * self.corpus.n / self.corpus.total)
        return {w: self.idf[w] * f * (self.k1 + 1) / (f + norm) for w, f in sorted(counts.items())}

    def item_of(self, k: int) -> tuple[Item, dict[bytes, float]]:
        """An item and its weights by word, made when first found and kept by the worker."""
        if k not in self._items:
            x = Item(*self.texts[k], self.size)
            weights = self._weights(Counter(x.words))
            whole = math.fsum(weights.values())
            self._items[k] = x, {w: v / whole for w, v in weights.items()}
        return self._items[k]

    def search(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """All (passages, items, scores) with score >= threshold. The pairs passage and term
        are distinct and sorted by passage."""
        if not len(passage) or not len(self.texts):
            return
        need = threshold - 1e-5
        ends = np.flatnonzero(np.diff(passage, append=-1)) + 1
        starts = np.concatenate([[0], ends[:-1]])
        live = np.add.reduceat(self.most[term], starts, dtype=np.float64) >= need
        starts, ends = starts[live], ends[live]
        for lo in range(0, len(starts), 512):
            a, e = starts[lo : lo + 512], ends[lo : lo + 512]
            at, row = _spread(a, e), np.repeat(np.arange(len(a)), e - a)
            yield from self._among(passage[a], row, term[at], need, threshold)

    def _among(self, names: np.ndarray, row: np.ndarray, term: np.ndarray, need: float, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The same for few passages, whose terms are (row, term)."""
        most = self.most[term].astype(np.float64)
        order = np.lexsort((most, row))
        row, term, most = row[order], term[order], most[order]
        size = np.bincount(row, minlength=len(names))
        begin = np.cumsum(size) - size
        run = np.cumsum(most)
        run -= (run[begin] - most[begin])[row]  # sums of the largest weights within the passage
        late = np.flatnonzero(run >= need)  # from the pivot on
        # the blocks that the lists from the pivot on name
        entries = _spread(self.first[term[late]], self.first[term[late] + 1])
        block = self.key[entries] % self.blocks
        pairs = np.unique(np.repeat(row[late], self.first[term[late] + 1] - self.first[term[late]]) * self.blocks + block)
        for lo in range(0, len(pairs), 4096):
            of, block = pairs[lo : lo + 4096] // self.blocks, pairs[lo : lo + 4096] % self.blocks
            own = _spread(begin[of], begin[of] + size[of])
            pair = np.repeat(np.arange(len(of)), size[of])
            key = term[own] * self.blocks + np.repeat(block, size[of])
            if self.entry is not None:
                place = self.entry[key]
                hit = place >= 0
            else:
                place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
                hit = self.key[place] == key
            place, pair = place[hit], pair[hit]
            ok = (np.bincount(pair, self.top[place], len(of)) >= need)[pair]
            place, pair = place[ok], pair[ok]
            posting = _spread(self.start[place], self.start[place + 1])
            slot = np.repeat(pair, self.start[place + 1] - self.start[place]) * self.per + self.item[posting] % self.per
            found, slot = np.unique(slot, return_inverse=True)
            score = np.bincount(slot, self.weight[posting], len(found))
            good = score >= threshold - 1e-9
            if good.any():
                p, i = found[good] // self.per, found[good] % self.per
                yield names[of[p]], i + block[p] * self.per, score[good]


def _spread(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after the other."""
    n = ends - starts
    return np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())


HITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("overlap", T.DoubleType()),
        T.StructField("question_overlap", T.DoubleType()),
        T.StructField("answer_overlap", T.DoubleType()),
    ]
)


def batch_hits(index: Bm25Index, texts: list[bytes | None], threshold: float, overlap: float, part: float, size: int) -> Iterator[tuple[int, int, tuple[float, float, float, float]]]:
    """(text number, item number, (score, overlap, question overlap, answer overlap)).

    Passages are twice the longest item and overlap by half, so one of them holds any item
    in full.
    """
    step = max(32, index.longest)
    every, keys, owner, first = [], [], [], [0]
    wide = len(index.terms) + 1
    for k, text in enumerate(texts):
        ws = words(text)
        every.append(ws)
        terms = np.fromiter(map(index.terms.get, ws, repeat(0)), np.int64, len(ws))
        at = np.flatnonzero(terms)
        last = max(-(-len(ws) // step) - 2, 0)
        place = at // step
        for shift in (0, 1):
            in_passage = place - shift
            ok = (in_passage >= 0) & (in_passage <= last)
            keys.append((first[-1] + in_passage[ok]) * wide + terms[at[ok]])
        owner += [k] * (last + 1)
        first.append(first[-1] + last + 1)
    pairs = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    shingles: dict[tuple[int, int], set] = {}
    for passages, items, _ in index.search(pairs // wide, pairs % wide, threshold):
        for p, k in zip(passages.tolist(), items.tolist(), strict=True):
            text, (item, weights) = owner[p], index.item_of(k)
            ws, start, n = every[text], (p - first[text]) * step, min(size, len(item.words))
            stop = min(start + 2 * step, len(ws))
            if (p, 0) not in shingles:
                shingles[p, 0] = set(ws[start:stop])
            # the same number whatever the order of terms and items
            score = math.fsum(x for w, x in weights.items() if w in shingles[p, 0])
            if score < threshold:
                continue
            if (p, n) not in shingles:
                shingles[p, n] = {tuple(ws[i : i + n]) for i in range(start, max(start, stop - n + 1))}
            own = shingles[p, n]
            whole, q, a = (len(x & own) / len(x) for x in (item.whole, item.question, item.answer))
            if whole >= overlap and q >= part and a >= part:
                yield text, k, (score, whole, q, a)


INDEX = "block long, part int, bytes binary"
#: An index is written in rows of so many bytes, as a reader holds some thousands of rows.
CHUNK = 16_384


def _item_words(test: DataFrame) -> DataFrame:
    """(block, word, length) of the items (block, text) that have words: one row for each word
    of an item and one without a word for the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                ws = words(text)
                if ws:
                    own = [None, *set(ws)]
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(own), pa.int64()), pa.array(own, pa.binary()), pa.array([len(ws)] * len(own), pa.int64())], ["block", "word", "length"])

    return stage(test.select(F.col("block").cast("long").alias("block"), "text").mapInArrow(run, "block long, word binary, length long"), "item-words")


def _built_indexes(test: DataFrame, size: int, several: bool) -> DataFrame:
    """(block, part, bytes): the index of each block of items, built in a task of its own.
    Where there are several, the frequencies of a block's words in all items come along with
    the items."""
    no = lambda kind, name: F.lit(None).cast(kind).alias(name)
    rows, counts = test.select("block", "item_id", "text", no("binary", "word"), no("long", "n")), None
    if several:
        counts, used = _frequencies(test)
        rows = rows.unionByName(used.select("block", no("long", "item_id"), no("string", "text"), "word", "n"))

    def build(batch: pa.Table) -> pa.Table:
        kinds = batch.column("word").is_valid()
        frequencies, items = batch.filter(kinds), batch.filter(pa.compute.invert(kinds))
        words = dict(zip(frequencies.column("word").to_pylist(), frequencies.column("n").to_pylist(), strict=True))
        own = list(zip(items.column("item_id").to_pylist(), items.column("text").to_pylist(), strict=True))
        blob = pickle.dumps(Bm25Index(own, size, corpus=counts and Corpus(*counts, words)), pickle.HIGHEST_PROTOCOL)
        parts = [blob[lo : lo + CHUNK] for lo in range(0, len(blob), CHUNK)]
        block = batch.column("block")[0].as_py()
        return pa.table([pa.array([block] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], ["block", "part", "bytes"])

    return stage(rows.groupBy("block").applyInArrow(build, INDEX), "item-indexes")


def _frequencies(test: DataFrame) -> tuple[tuple[int, int, int], DataFrame]:
    """How many items have words, their words in total and the longest; and (block, word, n):
    in how many items each word of a block is."""
    found = _item_words(test)
    n, total, longest = found.where("word is null").agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0)), F.coalesce(F.max("length"), F.lit(0))).first()
    inside = found.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return (n, total, longest), found.where("word is not null").select("block", "word").distinct().join(inside, "word")


def _indexes(spark: SparkSession, items: DataFrame, size: int, block_bytes: int) -> Iterator[tuple[Broadcast, bool]]:
    """Broadcast indexes, one after the other, of about ``block_bytes`` of item text each, the
    rows of an item_id in one of them, and whether there are several: then each goes once the
    next is asked for. Frequencies and lengths are those of all items."""
    test = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = test.agg(F.sum(F.octet_length("text") + 64).alias("n")).first()["n"] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    built = _built_indexes(test.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), size, blocks > 1)
    names = sorted(r["block"] for r in built.where("part = 0").select("block").collect())
    for k in names:
        parts = sorted((r["part"], r["bytes"]) for r in built.where(F.col("block") == k).select("part", "bytes").collect())
        shared = spark.sparkContext.broadcast(b"".join(p for _, p in parts))
        yield shared, len(names) > 1
        if len(names) > 1:
            shared.destroy()
    if not names:
        yield spark.sparkContext.broadcast(pickle.dumps(Bm25Index([], size))), False


_UNPACKED: dict[str, Bm25Index] = {}


def _unpacked(name: str, shared: Broadcast) -> Bm25Index:
    """The index, unpacked once in a worker, which holds one at a time."""
    if name not in _UNPACKED:
        _UNPACKED.clear()
        _UNPACKED[name] = pickle.loads(shared.value)
    return _UNPACKED[name]


#: So many bytes of item text are in one index, which takes some seven times that memory in
#: each worker; a larger benchmark takes a pass over the documents for each further index.
INDEX_BYTES = 8_000_000


def find_contamination(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, size: int = 5, block_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row for each document and test item that it holds: doc_id, item_id, score (share
    of the item's BM25 weight that a passage has), overlap (share of the item's five-word
    shingles), question_overlap, answer_overlap.

    Every passage of every whole text is a query, in one pass over the documents for each
    ``block_bytes`` of item text. Document frequencies, mean and longest length are those of
    all items, and an item's score adds up alike everywhere, so the rows don't depend on the
    number of indexes. An item of fewer than five words must be found whole. Null and empty
    texts match nothing; null ids stay null; repeated documents each give their rows; items
    that repeat an item_id are matched each, and the best row of an id is kept; empty tables
    give no rows; other columns are ignored.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = None
    for shared, several in _indexes(docs.sparkSession, items, size, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _unpacked(name, shared)
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    docs, texts = batch.column(0).slice(lo, 128).to_pylist(), batch.column(1).slice(lo, 128).cast(pa.binary()).to_pylist()
                    rows: dict = {}
                    for text, k, x in batch_hits(index, texts, threshold, overlap, part, size):
                        key = text, index.texts[k][0]
                        rows[key] = max(rows.get(key, (0.0,)), x)
                    out = [(docs[text], i, *x) for (text, i), x in rows.items()]
                    columns = list(zip(*out, strict=True)) if out else [[]] * 6
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 2 else pa.float64()) for i, c in enumerate(columns)], HITS.names)

        part_found = own.mapInArrow(run, HITS)
        if several:
            part_found = stage(part_found, "contamination")
        found = part_found if found is None else found.unionByName(part_found)
    return found


def uncontaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, overlap: float = 0.8, part: float = 0.5, size: int = 5, block_bytes: int = INDEX_BYTES) -> DataFrame:
    """The documents, with all of their columns, that ``find_contamination`` finds no item in.
    The pass that searches a text decides on its row, so no text moves. Nulls, empty texts,
    repeated rows and empty tables as there."""
    place = docs.columns.index("text")
    for shared, several in _indexes(docs.sparkSession, items, size, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _unpacked(name, shared)
            for batch in batches:
                for lo in range(0, batch.num_rows, 128):
                    rows = batch.slice(lo, 128)
                    texts = rows.column(place).cast(pa.binary()).to_pylist()
                    bad = {text for text, _, _ in batch_hits(index, texts, threshold, overlap, part, size)}
                    yield rows.filter(pa.array([i not in bad for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
        if several:
            docs = stage(docs, "uncontaminated")
    return docs
