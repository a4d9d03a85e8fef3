"""Packing along a space-filling curve.

Each document's hashed token counts are projected to a few dimensions, and its place on the
Hilbert curve through them is its key. Documents are range-sorted by that key and laid end to
end, so a sequence holds documents that are neighbours on the curve. Only keys and lengths are
sorted; the tokens move once, to meet their places.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clonoform.llm.common import numbered, stage
from clonoform.llm.hilbert import hilbert_keys
from clonoform.llm.token_codec import codec

#: Buckets that token ids are hashed to, dimensions that their counts are projected to, and
#: bits a dimension of the grid that the curve runs through.
BUCKETS, DIMENSIONS, BITS = 4096, 3, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _projection() -> np.ndarray:
    return np.random.default_rng(11).standard_normal((BUCKETS, DIMENSIONS))


def curve_points(rows: list[np.ndarray], projection: np.ndarray) -> np.ndarray:
    """Grid points of documents given by their token ids: log counts of hashed ids at unit
    length, projected; a document without tokens is the middle of the grid."""
    out = np.zeros((len(rows), DIMENSIONS))
    for k, ids in enumerate(rows):
        buckets, counts = np.unique((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52), return_counts=True)
        weights = np.log1p(counts)
        if len(weights):
            out[k] = weights / np.linalg.norm(weights) @ projection[buckets.astype(np.int64)]
    # a projected coordinate is a standard normal: four deviations either way fill the grid
    return np.clip((out + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def _tokens(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, key, n (tokens with the end id), ids (little-endian, without the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, projection = codec(path).encode, _projection()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                some = batch.slice(lo, 256)
                ids = [np.frombuffer(encode(t), "<u4") for t in some.column(1).cast(pa.binary()).to_pylist()]
                keys = hilbert_keys(curve_points(ids, projection), BITS)
                small = [i.astype("<u2") if i.size == 0 or i.max() < 65536 else i for i in ids]
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(keys), pa.array([len(i) + 1 for i in ids], pa.int64()), pa.array([i.itemsize for i in small], pa.int8()), pa.array([i.tobytes() for i in small], pa.binary())],
                    ["doc_id", "key", "n", "width", "ids"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, key long, n long, width tinyint, ids binary")


def _places(tokens: DataFrame) -> tuple[DataFrame, int]:
    """rid, at: how many tokens stand before each document along the curve; and all tokens.

    Equal keys are ordered by row, so one key that many documents have fills many ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = at + np.cumsum(batch.column("n").to_numpy())
            starts = ends - batch.column("n").to_numpy()
            at = int(ends[-1]) if len(ends) else at
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array([part] * len(ends), pa.int32())], ["rid", "local", "end", "part"])

    light = tokens.select("key", "rid", "n")
    ordered = stage(light.repartitionByRange("key", "rid").sortWithinPartitions("key", "rid").mapInArrow(run, "rid long, local long, end long, part int"), "curve-order")
    # one row a range: as many as the shuffle has partitions, whatever the input
    sizes = ordered.groupBy("part").agg(F.max("end").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    return ordered.join(F.broadcast(before), "part").select("rid", (F.col("before") + F.col("local")).alias("at")), int(total)


def sequence_starts(total: int, capacity: int) -> tuple[int, np.ndarray]:
    """How many full sequences ``total`` tokens make, and where those of the rest start: its
    powers of two, falling, so that none of them is padded. The last entry is ``total``."""
    full, rest = divmod(total, capacity)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return full, full * capacity + np.cumsum([0, *powers])


def _cuts(at: int, n: int, full: int, tail: np.ndarray, capacity: int) -> list[int]:
    """The starts of sequences that lie inside a document, between its own start and end."""
    inner = list(range((at // capacity + 1) * capacity, min(at + n, full * capacity), capacity))
    return [at, *inner, *tail[(tail > at) & (tail < at + n)].tolist(), at + n]


def pack_along_curve(docs: DataFrame, path: str, end_id: int = 2, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``capacity`` tokens, neighbours together.

    One row a piece; ``with_ids`` adds the piece's ids (little-endian unsigned 32-bit). All
    sequences are full but the last ones, whose lengths are falling powers of two (at most
    one of each), so nothing is padded. ``sequence_id`` follows the curve. A document is cut
    only where a sequence ends.

    Null text counts as empty (one end id); a null ``doc_id`` stays null; repeated rows are
    packed each; an empty table gives no rows; other columns are ignored.
    """
    tokens = numbered(_tokens(docs, path, end_id))
    places, total = _places(tokens)
    full, tail = sequence_starts(total, capacity)
    schema = PIECES + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, n, width, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "width", "ids", "at")), strict=True):
                own = np.concatenate([np.frombuffer(ids, f"<u{width}").astype("<u4"), end]).tobytes()
                cuts = _cuts(at, n, full, tail, capacity)
                for lo, hi in zip(cuts, cuts[1:], strict=False):
                    if lo < full * capacity:
                        sequence, first = lo // capacity, lo // capacity * capacity
                    else:
                        k = int(np.searchsorted(tail, lo, "right")) - 1
                        sequence, first = full + k, int(tail[k])
                    piece = own[4 * (lo - at) : 4 * (hi - at)]
                    out.append((doc, lo - at, hi - lo, zlib.crc32(piece), n, sequence, lo - first, *[piece] * with_ids))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if name == "ids" else pa.int64()) for c, name in zip(columns, names, strict=True)], names)

    return tokens.drop("key").join(places, "rid").mapInArrow(run, schema)
