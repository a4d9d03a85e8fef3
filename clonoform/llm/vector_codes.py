"""Vector codes: every eighth of a vector becomes the index of one of sixteen entries.

The parts of each position are sorted along a Hilbert curve and cut into flat blocks, which
keep their parts, the box of their components' least and largest values, and the
components' sums. In each round the distances of a block's box to the entries leave a short
list; a block with one entry left is added as a whole, and the parts of the others are
compared with the short list in exact integers. What the driver gets of a round is one sum
for each position, entry and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clonoform.llm.common import join_groups_of, numbered, stage
from clonoform.llm.hilbert import hilbert_keys

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Parts in a block.
BLOCK = 256
BLOCKS = "position int, rids binary, parts binary, low binary, high binary, sums binary"
#: Components are held as 32-bit integers in blocks; all sums and distances are 64-bit.
SMALL, WIDE = "<i4", "<i8"


def _finite(x: Column) -> Column:
    return F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def integer_vectors(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """rid, vec_id, label, v (integer components), without null or non-finite vectors, and
    without empty ones."""
    x = F.col(column).cast("array<double>")
    label = F.col("label") if "label" in vectors.columns else F.lit(None).cast("int")
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).where(F.col("x").isNotNull() & (F.size("x") > 0) & _finite(F.col("x")))
    return kept.select("vec_id", "label", F.transform("x", lambda v: F.floor(v * float(SCALE))).alias("v"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """The vectors of a batch, filled up with zeros to a multiple of the parts."""
    flat = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)
    return np.pad(flat, ((0, 0), (0, -width % PARTS)))


def _ranges(kept: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of each component, over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column(0), width)
                low, high = (m.min(0), m.max(0)) if low is None else (np.minimum(low, m.min(0)), np.maximum(high, m.max(0)))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low)), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["i", "low", "high"])

    found = kept.select("v").mapInArrow(run, "i int, low long, high long").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    found.sort(key=lambda r: r["i"])
    return np.array([r["low"] for r in found]), np.array([r["high"] for r in found])


def _sorted_parts(kept: DataFrame, width: int) -> DataFrame:
    """position, key, rid, part: the parts of each position in the order of their keys. Only
    the first 60 components of a part decide on its key."""
    low, high = _ranges(kept, width)
    size = len(low) // PARTS
    axes = min(size, 60)
    bits = min(8, 60 // axes)
    step = np.maximum((high - low) / (1 << bits), 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column(1), width)
            grid = np.clip((m - low) / step, 0, (1 << bits) - 1).astype(np.int64)
            for p in range(PARTS):
                own = slice(p * size, (p + 1) * size)
                data = np.ascontiguousarray(m[:, own].astype(SMALL))
                keys = hilbert_keys(grid[:, own][:, :axes], bits)
                parts = [row.tobytes() for row in data]
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(m), pa.int32()), pa.array(keys), batch.column(0), pa.array(parts, pa.binary())], ["position", "key", "rid", "part"])

    rows = kept.select("rid", "v").mapInArrow(run, "position int, key long, rid long, part binary")
    # rid orders equal keys, so one vector that many rows have fills many ranges
    return rows.repartitionByRange("position", "key", "rid").sortWithinPartitions("position", "key", "rid")


def _blocks(parts: DataFrame, size: int, block: int) -> DataFrame:
    def flush(position: int, rids: list, held: list) -> pa.RecordBatch:
        m = np.frombuffer(b"".join(held), SMALL).reshape(-1, size).astype(np.int64)
        cells = [np.array(rids, WIDE), m.astype(SMALL), m.min(0).astype(WIDE), m.max(0).astype(WIDE), m.sum(0).astype(WIDE)]
        return pa.RecordBatch.from_arrays([pa.array([position], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cells)], [c.split()[0] for c in BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rids, held = None, [], []
        for batch in batches:
            for position, rid, part in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if held and (position != at or len(held) == block):
                    yield flush(at, rids, held)
                    rids, held = [], []
                at = position
                rids.append(rid)
                held.append(part)
        if held:
            yield flush(at, rids, held)

    return stage(parts.select("position", "rid", "part").mapInArrow(run, BLOCKS), "vector-blocks")


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(boxes, entries): whether some point of the box may belong to the entry.

    An entry goes if its least distance to the box is above the largest distance of another,
    or if nowhere in the box it is nearer than the one whose largest distance is least (or as
    near, and behind it).
    """
    near = (np.maximum(np.maximum(low[:, None] - entries, entries - high[:, None]), 0) ** 2).sum(-1)
    far = (np.maximum(np.abs(entries - low[:, None]), np.abs(high[:, None] - entries)) ** 2).sum(-1)
    keep = near <= far.min(1, keepdims=True)
    best = far.argmin(1)
    # over the box, the largest value of distance to the best less distance to another entry
    gap = entries[best][:, None] - entries
    corner = np.where(gap > 0, low[:, None], high[:, None])
    most = (gap * (entries[best][:, None] + entries - 2 * corner)).sum(-1)
    order = np.arange(len(entries))
    beaten = (most < 0) | (most == 0) & (order > best[:, None])
    return keep & ~(beaten & (order != best[:, None]))


def _boxes(batch: pa.RecordBatch, codebooks: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Of each block of a batch: its row, its position and its short list."""
    size = codebooks.shape[2]
    positions = batch.column("position").to_numpy()
    low, high = (np.frombuffer(b"".join(batch.column(c).to_pylist()), WIDE).reshape(-1, size) for c in ("low", "high"))
    for p in np.unique(positions).tolist():
        rows = np.flatnonzero(positions == p)
        for lo in range(0, len(rows), 256):
            some = rows[lo : lo + 256]
            for row, keep in zip(some.tolist(), shortlists(low[some], high[some], codebooks[p]), strict=True):
                yield row, p, np.flatnonzero(keep)


def _distances(parts: bytes, entries: np.ndarray) -> np.ndarray:
    m = np.frombuffer(parts, SMALL).reshape(-1, entries.shape[1]).astype(np.int64)
    return ((m[:, None] - entries) ** 2).sum(-1)


def _round(blocks: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one more round: each entry the floor of the mean of its parts."""
    size = codebooks.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, many = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        for batch in batches:
            parts, totals, rids = (batch.column(c) for c in ("parts", "sums", "rids"))
            for row, p, few in _boxes(batch, codebooks):
                if len(few) == 1:
                    sums[p, few[0]] += np.frombuffer(totals[row].as_py(), WIDE)
                    many[p, few[0]] += len(rids[row].as_py()) // 8
                    continue
                own = parts[row].as_py()
                to = few[_distances(own, codebooks[p][few]).argmin(1)]
                np.add.at(sums[p], to, np.frombuffer(own, SMALL).reshape(-1, size).astype(np.int64))
                many[p] += np.bincount(to, minlength=codebooks.shape[1])
        p, e = np.nonzero(many)
        at = np.arange(size)
        columns = [np.repeat(p, size), np.repeat(e, size), np.tile(at, len(p)), sums[p, e].ravel(), np.repeat(many[p, e], size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 2, strict=True)], ["p", "e", "j", "total", "n"])

    rows = blocks.mapInArrow(run, "p int, e int, j int, total long, n long").groupBy("p", "e", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()
    out = codebooks.copy()
    for r in rows:
        out[r["p"], r["e"], r["j"]] = r["total"] // r["n"]
    return out


def _assign(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """rid, code (a byte a position, the first highest), error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, p, few in _boxes(batch, codebooks):
                d = _distances(batch.column("parts")[row].as_py(), codebooks[p][few])
                code = few[d.argmin(1)].astype(np.int64) << 8 * (PARTS - 1 - p)
                rids = np.frombuffer(batch.column("rids")[row].as_py(), WIDE)
                yield pa.RecordBatch.from_arrays([pa.array(rids), pa.array(code), pa.array(d.min(1))], ["rid", "code", "error"])

    found = blocks.mapInArrow(run, "rid long, code long, error long")
    return found.groupBy("rid").agg(F.sum("code").alias("code"), F.sum("error").alias("error"))


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, block: int = BLOCK, column: str = "embedding") -> DataFrame:
    """Per kept vector: vec_id, code (hex), error, label_error, codebooks_sha256.

    Entries start as the parts of the 16 smallest ``vec_id`` (nulls last; equal ids by their
    components) and move for ``rounds`` rounds; all arithmetic is exact.

    Null vectors, empty ones and those with a null or non-finite component are dropped. The
    vector that comes first in that order sets the length; vectors of another length are
    dropped too, as are those with a component so large that a squared distance could leave
    64 bits (beyond 43,000 in absolute value for 64 components). A length that 8 doesn't
    divide is filled up with zeros. Fewer than 16 vectors give as many entries. Repeated rows are coded each; a
    null ``vec_id`` stays null; without a ``label`` column all labels are null; a sum of
    errors beyond 64 bits is null; an empty table gives no rows; other columns are ignored.
    """
    rows = integer_vectors(vectors, column)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = rows.orderBy(*order).select(F.size("v")).first()
    width = first[0] if first else PARTS
    bound = math.isqrt((2**63 - 1) // (width + PARTS)) // 2
    inside = F.forall("v", lambda c: (c < bound) & (c > -bound))
    kept = numbered(rows.where((F.size("v") == width) & inside))
    starts = [r["v"] for r in kept.orderBy(*order).limit(ENTRIES).collect()]
    if not starts:
        empty = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.select("*", F.lit(0).cast("long").alias("label_error"), F.lit(hashlib.sha256(b"").hexdigest()).alias("codebooks_sha256"))
    start = np.pad(np.array(starts, np.int64).reshape(len(starts), width), ((0, 0), (0, -width % PARTS)))
    codebooks = np.ascontiguousarray(start.reshape(len(starts), PARTS, -1).transpose(1, 0, 2))
    size = codebooks.shape[2]
    blocks = _blocks(_sorted_parts(kept, width), size, block)
    for _ in range(rounds):
        codebooks = _round(blocks, codebooks)
    digest = hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()
    coded = stage(kept.select("rid", "vec_id", F.struct("label").alias("label")).join(_assign(blocks, codebooks), "rid"), "vector-codes")
    labels = stage(coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count(F.lit(1)).alias("size")), "label-errors")
    return join_groups_of(coded, labels, "label", "size").select(
        "vec_id",
        F.lpad(F.lower(F.hex("code")), 2 * PARTS, "0").alias("code"),
        "error",
        "label_error",
        F.lit(digest).alias("codebooks_sha256"),
    )
