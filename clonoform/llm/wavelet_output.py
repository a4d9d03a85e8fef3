"""Token-id output: one wavelet matrix per shard.

A shard is one compressed blob: a header, a directory, and for each bit of the ids, highest
first, a bit-plane in chunks of 65,536 bits that are compressed one by one. The directory has
each chunk's place and the ones before it; a chunk starts with the ones before each of its
blocks of 512 bits. Rank looks a chunk and a block up; select finds them by binary search on
the same counts. So any token, the count of an id in a range and the places of an id come from
the blob with only the chunks on their way decompressed.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from clonoform.llm.common import partitions, stage
from clonoform.llm.token_codec import codec

MAGIC = b"WMX2"
BLOCK = 512
CHUNK = 1 << 16
_BLOCKS = CHUNK // BLOCK
_HEAD = struct.Struct("<4sQB")


class _Plane:
    """One bit-plane: ones before each chunk, and chunks that are read when they are asked for."""

    def __init__(self, ranks: np.ndarray, chunks: dict[int, bytes] | list[bytes], n: int):
        self.ranks, self.chunks, self.n = ranks, chunks, n
        self.read: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def chunk(self, c: int) -> tuple[np.ndarray, np.ndarray]:
        """(ones before each block, from the chunk's start; the bits as bytes)."""
        if c not in self.read:
            import zstandard

            raw = zstandard.ZstdDecompressor().decompress(self.chunks[c])
            self.read[c] = np.frombuffer(raw, "<u2", _BLOCKS).astype(np.int64), np.frombuffer(raw, np.uint8, offset=2 * _BLOCKS)
        return self.read[c]

    def bits_and_ones(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit at each position (0 at the end) and the ones before it."""
        bit, ones = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
        chunk = at // CHUNK
        for c in np.unique(chunk).tolist():
            mine = np.flatnonzero(chunk == c)
            if c * CHUNK >= self.n:
                ones[mine] = self.ranks[-1]
                continue
            counts, raw = self.chunk(c)
            inside = at[mine] - c * CHUNK
            block, rest = inside // BLOCK, inside % BLOCK
            words = raw.reshape(-1, BLOCK // 8)[block]
            # bits of the block before the position
            before = np.arange(BLOCK // 8) * 8
            keep = np.clip(rest[:, None] - before, 0, 8)
            masked = words & ((1 << keep.astype(np.uint16)) - 1).astype(np.uint8)
            ones[mine] = self.ranks[c] + counts[block] + np.bitwise_count(masked).sum(axis=1, dtype=np.int64)
            bit[mine] = words[np.arange(len(mine)), rest // 8] >> (rest % 8).astype(np.uint8) & 1
        return bit, ones

    def select(self, number: np.ndarray, one: bool) -> np.ndarray:
        """The position of each numbered one (or zero), counted from 0."""
        before = self.ranks if one else np.minimum(np.arange(len(self.ranks)) * CHUNK, self.n) - self.ranks
        chunk = np.searchsorted(before, number, "right") - 1
        out = np.zeros(len(number), np.int64)
        for c in np.unique(chunk).tolist():
            mine = np.flatnonzero(chunk == c)
            counts, raw = self.chunk(c)
            counts = counts if one else np.arange(_BLOCKS) * BLOCK - counts
            left = number[mine] - before[c]
            block = np.searchsorted(counts, left, "right") - 1
            blocks, which = np.unique(block, return_inverse=True)
            bits = np.unpackbits(raw.reshape(-1, BLOCK // 8)[blocks], axis=1, bitorder="little")
            row, place = np.nonzero(bits if one else bits ^ 1)
            first = np.searchsorted(row, np.arange(len(blocks)))
            out[mine] = c * CHUNK + block * BLOCK + place[first[which] + left - counts[block]]
        return out

    def bits(self) -> np.ndarray:
        raw = [self.chunk(c)[1] for c in range(-(-self.n // CHUNK))]
        return np.unpackbits(np.concatenate(raw) if raw else np.zeros(0, np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """Succinct sequence of unsigned integers below 2**width."""

    def __init__(self, n: int, width: int, zeros: list[int], planes: list[_Plane]):
        self.n, self.width, self.zeros, self.planes = n, width, zeros, planes

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        import zstandard

        z = zstandard.ZstdCompressor(level=1)
        values = ids.astype(np.uint16 if width <= 16 else np.uint32)
        zeros, planes, n = [], [], len(ids)
        for k in range(width - 1, -1, -1):
            bits = (values >> k & 1).astype(bool)
            raw = np.zeros(-(-n // CHUNK) * CHUNK // 8, np.uint8)
            packed = np.packbits(bits, bitorder="little")
            raw[: len(packed)] = packed
            ones = np.bitwise_count(raw.view("<u8")).reshape(-1, _BLOCKS, BLOCK // 64).sum(axis=2, dtype=np.int64)
            inside = np.cumsum(ones, axis=1) - ones
            ranks = np.concatenate([[0], np.cumsum(ones.sum(axis=1))])
            rows = raw.reshape(-1, CHUNK // 8)
            planes.append(_Plane(ranks, [z.compress(inside[c].astype("<u2").tobytes() + rows[c].tobytes()) for c in range(len(rows))], n))
            low, high = values[~bits], values[bits]
            zeros.append(len(low))
            values = np.concatenate([low, high])
        return cls(n, width, zeros, planes)

    def to_bytes(self) -> bytes:
        """Header; then by plane its zeros, and by chunk the ones before it and its length; then
        the chunks."""
        directory, body = [], []
        for zeros, plane in zip(self.zeros, self.planes, strict=True):
            chunks = [plane.chunks[c] for c in range(len(plane.ranks) - 1)]
            directory.append(np.array([zeros, *plane.ranks, *map(len, chunks)], "<u8").tobytes())
            body += chunks
        return b"".join([_HEAD.pack(MAGIC, self.n, self.width), *directory, *body])

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        """A matrix that reads the blob's chunks as they are needed."""
        magic, n, width = _HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        many, view = -(-n // CHUNK), memoryview(blob)
        directory = np.frombuffer(blob, "<u8", width * (2 + 2 * many), _HEAD.size).astype(np.int64).reshape(width, -1)
        at, planes = _HEAD.size + directory.size * 8, []
        for row in directory:
            ends = at + np.cumsum(row[2 + many :])
            starts = [at, *ends[:-1].tolist()] if many else []
            planes.append(_Plane(row[1 : 2 + many], [view[a:b] for a, b in zip(starts, ends.tolist(), strict=True)], n))
            at = int(ends[-1]) if many else at
        return cls(n, width, directory[:, 0].tolist(), planes)

    def access(self, at) -> np.ndarray:
        """The tokens at these positions."""
        at = np.asarray(at, np.int64).copy()
        out = np.zeros(len(at), np.uint32)
        for level, plane in enumerate(self.planes):
            bit, ones = plane.bits_and_ones(at)
            out = out << 1 | bit
            at = np.where(bit, self.zeros[level] + ones, at - ones)
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.width:
            return 0, 0
        edge = np.array([start, end], np.int64)
        for level, plane in enumerate(self.planes):
            _, ones = plane.bits_and_ones(edge)
            edge = self.zeros[level] + ones if token >> (self.width - 1 - level) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often the token stands in positions start to end, end exclusive."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def positions(self, token: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The places of the token's occurrences number ``first`` to ``last``, ascending: select,
        plane by plane from the lowest."""
        a, b = self._range(token, 0, self.n)
        at = np.arange(a, b, dtype=np.int64)[first:last]
        for level in range(self.width - 1, -1, -1):
            one = bool(token >> (self.width - 1 - level) & 1)
            at = self.planes[level].select(at - self.zeros[level] if one else at, one)
        return at

    def decode(self) -> np.ndarray:
        """All tokens in order, by undoing the stable partition of each plane."""
        values = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        for level in range(self.width - 1, -1, -1):
            bits = self.planes[level].bits()
            before = np.empty_like(values)
            before[~bits] = values[: self.zeros[level]]
            before[bits] = values[self.zeros[level] :] | values.dtype.type(1 << (self.width - 1 - level))
            values = before
        return values


SHARD_SCHEMA = T.StructType(
    [
        T.StructField("part", T.IntegerType()),
        T.StructField("shard", T.IntegerType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("lengths", T.ArrayType(T.LongType())),
        T.StructField("blob", T.BinaryType()),
    ]
)


#: Null ids stand where the least id would, before it.
LEAST = np.iinfo(np.int64).min


def _encoded(docs: DataFrame, path: str, end_id: int, width: int, bounds: list[int]) -> DataFrame:
    cuts = np.asarray(bounds, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = codec(path, width).encode, end_id.to_bytes(width, "little")
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for lo in range(0, len(ids), 500):
                key = ids.slice(lo, 500)
                coded = [encode(t) + end for t in texts.slice(lo, 500).to_pylist()]
                order = np.array([zlib.crc32(c) for c in coded], np.int64)
                at = key.fill_null(LEAST).to_numpy(zero_copy_only=False)
                place, behind = (np.searchsorted(cuts, at, side=s) for s in ("left", "right"))
                # an id that several cuts fall on fills as many parts, by the order of its rows
                many = np.maximum(behind - place, 1)
                least = (at == LEAST) & key.is_valid().to_numpy(zero_copy_only=False)
                place = place + np.where(least, many - 1, order * many >> 32)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), key, pa.array(order), pa.array(coded, pa.binary())], ["part", "doc_id", "place", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part int, doc_id long, place long, ids binary")


def _shards(shard_tokens: int, width: int, item: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        docs: list[int | None] = []
        part, number, total = -1, 0, 0

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), item)
            blob = WaveletMatrix.build(ids, width).to_bytes()
            lengths = [len(b) // int(item[-1]) for b in held]
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([lengths], pa.list_(pa.int64())), pa.array([blob], pa.binary())],
                [f.name for f in SHARD_SCHEMA],
            )

        for batch in batches:
            for p, d, b in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                if held and (p != part or total >= shard_tokens):
                    yield flush()
                    held, docs, total, number = [], [], 0, number + 1 if p == part else 0
                part = p
                held.append(b)
                docs.append(d)
                total += len(b) // int(item[-1])
        if held:
            yield flush()

    return run


def write_token_shards(docs: DataFrame, path: str, end_id: int = 2, vocabulary: int = 49408, shard_tokens: int = 1 << 20) -> DataFrame:
    """Encode whole texts and write them as wavelet shards in ascending ``doc_id`` order.

    The document order comes from range partitions of ``doc_id``, cut at approximate
    quantiles; each partition is sorted and cut into shards of about ``shard_tokens``
    tokens (a document is never split). An id that several quantiles fall on, as nulls may be,
    fills as many partitions. Returns the written shards, read back.

    Null text counts as empty; null ``doc_id`` sorts first; rows that share a ``doc_id``
    are ordered by the crc32 of their token ids, then by these, so the result is the same
    each time. An empty table gives no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    known = F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LEAST)))
    cut = docs.agg(F.percentile_approx(known, [i / n for i in range(1, n)] or [0.5], max(10_000, 20 * n)).alias("q")).first()["q"]
    small = max(vocabulary, end_id + 1) <= 65536
    width = max(vocabulary - 1, end_id, 1).bit_length()
    encoded = _encoded(docs, path, end_id, 2 if small else 4, sorted(cut or []))
    ordered = encoded.repartitionById(n, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "place", "ids")
    return stage(ordered.mapInArrow(_shards(shard_tokens, width, "<u2" if small else "<u4"), SHARD_SCHEMA), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """Per document from the shards alone: doc_id, start, n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, docs, lengths, blob in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                ids = WaveletMatrix.from_bytes(blob).decode().astype("<u4").tobytes()
                ends = np.cumsum(lengths)
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths, strict=True)]
                m = len(docs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * m, pa.int32()), pa.array([shard] * m, pa.int32()), pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "shard", "doc_id", "local_start", "n_tokens", "ids_crc32"],
                )

    rows = shards.select("part", "shard", "doc_ids", "lengths", "blob").mapInArrow(run, "part int, shard int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    sizes = shards.select("part", "shard", "n_tokens")
    # one row a part: as many as partitions, whatever the input
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("part_start"))
    inner = Window.partitionBy("part").orderBy("shard")
    offsets = sizes.select("part", "shard", (F.sum("n_tokens").over(inner) - F.col("n_tokens")).alias("shard_start")).join(before, "part")
    return rows.join(offsets, ["part", "shard"]).select("doc_id", (F.col("part_start") + F.col("shard_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
