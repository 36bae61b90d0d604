"""Token ids in files of patched frame-of-reference blocks.

A segment file holds whole documents. Its ids are cut into blocks of 1024 (the last is filled up with its last id).
Of each block the minimum is subtracted; the bit width is that of the block's 90th percentile; the low bits are packed
by that width and what is larger has its place and high bits in an exception list. An index holds where each block's
words and exceptions start, so any id range is read from its own blocks.

Layout, all little-endian: magic, counts (documents, ids, blocks, words, exceptions) as u64; per document its id i64 and
its number of ids u64; per block minimum u32, width u8, word start u64, exception start u64; words u32; per exception
its place in its block u16 and its high bits u32. Segments are rows of a Parquet table, so that Spark's commit protocol
guards them against lost and repeated tasks on any store.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm import units
from nearfield.llm.storage import stored

MAGIC, BLOCK, PERCENTILE, LANES = b"PFR1", 1024, 90, 32


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """values: blocks x 1024, each under 2**width. Words: blocks x (32 * width); lane j of row i lies at bit i * width."""
    rows = values.reshape(len(values), 32, LANES)
    out = np.zeros((len(values), width, LANES), np.uint32)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        out[:, word] |= rows[:, i] << np.uint32(bit)
        if bit + width > 32:
            out[:, word + 1] |= rows[:, i] >> np.uint32(32 - bit)
    return out.reshape(len(values), width * LANES)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    at = words.reshape(len(words), width, LANES)
    out = np.zeros((len(words), 32, LANES), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for i in range(32 if width else 0):
        word, bit = divmod(i * width, 32)
        v = at[:, word] >> np.uint32(bit)
        if bit + width > 32:
            v = v | (at[:, word + 1] << np.uint32(32 - bit))
        out[:, i] = v & mask
    return out.reshape(len(words), BLOCK)


def write_segment(keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    """The file of some documents, their ids one after the other."""
    blocks = -(-len(ids) // BLOCK)
    full = np.concatenate([ids, np.full(blocks * BLOCK - len(ids), ids[-1] if len(ids) else 0, "<u4")]).astype(np.uint32).reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.empty(0, np.uint32)
    rest = full - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    common = np.partition(rest, at, axis=1)[:, at] if blocks else low
    width = np.frexp(common.astype(np.float64))[1].astype(np.uint8)
    word_n = width.astype(np.int64) * LANES
    word_at = np.cumsum(word_n) - word_n
    words = np.zeros(int(word_n.sum()), np.uint32)
    mask = ((np.uint64(1) << width.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        packed = _pack(rest[rows] & mask[rows, None], w)
        words[(word_at[rows][:, None] + np.arange(w * LANES)).ravel()] = packed.ravel()
    b, place = np.nonzero(rest > mask[:, None])
    high = (rest[b, place].astype(np.uint64) >> width[b].astype(np.uint64)).astype("<u4")
    exc_at = np.searchsorted(b, np.arange(blocks))
    head = MAGIC + struct.pack("<5Q", len(keys), len(ids), blocks, len(words), len(b))
    parts = [keys.astype("<i8"), counts.astype("<u8"), low.astype("<u4"), width, word_at.astype("<u8"), exc_at.astype("<u8"), words.astype("<u4"), place.astype("<u2"), high]
    return head + b"".join(x.tobytes() for x in parts)


class Segment:
    """Reads a file; ids(a, z) touches only the blocks that hold ids a to z."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token block file")
        docs, self.n, blocks, n_words, n_exc = struct.unpack_from("<5Q", data, 4)
        at = 4 + 40

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, n, at)
            at += got.nbytes
            return got

        self.keys, self.counts = take("<i8", docs), take("<u8", docs).astype(np.int64)
        self.low, self.width = take("<u4", blocks), take("u1", blocks)
        self.word_at, self.exc_at = take("<u8", blocks).astype(np.int64), np.append(take("<u8", blocks).astype(np.int64), n_exc)
        self.words, self.place, self.high = take("<u4", n_words), take("<u2", n_exc), take("<u4", n_exc)

    def ids(self, a: int = 0, z: int | None = None) -> np.ndarray:
        z = self.n if z is None else min(z, self.n)
        if z <= a:
            return np.empty(0, "<u4")
        first, last = a // BLOCK, -(-z // BLOCK)
        width, out = self.width[first:last], np.zeros((last - first, BLOCK), np.uint32)
        for w in np.unique(width).tolist():
            rows = np.flatnonzero(width == w)
            at = self.word_at[first + rows][:, None] + np.arange(w * LANES)
            out[rows] = _unpack(self.words[at.ravel()].reshape(len(rows), w * LANES), w)
        e0, e1 = self.exc_at[first], self.exc_at[last]
        b = np.repeat(np.arange(last - first), np.diff(self.exc_at[first : last + 1]))
        out[b, self.place[e0:e1]] |= self.high[e0:e1] << width[b].astype(np.uint32)
        out += self.low[first:last, None]
        return out.reshape(-1)[a - first * BLOCK : z - first * BLOCK].astype("<u4")


def write_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 0, segment_ids: int = 1 << 20) -> DataFrame:
    """The segment table (part, seq, n_ids, blob) of all texts' ids, each closed by end_id, in ascending key order: parts
    are key ranges. Texts are moved, not ids, which take more room. A segment closes at segment_ids ids; a longer
    document has its own. Null texts count as empty, null keys and repeated keys are kept as rows of their own (null first,
    written as -2**63); an empty table gives no segments."""
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = docs.select(F.coalesce(docs[key].cast("long"), F.lit(-(2**63))).alias("k"), docs[text].alias("t")).repartitionByRange(n, "k").sortWithinPartitions("k").withColumn("part", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = units.encoder(vocabulary)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        part, seq = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal seq
            keys, counts, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            seq += 1
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "blob": pa.array([write_segment(keys, counts, ids)], pa.binary())})

        for b in units.pieces(batches, "t"):
            if not b.num_rows:
                continue
            part = b.column("part")[0].as_py()
            ids, ends = enc.batch(b.column("t"))
            full = np.insert(ids, ends[1:], end_id)
            held.append((b.column("k").to_numpy(zero_copy_only=False), np.diff(ends) + 1, full))
            if sum(len(x[2]) for x in held) >= segment_ids:
                yield close()
        if held:
            yield close()

    return stored(ranged.mapInArrow(write, "part int, seq int, n_ids long, blob binary"), "token-blocks")


def read_documents(segments: DataFrame, crc: bool = True) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 of each document of a segment table."""
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))  # as many rows as there were key ranges
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("part_at"))
    inner = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    order = segments.select(F.col("part").alias("p2"), F.col("seq").alias("s2"), F.coalesce(F.sum("n_ids").over(inner.partitionBy("part")), F.lit(0).cast("long")).alias("seq_at"))
    places = order.join(parts, F.col("p2") == F.col("p")).select("p2", "s2", (F.col("part_at") + F.col("seq_at")).alias("at"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                s = Segment(b.column("blob")[k].as_py())
                ends = np.cumsum(s.counts)
                ids = memoryview(s.ids().tobytes())
                sums = [zlib.crc32(ids[4 * (z - c) : 4 * z]) for z, c in zip(ends.tolist(), s.counts.tolist())]
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(len(ends), b.column("part")[k].as_py()), pa.int32()), "seq": pa.array(np.full(len(ends), b.column("seq")[k].as_py()), pa.int32()), "key": pa.array(s.keys.astype(np.int64), pa.int64()), "inner": pa.array(ends - s.counts, pa.int64()), "n_tokens": pa.array(s.counts, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    rows = segments.select("part", "seq", "blob").mapInArrow(read, "part int, seq int, key long, inner long, n_tokens long, ids_crc32 long")
    return rows.join(places, (F.col("part") == F.col("p2")) & (F.col("seq") == F.col("s2"))).select("key", (F.col("at") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")
