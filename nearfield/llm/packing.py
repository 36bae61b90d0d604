"""Best-fit packing of token pieces into sequences by exact complements.

Lengths alone decide a packing, and there are at most `capacity` of them, so the plan is made on a histogram and is
never larger than that, however many documents there are. Sums of one, two and three lengths are looked up for the gap
that the largest piece leaves; a combination that fills it exactly is used as often as its counts allow. Where none does,
the largest length that fits goes in (best fit) and the rest of the gap is looked up again. Each use ends at least one
length's count, so there are at most `capacity` patterns. Pieces are then numbered inside their length (split by a hash, so
that no task sees a whole length) and an interval table sends the numbers of each length to sequence and offset. It has a row
for each distinct length of each pattern: lengths that differ and sum to 4,096 are at most 90, so whatever the corpus, the
table that is broadcast has at most 4,096 x 90 rows.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm import units
from nearfield.llm.ranks import grouped_ranks
from nearfield.llm.storage import stored

CAPACITY = 4096


class Complements:
    """Which lengths are left, and the exact fillings of a gap by one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.left = counts.astype(np.int64).copy()  # by length; index 0 is unused
        self.left[0] = 0

    def _pair(self, gap: int, most: int, used: dict[int, int]) -> tuple[int, int] | None:
        """The pair with the largest member that is at most `most`."""
        a = np.arange(min(gap - 1, most), (gap + 1) // 2 - 1, -1)
        if not len(a):
            return None
        have = self.left.copy() if used else self.left
        for k, v in used.items():
            have[k] -= v
        ok = (have[a] > 0) & (have[gap - a] > 0) & ((2 * a != gap) | (have[a] > 1))
        hit = int(ok.argmax())
        return (int(a[hit]), gap - int(a[hit])) if ok[hit] else None

    def fill(self, gap: int, used: dict[int, int]) -> list[int] | None:
        """used: how often lengths are in the sequence already."""
        if gap < len(self.left) and self.left[gap] > used.get(gap, 0):
            return [gap]
        if pair := self._pair(gap, len(self.left) - 1, used):
            return [*pair]
        there = np.flatnonzero(self.left[: min(gap, len(self.left))])
        for a in there[::-1].tolist():
            if 3 * a < gap:
                break
            if self.left[a] > used.get(a, 0) and gap - a >= 2 and (pair := self._pair(gap - a, a, used | {a: used.get(a, 0) + 1})):
                return [a, *pair]
        return None

    def best_fit(self, gap: int, used: dict[int, int]) -> int | None:
        there = [k for k in np.flatnonzero(self.left[: gap + 1])[::-1][: 1 + len(used)].tolist() if self.left[k] > used.get(k, 0)]
        return there[0] if there else None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a sequence, how many sequences) that hold every piece once."""
    table = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        table[length] += n
    state, out, top = Complements(table), [], capacity
    while True:
        while top and not state.left[top]:
            top -= 1
        if not top:
            return out
        pattern, used, gap = [top], {top: 1}, capacity - top
        while gap:
            more = state.fill(gap, used)
            if more is None:
                fit = state.best_fit(gap, used)
                if fit is None:
                    break
                more = [fit]
            for k in more:
                pattern.append(k)
                used[k] = used.get(k, 0) + 1
                gap -= k
        n = min(int(state.left[k]) // v for k, v in used.items())
        for k, v in used.items():
            state.left[k] -= n * v
        out.append((pattern, n))


def intervals(patterns: list[tuple[list[int], int]]) -> dict[int, list[tuple[int, int, int, int]]]:
    """By length, in the order of the pieces' numbers: (first number, first sequence, offset in it, pieces side by side in
    each sequence)."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    at: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        offset = 0
        for k in sorted(set(pattern), reverse=True):
            times = pattern.count(k)
            out.setdefault(k, []).append((at.get(k, 0), sequence, offset, times))
            at[k] = at.get(k, 0) + n * times
            offset += k * times
        sequence += n
    return out


def token_pieces(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every whole text's ids (null: none) and end_id, cut only where they are
    more than `capacity`."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = units.encoder(vocabulary)
        for b in units.pieces(batches, "t"):
            ids, ends = enc.batch(b.column("t"))
            full = memoryview(np.insert(ids, ends[1:], end_id).astype("<u4").tobytes())
            begin = ends[:-1] + np.arange(b.num_rows)
            n = np.diff(ends) + 1
            per = -(-n // capacity)
            doc = np.repeat(np.arange(b.num_rows), per)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            start = piece * capacity
            length = np.minimum(capacity, n[doc] - start)
            first = (begin[doc] + start).tolist()
            crc = [zlib.crc32(full[4 * a : 4 * (a + z)]) for a, z in zip(first, length.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("k").take(pa.array(doc)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return docs.select(docs[key].cast("long").alias("k"), docs[text].alias("t")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, with an integer `length` of 1 to capacity, and doc_id and piece to name a row) with
    sequence_id and offset; older columns of these two names are replaced, and no other name clashes. Ties are broken by
    doc_id and piece; repeated rows get places of their own; an empty table stays empty. The histogram on the driver has at
    most `capacity` rows."""
    spark = pieces.sparkSession
    row, rank = f"row-{uuid.uuid4().hex}", f"rank-{uuid.uuid4().hex}"
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    kept = stored(pieces.select(*[F.col(f"`{c}`") for c in names]).withColumn(row, F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in kept.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = intervals(plan(counts, capacity))
    numbered = grouped_ranks(kept, ["length"], ["doc_id", "piece", row], rank)
    table = spark.sparkContext.broadcast({k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in places.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = table.value
        for b in batches:
            lengths, ranks = (b.column(c).to_numpy().astype(np.int64) for c in ("length", rank))
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for length in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == length)
                first, sequence, offset, times = by[length]
                k = np.searchsorted(first, ranks[mine], "right") - 1
                nth = ranks[mine] - first[k]
                seq[mine], off[mine] = sequence[k] + nth // times[k], offset[k] + nth % times[k] * length
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = T.StructType([*[kept.schema[c] for c in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return numbered.select(*[F.col(f"`{c}`") for c in names], rank).mapInArrow(place, schema)
