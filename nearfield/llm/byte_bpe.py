"""Byte-level BPE as a tree reduction: a text's halves are encoded apart and joined where they meet.

Encodings with this join form a monoid. A node is the ids of a stretch of text as if it stood alone. Joining two
neighbours re-encodes a window around the cut that grows until both its edges are proven pretoken boundaries of the
whole text; ids outside the window are then those of the whole. A place is a proven boundary by the two characters
around it alone: no pretoken goes on after a letter or digit with another kind of character, nor from a character that
isn't white space into white space; only characters are used on whose kind all engines' tables agree. Inside a pretoken without such a place (a long run of letters) the window grows over
tokens instead, and stops when each token pair at its edges is what BPE makes of the two tokens' bytes: a row of
tokens all of whose neighbours are such pairs is the encoding of their bytes.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm import units

#: A leaf's characters, the first reach of a window, and the longest pretoken that is joined by re-encoding it whole.
LEAF, WINDOW, RUN = 512, 32, 4096


@functools.cache
def edge() -> regex.Pattern:
    """Proven boundaries: what ends (a letter, a digit, punctuation) and what begins are of settled and different kinds."""
    letter, digit = (regex.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", units.settled(k)) for k in "LN")
    mark, white = units.MARKS, r" \t\n\r"
    return regex.compile(f"(?<=[{letter}])(?=[{digit}{mark}{white}])|(?<=[{digit}])(?=[{letter}{mark}{white}])|(?<=[{mark}])(?=[{digit}{white}])")


class TreeBPE:
    def __init__(self, path: str, leaf: int = LEAF, run: int = RUN):
        enc = units.byte_encoding(path)
        self.whole, self.piece, self.leaf, self.run = enc._core_bpe.encode_ordinary, enc._core_bpe.encode_single_piece, leaf, run
        self.bytes_of = {i: b for b, i in units.byte_ranks(path).items()}
        self.one_match, self.edge = regex.compile(enc._pat_str).fullmatch, edge()

    def encode(self, text: str) -> list[int]:
        return self._node(text, 0, len(text))

    def _node(self, text: str, a: int, z: int) -> list[int]:
        if z - a <= self.leaf:
            return self.whole(text[a:z])
        mid = (a + z) // 2
        return self._join(text, a, mid, z, self._node(text, a, mid), self._node(text, mid, z))

    def _join(self, text: str, a: int, cut: int, z: int, left: list[int], right: list[int]) -> list[int]:
        reach = WINDOW
        while True:  # the last proven boundary before the cut, the first after it
            low, high = max(a, cut - reach), min(z, cut + reach)
            p = max((m.start() for m in self.edge.finditer(text, low, cut + 1) if m.start() < cut and m.start() > low), default=a if low == a else None)
            m = self.edge.search(text, cut + 1, high)
            q = m.start() if m else z if high == z else None
            if p is not None and q is not None:
                break
            reach *= 4
        drop, n_left = len(text[p:cut].encode()), len(left)
        while drop > 0:
            n_left -= 1
            drop -= len(self.bytes_of[left[n_left]])
        drop, n_right = len(text[cut:q].encode()), 0
        while drop > 0:
            drop -= len(self.bytes_of[right[n_right]])
            n_right += 1
        if q - p > self.run and self.one_match(text, p, q) and self.one_match(text, p, cut) and self.one_match(text, cut, q):
            inner = self._join_run(left[n_left:], right[:n_right])
        else:
            inner = self.whole(text[p:q])
        return left[:n_left] + inner + right[n_right:]

    def _pair(self, x: int, y: int) -> bool:
        return self.piece(self.bytes_of[x] + self.bytes_of[y]) == [x, y]

    def _join_run(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of one pretoken from the encodings of its two parts."""
        k = 1
        while True:
            i, j = max(0, len(left) - k), min(len(right), k)
            mid = self.piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or self._pair(left[i - 1], mid[0])) and (j == len(right) or self._pair(mid[-1], right[j])):
                return left[:i] + mid + right[j:]
            k *= 2

    def decode(self, ids: list[int]) -> bytes:
        """Up the same tree: halves are decoded apart and put together."""
        if len(ids) <= self.leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def encode_texts(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text", ids: bool = False, leaf: int = LEAF) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 of each whole text (null: empty, which has no ids), and the ids
    themselves if asked for. Repeated keys give a row each; other columns aren't read."""
    fields = [T.StructField("k", docs.schema[key].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if ids:
        fields.append(T.StructField("ids", T.ArrayType(T.LongType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = TreeBPE(ranks, leaf)
        for b in units.pieces(batches, "t"):
            rows: dict[str, list] = {"n": [], "i": [], "d": [], "ids": []}
            for t in b.column("t").to_pylist():
                got = bpe.encode(t or "")
                rows["n"].append(len(got))
                rows["i"].append(hashlib.sha256(" ".join(map(str, got)).encode()).hexdigest())
                rows["d"].append(hashlib.sha256(bpe.decode(got)).hexdigest())
                if ids:
                    rows["ids"].append(got)
            out = [b.column("k"), pa.array(rows["n"], pa.int64()), pa.array(rows["i"], pa.string()), pa.array(rows["d"], pa.string())]
            if ids:
                out.append(pa.array(rows["ids"], pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.select(docs[key].alias("k"), docs[text].alias("t")).mapInArrow(run, T.StructType(fields)).withColumnRenamed("k", key)
