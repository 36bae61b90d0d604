"""Token counts of whole texts by overlapping chunks that are spliced where both encodings must agree.

A chunk is 4,096 characters; a text of at most one chunk has nothing to splice and is counted as it is.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm import units

CHUNK, OVERLAP = 4096, 256


@functools.cache
def boundary() -> re.Pattern:
    """After a settled letter or digit a pretoken ends at punctuation and white space, and before white space it always ends."""
    kinds = "".join(re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: rf"\u{int(m[1], 16):04x}", units.settled(k)) for k in "LN")
    return re.compile(f"(?<=[{kinds}])(?=[{units.MARKS} \\n])|(?<=[{units.MARKS}])(?=[ \\n])")


def spliced_count(text: str, encode, chunk: int, overlap: int) -> int:
    """Tokens of text. encode(part) gives places where tokens of part begin and how many begin from each to the next. A chunk
    begins `overlap` characters before the last one ends; the two are spliced at a place that is a pretoken boundary by the
    characters around it and begins a token in both. Up to there the earlier chunk counts, from there the later. Where no
    such place is found the overlap is doubled; at last the later chunk begins at the last splice, which is a boundary itself."""
    edge = boundary()
    total, splice = 0, 0  # tokens before splice are counted; starts is right from splice on
    end = min(len(text), chunk)
    starts, tokens = encode(text[:end])
    while end < len(text):
        wide = overlap
        while True:
            nxt = max(end - wide, splice)
            last = min(len(text), max(nxt + chunk, end + overlap))
            if nxt == splice:  # nothing of the earlier chunk is kept
                at, last = splice, min(len(text), max(last, end + chunk))
            later, more = encode(text[nxt:last])
            later = later + nxt
            if nxt == splice:
                break
            common = np.intersect1d(starts[np.searchsorted(starts, nxt) :], later[: np.searchsorted(later, end)], assume_unique=False)
            common = common[(common > max(nxt, splice)) & (common <= end - 8)]
            at = next((p for p in common[::-1].tolist() if edge.match(text, p)), None)
            if at is not None:
                break
            wide *= 2
        total += int(tokens[(starts >= splice) & (starts < at)].sum())
        splice, starts, tokens, end = at, later, more, last
    return total + int(tokens[starts >= splice].sum())


def token_counts(docs: DataFrame, vocabulary: str, text: str = "text", out: str = "n_tokens", chunk: int = CHUNK, overlap: int = OVERLAP, keep: list[str] | None = None) -> DataFrame:
    """docs with a long column `out`: the tokens of the whole text by a byte-level .json vocabulary, as the tokenizers
    library counts them with its defaults and without added special tokens. Texts of more than `chunk` characters are
    encoded in overlapping chunks. Null and empty texts have 0 tokens; other columns stay as they are, also when one of
    them has the name of an internal column; an older column `out` is replaced. keep: the columns to return, all by default."""
    rest = [c for c in (docs.columns if keep is None else keep) if c != out]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = units.encoder(vocabulary)
        for b in units.pieces(batches, "t"):
            texts = b.column("t")
            long = np.nan_to_num(pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(float)) > chunk
            short = units.blanked(texts, long)
            _, ends = enc.batch(short)
            n = np.diff(ends)
            for k in np.flatnonzero(long).tolist():
                n[k] = spliced_count(texts[k].as_py(), enc.starts, chunk, overlap)
            yield pa.RecordBatch.from_arrays([b.column("r"), pa.array(n, pa.int64())], names=["r", "n"])

    inner = docs.select(F.struct(*[docs[c] for c in rest]).alias("r"), docs[text].alias("t"))
    made = inner.mapInArrow(count, T.StructType([inner.schema["r"], T.StructField("n", T.LongType())]))
    return made.select("r.*", F.col("n").alias(out))
