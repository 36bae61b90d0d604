"""Language of a text by compression: the language whose dictionary shortens it most.

For each language a raw-content zstandard dictionary is made of a bounded sample of labelled rows. A text is lowercased,
what isn't a letter becomes one space, and its whole length is compressed in blocks of 2 KB with each dictionary; blocks keep
the dictionary in reach, so a long text's evidence adds up. The smallest sum wins. The margin is the share by which it is
under the second; narrow margins are rejected.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm import units

#: Bounds of the fit: rows of a language, characters of a row, and rows in all. Every language is kept: where there are more
#: than SAMPLE_ALL / SAMPLE_ROWS of them, each gets fewer rows, at least one.
SAMPLE_ROWS, SAMPLE_CHARS, SAMPLE_ALL = 300, 400, 76_800
BLOCK, MIN_MARGIN, UNKNOWN = 2048, 0.005, "und"
OTHER = re.compile(r"[\W\d_]+")


@functools.cache
def numerals() -> re.Pattern:
    """What OTHER leaves of characters that may be no letters: fractions, circled digits and the like, and all beyond the basic
    plane, so that the class is a table look-up."""
    return re.compile("[" + "".join(c for c in map(chr, range(0x10000)) if c.isalnum() and not c.isalpha() and not OTHER.match(c)) + "\U00010000-\U0010ffff]+")


def normal(text: str) -> str:
    letters = OTHER.sub(" ", text.lower())
    if not letters.isascii():
        letters = numerals().sub(lambda m: "".join(c if c.isalpha() else " " for c in m[0]), letters)
    return f" {letters.strip()} "


def fit(docs: DataFrame, train: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, all_rows: int = SAMPLE_ALL) -> dict[str, bytes]:
    """A dictionary's content by language, from rows where `train` holds and text and language aren't null. Of each language
    the rows with the smallest hashes of key and text are taken, at most `rows` of at most `chars` characters; equal rows
    (of null or repeated keys too) tie and any of them may be taken, which gives the same content. Whatever the size of the
    table, at most max(all_rows, one row of each language) reach the driver. Without labelled rows there is no language."""
    labelled = docs.where(train & docs[text].isNotNull() & docs[lang].isNotNull()).select(docs[lang].cast("string").alias("l"), F.xxhash64(docs[key], docs[text]).alias("h"), F.substring(docs[text], 1, chars).alias("t"))
    languages = labelled.agg(F.count_distinct("l")).first()[0]
    if not languages:
        return {}
    place = F.row_number().over(Window.partitionBy("l").orderBy("h", "t"))  # Spark cuts each task's rows before they move
    near = labelled.withColumn("r", place).where(F.col("r") <= max(1, min(rows, all_rows // languages)))
    by: dict[str, list] = {}
    for r in sorted(near.collect(), key=lambda r: (r["l"], r["r"])):
        by.setdefault(r["l"], []).append(normal(r["t"]).strip())
    return {x: " ".join(v).encode() for x, v in sorted(by.items()) if "".join(v)}


@functools.lru_cache(maxsize=2)  # workers stay for later models
def _compressors(model: tuple[tuple[str, bytes], ...]):
    import zstandard as z

    made = []
    for lang, content in model:
        dictionary = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
        how = z.ZstdCompressionParameters(window_log=18, hash_log=16, chain_log=17, search_log=5, min_match=4, target_length=32, strategy=z.STRATEGY_BTLAZY2, write_checksum=False, write_content_size=False, write_dict_id=False)
        dictionary.precompute_compress(compression_params=how)
        made.append((lang, z.ZstdCompressor(compression_params=how, dict_data=dictionary)))
    return made


def classify(text: str | None, model: tuple[tuple[str, bytes], ...]) -> tuple[str, float]:
    """(language, margin of 0 to 1). `und` and 0 for null, for a text without a letter and for a model without languages;
    a tie goes to the first language by name, with margin 0. With one language the margin is 1."""
    data = normal(text).encode() if text else b"  "
    if not data.strip() or not model:
        return UNKNOWN, 0.0
    sizes = sorted((sum(len(c.compress(data[a : a + BLOCK])) for a in range(0, len(data), BLOCK)), lang) for lang, c in _compressors(model))
    return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[1][0] if len(sizes) > 1 else 1.0


def predict(docs: DataFrame, model: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score (the margin) and rejected (no language, or a margin under min_margin) to each row, from its
    whole text alone; letters are what Python's isalpha holds for. keep: the columns to return, all by default; older columns of the new names are replaced."""
    new = ["lang_pred", "score", "rejected"]
    rest = [c for c in (docs.columns if keep is None else keep) if c not in new]
    fixed = docs.sparkSession.sparkContext.broadcast(tuple(sorted(model.items())))  # as large as the sample: SAMPLE_ALL rows of SAMPLE_CHARS characters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in units.pieces(batches, "t"):
            found = [classify(t, fixed.value) for t in b.column("t").to_pylist()]
            langs, scores = [x for x, _ in found], [m for _, m in found]
            yield pa.RecordBatch.from_arrays([b.column("r"), *([b.column("t")] if text in rest else []), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array([x == UNKNOWN or m < min_margin for x, m in found], pa.bool_())], names=names)

    own = [docs[c] for c in rest if c != text] or [F.lit(0).alias("_")]  # the text is moved once
    inner = docs.select(F.struct(*own).alias("r"), docs[text].cast("string").alias("t"))
    names = ["r", *(["t"] if text in rest else []), *new]
    schema = T.StructType([inner.schema["r"], *([inner.schema["t"]] if text in rest else []), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return inner.mapInArrow(run, schema).select(*[F.col("t").alias(c) if c == text else F.col("r").getField(c).alias(c) for c in rest], *new)
