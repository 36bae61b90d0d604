"""Exact duplicates by chunk recipes, in DataFrame functions only.

A text is cut where its content says so: after at least 1024 characters at the next line or sentence end, and after 8192
at the latest. Equal texts have equal chunks, and texts that share passages share most of their chunks. A chunk's
identifier is its xxhash64, verified on all documents: if any identifier stands for chunks of different SHA-256 or length,
all are named by their SHA-256 instead. A text's recipe is the list of its identifiers; recipes, not texts, are moved and
compared. Texts are read twice and never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.storage import stored

CHUNK = r"(?s).{1024,8192}?(?:\n|[.!?]\s|\z)|.{1,8192}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def ambiguous(texts: DataFrame, text: str) -> bool:
    """Whether an identifier stands for more than one chunk; of n different chunks about n^2 / 2^65 do."""
    seen = texts.select(F.explode(chunks(F.col(text))).alias("c")).select(F.xxhash64("c").alias("h"), F.unhex(F.sha2("c", 256)).alias("s"), F.octet_length("c").alias("n"))
    different = seen.groupBy("h", "s", "n").agg(F.count(F.lit(1)).alias("times"))
    return not different.groupBy("h").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").isEmpty()


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key (of any type that has an order), keep_id (the largest key of equal texts), group_size, kept, text_sha256 of each row. Null counts as the empty
    text, which equals itself. Rows that repeat key and text are one document: they are kept or dropped alike. Null keys
    are the smallest; in a group that has no other, they stay. An empty table gives no rows; other columns aren't read."""
    whole = docs.select(docs[key].alias("k"), F.coalesce(docs[text], F.lit("")).alias("t"))
    name = (lambda c: F.unhex(F.sha2(c, 256))) if ambiguous(whole, "t") else (lambda c: F.xxhash64(c))
    recipe = F.transform(chunks(F.col("t")), name)
    rows = stored(whole.select("k", F.sha2("t", 256).alias("text_sha256"), recipe.alias("recipe")), "recipes")
    groups = stored(rows.groupBy("recipe").agg(F.max("k").alias("keep"), F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("recipe", "of"), "recipe-groups")
    # Both sides are read from storage, so a group of any size is a skewed join, whose partitions Spark splits.
    both = rows.join(groups, F.col("recipe") == F.col("of"), "left")
    return both.select(
        F.col("k").alias(key),
        F.when(F.col("n").isNull(), F.col("k")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.when(F.col("n").isNull(), F.lit(True)).otherwise(F.col("k").eqNullSafe(F.col("keep"))).alias("kept"),
        "text_sha256",
    )
