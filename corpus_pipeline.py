"""A corpus, stage by stage: language, exact copies, near copies, personal data, packing."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import exact_dedup, langid, near_dedup, packing, pii
from nearfield.llm.queries import pseudonym_key, vocabulary
from nearfield.llm.storage import Scratch, bounded_batches, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; the model is fitted on the labelled rows of what it gets. A corpus without labels
    stays whole, as nothing can be told of it."""
    with bounded_batches(spark):
        model = langid.fit(docs, F.lit(True))
        return stored(langid.predict(docs, model).where("NOT rejected").select(*docs.columns), "told") if model else docs


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: that with the largest id (null is the smallest), and of such rows one."""
    with Scratch(spark) as tables:
        rows, file, place = _named(docs, tables)
        found = exact_dedup.exact_duplicates(rows.select(F.struct("doc_id", file, place).alias("k"), "text"), key="k")
        return _without(docs, rows, file, place, found.where("NOT kept").select(F.col("k")[file].alias("f"), F.col("k")[place].alias("p")), tables)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one row stays: that with the smallest id (null comes last), and of such rows one."""
    with bounded_batches(spark), Scratch(spark) as tables:
        rows, file, place = _named(docs, tables)
        name = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", file, place)
        classed = near_dedup.word_classes(rows.select(name.alias("k"), "text"), "k", "text", tables)
        firsts = classed.groupBy("label").agg(F.min("id").alias("first")).withColumnRenamed("label", "l")
        others = classed.join(firsts, F.col("label") == F.col("l")).where(F.col("id") != F.col("first"))
        return _without(docs, rows, file, place, others.select(F.col("id")[file].alias("f"), F.col("id")[place].alias("p")), tables)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows."""
    out = pii.pseudonymise(docs, pseudonym_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed."""
    with bounded_batches(spark):
        return packing.pack(packing.token_pieces(docs, vocabulary("word_bpe_49k.json")))


def _named(docs: DataFrame, tables: Scratch) -> tuple[DataFrame, str, str]:
    """docs with two columns that name each row, whatever its id: its file and its place there. Rows that aren't read from
    files are written first."""
    file, place = f"file-{uuid.uuid4().hex}", f"place-{uuid.uuid4().hex}"
    metadata: tuple[Column, Column] = F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place)
    try:
        return docs.select("*", *metadata), file, place
    except AnalysisException:
        written = tables.stored(docs, "rows")
        tables.keep(written)
        return written.select("*", *metadata), file, place


def _without(docs: DataFrame, rows: DataFrame, file: str, place: str, found: DataFrame, tables: Scratch) -> DataFrame:
    """docs without the rows that `found` (f, p) names."""
    dropped = tables.stored(found, "dropped")
    tables.keep(dropped)
    return rows.join(dropped, (F.col(file) == F.col("f")) & (F.col(place) == F.col("p")), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


STAGES = [("language", language), ("exact_copies", exact_copies), ("near_copies", near_copies), ("private_data", private_data), ("packing", packing_stage)]
#: Compression, sketches and the packing plan are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Scratch(spark) as held:
        for name, stage in STAGES[:-1]:
            with Scratch(spark) as tables:
                after = tables.stored(stage(spark, docs, sf_dir), f"stage-{name}")
                tables.keep(after)
            held.drop(docs)
            docs = after
        held.keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
