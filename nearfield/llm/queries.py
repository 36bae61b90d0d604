"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm.storage import Scratch, bounded_batches, stored


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import packing

    with bounded_batches(spark):
        return packing.pack(packing.token_pieces(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json")))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import langid

    docs = _docs(spark, sf_dir)
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    with bounded_batches(spark):
        found = langid.predict(docs, langid.fit(docs, ~held_out), keep=["doc_id"])
        return stored(found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"), "languages")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import sharding

    return sharding.shard(_docs(spark, sf_dir))


#: The setting that holds the secret key of pseudonyms, and the key of trials without one, which anybody can know.
PSEUDONYM_KEY, TRIAL_KEY = "spark.nearfield.pseudonymKey", "replace-me"


def pseudonym_key(spark: SparkSession) -> str:
    """The session's key. Where none is set, the trial key, with a warning: such pseudonyms can be undone."""
    key = spark.conf.get(PSEUDONYM_KEY, None)
    if not key:
        warnings.warn(f"{PSEUDONYM_KEY} isn't set: pseudonyms are made with a public key", stacklevel=2)
    return key or TRIAL_KEY


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import pii

    return pii.pseudonymise(_docs(spark, sf_dir), pseudonym_key(spark), count="n_replaced")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import byte_bpe

    with bounded_batches(spark):
        return stored(byte_bpe.encode_texts(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.tiktoken")), "encoded")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import exact_dedup

    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import token_count

    docs = _docs(spark, sf_dir).select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    with bounded_batches(spark):
        counted = token_count.token_counts(docs, vocabulary("byte_bpe_50k.json"), keep=["doc_id", "n_bytes"])
        return stored(counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit")), "counted")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import exact_topk

    return exact_topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import token_blocks

    with bounded_batches(spark), Scratch(spark) as tables:
        segments = token_blocks.write_tokens(_docs(spark, sf_dir), vocabulary("byte_bpe_50k.json"))
        read = tables.stored(token_blocks.read_documents(segments).withColumnRenamed("key", "doc_id"), "read-back")
        tables.keep(read)
        return read


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nearfield.llm import near_dedup

    with bounded_batches(spark):
        return near_dedup.near_duplicates(_docs(spark, sf_dir))


def queries() -> dict:
    return {f.__name__: f for f in (op1_best_fit_packing, op2_language_id, op3_sharding, op4_pii, op5_byte_bpe, op6_exact_dedup, op7_token_counts, op8_exact_topk, op9_token_blocks, op10_near_dedup)}


OP6_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP8_SQL = """
WITH good AS (
  SELECT vec_id, list_transform(embedding, lambda v: floor(256 * v::double)::bigint) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0)))::bigint AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
ranked AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::int AS rank, vec_id, score FROM pairs)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_exact_dedup": OP6_SQL, "op8_exact_topk": OP8_SQL}
