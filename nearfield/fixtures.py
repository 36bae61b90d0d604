"""The driver's tables as items, tags, attributes and queries, in Spark and as the same common table expressions in SQL."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions import quantised

K = 10


@dataclass
class Tables:
    items: DataFrame
    tags: DataFrame
    attrs: DataFrame
    rows: DataFrame
    queries: DataFrame


def load(spark: SparkSession, sf_dir: str, scale: int | None = None) -> Tables:
    """scale: integer vectors floor(scale * x), which are exact and have ties. Queries are the rows whose id is divisible by
    50. Intervals come from the id, so a query whose own attribute is null or NaN has them too; such rows match no interval."""
    raw = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    i = F.col("vec_id")
    items = raw.select(i.alias("id"), (quantised("embedding", scale) if scale else F.col("embedding")).alias("vec"), F.col("label").cast("long").alias("label"))
    tag = F.array(F.col("label").cast("long"), 100 + i % 7, 200 + i % 3, 300 + F.when(F.get("embedding", F.lit(0)) > 0, 1).otherwise(0))
    tags = raw.select(i.alias("id"), F.explode(tag).alias("tag"))
    ok = i % 97 != 0
    attrs = raw.select(i.alias("id"), F.when(ok, (F.get("embedding", F.lit(0)).cast("double") + 1) / 2).alias("similarity"), F.when(ok, F.when(i % 89 == 0, F.lit(float("nan"))).otherwise((1 + (i * 37) % 1000).cast("double"))).alias("width"))
    attr = (i * 37) % 5000
    rows = raw.select(i.alias("id"), F.col("label").cast("long").alias("a"), (i % 4).alias("b"), ((i * 37) % 16).alias("bin"), attr.alias("attr"), F.floor(attr / 25).cast("long").alias("block"))
    w = 1 + (i * 37) % 1000
    queries = raw.where(i % 50 == 0).select(
        i.alias("qid"), (quantised("embedding", scale) if scale else F.col("embedding")).alias("qvec"), F.col("label").cast("long").alias("tag1"), (200 + i % 3).alias("tag2"), (100 + i % 7).alias("tag3"),
        (w - 250).cast("double").alias("lo1"), (w + 250).cast("double").alias("hi1"), (w - 100).cast("double").alias("lo2"), (w + 100).cast("double").alias("hi2"),
        F.greatest(attr - 333, F.lit(0)).cast("long").alias("a1"), F.least(attr + 333, F.lit(4999)).cast("long").alias("z1"), F.pmod(attr + 1700, F.lit(4000)).cast("long").alias("a2"), (F.pmod(attr + 1700, F.lit(4000)) + 180).cast("long").alias("z2"))
    return Tables(items, tags, attrs, rows, queries)


def prelude(scale: int | None = None) -> str:
    vec = f"list_transform(embedding, lambda x: floor(x::double * {scale})::bigint)" if scale else "embedding"
    return f"""
WITH items AS (SELECT vec_id AS id, {vec} AS vec, label::bigint AS label, embedding[1] AS x0 FROM embeddings),
tags AS (SELECT id, label AS tag FROM items UNION ALL SELECT id, 100 + id % 7 FROM items UNION ALL SELECT id, 200 + id % 3 FROM items
  UNION ALL SELECT id, 300 + (CASE WHEN x0 > 0 THEN 1 ELSE 0 END) FROM items),
attrs AS (SELECT id, CASE WHEN id % 97 <> 0 THEN (x0::double + 1) / 2 END AS similarity,
  CASE WHEN id % 97 = 0 THEN NULL WHEN id % 89 = 0 THEN 'nan'::double ELSE (1 + (id * 37) % 1000)::double END AS width FROM items),
rws AS (SELECT id, label AS a, id % 4 AS b, (id * 37) % 16 AS bin, (id * 37) % 5000 AS attr, ((id * 37) % 5000) // 25 AS block FROM items),
qs AS (SELECT id AS qid, vec AS qvec, label AS tag1, 200 + id % 3 AS tag2, 100 + id % 7 AS tag3,
  (1 + (id * 37) % 1000 - 250)::double AS lo1, (1 + (id * 37) % 1000 + 250)::double AS hi1, (1 + (id * 37) % 1000 - 100)::double AS lo2, (1 + (id * 37) % 1000 + 100)::double AS hi2,
  greatest((id * 37) % 5000 - 333, 0)::bigint AS a1, least((id * 37) % 5000 + 333, 4999)::bigint AS z1, (((id * 37) % 5000 + 1700) % 4000)::bigint AS a2, (((id * 37) % 5000 + 1700) % 4000 + 180)::bigint AS z2
  FROM items WHERE id % 50 = 0)"""


L2 = "list_sum(list_transform(list_zip(i.vec, q.qvec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
L2_INT = "list_sum(list_transform(list_zip(i.vec, q.qvec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint"


def top_sql(support: str, k: int = K, distance: str = L2, scale: int | None = None, tail: str = "SELECT qid, rank, id, dist FROM ranked WHERE rank <= {k}") -> str:
    return f"""{prelude(scale)},
support AS ({support}),
scored AS (SELECT s.qid, s.id, {distance} AS dist FROM support s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid),
ranked AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, id))::int AS rank, id, dist FROM scored)
{tail.format(k=k)}"""
