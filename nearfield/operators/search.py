"""Supports, top-K and what checks them. Ids are filtered and deduplicated first; vectors are joined last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions import l2, within


def equality(queries: DataFrame, tags: DataFrame, tag: str = "tag1") -> DataFrame:
    return queries.join(tags, F.col(tag) == F.col("tag")).select("qid", "id")


def conjunction(queries: DataFrame, tags: DataFrame, a: str = "tag1", b: str = "tag2") -> DataFrame:
    second = equality(queries, tags, b)
    return equality(queries, tags, a).join(second, ["qid", "id"], "left_semi")


def ranged(queries: DataFrame, tags: DataFrame, attrs: DataFrame, attr: str, lo: str, hi: str, tag: str = "tag1", bounds: str = "[)", domain: Column | None = None) -> DataFrame:
    """Rows of a tag whose attribute is in the query's interval. Ranges over all rows go by blocks (layouts.block_support),
    so that they are equi-joins too."""
    test = within(F.col(attr), F.col(lo), F.col(hi), bounds)
    test = test if domain is None else test & domain
    return queries.join(tags, F.col(tag) == F.col("tag")).join(attrs, "id").where(test).select("qid", "id")


def clause_tests(queries: DataFrame, tags: DataFrame, attrs: DataFrame, attr: str, tag: str, lo: str, hi: str, k: int) -> DataFrame:
    """qid, id, k, ok: every row of the clause's posting and whether its attribute is in the clause's interval."""
    met = queries.join(tags, F.col(tag) == F.col("tag")).join(attrs, "id")
    return met.select("qid", "id", F.lit(k).alias("k"), F.coalesce(within(F.col(attr), F.col(lo), F.col(hi)), F.lit(False)).alias("ok"))


def any_of(*branches: DataFrame) -> DataFrame:
    """Disjunction: a row that several branches admit is admitted once."""
    out = branches[0]
    for b in branches[1:]:
        out = out.union(b)
    return out.dropDuplicates(["qid", "id"])


def without(support: DataFrame, excluded: DataFrame) -> DataFrame:
    return support.join(excluded, ["qid", "id"], "left_anti")


def without_self(support: DataFrame) -> DataFrame:
    return support.where(F.col("id") != F.col("qid"))


def top(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int = 10, distance=l2) -> DataFrame:
    """qid, rank, id, dist: the first k of each query's support by (distance, id); fewer where the support is smaller."""
    scored = support.join(items.select("id", "vec"), "id").join(query_vectors.select("qid", "qvec"), "qid")
    return first(scored.select("qid", "id", distance("vec", "qvec").alias("dist")), k)


def packed_top(queries: DataFrame, tags: DataFrame, items: DataFrame, k: int, tag: str = "tag1", also: str | None = None, blocks: int | None = None, distance=l2) -> DataFrame:
    """top() of the rows with a query's tag (and another one, if `also` names its column), without the query's own row, for
    batches whose pairs of query and row are too many to move. Each row is dealt with its vector and its tags into a block
    of each of its tags; queries go to every block of their tag, and pairs arise only there. A block's first k are merged.
    What moves is rows x tags and queries x blocks, whatever a hot tag's posting holds."""
    n = blocks or max(8, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    own = tags.groupBy("id").agg(F.array_sort(F.collect_list("tag")).alias("tags"))  # a row's own tags
    rows = items.select("id", "vec").join(own, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    packs = rows.select("block", F.explode("tags").alias("tag"), "id", "vec", *(["tags"] if also else []))
    asked = queries.select("qid", "qvec", F.col(tag).alias("tag"), *([F.col(also).alias("also")] if also else []), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("block"))
    met = asked.join(packs, ["tag", "block"]).where(F.col("id") != F.col("qid"))
    if also:
        met = met.where(F.array_contains("tags", F.col("also")))
    near = met.select("qid", "block", "id", distance("vec", "qvec").alias("dist"))
    local = near.withColumn("r", F.row_number().over(Window.partitionBy("qid", "block").orderBy("dist", "id"))).where(F.col("r") <= k)
    return first(local.select("qid", "id", "dist"), k)


def first(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def union_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def scored(support: DataFrame, items: DataFrame, query_vectors: DataFrame, distance=l2) -> DataFrame:
    """support with dist: the distances of all its rows."""
    return support.join(items.select("id", "vec"), "id").join(query_vectors.select("qid", "qvec"), "qid").select(*support.columns, distance("vec", "qvec").alias("dist"))


def merged(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int, part: str = "key") -> DataFrame:
    """top() of a support in parts: each part's first k, and of these the first k of all. A row that several parts hold is
    counted once."""
    own = Window.partitionBy("qid", part).orderBy("dist", "id")
    local = scored(support, items, query_vectors).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k)
    return first(local.select("qid", "id", "dist").dropDuplicates(["qid", "id"]), k)


def cutoff_ties(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int, distance) -> DataFrame:
    """Whether the k-th and the next distance of a query are the same."""
    ranks = top(support, items, query_vectors, k + 1, distance)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    return ranks.groupBy("qid").agg(F.coalesce(at(k) == at(k + 1), F.lit(False)).alias("tie"))


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, strict (share of the k true ids) and tied (share of results no farther than the k-th truth)."""
    worst = truth.groupBy("qid").agg(F.max("dist").alias("tau"), F.count(F.lit(1)).alias("n"))
    own = truth.select("qid", "id", F.lit(1).alias("hit"))
    joined = worst.join(results, "qid", "left").join(own, ["qid", "id"], "left")
    return joined.groupBy("qid").agg((F.count("hit") / k).alias("strict"), (F.count_if(F.col("dist") <= F.col("tau")) / k).alias("tied"))


def integrity(results: DataFrame, support: DataFrame, queries: DataFrame, k: int, items: DataFrame, again: DataFrame) -> DataFrame:
    """Counts of each query: ids that aren't items, rows outside the support, repeated ids, own rows, missing rows, and rows
    whose distance differs in a second run."""
    ok = support.select("qid", "id", F.lit(1).alias("ok")).dropDuplicates(["qid", "id"])
    known = items.select("id", F.lit(1).alias("known"))
    second = again.select("qid", "rank", "id", F.col("dist").alias("dist2"))
    full = results.join(known, "id", "left").join(ok, ["qid", "id"], "left").join(second, ["qid", "rank", "id"], "left")
    per = full.groupBy("qid").agg(
        F.count_if(F.col("known").isNull()).alias("invalid"), F.count_if(F.col("known").isNotNull() & F.col("ok").isNull()).alias("predicate_fail"),
        (F.count(F.lit(1)) - F.count_distinct("id")).alias("duplicate"), F.count_if(F.col("id") == F.col("qid")).alias("forbidden_self"),
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("dist") != F.col("dist2")).alias("nondeterministic"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return queries.select("qid").join(per, "qid", "left").select("qid", *[zero(c) for c in ("invalid", "predicate_fail", "duplicate", "forbidden_self")], F.greatest(F.lit(0), k - F.coalesce("n", F.lit(0))).cast("long").alias("underfull"), zero("nondeterministic"))


def prefix_top(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int, dims: int, distance=l2) -> DataFrame:
    """top() in two steps: the k-th smallest distance of the k rows nearest by their first `dims` dimensions bounds the
    answer, and only rows whose partial sum doesn't exceed it are scored in full. Equal sums stay, for ties by id."""
    scored = support.join(items.select("id", "vec"), "id").join(query_vectors.select("qid", "qvec"), "qid")
    part = scored.withColumn("part", distance(F.slice("vec", 1, dims), F.slice("qvec", 1, dims)))
    nearest = part.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("part", "id"))).where(F.col("r") <= k)
    bound = nearest.groupBy("qid").agg(F.max(distance("vec", "qvec")).alias("bound"))
    return first(part.join(bound, "qid").where(F.col("part") <= F.col("bound")).select("qid", "id", distance("vec", "qvec").alias("dist")), k)


def cascade_top(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int, stages: list[int], distance=l2) -> DataFrame:
    """prefix_top() in several stages: each adds the dimensions up to its own to the sums of the rows that are left, and
    drops those whose sum exceeds the bound. The bound is the greatest full distance of the k rows nearest by the first stage."""
    part = scored_vectors(support, items, query_vectors).withColumn("part", distance(F.slice("vec", 1, stages[0]), F.slice("qvec", 1, stages[0])))
    nearest = part.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("part", "id"))).where(F.col("r") <= k)
    bound = nearest.groupBy("qid").agg(F.max(distance("vec", "qvec")).alias("bound"))
    left = part.join(bound, "qid").where(F.col("part") <= F.col("bound"))
    for a, z in zip(stages, stages[1:]):
        left = left.withColumn("part", F.col("part") + distance(F.slice("vec", a + 1, z - a), F.slice("qvec", a + 1, z - a))).where(F.col("part") <= F.col("bound"))
    return first(left.select("qid", "id", distance("vec", "qvec").alias("dist")), k)


def scored_vectors(support: DataFrame, items: DataFrame, query_vectors: DataFrame) -> DataFrame:
    return support.join(items.select("id", "vec"), "id").join(query_vectors.select("qid", "qvec"), "qid")


def seeded_prefix_top(support: DataFrame, items: DataFrame, query_vectors: DataFrame, k: int, dims: int, seeds: int, distance=l2) -> DataFrame:
    """The first `seeds` rows of each support by id give the bound: the k-th of their full distances, or none where they are
    fewer. Of the rest, rows whose first `dims` dimensions exceed it aren't scored in full."""
    pairs = scored_vectors(support, items, query_vectors)
    chosen = support.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy("id"))).where(F.col("r") <= seeds).select("qid", "id")
    known = first(scored(chosen, items, query_vectors, distance), k)
    bound = known.where(F.col("rank") == k).select("qid", F.col("dist").alias("bound"))
    able = pairs.join(bound, "qid", "left").where(F.col("bound").isNull() | (distance(F.slice("vec", 1, dims), F.slice("qvec", 1, dims)) <= F.col("bound")))
    return first(able.select("qid", "id", distance("vec", "qvec").alias("dist")), k)


def edge_ratio(ranked: DataFrame, k: int) -> DataFrame:
    """qid, ratio of the distances of rank k + 1 and rank k; null where there are fewer."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    return ranked.groupBy("qid").agg((at(k + 1) / at(k)).alias("ratio"))


#: Ids of a bitmap: what one value of Spark's bitmap functions holds.
BITMAP = 32768


def bitmaps(tags: DataFrame) -> DataFrame:
    """tag, bucket, bits, high: for each tag and BITMAP ids in a row a bit each, and the highest place that is set."""
    place = F.col("id") % BITMAP
    return tags.groupBy("tag", F.floor(F.col("id") / BITMAP).cast("long").alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits"), F.max(place).alias("high"))


def bits_and(a: Column, b: Column) -> Column:
    """The common bits of two bitmaps of 4,096 bytes, by words of 16 hexadecimal digits."""
    word = lambda x, i: F.conv(F.substr(F.hex(x), i * 8 + F.lit(1), F.lit(8)), 16, 10).cast("bigint")
    both = F.transform(F.sequence(F.lit(0), F.lit(BITMAP // 32 - 1)), lambda i: F.lpad(F.hex(word(a, i).bitwiseAND(word(b, i))), 8, "0"))
    return F.unhex(F.array_join(both, ""))


def bitmap_conjunction(queries: DataFrame, tags: DataFrame, a: str = "tag1", b: str = "tag2") -> DataFrame:
    """conjunction() with the second posting as bitmaps: a row's place is looked up in the bitmap of its bucket."""
    maps = bitmaps(tags).select(F.col("tag").alias(b), "bucket", "bits")
    rows = equality(queries, tags, a).join(queries.select("qid", b), "qid").withColumn("bucket", F.floor(F.col("id") / BITMAP).cast("long"))
    place = F.col("id") % BITMAP
    byte = F.conv(F.hex(F.substr("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(maps, [b, "bucket"]).where(F.getbit(byte, (place % 8).cast("int")) == 1).select("qid", "id")
