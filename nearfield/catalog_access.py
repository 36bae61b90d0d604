"""Registered queries of access routes: distances, prefixes, partial top-Ks, clusters, graphs, negation, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield import plans
from nearfield.fixtures import K, L2, L2_INT, Tables, load, prelude, top_sql
from nearfield.functions import l2_int, permuted
from nearfield.operators import graph, search, statistics
from nearfield.registry import query

EQ = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 WHERE t.id <> q.qid"
BOTH = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 JOIN tags u ON u.id = t.id AND u.tag = q.tag2 WHERE t.id <> q.qid"
ALL = top_sql(EQ, tail="SELECT qid, id, dist FROM scored")


def equal(t: Tables) -> DataFrame:
    return search.without_self(search.equality(t.queries, t.tags))


@query(ALL)
def support_distances(spark, d):
    """All rows of the supports, without a limit; an audit reads these."""
    t = load(spark, d)
    return search.scored(equal(t), t.items, t.queries).select("qid", "id", "dist")


@query(top_sql(EQ, K, L2_INT, 127))
def permuted_topk(spark, d):
    """Dimensions by falling variance on both sides; whole numbers have the same distances in any order."""
    t = load(spark, d, 127)
    places = statistics.variance_order(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding")
    by_place = F.array(*[F.lit(r["dim"]) for r in places.orderBy("place").collect()])  # as long as a vector
    turned = lambda df, v: df.withColumn(v, permuted(F.col(v), by_place))
    return search.top(equal(t), turned(t.items, "vec"), turned(t.queries, "qvec"), K, l2_int)


@query(top_sql(EQ, K, L2_INT, 127))
def seeded_prefix_topk(spark, d):
    """The first 256 rows of a support by id are scored in full; the rest by batches of ids against their K-th distance."""
    t = load(spark, d, 127)
    return search.seeded_prefix_top(equal(t), t.items, t.queries, K, 16, 256, l2_int)


@query(top_sql(EQ, K, L2_INT, 127))
def cascade_topk(spark, d):
    """Prefixes of 8, 24 and 64 dimensions, each only for rows that the one before couldn't exclude."""
    t = load(spark, d, 127)
    return search.cascade_top(equal(t), t.items, t.queries, K, [8, 24], l2_int)


@query(top_sql(EQ))
def merged_topk(spark, d):
    """Partial answers of blocks of rows, merged."""
    t = load(spark, d)
    return search.merged(equal(t).withColumn("key", F.floor(F.col("id") / 64)), t.items, t.queries, K)


@query(top_sql(EQ))
def chunked_topk(spark, d):
    """A support of any size dealt by hash into 16 chunks, whose answers are merged."""
    t = load(spark, d)
    return search.merged(equal(t).withColumn("key", F.pmod(F.xxhash64("id"), F.lit(16))), t.items, t.queries, K)


@query(top_sql("SELECT DISTINCT q.qid, t.id FROM qs q JOIN tags t ON t.tag IN (q.tag1, q.tag2, q.tag3) WHERE t.id <> q.qid"))
def seen_topk(spark, d):
    """Three postings of a query one after the other; a row seen in several counts once."""
    t = load(spark, d)
    each = t.queries.select("qid", F.explode(F.array_distinct(F.array("tag1", "tag2", "tag3"))).alias("key"))
    return search.merged(search.without_self(each.join(t.tags, F.col("key") == F.col("tag")).select("qid", "key", "id")), t.items, t.queries, K)


SIZED = ", f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag)"


@query(top_sql(BOTH))
def complement_topk(spark, d):
    """The second posting as a bitmap where it is large, by a merge (join) where it isn't; the same rows either way."""
    t = load(spark, d)
    sizes = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    asked = t.queries.join(sizes.withColumnRenamed("tag", "tag2"), "tag2")
    large = search.bitmap_conjunction(asked.where("n > 300"), t.tags)
    small = search.conjunction(asked.where("n <= 300"), t.tags)
    return search.top(search.without_self(large.union(small)), t.items, t.queries, K)


@query(prelude() + " SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM tags a JOIN tags b ON a.id = b.id AND a.tag < b.tag GROUP BY a.tag, b.tag")
def bitmap_intersections(spark, d):
    """Sizes of all pairs of postings, from one bitmap for each tag and 32,768 ids."""
    maps = search.bitmaps(load(spark, d).tags)
    a, b = (maps.select(F.col("tag").alias(x), "bucket", F.col("bits").alias(f"bits_{x}")) for x in "ab")
    met = a.join(b, "bucket").where("a < b").select("a", "b", F.bitmap_count(search.bits_and(F.col("bits_a"), F.col("bits_b"))).alias("n"))
    return met.groupBy("a", "b").agg(F.sum("n").alias("n")).where("n > 0")


@query(prelude() + ", p AS (SELECT tag, id // 32768 AS bucket, count(*) AS n, max(id % 32768) AS high FROM tags GROUP BY ALL) SELECT tag, bucket::bigint AS bucket, n, high::bigint AS high FROM p")
def bitmap_sizes(spark, d):
    m = search.bitmaps(load(spark, d).tags)
    return m.select("tag", "bucket", F.bitmap_count("bits").alias("n"), "high")


# Clusters: the labels, each around its row with the smallest id.
CENTS = "cents AS (SELECT c.cluster, i.vec AS centroid FROM (SELECT label AS cluster, min(id) AS medoid FROM items GROUP BY label) c JOIN items i ON i.id = c.medoid)"
PROBED = CENTS + ", near AS (SELECT q.qid, i.cluster, row_number() OVER (PARTITION BY q.qid ORDER BY list_sum(list_transform(list_zip(i.centroid, q.qvec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), i.cluster) AS nth FROM qs q, cents i)"


def clusters(t: Tables) -> DataFrame:
    return t.items.groupBy(F.col("label").alias("cluster")).agg(F.min(F.struct("id", "vec"))["vec"].alias("centroid"))


def members(t: Tables) -> DataFrame:
    return t.items.select(F.col("label").alias("cluster"), "id")


SINGLE = "SELECT qid, id FROM (SELECT n.qid, t.id, row_number() OVER (PARTITION BY n.qid ORDER BY n.nth, t.id) AS place FROM near n JOIN qs q USING (qid) JOIN items i ON i.label = n.cluster JOIN tags t ON t.id = i.id AND t.tag = q.tag2 WHERE n.nth <= 9) WHERE place <= 150 AND id <> qid"


@query(top_sql(SINGLE).replace("\nsupport AS", PROBED + ",\nsupport AS"))
def ivf_single_topk(spark, d):
    """The nearest clusters in order, until 150 members with the tag have been visited."""
    t = load(spark, d)
    visited = graph.ivf_visited(t.queries, clusters(t), members(t), t.tags, 9, "tag2", 150)
    return search.top(search.without_self(visited), t.items, t.queries, K)


TWO = "SELECT a.qid, a.id FROM (SELECT n.qid, t.id FROM near n JOIN qs q USING (qid) JOIN items i ON i.label = n.cluster JOIN tags t ON t.id = i.id AND t.tag = q.tag2 WHERE n.nth <= 9) a JOIN (SELECT n.qid, t.id FROM near n JOIN qs q USING (qid) JOIN items i ON i.label = n.cluster JOIN tags t ON t.id = i.id AND t.tag = q.tag3 WHERE n.nth <= 9) b ON a.qid = b.qid AND a.id = b.id WHERE a.id <> a.qid"


@query(top_sql(TWO).replace("\nsupport AS", PROBED + ",\nsupport AS"))
def ivf_two_sided_topk(spark, d):
    """Both tags' clusters are probed, and what both give is scored."""
    t = load(spark, d)
    side = lambda tag: graph.ivf_support(t.queries, clusters(t), members(t), t.tags, 9, tag)
    return search.top(search.without_self(side("tag2").join(side("tag3"), ["qid", "id"], "left_semi")), t.items, t.queries, K)


RETRY = 1.02
FOUND = "SELECT p.qid, t.id FROM near p JOIN qs q ON q.qid = p.qid JOIN items i ON i.label = p.cluster JOIN tags t ON t.id = i.id AND t.tag = q.tag2 WHERE p.nth <= 5 AND t.id <> p.qid"


@query(top_sql(FOUND, tail="""), full_support AS (SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag2 WHERE t.id <> q.qid),
full_ranked AS (SELECT s.qid, s.id, {dist} AS dist, (row_number() OVER (PARTITION BY s.qid ORDER BY {dist}, s.id))::int AS rank FROM full_support s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid),
edge AS (SELECT qid, max(dist) FILTER (rank = 11) / max(dist) FILTER (rank = 10) AS ratio FROM ranked GROUP BY qid), again AS (SELECT qid FROM edge WHERE ratio > 0 AND ratio <= 1.02)
SELECT qid, rank, id, dist, false AS retried FROM ranked WHERE rank <= 10 AND qid NOT IN (SELECT qid FROM again) UNION ALL SELECT qid, rank, id, dist, true FROM full_ranked WHERE rank <= 10 AND qid IN (SELECT qid FROM again)""".replace("{dist}", L2.replace("{", "{{").replace("}", "}}")).replace("), full_support", ", full_support")).replace("\nsupport AS", PROBED + ",\nsupport AS").replace("FROM scored)\n, full_support", "FROM scored),\nfull_support"))
def boundary_retry_topk(spark, d):
    """Five clusters; where the 11th found is hardly farther than the 10th, the query is answered again from its whole support."""
    t = load(spark, d)
    found = search.without_self(graph.ivf_support(t.queries, clusters(t), members(t), t.tags, 5, "tag2"))
    part = search.top(found, t.items, t.queries, K + 1)
    again = search.edge_ratio(part, K).where((F.col("ratio") > 0) & (F.col("ratio") <= RETRY)).select("qid")
    full = search.top(search.without_self(search.equality(t.queries, t.tags, "tag2")).join(again, "qid", "left_semi"), t.items, t.queries, K)
    kept = part.where(F.col("rank") <= K).join(again, "qid", "left_anti")
    return kept.withColumn("retried", F.lit(False)).union(full.withColumn("retried", F.lit(True)))


@query(prelude() + SIZED + " SELECT tag, CASE WHEN tag IN (3, 202) THEN 400 WHEN tag IN (5, 101) OR n >= 600 THEN 200 ELSE 100 END AS beam, CASE WHEN tag IN (3, 202) THEN 1.5 WHEN tag IN (5, 101) OR n >= 600 THEN 1.4 ELSE 1.35 END::double AS cut, tag IN (5, 101) OR n >= 600 AS high_effort, tag IN (3, 202) AS risk_effort FROM f")
def effort_tiers(spark, d):
    sizes = load(spark, d).tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    return sizes.select("tag", *plans.effort(F.col("tag"), F.col("n"), (100, 1.35), (200, 1.4), (400, 1.5), 600, [5, 101], [3, 202]))


NOT = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 WHERE NOT EXISTS (SELECT 1 FROM tags u WHERE u.id = t.id AND u.tag IN (200, 300))"
PLANNED = f"""{SIZED[2:]}, total AS (SELECT count(*) AS n FROM items), surv AS ({NOT}),
rates AS (SELECT (1 - (SELECT n FROM f WHERE tag = 200) / (SELECT n FROM total)) * (1 - (SELECT n FROM f WHERE tag = 300) / (SELECT n FROM total)) AS rate),
per AS (SELECT q.qid, f.n AS anchor, (SELECT count(*) FROM surv s WHERE s.qid = q.qid) AS n_eff, f.n * rate AS n_hat FROM qs q JOIN f ON f.tag = q.tag1, rates)"""
ROUTE = "CASE WHEN planner = 'exact' THEN CASE WHEN n_eff = 0 THEN 'empty' WHEN n_eff <= 15 THEN 'brute' ELSE 'graph' END WHEN planner = 'mono' THEN CASE WHEN anchor <= 50 THEN 'brute' ELSE 'graph' END ELSE CASE WHEN n_hat <= 16 THEN 'brute' ELSE 'graph' END END"


def planned(t: Tables) -> DataFrame:
    """qid, planner, anchor, n_eff, n_hat, route of each query under each planner. Excluded: tags 200 and 300."""
    sizes = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = t.items.agg(F.count(F.lit(1))).scalar()
    share = lambda tag: 1 - sizes.where(F.col("tag") == tag).agg(F.max("n")).scalar() / total
    kept = negated(t).groupBy("qid").agg(F.count(F.lit(1)).alias("k"))
    per = t.queries.join(sizes, F.col("tag1") == F.col("tag")).join(kept, "qid", "left")
    per = per.select("qid", F.col("n").alias("anchor"), F.coalesce("k", F.lit(0)).cast("long").alias("n_eff"), (F.col("n") * (share(200) * share(300))).alias("n_hat"), F.explode(F.array(*[F.lit(p) for p in ("exact", "mono", "indep")])).alias("planner"))
    limit = {"exact": 15, "mono": 50, "indep": 16}
    route: Column | None = None
    for p, n in limit.items():
        one = plans.negation_route(F.col("n_eff"), F.col("anchor"), F.col("n_hat"), p, n)
        route = F.when(F.col("planner") == p, one) if route is None else route.when(F.col("planner") == p, one)
    return per.withColumn("route", route)


def negated(t: Tables) -> DataFrame:
    excluded = t.queries.select("qid", F.explode(F.array(F.lit(200).cast("long"), F.lit(300).cast("long"))).alias("not"))
    return search.without(search.equality(t.queries, t.tags), search.equality(excluded, t.tags, "not"))


@query(prelude() + ", " + PLANNED + f", planned AS (SELECT *, {ROUTE} AS route FROM per, (SELECT unnest(['exact', 'mono', 'indep']) AS planner)) SELECT qid, planner, anchor, n_eff, round(n_hat, 6) AS n_hat, route FROM planned")
def negation_routes(spark, d):
    return planned(load(spark, d)).select("qid", "planner", "anchor", "n_eff", F.round("n_hat", 6).alias("n_hat"), "route")


@query(top_sql(NOT, tail=f", planned AS (SELECT *, {ROUTE} AS route FROM per, (SELECT unnest(['exact', 'mono', 'indep']) AS planner)) SELECT p.planner, p.route, r.qid, r.rank, r.id, r.dist FROM planned p JOIN ranked r USING (qid) WHERE rank <= 10").replace("\nsupport AS", PLANNED + ",\nsupport AS"))
def negation_routed_topk(spark, d):
    """Answers by the route that each planner chose: nothing, the survivors, or a search of the anchor's shard that filters as
    it goes (exact here, as shards have no graph of their own)."""
    t = load(spark, d)
    chosen = planned(t).select("qid", "planner", "route")
    brute = search.top(negated(t), t.items, t.queries, K).join(chosen.where("route = 'brute'"), "qid")
    excluded = t.tags.where(F.col("tag").isin(200, 300)).select("id").distinct()
    shard = search.scored(search.equality(t.queries, t.tags), t.items, t.queries).join(excluded, "id", "left_anti")
    walked = search.first(shard, K).join(chosen.where("route = 'graph'"), "qid")
    return brute.union(walked.select(*brute.columns)).select("planner", "route", "qid", "rank", "id", "dist")


SHARDS = """SELECT qid, id FROM (SELECT qid, id FROM (SELECT q.qid, t.id, row_number() OVER (PARTITION BY q.qid ORDER BY {d}, t.id) AS r FROM qs q JOIN tags t ON t.tag = q.tag1 JOIN items i ON i.id = t.id) WHERE r <= 40
UNION SELECT qid, id FROM (SELECT q.qid, t.id, row_number() OVER (PARTITION BY q.qid ORDER BY {d}, t.id) AS r FROM qs q JOIN tags t ON t.tag = q.tag3 JOIN items i ON i.id = t.id) WHERE r <= 40) x
SEMI JOIN (SELECT q.qid AS q2, a.id AS i2 FROM qs q JOIN tags a ON a.tag = q.tag1 JOIN tags b ON b.id = a.id AND b.tag = q.tag3) ok ON ok.q2 = x.qid AND ok.i2 = x.id WHERE x.id <> x.qid""".replace("{d}", L2)


@query(top_sql(SHARDS))
def dual_shard_topk(spark, d):
    """The 40 nearest of both tags' shards; those with both tags stay. Approximate: rows with both tags beyond the 40 are lost."""
    t = load(spark, d)
    pool = lambda tag: search.top(search.equality(t.queries, t.tags, tag), t.items, t.queries, 40).select("qid", "id")
    both = search.any_of(pool("tag1"), pool("tag3")).join(search.conjunction(t.queries, t.tags, "tag1", "tag3"), ["qid", "id"], "left_semi")
    return search.top(search.without_self(both), t.items, t.queries, K)


@query(top_sql("SELECT q.qid, a.id FROM qs q JOIN tags a ON a.tag = q.tag2 JOIN tags b ON b.id = a.id AND b.tag = q.tag3 WHERE a.id <> q.qid", tail="SELECT 20000 + 100 * least(q.tag2, q.tag3) + greatest(q.tag2, q.tag3) AS shard, r.qid, rank, r.id, dist FROM ranked r JOIN qs q USING (qid) WHERE rank <= 10"))
def pair_shard_topk(spark, d):
    """Pairs that have a shard of their own, under a number of both tags, are searched there without a filter."""
    t = load(spark, d)
    number = lambda a, b: 20000 + 100 * F.least(a, b) + F.greatest(a, b)
    x, y = t.tags.where("tag BETWEEN 200 AND 299"), t.tags.where("tag BETWEEN 100 AND 199").select("id", F.col("tag").alias("other"))
    shards = x.join(y, "id").select(number(F.col("tag"), F.col("other")).alias("shard"), "id")
    asked = t.queries.withColumn("shard", number(F.col("tag2"), F.col("tag3"))).select("qid", "shard")
    found = search.top(search.without_self(asked.join(shards, "shard").select("qid", "id")), t.items, t.queries, K)
    return found.join(asked, "qid").select("shard", "qid", "rank", "id", "dist")


@query()
def local_graph_topk(spark, d):
    """Approximate: a graph for each label whose share of the rows is in the band, searched from its smallest id with a pool
    of more than K; the query's own row is passed through and removed."""
    t = load(spark, d)
    shards = t.items.select("id", "vec", F.col("label").alias("shard"))
    return graph.search_distinct(t.queries.withColumn("shard", F.col("tag1")), shards, lambda s: graph.alpha_graph(s, 16, 1.2), K, 4 * K, 8)


@query(prelude() + """, i2 AS (SELECT i.id, i.vec, r.block FROM items i JOIN rws r USING (id)), e AS (SELECT a.block, a.id AS src, b.id AS dst, row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(list_zip(a.vec, b.vec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), b.id) AS r FROM i2 a JOIN i2 b ON a.block = b.block AND a.id <> b.id) SELECT block AS shard, src, dst FROM e WHERE r <= 4""")
def block_graphs(spark, d):
    """A graph for each fixed block, of its frozen rows."""
    t = load(spark, d)
    return graph.knn_graph(t.items.join(t.rows.select("id", "block"), "id"), "block", 4).select("shard", "src", "dst")


BAD_EDGES = ", e AS (SELECT i.label AS shard, i.id AS src, q.id AS dst, row_number() OVER (PARTITION BY i.id ORDER BY list_sum(list_transform(list_zip(i.vec, q.vec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), q.id) AS r FROM items i JOIN items q ON q.label = i.label AND q.id <> i.id), g AS (SELECT shard, src, dst FROM e WHERE r <= 4 UNION ALL SELECT label, id, id FROM items WHERE id % 100 = 1 UNION ALL SELECT shard, src, dst FROM e WHERE r = 1 AND src % 100 = 2 UNION ALL SELECT label, id, -5 FROM items WHERE id % 100 = 3)"


@query(prelude() + BAD_EDGES + """ SELECT shard, count(*) FILTER (src = dst) AS own, (count(*) - count(DISTINCT (src, dst)))::bigint AS repeated, count(*) FILTER (dst NOT IN (SELECT id FROM items)) AS foreign_, (SELECT count(*) FROM (SELECT src FROM g h WHERE h.shard = g.shard GROUP BY src HAVING count(*) > 4))::bigint AS too_many FROM g GROUP BY shard""")
def graph_audit(spark, d):
    """Violations of a neighbour graph, some of which are planted: own, repeated and foreign neighbours, and rows with too many."""
    t = load(spark, d)
    edges = graph.knn_graph(t.items, "label", 4)
    nth = F.row_number().over(Window.partitionBy("shard", "src").orderBy(F.asc_nulls_last("dist"), "dst"))
    twice = F.when((nth == 1) & (F.col("src") % 100 == 2), 2).otherwise(1)
    edges = edges.withColumn("n", twice).select("shard", "src", "dst", F.explode(F.sequence(F.lit(1), F.col("n")))).select("shard", "src", "dst")
    planted = lambda kind, dst: t.items.where(F.col("id") % 100 == kind).select(F.col("label").alias("shard"), F.col("id").alias("src"), dst.cast("long").alias("dst"))
    bad = search.union_of([edges, planted(1, F.col("id")), planted(3, F.lit(-5))])
    return graph.audit(bad, t.items, 4)


@query(prelude() + ", f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), p AS (SELECT q.qid, least(a.n, b.n) AS small, greatest(a.n, b.n) AS large FROM qs q JOIN f a ON a.tag = q.tag1 JOIN f b ON b.tag = q.tag2) SELECT qid, CASE WHEN large > 500 THEN 'bitmap' WHEN large > 8 * small THEN 'gallop' ELSE 'merge' END AS strategy FROM p")
def intersection_strategy(spark, d):
    t = load(spark, d)
    sizes = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    one, two = (sizes.select(F.col("tag").alias(f"tag{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    return t.queries.join(one, "tag1").join(two, "tag2").select("qid", plans.strategy(F.col("n1"), F.col("n2"), 500).alias("strategy"))


