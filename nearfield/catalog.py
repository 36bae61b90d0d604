"""The registered queries: each applies an operator to whole tables, with equivalent SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import plans
from nearfield.fixtures import K, L2, L2_INT, Tables, load, prelude, top_sql
from nearfield.functions import elias_fano_bytes, interval_gap, l2, l2_int, pair_position, quantised
from nearfield.operators import graph, layouts, order, search, statistics
from nearfield.registry import QUERIES, SQL, query

__all__ = ["QUERIES", "SQL"]


def self_free(t: Tables, support: DataFrame, k: int = K) -> DataFrame:
    return search.top(search.without_self(support), t.items, t.queries, k)


EQ = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 WHERE t.id <> q.qid"
BOTH = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 JOIN tags u ON u.id = t.id AND u.tag = q.{} WHERE t.id <> q.qid"
IN = "a.{0} IS NOT NULL AND NOT isnan(a.{0}) AND a.{0} >= q.lo{1} AND a.{0} < q.hi{1}"
RANGE = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 JOIN attrs a ON a.id = t.id WHERE t.id <> q.qid AND " + IN.format("width", 1)
DNF = RANGE + " UNION SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag2 JOIN attrs a ON a.id = t.id WHERE t.id <> q.qid AND " + IN.format("width", 2)
BLOCKS = "SELECT q.qid, r.id FROM qs q JOIN rws r ON r.attr BETWEEN q.a{0} AND q.z{0}"


@query(top_sql(EQ))
def equality_topk(spark, d):
    t = load(spark, d)
    return search.packed_top(t.queries, t.tags, t.items, K)


@query(top_sql(BOTH.format("tag2")))
def conjunction_topk(spark, d):
    t = load(spark, d)
    return search.packed_top(t.queries, t.tags, t.items, K, "tag1", "tag2")


@query(top_sql(BOTH.format("tag3")))
def underfull_topk(spark, d):
    t = load(spark, d)
    return self_free(t, search.conjunction(t.queries, t.tags, "tag1", "tag3"))


def width_range(t: Tables) -> DataFrame:
    return search.ranged(t.queries, t.tags, t.attrs, "width", "lo1", "hi1")


def two_clauses(t: Tables) -> DataFrame:
    return search.any_of(width_range(t), search.ranged(t.queries, t.tags, t.attrs, "width", "lo2", "hi2", "tag2"))


@query(top_sql(RANGE))
def range_topk(spark, d):
    t = load(spark, d)
    return self_free(t, width_range(t))


@query(top_sql(RANGE.replace("q.lo1 AND a.width < q.hi1", "q.lo1 AND a.width < q.hi1 AND a.width > 0 AND a.similarity BETWEEN 0 AND 1")))
def domain_range_topk(spark, d):
    t = load(spark, d)
    domain = (F.col("width") > 0) & F.col("similarity").between(0, 1)
    return self_free(t, search.ranged(t.queries, t.tags, t.attrs, "width", "lo1", "hi1", domain=domain))


@query(top_sql(DNF))
def dnf2_topk(spark, d):
    t = load(spark, d)
    return self_free(t, two_clauses(t))


@query(top_sql(BOTH.format("tag2") + " UNION " + BOTH.format("tag3")))
def dnf_pairs_topk(spark, d):
    t = load(spark, d)
    return self_free(t, search.any_of(search.conjunction(t.queries, t.tags), search.conjunction(t.queries, t.tags, "tag1", "tag3")))


def negated(t: Tables) -> DataFrame:
    """The first tag without tags 200 and 300."""
    return search.without(search.equality(t.queries, t.tags), search.equality(t.queries.select("qid", F.explode(F.array(F.lit(200).cast("long"), F.lit(300).cast("long"))).alias("not")), t.tags, "not"))


NOT = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 WHERE NOT EXISTS (SELECT 1 FROM tags u WHERE u.id = t.id AND u.tag IN (200, 300))"


@query(top_sql(NOT))
def negation_topk(spark, d):
    t = load(spark, d)
    return search.top(negated(t), t.items, t.queries, K)


@query(top_sql(BLOCKS.format(1)))
def fixed_block_topk(spark, d):
    t = load(spark, d)
    return search.top(layouts.block_support(t.queries, t.rows, "a1", "z1", 25), t.items, t.queries, K)


@query(top_sql("SELECT q.qid, r.id FROM qs q JOIN rws r ON r.attr >= q.a1 AND r.attr <= q.z1"))
def closed_range_topk(spark, d):
    """By wide blocks of 500, all of them tested."""
    t = load(spark, d)
    rows = t.rows.withColumn("block", F.floor(F.col("attr") / 500).cast("long"))
    return search.top(layouts.block_support(t.queries, rows, "a1", "z1", 500), t.items, t.queries, K)


@query(top_sql(BLOCKS.format(1) + " UNION " + BLOCKS.format(2)))
def two_range_dnf_topk(spark, d):
    t = load(spark, d)
    both = search.any_of(layouts.block_support(t.queries, t.rows, "a1", "z1", 25), layouts.block_support(t.queries, t.rows, "a2", "z2", 25))
    return search.top(both, t.items, t.queries, K)


@query(top_sql(BLOCKS.format(1)))
def hierarchical_range_topk(spark, d):
    """Both end blocks are tested; the blocks between come whole, from the nodes of their dyadic cover. The cover of a number
    of blocks is a closed form of their ends: a node is in it if it lies inside and its parent doesn't."""
    t = load(spark, d)
    lo, hi = F.floor(F.col("a1") / 25).cast("long"), F.floor(F.col("z1") / 25).cast("long")
    ends = search.any_of(*[t.queries.select("qid", "a1", "z1", e.alias("block")).join(t.rows, "block").where(F.col("attr").between(F.col("a1"), F.col("z1"))).select("qid", "id") for e in (lo, hi)])
    widths = F.explode(F.array(*[F.lit(1 << k).cast("long") for k in range(8)]))
    node = t.queries.select("qid", (lo + 1).alias("first"), hi.alias("end"), widths.alias("width"))
    node = node.where("first < end").withColumn("k", F.explode(F.sequence(F.floor(F.col("first") / F.col("width")).cast("long"), F.floor((F.col("end") - 1) / F.col("width")).cast("long"))))
    inside = lambda w: (F.floor(F.col("k") * F.col("width") / w) * w >= F.col("first")) & (F.floor(F.col("k") * F.col("width") / w) * w + w <= F.col("end"))
    wide = F.col("width") * 2
    cover = node.where(inside(F.col("width")) & ((F.col("width") == 128) | ~inside(wide))).select("qid", "width", (F.col("k") * F.col("width")).cast("long").alias("node"))
    segments = t.rows.select("id", "block", widths.alias("width")).withColumn("node", (F.floor(F.col("block") / F.col("width")) * F.col("width")).cast("long"))
    middle = cover.join(segments, ["width", "node"]).select("qid", "id")
    return search.top(search.any_of(ends, middle), t.items, t.queries, K)


@query(top_sql(EQ, K, L2_INT, 4, "SELECT qid, coalesce(max(dist) FILTER (rank = {k}) = max(dist) FILTER (rank = {k} + 1), false) AS tie FROM ranked GROUP BY qid"))
def cutoff_tie(spark, d):
    t = load(spark, d, 4)
    return search.cutoff_ties(search.without_self(search.equality(t.queries, t.tags)), t.items, t.queries, K, l2_int)


@query(top_sql(EQ, 64, L2_INT, 127))
def shortlist64(spark, d):
    t = load(spark, d, 127)
    return search.top(search.without_self(search.equality(t.queries, t.tags)), t.items, t.queries, 64, l2_int)


def approximate(t: Tables) -> DataFrame:
    """Top K on coarse vectors, scored exactly: what recall is measured on."""
    support = search.without_self(search.equality(t.queries, t.tags))
    coarse = search.top(support, t.items.withColumn("vec", quantised("vec", 4)), t.queries.withColumn("qvec", quantised("qvec", 4)), K, l2_int)
    return search.top(coarse.select("qid", "id"), t.items, t.queries, K)


COARSE = top_sql(EQ, tail="""SELECT 1""").replace("SELECT 1", "").rstrip() + """,
coarse AS (SELECT s.qid, s.id, row_number() OVER (PARTITION BY s.qid ORDER BY list_sum(list_transform(list_zip(i.vec, q.qvec),
  lambda z: (floor(z[1]::double * 4)::bigint - floor(z[2]::double * 4)::bigint) * (floor(z[1]::double * 4)::bigint - floor(z[2]::double * 4)::bigint))), s.id) AS r
  FROM support s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid),
found AS (SELECT c.qid, c.id, r.dist FROM coarse c JOIN ranked r ON r.qid = c.qid AND r.id = c.id WHERE c.r <= 10),
truth AS (SELECT * FROM ranked WHERE rank <= 10)"""


@query(COARSE + " SELECT t.qid, count(f.id) / 10 AS strict FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.id = t.id GROUP BY t.qid")
def strict_recall(spark, d):
    t = load(spark, d)
    return search.recall(approximate(t), equality_topk(spark, d), K).select("qid", "strict")


@query(COARSE + ", tau AS (SELECT qid, max(dist) AS tau FROM truth GROUP BY qid) SELECT t.qid, count(*) FILTER (f.dist <= t.tau) / 10 AS tied FROM tau t LEFT JOIN found f ON f.qid = t.qid GROUP BY t.qid")
def tie_recall(spark, d):
    t = load(spark, d)
    return search.recall(approximate(t), equality_topk(spark, d), K).select("qid", "tied")


#: Violations that are planted in results: a foreign id, a repeated one, the query's own, an id that isn't there, a distance
#: that differs in a second run, by the query's number modulo five.
PLANTED = """res AS (SELECT qid, rank, id, dist FROM ranked WHERE rank <= 10),
bad AS (SELECT qid, rank, id, dist FROM res UNION ALL SELECT qid, 11, qid, 0.0 FROM qs WHERE qid % 250 = 0 UNION ALL SELECT qid, 12, id, dist FROM res WHERE qid % 250 = 50 AND rank <= 2
  UNION ALL SELECT qid, 13, -7, 1.0 FROM qs WHERE qid % 250 = 100 UNION ALL SELECT qid, 14, i.id, 2.0 FROM qs JOIN items i ON i.id = qid + 1 WHERE qid % 250 = 150),
again AS (SELECT qid, rank, id, CASE WHEN qid % 250 = 200 THEN dist + 1 ELSE dist END AS dist FROM bad)"""


@query(top_sql(BOTH.format("tag3"), tail=", " + PLANTED + """ SELECT q.qid,
  (SELECT count(*) FROM bad b WHERE b.qid = q.qid AND b.id NOT IN (SELECT id FROM items))::bigint AS invalid,
  (SELECT count(*) FROM bad b WHERE b.qid = q.qid AND b.id IN (SELECT id FROM items) AND NOT EXISTS (SELECT 1 FROM support_all s WHERE s.qid = b.qid AND s.id = b.id))::bigint AS predicate_fail,
  (SELECT count(*) - count(DISTINCT id) FROM bad b WHERE b.qid = q.qid)::bigint AS duplicate,
  (SELECT count(*) FROM bad b WHERE b.qid = q.qid AND b.id = q.qid)::bigint AS forbidden_self,
  greatest(0, 10 - (SELECT count(*) FROM bad b WHERE b.qid = q.qid))::bigint AS underfull,
  (SELECT count(*) FROM bad b JOIN again g ON g.qid = b.qid AND g.rank = b.rank AND g.id = b.id WHERE b.qid = q.qid AND g.dist <> b.dist)::bigint AS nondeterministic FROM qs q""").replace("scored AS (", "support_all AS (" + BOTH.format("tag3").replace(" WHERE t.id <> q.qid", "") + "),\nscored AS ("))
def integrity_audit(spark, d):
    t = load(spark, d)
    good = underfull_topk(spark, d)
    kind = F.col("qid") % 250
    row = lambda df, rank, id_, dist: df.select("qid", F.lit(rank).alias("rank"), id_.cast("long").alias("id"), F.lit(dist).cast("double").alias("dist"))
    again = good.where((kind == 50) & (F.col("rank") <= 2)).select("qid", F.lit(12).alias("rank"), "id", "dist")
    foreign = t.queries.where(kind == 150).join(t.items.select((F.col("id") - 1).alias("qid")), "qid")
    bad = good.union(row(t.queries.where(kind == 0), 11, F.col("qid"), 0.0)).union(again).union(row(t.queries.where(kind == 100), 13, F.lit(-7), 1.0)).union(row(foreign, 14, F.col("qid") + 1, 2.0))
    second = bad.withColumn("dist", F.when(kind == 200, F.col("dist") + 1).otherwise(F.col("dist")))
    return search.integrity(bad, search.conjunction(t.queries, t.tags, "tag1", "tag3"), t.queries, K, t.items, second)


@query(prelude() + " SELECT tag, count(*) AS n FROM tags GROUP BY tag")
def posting_sizes(spark, d):
    return load(spark, d).tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


ROUTED = ", f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), r AS (SELECT q.*, f1.n AS n1, f2.n AS n2 FROM qs q LEFT JOIN f f1 ON f1.tag = q.tag1 LEFT JOIN f f2 ON f2.tag = q.tag2)"


def frequencies(t: Tables) -> DataFrame:
    f = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    one = f.select(F.col("tag").alias("tag1"), F.col("n").alias("n1"))
    two = f.select(F.col("tag").alias("tag2"), F.col("n").alias("n2"))
    return t.queries.join(one, "tag1", "left").join(two, "tag2", "left")


@query(prelude() + ROUTED + """ SELECT qid, CASE WHEN n1 IS NULL THEN 'skipped' WHEN least(n1, n2) <= 100 THEN 'brute' ELSE 'graph_conjunction' END AS route,
  CASE WHEN n1 < n2 OR (n1 = n2 AND tag1 < tag2) THEN tag1 ELSE tag2 END AS primary_tag, CASE WHEN n1 < 50000 THEN n1 WHEN n1 < 500000 THEN 2000 ELSE 4000 END::bigint AS target FROM r""")
def routes(spark, d):
    r = frequencies(load(spark, d))
    first = (F.col("n1") < F.col("n2")) | ((F.col("n1") == F.col("n2")) & (F.col("tag1") < F.col("tag2")))
    return r.select("qid", plans.tag_route(F.col("n1"), F.col("n2"), 100).alias("route"), F.when(first, F.col("tag1")).otherwise(F.col("tag2")).alias("primary_tag"), plans.target_points(F.col("n1"), 2000).cast("long").alias("target"))


@query(prelude() + ROUTED + ", s AS (" + NOT + """), c AS (SELECT count(*) AS n FROM items), z AS (SELECT q.qid, q.n1 AS anchor, count(s.id) AS n_eff FROM r q LEFT JOIN s ON s.qid = q.qid GROUP BY ALL)
SELECT z.qid, anchor, n_eff, 1 - n_eff / anchor AS r, CASE WHEN n_eff = 0 THEN 'empty' WHEN n_eff <= 15 THEN 'brute' ELSE 'graph' END AS exact, CASE WHEN anchor <= 50 THEN 'brute' ELSE 'graph' END AS mono FROM z""")
def negation_planner(spark, d):
    t = load(spark, d)
    kept = negated(t).groupBy("qid").agg(F.count(F.lit(1)).alias("k"))
    z = frequencies(t).join(kept, "qid", "left").select("qid", F.col("n1").alias("anchor"), F.coalesce("k", F.lit(0)).cast("long").alias("n_eff"))
    route = lambda p, limit: plans.negation_route(F.col("n_eff"), F.col("anchor"), F.col("n_eff"), p, limit)
    return z.select("qid", "anchor", "n_eff", (1 - F.col("n_eff") / F.col("anchor")).alias("r"), route("exact", 15).alias("exact"), route("mono", 50).alias("mono"))


@query(prelude() + ROUTED + ", c AS (SELECT count(*) AS n FROM items) SELECT qid, round(n1 * (1 - n2 / c.n), 9) AS estimate FROM r, c")
def selectivity_estimate(spark, d):
    t = load(spark, d)
    total = t.items.agg(F.count(F.lit(1))).scalar()
    return frequencies(t).select("qid", F.round(F.col("n1") * (1 - F.col("n2") / total), 9).alias("estimate"))


def _cells(names: str) -> str:
    return f"{prelude()}, s AS (SELECT {names}, count(*) AS n FROM rws GROUP BY {names}), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY {names} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first FROM s)"


@query(_cells("bin, a, b") + " SELECT bin, a, b, n, first FROM o")
def cube_offsets(spark, d):
    return layouts.cell_offsets(load(spark, d).rows, ["bin", "a", "b"])


@query(prelude() + " SELECT id, bin, a, b, row_number() OVER (ORDER BY bin, a, b, id) - 1 AS position FROM rws")
def cube_layout(spark, d):
    return layouts.layout(load(spark, d).rows, ["bin", "a", "b"])


@query(prelude() + " SELECT id, a, b, row_number() OVER (ORDER BY a, b, id) - 1 AS position FROM rws")
def pair_major_layout(spark, d):
    return layouts.layout(load(spark, d).rows, ["a", "b"])


@query("SELECT p_partkey AS id, p_brand AS a, p_type AS b, p_size AS bin, row_number() OVER (ORDER BY p_size, p_brand, p_type, p_partkey) - 1 AS position FROM part")
def part_cube_layout(spark, d):
    rows = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("a"), F.col("p_type").alias("b"), F.col("p_size").alias("bin"))
    return layouts.layout(rows, ["bin", "a", "b"])


@query(prelude() + ", w AS (SELECT unnest([1, 2, 4, 8]) AS width) SELECT width, (bin // width * width)::bigint AS start, count(*) AS n FROM rws, w GROUP BY ALL")
def dyadic_fragments(spark, d):
    return layouts.dyadic(load(spark, d).rows, "bin")


@query(prelude() + ", w AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]::bigint[]) AS width), h AS (SELECT width, unnest(range(0, 200 - width + 1, width)) AS first FROM w), c AS (SELECT width, block // width * width AS first, count(*) AS n FROM rws, w GROUP BY ALL) SELECT h.width, h.first, coalesce(c.n, 0)::bigint AS n FROM h LEFT JOIN c USING (width, first)")
def hierarchy_nodes(spark, d):
    """All aligned segments of the 200 blocks and how many rows each holds."""
    t = load(spark, d)
    held = layouts.dyadic(t.rows, "block", tuple(1 << k for k in range(8))).select(F.col("width").cast("long").alias("width"), F.col("start").alias("first"), "n")
    return layouts.hierarchy(spark.range(1)).join(held, ["width", "first"], "left").select("width", "first", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


MET = ", o AS (SELECT qid, a1, z1, unnest(range(a1 // 25, z1 // 25 + 1)) AS block FROM qs), m AS (SELECT qid, block, least(z1, block * 25 + 24) - greatest(a1, block * 25) + 1 AS n FROM o)"


@query(prelude() + MET + " SELECT qid, block, n < 25 AS is_boundary, n / 25 AS fraction FROM m")
def block_overlap(spark, d):
    return layouts.overlapped(load(spark, d).queries, "a1", "z1", 25)


@query(prelude() + MET + ", s AS (SELECT block, count(*) AS c FROM rws GROUP BY block) SELECT m.qid, m.block, least(c, CASE WHEN n = 25 THEN 10 ELSE ceil(40 / (n / 25)) END)::bigint AS pool FROM m JOIN s USING (block)")
def boundary_pool(spark, d):
    t = load(spark, d)
    sizes = t.rows.groupBy("block").agg(F.count(F.lit(1)).alias("c"))
    pool = F.when(~F.col("is_boundary"), F.lit(K)).otherwise(F.ceil(4 * K / F.col("fraction")))
    return layouts.overlapped(t.queries, "a1", "z1", 25).join(sizes, "block").select("qid", "block", F.least("c", pool).cast("long").alias("pool"))


@query(prelude() + ", c AS (SELECT tag AS owner, id, (row_number() OVER (PARTITION BY tag ORDER BY id) - 1) // 16 AS chunk FROM tags) SELECT DISTINCT owner, chunk::bigint AS chunk, t.tag FROM c JOIN tags t USING (id)")
def chunk_summary(spark, d):
    return layouts.chunk_tags(load(spark, d).tags)


PAIRS = ", ab AS (SELECT a, b, count(*) AS n FROM rws GROUP BY a, b), na AS (SELECT a, count(*) AS na FROM rws GROUP BY a), nb AS (SELECT b, count(*) AS nb FROM rws GROUP BY b)"


@query(prelude() + PAIRS + " SELECT a, b, n, (3500 + 8 * n)::bigint AS packed, (3500 + 16 * n)::bigint AS ids, (5000 + 4 * (na + nb) + 16 * n)::bigint AS online FROM ab JOIN na USING (a) JOIN nb USING (b)")
def fragment_costs(spark, d):
    rows = load(spark, d).rows
    size = lambda cols, n: rows.groupBy(*cols).agg(F.count(F.lit(1)).alias(n))
    f = size(["a", "b"], "n").join(size(["a"], "na"), "a").join(size(["b"], "nb"), "b")
    cost = lambda s: plans.fragment_cost(F.col("n"), F.col("na"), F.col("nb"), F.lit(s)).cast("long").alias(s)
    return f.select("a", "b", "n", cost("packed"), cost("ids"), cost("online"))


@query(prelude() + " SELECT tag, (4 * count(*))::bigint AS id_bytes, (128 * count(*))::bigint AS packed_bytes FROM tags GROUP BY tag")
def byte_charge(spark, d):
    return load(spark, d).tags.groupBy("tag").agg((4 * F.count(F.lit(1))).cast("long").alias("id_bytes"), (128 * F.count(F.lit(1))).cast("long").alias("packed_bytes"))


@query(prelude() + """, f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), l AS (SELECT *, CASE WHEN 1000000 // n <= 1 THEN 0 ELSE floor(log2(1000000 // n)) END::bigint AS low FROM f)
SELECT tag, low, (ceil(n * low / 64) * 8)::bigint AS low_bytes, (ceil((floor(1000000 / pow(2, low)) + n) / 64) * 8)::bigint AS high_bytes FROM l""")
def ef_account(spark, d):
    low, low_bytes, high_bytes = elias_fano_bytes(F.col("n"))
    return posting_sizes(spark, d).select("tag", low.alias("low"), low_bytes.alias("low_bytes"), high_bytes.alias("high_bytes"))


@query(prelude() + " SELECT tag, (3 * count(*))::bigint AS bytes FROM tags GROUP BY tag")
def u24_size(spark, d):
    return posting_sizes(spark, d).select("tag", (3 * F.col("n")).cast("long").alias("bytes"))


@query(prelude() + ", g AS (SELECT tag, id - lag(id) OVER (PARTITION BY tag ORDER BY id) AS gap FROM tags) SELECT tag, coalesce(max(gap), 0) <= 65535 AND coalesce(min(gap), 1) > 0 AS eligible, (4 + 2 * (count(*) - 1))::bigint AS bytes FROM g GROUP BY tag")
def delta16_eligibility(spark, d):
    g = order.greatest_gaps(load(spark, d).tags, ["tag"], "id")
    return g.select("tag", ((F.coalesce("most", F.lit(0)) <= 65535) & (F.coalesce("least", F.lit(1)) > 0)).alias("eligible"), (4 + 2 * (F.col("n") - 1)).cast("long").alias("bytes"))


@query(prelude() + " SELECT DISTINCT a.tag AS a, b.tag AS b, (a.tag * (800 - a.tag - 1) // 2 + b.tag - a.tag - 1)::bigint AS position FROM tags a JOIN tags b USING (id) WHERE a.tag < b.tag")
def arena_position(spark, d):
    """Places of the pairs of tags that occur in the triangle of 400 tokens."""
    tags = load(spark, d).tags
    pairs = tags.select("id", F.col("tag").alias("a")).join(tags.select("id", F.col("tag").alias("b")), "id").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", pair_position(F.col("a"), F.col("b"), 400).alias("position"))


RATIO = "SELECT nation, sum(v) FILTER (o_orderstatus = 'F') / sum(v) FILTER (o_orderstatus = 'O') AS ratio FROM (SELECT c.c_nationkey % 8 AS nation, o.o_orderstatus, o.o_orderkey::double AS v FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY nation"


def ratios(spark, d) -> DataFrame:
    """Eight paired ratios: per group of nations, the keys of finished over those of open orders."""
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey") == F.col("o_custkey"))
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey").cast("double")))
    return o.groupBy((F.col("c_nationkey") % 8).alias("nation")).agg((part("F") / part("O")).alias("ratio"))


@query(f"WITH r AS ({RATIO}) SELECT round(exp(avg(ln(ratio))), 9) AS geo_mean FROM r")
def geo_mean(spark, d):
    return statistics.geometric_mean(ratios(spark, d), "ratio").select(F.round("geo_mean", 9).alias("geo_mean"))


@query(f"""WITH r AS (SELECT ln(ratio) AS x, row_number() OVER (ORDER BY nation) - 1 AS i FROM ({RATIO})), m AS (SELECT unnest(range(0, (SELECT 2 ** count(*) FROM r)::bigint)) AS mask),
s AS (SELECT mask, sum(CASE WHEN (mask >> i) & 1 = 1 THEN -x ELSE x END) AS t FROM m, r GROUP BY mask), o AS (SELECT sum(x) AS t FROM r)
SELECT avg(CASE WHEN s.t >= o.t - 1e-15 THEN 1.0 ELSE 0.0 END)::double AS one_sided, avg(CASE WHEN abs(s.t) >= abs(o.t) - 1e-15 THEN 1.0 ELSE 0.0 END)::double AS two_sided FROM s, o""")
def sign_flip(spark, d):
    return statistics.sign_flip(spark, [r["ratio"] for r in ratios(spark, d).orderBy("nation").collect()])  # eight by construction


@query("SELECT l_returnflag, round(regr_slope(l_extendedprice::double, l_quantity::double), 6) AS slope, round(regr_intercept(l_extendedprice::double, l_quantity::double), 4) AS intercept FROM lineitem GROUP BY l_returnflag")
def ols_fit(spark, d):
    fit = statistics.least_squares(spark.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return fit.select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("""WITH r AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS y FROM part)
SELECT p_brand, round(corr(x::double, y::double), 9) AS rho FROM r GROUP BY p_brand""")
def spearman(spark, d):
    return statistics.spearman(spark.read.parquet(f"{d}/part.parquet"), "p_size", "p_retailprice", "p_partkey", ["p_brand"])


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(value) FILTER (r = floor(0.5 * (n - 1))) AS p50, max(value) FILTER (r = floor(0.95 * (n - 1))) AS p95, max(value) FILTER (r = ceil(0.95 * n) - 1) AS q95 FROM r GROUP BY event_type""")
def percentile_floor(spark, d):
    return statistics.percentiles(spark.read.parquet(f"{d}/events.parquet"), "value", "event_type")


@query("""WITH x AS (SELECT unnest(range(0, 64)) AS dim, unnest(embedding)::double AS v FROM embeddings), s AS (SELECT dim, round(var_pop(v), 12) AS variance FROM x GROUP BY dim)
SELECT dim::int AS dim, variance, (row_number() OVER (ORDER BY variance DESC, dim))::int AS place FROM s""")
def variance_order(spark, d):
    return statistics.variance_order(spark.read.parquet(f"{d}/embeddings.parquet"), "embedding")


@query(top_sql(EQ, K, L2_INT, 127, """, b AS (SELECT s.qid, s.id, list_sum(list_transform(list_zip(i.vec, q.qvec), lambda z: pow(greatest((z[1] >> 4 << 4) - z[2], z[2] - (z[1] >> 4 << 4) - 15, 0), 2)))::bigint AS bound
FROM support s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid) SELECT b.qid, b.id, bound, bound <= dist AS holds FROM b JOIN scored USING (qid, id)""").replace("\n, b AS", ", b AS").replace("(z[1] >> 4 << 4)", "(floor(z[1] / 16)::bigint * 16)"))
def bitplane_bound(spark, d):
    t = load(spark, d, 127)
    pairs = search.without_self(search.equality(t.queries, t.tags)).join(t.items, "id").join(t.queries.select("qid", "qvec"), "qid")
    bound = interval_gap("vec", "qvec", 4)
    return pairs.select("qid", "id", bound.alias("bound"), (bound <= l2_int("vec", "qvec")).alias("holds"))


@query(top_sql(EQ, K, L2_INT, 127))
def prefix_cascade(spark, d):
    t = load(spark, d, 127)
    return search.prefix_top(search.without_self(search.equality(t.queries, t.tags)), t.items, t.queries, K, 16, l2_int)


CLUSTERS = ", c AS (SELECT label AS cluster, min(id) AS medoid FROM items GROUP BY label), cents AS (SELECT c.cluster, i.vec AS centroid FROM c JOIN items i ON i.id = c.medoid)"


def clusters(t: Tables) -> DataFrame:
    """One cluster per label, around its row with the smallest id."""
    return t.items.groupBy(F.col("label").alias("cluster")).agg(F.min(F.struct("id", "vec"))["vec"].alias("centroid"))


@query(prelude() + CLUSTERS + """, m AS (SELECT q.cluster, i.id, list_sum(list_transform(list_zip(i.vec, q.centroid), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS dist FROM items i JOIN cents q ON q.cluster = i.label WHERE i.id NOT IN (SELECT medoid FROM c)),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dist, id) AS r FROM m) SELECT cluster, id, dist FROM r WHERE r = 1""")
def cluster_representatives(spark, d):
    t = load(spark, d)
    medoid = t.items.groupBy("label").agg(F.min("id").alias("m"))
    rows = t.items.join(clusters(t), F.col("label") == F.col("cluster")).join(medoid, "label").where("id <> m")
    return layouts.representatives(rows, l2("vec", "centroid"))


PROBES = 9


def members(t: Tables) -> DataFrame:
    return t.items.select(F.col("label").alias("cluster"), "id")


IVF = top_sql(EQ, tail="{{}}").replace("{}", "").replace("support AS (" + EQ + ")", "support AS (SELECT p.qid, t.id FROM probed p JOIN qs q ON q.qid = p.qid JOIN items i ON i.label = p.cluster JOIN tags t ON t.id = i.id AND t.tag = q.tag2 WHERE p.r <= 9 AND t.id <> p.qid)")
IVF = IVF.replace(",\nsupport AS", CLUSTERS + """, probed AS (SELECT q.qid, i.cluster, row_number() OVER (PARTITION BY q.qid ORDER BY list_sum(list_transform(list_zip(i.centroid, q.qvec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))), i.cluster) AS r FROM qs q, cents i),
support AS""") + " SELECT qid, rank, id, dist FROM ranked WHERE rank <= 10"


@query(IVF)
def ivf_topk(spark, d):
    """Members of the nearest clusters with the query's second tag. The vectors hardly cluster, so it takes 9 of 10 clusters
    to find 0.9 of the true neighbours."""
    t = load(spark, d)
    return search.top(search.without_self(graph.ivf_support(t.queries, clusters(t), members(t), t.tags, PROBES, "tag2")), t.items, t.queries, K)


@query()
def graph_topk(spark, d):
    """Approximate: beam search over the exact neighbour graph of each label's distinct vectors, both ways."""
    t = load(spark, d)
    shards = t.items.select("id", "vec", F.col("label").alias("shard"))
    return graph.search_distinct(t.queries.withColumn("shard", F.col("tag1")), shards, lambda s: graph.knn_graph(s, "shard", 16), K, 32, 6)


@query(prelude() + """, e AS (SELECT i.label AS shard, i.id AS src, q.id AS dst, list_sum(list_transform(list_zip(i.vec, q.vec), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double))) AS dist FROM items i JOIN items q ON q.label = i.label AND q.id <> i.id),
r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dist, dst) AS r FROM e) SELECT shard, src, dst FROM r WHERE r <= 16""")
def knn_graph(spark, d):
    return graph.knn_graph(load(spark, d).items, "label", 16).select("shard", "src", "dst")


from nearfield import catalog_access, catalog_audit, catalog_layouts  # noqa: E402, F401  registers its queries
