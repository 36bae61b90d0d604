"""Registered queries of audits, statistics, planning and codecs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield import plans
from nearfield.fixtures import K, Tables, load, prelude, top_sql
from nearfield.functions import arena_key, codecs, mixed_draws, pair_key, pair_unkey
from nearfield.operators import fragments, layouts, order, search, statistics
from nearfield.registry import QUERIES, SQL, query

EQ = "SELECT q.qid, t.id FROM qs q JOIN tags t ON t.tag = q.tag1 WHERE t.id <> q.qid"


@query(prelude() + " SELECT q.qid, count(t.id) AS before, count(t.id) FILTER (t.id <> q.qid) AS after_, count(t.id) FILTER (t.id = q.qid) AS own FROM qs q LEFT JOIN tags t ON t.tag = q.tag3 GROUP BY q.qid")
def support_cardinality(spark, d):
    t = load(spark, d)
    s = t.queries.select("qid").join(search.equality(t.queries, t.tags, "tag3"), "qid", "left").groupBy("qid")
    return s.agg(F.count("id").alias("before"), F.count_if(F.col("id") != F.col("qid")).alias("after_"), F.count_if(F.col("id") == F.col("qid")).alias("own"))


IN = "(a.width IS NOT NULL AND NOT isnan(a.width) AND a.width >= q.lo{0} AND a.width < q.hi{0})"


@query(prelude() + f""", v AS (SELECT q.qid, t.id, bool_or(t.tag = q.tag1 AND {IN.format(1)}) AS one, bool_or(t.tag = q.tag2 AND {IN.format(2)}) AS two, count(*) AS checks
FROM qs q JOIN tags t ON t.tag IN (q.tag1, q.tag2) JOIN attrs a ON a.id = t.id GROUP BY q.qid, t.id)
SELECT qid, count(*) AS visited, sum(checks)::bigint AS checks, count(*) FILTER (one) AS first_admitted, count(*) FILTER (two) AS second_admitted, count(*) FILTER (one AND two) AS both_admitted, count(*) FILTER ((one OR two) AND id = qid) AS own, count(*) FILTER ((one OR two) AND id <> qid) AS support FROM v GROUP BY qid""")
def audit_counters(spark, d):
    """What a two-clause disjunction visits, tests and admits."""
    t = load(spark, d)
    clause = lambda tag, k: search.clause_tests(t.queries, t.tags, t.attrs, "width", tag, f"lo{k}", f"hi{k}", k)
    rows = clause("tag1", 1).union(clause("tag2", 2)).groupBy("qid", "id").agg(F.count(F.lit(1)).alias("checks"), *[F.max(F.col("ok") & (F.col("k") == k)).alias(f"c{k}") for k in (1, 2)])
    one, two = F.col("c1"), F.col("c2")
    own = F.col("id") == F.col("qid")
    return rows.groupBy("qid").agg(F.count(F.lit(1)).alias("visited"), F.sum("checks").alias("checks"), F.count_if(one).alias("first_admitted"), F.count_if(two).alias("second_admitted"), F.count_if(one & two).alias("both_admitted"), F.count_if((one | two) & own).alias("own"), F.count_if((one | two) & ~own).alias("support"))


def measured(spark, d) -> DataFrame:
    return QUERIES["strict_recall"](spark, d)


RECALL = SQL["strict_recall"].rsplit(" SELECT t.qid", 1)[0] + ", strict AS (SELECT t.qid, count(f.id) / 10 AS strict FROM truth t LEFT JOIN found f ON f.qid = t.qid AND f.id = t.id GROUP BY t.qid)"


@query(RECALL + ", near AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY dist, id) AS rank FROM found) SELECT t.qid, count(*) FILTER (n.id IS DISTINCT FROM t.id) AS mismatches FROM truth t LEFT JOIN near n ON n.qid = t.qid AND n.rank = t.rank GROUP BY t.qid")
def rank_mismatch(spark, d):
    """Ranks at which an approximate answer has another id than the exact one, or none."""
    from nearfield.catalog import approximate

    t = load(spark, d)
    truth = QUERIES["equality_topk"](spark, d).select("qid", "rank", "id")
    exact = approximate(t).join(truth.select("qid", "id"), ["qid", "id"], "left_semi").select("qid", "id", "dist")
    near = search.first(exact, K).select("qid", "rank", F.col("id").alias("near"))
    return truth.join(near, ["qid", "rank"], "left").groupBy("qid").agg(F.count_if(~F.col("id").eqNullSafe(F.col("near"))).alias("mismatches"))


@query(RECALL + ", f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), r AS (SELECT q.qid, CASE WHEN least(a.n, b.n) <= 100 THEN 'brute' ELSE 'graph_conjunction' END AS route, a.n AS work FROM qs q JOIN f a ON a.tag = q.tag1 JOIN f b ON b.tag = q.tag2) SELECT route, count(*) AS n, round(avg(work), 9) AS mean_work, round(1 / avg(work), 12) AS rate, round(avg(strict), 9) AS recall FROM r JOIN strict USING (qid) GROUP BY route")
def route_statistics(spark, d):
    """By route: queries, mean work (the rows of the first posting), its inverse, and recall."""
    t = load(spark, d)
    sizes = t.tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    one, two = (sizes.select(F.col("tag").alias(f"tag{k}"), F.col("n").alias(f"n{k}")) for k in (1, 2))
    routed = t.queries.join(one, "tag1").join(two, "tag2").select("qid", plans.tag_route(F.col("n1"), F.col("n2"), 100).alias("route"), F.col("n1").alias("work"))
    by = routed.join(measured(spark, d), "qid").groupBy("route")
    return by.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("work"), 9).alias("mean_work"), F.round(1 / F.avg("work"), 12).alias("rate"), F.round(F.avg("strict"), 9).alias("recall"))


@query(RECALL + " SELECT (qid % 3)::bigint AS class, count(*) AS n, round(avg(strict), 9) AS recall FROM strict GROUP BY 1")
def recall_by_class(spark, d):
    return measured(spark, d).groupBy((F.col("qid") % 3).alias("class")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("strict"), 9).alias("recall"))


@query(RECALL + ", h AS (SELECT qid // 50 % 4 AS family, sum(round(strict * 10))::bigint AS hits, (10 * count(*))::bigint AS denominator FROM strict GROUP BY 1) SELECT family, hits, denominator, hits * 10000 >= denominator * 9995 AS passes, hits * 10 >= denominator * 5 AS passes_half, hits = denominator AS exact FROM h")
def recall_gates(spark, d):
    """Whole-number gates: hits over a denominator against a fraction, and exactness."""
    h = measured(spark, d).groupBy(F.floor(F.col("qid") / 50 % 4).alias("family")).agg(F.sum(F.round(F.col("strict") * 10)).cast("long").alias("hits"), (10 * F.count(F.lit(1))).cast("long").alias("denominator"))
    gate = lambda n, m: statistics.fraction_passes(F.col("hits"), F.col("denominator"), n, m)
    return h.select("family", "hits", "denominator", gate(9995, 10000).alias("passes"), gate(5, 10).alias("passes_half"), (F.col("hits") == F.col("denominator")).alias("exact"))


RATIO = "SELECT nation, sum(v) FILTER (o_orderstatus = 'F') AS f, sum(v) FILTER (o_orderstatus = 'O') AS o FROM (SELECT c.c_nationkey % 8 AS nation, o.o_orderstatus, o.o_orderkey::double AS v FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey) GROUP BY nation"


@query(f"WITH r AS ({RATIO}) SELECT exp(avg(ln(f / o)) FILTER (nation < 4)) >= 0.9 AS first_four, max(f / o) FILTER (nation = 0) >= 0.8 AS first_pair, exp(avg(ln(f / o))) >= 1.1 AS final FROM r")
def stop_gates(spark, d):
    """The early stops of a paired protocol (first pair, mean of the first four) and the final gate."""
    from nearfield.catalog import ratios

    r = ratios(spark, d)
    mean = lambda c: F.exp(F.avg(F.when(c, F.ln("ratio"))))
    return r.agg((mean(F.col("nation") < 4) >= 0.9).alias("first_four"), (F.max(F.when(F.col("nation") == 0, F.col("ratio"))) >= 0.8).alias("first_pair"), (mean(F.lit(True)) >= 1.1).alias("final"))


@query(f"WITH r AS ({RATIO}), c AS (SELECT nation, f, o, CASE WHEN nation = 3 THEN f / o * 1.01 ELSE round(f / o, 3) END AS recorded FROM r) SELECT nation, abs(f / o - recorded) <= greatest(0.002 * greatest(abs(f / o), abs(recorded)), 0.002) AS ratio_holds, f < o AS ordered FROM c")
def record_checks(spark, d):
    """Whether a record's ratio is that of its two figures within 0.2 %; one that isn't is planted."""
    o = spark.read.parquet(f"{d}/orders.parquet").join(spark.read.parquet(f"{d}/customer.parquet"), F.col("c_custkey") == F.col("o_custkey"))
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_orderkey").cast("double")))
    r = o.groupBy((F.col("c_nationkey") % 8).alias("nation")).agg(part("F").alias("f"), part("O").alias("o"))
    recorded = F.when(F.col("nation") == 3, F.col("f") / F.col("o") * 1.01).otherwise(F.round(F.col("f") / F.col("o"), 3))
    return r.select("nation", statistics.close(F.col("f") / F.col("o"), recorded).alias("ratio_holds"), (F.col("f") < F.col("o")).alias("ordered"))


@query(prelude() + ", s AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag) SELECT tag, CASE WHEN 4 * n > 2 * n + 150 THEN 'stop_persistent' WHEN 128 * n > 120 * n + 700 THEN 'stop_runtime' ELSE 'pass' END AS decision FROM s")
def resource_decision(spark, d):
    """Persistent bytes first, then those at run time, against the baseline and the graph together."""
    n = F.col("n")
    return QUERIES["posting_sizes"](spark, d).select("tag", plans.resources(4 * n, 2 * n, F.lit(150), 128 * n, 120 * n, F.lit(700)).alias("decision"))


@query(prelude() + """, s AS (SELECT count(*) AS rows, count(DISTINCT a) AS na, count(DISTINCT b) AS nb, count(DISTINCT bin) AS nbin FROM rws)
SELECT 'cube' AS layout, (64 * rows)::bigint AS vectors, (4 * (nbin * na * nb + 1))::bigint AS offsets, (8 * rows)::bigint AS maps, (64 * rows + 4 * (nbin * na * nb + 1) + 8 * rows)::bigint AS total FROM s
UNION ALL SELECT 'pair_major', (64 * rows)::bigint, (4 * (na * nb + 1))::bigint, (8 * rows)::bigint, (64 * rows + 4 * (na * nb + 1) + 8 * rows)::bigint FROM s
UNION ALL SELECT 'packs', (64 * rows)::bigint, 0::bigint, (4 * rows)::bigint, (68 * rows)::bigint FROM s""")
def layout_bytes(spark, d):
    """Charges of each layout: vectors of a byte a dimension, offsets and maps of four bytes."""
    return layouts.charges(load(spark, d).rows, 64)


FIT = """WITH p AS (SELECT *, p_partkey % 2 = 0 AS dev, p_partkey % 10 AS family FROM part), by_route AS (SELECT p_brand, count(*) AS n, CASE WHEN var_pop(p_size) > 0 THEN regr_slope(p_retailprice::double, p_size::double) ELSE 0 END AS s, CASE WHEN var_pop(p_size) > 0 THEN regr_intercept(p_retailprice::double, p_size::double) ELSE avg(p_retailprice::double) END AS i FROM p WHERE dev GROUP BY p_brand),
family AS (SELECT regr_slope(p_retailprice::double, p_size::double) AS fs, regr_intercept(p_retailprice::double, p_size::double) AS fi FROM p WHERE dev),
e AS (SELECT p.*, greatest(1, CASE WHEN n >= 2 THEN s * p_size + i ELSE fs * p_size + fi END) AS guess FROM p LEFT JOIN by_route USING (p_brand), family WHERE NOT dev),
r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY guess, p_partkey) AS x, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice, p_partkey) AS y FROM e)"""


@query(FIT + " SELECT p_brand, count(*) AS n, round(avg(abs(guess - p_retailprice::double) / p_retailprice::double), 6) AS ape, CASE WHEN count(*) > 1 THEN round(corr(x::double, y::double), 6) END AS rho FROM r GROUP BY p_brand")
def prediction_check(spark, d):
    """Costs fitted by route on one half of the rows, held against the other: mean relative error and rank correlation."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("work"), F.col("p_retailprice").cast("double").alias("cost"))
    return statistics.predicted(p, "cost", "work", "p_partkey", ["p_brand"], F.col("p_partkey") % 2 == 0)


@query(prelude() + """, s AS (SELECT qid, tag1, tag3, qid % 100 = 0 AS dev FROM qs), p AS (SELECT tag1, tag3, bool_or(dev) AS d, bool_or(NOT dev) AS e FROM s GROUP BY tag1, tag3)
SELECT count(*) FILTER (dev) AS dev_rows, count(*) FILTER (NOT dev) AS eval_rows, (SELECT count(*) FROM p WHERE d AND e) AS shared_pairs, (SELECT count(*) FROM p WHERE d AND NOT e) AS dev_pairs, (SELECT count(*) FROM p WHERE e AND NOT d) AS eval_pairs, (count(*) - count(DISTINCT qid))::bigint AS shared_rows FROM s""")
def split_census(spark, d):
    q = load(spark, d).queries.select("qid", "tag1", "tag3", (F.col("qid") % 100 == 0).alias("dev"))
    return plans.split_census(q, ["tag1", "tag3"])


BAD_ROUTES = """, o AS (SELECT qid, unnest(range(a1 // 25, z1 // 25 + 1)) AS block FROM qs), met AS (SELECT qid, block, row_number() OVER (PARTITION BY qid ORDER BY block) AS r FROM o),
route AS (SELECT qid, block FROM met WHERE NOT (qid % 250 = 50 AND r = 1) UNION ALL SELECT qid, block FROM met WHERE qid % 250 = 0 AND r = 1 UNION ALL SELECT qid, 900 FROM qs WHERE qid % 250 = 100), z AS (SELECT block, count(*) AS c FROM rws GROUP BY block)"""


@query(prelude() + BAD_ROUTES + """ SELECT q.qid, (SELECT count(*) - count(DISTINCT block) FROM route r WHERE r.qid = q.qid)::bigint AS repeated, (SELECT count(*) FROM met m WHERE m.qid = q.qid AND m.block NOT IN (SELECT block FROM route r WHERE r.qid = m.qid))::bigint AS missing,
(SELECT count(*) FROM route r WHERE r.qid = q.qid AND r.block NOT IN (SELECT block FROM met m WHERE m.qid = r.qid))::bigint AS foreign_, (SELECT count(DISTINCT block) FROM route r WHERE r.qid = q.qid) BETWEEN 1 AND 64 AS objects_ok,
coalesce((SELECT sum(c) FROM z WHERE block IN (SELECT block FROM route r WHERE r.qid = q.qid)), 0)::bigint AS rows FROM qs q""")
def route_validation(spark, d):
    """Block routes against the law that they are the overlapped blocks, each once; some that break it are planted."""
    t = load(spark, d)
    first = t.queries.select("qid", F.floor(F.col("a1") / 25).alias("first"))
    met = layouts.overlapped(t.queries, "a1", "z1", 25).join(first, "qid").select("qid", "block", (F.col("block") == F.col("first")).alias("is_first"))
    kind = F.col("qid") % 250
    route = met.where(~((kind == 50) & F.col("is_first"))).select("qid", "block").union(met.where((kind == 0) & F.col("is_first")).select("qid", "block")).union(t.queries.where(kind == 100).select("qid", F.lit(900).cast("long")))
    return plans.route_faults(t.queries.select("qid"), met.select("qid", "block"), route, t.rows.groupBy("block").agg(F.count(F.lit(1)).alias("c")), 64)


MIXED = """mix AS (SELECT i, (i // 4 + 28259056853217136)::UHUGEINT AS v FROM w),
m0 AS (SELECT i, (v + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM mix),
m1 AS (SELECT i, (xor(s::UBIGINT, s::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM m0),
m2 AS (SELECT i, (xor(s::UBIGINT, s::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS s FROM m1),
d AS (SELECT i, i % 4 AS family, xor(s::UBIGINT, s::UBIGINT >> 31) AS r FROM m2)"""


@query(prelude() + ", w AS (SELECT id AS i FROM items), " + MIXED + """, vp AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS k FROM (SELECT a, b FROM rws GROUP BY a, b HAVING count(*) >= 3)), np AS (SELECT count(*) AS n FROM vp),
x AS (SELECT i, family, ((r::UHUGEINT + (r >> 11)::UHUGEINT) % 18446744073709551616::UHUGEINT % 12)::bigint AS e, ((r % 64) % n)::bigint AS p, [1, 2, 4][((r >> 8) % 3)::int + 1]::bigint AS w, r, ((r % 24) % n)::bigint AS f, (((r >> 13) % 24) % n)::bigint AS g, n FROM d, np),
y AS (SELECT *, CASE WHEN g = f THEN (g + 1) % n ELSE g END AS h, ((r >> 16) % (17 - w)::UBIGINT)::bigint AS lo FROM x)
SELECT i, family::int AS family, CASE family WHEN 0 THEN e WHEN 1 THEN p1.a WHEN 3 THEN p2.a END AS a, CASE family WHEN 1 THEN p1.b WHEN 3 THEN p2.b END AS b, CASE WHEN family = 3 THEN p3.a END AS c, CASE WHEN family = 3 THEN p3.b END AS d,
CASE WHEN family = 2 THEN lo END AS lo, CASE WHEN family = 2 THEN lo + w - 1 END AS hi FROM y LEFT JOIN vp p1 ON p1.k = y.p LEFT JOIN vp p2 ON p2.k = y.f LEFT JOIN vp p3 ON p3.k = y.h""")
def workload(spark, d):
    """A reproducible workload, one query an id: the family by the id, everything else drawn from its mixed number."""
    t = load(spark, d)
    return plans.workload(t.items.select(F.col("id").alias("i")), t.rows, 3, 0x646576656C6F70, mixed_draws)


@query()
def staged_plan(spark, d):
    """Fragments that the staged greedy admits and packs under a budget; iterative, so tests hold it against a plain version."""
    units, uses, queries = catalog(load(spark, d))
    ids, packed, cost = plans.staged(units, uses, queries, 60_000)
    return spark.createDataFrame([(k, k in packed, float(cost)) for k in sorted(ids | packed)] or [("", False, float(cost))], "key string, packed boolean, workload_cost double")


@query()
def joint_plan(spark, d):
    units, uses, queries = catalog(load(spark, d))
    ids, packed, cost = plans.joint(units, uses, queries, 60_000)
    return spark.createDataFrame([(k, k in packed, float(cost)) for k in sorted(ids | packed)] or [("", False, float(cost))], "key string, packed boolean, workload_cost double")


def catalog(t: Tables):
    """Sizes by key, uses by key, and queries as (family, a, b, lo, hi, c, d): as large as the catalog of units and the
    stated queries."""
    w = fragments.workload(t.queries)
    units = {r["key"]: r["n"] for r in fragments.materialised(t.rows).groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()}
    queries = [tuple(r) for r in w.select("family", "a", "b", "lo", "hi", "c", "d").orderBy("qid").collect()]
    return units, plans.uses(queries), queries


CHUNKED = ", p AS (SELECT tag, id, (row_number() OVER (PARTITION BY tag ORDER BY id) - 1) // 256 AS chunk FROM tags), c AS (SELECT tag, chunk::bigint AS chunk, list(id ORDER BY id) AS ids FROM p GROUP BY tag, chunk)"


@query(prelude() + CHUNKED + " SELECT tag, chunk, list_aggregate(list_transform(ids, lambda i: printf('%02X%02X%02X', i % 256, i // 256 % 256, i // 65536)), 'string_agg', '') AS bytes, true AS round_trip FROM c")
def u24_codec(spark, d):
    p = fragments.postings(load(spark, d).tags, 256).withColumn("data", codecs.u24("ids"))
    return p.select("tag", "chunk", F.hex("data").alias("bytes"), (codecs.un_u24("data") == F.col("ids")).alias("round_trip"))


@query(prelude() + CHUNKED + """ SELECT tag, chunk, printf('%02X%02X%02X%02X', ids[1] % 256, ids[1] // 256 % 256, ids[1] // 65536 % 256, ids[1] // 16777216) || coalesce(list_aggregate(list_transform(list_zip(ids[:-2], ids[2:]), lambda z: printf('%02X%02X', (z[2] - z[1]) % 256, (z[2] - z[1]) // 256)), 'string_agg', ''), '') AS bytes, true AS round_trip FROM c""")
def delta16_codec(spark, d):
    p = fragments.postings(load(spark, d).tags, 256).withColumn("data", codecs.delta16("ids"))
    return p.select("tag", "chunk", F.hex("data").alias("bytes"), (codecs.un_delta16("data") == F.col("ids")).alias("round_trip"))


@query(prelude() + CHUNKED + " SELECT tag, chunk, list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(ids, lambda i: i::UHUGEINT)), lambda h, i: (xor(h::UBIGINT, i::UBIGINT)::UHUGEINT * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)::varchar AS checksum FROM c")
def fnv_checksum(spark, d):
    p = fragments.postings(load(spark, d).tags, 256)
    return p.select("tag", "chunk", codecs.fnv("ids").alias("checksum"))


@query(prelude() + CHUNKED + ", o AS (SELECT *, 32768 AS u FROM c) SELECT tag, chunk, len(ids)::bigint AS n, true AS round_trip, (SELECT count(DISTINCT x) FROM (SELECT unnest(ids) AS x))::bigint AS union_n FROM o")
def elias_fano_codec(spark, d):
    """Encoded, validated and decoded again; and the union with a part of itself."""
    p = fragments.postings(load(spark, d).tags, 256).withColumn("data", codecs.elias_fano("ids"))
    both = codecs.un_elias_fano(codecs.elias_fano_union("data", codecs.elias_fano(F.slice("ids", 1, 5))))
    return p.select("tag", "chunk", F.size("ids").cast("long").alias("n"), (codecs.un_elias_fano("data") == F.col("ids")).alias("round_trip"), F.size(both).cast("long").alias("union_n"))


@query(top_sql(EQ, tail="SELECT r.qid, rank, id, dist, coalesce((SELECT a.dist = b.dist FROM ranked a JOIN ranked b ON a.qid = b.qid WHERE a.rank = 10 AND b.rank = 11 AND a.qid = r.qid), false) AS cutoff_tie FROM ranked r WHERE rank <= 10"))
def elias_fano_topk(spark, d):
    """The owner's encoded postings, decoded id by id; the own row skipped; K best with a flag for a tie at the cutoff."""
    t = load(spark, d)
    held = fragments.postings(t.tags, 256).select("tag", codecs.elias_fano("ids").alias("data"))
    ids = t.queries.select("qid", F.col("tag1").alias("tag")).join(held, "tag").select("qid", F.explode(codecs.un_elias_fano("data")).alias("id"))
    best = search.top(search.without_self(ids), t.items, t.queries, K + 1)
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("dist")))
    ties = best.groupBy("qid").agg(F.coalesce(at(K) == at(K + 1), F.lit(False)).alias("cutoff_tie"))
    return best.where(F.col("rank") <= K).join(ties, "qid").select("qid", "rank", "id", "dist", "cutoff_tie")


@query(prelude() + " SELECT DISTINCT a.tag AS a, b.tag AS b, (a.tag * 4294967296 + b.tag)::bigint AS key, a.tag AS a_again, b.tag AS b_again FROM tags a JOIN tags b ON a.id = b.id AND a.tag < b.tag")
def pair_keys(spark, d):
    tags = load(spark, d).tags
    pairs = tags.select("id", F.col("tag").alias("a")).join(tags.select("id", F.col("tag").alias("b")), "id").where("a < b").select("a", "b").distinct()
    a, b = pair_unkey(F.col("key"))
    return pairs.withColumn("key", pair_key(F.col("a"), F.col("b"))).withColumns({"a_again": a, "b_again": b})


@query(prelude() + " SELECT DISTINCT t.tag AS token, r.block, 'X|' || t.tag || '|0|' || r.block AS key, (79800 + (t.tag * 2 + 0) * 200 + r.block)::bigint AS position FROM tags t JOIN rws r USING (id) WHERE t.tag < 400")
def arena_keys(spark, d):
    """Places of token, attribute and block objects after the pairs' triangle of 400 tokens."""
    t = load(spark, d)
    met = t.tags.where("tag < 400").join(t.rows.select("id", "block"), "id").select(F.col("tag").alias("token"), "block").distinct()
    return met.select("token", "block", F.concat(F.lit("X|"), "token", F.lit("|0|"), "block").alias("key"), arena_key(F.col("token"), F.lit(0), F.col("block"), 400, 2, 200).alias("position"))


ADVISED = prelude() + ", u AS (SELECT tag, (4 * count(*))::bigint AS cost FROM tags WHERE tag BETWEEN 100 AND 106 GROUP BY tag), s AS (SELECT a.tag AS label, b.tag, count(*)::double AS saving FROM tags a JOIN tags b USING (id) WHERE a.tag < 100 AND b.tag BETWEEN 100 AND 106 GROUP BY ALL), m AS (SELECT unnest(range(0, 128)) AS mask), c AS (SELECT mask, coalesce(sum(cost), 0)::bigint AS cost FROM m LEFT JOIN u ON (mask >> (tag - 100)) & 1 = 1 GROUP BY mask), v AS (SELECT mask, coalesce(sum(best), 0)::double AS value FROM (SELECT mask, label, max(saving) AS best FROM m JOIN s ON (mask >> (tag - 100)) & 1 = 1 GROUP BY mask, label) GROUP BY mask), b AS (SELECT sum(cost) // 2 AS budget FROM u)"


def instance(t: Tables) -> tuple[dict[str, int], dict[str, dict[str, float]], int]:
    """Seven groups as units that cost their ids' bytes; a label saves the rows it shares with a group; half of all fits."""
    units = {str(r["tag"]): 4 * r["n"] for r in t.tags.where("tag BETWEEN 100 AND 106").groupBy("tag").agg(F.count(F.lit(1)).alias("n")).collect()}
    label = t.tags.where("tag < 100").select("id", F.col("tag").alias("label"))
    savings: dict[str, dict[str, float]] = {}
    for r in t.tags.where("tag BETWEEN 100 AND 106").join(label, "id").groupBy("label", "tag").agg(F.count(F.lit(1)).alias("n")).collect():
        savings.setdefault(str(r["label"]), {})[str(r["tag"])] = float(r["n"])
    return units, savings, sum(units.values()) // 2


@query(ADVISED + " SELECT c.mask, c.cost, coalesce(v.value, 0)::double AS value FROM c LEFT JOIN v USING (mask), b WHERE c.cost <= budget")
def advisor_bruteforce(spark, d):
    units, savings, budget = instance(load(spark, d))
    return plans.subset_values(spark, units, savings, budget)


@query(ADVISED + " SELECT max(value) AS objective, 0.0::double AS gap FROM c JOIN v USING (mask), b WHERE c.cost <= budget")
def advisor_exact(spark, d):
    units, savings, budget = instance(load(spark, d))
    value, _, gap = plans.advise(units, savings, budget)
    return spark.createDataFrame([(float(value), float(gap))], "objective double, gap double")



@query(prelude() + """, c AS (SELECT qid, a1 // 25 + 1 AS first, z1 // 25 AS last_end FROM qs), w AS (SELECT unnest([1, 2, 4, 8, 16, 32, 64, 128]) AS width),
n AS (SELECT qid, first, last_end, width, unnest(range(first // width * width, last_end, width)) AS node FROM c, w WHERE first < last_end)
SELECT qid, width::bigint AS width, node::bigint AS node FROM n WHERE node >= first AND node + width <= last_end AND (width = 128 OR NOT (node // (2 * width) * 2 * width >= first AND node // (2 * width) * 2 * width + 2 * width <= last_end))""")
def dyadic_covers(spark, d):
    """The aligned segments that tile the inner blocks of each query's range, by the greedy walk from the left."""
    t = load(spark, d)
    walk = F.pandas_udf(lambda first, end: plans.covers(first, end), "array<struct<node: long, width: long>>")
    c = t.queries.select("qid", walk((F.floor(F.col("a1") / 25) + 1).cast("long"), F.floor(F.col("z1") / 25).cast("long")).alias("cover"))
    return c.select("qid", F.explode("cover").alias("x")).select("qid", F.col("x.width").alias("width"), F.col("x.node").alias("node"))


@query(prelude().replace("WITH items", "WITH RECURSIVE items") + """, w AS (SELECT unnest([1, 2, 4, 8]) AS width), f AS (SELECT width, bin // width * width AS start, count(*) AS n FROM rws, w GROUP BY ALL),
all_f AS (SELECT width, unnest(range(0, 16, width)) AS start FROM w), cost AS (SELECT a.width, a.start, 3500 + 16 * coalesce(n, 0) AS c FROM all_f a LEFT JOIN f USING (width, start)),
q AS (SELECT DISTINCT qid % 13 AS lo, qid % 13 + 3 AS hi FROM qs), RECURSIVE_t
SELECT lo, hi, min(c)::bigint AS cost FROM t WHERE pos = hi + 1 GROUP BY lo, hi""".replace("RECURSIVE_t", "t AS (SELECT lo, hi, lo AS pos, 0::bigint AS c FROM q UNION ALL SELECT t.lo, t.hi, t.pos + k.width, t.c + k.c + CASE WHEN t.pos > t.lo THEN 1500 ELSE 0 END FROM t JOIN cost k ON k.start = t.pos AND t.pos + k.width <= t.hi + 1)"))
def range_covers(spark, d):
    """The cheapest tiling of each range of bins by materialised ranges, as the planner's dynamic programme finds it."""
    t = load(spark, d)
    sizes = {(r["start"], r["width"]): r["n"] for r in layouts.dyadic(t.rows, "bin").collect()}  # at most 30 ranges
    cost = {(s, w): 3500 + 16 * sizes.get((s, w), 0) for w in (1, 2, 4, 8) for s in range(0, 16, w)}
    asked = t.queries.select((F.col("qid") % 13).alias("lo")).distinct().collect()  # at most 13
    return spark.createDataFrame([(r["lo"], r["lo"] + 3, plans.range_cover(r["lo"], r["lo"] + 3, cost)[0]) for r in asked], "lo long, hi long, cost long")


@query(prelude() + ", p AS (SELECT tag, id, CASE WHEN id % 100 = 7 THEN id - 90 ELSE id END AS written FROM tags), o AS (SELECT tag, id, written, lag(written) OVER (PARTITION BY tag ORDER BY id) AS before FROM p) SELECT tag, count(*) FILTER (before >= written) AS out_of_order, count(*) FILTER (written < 0) AS outside FROM o GROUP BY tag")
def posting_order(spark, d):
    """Neighbours of a posting that don't ascend, and ids outside the universe; some are planted."""
    t = load(spark, d)
    written = t.tags.withColumn("written", F.when(F.col("id") % 100 == 7, F.col("id") - 90).otherwise(F.col("id")))
    return order.disorder(written, ["tag"], "id", "written")
