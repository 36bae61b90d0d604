"""Registered queries of layouts, fragments, labels and packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.fixtures import K, L2, Tables, load, prelude, top_sql
from nearfield.functions import bins_of, mix64_mod
from nearfield.operators import fragments, layouts, order, search
from nearfield.registry import query

def rows_of() -> Column:
    return F.count(F.lit(1))


@query(prelude() + ", p AS (SELECT tag, id, (row_number() OVER (PARTITION BY tag ORDER BY id) - 1) // 256 AS chunk FROM tags) SELECT tag, chunk::bigint AS chunk, count(*) AS n, string_agg(id::varchar, ',' ORDER BY id) AS ids FROM p GROUP BY tag, chunk")
def postings(spark, d):
    """Rows to tags turned into tags to rows, in chunks of 256 ids, so that a tag of any size is many rows."""
    p = fragments.postings(load(spark, d).tags, 256)
    return p.select("tag", "chunk", F.size("ids").cast("long").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


@query(prelude() + ", s AS (SELECT block, count(*) AS n FROM rws GROUP BY block) SELECT block, n, coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first FROM s")
def block_offsets(spark, d):
    return layouts.cell_offsets(load(spark, d).rows, ["block"])


CELLS = ", s AS (SELECT bin, a, b, count(*) AS n FROM rws GROUP BY bin, a, b), o AS (SELECT *, coalesce(sum(n) OVER (ORDER BY bin, a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS first FROM s), w AS (SELECT qid, tag1 AS qa, qid % 4 AS qb, qid % 13 AS lo, qid % 13 + 3 AS hi FROM qs)"


@query(prelude() + CELLS + """ SELECT qid, 'range' AS kind, min(first) AS first, sum(n)::bigint AS n FROM w JOIN o ON bin BETWEEN lo AND hi GROUP BY qid
UNION ALL SELECT qid, 'a', min(first), sum(n)::bigint FROM w JOIN o ON bin BETWEEN lo AND hi AND a = qa GROUP BY qid, bin
UNION ALL SELECT qid, 'cell', first, n FROM w JOIN o ON bin BETWEEN lo AND hi AND a = qa AND b = qb""")
def cube_slices(spark, d):
    """Which stretches of the cube a range of bins needs: one in all, one a bin with the first label, one a cell with both."""
    t = load(spark, d)
    w = t.queries.select("qid", F.col("tag1").alias("qa"), (F.col("qid") % 4).alias("qb"), F.explode(F.sequence(F.col("qid") % 13, F.col("qid") % 13 + 3)).alias("bin"))
    return layouts.slices(w, layouts.cell_offsets(t.rows, ["bin", "a", "b"]))


@query(prelude() + ", p AS (SELECT id, row_number() OVER (ORDER BY bin, a, b, id) - 1 AS position FROM rws) SELECT t.tag, t.id, p.position, (row_number() OVER (PARTITION BY t.tag ORDER BY p.position) - 1)::bigint AS nth FROM tags t JOIN p USING (id)")
def posting_positions(spark, d):
    """Each tag's ids as places in the cube's order, in that order."""
    t = load(spark, d)
    placed = t.tags.join(layouts.layout(t.rows, ["bin", "a", "b"]).select("id", "position"), "id")
    return order.id_ranks(placed, ["tag"], "position", "nth").select("tag", "id", "position", "nth")


PAIR = ", v AS (SELECT a.tag AS a, b.tag AS b, count(*) AS n FROM tags a JOIN tags b ON a.id = b.id AND a.tag < 100 AND b.tag BETWEEN 100 AND 199 GROUP BY a.tag, b.tag HAVING count(*) >= 3)"


@query(prelude() + PAIR + """, f AS (SELECT tag, id, row_number() OVER (PARTITION BY tag ORDER BY id) - 1 AS place, count(*) OVER (PARTITION BY tag) AS n FROM tags)
SELECT 'C|' || v.a || '|' || v.b AS key, x.id, (CASE WHEN x.n < y.n OR (x.n = y.n AND v.a < v.b) THEN x.place ELSE y.place END)::bigint AS offset_in_primary FROM v JOIN f x ON x.tag = v.a JOIN f y ON y.tag = v.b AND y.id = x.id""")
def pair_fragments(spark, d):
    """Materialised intersections of the pairs in the vocabulary, with the place of each id in the smaller posting."""
    tags = load(spark, d).tags
    return fragments.pairs(tags, fragments.vocabulary(tags, 3))


@query(prelude() + " SELECT tag, (row_number() OVER (PARTITION BY tag ORDER BY i.id) - 1)::bigint AS place, i.id, i.vec[1]::double AS x0, i.vec[64]::double AS x63 FROM tags t JOIN items i USING (id) WHERE tag BETWEEN 200 AND 209")
def vector_packs(spark, d):
    """Copies of the vectors of each tag of the vocabulary in the order of its posting."""
    t = load(spark, d)
    packs = fragments.packs(t.tags.join(fragments.frozen(t.tags, 200, 209), "tag", "left_semi"), t.items)
    return packs.select("tag", "place", "id", F.get("vec", F.lit(0)).cast("double").alias("x0"), F.get("vec", F.lit(63)).cast("double").alias("x63"))


@query(prelude() + " SELECT DISTINCT t.tag, i.label AS cluster, u.tag AS other FROM tags t JOIN items i USING (id) JOIN tags u USING (id)")
def cluster_tags(spark, d):
    """Which tags occur among the members of a tag's cluster; a cluster without the wanted one is skipped."""
    t = load(spark, d)
    members = t.tags.join(t.items.select("id", F.col("label").alias("cluster")), "id").select("tag", "cluster", "id")
    return layouts.group_tags(members, ["tag", "cluster"], t.tags)


ADMITTED = prelude() + ", f AS (SELECT tag, count(*) AS n FROM tags GROUP BY tag), c AS (SELECT count(*) AS n FROM items), p AS (SELECT tag, f.n, 100.0 * f.n / c.n AS pct FROM f, c)"


@query(ADMITTED + " SELECT tag, n, round(pct::double, 9) AS pct FROM p WHERE pct >= 0.1 AND pct < 20 ORDER BY n DESC, tag LIMIT 12")
def shard_admission(spark, d):
    """Tags whose share of the rows is in the band, the largest first, as many as there is room for."""
    t = load(spark, d)
    return layouts.admitted(t.tags, t.items, 0.1, 20.0, 12).select("tag", "n", F.round("pct", 9).alias("pct"))


@query(prelude() + " SELECT tag, CASE WHEN count(*) * 1000 >= 400000 THEN 32 WHEN count(*) * 1000 >= 100000 THEN 24 ELSE 16 END AS degree FROM tags GROUP BY tag")
def degree_class(spark, d):
    """Degrees of graphs for a thousand times the table's rows."""
    return load(spark, d).tags.groupBy("tag").agg(layouts.degree(rows_of() * 1000).alias("degree"))


VOCABULARY = "SELECT unnest(range(200, 210)) AS tag"


@query(prelude() + f", v AS ({VOCABULARY}) SELECT tag, count(*) AS n FROM tags JOIN v USING (tag) GROUP BY tag")
def frozen_vocabulary(spark, d):
    """Only what the vocabulary lists is materialised, whatever the queries ask for."""
    tags = load(spark, d).tags
    return tags.join(fragments.frozen(tags, 200, 209), "tag", "left_semi").groupBy("tag").agg(rows_of().alias("n"))


EDGES = [float("-inf"), 1.0, 100.0, 250.0, 500.0, 900.0, float("inf")]
SIMILAR = [float("-inf"), 0.25, 0.45, 0.5, 0.55, 0.75, float("inf")]
UPPER = lambda c, edges: "CASE WHEN {0} IS NULL OR isnan({0}) THEN -1 ELSE {1} END".format(c, " + ".join(f"({c} >= {e})::int" for e in edges[1:-1]))
MIX = """mix AS (SELECT id, (id::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT AS s0 FROM items),
mix1 AS (SELECT id, (xor(s0::UBIGINT, s0::UBIGINT >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT AS s1 FROM mix),
mix2 AS (SELECT id, (xor(s1::UBIGINT, s1::UBIGINT >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT AS s2 FROM mix1),
mixed AS (SELECT id, xor(s2::UBIGINT, s2::UBIGINT >> 31) AS h FROM mix2)"""


@query(prelude() + ", " + MIX + f" SELECT r.id, ({UPPER('a.width', EDGES)})::int AS width_bin, least(r.attr * 16 // 5000, 15)::int AS attr_bin, (m.h % 32)::bigint AS hashed FROM rws r JOIN attrs a USING (id) JOIN mixed m USING (id)")
def labels(spark, d):
    """Bins by edges (a value on an edge is in the upper bin, invalid ones in none), by equal parts, and by a mixed hash."""
    t = load(spark, d)
    rows = t.rows.join(t.attrs, "id")
    return rows.select("id", bins_of(F.col("width"), EDGES).alias("width_bin"), F.least(F.floor(F.col("attr") * 16 / 5000), F.lit(15)).cast("int").alias("attr_bin"), mix64_mod("id", 32).alias("hashed"))


TOKENS, BINS = 400, (len(SIMILAR) - 1, len(EDGES) - 1)
CROSS = f"""b AS (SELECT id, {UPPER('similarity', SIMILAR)} AS b0, {UPPER('width', EDGES)} AS b1 FROM attrs),
x AS (SELECT t.id, {TOKENS} + t.tag * {sum(BINS)} + b0 AS label FROM tags t JOIN b USING (id) WHERE b0 >= 0 UNION ALL SELECT t.id, {TOKENS} + t.tag * {sum(BINS)} + {BINS[0]} + b1 FROM tags t JOIN b USING (id) WHERE b1 >= 0)"""


@query(prelude() + ", " + CROSS + " SELECT id, label::bigint AS label FROM x")
def cross_labels(spark, d):
    """A label for each tag and bin that a row has."""
    t = load(spark, d)
    return fragments.crossed(t.tags, binned(t), BINS, TOKENS)


def binned(t: Tables) -> DataFrame:
    return t.attrs.select("id", bins_of(F.col("similarity"), SIMILAR).alias("b0"), bins_of(F.col("width"), EDGES).alias("b1"))


@query(prelude() + ", " + CROSS + " SELECT id, tag::bigint AS label FROM tags UNION ALL SELECT id, label::bigint FROM x")
def expanded_metadata(spark, d):
    t = load(spark, d)
    return t.tags.select("id", F.col("tag").cast("long").alias("label")).union(fragments.crossed(t.tags, binned(t), BINS, TOKENS))


FAMILY = "(qid // 50 % 4)"
#: Rows that a query admits by its family: a label, two labels, a range of bins, one of two pairs.
ADMITS = f"""w AS (SELECT qid, qvec, {FAMILY} AS family, tag1 AS qa, qid % 4 AS qb, qid % 13 AS lo, qid % 13 + 3 AS hi, (tag1 + 1) % 10 AS qc, (qid + 1) % 4 AS qd FROM qs),
ok AS (SELECT w.qid, r.id FROM w JOIN rws r ON CASE family WHEN 0 THEN r.a = qa WHEN 1 THEN r.a = qa AND r.b = qb WHEN 2 THEN r.bin BETWEEN lo AND hi ELSE (r.a = qa AND r.b = qb) OR (r.a = qc AND r.b = qd) END)"""


@query(prelude() + ", " + ADMITS + " SELECT w.qid, w.family::int AS family, count(ok.id) AS n, coalesce(sum(ok.id), 0)::bigint AS ids FROM w LEFT JOIN ok USING (qid) GROUP BY w.qid, w.family")
def row_validity(spark, d):
    """Rows that a query's own test admits, whatever its family."""
    t = load(spark, d)
    w = fragments.workload(t.queries)
    found = fragments.full_scan(w, t.rows).groupBy("qid").agg(rows_of().alias("n"), F.sum("id").alias("ids"))
    return w.join(found, "qid", "left").select("qid", "family", F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("ids", F.lit(0)).cast("long").alias("ids"))


BY_FAMILY = f"""{prelude()}, {ADMITS}, scored AS (SELECT s.qid, s.id, {L2} AS dist FROM ok s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid),
ranked AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, id))::int AS rank, id, dist FROM scored)"""
BRUTE = BY_FAMILY + " SELECT qid, rank, id, dist FROM ranked WHERE rank <= 10"


@query(BRUTE)
def staged_topk(spark, d):
    """Each query's fragments by key: an atom, a pair, the dyadic cover of a range, two pairs. Each fragment gives its nearest
    K, and the parts are merged."""
    t = load(spark, d)
    w = fragments.workload(t.queries)
    asked = fragments.keys(w)
    held = fragments.materialised(t.rows)
    return search.merged(asked.join(held, "key").select("qid", "key", "id"), t.items, t.queries, K)


@query(BRUTE)
def canonical_topk(spark, d):
    """The canonical package: rows by the first label, the rest of the predicate tested on them; ranges by bins."""
    t = load(spark, d)
    w = fragments.workload(t.queries)
    return search.top(fragments.canonical(w, t.rows), t.items, t.queries, K)


@query(BRUTE)
def pair_major_topk(spark, d):
    """The pair-major package: stretches of the order by (a, b), the rest tested."""
    t = load(spark, d)
    return search.top(fragments.by_stretches(fragments.workload(t.queries), t.rows, ["a", "b"]), t.items, t.queries, K)


@query(BRUTE)
def cube_topk(spark, d):
    """The cube package: stretches of the order by (bin, a, b)."""
    t = load(spark, d)
    return search.top(fragments.by_stretches(fragments.workload(t.queries), t.rows, ["bin", "a", "b"]), t.items, t.queries, K)


@query(BY_FAMILY + ", arms AS (SELECT unnest(['full', 'layout_off', 'plan_off', 'support_off']) AS arm) SELECT arm, qid, rank, id, dist FROM ranked, arms WHERE rank <= 10")
def ablation_topk(spark, d):
    """The same answers by four plans: cube stretches with a prefix plan, no support (every row tested), no layout (posting
    gathered), no prefix plan."""
    t = load(spark, d)
    w = fragments.workload(t.queries)
    cube = fragments.by_stretches(w, t.rows, ["bin", "a", "b"])
    arms = {
        "full": search.prefix_top(cube, t.items, t.queries, K, 16),
        "support_off": search.top(fragments.full_scan(w, t.rows), t.items, t.queries, K),
        "layout_off": search.prefix_top(fragments.canonical(w, t.rows), t.items, t.queries, K, 16),
        "plan_off": search.top(cube, t.items, t.queries, K),
    }
    return search.union_of([df.select(F.lit(arm).alias("arm"), "qid", "rank", "id", "dist") for arm, df in arms.items()])


@query(BY_FAMILY + " SELECT r.qid, CASE WHEN w.family = 1 THEN 'graph' ELSE 'exact' END AS backend, rank, id, dist FROM ranked r JOIN w USING (qid) WHERE rank <= 10")
def hybrid_topk(spark, d):
    """Conjunctions go to the pair shards (a graph's stand-in), all else to exact supports."""
    t = load(spark, d)
    w = fragments.workload(t.queries).withColumn("backend", F.when(F.col("family") == 1, "graph").otherwise("exact"))
    exact = search.top(fragments.by_stretches(w.where("backend = 'exact'"), t.rows, ["bin", "a", "b"]), t.items, t.queries, K)
    shards = fragments.materialised(t.rows).where(F.col("key").startswith("P"))
    graph = search.top(fragments.keys(w.where("backend = 'graph'")).join(shards, "key").select("qid", "id"), t.items, t.queries, K)
    return search.union_of([exact, graph]).join(w.select("qid", "backend"), "qid").select("qid", "backend", "rank", "id", "dist")


@query(prelude() + PAIR + f""", want AS (SELECT q.qid, q.qvec, tag1 AS a, tag3 AS b FROM qs q SEMI JOIN v ON v.a = q.tag1 AND v.b = q.tag3),
support AS (SELECT w.qid, t.id FROM want w JOIN tags t ON t.tag = w.a JOIN tags u ON u.id = t.id AND u.tag = w.b),
scored AS (SELECT s.qid, s.id, {L2} AS dist FROM support s JOIN items i ON i.id = s.id JOIN qs q ON q.qid = s.qid),
ranked AS (SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY dist, id))::int AS rank, id, dist FROM scored) SELECT qid, rank, id, dist FROM ranked WHERE rank <= 10""")
def pair_scan_topk(spark, d):
    """Pairs of the vocabulary by their materialised posting alone."""
    t = load(spark, d)
    held = fragments.pairs(t.tags, fragments.vocabulary(t.tags, 3)).select("key", "id")
    asked = t.queries.select("qid", F.concat_ws("|", F.lit("C"), "tag1", "tag3").alias("key"))
    return search.top(asked.join(held, "key").select("qid", "id"), t.items, t.queries, K)


@query(top_sql("SELECT q.qid, r.id FROM qs q JOIN rws r ON r.attr BETWEEN q.a1 AND q.z1"))
def packed_block_topk(spark, d):
    """Blocks by places in a directory of objects instead of by numbers; the same answer as the fixed blocks."""
    t = load(spark, d)
    directory = layouts.directory(t.rows.select(F.col("block").alias("key")).distinct())
    packed = layouts.overlapped(t.queries, "a1", "z1", 25).join(directory.withColumnRenamed("key", "block"), "block").select("qid", "rank", "is_boundary")
    held = t.rows.join(directory.withColumnRenamed("key", "block"), "block").select("rank", "id", "attr")
    bounds = t.queries.select("qid", "a1", "z1")
    support = packed.join(bounds, "qid").join(held, "rank").where(~F.col("is_boundary") | F.col("attr").between(F.col("a1"), F.col("z1")))
    return search.top(support.select("qid", "id"), t.items, t.queries, K)


@query(prelude() + ", s AS (SELECT DISTINCT block FROM rws) SELECT block AS key, (row_number() OVER (ORDER BY block) - 1)::bigint AS rank, (block // 8)::bigint AS byte, (block % 8)::int AS bit FROM s")
def arena_directory(spark, d):
    """Which objects are there (a bit each), and how many before each."""
    blocks = load(spark, d).rows.select(F.col("block").alias("key")).distinct()
    return layouts.directory(blocks).select("key", "rank", F.floor(F.col("key") / 8).cast("long").alias("byte"), (F.col("key") % 8).cast("int").alias("bit"))
