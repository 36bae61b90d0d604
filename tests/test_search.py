"""Small supports: sizes around K, ties everywhere, overlapping clauses, empty tables."""

import pytest
from pyspark.sql import functions as F

from nearfield.operators import fragments, order, search


def tables(spark, sizes, same):
    rows = [(100 * q + k, [0.0, 0.0] if same else [float(k % 4), float(k % 3)], q) for q, n in enumerate(sizes) for k in range(n)]
    items = spark.createDataFrame([(i, v) for i, v, _ in rows] or [(0, [0.0, 0.0])], "id long, vec array<double>")
    tags = spark.createDataFrame([(i, q) for i, _, q in rows], "id long, tag long")
    queries = spark.createDataFrame([(10**6 + q, [0.0, 0.0], q) for q in range(len(sizes))], "qid long, qvec array<double>, tag1 long")
    return items, tags, queries


@pytest.mark.parametrize("same", [True, False])
def test_sizes_around_k(spark, same):
    sizes = [0, 1, 9, 10, 11, 12, 40]
    items, tags, queries = tables(spark, sizes, same)
    want = {}
    for q, n in enumerate(sizes):
        dist = lambda k: 0.0 if same else float((k % 4) ** 2 + (k % 3) ** 2)
        order_ = sorted(range(n), key=lambda k: (dist(k), k))[:10]
        want[10**6 + q] = [(r + 1, 100 * q + k, dist(k)) for r, k in enumerate(order_)]
    support = search.equality(queries, tags)
    ways = {
        "top": search.top(support, items, queries),
        "packed": search.packed_top(queries, tags, items, 10),
        "merged": search.merged(support.withColumn("key", F.col("id") % 3), items, queries, 10),
        "prefix": search.prefix_top(support, items, queries, 10, 1),
        "cascade": search.cascade_top(support, items, queries, 10, [1, 2]),
        "seeded": search.seeded_prefix_top(support, items, queries, 10, 1, 10),
    }
    for name, df in ways.items():
        got = {q: [] for q in want}
        for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
            got[r["qid"]].append((r["rank"], r["id"], r["dist"]))
        assert got == want, name
    ties = {r["qid"]: r["tie"] for r in search.cutoff_ties(support, items, queries, 10, search.l2).collect()}
    assert ties == {10**6 + q: n > 10 and (same or want[10**6 + q][9][2] == sorted(float((k % 4) ** 2 + (k % 3) ** 2) for k in range(n))[10]) for q, n in enumerate(sizes) if n}


def test_overlap_counts_once(spark):
    items, tags, queries = tables(spark, [12], True)
    support = search.equality(queries, tags)
    assert search.any_of(support, support, support).count() == 12
    assert search.top(search.any_of(support, support), items, queries).count() == 10
    assert search.without(support, support).count() == 0


def test_empty_tables(spark):
    items, tags, queries = tables(spark, [3], True)
    none = tags.where("false")
    assert search.top(search.equality(queries, none), items, queries).count() == 0
    assert search.packed_top(queries, none, items, 10).count() == 0
    assert order.id_ranks(none, ["tag"], "id", "r").count() == 0
    assert fragments.postings(none, 4).count() == 0
    assert order.greatest_gaps(none, ["tag"], "id").count() == 0


@pytest.mark.parametrize("n", [1, 3, 64])
def test_cuts_are_plain_ranks(spark, n):
    """Ranks, offsets and gaps against sorting, with a hot group, ties and single rows."""
    rows = [(k, 0 if k % 3 else 1 + k % 5, (k * 7919) % 50) for k in range(0, 900, 1 + n % 2)]
    df = spark.createDataFrame(rows, "id long, g long, v long")
    ranks = {r["id"]: r["r"] for r in order.id_ranks(df, ["g"], "id", "r", n).collect()}
    placed = {r["id"]: r["r"] for r in order.ordered_ranks(df, ["g"], "v", "id", "r").collect()}
    for g in {x[1] for x in rows}:
        own = [x for x in rows if x[1] == g]
        assert [ranks[i] for i, _, _ in sorted(own)] == list(range(len(own)))
        assert [placed[i] for i, _, _ in sorted(own, key=lambda x: (x[2], x[0]))] == list(range(len(own)))
    for r in order.value_offsets(df, ["g"], "v", n).collect():
        own = [x[2] for x in rows if x[1] == r["g"]]
        assert (r["first"], r["n"], r["total"]) == (sum(v < r["v"] for v in own), own.count(r["v"]), len(own))
    for r in order.greatest_gaps(df, ["g"], "id").collect():
        ids = sorted(x[0] for x in rows if x[1] == r["g"])
        steps = [b - a for a, b in zip(ids, ids[1:])]
        assert (r["least"], r["most"]) == (min(steps, default=None), max(steps, default=None))
