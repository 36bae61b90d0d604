"""Neighbour graphs: blocks against plain distances, odd vectors, copies, pruning, and work in blocks only."""

import math
import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.catalog import QUERIES
from nearfield.operators import graph, neighbours

INF, NAN = float("inf"), float("nan")


def distance(x, y):
    terms = [(a - b) * (a - b) for a, b in zip(x or [], y or []) if a is not None and b is not None]
    total = 0.0
    for t in terms:
        total += t
    return total if terms else None


def plain(rows, k):
    """src: its (dst, distance), of rows (id, vector)."""
    out = {}
    for i, x in rows:
        found = [(distance(x, y), j) for j, y in rows if j != i]
        found.sort(key=lambda f: (f[0] is None, f[0] is not None and math.isnan(f[0]), 0.0 if f[0] is None or math.isnan(f[0]) else f[0], f[1]))
        out[i] = [(j, repr(d)) for d, j in found[:k]]
    return out


@pytest.mark.parametrize("values", [[0.0, 1.0, -0.0, 2.0], [0.0, 0.1, 1e8, 1e8 + 0.1, 1e200, None, NAN, INF]])
def test_nearest_of_a_block(values, monkeypatch):
    """Ties, copies and odd components, with many and with few distances in memory."""
    draw = random.Random(7)
    for trial in range(60):
        rows = [(i, None if draw.random() < 0.05 else [draw.choice(values) for _ in range(draw.choice([3, 3, 3, 1]))]) for i in draw.sample(range(200), draw.randint(2, 50))]
        monkeypatch.setattr(neighbours, "CELLS", draw.choice([1, 60, 1 << 20]))
        k, ids = draw.randint(1, 8), np.array([i for i, _ in rows])
        b = neighbours.block(pa.array([v for _, v in rows], pa.list_(pa.float64())), 3)
        got = {i: [] for i, _ in rows}
        for s, t, d, there in zip(*(c.tolist() for c in neighbours.nearest(ids, b, ids, b, k))):
            got[s].append((t, repr(d if there else None)))
        assert got == plain(rows, k)


def test_graph_in_many_groups(spark, monkeypatch):
    """Slices and stretches give the graph of all pairs, each edge once; null vectors are nobody's nearest."""
    monkeypatch.setattr(neighbours, "SOURCES", 20)
    monkeypatch.setattr(neighbours, "TARGETS", 30)
    draw = random.Random(3)
    rows = [(i, [draw.choice([0.0, 0.5, 1.0]) for _ in range(3)] if i % 40 else None, i % 2) for i in range(200)]
    items = spark.createDataFrame(rows, "id long, vec array<float>, part int")
    got = {i: [] for i, _, _ in rows}
    for r in sorted(graph.knn_graph(items, "part", 5).collect(), key=lambda r: (r["dist"] is None, r["dist"], r["dst"])):
        got[r["src"]].append((r["dst"], repr(r["dist"])))
    assert got == {s: m for p in (0, 1) for s, m in plain([r[:2] for r in rows if r[2] == p], 5).items()}


@pytest.mark.parametrize("name", ["graph_audit", "knn_graph"])
def test_pairs_of_rows_are_no_rows(spark, sf, name, capsys):
    """A shard's rows meet in blocks, once, and not as rows of a join."""
    QUERIES[name](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("FlatMapGroupsInArrow (") == 1 and "src) = dst" not in plan and "src = dst" not in plan


def test_lists_of_many_blocks(monkeypatch):
    """Vectors that are met a few at a time, in products of small tiles, give the lists of all at once."""
    for name, value in (("FIRST", 4), ("TARGETS", 8), ("TILE", (16, 8))):
        monkeypatch.setattr(neighbours, name, value)
    draw = random.Random(11)
    for values in ([x / 8 for x in range(80)], [0.0, 0.1, 1e8, 1e8 + 0.1, None, NAN], [1e-160, 2e-160, 3e-160], [1000 + x * 1e-6 for x in range(50)]):
        rows = [(i, [draw.choice(values) for _ in range(3)]) for i in draw.sample(range(300), 90)]
        ids = np.array([i for i, _ in rows])
        b = neighbours.block(pa.array([v for _, v in rows], pa.list_(pa.float64())), 3)
        got = {i: [] for i, _ in rows}
        for s, t, d, there in zip(*(c.tolist() for c in neighbours.nearest(ids, b, ids, b, 5))):
            got[s].append((t, repr(d if there else None)))
        assert got == plain(rows, 5)


def test_graph_of_copies_and_odd_vectors_in_slices(spark, monkeypatch):
    """More copies than neighbours, -0.0, NaN, nulls and vectors of other widths than those that ask."""
    monkeypatch.setattr(neighbours, "SOURCES", 1)  # a shard of 8 slices
    draw = random.Random(9)
    odd = [None, [], [0.5], [None, 1.0, 2.0], [NAN, 1.0], [0.0, 0.0, 0.0], [-0.0, 0.0, -0.0], [1.0, 2.0, 3.0, 4.0, 5.0]]
    rows = [(i, draw.choice(odd) if i % 3 else [float(draw.randrange(30)), 1.0, 2.0], 0) for i in range(150)]
    got = {i: [] for i, _, _ in rows}
    for r in graph.knn_graph(spark.createDataFrame(rows, "id long, vec array<double>, part int"), "part", 6).collect():
        got[r["src"]].append((r["dst"], r["dist"]))
    key = lambda f: (f[1] is None, f[1] is not None and math.isnan(f[1]), 0.0 if f[1] is None or math.isnan(f[1]) else f[1], f[0])
    assert {s: [(t, repr(d)) for t, d in sorted(m, key=key)] for s, m in got.items()} == plain([r[:2] for r in rows], 6)


@pytest.mark.parametrize("name", ["block_graphs", "graph_audit", "knn_graph"])
def test_no_shard_is_searched_in_cells(spark, sf, name, capsys):
    """What has SQL is exact for shards of any size: no row is held against its pivots' cells only."""
    QUERIES[name](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    assert "pivot" not in plan and "cell" not in plan


def recall(spark, name, d):
    true, found = ({(r["qid"], r["id"]) for r in QUERIES[n](spark, d).collect()} for n in ("equality_topk", name))
    return len(true & found) / len(true)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="the check tool's tables aren't here")
def test_recall_of_graph_topk(spark):
    assert recall(spark, "graph_topk", "/root/testdata/check_s") >= 0.9


def line(spark, places):
    return spark.createDataFrame([(i, [float(x)], 0) for i, x in enumerate(places)], "id long, vec array<double>, shard long")


def test_edges_are_followed_both_ways(spark):
    """The first rows are only each other's neighbours; the others are found by those that point at them."""
    items = line(spark, [0.0, 0.1, 0.2, 0.3, *(2 + 0.6 * k + 0.01 * k * k for k in range(12))])
    asked = spark.createDataFrame([(100, [2 + 0.6 * 11 + 1.21], 0)], "qid long, qvec array<double>, shard long")
    got = graph.beam_search(asked, items, graph.knn_graph(items, "shard", 3), 3, 6, 12).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["rank"])] == [15, 14, 13]


def test_copies_do_not_cut_the_graph(spark):
    items = line(spark, [k // 30 for k in range(300)])
    asked = spark.createDataFrame([(295, [9.0], 0)], "qid long, qvec array<double>, shard long")
    got = graph.search_distinct(asked, items, lambda s: graph.knn_graph(s, "shard", 2), 40, 6, 10).collect()
    assert [(r["rank"], r["id"], r["dist"]) for r in sorted(got, key=lambda r: r["rank"])] == [(k + 1, i, d) for k, (i, d) in enumerate([(i, 0.0) for i in range(270, 300) if i != 295] + [(i, 1.0) for i in range(240, 251)])]


def test_pruned_shards_of_any_size(spark, monkeypatch):
    """Pruned in a group or after merging, the graph is that of the rule."""
    draw = random.Random(5)
    rows = [(i, [draw.choice([0.0, 0.3, 0.5, 1.0]) for _ in range(3)], i % 4 // 3) for i in range(160)]
    items = spark.createDataFrame(rows, "id long, vec array<float>, shard long")
    rows = [(r["id"], list(r["vec"]), r["shard"]) for r in items.collect()]
    want = set()
    for part in (0, 1):
        here = {i: v for i, v, p in rows if p == part}
        for src, found in plain(list(here.items()), 12).items():
            kept = []
            for dst, d in found:
                if len(kept) < 4 and not any(distance(here[k], here[dst]) * (1.2 * 1.2) < float(d) for k in kept):
                    kept.append(dst)
            want |= {(part, src, k) for k in kept}
    for sources, targets in ((4096, 32768), (25, 60)):  # the second makes shard 0 a large one
        monkeypatch.setattr(neighbours, "SOURCES", sources)
        monkeypatch.setattr(neighbours, "TARGETS", targets)
        got = [(r["shard"], r["src"], r["dst"]) for r in graph.alpha_graph(items, 4, 1.2, 12).collect()]
        assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/check_s"), reason="the check tool's tables aren't here")
def test_recall_of_local_graph_topk(spark):
    assert recall(spark, "local_graph_topk", "/root/testdata/check_s") >= 0.9
