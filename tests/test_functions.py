import itertools
import random
import struct

import pytest
from pyspark.sql import functions as F

from nearfield import functions as f
from nearfield import plans, sources
from nearfield.operators import layouts


def test_codecs():
    ids = sorted(random.Random(1).sample(range(f.UNIVERSE), 300))
    assert f.u24_decode(f.u24_encode(ids)) == ids
    near = list(itertools.accumulate(random.Random(2).choices(range(1, 3000), k=300)))
    assert f.delta16_decode(f.delta16_encode(near)) == near
    for case in (ids, [0], [f.UNIVERSE - 1], [0, f.UNIVERSE - 1]):
        assert f.elias_fano_decode(*f.elias_fano_encode(case)) == case
    for bad in (lambda: f.u24_decode(b"ab"), lambda: f.delta16_encode([1, 1]), lambda: f.elias_fano_encode([])):
        with pytest.raises(ValueError):
            bad()
    assert f.fnv1a([]) == 14695981039346656037


def test_elias_fano_account(spark):
    df = spark.createDataFrame([(15625,), (15626,), (10,)], "n long")
    got = {r[0]: r[1:] for r in df.select("n", *f.elias_fano_bytes(F.col("n"))).collect()}
    assert got[15625][0] == 6 and got[15626][0] == 5 and got[10][1:] == (24, 8)


def test_within_and_endpoints(spark):
    inf = float("inf")
    df = spark.createDataFrame([(None,), (float("nan"),), (1.0,), (inf,)], "v double")
    assert [bool(r[0]) for r in df.select(f.within(F.col("v"), F.lit(1.0), F.lit(inf))).collect()] == [False, False, True, False]
    assert [r[0] for r in spark.createDataFrame([("-inf",), ("+inf",), ("2.5",)], "t string").select(f.endpoint(F.col("t"))).collect()] == [-inf, inf, 2.5]


def test_advisor_toy():
    units = {"pair_ab": 4, "range": 3, "pair_cd": 5}
    savings = {"a": {"pair_ab": 14, "pair_cd": 20}, "b": {"range": 3, "pair_cd": 8}, "c": {"range": 8}}
    assert plans.advise(units, savings, 7)[:2] == (28, ["pair_cd"])


def test_advisor_is_brute_force(spark):
    rnd = random.Random(3)
    for _ in range(25):
        units = {f"u{k}": rnd.randint(1, 6) for k in range(6)}
        savings = {f"q{k}": {u: float(rnd.randint(0, 9)) for u in units} for k in range(4)}
        budget = rnd.randint(0, 12)
        best = max(sum(max((q[u] for u in s), default=0) for q in savings.values()) for n in range(7) for s in itertools.combinations(units, n) if sum(units[u] for u in s) <= budget)
        value, chosen, gap = plans.advise(units, savings, budget)
        assert value == best and gap == 0 and sum(units[u] for u in chosen) <= budget
        assert plans.greedy(units, savings, budget)[0] <= best
    top = plans.subset_values(spark, units, savings, budget).agg(F.max("value")).first()[0]
    assert top == best


def test_range_cover():
    cost = {(s, w): 100 for w in (1, 2, 4, 8) for s in range(0, 16, w)}
    assert plans.range_cover(0, 7, cost) == (100, [(0, 8)])
    assert plans.range_cover(1, 10, cost) == (5 * 100 + 4 * 1500, [(1, 1), (2, 2), (4, 4), (8, 2), (10, 1)])
    assert layouts.dyadic_cover(0, 8) == [(0, 8)] and layouts.dyadic_cover(3, 12) == [(3, 1), (4, 4), (8, 4)]
    for a, z in itertools.combinations(range(30), 2):
        assert [x for s, w in layouts.dyadic_cover(a, z) for x in range(s, s + w)] == list(range(a, z))


def test_sources(spark, tmp_path):
    (tmp_path / "v.bin").write_bytes(struct.pack("<II4f", 2, 2, 1, 2, 3, 4))
    assert [(r["id"], list(r["vec"])) for r in sources.read_dense(spark, str(tmp_path / "v.bin")).collect()] == [(0, [1, 2]), (1, [3, 4])]
    (tmp_path / "m.spmat").write_bytes(struct.pack("<3Q3Q3I", 2, 9, 3, 0, 2, 3, 1, 5, 4))
    rows = sources.read_postings(spark, str(tmp_path / "m.spmat"))
    assert [tuple(r) for r in rows.collect()] == [(0, 1), (0, 5), (1, 4)]
    (tmp_path / "w.tsv").write_text("qid\ttag\n# note\n1\t2\n")
    assert sources.read_tsv(spark, str(tmp_path / "w.tsv"), "qid long, tag int").collect() == [(1, 2)]
    sources.publish(rows, str(tmp_path / "out"), ["tag"])
    with pytest.raises(Exception):
        sources.publish(rows, str(tmp_path / "out"))


def refused(df):
    with pytest.raises(Exception):
        df.collect()


def test_binary_sources(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data) and str(tmp_path / name)
    rows = lambda df: sorted(tuple(list(x) if isinstance(x, list) else x for x in r) for r in df.collect())
    assert rows(sources.read_raw(spark, put("raw", struct.pack("<4f", 1, 2, 3, 4)), 2)) == [(0, [1, 2]), (1, [3, 4])]
    refused(sources.read_raw(spark, put("raw2", b"123"), 2))
    good = struct.pack("<iff", 2, 1, 255) + struct.pack("<iff", 2, 0, 7)
    assert rows(sources.read_fvecs(spark, put("f", good), 2, True)) == [(0, [1, 255]), (1, [0, 7])]
    for bad in (struct.pack("<iff", 3, 1, 2), struct.pack("<iff", 2, 1.5, 2), struct.pack("<iff", 2, 256, 2)):
        refused(sources.read_fvecs(spark, put("fb", bad), 2, True))
    assert rows(sources.read_subset(spark, put("s", struct.pack("<3i", 2, 7, 5)))) == [(0, 7), (1, 5)]
    refused(sources.read_subset(spark, put("s2", struct.pack("<2i", 2, 7))))
    assert rows(sources.read_offsets(spark, put("o", struct.pack("<3Q", 0, 2, 5)), 2, 5)) == [(0, 0, 2), (1, 2, 3)]
    refused(sources.read_offsets(spark, put("o2", struct.pack("<3Q", 0, 6, 5)), 2, 5))
    assert rows(sources.read_ranges(spark, put("r", struct.pack("<8i", 0, 4, 9, 9, 1, 2, 3, 4)), 2)) == [(0, 0, 0, 4), (0, 1, 9, 9), (1, 0, 1, 2), (1, 1, 3, 4)]
    refused(sources.read_ranges(spark, put("r2", struct.pack("<2i", 5, 4))))
    (tmp_path / "n.json").write_text('[{"anchor": 3, "neg": [1, 2], "qids": [10, 11], "more": {"x": 1}}]')
    assert rows(sources.read_negations(spark, str(tmp_path / "n.json"))) == [(0, 3, [1, 2], 10), (0, 3, [1, 2], 11)]
    (tmp_path / "n2.json").write_text('[{"anchor": 3, "neg": [], "qids": [10]}]')
    refused(sources.read_negations(spark, str(tmp_path / "n2.json")))


def test_truth_and_clusters(spark, tmp_path):
    put = lambda name, data: (tmp_path / name).write_bytes(data) and str(tmp_path / name)
    rows = lambda df: sorted(map(tuple, df.collect()))
    none, inf = 2**32 - 1, float("inf")
    truth = lambda ids, d: struct.pack("<II6I6f", 2, 3, *ids, *d)
    assert rows(sources.read_truth(spark, put("t", truth([4, 1, 2, 3, none, none], [0, 1, 1, 2, inf, inf])), 9)) == [(0, 1, 4, 0.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (1, 1, 3, 2.0)]
    for k, (ids, d) in enumerate([([4, 2, 1, 3, none, none], [0, 1, 1, 2, inf, inf]), ([4, 1, 4, 3, 5, 6], [0, 1, 2, 2, 3, 4]), ([4, 1, 9, 3, 5, 6], [0, 1, 2, 2, 3, 4]), ([4, none, 2, 3, 5, 6], [0, inf, 2, 2, 3, 4]), ([4, 1, none, 3, 5, 6], [0, 1, 5, 2, 3, 4])]):
        refused(sources.read_truth(spark, put(f"t{k}", truth(ids, d)), 9))
    assert rows(sources.read_truth_lists(spark, put("l", struct.pack("<iIIi", 2, 8, 9, 0)))) == [(0, 1, 8), (0, 2, 9)]
    refused(sources.read_truth_lists(spark, put("l2", struct.pack("<iI", 2, 8))))
    assert rows(sources.read_truth_tens(spark, put("x", struct.pack("<10i", *range(8), -1, -1)), 1))[-1] == (0, 8, 7)
    assert sources.read_truth_tens(spark, put("x2", b"1234"), 1) is None and sources.read_truth_tens(spark, str(tmp_path / "no"), 1) is None
    c, m = sources.read_clusters(spark, put("7_centroids.bin", struct.pack("<ii4B", 2, 2, 1, 2, 3, 4)), put("7_members.bin", struct.pack("<i3q3i", 2, 0, 1, 3, 9, 8, 7)))
    assert [(r["tag"], r["cluster"], list(r["centroid"])) for r in c.collect()] == [(7, 0, [1, 2]), (7, 1, [3, 4])]
    assert rows(m) == [(7, 0, 9), (7, 1, 7), (7, 1, 8)]
    (tmp_path / "v.txt").write_text("# units\n4 3 and more\n\n  # none\n5 6\n3 4\n")
    assert rows(sources.read_vocabulary(spark, str(tmp_path / "v.txt"), ("a", "b"))) == [(3, 4), (5, 6)]
    assert rows(sources.read_vocabulary(spark, str(tmp_path / "v.txt"))) == [(3,), (4,), (5,)]
    for text in ("3 3\n", "3\n", "3 x\n", "-1 2\n", "1 3000000000\n"):
        (tmp_path / "v2.txt").write_text(text)
        refused(sources.read_vocabulary(spark, str(tmp_path / "v2.txt"), ("a", "b")))


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([(1, 1, 7, 0.5), (1, 2, 9, 1.5), (2, 1, 3, 0.0)], "qid long, rank int, id long, dist double")
    rows = sorted((r["qid"], list(r["ids"]), list(r["dists"])) for r in sources.padded(found, 3).collect())
    inf = float("inf")
    assert rows == [(1, [7, 9, -1], [0.5, 1.5, inf]), (2, [3, -1, -1], [0.0, inf, inf])]
    sources.publish_csv(sources.padded(found, 2), str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True)
    assert sorted(map(tuple, back.select("qid", "ids").collect())) == [("1", "7 9"), ("2", "3 -1")]
    with pytest.raises(Exception):
        sources.publish_csv(found, str(tmp_path / "out"))
    sources.publish(found, str(tmp_path / "p"), ["qid"])
    import hashlib
    import pathlib

    got = {r["path"].split("/")[-1]: r["sha256"] for r in sources.file_hashes(spark, str(tmp_path / "p")).collect()}
    assert got and all(hashlib.sha256(pathlib.Path(tmp_path / "p" / n).read_bytes()).hexdigest() == h for n, h in got.items())


def test_codec_columns_are_the_plain_ones(spark):
    from nearfield.functions import codecs

    lists = [sorted(random.Random(k).sample(range(60000), 1 + 7 * k)) for k in range(12)] + [[0], [999_999], [0, 999_999]]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(lists)], "k int, ids array<long>")
    small = df.where("k < 13")
    for r in small.select("ids", codecs.u24("ids").alias("a"), codecs.delta16("ids").alias("b")).collect():
        assert bytes(r["a"]) == f.u24_encode(r["ids"]) and bytes(r["b"]) == f.delta16_encode(r["ids"])
    for r in df.select("ids", codecs.elias_fano("ids").alias("e"), codecs.fnv("ids").alias("h"), codecs.un_elias_fano(codecs.elias_fano("ids")).alias("back")).collect():
        assert r["back"] == r["ids"] and int(r["h"]) == f.fnv1a(r["ids"]) and bytes(r["e"]) == f.elias_fano_bytes_of(r["ids"])
    one = lambda *ids: spark.createDataFrame([(list(ids),)], "ids array<long>")
    for bad in (one(1 << 24).select(codecs.u24("ids")), one(5, 5).select(codecs.delta16("ids")), one(0, 70000).select(codecs.delta16("ids")), one(3, 2).select(codecs.elias_fano("ids")), one().select(codecs.delta16("ids"))):
        refused(bad)
    raw = lambda data: spark.createDataFrame([(bytearray(data),)], "d binary")
    for bad in (raw(b"ab").select(codecs.un_u24("d")), raw(b"\0\0\0\0\0\0").select(codecs.un_delta16("d")), raw(b"abc").select(codecs.un_elias_fano("d"))):
        refused(bad)


def test_elias_fano_is_canonical():
    """Every list has one encoding: spare bits, another count or order, and another length are refused."""
    r = random.Random(5)
    for n in (1, 2, 63, 64, 65, 500):
        ids = sorted(r.sample(range(f.UNIVERSE), n))
        data = f.elias_fano_bytes_of(ids)
        assert f.elias_fano_ids_of(data) == ids
        for broken in (data + b"\0" * 8, data[:-8], struct.pack("<Q", n + 1) + data[8:], data[:-1] + bytes([data[-1] | 0x80])):
            with pytest.raises(ValueError):
                f.elias_fano_ids_of(broken)


def test_draws_and_permutations():
    assert [hex(int(x)) for x in f.mix64([0, 1])] == ["0xe220a8397b1dcdaf", "0x910a2dec89025cc1"]
    for n in (1, 2, 17, 400):
        p = f.permutation(n, 42)
        assert sorted(p) == list(range(n)) and p == f.permutation(n, 42)
    assert f.permutation(400, 1) != f.permutation(400, 2) and f.fingerprint([0, 1]) != f.fingerprint([1, 0])
    with pytest.raises(ValueError):
        f.draw(1, 0)


def brute_cost(queries, sizes, ids, packed):
    """A workload's cost with every tiling of a range tried."""
    def cost(key):
        n = sizes.get(key, 0)
        if key in packed:
            return 3500 + 8 * n
        if key[0] == "P" and key not in ids:
            a, b = key[1:].split("_")
            return 5000 + 4 * sum(v for k, v in sizes.items() if k[0] == "P" and (k[1:].split("_")[0] == a)) + 4 * sum(v for k, v in sizes.items() if k[0] == "P" and (k[1:].split("_")[1] == b)) + 16 * n
        return 3500 + 16 * n

    def tilings(lo, hi):
        if lo > hi:
            yield []
        for w in (1, 2, 4, 8):
            if lo % w == 0 and lo + w - 1 <= hi and (w == 1 or f"R{w}_{lo}" in ids | packed):
                for rest in tilings(lo + w, hi):
                    yield [f"R{w}_{lo}", *rest]

    total = 0
    for family, a, b, lo, hi, c, d in queries:
        if family == 2:
            total += min(sum(cost(k) for k in t) + 1500 * (len(t) - 1) for t in tilings(lo, hi))
        else:
            total += cost(f"A{a}") if family == 0 else cost(f"P{a}_{b}") if family == 1 else cost(f"P{a}_{b}") + cost(f"P{c}_{d}") + 1500
    return total


def test_greedy_plans():
    r = random.Random(2)
    sizes = {f"A{k}": r.randint(20, 90) for k in range(4)} | {f"P{a}_{b}": r.randint(3, 20) for a in range(4) for b in range(3)}
    bins = [r.randint(1, 30) for _ in range(16)]
    sizes |= {f"R{w}_{s}": sum(bins[s : s + w]) for w in (1, 2, 4, 8) for s in range(0, 16, w)}
    queries = [(k % 4, r.randrange(4), r.randrange(3), lo := r.randrange(12), lo + 3, r.randrange(4), r.randrange(3)) for k in range(24)]
    used = plans.uses(queries)
    for budget in (0, 500, 5_000, 40_000):
        empty = plans.workload_cost(queries, sizes, set(), set())
        assert empty == brute_cost(queries, sizes, set(), set())
        a, b = plans.staged(sizes, used, queries, budget), plans.joint(sizes, used, queries, budget)
        for ids, packed, cost in (a, b):
            assert cost == brute_cost(queries, sizes, ids, packed) <= empty
            assert 4 * sum(sizes[k] for k in ids) + 128 * sum(sizes[k] for k in packed) <= budget
        assert b[2] <= a[2]  # never worse than the incumbent
