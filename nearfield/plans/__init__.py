"""Planning: routes, cost model, advisor. What runs on the driver is as large as the catalog of units, not the data."""

from __future__ import annotations

import heapq
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH_FROM = 200_000


def tag_route(n1: Column, n2: Column, threshold: int = GRAPH_FROM) -> Column:
    """Route of a query of one or two tags by its posting sizes (null: no such tag)."""
    return F.when(n1.isNull(), "skipped").when(n2.isNull(), F.when(n1 > threshold, "graph_single").otherwise("brute")).when(F.least(n1, n2) <= threshold, "brute").otherwise("graph_conjunction")


def negation_route(n_eff: Column, anchor: Column, estimate: Column, planner: str, threshold: int) -> Column:
    if planner == "exact":
        return F.when(n_eff == 0, "empty").when(n_eff <= threshold, "brute").otherwise("graph")
    return F.when((anchor if planner == "mono" else estimate) <= threshold, "brute").otherwise("graph")


def effort(tag: Column, n: Column, base: tuple[int, float], high: tuple[int, float], risk: tuple[int, float], least: int, high_tags: list[int], risk_tags: list[int]) -> list[Column]:
    """beam, cut, high_effort, risk_effort of a tag's searches: risk tags first, then listed or large ones."""
    is_high, is_risk = tag.isin(high_tags) | (n >= least), tag.isin(risk_tags)
    pick = lambda k: F.when(is_risk, F.lit(risk[k])).when(is_high, F.lit(high[k])).otherwise(F.lit(base[k]))
    return [pick(0).alias("beam"), pick(1).cast("double").alias("cut"), is_high.alias("high_effort"), is_risk.alias("risk_effort")]


def strategy(n1: Column, n2: Column, bitmap_from: int = 65_536) -> Column:
    """How two postings are intersected: by a bitmap of a large one, by a search of a much smaller one's ids, or merged."""
    small, large = F.least(n1, n2), F.greatest(n1, n2)
    return F.when(large > bitmap_from, "bitmap").when(large > 8 * small, "gallop").otherwise("merge")


def covers(first, end):
    """A pandas series of lists of (node, width): each pair's aligned segments, the widest that fit from the left."""
    import pandas as pd

    from nearfield.operators.layouts import dyadic_cover

    return pd.Series([[{"node": n, "width": w} for n, w in dyadic_cover(int(a), int(z), 128)] for a, z in zip(first, end)])


def target_points(n: Column, default: int) -> Column:
    return F.when(n < 50_000, n).when(n < 500_000, F.lit(default)).otherwise(F.least(F.lit(100_000), F.lit(2 * default)))


def fragment_cost(n: Column, na: Column, nb: Column, state: Column) -> Column:
    """3500 + 8n packed, 3500 + 16n with ids, 5000 + 4(|A| + |B|) + 16n for a pair that is not there."""
    return F.when(state == "packed", 3500 + 8 * n).when(state == "ids", 3500 + 16 * n).otherwise(5000 + 4 * (na + nb) + 16 * n)


def range_cover(lo: int, hi: int, cost: dict[tuple[int, int], int], extra: int = 1500) -> tuple[int, list[tuple[int, int]]]:
    """Cheapest tiling of bins lo to hi by aligned ranges (start, width) that `cost` has; each part after the first costs
    `extra`, and fewer parts win a tie."""
    best: dict[int, tuple[int, list]] = {hi + 1: (0, [])}
    for at in range(hi, lo - 1, -1):
        found = []
        for (start, width), c in cost.items():
            if start == at and at + width in best:
                rest, parts = best[at + width]
                found.append((c + rest + extra * bool(parts), len(parts), [(at, width), *parts]))
        if found:
            c, _, parts = min(found)
            best[at] = (c, parts)
    if lo not in best:
        raise ValueError("no cover")
    return best[lo]


def advise(units: dict[str, int], savings: dict[str, dict[str, float]], budget: int, nodes: int = 100_000) -> tuple[float, list[str], float]:
    """(objective, chosen units, gap): units within the budget whose best savings, summed over queries, are largest. savings:
    query -> unit -> weighted saving; an unused unit is never chosen. Branch and bound, the largest bound first: what a set of
    units adds is at most the sum of what each adds alone, so the chosen ones' value and the fractional knapsack of the
    open ones' additions bounds a node, and so does the value with all open ones that fit. After `nodes` nodes the best found
    is given with its gap, the share by which the largest open bound exceeds it; else the gap is 0."""
    if budget < 0 or any(c <= 0 for c in units.values()) or any(u not in units for q in savings.values() for u in q) or any(v < 0 for q in savings.values() for v in q.values()):
        raise ValueError("a negative budget or saving, a cost that isn't positive or an unknown unit")
    of: dict[str, dict[str, float]] = {}
    for q, edges in savings.items():
        for u, v in edges.items():
            if v > 0:
                of.setdefault(u, {})[q] = v
    order = sorted(of, key=lambda u: (-sum(of[u].values()) / units[u], u))

    def adds(u: str, have: dict[str, float]) -> float:
        return sum(v - have.get(q, 0.0) for q, v in of[u].items() if v > have.get(q, 0.0))

    def bound(k: int, have: dict[str, float], left: int) -> float:
        now, most, knapsack = sum(have.values()), dict(have), 0.0
        gains = []
        for u in order[k:]:
            if units[u] <= left and (gain := adds(u, have)) > 0:
                gains.append((gain / units[u], gain, units[u]))
                for q, v in of[u].items():
                    most[q] = max(most.get(q, 0.0), v)
        room = left
        for _, gain, cost in sorted(gains, reverse=True):
            knapsack += gain * min(1.0, room / cost)
            room -= min(room, cost)
        return min(sum(most.values()), now + knapsack)

    value, chosen = greedy(units, savings, budget)
    best: tuple[float, list[str]] = (value, chosen)
    heap: list[tuple[float, int, int, list[str], dict[str, float], int]] = [(-bound(0, {}, budget), 0, 0, [], {}, budget)]
    made = 0
    while heap and -heap[0][0] > best[0] * (1 + 1e-12) + 1e-12:
        if made >= nodes:
            break
        _, _, k, picked, have, left = heapq.heappop(heap)
        if sum(have.values()) > best[0]:
            best = (sum(have.values()), picked)
        while k < len(order) and (units[order[k]] > left or adds(order[k], have) <= 0):
            k += 1
        if k == len(order):
            continue
        u = order[k]
        more = {**have, **{q: max(v, have.get(q, 0.0)) for q, v in of[u].items()}}
        for p, h, room in (([*picked, u], more, left - units[u]), (picked, have, left)):
            if sum(h.values()) > best[0]:
                best = (sum(h.values()), p)
            if (b := bound(k + 1, h, room)) > best[0]:
                made += 1
                heapq.heappush(heap, (-b, made, k + 1, p, h, room))
    gap = max(0.0, -heap[0][0] / best[0] - 1) if heap and best[0] > 0 and made >= nodes else 0.0
    used = [u for u in best[1] if any(v >= max(of[w].get(q, 0.0) for w in best[1]) for q, v in of.get(u, {}).items())]
    return best[0], sorted(used), gap


def greedy(units: dict[str, int], savings: dict[str, dict[str, float]], budget: int) -> tuple[float, list[str]]:
    """Joint greedy: the unit with the largest drop in total cost per byte that still fits, until none helps."""
    chosen: list[str] = []
    have = {q: 0.0 for q in savings}
    while True:
        gain = {u: sum(max(0.0, savings[q].get(u, 0.0) - have[q]) for q in savings) for u in units if u not in chosen and units[u] <= budget}
        gain = {u: g for u, g in gain.items() if g > 0}
        if not gain:
            return sum(have.values()), chosen
        u = min(gain, key=lambda x: (-gain[x] / units[x], x))
        chosen.append(u)
        budget -= units[u]
        have = {q: max(have[q], savings[q].get(u, 0.0)) for q in savings}


def subset_values(spark: SparkSession, units: dict[str, int], savings: dict[str, dict[str, float]], budget: int) -> DataFrame:
    """mask, cost, value of every subset of the units (bit k: the k-th by name) within the budget; an oracle for advise(), for
    up to about 20 units."""
    names = sorted(units)
    has = {u: F.shiftright("mask", k).bitwiseAND(F.lit(1).cast("bigint")) for k, u in enumerate(names)}
    cost = sum((has[u] * units[u] for u in names), F.lit(0).cast("bigint"))
    best = [F.greatest(F.lit(0.0), F.lit(0.0), *[has[u] * F.lit(float(v)) for u, v in q.items()]) for q in savings.values()]
    subsets = spark.range(1 << len(names)).withColumnRenamed("id", "mask")
    return subsets.select("mask", cost.cast("long").alias("cost"), sum(best, F.lit(0.0)).alias("value")).where(F.col("cost") <= budget)


def resources(persistent: Column, baseline: Column, graph: Column, runtime: Column, baseline_runtime: Column, graph_runtime: Column) -> Column:
    """Whether a design stays within the baseline and the graph together: what persists first, then what runs."""
    return F.when(persistent > baseline + graph, "stop_persistent").when(runtime > baseline_runtime + graph_runtime, "stop_runtime").otherwise("pass")


def split_census(queries: DataFrame, pair: list[str]) -> DataFrame:
    """One row: queries of either side (dev: a boolean), pairs that both have or only one, and rows that are there twice."""
    p = queries.groupBy(*pair).agg(F.max("dev").alias("d"), F.max(~F.col("dev")).alias("e"))
    counts = p.agg(F.count_if(F.col("d") & F.col("e")).alias("shared"), F.count_if(F.col("d") & ~F.col("e")).alias("dev"), F.count_if(F.col("e") & ~F.col("d")).alias("eval"))
    of = lambda c: counts.select(c).scalar()
    return queries.agg(F.count_if("dev").alias("dev_rows"), F.count_if(~F.col("dev")).alias("eval_rows"), (F.count(F.lit(1)) - F.count_distinct("qid")).alias("shared_rows")).select("dev_rows", "eval_rows", of("shared").alias("shared_pairs"), of("dev").alias("dev_pairs"), of("eval").alias("eval_pairs"), "shared_rows")


def route_faults(queries: DataFrame, overlap: DataFrame, route: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """qid, repeated, missing, foreign_, objects_ok, rows of each route (qid, block) against the blocks it must have."""
    once = route.groupBy("qid", "block").agg(F.count(F.lit(1)).alias("times"))
    both = once.join(overlap.withColumn("due", F.lit(True)), ["qid", "block"], "full").join(sizes, "block", "left")
    there = F.col("times").isNotNull()
    per = both.groupBy("qid").agg(
        F.sum(F.coalesce(F.col("times") - 1, F.lit(0))).alias("repeated"), F.count_if(~there).alias("missing"), F.count_if(F.col("due").isNull()).alias("foreign_"),
        F.count_if(there).between(1, most).alias("objects_ok"), F.coalesce(F.sum(F.when(there, F.col("c"))), F.lit(0)).alias("rows"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return queries.join(per, "qid", "left").select("qid", zero("repeated"), zero("missing"), zero("foreign_"), F.coalesce("objects_ok", F.lit(False)).alias("objects_ok"), zero("rows"))


def workload(ids: DataFrame, rows: DataFrame, least: int, seed: int, draws) -> DataFrame:
    """i, family, a, b, c, d, lo, hi: the family is i modulo 4 (a label, a pair, a range of 1, 2 or 4 bins, two pairs), the
    rest is drawn from the mixed number of i / 4 and the seed. draws: a column function of unsigned draws."""
    from pyspark.sql import Window

    pairs = rows.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    pairs = pairs.withColumn("k", (F.row_number().over(Window.orderBy("a", "b")) - 1).cast("long")).select("k", F.col("a").alias("pa"), F.col("b").alias("pb"))  # as many as pairs of labels
    n = pairs.agg(F.count(F.lit(1))).scalar()
    drawn = ids.withColumn("x", draws("i", seed)).select("i", (F.col("i") % 4).cast("int").alias("family"), "x.*")
    width = F.element_at(F.array(*[F.lit(w).cast("long") for w in (1, 2, 4)]), (F.col("by3") + 1).cast("int"))
    spec = drawn.withColumns({"p": F.col("by64") % n, "f": F.col("by24") % n, "g": F.col("high24") % n, "w": width})
    spec = spec.withColumns({"h": F.when(F.col("g") == F.col("f"), (F.col("g") + 1) % n).otherwise(F.col("g")), "lo": F.element_at(F.array("low16", F.col("low15"), F.lit(None).cast("long"), F.col("low13")), F.col("w").cast("int"))})
    side = lambda k, x, y: pairs.select(F.col("k").alias(k), F.col("pa").alias(x), F.col("pb").alias(y))
    full = spec.join(side("p", "a1", "b1"), "p", "left").join(side("f", "a2", "b2"), "f", "left").join(side("h", "a3", "b3"), "h", "left")
    family = F.col("family")
    of = lambda **by: F.coalesce(*[F.when(family == int(k[1]), F.col(c)) for k, c in by.items()])
    return full.select("i", "family", of(f0="by12", f1="a1", f3="a2").alias("a"), of(f1="b1", f3="b2").alias("b"), of(f3="a3").alias("c"), of(f3="b3").alias("d"), of(f2="lo").alias("lo"), F.when(family == 2, F.col("lo") + F.col("w") - 1).alias("hi"))


Spec = tuple[int, int, int, int, int, int, int]


def _pair(a: int, b: int) -> str:
    return f"P{a}_{b}"


def _ranges(lo: int, hi: int) -> list[str]:
    return [f"R{w}_{s}" for w in (1, 2, 4, 8) for s in range(0, 16, w) if lo <= s and s + w - 1 <= hi]


def uses(queries: list[Spec]) -> dict[str, int]:
    """How often the queries (family, a, b, lo, hi, c, d) can use each key."""
    out: dict[str, int] = {}
    for family, a, b, lo, hi, c, d in queries:
        keys = [f"A{a}"] if family == 0 else [_pair(a, b)] if family == 1 else _ranges(lo, hi) if family == 2 else [_pair(a, b), _pair(c, d)]
        for k in keys:
            out[k] = out.get(k, 0) + 1
    return out


def _free(key: str) -> bool:
    """Atoms and single bins have their ids anyway."""
    return key[0] == "A" or key.startswith("R1_")


def _cost(key: str, sizes: dict[str, int], ids: set[str], packed: set[str]) -> float:
    n = sizes.get(key, 0)
    if key in packed:
        return 3500 + 8 * n
    if key[0] == "P" and key not in ids:
        a, b = key[1:].split("_")
        marginal = lambda side, x: sum(v for k, v in sizes.items() if k[0] == "P" and k[1:].split("_")[side] == x)
        return 5000 + 4 * (marginal(0, a) + marginal(1, b)) + 16 * n
    return 3500 + 16 * n


def workload_cost(queries: list[Spec], sizes: dict[str, int], ids: set[str], packed: set[str]) -> float:
    memo: dict[str, float] = {}

    def cost(key: str) -> float:
        if key not in memo:
            memo[key] = _cost(key, sizes, ids, packed)
        return memo[key]

    total = 0.0
    for (family, a, b, lo, hi, c, d), times in Counter(queries).items():
        if family == 0:
            one = cost(f"A{a}")
        elif family == 1:
            one = cost(_pair(a, b))
        elif family == 2:
            there = [k for k in _ranges(lo, hi) if _free(k) or k in ids or k in packed]
            one = range_cover(lo, hi, {(int(s), int(w)): int(cost(f"R{w}_{s}")) for w, s in (k[1:].split("_") for k in there)})[0]
        else:
            one = cost(_pair(a, b)) + cost(_pair(c, d)) + 1500
        total += times * one
    return total


def staged(sizes: dict[str, int], used: dict[str, int], queries: list[Spec], budget: int) -> tuple[set[str], set[str], float]:
    """(ids, packed, workload cost): first ids by uses and a fixed worth (35,000 of a pair, 3,000 of a range) a byte, then packs
    by the drop in cost a byte. 4 bytes an id that is admitted, 128 a packed row."""
    ids: set[str] = set()
    packed: set[str] = set()
    left = budget
    wide = [k for k in sizes if not _free(k) and used.get(k, 0) and sizes[k]]
    for k in sorted(wide, key=lambda k: (-used[k] * (35_000 if k[0] == "P" else 3_000) / (4 * sizes[k]), k)):
        if 4 * sizes[k] <= left:
            ids.add(k)
            left -= 4 * sizes[k]
    while True:
        able = [k for k in sizes if (_free(k) or k in ids) and k not in packed and 0 < 128 * sizes[k] <= left]
        gain = {k: used.get(k, 0) * (_cost(k, sizes, ids, packed) - _cost(k, sizes, ids, packed | {k})) / (128 * sizes[k]) for k in able}
        best = min((k for k in able if gain[k] > 0), key=lambda k: (-gain[k], k), default=None)
        if best is None:
            return ids, packed, workload_cost(queries, sizes, ids, packed)
        packed.add(best)
        left -= 128 * sizes[best]


def joint(sizes: dict[str, int], used: dict[str, int], queries: list[Spec], budget: int, rounds: int = 256) -> tuple[set[str], set[str], float]:
    """(ids, packed, workload cost): each round the move with the largest drop of the whole workload's cost a byte, ties to the
    lower cost: admit ids, admit and pack, pack, or admit and pack all ranges of two bins inside a query's range. The staged
    solution is kept if it is cheaper."""
    ids: set[str] = set()
    packed: set[str] = set()
    left, now = budget, workload_cost(queries, sizes, set(), set())
    wanted = sorted(k for k in sizes if used.get(k, 0) and sizes[k])
    groups = sorted({tuple(k for k in _ranges(q[3], q[4]) if k.startswith("R2_") and sizes.get(k)) for q in queries if q[0] == 2} - {()})
    for _ in range(rounds):
        moves: list[tuple[set[str], set[str]]] = []
        for k in wanted:
            if not _free(k) and k not in ids:
                moves += [({k}, set()), ({k}, {k})]
            elif k not in packed:
                moves.append((set(), {k}))
        moves += [({k for k in g if k not in ids}, {k for k in g if k not in packed}) for g in groups]
        best = None
        for more, pack in moves:
            size = sum(4 * sizes[k] for k in more) + sum(128 * sizes[k] for k in pack)
            if not 0 < size <= left:
                continue
            after = workload_cost(queries, sizes, ids | more, packed | pack)
            rank = (-(now - after) / size, after)
            if after < now and (best is None or rank < best[0]):
                best = (rank, more, pack, size, after)
        if best is None:
            break
        _, more, pack, size, now = best
        ids, packed, left = ids | more, packed | pack, left - size
    other = staged(sizes, used, queries, budget)
    return other if other[2] < now else (ids, packed, now)
