"""Exact top-k inner products by reading sorted lists without random access.

Candidates are cut into blocks. In a block every dimension is a list of (candidate, value) sorted by value, which a query
reads from both ends inwards, so that the contributions to the score shrink as it goes. All lists are read down to a common
size of contribution, in the falling steps of LEVELS. What has been read of a candidate is summed and counted; nothing is
looked up by candidate. A list that hasn't shown a candidate yet can add or take no more than the common contribution, so its
score lies within that many times the lists that haven't.

A candidate whose upper bound is under the k-th best lower bound is out for good. When all are out but a few (SURVIVORS * k),
outsiders can't qualify; reading goes on in order for the entries of those that are left until their scores are complete.
nra() also tells the share of the entries that was read until that point.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a block's components, for candidates and for queries, and the fewest rows of each that blocks are cut down to for
#: parallel work.
BLOCK_BYTES, QUERY_BYTES, LEAST_ROWS, LEAST_QUERIES = 32 << 20, 8 << 20, 16384, 64
#: Common contributions, as parts of the largest one in the block; the last step reads all that is left of the lists.
LEVELS, SURVIVORS = (0.05, 0.025, 0.014, 0.0), 8


class Lists(NamedTuple):
    """A block's sorted lists: candidates by dimension and place, their values, exact values if doubles don't hold the sums."""

    order: np.ndarray
    values: np.ndarray
    exact: np.ndarray | None
    ids: np.ndarray


def lists(x: np.ndarray, ids: np.ndarray) -> Lists:
    """x: candidates x dims, doubles of whole numbers."""
    order = np.argsort(x, axis=0, kind="stable").T.astype(np.int32).copy()
    values = np.take_along_axis(x.T, order.astype(np.int64), 1)
    large = float(np.abs(x).max(initial=0)) ** 2 * x.shape[1] >= 2.0**52
    exact = np.array([[int(v) for v in row] for row in values.tolist()], object).reshape(values.shape) if large else None
    return Lists(order, values, exact, ids)


def nra(block: Lists, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int], float]:
    """(ids, scores, share of the entries read until outsiders couldn't qualify): the k best, ties to smaller ids, without the
    candidates whose id is `own`."""
    n = block.order.shape[1]
    use = np.flatnonzero(q)
    alive = block.ids != own
    if not alive.any():
        return block.ids[:0], [], 0.0
    exact = block.exact is not None or float(np.abs(q).max(initial=0)) * float(np.abs(block.values).max(initial=0)) * len(q) >= 2.0**52
    total = np.zeros(n, object if exact else np.float64)
    rough, unseen = np.zeros(n), np.full(n, len(use))
    low, high, read, decided = np.zeros(len(use), np.int64), np.full(len(use), n), 0, None
    largest = min(1e300, max((abs(q[i]) * max(block.values[i, -1], -block.values[i, 0], 0.0) for i in use), default=0.0))
    slack = 1e-9 * len(use) * largest
    for level in LEVELS:
        common, few = level * largest, 2 * int(alive.sum()) < n
        who, terms = [], []
        for j, i in enumerate(use.tolist()):
            edge, values = common / abs(q[i]), block.values[i]
            to = max(low[j], min(high[j], int(np.searchsorted(values, edge, "left"))))
            up = min(to, max(low[j], int(np.searchsorted(values, -edge, "right"))))
            for where in (slice(to, high[j]), slice(low[j], up)):
                if where.stop > where.start:
                    read += where.stop - where.start
                    w, v = block.order[i, where], values[where]
                    keep = np.flatnonzero(alive[w]) if few or exact else slice(None)
                    w, v = w[keep], v[keep]
                    who.append(w)
                    terms.append(v * q[i])
                    if exact and len(w):  # a list shows a candidate once
                        total[w] += (block.exact[i, where][keep] if block.exact is not None else np.array([int(z) for z in v.tolist()], object)) * int(q[i])
            low[j], high[j] = up, to
        if who:
            shown = np.concatenate(who)
            rough += np.bincount(shown, np.concatenate(terms), n)
            unseen -= np.bincount(shown, minlength=n)
        left = np.flatnonzero(alive)
        if len(left) > k:
            reach = common * unseen[left] + slack
            lower = rough[left] - reach
            alive[left[rough[left] + reach < np.partition(lower, len(left) - k)[len(left) - k]]] = False
            left = np.flatnonzero(alive)
        if decided is None and len(left) <= SURVIVORS * k:
            decided = read
        if not unseen[left].any():
            break
    score = [int(s) for s in (total if exact else rough)[left].tolist()]
    best = sorted(range(len(left)), key=lambda j: (-score[j], int(block.ids[left[j]])))[:k]
    return block.ids[left[best]], [score[j] for j in best], (read if decided is None else decided) / max(1, n * len(use))


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, block_bytes: int = BLOCK_BYTES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row where `queries` holds its k largest integer inner products with
    all other rows, ties to the smaller id; fewer where there are fewer. Components become floor(scale * x), a double.
    Vectors that are null or empty or hold a null or non-finite component (also one that only scaling makes infinite) take
    no part; shorter ones count as ending in zeros. Scores are exact sums; one that a long doesn't hold is given as the
    nearest long, after ranking. Rows that repeat a key are each a candidate, and none of them is a candidate of its own key;
    if a key asks more than once, it gets one answer, that of its largest vector. Both sides are dealt into blocks by their
    keys' hashes, of as many rows as block_bytes and query_bytes hold, and each pair of blocks is a task's: a stated query
    set against all rows."""
    wide = F.transform(vector, lambda v: v.cast("double") * scale)  # the floor is taken in the blocks, as doubles
    base = vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).where(F.size(vector) > 0)
    base = base.select(F.col(key).cast("long").alias("id"), wide.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    base = base.where(~F.exists("v", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.count_if("q").alias("m"), F.max(F.size("v")).alias("d")).first()
    tasks = base.sparkSession.sparkContext.defaultParallelism
    cut = lambda rows, room, least, parts: max(1, -(-rows * 8 * (size["d"] or 1) // room), min(parts, rows // least))
    blocks = cut(size["n"], block_bytes, LEAST_ROWS, tasks)
    query_blocks = cut(size["m"], query_bytes, LEAST_QUERIES, tasks // blocks)
    number = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)).cast("int")
    candidates = base.select(number(blocks, 1).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("g"), "id", "v")
    asking = base.where("q").groupBy("id").agg(F.max("v").alias("v"))
    asked = asking.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"), number(query_blocks, 2).alias("g"), "id", "v")
    dims = size["d"] or 1

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows: dict[str, list] = {"query_id": [], "vec_id": [], "high": [], "score": []}
        if len(left) and len(right):
            matrix = lambda s: np.floor(np.array([np.pad(v, (0, dims - len(v))) for v in s], np.float64).reshape(len(s), dims))
            block = lists(matrix(left["v"]), left["id"].to_numpy())
            for own, q in zip(right["id"].tolist(), matrix(right["v"])):
                with np.errstate(over="ignore", invalid="ignore"):  # bounds beyond doubles exclude nothing
                    ids, scores, _ = nra(block, q, own, k)
                rows["query_id"] += [own] * len(ids)
                rows["vec_id"] += ids.tolist()
                rows["score"] += [min(max(s, -(2**63)), 2**63 - 1) for s in scores]
                rows["high"] += [f"{s + 10**640:0641d}" if abs(s) >= 2**63 else "" for s in scores]  # sorts as the score does
        return pd.DataFrame(rows).astype({"query_id": "int64", "vec_id": "int64", "score": "int64", "high": "str"})

    parts = candidates.groupBy("b", "g").cogroup(asked.groupBy("b", "g")).applyInPandas(search, "query_id long, vec_id long, high string, score long")
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("high"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
