"""Shards by balanced label propagation: linked documents move to each other under quotas.

Linked documents share a hub (here: documents with equal texts). Every document starts in the shard of its key's hash. In a
round each hub looks at how many of its documents each shard has, and those outside its fullest shard ask to move there. A
shard lets in what its room allows: its capacity, less the documents that it holds, plus those that leave it in the same
round, which depends on what the other shards let in; the shares are the fixed point of that. Small hubs are let in whole,
as many as the share says; of those over a quarter of a shard the share of their documents. A shard that is full and that nobody leaves is no
target, so a hub of more than a shard's capacity fills one shard after another. Large hubs settle first, with all else
counted as free to go (over a quarter of a shard, then over a 64th); then small hubs do in what is left, where they start too. After its
rounds a hub of at most a quarter of a shard goes whole to its fullest shard, or where that has no room for it, whole to another
that has. At last the hubs that no shard has room for and the unlinked documents fill every shard to its capacity.
Capacities differ by one row at most.

Hub sizes, askings and numberings are sums by (hub, shard) or by hash splits, so a hub may hold any share of the rows; the
driver sees only tables of the shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.ranks import grouped_ranks
from nearfield.llm.storage import Scratch

SHARDS, ROUNDS = 16, 24


def unit(*cols: Column | str) -> Column:
    """A hash as a number from 0 to 1."""
    return F.xxhash64(*cols).cast("double") / 2.0**64 + 0.5


def shares(room: list[int], flow: dict[tuple[int, int], int]) -> list[float]:
    """The share of the askings that each shard can let in, for askings flow[from, to]."""
    n = len(room)
    asked = [sum(v for (_, t), v in flow.items() if t == s) for s in range(n)]
    share = [1.0] * n
    for _ in range(200):
        leaving = [sum(v * share[t] for (f, t), v in flow.items() if f == s) for s in range(n)]
        share = [min(share[s], max(0.0, room[s] + leaving[s]) / asked[s]) if asked[s] else 0.0 for s in range(n)]
    return share


def propagate(linked: DataFrame, capacity: list[int], whole: bool, tables: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """linked: key, row, hub, shard, a table of `tables`. The same rows, with the shards that the rounds give them. whole: hubs move whole."""
    shards = len(capacity)
    closed = [c <= 0 for c in capacity]
    for turn in range(rounds):
        by = tables.stored(linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n")), "hub-shards")
        held = {r["shard"]: r["n"] for r in by.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        room = [capacity[s] - held.get(s, 0) for s in range(shards)]
        score = F.struct(F.col("n"), F.xxhash64("hub", "shard"), F.col("shard"))  # ties by a hash, so that hubs spread
        is_open = F.element_at(F.array(*[F.lit(not x) for x in closed]), F.col("shard") + 1)
        targets = by.where(is_open).groupBy("hub").agg(F.max(score).alias("t")).select(F.col("hub").alias("h"), "t")
        asks = by.join(targets, F.col("hub") == F.col("h")).where((F.col("shard") != F.col("t.shard")) & (score < F.col("t")))
        asks = tables.stored(asks.select("hub", "shard", "n", F.col("t.shard").alias("to")), "asks")
        flow = {(r["shard"], r["to"]): r["n"] for r in asks.groupBy("shard", "to").agg(F.sum("n").alias("n")).collect()}
        if not flow:
            tables.drop(by)
            tables.drop(asks)
            break
        share = shares(room, flow)
        closed = [capacity[s] <= 0 or room[s] <= capacity[s] // 20 and not any(f == s for f, _ in flow) for s in range(shards)]
        rate = F.element_at(F.array(*[F.lit(float(x)) for x in share]), F.col("to") + 1)
        draw = unit("hub", F.lit(turn)) if whole else unit("key", "row", F.lit(turn))
        moves = asks.select(F.col("hub").alias("h"), F.col("shard").alias("s"), "to")
        next_ = linked.join(moves, (F.col("hub") == F.col("h")) & (F.col("shard") == F.col("s")), "left")
        go = F.col("to").isNotNull() & (draw < rate)
        after = tables.stored(next_.select("key", "row", "hub", F.when(go, F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        for old in (by, asks, linked):
            tables.drop(old)
        linked = after
    return linked


def spread(room: list[int], draw: Column) -> Column:
    """A shard for a draw from 0 to 1, in proportion to the room."""
    total, low, cases = sum(room), 0, F.lit(max(range(len(room)), key=lambda s: room[s]))
    for s, r in reversed(list(enumerate(room))):
        if r > 0:
            cases = F.when((draw >= (total - low - r) / total) & (draw < (total - low) / total), F.lit(s)).otherwise(cases)
            low += r
    return cases


def settle(linked: DataFrame, room: list[int], tables: Scratch) -> DataFrame:
    """linked: key, row, hub, shard. The same rows, each hub whole in one shard: its fullest, as far as that has room, or else
    one drawn from those that have. A null shard for hubs that no shard has room for. In each round, every shard that a hub
    asks takes the first one at least, so the rounds end."""
    score = F.struct(F.col("n"), F.xxhash64("hub", "shard"), F.col("shard"))
    by = linked.groupBy("hub", "shard").agg(F.count(F.lit(1)).alias("n"))
    fullest = by.groupBy("hub").agg(F.sum("n").alias("size"), F.max(score).alias("t"))
    asking = tables.stored(fullest.select("hub", "size", F.when(F.element_at(F.array(*[F.lit(r) for r in room]), F.col("t.shard") + 1) >= F.col("size"), F.col("t.shard")).alias("shard")), "hub-homes")
    homes, room, turn = None, list(room), 0
    while True:
        drawn = F.transform(
            F.filter(F.array(*[F.struct(F.lit(s).alias("shard"), F.lit(r).alias("room")) for s, r in enumerate(room)]), lambda x: x["room"] >= F.col("size")),
            lambda x: F.struct((-F.log(F.greatest(unit("hub", x["shard"], F.lit(turn)), F.lit(1e-18))) / x["room"]).alias("at"), x["shard"].alias("shard")),
        )
        asking = asking.select("hub", "size", F.coalesce("shard", F.array_min(drawn)["shard"]).alias("shard"))
        ranked = grouped_ranks(asking.where(F.col("shard").isNotNull()), ["shard"], ["hub"], "before", weight="size")
        limit = F.element_at(F.array(*[F.lit(r) for r in room]), F.col("shard") + 1)
        ranked = tables.stored(ranked.withColumn("fits", F.col("before") + F.col("size") <= limit), "hub-asks")
        taken = {r["shard"]: r["n"] for r in ranked.where("fits").groupBy("shard").agg(F.sum("size").alias("n")).collect()}
        room = [r - taken.get(s, 0) for s, r in enumerate(room)]
        fit = ranked.where("fits").select("hub", "shard")
        homes = fit if homes is None else tables.stored(homes.union(fit), "homes")
        asking, turn = ranked.where("NOT fits").select("hub", "size", F.lit(None).cast("int").alias("shard")), turn + 1
        if asking.isEmpty():
            break
    homes = homes.select(F.col("hub").alias("h"), F.col("shard").alias("home"))
    return tables.stored(linked.join(homes, F.col("hub") == F.col("h"), "left").select("key", "row", "hub", F.col("home").alias("shard")), "settled")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size (UTF-8 bytes of the text and 1; null texts have no bytes), text_crc32 (of the text in UTF-8, null as
    empty), law (`rows`), shard, slot, grown_shard (null) of each row. Shards' row counts differ by one at most and slots are
    gapless from 0. Equal texts, null ones being equal to empty ones, are linked. Repeated rows count as rows; an empty
    table stays empty; other columns aren't read."""
    with Scratch(docs.sparkSession) as tables:
        body = F.coalesce(docs[text], F.lit(""))
        rows = docs.select(docs[key].alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.sha2(body, 256).alias("text_sha"))
        rows = tables.stored(rows.withColumn("row", F.monotonically_increasing_id()), "sizes")
        total = rows.count()
        capacity = [total // shards + (s < total % shards) for s in range(shards)]
        hubs = tables.stored(rows.groupBy("text_sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("text_sha").alias("of"), F.xxhash64("text_sha").alias("hub"), "n"), "hubs")
        both = tables.stored(rows.join(hubs, F.col("text_sha") == F.col("of"), "left").select("key", "row", "size", "text_crc32", F.col("hub"), F.when(F.col("n") * 4 > capacity[0], 0).when(F.col("n") * 64 > capacity[0], 1).otherwise(2).alias("level")), "linked")
        left, settled = capacity, None
        there = {r["level"] for r in both.where("hub IS NOT NULL").select("level").distinct().collect()}
        for level in sorted(there):
            level_rows = both.where(F.col("hub").isNotNull() & (F.col("level") == level))
            members = tables.stored(level_rows.select("key", "row", "hub", spread(left, unit("key", "row", F.lit(3))).alias("shard")), "labels")
            members = propagate(members, left, level > 0, tables, rounds)
            if level:
                members = settle(members, left, tables)
            held = {r["shard"]: r["n"] for r in members.where(F.col("shard").isNotNull()).groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
            left = [max(0, left[s] - held.get(s, 0)) for s in range(shards)]
            settled = members if settled is None else settled.union(members)
        if settled is None:
            settled = both.where("false").select("key", "row", "hub", F.lit(None).cast("int").alias("shard"))
        linked = settled.where(F.col("shard").isNotNull())
        # What a shard has over its capacity is freed.
        ranked = tables.stored(grouped_ranks(linked, ["shard"], ["hub", "row"], "slot"), "ranked")
        limit = F.element_at(F.array(*[F.lit(c) for c in capacity]), F.col("shard") + 1)
        fixed = ranked.where(F.col("slot") < limit)
        held = {r["shard"]: r["n"] for r in fixed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}
        # Hubs without a shard come first, one after another, so that each is cut into few parts.
        loose = settled.where(F.col("shard").isNull()).select("row", "hub")
        bases = grouped_ranks(loose.groupBy("hub").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), ["all"], ["hub"], "base", weight="n").select(F.col("hub").alias("h"), "base")
        first = tables.stored(grouped_ranks(loose, ["hub"], ["row"], "nth").join(bases, F.col("hub") == F.col("h")).select("row", (F.col("base") + F.col("nth")).alias("at")), "loose")
        free = both.where(F.col("hub").isNull()).select("row").union(ranked.where(F.col("slot") >= limit).select("row"))
        later = grouped_ranks(free.withColumn("all", F.lit(0)), ["all"], ["row"], "at").select("row", (F.col("at") + F.lit(first.count())).alias("at"))
        numbered = first.union(later)
        cases, low = [], 0
        for s in sorted(range(shards), key=lambda s: held.get(s, 0) - capacity[s]):
            have = held.get(s, 0)
            cases.append((low, low + capacity[s] - have, s, have))
            low += capacity[s] - have
        shard_of, slot_of = F.lit(None).cast("int"), F.lit(None).cast("long")
        for a, z, s, have in cases:
            inside = (F.col("at") >= a) & (F.col("at") < z)
            shard_of = F.when(inside, F.lit(s)).otherwise(shard_of)
            slot_of = F.when(inside, F.col("at") - a + have).otherwise(slot_of)
        written = tables.stored(fixed.select("row", "shard", "slot").union(numbered.select("row", shard_of, slot_of)), "placed")
        placed = written.withColumnRenamed("row", "row2")
        tables.keep(both, written)
        return both.join(placed, F.col("row") == F.col("row2")).select(F.col("key").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
