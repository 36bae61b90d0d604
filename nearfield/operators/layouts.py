"""Layouts and fragments as tables: cube order, dyadic ranges, fixed blocks, hierarchies, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.operators import order


def cell_offsets(rows: DataFrame, cell: list[str]) -> DataFrame:
    """First place and size of each cell when rows are sorted by cell and id. Only cells are numbered in one task."""
    sizes = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(*cell).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def layout(rows: DataFrame, cell: list[str]) -> DataFrame:
    """Place of each row in that order: its cell's offset and its rank in the cell. Cells of any size are cut by id."""
    return order.id_ranks(rows, cell, "id", "r").join(cell_offsets(rows, cell).drop("n"), cell).select("id", *cell, (F.col("first") + F.col("r")).alias("position"))


def dyadic(rows: DataFrame, bin_: str, widths: tuple[int, ...] = (1, 2, 4, 8)) -> DataFrame:
    """Sizes of the aligned ranges of bins of each width."""
    wide = rows.withColumn("width", F.explode(F.array(*[F.lit(w) for w in widths])))
    return wide.groupBy("width", (F.floor(F.col(bin_) / F.col("width")) * F.col("width")).cast("long").alias("start")).agg(F.count(F.lit(1)).alias("n"))


def hierarchy(nodes: DataFrame, blocks: int = 200, widest: int = 128) -> DataFrame:
    """All aligned segments of 1, 2, 4 ... blocks. nodes: one row."""
    widths = [1 << k for k in range(widest.bit_length())]
    w = nodes.select(F.explode(F.array(*[F.lit(x) for x in widths])).alias("width"))
    return w.select("width", F.explode(F.sequence(F.lit(0), F.floor(F.lit(blocks) / F.col("width")).cast("int") - 1)).alias("k")).select(F.col("width").cast("long").alias("width"), (F.col("k") * F.col("width")).cast("long").alias("first"))


def overlapped(queries: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """qid, block, is_boundary, fraction: the blocks that a closed range meets, by their numbers (an equi-join follows)."""
    a, b = F.col(lo), F.col(hi)
    each = queries.select("qid", lo, hi, F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor(b / width).cast("long"))).alias("block"))
    inside = F.least(b, F.col("block") * width + width - 1) - F.greatest(a, F.col("block") * width) + 1
    return each.select("qid", "block", (inside < width).alias("is_boundary"), (inside / width).alias("fraction"))


def block_support(queries: DataFrame, rows: DataFrame, lo: str, hi: str, width: int) -> DataFrame:
    """Rows of the blocks a range meets; only those of boundary blocks are tested."""
    met = overlapped(queries, lo, hi, width).join(queries.select("qid", lo, hi), "qid")
    return met.join(rows, "block").where(~F.col("is_boundary") | F.col("attr").between(F.col(lo), F.col(hi))).select("qid", "id")


def dyadic_cover(first: int, end: int, widest: int = 1 << 30) -> list[tuple[int, int]]:
    """Aligned segments (first, width) of doubling widths that tile [first, end), the widest that fit from the left."""
    out = []
    while first < end:
        width = min(widest, first & -first or 1 << (end - first).bit_length())
        while first + width > end:
            width >>= 1
        out.append((first, width))
        first += width
    return out


def slices(wanted: DataFrame, cells: DataFrame) -> DataFrame:
    """wanted: qid, qa, qb, bin (one row a bin). Stretches (qid, kind, first, n) of a layout by (bin, a, b), from its offsets:
    the whole range of bins, a label's part of each bin, and a cell of each bin."""
    met = wanted.join(cells, "bin")
    stretch = lambda df, kind: df.agg(F.min("first").alias("first"), F.sum("n").alias("n")).select("qid", F.lit(kind).alias("kind"), "first", "n")
    label = met.where("a = qa")
    return stretch(met.groupBy("qid"), "range").union(stretch(label.groupBy("qid", "bin"), "a")).union(stretch(label.where("b = qb").groupBy("qid", "bin"), "cell"))


def admitted(tags: DataFrame, items: DataFrame, low: float, high: float, most: int) -> DataFrame:
    """tag, n, pct: the tags with low <= 100 n / N < high, the `most` largest, ties to the smaller tag."""
    total = items.agg(F.count(F.lit(1))).scalar()
    sizes = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n")).withColumn("pct", 100.0 * F.col("n") / total)
    return sizes.where((F.col("pct") >= low) & (F.col("pct") < high)).orderBy(F.desc("n"), "tag").limit(most)


def charges(rows: DataFrame, dims: int) -> DataFrame:
    """layout, vectors, offsets, maps, total in bytes: of the cube, of the pair-major order, and of packs by posting."""
    n = rows.agg(F.count(F.lit(1)).alias("rows"), *[F.count_distinct(c).alias(f"n_{c}") for c in ("a", "b", "bin")])
    size, pairs = F.col("rows"), F.col("n_a") * F.col("n_b")
    kind = lambda name, offsets, maps: F.struct(F.lit(name).alias("layout"), (size * dims).alias("vectors"), offsets.cast("long").alias("offsets"), (size * maps).alias("maps"))
    each = n.select(F.explode(F.array(kind("cube", 4 * (F.col("n_bin") * pairs + 1), 8), kind("pair_major", 4 * (pairs + 1), 8), kind("packs", F.lit(0), 4))).alias("x")).select("x.*")
    return each.withColumn("total", F.col("vectors") + F.col("offsets") + F.col("maps"))


def degree(n: Column) -> Column:
    """32 from 400,000 rows on, 24 from 100,000 on, else 16."""
    return F.when(n >= 400_000, 32).when(n >= 100_000, 24).otherwise(16)


def directory(keys: DataFrame) -> DataFrame:
    """key, rank: of objects that are there how many come before; key is a unique number."""
    return order.id_ranks(keys.withColumn("_all", F.lit(0)), ["_all"], "key", "rank").select("key", "rank")


def group_tags(members: DataFrame, group: list[str], tags: DataFrame) -> DataFrame:
    """The tags that occur among a group's members."""
    return members.join(tags.select("id", F.col("tag").alias("other")), "id").select(*group, "other").distinct()


def chunk_tags(tags: DataFrame, rows: int = 16) -> DataFrame:
    """For each tag's posting, cut into chunks of `rows`, the tags that occur among a chunk's rows."""
    place = order.id_ranks(tags, ["tag"], "id", "place").select(F.col("tag").alias("owner"), "id", F.floor(F.col("place") / rows).cast("long").alias("chunk"))
    return place.join(tags, "id").select("owner", "chunk", "tag").distinct()


def representatives(members: DataFrame, distance: Column) -> DataFrame:
    """The member nearest to its centroid, ties to the smaller id. members: cluster, id, vec, centroid."""
    order = Window.partitionBy("cluster").orderBy("dist", "id")
    return members.withColumn("dist", distance).withColumn("r", F.row_number().over(order)).where("r = 1").select("cluster", "id", "dist")
