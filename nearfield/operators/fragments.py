"""Fragments: postings, pairs, packs and labels as tables by key, and the packages that answer queries from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions import cross_label
from nearfield.operators import order

WIDTHS = (1, 2, 4, 8)


def postings(tags: DataFrame, chunk: int) -> DataFrame:
    """tag, chunk, ids: the ascending ids of a tag, `chunk` in a row."""
    placed = order.id_ranks(tags, ["tag"], "id", "place").withColumn("chunk", F.floor(F.col("place") / chunk).cast("long"))
    return placed.groupBy("tag", "chunk").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def frozen(tags: DataFrame, low: int, high: int) -> DataFrame:
    """A vocabulary: the tags of a range that are there."""
    return tags.where(F.col("tag").between(low, high)).select("tag").distinct()


def vocabulary(tags: DataFrame, least: int) -> DataFrame:
    """Pairs a, b of a label and a group with at least so many rows."""
    a = tags.where("tag < 100").select("id", F.col("tag").alias("a"))
    b = tags.where("tag BETWEEN 100 AND 199").select("id", F.col("tag").alias("b"))
    return a.join(b, "id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b")


def pairs(tags: DataFrame, listed: DataFrame) -> DataFrame:
    """key (C|a|b), id, offset_in_primary: the rows of each listed pair, with their places in the smaller of its postings (the
    smaller tag's if they are alike)."""
    sizes = tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    placed = order.id_ranks(tags, ["tag"], "id", "place").join(sizes, "tag")
    side = lambda x: placed.select("id", F.col("tag").alias(x), F.col("place").alias(f"place_{x}"), F.col("n").alias(f"n_{x}"))
    both = listed.join(side("a"), "a").join(side("b"), ["b", "id"])
    first = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    return both.select(F.concat_ws("|", F.lit("C"), "a", "b").alias("key"), "id", F.when(first, F.col("place_a")).otherwise(F.col("place_b")).alias("offset_in_primary"))


def packs(tags: DataFrame, items: DataFrame) -> DataFrame:
    """tag, place, id, vec: each tag's vectors in posting order."""
    return order.id_ranks(tags, ["tag"], "id", "place").join(items.select("id", "vec"), "id").select("tag", "place", "id", "vec")


def crossed(tags: DataFrame, binned: DataFrame, sizes: tuple[int, ...], tokens: int) -> DataFrame:
    """id, label of each tag and valid bin of a row; binned: id, b0, b1 ... (-1: none)."""
    columns = [F.struct(F.lit(sum(sizes[:k])).alias("at"), F.col(f"b{k}").alias("bin")) for k in range(len(sizes))]
    each = binned.select("id", F.explode(F.filter(F.array(*columns), lambda x: x["bin"] >= 0)).alias("x"))
    return tags.join(each, "id").select("id", cross_label(F.col("tag"), F.col("x.at"), F.col("x.bin"), sum(sizes), tokens).alias("label"))


def workload(queries: DataFrame) -> DataFrame:
    """qid, family, a, b, lo, hi, c, d: 0 a label, 1 two labels, 2 a closed range of bins, 3 one of two pairs."""
    q = F.col("qid")
    return queries.select("qid", (F.floor(q / 50) % 4).cast("int").alias("family"), F.col("tag1").alias("a"), (q % 4).alias("b"), (q % 13).alias("lo"), (q % 13 + 3).alias("hi"), ((F.col("tag1") + 1) % 10).alias("c"), ((q + 1) % 4).alias("d"))


def admits(r: dict[str, Column]) -> Column:
    """The query's test of a row with labels a, b and a bin."""
    pair = lambda x, y: (r["a"] == F.col(x)) & (r["b"] == F.col(y))
    family = F.col("family")
    return F.when(family == 0, r["a"] == F.col("a")).when(family == 1, pair("a", "b")).when(family == 2, r["bin"].between(F.col("lo"), F.col("hi"))).otherwise(pair("a", "b") | pair("c", "d"))


def _row(rows: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    named = rows.select("id", F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("bin").alias("rbin"))
    return named, {"a": F.col("ra"), "b": F.col("rb"), "bin": F.col("rbin")}


def full_scan(w: DataFrame, rows: DataFrame, parts: int = 64) -> DataFrame:
    """No support: a stated query set against all rows, in blocks of rows."""
    named, r = _row(rows)
    dealt = named.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    asked = w.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return asked.join(dealt, "part").where(admits(r)).select("qid", "id")


def canonical(w: DataFrame, rows: DataFrame) -> DataFrame:
    """Postings of the first label (both first labels of a disjunction) or of the range's bins, and the rest tested."""
    named, r = _row(rows)
    atoms = w.where("family <> 2").withColumn("ra", F.explode(F.when(F.col("family") == 3, F.array_distinct(F.array("a", "c"))).otherwise(F.array("a"))))
    bins = w.where("family = 2").withColumn("rbin", F.explode(F.sequence("lo", "hi")))
    return atoms.join(named, "ra").where(admits(r)).select("qid", "id").union(bins.join(named, "rbin").select("qid", "id"))


def by_stretches(w: DataFrame, rows: DataFrame, cell: list[str]) -> DataFrame:
    """Cells of a layout that can hold admitted rows, from its offset table alone, and then the rows of their stretches."""
    cells = rows.select("a", "b", *(["bin"] if "bin" in cell else [])).distinct()
    named = cells.select(F.col("a").alias("ra"), F.col("b").alias("rb"), *([F.col("bin").alias("rbin")] if "bin" in cell else []))
    r = {"a": F.col("ra"), "b": F.col("rb"), "bin": F.col("rbin") if "bin" in cell else F.col("lo")}
    asked = w.withColumn("first", F.explode(F.when(F.col("family") == 3, F.array_distinct(F.array("a", "c"))).when(F.col("family") == 2, F.array(F.lit(-1).cast("long"))).otherwise(F.array("a"))))
    by_label = asked.where("family <> 2").join(named, F.col("first") == F.col("ra")).where(admits(r)).select("qid", "ra", "rb", *(["rbin"] if "bin" in cell else []))
    full, test = _row(rows)
    found = by_label.distinct().join(full, ["ra", "rb", *(["rbin"] if "bin" in cell else [])]).select("qid", "id")
    ranges = w.where("family = 2").withColumn("rbin", F.explode(F.sequence("lo", "hi"))).join(full, "rbin").select("qid", "id")
    return found.union(ranges)


def dyadic_cover(lo: Column, hi: Column, widths: tuple[int, ...] = WIDTHS) -> Column:
    """Array of (start, width): the aligned ranges that tile lo to hi, none of them inside a wider one that fits."""
    end = hi + 1
    inside = lambda at, w: (at >= lo) & (at + w <= end)

    def of_width(w: int, wide: int | None) -> Column:
        starts = F.transform(F.sequence(F.floor(lo / w), F.floor(hi / w)), lambda k: k * w)
        keep = lambda at: inside(at, w) if wide is None else inside(at, w) & ~inside(F.floor(at / wide) * wide, wide)
        return F.transform(F.filter(starts, keep), lambda at: F.struct(at.cast("long").alias("start"), F.lit(w).cast("long").alias("width")))

    return F.concat(*[of_width(w, wide) for w, wide in zip(widths, [*widths[1:], None])])


def keys(w: DataFrame) -> DataFrame:
    """qid, key of the fragments that answer a query: A<a>, P<a>_<b>, R<width>_<start>."""
    pair = lambda a, b: F.concat(F.lit("P"), a, F.lit("_"), b)
    ranges = F.transform(dyadic_cover(F.col("lo"), F.col("hi")), lambda s: F.concat(F.lit("R"), s["width"], F.lit("_"), s["start"]))
    family = F.col("family")
    atom = F.array(F.concat(F.lit("A"), "a"))
    chosen = F.when(family == 0, atom).when(family == 1, F.array(pair("a", "b"))).when(family == 2, ranges).otherwise(F.array_distinct(F.array(pair("a", "b"), pair("c", "d"))))
    return w.select("qid", F.explode(chosen).alias("key"))


def materialised(rows: DataFrame) -> DataFrame:
    """key, id of every atom, pair and dyadic range."""
    ranges = [F.concat(F.lit(f"R{w}_"), F.floor(F.col("bin") / w) * w) for w in WIDTHS]
    own = [F.concat(F.lit("A"), "a"), F.concat(F.lit("P"), "a", F.lit("_"), "b")]
    return rows.select("id", F.explode(F.array(*own, *ranges)).alias("key")).select("key", "id")
