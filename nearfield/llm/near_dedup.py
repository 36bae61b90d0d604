"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A text's words are lowercased runs of letters, digits and underscores; its k-mers are five words in a row, each with its
occurrence number, so none repeats within a text (a shorter text is one k-mer). Each of 16 bands takes the 3 k-mers with the
smallest hashes, keeps them in text order and hashes that row, so texts meet in a band if they share the k-mers and
their order. Two texts that share m of u k-mers, in one order, miss each other in all bands with a chance of about
(1 - C(m, 3) / C(u, 3))^16. At a similarity of 0.8 that is 1e-5 for long texts ((1 - 0.8^3)^16), but more for short ones:
4e-5 at 8 of 10 k-mers and 3e-4 at 4 of 5.

Similarity is that of an alignment: L k-mers matched in order, L / (|A| + |B| - L). As a labelled k-mer occurs at most once
in a text, the best alignment is a longest increasing run of matched places; only matches inside the band |i - j| that a
similarity of the threshold allows can be part of one, so the others are left out.

Texts with the same words are one node, named by its row of words and never by a document's id. What is compared are the
nodes' k-mers, made once for the nodes that meet others. Buckets of up to 32 nodes are compared in all pairs of like lengths. In
a larger bucket each node is compared with a center, the node that shares most places in large buckets; those that are
similar to it are of its class. The large buckets of a center are one group, and what is outside the center's class there must
still be held against the group's other classes, without forming all pairs:

- a group of up to WIDE nodes is cut into blocks (at most 8 of members and 16 of outsiders, where texts are not very long), where a matrix product counts
  the shared k-mers, which bounds the alignment;
- a larger group, for which blocks would move every node ever more often, is split by prefixes first. Two texts of similarity s share at least one of the (1 - s) * n + 1 k-mers that are
  rarest among all such groups. So nodes of different classes that share none of those can't be linked, and those that share
  one meet in its bucket. These buckets go through the same steps: all pairs, or a center, and blocks for what is left.

Both ways are exact, so no link between classes is lost, and no pair is a row of its own before its bucket asks for it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm import units
from nearfield.llm.storage import Scratch

WORD = re.compile(r"\w+")
K, SIMILARITY, BANDS, TAKEN, ALL_PAIRS, BLOCK, WIDE = 5, 0.8, 16, 3, 32, 1024, 8192
KNOWN_WORDS = 150_000


class Hasher:
    def __init__(self, k: int = K, bands: int = BANDS, taken: int = TAKEN):
        self.k, self.bands, self.taken, self.known = k, bands, taken, {}
        odd = np.random.default_rng(10).integers(0, 2**63, (2, bands), dtype=np.uint64)
        self.a, self.b = odd[0] * np.uint64(2) + np.uint64(1), odd[1]

    def words(self, text: str) -> np.ndarray:
        known, out = self.known, []
        if len(known) > KNOWN_WORDS:
            known.clear()
        for w in WORD.findall(text.lower()):
            h = known.get(w)
            if h is None:
                h = known[w] = xxhash.xxh64_intdigest(w.encode())
            out.append(h)
        return np.array(out, np.uint64)

    def kmers(self, words: np.ndarray) -> np.ndarray:
        """Hashes of the occurrence-labelled k-mers, in text order."""
        n = len(words)
        if not n:
            return words
        if n < self.k:
            return np.array([xxhash.xxh64_intdigest(words.tobytes())], np.uint64)
        h = np.zeros(n - self.k + 1, np.uint64)
        for i in range(self.k):
            h = h * np.uint64(0x9E3779B97F4A7C15) + words[i : n - self.k + 1 + i]
            h ^= h >> np.uint64(29)
        order = np.argsort(h, kind="stable")
        ranked = h[order]
        new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        if not new.all():
            first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
            nth = np.empty(len(h), np.uint64)
            nth[order] = (np.arange(len(h)) - first).astype(np.uint64)
            h = h + nth * np.uint64(0xD6E8FEB86659FD93)
        return h

    def bands_of(self, kmers: np.ndarray) -> np.ndarray:
        """A key for each band; keys of different bands differ."""
        n = len(kmers)
        if not n:
            return np.empty(0, np.int64)
        take, keys = min(self.taken, n), np.empty(self.bands, np.uint64)
        step = max(1, (1 << 20) // n)  # bounded memory for long texts
        for s in range(0, self.bands, step):
            h = kmers[:, None] * self.a[None, s : s + step] + self.b[None, s : s + step]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(33)
            at = np.sort(np.argpartition(h, take - 1, axis=0)[:take] if n > take else np.tile(np.arange(n)[:, None], (1, h.shape[1])), axis=0)
            key = np.arange(s, s + h.shape[1], dtype=np.uint64) + np.uint64(1)
            for row in at:
                key = (key ^ kmers[row]) * np.uint64(0x94D049BB133111EB)
                key ^= key >> np.uint64(32)
            keys[s : s + step] = key
        return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """That of the best alignment if it is at least `least`, else 0. a, b: labelled k-mers without repeats."""
    total = len(a) + len(b)
    if not total or not len(a) or not len(b):
        return 0.0
    need = int(np.ceil(least * total / (1 + least) - 1e-9))
    if need > min(len(a), len(b)):
        return 0.0
    order = np.argsort(b)
    at = np.minimum(np.searchsorted(b, a, sorter=order), len(b) - 1)
    hit = b[order[at]] == a
    i = np.flatnonzero(hit)
    j = order[at[i]]
    low, high = need - len(b), len(a) - need  # i - j of a match in an alignment of `need` or more
    j = j[(i - j >= low) & (i - j <= high)]
    if len(j) < need:
        return 0.0
    if np.all(j[1:] > j[:-1]):
        matched = len(j)
    else:
        tails: list[int] = []
        for x in j.tolist():
            k = bisect_left(tails, x)
            tails[k : k + 1] = [x]
        matched = len(tails)
    return matched / (total - matched) if matched >= need else 0.0


def sketches(docs: DataFrame, key: str, text: str, k: int, bands: int, taken: int) -> DataFrame:
    """id (the key as it is), text_key (SHA-256 of the text), word_key (names the row of words), n_kmers, keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(k, bands, taken)
        for b in units.pieces(batches, "t"):
            name, n, keys = [], [], []
            for t in b.column("t").to_pylist():
                words = hasher.words(t or "")
                kmers = hasher.kmers(words)
                name.append(xxhash.xxh3_128_digest(words.tobytes()))
                n.append(len(kmers))
                keys.append(hasher.bands_of(kmers))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("text_key"), pa.array(name, pa.binary()), pa.array(n, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "text_key", "word_key", "n_kmers", "keys"])

    inner = docs.select(docs[key].alias("id"), text_key(docs[text]).alias("text_key"), docs[text].alias("t"))
    schema = T.StructType([inner.schema["id"], inner.schema["text_key"], T.StructField("word_key", T.BinaryType()), T.StructField("n_kmers", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    return inner.mapInArrow(run, schema)


def text_key(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def kmers_of(nodes: DataFrame, docs: DataFrame, text: str, k: int) -> DataFrame:
    """node, kmers (unsigned 64-bit integers in a row) of nodes (node, text_key). A text that many rows hold moves once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(k)
        for b in units.pieces(batches, "t"):
            made = [hasher.kmers(hasher.words(t or "")).tobytes() for t in b.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(made, pa.binary())], names=["node", "kmers"])

    texts = docs.select(text_key(docs[text]).alias("key"), docs[text].alias("t")).groupBy("key").agg(F.first("t").alias("t"))
    return nodes.join(texts, F.col("text_key") == F.col("key")).select("node", "t").mapInArrow(run, "node long, kmers binary")


def verified(pairs: DataFrame, kmers: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose nodes have at least that similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = ([np.frombuffer(v, np.uint64) for v in b.column(c).to_pylist()] for c in ("ka", "kb"))
            sim = np.array([similarity(x, y, least) for x, y in zip(*sides)], float)
            ok = pa.array(sim >= least)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(ok), b.column("b").filter(ok), pa.array(sim[sim >= least])], names=["a", "b", "similarity"])
        units.release()

    first = pairs.join(kmers.select(F.col("node").alias("a"), F.col("kmers").alias("ka")), "a")
    both = first.join(kmers.select(F.col("node").alias("b"), F.col("kmers").alias("kb")), "b")
    return both.select("a", "b", "ka", "kb").mapInArrow(run, "a long, b long, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """id, class_id (the smallest id) of each node of the edges (a, b): every round a node takes the smallest label of its
    neighbours and itself, then that label's label, until nothing changes. Labels are tables in the shared folder."""
    with Scratch(edges.sparkSession) as tables:
        both = tables.stored(edges.select("a", "b").union(edges.select("b", "a")), "edges")
        last = tables.stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label")), "labels")
        while True:
            labels = last.select("id", "label")
            seen = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("label").alias("m"))
            near = labels.join(seen, F.col("id") == F.col("a")).select("id", F.col("label").alias("old"), F.least("label", "m").alias("l"))
            jump = labels.select(F.col("id").alias("of"), F.col("label").alias("next"))
            new = tables.stored(near.join(jump, F.col("l") == F.col("of"), "left").select("id", "old", F.least("l", F.coalesce("next", "l")).alias("label")), "labels")
            tables.drop(last)
            last = new
            if new.where("label <> old").isEmpty():
                tables.keep(new)
                return new.select("id", F.col("label").alias("class_id"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many k-mers each of left shares with each of right."""
    out = np.zeros((len(left), len(right)), np.float32)
    flat = [(np.concatenate(x) if x else np.empty(0, np.uint64), np.repeat(np.arange(len(x)), [len(v) for v in x])) for x in (left, right)]
    both = np.intersect1d(np.unique(flat[0][0]), np.unique(flat[1][0]), assume_unique=True)
    if not len(both):
        return out
    at = []
    for tokens, rows in flat:
        k = np.minimum(np.searchsorted(both, tokens), len(both) - 1)
        hit = both[k] == tokens
        order = np.argsort(k[hit], kind="stable")
        at.append((k[hit][order], rows[hit][order]))
    for c in range(0, len(both), columns):
        sides = []
        for (k, rows), n in zip(at, (len(left), len(right))):
            a, z = np.searchsorted(k, (c, c + columns))
            m = np.zeros((n, min(columns, len(both) - c)), np.float32)
            m[rows[a:z], k[a:z] - c] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def links_across(groups: DataFrame, kmers: DataFrame, least: float, tables: Scratch) -> DataFrame:
    """groups: g, node, n_kmers, class_id, main (the class of the group's center). Links (a, b) that join each node outside
    the main class to each other class of its group to which it has one. A group is cut into blocks of outsiders and of
    members, and each pair of blocks is a task's."""
    outside = F.col("class_id") != F.col("main")
    sizes = groups.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("n_kmers").alias("w"), F.count_if(outside).alias("u"), F.sum(F.when(outside, F.col("n_kmers")).otherwise(0)).alias("uw")).where("u > 0")
    cut = lambda n, w, rows, size: F.ceil(F.greatest(F.col(n) / rows, F.col(w) / size)).cast("int")
    sizes = tables.stored(sizes.select(F.col("g").alias("of"), cut("u", "uw", 512, 1 << 18).alias("ub"), cut("n", "w", BLOCK, 1 << 19).alias("xb")), "groups")
    rows = groups.join(sizes, F.col("g") == F.col("of"))
    full = tables.stored(rows.join(kmers.withColumnRenamed("node", "id"), F.col("node") == F.col("id")).select("g", "node", "class_id", "main", "ub", "xb", "kmers"), "group-kmers")
    part = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = full.where(outside).select("g", part("ub", 1).alias("i"), every("xb").alias("j"), "node", "class_id", "kmers")
    right = full.select(F.col("g").alias("h"), every("ub").alias("i"), part("xb", 2).alias("j"), *[F.col(c).alias(c) for c in ("node", "class_id", "kmers")])

    def compare(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {"a": [], "b": [], "similarity": []}
        if len(x) and len(y):
            kx, ky = ([np.frombuffer(v, np.uint64) for v in f["kmers"]] for f in (x, y))
            nx, ny = (np.array([len(v) for v in f]) for f in (kx, ky))
            cx, cy = x["class_id"].to_numpy(), y["class_id"].to_numpy()
            total = nx[:, None] + ny[None, :]
            counts = shared_counts(kx, ky)
            able = (counts >= np.ceil(least * total / (1 + least) - 1e-9)) & (cx[:, None] != cy[None, :]) & (total > 0)
            for i in np.flatnonzero(able.any(axis=1)).tolist():
                found = set()
                near = np.flatnonzero(able[i])
                for j in near[np.argsort(-counts[i, near], kind="stable")].tolist():
                    if cy[j] not in found and (sim := similarity(kx[i], ky[j], least)) >= least:
                        found.add(cy[j])
                        a, b = sorted((int(x["node"].iloc[i]), int(y["node"].iloc[j])))
                        out["a"].append(a)
                        out["b"].append(b)
                        out["similarity"].append(sim)
        return pd.DataFrame({"a": np.array(out["a"], np.int64), "b": np.array(out["b"], np.int64), "similarity": np.array(out["similarity"], float)})

    return left.groupBy("g", "i", "j").cogroup(right.groupBy("h", "i", "j")).applyInPandas(compare, "a long, b long, similarity double")


def bucketed(members: DataFrame, least: float, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """members: key, node, n_kmers, class_id (nodes of one class needn't be compared). (pairs a < b to be verified, groups
    g, node, n_kmers): all pairs of small buckets, and of each group its center g with every other node."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumnRenamed("key", "of")
    placed = tables.stored(members.join(sizes, F.col("key") == F.col("of")).select("key", "node", "n_kmers", "class_id", "n"), "bucketed")
    few = placed.where(F.col("n") <= ALL_PAIRS).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("node", "n_kmers", "class_id"))).alias("m"))
    close = lambda x, y: F.least(x, y) >= least * F.greatest(x, y)  # noqa: E731  no alignment of more unequal lengths reaches `least`
    worth = lambda x, y: (y["node"] > x["node"]) & (y["class_id"] != x["class_id"]) & close(x["n_kmers"], y["n_kmers"])
    two = F.flatten(F.transform("m", lambda x: F.transform(F.filter("m", lambda y: worth(x, y)), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    pairs = few.select(F.explode(two).alias("p")).select("p.a", "p.b")
    large = placed.where(F.col("n") > ALL_PAIRS)
    weight = large.groupBy("node").agg(F.sum("n").alias("w")).withColumnRenamed("node", "m")
    weighed = tables.stored(large.join(weight, F.col("node") == F.col("m")).select("key", "node", "n_kmers", "class_id", "w"), "large")
    centers = weighed.groupBy("key").agg(F.max(F.struct(F.col("w"), (-F.col("node")).alias("x"), F.col("n_kmers"), F.col("class_id"))).alias("c"))
    centers = centers.select(F.col("key").alias("of"), (-F.col("c.x")).alias("g"), F.col("c.n_kmers").alias("gn"), F.col("c.class_id").alias("gc"))
    groups = tables.stored(weighed.join(centers, F.col("key") == F.col("of")).select("g", "gn", "gc", "node", "n_kmers", "class_id").distinct(), "members")
    star = groups.where((F.col("g") != F.col("node")) & (F.col("gc") != F.col("class_id")) & close(F.col("gn"), F.col("n_kmers")))
    star = star.select(F.least("g", "node").alias("a"), F.greatest("g", "node").alias("b"))
    return tables.stored(pairs.union(star).distinct(), "pairs"), groups.select("g", "node", "n_kmers")


def with_main(groups: DataFrame, classes: DataFrame, tables: Scratch) -> DataFrame:
    """groups with class_id of each node, main (that of the center), n and u (nodes, and those outside main, of the group);
    only groups that have any outside."""
    own = tables.stored(groups.join(classes, F.col("node") == F.col("id"), "left").select("g", "node", "n_kmers", F.coalesce("class_id", "node").alias("class_id")), "classed")
    main = own.where("g = node").select(F.col("g").alias("of"), F.col("class_id").alias("main"))
    both = tables.stored(own.join(main, F.col("g") == F.col("of")).select("g", "node", "n_kmers", "class_id", "main"), "mained")
    sizes = both.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_id") != F.col("main")).alias("u")).where("u > 0").withColumnRenamed("g", "of")
    return both.join(sizes, F.col("g") == F.col("of")).drop("of")


def prefixes(groups: DataFrame, kmers: DataFrame, least: float, tables: Scratch) -> DataFrame:
    """key, node, n_kmers, class_id: each node of groups in the buckets of its group and of the k-mers in its prefix, which
    are the rarest ones of all these nodes. K-mers of one node alone are counted in the prefix but make no bucket."""
    nodes = groups.select("node").distinct()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = [np.frombuffer(v, np.int64) for v in b.column("kmers").to_pylist()]
            node = np.repeat(b.column("node").to_numpy(), [len(v) for v in values])
            flat = np.concatenate(values) if values else np.empty(0, np.int64)
            for a in range(0, len(flat), 1 << 18):
                yield pa.RecordBatch.from_arrays([pa.array(node[a : a + (1 << 18)]), pa.array(flat[a : a + (1 << 18)])], names=["node", "kmer"])

    single = tables.stored(nodes.join(kmers, "node").mapInArrow(read, "node long, kmer long"), "single-kmers")
    often = single.groupBy("kmer").agg(F.count(F.lit(1)).alias("f")).withColumnRenamed("kmer", "k")
    ranked = single.join(often, F.col("kmer") == F.col("k")).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("f", "kmer"))).alias("m"))
    size = F.size("m") - F.ceil(F.size("m") * F.lit(least) - 1e-9).cast("int") + 1
    kept = ranked.select(F.col("node").alias("of"), F.explode(F.filter(F.slice("m", F.lit(1), size), lambda x: x["f"] > 1)).alias("x"))
    return groups.join(kept, F.col("node") == F.col("of")).select(F.xxhash64("g", "x.kmer").alias("key"), "node", "n_kmers", "class_id")


def word_classes(docs: DataFrame, key: str, text: str, tables: Scratch, k: int = K, least: float = SIMILARITY, bands: int = BANDS, taken: int = TAKEN) -> DataFrame:
    """id, word_key, label of each row of docs: rows are of one class if their labels are equal."""
    made = tables.stored(sketches(docs, key, text, k, bands, taken), "sketches")
    nodes = made.groupBy("word_key").agg(F.min("text_key").alias("text_key"), F.first("n_kmers").alias("n_kmers"), F.first("keys").alias("keys"))
    nodes = tables.stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs, groups = bucketed(nodes.select(F.explode("keys").alias("key"), "node", "n_kmers", F.col("node").alias("class_id")), least, tables)
    met = pairs.select(F.col("a").alias("m")).union(pairs.select("b")).union(groups.select("node")).distinct()
    kmers = tables.stored(kmers_of(nodes.join(met, F.col("node") == F.col("m")).select("node", "text_key"), docs, text, k), "kmers")
    links = tables.stored(verified(pairs, kmers, least).select("a", "b"), "links")
    classes = components(links)
    left = tables.stored(with_main(groups, classes, tables), "left")
    if not left.isEmpty():
        links = links.union(tables.stored(links_across(left.where(F.col("n") <= WIDE), kmers, least, tables).select("a", "b"), "links"))
        wide = left.where(F.col("n") > WIDE)
        if not wide.isEmpty():
            pairs, groups = bucketed(prefixes(wide, kmers, least, tables), least, tables)
            links = links.union(tables.stored(verified(pairs, kmers, least).select("a", "b"), "links"))
            rest = with_main(groups, components(links), tables)
            links = links.union(tables.stored(links_across(rest, kmers, least, tables).select("a", "b"), "links"))
        classes = components(links.distinct())
    told = nodes.join(classes, F.col("node") == F.col("id"), "left").select(F.col("word_key").alias("w"), F.coalesce("class_id", "node").alias("label"))
    return tables.stored(made.select("id", "word_key").join(told, F.col("word_key") == F.col("w")).select("id", "word_key", "label"), "classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """key (a long), class_id, kept of each row; `how`: the parameters of word_classes.
    Classes are the components of the links, a link being a verified similarity of `least` or more. Texts with the same words are
    always of one class, also texts without words (null, empty), which are like no other. Of each class the row with the
    smallest key stays; null keys come last, and of rows that share the smallest key, those with the smallest hash of their
    words. Rows that repeat key and words are alike. class_id is the key of the row that stays; where it is null, or
    stands for rows of other classes too, the class has a negative number of its own instead. An empty table gives no rows;
    other columns aren't read."""
    with Scratch(docs.sparkSession) as tables:
        rows = word_classes(docs.select(docs[key].cast("long").alias("id"), docs[text].alias("t")), "id", "t", tables, **how)
        order = F.struct(F.col("id").isNull().alias("last"), F.col("id"), F.col("word_key"))
        firsts = rows.groupBy("label").agg(F.min(order).alias("first"))
        shared = rows.where("id IS NOT NULL").groupBy("id").agg(F.min("label").alias("a"), F.max("label").alias("z")).where("a <> z").select(F.col("id").alias("of"))
        number = F.when(F.col("first.id").isNotNull() & F.col("of").isNull(), F.col("first.id")).otherwise(-1 - F.col("label"))
        named = firsts.join(shared, F.col("first.id") == F.col("of"), "left").select(F.col("label").alias("l"), "first", number.alias("class_id"))
        named = tables.stored(named, "names")
        tables.keep(rows, named)
        return rows.join(named, F.col("label") == F.col("l")).select(F.col("id").alias(key), "class_id", (order == F.col("first")).alias("kept"))
