"""Readers and create-only sinks."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A workload file with a header; lines that start with # are comments. What doesn't fit the schema is an error."""
    return spark.read.csv(path, sep="\t", header=True, schema=schema, comment="#", mode="FAILFAST")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.json(path, schema=schema, mode="FAILFAST")


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    """Rows that parse(data, path) yields as pandas frames, a file at a time. One task reads a file, so large sets come in many."""

    def rows(batches):
        for b in batches:
            for data, name in zip(b["content"], b["path"]):
                yield from parse(bytes(data), name)

    return spark.read.format("binaryFile").load(path).select("content", "path").mapInPandas(rows, schema)


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def _vectors(data: bytes, at: int, n: int, d: int, kind: str, stride: int = 0):
    import numpy as np
    import pandas as pd

    item, out = ("<f4", "<f4") if kind == "float" else ("u1", "<i2")
    m = np.frombuffer(data, item, n * (d + stride), at).reshape(n, d + stride)[:, stride:]
    for a in range(0, n, 4096):
        yield pd.DataFrame({"id": range(a, min(n, a + 4096)), "vec": list(m[a : a + 4096].astype(out))})


def read_dense(spark: SparkSession, path: str, kind: str = "float") -> DataFrame:
    """(id, vec) of files with a header of two unsigned 32-bit integers, rows and dimensions, and then the rows; kind: float
    or byte. A file whose length isn't that of its header is an error."""

    def parse(data: bytes, name: str):
        n, d = struct.unpack_from("<II", data)
        _need(len(data) == 8 + n * d * (4 if kind == "float" else 1), f"{name}: the file's length isn't that of its header")
        yield from _vectors(data, 8, n, d, kind)

    return _binary(spark, path, parse, f"id long, vec array<{'float' if kind == 'float' else 'smallint'}>")


def read_raw(spark: SparkSession, path: str, dims: int) -> DataFrame:
    """(id, vec) of files of 32-bit floats without a header; the length must be a whole number of rows."""

    def parse(data: bytes, name: str):
        _need(len(data) % (4 * dims) == 0, f"{name}: not a whole number of rows")
        yield from _vectors(data, 0, len(data) // (4 * dims), dims, "float")

    return _binary(spark, path, parse, "id long, vec array<float>")


def read_fvecs(spark: SparkSession, path: str, dims: int, whole_bytes: bool = False) -> DataFrame:
    """(id, vec) of files whose rows each begin with their number of dimensions. whole_bytes: values must be whole, 0 to 255,
    and become small integers."""
    import numpy as np

    def parse(data: bytes, name: str):
        size = 4 * (dims + 1)
        _need(len(data) % size == 0, f"{name}: not a whole number of rows")
        n = len(data) // size
        _need(bool((np.frombuffer(data, "<i4", n * (dims + 1)).reshape(n, dims + 1)[:, 0] == dims).all()), f"{name}: another number of dimensions")
        for part in _vectors(data, 0, n, dims, "float", 1):
            if whole_bytes:
                values = np.stack(part["vec"].to_numpy()) if len(part) else np.empty((0, dims))
                _need(bool(np.isfinite(values).all() and (values >= 0).all() and (values <= 255).all() and (values == np.round(values)).all()), f"{name}: not whole bytes")
                part["vec"] = list(values.astype("<i2"))
            yield part

    return _binary(spark, path, parse, f"id long, vec array<{'smallint' if whole_bytes else 'float'}>")


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(id, tag) of sparse matrix files: rows, columns, entries as unsigned 64-bit, row offsets, 32-bit columns that
    ascend within a row."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        n, _, nnz = struct.unpack_from("<3Q", data)
        off = np.frombuffer(data, "<u8", n + 1, 24).astype(np.int64)
        tags = np.frombuffer(data, "<u4", nnz, 24 + 8 * (n + 1)).astype(np.int32)
        ids = np.repeat(np.arange(n), np.diff(off))
        _need(off[-1] == nnz and not np.any((np.diff(ids) == 0) & (np.diff(tags) <= 0)), f"{name}: offsets or tags out of order")
        yield pd.DataFrame({"id": ids, "tag": tags})

    return _binary(spark, path, parse, "id long, tag int")


def read_subset(spark: SparkSession, path: str) -> DataFrame:
    """(place, id) of files with a 32-bit count and as many 32-bit ids."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        (n,) = struct.unpack_from("<i", data)
        _need(n >= 0 and len(data) >= 4 + 4 * n, f"{name}: a short subset")
        yield pd.DataFrame({"place": range(n), "id": np.frombuffer(data, "<i4", n, 4)})

    return _binary(spark, path, parse, "place long, id int")


def read_offsets(spark: SparkSession, path: str, blocks: int, rows: int) -> DataFrame:
    """(block, first, n) of a file of blocks + 1 rising unsigned 64-bit offsets from 0 to rows."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        _need(len(data) == 8 * (blocks + 1), f"{name}: another number of blocks")
        off = np.frombuffer(data, "<u8").astype(np.int64)
        _need(off[0] == 0 and off[-1] == rows and not np.any(np.diff(off) < 0), f"{name}: offsets don't rise from 0 to the rows")
        yield pd.DataFrame({"block": range(blocks), "first": off[:-1], "n": np.diff(off)})

    return _binary(spark, path, parse, "block long, first long, n long")


def read_ranges(spark: SparkSession, path: str, clauses: int = 1, domain: int = 5000) -> DataFrame:
    """(qid, clause, lo, hi) of a file of 32-bit closed ranges, `clauses` a query; 0 <= lo <= hi < domain."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        _need(len(data) % (8 * clauses) == 0, f"{name}: not a whole number of queries")
        r = np.frombuffer(data, "<i4").reshape(-1, 2)
        _need(bool((r[:, 0] >= 0).all() and (r[:, 1] < domain).all() and (r[:, 0] <= r[:, 1]).all()), f"{name}: a range outside the domain")
        at = np.arange(len(r))
        yield pd.DataFrame({"qid": at // clauses, "clause": (at % clauses).astype("int32"), "lo": r[:, 0], "hi": r[:, 1]})

    return _binary(spark, path, parse, "qid long, clause int, lo int, hi int")


def read_negations(spark: SparkSession, path: str) -> DataFrame:
    """(task, anchor, neg, qid), a row a query, of a JSON array of {anchor, neg, qids}; other keys are skipped, and a task
    without one of these or with an empty list is an error."""
    import json

    import pandas as pd

    def parse(data: bytes, name: str):
        rows = []
        for k, task in enumerate(json.loads(data)):
            _need(all(x in task for x in ("anchor", "neg", "qids")) and task["neg"] and task["qids"], f"{name}: task {k} lacks an anchor, exclusions or queries")
            rows += [(k, int(task["anchor"]), [int(x) for x in task["neg"]], int(q)) for q in task["qids"]]
        yield pd.DataFrame(rows, columns=["task", "anchor", "neg", "qid"])

    return _binary(spark, path, parse, "task int, anchor int, neg array<int>, qid int")


def read_truth(spark: SparkSession, path: str, rows: int) -> DataFrame:
    """(qid, rank, id, dist) of a file with N and K, ids and then distances. Places after the last neighbour hold the
    largest id and infinity and give no rows; ids are under `rows` and don't repeat, and (distance, id) rises."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        n, k = struct.unpack_from("<II", data)
        _need(len(data) == 8 + 8 * n * k, f"{name}: the file's length isn't that of its header")
        ids = np.frombuffer(data, "<u4", n * k, 8).reshape(n, k).astype(np.int64)
        dist = np.frombuffer(data, "<f4", n * k, 8 + 4 * n * k).reshape(n, k)
        there = ids != 2**32 - 1
        _need(not np.any(there[:, 1:] & ~there[:, :-1]) and bool(np.isposinf(dist[~there]).all()), f"{name}: wrong padding")
        _need(bool((ids[there] < rows).all() and np.isfinite(dist[there]).all() and (dist[there] >= 0).all()), f"{name}: an id or distance out of bounds")
        rises = (dist[:, 1:] > dist[:, :-1]) | ((dist[:, 1:] == dist[:, :-1]) & (ids[:, 1:] > ids[:, :-1]))
        _need(bool((rises | ~there[:, 1:]).all()) and all(len(set(r[t].tolist())) == t.sum() for r, t in zip(ids, there)), f"{name}: neighbours out of order or repeated")
        q, r = np.nonzero(there)
        yield pd.DataFrame({"qid": q, "rank": (r + 1).astype("int32"), "id": ids[there], "dist": dist[there].astype("float64")})

    return _binary(spark, path, parse, "qid long, rank int, id long, dist double")


def read_truth_lists(spark: SparkSession, path: str, most: int = 100_000) -> DataFrame:
    """(qid, rank, id) of a file of lists, each of a 32-bit length and as many 32-bit ids."""
    import numpy as np
    import pandas as pd

    def parse(data: bytes, name: str):
        at, qid = 0, 0
        while at < len(data):
            (k,) = struct.unpack_from("<i", data, at)
            _need(0 <= k <= most and at + 4 + 4 * k <= len(data), f"{name}: a bad list {qid}")
            yield pd.DataFrame({"qid": [qid] * k, "rank": np.arange(1, k + 1, dtype="int32"), "id": np.frombuffer(data, "<u4", k, at + 4).astype("int64")})
            at, qid = at + 4 + 4 * k, qid + 1

    return _binary(spark, path, parse, "qid long, rank int, id long")


def read_truth_tens(spark: SparkSession, path: str, queries: int, k: int = 10) -> DataFrame | None:
    """(qid, rank, id) of a file of k 32-bit ids a query, without those under 0; none where there is no file of that size, as such
    truth is optional."""
    import numpy as np
    import pandas as pd

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*").load(path).where(F.col("length") == 4 * k * queries) if _exists(spark, path) else None
    if found is None or found.isEmpty():
        return None

    def parse(data: bytes, name: str):
        ids = np.frombuffer(data, "<i4")
        at = np.arange(len(ids))
        yield pd.DataFrame({"qid": at // k, "rank": (at % k + 1).astype("int32"), "id": ids.astype("int64")})[ids >= 0]

    return _binary(spark, path, parse, "qid long, rank int, id long")


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def read_clusters(spark: SparkSession, centroids: str, members: str) -> tuple[DataFrame, DataFrame]:
    """(tag, cluster, centroid) and (tag, cluster, id) of files <tag>_centroids.bin (clusters, bytes a row, rows) and
    <tag>_members.bin (clusters, 64-bit offsets, 32-bit ids)."""
    import re

    import numpy as np
    import pandas as pd

    tag_of = lambda name: int(re.search(r"(\d+)_\w+\.bin$", name)[1])

    def middle(data: bytes, name: str):
        n, d = struct.unpack_from("<ii", data)
        _need(len(data) == 8 + n * d, f"{name}: the file's length isn't that of its header")
        m = np.frombuffer(data, "u1", n * d, 8).reshape(n, d).astype("<i2")
        yield pd.DataFrame({"tag": tag_of(name), "cluster": range(n), "centroid": list(m)})

    def inside(data: bytes, name: str):
        (n,) = struct.unpack_from("<i", data)
        off = np.frombuffer(data, "<i8", n + 1, 4)
        _need(off[0] == 0 and not np.any(np.diff(off) < 0) and len(data) == 4 + 8 * (n + 1) + 4 * off[-1], f"{name}: wrong offsets")
        yield pd.DataFrame({"tag": tag_of(name), "cluster": np.repeat(np.arange(n), np.diff(off)), "id": np.frombuffer(data, "<i4", int(off[-1]), 4 + 8 * (n + 1))})

    return _binary(spark, centroids, middle, "tag int, cluster int, centroid array<smallint>"), _binary(spark, members, inside, "tag int, cluster int, id int")


def read_vocabulary(spark: SparkSession, path: str, names: tuple[str, ...] = ("tag",)) -> DataFrame:
    """Units of a text file, one a line, each once: the first numbers of a line, as many as names. Two of them are a pair, the
    smaller first, and must differ. Empty lines and those that begin with # don't count; a line that doesn't begin with such
    numbers is an error."""
    line = F.ltrim("value")
    lines = spark.read.text(path).where((F.trim("value") != "") & ~line.startswith("#"))
    numbers = F.transform(F.slice(F.split(F.trim("value"), r"\s+"), 1, len(names)), lambda x: F.when(x.rlike(r"^\d{1,10}$"), x.cast("long")))
    units = lines.select(F.array_sort(numbers).alias("u"), "value")
    wrong = (F.size("u") < len(names)) | F.exists("u", lambda x: x.isNull() | (x > 2**31 - 1)) | (F.size(F.array_distinct("u")) < F.size("u"))
    checked = units.select(F.when(wrong, F.raise_error(F.concat(F.lit("not a unit: "), "value"))).otherwise(F.col("u")).alias("u"))
    return checked.select(*[F.get("u", F.lit(k)).cast("int").alias(n) for k, n in enumerate(names)]).distinct()


def padded(results: DataFrame, k: int) -> DataFrame:
    """qid, ids, dists: each query's k ids and distances in order of rank, the rest -1 and infinity."""
    g = results.where(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "dist"))).alias("r"))  # k rows at most
    fill = lambda name, v: F.slice(F.concat(F.transform("r", lambda x: x[name]), F.array_repeat(F.lit(v), k)), 1, k)
    return g.select("qid", fill("id", -1).cast("array<long>").alias("ids"), fill("dist", float("inf")).alias("dists"))


def publish_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Text files with a header where nothing is yet; lists are written with spaces between their values."""
    plain = [F.concat_ws(" ", F.transform(f.name, lambda x: x.cast("string"))).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name) for f in df.schema]
    df.select(*plain).write.mode("errorifexists").option("header", True).option("sep", sep).csv(path)


def publish(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Writes df where nothing is yet; an existing path is an error. by: clusters the files by these columns."""
    if by:
        df = df.repartitionByRange(*by).sortWithinPartitions(*by)
    df.write.mode("errorifexists").parquet(path)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
