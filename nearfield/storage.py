"""Tables between the steps of an operator, in the folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset: on a cluster a folder of the warehouse, which executors share as well, and only
    in local mode, where driver and executors are one process, a temporary folder of this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if spark.sparkContext.master.startswith("local"):
        return f"file://{tempfile.gettempdir()}/nearfield-checkpoints"
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/nearfield-checkpoints"


#: Bounds of whole texts in memory: rows of a Parquet vector, and rows and bytes of an Arrow batch.
BOUNDS = {"spark.sql.parquet.columnarReaderBatchSize": 500, "spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


@contextlib.contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside gets batches of at most BOUNDS; smaller settings stay, and all are as before afterwards. Settings
    that this version of Spark doesn't have are left out."""
    before: dict[str, str] = {}
    for name, most in BOUNDS.items():
        try:
            now = spark.conf.get(name)
        except PySparkException:
            continue
        before[name] = now
        if not now.isdigit() or int(now) > most:
            spark.conf.set(name, str(most))
    try:
        yield
    finally:
        for name, old in before.items():
            spark.conf.set(name, old)


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """The tables of a call: `with Scratch(spark) as tables`. At the end they are deleted, but for those that keep() names,
    which the result still reads. An open Scratch around this one takes those over as its own; else they are left to the cluster."""

    _open = threading.local()

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.tables: list[tuple[DataFrame, str]] = []
        self.kept: list[DataFrame] = []

    def __enter__(self) -> Scratch:
        self.outer: Scratch | None = getattr(Scratch._open, "now", None)
        Scratch._open.now = self
        return self

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        """Writes df once as Parquet and reads it back: a lost executor costs no recomputation and the lineage ends here."""
        path = f"{shared_folder(self.spark)}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.tables.append((out, path))
        return out

    def keep(self, *tables: DataFrame) -> None:
        self.kept += tables

    def drop(self, table: DataFrame) -> None:
        """Deletes a table that nothing reads any more."""
        for k, (df, path) in enumerate(self.tables):
            if df is table:
                remove(self.spark, path)
                del self.tables[k]
                return

    def __exit__(self, error, *_) -> None:
        Scratch._open.now = self.outer
        for df, path in self.tables:
            if error is not None or not any(df is k for k in self.kept):
                remove(self.spark, path)
            elif self.outer is not None:
                self.outer.tables.append((df, path))


def stored(df: DataFrame, what: str) -> DataFrame:
    """One table that the result reads."""
    with Scratch(df.sparkSession) as tables:
        out = tables.stored(df, what)
        tables.keep(out)
    return out
