"""What the corpus operators share: the shared folder, durable intermediate tables, text batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A null document number counts as the smallest one.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session, as in tests, gets a temporary one,
    and a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="gridwright-")
        atexit.register(shutil.rmtree, found, True)
        spark.sparkContext.setCheckpointDir(found)  # the setting itself can't be changed while a session runs
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def settled(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """settle, and the path of the table, for who deletes it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts the lineage, and survives lost executors."""
    return settled(df, label)[0]


class Scratch:
    """Settled tables that are deleted together, when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame, label: str) -> DataFrame:
        found, path = settled(df, label)
        self.paths.append(path)
        return found

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


#: A key is hot with more rows than this, and than one in so many of all; rows of a hot key go to so many tasks.
HOT_ROWS, HOT_SHARE, HOT_TASKS = 1000, 1000, 64


def even_join(left: DataFrame, right: DataFrame, key: str, spread: str, n: str) -> DataFrame:
    """left joined with the one row of right that has its key. n: right's column with the number of left's rows of the key;
    spread: a column of left in which rows of one key differ. Rows of a hot key are dealt over HOT_TASKS by it, and right
    has a hot row as often. There are no more than HOT_SHARE hot keys, so these are broadcast."""
    total = right.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(HOT_ROWS, total // HOT_SHARE)
    keys = F.broadcast(right.where(hot).select(key, F.lit(True).alias("_hot")))
    salted = left.join(keys, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(HOT_TASKS))).otherwise(0).cast("int")).drop("_hot")
    copied = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(HOT_TASKS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(copied.drop(n), [key, "_salt"]).drop("_salt")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def key_of(column: str):
    """A document number that can be compared and joined: null becomes NULL_ID."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NULL_ID))


def text_of(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Python gets at most so many texts at once: a batch of the default 10,000 takes room in the JVM and in Python several
    times over. A smaller number that the session has set stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of finished jobs now: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes tables of the shared folder that nothing will read again."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def bounded_sample(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Of more than `rows` rows those with the smallest hashes of keys. A count comes first, and a limit on the hash lets
    about four times as many rows through, so that no more than these are sorted, however large df is."""
    n, share = df.select(keys[0]).count(), 1.0
    if n > 4 * rows:
        share = 4 * rows / n
        df = df.where(F.xxhash64(*keys) < int(-(2**63) + share * 2**64))
    return df.orderBy(F.xxhash64(*keys), *keys).limit(rows)


def tidy() -> None:
    """At the end of a Python task: collects garbage and gives freed memory back, as workers live on between tasks."""
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
