"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, which the cluster names. Where it is unset,
    a temporary folder in local mode and the warehouse elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        root = tempfile.gettempdir() + "/quill-scratch" if local else spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


#: Whether Spark drops a query's shuffle files as it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """What is written within leaves no shuffle files behind: its readers begin at the table, and the files would lie until the driver happens to
    collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def written(df: DataFrame, what: str, plain: bool = False) -> DataFrame:
    """The rows as a Parquet table in the shared folder: cuts lineage and plans, survives lost executors, and
    fixes ids that were numbered on the way. plain: neither compressed nor coded, so that the size of the files is that of the rows. Spark goes by it
    when it picks what to broadcast, and rows that repeat may be a hundred times their files."""
    path = f"{scratch_root(df.sparkSession)}/quill-{what}-{uuid.uuid4().hex}"
    options = {"compression": "uncompressed", "parquet.enable.dictionary": "false"} if plain else {}
    with released(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str, least: int = 1, exact: bool = False) -> DataFrame:
    """The rows as a table whose files are dealt by key, sorted within: a join on the key reads them as they lie. At least as many buckets
    as a shuffle has partitions, so that Spark moves the other side of a join; or exactly the least
    number of buckets, for other sides that are repartitioned to that number by the key."""
    spark = df.sparkSession
    buckets = least if exact else max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
    name = f"quill_{what}_{uuid.uuid4().hex}"
    path = f"{scratch_root(spark)}/{name}"
    with released(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return spark.table(name)
