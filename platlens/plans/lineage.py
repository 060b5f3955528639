"""Cutting lineage, and broadcasting only what has been measured."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; a row of such sides is well under 200 bytes.
BROADCAST_ROWS = 200_000


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the folder the cluster names in spark.checkpoint.dir; choose one of this machine only where none is set and all
    of Spark runs on it, as in tests."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="platlens-checkpoint-"))


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder, which all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder at a path of any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from reliable storage: survives the loss of any executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> bool:
    """Whether df has at most so many rows; looks at no more than one row beyond."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its row count is proven small, else df for a shuffled join."""
    return F.broadcast(df) if small(df, most) else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, where a scan gives fewer tasks than there are: for work that costs much more than a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[Column | str], name: str, weight: str | None = None) -> DataFrame:
    """df with the place of each row in a total order, from 0 (with `weight`, the sum of it over the rows before). Rows are
    range-partitioned by the order and kept, so that their partitions stay what they are; each partition is numbered by
    itself, behind the counts of those before it, of which there are as many as partitions."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = cut(df.repartitionByRange(*cols)).withColumn("__range", F.spark_partition_id())
    total = F.count("*") if weight is None else F.sum(weight)
    per = parts.groupBy("__range").agg(total.alias("__rows"))
    before = per.select("__range", (F.sum("__rows").over(Window.orderBy("__range")) - F.col("__rows")).alias("__before"))
    w = Window.partitionBy("__range").orderBy(*cols)
    own = F.row_number().over(w) - 1 if weight is None else F.sum(weight).over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(weight)
    return parts.join(F.broadcast(before), "__range").withColumn(name, (F.col("__before") + own).cast("bigint")).drop("__range", "__before")
