"""Session defaults and table access."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(name: str = "quillstream", **conf: str) -> SparkSession:
    """A session with UTC time and adaptive execution; everything else is the cluster's business."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's setting, else the context's checkpoint folder.

    A folder of this machine is made only where neither is set and all runs on this machine, as in tests.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        base = tempfile.mkdtemp(prefix="quillstream-")
    return base.rstrip("/")


def settle(df: DataFrame) -> DataFrame:
    """Cuts lineage in the shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage as ``settle`` does, by a Parquet table in that folder: columns are compressed, and a column that isn't asked
    for isn't read. Files of shuffles that no plan holds any more may go."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quill-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Adds ord, the place from 1 in ``order``: the place in a sorted partition and the rows of the partitions before it."""
    d = settle(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = d.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row a partition
    return d.join(F.broadcast(parts), "_part").withColumn("ord", F.col("_at").bitwiseAND((1 << 33) - 1) + F.col("_before") + 1).drop("_at", "_part", "_before")


#: Rows up to which a table is sent to all executors; a larger one is shuffled instead.
SMALL = 100_000


def few(d: DataFrame, most: int = SMALL) -> DataFrame:
    """A table, to be broadcast if it has ``most`` rows at most."""
    return F.broadcast(d) if d.limit(most + 1).count() <= most else d


def small(df: DataFrame, most: int = SMALL) -> DataFrame:
    """df, to be broadcast if it has ``most`` rows at most: they are counted, and computed once."""
    return few(settle(df), most)
