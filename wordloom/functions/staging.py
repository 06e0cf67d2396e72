"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The session names it in spark.checkpoint.dir. Where that is unset a local session gets a folder of
    its own; on a cluster that would be a different folder on every machine, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="wordloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/wordloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost
    executor costs only the tasks that read from it."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: Bytes of files under which a table may be one row group, and so one task, however many cores there are.
FEW_BYTES = 1 << 30


def spread(df: DataFrame, path: str) -> DataFrame:
    """df, read from path, dealt out over the cores if its files are small. Larger tables have row groups enough, and
    aren't shuffled."""
    spark = df.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return df.repartition(spark.sparkContext.defaultParallelism) if size < FEW_BYTES else df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The distinct keys of df, dealt out four to a core. Each makes many rows, so Spark, which sees only how few bytes they
    have now, mustn't put them into fewer tasks. One more, since the partitions of a shuffle it would take for its own."""
    return df.select(key).distinct().repartition(4 * df.sparkSession.sparkContext.defaultParallelism + 1, key)


def discard(df: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = df.sparkSession
    for f in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """df with `number`, 1 and on in this order. The rows are range-sorted and written; a number is the place
    in a partition and the count of those before, so that no task holds all rows."""
    rows = staged(df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    # A row a partition.
    ahead = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__ahead"))
    return rows.withColumn("__part", part).join(ahead, "__part").withColumn("number", F.col("__ahead") + place + 1).drop("__at", "__part", "__ahead")
