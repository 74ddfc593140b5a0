"""Session-level helpers shared by all operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it in spark.checkpoint.dir.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if named is None and current.isDefined():
        return current.get()
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-")
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut(df: DataFrame, bare: bool = False) -> DataFrame:
    """Write df to the shared folder and go on from there: a reliable end of its lineage.

    bare: without what the planner expects of its size and values, which a checkpoint keeps. In a
    loop of joins the expected size is multiplied in each round, so that its digits grow as a power
    of the rounds, until reckoning with it takes the driver all its time and memory.
    """
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    if not bare:
        return done
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False), spark)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and go on from there: as cut, in columns and compressed."""
    folder = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """A scan of few small files, dealt out to all cores before a costly step; a scan with enough parts stays as it is.

    Only for plans without a shuffle, which would run to count its parts.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def small_or_none(df: DataFrame, max_rows: int) -> list | None:
    """The rows of df if there are at most max_rows, else None; never more than max_rows + 1 reach the driver."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """Hint a broadcast only after df was seen to hold at most max_rows; otherwise leave the join to the planner."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def with_salt(df: DataFrame, salts: int, *by: str | Column) -> DataFrame:
    """Spread the rows of each key over `salts` sub-keys by a hash of other columns."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))


def replicated(df: DataFrame, salts: int) -> DataFrame:
    """Copy the rows of the small side of a salted join once for each sub-key."""
    return df.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


#: White space at either end, in any script.
OUTER_BLANKS = r"(?U)^\s+|\s+$"


def key_of(col: str | Column) -> Column:
    """The form under which two texts are the same key: trimmed, case ignored; blank is null."""
    c = F.col(col) if isinstance(col, str) else col
    k = F.lower(F.regexp_replace(c, OUTER_BLANKS, ""))
    return F.when(k != "", k)
