"""Helpers shared by the corpus operators: staging in the shared folder, columns, word rules."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word between the six ASCII white-space characters.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
#: Rows of two numbers that a join may broadcast, about 64 bytes each in memory.
MAX_IDS = 1_000_000
#: Tables that this session has put in its catalog, for ``clean_up``.
_TABLES: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or the context's checkpoint folder.

    Where neither is set, a local master gets a temporary folder, for there the driver and the
    executors are one process; on a cluster that is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return own.get()
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tillroll/{spark.sparkContext.applicationId}"


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again.

    This cuts the lineage on storage that outlives executors and fixes generated row ids.
    """
    spark = df.sparkSession
    path = staging_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def staged_table(df: DataFrame, key: str, n: int) -> DataFrame:
    """The same as a table whose files are dealt by key, so that joins on it shuffle the other side only."""
    spark = df.sparkSession
    path = staging_path(spark, "table")
    name = "tillroll_" + path.rsplit("-", 1)[1]
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").saveAsTable(name)
    _TABLES.add(name)
    return spark.table(name)


def sized(ids: DataFrame, most: int = MAX_IDS) -> DataFrame:
    """A staged frame of ids, to be broadcast if it has at most so many rows; else the optimizer chooses."""
    return F.broadcast(ids) if ids.count() <= most else ids


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def discard(*frames: DataFrame) -> None:
    """Delete staged frames that nothing reads any more; others are left alone."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            _delete(df.sparkSession, path)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application has staged, and its tables; call it when the results have been written."""
    for name in sorted(_TABLES):
        spark.sql(f"drop table if exists {name}")
    _TABLES.clear()
    _delete(spark, _own_dir(spark))


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, not whenever the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def by_position(df: DataFrame) -> DataFrame:
    """df with its columns renamed ``_k0``, ``_k1`` and so on, so that no name of the caller's can clash with an operator's."""
    return df.toDF(*(f"_k{i}" for i in range(len(df.columns))))


def position(df: DataFrame, col: str) -> str:
    """The name that ``by_position`` gives a column; names match as Spark matches them, without case."""
    return f"_k{[c.lower() for c in df.columns].index(col.lower())}"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else.

    ``lower`` does that fast where no other upper-case letter occurs; ``translate`` does the rest.
    """
    return F.when(text.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"), F.translate(text, UPPER, UPPER.lower())).otherwise(F.lower(text))


def parallel(spark: SparkSession) -> int:
    """Number of shuffle partitions in force."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
