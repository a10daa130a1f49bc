"""Table sinks: sorted, partitioned, versions switched by a manifest."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; on a local master without one, a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: computed once for all that use it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and a function to its Path objects."""
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def _latest(spark: SparkSession, path: str) -> int:
    """Number of the newest manifest; 0 without one."""
    fs, at = _files(spark, path)
    folder_ = at(f"{path}/manifests")
    names = [s.getPath().getName() for s in fs.listStatus(folder_)] if fs.exists(folder_) else []
    return max((int(n) for n in names if n.isdigit()), default=0)


def write_table(df: DataFrame, path: str, partition: str = "season", order: tuple[str, ...] = ("date", "game_pk"), fmt: str = "parquet") -> None:
    """Replace the table at path by df, all partitions at once; read_table reads it.

    Files go to a version folder of their own, rows of a partition value dealt over several tasks by the first order column and
    sorted in files. Then a manifest that names the folder is renamed to the next number, which is one step: until then, and
    if anything fails before, readers have the old version. Of two writers that meet the second gets an error. The version
    before the new one stays for readers under way; older ones are removed.
    """
    spark = df.sparkSession
    number, version = _latest(spark, path) + 1, f"v-{uuid.uuid4().hex}"
    rows = df.repartition(partition, order[0]).sortWithinPartitions(partition, *order)
    rows.write.format(fmt).option("header", True).partitionBy(partition).save(f"{path}/{version}")
    fs, at = _files(spark, path)
    draft = at(f"{path}/manifests/.{version}")
    out = fs.create(draft)
    out.write(bytearray(version.encode()))
    out.close()
    if fs.exists(at(f"{path}/manifests/{number}")) or not fs.rename(draft, at(f"{path}/manifests/{number}")):
        fs.delete(draft, False)
        raise FileExistsError(f"version {number} of {path} was written by another")
    for old in range(max(1, number - 2), number - 1):
        gone = _version(spark, path, old)
        if gone:
            fs.delete(at(f"{path}/{gone}"), True)
            fs.delete(at(f"{path}/manifests/{old}"), False)


def _version(spark: SparkSession, path: str, number: int) -> str | None:
    fs, at = _files(spark, path)
    manifest = f"{path}/manifests/{number}"
    return spark.read.text(manifest).first()[0] if fs.exists(at(manifest)) else None


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet") -> DataFrame:
    """The newest version of a table of write_table, as it is now; later versions do not change the frame."""
    version = _version(spark, path, _latest(spark, path))
    if version is None:
        raise FileNotFoundError(f"no table at {path}")
    return spark.read.schema(schema).format(fmt).option("header", True).load(f"{path}/{version}")


def ratings_snapshot(ratings: DataFrame, stamp: Column) -> DataFrame:
    """team_id, rating (two decimals), updated_at; highest first."""
    return ratings.select("team_id", F.round("rating", 2).alias("rating"), stamp.alias("updated_at")).orderBy(F.desc("rating"), "team_id")
