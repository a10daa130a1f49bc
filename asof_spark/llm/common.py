"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Most bytes of an Arrow batch that is sent to a Python worker, so that its memory does not follow the length of texts.
BATCH_BYTES = 4 << 20


#: Temporary folders of local applications that set none.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one on a local master where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    application = spark.sparkContext.applicationId
    if application not in _OWN:
        _OWN[application] = tempfile.mkdtemp(prefix="spark-shared-")
    return _OWN[application]


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by BATCH_BYTES; a smaller setting of the caller stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name).lower().rstrip("b")) > BATCH_BYTES:
        spark.conf.set(name, BATCH_BYTES)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: it is computed once, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def map_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], kind: str, name: str = "doc_id") -> DataFrame:
    """df.mapInPandas(run, kind) that keeps the longs of `name` exact: pandas would make a column with nulls floating point.

    run gets 0 for a null and has to give one frame for each that it gets, with the same rows.
    """

    def exact(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nulls = []

        def filled() -> Iterator[pd.DataFrame]:
            for f in frames:
                if len(f):
                    nulls.append(f.pop("__null").to_numpy())
                    yield f

        for out in run(filled()):
            yield out.assign(__null=nulls.pop(0))

    own = F.col(name)
    rows = df.withColumns({"__null": own.isNull(), name: F.coalesce(own, F.lit(0).cast("long"))})
    return rows.mapInPandas(exact, f"{kind}, __null boolean").withColumn(name, F.when(~F.col("__null"), own)).drop("__null")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """df with a broadcast hint when a count shows at most max_rows rows (of a few fixed-width columns), else df as it is.

    df should be cheap to count, as after cut().
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def even_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", least: int = 256) -> DataFrame:
    """left.join(right, key, how) by shuffle, with rows of a hot key of left dealt out over many tasks.

    A key is hot over 1 / 10,000 of the rows of left (and over `least`), so at most 10,000 keys are; their rows of
    left get salts and those of right are repeated once for each salt. how: inner or left. left is read three times and
    should be cheap to read, as after cut().
    """
    counts = cut(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")), "key-counts")
    rows = counts.agg(F.sum("__n")).first()[0] or 0
    limit = max(least, rows // 10_000)
    hot = F.broadcast(counts.filter(F.col("__n") > limit).select(key, F.ceil(F.col("__n") / limit).cast("int").alias("__k")))
    salts = F.coalesce("__k", F.lit(1))
    # a null key meets nothing, so its rows can lie anywhere
    own = F.when(F.col(f"`{key}`").isNull(), F.lit(1 << 20)).otherwise(salts)
    salted = left.withColumn("__row", F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])).join(hot, key, "left")
    salted = salted.withColumn("__salt", F.pmod("__row", own).cast("int")).drop("__k", "__row")
    repeated = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__k")
    return salted.hint("merge").join(repeated.hint("merge"), [key, "__salt"], how).drop("__salt")


def meet(left: DataFrame, right: DataFrame, key: str, max_rows: int) -> DataFrame:
    """Left join on a key of which left may hold one value very often: right is broadcast when a count shows at most max_rows rows, else even_join."""
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), key, "left")
    return even_join(left, right, key, "left")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """df less the columns that an operator is about to add; names compare without case, as in Spark."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
