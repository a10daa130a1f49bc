"""Exact dedup by progressive refinement: length, then a hash of a prefix, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes hashed in the second step.
PREFIX_BYTES = 256
#: Key sets of at most so many rows (about 24 bytes each) are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000
#: Beyond BROADCAST_ROWS, the groups with more than this part of all copies (so at most as many groups) are still broadcast.
HOT_GROUPS = 10_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        text.alias("__text"),
        F.octet_length(text).alias("__len"),
        F.xxhash64(F.substring(text.cast("binary"), 1, PREFIX_BYTES)).alias("__head"),
    )


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of two or more equal texts: digest, keep_id (largest id), group_size.

    Each step keeps only keys that two rows share, so whole texts are hashed for the rows that are left after
    length and prefix. Counts are combined before each shuffle, so a hot length or text is no hot task.
    A null text counts as empty. An empty table gives no groups. Null ids are counted but never kept
    unless a group has no other id.
    """
    rows = _keyed(docs, id_col, text_col)
    again = F.count(F.lit(1)).alias("__n")
    lengths = common.cut(rows.groupBy("__len").agg(again).filter("__n > 1").select("__len"), "lengths")
    rows = rows.join(common.small(lengths, BROADCAST_ROWS), "__len", "left_semi")
    heads = common.cut(rows.groupBy("__len", "__head").agg(again).filter("__n > 1").select("__len", "__head"), "heads")
    rows = rows.join(common.small(heads, BROADCAST_ROWS), ["__len", "__head"], "left_semi")
    return (
        rows.select("__id", F.sha2(F.col("__text").cast("binary"), 256).alias("digest"))
        .groupBy("digest")
        .agg(F.max("__id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )


def _with_groups(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows left joined to groups by __digest, without a hot task.

    Few groups are broadcast. Else only the hot ones are, at most HOT_GROUPS, and their rows are not shuffled; the
    others are met by shuffle. That second way reads rows twice.
    """
    if groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(groups), "__digest", "left")
    is_hot = F.col("__size") > groups.agg(F.sum("__size")).first()[0] / HOT_GROUPS
    hot = F.broadcast(groups.filter(is_hot))
    others = rows.join(hot, "__digest", "left_anti").join(groups.filter(~is_hot).hint("merge"), "__digest", "left")
    return rows.join(hot, "__digest").unionByName(others)


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_sha256, keep_id, group_size and kept; of equal texts the row with the largest id is kept.

    Null texts count as empty; a text without copies is its own group of one. Rows that repeat the id which
    stays are all marked kept (drop_copies leaves one of them). A group whose ids are all null keeps its null.
    Input columns named like the new ones are replaced.
    """
    new = ["text_sha256", "keep_id", "group_size", "kept"]
    groups = common.cut(copy_groups(docs, id_col, text_col), "groups")
    groups = groups.select(F.col("digest").alias("__digest"), F.col("keep_id").alias("__keep"), F.col("group_size").alias("__size"))
    digest = F.sha2(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary"), 256)
    rows = docs.withColumn("__digest", digest)
    row_id = F.col(f"`{id_col}`")
    keep = F.when(F.col("__size").isNull(), row_id).otherwise(F.col("__keep"))
    return _with_groups(rows, groups).select(
        *[F.col(f"`{c}`") for c in docs.columns if c.lower() not in new],
        F.col("__digest").alias("text_sha256"),
        keep.alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        row_id.eqNullSafe(keep).alias("kept"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that mark_copies keeps, one for each text, with the columns of docs."""
    kept = mark_copies(docs.withColumn("__copy_of", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), id_col, text_col).filter("kept")
    alone, heads = kept.filter("group_size = 1"), kept.filter("group_size > 1").dropDuplicates(["text_sha256"])
    return alone.unionByName(heads).select("__copy_of.*")
