"""Secret scan with corpus-wide ownership frequency.

Candidates are found by patterns; how many owners and repositories carry the same value tells widely copied
examples from owner-specific, live-looking credentials.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The patterns of the contract.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"(AKIA[A-Z0-9]{14,})"
HEX = r"([0-9a-f]{16,})"
#: Least characters of an assigned value; the other two patterns hold their least length, which finds the same runs.
ASSIGN_CHARS = 12
#: Further candidates: long runs that mix digits and both cases. They count only while one owner alone has the value.
MIXED = r"([A-Za-z0-9_-]{24,})"
#: Order of kinds that start at the same place.
KINDS = ("assign", "access", "hex", "mixed")
#: A value that so many owners or more share is an example, not a live credential.
EXAMPLE_OWNERS = 2

SPAN = "struct<start:bigint,kind:int,end:bigint,digest:string>"


#: Matches whose spans are appended to one array; arrays of so many are joined, so the work is about linear in the matches.
BLOCK = 256


def _spans(text: Column, pattern: str, group: int, kind: int, keep: str) -> Column:
    """Spans of the leftmost non-overlapping matches. Start = length of the gaps and matches before it.

    keep: SQL condition on x.`2`, the value of a match (x.`0` is the gap before it, x.`1` the match). Starts are
    summed over blocks of BLOCK matches first, then within each block.
    """
    quoted = pattern.replace("\\", "\\\\").replace("'", "\\'")
    found = F.expr(
        f"""transform(array(arrays_zip(split(__text, '{quoted}', -1), regexp_extract_all(__text, '{quoted}', 0), regexp_extract_all(__text, '{quoted}', {group}))), all ->
            transform(array(transform(sequence(0, (size(all) - 1) div {BLOCK}), b -> slice(all, b * {BLOCK} + 1, {BLOCK}))), blocks ->
                flatten(transform(
                    arrays_zip(blocks, slice(aggregate(blocks, array(0L), (acc, block) -> array_append(acc, element_at(acc, -1) + aggregate(block, 0L, (n, x) -> n + length(x.`0`) + coalesce(length(x.`1`), 0)))), 1, size(blocks))),
                    p -> aggregate(p.blocks, named_struct('at', p.`1`, 'out', cast(array() as array<{SPAN}>)),
                        (acc, x) -> if(x.`1` is null, acc, named_struct(
                            'at', acc.at + length(x.`0`) + length(x.`1`),
                            'out', if({keep}, array_append(acc.out, named_struct('start', acc.at + length(x.`0`), 'kind', {kind}, 'end', acc.at + length(x.`0`) + length(x.`1`), 'digest', sha2(x.`2`, 256))), acc.out))),
                        acc -> acc.out)))
            )[0])[0]"""
    )
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{SPAN}>)"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform(array_sort({spans}), x -> concat(element_at(array({names}), x.kind + 1), ':', x.start, ':', x.end)), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Spans of secrets in every whole text.

    One row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans (all of them as
    kind:start:end by start and kind), n_live, n_example and secrets (array of kind, start, end, digest, owners,
    repositories, live). Offsets are code points, ends exclusive. Null texts count as empty; empty texts have no
    span; rows with equal id and text get equal results. A null owner or repository is one value of its own.
    An empty table gives no rows. Values are compared by SHA-256; frequencies are reduced to distinct
    (value, owner, repository) before they are counted, and places of a frequent value are dealt out when they meet
    its count, so a value in a third of all rows is no hot task.
    """
    repo = F.concat_ws("/", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("?")) for c in repo_cols])
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{owner_col}`").cast("string"), F.lit("?")).alias("__owner"),
        repo.alias("__repo"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"),
    )
    text = F.col("__text")
    mixed = "x.`2` rlike '[0-9]' and x.`2` rlike '[a-z]' and x.`2` rlike '[A-Z]'"
    spans = F.concat(
        _spans(text, ASSIGN, 2, 0, f"length(x.`2`) >= {ASSIGN_CHARS}"),
        _spans(text, ACCESS, 1, 1, "true"),
        _spans(text, HEX, 1, 2, "true"),
        _spans(text, MIXED, 1, 3, mixed),
    )
    found = common.cut(rows.select("doc_id", "__owner", "__repo", spans.alias("__found")).withColumn("__key", F.expr("xxhash64(__found)")), "secrets")
    hits = found.filter("size(__found) > 0").select("doc_id", "__key", "__owner", "__repo", F.explode("__found").alias("s")).select("doc_id", "__key", "__owner", "__repo", "s.*")
    frequency = (
        hits.select("digest", "__owner", "__repo").distinct().groupBy("digest").agg(F.count_distinct("__owner").alias("owners"), F.count_distinct("__repo").alias("repositories"))
    )
    places = common.cut(hits.select("doc_id", "__key", "start", "kind", "end", "digest").distinct(), "places")
    judged = (
        common.even_join(places, frequency, "digest")
        .withColumn("live", F.col("owners") < EXAMPLE_OWNERS)
        .filter("kind < 3 or live")
        .groupBy("doc_id", "__key")
        .agg(F.collect_list(F.struct("start", "kind", "end", "digest", "owners", "repositories", "live")).alias("__secrets"))
    )
    judged = judged.select(F.col("doc_id").alias("__id"), F.col("__key").alias("__judged"), "__secrets")
    kind = "array<struct<start:bigint,kind:int,end:bigint,digest:string,owners:bigint,repositories:bigint,live:boolean>>"
    whole = found.join(judged, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__judged")), "left").withColumn("__all", F.expr(f"array_sort(coalesce(__secrets, cast(array() as {kind})))"))
    count = lambda what: F.expr(f"cast(size(filter(__found, x -> x.kind = {what})) as bigint)")
    return whole.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.expr(f"sha2({_joined('filter(__found, x -> x.kind < 3)')}, 256)").alias("base_sha256"),
        F.expr(_joined("__all")).alias("spans"),
        F.expr("cast(size(filter(__all, x -> x.live)) as bigint)").alias("n_live"),
        F.expr("cast(size(filter(__all, x -> not x.live)) as bigint)").alias("n_example"),
        F.expr(f"transform(__all, x -> named_struct('kind', element_at(array({', '.join(repr(k) for k in KINDS)}), x.kind + 1), 'start', x.start, 'end', x.end, 'digest', x.digest, 'owners', x.owners, 'repositories', x.repositories, 'live', x.live))").alias("secrets"),
    )
