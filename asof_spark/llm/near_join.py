"""n-gram Jaccard join: MinHash LSH forest for candidates, exact verification, classes of near duplicates.

Every text is a set of hashed word shingles. Texts with equal sets are one entry. Each of TREES tries holds the
signatures of all entries in sorted order; common prefixes with the neighbours tell how deep an entry meets others.
All prefixes start at full length and are shortened, entry by entry, until a partner at the threshold would have been
met with the target recall: first where the shorter prefix meets nobody, then where it meets the fewest. So crowded
branches stay at long prefixes when other trees make up for them. Entries that meet under a prefix are verified in
blocks: each entry lies in one block, blocks hold a bounded number of shingles of about one length, and each pair
of blocks that share a prefix is compared once, so a large group makes few rows and loses no pair.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, TARGET_RECALL = 20, 8, 0.9999
#: Shingles and entries of a block, about; one long text can be over it by itself.
BLOCK_SHINGLES, BLOCK_ENTRIES = 50_000, 200
#: Rows of a few keys (at most 64 bytes each, so 13 MB) that are broadcast; more go by shuffle.
BROADCAST_ROWS = 200_000
CACHED_WORDS = 50_000


def least_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL, deepest: int = DEEPEST) -> int:
    """One less than the longest prefix that reaches the recall when all trees use it: the room in which depths can differ."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return max(1, depth - 1)


class WordHashes(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, word: str) -> int:
        found = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str, hashes: dict, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of `words` words; a shorter text is one run; a text without words has none."""
    w = np.array(list(map(hashes.__getitem__, text.split())), dtype=np.uint64)
    if not len(w):
        return w
    runs = max(1, len(w) - words + 1)
    h = np.full(runs, min(len(w), words), dtype=np.uint64)
    for i in range(min(words, len(w))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + _mixed(w[i : i + runs])
    return np.unique(_mixed(h))


def _hashes(length: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return rng.integers(0, 1 << 63, trees * length, dtype=np.uint64), rng.integers(0, 1 << 63, trees * length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(sets: np.ndarray, xor: np.ndarray, odd: np.ndarray) -> bytes:
    """16 bits of the least hash of the set under every function, big-endian, tree after tree."""
    low = np.full(len(xor), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(sets), 1024):
        low = np.minimum(low, ((sets[at : at + 1024, None] ^ xor) * odd).min(0))
    return (_mixed(low) >> np.uint64(48)).astype(">u2").tobytes()


def _signer(words: int, length: int, trees: int):
    xor, odd = _hashes(length, trees)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            rows = []
            for text in b["text"]:
                s = shingles(text, hashes, words)
                rows.append((hashlib.blake2b(s.tobytes(), digest_size=16).digest(), len(s), signature(s, xor, odd)) if len(s) else (None, 0, None))
            yield pd.concat([b[["doc_id", "own"]], pd.DataFrame(rows, columns=["set", "n", "signature"], index=b.index)], axis=1)

    return sign


def _climber(depth: int, floor: int):
    """tree, prefix, set in sorted order -> the rows that share `floor` values or more with a neighbour: met (how many values) and crowd (log2 of the rows that share 1.. values, as far as a batch shows).

    The neighbours beyond the edges of a partition are not known and count as equal, which only keeps a row more.
    """

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, depth

        def kept(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table, int]:
            nonlocal before
            tree = rows.column("tree").to_numpy()
            values = np.frombuffer(b"".join(rows.column("prefix").to_pylist()), ">u2").reshape(-1, depth)
            equal = (values[1:] == values[:-1]) & (tree[1:] == tree[:-1])[:, None]
            common_values = np.where(equal.all(1), depth, equal.argmin(1))
            up, down = np.concatenate([[before], common_values]), np.concatenate([common_values, [depth]])
            crowd = np.empty((len(tree), depth), dtype=np.uint8)
            for d in range(1, depth + 1):
                run = np.cumsum(np.concatenate([[0], common_values < d]))
                crowd[:, d - 1] = np.log2(np.bincount(run))[run]
            n = len(tree) - (not last)
            before = int(up[-1])
            some = np.flatnonzero(np.maximum(up, down)[:n] >= floor)
            met = np.maximum(up, down)[some].astype(np.int8)
            found = rows.take(pa.array(some)).append_column("met", pa.array(met)).append_column("crowd", pa.array([c.tobytes() for c in crowd[some]], pa.binary()))
            return found.combine_chunks().to_batches()[0] if len(some) else None, rows.slice(n)

        for b in batches:
            rows = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])]).combine_chunks()
            found, held = kept(rows, False)
            if found is not None:
                yield found
        if held is not None:
            found, _ = kept(held, True)
            if found is not None:
                yield found

    return climb


def depths(met: np.ndarray, crowd: np.ndarray, threshold: float, recall: float, floor: int, deepest: int) -> np.ndarray:
    """Prefix lengths of every entry (row) in every tree (column): shortened one by one until 1 - prod(1 - threshold ** depth) reaches the recall.

    met: values shared with the nearest neighbour, under floor where there is none. crowd[..., d - 1]: how many
    share d values. A prefix that is longer than met meets nobody, so it is shortened down to there at once.
    """
    depth = np.clip(met + 1, floor, deepest)
    miss = lambda d: np.log1p(-(float(threshold) ** d))
    want = math.log(1 - recall) if recall < 1 else -math.inf
    rows = np.arange(len(depth))
    while True:
        needy = (miss(depth).sum(1) > want) & (depth > floor).any(1)
        if not needy.any():
            return depth
        shorter = np.maximum(depth - 1, 1)
        cost = np.where(depth > floor, np.take_along_axis(crowd, shorter[:, :, None] - 1, 2)[:, :, 0] * 16.0 - depth, np.inf)
        tree = cost.argmin(1)
        depth[rows[needy], tree[needy]] -= 1


def _chooser(trees: int, deepest: int, floor: int, threshold: float, recall: float):
    """set and its rows of the tries -> set, keys of all its prefixes that others share, and which of them it asks for."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("rows")
            owner = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            rows = lists.flatten()
            tree, met_rows = rows.field("tree").to_numpy(), rows.field("met").to_numpy().astype(np.int64)
            met = np.zeros((b.num_rows, trees), dtype=np.int64)
            crowd = np.zeros((b.num_rows, trees, deepest), dtype=np.int64)
            met[owner, tree] = met_rows
            crowd[owner, tree] = np.frombuffer(b"".join(rows.field("crowd").to_pylist()), np.uint8).reshape(-1, deepest)
            asked = depths(met, crowd, threshold, recall, floor, deepest)[owner, tree]
            values = np.frombuffer(b"".join(rows.field("prefix").to_pylist()), ">u2").reshape(-1, deepest).astype(np.uint64)
            key, columns = tree.astype(np.uint64), []
            for d in range(1, deepest + 1):
                key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, d - 1] + np.uint64(1))
                some = np.flatnonzero((d >= floor) & (met_rows >= d))
                columns.append((owner[some], key[some].view(np.int64), asked[some] == d))
            at, keys, asks = (np.concatenate(c) for c in zip(*columns, strict=True))
            yield pa.RecordBatch.from_arrays([b.column("set").take(pa.array(at)), pa.array(keys), pa.array(asks)], ["set", "prefix", "asked"])

    return choose


def _gatherer(words: int):
    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for b in batches:
            out = b.assign(s=[shingles(t, hashes, words).tobytes() for t in b["text"]])
            same = [hashlib.blake2b(s, digest_size=16).digest() == key for s, key in zip(out["s"], out["set"], strict=True)]
            yield out.loc[same, ["set", "block", "rows", "s"]]

    return gather


def _verifier(threshold: float):
    share = threshold / (1 + threshold)

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for left, right, same in zip(b["left"], b["right"], b["same"], strict=True):
                out = _links(left, left if same else right, bool(same), share)
                if out is not None:
                    yield out

    return verify


def _links(left, right, same: bool, share: float) -> pd.DataFrame | None:
    """Links of two blocks: linked documents and texts of every entry, and a spanning star of each connected part."""
    sets = [[np.frombuffer(e["s"], np.uint64) for e in side] for side in (left, right)]
    flat = [np.concatenate(s) for s in sets]
    shared = np.intersect1d(*flat) if not same else np.unique(flat[0])
    sizes, marks = [], []
    for s, f in zip(sets, flat, strict=True):
        n = np.array([len(x) for x in s])
        owner, at = np.repeat(np.arange(len(s)), n), np.searchsorted(shared, f)
        hit = (at < len(shared)) & (shared[np.minimum(at, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool)
        m = np.zeros((len(s), max(1, len(shared))), dtype=np.float32)
        m[owner[hit], at[hit]] = 1
        sizes.append(n)
        marks.append(m)
    both = marks[0] @ marks[1].T
    linked = both >= share * (sizes[0][:, None] + sizes[1][None, :]) - 1e-6
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    names = [e["set"] for e in left] + ([] if same else [e["set"] for e in right])
    rows = [np.array([e["rows"] for e in side]) for side in (left, right)]
    n = len(left)
    if same:
        near, documents = linked, linked @ rows[0]
    else:
        near = np.zeros((len(names), len(names)), dtype=bool)
        near[:n, n:], near[n:, :n] = linked, linked.T
        documents = np.concatenate([linked @ rows[1], linked.T @ rows[0]])
    texts, star, at = near.sum(1), np.arange(len(names)), None
    while at is None or (at != star).any():
        at = star
        star = np.minimum(star, np.where(near, star[None, :], len(names)).min(1))
    some = np.flatnonzero(texts)
    return pd.DataFrame({"set": [names[i] for i in some], "centre": [names[star[i]] for i in some], "documents": documents[some].astype("int64"), "texts": texts[some].astype("int64")})


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the undirected edges (a, b): the smallest node of its connected part.

    Each round takes the smallest label among the neighbours and then the label of that label, so chains halve;
    tables are cut between rounds. Labels are combined before each shuffle, and the edges of a node with many
    (the centre of a star) and the nodes of a large part are dealt out over tasks.
    """
    both = common.cut(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = common.cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = common.even_join(both, labels.withColumnRenamed("node", "a"), "a").groupBy("b").agg(F.min("label").alias("near"))
        joined = labels.join(near, labels["node"] == near["b"], "left").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label"))
        joined = common.cut(joined, "labels")
        if joined.filter("label < before").isEmpty():
            return joined.select("node", "label")
        up = joined.select(F.col("node").alias("label"), F.col("label").alias("up"))
        labels = common.cut(common.even_join(joined.select("node", "label"), up, "label", "left").select("node", F.coalesce("up", "label").alias("label")), "labels")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = TARGET_RECALL) -> DataFrame:
    """Near-duplicate classes of docs.

    One row per row of docs: doc_id, text_key (a hash of the text), class_id (smallest id of the connected part),
    n_links (other documents with similarity of at least `threshold`, copies included), n_texts (linked entries with
    another set of shingles), class_size and stays (whether the row's text is the one that stays of its class: that of
    the smallest id, then of the smallest hash). Words are runs without white space. Null texts count as empty; texts
    without words have no links, a class of their own and size one. Rows that repeat an id count as documents of
    their own; null ids are linked like others and come last, so a class id is null only where all ids of the class
    are. An empty table gives no rows; other columns of docs are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    floor = least_depth(threshold, trees, recall)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    last = F.lit((1 << 63) - 1)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("own"), text.alias("text"))
    signed = common.cut(common.map_frames(texts, _signer(words, DEEPEST, trees), "doc_id long, own long, set binary, n int, signature binary"), "signed")
    entries = (
        signed.filter("set is not null").groupBy("set")
        .agg(F.min(F.struct(F.coalesce("doc_id", last).alias("id"), "own")).alias("first"), F.count(F.lit(1)).alias("rows"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature"))
        .select("set", "first.id", "first.own", "rows", "n", "signature")
    )
    entries = common.cut(entries, "entries")
    at = F.expr(f"explode(transform(sequence(0, {trees - 1}), t -> struct(t as tree, substring(signature, t * {2 * DEEPEST} + 1, {2 * DEEPEST}) as prefix)))")
    tries = entries.select("set", at.alias("t")).select(F.col("t.tree").cast("int").alias("tree"), "t.prefix", "set").repartitionByRange("tree", "prefix", "set").sortWithinPartitions("tree", "prefix", "set")
    climbed = tries.mapInArrow(_climber(DEEPEST, floor), "tree int, prefix binary, set binary, met tinyint, crowd binary")
    chosen = climbed.groupBy("set").agg(F.collect_list(F.struct("tree", "prefix", "met", "crowd")).alias("rows"))
    leaves = common.cut(chosen.mapInArrow(_chooser(trees, DEEPEST, floor, threshold, recall), "set binary, prefix long, asked boolean"), "leaves")
    nodes = leaves.groupBy("prefix").agg(F.count(F.lit(1)).alias("k"), F.max("asked").alias("asked"), F.min("set").alias("head"))
    nodes = common.cut(nodes.filter("k > 1 and asked").select("prefix", "head"), "nodes")
    leaves = leaves.select("set", "prefix")
    few = nodes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    met = common.cut(leaves.join(F.broadcast(nodes), "prefix") if few else common.even_join(leaves, nodes, "prefix"), "met")
    homes = met.groupBy("set").agg(F.min("head").alias("home")).join(entries.select("set", "id", "own", "n", "rows"), "set")
    # sets that reach the threshold differ in size by one step at most
    homes = common.cut(homes.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")), "homes")
    chunks = homes.groupBy("home", "step").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count(F.lit(1)) / BLOCK_ENTRIES)).cast("int").alias("chunks"))
    chunks = common.cut(chunks.filter("chunks > 1"), "chunks")
    keyed = homes.withColumn("at", F.xxhash64("home", "step"))
    sizes = chunks.select(F.xxhash64("home", "step").alias("at"), "chunks")
    placed = common.even_join(keyed, sizes, "at", "left").withColumn("block", F.xxhash64("at", F.pmod(F.xxhash64("set"), F.coalesce("chunks", F.lit(1)))))
    placed = common.cut(placed.select("set", "id", "own", "rows", "step", "block"), "placed")
    blocks_at = common.cut(met.select("prefix", "set").join(placed.select("set", "block", "step"), "set").select("prefix", "block", "step").distinct(), "at")
    alone = placed.groupBy("block").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select(F.col("block").alias("a"), F.col("block").alias("b"))
    other = blocks_at.select("prefix", F.col("block").alias("b"), F.col("step").alias("other"))
    across = blocks_at.withColumnRenamed("block", "a").join(other, "prefix").filter("a < b and abs(step - other) <= 1").select("a", "b").distinct()
    pairs = common.cut(alone.unionByName(across), "pairs")
    # the texts of entries that met some other, read once more; one row for each entry
    again = texts.withColumn("id", F.coalesce("doc_id", last)).drop("doc_id").join(common.small(placed.drop("step"), BROADCAST_ROWS), ["id", "own"]).select("set", "block", "rows", "text")
    gathered = again.mapInPandas(_gatherer(words), "set binary, block long, rows long, s binary").dropDuplicates(["set"])
    blocks = common.cut(gathered.groupBy("block").agg(F.collect_list(F.struct("set", "rows", "s")).alias("e")), "blocks")
    sides = pairs.join(blocks.select(F.col("block").alias("a"), F.col("e").alias("left")), "a").join(blocks.select(F.col("block").alias("b"), F.col("e").alias("right")), "b")
    found = sides.select("left", "right", (F.col("a") == F.col("b")).alias("same")).mapInPandas(_verifier(threshold), "set binary, centre binary, documents long, texts long")
    found = common.cut(found, "links")
    links = found.groupBy("set").agg(F.sum("documents").alias("documents"), F.sum("texts").alias("texts"))
    labels = components(found.filter("set <> centre").select(F.col("set").alias("a"), F.col("centre").alias("b")))
    named = entries.select("set", "id", "own", "rows").join(labels.select(F.col("node").alias("set"), "label"), "set", "left").withColumn("label", F.coalesce("label", "set")).join(links, "set", "left")
    named = common.cut(named, "named")
    classes = named.groupBy("label").agg(F.min(F.struct("id", "own")).alias("first"), F.sum("rows").alias("class_size"))
    named = common.even_join(named, classes, "label").select(
        "set", "first", "class_size", (F.col("rows") - 1 + F.coalesce("documents", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts")
    )
    named = common.cut(named, "classes")
    # copies of one set can be many: the few columns are joined with the copies dealt out
    alone = F.col("set").isNull()
    return common.even_join(signed.select("doc_id", "own", "set"), named, "set", "left").select(
        "doc_id",
        F.col("own").alias("text_key"),
        F.when(alone, F.col("doc_id")).otherwise(F.nullif(F.col("first.id"), last)).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (alone | ((F.coalesce("doc_id", last) == F.col("first.id")) & (F.col("own") == F.col("first.own")))).alias("stays"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text stays of its class of near duplicates, with the columns of docs.

    Rows are told by id and text, so a row that shares its id with a near copy is judged by its own text. Texts
    without words have classes of their own and stay. Rows that repeat an id and its text share their fate.
    """
    dropped = join(docs, id_col, text_col).filter("not stays").select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("__id"), F.col("text_key").alias("__text")).distinct()
    dropped = common.small(common.cut(dropped, "near-copies"), BROADCAST_ROWS)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("__id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__text"))
    return own.join(dropped, ["__id", "__text"], "left_anti").select("__own.*")
