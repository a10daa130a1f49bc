"""Mixing to target weights by iterative proportional fitting, then calibrated sampling.

Tokens are counted by the tokenizer of the training run. Topics come from the content: the tokens of a document are
hashed to TERMS buckets, and the signs of its leading principal components within its language are its topic. Means and
the covariance are summed over all documents, so the axes are fitted on the whole corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, packing

#: Classes that no target names are pooled under this name, so cells are at most the product of the targets.
OTHER = "other"
ROUNDS, TOLERANCE = 200, 1e-10
#: Buckets of hashed tokens, and principal axes; there are 2 ** AXES topics.
TERMS, AXES = 64, 3
TOPICS = [f"t{i}" for i in range(1 << AXES)]
#: Keys of sampled rows (16 bytes each) that are broadcast to the documents; more meet them by shuffle.
BROADCAST_ROWS = 500_000


def _pooled(value: Column, target: dict[str, float]) -> Column:
    return F.when(value.isin(*target), value).otherwise(OTHER)


def rake(mass: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """Factors of the cells of `mass` whose weighted marginals match `targets`, as far as empty classes allow.

    Each target is scaled to the total mass over the classes that have any. Zero cells stay zero.
    """
    weights, total = mass.astype(float).copy(), mass.sum()
    if total == 0:
        return np.zeros_like(weights)
    axes = [tuple(j for j in range(mass.ndim) if j != i) for i in range(mass.ndim)]
    wanted = []
    for axis, target in zip(axes, targets, strict=True):
        live = np.where(mass.sum(axis) > 0, target, 0.0)
        wanted.append(live / live.sum() * total if live.sum() > 0 else mass.sum(axis))
    for _ in range(rounds):
        worst = 0.0
        for i, (axis, want) in enumerate(zip(axes, wanted, strict=True)):
            have = weights.sum(axis)
            factor = np.divide(want, have, out=np.ones_like(want), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max()) / total)
            weights *= factor.reshape([-1 if j == i else 1 for j in range(mass.ndim)])
        if worst < tolerance:
            break
    return np.divide(weights, mass, out=np.zeros_like(weights), where=mass > 0)


def calibrate(factors: np.ndarray, mass: np.ndarray, share: float) -> np.ndarray:
    """Probabilities min(1, c * factor), c such that the expected tokens are `share` of all, as far as that is possible."""
    low, high, total = 0.0, 1.0, mass.sum()
    kept = lambda c: float((np.minimum(1.0, c * factors) * mass).sum())
    while kept(high) < share * total and high < 1e12:
        high *= 2
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if kept(middle) < share * total else (low, middle)
    return np.minimum(1.0, high * factors)


def terms(ids: np.ndarray) -> np.ndarray:
    """Square roots of the shares of the buckets of a document's tokens; zeros without tokens."""
    bucket = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TERMS.bit_length() + 1)
    return np.sqrt(np.bincount(bucket.astype(np.int64), minlength=TERMS) / max(1, len(ids))).astype(np.float32)


def axes(count: np.ndarray, total: np.ndarray, products: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means of every language and the leading axes of what varies within languages, the largest part of an axis positive.

    count: documents of each language; total: sums of their terms; products: the sum of x x' over all.
    """
    mean = total / np.maximum(1, count)[:, None]
    within = products - (mean * count[:, None]).T @ mean
    vectors = np.linalg.eigh(within)[1][:, ::-1][:, :AXES]
    return mean, vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(AXES)])


def topics(x: np.ndarray, language: np.ndarray, mean: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    return ((x - mean[language]) @ vectors > 0) @ (1 << np.arange(AXES))


def _measure(texts: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, text_key, both classes, the number of the language, tokens (with an end token) and terms of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = packing.encoder(tokenizer)
        for b in batches:
            tokens, found = [], []
            for ids in encode(b.column("text").to_pylist()):
                ids = np.frombuffer(ids, "<u4")
                tokens.append(len(ids) + 1)
                found.append(terms(ids).tobytes())
            names = b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(tokens, pa.int64()), pa.array(found, pa.binary())], [*names, "tokens", "terms"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema.fields[:-1])
    return common.cut(texts.mapInArrow(run, f"{kind}, tokens long, terms binary"), "tokens")


def _topical(measured: DataFrame, languages: int) -> DataFrame:
    """measured with topic in place of terms; the driver sees the sums over all documents, (languages + TERMS) x TERMS numbers."""
    size = languages * (TERMS + 1) + TERMS * TERMS
    x_of = lambda b: np.frombuffer(b"".join(b.column("terms").to_pylist()), np.float32).reshape(-1, TERMS).astype(np.float64)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total, products = np.zeros(languages), np.zeros((languages, TERMS)), np.zeros((TERMS, TERMS))
        for b in batches:
            x, language = x_of(b), b.column("language").to_numpy()
            count += np.bincount(language, minlength=languages)
            np.add.at(total, language, x)
            products += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size)), pa.array(np.concatenate([count, total.ravel(), products.ravel()]))], ["i", "v"])

    flat = np.zeros(size)
    for i, v in measured.select("language", "terms").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v")).collect():
        flat[i] = v
    mean, vectors = axes(flat[:languages], flat[languages : languages * (TERMS + 1)].reshape(languages, TERMS), flat[languages * (TERMS + 1) :].reshape(TERMS, TERMS))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            topic = topics(x_of(b), b.column("language").to_numpy(), mean, vectors)
            yield b.drop_columns(["terms"]).append_column("topic", pa.array([TOPICS[t] for t in topic.tolist()], pa.string()))

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields if f.name != "terms")
    return common.cut(measured.mapInArrow(assign, f"{kind}, topic string"), "topics")


def weigh(docs: DataFrame, targets: dict[str, dict[str, float]], tokenizer: str, share: float = 0.5, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", topic_col: str | None = None) -> DataFrame:
    """doc_id, text_key (a hash of the text), source, lang, topic, tokens, weight (the raked factor), probability, draw and sampled for every row of docs.

    Token sums of the cells source x language x topic are raked to the target marginals and scaled so that the
    expected sample holds `share` of the tokens; a document is sampled when its draw, a hash of seed and id, is
    below its probability. Cells are bounded by the targets (other classes, nulls included, are pooled), so only
    that table and sums of a fixed size are collected and sent back. Null texts count as empty, with the end token
    alone. Rows that repeat an id share its draw; null ids share one draw. An empty table gives no rows. The three
    keys of `targets` are, in order, the columns of source and language and the topic, which is derived from the text
    unless topic_col names a column; other columns of docs are not read. The classes of targets are its shares,
    scaled to sum to one; a class without rows gives its share to the rest.
    """
    common.small_batches(docs.sparkSession)
    names = list(targets)
    classes = [sorted({*targets[n], OTHER}) for n in names]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    values = [F.col(f"`{n}`").cast("string") for n in names[:2]]
    language = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in classes[1]]), _pooled(values[1], targets[names[1]])) - 1, F.lit(0)).cast("int")
    own_topic = [F.col(f"`{topic_col}`").cast("string").alias("given")] if topic_col else []
    texts = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_key"), values[0].alias("source"), values[1].alias("lang"), language.alias("language"), *own_topic, text.alias("text"))
    keyed = _topical(_measure(texts, tokenizer), len(classes[1]))
    if topic_col:
        keyed = keyed.withColumn("topic", F.col("given"))
    keyed = keyed.withColumns({f"__{i}": _pooled(F.col(c), targets[n]) for i, (c, n) in enumerate(zip(("source", "lang", "topic"), names, strict=True))})
    cells = keyed.groupBy("__0", "__1", "__2").agg(F.sum("tokens").alias("mass")).collect()
    mass, at = np.zeros([len(c) for c in classes]), [{v: k for k, v in enumerate(c)} for c in classes]
    for row in cells:
        mass[at[0][row[0]], at[1][row[1]], at[2][row[2]]] = row[3]
    factors = rake(mass, [np.array([t.get(v, 0.0) for v in c]) for t, c in zip(targets.values(), classes, strict=True)])
    chances = calibrate(factors, mass, share)
    table = [(classes[0][i], classes[1][j], classes[2][k], float(factors[i, j, k]), float(chances[i, j, k])) for i, j, k in np.argwhere(mass > 0)]
    cells_df = docs.sparkSession.createDataFrame(table, "__0 string, __1 string, __2 string, weight double, probability double")
    # 53 bits of a hash of seed and id
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("string")), 11) / F.lit(float(1 << 53))
    return keyed.join(F.broadcast(cells_df), ["__0", "__1", "__2"], "left").withColumn("draw", draw).select("doc_id", "text_key", "source", "lang", "topic", "tokens", "weight", "probability", "draw", (F.col("draw") < F.col("probability")).alias("sampled"))


def sample(docs: DataFrame, targets: dict[str, dict[str, float]], tokenizer: str, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that weigh() samples, with the columns of docs. Rows are told by id and text; equal ones share their fate."""
    kept = weigh(docs, targets, tokenizer, share, id_col=id_col, text_col=text_col).filter("sampled")
    kept = common.cut(kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("__id"), F.col("text_key").alias("__text")).distinct(), "sampled")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__own"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")).alias("__id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__text"))
    return own.join(common.small(kept, BROADCAST_ROWS), ["__id", "__text"], "left_semi").select("__own.*")
