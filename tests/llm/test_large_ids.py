"""Ids over 2^53 beside a null id stay what they are, in every operator and every stage of the pipeline."""

import collections
import random

import public_tokenizers
import pytest

import corpus_pipeline
from asof_spark.llm import conversations, exact_dedup, license_lookup, mixing, near_join, packing, quality, queries, secret_scan, spelling, suffix_dedup

BIG = 2**53 + 1
IDS = [None, BIG, BIG + 2, 7, None, BIG + 4, BIG + 5, 2**62 + 1, 1, 2]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(150)) + "." for _ in range(5)]
    near = prose[0].split()
    near[70] = "other"
    texts = [prose[0], prose[0], " ".join(near), prose[1], prose[2], prose[3], prose[3] + " " + prose[4], prose[4], "", "token = 'abcdefghijkl1234'"]
    rows = [(i, t, "en", "src0", len(t)) for i, t in zip(IDS, texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(BIG, 1, 0), (BIG + 2, 0, 0), (7, 1, 0), (BIG + 4, 0, 0), (2**62 + 1, 1, 0)], "doc_id long, quality int, toxic int")


TOKENIZER = public_tokenizers.path(queries.TOKENIZER)
OPERATORS = {
    "op1": lambda d, m: packing.pack(d, TOKENIZER).filter("start = 0"),
    "op1 leftovers": lambda d, m: packing.pack(d, TOKENIZER, size=1 << 20).filter("start = 0"),
    "op2": lambda d, m: suffix_dedup.remove_repeats(d),
    "op3": lambda d, m: secret_scan.scan(d),
    "op4": lambda d, m: quality.score(d, m),
    "op5": lambda d, m: exact_dedup.mark_copies(d),
    "op7": lambda d, m: near_join.join(d),
    "op9": lambda d, m: license_lookup.lookup(d),
    "op10": lambda d, m: mixing.weigh(d, queries.MIX_TARGETS, TOKENIZER),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_operator_keeps_ids(docs, labels, name):
    got = collections.Counter(r.doc_id for r in OPERATORS[name](docs, labels).collect())
    assert got == collections.Counter(IDS)


def test_fold_is_that_of_the_exact_id(docs, labels):
    import zlib

    held = {r.doc_id: r.held_out for r in quality.score(docs, labels).collect() if r.doc_id is not None}
    assert held == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in IDS if i is not None}


def test_classes_and_links_name_exact_ids(docs):
    rows = {(r.doc_id, r.class_id, r.stays) for r in near_join.join(docs).collect() if r.class_size > 1}
    assert {x for x in rows if x[0] in (BIG, BIG + 2)} == {(BIG, BIG, True), (BIG + 2, BIG, False)}
    kept = collections.Counter(r.doc_id for r in near_join.keep_one(docs).collect())
    assert BIG in kept and BIG + 2 not in kept


def test_words_and_turns(spark):
    rows = [(None, 1, "user", "a."), (BIG, 1, "user", "b."), (BIG + 2, 1, "assistant", "c.")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert {r.conv_id for r in conversations.repair(turns).collect()} == {None, BIG, BIG + 2}
    text = spark.createDataFrame([(None, "word"), (BIG, "word")], "doc_id long, text string")
    assert {r.id for r in spelling.runs(text).collect()} == {None, BIG}


def test_every_stage_keeps_ids(spark, docs, tmp_path):
    labels = spark.createDataFrame([(BIG + 4, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        got = {r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()}
        assert got <= set(IDS), name
        if name in ("quality", "packing"):
            assert got == set(IDS), name
