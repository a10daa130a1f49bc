"""The quality classifier against a plain ridge and isotonic fit, licence lookup against plain Python, and pipeline stages on odd rows."""

import hashlib
import math
import random
import re
import tempfile
import unicodedata
import zlib

import numpy as np
import pytest

import corpus_pipeline
from asof_spark.llm import common, license_lookup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def fold(i):
    return zlib.crc32(str(i).encode()) % 3


def plain_pools(at, good, total):
    """Isotonic fit by the max-min formula; each run of equal values is a pool."""
    n = len(at)
    mean = lambda i, j: good[i : j + 1].sum() / total[i : j + 1].sum()
    fitted = [max(min(mean(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    pools, start = [], 0
    for k in range(1, n + 1):
        if k == n or not math.isclose(fitted[k], fitted[start], abs_tol=1e-12):
            own = slice(start, k)
            pools.append((np.average(at[own], weights=total[own]), (good[own].sum() + 0.5) / (total[own].sum() + 1)))
            start = k
    rates = np.maximum.accumulate([p[1] for p in pools])
    return [-1e-9, *[p[0] for p in pools], 1 + 1e-9], [min(0.0, rates[0]), *rates, max(1.0, rates[-1])]


def plain_scores(texts, ids, label):
    """Scores of texts by one matrix of all labelled rows, solved by least squares with the ridge as further rows."""
    x = np.array([quality.statistics(t) for t in texts])
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) > 1e-12, x.std(0), 1.0), -6, 6)
    rng = np.random.default_rng(quality.SEED)
    omega, phase = rng.normal(size=(x.shape[1], quality.FEATURES)) / quality.BANDWIDTH, rng.uniform(0, 2 * np.pi, quality.FEATURES)
    phi = np.array([[math.cos(row @ omega[:, k] + phase[k]) * math.sqrt(2 / quality.FEATURES) for k in range(quality.FEATURES)] + [1.0] for row in z])
    train = [k for k, i in enumerate(ids) if fold(i) == 0 and i in label]
    y = np.array([label[ids[k]] for k in train], dtype=float)
    size = phi.shape[1]
    weights = np.linalg.lstsq(np.vstack([phi[train], math.sqrt(quality.RIDGE) * np.eye(size)]), np.concatenate([y, np.zeros(size)]), rcond=None)[0]
    raw = np.clip(phi @ weights, 0, 1)
    bins = {}
    for k, i in enumerate(ids):
        if fold(i) == 2 and i in label:
            own = bins.setdefault(min(quality.BINS - 1, int(raw[k] * quality.BINS)), [0, 0])
            own[0] += label[i]
            own[1] += 1
    order = sorted(bins)
    at, p = plain_pools(np.array([(b + 0.5) / quality.BINS for b in order]), np.array([bins[b][0] for b in order], dtype=float), np.array([bins[b][1] for b in order], dtype=float))
    return np.clip(np.interp(raw, at, p), 0, 1)


def test_quality_against_plain_fit(spark):
    """Labels are noisy, so the isotonic fit has to pool; one text is very long, two are empty, some rows have no label."""
    rng = random.Random(8)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]
    texts = [" ".join(rng.choice(words[: 2 + i % 7]) for _ in range(20 + i % 90)) + ("!" * (i % 5)) for i in range(420)]
    texts += ["", None, " ".join(rng.choice(words) for _ in range(60_000))]
    label = {i: int((i % 7 > 3) ^ (rng.random() < 0.25)) for i in range(400)}
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r.score for r in quality.score(df, spark.createDataFrame(sorted(label.items()), "doc_id long, quality int")).collect()}
    want = plain_scores([t or "" for t in texts], list(range(len(texts))), label)
    assert len(set(np.round(want, 6))) > 20
    assert [got[i] for i in range(len(texts))] == pytest.approx(want.tolist(), abs=1e-6)


def test_statistics_by_definition():
    text = "One one, TWO (3)\nfour | five! " + "x" * 40
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    words = text.split()
    assert got["log_words"] == pytest.approx(math.log(1 + len(words))) and got["long_words"] == pytest.approx(1 / len(words))
    assert got["upper"] == pytest.approx(sum(c.isupper() for c in text) / len(text)) and got["digits"] == pytest.approx(1 / len(text))
    assert got["pipes"] == got["bangs"] == pytest.approx(1 / len(words)) and got["repeated"] == 0
    assert quality.statistics("") == [0.0] * len(quality.STATISTICS)


def plain_canonical(text):
    text = text.lower()
    if re.search(r"copyright|\(c\)|©", text):
        text = re.sub(license_lookup.COPYRIGHT_LINE, "", text)
    out, gap = [], False
    for c in text:
        if c != "\n" and (c.isspace() or unicodedata.category(c)[0] in "PS"):
            gap = True
            continue
        out.append((" " if gap else "") + c)
        gap = False
    text = "".join(out) + (" " if gap else "")
    for pattern, to in license_lookup.SPELLINGS:
        text = re.sub(pattern, lambda m, to=to: to.replace("$1", (m.group(1) or "") if m.groups() else ""), text)
    return text


def test_license_lookup_of_all_documents(spark):
    """Every document of the small tables: digest, whole text and lines by plain Python."""
    docs = common.documents(spark, SF)
    one = lambda t: " ".join(t.split())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    known = {}
    for name, text in license_lookup.KNOWN:
        known.setdefault(one(plain_canonical(text)), []).append(name)
    by_digest = {sha(t): min(names) for t, names in known.items()}
    for name, digest in license_lookup.WHOLE_TEXTS:
        by_digest[digest] = min(name, by_digest.get(digest, name))
    got = {r.doc_id: r for r in license_lookup.lookup(docs).collect()}
    lines = 0
    for r in docs.collect():
        canon = plain_canonical(r.text or "")
        hits = [min(known[one(x)]) for x in canon.split("\n") if one(x) in known]
        lines += len(hits)
        mine = got[r.doc_id]
        assert (mine.text_digest, mine.text_license) == (sha(one(canon)), by_digest.get(sha(one(canon))) if one(canon) else None)
        assert (mine.line_licenses, mine.n_license_lines) == (sorted(set(hits)), len(hits))
    assert len(got) == docs.count() and lines


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null ids, null and empty texts, repeated rows, ids on two texts, copies and near copies, one very long text."""
    rng = random.Random(2)
    words = [a + b for a in ("ka", "lo", "mi", "nu", "per", "so") for b in ("ran", "tel", "vis", "dor", "gam", "hes")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)) + "."
    base = [prose(150) for _ in range(8)]
    near = base[0].split()
    near[75] = "changed"
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[1]), (20, base[1]), (21, " ".join(near)), (22, None), (23, ""), (None, base[2]), (None, None), (3, prose(140)), (24, prose(20_000)), (25, "x"), (26, " ")]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}", len(t or "")) for i, t in rows], SCHEMA).repartition(3)


def pairs(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in df.collect())


def test_stages_on_odd_rows(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before = pairs(docs)
        out = common.cut(stage(spark, docs, SF), name)
        if name == "packing":
            rows = out.collect()
            assert {(-1 if r.doc_id is None else r.doc_id) for r in rows} == {i for i, _ in before}
            assert sum(r.length for r in rows) >= len(before)
            break
        assert out.columns == odd.columns
        after = pairs(out)
        if name == "quality":
            marked = quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()
            assert sorted(i for i, _ in after) == sorted(-1 if r.doc_id is None else r.doc_id for r in marked)
            assert set(after) <= set(before)
            docs = odd  # later stages see every odd row, whatever the classifier says of so few
            continue
        if name == "exact_dedup":
            assert after == sorted((i, t) for t, i in {t: i for i, t in before}.items())  # the largest id of each text
        if name == "near_dedup":
            texts = [t for _, t in after]
            assert all(jaccard(shingles(a), shingles(b)) < 0.8 for k, a in enumerate(texts) for b in texts[:k])
            lost = [t for i, t in before if (i, t) not in after]
            assert lost and all(any(jaccard(shingles(t), shingles(k)) >= 0.8 for k in texts) for t in lost)
        if name == "mixing":
            assert set(after) <= set(before) and after
        docs = out


def test_pipeline_of_an_empty_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
