"""URL filter: explicit rules first, then the reputation of the host, shrunk by empirical Bayes from suffix to domain to host.

Labelled pages are counted by host with map-side combine. A suffix is shrunk to the share of all pages, a registered
domain to its suffix and a host to its domain, each through a beta prior whose strength is fitted to the
spread of its level by moments of the beta-binomial. A host is blocked when even the upper bound of its posterior
share of good pages lies below the limit, so hosts with little evidence stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Two-part suffixes under which domains are registered; others are the last label of the host.
TWO_PART_SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
#: A host is blocked when its share of good pages lies below GOOD_SHARE with probability CONFIDENCE.
GOOD_SHARE, CONFIDENCE = 0.5, 0.95
#: Bounds of a prior's strength, in pages.
WEAKEST, STRONGEST = 1.0, 1000.0
#: Host tables of at most so many rows (about 200 bytes each) are broadcast.
BROADCAST_ROWS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _levels(host: Column) -> tuple[Column, Column]:
    """Suffix and registered domain of a host, less user and port. A host that is a suffix is its own domain."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r":\d*$", "")
    pair = F.substring_index(bare, ".", -2)
    two = pair.isin(*TWO_PART_SUFFIXES)
    return F.when(two, pair).otherwise(F.substring_index(bare, ".", -1)), F.when(two, F.substring_index(bare, ".", -3)).otherwise(pair)


def _strength(children: DataFrame, mean: Column) -> float:
    """Pages that the prior of a level weighs, from the spread of its children around their parents' shares.

    E (good - n m)^2 = n m (1 - m) (1 + (n - 1) r) for the beta-binomial of correlation r; the strength is 1 / r - 1.
    """
    over = F.pow(F.col("good") - F.col("n") * mean, 2) / (mean * (1 - mean))
    x = children.filter("n > 0").agg(F.sum(over - F.col("n")).alias("over"), F.sum(F.col("n") * (F.col("n") - 1.0)).alias("pairs")).first()
    if not x.pairs or x.over <= 0:
        return STRONGEST
    return min(STRONGEST, max(WEAKEST, x.pairs / x.over - 1))


def _sums(df: DataFrame, key: str, *more: Column) -> DataFrame:
    return df.groupBy(key).agg(F.sum("good").alias("good"), F.sum("n").alias("n"), *more)


def host_posteriors(counts: DataFrame) -> DataFrame:
    """Posterior of each host's share of good pages.

    counts: host, good, n (labelled pages), one row a host. Returns host, domain, suffix, good, n, alpha, beta. Hosts
    without labelled pages have their domain's prior; without any label all shares are 1 / 2 with STRONGEST.
    """
    suffix, domain = _levels(F.col("host"))
    hosts = common.cut(counts.withColumn("suffix", suffix).withColumn("domain", domain), "hosts")
    domains = common.cut(_sums(hosts, "domain", F.first("suffix").alias("suffix")), "domains")
    suffixes = _sums(domains, "suffix")
    total = domains.agg(F.sum("good"), F.sum("n")).first()
    mean = F.lit(((total[0] or 0) + 0.5) / ((total[1] or 0) + 1))
    weight = _strength(suffixes, mean)
    tops = suffixes.select("suffix", ((F.col("good") + weight * mean) / (F.col("n") + weight)).alias("top"))
    domains = common.cut(common.meet(domains, common.cut(tops, "suffixes"), "suffix", BROADCAST_ROWS), "domains")
    weight = _strength(domains, F.col("top"))
    shares = domains.select("domain", ((F.col("good") + weight * F.col("top")) / (F.col("n") + weight)).alias("share"))
    hosts = common.cut(common.meet(hosts, common.cut(shares, "shares"), "domain", BROADCAST_ROWS), "hosts")
    weight = _strength(hosts, F.col("share"))
    prior = weight * F.col("share")
    return hosts.select("host", "domain", "suffix", "good", "n", (F.col("good") + prior).alias("alpha"), (F.col("n") - F.col("good") + weight - prior).alias("beta"))


def beta_below(x: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that a beta variable lies below x: the regularised incomplete beta function, by Lentz's fraction."""
    log = np.array([math.lgamma(p + q) - math.lgamma(p) - math.lgamma(q) for p, q in zip(a, b)])
    front = np.exp(log + a * math.log(x) + b * math.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(p), 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(abs(d) < tiny, tiny, d)
    value = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 + step * d, 1 + step / c
            d = 1 / np.where(abs(d) < tiny, tiny, d)
            c = np.where(abs(c) < tiny, tiny, c)
            value *= d * c
    low = front * value / p
    return np.where(swap, 1 - low, low)


def reputations(counts: DataFrame, good_share: float = GOOD_SHARE, confidence: float = CONFIDENCE) -> DataFrame:
    """host_posteriors with p_below, the posterior probability of a share below good_share, and blocked."""
    posts = host_posteriors(counts)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            if len(x):
                x["p_below"] = beta_below(good_share, x.alpha.to_numpy(float), x.beta.to_numpy(float))
                x["blocked"] = x.p_below >= confidence
                yield x

    return posts.mapInPandas(judge, "host string, domain string, suffix string, good long, n long, alpha double, beta double, p_below double, blocked boolean")


def _rules_by_host(hosts: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """host and the rules that fit it, longest first; hosts without one are left out. rules: a parameter, so bounded."""
    spark = hosts.sparkSession
    rows = [(r.partition("/")[0].lower(), "/" * ("/" in r) + r.partition("/")[2], r, action) for action, r in rules]
    table = F.broadcast(spark.createDataFrame(rows, "__end string, path string, rule string, action string").distinct())
    labels = F.split("host", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    # longer rules first, then longer hosts, then block before allow
    order = F.struct((-F.length("rule")).alias("a"), (-F.length("__end")).alias("b"), (F.col("action") != "block").alias("c"), "path", "rule", "action")
    return hosts.select("host", F.explode(ends).alias("__end")).join(table, "__end").groupBy("host").agg(F.sort_array(F.collect_list(order)).alias("rules"))


def judge_pages(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule, verdict: allow or block by the longest rule that fits, else by the host's reputation.

    outcomes: id_col and good (0 or 1), a row for each labelled page. Rows of one id are labels of that page, each of which counts; rows
    with a null id or outcome, or of no page, count for nothing. rules: (allow or block, host and path from the first slash); of
    rules of equal length that of the longer host wins, then block. A null url or one without :// is the empty host,
    a host like any other. Rows that repeat an id are judged and counted each; an empty table gives no rows. Input columns named like
    the new ones are replaced. A hot host is counted before the shuffle and met by a broadcast table or in salted parts.
    """
    url = F.col(f"`{url_col}`")
    new = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c.lower() not in new]
    parsed = pages.select(*[F.col(f"`{c}`") for c in keep], host_of(url).alias("host"), path_of(url).alias("path"))
    seen = parsed.select(F.col(f"`{id_col}`").alias("__id"), "host")
    told = outcomes.select(F.col(f"`{id_col}`").alias("__id"), F.col("good").cast("long").alias("good")).dropna()
    told = told.groupBy("__id").agg(F.sum("good").alias("good"), F.count(F.lit(1)).alias("n"))
    seen = seen.groupBy("__id", "host").agg(F.count(F.lit(1)).alias("__rows")).join(told, "__id", "left")
    times = lambda c: F.coalesce(F.sum(F.col(c) * F.col("__rows")), F.lit(0)).alias(c)
    counts = common.cut(seen.groupBy("host").agg(times("good"), times("n")), "host-counts")
    judged = reputations(counts).select("host", "blocked")
    table = common.cut(judged.join(_rules_by_host(counts.select("host"), rules), "host", "left"), "hosts")
    rows = common.meet(parsed, table, "host", BROADCAST_ROWS)
    fit = F.get(F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    return rows.select(
        *[F.col(f"`{c}`") for c in keep],
        "host",
        "path",
        fit["rule"].alias("rule"),
        F.coalesce(fit["action"], F.when(F.col("blocked"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
