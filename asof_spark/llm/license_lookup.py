"""Licence detection by canonical digest: texts are normalised, hashed and joined to digests of known licences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_digests import WHOLE_TEXTS

#: Known notices and titles, which are looked up as whole texts and as lines: fixed values, public notices and titles. Callers may pass their own.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU General Public License Version 3, 29 June 2007"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "The MIT License (MIT)"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("All-rights-reserved", "All rights reserved."),
]
#: Equivalent spellings after lower case: (pattern, replacement), applied to whole words.
SPELLINGS = [(r"\blicence(s|d)?\b", "license$1"), (r"\blicencing\b", "licensing"), (r"\bcopyright holders\b", "copyright owner"), (r"\bcopyright holder\b", "copyright owner"), (r"\bversion (?=[0-9])", "v "), (r"\bv\. ?(?=[0-9])", "v "), (r"\bnon ?commercial\b", "noncommercial")]
COPYRIGHT_LINE = r"(?m)^[ \t#/*;-]*(?:copyright\b|\(c\)|©)[^\n]*$"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, one spelling, no punctuation, single spaces; line breaks stay as they are."""
    text = F.lower(text)
    text = F.when(text.rlike(r"copyright|\(c\)|©"), F.regexp_replace(text, COPYRIGHT_LINE, "")).otherwise(text)
    text = F.regexp_replace(text, r"(?:(?![\n])[\p{Punct}\p{P}\p{S}\s])+", " ")
    spelled = text
    for pattern, to in SPELLINGS:
        spelled = F.regexp_replace(spelled, pattern, to)
    return F.when(text.rlike("licenc|copyright holder|version|\\bv [0-9]|non ?commercial"), spelled).otherwise(text)


def _digest(canon: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(canon, r"\s+", " ")), 256)


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = WHOLE_TEXTS) -> DataFrame:
    """license, digest: one row for each distinct digest of the known texts and the given digests (as many rows as the parameters, at most)."""
    texts = spark.createDataFrame(known, "license string, text string").select("license", _digest(canonical(F.col("text"))).alias("digest"))
    return texts.union(spark.createDataFrame(digests, "license string, digest string")).groupBy("digest").agg(F.min("license").alias("license"))


def lookup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = WHOLE_TEXTS) -> DataFrame:
    """Licences of every text: its canonical digest is joined to those of known licences.

    One row per row of docs: doc_id, text_digest (canonical SHA-256 of the whole text), text_license (the licence
    whose text the whole document is, else null), line_licenses (sorted, distinct licences of `known` that fill a line
    of their own) and n_license_lines. Null texts count as empty; an empty text or line has no licence. Repeated
    rows get equal results; an empty table gives no rows; other columns of docs are not read. Each text is normalised
    once. The known digests are the broadcast side, so its size is that of the parameters; texts are not shuffled.
    """
    spark = docs.sparkSession
    table = known_digests(spark, known, digests)
    # a line can only be a known one if it has the length of one
    shapes = spark.createDataFrame(known, "license string, text string").select(F.length(F.trim(F.regexp_replace(canonical(F.col("text")), r"\s+", " "))).alias("n"))
    lengths = sorted({r.n for r in shapes.collect()})
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), canonical(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("canon"))
    lines = F.filter(F.transform(F.split("canon", "\n"), lambda line: F.trim(line)), lambda line: F.length(line).isin(lengths))
    rows = common.cut(rows.select("doc_id", _digest(F.col("canon")).alias("text_digest"), F.transform(lines, lambda line: F.sha2(line, 256)).alias("lines")), "licences")
    found = rows.filter("size(lines) > 0").distinct().select("doc_id", "text_digest", F.explode("lines").alias("digest")).join(F.broadcast(table), "digest")
    hits = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_digest").alias("__text")).agg(F.array_sort(F.collect_set("license")).alias("__licenses"), F.count(F.lit(1)).alias("__lines"))
    whole = rows.select("doc_id", "text_digest").join(F.broadcast(table.select(F.col("digest").alias("text_digest"), F.col("license").alias("text_license"))), "text_digest", "left")
    return whole.join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_digest") == F.col("__text")), "left").select(
        "doc_id",
        "text_digest",
        "text_license",
        F.coalesce("__licenses", F.expr("cast(array() as array<string>)")).alias("line_licenses"),
        F.coalesce("__lines", F.lit(0)).cast("long").alias("n_license_lines"),
    )
