"""Spelling variants: words one edit apart are found by PartEnum signatures of their letter multisets.

A multiset of letters is a binary vector with a bit for each letter and occurrence. One inserted or deleted letter changes one
bit and one replaced letter two, so words one edit apart have Hamming distance at most two. The bits are dealt over
PARTS parts by letter; of these at most two differ, so the words agree on some PARTS - 2 of them whole: each such
choice of parts is a signature. A signature also holds the longer word's length and two thirds of the word, since one
edit leaves two of its three pieces alone; both only split groups of equal signatures. Words that share a signature
are met by an equi-join and verified by their edit distance. All of it runs in SQL functions.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Parts that the bits are dealt over; a signature holds PARTS - 2 of them.
PARTS = 4
#: Letters of a word.
LETTERS = [chr(c) for c in (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0xC0, 0x100))]
RUN = "[A-Za-zÀ-ÿ]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rounds of pointer doubling; chains of 2^32 forms would be whole in 32.
MOST_ROUNDS = 32


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and run, a row for each maximal run of letters of the whole text, A-Z lower-cased. A null text has none."""
    text = F.translate(F.col(f"`{text_col}`"), _UPPER, _LOWER)
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("run"))


def count_words(words: DataFrame, min_length: int = 7, min_count: int = 2) -> DataFrame:
    """word and n: the distinct values of `word` of at least min_length code points and min_count rows."""
    return words.filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def _signatures(word: Column) -> Column:
    """Array of (key, longest): the word's signatures as the longer or equal word of a pair and as the shorter one."""
    letters = F.array_join(F.array_sort(F.split(word, "")), "")
    cores = []
    for parts in combinations(range(PARTS), PARTS - 2):
        others = "".join(c for c in LETTERS if ord(c) % PARTS not in parts)
        cores.append(F.translate(letters, others, ""))
    found, length = [], F.length(word)
    for longest in (length, length + 1):
        third = F.floor(longest / 3).cast("int")
        rest, one = longest - third, F.lit(1)
        head, tail = F.substr(word, one, third), F.substr(word, length - third + 1, third)
        pieces = (F.substr(word, one, rest), F.substr(word, length - rest + 1, rest), F.concat(head, F.lit(" "), tail))
        for i, core in enumerate(cores):
            for j, piece in enumerate(pieces):
                found.append(F.struct(F.xxhash64(F.lit(i * 3 + j), longest, core, piece).alias("key"), longest.alias("longest")))
    return F.array(*found)


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a < b) exactly one inserted, deleted or replaced code point apart, each once, with their counts.

    words: word of at least 3 code points, n; one row a word, as from count_words.
    """
    keyed = words.select("word", "n", F.explode(_signatures(F.col("word"))).alias("s")).select("s.*", "word", "n")
    left = keyed.select("key", "longest", F.col("word").alias("a"), F.col("n").alias("n_a"))
    right = keyed.select("key", "longest", F.col("word").alias("b"), F.col("n").alias("n_b"))
    # pairs of two shorter words meet under their own length
    met = (F.col("a") < F.col("b")) & (F.greatest(F.length("a"), F.length("b")) == F.col("longest"))
    near = F.levenshtein("a", "b", 1) == 1
    return left.join(right, ["key", "longest"]).filter(met & near).groupBy("a", "b").agg(F.first("n_a").alias("n_a"), F.first("n_b").alias("n_b"))


def group_variants(words: DataFrame, ratio: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word.

    form is the near word of largest n (ties: the smallest in code-point order) if its n is at least ratio times the word's;
    root follows forms to the last. n grows with each form, so forms make no circle, and pointers double each round.
    words: word, n, one row a word; an empty table gives no rows. A word without near words has n_near 0, form null and
    itself as root.
    """
    if ratio < 2:
        raise ValueError("ratio must be at least 2")
    words = common.cut(words.select("word", "n"), "words")
    pairs = near_pairs(words).select(
        F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))).alias("p")
    )
    best = pairs.select("p.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), F.col("other"))).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    known = common.cut(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")
        ),
        "forms",
    )
    roots = known.filter("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(MOST_ROUNDS):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        met = common.cut(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        roots = met.select("word", "root")
        if met.filter("moved").isEmpty():
            break
    return known.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def misspell(found: DataFrame, every: int = 31) -> DataFrame:
    """`word` of runs(): where every divides h, the crc32 of `<id>:<run>`, the run less its code point h % length.

    A null id is written as empty text. Runs of one code point may leave an empty word.
    """
    h = F.crc32(F.encode(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")), "UTF-8"))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    less = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    return found.withColumn("h", h).select(F.when(F.col("h") % every == 0, less).otherwise(F.col("run")).alias("word"))
