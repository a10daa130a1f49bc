"""Packing by bounded-space online best fit.

Each partition keeps a fixed number of open windows. A piece goes to the open window that it fills best; when it
fits none and all are open, the fullest window is emitted. What is still open at the end of a partition is
merged in a last pass over groups of partitions.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Open windows of a partition.
OPEN_WINDOWS = 256
#: Partitions whose leftovers are merged by one task: at most MERGE_PARTITIONS x OPEN_WINDOWS windows.
MERGE_PARTITIONS = 32
#: Words whose ids a worker remembers, about.
CACHED_WORDS = 50_000
#: A space belongs to the word after it, so a text can be cut before any space that no white space follows.
CUT, UNEVEN_SPACE = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: The pattern of the fast encoder recurses on white space; texts with longer runs go to `tokenizers`.
LONG_SPACE = re.compile(r"\s{1000}")

# How byte-level vocabularies write bytes, printable ones as themselves and the others from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part int, ids binary"


class Encoder:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes, word by word.

    The vocabulary is that of a byte-level `tokenizers` file. Words that are not known yet are encoded together, by
    tiktoken on the same vocabulary, which gives the same ids faster, and told apart by the bytes of their tokens.
    Strings of special tokens in a text are ordinary text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"]}
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in model["model"]["vocab"].items() if t not in special}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        self.sizes[list(ranks.values())] = list(map(len, ranks))
        self.words: dict[str, bytes] = {}
        self.path, self._whole = path, None

    def _plain(self, text: str) -> bytes:
        """Ids of one text by `tokenizers` itself, loaded when the first such text comes."""
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self.path)
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        for at in range(0, len(words), 10_000):
            some = words[at : at + 10_000]
            ids = np.array(self.encoding.encode_ordinary(" " + " ".join(some)), dtype="<u4")
            ends = np.cumsum([1 + len(w.encode("utf-8", "surrogatepass")) for w in some])
            edges = np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1
            data, edges = ids.tobytes(), [0, *(4 * edges).tolist()]
            self.words.update({w: data[i:j] for w, i, j in zip(some, edges[:-1], edges[1:], strict=True)})

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        for at in range(0, len(texts), 200):
            some = texts[at : at + 200]
            split = [None if LONG_SPACE.search(t) else CUT.split(t) if UNEVEN_SPACE.search(t) else t.split(" ") for t in some]
            if len(self.words) > CACHED_WORDS:
                self.words.clear()
            later = set().union(*[w[1:] for w in split if w])
            self._learn(list(later.difference(self.words)))
            for text, words in zip(some, split, strict=True):
                if words is None:
                    yield self._plain(text)
                    continue
                first = np.array(self.encoding.encode_ordinary(words[0]), dtype="<u4").tobytes()
                yield first + b"".join(map(self.words.__getitem__, words[1:]))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, so words stay known from task to task."""
    return Encoder(path)


class OpenWindows:
    """At most `most` windows with room left; best fit by a bit set of the rooms that occur."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.count, self.bits = size, most, 0, 0
        self.by_room: list[list[list]] = [[] for _ in range(size)]

    def take(self, need: int) -> list | None:
        """The window with the least room for `need`."""
        rooms = self.bits >> need
        if not rooms:
            return None
        return self._pop(need + (rooms & -rooms).bit_length() - 1)

    def fullest(self) -> list:
        return self._pop((self.bits & -self.bits).bit_length() - 1)

    def _pop(self, room: int) -> list:
        window = self.by_room[room].pop()
        self.count -= 1
        if not self.by_room[room]:
            self.bits &= ~(1 << room)
        return window

    def put(self, window: list, room: int) -> None:
        self.by_room[room].append(window)
        self.count += 1
        self.bits |= 1 << room

    def add(self, item: tuple, need: int) -> list | None:
        """Place an item; the window that is now complete or had to be emitted, if any."""
        window, out = self.take(need), None
        if window is None:
            if self.count >= self.most:
                out = self.fullest()
            window = []
        window.append(item)
        room = self.size - sum(i[2] for i in window)
        if room == 0:
            if out is None:
                return window
            self.put(out, self.size - sum(i[2] for i in out))
            return window
        self.put(window, room)
        return out

    def rest(self) -> Iterator[list]:
        for windows in self.by_room:
            yield from windows


def _rows(window: list, sequence: int) -> Iterator[tuple]:
    at = 0
    for item in window:
        yield (*item[:5], sequence, at, item[5])
        at += item[2]


def _packer(path: str, size: int, end_id: int, most: int, with_ids: bool):
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, windows, n, schema = TaskContext.get().partitionId(), encoder(path), OpenWindows(size, most), 0, _schema()

        def batch(rows: list[tuple], is_open: bool) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*cols[:7], [is_open] * len(rows), [part] * len(rows), cols[7]], schema.types, strict=True)], schema=schema)

        for b in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    item = (doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece if with_ids else None)
                    full = [item] if item[2] == size else windows.add(item, item[2])
                    if full:
                        rows += _rows(full, part << 32 | n)
                        n += 1
                if len(rows) >= 20_000:
                    yield batch(rows, False)
                    rows = []
            if rows:
                yield batch(rows, False)
        rows = []
        for window in windows.rest():
            rows += _rows(window, part << 32 | n)
            n += 1
        if rows:
            yield batch(rows, True)

    return pack


def _schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in PIECES.split(", "))])


def _merger(size: int, most: int):
    def merge(key: tuple, pieces: pd.DataFrame) -> pd.DataFrame:
        """Best fit, longest first, over the leftovers of one group of partitions."""
        pieces = pieces.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True]).reset_index(drop=True)
        windows, sequence, at, n = OpenWindows(size, most), [0] * len(pieces), [0] * len(pieces), 0
        full = []
        for i, length in enumerate(pieces["length"].tolist()):
            if out := windows.add((i, 0, length), length):
                full.append(out)
        for window in [*full, *windows.rest()]:
            offset = 0
            for i, _, length in window:
                sequence[i], at[i] = 1 << 62 | int(key[0]) << 32 | n, offset
                offset += length
            n += 1
        return pieces.assign(sequence_id=sequence, offset=at)

    return merge


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end_id: int = 0, open_windows: int = OPEN_WINDOWS, with_ids: bool = True) -> DataFrame:
    """Pack every text into windows of at most `size` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if with_ids, ids
    (little-endian unsigned 32-bit). A document is the ids of its text and end_id; documents over `size` are
    cut every `size` ids. Null and empty texts are end_id alone; null and repeated ids are packed as they come.
    An empty table gives no rows; other columns of docs are not read. Memory in a task: one batch, the open windows
    and a bounded word cache.
    """
    common.small_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    pieces = common.cut(texts.mapInArrow(_packer(tokenizer, size, end_id, open_windows, with_ids), PIECES), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
    leftovers = pieces.filter("open").withColumn("group", F.expr(f"part div {MERGE_PARTITIONS}"))
    # pandas would make ids beside a null floating point
    own = F.col("doc_id")
    leftovers = leftovers.withColumns({"no_id": own.isNull(), "doc_id": F.coalesce(own, F.lit(0).cast("long"))})
    merged = leftovers.groupBy("group").applyInPandas(_merger(size, MERGE_PARTITIONS * open_windows), leftovers.schema)
    merged = merged.withColumn("doc_id", F.when(~F.col("no_id"), own))
    return pieces.filter("not open").select(columns).unionByName(merged.select(columns))
