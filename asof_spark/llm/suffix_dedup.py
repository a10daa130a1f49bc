"""Removal of repeated substrings by a common-prefix-aware distributed merge sort of suffixes.

A string of SPAN bytes that also starts earlier is removed. Only suffixes at sampled places, the anchors, are
sorted, and every removal comes from a merge that compared the bytes.

1. Anchors. Each window of SPAN bytes picks the smallest hash of its GRAM-byte grams; neighbouring windows with the
   same pick form a record. Equal windows pick the same gram at the same place, so a record whose gram occurs once
   cannot repeat. A bit filter of bounded size skips such records; a false hit only costs time.
2. Records are sorted as strings: the suffix at the anchor, then the bytes before the anchor backwards, then shape.
   Sorted runs are front-coded, cut at sampled splitters, exchanged and merged by a loser tree. Windows of a
   record that equals an earlier one are repeats.
3. A window of the first of equal records can still repeat in another record that agrees on the suffix up to the
   window's end, hence in a neighbour of the sorted order: the common prefixes of the merge tell which windows are
   open. They are sorted, exchanged and merged in the same way, in the same order of bytes.
4. The repeats of a document are joined to its text and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SPAN, GRAM = 100, 32
#: Most bytes of a record before its anchor, and bytes of the strings that stand for a record and a window.
BEFORE = SPAN - GRAM
RECORD, WINDOW = SPAN + BEFORE + 2, SPAN + 1
#: Bytes that are hashed at once; longer texts are cut with an overlap, so memory does not grow with a text.
PIECE_BYTES = 1 << 18
#: Strings of a sorted run, of a segment at most, and (about) of a range that is merged at once.
RUN, SEGMENT, RANGE = 60_000, 400, 100_000
#: Ranges by splitters at most; beyond them a range is dealt out by the gram, so the driver's sample stays bounded.
MAX_RANGES, SPLITTER_SOURCES, SAMPLE_STRINGS = 2_048, 2_000, 100_000
#: Bits of the filter for each gram that occurs again, and the most bits (32 MB).
GRAM_BITS, MOST_BITS, SLICES = 16, 28, 64
#: Packed stretches of a table are broadcast to the texts up to so many bytes and rows; more meet them by shuffle.
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    if n > 1:
        out[1:] = np.uint64(base)
        np.multiply.accumulate(out, out=out)
    return out


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


class Anchors:
    """Records of many texts at once; grams are hashed by differences of sums of byte x power."""

    def __init__(self, room: int = PIECE_BYTES):
        self.up, self.down = _powers(_BASE, room + 1), _powers(_INVERSE, room + 1)

    def records(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """gram hash, text number, anchor and first window (places in data) and windows of every record."""
        n = len(data)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=total[1:])
        grams = _mixed((total[GRAM:] - total[:-GRAM]) * self.down[: n - GRAM + 1])
        place = np.uint64((1 << 24) - 1)
        least, have, want = (grams & ~place) | np.arange(len(grams), dtype=np.uint64), 1, SPAN - GRAM + 1
        while have < want:
            step = min(have, want - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        windows = np.maximum(0, lengths - SPAN + 1)
        text = np.repeat(np.arange(len(lengths)), windows)
        at = np.arange(len(text)) + np.repeat(starts - np.cumsum(windows) + windows, windows)
        anchor = (least[at] & place).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])]))
        count = np.diff(np.append(new, len(at)))
        # the least of many hashes is small, so it is mixed once more before it is dealt out and looked up
        return _mixed(grams[anchor[new]]), text[new], anchor[new], at[new], count


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Batches of (text), or of (doc, version, text), as tuples of joined pieces: data, starts, lengths, docs, versions and places in the documents."""

    def joined() -> tuple:
        lengths = np.array([len(p) for p in pieces])
        tags = np.array(heads, dtype=np.int64).reshape(-1, 3)
        return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(lengths) - lengths, lengths, tags[:, 0], tags[:, 1], tags[:, 2]

    pieces, heads, held = [], [], 0
    for b in batches:
        texts = b.column(b.num_columns - 1)
        ids = zip(*(b.column(i).to_pylist() for i in range(2)), strict=True) if b.num_columns == 3 else [(0, 0)] * b.num_rows
        for (doc, version), text in zip(ids, texts, strict=True):
            data = text.as_buffer()
            for at in range(0, len(data) - SPAN + 1, PIECE_BYTES - SPAN):
                piece = data[at : at + PIECE_BYTES - 1].to_pybytes()
                if held + len(piece) > PIECE_BYTES:
                    yield joined()
                    pieces, heads, held = [], [], 0
                pieces.append(piece)
                heads.append((doc, version, at))
                held += len(piece)
    if pieces:
        yield joined()


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> gram, n: the grams of its records."""
    anchors = Anchors()
    for data, starts, lengths, *_ in _pieces(batches):
        gram, n = np.unique(anchors.records(data, starts, lengths)[0], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(n)], ["gram", "n"])


class GramFilter:
    """A bit for each hash of a gram that occurs again; a gram without its bit is unique."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.shift = np.uint64(64 - (8 * len(bits)).bit_length() + 1)

    def __call__(self, gram: np.ndarray) -> np.ndarray:
        at = gram >> self.shift
        return self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1


def _slicer(width: int):
    """gram -> slice, bits: the part of the filter that holds the grams of a slice."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        size = (1 << width) // SLICES
        for b in batches:
            at = (b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - width)).astype(np.int64)
            for s in np.unique(at // size).tolist():
                own = found.setdefault(s, np.zeros(size, dtype=bool))
                own[at[at // size == s] % size] = True
        for s, own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([s]), pa.array([np.packbits(own, bitorder="little").tobytes()])], ["slice", "bits"])

    return fill


def gram_filter(shared: DataFrame) -> bytes:
    """The filter of a table of grams: as many bits as they need, at most 2 ** MOST_BITS, whatever the size of the table."""
    width = min(MOST_BITS, max(16, (GRAM_BITS * shared.count()).bit_length()))
    by_slice = shared.select("gram").repartition(SLICES, F.shiftrightunsigned("gram", 64 - SLICES.bit_length() + 1))
    bits = bytearray((1 << width) // 8)
    size = len(bits) // SLICES
    for s, part in by_slice.mapInArrow(_slicer(width), "slice long, bits binary").collect():
        bits[s * size : (s + 1) * size] = part
    return bytes(bits)


def record_strings(data: np.ndarray, anchor: np.ndarray, low: np.ndarray, count: np.ndarray) -> np.ndarray:
    """RECORD bytes for each record: from the anchor on, before the anchor backwards (each filled up with zeros), place of the anchor, windows."""
    padded = np.concatenate([np.zeros(BEFORE, np.uint8), data, np.zeros(SPAN, np.uint8)])
    around = np.lib.stride_tricks.sliding_window_view(padded, BEFORE + SPAN)[anchor]
    out = np.empty((len(anchor), RECORD), dtype=np.uint8)
    out[:, :SPAN] = np.where(np.arange(SPAN)[None, :] < (low + count + SPAN - 1 - anchor)[:, None], around[:, BEFORE:], 0)
    out[:, SPAN:-2] = np.where(np.arange(BEFORE)[None, :] < (anchor - low)[:, None], around[:, BEFORE - 1 :: -1], 0)
    out[:, -2], out[:, -1] = anchor - low, count
    return out


def window_strings(records: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings of the windows of records that hold `least` to all bytes before the anchor; their records and those bytes.

    WINDOW bytes: from the anchor to the window's end, before the anchor backwards to its start, and how many those are.
    """
    place = records[:, -2].astype(np.int64)
    count = place - least + 1
    owner = np.repeat(np.arange(len(records)), count)
    before = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count) + least[owner]
    out = np.empty((len(owner), WINDOW), dtype=np.uint8)
    columns = np.arange(SPAN)
    for i in range(0, len(owner), 8192):
        some, b = owner[i : i + 8192], before[i : i + 8192, None]
        out[i : i + 8192, :SPAN] = records[some[:, None], columns + b * (columns >= SPAN - b)]
    out[:, -1] = before
    return out, owner, before


SEGMENTS = "range int, deal int, run long, n int, lcp binary, tails binary, tags binary"
_SEGMENTS = pa.schema([("range", pa.int32()), ("deal", pa.int32()), ("run", pa.int64()), ("n", pa.int32()), ("lcp", pa.binary()), ("tails", pa.binary()), ("tags", pa.binary())])


def _front_coded(strings: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted strings of one width: common prefixes with the one before, and what follows them."""
    lcp = np.zeros(len(strings), dtype=np.uint8)
    if len(strings) > 1:
        lcp[1:] = (strings[1:] != strings[:-1]).argmax(axis=1)
    return lcp.tobytes(), strings[np.arange(strings.shape[1])[None, :] >= lcp[:, None]].tobytes()


def _unpacked(lcp: bytes, tails: bytes, width: int) -> Iterator[bytes]:
    before, at = b"", 0
    for keep in lcp:
        before = before[:keep] + tails[at : at + width - keep]
        at += width - keep
        yield before


def _stretches(tags: np.ndarray) -> np.ndarray:
    """doc, version, low, windows: overlapping and neighbouring stretches of a document as one."""
    if not len(tags):
        return tags
    tags = tags[np.lexsort((tags[:, 2], tags[:, 1], tags[:, 0]))]
    new_text = np.concatenate([[True], (tags[1:, :2] != tags[:-1, :2]).any(axis=1)])
    end = tags[:, 2] + tags[:, 3]
    room = int(end.max()) + 1
    text = np.cumsum(new_text) - 1
    reach = np.maximum.accumulate(end + text * room) - text * room  # the furthest end so far in this document
    new = np.flatnonzero(new_text | np.concatenate([[True], tags[1:, 2] > reach[:-1]]))
    out = tags[new].copy()
    out[:, 3] = reach[np.append(new[1:] - 1, len(tags) - 1)] - out[:, 2]
    return out


class Runs:
    """Strings with tags (doc, version, low, windows) -> front-coded segments of sorted runs, each within a range.

    A run keeps the first of equal strings; the others are segments without strings, which only hold tags.
    """

    def __init__(self, width: int, splitters: list[bytes], deals: int):
        self.width, self.cuts, self.deals = width, np.array(splitters, dtype=f"S{width}"), deals
        self.parts, self.held, self.number, self.task = [], 0, 0, TaskContext.get().partitionId()

    def add(self, strings: np.ndarray, tags: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(strings), RUN):
            self.parts.append((strings[i : i + RUN], tags[i : i + RUN]))
            self.held += len(self.parts[-1][0])
            if self.held >= RUN:
                yield self.run()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self.run()

    def run(self) -> pa.RecordBatch:
        strings, tags = (np.concatenate([p[i] for p in self.parts]) for i in range(2))
        self.parts, self.held, self.number = [], 0, self.number + 1
        order = np.lexsort((tags[:, 2], tags[:, 1], tags[:, 0]))
        order = order[np.argsort(strings.view(f"S{self.width}").ravel()[order], kind="stable")]
        strings, tags = strings[order], tags[order]
        new = np.concatenate([[True], (strings[1:] != strings[:-1]).any(axis=1)])
        head = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = _stretches(tags[(tags[:, :3] != tags[head, :3]).any(axis=1)])
        strings, tags = strings[new], tags[new]
        target = np.searchsorted(self.cuts, strings.view(f"S{self.width}").ravel(), side="right").astype(np.int64)
        deal = np.zeros(len(strings), dtype=np.int64)
        if self.deals > 1:
            words = strings[:, :GRAM].copy().view("<u8")
            deal = (_mixed(words[:, 0] + _mixed(words[:, 1] + _mixed(words[:, 2] + _mixed(words[:, 3])))) % np.uint64(self.deals)).astype(np.int64)
            order = np.lexsort((deal, target))  # stable, so strings stay sorted within
            strings, tags, target, deal = strings[order], tags[order], target[order], deal[order]
        edges = [0, *(np.flatnonzero((target[1:] != target[:-1]) | (deal[1:] != deal[:-1])) + 1).tolist(), len(target)]
        run = self.task << 32 | self.number
        rows = [(self.number % (len(self.cuts) + 1), 0, run, None, None, None, again[i : i + 20_000].astype("<i8").tobytes()) for i in range(0, len(again), 20_000)]
        for i, j in zip(edges[:-1], edges[1:], strict=True):
            for k in range(i, j, SEGMENT):
                m = min(j, k + SEGMENT)
                rows.append((int(target[i]), int(deal[i]), run, m - k, *_front_coded(strings[k:m]), tags[k:m].astype("<i8").tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SEGMENTS.types, strict=True)], schema=_SEGMENTS)


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix of two strings of one width, the first `known` bytes of which are equal."""
    if a == b:
        return len(a)
    step = known
    while a[step : step + 8] == b[step : step + 8]:
        step += 8
    while a[step] == b[step]:
        step += 1
    return step


class LoserTree:
    """Merge of sorted runs of (string, common prefix with the one before, tag); the strings of a run are distinct.

    Each run's lcp is the common prefix of its next string with the last output. The longer one is the smaller
    string; only equal ones need bytes, and only those after the prefix. While the winner's own next string has a
    longer prefix than any loser on its way, it wins again without a match.
    """

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.head: list[tuple | None] = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.lcp = [0 if h else -1 for h in self.head]
        self.losers = [0] * self.size
        winners = list(range(self.size))
        for level in range(self.size.bit_length() - 1):
            nodes = self.size >> (level + 1)
            for i in range(nodes):
                winners[i], self.losers[nodes + i] = self._play(winners[2 * i], winners[2 * i + 1])
        self.winner = winners[0]

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's lcp becomes that with the winner."""
        la, lb = self.lcp[a], self.lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        x, y = self.head[a][0], self.head[b][0]
        at = common_prefix(x, y, la)
        if at == len(x) or x[at] < y[at]:
            self.lcp[b] = at
            return a, b
        self.lcp[a] = at
        return b, a

    def __iter__(self) -> Iterator[tuple]:
        """lcp with the output before, string, tag."""
        runs, head, lcp, losers, size, play = self.runs, self.head, self.lcp, self.losers, self.size, self._play
        w = self.winner
        while head[w] is not None:
            start = node = (size + w) >> 1
            most = -1
            while node:
                if lcp[losers[node]] > most:
                    most = lcp[losers[node]]
                node >>= 1
            feed = runs[w]
            while True:
                out = head[w]
                yield lcp[w], out[0], out[2]
                head[w] = following = next(feed, None)
                lcp[w] = following[1] if following else -1
                if lcp[w] <= most:
                    break
            node = start
            while node:
                other = losers[node]
                if lcp[other] > lcp[w]:
                    losers[node], w = w, other
                elif lcp[other] == lcp[w]:
                    w, losers[node] = play(w, other)
                node >>= 1


def _ranges(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[list[np.ndarray], LoserTree | None]]:
    """Ranges of a partition sorted by range, deal and run: tags known to repeat, and the merge of the runs."""

    def read(segments: list[tuple]) -> Iterator[tuple]:
        before = b""
        for lcp, tails, tags in segments:
            lcps = list(lcp)
            tags = np.frombuffer(tags, "<i8").reshape(-1, 4).tolist()
            for string, keep, tag in zip(_unpacked(lcp, tails, width), lcps, tags, strict=True):
                if not keep and before:
                    keep = common_prefix(before, string, 0)
                before = b""
                yield string, keep, tag
            before = string

    def merged() -> tuple:
        return known, LoserTree([read(s) for s in runs.values()]) if runs else None

    now, known, runs = None, [], {}
    for b in batches:
        columns = [b.column(i) for i in range(7)]
        for i in range(b.num_rows):
            key = (columns[0][i].as_py(), columns[1][i].as_py())
            if key != now and now is not None:
                yield merged()
                known, runs = [], {}
            now = key
            if columns[3][i].as_py() is None:
                known.append(np.frombuffer(columns[6][i].as_py(), "<i8").reshape(-1, 4))
            else:
                runs.setdefault(columns[2][i].as_py(), []).append(tuple(columns[c][i].as_py() for c in (4, 5, 6)))
    if now is not None:
        yield merged()


REPEATS = "doc long, version long, low long, windows long"
OPEN = "strings binary, lcp binary, tags binary, least binary, open long"


def _batch(tags: np.ndarray, opened: tuple | None = None) -> pa.RecordBatch:
    """Stretches of repeats, or (with opened) one segment of open records."""
    tags = np.asarray(tags, dtype=np.int64).reshape(-1, 4)
    columns, n = [pa.array(tags[:, i]) for i in range(4)], len(tags)
    more = [pa.nulls(n, pa.binary())] * 4 + [pa.nulls(n, pa.int64())]
    if opened is not None:
        columns, more = [pa.nulls(1, pa.int64())] * 4, [pa.array([x]) for x in opened]
    return pa.RecordBatch.from_arrays(columns + more, [c.split()[0] for c in f"{REPEATS}, {OPEN}".split(", ")])


def _merge_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of repeated records, and segments of first records with the windows that a neighbour may share."""
    for known, tree in _ranges(batches, RECORD):
        again, held = [], []

        def opened(held: list[tuple]) -> pa.RecordBatch:
            strings = np.frombuffer(b"".join(h[0] for h in held), np.uint8).reshape(-1, RECORD)
            least = np.array([h[2] for h in held], dtype=np.uint8)
            lcp, tails = _front_coded(strings)
            return _batch([], (tails, lcp, np.array([h[1] for h in held], dtype="<i8").tobytes(), least.tobytes(), int((strings[:, -2] + 1 - least.astype(np.int64)).sum())))

        string, first, shared = None, None, SPAN
        # beyond the edges of a range the neighbours are not known: they may share all windows
        for lcp, s, tag in tree or ():
            if lcp == RECORD and string is not None:
                if tag[:3] != first[:3]:
                    again.append(max(first, tag))
                    first = min(first, tag)
                continue
            if string is not None:
                least = max(string[-2] - string[-1] + 1, SPAN - min(SPAN, max(shared, lcp)))
                if least <= string[-2]:
                    held.append((string, first, least))
                    if len(held) >= SEGMENT:
                        yield opened(held)
                        held = []
                shared = lcp
            string, first = s, tag
        if string is not None:
            held.append((string, first, max(0, string[-2] - string[-1] + 1)))
            yield opened(held)
        if again or known:
            yield _batch(_stretches(np.concatenate([np.array(again, dtype=np.int64).reshape(-1, 4), *known])))


def _merge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of windows that several first records hold, less the first of each."""
    for known, tree in _ranges(batches, WINDOW):
        again, first = [], None
        for lcp, _, tag in tree or ():
            if lcp < WINDOW or first is None:
                first = tag
            elif tag[:3] != first[:3]:
                again.append(max(first, tag))
                first = min(first, tag)
        if again or known:
            yield _batch(_stretches(np.concatenate([np.array(again, dtype=np.int64).reshape(-1, 4), *known]))).select(range(4))


def _shared_records(batches: Iterator[pa.RecordBatch], bits) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings and tags of the records whose gram the filter holds."""
    anchors, keep = Anchors(), GramFilter(bits.value)
    for data, starts, lengths, docs, versions, base in _pieces(batches):
        gram, text, anchor, low, count = anchors.records(data, starts, lengths)
        some = np.flatnonzero(keep(gram))
        if len(some):
            text, anchor, low, count = text[some], anchor[some], low[some], count[some]
            yield record_strings(data, anchor, low, count), np.stack([docs[text], versions[text], low - starts[text] + base[text], count], axis=1)


def _open_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strings and tags of the open windows of segments of records."""
    for b in batches:
        for tails, lcp, tags, least in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            records = np.frombuffer(b"".join(_unpacked(lcp, tails, RECORD)), np.uint8).reshape(-1, RECORD)
            strings, owner, before = window_strings(records, np.frombuffer(least, np.uint8).astype(np.int64))
            tags = np.frombuffer(tags, "<i8").reshape(-1, 4)[owner]
            yield strings, np.stack([tags[:, 0], tags[:, 1], tags[:, 2] + records[owner, -2] - before, np.ones(len(owner), np.int64)], axis=1)


def _sampler(strings_of: Callable, step: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = 0
        for strings, _ in strings_of(batches):
            some = strings[first::step]
            first = (first - len(strings)) % step
            yield pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in some], pa.binary())], ["s"])

    return sample


def _builder(strings_of: Callable, width: int, splitters: list[bytes], deals: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(width, splitters, deals)
        for strings, tags in strings_of(batches):
            yield from runs.add(strings, tags)
        yield from runs.rest()

    return build


def _merged(rows: DataFrame, key: list[str], sources: int, total: int, step: int, strings_of: Callable, width: int, merge: Callable, kind: str) -> DataFrame:
    """Merge sort of the strings of rows; total: about how many they are.

    Splitters are chosen from every step-th string of about SPLITTER_SOURCES rows, of which the driver gets some
    SAMPLE_STRINGS at most. key tells rows apart, so that copies of a text are not all taken.
    """
    ranges = max(1, -(-total // RANGE))
    sample = []
    if ranges > 1:
        some = rows.filter(F.pmod(F.xxhash64(*key), F.lit(max(1, sources // SPLITTER_SOURCES))) == 0)
        strings = common.cut(some.mapInArrow(_sampler(strings_of, step), "s binary"), "sample")
        share = SAMPLE_STRINGS / max(1, strings.count())
        sample = sorted(bytes(r[0]) for r in (strings if share >= 1 else strings.sample(share, 1)).collect())
    wanted = min(ranges, MAX_RANGES)
    splitters = sorted({sample[len(sample) * i // wanted] for i in range(1, wanted)}) if sample else []
    runs = rows.mapInArrow(_builder(strings_of, width, splitters, -(-ranges // wanted)), SEGMENTS)
    return runs.repartition("range", "deal").sortWithinPartitions("range", "deal", "run").mapInArrow(merge, kind)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc (the order of documents; null ids come last), version (tells texts of one id apart, and orders them), doc_id and the text as bytes."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    own: Column = F.col(f"`{id_col}`").cast("long")
    return docs.select(F.coalesce(own, F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(text).alias("version"), own.alias("doc_id"), text.cast("binary").alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, version, low, windows: stretches of starts of SPAN-byte strings that also start earlier. They can overlap."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = _texts(docs, id_col, text_col).filter(F.length("text") >= SPAN).select("doc", "version", "text")
    counted = texts.select("text").mapInArrow(_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    shared = common.cut(counted.filter("n > 1"), "grams")
    total = shared.agg(F.sum("n")).first()[0] or 0
    bits = spark.sparkContext.broadcast(gram_filter(shared))
    kind = f"{REPEATS}, {OPEN}"
    merged = _merged(texts, ["doc", "version"], texts.count(), total, 4, lambda b: _shared_records(b, bits), RECORD, _merge_records, kind)
    merged = common.cut(merged, "records")
    segments = merged.filter("open is not null").select("strings", "lcp", "tags", "least", "open")
    holders, windows = segments.agg(F.count(F.lit(1)), F.sum("open")).first()
    again = _merged(segments.drop("open"), ["tags"], holders, windows or 0, 64, _open_windows, WINDOW, _merge_windows, REPEATS)
    return merged.filter("open is null").select("doc", "version", "low", "windows").unionByName(again)


def _packed(low: np.ndarray, end: np.ndarray) -> bytes:
    """Stretches of one document, sorted and apart: 32-bit gaps and lengths, 64-bit where they need it."""
    flat = np.diff(np.stack([low, end], axis=1).ravel(), prepend=0)
    kind = "<u4" if flat.max() < 1 << 32 else "<u8"
    return bytes([int(kind[2])]) + flat.astype(kind).tobytes()


def _by_document(stretches: DataFrame) -> DataFrame:
    """doc, version, packed: the removed bytes of each document as one value, with a broadcast hint if all of them are small."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for low, n in zip(b["lows"], b["counts"], strict=True):
                low, end = np.asarray(low), np.asarray(low) + np.asarray(n) + SPAN - 1
                spans = _stretches(np.stack([np.zeros_like(low), np.zeros_like(low), low, end - low], axis=1))
                out.append(_packed(spans[:, 2], spans[:, 2] + spans[:, 3]))
            yield pd.DataFrame({"doc": b["doc"], "version": b["version"], "packed": out})

    lists = stretches.groupBy("doc", "version").agg(F.collect_list(F.struct("low", "windows")).alias("w"))
    lists = lists.select("doc", "version", F.col("w.low").alias("lows"), F.col("w.windows").alias("counts"))
    packed = common.cut(lists.mapInPandas(pack, "doc long, version long, packed binary"), "found")
    rows, size = packed.agg(F.count(F.lit(1)), F.sum(F.length("packed"))).first()
    return F.broadcast(packed) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else packed


def _remover(with_kept: bool):
    def removed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for doc_id, data, packed in zip(b["doc_id"], b["text"], b["packed"], strict=True):
                edges = [] if packed is None else np.cumsum(np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.int64)).tolist()
                starts, ends = edges[::2], edges[1::2]
                kept = b"".join([data[i:j] for i, j in zip([0, *ends], [*starts, len(data)], strict=True)])
                out.append((doc_id, len(data), len(data) - len(kept), list(zip(starts, ends, strict=True)), kept if with_kept else None, hashlib.sha256(kept).hexdigest(), len(starts)))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept", "kept_sha256", "n_spans"])

    return removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_kept: bool = True) -> DataFrame:
    """Remove every byte covered by a SPAN-byte string that also starts earlier (smaller id, or earlier in the text).

    One row per row of docs: doc_id, n_bytes, n_removed, n_spans, spans (array of start and end in bytes), kept
    (the remaining bytes, if with_kept) and kept_sha256. Texts are UTF-8; a null text is empty; texts under SPAN
    bytes lose nothing. Rows that repeat an id and its text are one document and get equal results; different
    texts of one id are documents of their own, in the order of a hash of the text. Null ids come after all
    others. An empty table gives no rows; other columns of docs are not read.
    """
    found = _by_document(repeats(docs, id_col, text_col))
    kind = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary, kept_sha256 string, n_spans long"
    return common.map_frames(_texts(docs, id_col, text_col).join(found, ["doc", "version"], "left").select("doc_id", "text", "packed"), _remover(with_kept), kind)
