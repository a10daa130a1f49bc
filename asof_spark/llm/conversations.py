"""Repair of the turn structure of conversations by cheapest edits, computed by Four-Russians block tables.

The roles of a repaired conversation read (s?(ua)+)?: an optional system turn, then pairs of user and assistant. A row is
one of nine symbols: to be deleted, or the initial of its role (s, u, a, other) whole or truncated. The costs still to
come are a vector over the four states of that grammar; less their least value only a few dozen vectors can occur. For each of these and
each block of BLOCK symbols a table holds the vector before the block and what was subtracted, so a conversation is walked backward
a block a look-up. Then every block is expanded backward from the vector at its end, and the edits are read
forward, each step taking the least letter that keeps the cost: since in a state each letter leads to one
state, that gives the ASCII-least of the cheapest edit strings.

Rows are dealt out by ranges of conversation and turn, so a conversation of any length is spread over tasks: a task cuts it into pieces of
at most PIECE_ROWS rows and PIECE_BYTES of text. A conversation that lies in one piece is finished there. For the others each piece yields the
costs from every state to every state; a walk over those gives the vector at the end of each piece, and one over
the pieces in order reads the edits and the digest, which is one chain by its nature. Each walk holds one piece at a time.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Symbols of a block.
BLOCK = 3
#: Most rows and text bytes of a piece, unless one row alone is longer.
PIECE_ROWS, PIECE_BYTES = 4096, 4 << 20
#: Counted tables of at most so many rows (about 100 bytes each) are broadcast.
BROADCAST_ROWS = 100_000

# states of the grammar: nothing yet, after s, after u, after ua
_START, _SYSTEM, _USER, _PAIR = range(4)
_NEXT = {(_START, "s"): _SYSTEM, (_START, "u"): _USER, (_SYSTEM, "u"): _USER, (_USER, "a"): _PAIR, (_PAIR, "u"): _USER}
#: The one role that may be inserted or given in a state.
_ROLE = ("user", "user", "assistant", "user")
_INF = 1 << 40
#: Symbol 0 is a row to be deleted; 1 + 2 i is initial i of this string whole, 2 + 2 i truncated.
_INITIALS = "sua?"
_SYMBOLS = 1 + 2 * len(_INITIALS)
_KEEP, _REROLE, _DELETE, _INSERT, _TRUNCATED = 0, 2, 3, 2, 1


def _inserted(costs: list[int]) -> list[int]:
    """Costs with any insertions before what follows."""
    out = list(costs)
    for _ in range(3):
        for q in range(4):
            out[q] = min(out[q], _INSERT + out[_NEXT[q, _ROLE[q][0]]])
    return [min(c, _INF) for c in out]


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row of this symbol."""
    found = [("D", _DELETE, state)]
    if symbol:
        initial, more = _INITIALS[(symbol - 1) // 2], _TRUNCATED * (symbol % 2 == 0)
        if (state, initial) in _NEXT:
            found.append(("K", _KEEP + more, _NEXT[state, initial]))
        found.append(("R", _REROLE + more, _NEXT[state, _ROLE[state][0]]))
    return found


def _before(symbol: int, costs: list[int]) -> list[int]:
    """Costs before a row from those after it."""
    return _inserted([min(c + costs[q] for _, c, q in _choices(symbol, state)) for state in range(4)])


#: Costs after the last row: nothing more is needed in the states that the grammar accepts.
END = tuple(_inserted([0, _INF, _INF, 0]))
#: Costs after the last row of a piece that has to end in a given state.
ENDS = [tuple(_inserted([0 if q == e else _INF for q in range(4)])) for e in range(4)]


def _normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, _INF) if c < _INF else _INF for c in costs), least


@lru_cache(maxsize=1)
def tables() -> tuple[list[tuple[int, ...]], dict[tuple[int, ...], int], list[list[tuple[int, int]]], list[list[tuple[int, int]]]]:
    """Vectors, their numbers, and by number and symbol or block code: (number before it, what was subtracted)."""
    numbers, vectors, single = {}, [], []
    waiting = [_normal(list(v))[0] for v in (END, *ENDS)]
    while waiting:
        v = waiting.pop()
        if v not in numbers:
            numbers[v] = len(vectors)
            vectors.append(v)
            waiting += [_normal(_before(s, list(v)))[0] for s in range(_SYMBOLS)]
    for v in vectors:
        single.append([(numbers[w], least) for w, least in (_normal(_before(s, list(v))) for s in range(_SYMBOLS))])
    blocks = []
    for v in range(len(vectors)):
        row = []
        for block in itertools.product(range(_SYMBOLS), repeat=BLOCK):
            at, total = v, 0
            for symbol in reversed(block):
                at, least = single[at][symbol]
                total += least
            row.append((at, total))
        blocks.append(row)
    return vectors, numbers, single, blocks


def _code(symbols: bytes, at: int) -> int:
    code = 0
    for s in symbols[at : at + BLOCK]:
        code = code * _SYMBOLS + s
    return code


def walk(symbols: bytes, end: tuple[int, ...]) -> tuple[list[tuple[int, int]], tuple[int, ...]]:
    """Backward over whole blocks, then the rest at the front: (vector number, its base) after each block, last one first; and
    the costs before the first row."""
    vectors, numbers, single, blocks = tables()
    normal, base = _normal(list(end))
    at, seen = numbers[normal], []
    first = len(symbols) % BLOCK
    for i in range(len(symbols) - BLOCK, first - 1, -BLOCK):
        seen.append((at, base))
        at, least = blocks[at][_code(symbols, i)]
        base += least
    if first:
        seen.append((at, base))
    for s in reversed(symbols[:first]):
        at, least = single[at][s]
        base += least
    return seen, tuple(min(c + base, _INF) if c < _INF else _INF for c in vectors[at])


def edits(symbols: bytes, state: int, end: tuple[int, ...], last: bool) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits from a state on, and the state that they end in.

    end: costs still to come after these rows. last: insertions after the last row belong to these edits; else they are
    left to the rows that follow.
    """
    vectors, _, single, _ = tables()
    seen, _ = walk(symbols, end)
    out, first = [], len(symbols) % BLOCK
    starts = ([0] if first else []) + list(range(first, len(symbols), BLOCK))
    for i, after in zip(starts, [*starts[1:], len(symbols)]):
        points = [seen.pop()]
        for s in reversed(symbols[i:after]):
            number, less = single[points[-1][0]][s]
            points.append((number, points[-1][1] + less))
        costs = [[c + base for c in vectors[number]] for number, base in reversed(points)]
        for j, s in enumerate(symbols[i:after]):
            steps = {letter: (cost, q) for letter, cost, q in _choices(s, state)}
            while True:
                kept = next((x for x in "DIKR" if _leads(x, steps, state, costs[j], costs[j + 1])), None)
                out.append(kept)
                if kept != "I":
                    break
                state = _NEXT[state, _ROLE[state][0]]
                steps = {letter: (cost, q) for letter, cost, q in _choices(s, state)}
            state = steps[kept][1]
    while last and state not in (_START, _PAIR):
        out.append("I")
        state = _NEXT[state, _ROLE[state][0]]
    return "".join(out), state


def _leads(letter: str, steps: dict[str, tuple[int, int]], state: int, here: list[int], after: list[int]) -> bool:
    """Whether the cheapest edits from here may begin with this letter."""
    if letter == "I":
        return _INSERT + here[_NEXT[state, _ROLE[state][0]]] == here[state]
    return letter in steps and steps[letter][0] + after[steps[letter][1]] == here[state]


class _Reading:
    """Edits, digest and counts of one conversation, fed piece by piece in order."""

    def __init__(self, with_turns: bool) -> None:
        self.state, self.cost, self.audit, self.sha, self.begun = _START, None, [], hashlib.sha256(), False
        self.counts, self.turns, self.low, self.high, self.initial = [0, 0, 0, 0], 0, None, None, ""
        self.repaired = [] if with_turns else None

    def _write(self, role: str, text: str) -> None:
        self.sha.update((b"\n" if self.begun else b"") + f"{role}:{text}".encode())
        self.begun = True
        if self.repaired is not None:
            self.repaired.append({"role": role, "text": text})

    def feed(self, piece: dict, end: tuple[int, ...], last: bool) -> None:
        symbols = piece["symbols"]
        if self.cost is None:
            self.cost = walk(symbols, end)[1][_START]
        state, rows = self.state, iter(zip(symbols, _texts(piece)))
        letters, self.state = edits(symbols, state, end, last)
        for letter in letters:
            if letter == "D":
                next(rows)
                continue
            role = _ROLE[state]
            if letter == "I":
                self._write(role, "")
            else:
                _, (own, text) = next(rows)
                role = own if letter == "K" else role
                self._write(role, text)
            state = _NEXT[state, role[0]]
        self.audit.append(letters)
        for i, n in enumerate(piece["counts"]):
            self.counts[i] += n
        self.counts[3] += bool(self.initial) and self.initial + piece["initials"][0] not in _LEGAL
        self.initial = piece["initials"][1]
        if piece["low"] is not None:
            self.turns += piece["turns"] - (self.high == piece["low"])
            self.low, self.high = piece["low"] if self.low is None else self.low, piece["high"]

    def row(self, conv: object) -> dict:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        found = {"conv": conv, "gaps": gaps} | dict(zip(("blank", "duplicate", "truncated", "illegal"), self.counts))
        return found | {"cost": self.cost, "audit": "".join(self.audit), "repaired_sha256": self.sha.hexdigest(), "repaired": self.repaired}


def _texts(piece: dict) -> Iterator[tuple[str, str]]:
    """Role and text of every row of a piece; those to be deleted have none."""
    kept = iter(zip(piece["roles"], piece["texts"]))
    for s in piece["symbols"]:
        yield next(kept) if s else ("", "")


_LEGAL = ("su", "ua", "au")
_FAULTS = {"blank": 0, "duplicate": 1, "truncated": 2}
_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()),
           ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))]
_RESULT_DDL = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired array<struct<role:string,text:string>>"
_PIECE = [("part", pa.int64()), ("no", pa.int64()), ("symbols", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("initials", pa.list_(pa.string())),
          ("turns", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("costs", pa.list_(pa.int64()))]
_PIECE_DDL = "part long, no long, symbols binary, roles array<string>, texts array<string>, counts array<long>, initials array<string>, turns long, low long, high long, costs array<long>"


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            yield from batch.slice(at, 256).to_pylist()


def _pieces(rows: Iterator[dict], most: int) -> Iterator[dict]:
    """Pieces of sorted rows, each of one conversation, without costs. A row that stands for many copies is spread over pieces."""
    piece, size, before = None, 0, None
    for r in rows:
        left = r["times"]
        while left:
            if piece is not None and (piece["conv"] != r["conv"] or len(piece["symbols"]) >= most or size >= PIECE_BYTES):
                yield piece
                piece = None
            if piece is None:
                piece, size = {"conv": r["conv"], "symbols": bytearray(), "roles": [], "texts": [], "counts": [0, 0, 0, 0], "initials": [r["initial"], ""], "turns": 0, "low": None, "high": None}, 0
            more = 1 if left == r["times"] else min(left, most)
            fault = r["fault"] if left == r["times"] or r["fault"] == "blank" else "duplicate"
            if fault:
                piece["counts"][_FAULTS[fault]] += more
            if fault in ("blank", "duplicate"):
                piece["symbols"] += bytes(more)
            else:
                piece["symbols"].append(1 + 2 * _INITIALS.index(r["initial"]) + (fault == "truncated"))
                piece["roles"].append(r["role"])
                piece["texts"].append(r["text"])
                size += len(r["text"])
            last = piece["initials"][1]
            piece["counts"][3] += more - 1 + (bool(last) and last + r["initial"] not in _LEGAL)
            piece["initials"][1] = r["initial"]
            if r["turn"] is not None:
                piece["turns"] += r["turn"] != piece["high"]
                piece["low"], piece["high"] = r["turn"] if piece["low"] is None else piece["low"], r["turn"]
            left -= more
    if piece is not None:
        yield piece


def _write(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("audit") or "") + 2 * sum(map(len, r.get("texts") or ())) + 2 * sum(len(x["text"]) for x in r.get("repaired") or ())
        if size > common.BATCH_BYTES or len(held) >= 4096:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _solve(with_turns: bool, conv: pa.DataType, most: int):
    """Rows sorted by conversation to finished conversations and pieces of those that may go on in other tasks."""
    schema = pa.schema([("conv", conv), *_RESULT, *_PIECE])

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        part, no, outer = TaskContext.get().partitionId(), 0, True
        for conv_pieces, inner in _conversations(_pieces(_rows(batches), most)):
            for k, (piece, only) in enumerate(conv_pieces):
                piece["symbols"] = bytes(piece["symbols"])
                if only and inner and not outer:
                    reading = _Reading(with_turns)
                    reading.feed(piece, END, True)
                    yield reading.row(piece["conv"])
                else:
                    by_end = [walk(piece["symbols"], end)[1] for end in ENDS]
                    yield piece | {"part": part, "no": no, "costs": [by_end[e][q] for q in range(4) for e in range(4)]}
                no += 1
            outer = False

    return lambda batches: _write(result(batches), schema)


def _conversations(pieces: Iterator[dict]) -> Iterator[tuple[Iterator[tuple[dict, bool]], bool]]:
    """The pieces of each conversation, each with whether it is the only one, and whether another conversation follows."""
    ahead = next(pieces, None)
    while ahead is not None:
        first, ahead = ahead, next(pieces, None)
        alone = ahead is None or ahead["conv"] != first["conv"]
        if alone:
            yield iter([(first, True)]), ahead is not None
            continue

        def several(piece: dict = first) -> Iterator[tuple[dict, bool]]:
            nonlocal ahead
            yield piece, False
            while ahead is not None and ahead["conv"] == piece["conv"]:
                now, ahead = ahead, next(pieces, None)
                yield now, False

        yield several(), True


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs after each piece, from pieces sorted by conversation and backward."""
    schema = pa.schema([("part", pa.int64()), ("no", pa.int64()), ("end", pa.list_(pa.int64())), ("last", pa.bool_())])

    def found() -> Iterator[dict]:
        conv, costs, begun = None, END, False
        for r in _rows(batches):
            last = not begun or r["conv"] != conv
            conv, costs, begun = r["conv"], END if last else costs, True
            yield {"part": r["part"], "no": r["no"], "end": list(costs), "last": last}
            costs = tuple(min(r["costs"][4 * q + e] + costs[e] for e in range(4)) for q in range(4))

    return _write(found(), schema)


def _finish(with_turns: bool, conv_type: pa.DataType):
    """Conversations from their pieces in order, each with the costs after it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        reading = None
        for batch in batches:
            for at in range(batch.num_rows):
                (piece,) = batch.slice(at, 1).to_pylist()
                reading = reading or _Reading(with_turns)
                reading.feed(piece, tuple(piece["end"]), piece["last"])
                if piece["last"]:
                    yield reading.row(piece["conv"])
                    reading = None

    return lambda batches: _write(found(batches), pa.schema([("conv", conv_type), *_RESULT]))


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", times_col: str | None = None, with_turns: bool = False, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """One row a conversation: faults of its rows, the cheapest edits that make it legal, and the digest of the result.

    Rows are taken by turn (null turns first), then role, then a digest; equal rows lie side by side. times_col: a count of adjacent copies that a row
    stands for (else 1; rows of 0 or null are no rows of their conversation, which is still returned). A null role or text is one space; null
    ids are one conversation. Faults, the first that fits: blank (only white space), duplicate (role and text of an earlier row), truncated
    (the last character that is no white space is not . ! ?). Edits: K keep 0, R give the role user or assistant 2, D delete 3
    (the only edit of blank and duplicate rows), I insert an empty user or assistant turn 2; a truncated row that stays adds 1.
    Returns conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (`role:text` by lines) and, with_turns,
    repaired: the turns of the result. Other columns are not read; an empty table gives no rows.
    """
    spark = turns.sparkSession
    common.small_batches(spark)
    from_role, from_text = (F.coalesce(F.col(f"`{c}`"), F.lit(" ")) for c in (role_col, text_col))
    times = F.coalesce(F.col(f"`{times_col}`"), F.lit(0)).cast("long") if times_col else F.lit(1).cast("long")
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").cast("long").alias("turn"), from_role.alias("role"), from_text.alias("text"), times.alias("times"))
    none = rows.groupBy("conv").agg(F.max("times").alias("most")).filter("most <= 0").select("conv")
    owner = F.concat_ws(":", F.col("conv").isNull().cast("string"), F.coalesce(F.col("conv").cast("string"), F.lit("")), F.length("role").cast("string"))
    rows = rows.filter("times > 0").withColumn("same", F.sha2(F.concat_ws(":", owner, "role", "text"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    seen = rows.groupBy("same", "turn").agg(F.count(F.lit(1)).alias("copies"))
    groups = common.cut(seen.groupBy("same").agg(F.min(place).alias("first"), F.max("copies").alias("copies"), F.count(F.lit(1)).alias("places")).filter("copies > 1 OR places > 1"), "repeats")
    rows = common.meet(rows, groups, "same", BROADCAST_ROWS)
    ended = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\f\r"))
    fault = (
        F.when(ended == "", "blank")
        .when(F.coalesce(place > F.col("first"), F.lit(False)), "duplicate")
        .when(~F.right(ended, F.lit(1)).isin(".", "!", "?"), "truncated")
    )
    start = F.substring("role", 1, 1)
    rows = rows.select("conv", "turn", "role", "text", "same", "times", F.coalesce("copies", F.lit(1)).alias("copies"), fault.alias("fault"), F.when(start.isin("s", "u", "a"), start).otherwise("?").alias("initial"))
    once = rows.filter("copies = 1").drop("copies")
    # copies are counted, so a row repeated without end is one row of one task
    many = rows.filter("copies > 1").groupBy("conv", "turn", "role", "text", "same", "fault", "initial").agg(F.sum("times").alias("times"))
    order = ["conv", "turn", "role", "same"]
    dealt = once.unionByName(many.select(once.columns)).repartitionByRange(*order).sortWithinPartitions(*order).drop("same")
    kind = _arrow_type(turns, conv_col)
    ddl = turns.select(F.col(f"`{conv_col}`").alias("conv")).schema["conv"].dataType.simpleString()
    solved = common.cut(dealt.mapInArrow(_solve(with_turns, kind, piece_rows), f"conv {ddl}, {_RESULT_DDL}, {_PIECE_DDL}"), "conversations")
    names = [n for n, _ in _RESULT]
    pieces = solved.filter("audit IS NULL").select("conv", *[n for n, _ in _PIECE])
    back = pieces.select("conv", "part", "no", "costs").repartition("conv").sortWithinPartitions("conv", F.desc("part"), F.desc("no"))
    ends = common.cut(back.mapInArrow(_ends, "part long, no long, end array<long>, last boolean"), "ends")
    forward = pieces.drop("costs").join(common.small(ends, BROADCAST_ROWS), ["part", "no"]).repartition("conv").sortWithinPartitions("conv", "part", "no")
    long = forward.mapInArrow(_finish(with_turns, kind), f"conv {ddl}, {_RESULT_DDL}")
    zeros = [F.lit(0).cast("long").alias(n) for n in names[:6]]
    empty = none.select("conv", *zeros, F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"), F.array().cast("array<struct<role:string,text:string>>").alias("repaired"))
    found = solved.filter("audit IS NOT NULL").select("conv", *names).unionByName(long).unionByName(empty).withColumnRenamed("conv", conv_col)
    return found if with_turns else found.drop("repaired")


def _arrow_type(df: DataFrame, name: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[name].dataType)


def damage(turns: DataFrame, modulus: int = 20) -> DataFrame:
    """turns as after faults of transport, by code = crc32 of `conv_id:turn` modulo modulus, with `times`.

    0 drops the row (times 0), 1 empties its text, 2 takes its . ! ? away, 3 repeats it (times 2), 4 gives it the role user. Null columns are one space.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    code = F.crc32(F.encode(key, "UTF-8")) % modulus
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return turns.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(code == 0, 0).when(code == 3, 2).otherwise(1).alias("times"),
    )
