"""Conversation structure repair by a square-root checkpointed dynamic programme.

The role initials of a repaired conversation read `(s?(ua)+)?`. Four states stand for what has been
read (nothing, s, u, a), and the least cost of the rest of a conversation from each state is a
vector of four numbers. Walking backward, the vectors are kept only at checkpoints, one in the
square root of the rows. Walking forward, the vectors of one block at a time are made again from
its checkpoint, and of the edits that keep the least cost the one with the least initial is taken.

Rows are dealt by ranges of conversation and turn, so a conversation that holds a third of all rows
lies in many tasks. A conversation that lies whole in one task is repaired there. The others become
pieces of bounded size: each piece tells its least costs from every state to every state, a stream
over the pieces of a conversation, last first, gives the vector behind each, a stream, first first,
the state in front of each, and the pieces are then walked side by side.
"""

from collections.abc import Iterator
from hashlib import sha256
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiframe.llm.common import ship
from lexiframe.plans.layout import written

BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
PIECE_ROWS, PIECE_BYTES = 4096, 1 << 20

# Costs of the edits, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)  # states: what was read last
KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (USER, 2): ASSISTANT, (ASSISTANT, 1): USER}
ADDED = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled turn leads
LAST = (0, 2 * INSERT, INSERT, 0)  # least costs at the end of a conversation
LAST_EDITS = ("", "II", "I", "")
FAR = 1 << 50

# A row's code: its initial (s, u, a, another) and its first fault times four.
INITIALS = ("s", "u", "a")
WHOLE, CUT_OFF, BLANK, DUPLICATE = range(4)


class Costs:
    """Vectors of least costs, numbered; equal ones but for a constant share their number.

    Only few differ, so a step is made once and looked up after. State for a task, not data.
    """

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[int, tuple[int, int]] = {}
        self.moves: dict[int, tuple[str, int]] = {}
        self.last, _ = self.number(LAST)

    def number(self, vector) -> tuple[int, int]:
        """Number of a vector, and the constant taken off it."""
        least = min(vector)
        key = tuple(min(x - least, FAR) for x in vector)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def before(self, after: tuple[int, ...], code: int) -> list[int]:
        """Least costs in front of a row from those behind it."""
        initial, fault = code & 3, code >> 2
        stay = TRUNCATED if fault == CUT_OFF else 0
        costs = [DELETE + x for x in after]
        if fault < BLANK:
            for state in range(4):
                costs[state] = min(costs[state], REROLE + stay + after[ADDED[state]])
                if (state, initial) in KEEP:
                    costs[state] = min(costs[state], stay + after[KEEP[state, initial]])
        for _ in range(2):  # two insertions lead from any state to any later one
            costs = [min(c, INSERT + costs[ADDED[state]]) for state, c in enumerate(costs)]
        return costs

    def step(self, key: int) -> tuple[int, int]:
        """In front of a row: number and constant; the key is the number behind it and its code."""
        self.steps[key] = found = self.number(self.before(self.vectors[key >> 4], key & 15))
        return found

    def move(self, key: int) -> tuple[str, int]:
        """The tight edits of least initials up to and with a row, and the state behind it."""
        state, code, after = key & 3, (key >> 2) & 15, self.vectors[key >> 6]
        costs, fault, edits = self.before(after, code), code >> 2, ""
        stay = TRUNCATED if fault == CUT_OFF else 0
        while True:
            if costs[state] == DELETE + after[state]:
                edits += "D"
                break
            if costs[state] == INSERT + costs[ADDED[state]]:
                edits, state = edits + "I", ADDED[state]
            elif (kept := KEEP.get((state, code & 3))) is not None and fault < BLANK \
                    and costs[state] == stay + after[kept]:
                edits, state = edits + "K", kept
                break
            else:
                edits, state = edits + "R", ADDED[state]
                break
        self.moves[key] = edits, state
        return edits, state

    def back(self, codes: bytes, end: int) -> tuple[int, int]:
        """Number and constant of the vector in front of all rows."""
        steps, cost = self.steps, 0
        for code in reversed(codes):
            key = end << 4 | code
            end, more = steps.get(key) or self.step(key)
            cost += more
        return end, cost

    def walk(self, codes: bytes, end: int, state: int) -> tuple[str, int]:
        """Edits from a state, the vector behind the rows being `end`, and the state reached."""
        steps, moves, size = self.steps, self.moves, isqrt(len(codes)) + 1
        marks = [end]
        for k in range((len(codes) - 1) // size, 0, -1):  # checkpoints, from the last block on
            marks.append(self.back(codes[k * size:(k + 1) * size], marks[-1])[0])
        edits = []
        for k in range(0, len(codes), size):
            block, vector = codes[k:k + size], marks.pop()
            behind = []
            for code in reversed(block):
                behind.append(vector)
                key = vector << 4 | code
                vector = (steps.get(key) or self.step(key))[0]
            for code in block:
                key = (behind.pop() << 4 | code) << 2 | state
                more, state = moves.get(key) or self.move(key)
                edits.append(more)
        return "".join(edits), state


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    if len(parts) == 1:
        return parts[0]
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([p.column(k) for p in parts]) for k in range(parts[0].num_columns)],
        schema=parts[0].schema)


def _starts(keys: pa.Array) -> np.ndarray:
    """Places where a new conversation begins."""
    new = pc.not_equal(keys.slice(1), keys.slice(0, len(keys) - 1))
    return np.concatenate([[0], 1 + np.flatnonzero(new.to_numpy(zero_copy_only=False))])


def _summary(rows: pa.RecordBatch, starts: np.ndarray) -> dict[str, np.ndarray]:
    """Codes with duplicates, and the counts of each run of rows."""
    n = len(starts)
    run = np.repeat(np.arange(n), np.diff(np.append(starts, rows.num_rows)))
    code = rows["code"].to_numpy().astype("u1")
    a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
    again = pd.DataFrame({"run": run, "a": a, "b": b}).duplicated().to_numpy()
    code = np.where(again & (code >> 2 != BLANK), code & 3 | DUPLICATE << 2, code).astype("u1")
    fault, initial = code >> 2, (code & 3).astype("i2")
    pair = initial[:-1] * 4 + initial[1:]
    bad = (run[1:] == run[:-1]) & ~np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1])  # su, ua, au
    turns = rows["turn"]
    at = np.flatnonzero(turns.is_valid().to_numpy(zero_copy_only=False))
    turn = turns.drop_null().to_numpy()
    of = run[at]
    new = np.ones(len(at), bool)
    new[1:] = (of[1:] != of[:-1]) | (turn[1:] != turn[:-1])
    low, high = np.zeros(n, "i8"), np.zeros(n, "i8")
    high[of] = turn  # turns rise inside a run, so the last one stays
    low[of[::-1]] = turn[::-1]
    count = lambda mask: np.bincount(run[mask], minlength=n)
    return {"code": code, "again": again, "low": low, "high": high, "turns": np.bincount(of[new], minlength=n),
            "blank": count(fault == BLANK), "duplicate": count(fault == DUPLICATE),
            "truncated": count(fault == CUT_OFF), "illegal": count(np.flatnonzero(bad) + 1)}


def _repaired(role: pa.Array, text: pa.Array, edits: list[str], entry: list[int]) -> pa.Array:
    """The turns of each run of rows after its edits: a list of (role, text) apiece."""
    n = len(text)
    flat = np.frombuffer("".join(edits).encode(), "u1")
    of = np.repeat(np.arange(len(edits)), [len(e) for e in edits])
    own = flat != ord("I")
    source = np.where(own, np.cumsum(own) - 1, n)
    stays = flat != ord("D")
    flat, of, source = flat[stays], of[stays], source[stays]
    sizes = np.bincount(of, minlength=len(edits))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(of)) - first[of]
    # users and assistants take turns; a system turn can only come first, from the first state
    initials = pc.utf8_slice_codeunits(role, 0, 1)
    system = np.append(pc.equal(initials, "s").to_numpy(zero_copy_only=False), False)
    shift = np.where(np.array(entry, "i8") == USER, 1, 0)
    opens = first[sizes > 0]
    shift[of[opens]] -= (flat[opens] == ord("K")) & system[source[opens]]
    speaker = (place + shift[of]) % 2
    roles = pa.concat_arrays([role, pa.array(["user", "assistant"], role.type)])
    texts = pa.concat_arrays([text, pa.array([""], text.type)])
    names = roles.take(pa.array(np.where(flat == ord("K"), source, n + speaker)))
    said = texts.take(pa.array(source))
    turns = pa.StructArray.from_arrays([names, said], ["role", "text"])
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), turns)


COUNTS = ("blank", "duplicate", "truncated", "illegal")
TOTALS = ("gaps", *COUNTS, "cost")
TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
FOUND = pa.schema([("conv", pa.string()), ("part", pa.int32()), ("piece", pa.int32()), ("whole", pa.bool_()),
                   *[(c, pa.int64()) for c in (*COUNTS, "low", "high", "turns", "cost")],
                   ("audit", pa.string()), ("codes", pa.binary()), ("at", pa.list_(pa.int32())),
                   ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("said", TURNS)])
FOUND_DDL = ("conv string, part int, piece int, whole boolean, blank long, duplicate long, truncated long, "
             "illegal long, low long, high long, turns long, cost long, audit string, codes binary, "
             "at array<int>, a array<long>, b array<long>, said array<struct<role:string,text:string>>")


def _record(columns: dict, n: int) -> pa.RecordBatch:
    """A batch of FOUND; columns that are not given are null."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c := columns.get(f.name), pa.Array) else pa.nulls(n, f.type) if c is None
         else pa.array(c, f.type) for f in FOUND], schema=FOUND)


def _finish(rows: pa.RecordBatch, part: int, costs: Costs) -> pa.RecordBatch:
    """Repair conversations of which all rows are here."""
    starts = _starts(rows["conv"])
    found = _summary(rows, starts)
    code, bounds = found["code"].tobytes(), [*starts.tolist(), rows.num_rows]
    cost, audit = [], []
    for begin, end in zip(bounds, bounds[1:]):
        own = code[begin:end]
        number, spent = costs.back(own, costs.last)
        edits, state = costs.walk(own, costs.last, START)
        cost.append(spent + costs.vectors[number][START])
        audit.append(edits + LAST_EDITS[state])
    n = len(audit)
    said = _repaired(rows["role"], rows["text"], audit, [START] * n)
    gaps = np.where(found["turns"] > 0, found["high"] - found["low"] + 1 - found["turns"], 0)
    return _record({"conv": rows["conv"].take(pa.array(starts)), "part": [part] * n, "piece": [0] * n,
                    "whole": [True] * n, **{c: found[c] for c in COUNTS}, "turns": gaps, "cost": cost,
                    "audit": audit, "said": said}, n)


def _piece(rows: pa.RecordBatch, part: int, piece: int) -> pa.RecordBatch:
    """Rows of one conversation that may have more elsewhere: codes, digests of first rows, counts."""
    found = _summary(rows, np.zeros(1, "i8"))
    at = np.flatnonzero(~found["again"] & (found["code"] >> 2 != BLANK))
    one = lambda x: pa.array([x])
    turns = pa.ListArray.from_arrays(pa.array([0, rows.num_rows], pa.int32()), pa.StructArray.from_arrays(
        [rows["role"], rows["text"]], ["role", "text"]))
    return _record({"conv": rows["conv"].slice(0, 1), "part": [part], "piece": [piece], "whole": [False],
                    "illegal": found["illegal"], "low": found["low"], "high": found["high"],
                    "turns": found["turns"], "codes": one(found["code"].tobytes()),
                    "at": one(at.astype("i4")), "a": one(rows["a"].to_numpy()[at]),
                    "b": one(rows["b"].to_numpy()[at]), "said": turns}, 1)


def _cut(rows: pa.RecordBatch, most_rows: int, most_bytes: int) -> int:
    """How many rows make a piece: one at least."""
    if rows.num_rows <= most_rows and rows.nbytes <= most_bytes:
        return rows.num_rows
    text = pc.binary_length(rows["text"].slice(0, most_rows)).to_numpy()
    return max(1, min(most_rows, int(np.searchsorted(np.cumsum(text), most_bytes, "right"))))


def _first(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, costs = TaskContext.get().partitionId(), Costs()
        held, piece, opened = None, 0, True  # the first conversation may have begun before
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch if held is None else _joined([held, batch])
            last = int(_starts(rows["conv"])[-1])
            if last:
                begin = 0
                if opened:
                    begin = int(_starts(rows["conv"])[1])
                    own = rows.slice(0, begin)
                    while own.num_rows:
                        size = _cut(own, most_rows, most_bytes)
                        yield _piece(own.slice(0, size), part, piece)
                        own, piece = own.slice(size), piece + 1
                if begin < last:
                    yield _finish(rows.slice(begin, last - begin), part, costs)
                rows, piece, opened = rows.slice(last), 0, False
            while (size := _cut(rows, most_rows, most_bytes)) < rows.num_rows:
                yield _piece(rows.slice(0, size), part, piece)
                rows, piece, opened = rows.slice(size), piece + 1, True
            held = rows
        if held is not None:  # the last one may go on behind
            yield _piece(held, part, piece)

    return run


KEYS = ("conv", "part", "piece")


def _late(pieces: DataFrame) -> DataFrame:
    """Places of rows whose role and text stand in an earlier piece of the conversation.

    Each piece sends a role and text once, so a very common one costs a row per piece.
    """
    rows = pieces.select(*KEYS, F.explode(F.arrays_zip("at", "a", "b")).alias("r")).select(
        *KEYS, F.struct("part", "piece").alias("here"), "r.at", "r.a", "r.b")
    first = rows.groupBy("conv", "a", "b").agg(F.min("here").alias("seen"), F.count(F.lit(1)).alias("n"))
    return (rows.join(first.filter("n > 1"), ["conv", "a", "b"]).filter("here > seen")
            .groupBy(*KEYS).agg(F.collect_list("at").alias("late")))


def _matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Codes with all duplicates, counts, and the least costs from each state to each state."""
    costs = Costs()
    for batch in batches:
        out = []
        for codes, late in zip(batch["codes"], batch["late"]):
            codes = np.frombuffer(codes, "u1").copy()
            if late is not None:
                at = np.asarray(late, "i8")
                codes[at] = codes[at] & 3 | DUPLICATE << 2
            columns = []
            for state in range(4):
                start, spent = costs.number([0 if s == state else FAR for s in range(4)])
                number, more = costs.back(codes.tobytes(), start)
                columns.append([min(FAR, spent + more + x) for x in costs.vectors[number]])
            fault = np.bincount(codes >> 2, minlength=4)
            out.append((codes.tobytes(), int(fault[BLANK]), int(fault[DUPLICATE]), int(fault[CUT_OFF]),
                        int(codes[0] & 3), int(codes[-1] & 3), [x for c in columns for x in c]))
        new = pd.DataFrame(out, columns=["codes", "blank", "duplicate", "truncated", "first", "last", "matrix"])
        same = batch[[*KEYS, "illegal", "low", "high", "turns"]].reset_index(drop=True)
        yield pd.concat([same, new], axis=1)


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The vector behind each piece, pieces coming last first; `cost` from the first state on."""
    conv, vector = None, list(LAST)
    for batch in batches:
        ends, cost = [], []
        for own, matrix in zip(batch["conv"], batch["matrix"]):
            if own != conv:
                conv, vector = own, list(LAST)
            ends.append(vector)
            vector = [min(int(matrix[4 * t + s]) + vector[t] for t in range(4)) for s in range(4)]
            cost.append(vector[START])
        yield pd.DataFrame({**{k: batch[k] for k in KEYS}, "behind": ends, "cost": cost})


def _exits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state behind each piece by the state in front of it."""
    costs = Costs()
    for batch in batches:
        exits = [[costs.walk(bytes(codes), costs.number([int(x) for x in behind])[0], state)[1] for state in range(4)]
                 for codes, behind in zip(batch["codes"], batch["behind"])]
        yield batch.drop(columns="codes").assign(exits=exits)


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state in front of each piece, pieces coming in order, and the counts so far."""
    conv = state = None
    seen: dict = {}
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.conv != conv:
                conv, state = r.conv, START
                seen = dict.fromkeys(COUNTS, 0) | {"cost": int(r.cost), "last": None, "low": None, "high": 0, "turns": 0}
            entry, state = state, int(r.exits[state])
            for c in COUNTS:
                seen[c] += int(getattr(r, c))
            if seen["last"] is not None and (seen["last"], r.first) not in ((0, 1), (1, 2), (2, 1)):
                seen["illegal"] += 1
            seen["last"] = r.last
            if r.turns:
                seen["turns"] += int(r.turns) - (seen["low"] is not None and seen["high"] == r.low)
                seen["low"], seen["high"] = (r.low if seen["low"] is None else seen["low"]), r.high
            gaps = int(seen["high"] - seen["low"] + 1 - seen["turns"]) if seen["turns"] else 0
            out.append((r.conv, r.part, r.piece, r.behind, entry, state, gaps, *[seen[c] for c in COUNTS], seen["cost"]))
        yield pd.DataFrame(out, columns=[*KEYS, "behind", "entry", "exit", "gaps", *COUNTS, "cost"])


def _walks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edits of each piece; the last one of a conversation adds those at its end."""
    costs = Costs()
    for batch in batches:
        edits = []
        for codes, behind, entry, more in zip(batch["codes"], batch["behind"], batch["entry"], batch["more"]):
            own, state = costs.walk(bytes(codes), costs.number([int(x) for x in behind])[0], int(entry))
            edits.append(own if more else own + LAST_EDITS[state])
        yield batch.drop(columns=["codes", "behind"]).assign(audit=edits)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired turns of each piece."""
    for batch in batches:
        said = batch["said"]
        rows = said.flatten()
        new = _repaired(rows.field("role"), rows.field("text"), batch["audit"].to_pylist(),
                        batch["entry"].to_pylist())
        at = batch.schema.get_field_index("said")
        yield batch.set_column(at, "said", new.cast(TURNS))


def key_of(conv: str) -> Column:
    """A conversation's id as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit(""))


def id_of(kind) -> Column:
    """The id back from its text in `conv`."""
    return F.when(F.col("conv") != "", F.substr("conv", F.lit(2)).cast(kind))


def _texts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """What the repair reads: conversation, turn, role, text, code and digests of each row."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(key_of(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), spoken(role).alias("role"), spoken(text).alias("text"))
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (F.when(body == "", BLANK).when(F.right(body, F.lit(1)).isin(*ENDS), WHOLE).otherwise(CUT_OFF))
    initial = F.substring("role", 1, 1)
    kind = F.lit(3)
    for k, letter in enumerate(INITIALS):
        kind = F.when(initial == letter, k).otherwise(kind)
    return rows.select("*", (kind + 4 * fault).cast("int").alias("code"),
                       F.xxhash64(F.lit(1), "role", "text").alias("a"), F.xxhash64(F.lit(2), "role", "text").alias("b"))


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The cheapest edits of every conversation: one row per piece, a short conversation being one.

    Columns: `conv_id`, the conversation's id, `part` and `piece` (their order is the order of
    the pieces), `alone` (it was whole in one task), `more` (pieces follow), `gaps`, `blank`, `duplicate`, `truncated`, `illegal` and
    `cost` (of the whole conversation; where `more` is false), `audit` (initials of the edits) and
    `said` (the repaired turns, role and text).

    Rows go by turn, nulls first; rows of one turn by role, then by the first 200 characters of
    their text, then by a hash. Role and text that are null count as one blank; a null id is a
    conversation of its own. A row whose role does not begin with s, u or a (an empty one too)
    can be reroled or deleted, not kept. Texts and conversations may be of any length. Repeated
    rows are rows of their own, so all but the first are duplicates. Other columns are ignored,
    whatever their names. No rows give no rows. A role and text count as seen by 128 bits of hash.
    """
    spark = rows.sparkSession
    ship(spark)
    kind = rows.schema[conv].dataType
    order = ["conv", "turn", "role", F.substring("text", 1, 200), "a"]
    ready = _texts(rows, conv, turn, role, text).withColumn(
        "salt", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1024)).cast("short"))
    # equal rows go to several ranges by their salt: which of them comes first makes no difference
    dealt = ready.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select(
        "conv", "turn", "role", "text", "code", "a", "b")
    found = written(dealt.mapInArrow(_first(piece_rows, piece_bytes), FOUND_DDL), "conversations")
    pieces = found.filter("NOT whole")
    blocks = pieces.select(*KEYS, "codes", "illegal", "low", "high", "turns").join(_late(pieces), [*KEYS], "left")
    key_ddl = "conv string, part int, piece int"
    counts = ", ".join(f"{c} long" for c in COUNTS)
    blocks = written(blocks.mapInPandas(_matrices, f"{key_ddl}, illegal long, low long, high long, turns long, "
                                        "codes binary, blank long, duplicate long, truncated long, first int, "
                                        "last int, matrix array<long>"), "pieces")
    behind = (blocks.select(*KEYS, "matrix").repartition("conv")
              .sortWithinPartitions("conv", F.desc("part"), F.desc("piece"))
              .mapInPandas(_ends, f"{key_ddl}, behind array<long>, cost long"))
    carried = [*KEYS, *COUNTS, "low", "high", "turns", "first", "last", "behind", "cost"]
    exits = blocks.join(behind, [*KEYS]).select(*carried, "codes").mapInPandas(
        _exits, f"{key_ddl}, {counts}, low long, high long, turns long, first int, last int, "
        "behind array<long>, cost long, exits array<int>")
    states = exits.repartition("conv").sortWithinPartitions(*KEYS).mapInPandas(
        _entries, f"{key_ddl}, behind array<long>, entry int, exit int, gaps long, {counts}, cost long")
    ends = states.groupBy("conv").agg(F.max(F.struct("part", "piece")).alias("end"))
    walks = (states.join(ends, "conv").withColumn("more", F.struct("part", "piece") != F.col("end"))
             .join(blocks.select(*KEYS, "codes"), [*KEYS]))
    walked = walks.select(*KEYS, "more", "entry", *TOTALS, "behind", "codes").mapInPandas(
        _walks, f"{key_ddl}, more boolean, entry int, gaps long, {counts}, cost long, audit string")
    said = "said array<struct<role:string,text:string>>"
    parts = (pieces.select(*KEYS, "said").join(walked, [*KEYS])
             .select(*KEYS, "more", *TOTALS, "audit", "entry", "said")
             .mapInArrow(_turns, f"{key_ddl}, more boolean, gaps long, {counts}, cost long, audit string, "
                         f"entry int, {said}"))
    whole = found.filter("whole").select(*KEYS, F.lit(False).alias("more"), F.col("turns").alias("gaps"),
                                         *COUNTS, "cost", "audit", "said")
    every = whole.withColumn("alone", F.lit(True)).unionByName(
        parts.drop("entry").withColumn("alone", F.lit(False)))
    return every.select(id_of(kind).alias("conv_id"), "part", "piece", "alone", "more",
                        *[F.when(~F.col("more"), F.col(c)).alias(c) for c in TOTALS], "audit", "said")


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digest and whole audit of each conversation, its pieces coming in order."""
    digest, audit, begun = sha256(), [], False
    for batch in batches:
        out = []
        for r in batch.itertuples(index=False):
            if r.n:
                digest.update((("\n" if begun else "") + r.body).encode())
                begun = True
            audit.append(r.audit)
            if not r.more:
                out.append((r.conv, *[int(getattr(r, c)) for c in TOTALS], "".join(audit), digest.hexdigest()))
                digest, audit, begun = sha256(), [], False
        yield pd.DataFrame(out, columns=["conv", *TOTALS, "audit", "repaired_sha256"])


def reports(pieces: DataFrame) -> DataFrame:
    """One row per conversation of `repair`: its id, `gaps`, `blank`, `duplicate`, `truncated`,
    `illegal`, `cost`, the whole `audit`, and the digest of the repaired turns (`role:text`,
    joined by line ends). No rows give no rows.

    A digest reads its text in order, so the pieces of a long conversation stream through one
    task, piece by piece; none is kept there.
    """
    ship(pieces.sparkSession)
    body = F.array_join(F.transform("said", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    one = pieces.filter("alone").select(key_of("conv_id").alias("conv"), *TOTALS, "audit",
                                        F.sha2(F.encode(body, "UTF-8"), 256).alias("repaired_sha256"))
    many = pieces.filter("NOT alone").select(
        key_of("conv_id").alias("conv"), "part", "piece", "more", *[F.coalesce(c, F.lit(0)).alias(c) for c in TOTALS],
        "audit", F.size("said").alias("n"), body.alias("body"))
    many = many.repartition("conv").sortWithinPartitions(*KEYS).mapInPandas(
        _digests, "conv string, " + ", ".join(f"{c} long" for c in TOTALS) + ", audit string, repaired_sha256 string")
    return one.unionByName(many).select(id_of(pieces.schema["conv_id"].dataType).alias("conv_id"), *TOTALS, "audit",
                                        "repaired_sha256")


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the faults that crc32(`conv_id:turn`) % 20 names: 0 drops
    the row, 1 empties its text, 2 takes out `[.!?]`, 3 repeats it, 4 makes its role user. Nulls
    count as one blank, but conv_id and turn stay null."""
    spoken = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    name = F.concat(spoken("conv_id"), F.lit(":"), spoken("turn"))
    fault = F.col("fault")
    rows = rows.select("conv_id", "turn", spoken("role").alias("role"), spoken("text").alias("text"),
                       (F.crc32(name.cast("binary")) % 20).cast("int").alias("fault")).filter(fault != 0)
    text = F.when(fault == 1, "").when(fault == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
