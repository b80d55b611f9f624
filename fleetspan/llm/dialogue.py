"""Cheapest repair of damaged conversations, decided by one integer a path.

The project holds no dialogues, so the interface is general: any table of turns with a conversation, a turn number, a role
and a text. A repaired conversation has the role initials ``(s?(ua)+)?``: perhaps a system turn, then user and assistant in
turn. A walk over its rows is a path in a graph of four states (nothing yet, after s, after u, after a). The weight of an
edge is one integer: its high digits are the cost, its low digits the audit letters of the row in a slot of fixed width,
ended with zeros, at the row's place. No slot is the beginning of another, so the smallest sum is the cheapest walk and
among those the ASCII-least audit; nothing but ``min`` and ``+`` on integers is needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import stored

# fixed values: the costs of the edits and the characters that are blank or that end a text
KEEP, REROLE, DELETE, INSERT, UNMENDED = 0, 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
LEGAL = ("su", "ua", "au")

DIGIT = 3  # bits of an audit letter; 0 is the padding
LETTERS = {"D": 1, "I": 2, "K": 3, "R": 4}
SLOT = 2 * DIGIT  # an insertion, perhaps, and the row's own letter
START, SYSTEM, USER, ASSISTANT = range(4)
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
SPEAKER = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}  # whom an inserted or rerouted turn goes to
NAMES = {USER: "user", ASSISTANT: "assistant"}

BLOCK_ROWS = 4096
BLOCK_CHARS = 4_000_000
FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal")


def damaged_turns(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``turns`` with planted faults, for tests of a repair; the four named columns are returned.

    The CRC-32 of ``conversation:turn`` modulo 20 decides: 0 drops the row, 1 empties the text, 2 removes its ``.!?``, 3 says
    it twice, 4 makes the role user. Nulls are one space, in that key as in role and text.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conversation), F.lit(":"), said(turn)).cast("binary")) % 20
    words = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said(text), "[.!?]", "")).otherwise(said(text))
    out = turns.select(F.col(conversation), F.col(turn), F.when(kind == 4, F.lit("user")).otherwise(said(role)).alias(role), words.alias(text), F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("__times"))
    return out.withColumn("__times", F.explode(F.array_repeat(F.lit(1), F.col("__times")))).drop("__times")


def _edges() -> dict[tuple[str, bool, bool], list[list[tuple[int, int, int]]]]:
    """For (initial, must go, truncated): from each state the least (state, cost, slot) to every other."""
    table = {}
    for initial in ("s", "u", "a", ""):
        for gone in (False, True):
            for cut in (False, True):
                rows: list[list[tuple[int, int, int]]] = []
                for state in range(4):
                    best: dict[int, tuple[int, int]] = {}
                    for inserted in (False, True):
                        here, paid, before = (SPEAKER[state], INSERT, "I") if inserted else (state, 0, "")
                        ways = [("D", here, DELETE)]
                        if not gone:
                            extra = UNMENDED if cut else 0
                            ways.append(("R", SPEAKER[here], REROLE + extra))
                            if here in AFTER.get(initial, {}):
                                ways.append(("K", AFTER[initial][here], KEEP + extra))
                        for letter, to, cost in ways:
                            best[to] = min(best.get(to, (1 << 30, 0)), (paid + cost, _slot(before + letter)))
                    rows.append([(to, cost, slot) for to, (cost, slot) in best.items()])
                table[initial, gone, cut] = rows
    return table


def _slot(letters: str) -> int:
    first, second = (LETTERS[c] for c in letters.ljust(2)) if len(letters) == 2 else (LETTERS[letters], 0)
    return first << DIGIT | second


EDGES = _edges()


def weights(kinds: list[tuple[str, bool, bool]], entries=(START,), tail: bool = True) -> list[list[int | None]]:
    """For each entry state the least weight of a walk over the rows to every state; with ``tail`` a last slot may insert.

    A weight is ``cost << w | letters`` with ``w`` = 6 bits a row and 3 for the tail, see ``read_weight``.
    """
    width = SLOT * len(kinds) + (DIGIT if tail else 0)
    out = []
    for entry in entries:
        at: list[int | None] = [None] * 4
        at[entry] = 0
        shift = width
        for kind in kinds:
            shift -= SLOT
            after: list[int | None] = [None] * 4
            for state, edges in enumerate(EDGES[kind]):
                if (base := at[state]) is not None:
                    for to, cost, slot in edges:
                        w = base + (cost << width) + (slot << shift)
                        if after[to] is None or w < after[to]:
                            after[to] = w
            at = after
        if tail:
            after = list(at)
            for state in range(4):
                if at[state] is not None:
                    w, to = at[state] + (INSERT << width) + LETTERS["I"], SPEAKER[state]
                    if after[to] is None or w < after[to]:
                        after[to] = w
            at = after
        out.append(at)
    return out


def read_weight(weight: int, rows: int, tail: bool = True) -> tuple[int, list[str]]:
    """Cost and the letters of every slot, those of the tail last."""
    width = SLOT * rows + (DIGIT if tail else 0)
    names = {v: k for k, v in LETTERS.items()} | {0: ""}
    low = weight & ((1 << width) - 1)
    digits = oct(low)[2:].rjust(width // DIGIT, "0") if width else ""
    slots = ["".join(names[int(d)] for d in digits[i : i + 2]) for i in range(0, len(digits), 2)]
    return weight >> width, slots if tail else slots + [""]


def _least(*walks: int | None) -> int:
    return min(w for w in walks if w is not None)


def repaired(rows: list[tuple[str, str]], slots: list[str], state: int = START) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) rows that the letters of ``slots`` leave, and the state after them."""
    out = []
    for i, letters in enumerate(slots):
        for c in letters:
            if c == "D":
                continue
            if c == "K":
                role, text = rows[i]
                state = AFTER[role[:1]][state]
            else:
                state = SPEAKER[state]
                role, text = NAMES[state], rows[i][1] if c == "R" else ""
            out.append((role, text))
    return out, state


def _facts(text: str) -> tuple[bool, bool]:
    said = text.rstrip(BLANKS)
    return not said, bool(said) and said[-1] not in ENDS


class _Tally:
    """Counts over the rows of a conversation, or of a block of it, in order."""

    def __init__(self) -> None:
        self.first_turn = self.last_turn = self.first_initial = self.last_initial = None
        self.turns = self.rows = 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns, self.last_turn = self.turns + 1, turn
            self.first_turn = turn if self.first_turn is None else self.first_turn
        if self.rows:
            self.illegal += self.last_initial + initial not in LEGAL
        else:
            self.first_initial = initial
        self.last_initial = initial
        self.rows += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated

    def extend(self, b) -> None:
        """Take in the block after these rows."""
        if b.first_turn is not None:
            self.turns += b.turns - (b.first_turn == self.last_turn)
            self.first_turn = b.first_turn if self.first_turn is None else self.first_turn
            self.last_turn = b.last_turn
        self.illegal += b.illegal + (self.last_initial + b.first_initial not in LEGAL if self.rows else 0)
        self.last_initial = b.last_initial
        self.rows += b.rows
        self.blank += b.blank
        self.duplicate += b.duplicate
        self.truncated += b.truncated

    def found(self) -> tuple[int, ...]:
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal


def repair_conversations(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Faults, the cheapest repair and the digest of the repaired transcript of every conversation.

    Rows count in order of turn (nulls first), role and text. A row's first fault counts: blank (nothing but white space),
    duplicate (role and text stood earlier in the conversation), truncated (the last visible character is none of ``.!?``).
    Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (a must for blank and duplicate), Insert an empty turn 3; a
    truncated row that stays costs 3 more. ``audit`` has the initials of the cheapest edits, the ASCII-least of these. Returns
    conv_id (the column's own name), gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of the
    newline-joined ``role:text``; other columns are not carried. Null role and text are one space; a null conversation is
    one of its own; a role without an initial cannot be kept. An empty table gives no rows.

    Rows are sorted by range over all tasks. A conversation inside one range, of one block (``block_rows`` rows or 4 million
    characters), is settled there. Of any other, blocks are weighed in parallel for each of their four entry states and the
    blocks' weights added up; only its digest, a sequential thing, is streamed through one task, a row at a time.
    """
    names = [conversation, turn, role, text]
    rows = turns.select(F.col(conversation).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    # the beginning of a text orders as the text does and keeps the sampled bounds small
    ranged = rows.repartitionByRange(F.col("conv"), F.col("turn"), F.col("role"), F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    conv_type = rows.schema["conv"].dataType
    settled = T.StructType([T.StructField("conv", conv_type)] + [T.StructField(c, T.LongType()) for c in (*FOUND, "cost")] + [T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    place = [T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("no", T.IntegerType())]
    schema = T.StructType([T.StructField("open", T.BooleanType()), *settled, *place, T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    first = stored(ranged.mapInArrow(_settle(block_rows), schema), "conversations")
    done = first.where("not open").select(settled.fieldNames())
    rest = first.where("open").select("conv", "part", "block", "no", "turn", "role", "text")
    out = done.unionByName(_settled_in_blocks(rest, settled))
    return out.withColumnRenamed("conv", names[0])


def _settle(block_rows: int):
    """One pass over sorted rows: conversations inside the partition are settled, the rows of others passed on by blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out: list[tuple] = []
        held: list[tuple] = []  # rows of the present block
        conv, block, chars, is_open, seen_any = None, 0, 0, True, False
        kind = None

        def pass_on() -> None:
            out.extend((True, conv, None, None, None, None, None, None, None, None, part, block, i, t, r, x) for i, (t, r, x) in enumerate(held))

        def close(last: bool) -> None:
            if not seen_any:
                return
            if is_open or last:
                pass_on()
            else:
                out.append((False, conv, *_whole(held), None, None, None, None, None, None))

        def packed() -> pa.RecordBatch:
            cols = list(zip(*out)) or [()] * 16
            types = [pa.bool_(), kind, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()]
            names = ["open", "conv", *FOUND, "cost", "audit", "repaired_sha256", "part", "block", "no", "turn", "role", "text"]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            out.clear()
            return done

        for batch in batches:
            kind = batch.schema.field(0).type
            for c, t, r, x in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if not seen_any or c != conv or (c is None) != (conv is None):
                    close(last=False)
                    is_open, seen_any, conv, block, chars = not seen_any, True, c, 0, 0
                    held = []
                elif len(held) >= block_rows or chars >= BLOCK_CHARS:
                    pass_on()
                    is_open, block, chars, held = True, block + 1, 0, []
                held.append((t, r, x))
                chars += len(x)
                if len(out) >= 4096:
                    yield packed()
        if seen_any:
            close(last=True)
            yield packed()

    return run


def _whole(held: list[tuple[int | None, str, str]]) -> tuple:
    """The result row of a conversation whose rows are all here."""
    tally, kinds, seen = _Tally(), [], set()
    for t, r, x in held:
        blank, cut = _facts(x)
        again = (r, x) in seen
        seen.add((r, x))
        gone, cut = blank or again, cut and not again
        tally.add(t, r[:1], blank, again and not blank, cut)
        kinds.append((r[:1] if r[:1] in AFTER else "", gone, cut))
    ends = weights(kinds)[0]
    cost, slots = read_weight(_least(ends[START], ends[ASSISTANT]), len(kinds))
    rows, _ = repaired([(r, x) for _, r, x in held], slots)
    return *tally.found(), cost, "".join(slots), hashlib.sha256("\n".join(f"{r}:{x}" for r, x in rows).encode()).hexdigest()


def _settled_in_blocks(rest: DataFrame, settled: T.StructType) -> DataFrame:
    """The result rows of conversations that lie in several blocks or at the edge of a partition."""
    at = F.struct("part", "block", "no")
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    light = rest.select("conv", "part", "block", "no", "turn", F.substring("role", 1, 1).alias("initial"), (said == "").alias("blank"), (~F.substring(said, -1, 1).isin(*ENDS)).alias("cut"), F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256).alias("mark"))
    repeats = light.groupBy("conv", "mark").agg(F.min(at).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("r_conv"), F.col("mark").alias("r_mark"), "first")
    marked = light.join(repeats, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("mark") == F.col("r_mark")), "left")
    again = F.coalesce(at > F.col("first"), F.lit(False))
    flagged = marked.select("conv", "part", "block", "no", "turn", "initial", "blank", (~F.col("blank") & again).alias("duplicate"), (~F.col("blank") & ~again & F.col("cut")).alias("cut"))
    kind = settled["conv"].dataType
    tallies = "first_turn long, last_turn long, first_initial string, last_initial string, turns long, rows long, blank long, duplicate long, truncated long, illegal long"
    keys = T.StructType([T.StructField("conv", kind), T.StructField("part", T.IntegerType()), T.StructField("block", T.LongType())])
    blocks = flagged.groupBy("conv", "part", "block").applyInArrow(_weigh_block, T.StructType([*keys, *T.StructType.fromDDL(tallies), T.StructField("weights", T.ArrayType(T.BinaryType()))]))
    chosen = stored(blocks.groupBy("conv").applyInArrow(_choose, T.StructType([*keys, *[T.StructField(c, T.LongType()) for c in (*FOUND, "cost")], T.StructField("entry", T.IntegerType()), T.StructField("slots", T.ArrayType(T.StringType()))])), "repairs")
    # a block's choice, then its rows, then the next block's: what is sequential streams through a task
    null = lambda df, cs, like: [F.lit(None).cast(like.schema[c].dataType).alias(c) for c in cs]
    extra = [*FOUND, "cost", "entry", "slots"]
    heads = chosen.select("conv", "part", "block", F.lit(-1).alias("no"), *extra, *null(chosen, ["role", "text"], rest))
    lines = rest.select("conv", "part", "block", "no", *null(rest, extra, chosen), "role", "text")
    # few such conversations have more than one block, so a hash of the name spreads them; the sort spills
    return heads.unionByName(lines).repartition("conv").sortWithinPartitions("conv", "part", "block", "no").mapInArrow(_digest, settled)


def _weigh_block(table: pa.Table) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["no"])
    tally = _Tally()
    for r in rows:
        tally.add(r["turn"], r["initial"], r["blank"], r["duplicate"], r["cut"])
    kinds = [(r["initial"] if r["initial"] in AFTER else "", r["blank"] or r["duplicate"], r["cut"]) for r in rows]
    size = 9 + SLOT * len(kinds) // 8
    cells = [None if w is None else w.to_bytes(size, "big") for line in weights(kinds, range(4), tail=False) for w in line]
    one = {k: [rows[0][k]] for k in ("conv", "part", "block")} | {k: [getattr(tally, k)] for k in ("first_turn", "last_turn", "first_initial", "last_initial", "turns", "rows", "blank", "duplicate", "truncated", "illegal")} | {"weights": [cells]}
    types = [table.schema.field("conv").type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.binary())]
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(one.items(), types)})


def _choose(table: pa.Table) -> pa.Table:
    """The entry state and the letters of each block on the least walk over all of them.

    Walks so far differ in cost and, at equal cost, in the order of their letters; that order is all that is carried on, so
    the integers stay as long as a block.
    """
    table = table.take(pc.sort_indices(table, sort_keys=[("part", "ascending"), ("block", "ascending")]))
    tally = _Tally()
    at: list[tuple[int, int] | None] = [(0, 0), None, None, None]  # cost and rank among the walks
    back: list[list[int]] = []
    n_rows = table.column("rows").to_pylist()
    heads = table.drop_columns(["weights"]).to_pylist()
    cells = table.column("weights")

    def cell(k: int, a: int, b: int) -> tuple[int, int] | None:
        raw = cells[k][4 * a + b].as_py()
        if raw is None:
            return None
        width = SLOT * n_rows[k]
        w = int.from_bytes(raw, "big")
        return w >> width, w & ((1 << width) - 1)

    for k, head in enumerate(heads):
        tally.extend(SimpleNamespace(**head))
        best: list[tuple | None] = [None] * 4
        for a in range(4):
            if at[a] is not None:
                for b in range(4):
                    if (c := cell(k, a, b)) is not None:
                        walk = (at[a][0] + c[0], at[a][1], c[1], a)
                        if best[b] is None or walk[:3] < best[b][:3]:
                            best[b] = walk
        order = sorted({w[1:3] for w in best if w is not None})
        at = [None if w is None else (w[0], order.index(w[1:3])) for w in best]
        back.append([-1 if w is None else w[3] for w in best])
    ends = [(w[0] + paid, w[1], letters, s, tail) for s, paid, letters, tail in ((START, 0, 0, ""), (ASSISTANT, 0, 0, ""), (USER, INSERT, LETTERS["I"], "I")) if (w := at[s]) is not None]
    cost, _, _, state, tail = min(ends)
    entry, slots = [0] * len(heads), [None] * len(heads)
    for k in range(len(heads) - 1, -1, -1):
        entry[k] = back[k][state]
        _, low = cell(k, entry[k], state)
        slots[k] = read_weight(low, n_rows[k], tail=False)[1][:-1] + ([tail] if k == len(heads) - 1 else [])
        state = entry[k]
    found = tally.found()
    base = [table.column(c).combine_chunks() for c in ("conv", "part", "block")]
    same = [pa.array([v] * len(heads), pa.int64()) for v in (*found, cost)]
    return pa.Table.from_arrays([*base, *same, pa.array(entry, pa.int32()), pa.array(slots, pa.list_(pa.string()))], names=["conv", "part", "block", *FOUND, "cost", "entry", "slots"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", *FOUND, "cost", "audit", "repaired_sha256"]
    kind = None
    now: dict | None = None

    def finished(x: dict) -> pa.RecordBatch:
        types = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        values = [x["conv"], *x["counts"], "".join(x["audit"]), x["sha"].hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)

    def said(x: dict, rows: list[tuple[str, str]]) -> None:
        for r, t in rows:
            x["sha"].update((("\n" if x["any"] else "") + f"{r}:{t}").encode())
            x["any"] = True

    def end_block(x: dict) -> None:
        if len(x["slots"]) > x["rows"]:  # the tail
            said(x, repaired([], x["slots"][x["rows"] :], x["state"])[0])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for row in batch.to_pylist():
            if row["no"] == -1:
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        end_block(now)
                        yield finished(now)
                    now = {"conv": row["conv"], "counts": [row[c] for c in (*FOUND, "cost")], "audit": [], "sha": hashlib.sha256(), "any": False}
                now |= {"slots": row["slots"], "state": row["entry"], "rows": 0}
                now["audit"].append("".join(row["slots"]))
            else:
                rows, now["state"] = repaired([(row["role"], row["text"])], [now["slots"][now["rows"]]], now["state"])
                said(now, rows)
                now["rows"] += 1
    if now is not None:
        end_block(now)
        yield finished(now)
