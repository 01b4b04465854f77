"""Repair of the structure of conversations by a DP over a trie of role and fault signatures.

1. Rows get their first fault: blank, duplicate (role and text seen earlier in the conversation) or
   truncated. Each row becomes a letter: ``d`` where it has to go, else its role (s, u, a, or x for any
   other), upper case when truncated.
2. Rows are sorted by conversation and turn over ranges, which may cut a conversation, and run together
   into pieces of at most ``PIECE_ROWS`` rows or ``PIECE_BYTES`` bytes of text. The letters of a piece
   are its signature.
3. Distinct signatures, sorted, are a depth-first walk of their trie. A layer holds, for each state of
   the output at the start of a piece and each state reached, the cheapest edits; layers of a shared
   prefix are made once, and a signature that ends gives the layer of its node. Only the layers from
   the root to the present node are held.
4. The pieces of a conversation are put together in order by their layers, which gives the cheapest
   edits of the whole; each piece then applies its part to its rows, and the repaired texts are hashed
   as a stream.

States: nothing yet, after a system row, after a user row, after an assistant row. Good roles are
``(s?(ua)+)?`` by initials. Edits: Keep 0; Rerole to user or assistant 2; Delete 3 (the only way for
blank and duplicate rows); Insert an empty user or assistant row 2; a truncated row that stays adds 1.
Among equal costs the edits' initials are least in ASCII order.

Cases: a null role or text is one space (blank); a null turn comes first; a null conv_id is a
conversation of its own; rows of one turn are ordered by role, then by the SHA-256 of their text;
repeated rows are duplicates; a conversation without rows gives zeros, no edits and no text; a
conversation of any length is cut, only its edits and the hashing of its texts, which is sequential,
are not (the texts pass as a stream); an empty table gives an empty table; other columns are not
looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import forget, saved

PIECE_ROWS, PIECE_BYTES = 512, 1 << 20
#: Rows handed on at once, and letters of text at most (or one row).
BATCH, BATCH_LETTERS = 256, 8 << 20

_BLANKS = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial) -> state, for rows that keep their role.
_KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The state after a row made user or assistant, whichever fits.
_NEXT = (USER, USER, ASSISTANT, USER)

# (cost, edits) by state, None where no edits lead to it
Layer = tuple[tuple[int, str] | None, ...]


def inserted(layer: Layer) -> Layer:
    """A layer with inserted rows behind it."""
    out = list(layer)
    for _ in range(3):
        for state in range(4):
            if out[state]:
                cost, edits = out[state]
                new, to = (cost + 2, edits + "I"), _NEXT[state]
                if out[to] is None or new < out[to]:
                    out[to] = new
    return tuple(out)


def stepped(layer: Layer, letter: str) -> Layer:
    """The layer after one more row."""
    out: list[tuple[int, str] | None] = [None] * 4

    def offer(state: int, cost: int, edits: str) -> None:
        if out[state] is None or (cost, edits) < out[state]:
            out[state] = (cost, edits)

    cut, initial = int(letter.isupper()), letter.lower()
    for state, reached in enumerate(layer):
        if reached is None:
            continue
        cost, edits = reached
        offer(state, cost + 3, edits + "D")
        if letter != "d":
            kept = _KEEP.get((state, initial))
            if kept is not None:
                offer(kept, cost + cut, edits + "K")
            offer(_NEXT[state], cost + cut + 2, edits + "R")
    return inserted(tuple(out))


def trie_walk(signatures: Iterator[str]) -> Iterator[tuple[str, list[Layer]]]:
    """Sorted signatures with the layers, by entry state, of their nodes in the trie."""
    path = [[tuple((0, "") if q == e else None for q in range(4)) for e in range(4)]]
    before = ""
    for signature in signatures:
        shared = 0
        for x, y in zip(before, signature, strict=False):
            if x != y:
                break
            shared += 1
        del path[shared + 1 :]
        for letter in signature[shared:]:
            path.append([stepped(layer, letter) for layer in path[-1]])
        before = signature
        yield signature, path[-1]


def _batches(rows: Iterator[tuple], schema: pa.Schema, letters: Callable[[tuple], int] = lambda _: 0) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += letters(row)
        if len(held) == BATCH or size > BATCH_LETTERS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch], step: int = BATCH) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, step).columns), strict=True)


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage of the contract, by crc32 of ``conv_id:turn`` mod 20: 0
    drops a row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls in
    the key, the role and the text are one space."""
    space = lambda c: F.coalesce(conversations[c].cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role = F.when(fate == 4, F.lit("user")).otherwise(space("role"))
    text = F.when(fate == 1, F.lit("")).when(fate == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    times = F.when(fate == 0, F.lit(0)).when(fate == 3, F.lit(2)).otherwise(F.lit(1))
    return conversations.select(conversations["conv_id"], conversations["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).drop("copy")


def _pieces(rows: DataFrame, conv: str) -> DataFrame:
    """Sorted rows, run together: conv_id, part, seq, signature, roles, texts and what the report needs."""
    from pyspark import TaskContext

    kind = {"long": pa.int64(), "string": pa.string()}
    names = "part seq signature roles texts rows blank duplicate truncated illegal first last turns first_turn last_turn".split()
    types = ["long", "long", "string", "array<string>", "array<string>", "long", "long", "long", "long", "long", "string", "string", "long", "long", "long"]
    form = lambda t: pa.list_(pa.string()) if t == "array<string>" else kind[t]

    def run(batches):
        part, first_schema = TaskContext.get().partitionId(), None

        def made(all_batches):
            now, size, seq, key, started = [], 0, 0, None, False
            for row in _rows(all_batches, 16):
                if started and (row[0] != key or len(now) >= PIECE_ROWS or size >= PIECE_BYTES):
                    yield piece(key, seq, now)
                    now, size, seq = [], 0, seq + 1
                key, started = row[0], True
                now.append(row)
                size += len(row[3])
            if started:
                yield piece(key, seq, now)

        def piece(key, seq, now):
            faults, initials = [r[4] for r in now], [r[2][:1] for r in now]
            letters = []
            for fault, initial in zip(faults, initials, strict=True):
                letter = initial if initial in ("s", "u", "a") else "x"
                letters.append("d" if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
            turns = [r[1] for r in now if r[1] is not None]
            illegal = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
            counts = [sum(f == kind_ for f in faults) for kind_ in ("blank", "duplicate", "truncated")]
            return (key, part, seq, "".join(letters), [r[2] for r in now], [r[3] for r in now], len(now), *counts, illegal, initials[0], initials[-1], len(set(turns)), min(turns, default=None), max(turns, default=None))

        batches = iter(batches)
        for batch in batches:
            first_schema = pa.schema([batch.schema.field(0), *(pa.field(n, form(t)) for n, t in zip(names, types, strict=True))])
            yield from _batches(made(_chain(batch, batches)), first_schema, lambda row: sum(map(len, row[5])))

    schema = f"{conv} {rows.schema[conv].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return rows.mapInArrow(run, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def _joined(layer: Layer, steps: list[Layer]) -> Layer:
    """A layer after a piece with these layers by entry state."""
    out: list[tuple[int, str] | None] = [None] * 4
    for state, reached in enumerate(layer):
        if reached:
            for to, more in enumerate(steps[state]):
                if more:
                    new = (reached[0] + more[0], reached[1] + more[1])
                    if out[to] is None or new < out[to]:
                        out[to] = new
    return tuple(out)


def _report(pieces: DataFrame, conv: str) -> DataFrame:
    """Pieces of each conversation in order, with their layers, put together: a row for each piece with its
    part of the edits and the state it starts in; the last row of a conversation has its report."""
    names = ["part", "seq", "state", "part_edits", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    types = ["long", "long", "long", "string", "long", "long", "long", "long", "long", "long", "string"]

    def after(layer, r):
        flat = [(c, a) if c is not None else None for c, a in zip(r[3], r[4], strict=True)]
        return _joined(layer, [tuple(flat[4 * e : 4 * e + 4]) for e in range(4)])

    def whole(key, now, layer):
        cost, audit = min(x for x in (layer[NOTHING], layer[ASSISTANT]) if x)
        totals = [sum(r[i] for r in now) for i in (6, 7, 8)]
        illegal = sum(r[9] for r in now) + sum(x[11] + y[10] not in ("su", "ua", "au") for x, y in zip(now, now[1:], strict=False))
        turned = [r for r in now if r[12]]
        # a turn that ends a piece and starts the next counts once
        distinct = sum(r[12] for r in turned) - sum(x[14] == y[13] for x, y in zip(turned, turned[1:], strict=False))
        gaps = turned[-1][14] - turned[0][13] + 1 - distinct if turned else 0
        at, state = 0, NOTHING
        for i, r in enumerate(now):
            begin, entry, left = at, state, r[5]
            while at < len(audit) and (left or i == len(now) - 1):
                left -= audit[at] != "I"
                at += 1
            for n, edit in enumerate(audit[begin:at]):
                if edit == "K" and state == NOTHING:
                    # the row that is kept is the one after the rows dealt with so far
                    initial = r[15][sum(e != "I" for e in audit[begin : begin + n])]
                    state = SYSTEM if initial.lower() == "s" else USER
                elif edit != "D":
                    state = _NEXT[state]
            last = i == len(now) - 1
            yield (key, r[1], r[2], entry, audit[begin:at], *((gaps, *totals, illegal, cost, audit) if last else (None,) * 7))

    def run(batches):
        def made(all_batches):
            start: Layer = inserted(((0, ""), None, None, None))
            now, key, layer = [], None, start
            for row in _rows(all_batches):
                if now and row[0] != key:
                    yield from whole(key, now, layer)
                    now, layer = [], start
                key, layer = row[0], after(layer, row)
                # what stays of a piece is its signature and counts, not its layers
                now.append((*row[:3], None, None, *row[5:]))
            if now:
                yield from whole(key, now, layer)

        batches = iter(batches)
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), *(pa.field(n, pa.int64() if t == "long" else pa.string()) for n, t in zip(names, types, strict=True))])
            yield from _batches(made(_chain(batch, batches)), schema)

    chosen = pieces.select(conv, "part", "seq", "costs", "edits", "rows", "blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "first_turn", "last_turn", "signature")
    schema = f"{conv} {pieces.schema[conv].dataType.simpleString()}, " + ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True))
    return chosen.repartition(conv).sortWithinPartitions(conv, "part", "seq").mapInArrow(run, schema)


def repaired_rows(roles: list[str], texts: list[str], edits: str, state: int) -> list[tuple[str, str]]:
    """Role and text of the rows that edits leave, from a state on."""
    out, at = [], 0
    for edit in edits:
        role, text = (roles[at], texts[at]) if edit != "I" else ("", "")
        at += edit != "I"
        if edit == "D":
            continue
        if edit == "K":
            state = _KEEP[state, role[:1]]
        else:
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        out.append((role, text))
    return out


def _hashed(pieces: DataFrame, conv: str) -> DataFrame:
    """conv_id and the SHA-256 of the repaired rows, each piece taken up in order."""
    applied = pieces.select(conv, "part", "seq", "roles", "texts", "part_edits", "state")

    def apply(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8):
                part = batch.slice(at, 8)
                columns = [part.column(i).to_pylist() for i in (3, 4, 5, 6)]
                lines = [[f"{r}:{t}" for r, t in repaired_rows(*row)] for row in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(["\n".join(x) if x else None for x in lines], pa.string())], names=[*part.schema.names[:3], "body"])

    def digest(batches):
        def made(all_batches):
            key, started, state, any_ = None, False, hashlib.sha256(), False
            for row in _rows(all_batches, 8):
                if started and row[0] != key:
                    yield key, state.hexdigest()
                    state, any_ = hashlib.sha256(), False
                key, started = row[0], True
                if row[3] is not None:
                    state.update((b"\n" if any_ else b"") + row[3].encode("utf-8", "surrogatepass"))
                    any_ = True
            if started:
                yield key, state.hexdigest()

        batches = iter(batches)
        for batch in batches:
            yield from _batches(made(_chain(batch, batches)), pa.schema([batch.schema.field(0), pa.field("repaired_sha256", pa.string())]))

    kind = pieces.schema[conv].dataType.simpleString()
    bodies = applied.mapInArrow(apply, f"{conv} {kind}, part long, seq long, body string")
    return bodies.repartition(conv).sortWithinPartitions(conv, "part", "seq").mapInArrow(digest, f"{conv} {kind}, repaired_sha256 string")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, row) with the SHA-256 of the text and their first fault, or null."""
    ends = F.rtrim("text", F.lit(_BLANKS))
    rows = rows.withColumns({"sha": F.sha2("text", 256), "__end": F.right(ends, F.lit(1))})
    # first row of each role and text that a conversation holds twice
    first = rows.groupBy("conv_id", "role", "sha").agg(F.min(F.struct("turn", "row")).alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    first = first.select(F.col("conv_id").alias("__conv"), F.col("role").alias("__role"), F.col("sha").alias("__sha"), F.col("__first.row").alias("__first"))
    joined = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("role") == F.col("__role")) & (F.col("sha") == F.col("__sha")), "left")
    fault: Column = F.when(F.col("__end") == "", "blank").when(F.col("__first").isNotNull() & (F.col("__first") != F.col("row")), "duplicate").when(~F.col("__end").isin(".", "!", "?"), "truncated")
    return joined.select("conv_id", "turn", "role", "text", fault.alias("fault"), "sha", "row")


def repair_conversations(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conv_id of ``conversations``: gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 of its ``rows`` (conv_id, turn, role, text)."""
    space = lambda c: F.coalesce(rows[c].cast("string"), F.lit(" ")).alias(c)
    numbered = saved(rows.select(rows["conv_id"], rows["turn"].cast("long").alias("turn"), space("role"), space("text")).withColumn("row", F.monotonically_increasing_id()), "rows")
    order = ("conv_id", "turn", "role", "sha", "row")
    faults = with_faults(numbered).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = saved(_pieces(faults.select("conv_id", "turn", "role", "text", "fault"), "conv_id"), "pieces")
    forget(numbered)

    def layers(batches):
        def made():
            for signature, by_entry in trie_walk(r[0] for r in _rows(batches)):
                flat = [x for layer in by_entry for x in layer]
                yield signature, [x and x[0] for x in flat], [x and x[1] for x in flat]

        yield from _batches(made(), pa.schema([("signature", pa.string()), ("costs", pa.list_(pa.int64())), ("edits", pa.list_(pa.string()))]))

    signatures = pieces.select("signature").distinct().repartitionByRange("signature").sortWithinPartitions("signature")
    known = saved(signatures.mapInArrow(layers, "signature string, costs array<long>, edits array<string>"), "layers")
    report = saved(_report(pieces.drop("roles", "texts").join(known, "signature"), "conv_id"), "report")
    forget(known)
    hashed = _hashed(pieces.select("conv_id", "part", "seq", "roles", "texts").join(report.select("part", "seq", "part_edits", "state"), ["part", "seq"]), "conv_id")
    totals = report.where("audit IS NOT NULL").join(hashed.select(F.col("conv_id").alias("__conv"), "repaired_sha256"), F.col("conv_id").eqNullSafe(F.col("__conv")))
    totals = totals.select(F.col("conv_id").alias("__conv"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    every = conversations.select(conversations["conv_id"]).distinct()
    out = every.join(totals, F.col("conv_id").eqNullSafe(F.col("__conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
