"""Repair of the structure of conversations: the cheapest edits after which roles alternate.

A conversation's rows, in the order of their turns (null turns first, equal turns by
role and text), are layers of a graph whose states say what was put out last:
nothing, a system text, a user's, an assistant's.  Arcs keep, delete or rerole a row,
or insert a turn without text.  Least costs from the start and least costs to the end
tell which arcs lie on a cheapest way; a walk over these arcs alone, from the set of
states reached so far, takes the least letter at each step.  A letter leads from one
state to one state, so the set stays a single state here.

A conversation may hold any share of the rows.  Rows are sorted over the whole table
and cut into blocks, so a long conversation is many blocks in many tasks.  A block is
summed up by its least costs between the states at its two ends; a scan of these
small matrices gives each block the costs at its ends, a second one the state that
it begins with, and then each block is walked on its own.  Conversations within one
block, nearly all, are done where they are found.

Null texts and roles count as one space.  Null ids are one conversation.  Equal rows
are told apart by ``uid``; the first of them is no duplicate.  Ids without rows
(``absent``) have zeros, an empty audit and the digest of nothing.  An empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import IN_ROWS, OUT_ROWS, arrow_batches, rows_of, table, to_batch

#: Rows and characters in one block.
BLOCK_ROWS, BLOCK_CHARS = 4096, 4_000_000
#: Blocks in one Arrow batch.
BATCH = 16
KEEP, REROLE, INSERT, DELETE, TRUNCATED = 0, 2, 2, 3, 1
#: What was put out last.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
NEVER = 1 << 60
#: Where an inserted or reroled turn leads: a user's turn opens a pair, an assistant's closes it.
NEXT = {NOTHING: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
OWN = {"s": ((NOTHING, SYSTEM),), "u": ((NOTHING, USER), (SYSTEM, USER), (ASSISTANT, USER)), "a": ((USER, ASSISTANT),)}
#: Least costs from each state to an allowed end, when no row is left.
ENDS = [0, 2 * INSERT, INSERT, 0]
ROLES = {USER: "user", ASSISTANT: "assistant"}
_DARK = re.compile(r"[^\x20\x09-\x0D]")
_LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")
BLANK, DUPLICATE, CUT_OFF, SOUND = range(4)


def fault(text: str, seen: bool) -> int:
    """The row's first fault."""
    if not _DARK.search(text):
        return BLANK
    if seen:
        return DUPLICATE
    return SOUND if _LAST.search(text)[1] in ".!?" else CUT_OFF


def _arcs(initial: str, kind: int) -> list[tuple[str, int, int, int]]:
    """(letter, from, to, cost) over a row; blank and duplicate rows can only go."""
    arcs = [("D", s, s, DELETE) for s in STATES]
    if kind in (SOUND, CUT_OFF):
        more = TRUNCATED if kind == CUT_OFF else 0
        arcs += [("K", u, v, KEEP + more) for u, v in OWN.get(initial, ())]
        arcs += [("R", u, v, REROLE + more) for u, v in NEXT.items()]
    return arcs


ARCS = {(i, k): _arcs(i, k) for i in "sua?" for k in range(4)}


def arcs_of(role: str, kind: int) -> list[tuple[str, int, int, int]]:
    return ARCS[role[:1] if role[:1] in OWN else "?", kind]


def inserted(costs: list[int]) -> list[int]:
    """Least costs when turns may be inserted now."""
    nothing, system, user, assistant = costs
    user = min(user, min(nothing, system, assistant) + INSERT)
    return [nothing, system, user, min(assistant, user + INSERT)]


def forward(rows: list[list], costs: list[int]) -> tuple[list[list[int]], list[int]]:
    """Least costs before each row, with what is inserted there; and after the last row."""
    layers = []
    for arcs in rows:
        layers.append(costs := inserted(costs))
        now = [NEVER] * 4
        for _, u, v, w in arcs:
            if costs[u] + w < now[v]:
                now[v] = costs[u] + w
        costs = now
    return layers, costs


def backward(rows: list[list], costs: list[int]) -> list[list[int]]:
    """Least costs to the end from before each row, and from after the last one (``costs``)."""
    layers = [costs]
    for arcs in reversed(rows):
        now = [NEVER] * 4
        for _, u, v, w in arcs:
            if w + costs[v] < now[u]:
                now[u] = w + costs[v]
        nothing, system, user, assistant = now
        user = min(user, assistant + INSERT)
        costs = [min(nothing, user + INSERT), min(system, user + INSERT), user, min(assistant, user + INSERT)]
        layers.append(costs)
    return layers[::-1]


def matrix(rows: list[list]) -> list[list[int]]:
    """Least costs from each state at the beginning of a block to each state at its end."""
    return [forward(rows, [0 if s == t else NEVER for t in STATES])[1] for s in STATES]


def walk(rows: list[list], ahead: list[list[int]], behind: list[list[int]], total: int, state: int, last: bool) -> tuple[list[tuple[str, int]], int]:
    """The least letters over arcs that lie on a cheapest way, with the states they lead to; the state after the block."""
    out, frontier, at = [], {state}, 0
    while True:
        tight: dict[str, set[int]] = {}
        for s in frontier:
            if at < len(rows) or last:
                so_far = ahead[at][s]
                if so_far + INSERT + behind[at][NEXT[s]] == total:
                    tight.setdefault("I", set()).add(NEXT[s])
                for letter, u, v, w in rows[at] if at < len(rows) else ():
                    if u == s and so_far + w + behind[at + 1][v] == total:
                        tight.setdefault(letter, set()).add(v)
        if not tight:
            return out, min(frontier)
        letter = min(tight)
        frontier, at = tight[letter], at + (letter != "I")
        out.append((letter, min(frontier)))


def repaired(steps: list[tuple[str, int]], rows: list[tuple[str, str]]) -> list[str]:
    """The lines ``role:text`` after the edits."""
    out, at = [], 0
    for letter, state in steps:
        if letter == "I":
            out.append(f"{ROLES[state]}:")
            continue
        role, text = rows[at]
        at += 1
        if letter != "D":
            out.append(f"{role if letter == 'K' else ROLES[state]}:{text}")
    return out


def _solved(rows: list[list], costs: list[int], ends: list[int]) -> tuple[list[list[int]], list[list[int]], int]:
    """Forward and backward layers of a block, and the least cost of the whole conversation."""
    ahead, after = forward(rows, costs)
    behind = backward(rows, ends)
    return [*ahead, inserted(after)], behind, min(a + b for a, b in zip(costs, behind[0]))


def repair(turns: DataFrame, absent: DataFrame | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each conversation of ``conv_id, turn, role, text``, and for each id of ``absent``.

    ``conv_id``, ``gaps`` (turn numbers that are missing), ``blank``, ``duplicate``, ``truncated``
    (rows by their first fault), ``illegal`` (neighbours whose roles can't follow one another),
    ``cost`` and ``audit`` (the cheapest edits), ``repaired_sha256`` (the repaired turns).
    """
    spark, kind = turns.sparkSession, turns.schema["conv_id"].dataType
    own = turns.select(
        "conv_id", F.col("turn").try_cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), F.lit(True).alias("there"),
    )
    if absent is not None:
        marks = [F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(False).alias("there")]
        own = own.unionByName(absent.select("conv_id", *marks))
    digest = F.sha2(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("\1")), F.length("role").cast("string"), "role", "text"), 256)
    # Stored, so that a row's uid is the same wherever it is read again.
    rows = table(own.select("*", F.when(F.col("there"), digest).alias("digest"), F.monotonically_increasing_id().alias("uid")), "repair-rows")
    first = rows.where("there").groupBy("digest").agg(F.min(F.struct("turn", "uid")).alias("first"), F.count("*").alias("n"))
    first = table(first.where("n > 1").select("digest", F.col("first.uid").alias("first")), "repair-repeats")
    flagged = rows.join(first, "digest", "left").withColumn("seen", F.coalesce(F.col("first") != F.col("uid"), F.lit(False)))
    order = [F.col(n).asc_nulls_first() for n in ("conv_id", "turn", "role", "text", "uid")]
    run = flagged.select("conv_id", "turn", "role", "text", "there", "seen", "uid").repartitionByRange(*order).sortWithinPartitions(*order)
    field = lambda n, k: T.StructField(n, k)
    strings, longs = T.ArrayType(T.StringType()), T.ArrayType(T.LongType())
    counts = [field(n, T.LongType()) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    done = T.StructType([field("conv_id", kind), *counts, field("audit", T.StringType()), field("repaired_sha256", T.StringType())])
    blocks_schema = T.StructType(
        [*done, field("block", T.LongType()), field("whole", T.BooleanType()), field("roles", strings), field("texts", strings), field("kinds", T.BinaryType()),
         field("matrix", longs), field("ends", strings), field("turns", longs)]
    )
    with arrow_batches(spark, IN_ROWS):
        blocks = table(run.mapInArrow(_cutter(blocks_schema, block_rows), blocks_schema), "repair-blocks")
    whole, parts = blocks.where("whole").select(done.names), blocks.where("not whole")
    # Only these small summaries of a long conversation's blocks meet in one task.
    scan_schema = T.StructType([field("block", T.LongType()), field("costs", longs), field("to_end", longs), field("last", T.BooleanType()), *counts])
    columns = ["conv_id", "block", "matrix", "ends", "turns", "blank", "duplicate", "truncated", "illegal"]
    scanned = table(parts.select(columns).groupBy("conv_id").applyInArrow(_scanner(scan_schema), scan_schema), "repair-scan")
    with arrow_batches(spark, BATCH):
        joined = parts.select("conv_id", "block", "roles", "texts", "kinds").join(scanned.drop(*[c.name for c in counts]), "block")
        map_schema = T.StructType([field("conv_id", kind), field("block", T.LongType()), field("leads", longs)])
        leads = joined.drop("texts").mapInArrow(_leader(map_schema), map_schema)
        state_schema = T.StructType([field("block", T.LongType()), field("state", T.LongType())])
        states = table(leads.groupBy("conv_id").applyInArrow(_chainer(state_schema), state_schema), "repair-states")
        part_schema = T.StructType([field("conv_id", kind), field("block", T.LongType()), field("audit", T.StringType()), field("lines", T.LongType()), field("body", T.BinaryType())])
        written = table(joined.join(states, "block").mapInArrow(_walker(part_schema), part_schema), "repair-parts")
        ordered = written.join(scanned.select("block", *(c.name for c in counts)), "block").repartition("conv_id").sortWithinPartitions("conv_id", "block")
        joined_up = table(ordered.mapInArrow(_joiner(done), done), "repair-joined")
    return whole.unionByName(joined_up)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _batched(rows: Iterator[tuple], schema: T.StructType, size: int = OUT_ROWS, is_large=lambda row: False) -> Iterator[pa.RecordBatch]:
    arrow, held = _arrow(schema), []
    for row in rows:
        held.append(row)
        if len(held) >= size or is_large(row):
            yield to_batch(held, arrow)
            held = []
    if held:
        yield to_batch(held, arrow)


def gaps_of(turns: list[int], distinct: int) -> int:
    return max(turns) - min(turns) + 1 - distinct if turns else 0


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def _cutter(schema: T.StructType, block_rows: int):
    """Sorted rows to blocks of one conversation each; a conversation that is in one block is solved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32

        def blocks() -> Iterator[tuple]:
            n_blocks, conv, held, chars, alone = 0, None, [], 0, False
            for row in rows_of(batches):
                is_new = n_blocks == 0 and not held or row[0] != conv
                if is_new or len(held) >= block_rows or chars >= BLOCK_CHARS:
                    if held:
                        # Whole: begun here after another conversation, ended here before another one.
                        yield block(base + n_blocks, conv, held, alone and is_new)
                        n_blocks += 1
                    alone = is_new and n_blocks > 0
                    conv, held, chars = row[0], [], 0
                held.append(row)
                chars += len(row[3])
            if held:
                yield block(base + n_blocks, conv, held, False)

        def block(number: int, conv, held: list[tuple], whole: bool) -> tuple:
            rows = [r for r in held if r[4]]
            kinds = [fault(r[3], r[5]) for r in rows]
            arcs = [arcs_of(r[2], k) for r, k in zip(rows, kinds)]
            initials = [r[2][:1] for r in rows]
            turns = [r[1] for r in rows if r[1] is not None]
            distinct = len(set(turns))
            illegal = sum(map(_illegal, initials, initials[1:]))
            counts = [kinds.count(k) for k in (BLANK, DUPLICATE, CUT_OFF)]
            if whole:
                ahead, behind, total = _solved(arcs, [0, NEVER, NEVER, NEVER], ENDS)
                steps, _ = walk(arcs, ahead, behind, total, NOTHING, True)
                lines = "\n".join(repaired(steps, [(r[2], r[3]) for r in rows]))
                found = (gaps_of(turns, distinct), *counts, illegal, total, "".join(s[0] for s in steps), hashlib.sha256(lines.encode()).hexdigest())
                return (conv, *found, number, True, *[None] * 6)
            costs = [c for line in matrix(arcs) for c in line]
            # Turns of a block: first, last, how many there are.
            own = (costs, initials[:1] + initials[-1:], [turns[0], turns[-1], distinct] if turns else [])
            return (conv, None, *counts, illegal, None, None, None, number, False, [r[2] for r in rows], [r[3] for r in rows], bytes(kinds), *own)

        whole = schema.names.index("whole")
        yield from _batched(blocks(), schema, is_large=lambda row: not row[whole])

    return run


def _scanner(schema: T.StructType):
    """A conversation's blocks in order: least costs at both ends of each, and what its blocks count together."""

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(group.select(["block", "matrix", "ends", "turns", "blank", "duplicate", "truncated", "illegal"]).to_pylist(), key=lambda r: r["block"])
        moves = [[r["matrix"][4 * s : 4 * s + 4] for s in STATES] for r in rows]
        ahead = [[0, NEVER, NEVER, NEVER]]
        for m in moves:
            ahead.append([min(min(ahead[-1][s] + m[s][t] for s in STATES), NEVER) for t in STATES])
        behind = [ENDS]
        for m in reversed(moves):
            behind.append([min(min(m[s][t] + behind[-1][t] for t in STATES), NEVER) for s in STATES])
        behind.reverse()
        sums = [sum(r[n] for r in rows) for n in ("blank", "duplicate", "truncated", "illegal")]
        last_role, last_turn, turns, distinct = "", None, [], 0
        for r in rows:
            if r["ends"]:
                sums[3] += bool(last_role) and _illegal(last_role[1:], r["ends"][0])
                last_role = f"-{r['ends'][-1]}"
            if r["turns"]:
                a, b, n = r["turns"]
                distinct += n - (a == last_turn)
                turns, last_turn = [turns[0] if turns else a, b], b
        total = [gaps_of(turns, distinct), *sums, behind[0][NOTHING]]
        out = [(r["block"], ahead[k], behind[k + 1], k == len(rows) - 1, *total) for k, r in enumerate(rows)]
        return pa.Table.from_batches([to_batch(out, _arrow(schema))])

    return run


def _leader(schema: T.StructType):
    """For each state that a block may begin with: the state after it (-1: no cheapest way begins there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    arcs = [arcs_of(role, k) for role, k in zip(r["roles"], r["kinds"])]
                    ahead, behind, total = _solved(arcs, r["costs"], r["to_end"])
                    leads = [walk(arcs, ahead, behind, total, s, r["last"])[1] if r["costs"][s] + behind[0][s] == total else -1 for s in STATES]
                    yield r["conv_id"], r["block"], leads

        yield from _batched(found(), schema)

    return run


def _chainer(schema: T.StructType):
    """The state that each block of a conversation begins with."""

    def run(group: pa.Table) -> pa.Table:
        state, out = NOTHING, []
        for r in sorted(group.select(["block", "leads"]).to_pylist(), key=lambda r: r["block"]):
            out.append((r["block"], state))
            state = r["leads"][state]
        return pa.Table.from_batches([to_batch(out, _arrow(schema))])

    return run


def _walker(schema: T.StructType):
    """A block's own part of the audit and of the repaired turns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    arcs = [arcs_of(role, k) for role, k in zip(r["roles"], r["kinds"])]
                    ahead, behind, total = _solved(arcs, r["costs"], r["to_end"])
                    steps, _ = walk(arcs, ahead, behind, total, r["state"], r["last"])
                    lines = repaired(steps, list(zip(r["roles"], r["texts"])))
                    yield r["conv_id"], r["block"], "".join(s[0] for s in steps), len(lines), "\n".join(lines).encode()

        yield from _batched(parts(), schema, BATCH)

    return run


def _joiner(schema: T.StructType):
    """Parts in order, one conversation after the other: texts pass through the digest and are not held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def conversations() -> Iterator[tuple]:
            now, audit, digest, lines = None, [], None, 0
            for batch in batches:
                for r in batch.to_pylist():
                    if now is None or r["conv_id"] != now[0]:
                        if now is not None:
                            yield (*now, "".join(audit), digest.hexdigest())
                        now = tuple(r[n] for n in schema.names[:-2])
                        audit, digest, lines = [], hashlib.sha256(), 0
                    audit.append(r["audit"])
                    digest.update(b"\n" * bool(lines and r["lines"]) + r["body"])
                    lines += r["lines"]
            if now is not None:
                yield (*now, "".join(audit), digest.hexdigest())

        yield from _batched(conversations(), schema)

    return run
