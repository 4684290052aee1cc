"""Conversation structure repair: cheapest edits by the auction algorithm for shortest paths.

Turns are sorted over the cluster by (conversation, turn) and numbered. Each is judged (blank, a
repetition, cut off) and becomes one character; a conversation is brought together as these characters
only, as many as its audit has. Texts stay where they are and meet their edits by number.

The lattice of a conversation has a node for each number of turns read and each state of the roles
written so far: nothing, a system turn, ends in user, ends in assistant. Its arcs are the edits with
their whole costs. Node prices start too low; the path grows along the cheapest arc while the price of
its last node allows that arc, and otherwise raises that price and takes the node back. At the end
prices and path fulfil complementary slackness: the price of the start is the least cost, and all
cheapest paths run over tight arcs only, along which the least edit that leads to the end is traced.

Long conversations are settled in pieces of `PIECE` turns from the last to the first: the auction of a
piece starts at each of its entry nodes and ends at the entry nodes of the next piece, whose prices are
final by then. Work is proportional to the turns, and the settled prices alone are kept.

Defined results: a null role or text is one blank, also where it names a row. Rows of one turn come in
the order of role, then of the SHA-256 of conversation, role and text. A role whose first character is
none of s, u, a, or an empty one, cannot be kept. A null conv_id is a conversation of its own. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabletrust.llm.text import BLANKS
from tabletrust.operators.skew import join_by_key
from tabletrust.session import materialize

#: Costs of the edits, and of leaving a cut-off turn in place.
DELETE, REROLE, INSERT, CUT_OFF = 4, 3, 3, 3
#: Turns whose prices are settled at once, and turns of a conversation packed in one row.
PIECE, PACKED_BITS = 16, 12

_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
#: The state after the one role that may be written next, and that after a kept role.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_KEPT = {"s": {_NOTHING: _SYSTEM}, "u": {s: _USER for s in (_NOTHING, _SYSTEM, _ASSISTANT)},
         "a": {_USER: _ASSISTANT}, "o": {}}
#: One character per turn: initial of the role (o: none that may stay), times what is wrong with it.
INITIALS, FAULTS = "suao", ("sound", "cut off", "must go")
CODES = "ABCDEFGHIJKL"
#: Edits with the roles they give; the audit has their plain initials.
MOVES, AUDIT = "DKUAua", "DKRRII"
_FOLLOWS = {"su", "ua", "au"}

Arc = tuple[str, int, int]


def damaged(chats: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): every row after the damage that its name decides."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    damage = F.crc32(F.concat(name[0], F.lit(":"), name[1])) % 20
    rows = chats.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        damage.alias("damage"), role.alias("role"), text.alias("text"),
    ).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").otherwise(F.col("text"))
    text = F.when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(text)
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("damage") == 3, 2).otherwise(1)
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def in_order(rows: DataFrame) -> DataFrame:
    """`rows` with `mark`, which names conversation, role and text, and their place `pos`.

    Places rise with (conversation, turn) over all partitions, and without gaps inside one.
    """
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    named = F.concat_ws(":", conv, F.char_length("role"), F.concat("role", "text"))
    keys = ["conv_id", "turn", "role", "mark"]
    rows = rows.withColumn("mark", F.sha2(named, 256))
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return materialize(dealt.withColumn("pos", F.monotonically_increasing_id()), "ordered-turns")


def judged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, blank, duplicate, truncated, code) of ordered rows; no texts."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    ends = F.substring(bare, -1, 1).isin(".", "!", "?")
    slim = rows.select(
        "conv_id", "turn", "pos", "mark", F.substring("role", 1, 1).alias("initial"),
        (bare == "").alias("blank"), ends.alias("ends"),
    )
    seen = slim.where("not blank").groupBy("mark").agg(
        F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")
    )
    again = materialize(seen.where("n > 1").select("mark", "first"), "repeated-turns")
    found = join_by_key(slim, again, "mark", "left")
    duplicate = ~F.col("blank") & F.coalesce(F.col("pos") > F.col("first"), F.lit(False))
    found = found.withColumn("duplicate", duplicate)
    found = found.withColumn("truncated", ~(F.col("blank") | F.col("duplicate") | F.col("ends")))
    role = _place("initial")
    fault = F.when(F.col("blank") | F.col("duplicate"), 2).otherwise(F.col("truncated").cast("int"))
    code = F.substring(F.lit(CODES), role * len(FAULTS) + fault + 1, F.lit(1))
    return found.select("conv_id", "turn", "pos", "blank", "duplicate", "truncated", code.alias("code"))


def _place(initial: str) -> Column:
    out = F.lit(len(INITIALS) - 1)
    for k, c in enumerate(INITIALS[:-1]):
        out = F.when(F.col(initial) == c, k).otherwise(out)
    return out


def packed(turns: DataFrame) -> DataFrame:
    """Runs of judged turns of one conversation as strings of codes, with their sums."""
    block = F.shiftright("pos", PACKED_BITS)
    row = F.sort_array(F.collect_list(F.struct("pos", "code", "turn")))
    count = lambda c: F.sum(F.col(c).cast("bigint")).alias(c)
    runs = turns.groupBy("conv_id", block.alias("block")).agg(
        row.alias("rows"), *map(count, ("blank", "duplicate", "truncated")),
        F.min("turn").alias("low"), F.max("turn").alias("high"),
    )
    known = F.filter(F.array_distinct("rows.turn"), lambda t: t.isNotNull())
    return runs.select(
        "conv_id", F.col("rows")[0]["pos"].alias("start"), F.array_join("rows.code", "").alias("codes"),
        "blank", "duplicate", "truncated", "low", "high",
        F.size(known).cast("bigint").alias("n_turns"),
    )


def auction(arcs: list[list[Arc]], price: list[int], origins: range) -> None:
    """Raise `price` until it is the cost of the shortest path from each of `origins` to the end.

    `arcs` has (edit, cost, node) of every open node; nodes beyond them are settled. Prices must not be
    over the cost of any arc plus the price it leads to, and stay so.
    """
    for origin in origins:
        path = [origin]
        while True:
            node = path[-1]
            best, to = min((cost + price[j], j) for _, cost, j in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            elif to >= len(arcs):
                break
            else:
                path.append(to)


def lattice(codes: str, last: bool) -> list[list[Arc]]:
    """The arcs of a piece's nodes, in the order of the edits' initials; node 4 * turns read + state."""
    out: list[list[Arc]] = []
    for i, code in enumerate(codes):
        role, fault = divmod(CODES.index(code), len(FAULTS))
        for state in range(4):
            here, below = 4 * i, 4 * i + 4
            written = _NEXT[state]
            arcs = [("D", DELETE, below + state), ("ua"[written - 2], INSERT, here + written)]
            if fault < 2:
                extra = CUT_OFF * fault
                if (after := _KEPT[INITIALS[role]].get(state)) is not None:
                    arcs.append(("K", extra, below + after))
                arcs.append(("UA"[written - 2], REROLE + extra, below + written))
            out.append(sorted(arcs, key=lambda arc: AUDIT[MOVES.index(arc[0])]))
    if last:
        here = 4 * len(codes)
        for state in range(4):
            arcs = [("ua"[_NEXT[state] - 2], INSERT, here + _NEXT[state])]
            if state in (_NOTHING, _ASSISTANT):
                arcs.append(("", 0, here + 4))
            out.append(arcs)
    return out


@lru_cache(1 << 14)
def settled(codes: str, exits: tuple[int, ...] | None) -> tuple[list[list[Arc]], list[int]]:
    """Arcs and converged prices of a piece; `exits` are the next piece's prices, None at the end."""
    arcs = lattice(codes, exits is None)
    after = [0] if exits is None else list(exits)
    price = [min(after)] * len(arcs) + after
    auction(arcs, price, range(4))
    return arcs, price


def trace(arcs: list[list[Arc]], price: list[int], node: int) -> tuple[str, int]:
    """The least moves along tight arcs from a node to a settled one, and that node's place there."""
    leads: dict[int, bool] = {}

    def tight(i: int) -> Iterator[Arc]:
        return (arc for arc in arcs[i] if price[i] == arc[1] + price[arc[2]])

    def ends(i: int) -> bool:
        if i >= len(arcs):
            return True
        if i not in leads:
            leads[i] = any(ends(j) for _, _, j in tight(i))
        return leads[i]

    moves = []
    while node < len(arcs):
        move, _, node = next(arc for arc in tight(node) if ends(arc[2]))
        moves.append(move)
    return "".join(moves), node - len(arcs)


def repair(codes: str) -> tuple[int, list[str]]:
    """The least cost, and the least moves for each PIECE of turns."""
    starts = range(0, max(1, len(codes)), PIECE)
    exits, known = None, array("q")
    for start in reversed(starts):
        _, price = settled(codes[start : start + PIECE], exits)
        exits = tuple(price[:4])
        known.extend(exits)
    moves, state = [], _NOTHING
    for k, start in enumerate(starts):
        at = 4 * (len(starts) - 2 - k)
        after = tuple(known[at : at + 4]) if at >= 0 else None
        found, state = trace(*settled(codes[start : start + PIECE], after), state)
        moves.append(found)
    return exits[0], moves


def turn_moves(moves: list[str]) -> Iterator[str]:
    """Moves dealt to the turns: insertions go with the next turn, those at the end with the last."""
    held, own = "", None
    for part in moves:
        for move in part:
            held += move
            if move in "DKUA":
                if own is not None:
                    yield own
                own, held = held, ""
    yield (own or "") + held


_SOLVED = (
    "conv_id bigint, start bigint, moves array<string>, gaps bigint, blank bigint, duplicate bigint,"
    " truncated bigint, illegal bigint, cost bigint"
)
_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("start", pa.int64()), ("moves", pa.list_(pa.string()))]
    + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
)


def _solved(runs: list[dict]) -> Iterator[dict]:
    """One row per run; the first also has the conversation's sums."""
    codes = "".join(r["codes"] for r in runs)
    cost, moves = repair(codes)
    initials = codes.translate({ord(c): INITIALS[k // len(FAULTS)] for k, c in enumerate(CODES)})
    known = [r for r in runs if r["low"] is not None]
    gaps = 0
    if known:
        shared = sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        distinct = sum(r["n_turns"] for r in known) - shared
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct
    sums = {c: sum(r[c] for r in runs) for c in ("blank", "duplicate", "truncated")}
    illegal = sum(a + b not in _FOLLOWS for a, b in zip(initials, initials[1:]))
    sums |= {"gaps": gaps, "illegal": illegal, "cost": cost}
    each = turn_moves(moves)
    for r in runs:
        yield {"conv_id": r["conv_id"], "start": r["start"], "moves": [next(each) for _ in r["codes"]]} | sums
        sums = {}


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs come sorted by conversation and place; a conversation may go on in the next batch."""
    held: list[dict] = []
    for batch in batches:
        out = []
        for run in batch.to_pylist():
            if held and run["conv_id"] != held[0]["conv_id"]:
                out.extend(_solved(held))
                held = []
            held.append(run)
        if out:
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)
    if held:
        yield pa.RecordBatch.from_pylist(list(_solved(held)), _SCHEMA)


def solved(runs: DataFrame) -> DataFrame:
    """Moves of every run of packed turns, and the sums of its conversation beside the first."""
    dealt = runs.repartition("conv_id").sortWithinPartitions("conv_id", "start")
    return materialize(dealt.mapInArrow(_solve, _SOLVED), "turn-edits")


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """(conv_id, pos, place, edit, role, text): the turns of every conversation after its repair.

    `place` orders the turns that are inserted around one of `rows`.
    """
    each = edits.select("start", F.posexplode("moves").alias("at", "moves"))
    each = each.select((F.col("start") + F.col("at")).alias("pos"), "moves")
    moves = F.split(F.col("moves"), "")
    found = rows.join(each, "pos").select(
        "conv_id", "pos", "role", "text", F.posexplode(F.filter(moves, lambda m: m != "")).alias("place", "move")
    )
    move = F.col("move")
    inserted = move.isin("u", "a")
    role = F.when(move.isin("u", "U"), "user").when(move.isin("a", "A"), "assistant")
    return found.where(move != "D").select(
        "conv_id", "pos", "place", F.translate("move", MOVES, AUDIT).alias("edit"),
        F.coalesce(role, "role").alias("role"), F.when(inserted, "").otherwise(F.col("text")).alias("text"),
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each conversation, read in order and not held."""
    ids, digests, now, started = [], [], None, False
    for batch in batches:
        for conv_id, line in zip(batch.column("conv_id").to_pylist(), batch.column("line").to_pylist()):
            if not started or conv_id != ids[-1]:
                if started:
                    digests.append(now.hexdigest())
                ids.append(conv_id)
                now, started = hashlib.sha256(line.encode()), True
            else:
                now.update(b"\n" + line.encode())
        if len(ids) > 1:
            done = [pa.array(ids[:-1], pa.int64()), pa.array(digests, pa.string())]
            yield pa.record_batch(done, ["conv_id", "repaired_sha256"])
            ids, digests = ids[-1:], []
    if started:
        done = [pa.array(ids, pa.int64()), pa.array([*digests, now.hexdigest()], pa.string())]
        yield pa.record_batch(done, ["conv_id", "repaired_sha256"])


def report(chats: DataFrame) -> DataFrame:
    """Faults, cost, audit and digest of every conversation of `chats` after damage and repair."""
    rows = in_order(damaged(chats))
    edits = solved(packed(judged(rows)))
    lines = repaired_turns(rows, edits).select(
        "conv_id", "pos", "place", F.concat_ws(":", "role", "text").alias("line")
    )
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "place")
    digests = lines.select("conv_id", "line").mapInArrow(_digest, "conv_id bigint, repaired_sha256 string")
    plain = F.translate(F.array_join("moves", ""), MOVES, AUDIT)
    audits = edits.groupBy("conv_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("start", plain.alias("audit"))))["audit"], "")
        .alias("audit"),
        *(F.max(c).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
    )
    ids = chats.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    # A conversation is in each part at most once; a grouping also matches null ids.
    parts = ids.unionByName(audits, True).unionByName(digests, True)
    sums = [F.coalesce(F.max(c), F.lit(0)).alias(c)
            for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return parts.groupBy("conv_id").agg(
        *sums, F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
