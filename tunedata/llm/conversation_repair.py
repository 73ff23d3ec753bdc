"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

A conversation should be empty, or an optional system turn followed by one or more pairs of a user and an assistant turn.
Edits, in the order of the turns, and what they cost:

=====  ======================================================  ====
D      delete the turn (a must if it is blank or a duplicate)  3
I      insert an empty turn of user or assistant               2
K      keep the turn as it is                                  0
R      give the turn the role user or assistant                2
=====  ======================================================  ====

A truncated turn that isn't deleted costs 1 more.  The *audit* is the text of the edits' letters; of the cheapest
edits the one with the least audit is taken.  What a letter makes follows from the state before it (nothing yet, after
system, user or assistant), so the audit fixes the repaired conversation.

**Search** (``best_edits``): depth-first branch and bound with an explicit stack.  A node is (turns consumed, state); its children are
visited in the order of their letters.

* *Suffix lower bound*: forced deletions and truncations ahead, and at least 2 for every edit still needed: two
  neighbouring turns that don't fit need an edit of either or an insertion between, and an edit of a turn settles
  its two neighbourhoods at most, so a run of r misfits needs ceil(r / 2) edits.
* *Incumbent*: the best (cost, audit) so far, at first from a greedy descent.  A prefix goes if its cost and bound exceed it, or
  equal its cost with a greater audit.
* *Dominance table*: per node the best (cost, audit) that reached it; a worse prefix goes.  That is safe: two prefixes of one node and of equal
  cost differ in a letter (a longer one has more insertions and costs more), so any suffix keeps their order.  Every
  expansion of a node lowers its cost, so the search ends after a number of steps polynomial in the number of turns.

**On the cluster**: turns are range-partitioned and sorted by (conversation, turn), which splits a hot conversation over many tasks.
Runs of ``PIECE`` sorted rows are cut at conversations; a *piece* holds the letters of its turns (role and fault, two
characters a turn, no texts).  A conversation of one piece is solved at once.  The pieces of a longer one are solved in parallel, each
for every state before and after it; the tables of two neighbours make the table of both, in rounds.
So one task sees at most two letters for each turn of a conversation, and a few audits of that length; texts are joined to the
edits by row and never gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunedata.llm.common import WS, fan_out, staged

#: rows of a piece (a power of two), and characters of a text that order turns of equal number and role before their hash
PIECE_BITS, TIE_CHARS = 7, 256
#: solved conversations that a task remembers
KNOWN = 1 << 14
#: states: nothing yet, after system, after user, after assistant; the role that must come, and the state after it
START, SYSTEM, USER, ASSISTANT = range(4)
NEED, AFTER = "uuau", (USER, USER, ASSISTANT, USER)
ROLE = {"u": "user", "a": "assistant"}
FITS = {"su", "ua", "au"}
END_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: states in which a conversation may end
DONE = (START, ASSISTANT)


# ---- search ------------------------------------------------------------------------------------

def _after(state: int, role: str) -> int:
    """State after a kept turn, or -1 if it doesn't fit."""
    if role == NEED[state]:
        return AFTER[state]
    return SYSTEM if role == "s" and state == START else -1


class Bounds:
    """Lower bounds of the cost of a suffix, from one pass backwards."""

    def __init__(self, roles: str, faults: str, exits: tuple):
        n = len(roles)
        self.exits = exits
        self.forced, self.edits, self.run, self.first = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1), [""] * (n + 1)
        for i in range(n - 1, -1, -1):
            self.forced[i], self.edits[i], self.run[i], self.first[i] = self.forced[i + 1], self.edits[i + 1], self.run[i + 1], self.first[i + 1]
            if faults[i] in "bd":
                self.forced[i] += 3
                continue
            self.forced[i] += faults[i] == "t"
            x, y = roles[i], self.first[i + 1]
            fits = x + y in FITS if y else END_STATE.get(x) in exits
            r = self.run[i + 1]
            self.run[i] = 0 if fits else r + 1
            self.edits[i] += 0 if fits else (r + 2) // 2 - (r + 1) // 2
            self.first[i] = x

    def __call__(self, i: int, state: int) -> int:
        x, r = self.first[i], self.run[i]
        fits = _after(state, x) >= 0 if x else state in self.exits
        return self.forced[i] + 2 * (self.edits[i] + (0 if fits else (r + 2) // 2 - (r + 1) // 2))


def _children(roles: str, faults: str, i: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, turns consumed, state, cost of the edit), in the order of the letters."""
    new = AFTER[state]
    if i == len(roles):
        return [("I", i, new, 2)]
    out = [("D", i + 1, state, 3), ("I", i, new, 2)]
    if faults[i] not in "bd":
        cost = int(faults[i] == "t")
        kept = _after(state, roles[i])
        if kept >= 0:
            out.append(("K", i + 1, kept, cost))
        out.append(("R", i + 1, new, cost + 2))
    return out


def _descent(roles: str, faults: str, entry: int, exits: tuple, bound: Bounds) -> tuple[int, str] | None:
    """A first solution: always the child with the least cost and bound."""
    i, state, cost, audit = 0, entry, 0, []
    for _ in range(4 * len(roles) + 8):
        if i == len(roles) and state in exits:
            return cost, "".join(audit)
        letter, i, state, step = min(_children(roles, faults, i, state), key=lambda c: (c[3] + bound(c[1], c[2]), c[0]))
        cost += step
        audit.append(letter)
    return None


def best_edits(roles: str, faults: str, entry: int = START, exits: tuple = DONE) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits from state ``entry`` to one of ``exits``, ties by the least audit; None if there are none.

    ``roles``: per turn ``s``, ``u``, ``a`` or another character; ``faults``: per turn ``b`` (blank), ``d`` (duplicate),
    ``t`` (truncated) or ``-``.
    """
    n, bound = len(roles), Bounds(roles, faults, exits)
    speaks = max(exits) > SYSTEM                                 # else no user or assistant turn may be made
    best = _descent(roles, faults, entry, exits, bound) if speaks else None
    table: dict[tuple[int, int], tuple[int, str]] = {}
    stack = [(0, entry, 0, "")]
    while stack:
        i, state, cost, audit = stack.pop()
        if best is not None:
            least = cost + bound(i, state)
            if least > best[0] or least == best[0] and audit > best[1][:len(audit)]:
                continue
        if (i, state) in table and table[i, state] <= (cost, audit):
            continue
        table[i, state] = cost, audit
        if i == n and state in exits and (best is None or (cost, audit) < best):
            best = cost, audit
        for letter, j, new, step in reversed(_children(roles, faults, i, state)):
            if speaks or new <= SYSTEM:
                stack.append((j, new, cost + step, audit + letter))
    return best


def edit_table(roles: str, faults: str) -> dict[tuple[int, int], tuple[int, str]]:
    """Best edits of a piece for every state before it and after it."""
    pairs = [(a, b) for a in range(4) for b in range(4) if b > SYSTEM or a <= b]
    found = {(a, b): best_edits(roles, faults, a, (b,)) for a, b in pairs}
    return {k: v for k, v in found.items() if v}


def joined_tables(left: dict, right: dict) -> dict:
    """Best edits of two neighbouring pieces."""
    out: dict = {}
    for (a, b), (c, x) in left.items():
        for (b2, d), (e, y) in right.items():
            if b == b2 and ((a, d) not in out or (c + e, x + y) < out[a, d]):
                out[a, d] = c + e, x + y
    return out


def made_roles(roles: str, audit: str, state: int) -> tuple[str, int]:
    """Per letter ``-`` (deleted), ``k`` (kept) or the new role's initial, and the state at the end."""
    out, i = [], 0
    for letter in audit:
        if letter == "D":
            out.append("-")
        elif letter == "K":
            state = _after(state, roles[i])
            out.append("k")
        else:
            out.append(NEED[state])
            state = AFTER[state]
        i += letter != "I"
    return "".join(out), state


# ---- Spark -------------------------------------------------------------------------------------

def _sequence(rows: DataFrame) -> DataFrame:
    """Rows in order with ``_at`` (increasing along conversations and their turns), stored."""
    def sized(c: str) -> Column:
        return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))
    rows = rows.withColumn("_key", F.col("_conv").cast("string"))
    rows = rows.withColumn("_digest", F.unhex(F.sha2(F.concat(sized("_key"), sized("_role"), F.col("_text")), 256))).drop("_key")
    order = [F.col("_conv").asc_nulls_first(), F.col("_turn").asc_nulls_first(), F.col("_role"), F.substring("_text", 1, TIE_CHARS), F.col("_digest")]
    parts = fan_out(rows.sparkSession)
    return staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "turns")


def _pieces(seq: DataFrame) -> DataFrame:
    """(``_conv``, ``_piece``, ``_first`` row, ``roles``, ``faults``, ``alone``): the letters of at most 2^PIECE_BITS turns."""
    spoken = F.rtrim("_text", F.lit(WS))
    narrow = seq.select("_conv", "_at", "_digest", F.substring("_role", 1, 1).alias("_i"), (F.length(spoken) == 0).alias("_blank"),
                        F.substring(spoken, -1, 1).isin(".", "!", "?").alias("_whole"))
    again = narrow.groupBy("_digest").agg(F.min("_at").alias("_seen"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    fault = (F.when(F.col("_blank"), "b").when(F.col("_at") > F.col("_seen"), "d").when(~F.col("_whole"), "t").otherwise("-"))
    initial = F.when(F.col("_i").isin("s", "u", "a"), F.col("_i")).otherwise("?")
    coded = narrow.join(again, "_digest", "left").select("_conv", "_at", initial.alias("i"), fault.alias("f"))
    cut = coded.groupBy("_conv", F.shiftright("_at", PIECE_BITS).alias("_piece")).agg(
        F.min("_at").alias("_first"), F.sort_array(F.collect_list(F.struct("_at", "i", "f"))).alias("_t"))        # at most 2^PIECE_BITS
    cut = cut.select("_conv", "_piece", "_first", F.array_join(F.col("_t.i"), "").alias("roles"), F.array_join(F.col("_t.f"), "").alias("faults"))
    cut = staged(cut, "turn-pieces")
    long = cut.groupBy(F.col("_conv").alias("_c")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_c", F.lit(False).alias("_a"))
    return cut.join(long, F.col("_conv").eqNullSafe(F.col("_c")), "left").select(*cut.columns, F.coalesce("_a", F.lit(True)).alias("alone"))


_EDITS = "array<struct<i:int,row:int,edit:string,role:string>>"
_EDITS_ARROW = pa.list_(pa.struct([("i", pa.int32()), ("row", pa.int32()), ("edit", pa.string()), ("role", pa.string())]))
_TABLE_ARROW = pa.list_(pa.struct([("a", pa.int8()), ("b", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))


def _edits(roles: str, audit: str, state: int) -> list[dict]:
    made, _ = made_roles(roles, audit, state)
    row, out = 0, []
    for i, letter in enumerate(audit):
        if letter != "D":
            out.append({"i": i, "row": row, "edit": letter, "role": ROLE.get(made[i])})
        row += letter != "I"
    return out


def _columns(t, *names: str) -> list[list]:
    return [t.column(n).to_pylist() for n in names]


def _solve_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[tuple[str, str], tuple[int, str]] = {}           # many conversations look alike
    for b in batches:
        roles, faults = _columns(b, "roles", "faults")
        found = []
        for key in zip(roles, faults):
            if key not in known:
                if len(known) == KNOWN:
                    known.clear()
                known[key] = best_edits(*key)
            found.append(known[key])
        columns = [*b.columns, pa.array([""] * len(found)), pa.array([c for c, _ in found], pa.int64()), pa.array([x for _, x in found]),
                   pa.array([_edits(r, x, START) for r, (_, x) in zip(roles, found)], _EDITS_ARROW)]
        yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "before", "cost", "audit", "edits"])


def _solve_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        tables = [edit_table(r, f) for r, f in zip(*_columns(b, "roles", "faults"))]
        rows = [[{"a": a, "b": e, "cost": c, "audit": x} for (a, e), (c, x) in t.items()] for t in tables]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rows, _TABLE_ARROW)], [*b.schema.names, "options"])


def _join_pieces(t: pa.Table) -> pa.Table:
    """The pieces of one conversation: the best edits of all, dealt back to the pieces."""
    t = t.sort_by("_piece")
    roles, options = _columns(t, "roles", "options")
    tables = [{(o["a"], o["b"]): (o["cost"], o["audit"]) for o in x} for x in options]
    while len(tables) > 1:
        tables = [joined_tables(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    cost, audit = min(v for (a, b), v in tables[0].items() if a == START and b in DONE)
    state, at, parts, edits, before = START, 0, [], [], [""]
    for k, r in enumerate(roles):
        end, left = at, len(r)
        while left:
            left -= audit[end] != "I"
            end += 1
        part = audit[at:] if k + 1 == len(roles) else audit[at:end]
        parts.append(part)
        edits.append(_edits(r, part, state))
        state = made_roles(r, part, state)[1]
        at += len(part)
        before.append(r[-1])
    out = t.drop_columns(["options"])
    costs = [cost] + [0] * (len(roles) - 1)
    for name, col in (("before", pa.array(before[:-1])), ("cost", pa.array(costs, pa.int64())), ("audit", pa.array(parts)), ("edits", pa.array(edits, _EDITS_ARROW))):
        out = out.append_column(name, col)
    return out


class Repair(NamedTuple):
    """``conversations``: one row each; ``turns``: the repaired turns, in order by (``piece``, ``place``)."""
    conversations: DataFrame
    turns: DataFrame


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> Repair:
    """Faults, cheapest repair and repaired turns of every conversation.

    ``conversations``: id, ``gaps`` (missing turn numbers between least and greatest), ``blank``, ``duplicate``, ``truncated`` (turns by
    their first fault), ``illegal`` (neighbours whose roles' initials aren't su, ua or au), ``cost`` and ``audit``.  ``turns``: id,
    ``piece``, ``place``, ``edit``, role and text.

    Turns are ordered by number (nulls first), ties by role, the first 256 characters of the text and its hash.  A turn is blank
    without any character but ASCII white space, a duplicate if the same role and text came before, truncated if its last character that isn't
    white space isn't one of ``.!?``.  A role counts by its first character; one that isn't s, u or a (an empty one too) fits
    nowhere.  Null roles and texts are one space.  Repeated rows are turns like others (all but the first are duplicates).  A null
    id is a conversation of its own.  Texts of any length are compared by SHA-256 and never gathered.  Other columns
    are not looked at; an empty table gives empty results.
    """
    seq = rows.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(role_col, F.lit(" ")).alias("_role"),
                      F.coalesce(text_col, F.lit(" ")).alias("_text"))
    conv = seq.schema["_conv"]
    seq = _sequence(seq)
    cut = _pieces(seq)
    fields = list(cut.schema) + [T.StructField("before", T.StringType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]
    shape = T.StructType(fields).add("edits", T.DataType.fromDDL(_EDITS))
    alone = cut.where("alone").mapInArrow(_solve_alone, shape)
    table = T.StructType(list(cut.schema)).add("options", T.DataType.fromDDL("array<struct<a:tinyint,b:tinyint,cost:bigint,audit:string>>"))
    several = staged(cut.where("not alone").mapInArrow(_solve_pieces, table), "piece-tables")
    solved = staged(alone.unionByName(several.groupBy("_conv").applyInArrow(_join_pieces, shape)), "turn-edits")

    met = F.concat("before", "roles")
    pairs = F.when(F.length(met) < 2, 0).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.length(met) - 1), lambda i: ~F.substr(met, i, F.lit(2)).isin(*FITS))))

    def number(f: str) -> Column:
        return F.sum(F.length("faults") - F.length(F.translate("faults", f, ""))).cast("long")
    audit = F.array_join(F.sort_array(F.collect_list(F.struct("_piece", "audit")))["audit"], "")
    faults = solved.groupBy("_conv").agg(number("b").alias("blank"), number("d").alias("duplicate"), number("t").alias("truncated"),
                                         F.sum(pairs).cast("long").alias("illegal"), F.sum("cost").alias("cost"), audit.alias("audit"))
    whole = "decimal(38,0)"
    gaps = F.max("_turn").cast(whole) - F.min("_turn").cast(whole) + 1 - F.count_distinct("_turn")
    numbers = seq.groupBy(F.col("_conv").alias("_c")).agg(F.coalesce(gaps.try_cast("long"), F.lit(0)).cast("long").alias("gaps"))
    summary = faults.join(numbers, F.col("_conv").eqNullSafe(F.col("_c")))
    summary = summary.select(F.col("_conv").alias(conv_col), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    edits = solved.select("_conv", "_piece", "_first", F.inline("edits"))
    made = F.coalesce("role", "_role")
    stay = edits.where("edit <> 'I'").withColumn("_at", F.col("_first") + F.col("row")).join(seq.select("_at", "_role", "_text"), "_at")
    turns = stay.select("_conv", "_piece", "i", "edit", made.alias("_r"), "_text").unionByName(
        edits.where("edit = 'I'").select("_conv", "_piece", "i", "edit", F.col("role").alias("_r"), F.lit("").alias("_text")))
    turns = turns.select(F.col("_conv").alias(conv_col), F.col("_piece").alias("piece"), F.col("i").alias("place"), "edit",
                         F.col("_r").alias(role_col), F.col("_text").alias(text_col))
    return Repair(summary, turns)


# ---- digest ------------------------------------------------------------------------------------

def _hash_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the lines of each run of equal ids; a line enters the hash as it comes."""
    now, digest, names = None, None, ["_conv", "sha256"]
    for b in batches:
        ids, lines = b.column(0).to_pylist(), b.column(1)
        done = []
        for c, line in zip(ids, lines):
            if digest is None or c != now:
                if digest is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = c, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(line.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], b.schema.types[0]), pa.array([x for _, x in done], pa.string())], names)
        last = b.schema.types[0]
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], last), pa.array([digest.hexdigest()])], names)


def hash_turns(turns: DataFrame, conv_col: str = "conv_id", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, ``sha256``) of each conversation's ``role:text`` lines, joined by line breaks.

    SHA-256 of one long text has to be taken in order, so a conversation's turns pass one task; they stream through it batch by batch and
    are never held together.
    """
    line = F.encode(F.concat(F.col(role_col), F.lit(":"), F.col(text_col)), "UTF-8").alias("_line")
    rows = turns.select(F.col(conv_col).alias("_conv"), line, "piece", "place").repartition(fan_out(turns.sparkSession), "_conv")
    rows = rows.sortWithinPartitions("_conv", "piece", "place").select("_conv", "_line")
    schema = T.StructType([T.StructField("_conv", rows.schema["_conv"].dataType), T.StructField("sha256", T.StringType())])
    return rows.mapInArrow(_hash_lines, schema).withColumnRenamed("_conv", conv_col)
