"""Conversation structure repair over a suffix-shared automaton.

A conversation's rows in order of turn spell a signature, one letter for each row's
role and fault. The cheapest repair of a row and all that follow it depends on the
letters from there to the end alone, so signatures are minimised from the end: the
distinct ones are sorted by their reverse, and each distinct suffix is one node,
worked out once for each state of the role grammar however many conversations share
it. A node holds the cost-to-go and the best audit suffix as its first edit and a link
to the rest. Signatures that share a suffix are neighbours in the sorted order, so a
task keeps no more of the automaton than the path of one signature, and a suffix
that very many signatures share is split between tasks, each of which builds only the
path to it again.

Texts move once, beside their conversation's audit, and are repaired in a stream of
rows; no conversation is gathered in memory but its signature and audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, runs

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of edits; an undeleted truncated row adds TRUNCATED.
COSTS = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1
#: The grammar (s?(ua)+)? over role initials: for each state, what an initial leads to. States: nothing yet, after s, after u, after a.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (True, False, False, True)
#: The role that a rerole or an insert takes in each state, and the state it leads to.
MADE = tuple(("user", 2) if "u" in n else ("assistant", 3) for n in NEXT)
_LONG = (1 << 63) - 1
#: The white space that makes a text blank.
SPACES = " \t\n\x0b\x0c\r"
#: Letters of a signature: x for a row that must go; s, u, a, o (any other role) for others, in upper case if truncated.
MUST_GO = "x"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


# --- the automaton ------------------------------------------------------------
class Node:
    """A suffix: for each state the cost-to-go and the first edit of the best audit, with the state it leads to (None at the end)."""

    __slots__ = ("costs", "moves")

    def __init__(self, costs: list[int | None], moves: list[tuple[str, int] | None]):
        # An insert stays at the node: one or two of them, as a third would be back in a state already passed.
        for _ in range(2):
            for state, (_, to) in enumerate(MADE):
                if costs[to] is None:
                    continue
                cost = COSTS[INSERT] + costs[to]
                if costs[state] is None or (cost, INSERT) < (costs[state], moves[state][0] if moves[state] else ""):
                    costs[state], moves[state] = cost, (INSERT, to)
        self.costs, self.moves = costs, moves


def end_node() -> Node:
    return Node([0 if e else None for e in ENDS], [None] * len(ENDS))


def node_before(letter: str, after: Node) -> Node:
    """The node of a letter in front of a suffix."""
    role, extra = letter.lower(), TRUNCATED * letter.isupper()
    costs, moves = [], []
    for state, allowed in enumerate(NEXT):
        options = [(COSTS[DELETE] + after.costs[state], DELETE, state)]
        if letter != MUST_GO:
            if role in allowed:
                options.append((COSTS[KEEP] + extra + after.costs[allowed[role]], KEEP, allowed[role]))
            to = MADE[state][1]
            options.append((COSTS[REROLE] + extra + after.costs[to], REROLE, to))
        cost, edit, to = min(options)
        costs.append(cost)
        moves.append((edit, to))
    return Node(costs, moves)


def best_audits(signatures: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures in order of their reverses; each suffix's node is made once."""
    path, last = [end_node()], ""
    for signature in signatures:
        reverse = signature[::-1]
        del path[len(commonprefix((last, reverse))) + 1 :]
        for letter in reverse[len(path) - 1 :]:
            path.append(node_before(letter, path[-1]))
        at, state, edits = len(path) - 1, 0, []
        while (move := path[at].moves[state]) is not None:
            edits.append(move[0])
            at, state = at - (move[0] != INSERT), move[1]
        yield signature, path[-1].costs[0], "".join(edits)
        last = reverse


def signature_audits(signatures: DataFrame) -> DataFrame:
    """signature, cost, audit for each distinct signature."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (s for b in batches for s in b.column(0).to_pylist())
        out, size = [], 0
        for row in best_audits(rows):
            out.append(row)
            size += len(row[0]) + len(row[2])
            if len(out) >= 5000 or size > 8 << 20:
                yield as_batch(out)
                size = 0
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["signature", "cost", "audit"])

    reverse = F.reverse("signature")
    return signatures.select("signature").distinct().repartitionByRange(reverse).sortWithinPartitions(reverse).mapInArrow(work, "signature string, cost long, audit string")


# --- rows ---------------------------------------------------------------------
def prepared(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (null role and text: one space) and digest, the text's SHA-256, which orders rows of one turn and role."""
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    return out.withColumn("digest", F.unhex(F.sha2("text", 256)))


def in_order(rows: DataFrame, *first: Column) -> DataFrame:
    """Each conversation's rows together and in order: by turn, nulls first, then role and digest."""
    return rows.sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest")


class _Reading:
    """What is counted of a conversation while its rows pass."""

    __slots__ = ("key", "letters", "turns", "first", "last", "before", "blank", "duplicate", "truncated", "illegal")

    def __init__(self, key: int | None):
        self.key, self.letters, self.turns, self.first, self.last, self.before = key, [], 0, None, None, None
        self.blank = self.duplicate = self.truncated = self.illegal = 0

    def take(self, turns: list, roles: list, faults: list) -> None:
        for turn, initial, fault in zip(turns, roles, faults):
            if turn is not None and turn != self.last:
                self.first = turn if self.first is None else self.first
                self.turns, self.last = self.turns + 1, turn
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            letter = initial if initial in ("s", "u", "a") else "o"
            if fault == "blank" or fault == "duplicate":
                letter = MUST_GO
            elif fault == "truncated":
                letter = letter.upper()
            if fault:
                setattr(self, fault, getattr(self, fault) + 1)
            self.letters.append(letter)

    def row(self) -> tuple:
        gaps = 0 if self.first is None else min(_LONG, self.last - self.first + 1 - self.turns)
        return self.key, gaps, self.blank, self.duplicate, self.truncated, self.illegal, "".join(self.letters)


def readings(rows: DataFrame, everyone: DataFrame) -> DataFrame:
    """conv_id, gaps, the counts of faults, illegal and signature for each conversation of `everyone` (conv_id); those without rows too.

    One exchange by conversation serves the search for duplicates and the reading.
    """
    stripped = F.rtrim("text", F.lit(SPACES))
    own = F.when(stripped == "", "blank").when(~F.substring(stripped, -1, 1).isin(".", "!", "?"), "truncated")
    slim = prepared(rows).select("conv_id", "turn", "role", "digest", own.alias("own"))
    marks = everyone.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().select("conv_id", *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("own", "string"))])
    both = slim.unionByName(marks).repartition("conv_id")
    copies = F.row_number().over(W.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first()))
    fault = F.when(F.col("own") == "blank", "blank").when(F.col("copy") > 1, "duplicate").otherwise(F.col("own"))
    dealt = in_order(both.withColumn("copy", copies)).select("conv_id", "turn", F.col("role").isNull().alias("mark"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, out, size = None, [], 0
        for key, new, part in runs(batches):
            if new:
                if one:
                    out.append(one.row())
                    size += len(one.letters)
                one = _Reading(key)
            part = part.filter(pc.invert(part.column(2)))
            one.take(*(part.column(i).to_pylist() for i in (1, 3, 4)))
            if len(out) >= 5000 or size > 8 << 20:
                yield as_batch(out)
                size = 0
        if one:
            out.append(one.row())
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        rows.clear()
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.string())], ["conv_id", *COUNTS, "signature"])

    return dealt.mapInArrow(work, ", ".join(f"{c} long" for c in ("conv_id", *COUNTS)) + ", signature string")


def audits(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for each conversation of rows (conv_id, turn, role, text).

    Rows are taken by turn, nulls first, those of one turn by role and text digest. A
    null role or text is one space, a null conv_id a conversation of its own; a row is
    blank, or repeats role and text of an earlier one, or is truncated, the first that
    holds. everyone: conversations (conv_id) to return even if no row of theirs is in
    rows. Costs count as COSTS has it; of audits that cost the same, the least string.
    """
    read = materialize(readings(rows, rows if everyone is None else everyone))
    # A table of its own, so that both sides of the join are plain exchanges, whose hot keys the adaptive join splits.
    best = materialize(signature_audits(read))
    return read.join(best, "signature").select("conv_id", *COUNTS, "cost", "audit")


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, edit, turn, role, text: the rows that stay or are inserted (turn null), each conversation's together and in order.

    found: what audits() gives for these rows. The text of an inserted row is empty.
    """
    one = prepared(rows).withColumn("audit", F.lit(None).cast("string"))
    plan = found.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"), "audit")
    dealt = in_order(one.unionByName(plan).repartition("conv_id"), F.col("audit").isNull()).select("conv_id", "turn", "role", "text", "audit")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        audit, at, state = "", 0, 0
        out: list[tuple] = []
        size = 0

        def inserts(key: int | None) -> None:
            nonlocal at, state
            while audit[at : at + 1] == INSERT:
                role, state = MADE[state]
                at += 1
                out.append((key, INSERT, None, role, ""))

        for key, new, part in runs(batches):
            for k, (turn, role, text, plan) in enumerate(zip(*(part.column(i).to_pylist() for i in range(1, 5)))):
                if new and not k:
                    audit, at, state = plan, 0, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit == KEEP:
                        state = NEXT[state][role[0]]
                    elif edit == REROLE:
                        role, state = MADE[state]
                    if edit != DELETE:
                        out.append((key, edit, turn, role, text))
                        size += len(text)
                inserts(key)
                if len(out) >= 5000 or size > 4 << 20:
                    yield as_batch(out)
                    size = 0
        if out:
            yield as_batch(out)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows))
        rows.clear()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["conv_id", "edit", "turn", "role", "text"])

    return dealt.mapInArrow(work, "conv_id long, edit string, turn long, role string, text string")


def conversation_digests(fixed: DataFrame) -> DataFrame:
    """conv_id and sha256 of role:text, newline-joined, of repaired() rows as they come."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, last, keys, out = None, None, [], []
        for key, new, part in runs(batches):
            if new and digest is not None:
                keys.append(last)
                out.append(digest.hexdigest())
            lines = "\n".join(f"{r}:{t}" for r, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist())).encode("utf-8", "surrogatepass")
            if new:
                digest, last = hashlib.sha256(lines), key
            else:
                digest.update(b"\n" + lines)
            if len(keys) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.string())], ["conv_id", "sha256"])
                keys, out = [], []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([*keys, last], pa.int64()), pa.array([*out, digest.hexdigest()], pa.string())], ["conv_id", "sha256"])

    return fixed.select("conv_id", "role", "text").mapInArrow(work, "conv_id long, sha256 string")


# --- the query's damage -------------------------------------------------------
def damaged(rows: DataFrame) -> DataFrame:
    """rows with faults put in by crc32(conv_id:turn) % 20: 0 drops a row, 1 empties its text, 2 takes out . ! ?, 3 repeats it, 4 makes its role user. Nulls are one space there and in role and text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    mark = F.pmod(F.crc32(F.encode(F.concat_ws(":", text("conv_id"), text("turn")), "UTF-8")), F.lit(20))
    marked = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), mark.alias("mark")).filter("mark <> 0")
    changed = marked.select(
        "conv_id",
        "turn",
        F.when(F.col("mark") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("mark") == 1, "").when(F.col("mark") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("mark") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return changed.drop("copy")


def repair_digests(rows: DataFrame, everyone: DataFrame | None = None) -> DataFrame:
    """audits() with repaired_sha256, the SHA-256 of the repaired role:text lines (of nothing where none stays)."""
    found = materialize(audits(rows, everyone))
    digests = materialize(conversation_digests(repaired(rows, found))).select(F.col("conv_id").alias("_conv"), F.col("sha256").alias("_sha"))
    joined = found.join(digests, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return joined.select("conv_id", *COUNTS, "cost", "audit", F.coalesce("_sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
