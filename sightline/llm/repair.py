"""Cheapest repair of conversations, solved once per shared suffix of their signatures.

A row's symbol says its role and its first fault; a conversation's signature is the string of its symbols.
What the cheapest edits of a row are depends on the rows after it and on the state of the role
grammar ``(s?(ua)+)?`` alone. So signatures are merged from their ends into an acyclic automaton: a
node is a suffix, and conversations that end alike share its nodes. Per node and grammar state
the cost to go and the best audit are computed once, over all conversations.

The automaton is built by blocks of symbols, the first at the end. A round takes the distinct pairs of
a block and the node that follows it, sorts them by following node and reversed block, so that blocks with
a common end lie side by side, and keeps the suffixes of the last block on a stack: what it shares
with the next is not computed again. Blocks double in width from round to round, so that the number
of rounds follows the logarithm of the longest conversation. A node's name is a hash of its block
and of the name of what follows.

Edits and ties: of the letters D, I, K, R each leads from a row and a state to one successor, so the
least audit takes the least letter among those of least cost, row by row. Rows are put right in
one pass over the rows of each conversation in order, with its audit ahead of them.

Edge cases: null conv_ids are one conversation. Null turns come first; rows of one turn are in the order
of role and text. A null role or text is one space. A row of an unknown role (or an empty one) can
be deleted or get another role. A conversation of any length is sorted by Spark and read as a
stream; only its signature and audit, a byte a row, are single values. Empty tables give empty
tables. Columns besides conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sightline.llm.common import sha256_hex, table, written

#: Symbols of the first block.
WIDTH = 16
#: States of the grammar: nothing yet, after s, after u, after a. Letters of roles by state before them.
START, SYSTEM, USER, ASSISTANT = range(4)
KEEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The state after a user or an assistant that is put in, or made of another role.
MADE = (USER, USER, ASSISTANT, USER)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
GONE = "x"
#: From the end of all rows: cost and audit by state.
END_COSTS, END_AUDITS = (0, 4, 2, 0), ("", "II", "I", "")
ROLES = {USER: "user", ASSISTANT: "assistant"}


# Rows.


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that their own crc32 names."""
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(named.cast("binary")) % 20
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("copy")).drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation (from 1), first fault, symbol, and what counts need."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    same = Window.partitionBy("conv_id", "role", "text").orderBy("at")
    filled = rows.select(
        "conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    )
    first = F.substring("role", 1, 1)
    placed = filled.select(
        "*",
        F.row_number().over(order).alias("at"),
        first.alias("initial"),
        F.lag(first).over(order).alias("before"),
        F.lag("turn").over(order).alias("turn_before"),
    )
    shown = F.btrim("text", F.lit(" \t\n\x0b\x0c\r"))
    blank = shown == ""
    cut = ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    fault = (
        F.when(blank, "blank").when(F.row_number().over(same) > 1, "duplicate").when(cut, "truncated")
    )
    kind = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    return placed.withColumn("fault", fault).select(
        "conv_id",
        "turn",
        "role",
        "text",
        "at",
        "fault",
        F.when(F.col("fault").isin("blank", "duplicate"), GONE)
        .when(F.col("fault") == "truncated", F.upper(kind))
        .otherwise(kind)
        .alias("symbol"),
        (F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(F.col("turn_before"))).alias("new_turn"),
    )


def signatures(rows: DataFrame) -> DataFrame:
    """Counts and signature of every conversation that has rows."""
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    symbols = F.array_sort(F.collect_list(F.struct("at", "symbol")))
    return rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - count(F.col("new_turn")), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("illegal")).alias("illegal"),
        F.array_join(F.transform(symbols, lambda s: s["symbol"]), "").alias("signature"),
    )


# The automaton.


def step(symbol: str, costs: tuple[int, ...]) -> tuple[tuple[int, ...], str, tuple[int, ...]]:
    """Before a row of this symbol, by state: cost to go, letter of the best edit, state after it.

    A letter I stays before the row.
    """
    role, more = symbol.lower(), CUT * symbol.isupper()
    best = []
    for state in range(4):
        options = [(DELETE + costs[state], "D", state)]
        if symbol != GONE:
            options.append((REROLE + more + costs[MADE[state]], "R", MADE[state]))
            if (state, role) in KEEPS:
                options.append((more + costs[KEEPS[state, role]], "K", KEEPS[state, role]))
        best.append(min(options))
    # one insertion leads to u or a; a second to what a first would have reached
    for state in (USER, ASSISTANT, START, SYSTEM):
        after = MADE[state]
        best[state] = min(best[state], (INSERT + best[after][0], "I", after))
    return tuple(zip(*best, strict=True))  # type: ignore[return-value]


def audit(rows: list, state: int, tails: list[str]) -> str:
    """The letters from the first of ``rows`` (steps, the last row's first) to the end."""
    out = []
    at = len(rows) - 1
    while at >= 0:
        _, letters, after = rows[at]
        out.append(letters[state])
        at -= letters[state] != "I"
        state = after[state]
    return "".join(out) + tails[state]


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of blocks that come sorted by following node and reversed block."""
    following, read, stack = None, "", []
    for batch in batches:
        names, costs, audits = [], [], []
        for name, after, block, tail_costs, tails in zip(*(batch.column(c).to_pylist() for c in ("node", "following", "block", "costs", "audits")), strict=True):
            if after != following:
                following, read, stack = after, "", []
            back = block[::-1]
            shared = next((i for i, (a, b) in enumerate(zip(read, back, strict=False)) if a != b), min(len(read), len(back)))
            del stack[shared:]
            for symbol in back[shared:]:
                stack.append(step(symbol, stack[-1][0] if stack else tuple(tail_costs)))
            read = back
            names.append(name)
            costs.append(list(stack[-1][0]))
            audits.append([audit(stack, state, tails) for state in range(4)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(costs, pa.list_(pa.int64())), pa.array(audits, pa.list_(pa.string()))],
            names=["node", "costs", "audits"],
        )


def solved(found: DataFrame, width: int = WIDTH) -> DataFrame:
    """(signature, cost, audit) of the distinct signatures."""
    spark = found.sparkSession
    open_ = written(
        found.select("signature", F.col("signature").alias("rest"), F.lit("").alias("node")).distinct(), "signatures"
    )
    longest = open_.agg(F.max(F.length("signature"))).first()[0] or 0
    nodes = spark.createDataFrame(
        [("", list(END_COSTS), list(END_AUDITS))], "node string, costs array<long>, audits array<string>"
    )
    answers, covered = None, 0
    while covered < longest:
        block = F.right("rest", F.lit(width))
        left = F.greatest(F.length("rest") - width, F.lit(0))
        taken = open_.select(
            "signature",
            F.expr(f"left(rest, greatest(length(rest) - {width}, 0))").alias("rest"),
            F.col("node").alias("following"),
            block.alias("block"),
            sha256_hex(F.concat(block, F.lit("|"), "node")).alias("node"),
            (left == 0).alias("whole"),
        )
        taken = written(taken, "blocks")
        asked = taken.select("node", "following", "block").distinct()
        ordered = (
            asked.join(nodes.withColumnRenamed("node", "following"), "following")
            .select("node", "following", "block", "costs", "audits")
            .withColumn("back", F.reverse("block"))
            .repartitionByRange("following", "back")
            .sortWithinPartitions("following", "back")
            .drop("back")
        )
        nodes = written(ordered.mapInArrow(_solve, "node string, costs array<long>, audits array<string>"), "nodes")
        done = taken.where("whole").join(nodes, "node").select(
            "signature", F.col("costs")[START].alias("cost"), F.col("audits")[START].alias("audit")
        )
        answers = done if answers is None else answers.unionByName(done)
        open_ = taken.where("NOT whole").select("signature", "rest", "node")
        covered, width = covered + width, 2 * width
    if answers is None:
        return spark.createDataFrame([], "signature string, cost long, audit string")
    return written(answers, "solved-signatures")


# Repaired rows.


class Turns:
    """Applies an audit to the rows of one conversation, in order."""

    def __init__(self, letters: str):
        self.letters, self.next, self.place = letters, 0, 0
        # an s can only be kept: an odd number of roles begins with one
        self.state = START if (len(letters) - letters.count("D")) % 2 == 0 else None

    def _made(self) -> str:
        self.state = MADE[self.state]
        return ROLES[self.state]

    def inserted(self) -> Iterator[tuple[int, str, str, str]]:
        while self.next < len(self.letters) and self.letters[self.next] == "I":
            self.next, self.place = self.next + 1, self.place + 1
            yield self.place, "I", self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[int, str, str, str]]:
        yield from self.inserted()
        letter = self.letters[self.next]
        self.next += 1
        if letter == "D":
            return
        self.place += 1
        if letter == "K":
            self.state = SYSTEM if self.state is None else KEEPS[self.state, role[0]]
            yield self.place, letter, role, text
        else:
            yield self.place, letter, self._made(), text


def _apply(kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, conv, held = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True)) or [[]] * 5
            kinds = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["conv_id", "place", "edit", "role", "text"])

        for batch in batches:
            for own, letters, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text")), strict=True):
                if letters is not None:  # the audit comes before the rows
                    if turns:
                        held += [(conv, *t) for t in turns.inserted()]
                    turns, conv = Turns(letters), own
                else:
                    held += [(conv, *t) for t in turns.row(role, text)]
            yield out()
        if turns:
            held += [(conv, *t) for t in turns.inserted()]
            yield out()

    return run


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text) of what stays, from ``judged`` rows and (conv_id, audit).

    The rows of a conversation lie in one partition, in order.
    """
    none = F.lit(None).cast("string")
    ahead = audits.select("conv_id", F.lit(0).alias("at"), "audit", none.alias("role"), none.alias("text"))
    follow = rows.select("conv_id", "at", none.alias("audit"), "role", "text")
    ordered = ahead.unionByName(follow).repartition("conv_id").sortWithinPartitions("conv_id", "at")
    field = ordered.schema["conv_id"].dataType
    kind = {"long": pa.int64(), "bigint": pa.int64(), "integer": pa.int32(), "string": pa.string()}[field.typeName()]
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(
        _apply(kind), f"conv_id {field.simpleString()}, place long, edit string, role string, text string"
    )


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a conversation follow each other, and the first has place 1."""
    held = None
    for batch in batches:
        ids, hashes = [], []
        for place, own, role, text in zip(batch.column("place").to_pylist(), batch.column("conv_id"), *(batch.column(c).to_pylist() for c in ("role", "text")), strict=True):
            if place == 1:
                if held:
                    ids.append(held[0])
                    hashes.append(held[1].hexdigest())
                held = own.as_py(), hashlib.sha256()
            held[1].update(f"{'' if place == 1 else chr(10)}{role}:{text}".encode())
        kind = batch.schema.field("conv_id").type
        yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(hashes, pa.string())], names=["conv_id", "repaired_sha256"])
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array([held[0]], kind), pa.array([held[1].hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"]
        )


def hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` rows, which are still in order."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    return turns.mapInArrow(_digest, f"conv_id {kind}, repaired_sha256 string")


def audited(rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """Counts, cost and audit of every conversation that has ``judged`` rows."""
    found = written(signatures(rows), "conversation-signatures")
    return found.join(solved(found, width), "signature").drop("signature")


def repair(conversations: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """A row for every conv_id of ``conversations``; ``rows`` are theirs, as they are to be repaired."""
    placed = written(judged(rows), "judged-rows")
    audits = written(audited(placed, width), "audits")
    ends = written(hashes(repaired(placed, audits.select("conv_id", "audit"))), "repaired-hashes")
    ids = conversations.select(F.col("conv_id").alias("id")).distinct()
    same = lambda own: F.col("id").eqNullSafe(own)
    joined = (
        ids.join(audits, same(F.col("conv_id")), "left")
        .drop("conv_id")
        .join(ends, same(F.col("conv_id")), "left")
        .drop("conv_id")
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(
        F.col("id").alias("conv_id"),
        *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", sha256_hex(F.lit(""))).alias("repaired_sha256"),
    )


def structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: all conversations, damaged as the contract says."""
    conversations = table(spark, sf_dir, "conversations")
    return repair(conversations, damaged(conversations))
