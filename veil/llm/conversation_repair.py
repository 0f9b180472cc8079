"""Conversations repaired by the cheapest edits, solved once for all conversations with the same ending.

Each message is one symbol of its conversation's signature: its role and its
first fault.  Sorted by their reversal, the signatures form an automaton that
shares suffixes: a node is a distinct ending of signatures.  It is walked depth
first, so a task holds one path of it; on each node the cost to go and the best
next edit are computed once for each state of the grammar, and every
conversation that ends in the same way uses them.  A conversation's audit is
read off its own path from the front.

No step holds the texts of a conversation: messages travel in chunks of sorted
rows, and edits go back to the chunks they belong to.
"""

from __future__ import annotations

import hashlib
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from veil.llm.rows import col, digest
from veil.operators.materialize import materialize

#: Messages of a chunk at most.
CHUNK = 1000
DELETE, INSERT, KEEP, REROLE = "DIKR"
DELETE_COST, INSERT_COST, REROLE_COST, TRUNCATED_COST = 2, 5, 1, 5

# A symbol is "A" plus four times the role's number plus the fault's number.
ROLES, FAULTS = "sua", ("none", "blank", "duplicate", "truncated")
_OTHER = len(ROLES)

# States of (s?(ua)+)?: nothing yet, behind s, behind u, behind a.
START, SYSTEM, USER, ASSISTANT = range(4)
_WANTS = (USER, USER, ASSISTANT, USER)
_KEPT = {(START, "s"): SYSTEM, **{(q, "ua"[w - USER]): w for q, w in enumerate(_WANTS)}}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {"su", "ua", "au"}


def _closed(costs: list[float], edits: list[str]) -> tuple[list[float], list[str]]:
    """The best of each state when messages may be inserted first."""
    costs, edits = list(costs), list(edits)
    for _ in costs:
        for q, to in enumerate(_WANTS):
            if (INSERT_COST + costs[to], INSERT) < (costs[q], edits[q] or " "):
                costs[q], edits[q] = INSERT_COST + costs[to], INSERT
    return costs, edits


def _ended() -> tuple[list[float], list[str]]:
    """The node of the empty ending; an empty edit accepts."""
    never = float("inf")
    return _closed([0, never, never, 0], ["", "~", "~", ""])


def step(symbol: str, costs: list[float]) -> tuple[list[float], list[str]]:
    """A node from the node behind it: cost to go and best edit of each state; edits that tie differ in their initials."""
    role, fault = divmod(ord(symbol) - ord("A"), len(FAULTS))
    best, edits = [], []
    for q in range(4):
        options = [(DELETE_COST + costs[q], DELETE)]
        if FAULTS[fault] in ("none", "truncated"):
            extra = TRUNCATED_COST if FAULTS[fault] == "truncated" else 0
            to = _KEPT.get((q, ROLES[role])) if role < _OTHER else None
            if to is not None:
                options.append((extra + costs[to], KEEP))
            options.append((extra + REROLE_COST + costs[_WANTS[q]], REROLE))
        cost, edit = min(options)
        best.append(cost)
        edits.append(edit)
    return _closed(best, edits)


class Automaton:
    """The path of the nodes of one signature; a signature that shares an ending with the one before keeps its nodes."""

    def __init__(self):
        costs, edits = _ended()
        self.reversed = ""
        self.costs, self.offsets, self.edits = [costs], [0], [edits]
        self.nodes = 1
        self._steps: dict = {}

    def enter(self, signature: str) -> None:
        mirrored, shared = signature[::-1], 0
        for a, b in zip(mirrored, self.reversed, strict=False):
            if a != b:
                break
            shared += 1
        del self.costs[shared + 1:], self.offsets[shared + 1:], self.edits[shared + 1:]
        for symbol in mirrored[shared:]:
            # Costs count from the least of a node, so that few different ones occur and a step is looked up.
            key = symbol, tuple(self.costs[-1])
            if key not in self._steps:
                costs, edits = step(symbol, self.costs[-1])
                least = min(costs)
                self._steps[key] = [c - least for c in costs], least, edits
            costs, least, edits = self._steps[key]
            self.costs.append(costs)
            self.offsets.append(self.offsets[-1] + least)
            self.edits.append(edits)
            self.nodes += 1
        self.reversed = mirrored

    def audit(self) -> tuple[int, str, str, list[int]]:
        """(cost, edits, roles given by them, number of the message each edit stands at) of the signature entered last."""
        size, at, state = len(self.reversed), 0, START
        edits, given, places = [], [], []
        while edit := self.edits[size - at][state]:
            edits.append(edit)
            places.append(min(at, size - 1))
            if edit in (INSERT, REROLE):
                state = _WANTS[state]
                given.append("ua"[state - USER])
            else:
                given.append("-")
            if edit == KEEP:
                state = _KEPT[state, ROLES[(ord(self.reversed[size - at - 1]) - ord("A")) // len(FAULTS)]]
            at += edit != INSERT
        return int(self.offsets[size] + self.costs[size][START]), "".join(edits), "".join(given), places


def faulty(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text") -> DataFrame:
    """(c, turn, role, text, symbols): equal rows are one row with a symbol for each, all but the first duplicates."""
    rows = messages.select(
        col(conversation).alias("c"), col(turn).cast("bigint").alias("turn"),
        F.coalesce(col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(col(text).cast("string"), F.lit(" ")).alias("text")).groupBy("c", "turn", "role", "text").agg(
        F.count("*").alias("times")).withColumn("said", digest(F.concat(F.length("role"), F.lit(" "), "role", "text")))
    # Only what is said at several turns has a first turn to be looked up; the counts are combined before they move.
    place = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn").alias("turn"))
    firsts = rows.groupBy("c", "said").agg(F.min(place).alias("first"), F.count("*").alias("turns")).filter(
        "turns > 1").select(F.col("c").alias("first_c"), F.col("said").alias("first_said"), "first")
    rows = rows.join(firsts, F.col("c").eqNullSafe(F.col("first_c")) & (F.col("said") == F.col("first_said")), "left")
    last = F.substring(F.rtrim("text", F.lit(" \t\n\v\f\r")), -1, 1)

    def symbol(fault: F.Column) -> F.Column:
        number = F.coalesce(F.element_at(F.create_map(*[x for i, r in enumerate(ROLES) for x in (F.lit(r), F.lit(i))]),
                                         F.substring("role", 1, 1)), F.lit(_OTHER))
        return F.char(F.lit(ord("A")) + number * len(FAULTS) + fault)

    fault = F.when(last == "", 1).when(F.col("first").isNotNull() & (place > F.col("first")), 2).when(
        ~last.isin(*".!?"), 3).otherwise(0)
    repeated = F.when(last == "", 1).otherwise(2)
    return rows.select("c", "turn", "role", "text", F.concat(
        symbol(fault), F.repeat(symbol(repeated), (F.col("times") - 1).cast("int"))).alias("symbols"))


def _chunks(rows: DataFrame) -> DataFrame:
    """Sorted rows in chunks (c, part, nth, turns, roles, texts, symbols); a conversation may go on in the next part."""
    kind = rows.schema["c"].dataType.simpleString()
    ordered = rows.repartitionByRange("c", "turn", "role", "text").sortWithinPartitions("c", "turn", "role", "text")

    def run(batches):
        part, numbers = TaskContext.get().partitionId(), count()
        for batch in batches:
            size = batch.num_rows
            if not size:
                continue
            c = batch.column(0)
            before, after = c.slice(0, size - 1), c.slice(1)
            differ = pc.or_(pc.xor(pc.is_null(before), pc.is_null(after)), pc.fill_null(pc.not_equal(before, after), False))
            starts = np.concatenate([[0], np.flatnonzero(differ.to_numpy(zero_copy_only=False)) + 1, [size]])
            starts = np.unique(np.concatenate([np.arange(a, b, CHUNK) for a, b in zip(starts, starts[1:], strict=False)]))
            offsets = pa.array(np.append(starts, size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, batch.column(i)) for i in range(1, 5)]
            yield pa.RecordBatch.from_arrays(
                [c.take(pa.array(starts)), pa.array([part] * len(starts), pa.int32()),
                 pa.array([next(numbers) for _ in starts], pa.int64()), *lists],
                ["c", "part", "nth", "turns", "roles", "texts", "symbols"])

    return ordered.mapInArrow(run, f"c {kind}, part int, nth bigint, turns array<bigint>, roles array<string>, "
                                   "texts array<string>, symbols array<string>")


def _summary(pieces: list[dict]) -> tuple[str, int]:
    """A conversation's signature, and the turns that are missing between its first and last one."""
    signature = "".join(p["symbols"] for p in pieces)
    numbered = [p for p in pieces if p["distinct"]]
    if not numbered:
        return signature, 0
    distinct = sum(p["distinct"] for p in numbered) - sum(
        a["last"] == b["first"] for a, b in zip(numbered, numbered[1:], strict=False))
    return signature, numbered[-1]["last"] - numbered[0]["first"] + 1 - distinct


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _solved(chunks: DataFrame) -> DataFrame:
    """(c, counts, audit, pieces): each conversation with its edits, dealt back to its chunks."""
    kind = chunks.schema["c"].dataType.simpleString()
    turns = F.filter("turns", lambda t: t.isNotNull())
    piece = F.struct("part", "nth", F.array_join("symbols", "").alias("symbols"),
                     F.array_min(turns).alias("first"), F.array_max(turns).alias("last"),
                     F.size(F.array_distinct(turns)).alias("distinct"))
    joined = chunks.groupBy("c").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    ending = F.reverse(F.array_join(F.transform("pieces", lambda p: p["symbols"]), ""))
    # Many conversations may have one signature: the second key lets them fall into several tasks.
    ordered = joined.withColumn("ending", ending).withColumn("deal", F.xxhash64("c")).repartitionByRange(
        "ending", "deal").sortWithinPartitions("ending", "deal").select("c", "pieces")
    out = pa.struct([("part", pa.int32()), ("nth", pa.int64()), ("edits", pa.string()), ("given", pa.string()),
                     ("before", pa.int64())])

    def run(batches):
        automaton = Automaton()
        for batch in batches:
            counts, audits, dealt = {name: [] for name in _COUNTS}, [], []
            for pieces in batch.column(1).to_pylist():
                signature, gaps = _summary(pieces)
                automaton.enter(signature)
                cost, audit, given, places = automaton.audit()
                kinds = [(ord(x) - ord("A")) % len(FAULTS) for x in signature]
                roles = "".join((ROLES + "x")[(ord(x) - ord("A")) // len(FAULTS)] for x in signature)
                illegal = sum(a + b not in _LEGAL for a, b in zip(roles, roles[1:], strict=False))
                for name, value in zip(_COUNTS, (gaps, *(kinds.count(k) for k in (1, 2, 3)), illegal, cost), strict=True):
                    counts[name].append(value)
                audits.append(audit)
                ends = np.cumsum([len(p["symbols"]) for p in pieces])
                cuts = [0, *np.searchsorted(places, ends).tolist()]
                made = []
                for p, a, b in zip(pieces, cuts, cuts[1:], strict=False):
                    made.append({"part": p["part"], "nth": p["nth"], "edits": audit[a:b], "given": given[a:b],
                                 "before": a - audit.count(DELETE, 0, a)})
                dealt.append(made)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(v, pa.int64()) for v in counts.values()], pa.array(audits, pa.string()),
                 pa.array(dealt, pa.list_(out))], ["c", *_COUNTS, "audit", "pieces"])

    return ordered.mapInArrow(run, f"c {kind}, {', '.join(n + ' bigint' for n in _COUNTS)}, audit string, pieces array<"
                                   "struct<part: int, nth: bigint, edits: string, given: string, before: bigint>>")


def _edited(chunks: DataFrame, pieces: DataFrame) -> DataFrame:
    """(c, position, edit, role, text) of the messages that are left."""
    kind = chunks.schema["c"].dataType.simpleString()
    met = chunks.join(pieces, ["part", "nth"]).select("c", "roles", "texts", "symbols", "edits", "given", "before")

    def run(batches):
        for batch in batches:
            chunk, position, edit_of, role_of, row = [], [], [], [], []
            roles, texts, symbols = (batch.column(i) for i in (1, 2, 3))
            for n, (edits, given, before) in enumerate(zip(*(batch.column(i).to_pylist() for i in (4, 5, 6)), strict=True)):
                rows = [i for i, x in enumerate(symbols[n].as_py()) for _ in x]
                first, at = roles.offsets[n].as_py(), 0
                for edit, role in zip(edits, given, strict=True):
                    if edit != DELETE:
                        chunk.append(n)
                        position.append(before)
                        before += 1
                        edit_of.append(edit)
                        role_of.append(None if edit == KEEP else _NAMES["ua".index(role) + USER])
                        row.append(None if edit == INSERT else first + rows[at])
                    at += edit != INSERT
            numbers = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(chunk, pa.int64())), pa.array(position, pa.int64()),
                 pa.array(edit_of, pa.string()), pc.coalesce(pa.array(role_of, pa.string()), roles.values.take(numbers)),
                 pc.fill_null(texts.values.take(numbers), "")], ["c", "position", "edit", "role", "text"])

    return met.mapInArrow(run, f"c {kind}, position bigint, edit string, role string, text string")


def repair_conversations(messages: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> tuple[DataFrame, DataFrame]:
    """What is wrong with each conversation and its cheapest repair, and the repaired messages.

    The first table has a row for each conversation: ``gaps`` (turns missing
    between the first and the last), messages ``blank``, ``duplicate`` (role and
    text were there before) and ``truncated`` (no ``.!?`` at the end), each
    counted under its first fault, ``illegal`` neighbours of roles, ``cost`` and
    ``audit``, the initials of the edits delete, insert, keep and rerole.  The
    second has (conversation, position, edit, role, text) of what is left.

    Roles count by their initial.  Messages come by turn, those without a turn
    first, equal turns by role and text.  Null roles and texts are one space;
    null conversations are one conversation; rows that occur twice are
    duplicates; other columns are ignored; no messages, no conversations.
    """
    chunks = materialize(_chunks(faulty(messages, conversation, turn, role, text)))
    solved = materialize(_solved(chunks))
    report = solved.select(F.col("c").alias(conversation), *_COUNTS, "audit")
    pieces = solved.select(F.explode("pieces").alias("p")).select("p.*")
    return report, _edited(chunks, pieces).withColumnRenamed("c", conversation)


def message_digests(repaired: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, repaired_sha256): the digest of all ``role:text``, joined by line breaks; texts are read one by one."""
    rows = repaired.select(col(conversation).alias("c"), "position", F.concat_ws(":", "role", "text").alias("said"))
    kind = rows.schema["c"].dataType.simpleString()
    # Conversations are told apart by their position 0.
    ordered = rows.repartition("c").sortWithinPartitions("c", "position")

    def run(batches):
        current, made = None, None
        for batch in batches:
            ids, out = [], []
            for c, position, said in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if position == 0:
                    if made is not None:
                        ids.append(current)
                        out.append(made.hexdigest())
                    current, made = c, hashlib.sha256()
                else:
                    made.update(b"\n")
                made.update(said.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(out, pa.string())],
                                             ["c", "repaired_sha256"])
        if made is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], batch.column(0).type),
                                              pa.array([made.hexdigest()], pa.string())], ["c", "repaired_sha256"])

    return ordered.mapInArrow(run, f"c {kind}, repaired_sha256 string").withColumnRenamed("c", conversation)
