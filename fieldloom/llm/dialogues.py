"""Repair conversations at least cost: which turns to keep, re-role, delete or insert so that roles read ``(s?(ua)+)?`` by their initials.

A row's first fault counts: *blank* (no character but ASCII white space), *duplicate* (role and text seen earlier in the conversation), *truncated* (the
last such character is none of ``.!?``). Keep costs 0, a new role 3, deletion 4 (required for blank and duplicate rows), an inserted empty turn 3, and every
truncated row that stays 3 more. Of equally cheap repairs the one whose letters (K, R, D, I) sort first is taken.

Every row becomes one letter, its role and fault. A conversation's letters, read from the end, are a path in an automaton that all conversations share:
conversations with the same ending share its nodes, so sorted by their reversed letters each node is reached once in a task. There the cost-to-go of the
four grammar states and the first letter of their best audit suffix are computed once; the rest of that suffix is the next node's.

Scale: rows meet by (conversation, role, text) with partial sums, are ordered by ranges that cut through long conversations, and travel as one letter a row
from there. The texts that stay are streamed, a conversation in its order, never gathered; as its turns must come out in order, one task writes them.
A conversation's letters and audit are one value each (a byte a row), as its result is.

Null roles and texts are one space; a null conversation id is one conversation. Rows of one turn number are ordered by role, then by the SHA-256 of the
text; null turn numbers come first. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldloom.llm.common import parts_for, written

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3

#: Grammar states: before everything, after the system turn, after a user turn, after an assistant turn. The next turn that is not a system turn is fixed.
FOLLOWING = (2, 2, 3, 2)
ROLE_OF = {2: "user", 3: "assistant"}
ENDS = (0, 3)
FAR = 1 << 40


def accepts(state: int, initial: str) -> int | None:
    """The state after a turn whose role begins with ``initial``, or None."""
    if initial == "s":
        return 1 if state == 0 else None
    to = FOLLOWING[state]
    return to if ROLE_OF[to][0] == initial else None


def with_insertions(base: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Best (cost, letter) of each state where turns may also be inserted at this place; two in a row at most are ever worth it."""
    best = list(base)
    for state in (2, 3):
        best[state] = min(base[state], (INSERT + base[FOLLOWING[state]][0], "I"))
    for state in (0, 1):
        best[state] = min(base[state], (INSERT + best[FOLLOWING[state]][0], "I"))
    return best


@lru_cache(maxsize=1 << 14)
def node(letter: str, after: tuple[int, ...]) -> tuple[tuple[int, ...], bytes]:
    """Cost-to-go and first audit letter of the four states at a row with ``letter``, given the costs of the node after it."""
    base = []
    for state in range(4):
        options = [(DELETE + after[state], "D")]
        if letter != "-":
            extra = TRUNCATED if letter.isupper() else 0
            to = accepts(state, letter.lower())
            if to is not None:
                options.append((KEEP + extra + after[to], "K"))
            options.append((REROLE + extra + after[FOLLOWING[state]], "R"))
        base.append(min(options))
    best = with_insertions(base)
    return tuple(c for c, _ in best), "".join(x for _, x in best).encode()


def last_node() -> tuple[tuple[int, ...], bytes]:
    best = with_insertions([(0 if state in ENDS else FAR, "$") for state in range(4)])
    return tuple(c for c, _ in best), "".join(x for _, x in best).encode()


class Automaton:
    """The suffix-shared automaton along one path: ``audit`` keeps the nodes that the last conversation shares with the next."""

    def __init__(self):
        costs, letters = last_node()
        self.path, self.costs, self.first, self.made = "", array("q", costs), bytearray(letters), 0

    def _shared(self, backwards: str) -> int:
        low, high = 0, min(len(self.path), len(backwards))
        while low < high:
            half = (low + high + 1) // 2
            if self.path[low:half] == backwards[low:half]:
                low = half
            else:
                high = half - 1
        return low

    def audit(self, backwards: str) -> tuple[int, str, str]:
        """Cost, audit, and the audit without the deletions that faults require, of the conversation whose letters end to start are ``backwards``."""
        kept = self._shared(backwards)
        del self.costs[4 * (kept + 1) :], self.first[4 * (kept + 1) :]
        for letter in backwards[kept:]:
            after = self.costs[-4:]
            least = min(after)
            costs, letters = node(letter, tuple(c - least for c in after))
            self.costs.extend(c + least for c in costs)
            self.first += letters
            self.made += 1
        self.path = backwards
        audit, own, state, depth = bytearray(), bytearray(), 0, len(backwards)
        while True:
            edit = self.first[4 * depth + state]
            if edit == 36:  # $
                break
            audit.append(edit)
            row = "" if edit == 73 else backwards[depth - 1]
            if row != "-":
                own.append(edit)
            if edit in (73, 82):  # I, R
                state = FOLLOWING[state]
            elif edit == 75:  # K
                state = accepts(state, row.lower())
            depth -= edit != 73
        return self.costs[-4], audit.decode(), own.decode()


def letter_of(initial: str, truncated: bool) -> str:
    low = initial if initial in ("s", "u", "a") else "x"
    return low.upper() if truncated else low


_KINDS = {"bigint": T.LongType(), "int": T.IntegerType(), "string": T.StringType()}


def fields(names: str) -> T.StructType:
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in names.split(","))])


CHUNKS = fields(
    "conv_id bigint, part int, letters string, n_turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string, "
    "last_initial string, first_turn bigint, last_turn bigint, turns bigint"
)
LEGAL = {"su", "ua", "au"}


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn to one row per conversation and task."""
    from pyspark import TaskContext

    part, held, letters, none = TaskContext.get().partitionId(), None, [], object()
    conversation, out = none, []

    def close():
        if conversation is not none:
            out.append({**held, "conv_id": conversation, "part": part, "letters": "".join(letters)})

    kind = None
    for batch in batches:
        kind = kind or pa.schema([(f.name, batch.schema.field("conv_id").type if f.name == "conv_id" else _arrow(f.dataType)) for f in CHUNKS])
        for row in batch.to_pylist():
            if conversation is none or row["conv_id"] != conversation:
                close()
                conversation, letters = row["conv_id"], []
                held = dict.fromkeys(("n_turns", "blank", "duplicate", "truncated", "illegal", "turns"), 0)
                held |= {"first_initial": None, "last_initial": None, "first_turn": None, "last_turn": None}
            n, initial, turn = row["n"], row["role"][:1], row["turn"]
            if held["first_initial"] is None:
                held["first_initial"] = initial
            else:
                held["illegal"] += held["last_initial"] + initial not in LEGAL
            held["illegal"] += (n - 1) * (initial + initial not in LEGAL)
            held["last_initial"] = initial
            held["n_turns"] += n
            if turn is not None and turn != held["last_turn"]:
                held["turns"] += 1
                held["last_turn"] = turn
                if held["first_turn"] is None:
                    held["first_turn"] = turn
            stays = not row["blank"] and row["is_first"]
            if row["blank"]:
                held["blank"] += n
            else:
                held["duplicate"] += n - stays
                held["truncated"] += stays and row["cut"]
            letters.append((letter_of(initial, row["cut"]) if stays else "") + "-" * (n - stays))
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pylist(out, kind)
            out.clear()
    close()
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "integer": pa.int32(), "long": pa.int64()}[kind.typeName()]


def _typed(schema: T.StructType, like: DataFrame) -> T.StructType:
    """``schema`` with the type of ``like``'s conversation ids."""
    return T.StructType([T.StructField(f.name, like.schema["conv_id"].dataType if f.name == "conv_id" else f.dataType) for f in schema])


def _one_row_each(chunks: DataFrame) -> DataFrame:
    """The chunks of a conversation, which ranges of rows may have cut, in order as one row."""
    gathered = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in chunks.columns if c != "conv_id"]))).alias("c"))

    def total(name: str) -> Column:
        return F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x[name])

    border = F.struct(F.lit(None).cast("string").alias("initial"), F.lit(None).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("illegal"), F.lit(0).cast("bigint").alias("again"))
    across = F.aggregate(
        "c",
        border,
        lambda a, x: F.struct(
            x["last_initial"].alias("initial"),
            F.coalesce(x["last_turn"], a["turn"]).alias("turn"),
            (a["illegal"] + F.coalesce((~F.concat(a["initial"], x["first_initial"]).isin(*LEGAL)).cast("bigint"), F.lit(0))).alias("illegal"),
            (a["again"] + F.coalesce((a["turn"] == x["first_turn"]).cast("bigint"), F.lit(0))).alias("again"),
        ),
    )
    least, most = F.array_min(F.transform("c", lambda x: x["first_turn"])), F.array_max(F.transform("c", lambda x: x["last_turn"]))
    gaps = F.coalesce(most - least + 1 - (total("turns") - F.col("across.again")), F.lit(0).cast("bigint"))
    return gathered.withColumn("across", across).select(
        "conv_id",
        F.array_join(F.transform("c", lambda x: x["letters"]), "").alias("letters"),
        gaps.alias("gaps"),
        *[total(n).alias(n) for n in ("n_turns", "blank", "duplicate", "truncated")],
        (total("illegal") + F.col("across.illegal")).alias("illegal"),
    )


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by reversed letters get cost, audit and edits; equal letters are looked up, equal endings share their nodes."""
    automaton, known = Automaton(), None
    for batch in batches:
        answers = []
        for backwards in batch.column("backwards").to_pylist():
            if known is None or backwards != automaton.path:
                known = automaton.audit(backwards)
            answers.append(known)
        cost, audit, edits = (list(x) for x in zip(*answers)) if answers else ([], [], [])
        rest = batch.drop_columns(["backwards"])
        names = [*rest.schema.names, "cost", "audit", "edits"]
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(cost, pa.int64()), pa.array(audit, pa.string()), pa.array(edits, pa.string())], names)


TURNS = fields("conv_id bigint, position bigint, edit string, role string, text string")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by conversation, the plan's row before its turns; gives the turns that remain or are inserted, in order."""
    edits, at, state, position, conversation, out = "", 0, 0, 0, None, []
    kind = None

    def emit(edit: str, role: str, text: str):
        nonlocal position
        out.append({"conv_id": conversation, "position": position, "edit": edit, "role": role, "text": text})
        position += 1

    def insert():
        nonlocal at, state
        while at < len(edits) and edits[at] == "I":
            state = FOLLOWING[state]
            emit("I", ROLE_OF[state], "")
            at += 1

    for batch in batches:
        kind = kind or pa.schema([(f.name, batch.schema.field("conv_id").type if f.name == "conv_id" else _arrow(f.dataType)) for f in TURNS])
        for conv, plan, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "edits", "role", "text"))):
            if plan is not None:
                conversation, edits, at, state, position = conv, plan, 0, 0, 0
                insert()
                continue
            edit = edits[at]
            at += 1
            if edit != "D":
                state = FOLLOWING[state] if edit == "R" else accepts(state, role[:1])
                emit(edit, ROLE_OF[state] if edit == "R" else role, text)
            insert()
            if len(out) >= 2_000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out.clear()
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, conversation, out = None, None, []
    kind = None
    for batch in batches:
        kind = kind or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("sha256", pa.string())])
        for conv, position, role, text in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "position", "role", "text"))):
            if position == 0:
                if held is not None:
                    out.append({"conv_id": conversation, "sha256": held.hexdigest()})
                held, conversation = hashlib.sha256(), conv
            held.update((("\n" if position else "") + role + ":" + text).encode())
        if len(out) >= 5_000:
            yield pa.RecordBatch.from_pylist(out, kind)
            out.clear()
    if held is not None:
        out.append({"conv_id": conversation, "sha256": held.hexdigest()})
    if out:
        yield pa.RecordBatch.from_pylist(out, kind)


def _faults(turns: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(n), F.lit(" ")) for n in ("role", "text"))
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text"))
    body = F.rtrim("text", F.lit(SPACE))
    cut = ~F.right(body, F.lit(1)).isin(".", "!", "?")
    return rows.select("*", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), (body == "").alias("blank"), cut.alias("cut"))


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``turns`` (conv_id, turn, role, text) to a plan and the repaired turns.

    The plan has a row per conversation: conv_id, n_turns, gaps (turn numbers missing between the least and the greatest), counts blank, duplicate,
    truncated and illegal (neighbouring role initials other than su, ua, au), cost and audit (letters of the edits in order). The repaired turns have
    conv_id, position, edit, role and text; those of a conversation stand together, in order, in one partition.
    """
    parts = parts_for(turns.sparkSession)
    rows = _faults(turns)
    kinds = ["conv_id", "role", "text", "digest", "blank"]
    firsts = rows.groupBy(*kinds).agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unnumbered"))
    firsts = firsts.select(*kinds, F.when(~F.col("unnumbered"), F.col("least")).alias("turn"))
    firsts = written(firsts, "first-turns")
    counted = rows.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    seen = firsts.select(*[F.col(c).alias(f"f_{c}") for c in ("conv_id", "turn", "role", "digest")])
    same = [F.col(c).eqNullSafe(F.col(f"f_{c}")) for c in ("conv_id", "turn", "role", "digest")]
    marked = counted.join(seen, same, "left").select(*counted.columns, F.col("f_digest").isNotNull().alias("is_first"))
    order = ["conv_id", "turn", "role", "digest"]
    chunks = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_chunks, _typed(CHUNKS, turns))
    letters = written(_one_row_each(chunks).withColumn("backwards", F.reverse("letters")).drop("letters"), "letters")
    schema = T.StructType([*[f for f in letters.schema if f.name != "backwards"], *fields("cost bigint, audit string, edits string")])
    ordered = letters.repartitionByRange(parts, "backwards", "conv_id").sortWithinPartitions("backwards")
    plan = written(ordered.mapInArrow(_audited, schema), "plan")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("role", "text", "digest")]
    kept = firsts.where(~F.col("blank")).select("conv_id", F.lit(None).cast("string").alias("edits"), "turn", "role", "text", "digest")
    both = plan.select("conv_id", "edits", F.lit(None).cast("bigint").alias("turn"), *nothing).unionByName(kept)
    stream = both.repartition(parts, "conv_id").sortWithinPartitions("conv_id", F.col("edits").asc_nulls_last(), "turn", "role", "digest")
    return plan.drop("edits"), stream.mapInArrow(_edited, _typed(TURNS, turns))


def digests(repaired: DataFrame) -> DataFrame:
    """SHA-256 of ``role:text`` lines of each conversation of ``repair``'s turns; conversations without a turn have no row."""
    return repaired.select("conv_id", "position", "role", "text").mapInArrow(_digests, _typed(fields("conv_id bigint, sha256 string"), repaired))


def damaged(turns: DataFrame) -> DataFrame:
    """Turns with planted faults, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it,
    4 makes its role user. Nulls of any column read as one space there; conversation ids and turn numbers stay null."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    turns = turns.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return turns.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")
