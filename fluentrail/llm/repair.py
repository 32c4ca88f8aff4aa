"""Cheapest repairs of damaged conversations by lightest derivations.

A repair is a derivation: an item ``[i, q]`` says how the rows from the i-th on can be turned into something that the
grammar ``(s?(ua)+)?`` accepts from state q. A deduction has two antecedents, an edit of row i that leads from q to q' (or
an insertion) and the item ``[i + 1, q']`` (or ``[i, q']``); its weight is the sum of the costs, and its audit the edit's letter before
the item's. Items are popped from an agenda by cost, then rows covered, then audit. A deduction never lowers this order and
keeps that of its antecedents, so an item is final when it is popped (Knuth), and the goal ``[0, start]`` ends the search.

A conversation may be longer than a task can hold. Rows are sorted by conversation and turn into ranges; the part of a
conversation within a range gives the lightest derivations between any two states, worked out in blocks. Deductions over
blocks and parts are of the same form: instead of letters they write the rank of an audit among those of the block that
start in the same state. These never begin with each other, since all of them cover the same rows and end with one, so ranks
order whole audits as letters do.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluentrail.llm.common import stored

#: States of the grammar: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
#: The role that follows each state, and the state after it.
NEXT = {START: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
NAMES = {"u": "user", "a": "assistant"}
#: Costs of edits, and what a truncated row that stays adds.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: What ends a conversation after each state.
TAILS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
LEGAL = {"su", "ua", "au"}
#: Steps of a block, and different rows of a range.
BLOCK, RANGE_ROWS = 256, 1 << 15

#: Deductions of one step, by the state they need: state that they give, letters, cost.
Step = dict[int, list[tuple[int, str, int]]]
Spans = dict[tuple[int, int], tuple[int, str]]


@lru_cache(maxsize=64)
def kept_step(initial: str, truncated: bool) -> Step:
    """Edits of a row that may stay."""
    found: Step = defaultdict(list)
    more = TRUNCATED if truncated else 0
    for state in STATES:
        role, after = NEXT[state]
        found[after].append((state, "K", more) if initial == role else (state, "R", REROLE + more))
        found[state].append((state, "D", DELETE))
    if initial == "s":
        found[SYSTEM].append((START, "K", more))
    return dict(found)


def deleted_step(rows: int) -> Step:
    """The only edit of rows that must go. An insertion before or between them never has the least audit."""
    return {state: [(state, "D" * rows, DELETE * rows)] for state in STATES}


INSERTIONS: Step = {after: [(state, "I", INSERT) for state in STATES if NEXT[state][1] == after] for after in (USER, ASSISTANT)}


def lightest(steps: list[Step], ends: dict[int, int], insertions: Step | None, at_end: bool = False, wanted: int = len(STATES)) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) of all steps from each state to one of ``ends``, which may cost something themselves.

    ``insertions`` may stand before each step, and behind the last one if ``at_end``. With ``wanted`` 1, the search ends with ``START``.
    """
    count = len(steps)
    agenda: list[tuple[int, int, str, int]] = []
    final: set[tuple[int, int]] = set()
    goals: dict[int, tuple[int, str]] = {}
    for state, cost in ends.items():
        heappush(agenda, (cost, 0, "", state))
    while agenda and len(goals) < len(STATES):
        cost, covered, audit, state = heappop(agenda)
        if (covered, state) in final:
            continue
        final.add((covered, state))
        if covered == count:
            goals[state] = (cost, audit)
            if wanted == 1 and state == START:
                break
        if insertions and (covered or at_end):
            for before, letters, more in insertions.get(state, ()):
                if (covered, before) not in final:
                    heappush(agenda, (cost + more, covered, letters + audit, before))
        if covered < count:
            for before, letters, more in steps[count - 1 - covered].get(state, ()):
                heappush(agenda, (cost + more, covered + 1, letters + audit, before))
    return goals


def open_spans(steps: list[Step], insertions: Step | None = INSERTIONS) -> Spans:
    """The lightest derivations of all steps between any two states."""
    spans = {}
    for end in STATES:
        for start, found in lightest(steps, {end: 0}, insertions).items():
            spans[start, end] = found
    return spans


def ranked_step(spans: Spans) -> tuple[Step, dict[tuple[int, str], int]]:
    """Spans as a step whose letters are ranks of audits, and the state that a rank leads to."""
    step: Step = defaultdict(list)
    leads: dict[tuple[int, str], int] = {}
    for start in STATES:
        order = sorted((audit, cost, end) for (s, end), (cost, audit) in spans.items() if s == start)
        for rank, (_, cost, end) in enumerate(order):
            step[end].append((start, str(rank), cost))
            leads[start, str(rank)] = end
    return dict(step), leads


def span_steps(steps: list[Step]) -> Spans:
    """As ``open_spans``, by blocks, so that audits stay short while they grow from the front."""
    if len(steps) <= BLOCK:
        return open_spans(steps)
    blocks = [open_spans(steps[i : i + BLOCK]) for i in range(0, len(steps), BLOCK)]
    ranked = [ranked_step(b) for b in blocks]
    spans = {}
    for (start, end), (cost, path) in open_spans([step for step, _ in ranked], None).items():
        state, audit = start, []
        for block, (_, leads), rank in zip(blocks, ranked, path, strict=True):
            after = leads[state, rank]
            audit.append(block[state, after][1])
            state = after
        spans[start, end] = (cost, "".join(audit))
    return spans


def repair_steps(steps: list[Step]) -> tuple[int, str]:
    """Cost and audit of the lightest derivation of a whole conversation."""
    if len(steps) <= BLOCK:
        return lightest(steps, {START: 0, ASSISTANT: 0}, INSERTIONS, at_end=True, wanted=1)[START]
    spans = span_steps(steps)
    closed = {START: {"": 0}, SYSTEM: {"II": 2 * INSERT}, USER: {"I": INSERT}, ASSISTANT: {"": 0}}
    # audits to different states never begin with each other, so the first difference decides
    return min((cost + more, audit + tail) for (start, end), (cost, audit) in spans.items() if start == START for tail, more in closed[end].items())


@dataclass
class Part:
    """The rows of one conversation in one range, as they come."""

    conversation: tuple
    rows: list[tuple]

    def steps(self) -> list[Step]:
        steps = []
        for _, _, role, _, copies, blank, seen, truncated in self.rows:
            if blank or seen:
                steps.append(deleted_step(copies))
            else:
                steps.append(kept_step(role[:1], truncated))
                if copies > 1:
                    steps.append(deleted_step(copies - 1))
        return steps

    def record(self, number: int, whole: bool) -> dict:
        """Counts of faults, and the spans: one from start to end if the conversation is whole."""
        steps = self.steps()
        if whole:
            cost, audit = repair_steps(steps)
            spans = [{"start": START, "end": -1, "cost": cost, "audit": audit}]
        else:
            spans = [{"start": s, "end": e, "cost": cost, "audit": audit} for (s, e), (cost, audit) in span_steps(steps).items()]
        blank = duplicate = truncated = illegal = turns = 0
        last_role, last_turn = None, None
        for has_turn, turn, role, _, copies, is_blank, seen, is_truncated in self.rows:
            blank += copies * is_blank
            duplicate += 0 if is_blank else copies if seen else copies - 1
            truncated += not is_blank and not seen and is_truncated
            illegal += copies - 1 + (last_role is not None and last_role + role[:1] not in LEGAL)
            if has_turn and turn != last_turn:
                turns, last_turn = turns + 1, turn
            last_role = role[:1]
        dated = [row[1] for row in self.rows if row[0]]
        return {
            "part": number, "whole": whole, "spans": spans, "blank": blank, "duplicate": duplicate, "truncated": int(truncated), "illegal": int(illegal), "turns": turns,
            "first_turn": dated[0] if dated else None, "last_turn": dated[-1] if dated else None, "first_role": self.rows[0][2][:1], "last_role": last_role,
            "rows": [{"has_turn": r[0], "turn": r[1], "role": r[2], "digest": r[3], "copies": r[4], "goes": r[5] or r[6]} for r in self.rows],
        }


PART_COLUMNS = (
    "part long, whole boolean, spans array<struct<start: int, end: int, cost: long, audit: string>>, blank long, duplicate long, truncated long, "
    "illegal long, turns long, first_turn {turn}, last_turn {turn}, first_role string, last_role string, "
    "rows array<struct<has_turn: boolean, turn: {turn}, role: string, digest: string, copies: long, goes: boolean>>"
)


def _cut_parts(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        open_part: Part | None = None
        first = True

        def emit(parts: list[tuple[Part, bool]]) -> pa.RecordBatch:
            records = [{"has_conv": p.conversation[0], "conv": p.conversation[1]} | p.record(number, whole) for p, whole in parts]
            return pa.RecordBatch.from_pylist(records, schema=schema)

        for batch in batches:
            done = []
            for has_conv, conv, *row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if open_part is None or open_part.conversation != (has_conv, conv):
                    if open_part is not None:
                        # what lies between two others in its range is whole
                        done.append((open_part, not first))
                        first = False
                    open_part = Part((has_conv, conv), [])
                open_part.rows.append(tuple(row))
            if done:
                yield emit(done)
        if open_part is not None:
            yield emit([(open_part, False)])

    return run


def _choose(schema: pa.Schema) -> Callable:
    """The span that each part of a conversation takes, by a derivation over its parts."""

    def run(edges: pa.Table) -> pa.Table:
        rows = sorted(edges.to_pylist(), key=lambda r: r["part"])
        parts: dict[int, Spans] = defaultdict(dict)
        for r in rows:
            parts[r["part"]][r["start"], r["end"]] = (r["cost"], str(r["rank"]))
        ranked = [ranked_step(spans) for spans in parts.values()]
        ends = {state: INSERT * len(tail) for state, tail in TAILS.items()}
        _, path = lightest([step for step, _ in ranked], ends, None, wanted=1)[START]
        state, out = START, []
        for number, (_, leads), rank in zip(parts, ranked, path, strict=True):
            after = leads[state, rank]
            out.append({"has_conv": rows[0]["has_conv"], "conv": rows[0]["conv"], "part": number, "start": state, "end": after, "tail": ""})
            state = after
        out[-1]["tail"] = TAILS[state]
        return pa.Table.from_pylist(out, schema=schema)

    return run


def _edited(schema: pa.Schema) -> Callable:
    """The rows that a repair keeps or inserts, in order, from a part's rows and its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.to_pylist():
                state, place, at, copy = part["start"], part["part"] << 32, 0, 0
                out = []
                for letter in part["audit"]:
                    row = None
                    if letter != "I":
                        row = part["rows"][at]
                        copy += 1
                        if copy == row["copies"]:
                            at, copy = at + 1, 0
                    if letter == "D":
                        continue
                    initial, after = NEXT[state]
                    role = NAMES[initial]
                    if letter == "K":
                        role = row["role"]
                        after = SYSTEM if role.startswith("s") else after
                    state = after
                    source = row or {"has_turn": None, "turn": None, "role": None, "digest": None}
                    out.append({"has_conv": part["has_conv"], "conv": part["conv"], "place": place, "edit": letter, "new_role": role, "has_turn": source["has_turn"], "turn": source["turn"], "role": source["role"], "digest": source["digest"]})
                    place += 1
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def _default(column: str, rows: DataFrame) -> Column:
    kind = rows.schema[column].dataType
    return F.coalesce(F.col(column), F.lit("0").cast(kind))


@dataclass(frozen=True)
class Repaired:
    """``reports``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; ``turns``: conv_id, place, role, text, edit."""

    reports: DataFrame
    turns: DataFrame


def repair_conversations(turns: DataFrame) -> Repaired:
    """Repair conversations given as rows of ``conv_id, turn, role, text`` at the least cost.

    Rows are taken by turn, null first; rows of one turn by role and then by the SHA-256 of their text. A null role or text counts as one
    space, a null ``conv_id`` as a conversation. A row is blank without a sign other than white space, duplicate if role and text came
    earlier, truncated if its last sign other than white space is none of ``.!?``; the first of these counts. Keeping a row costs 0, giving it the role
    user or assistant 2, deleting it 3, inserting an empty one 2; blank and duplicate rows are deleted; a truncated row that stays adds 1. Of the cheapest repairs
    whose initials of roles form ``(s?(ua)+)?``, the one with the least audit (initials of its edits in order) is taken.

    ``place`` orders the turns of a conversation and has gaps. Equal rows are held once, with their number. Other columns are not
    read. An empty table gives empty results. The rows are read twice, so they must come out the same both times.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    text = F.coalesce("text", F.lit(" "))
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    key = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]
    keyed = turns.select(
        F.col("conv_id").isNotNull().alias("has_conv"), _default("conv_id", turns).alias("conv"), F.col("turn").isNotNull().alias("has_turn"), _default("turn", turns).alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.sha2(text, 256).alias("digest"), text.alias("text"), last.alias("last"),
    )
    slim = keyed.groupBy(*key).agg(F.count("*").alias("copies"), F.first("last").alias("last"))
    slim = stored(slim.select(*key, "copies", (F.col("last") == "").alias("blank"), (~F.col("last").isin(".", "!", "?")).alias("truncated")), "repair-rows")
    said = ["has_conv", "conv", "role", "digest"]
    again = slim.groupBy(*said).agg(F.min(F.struct("has_turn", "turn")).alias("first"), F.count("*").alias("times")).filter("times > 1").drop("times")
    marked = slim.join(again, said, "left").withColumn("seen", F.coalesce(F.struct("has_turn", "turn") > F.col("first"), F.lit(False)))
    order = ["has_conv", "conv", "has_turn", "turn", "role", "digest"]
    marked = stored(marked.select("has_conv", "conv", "has_turn", "turn", "role", "digest", "copies", "blank", "seen", "truncated"), "repair-marked")
    ranges = 1 + slim.count() // RANGE_ROWS
    in_order = marked.repartitionByRange(ranges, *order).sortWithinPartitions(*order)

    conv_type, turn_type = turns.schema["conv_id"].dataType.simpleString(), turns.schema["turn"].dataType.simpleString()
    conv_columns = f"has_conv boolean, conv {conv_type}"
    spark = turns.sparkSession

    def arrow(columns: str) -> pa.Schema:
        return to_arrow_schema(spark.createDataFrame([], columns).schema)

    part_columns = f"{conv_columns}, {PART_COLUMNS.format(turn=turn_type)}"
    parts = stored(in_order.mapInArrow(_cut_parts(arrow(part_columns)), part_columns), "repair-parts")

    # parts at the edges of ranges: at most two a range
    spans = parts.filter("not whole").select("has_conv", "conv", "part", F.expr("transform(spans, s -> struct(s.start, s.end, s.cost, size(filter(spans, t -> t.start = s.start and t.audit < s.audit)) as rank))").alias("spans"))
    edges = spans.select("has_conv", "conv", "part", F.inline("spans"))
    choice_columns = f"{conv_columns}, part long, start int, end int, tail string"
    chosen = stored(edges.groupBy("has_conv", "conv").applyInArrow(_choose(arrow(choice_columns)), choice_columns), "repair-choices")
    picked = parts.join(chosen.select("has_conv", "conv", "part", F.struct("start", "end", "tail").alias("choice")), ["has_conv", "conv", "part"], "left")
    span = F.expr("filter(spans, s -> whole or (s.start = choice.start and s.end = choice.end))[0]")
    picked = picked.withColumn("span", span).withColumn("audit", F.concat("span.audit", F.coalesce("choice.tail", F.lit(""))))
    picked = picked.withColumn("cost", F.col("span.cost") + INSERT * F.length(F.coalesce("choice.tail", F.lit("")))).withColumn("start", F.col("span.start"))

    counts = ["blank", "duplicate", "truncated", "illegal", "turns", "cost"]
    ends = F.array_sort(F.collect_list(F.struct("part", "first_turn", "last_turn", "first_role", "last_role", "audit")))
    told = picked.groupBy("has_conv", "conv").agg(*[F.sum(c).alias(c) for c in counts], F.min("first_turn").alias("low"), F.max("last_turn").alias("high"), ends.alias("ends"))
    pairs = "transform(sequence(2, size(ends)), i -> struct(ends[i - 2] as a, ends[i - 1] as b))"
    pairs = F.expr(f"if(size(ends) > 1, {pairs}, array())")
    told = told.withColumn("pairs", pairs)
    crossed = F.expr("size(filter(pairs, p -> concat(p.a.last_role, p.b.first_role) not in ('su', 'ua', 'au')))")
    shared = F.expr("size(filter(pairs, p -> p.a.last_turn = p.b.first_turn))")
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - (F.col("turns") - shared), F.lit(0))
    conv_id = F.when(F.col("has_conv"), F.col("conv")).alias("conv_id")
    reports = told.select(
        conv_id, gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", (F.col("illegal") + crossed).cast("long").alias("illegal"), "cost",
        F.expr("array_join(transform(ends, e -> e.audit), '')").alias("audit"),
    )

    edit_columns = f"{conv_columns}, place long, edit string, new_role string, has_turn boolean, turn {turn_type}, role string, digest string"
    edited = picked.select("has_conv", "conv", "part", "start", "audit", "rows").mapInArrow(_edited(arrow(edit_columns)), edit_columns)
    texts = keyed.groupBy(*key).agg(F.first("text").alias("text"))
    kept = edited.join(texts, key, "left")
    return Repaired(reports, kept.select(conv_id, "place", F.col("new_role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit"))


def digests(turns: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of the lines ``role:text`` of each conversation, in order of place.

    The digest runs along the lines, so a conversation's lines pass one task; they stream through it, and the task
    holds none of them.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    schema = pa.schema([("conv_id", _arrow_type(turns)), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for batch in batches:
            done = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                line = f"{role}:{text}".encode()
                if running is None or conv != current:
                    if running is not None:
                        done.append((current, running.hexdigest()))
                    current, running = conv, hashlib.sha256(line)
                else:
                    running.update(b"\n")
                    running.update(line)
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], schema.field(0).type), pa.array([d for _, d in done], pa.string())], schema=schema)
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], schema.field(0).type), pa.array([running.hexdigest()], pa.string())], schema=schema)

    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, f"conv_id {kind}, sha256 string")


def _arrow_type(turns: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(turns.schema["conv_id"].dataType)
