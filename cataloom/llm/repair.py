"""Conversation structure repair by a rank-convergence parallel Viterbi search.

A conversation should read `(system? (user assistant)+)?`. Rows are kept, given another role, deleted, or empty
rows inserted, at least cost. The search runs over four states (nothing yet, after system, after user, after
assistant); the backward cost of a state is the cheapest way to the end of the conversation from there.

Conversations of any length are cut into chunks of rows. Every chunk starts from a speculative cost vector,
as if the conversation ended there, and runs backwards. Only differences between states matter, and these
soon stop depending on the start: fix-up passes rerun a chunk from the vector that its successor now begins with
until that vector differs from the one used before only by a constant. Where roles keep a parity alive for ever (say
users only) vectors need not converge in `passes` rounds; such chains are closed by products of the chunks' own
4 x 4 cost matrices, in rounds that double the span. With the stitched backward costs each chunk traces its
cheapest edits, least audit first; the states in which chunks begin come from products of the same kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept

START, SYSTEM, USER, ASSISTANT = range(4)
KEEP_TO = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FORCED = (USER, USER, ASSISTANT, USER)  # the role that an inserted or rerolled row must have in each state
ROLE = {USER: "user", ASSISTANT: "assistant"}
DELETE, INSERT, REROLE = 3, 2, 2
END = (0, 4, 2, 0)  # after the last row: user and assistant, or the assistant alone, are still to be inserted
FAR = 1 << 40
INITIALS = "-sua"
BLANKS = " \t\n\x0b\x0c\r"


class Steps:
    """Transitions between cost vectors. Vectors are told apart up to a constant; the few that occur are numbered and
    each (vector, row kind) is worked out once, so that a row costs one look-up. A row kind is twice the place of its
    role's initial in INITIALS plus one if it is truncated."""

    def __init__(self):
        self.number: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.back: dict[tuple[int, int], tuple[int, int]] = {}
        self.acts: dict[tuple[int, int, int], tuple[str, int, int]] = {}

    def of(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """Number of the vector's shape, and the constant taken off."""
        low = min(vector)
        shape = tuple(FAR if v >= FAR // 2 else v - low for v in vector)
        if shape not in self.number:
            self.number[shape] = len(self.vectors)
            self.vectors.append(shape)
        return self.number[shape], low

    def costs(self, after: int, kind: int) -> tuple[int, ...]:
        """Costs before a row of the kind, by the costs after it."""
        to, late = self.vectors[after], kind % 2
        best = []
        for state in range(4):
            keep = KEEP_TO.get((state, INITIALS[kind // 2]))
            best.append(min(DELETE + to[state], REROLE + late + to[FORCED[state]], FAR if keep is None else late + to[keep]))
        user, assistant = min(best[USER], INSERT + best[ASSISTANT]), min(best[ASSISTANT], INSERT + best[USER])
        return min(best[START], INSERT + user), min(best[SYSTEM], INSERT + user), user, assistant

    def before(self, after: int, kind: int) -> tuple[int, int]:
        found = self.back.get((after, kind))
        if found is None:
            found = self.back[after, kind] = self.of(self.costs(after, kind))
        return found

    def act(self, after: int, kind: int, state: int) -> tuple[str, int, int]:
        """Edits up to and with a row of the kind, the state then, and their cost: of the cheapest ones the least letters."""
        found = self.acts.get((after, kind, state))
        if found is None:
            now, to, late = self.costs(after, kind), self.vectors[after], kind % 2
            edits, at, cost = "", state, 0
            while True:
                keep = KEEP_TO.get((at, INITIALS[kind // 2]))
                if now[at] == DELETE + to[at]:
                    edits, cost = edits + "D", cost + DELETE
                elif now[at] == INSERT + now[FORCED[at]]:
                    edits, cost, at = edits + "I", cost + INSERT, FORCED[at]
                    continue
                elif keep is not None and now[at] == late + to[keep]:
                    edits, cost, at = edits + "K", cost + late, keep
                else:
                    edits, cost, at = edits + "R", cost + REROLE + late, FORCED[at]
                break
            found = self.acts[after, kind, state] = edits, at, cost
        return found

    def sweep(self, kinds: list[int], end: tuple[int, ...]) -> tuple[list[int], int]:
        """Shape numbers after each row and before the first one, and the constant gathered on the way."""
        shape, total = self.of(end)
        out = [shape]
        for kind in reversed(kinds):
            shape, more = self.before(shape, kind)
            total += more
            out.append(shape)
        return out[::-1], total


_STEPS = Steps()


# --- damage ------------------------------------------------------------------------------------------------
def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, copies) after the deterministic damage of the contract: by the CRC-32 of
    `conv_id:turn` modulo 20 a row is dropped (0), emptied (1), loses its `.!?` (2), stands twice (3) or is a user's (4).
    Null roles and texts, and null ids and turns in that key, are one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.encode(F.concat(blank("conv_id"), F.lit(":"), blank("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), fate.alias("fate")).where("fate <> 0")
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       F.when(F.col("fate") == 3, 2).otherwise(1).alias("copies"))


# --- ordered, chunked rows --------------------------------------------------------------------------------------
def _ordered(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """Stored rows in order: equal rows collapse to one with their number before anything is sorted; ranges of the order,
    not conversations, are the partitions, so a conversation of any size is dealt over many tasks."""
    once = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    ranged = once.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    shown = F.rtrim("text", F.lit(BLANKS))
    initial = F.expr("CASE substring(role, 1, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END")
    kind = initial * 2 + (~F.right(shown, F.lit(1)).isin(".", "!", "?")).cast("int")
    placed = ranged.withColumns({"pos": F.monotonically_increasing_id(), "blank": shown == "", "kind": kind,
                                 "same": F.md5(F.concat_ws(":", F.length("role"), "role", "text"))})
    return kept(placed.withColumn("chunk", F.expr(f"pos div {chunk_rows}")), "turns")


def _marked(turns: DataFrame) -> DataFrame:
    """Stored narrow rows (conv_id, chunk, pos, kind, copies, blank, again): `again` if role and text stand earlier."""
    seen = turns.groupBy(F.col("conv_id").alias("__conv"), F.col("same").alias("__same")).agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1")
    narrow = turns.select("conv_id", "chunk", "pos", "kind", "copies", "blank", "same")
    joined = narrow.join(seen, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("same") == F.col("__same")), "left")
    return kept(joined.select("conv_id", "chunk", "pos", "kind", "copies", "blank", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)).alias("again")), "marks")


def _segments(table: pa.Table) -> tuple[dict[str, list], list[tuple[int, int]]]:
    """Columns of a chunk in order of place, and the ranges of rows of one conversation."""
    rows = table.sort_by("pos").to_pydict()
    conv = rows["conv_id"]
    cuts = [i for i in range(1, len(conv)) if conv[i] != conv[i - 1]]
    return rows, list(zip([0, *cuts], [*cuts, len(conv)]))


def _live(rows: dict[str, list], a: int, b: int) -> list[int]:
    return [k for k, blank, again in zip(rows["kind"][a:b], rows["blank"][a:b], rows["again"][a:b]) if not blank and not again]


def _first(table: pa.Table, column: str):
    return table.column(column)[0].as_py()


# --- stitching chunks ---------------------------------------------------------------------------------------------
def _speculated(table: pa.Table) -> pa.Table:
    """First and last segment of a chunk, run backwards as if their conversations ended there."""
    rows, parts = _segments(table)
    edge = sorted({0, len(parts) - 1})
    heads = [_STEPS.vectors[_STEPS.sweep(_live(rows, *parts[i]), END)[0][0]] for i in edge]
    conv = pa.array([rows["conv_id"][parts[i][0]] for i in edge], table.schema.field("conv_id").type)
    return pa.table({"conv_id": conv, "chunk": [rows["chunk"][0]] * len(edge), "last": [i == len(parts) - 1 for i in edge],
                     "used": [list(END)] * len(edge), "head": [list(h) for h in heads]})


def _rerun(table: pa.Table) -> pa.Table:
    """The last segment of a chunk from the vector that its successor begins with."""
    rows, parts = _segments(table)
    need = _first(table, "need")
    shapes, _ = _STEPS.sweep(_live(rows, *parts[-1]), tuple(need))
    return pa.table({"chunk": [rows["chunk"][0]], "used": [need], "head": [list(_STEPS.vectors[shapes[0]])]})


def _cost_matrix(table: pa.Table) -> pa.Table:
    """Costs from every state before a segment to every state after it, of the chunk's first and last segment."""
    rows, parts = _segments(table)
    edge = sorted({0, len(parts) - 1})
    out = []
    for i in edge:
        live, columns = _live(rows, *parts[i]), []
        for state in range(4):
            shapes, total = _STEPS.sweep(live, tuple(0 if s == state else FAR for s in range(4)))
            columns.append([v if v >= FAR else v + total for v in _STEPS.vectors[shapes[0]]])
        out.append([columns[t][s] for s in range(4) for t in range(4)])
    return pa.table({"chunk": [rows["chunk"][0]] * len(edge), "last": [i == len(parts) - 1 for i in edge], "m": out})


def _state_matrix(table: pa.Table) -> pa.Table:
    """Where the cheapest edits of a chunk's last segment lead from every state, as a matrix of 0 and FAR."""
    rows, parts = _segments(table)
    live = _live(rows, *parts[-1])
    shapes, _ = _STEPS.sweep(live, tuple(_first(table, "need")))
    out = [FAR] * 16
    for state in range(4):
        at = state
        for kind, after in zip(live, shapes[1:]):
            at = _STEPS.act(after, kind, at)[1]
        out[state * 4 + at] = 0
    return pa.table({"chunk": [rows["chunk"][0]], "m": [out]})


def _products(parts: DataFrame, longest: int, backward: bool) -> DataFrame:
    """(conv_id, idx, m): for every link of a chain the product of the matrices up to it (or from it on), least sum over
    the state between, in rounds that double the span. Each round is stored; no chain is gathered anywhere."""
    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine, other = (batch.column(i) for i in (2, 3))
            has = np.flatnonzero(other.is_valid().to_numpy(zero_copy_only=False))
            m = mine.flatten().to_numpy().reshape(-1, 4, 4).copy()
            if len(has):
                o = other.drop_null().flatten().to_numpy().reshape(-1, 4, 4)
                left, right = (m[has], o) if backward else (o, m[has])
                m[has] = np.minimum((left[:, :, :, None] + right[:, None, :, :]).min(axis=2), FAR)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, 16 * len(m) + 1, 16, dtype=np.int32)), pa.array(m.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["conv_id", "idx", "m"])

    conv = parts.schema["conv_id"].dataType.simpleString()
    step = 1
    while step < longest:
        other = parts.select(F.col("conv_id").alias("__conv"), (F.col("idx") + (-step if backward else step)).alias("__idx"), F.col("m").alias("o"))
        both = parts.join(other, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("idx") == F.col("__idx")), "left")
        parts = kept(both.select("conv_id", "idx", "m", "o").mapInArrow(multiply, f"conv_id {conv}, idx long, m array<long>"), "products")
        step *= 2
    return parts


def _stitched(marks: DataFrame, passes: int) -> DataFrame:
    """Stored (chunk, need, entry) of the chunks on whose borders a conversation goes on: `need`, the costs after the
    last segment if it continues in the next chunk, and `entry`, the state of the first one if it continues an earlier one."""
    conv = marks.schema["conv_id"].dataType.simpleString()
    along = Window.partitionBy("conv_id").orderBy("chunk")
    links = kept(marks.groupBy("chunk").applyInArrow(_speculated, f"conv_id {conv}, chunk long, last boolean, used array<long>, head array<long>"), "links")
    links = kept(links.withColumns({"idx": F.row_number().over(along).cast("long") - 1, "more": F.lead("chunk").over(along).isNotNull()}).where("more or idx > 0"), "links")
    longest = links.agg(F.max("idx")).first()[0]
    rows_of = lambda chunks: marks.join(chunks, "chunk")
    for _ in range(passes if longest else 0):
        needed = links.withColumn("need", F.lead("head").over(along))
        moved = kept(needed.where("more and need <> used").select("chunk", "need"), "moved")
        if moved.isEmpty():
            break
        new = rows_of(moved).groupBy("chunk").applyInArrow(_rerun, "chunk long, used array<long>, head array<long>")
        new = new.select("chunk", F.lit(True).alias("last"), F.col("used").alias("__used"), F.col("head").alias("__head"))
        links = kept(links.join(new, ["chunk", "last"], "left").select(
            "conv_id", "chunk", "last", F.coalesce("__used", "used").alias("used"), F.coalesce("__head", "head").alias("head"), "idx", "more"), "links")
    needed = kept(links.withColumn("need", F.lead("head").over(along)), "needs")
    if longest and not needed.where("more and need <> used").isEmpty():
        matrices = rows_of(links.select("chunk").distinct()).groupBy("chunk").applyInArrow(_cost_matrix, "chunk long, last boolean, m array<long>")
        spans = _products(links.join(matrices, ["chunk", "last"]).select("conv_id", "idx", "m"), longest + 1, backward=True)
        ends = F.array(*[F.least(*[F.get("m", F.lit(s * 4 + t)) + END[t] for t in range(4)]) for s in range(4)])
        heads = spans.select(F.col("conv_id").alias("__conv"), (F.col("idx") - 1).alias("__idx"), ends.alias("__head"))
        needed = kept(links.join(heads, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("idx") == F.col("__idx")), "left").select(
            "conv_id", "chunk", "last", "idx", "more", F.col("__head").alias("need")), "needs")
    going = needed.where("more").select("chunk", "need")
    states = rows_of(going).groupBy("chunk").applyInArrow(_state_matrix, "chunk long, m array<long>")
    exits = _products(kept(needed.where("more").join(states, "chunk").select("conv_id", "idx", "m"), "states"), longest or 0, backward=False)
    entry = exits.select(F.col("conv_id").alias("__conv"), (F.col("idx") + 1).alias("__idx"),
                         (F.array_position("m", F.lit(0).cast("long")) - 1).cast("int").alias("entry"))  # row of state START
    entered = needed.join(entry, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("idx") == F.col("__idx"))).select("chunk", "entry")
    return kept(going.join(entered, "chunk", "full"), "plan")


# --- tracing ---------------------------------------------------------------------------------------------------------
def _trace(turns: pa.Table, marks: pa.Table) -> pa.Table:
    """Edits and repaired rows of every segment of a chunk."""
    rows, parts = _segments(marks)
    words = turns.sort_by("pos").to_pydict()
    need, entry = _first(marks, "need"), _first(marks, "entry")
    out: dict[str, list] = {f: [] for f in ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns", "whole", "first", "last")}
    for p, (a, b) in enumerate(parts):
        goes_on, went_on = need is not None and p == len(parts) - 1, entry is not None and p == 0
        live = _live(rows, a, b)
        shapes, _ = _STEPS.sweep(live, tuple(need) if goes_on else END)
        state = entry if went_on else START
        audit, made, seen = [], [], 0
        blank = duplicate = truncated = illegal = cost = 0
        for i in range(a, b):
            kind, copies = rows["kind"][i], rows["copies"][i]
            illegal += copies - 1 + (i > a and illegal_pair(rows["kind"][i - 1], kind))
            dead = copies - 1
            if rows["blank"][i]:
                blank, dead = blank + copies, copies
            elif rows["again"][i]:
                duplicate, dead = duplicate + copies, copies
            else:
                duplicate += dead
                truncated += kind % 2
                edits, after, more = _STEPS.act(shapes[seen + 1], kind, state)
                seen, cost = seen + 1, cost + more
                audit.append(edits)
                for edit in edits:
                    state = FORCED[state] if edit in "IR" else state
                    if edit == "I":
                        made.append({"role": ROLE[state], "text": ""})
                    elif edit == "R":
                        made.append({"role": ROLE[state], "text": words["text"][i]})
                    elif edit == "K":
                        made.append({"role": words["role"][i], "text": words["text"][i]})
                state = after
            audit.append("D" * dead)
            cost += DELETE * dead
        while not goes_on and state in (SYSTEM, USER):
            state = FORCED[state]
            audit.append("I")
            made.append({"role": ROLE[state], "text": ""})
            cost += INSERT
        for f, v in zip(out, (blank, duplicate, truncated, illegal, cost, "".join(audit), made, not goes_on and not went_on, rows["kind"][a] // 2, rows["kind"][b - 1] // 2)):
            out[f].append(v)
    conv = pa.array([rows["conv_id"][a] for a, _ in parts], marks.schema.field("conv_id").type)
    made = pa.array(out.pop("turns"), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))
    return pa.table({"conv_id": conv, "chunk": [rows["chunk"][0]] * len(parts), **out, "turns": made})


def illegal_pair(before: int, kind: int) -> bool:
    return INITIALS[before // 2] + INITIALS[kind // 2] not in ("su", "ua", "au")


def repair(rows: DataFrame, chunk_rows: int = 2_048, passes: int = 3) -> DataFrame:
    """Repaired pieces of conversations: (conv_id, chunk, whole, blank, duplicate, truncated, illegal, cost, audit, turns, ...).

    `rows` has conv_id, turn, role, text and copies (equal adjacent rows); other columns are ignored. Rows go by turn, nulls
    first, then by role and text; a null conversation id is a conversation like any other; role and text must not be null.
    A piece holds the rows of a conversation in one chunk of `chunk_rows` distinct rows (a divisor of 2**33); `chunk` orders
    the pieces, `whole` says that there is only one. `turns` are the repaired rows, `audit` the initials of the edits: Keep,
    Rerole (2), Delete (3), Insert (2), truncated rows that stay add 1; blank rows and those whose role and text stand
    earlier must go. Empty tables give an empty result. A task holds one chunk, however long a conversation is.
    """
    turns = _ordered(rows, chunk_rows)
    marks = _marked(turns)
    plan = _stitched(marks, passes)
    conv = turns.schema["conv_id"].dataType.simpleString()
    schema = f"""conv_id {conv}, chunk long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, whole boolean,
                 first long, last long, turns array<struct<role:string,text:string>>"""
    guided = marks.join(plan, "chunk", "left")
    pieces = turns.select("chunk", "pos", "role", "text").groupBy("chunk").cogroup(guided.groupBy("chunk")).applyInArrow(_trace, schema)
    return kept(pieces, "pieces")


def _stream_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order; only the running digest is held."""
    conv, digest, begun = None, None, False
    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for c, n, body in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
            if digest is None or c != conv:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["__conv", "streamed"])
                conv, digest, begun = c, hashlib.sha256(), False
            if n:
                digest.update(("\n" if begun else "").encode() + body.encode())
                begun = True
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["__conv", "streamed"])


def repair_report(conversations: DataFrame, rows: DataFrame, chunk_rows: int = 2_048, passes: int = 3) -> DataFrame:
    """One row per conversation id of `conversations`: what `repair` found and did in `rows`, its damaged rows.

    Columns conv_id, gaps (turns missing between the least and the largest; null turns count as none), blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256 (of `role:text`, one row per line). Conversations without rows have
    zeros, an empty audit and the digest of the empty string. A digest is sequential, so the texts of a conversation of
    several chunks pass one task, as a stream of pieces that holds one batch; all others are digested where they lie.
    """
    pieces = repair(rows, chunk_rows, passes)
    along = Window.partitionBy("conv_id").orderBy("chunk")
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    pair = F.concat(_initial(F.lag("last").over(along)), _initial(F.col("first")))
    small = pieces.withColumns({"border": F.when(F.lag("last").over(along).isNotNull() & ~pair.isin("su", "ua", "au"), 1).otherwise(0)})
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "audit"))), lambda p: p["audit"]), "")
    found = small.drop("turns").groupBy(F.col("conv_id").alias("__conv")).agg(*sums, F.sum(F.col("illegal") + F.col("border")).alias("illegal"), audit.alias("audit"))
    whole = pieces.where("whole").select(F.col("conv_id").alias("__conv"), F.sha2(body, 256).alias("streamed"))
    parts = pieces.where("not whole").select("conv_id", "chunk", F.size("turns").alias("n"), body.alias("body"))
    conv = pieces.schema["conv_id"].dataType.simpleString()
    streamed = parts.repartition("conv_id").sortWithinPartitions("conv_id", "chunk").mapInArrow(_stream_digest, f"__conv {conv}, streamed string")
    digests = whole.unionByName(streamed)
    spans = rows.groupBy(F.col("conv_id").alias("__conv")).agg(F.expr(
        "try_cast(cast(max(turn) as decimal(20,0)) - cast(min(turn) as decimal(20,0)) + 1 - count(distinct turn) as bigint)").alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for side in (found, digests, spans):
        out = out.join(side, F.col("conv_id").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select("conv_id", *map(number, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("streamed", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _initial(place: Column) -> Column:
    return F.substring(F.lit(INITIALS), (place + 1).cast("int"), F.lit(1))
