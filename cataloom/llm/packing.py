"""Packing of tokenised documents into fixed sequences by cutting-stock column generation.

Documents are cut at multiples of the sequence length; the pieces' lengths form a histogram of bounded size.
A linear program over packing patterns is solved by column generation (a knapsack dynamic program prices new
patterns), its solution is rounded down to whole patterns, what is left is packed best fit, and the pieces,
ranked inside their length class, take the slots of the patterns.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import byte_bpe
from .common import kept, map_batches, rank_within, releasing
from .tokens import vocabulary


def best_pattern(sizes: np.ndarray, worth: np.ndarray, room: int) -> np.ndarray:
    """Unbounded knapsack: the counts of each size that are worth most within `room`. Sizes ascend."""
    value, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        n = np.searchsorted(sizes, c, "right")
        value[c] = value[c - 1]
        if n:
            options = value[c - sizes[:n]] + worth[:n]
            k = int(options.argmax())
            if options[k] > value[c]:
                value[c], pick[c] = options[k], k
    counts, c = np.zeros(len(sizes)), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            counts[pick[c]] += 1
            c -= sizes[pick[c]]
    return counts


def pattern_mix(sizes: np.ndarray, demand: np.ndarray, room: int, rounds: int = 6_000, close: float = 5e-4, smooth: float = 0.8) -> tuple[np.ndarray, np.ndarray]:
    """Linear program min sum(x), patterns @ x = demand, by column generation from one-size patterns.
    Prices are smoothed towards size / room, the prices of a mix without waste. Stops when no pattern is
    better by `close`, or when the mix is that near to the bound that all room is used."""
    columns = np.diag((room // sizes).astype(float))
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    for _ in range(rounds):
        if x.sum() <= (1 + close) * (sizes @ demand) / room:
            break
        worth = inverse.sum(0)
        for weight in (smooth, 0.0):
            new = best_pattern(sizes, weight * sizes / room + (1 - weight) * worth, room)
            if worth @ new > 1 + close:
                break
        else:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        step = max(0.0, ratio[out])
        x = x - step * direction
        x[out] = step
        columns[:, out] = new
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
    return columns, np.maximum(x, 0)


def whole_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[int, dict[int, int]]]:
    """(times, {index of size: count}) with every piece in exactly one pattern: the rounded mix, then best fit."""
    if not len(sizes):
        return []
    columns, x = pattern_mix(sizes, demand.astype(float), room)
    times = np.floor(x + 1e-7).astype(np.int64)
    left = demand.astype(np.int64).copy()
    plan = []
    for p in np.argsort(-times, kind="stable"):
        need = columns[:, p].astype(np.int64)
        used = np.flatnonzero(need)
        n = int(min(times[p], (left[used] // need[used]).min()))
        if n > 0:
            left[used] -= n * need[used]
            plan.append((n, {int(i): int(need[i]) for i in used}))
    open_: dict[int, list[dict[int, int]]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        for _ in range(int(left[i])):
            fits = min((c for c, v in open_.items() if c >= sizes[i] and v), default=None)
            held = open_[fits].pop() if fits is not None else {}
            held[i] = held.get(i, 0) + 1
            open_.setdefault(int((room if fits is None else fits) - sizes[i]), []).append(held)
    return plan + [(1, held) for v in open_.values() for held in v]


def slot_table(patterns: list[tuple[int, dict[int, int]]], classes: int) -> dict[str, np.ndarray]:
    """For the pieces numbered class after class: where each run of numbers ends, and its pattern's slots."""
    rows, sequence = [], 0
    for times, held in patterns:
        slot = 0
        for i, n in sorted(held.items(), reverse=True):
            rows.append((i, times * n, n, sequence, slot))
            slot += n
        sequence += times
    rows.sort(key=lambda r: (r[0], r[3]))
    table = np.array(rows, np.int64).reshape(-1, 5)
    ends = np.cumsum(table[:, 1])
    totals = np.bincount(table[:, 0], table[:, 1], minlength=classes).astype(np.int64)
    return {"end": ends, "start": ends - table[:, 1], "each": table[:, 2], "sequence": table[:, 3], "slot": table[:, 4], "first": np.cumsum(totals) - totals}


def cut_documents(docs: DataFrame, path: str, room: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): whole sequences first, then the rest of each document."""
    def run(columns):
        out = [[], [], [], [], []]
        close = np.array([end_id], "<u4").tobytes()
        for doc, data in zip(columns[0], byte_bpe(path).encode(columns[1])):
            data += close
            total = len(data) // 4
            for at in range(0, total, room):
                piece = data[at * 4:(at + room) * 4]
                for column, value in zip(out, (doc, at, len(piece) // 4, zlib.crc32(piece), total)):
                    column.append(value)
        return out

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, [id_col, text_col], f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(docs: DataFrame, path: str | None = None, room: int = 2048, width: int = 8, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most `room` ids, one row per piece:
    (id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    Every document is its ids and `end_id`; a null or empty text is the end id alone. Lengths are classed in
    steps of `width`, so that the plan has at most room / width classes whatever the input is, and a sequence
    wastes fewer than `width` ids a piece plus what the pattern leaves. Only the histogram reaches the driver.
    A class that holds any share of all pieces is ranked in salted parts. Repeated rows are packed each; null
    ids stay null; other columns are left aside; an empty table gives no pieces.
    """
    path = path or vocabulary()
    if room % width:
        raise ValueError("width must divide room")
    pieces = kept(cut_documents(docs, path, room, end_id, id_col, text_col), "pieces")
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / width).cast("int"))
    counts = {r["class"]: r["count"] for r in pieces.groupBy("class").count().collect()}  # at most room / width rows
    classes = np.array(sorted(counts), np.int64)
    demand = np.array([counts[c] for c in classes], np.int64)
    table = slot_table(whole_patterns(classes, demand, room // width), len(classes))
    ranked = rank_within(pieces, "class", ["length", id_col, "start", "ids_crc32"], int(demand.sum()))

    def place(frames):
        for f in frames:
            number = table["first"][np.searchsorted(classes, f["class"])] + f["rank"].to_numpy()
            row = np.searchsorted(table["end"], number, "right")
            inside = number - table["start"][row]
            yield f.drop(columns=["class", "rank"]).assign(sequence_id=table["sequence"][row] + inside // table["each"][row],
                                                           slot=table["slot"][row] + inside % table["each"][row])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, slot bigint"
    placed = ranked.mapInPandas(releasing(place), schema)
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")
