"""SimHash near-duplicates: fingerprints, bit-sliced comparison inside keyed blocks, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, map_batches, releasing
from .graph import components, join_labels

_ALL = np.uint64(2**64 - 1)


def fingerprint(text: str | None, words: int, seed: int) -> int:
    """64-bit SimHash of the word shingles; a bit is set if it is set in over half of the shingle hashes."""
    found = (text or "").encode().lower().split()  # on bytes: only A-Z changes, only \x20 and \x09-\x0D separate
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at:at + 65_536].astype("<u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint of every whole text as a signed 64-bit number."""
    def run(columns):
        prints = np.array([fingerprint(t, words, seed) for t in columns[1]], np.uint64).view(np.int64)
        return [columns[0], prints]
    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, [id_col, text_col], f"`{id_col}` {kind}, fp bigint")


def near_in_blocks(prints: np.ndarray, end: np.ndarray, radius: int, at_once: int = 32_768) -> np.ndarray:
    """Label of each row: the smallest row it is linked to through prints of its block that differ in at most `radius`
    bits. Rows of a block are adjacent, `end[i]` is the row after the block of row i.

    Bit planes are stored vertically, 64 rows a word. A step compares many (row, word) pairs: each plane's differences
    are added to carry-save counters for all 64 rows of a word at a time, and words in which every row is beyond the
    radius leave. Words whose rows all carry the row's own label are not compared at all.
    """
    n = len(prints)
    words = -(-n // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[:n] = prints
    one = np.uint64(1)
    planes = np.stack([np.packbits(((padded >> np.uint64(j)) & one).astype(np.uint8), bitorder="little").view("<u8") for j in range(64)])
    bits = max(1, int(radius).bit_length())
    offset = (1 << bits) - 1 - radius  # counters start here and overflow beyond the radius
    label = np.arange(n)
    row = np.arange(n)
    first, spans = row >> 6, ((np.maximum(end, 1) - 1) >> 6) - (row >> 6) + 1
    spans[end - row <= 1] = 0
    cut = np.cumsum(spans)
    at, size = 0, 64
    while at < n:
        stop = max(at + 1, int(np.searchsorted(cut, (cut[at - 1] if at else 0) + size, "right")))
        size = min(at_once, size * 2)
        q = np.repeat(row[at:stop], spans[at:stop])
        if len(q):
            ahead = np.cumsum(spans[at:stop]) - spans[at:stop]
            w = np.arange(len(q)) - np.repeat(ahead, spans[at:stop]) + first[q]
            full = np.concatenate([label, np.full(words * 64 - n, -1)]).reshape(-1, 64)
            low, high = full.min(1), full.max(1)
            open_ = (low[w] != high[w]) | (low[w] != label[q])
            q, w = q[open_], w[open_]
        at = stop
        if not len(q):
            continue
        own = prints[q]
        counter = [np.full(len(q), _ALL if offset >> k & 1 else 0, np.uint64) for k in range(bits)]
        over = np.zeros(len(q), np.uint64)
        for j in range(64):
            carry = planes[j][w] ^ (np.uint64(0) - ((own >> np.uint64(j)) & one))
            for k in range(bits):
                counter[k], carry = counter[k] ^ carry, counter[k] & carry
            over |= carry
            if j % 8 == 7:
                live = over != _ALL
                if live.mean() < 0.75:
                    q, w, own, over, counter = q[live], w[live], own[live], over[live], [c[live] for c in counter]
                    if not len(q):
                        break
        hit = np.flatnonzero(over != _ALL)
        if not len(hit):
            continue
        near = np.unpackbits((~over[hit]).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        which, bit = np.nonzero(near)
        a, b = q[hit][which], w[hit][which] * 64 + bit
        real = (b > a) & (b < end[a])
        label = join_labels(label, a[real], b[real])
    return label


def _blocks(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of radius + 2 bit blocks; two prints within the radius agree on two of them at least."""
    edges = np.linspace(0, 64, radius + 3).round().astype(int)
    return [(int(a), int(b - a)) for a, b in zip(edges, edges[1:])]


def near_links(prints: DataFrame, radius: int = 3, most: int = 4_096) -> DataFrame:
    """Links (a, b) that span the components of distinct prints (column fp) within `radius` bits.

    Prints meet under keys of two equal blocks out of radius + 2, so that none is missed. A key with more than `most`
    prints is dealt into parts and every pair of parts meets in a task of its own: exact, and no task holds more than two
    parts at once. A task sends one link per print and key at most, never the pairs."""
    blocks = _blocks(radius)
    part = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1)) for a, w in blocks]
    keys = F.array(*[F.lit(i << 58).bitwiseOR(F.shiftleft(part[a], 29)).bitwiseOR(part[b])
                     for i, (a, b) in enumerate(combinations(range(len(blocks)), 2))])
    keyed = kept(prints.select("fp", F.explode(keys).alias("key")), "keyed")
    shared = keyed.groupBy("key").count().where("count > 1")
    parts = F.ceil(F.col("count") / most).cast("int")
    mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
    dealt = keyed.join(shared.withColumn("parts", parts), "key").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("fp", "key", F.least("mine", "other").alias("p1"), F.greatest("mine", "other").alias("p2"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        rows = 0

        def links(f: pd.DataFrame) -> pd.DataFrame:
            prints = f["fp"].to_numpy(np.int64)
            same = (f["key"].to_numpy()[1:] == f["key"].to_numpy()[:-1]) & (f["p1"].to_numpy()[1:] == f["p1"].to_numpy()[:-1]) & (f["p2"].to_numpy()[1:] == f["p2"].to_numpy()[:-1])
            start = np.flatnonzero(np.concatenate([[True], ~same]))
            end = np.repeat(np.append(start[1:], len(f)), np.diff(np.append(start, len(f))))
            label = near_in_blocks(prints.view(np.uint64), end, radius)
            to = np.flatnonzero(label != np.arange(len(f)))
            return pd.DataFrame({"a": prints[label[to]], "b": prints[to]})

        for f in frames:
            held.append(f)
            rows += len(f)
            if rows >= 60_000:  # work on whole blocks; the last, open one waits for its other rows
                f = pd.concat(held, ignore_index=True)
                last = f.iloc[-1]
                open_ = ((f["key"] == last["key"]) & (f["p1"] == last["p1"]) & (f["p2"] == last["p2"])).to_numpy()
                if not open_.all():
                    yield links(f[~open_])
                    f = f[open_]
                held, rows = [f], len(f)
        if rows:
            yield links(pd.concat(held, ignore_index=True))

    return (dealt.repartition("key", "p1", "p2").sortWithinPartitions("key", "p1", "p2").mapInPandas(releasing(run), "a bigint, b bigint").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id), one row per input row: the smallest id reachable over links of `radius` bits or fewer.

    Texts with equal fingerprints collapse first, so that copies cost one row however many there are; only distinct
    fingerprints are compared. A null or empty text has fingerprint zero and links like any other. A text of fewer words
    than a shingle is one shingle. A null id stays null and is no candidate for the smallest id (a component of null ids
    alone has a null component_id); repeated rows are each returned; other columns are left aside; an empty table gives
    an empty result.
    """
    marked = kept(fingerprints(docs, words, seed, id_col, text_col), "prints")
    distinct = kept(marked.groupBy("fp").agg(F.min(id_col).alias("least")), "distinct")
    found = components(near_links(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    classes = kept(distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("class")), "classes")
    smallest = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    placed = kept(classes.join(smallest, "class").select("fp", "component_id"), "placed")
    return marked.join(placed, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
