"""Line deduplication as an exact set-similarity join with prefix, positional and length filters."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .anchors import mixed
from .common import by_size, forget_since, kept, made_so_far, marked_rows, releasing

BUCKETS = 1 << 20  # of the rarity table, whatever the corpus: 4 MB
_LAST = 2**63 - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
ROW = [("token", np.uint64), ("bits", np.uint64), ("doc", np.int64), ("twin", np.int64), ("line", np.uint32), ("size", np.uint32), ("at", np.uint32)]
PACKED = [*ROW, ("whole", np.uint64)]
PLACED = "doc bigint, twin bigint"
PLACE = f"{PLACED}, line bigint"


def placed_texts(docs: DataFrame, id_col: str, text_col: str, *more: str, twins: bool = True) -> DataFrame:
    """(doc, twin, text): the place of a row is its id (null: last), then a hash of its text; equal rows are one document.
    Without `twins` the id alone is the place, for tables in which no id has two texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc"),
                       (F.xxhash64(text) if twins else F.lit(0).cast("bigint")).alias("twin"), text.alias("text"), *more)


def has_twins(docs: DataFrame, id_col: str, text_col: str) -> bool:
    """Whether an id has two different texts; only texts of repeated ids are read."""
    place = F.coalesce(F.col(id_col).cast("bigint"), F.lit(_LAST)).alias("doc")
    repeated = kept(docs.select(place).groupBy("doc").count().where("count > 1").select("doc"), "repeated_ids")
    if repeated.isEmpty():
        return False
    texts = placed_texts(docs, id_col, text_col).join(repeated, "doc", "left_semi").groupBy("doc").agg(F.min("twin").alias("first"), F.max("twin").alias("last"))
    return not texts.where("first < last").isEmpty()


def packed_texts(texts: DataFrame) -> DataFrame:
    """The same with compressed texts, for a shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(t) for _, part in parts_of(b.column(2)) for t in part], pa.binary())],
                                             names=["doc", "twin", "text"])
    return texts.mapInArrow(releasing(run), "doc bigint, twin bigint, text binary")


def parts_of(texts: pa.Array, most: int = 300_000) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts) of parts of a column with about `most` bytes; only one part at a time is held as Python objects."""
    np.empty(8 << 20, np.uint8)  # freed at once: from then on the allocator keeps up to twice as much for the next part, instead of giving each array back
    for at, rows in by_size(pc.binary_length(texts), most):
        yield at, [t or b"" for t in texts.slice(at, rows).cast(pa.binary()).to_pylist()]


def chunks(batch: pa.RecordBatch, most: int = 300_000) -> Iterator[tuple[np.ndarray, np.ndarray, list[bytes]]]:
    """(doc, twin, texts) of a batch in parts of about `most` bytes."""
    doc, twin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    for at, texts in parts_of(batch.column(2), most):
        yield doc[at:at + len(texts)], twin[at:at + len(texts)], texts


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[begin[i] : end[i]], eight bytes at a time; the same for equal bytes wherever they lie."""
    words = np.ndarray(len(data) + 1, np.uint64, np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))  # the eight bytes from each place on
    left = end - begin
    h = mixed(mixed(left.astype(np.uint64)) ^ (words[begin] & _MASKS[np.minimum(left, 8)]))
    rest, at = np.flatnonzero(left > 8), 8
    while len(rest):
        h[rest] = mixed(h[rest] ^ (words[begin[rest] + at] & _MASKS[np.minimum(left[rest] - at, 8)]))
        at += 8
        rest = rest[left[rest] > at]
    return mixed(h)


def token_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and line of every token of the texts, lines numbered through; and the number of lines of each text."""
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    space = np.ones(len(data) + 2, bool)
    space[1:-1] = _SPACE[data]
    edge = np.flatnonzero(space[1:] != space[:-1])  # a token begins and ends by turns
    begin, end = edge[::2], edge[1::2]
    before = np.searchsorted(begin, np.flatnonzero(data == 10))  # tokens before each line feed
    return word_hashes(data, begin, end), np.repeat(np.arange(len(before) + 1), np.diff(before, prepend=0, append=len(begin))), lines


def rarity_table(docs: DataFrame, text_col: str) -> np.ndarray:
    """Occurrences of hashed tokens over all texts, in a table of fixed size; summed in parts on the executors."""
    parts, width = 64, BUCKETS // 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(BUCKETS, np.int64), []
        for b in batches:
            for _, texts in parts_of(b.column(0)):
                seen.append((token_hashes(texts)[0] >> np.uint64(44)).astype(np.int32))
                if sum(map(len, seen)) >= BUCKETS:
                    total += np.bincount(np.concatenate(seen), minlength=BUCKETS)
                    seen.clear()
        total += np.bincount(np.concatenate([np.zeros(0, np.int32), *seen]), minlength=BUCKETS)
        press = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([press.compress(total[i * width:(i + 1) * width].tobytes()) for i in range(parts)], pa.binary())],
                                         names=["part", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[part] = sums.get(part, 0) + np.frombuffer(zstandard.decompress(data), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(v, 2**32 - 1).astype(np.uint32).tobytes() for v in sums.values()], pa.binary())],
                                         names=["part", "data"])

    rows = docs.select(text_col).mapInArrow(releasing(count), "part int, data binary").repartition("part").mapInArrow(releasing(add), "part int, data binary").collect()
    table = np.zeros((parts, width), np.uint32)
    for r in rows:  # 64 rows of 64 KB
        table[r["part"]] = np.frombuffer(r["data"], np.uint32)
    return table.ravel()


def wide_words(size: np.ndarray) -> np.ndarray:
    """64-bit words of the wide bitmap of a set: none up to 112 tokens, then 4, 16, 64, ... as the size quadruples."""
    words, limit = np.where(size > 112, 4, 0), 448
    while (size > limit).any():
        words, limit = np.where(size > limit, words * 4, words), limit * 4
    return words


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions begin[i] .. begin[i] + size[i] - 1 of all i, one after the other."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def in_runs(v: np.ndarray) -> np.ndarray:
    """Which of the sorted values occur more than once."""
    same = np.concatenate([[False], v[1:] == v[:-1], [False]])
    return same[1:len(v) + 1] | same[:len(v)]


def rarest_first(token: np.ndarray, rarity: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Order by line, rarity (to seven binary digits), the last 44 bits of the token and the token; lines are sorted. One
    number holds the line, the rarity, as much of the token as there is room for, and the place; what there is no room for
    is compared only where tokens agree in the rest."""
    if not len(line):
        return np.zeros(0, np.int64)
    rarity, last = rarity.astype(np.float32).view(np.uint32) >> np.uint32(16), token << np.uint64(20)
    places = np.uint64(len(line).bit_length())
    room = 48 - int(line[-1]).bit_length() - int(places)
    if room < 1:
        return np.lexsort((token, last, rarity, line))
    key = ((line.astype(np.uint64) << np.uint64(16)) | rarity) << np.uint64(room) | last >> np.uint64(64 - room)
    key = np.sort(key << places | np.arange(len(key), dtype=np.uint64))
    order = (key & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    key, tokens = key >> places, token[order]
    if ((key[1:] == key[:-1]) & (tokens[1:] != tokens[:-1])).any():
        tied = np.flatnonzero(in_runs(key))
        rows = order[tied]
        order[tied] = rows[np.lexsort((token[rows], last[rows], key[tied]))]
    return order


def line_sets(texts: list[bytes], table: np.ndarray, asked: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Token sets of the lines that have tokens, rarest token first; with `asked`, of the lines that hold a token whose
    bucket of the rarity table is marked there."""
    token, line, lines = token_hashes(texts)
    bucket = (token >> np.uint64(44)).astype(np.int64)
    if asked is not None:
        held = np.zeros(int(lines.sum()), bool)
        held[line[asked[bucket]]] = True
        token, bucket, line = token[held[line]], bucket[held[line]], line[held[line]]
    order = rarest_first(token, table[bucket], line)
    token, line = token[order], line[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (line[1:] != line[:-1])
    token, line = token[fresh], line[fresh]
    start = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(token)))
    text = np.repeat(np.arange(len(texts)), lines)
    number = np.arange(lines.sum()) - np.repeat(np.cumsum(lines) - lines, lines)
    at = line[start]
    words = wide_words(size)
    wide = np.zeros(words.sum(), np.uint64)
    long = np.flatnonzero(words)
    of_long = token[ragged(start[long], size[long])]
    place = np.repeat((np.cumsum(words) - words)[long], size[long]) + ((of_long >> np.uint64(6)) & np.repeat((words[long] - 1).astype(np.uint64), size[long])).astype(np.int64)
    np.bitwise_xor.at(wide, place, np.uint64(1) << (of_long & np.uint64(63)))
    return {"wide": wide, "token": token, "start": start, "size": size, "text": text[at], "line": number[at],
            "bits": np.bitwise_xor.reduceat(np.uint64(1) << (token & np.uint64(63)), start) if len(start) else np.zeros(0, np.uint64),
            "whole": np.add.reduceat(mixed(token), start) if len(start) else np.zeros(0, np.uint64)}


def prefix_length(size: np.ndarray, share: float) -> np.ndarray:
    return size - np.ceil(share * size - 1e-9).astype(np.int64) + 1


def _pack(rows: dict[str, np.ndarray], buckets: int, removed: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Column blobs by bucket of the token, from columns of lines and the line (`own`), token and place (`at`) of each row;
    lines that are settled already come along in buckets below 0."""
    press = zstandard.ZstdCompressor(level=1)
    bucket = ((rows["token"] >> np.uint64(20)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    places = np.uint64(len(bucket).bit_length())
    order = np.sort(rows["token"] >> places << places | np.arange(len(bucket), dtype=np.uint64))  # by all of the token that leaves room for the place
    order = (order & ((np.uint64(1) << places) - np.uint64(1))).astype(np.int64)
    order = order[np.argsort(bucket[order], kind="stable")]
    bucket = bucket[order].astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    names, blobs = bucket[first], []
    for a, b in zip(first, [*first[1:], len(bucket)]):
        use = order[a:b]
        own = rows["own"][use]
        bits = rows["wide"][ragged(rows["wide_at"][own], wide_words(rows["size"][own]))]
        blobs.append(press.compress(b"".join([*((rows[k][use] if k in ("token", "at") else rows[k][own]).astype(t, copy=False).tobytes() for k, t in PACKED), bits.tobytes()])))
    counts = np.diff([*first, len(bucket)]).tolist()
    if len(removed["doc"]):
        names, counts = [*names.tolist(), -1 - int(removed["doc"][0] % buckets)], [*counts, len(removed["doc"])]
        blobs.append(press.compress(b"".join(removed[k].astype(np.int64).tobytes() for k in ("doc", "twin", "line"))))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "rows", "data"])


def prefixes(texts: DataFrame, table: np.ndarray, share: float, buckets: int, flush: int = 120_000, flush_rows: int = 400_000) -> DataFrame:
    """Packed prefix rows of all lines. Lines with the same set as an earlier one settle there, so that a line in any share
    of all documents leaves one set per `flush` lines or `flush_rows` prefix rows of a task; no more is held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []

        def out() -> pa.RecordBatch:
            lines = {k: np.concatenate([h[k] for h in held]) for k in ("doc", "twin", "line", "size", "bits", "whole", "token", "wide")}
            held.clear()
            words = wide_words(lines["size"])
            lines["wide_at"] = np.cumsum(words) - words
            rows = prefix_length(lines["size"], share)
            begin = np.cumsum(rows) - rows
            order = np.lexsort((lines["line"], lines["twin"], lines["doc"], lines["size"], lines["bits"], lines["whole"]))
            again, other = np.zeros(len(order), bool), np.zeros(len(order), bool)
            for k in ("whole", "bits", "size"):
                v = lines[k][order]
                again[1:] = (v[1:] == v[:-1]) & (again[1:] if k != "whole" else True)
            for k in ("doc", "twin", "line"):
                v = lines[k][order]
                other[1:] |= v[1:] != v[:-1]
            removed = {k: lines[k][order[again & other]] for k in ("doc", "twin", "line")}
            stay = np.sort(order[~again])
            n = rows[stay]
            return _pack(lines | {"own": np.repeat(stay, n), "token": lines["token"][ragged(begin[stay], n)], "at": ragged(np.zeros(len(n), np.int64), n)}, buckets, removed)

        for b in batches:
            for doc, twin, part in chunks(b):
                s = line_sets(part, table)
                held.append({"doc": doc[s["text"]], "twin": twin[s["text"]], "token": s["token"][ragged(s["start"], prefix_length(s["size"], share))],
                             **{k: s[k] for k in ("line", "size", "bits", "whole", "wide")}})
                if sum(len(h["doc"]) for h in held) >= flush or sum(len(h["token"]) for h in held) >= flush_rows:
                    yield out()
        if held:
            yield out()

    return texts.mapInArrow(releasing(run), "bucket int, rows bigint, data binary")


def may_match(r: dict, i: np.ndarray, j: np.ndarray, share: float) -> np.ndarray:
    """Length, positional and bitmap filters for rows i and j of one token; a similar pair passes them at its first common
    token. Two sets differ in at least as many tokens as their parity bitmaps differ in bits; wide bitmaps are folded to
    the narrower one's width."""
    na, nb = r["size"][i].astype(np.int64), r["size"][j].astype(np.int64)
    need = np.ceil(share / (1 + share) * (na + nb) - 1e-9)
    ok = (np.minimum(na, nb) >= share * np.maximum(na, nb) - 1e-9) & (1 + np.minimum(na - 1 - r["at"][i], nb - 1 - r["at"][j]) >= need)
    ok &= np.bitwise_count(r["bits"][i] ^ r["bits"][j]) <= na + nb - 2 * need
    both = np.minimum(r["words"][i], r["words"][j])
    left = np.flatnonzero(ok & (both > 0))
    for width in np.unique(both[left]):
        k = left[both[left] == width]
        apart = _folded(r, i[k], width) ^ _folded(r, j[k], width)
        ok[k] = np.bitwise_count(apart).sum(1, dtype=np.int64) <= na[k] + nb[k] - 2 * need[k]
    return ok


def _folded(r: dict, i: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(i), width), np.uint64)
    for words in np.unique(r["words"][i]):
        k = np.flatnonzero(r["words"][i] == words)
        bits = r["wide"][r["wide_at"][i[k], None] + np.arange(words)[None, :]]
        out[k] = np.bitwise_xor.reduce(bits.reshape(len(k), words // width, width), axis=1)
    return out


def candidates(packed: DataFrame, share: float, buckets: int, small: int = 128, first: int = 16) -> DataFrame:
    """(b_*, a_*, more): lines settled before or by an equal set of another task, with no a, and later lines with earlier lines that pass the filters. Of equal
    sets only the first is compared, so that a line in any share of all documents is one row of its groups. In a token group of more than `small` rows a line stops after its `first` earliest ones and is marked, for `remaining` to go on with it if none of them matches."""
    def pairs(r: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        n = len(r["token"])
        start = np.flatnonzero(np.concatenate([[True], r["token"][1:] != r["token"][:-1]]))
        size = np.diff(np.append(start, n))
        end = np.repeat(start + size, size)
        light = np.repeat(size <= small, size)
        row = np.flatnonzero(light & (end - np.arange(n) > 1))
        step = 1
        while len(row):
            ok = may_match(r, row, row + step, share)
            yield row[ok], row[ok] + step, np.zeros(int(ok.sum()), bool)
            step += 1
            row = row[row + step < end[row]]
        for s, g in zip(start[size > small], size[size > small]):  # earliest rows first, in growing blocks; rows with enough leave
            open_, found = np.arange(s, s + g), np.zeros(g, np.int64)
            at, width = s, 16
            while at < s + g and len(open_):
                stop = min(s + g, at + width)
                for lo in range(0, len(open_), max(1, 2_000_000 // (stop - at))):
                    later = open_[lo:lo + max(1, 2_000_000 // (stop - at))]
                    j, i = (x.ravel() for x in np.meshgrid(later, np.arange(at, stop), indexing="ij"))
                    ok = i < j
                    i, j = i[ok], j[ok]
                    ok = may_match(r, i, j, share)
                    i, j = i[ok], j[ok]
                    order = np.lexsort((i, j))
                    i, j = i[order], j[order]
                    new = np.concatenate([[True], j[1:] != j[:-1]]) if len(j) else np.zeros(0, bool)
                    nth = np.arange(len(j)) - np.maximum.accumulate(np.where(new, np.arange(len(j)), 0)) + found[j - s] if len(j) else j
                    np.add.at(found, j - s, 1)
                    take = nth < first
                    yield i[take], j[take], found[j[take] - s] >= first
                at, width = stop, width * 2
                open_ = open_[(open_ >= at) & (found[open_ - s] < first)]

    names = ["b_doc", "b_twin", "b_line", "a_doc", "a_twin", "a_line", "more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        now = None

        def close() -> pa.RecordBatch:
            r = {k: np.concatenate([h[k] for h in held]) for k, _ in PACKED}
            r["words"] = wide_words(r["size"])
            r["wide_at"] = np.cumsum(r["words"]) - r["words"]
            key = mixed(r["token"]) + r["whole"]  # equal sets have equal keys under a token; rows of other keys need no comparison
            order = np.argsort(key)
            alone = in_runs(key[order])
            alone, order = order[~alone], order[alone]
            order = order[np.lexsort(tuple(r[k][order] for k in ("line", "twin", "doc", "bits", "size", "whole", "token")))]
            again, other = np.zeros(len(order), bool), np.zeros(len(order), bool)  # equal sets meet under each of their tokens
            again[1:] = np.logical_and.reduce([r[k][order[1:]] == r[k][order[:-1]] for k in ("token", "whole", "size", "bits")])
            other[1:] = np.logical_or.reduce([r[k][order[1:]] != r[k][order[:-1]] for k in ("doc", "twin", "line")])
            equal = order[again & other & (r["at"][order] == 0)]
            settled = [r[k][equal].astype(np.int64) for k in ("doc", "twin", "line")]
            order = np.concatenate([alone, order[~again]])
            order = order[np.argsort(r["token"][order])]
            order = order[in_runs(r["token"][order])]  # a token of one line makes no pair
            order = order[np.lexsort(tuple(r[k][order] for k in ("line", "twin", "doc", "token")))]
            r = {k: v[order] for k, v in r.items()} | {"wide": np.concatenate([h["wide"] for h in held])}
            parts = list(pairs(r))
            i, j, more = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in range(3))
            # rows of one line get one number, so that a pair is one number too
            by_place = np.unique(np.concatenate([i, j]))
            by_place = by_place[np.lexsort(tuple(r[k][by_place] for k in ("line", "twin", "doc")))]
            new = np.logical_or.reduce([r[k][by_place][1:] != r[k][by_place][:-1] for k in ("doc", "twin", "line")])
            place = np.zeros(len(r["token"]), np.int64)
            place[by_place] = np.concatenate([[0], np.cumsum(new)])[:len(by_place)]
            pair = place[j] * len(place) + place[i]
            order = np.lexsort((-more.astype(np.int64), pair))  # marked ones first
            order = order[place[i[order]] != place[j[order]]]
            order = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])[:len(order)]]
            i, j, more = i[order], j[order], more[order].astype(np.int64)
            gone = len(equal)
            return pa.RecordBatch.from_arrays(
                [*(pa.array(np.concatenate([s, r[k][j].astype(np.int64)])) for s, k in zip(settled, ("doc", "twin", "line"))),
                 *(pa.concat_arrays([pa.nulls(gone, pa.int64()), pa.array(r[k][i].astype(np.int64))]) for k in ("doc", "twin", "line")),
                 pa.array(np.concatenate([np.zeros(gone, np.int64), more]))], names=names)

        for b in batches:
            for number, rows, data in zip(*(c.to_pylist() for c in b.columns)):
                if number < 0:
                    done = np.frombuffer(zstandard.decompress(data), np.int64).reshape(3, rows)
                    yield pa.RecordBatch.from_arrays([*(pa.array(v) for v in done), *(pa.nulls(rows, pa.int64()) for _ in range(3)), pa.array(np.zeros(rows, np.int64))], names=names)
                    continue
                if number != now and held:
                    yield close()
                    held.clear()
                now, raw, at, part = number, zstandard.decompress(data), 0, {}
                for k, t in PACKED:
                    part[k] = np.frombuffer(raw, t, rows, at)
                    at += rows * np.dtype(t).itemsize
                held.append(part | {"wide": np.frombuffer(raw, np.uint64, offset=at)})
        if held:
            yield close()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(releasing(run), ", ".join(f"{n} bigint" for n in names))


def fetch_lines(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(doc, twin, line, words): the bytes of the asked lines, compressed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, open_ = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()
        for b in batches:
            out = [[], [], [], []]
            for doc, twin, text, wanted in zip(*(c.to_pylist() for c in b.columns)):
                lines = open_.decompress(text).split(b"\n")
                for n in wanted:
                    for column, v in zip(out, (doc, twin, n, press.compress(lines[n]))):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in out[:3]), pa.array(out[3], pa.binary())], names=["doc", "twin", "line", "words"])

    wanted = kept(places.groupBy("doc", "twin").agg(F.collect_set("line").alias("wanted")), "wanted")  # its size is known: few places are sent to the texts
    return packed_texts(marked_rows(texts, wanted, "doc", "twin")).join(wanted, ["doc", "twin"]).select("doc", "twin", "text", "wanted").dropDuplicates(["doc", "twin"]).mapInArrow(releasing(run), PLACE + ", words binary")


def verified(pairs: DataFrame, texts: DataFrame, share: float) -> DataFrame:
    """Places of later lines of which a candidate has Jaccard similarity `share` or more, on the whole token sets."""
    places = pairs.select(*(F.col(f"b_{k}").alias(k) for k in ("doc", "twin", "line"))).union(pairs.select("a_doc", "a_twin", "a_line"))
    words = kept(fetch_lines(places, texts), "lines")

    def side(name: str) -> DataFrame:
        return words.select(*(F.col(k).alias(f"{name}_{k}") for k in ("doc", "twin", "line")), F.col("words").alias(f"{name}_words"))

    joined = pairs.join(side("b"), ["b_doc", "b_twin", "b_line"]).join(side("a"), ["a_doc", "a_twin", "a_line"]).select("b_doc", "b_twin", "b_line", "b_words", "a_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            ok = []
            for b, a in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                x, y = set(open_.decompress(b).split()), set(open_.decompress(a).split())
                both = len(x & y)
                ok.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:3]], names=["doc", "twin", "line"])

    return joined.mapInArrow(releasing(run), PLACE).distinct()


def remaining(unsettled: DataFrame, texts: DataFrame, table: np.ndarray, share: float) -> DataFrame:
    """All candidates of lines whose first ones did not match: their prefix rows are joined with everybody's who holds a
    token in the same bucket of the rarity table as one of theirs."""
    def rows(asked: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, twin, part in chunks(b):
                    s = line_sets(part, table, asked)
                    n = prefix_length(s["size"], share)
                    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    own = np.repeat(np.arange(len(n)), n)
                    token = s["token"][s["start"][own] + at]
                    bucket = (token >> np.uint64(44)).astype(np.int64)
                    use = np.arange(len(own)) if asked is None else np.flatnonzero(asked[bucket])
                    own, at, token = own[use], at[use], token[use]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ascontiguousarray(v).view(np.int64) if v.dtype == np.uint64 else np.asarray(v, np.int64))
                         for v in (token, s["bits"][own], doc[s["text"][own]], twin[s["text"][own]], s["line"][own], s["size"][own], at)],
                        names=[k for k, _ in ROW])
        return releasing(run)

    columns = ", ".join(f"{k} bigint" for k, _ in ROW)
    theirs = texts.join(unsettled.select("doc", "twin").distinct(), ["doc", "twin"], "left_semi")  # only the texts that hold an open line
    ours = kept(theirs.mapInArrow(rows(None), columns).join(unsettled, ["doc", "twin", "line"], "left_semi"), "unsettled_rows")
    asked = np.zeros(BUCKETS, bool)
    words = ours.selectExpr("shiftrightunsigned(token, 44) AS at").groupBy(F.expr("shiftright(at, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(at % 64)))").alias("bits"))
    for r in words.collect():  # BUCKETS / 64 rows at most
        asked[r["word"] * 64:r["word"] * 64 + 64] = np.unpackbits(np.array([r["bits"]], "<i8").view(np.uint8), bitorder="little").astype(bool)
    everybody = texts.mapInArrow(rows(asked), columns)
    a, b = everybody.alias("a"), ours.alias("b")
    need = F.ceil(F.lit(share / (1 + share)) * (F.col("a.size") + F.col("b.size")) - 1e-9)
    before = F.struct("a.doc", "a.twin", "a.line") < F.struct("b.doc", "b.twin", "b.line")
    near = (F.least("a.size", "b.size") >= share * F.greatest("a.size", "b.size") - 1e-9) & (1 + F.least(F.col("a.size") - F.col("a.at"), F.col("b.size") - F.col("b.at")) - 1 >= need)
    near = near & (F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))) <= F.col("a.size") + F.col("b.size") - 2 * need)
    return a.join(b, F.col("a.token") == F.col("b.token")).where(before & near).select(*(F.col(f"{s}.{k}").alias(f"{s}_{k}") for s in "ba" for k in ("doc", "twin", "line"))).distinct()


def repeated_lines(texts: DataFrame, share: float = 0.8, buckets: int | None = None) -> DataFrame:
    """(doc, twin, line) of every line to remove: one whose token set has similarity `share` or more with that of an earlier line."""
    begun = made_so_far()
    buckets = buckets or max(1, 4 * texts.rdd.getNumPartitions())
    table = rarity_table(texts, "text")
    packed = prefixes(texts, table, share, buckets)
    shared = kept(candidates(packed, share, buckets), "pairs")
    at_once = shared.where("a_doc IS NULL").select(*(F.col(f"b_{k}").alias(k) for k in ("doc", "twin", "line")))
    b_place = ["b_doc", "b_twin", "b_line"]
    pairs = kept(shared.where("a_doc IS NOT NULL").groupBy(*b_place, "a_doc", "a_twin", "a_line").agg(F.max("more").alias("more"))
                 .join(at_once.distinct().toDF(*b_place), b_place, "left_anti"), "distinct_pairs")
    gone = kept(verified(pairs.drop("more"), texts, share), "matched")
    open_ = kept(pairs.where("more = 1").select(*(F.col(f"b_{k}").alias(k) for k in ("doc", "twin", "line"))).distinct().join(gone, ["doc", "twin", "line"], "left_anti"), "open")
    out = at_once.union(gone)
    if not open_.isEmpty():
        out = out.union(verified(kept(remaining(open_, texts, table, share), "more_pairs"), texts, share))
    done = kept(out.distinct(), "repeated_lines")
    forget_since(texts.sparkSession, begun, done)
    return done


def dedup_lines(docs: DataFrame, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated lines: all columns, then n_lines and n_removed; one row per input row.

    A line (between line feeds) is a set of words between ASCII white space. A line goes if an earlier line, in a document
    with a smaller id or before it in its own, has Jaccard similarity `share` or more; lines are judged on the input, and
    lines without words stay. A null text stays null with 0 lines, an empty text has one empty line. A null id comes after
    all others; rows of equal id and different text are ordered by a hash of the text; rows that are equal count as one
    document, and each is returned. Other columns are carried along; an empty table gives an empty result.
    """
    twins = has_twins(docs, id_col, text_col)  # if not, the hash of the text is a column of zeros wherever places are moved
    gone = repeated_lines(placed_texts(docs, id_col, text_col, twins=twins), share).groupBy("doc", "twin").agg(F.collect_list("line").alias("gone"))
    others = [c for c in docs.columns if c != text_col]
    placed = placed_texts(docs.withColumn("__rest", F.struct(*others, F.col(text_col).isNull().alias("__void"))), id_col, text_col, "__rest", twins=twins)
    rest = placed.schema["__rest"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([press.compress(t) for _, part in parts_of(b.column(2)) for t in part], pa.binary()), b.column(3)],
                                             names=["doc", "twin", "text", "__rest"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [[], [], []]
                for raw, lines_gone in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    lines = open_.decompress(raw).decode().split("\n")
                    drop = set(lines_gone or ())
                    for column, v in zip(out, ("\n".join(x for i, x in enumerate(lines) if i not in drop), len(lines), len(drop))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), part.column(2)],
                                                 names=["text", "n_lines", "n_removed", "__rest"])

    packed = placed.mapInArrow(releasing(pack), StructType.fromDDL(PLACED).add("text", "binary").add(rest))
    joined = packed.join(gone, ["doc", "twin"], "left").select("text", "gone", "__rest")
    done = joined.mapInArrow(releasing(clean), StructType().add("text", "string").add("n_lines", "long").add("n_removed", "long").add(rest))
    void = F.col("__rest.__void")
    columns = [F.when(~void, F.col("text")).alias(c) if c == text_col else F.col("__rest")[c].alias(c) for c in docs.columns]
    return done.select(*columns, F.when(void, 0).otherwise(F.col("n_lines")).alias("n_lines"), "n_removed")
