"""Removal of repeated 100-byte strings by logarithmic families of sparse suffix indexes.

Suffixes are sampled at content-defined anchors, so that equal strings hold equal anchors. Anchors are dealt by
their k-mer; each part takes them in document order, batch after batch: a batch is sorted, merge-scanned against
the levels before it, and becomes a level, and levels of equal size merge. An anchor whose whole surroundings
(all strings that it stands for) were seen settles without its text; where only a part of the surroundings
repeats, the bytes are fetched and every string in them is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import KMER, anchor_positions, mixed, range_hashes
from .common import kept
from .lines import packed_texts, placed_texts

RECORD = np.dtype([("kmer", "<u8"), ("around", "<u8"), ("doc", "<i8"), ("twin", "<i8"), ("pos", "<u4")])
_SPANS = np.dtype([("doc", "<i8"), ("twin", "<i8"), ("lo", "<u4"), ("hi", "<u4")])
_LAST = 2**63 - 1


class LevelFamily:
    """Sorted levels of records (kmer, around, place), unique by both keys, each kept at its earliest place. Records must
    come in order of place; `add` tells which of them repeat an earlier record at another place."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    @staticmethod
    def _other_place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a["doc"] != b["doc"]) | (a["twin"] != b["twin"]) | (a["pos"] != b["pos"])

    def add(self, batch: np.ndarray) -> np.ndarray:
        key = mixed(batch["kmer"] + batch["around"] * np.uint64(0xD6E8FEB86659FD93))
        order = np.argsort(key, kind="stable")
        key, level = key[order], batch[order]
        again = np.zeros(len(batch), bool)
        again[1:] = (key[1:] == key[:-1]) & (level["kmer"][1:] == level["kmer"][:-1])
        repeated = np.zeros(len(batch), bool)
        repeated[order[1:][again[1:] & self._other_place(level[1:], level[:-1])]] = True
        key, level, order = key[~again], level[~again], order[~again]
        for old_key, old in self.levels:  # merge scan: both are sorted
            at = np.minimum(np.searchsorted(old_key, key), len(old_key) - 1)
            known = (old_key[at] == key) & (old["kmer"][at] == level["kmer"])
            repeated[order[known & self._other_place(old[at], level)]] = True
            key, level, order = key[~known], level[~known], order[~known]
        if len(level):
            self.levels.append((key, level))
        while len(self.levels) > 1 and len(self.levels[-1][0]) >= len(self.levels[-2][0]):
            self._merge()
        return repeated

    def _merge(self) -> None:
        newer, older = self.levels.pop(), self.levels.pop()
        key = np.concatenate([older[0], newer[0]])
        order = np.argsort(key, kind="stable")
        self.levels.append((key[order], np.concatenate([older[1], newer[1]])[order]))

    def all(self) -> np.ndarray:
        """Every record once, sorted by k-mer."""
        while len(self.levels) > 1:
            self._merge()
        found = self.levels[0][1] if self.levels else np.zeros(0, RECORD)
        return found[np.argsort(found["kmer"], kind="stable")]


def _ordered(records: np.ndarray) -> np.ndarray:
    return records[np.lexsort((records["pos"], records["twin"], records["doc"]))]


def _span_batch(doc, twin, lo, hi, kind: int, kmer=None) -> pa.RecordBatch:
    n = len(doc)
    kmer = np.zeros(n, np.uint64) if kmer is None else np.ascontiguousarray(kmer)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, kind, np.int32)), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(twin, np.int64)), pa.array(np.asarray(lo, np.int64)),
         pa.array(np.asarray(hi, np.int64)), pa.array(kmer.view(np.int64))],
        names=["kind", "doc", "twin", "lo", "hi", "kmer"])


FOUND = "kind int, doc bigint, twin bigint, lo bigint, hi bigint, kmer bigint"
SPAN, ASKED = 0, 1


def _anchor_records(texts: list[bytes], doc: np.ndarray, twin: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Records of the anchors of some texts, and the stretch [lo, hi) that all strings around an anchor cover."""
    size = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(size) - size
    data = np.frombuffer(b"".join(texts), np.uint8)
    at, kmer = anchor_positions(data, begin, size, length)
    row = np.searchsorted(begin, at, "right") - 1
    lo = np.maximum(at - (length - KMER), begin[row])
    hi = np.minimum(at + length, begin[row] + size[row])
    out = np.zeros(len(at), RECORD)
    out["kmer"], out["doc"], out["twin"], out["pos"] = kmer, doc[row], twin[row], at - begin[row]
    out["around"] = mixed(range_hashes(data, lo, hi) + (at - lo).astype(np.uint64))
    return out, lo - begin[row], hi - begin[row]


def sample_anchors(docs: DataFrame, length: int, buckets: int, id_col: str, text_col: str, flush: int = 400_000) -> DataFrame:
    """Packed records by bucket of the k-mer. Surroundings met before in the same task settle there, so that a passage in
    any share of all documents leaves one record per task; those spans come along in buckets below 0."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            records, lo, hi = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            order = np.lexsort((records["pos"], records["twin"], records["doc"], records["around"], records["kmer"]))
            records, lo, hi = records[order], lo[order], hi[order]
            again = np.zeros(len(records), bool)
            again[1:] = (records["kmer"][1:] == records["kmer"][:-1]) & (records["around"][1:] == records["around"][:-1])
            spans = np.zeros(int(again.sum()), _SPANS)
            spans["doc"], spans["twin"], spans["lo"], spans["hi"] = records["doc"][again], records["twin"][again], lo[again], hi[again]
            # one place twice: equal rows; nothing is earlier there
            real = (records["doc"][1:] != records["doc"][:-1]) | (records["twin"][1:] != records["twin"][:-1]) | (records["pos"][1:] != records["pos"][:-1])
            spans = spans[np.concatenate([[True], real])[again]] if len(records) else spans
            records = records[~again]
            bucket = (records["kmer"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            records, bucket = records[order], bucket[order]
            names, first = np.unique(bucket, return_index=True)
            blobs = [records[a:b].tobytes() for a, b in zip(first, [*first[1:], len(records)])]
            numbers = [*names.tolist()]
            if len(spans):
                numbers.append(-1 - int(spans["doc"][0] % buckets))
                blobs.append(spans.tobytes())
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

        for batch in batches:
            doc, twin = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            texts = [t.encode() for t in batch.column(2).to_pylist()]
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < 1_000_000:
                    size += len(texts[stop])
                    stop += 1
                held.append(_anchor_records(texts[at:stop], doc[at:stop], twin[at:stop], length))
                at = stop
                if sum(len(h[0]) for h in held) >= flush:
                    yield out()
        if held:
            yield out()

    return placed_texts(docs, id_col, text_col).mapInArrow(run, "bucket int, data binary")


def settle(packed: DataFrame, length: int, buckets: int, batch: int = 65_536) -> DataFrame:
    """Spans of anchors whose surroundings repeat, and the anchors whose k-mer stands in several surroundings."""
    reach = length - KMER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        now = None

        def close() -> Iterator[pa.RecordBatch]:
            records = _ordered(np.frombuffer(b"".join(held), RECORD))
            family = LevelFamily()
            for at in range(0, len(records), batch):
                part = records[at:at + batch]
                again = part[family.add(part)]
                # the end of the stretch may lie beyond a short text: it is clipped where the span is applied
                yield _span_batch(again["doc"], again["twin"], np.maximum(again["pos"].astype(np.int64) - reach, 0), again["pos"].astype(np.int64) + length, SPAN)
            known = family.all()
            if len(known):
                several = np.zeros(len(known), bool)
                same = known["kmer"][1:] == known["kmer"][:-1]
                several[1:] |= same
                several[:-1] |= same
                known = known[several]
                yield _span_batch(known["doc"], known["twin"], known["pos"], known["pos"], ASKED, known["kmer"])

        for b in batches:
            for number, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if number < 0:
                    s = np.frombuffer(data, _SPANS)
                    yield _span_batch(s["doc"], s["twin"], s["lo"], s["hi"], SPAN)
                    continue
                if number != now and held:
                    yield from close()
                    held.clear()
                now = number
                held.append(data)
        if held:
            yield from close()

    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


AROUND = "kmer bigint, doc bigint, twin bigint, pos bigint, lo bigint, data binary"


def fetch(asked: DataFrame, docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """The bytes around each anchor that is asked for."""
    reach = length - KMER

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [[], [], [], [], [], []]
                for doc, twin, text, wanted, kmers in zip(*(c.to_pylist() for c in part.columns)):
                    raw = open_.decompress(text)
                    for pos, kmer in zip(wanted, kmers):
                        lo = max(0, pos - reach)
                        for column, v in zip(out, (kmer, doc, twin, pos, lo, raw[lo:pos + length])):
                            column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[i], pa.int64()) for i in range(5)] + [pa.array(out[5], pa.binary())],
                                                 names=["kmer", "doc", "twin", "pos", "lo", "data"])

    by_doc = asked.groupBy("doc", "twin").agg(F.collect_list(F.struct("lo", "kmer")).alias("wanted"))
    joined = packed_texts(placed_texts(docs, id_col, text_col)).join(by_doc, ["doc", "twin"]).select("doc", "twin", "text", F.col("wanted.lo").alias("pos"), F.col("wanted.kmer").alias("kmer"))
    return joined.mapInArrow(run, AROUND)


def _windows(kmer, doc, twin, lo, data: list[bytes], length: int) -> np.ndarray:
    """A record for every `length`-byte string of the given stretches: kmer, hash of the string, place."""
    size = np.array([len(d) for d in data], np.int64)
    count = np.maximum(size - length + 1, 0)
    begin = np.cumsum(size) - size
    at = np.arange(count.sum()) + np.repeat(begin - (np.cumsum(count) - count), count)
    out = np.zeros(len(at), RECORD)
    if len(at):
        out["around"] = range_hashes(np.frombuffer(b"".join(data), np.uint8), at, at + length)
        out["kmer"], out["doc"], out["twin"] = (np.repeat(x, count) for x in (kmer, doc, twin))
        out["pos"] = np.repeat(lo, count) + at - np.repeat(begin, count)
    return out


def _merge_starts(records: np.ndarray, length: int) -> pa.RecordBatch:
    """Spans of runs of neighbouring repeated strings."""
    records = np.unique(records[["doc", "twin", "pos"]])
    if not len(records):
        return _span_batch([], [], [], [], SPAN)
    new = np.ones(len(records), bool)
    new[1:] = (records["doc"][1:] != records["doc"][:-1]) | (records["twin"][1:] != records["twin"][:-1]) | (records["pos"][1:].astype(np.int64) != records["pos"][:-1].astype(np.int64) + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(records)) - 1
    return _span_batch(records["doc"][first], records["twin"][first], records["pos"][first], records["pos"][last].astype(np.int64) + length, SPAN)


def compare(around: DataFrame, length: int, buckets: int, batch: int = 2_000) -> DataFrame:
    """Spans of the strings around asked anchors that start earlier elsewhere: parts by k-mer, a family of levels each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def close() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).sort_by([("doc", "ascending"), ("twin", "ascending"), ("pos", "ascending")])
            kmer, doc, twin, lo = (table[c].to_numpy() for c in ("kmer", "doc", "twin", "lo"))
            data = table["data"].to_pylist()
            family, found = LevelFamily(), []
            for at in range(0, len(data), batch):
                part = _windows(kmer[at:at + batch].view(np.uint64), doc[at:at + batch], twin[at:at + batch], lo[at:at + batch], data[at:at + batch], length)
                part = _ordered(part)  # a string may stand around two anchors with the same k-mer, at one place
                found.append(part[family.add(part)][["doc", "twin", "pos"]])
            return _merge_starts(np.concatenate(found), length)

        for b in batches:
            at = 0
            while at < b.num_rows:
                keys = b.column(0).to_numpy()
                if rows >= 4_000 and keys[at] != held[-1].column(0)[-1].as_py():  # whole k-mers only
                    yield close()
                    held, rows = [], 0
                stop = at + 4_000
                while stop < b.num_rows and keys[stop] == keys[stop - 1]:
                    stop += 1
                part = b.slice(at, min(stop, b.num_rows) - at)
                held.append(part)
                rows += part.num_rows
                at += part.num_rows
        if held:
            yield close()

    return around.repartition(buckets, "kmer").sortWithinPartitions("kmer").mapInArrow(run, FOUND)


def compare_hot(around: DataFrame, length: int) -> DataFrame:
    """The same for k-mers with too many surroundings for one task: a row per string, first places by partial aggregation."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2_000):
                part = b.slice(at, 2_000)
                kmer, doc, twin, lo = (part.column(i).to_numpy() for i in (0, 1, 2, 4))
                w = _windows(kmer.view(np.uint64), doc, twin, lo, part.column(5).to_pylist(), length)
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(w["kmer"]).view(np.int64)),
                                                  pa.array(np.ascontiguousarray(w["around"]).view(np.int64)), pa.array(w["doc"]),
                                                  pa.array(w["twin"].astype(np.int64)), pa.array(w["pos"].astype(np.int64))], names=["kmer", "string", "doc", "twin", "pos"])

    strings = kept(around.mapInArrow(run, "kmer bigint, string bigint, doc bigint, twin bigint, pos bigint"), "strings")
    first = kept(strings.groupBy("kmer", "string").agg(F.min(F.struct("doc", "twin", "pos")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    again = strings.join(first, ["kmer", "string"]).where(F.struct("doc", "twin", "pos") != F.col("first"))
    return again.select(F.lit(SPAN).alias("kind"), "doc", "twin", F.col("pos").alias("lo"), (F.col("pos") + length).alias("hi"), F.lit(0).cast("bigint").alias("kmer"))


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text", hot: int = 100_000) -> DataFrame:
    """(doc, twin, lo, hi): stretches of bytes, which may overlap and end beyond the text, covered by strings that start earlier."""
    if length < 2 * KMER:
        raise ValueError(f"length must be {2 * KMER} or more")
    buckets = max(1, 4 * docs.rdd.getNumPartitions())
    found = kept(settle(sample_anchors(docs, length, buckets, id_col, text_col), length, buckets), "found")
    asked = found.where(F.col("kind") == ASKED)
    around = kept(fetch(asked, docs, length, id_col, text_col), "around")
    busy = kept(around.groupBy("kmer").count().where(F.col("count") > hot).select("kmer"), "busy")
    spans = [found.where(F.col("kind") == SPAN), compare(around.join(busy, "kmer", "left_anti"), length, buckets), compare_hot(around.join(busy, "kmer", "left_semi"), length)]
    return kept(spans[0].unionByName(spans[1]).unionByName(spans[2]).select("doc", "twin", "lo", "hi"), "spans")


def remove_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes covered by a `length`-byte string that starts earlier are removed: (id, n_bytes, n_removed, n_spans, kept_sha256, kept),
    one row per input row. `kept` holds the remaining bytes, which need not be valid UTF-8.

    Earlier is a smaller id, or an earlier start in the same document; strings are judged on the input, overlaps count.
    A null or empty text, or one shorter than `length`, keeps all its bytes. A null id comes after all others. Rows of
    equal id and different text are ordered by a hash of the text; rows that are equal count as one document, and each is
    returned. Other columns are left aside; an empty table gives an empty result.
    """
    spans = repeated_spans(docs, length, id_col, text_col)
    packed = spans.groupBy("doc", "twin").agg(F.collect_list(F.shiftleft("lo", 32).bitwiseOR(F.col("hi"))).alias("spans"))
    joined = packed_texts(placed_texts(docs, id_col, text_col)).join(packed, ["doc", "twin"], "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                out = [[], [], [], [], [], []]
                for doc, text, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2)):
                    raw = open_.decompress(text)
                    removed, runs = 0, 0
                    if found.is_valid and len(found):
                        packed = np.sort(found.values.to_numpy())
                        lo, hi = packed >> 32, np.minimum(packed & (2**32 - 1), len(raw))
                        reach = np.maximum.accumulate(hi)
                        first = np.flatnonzero(np.concatenate([[True], lo[1:] > reach[:-1]]))
                        starts, ends = lo[first], reach[np.append(first[1:], len(lo)) - 1]
                        removed, runs = int((ends - starts).sum()), len(starts)
                        edges = [0, *np.column_stack([starts, ends]).ravel().tolist(), len(raw)]
                        raw_kept = b"".join(raw[a:c] for a, c in zip(edges[::2], edges[1::2]))
                    else:
                        raw_kept = raw
                    for column, v in zip(out, (None if doc == _LAST else doc, len(raw), removed, runs, hashlib.sha256(raw_kept).hexdigest(), raw_kept)):
                        column.append(v)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.mapInArrow(run, "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").withColumnRenamed("doc", id_col)
