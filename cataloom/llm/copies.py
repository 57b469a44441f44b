"""Near copies of documents: SimHash links and keys of shingle sets, exact Jaccard similarity of the texts that meet, components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget_since, kept, made_so_far, marked_rows, releasing
from .graph import components
from .lines import prefix_length
from .simhash import near_links

BANDS, ROWS, SHORT = 36, 5, 160  # a pair at 0.8 shares no key with (1 - 0.8 ** 5) ** 36 = 6e-7; pairs of up to SHORT shingles always do
_MIX = np.random.default_rng(11).integers(0, 2**32, (2, BANDS * ROWS, 1), np.uint32, endpoint=False)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """Sorted hashes of the distinct word shingles of a text; one of fewer words is one shingle, one of no words has none."""
    found = text.lower().split()  # on bytes, as the SimHash
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(7)), np.uint64))


def set_keys(hashes: np.ndarray, share: float) -> list[int]:
    """Keys under which sets of similarity `share` meet: sets of up to SHORT hashes by their prefix in hash order, which misses
    none; larger ones by bands of minimal hashes. Sets near the limit have both, since the larger of a pair decides."""
    keys = []
    if len(hashes) <= SHORT:
        keys += hashes[:int(prefix_length(np.array([len(hashes)]), share)[0])].view(np.int64).tolist() if len(hashes) else []
    if len(hashes) >= share * SHORT - 1:
        low = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
        part = (hashes >> np.uint64(32)).astype(np.uint32)
        for at in range(0, len(part), 2_048):
            low = np.minimum(low, ((part[None, at:at + 2_048] ^ _MIX[0]) * (_MIX[1] | np.uint32(1))).min(1))
        keys += [xxhash.xxh64_intdigest(band.tobytes(), i) - 2**63 for i, band in enumerate(low.reshape(BANDS, ROWS))]
    return keys


SIGNATURE = 8  # 64-bit words of the parity signature of a set


def signature(hashes: np.ndarray) -> list[int]:
    """Parity bitmap of a set: two sets differ in at least as many members as their signatures differ in bits."""
    out = np.zeros(SIGNATURE, np.uint64)
    np.bitwise_xor.at(out, ((hashes >> np.uint64(6)) % np.uint64(SIGNATURE)).astype(np.int64), np.uint64(1) << (hashes & np.uint64(63)))
    return out.view(np.int64).tolist()


def print_of(hashes: np.ndarray) -> int:
    """SimHash of a set: bit i is set if it is in over half of the hashes."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<i8")[0])


def marked_texts(docs: DataFrame, words: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """(id, node, size, fp, sign, keys): hash of the words, number of shingles, SimHash, signature and keys where a task meets the words first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            for at in range(0, b.num_rows, 1_000):
                part = b.slice(at, 1_000)
                nodes, sizes, prints, signs, keys = [], [], [], [], []
                for t in part.column(1).to_pylist():
                    raw = (t or "").encode()
                    node = xxhash.xxh64_intdigest(b" ".join(raw.lower().split())) - 2**63
                    fresh = node not in seen
                    seen.add(node)
                    own = shingle_set(raw, words) if fresh else ()
                    nodes.append(node)
                    sizes.append(len(own))
                    prints.append(print_of(own) if fresh else None)
                    signs.append(signature(own) if fresh else None)
                    keys.append(set_keys(own, share) if fresh else [])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()),
                                                  pa.array(signs, pa.list_(pa.int64())), pa.array(keys, pa.list_(pa.int64()))], names=[id_col, "node", "size", "fp", "sign", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(releasing(run), f"`{id_col}` {kind}, node bigint, size bigint, fp bigint, sign array<bigint>, keys array<bigint>")


def similar(pairs: DataFrame, texts: DataFrame, words: int, share: float) -> DataFrame:
    """The pairs (a, b) of which the texts (node, text) have Jaccard similarity `share` or more."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress((t or "").encode()) for t in b.column(1).to_pylist()], pa.binary())], names=["node", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = shingle_set(open_.decompress(x), words), shingle_set(open_.decompress(y), words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= share * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    packed = kept(texts.mapInArrow(releasing(pack), "node bigint, text binary"), "copy_texts")
    joined = pairs.join(packed.toDF("b", "b_text"), "b").join(packed.toDF("a", "a_text"), "a").select("a", "b", "a_text", "b_text")
    return joined.mapInArrow(releasing(run), "a bigint, b bigint")


def near_copies(docs: DataFrame, words: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", radius: int = 3) -> DataFrame:
    """(id, node, component), one row per input row: texts are linked if their sets of word shingles have Jaccard similarity
    `share` or more, and a component is all that links reach. `id_col` must be unique and not null; `docs` is read three times.

    Texts of the same words are one node. Texts whose SimHashes differ in `radius` bits or fewer, found by the bit-sliced
    comparison, and texts that share a key of their shingle set are candidates; few pairs at the limit are within the
    radius, so the keys decide the recall. Under each key everybody is compared with the smallest node first; what then stands in
    different components under one key meets pair by pair, so that a large group of copies costs one pair each. A pair
    leaves the join only if sizes and signatures do not prove it less similar than `share`: a large group of texts that share
    keys but are not similar is tested there by bits, and is neither written nor read again. Intermediate tables are removed.
    """
    begun = made_so_far()
    marked = kept(marked_texts(docs, words, share, id_col, text_col), "marked")
    first = marked.groupBy("node").agg(F.min(id_col).alias(id_col))
    keyed = marked.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub <> top").select("key", "hub")
    keyed = kept(keyed.join(hubs, "key").distinct(), "keyed")
    nodes = kept(marked.where("size > 0").dropDuplicates(["node"]).select("node", "size", "fp", *(F.get("sign", F.lit(i)).alias(f"s{i}") for i in range(SIGNATURE))), "nodes")
    prints = kept(nodes.groupBy("fp").agg(F.min("node").alias("low")), "prints")
    near = near_links(prints.select("fp"), radius).join(prints.toDF("a", "x"), "a").join(prints.toDF("b", "y"), "b").select("x", "y")
    near = near.union(nodes.join(prints, "fp").where("node <> low").select("low", "node"))  # (x, y)

    def side(name: str) -> DataFrame:
        return nodes.select(F.col("node").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in nodes.columns if c not in ("node", "fp")))

    def may_link(x: str, y: str):
        """Whether sizes and signatures leave room for the similarity."""
        small, large = F.least(f"{x}_size", f"{y}_size"), F.greatest(f"{x}_size", f"{y}_size")
        need = F.ceil(F.lit(share / (1 + share)) * (small + large) - 1e-9)
        apart = sum((F.bit_count(F.col(f"{x}_s{i}").bitwiseXOR(F.col(f"{y}_s{i}"))) for i in range(SIGNATURE)), F.lit(0))
        return (small >= share * large - 1e-9) & (apart <= small + large - 2 * need)

    def links(pairs: DataFrame) -> DataFrame:
        wanted = kept(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(first, "node"), "wanted")
        return kept(similar(pairs, marked_rows(docs, wanted, id_col).join(wanted, id_col).select("node", text_col), words, share), "links")

    stars = keyed.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    stars = stars.union(near.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))).distinct()
    stars = kept(stars.join(side("a"), "a").join(side("b"), "b").where(may_link("a", "b")).select("a", "b"), "stars")
    found = links(stars)
    labels = components(found).withColumnRenamed("component", "label")
    placed = keyed.select("key", "node").join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    apart = kept(placed.join(mixed, "key").join(nodes.drop("fp"), "node"), "apart")
    a, b = (apart.select("key", *(F.col(c).alias(f"{s}_{c}") for c in apart.columns if c != "key")) for s in "ab")
    together = (F.col("x.key") == F.col("y.key")) & (F.col("a_node") < F.col("b_node")) & (F.col("a_label") != F.col("b_label")) & may_link("a", "b")
    crossed = a.alias("x").join(b.alias("y"), together).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    crossed = kept(crossed.join(stars, ["a", "b"], "left_anti"), "crossed")
    if not crossed.isEmpty():
        found = found.union(links(crossed))
        labels = components(found).withColumnRenamed("component", "label")
    labels = kept(labels, "labels")
    forget_since(docs.sparkSession, begun, marked, labels)
    return marked.select(id_col, "node").join(labels, "node", "left").select(id_col, "node", F.coalesce("label", "node").alias("component"))


def one_of_each(docs: DataFrame, words: int = 5, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, without near copies: of each component the row with the smallest id stays.

    Rows are told by their place, so null and repeated ids are rows like any other; null ids come last.
    """
    rows = kept(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    found = near_copies(rows.select("__row", text_col), words, share, "__row", text_col).join(rows.select("__row", id_col), "__row")
    found = kept(found.select("component", F.struct(F.col(id_col).isNull().alias("void"), F.col(id_col), "node", "__row").alias("place")), "copies")
    stays = found.groupBy("component").agg(F.min("place").alias("place")).select("place.__row")
    gone = kept(found.select("place.__row").join(stays, "__row", "left_anti"), "gone")
    return rows.join(gone, "__row", "left_anti").select(*docs.columns)
