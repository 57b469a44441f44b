"""Phrase collocations by prefix-free parsing.

Texts are cut into pieces at punctuation and line breaks, and pieces into chunks at content triggers: words
whose hash says so, whatever stands around them. A chunk is extended by up to three words of the next one
(the overlap), so that every phrase of up to four words lies wholly inside the chunk in which it starts and
is counted there alone. Equal passages have equal chunks; the distinct chunks with their frequencies are the
dictionary, and all counting runs over the dictionary, each phrase weighted by its chunk's frequency.

Phrases are counted by size. A phrase cannot be more frequent than its parts, so longer ones are only looked
at where all their parts passed; which ones did is told to the tasks by a bitmap of fixed size, whose false
hits cost rows but change nothing, since every count is exact and compared with the least frequency.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_size, kept

LONGEST = 4  # words of the longest phrase
OVERLAP = LONGEST - 1
SPACE, BREAK = 32, 10
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _byte_classes() -> np.ndarray:
    """A-Z to lower case, tabs to spaces, punctuation and line breaks to one break sign."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[9] = SPACE
    table[[*b".,;:!?", 10, 11, 12, 13]] = BREAK
    return table


_CLASSES = _byte_classes()
_BYTE_HASH = np.random.default_rng(13).integers(0, 2**64, 256, np.uint64, endpoint=False)


def _ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    edge = np.cumsum(size)
    return np.arange(edge[-1] if len(edge) else 0) + np.repeat(begin - (edge - size), size)


def _strings(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.StringArray:
    """The byte ranges as an array of strings."""
    offset = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(size), pa.py_buffer(offset.tobytes()), pa.py_buffer(data[_ragged(begin, size)].tobytes()))


def chunks_of(texts: pa.StringArray, modulus: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.StringArray]:
    """(text, own, tail, chunk) of every chunk of the texts: its text's index, its own words, the words it shows of the
    next chunk, and its words joined by single spaces. Without a word in any text all are empty."""
    offset = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = _CLASSES[np.frombuffer(raw, np.uint8)[offset[0]:offset[-1]]] if raw is not None else np.zeros(0, np.uint8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offset - offset[0]] = True
    solid = np.concatenate([[False], (data != SPACE) & (data != BREAK), [False]])
    begin = np.flatnonzero(solid[1:-1] & (~solid[:-2] | edge[:-1]))
    if not len(begin):
        none = np.zeros(0, np.int64)
        return none, none, none, pa.array([], pa.string())
    size = np.flatnonzero(solid[1:-1] & (~solid[2:] | edge[1:])) + 1 - begin
    text = np.searchsorted(offset - offset[0], begin, "right") - 1
    piece = np.cumsum(data == BREAK, dtype=np.int32)[begin]
    letters = data[_ragged(begin, size)]
    place = np.cumsum(size) - size  # of each word in `letters`
    hashed = np.add.reduceat(_BYTE_HASH[letters] * ((np.arange(len(letters)) - np.repeat(place, size)) * 2 + 1).astype(np.uint64), place)
    trigger = ((hashed ^ (hashed >> np.uint64(31))) * _MIX >> np.uint64(40)) % np.uint64(modulus) == 0
    fresh = np.ones(len(begin), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(fresh | trigger)
    after = np.append(first[1:], len(begin))
    pieces = np.append(np.flatnonzero(fresh), len(begin))
    until = np.minimum(after + OVERLAP, pieces[np.searchsorted(pieces, first, "right")])
    spaced = np.full(len(letters) + len(begin), SPACE, np.uint8)
    spaced[np.arange(len(letters)) + np.repeat(np.arange(len(begin)), size)] = letters
    place = place + np.arange(len(begin))
    return text[first], after - first, until - after, _strings(spaced, place[first], place[until - 1] + size[until - 1] - place[first])


def dictionary(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", modulus: int = 16, at_once: int = 1_500_000) -> DataFrame:
    """(lang, tail, chunk, own, freq): distinct chunks, their own and overlapping words and how often each occurs.

    Equal chunks are summed in the task before they are shuffled, so neither a hot language nor a passage that
    millions of texts share reaches one task. A null language is `und`; a null text has no chunk.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.string())
            for at, rows in by_size(pc.binary_length(texts), at_once):
                text, own, tail, chunk = chunks_of(texts.slice(at, rows), modulus)
                lang = batch.column(0).slice(at, rows).dictionary_encode()
                chunk = chunk.dictionary_encode()
                langs = max(1, len(lang.dictionary))
                of = lang.indices.to_numpy(zero_copy_only=False)[text]
                key = (chunk.indices.to_numpy(zero_copy_only=False).astype(np.int64) * langs + of) * LONGEST + tail
                key, seen, count = np.unique(key, return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(of[seen])), pa.array(tail[seen], pa.int32()),
                     chunk.dictionary.take(pa.array(key // LONGEST // langs)), pa.array(own[seen], pa.int64()), pa.array(count, pa.int64())],
                    names=["lang", "tail", "chunk", "own", "freq"])

    ready = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    found = ready.mapInArrow(run, "lang string, tail int, chunk string, own long, freq long")
    return found.groupBy("lang", "tail", "chunk").agg(F.first("own").alias("own"), F.sum("freq").alias("freq"))


class Bitmap:
    """Bits at the hashed places of a set of phrases."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def holds(self, hashed: np.ndarray) -> np.ndarray:
        place = hashed >> np.uint64(64 - self.bits)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _string_hash(values: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), np.uint64, len(values))


def _phrase_hash(lang: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Hash of phrases from the hashes of their language and of their words."""
    out = lang
    for w in words:
        out = (out ^ (out >> np.uint64(29)) ^ w) * _MIX
    return out


def _bitmap(phrases: DataFrame, words: int, bits_each: int = 16, most: int = 24) -> Bitmap:
    """Bitmap of stored phrases of `words` words: `bits_each` bits for each, at most 2**`most` bits (2 MB) whatever
    their number, so that what the driver holds and the tasks receive is bounded."""
    bits = min(most, max(16, int(phrases.count() * bits_each).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = pc.split_pattern(batch.column(1), " ").flatten().dictionary_encode()
            hashed = _string_hash(split.dictionary)[split.indices.to_numpy(zero_copy_only=False)].reshape(-1, words)
            lang = batch.column(0).dictionary_encode()
            place = _phrase_hash(_string_hash(lang.dictionary)[lang.indices.to_numpy(zero_copy_only=False)], list(hashed.T)) >> np.uint64(64 - bits)
            at, which = np.unique(place >> np.uint64(6), return_inverse=True)
            held = np.zeros(len(at), np.uint64)
            np.bitwise_or.at(held, which, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(held.view(np.int64))], names=["at", "held"])

    set_bits = phrases.select("lang", "phrase").mapInArrow(run, "at long, held long").groupBy("at").agg(F.bit_or("held").alias("held")).toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[set_bits["at"].to_numpy()] = set_bits["held"].to_numpy().view(np.uint64)
    return Bitmap(bits, out)


def _counted(chunks: DataFrame, sizes: tuple[int, ...], least: int, parts: tuple[int, Bitmap] | None = None) -> DataFrame:
    """(lang, phrase, words, f) of the phrases with `sizes` words that occur `least` times or more; with `parts`, only
    phrases are looked at whose parts of so many words are all in the bitmap."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pc.split_pattern(batch.column(2), " ")
            number = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            split = lists.flatten().dictionary_encode()
            word = split.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            tail, freq = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 3))
            lang = batch.column(0).dictionary_encode()
            of = lang.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            chunk = np.repeat(np.arange(len(number)), number)
            left = np.repeat(np.cumsum(number), number) - np.arange(len(word))  # words from here to the chunk's end
            starts = np.flatnonzero(left > tail[chunk])
            if parts:
                step, passed = parts
                padded = np.concatenate([_string_hash(split.dictionary)[word], np.zeros(step, np.uint64)])
                langs = _string_hash(lang.dictionary)[of][chunk]
                good = passed.holds(_phrase_hash(langs, [padded[j:j + len(word)] for j in range(step)])) & (left >= step)
            for n in sizes:
                at = starts[left[starts] >= n]
                for j in range(n - parts[0] + 1 if parts else 0):
                    at = at[good[at + j]]
                if len(at):
                    yield _summed(at, n, word, split.dictionary, of[chunk[at]], lang.dictionary, freq[chunk[at]])

    found = chunks.select("lang", "tail", "chunk", "freq").mapInArrow(run, "lang string, phrase string, words int, f long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def _summed(at: np.ndarray, n: int, word: np.ndarray, words: pa.Array, lang: np.ndarray, langs: pa.Array, freq: np.ndarray) -> pa.RecordBatch:
    """The phrases of n words that start at `at`, equal ones as one row with their summed frequency."""
    key = lang
    for j in range(n):
        key = key * len(words) + word[at + j]
        _, seen, key = np.unique(key, return_index=True, return_inverse=True)
    total = np.zeros(len(seen), np.int64)
    np.add.at(total, key, freq)
    spelled = [words.take(pa.array(word[at[seen] + j])) for j in range(n)]
    phrase = pc.binary_join_element_wise(*spelled, " ") if n > 1 else spelled[0]
    return pa.RecordBatch.from_arrays([langs.take(pa.array(lang[seen])), phrase, pa.array(np.full(len(seen), n), pa.int32()), pa.array(total)],
                                      names=["lang", "phrase", "words", "f"])


def frequent_phrases(chunks: DataFrame, least: int = 30) -> DataFrame:
    """(lang, phrase, words, f): every phrase of one to four words with at least `least` occurrences, counted exactly.
    `chunks` is a stored dictionary; each size is written before the next one reads it."""
    one = kept(_counted(chunks, (1,), least), "words")
    two = kept(_counted(chunks, (2,), least, (1, _bitmap(one, 1))), "pairs")
    more = kept(_counted(chunks, tuple(range(3, LONGEST + 1)), least, (2, _bitmap(two, 2))), "phrases")
    return one.unionByName(two).unionByName(more)


def _product(value: str, factor: int) -> Column:
    return F.col(value).cast("decimal(19,0)") * F.lit(factor).cast("decimal(10,0)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, covered: int = 80,
                 top: int | None = 2_000, modulus: int = 16, scale: int = 2_000_000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases of two to four words that occur `least` times.

    a is the phrase's count, l and r those of the two sides of its worst cut, n all words of the language; the score is
    floor(scale * a / (l + r)), computed in integers of 38 digits. A phrase goes if a longer one that holds it has
    `covered` percent of its occurrences. Ranks go by score, then a, then the phrase's bytes; `top` None returns all.
    Null texts have no words, a null language is `und`, repeated rows count each, other columns are ignored, an
    empty table or one without frequent phrases gives an empty result; very long texts cost memory by their own length.
    """
    chunks = kept(dictionary(docs, text_col, lang_col, modulus), "chunks")
    counts = frequent_phrases(chunks, least)
    totals = chunks.groupBy("lang").agg(F.sum(F.col("own") * F.col("freq")).alias("n"))
    phrases = counts.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("cut")).select(
        "*", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - words)").alias("rest"))
    side = lambda part, count: counts.select("lang", F.col("phrase").alias(part), F.col("f").alias(count))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("rest", "r"), ["lang", "rest"]).withColumn(
        "score", F.expr(f"(cast(a as decimal(19,0)) * cast({scale} as decimal(10,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))"))
    worst = scored.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("w"))
    inner = counts.where("words >= 3").select("lang", "f", F.explode(F.expr("""flatten(transform(sequence(2, words - 1), m ->
        transform(sequence(1, words - m + 1), s -> array_join(slice(split(phrase, ' '), s, m), ' '))))""")).alias("phrase"))
    longer = inner.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    left = worst.join(longer, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (_product("longer", 100) < _product("a", covered)))
    out = left.join(totals, "lang").select("lang", "phrase", "a", "w.l", "w.r", "n", F.col("w.score").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = out.withColumn("rank", F.row_number().over(order).cast("long"))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


