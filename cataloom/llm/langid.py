"""Language identification by error-correcting output codes over hashed n-grams.

Every language has a binary codeword; one logistic classifier per bit reads hashed byte n-grams; decoding
sums, per language, the losses of the bit margins against its codeword and takes the smallest total.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, releasing

_WORD = re.compile(r"[^\W\d_]+")


def has_letter(text: str) -> bool:
    """Whether a text holds a character of Unicode category L (other word characters, such as Roman numerals, are none)."""
    return any(c.isalpha() for m in _WORD.finditer(text) for c in m[0])


def codewords(languages: int, seed: int = 11) -> np.ndarray:
    """One row of -1 / 1 per language. Up to 6 languages get every split into two sides; more get random
    splits, 12 bits per doubling, of which the draw with the largest least distance is taken."""
    if languages <= 1:
        return np.ones((languages, 1))
    if languages <= 6:
        rows = [(1, *r) for r in product((1, -1), repeat=languages - 1) if -1 in r]
        return np.array(rows, float).T
    rng = np.random.default_rng(seed)
    bits = 12 * int(np.ceil(np.log2(languages)))
    draws = [np.where(rng.random((languages, bits)) < 0.5, -1.0, 1.0) for _ in range(50)]
    draws = [d for d in draws if (np.abs(d.sum(0)) < languages).all()] or draws
    return max(draws, key=lambda d: min((d[i] != d[j]).sum() for i in range(languages) for j in range(i)))


def ngram_shares(text: str, buckets: int) -> np.ndarray:
    """Square roots of the shares of hashed byte 1- to 4-grams of the lower-cased text; unit length."""
    b = np.frombuffer(b" " + " ".join(text.lower().split()).encode() + b" ", np.uint8).astype(np.uint32)
    total = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    gram = np.zeros(len(b), np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        gram = (gram[:len(b) - n + 1] << np.uint32(8)) | b[n - 1:]
        total += np.bincount(((gram ^ np.uint32(n * 0x1F123BB5 & 0xFFFFFFFF)) * np.uint32(2654435761)) >> shift, minlength=buckets)
    return np.sqrt(total / total.sum()).astype(np.float32)


def snippets(text: str) -> list[str]:
    """The text and three parts of its middle, so that short texts are known to the classifiers as well."""
    return [text, *(text[max(0, len(text) // 2 - n):][:n] for n in (15, 50, 200))]


def fit_bits(x: np.ndarray, y: np.ndarray, codes: np.ndarray, rounds: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Weights of one logistic classifier per bit (last row: bias), all bits at once, by accelerated descent."""
    sign = codes[y].astype(np.float32)
    w = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    ahead, t = w.copy(), 1.0
    step = np.float32(4.0)  # rows have unit length and a bias, so the curvature is at most (1 + 1) / 4
    for _ in range(rounds):
        margin = x @ ahead[:-1] + ahead[-1]
        slope = -sign / (1 + np.exp(np.clip(sign * margin, -30, 30))) / len(x)
        grad = np.vstack([x.T @ slope, slope.sum(0)]) + np.float32(ridge) * ahead / 10
        new = ahead - step * grad
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + np.float32((t - 1) / after) * (new - w), new, after
    return w


def decode(margins: np.ndarray, codes: np.ndarray, gain: float) -> np.ndarray:
    """Share of each language: loss-weighted distances of the margins to the codewords, turned into shares."""
    loss = np.logaddexp(0, -margins[:, None, :] * codes[None, :, :]).mean(2) * gain
    share = np.exp(loss.min(1, keepdims=True) - loss)
    return share / share.sum(1, keepdims=True)


def fold(column) -> F.Column:
    """crc32 of an id as text, modulo 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, sample_rows: int = 3_000, buckets: int = 2_048, most_languages: int = 256, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict:
    """Classifiers from labelled rows outside the held-out fold. At most `sample_rows` different texts are used (one of each
    language at least), dealt evenly over the languages by a hash of text, so that a text in any share of all rows
    counts once; the `most_languages` most frequent labels are learned. The sample's features, and nothing that grows with
    the table, reach the driver."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(
        (fold(F.col(id_col)) != 0) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (F.col(lang_col) != ""))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct(F.xxhash64("text")).alias("texts"))
    counts = {r["lang"]: r["texts"] for r in found.orderBy(F.col("n").desc(), "lang").limit(most_languages).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "weights": None, "codes": None, "buckets": buckets}
    each = max(1, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, 1.5 * each / max(counts[k], 1)))])
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    picked = rows.where(F.col("lang").isin(languages)).where(order / float(1 << 30) < share[F.col("lang")]).withColumn("order", order)
    picked = picked.dropDuplicates(["lang", "text"])  # copies leave one row per task before they are shuffled
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))).where(F.col("place") <= each)

    def features(frames):
        for f in frames:
            out = [(lang, ngram_shares(part, buckets).astype(np.float16).tobytes()) for lang, text in zip(f["lang"], f["text"])
                   if has_letter(text) for part in snippets(text) if has_letter(part)]
            yield pd.DataFrame(out, columns=["lang", "x"])

    sample = picked.select("lang", "text").mapInPandas(releasing(features), "lang string, x binary").toPandas()
    sample = sample.sort_values(["lang", "x"])  # the same weights whatever the order of arrival
    codes = codewords(len(languages))
    if not len(sample):
        return {"languages": [], "weights": None, "codes": None, "buckets": buckets}
    x = np.frombuffer(b"".join(sample["x"]), np.float16).reshape(len(sample), buckets).astype(np.float32)
    y = np.searchsorted(np.array(languages), sample["lang"].to_numpy(str))
    return {"languages": languages, "weights": fit_bits(x, y, codes), "codes": codes, "buckets": buckets}


def predict(model: dict, texts: list[str | None], gain: float = 8.0, ambiguous_below: float = 0.05) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and ambiguity of whole texts. `und` with score 0 if a text is null, has no letter or nothing was
    learned; ambiguous if the two best shares differ by less than `ambiguous_below`."""
    lang, score, unsure = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts)
    at = [i for i, t in enumerate(texts) if t and has_letter(t)] if model["languages"] else []
    for begin in range(0, len(at), 500):
        part = at[begin:begin + 500]
        x = np.stack([ngram_shares(texts[i], model["buckets"]) for i in part])
        share = decode(x @ model["weights"][:-1] + model["weights"][-1], model["codes"], gain)
        order = np.sort(share, 1)
        gap = order[:, -1] - (order[:, -2] if order.shape[1] > 1 else 0)
        for i, best, top, g in zip(part, share.argmax(1), order[:, -1], gap):
            lang[i], score[i], unsure[i] = model["languages"][best], float(top), bool(g < ambiguous_below)
    return lang, score, unsure


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang_pred, score, ambiguous), one row per input row, from whole texts in one narrow pass.

    Only the text is read for the prediction. Ties between languages go to the first by name. Null and letterless texts
    are `und`; null ids stay null; repeated rows get the same answer; other columns are left aside; an empty table gives
    an empty result. The model is a few hundred kilobytes whatever the table's size.
    """
    def run(columns):
        ids, texts = columns
        lang, score, unsure = predict(model, texts)
        held = [zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0 for i in ids]
        return [ids, held, lang, score, unsure]

    kind = docs.schema[id_col].dataType.simpleString()
    return map_batches(docs, run, [id_col, text_col], f"`{id_col}` {kind}, held_out boolean, lang_pred string, score double, ambiguous boolean")


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """The rows whose language is told without ambiguity, all columns unchanged, in one narrow pass."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                lang, _, unsure = predict(model, part.column(place).to_pylist())
                yield part.filter(pa.array([x != "und" and not u for x, u in zip(lang, unsure)], pa.bool_()))

    place = docs.columns.index(text_col)
    return docs.mapInArrow(releasing(run), docs.schema)
