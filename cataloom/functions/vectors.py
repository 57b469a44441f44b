"""Array mathematics: products, softmax, divergences, padding, ranking gains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def softmax(logits: Column) -> Column:
    def spread(v: Column) -> Column:
        top = F.array_max(v)
        powers = F.transform(v, lambda x: F.exp(x - top))
        return let(powers, lambda p: let(_sum(p), lambda total: F.transform(p, lambda x: x / total)))
    return let(logits.cast("array<double>"), spread)


def best_index(weights: Column) -> Column:
    """0-based position of the maximum, first on ties."""
    return (F.array_position(weights, F.array_max(weights)) - 1).cast("int")


def prob_stats(p: Column) -> Column:
    """argmax, confidence and top1-top2 margin of a distribution (one class: margin = confidence)."""
    def stats(v: Column) -> Column:
        ranked = F.sort_array(v, asc=False)
        top, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
        return F.struct(best_index(v).alias("pred"), top.alias("confidence"),
                        F.coalesce(top - second, top).alias("margin"))
    return let(p, stats)


def softmax_stats(logits: Column) -> Column:
    return prob_stats(softmax(logits))


def entropy(p: Column) -> Column:
    return -_sum(F.transform(p, lambda x: x * F.ln(x + F.lit(1e-8))))


def kl(p: Column, q: Column) -> Column:
    """sum p * (ln p - ln(q + 1e-8)), terms with p = 0 count 0."""
    return _sum(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * (F.ln(x) - F.ln(y + F.lit(1e-8)))).otherwise(F.lit(0.0))))


def pad_and_mask(arr: Column, k: int, zero: Column) -> Column:
    """First k elements, padded with `zero`; mask 1 for real ones."""
    n = F.least(F.size(arr), F.lit(k))
    return F.struct(
        F.slice(F.concat(arr, F.array_repeat(zero, k)), 1, k).alias("padded"),
        F.transform(F.sequence(F.lit(1), F.lit(k)), lambda i: F.when(i <= n, 1.0).otherwise(0.0)).alias("mask"))


def clip_norm(score: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def dcg(rels: Column, k: int) -> Column:
    gains = F.transform(F.slice(rels, 1, k), lambda r, i: (F.pow(F.lit(2.0), r) - 1) / F.log2(i + F.lit(2.0)))
    return _sum(gains)


def ndcg(rels: Column, k: int, judged: Column | None = None) -> Column:
    """Gain over the ideal order of the retrieved list, or of all judged relevances when given."""
    ideal = dcg(F.sort_array(rels if judged is None else judged, asc=False), k)
    return let(ideal, lambda best: F.when(best > 0, dcg(rels, k) / best).otherwise(F.lit(0.0)))
