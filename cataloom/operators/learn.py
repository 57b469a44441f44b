"""Text classifiers per attribute and taxonomy level, all trained together.

Texts become sparse counts of hashed words once. The heads (one per attribute or level) are multinomial logistic
regressions on the same features; every round reads the stored features once, makes the gradients of all heads
in each task, and sums them by label in two levels, so that neither the driver nor a task sees more than
one row of weights per label and part. The driver keeps the weights and takes each head's own quasi-Newton step.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import each, let
from ..session import written

CELLS = 2_000_000  # numbers that a task multiplies at once


# --- features ---------------------------------------------------------------------------------------------
@dataclass
class TextFeatures:
    """Hashed word counts weighted by rarity; `idf` has one weight per place."""

    text: str
    idf: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.idf)

    def columns(self, dim: int | None = None) -> tuple[Column, Column]:
        """Places and weighted counts of a text; a null text has none."""
        counts = word_places(F.col(self.text), dim or self.dim)
        idf = F.lit([float(x) for x in self.idf])
        return (F.transform(counts, lambda e: e["at"]).alias("_at"),
                F.transform(counts, lambda e: e["n"] * F.get(idf, e["at"])).alias("_x"))


def word_places(text: Column, dim: int) -> Column:
    """Distinct places (at) of a text's words in `dim` hash buckets, with their numbers (n), in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\W+"), lambda w: w != "")
    places = F.array_sort(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(dim))))

    def runs(p: Column) -> Column:
        inside = F.when(F.size(p) > 0, F.sequence(F.lit(0), F.size(p) - 1)).otherwise(F.array().cast("array<int>"))
        starts = F.filter(inside, lambda i: (i == 0) | (F.get(p, i) != F.get(p, i - 1)))
        return let(starts, lambda first: F.transform(first, lambda i, k: F.struct(
            F.get(p, i).alias("at"), (F.coalesce(F.get(first, k + 1), F.size(p)) - i).alias("n"))))
    return let(places, runs)


def text_features(df: DataFrame, text: str, dim: int = 1024) -> TextFeatures:
    """Weights of the `dim` places, ln((texts + 1) / (texts with it + 1)), in one pass; null texts are left out."""
    texts = df.where(F.col(text).isNotNull()).groupBy(text).agg(F.count("*").alias("_n")).repartition(df.sparkSession.sparkContext.defaultParallelism)
    marked = texts.select("_n", F.concat(F.array(F.lit(-1)), F.transform(word_places(F.col(text), dim), lambda e: e["at"])).alias("_at"))
    seen = dict(each(marked, F.col("_at"), "at", "_n").groupBy("at").agg(F.sum("_n")).collect())  # dim + 1 rows
    total = seen.pop(-1, 0)
    return TextFeatures(text, np.log((total + 1) / (np.array([seen.get(i, 0) for i in range(dim)]) + 1)))


# --- one pass over the rows ----------------------------------------------------------------------------------
def _parts(batch: pa.RecordBatch, at: int, x: int, wide: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, owner, place, value) of slices of a batch with about CELLS products of a value and `wide` weights."""
    size = batch.column(at).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    place = batch.column(at).flatten().to_numpy(zero_copy_only=False)
    value = batch.column(x).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    edge = np.concatenate([[0], np.cumsum(size)])
    most = max(1, CELLS // max(wide, 1))
    row = 0
    while row < len(size):
        end = max(row + 1, min(int(np.searchsorted(edge, edge[row] + most, "right")) - 1, row + most))
        owner = np.repeat(np.arange(end - row), size[row:end])
        yield slice(row, end), owner, place[edge[row]:edge[end]], value[edge[row]:edge[end]]
        row = end


def _numbers(batch: pa.RecordBatch, rows: slice) -> np.ndarray:
    """How many equal rows each row stands for: the last column."""
    return batch.column(batch.num_columns - 1).slice(rows.start, rows.stop - rows.start).to_numpy(zero_copy_only=False).astype(np.float64)


def _margins(rows: int, owner: np.ndarray, place: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Products of sparse rows and weights (places + 1, labels), the last row being added to all."""
    out = np.repeat(weights[-1:], rows, axis=0)
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] += np.add.reduceat(weights[place] * value[:, None], first, axis=0)
    return out


def _gathered(rows: np.ndarray, owner: np.ndarray, place: np.ndarray, value: np.ndarray, into: np.ndarray) -> None:
    """Add value x rows[owner] to into[place]."""
    if len(owner):
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(place[order]) != 0]))
        into[place[order][first]] += np.add.reduceat(rows[owner[order]] * value[order, None], first, axis=0)


def _softmax(margins: np.ndarray) -> np.ndarray:
    p = np.exp(margins - margins.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _summed(rows: DataFrame, parts: int) -> DataFrame:
    """Sums of `v` by (head, label): first by groups of about the square root of the number of tasks, then over these."""
    def add(table: pa.Table) -> pa.Table:
        v = table.column("v").combine_chunks()
        keys = {c: [table.column(c)[0].as_py()] for c in table.column_names if c != "v"}
        return pa.table({**keys, "v": pa.array([v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)], pa.list_(pa.float64()))},
                        schema=pa.schema([*[(c, pa.int32()) for c in keys], ("v", pa.list_(pa.float64()))]))
    fan = max(1, int(parts ** 0.5))
    if fan > 3:
        rows = rows.select("head", "label", (F.col("part") % fan).alias("part"), "v").groupBy("head", "label", "part").applyInArrow(
            add, "head int, label int, part int, v array<double>")
    return rows.select("head", "label", "v").groupBy("head", "label").applyInArrow(add, "head int, label int, v array<double>")


def _task() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def _emit(head: int, vectors: np.ndarray) -> pa.RecordBatch:
    labels, width = vectors.shape
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, labels * width + 1, width, dtype=np.int32)), pa.array(vectors.reshape(-1)))
    whole = lambda n: pa.array(np.full(labels, n, np.int32))
    return pa.RecordBatch.from_arrays([whole(head), pa.array(np.arange(labels, dtype=np.int32)), whole(_task()), lists], names=["head", "label", "part", "v"])


_VECTORS = "head int, label int, part int, v array<double>"


def _moments(rows: DataFrame, heads: int, dim: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled rows of each head, and the standard deviation of each place over them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((heads, 2 * dim + 1))
        for batch in batches:
            for rows_, owner, place, value in _parts(batch, 0, 1, heads):
                n = _numbers(batch, rows_)
                for h in range(heads):
                    good = batch.column(2 + h).slice(rows_.start, rows_.stop - rows_.start).to_numpy(zero_copy_only=False) >= 0
                    in_ = good[owner]
                    sums[h, :dim] += np.bincount(place[in_], (n[owner] * value)[in_], dim)
                    sums[h, dim:-1] += np.bincount(place[in_], (n[owner] * value ** 2)[in_], dim)
                    sums[h, -1] += n[good].sum()
        for h in range(heads):
            yield _emit(h, sums[h:h + 1])
    n, deviation = np.zeros(heads), np.zeros((heads, dim))
    for r in _summed(rows.mapInArrow(run, _VECTORS), parts).collect():  # one row per head
        v = np.array(r.v)
        n[r.head] = v[-1]
        spread = (v[dim:-1] - v[:dim] ** 2 / max(v[-1], 1)) / max(v[-1] - 1, 1)
        deviation[r.head] = np.sqrt(np.maximum(spread, 0))
    return n, deviation


def _losses(rows: DataFrame, weights: list[np.ndarray], parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Summed log losses of the heads and their gradients by the weights, over all rows, in one pass."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)  # places x labels of all heads
    edge = np.concatenate([[0], np.cumsum([w.shape[1] for w in weights])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.concatenate(shared.value, axis=1)
        gradient, loss = np.zeros_like(wide), np.zeros(len(edge) - 1)
        for batch in batches:
            for rows_, owner, place, value in _parts(batch, 0, 1, wide.shape[1]):
                count = rows_.stop - rows_.start
                n = _numbers(batch, rows_)
                margins = _margins(count, owner, place, value, wide)
                for h, (a, b) in enumerate(zip(edge, edge[1:])):
                    label = batch.column(2 + h).slice(rows_.start, count).to_numpy(zero_copy_only=False)
                    good = np.flatnonzero(label >= 0)
                    p = _softmax(margins[:, a:b])
                    loss[h] -= (n[good] * np.log(np.maximum(p[good, label[good]], 1e-300))).sum()
                    p[good, label[good]] -= 1
                    p[label < 0] = 0
                    margins[:, a:b] = p
                margins *= n[:, None]
                _gathered(margins, owner, place, value, gradient)
                gradient[-1] += margins.sum(axis=0)
        for h, (a, b) in enumerate(zip(edge, edge[1:])):
            yield _emit(h, np.concatenate([gradient[:, a:b].T, np.full((b - a, 1), loss[h] / (b - a))], axis=1))
    loss, gradient = np.zeros(len(weights)), [np.zeros_like(w) for w in weights]
    try:
        for r in _summed(rows.mapInArrow(run, _VECTORS), parts).collect():  # one row per label
            v = np.array(r.v)
            loss[r.head] += v[-1]
            gradient[r.head][:, r.label] = v[:-1]
    finally:
        shared.destroy()
    return loss, gradient


# --- training --------------------------------------------------------------------------------------------------
class _Steps:
    """Limited-memory quasi-Newton steps with backtracking; one function value and gradient is told per round."""

    def __init__(self, start: np.ndarray, memory: int = 10):
        self.x = self.trial = start
        self.f, self.g, self.step = np.inf, None, 1.0
        self.memory, self.moves, self.settled = memory, [], False

    def tell(self, f: float, g: np.ndarray) -> None:
        if self.g is not None and f > self.f + 1e-4 * self.step * float((self.g * self.way).sum()):
            self.step *= 0.3
            self.settled = self.step < 1e-8
        else:
            if self.g is not None:
                s, y = self.trial - self.x, g - self.g
                if (s * y).sum() > 1e-12:
                    self.moves = [*self.moves, (s, y)][-self.memory:]
                self.settled = self.f - f <= 1e-7 * max(abs(f), 1e-12)
            self.x, self.f, self.g = self.trial, f, g
            self.way = self._direction()
            self.step = 1.0 if self.moves else min(1.0, 1.0 / max(float(np.abs(g).sum()), 1e-12))
        self.trial = self.x + self.step * self.way

    def _direction(self) -> np.ndarray:
        q, used = self.g.copy(), []
        for s, y in reversed(self.moves):
            a = (s * q).sum() / (s * y).sum()
            used.append(a)
            q -= a * y
        if self.moves:
            s, y = self.moves[-1]
            q *= (s * y).sum() / (y * y).sum()
        for (s, y), a in zip(self.moves, reversed(used)):
            q += s * (a - (y * q).sum() / (s * y).sum())
        return -q


@dataclass
class Head:
    """Labels in order, weights (places + 1, labels), and the heads whose probabilities follow the text's places."""

    labels: list[str]
    weights: np.ndarray
    inputs: tuple[str, ...] = ()


def fit_heads(rows: DataFrame, labels: dict[str, Column], dim: int, iterations: int = 20, penalty: float = 0.01,
              inputs: tuple[str, ...] = ()) -> dict[str, Head]:
    """All heads at once on sparse rows (_at, _x), of which each counts `_n` times if there is such a column; a head
    learns from the rows on which its label is not null.

    Each minimises its mean log loss plus penalty / 2 x the squared weights of features scaled to unit deviation, as a
    separate multinomial regression would. `iterations` bounds the rounds, of which each is one pass over the rows for
    all heads; a head without labels predicts nothing. Labels, in order of their text, and weights are held by the driver.
    """
    names = list(labels)
    values = each(rows.select(F.array(*[F.struct(F.lit(i).alias("h"), labels[n].cast("string").alias("v")) for i, n in enumerate(names)]).alias("_l")),
                  F.col("_l"), "e").select("e.h", "e.v").where("v IS NOT NULL").distinct()
    known: dict[str, list[str]] = {n: [] for n in names}
    for r in values.collect():  # the closed lists of labels
        known[names[r.h]].append(r.v)
    known = {n: sorted(v) for n, v in known.items()}
    index = [F.coalesce(F.array_position(F.lit(known[n]).cast("array<string>"), labels[n].cast("string")) - 1, F.lit(-1)).cast("int").alias(f"_y{i}") if known[n]
             else F.lit(-1).alias(f"_y{i}") for i, n in enumerate(names)]
    number = F.col("_n") if "_n" in rows.columns else F.lit(1)
    stored = written(rows.select("_at", "_x", *index, number.cast("long").alias("_n")), "sparse")
    parts = stored.rdd.getNumPartitions()
    n, deviation = _moments(stored, len(names), dim, parts)
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    steps = [_Steps(np.zeros((dim + 1, max(1, len(known[name]))))) for name in names]
    raw = lambda h, w: np.concatenate([w[:-1] * scale[h][:, None], w[-1:]])
    for _ in range(iterations):
        loss, gradient = _losses(stored, [raw(h, s.trial) for h, s in enumerate(steps)], parts)
        for h, s in enumerate(steps):
            flat = s.trial.copy()
            flat[-1] = 0
            total = max(n[h], 1)
            if not s.settled:
                s.tell(loss[h] / total + penalty / 2 * float((flat ** 2).sum()), raw(h, gradient[h]) / total + penalty * flat)
        if all(s.settled for s in steps):
            break
    return {name: Head(known[name], raw(h, s.x), inputs) for h, (name, s) in enumerate(zip(names, steps))}


@dataclass
class TextModels:
    """Shared text features and one label model per field."""

    features: TextFeatures
    heads: dict[str, Head] = field(default_factory=dict)


def _distinct(df: DataFrame, **columns: Column) -> DataFrame:
    """The distinct rows of some columns with their numbers (_n), stored in as many files as there are cores at least: rows of
    a text that many products share are learned from once, and few bytes of many rows are not left to one task."""
    named = [c.alias(name) for name, c in columns.items()]
    cores = df.sparkSession.sparkContext.defaultParallelism
    return written(df.select(*named).groupBy(*columns).agg(F.count("*").alias("_n")).repartition(cores), "distinct")


def _sparse(df: DataFrame, features: TextFeatures) -> DataFrame:
    return df.withColumns(dict(zip(("_at", "_x"), features.columns())))


def train_attribute_models(df: DataFrame, attributes: Sequence[str], text: str = "text_input", dim: int = 1024,
                           iterations: int = 20, features: TextFeatures | None = None) -> TextModels:
    """One classifier per attribute; rows without that label are left out of its training."""
    fitted = features or text_features(df, text, dim)
    rows = _distinct(df, **{fitted.text: F.col(fitted.text)}, **{f"_{i}": F.col(a) for i, a in enumerate(attributes)})
    return TextModels(fitted, fit_heads(_sparse(rows, fitted), {a: F.col(f"_{i}") for i, a in enumerate(attributes)}, fitted.dim, iterations))


def train_taxonomy_models(df: DataFrame, levels: int, path: str = "taxonomy", text: str = "text_input", dim: int = 1024,
                          iterations: int = 20, features: TextFeatures | None = None) -> TextModels:
    """One classifier per taxonomy level; products with fewer levels are left out there."""
    fitted = features or text_features(df, text, dim)
    rows = _distinct(df, **{fitted.text: F.col(fitted.text)}, **{f"level_{i + 1}": F.get(path, F.lit(i)) for i in range(levels)})
    return TextModels(fitted, fit_heads(_sparse(rows, fitted), {f"level_{i + 1}": F.col(f"level_{i + 1}") for i in range(levels)}, fitted.dim, iterations))


def train_class_model(df: DataFrame, levels: TextModels, cls: str = "product_class", iterations: int = 20) -> TextModels:
    """Class model that sees the text features and the probabilities of every level."""
    names = tuple(levels.heads)
    rows = _distinct(df, **{levels.features.text: F.col(levels.features.text)}, _class=F.col(cls))
    probabilities = _apply(_sparse(rows, levels.features), levels, ["_class", "_n"], True)
    wide = levels.features.dim + sum(len(levels.heads[n].labels) for n in names)
    return TextModels(levels.features, {**levels.heads, **fit_heads(probabilities, {"product_class": F.col("_class")}, wide, iterations, inputs=names)})


# --- prediction ------------------------------------------------------------------------------------------------------
def _probabilities(models: TextModels, rows: int, owner: np.ndarray, place: np.ndarray, value: np.ndarray) -> dict[str, np.ndarray]:
    """Each head's probabilities; heads with inputs come after these."""
    dim = models.features.dim
    out: dict[str, np.ndarray] = {}
    for name, head in models.heads.items():
        margins = _margins(rows, owner, place, value, np.concatenate([head.weights[:dim], head.weights[-1:]]))
        if head.inputs:
            margins += np.concatenate([out[n] for n in head.inputs], axis=1) @ head.weights[dim:-1]
        out[name] = _softmax(margins) if head.labels else np.zeros((rows, 0))
    return out


def _apply(df: DataFrame, models: TextModels, keep: Sequence[str], widen: bool) -> DataFrame:
    """Per row the kept columns with, if `widen`, the sparse features followed by the probabilities of all heads (_at, _x), else
    one row per head (i, field, val, confidence)."""
    shared = df.sparkSession.sparkContext.broadcast(models)
    columns = len(keep)
    wide = sum(h.weights.shape[1] for h in models.heads.values())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for rows, owner, place, value in _parts(batch, columns, columns + 1, wide):
                count = rows.stop - rows.start
                kept = [batch.column(c).slice(rows.start, count) for c in range(columns)]
                found = _probabilities(m, count, owner, place, value)
                if widen:
                    p = np.concatenate(list(found.values()), axis=1)
                    more = np.broadcast_to(m.features.dim + np.arange(p.shape[1]), p.shape)
                    of = np.concatenate([owner, np.repeat(np.arange(count), p.shape[1])])
                    order = np.argsort(of, kind="stable")
                    edge = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=count))]).astype(np.int32))
                    at = pa.array(np.concatenate([place, more.reshape(-1)])[order].astype(np.int32))
                    x = pa.array(np.concatenate([value, p.reshape(-1)])[order])
                    yield pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(edge, at), pa.ListArray.from_arrays(edge, x)], names=[*keep, "_at", "_x"])
                    continue
                for i, (name, p) in enumerate(found.items()):
                    labels = m.heads[name].labels
                    best = p.argmax(axis=1) if labels else np.zeros(count, np.int64)
                    val = pa.array(labels, pa.string()).take(pa.array(best)) if labels else pa.nulls(count, pa.string())
                    sure = p[np.arange(count), best] if labels else np.zeros(count)
                    yield pa.RecordBatch.from_arrays([*kept, pa.array(np.full(count, i, np.int32)), pa.array([name] * count), val, pa.array(sure)],
                                                     names=[*keep, "i", "field", "val", "confidence"])
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    tail = "_at array<int>, _x array<double>" if widen else "i int, field string, val string, confidence double"
    return df.select(*keep, "_at", "_x").mapInArrow(run, f"{kinds}, {tail}")


def predict_with_confidence(df: DataFrame, models: TextModels, threshold: float = 0.5, key: str = "product_id") -> DataFrame:
    """(key, i, field, val, confidence, needs_vlm) in long form, ready for the routing operators; all heads in one pass.

    A null text is predicted from the intercepts; a head that saw no label gives a null value with confidence 0.
    """
    long = _apply(_sparse(df, models.features), models, [key], False)
    return long.withColumn("needs_vlm", F.col("confidence") < threshold)
