"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, table distances, exact rerank."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept
from .graph import components, join_labels


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Centres by Lloyd's method from a seeded choice of rows; an empty centre keeps its place."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, centre)
        count = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        full = count > 0
        centre[full] = total[full] / count[full, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre * centre).sum(1) / 2
    return np.concatenate([(half - x[at:at + 4096] @ centre.T).argmin(1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


class Codebook:
    """Coarse centres and, per subspace of the residuals, 2 ** bits codewords."""

    def __init__(self, x: np.ndarray, lists: int, parts: int, words: int = 256):
        self.coarse = kmeans(x, lists)
        rest = x - self.coarse[nearest(x, self.coarse)]
        parts = max(1, min(parts, x.shape[1]))
        self.edges = np.linspace(0, x.shape[1], parts + 1).round().astype(int)
        self.words = [kmeans(rest[:, a:b], words, seed=7 + i) for i, (a, b) in enumerate(zip(self.edges, self.edges[1:]))]

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """List, residual codes, and distance to the vector that the codes stand for."""
        home = nearest(x, self.coarse)
        rest = x - self.coarse[home]
        codes = np.stack([nearest(rest[:, a:b], w) for a, b, w in zip(self.edges, self.edges[1:], self.words)], 1).astype(np.uint8)
        again = np.concatenate([w[codes[:, i]] for i, w in enumerate(self.words)], 1)
        return home, codes, np.sqrt(((rest - again) ** 2).sum(1))

    def tables(self, q: np.ndarray, home: int) -> list[np.ndarray]:
        """Per subspace, squared distances of each query's residual in a list to every codeword, in single precision."""
        rest = q - self.coarse[home]
        return [(((rest[:, a:b] ** 2).sum(1)[:, None] - 2 * rest[:, a:b] @ w.T) + (w * w).sum(1)[None]).astype(np.float32)
                for a, b, w in zip(self.edges, self.edges[1:], self.words)]

    def visits(self, x: np.ndarray, radius: float, near: int = 8) -> list[list[int]]:
        """Lists of each vector that may hold a partner within `radius`.

        A partner in the list of centre c is no farther from c than from any other centre o, so the vector lies within the
        radius of the half-space nearer to c: (d(x, c)^2 - d(x, o)^2) / (2 d(c, o)) <= radius, asked for its `near` nearest centres.
        """
        square = np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ self.coarse.T + (self.coarse ** 2).sum(1)[None])
        between = np.sqrt(np.maximum(0, (self.coarse ** 2).sum(1)[:, None] - 2 * self.coarse @ self.coarse.T + (self.coarse ** 2).sum(1)[None]))
        reach = np.full(square.shape, -np.inf)
        order = np.argsort(square, axis=1)[:, :near]
        for k in range(order.shape[1]):
            apart = between[order[:, k]]
            with np.errstate(divide="ignore", invalid="ignore"):
                bound = (square - np.take_along_axis(square, order[:, k:k + 1], 1)) / (2 * apart)
            reach = np.maximum(reach, np.where(apart > 1e-9, bound, -np.inf))
        return [np.flatnonzero(r <= radius).tolist() for r in reach]


def _unit(frame_vectors) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double precision, and whether each was usable."""
    good = np.array([v is not None and len(v) > 0 and not any(c is None for c in v) and bool(np.isfinite(np.asarray(v, np.float64)).all()) and any(c != 0 for c in v)
                     for v in frame_vectors], bool)
    x = np.array([np.asarray(v, np.float64) for v, g in zip(frame_vectors, good) if g])
    if len(x):
        x = x / np.abs(x).max(1, keepdims=True)
        x = x / np.sqrt((x * x).sum(1, keepdims=True))
    return x, good


def vectors(table: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """Distinct usable vectors of a label: (label, vec, least id, copies)."""
    usable = F.col(vec_col).isNotNull() & F.col(label_col).isNotNull() & ~F.exists(vec_col, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(vec_col, lambda c: c != 0)
    return table.where(usable).groupBy(F.col(label_col).alias("label"), F.col(vec_col).cast("array<double>").alias("vec")).agg(F.min(id_col).alias("least"), F.count("*").alias("copies"))


def near_vectors(table: DataFrame, share: float = 0.98, train_rows: int = 20_000, per_list: int | None = None, parts: int = 16, most: int = 2_048, books: int = 16,
                 id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Links between vectors of the same label with cosine `share` or more: (id, n_links, component_id, kept), one row per input row.

    Equal vectors collapse first. Coarse centres and codewords are learned on at most about `train_rows` distinct vectors,
    chosen by hash, for each of the `books` most frequent widths; there are as many lists as the square root of the largest
    label's vectors (or one for each `per_list`), at most train_rows / 40. Every vector is indexed; vectors of other widths make one list of each
    label and width. Probes are sufficient: a vector visits every list on whose side of the bisectors between the centres
    a partner within the link radius can lie; a coded partner passes if its table distance, in single precision with room
    for its rounding, is within the radius plus its own coding error, which the true distance cannot undercut; what passes
    is compared exactly in double precision. So no link is lost but by rounding. A list with more than `most` vectors
    is dealt into parts, and all visitors see every part. A task sends counts and one link per vector and part, never
    the pairs.

    Vectors that are null, empty, zero or hold null or non-finite components and those with a null label link with nothing:
    they are their own component; vectors link within one length only. A null id is counted in its partners' links but is
    no candidate for the smallest id. Repeated rows are each returned; other columns are left aside; an empty table gives
    an empty result.
    """
    spark = table.sparkSession
    rows = table.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    distinct = kept(vectors(rows, "id", "vec", "label").withColumn("node", F.xxhash64("label", "vec")), "vectors")
    sizes = distinct.groupBy("label").count().agg(F.sum("count").alias("all"), F.max("count").alias("most")).first()  # one row
    number = sizes["all"] or 0
    out_columns = [F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")]
    if not number:
        return rows.select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id")).select(*out_columns)
    radius = float(np.sqrt(2 - 2 * share)) + 1e-6
    sample = distinct.where(F.pmod(F.xxhash64("vec", F.lit(9)), F.lit(1 << 30)) < F.lit(int(min(1.0, train_rows / number) * (1 << 30)))).select("vec").toPandas()
    if not len(sample):
        sample = distinct.select("vec").limit(train_rows).toPandas()
    lists = max(1, min(sizes["most"] // per_list if per_list else int(sizes["most"] ** 0.5), train_rows // 40))
    widths = sample["vec"].map(len)
    shelf = {int(w): Codebook(_unit(sample["vec"][widths == w])[0], max(1, min(lists, int((widths == w).sum()) // 8)), parts) for w in widths.value_counts().index[:books]}
    shelf = spark.sparkContext.broadcast(shelf)  # size bound by train_rows, the widths and `books`

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for width, f in f.groupby(f["vec"].map(len)):
                x, _ = _unit(f["vec"])
                book = shelf.value.get(int(width))
                if book is None:
                    home, codes, error, visits = np.zeros(len(x), int), np.zeros((len(x), 0), np.uint8), np.zeros(len(x)), [[0]] * len(x)
                else:
                    home, codes, error = book.encode(x)
                    visits = [v for at in range(0, len(x), 1_024) for v in book.visits(x[at:at + 1_024], radius)]
                yield pd.DataFrame({"node": f["node"], "label": f["label"], "width": int(width), "copies": f["copies"], "home": home, "error": error,
                                    "codes": [c.tobytes() for c in codes], "unit": [v.tobytes() for v in x], "visits": visits})

    indexed = kept(distinct.select("node", "label", "copies", "vec").mapInPandas(
        index, f"node bigint, label {rows.schema['label'].dataType.simpleString()}, width int, copies bigint, home int, error double, codes binary, unit binary, visits array<int>"), "indexed")
    sizes = indexed.groupBy("label", "width", "home").agg(F.ceil(F.count("*") / most).cast("int").alias("parts"))
    items = indexed.join(sizes, ["label", "width", "home"]).select(
        "label", "width", F.col("home").alias("list"), F.pmod(F.xxhash64("node", F.lit(3)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("role"), "node", "copies", "error", "codes", "unit")
    visitors = (indexed.select("label", "width", "node", "copies", "unit", F.explode("visits").alias("list"))
                .join(sizes.withColumnRenamed("home", "list"), ["label", "width", "list"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .select("label", "width", "list", "part", F.lit(1).alias("role"), "node", "copies", F.lit(0.0).alias("error"), F.lit(None).cast("binary").alias("codes"), "unit"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, held = None, []
        state: dict = {}

        def open_block(f: pd.DataFrame, width: int, home: int) -> None:
            state.update(book=shelf.value.get(width), node=f["node"].to_numpy(), copies=f["copies"].to_numpy(), unit=np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1), home=home,
                         codes=np.frombuffer(b"".join(f["codes"]), np.uint8).reshape(len(f), -1), reach=((radius + f["error"].to_numpy()) ** 2 + 1e-5).astype(np.float32))
            state["label"], state["names"] = np.arange(len(f)), state["node"]

        def visit(f: pd.DataFrame) -> pd.DataFrame | None:
            q = np.frombuffer(b"".join(f["unit"]), np.float64).reshape(len(f), -1)
            nodes = f["node"].to_numpy()
            links, a, b = np.zeros(len(f), np.int64), [], []
            label = np.arange(len(state["node"]) + len(f))
            place = {n: i for i, n in enumerate(state["node"].tolist())}
            own = np.array([place.get(n, len(state["node"]) + i) for i, n in enumerate(nodes.tolist())])
            for at in range(0, len(f), 256):
                part = q[at:at + 256]
                if state["book"] is None:
                    i, j = np.nonzero(part @ state["unit"].T >= share - 1e-9)
                else:
                    distance = np.zeros((len(part), len(state["node"])), np.float32)
                    for i, t in enumerate(state["book"].tables(part, state["home"])):
                        distance += t[:, state["codes"][:, i]]
                    i, j = np.nonzero(distance <= state["reach"][None, :])
                real = (np.einsum("ij,ij->i", part[i], state["unit"][j]) >= share) & (nodes[at + i] != state["node"][j])
                i, j = i[real], j[real]
                np.add.at(links, at + i, state["copies"][j])
                label = join_labels(label, own[at + i], j)
            names = np.concatenate([state["node"], nodes])
            to = np.flatnonzero(label != np.arange(len(label)))
            hit = np.flatnonzero(links)
            return pd.DataFrame({"node": np.concatenate([nodes[hit], names[to]]), "other": np.concatenate([nodes[hit], names[label[to]]]),
                                 "links": np.concatenate([links[hit], np.zeros(len(to), np.int64)])})

        for f in frames:
            for key, g in f.groupby(["label", "width", "list", "part"], sort=False):
                if key != now:
                    now, held = key, []
                    state.clear()
                items = g[g["role"] == 0]
                if len(items):
                    held.append(items)
                guests = g[g["role"] == 1]
                if len(guests):
                    if not state and held:  # items come first
                        open_block(pd.concat(held), int(key[1]), int(key[2]))
                    if state:
                        yield visit(guests)

    found = kept(items.unionByName(visitors).repartition("label", "width", "list", "part").sortWithinPartitions("label", "width", "list", "part", "role")
                 .mapInPandas(run, "node bigint, other bigint, links bigint"), "found")
    counted = found.where("links > 0").groupBy("node").agg(F.sum("links").alias("links"))
    grouped = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    base = distinct.select("node", "label", "vec", "least", "copies").join(counted, "node", "left").join(grouped, "node", "left").withColumn("component", F.coalesce("component", "node"))
    base = kept(base, "classes")
    lowest = base.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = kept(base.join(lowest, "component").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "placed")
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & ~F.exists("vec", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists("vec", lambda c: c != 0)
    keyed = kept(rows.select("id", F.when(usable, F.xxhash64("label", F.col("vec").cast("array<double>"))).alias("node")), "rows")
    joined = keyed.join(classes, "node", "left")
    return joined.select("id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "id").alias("component_id")).select(*out_columns)
