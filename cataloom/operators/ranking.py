"""Ranking, top-k, exact order statistics and run detection.

A window that must see a whole group is only used where the group is bounded.  Where one
group may hold a large part of the table, the work is split:

* `bucketed_rank` ranks inside order-preserving buckets and adds per-bucket offsets;
* `order_statistics` narrows to a sliver of values with a sketch, then counts exactly;
* `failure_streaks` scans time chunks and carries a summary from chunk to chunk;
* top-k filters on `row_number` are planned with a per-partition limit before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.text import let


def _same(left: str, right: str, keys: Sequence[str]):
    return [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]


def bucketed_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], bucket: Column, rank: str = "rnk",
                  total: str | None = None) -> DataFrame:
    """Exact 1-based rank inside `by` along `order`, without collecting a group in one task.

    `bucket` must not decrease along `order`; ranks are counted inside (by, bucket) and
    shifted by the sizes of the buckets before.  `total` adds the group size.
    """
    by = list(by)
    keyed = df.withColumn("_bucket", bucket)
    sizes = keyed.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_before"),
                           F.sum("_n").over(whole).alias("_total"))
    inside = keyed.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order)))
    joined = inside.alias("a").join(offsets.alias("b"), _same("a", "b", [*by, "_bucket"]))
    extra = [F.col("_total").alias(total)] if total else []
    return joined.select(*[F.col(f"a.{c}") for c in df.columns],
                         (F.col("_in") + F.col("_before")).cast("long").alias(rank), *extra)


def hash_order(seed: int | str, *ids: str) -> Column:
    """Deterministic shuffle key: md5 of seed and ids, the same for any partitioning."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def shuffled_rank(df: DataFrame, by: Sequence[str], seed: int | str, ids: Sequence[str], rank: str = "rnk",
                  total: str | None = None, digits: int = 3) -> DataFrame:
    """Rank in md5 order; `digits` hex digits give 16^digits even buckets per group."""
    keyed = df.withColumn("_h", hash_order(seed, *ids))
    out = bucketed_rank(keyed, by, [F.col("_h"), *[F.col(i) for i in ids]], F.substring("_h", 1, digits), rank, total)
    return out.drop("_h")


def order_statistics(df: DataFrame, value: str, targets: dict[str, tuple[float, Column]], by: Sequence[str] = (),
                     count: str = "n", accuracy: int = 100_000) -> DataFrame:
    """Exact order statistics: for each target the value at a 0-based rank.

    A target is (fraction, rank), the rank a Column over the group size `n` within one of
    fraction x n.  A quantile sketch bounds each answer between two values; the rows below
    are counted and only the distinct values in between, a few in `accuracy` of all, are
    ordered.  Groups too small for the sketch to matter are ordered whole.
    """
    by = list(by)
    names = list(targets)
    base = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    margin = 2.0 / accuracy  # twice the sketch error on each side
    edges = [min(1.0, max(0.0, f + side * margin)) for f, _ in targets.values() for side in (-1, 1)]
    sketch = base.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", edges, accuracy).alias("_q"),
                                   F.min("_v").alias("_min"), F.max("_v").alias("_max"))

    def bracket(i: int, name: str) -> Column:
        whole = F.col("n") < 10 * accuracy
        lo = F.col("_min") if edges[2 * i] <= 0 else F.when(whole, F.col("_min")).otherwise(F.get("_q", F.lit(2 * i)))
        hi = F.col("_max") if edges[2 * i + 1] >= 1 else F.when(whole, F.col("_max")).otherwise(F.get("_q", F.lit(2 * i + 1)))
        return F.struct(F.lit(name).alias("name"), targets[name][1].cast("long").alias("at"), lo.alias("lo"), hi.alias("hi"))
    bounds = sketch.select(*by, "n", F.array(*[bracket(i, t) for i, t in enumerate(names)]).alias("_b"))
    if by:
        joined = base.alias("a").join(bounds.alias("b"), _same("a", "b", by)).select(
            *[F.col(f"a.{k}") for k in by], "_v", "_b")
    else:
        joined = base.crossJoin(F.broadcast(bounds.select("_b")))  # exactly one row
    # one record per (target, value inside its bracket) after the map-side combine; rows below collapse to one
    hit = let(F.col("_v"), lambda v: F.filter(F.transform("_b", lambda b: F.struct(
        b["name"].alias("name"), b["at"].alias("at"), F.when(v >= b["lo"], v).alias("v"), (v <= b["hi"]).alias("keep"))),
        lambda h: h["keep"]))
    counted = joined.select(*by, F.explode(hit).alias("h")).groupBy(*by, "h.name", "h.at", "h.v").agg(
        F.count("*").alias("_c"))
    run = Window.partitionBy(*by, "name").orderBy(F.col("v").asc_nulls_first())
    found = counted.withColumn("_cum", F.sum("_c").over(run)).filter(
        F.col("v").isNotNull() & (F.col("_cum") > F.col("at")))
    picked = found.groupBy(*by).agg(*[F.min(F.when(F.col("name") == t, F.col("v"))).alias(t) for t in names])
    totals = bounds.select(*by, F.col("n").alias(count))
    if by:
        return totals.alias("a").join(picked.alias("b"), _same("a", "b", by)).select(
            *[F.col(f"a.{k}") for k in by], count, *names)
    return totals.crossJoin(F.broadcast(picked))  # one row each


def interpolated_percentiles(df: DataFrame, value: str, fractions: dict[str, float], by: Sequence[str] = (),
                             count: str = "n", accuracy: int = 100_000) -> DataFrame:
    """Exact linearly interpolated percentiles built from two neighbouring order statistics."""
    def position(f: float) -> Column:
        return F.lit(f) * (F.col("n") - 1)
    targets = {}
    for name, f in fractions.items():
        targets[f"_{name}_lo"] = (f, F.floor(position(f)))
        targets[f"_{name}_hi"] = (f, F.ceil(position(f)))
    stats = order_statistics(df, value, targets, by, "n", accuracy)
    out = [(F.col(f"_{n}_lo") + (position(f) - F.floor(position(f))) * (F.col(f"_{n}_hi") - F.col(f"_{n}_lo"))).alias(n)
           for n, f in fractions.items()]
    return stats.select(*by, F.col("n").alias(count), *out)


# --- top-k and re-ranking -------------------------------------------------------------------
def topk_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rnk") -> DataFrame:
    """The k best rows per key with ranks from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def final_rank(df: DataFrame, key: str, score: str, previous: str, rank: str = "final_rank") -> DataFrame:
    """Re-rank candidate lists by a new score; equal scores keep the previous order.

    For candidate lists, which an earlier top-k has bounded per key.
    """
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(previous).asc())
    return df.withColumn(rank, F.row_number().over(w))


def best_candidate(df: DataFrame, key: str, score: str, position: str) -> DataFrame:
    """Highest non-negative score per key, earliest position on ties; keys without one vanish."""
    payload = F.struct(*[c for c in df.columns if c != key])
    best = df.filter(F.col(score) >= 0).groupBy(key).agg(
        F.max_by(payload, F.struct(F.col(score), -F.col(position))).alias("_r"))
    return best.select(key, "_r.*")


def latest_per_key(df: DataFrame, key: str, sequence: str) -> DataFrame:
    """Last record per key; an aggregate, so it combines before the shuffle."""
    payload = F.struct(*[c for c in df.columns if c != key])
    return df.groupBy(key).agg(F.max_by(payload, F.col(sequence)).alias("_r")).select(key, "_r.*")


def first_relevant(df: DataFrame, key: str, rank: str, relevance: str, threshold: int = 1) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.when(F.col(relevance) >= threshold, F.col(rank))).alias("first_relevant"))


def sort_by_score(df: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return df.orderBy(F.col(score).desc(), F.col(tie).asc()).limit(n)


def taxonomy_prefix_cut(levels: Column, threshold: float = 0.5) -> Column:
    """Levels (array<struct<value,confidence>>) up to the first weak or unknown one."""
    bad = F.transform(levels, lambda l: (l["confidence"] < threshold) | (l["value"] == lx.UNKNOWN) | l["value"].isNull())
    first_bad = F.array_position(bad, F.lit(True))
    return F.when(first_bad > 0, F.slice(levels, F.lit(1), (first_bad - 1).cast("int"))).otherwise(levels)


def pick_hero_image(products: DataFrame, files: DataFrame, key: str = "product_id",
                    extensions: Sequence[str] = lx.HERO_EXTENSIONS) -> DataFrame:
    """Hero image and material crop per product by extension priority, has_image and file count."""
    name = F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    order = F.array_position(F.lit(list(extensions)), ext)
    marked = files.withColumns({"_role": name, "_order": order})

    def pick(role: str) -> Column:
        use = (F.col("_role") == role) & (F.col("_order") > 0)
        return F.min_by(F.when(use, F.col("path")), F.when(use, F.struct("_order", "path")))
    images = marked.groupBy(key).agg(pick("hero").alias("hero"), pick("material_crop").alias("material_crop"),
                                     F.count("*").alias("_files"))
    return products.join(images, key, "left").withColumn("image_count", F.coalesce("_files", F.lit(0))).withColumn(
        "has_image", F.col("hero").isNotNull()).drop("_files")


# --- balanced selection -----------------------------------------------------------------------
def class_tier(size: Column, tiers: list[tuple[str, int, int]] = lx.CLASS_TIERS) -> Column:
    """struct(tier, cap) for a class size."""
    chain = F
    for name, least, cap in tiers:
        chain = chain.when(size >= least, F.struct(F.lit(name).alias("tier"), F.lit(cap).alias("cap")))
    return chain.otherwise(None)


def balanced_queue(df: DataFrame, score: str = "attr_score", id_col: str = "product_id",
                   tiers: list[tuple[str, int, int]] = lx.CLASS_TIERS) -> DataFrame:
    """Best rows per class, capped by the tier of the class size.

    Sizes come from one combined count.  A tier's cap is never above the cap of the
    smallest tier it can meet, so the rank filter stops at the largest useful cap and each
    map task forwards at most that many rows per class.
    """
    cls = F.coalesce(F.trim(F.substring_index("product_class", "|", 1)), F.lit("Unknown"))
    keyed = df.withColumn("class_clean", cls)
    sizes = keyed.groupBy("class_clean").agg(F.count("*").alias("class_size")).withColumn(
        "_t", class_tier(F.col("class_size"), tiers))
    # a class below the next tier's minimum cannot fill a larger cap
    useful = 0
    upper = None
    for _, least, cap in tiers:
        useful = max(useful, cap if upper is None else min(cap, upper - 1))
        upper = least
    top = topk_per_key(keyed, ["class_clean"], [F.col(score).desc(), F.col(id_col).asc()], useful, "class_rank")
    return top.join(sizes, "class_clean").filter(F.col("class_rank") <= F.col("_t.cap")).withColumn(
        "tier", F.col("_t.tier")).drop("_t")


# --- runs of failures ---------------------------------------------------------------------------
def failure_streaks(log: DataFrame, key: str, order: Sequence[str], failed: str, chunk: Column, n: int = 15) -> DataFrame:
    """Position of each failed row in its run of consecutive failures; every n-th is flagged.

    `chunk` is a column that does not decrease along `order` (a day, an hour).  Chunks are
    scanned in parallel; only one summary row per (key, chunk) goes through the carry window.
    """
    bad = F.col(failed)
    rows = log.withColumn("_chunk", chunk).withColumn("_ok", F.when(bad, 0).otherwise(1))
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    marked = rows.withColumn("_island", F.sum("_ok").over(inside))
    run = Window.partitionBy(key, "_chunk", "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_pos", F.sum(F.when(bad, 1).otherwise(0)).over(run))
    # trailing failures per chunk and whether the chunk had a success
    last_ok = rows.groupBy(key, "_chunk").agg(
        F.max(F.when(~bad, F.struct(*order))).alias("_last_ok"), F.max("_ok").alias("_had_ok"))
    tail = rows.join(last_ok, [key, "_chunk"]).groupBy(key, "_chunk").agg(
        F.max("_had_ok").alias("_had_ok"),
        F.sum(F.when(bad & (F.col("_last_ok").isNull() | (F.struct(*order) > F.col("_last_ok"))), 1).otherwise(0))
        .alias("_tail"))
    by_chunk = Window.partitionBy(key).orderBy("_chunk")
    grouped = tail.withColumn("_g", F.sum("_had_ok").over(by_chunk))
    carried = grouped.withColumn("_run", F.sum("_tail").over(Window.partitionBy(key, "_g").orderBy("_chunk")))
    carry = carried.withColumn("_carry", F.coalesce(F.lag("_run").over(by_chunk), F.lit(0))).select(key, "_chunk", "_carry")
    out = local.join(carry, [key, "_chunk"]).withColumn(
        "streak", F.when(bad, F.col("_pos") + F.when(F.col("_island") == 0, F.col("_carry")).otherwise(0)).otherwise(0))
    return out.select(*log.columns, F.when(F.col("streak") > 0, F.pmod(F.col("streak") - 1, F.lit(n)) + 1).otherwise(0)
                      .cast("long").alias("streak"),
                      ((F.col("streak") > 0) & (F.pmod(F.col("streak"), F.lit(n)) == 0)).alias("flagged"))
