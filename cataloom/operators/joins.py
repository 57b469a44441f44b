"""Joins that assemble training pairs, attach side tables and resume work."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.keywords import plain_text
from ..functions.text import each, search_text, text_or_empty
from ..session import written


def _literal(c: Column, table: dict) -> Column:
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), c)


def product_texts(products: DataFrame) -> DataFrame:
    return products.select("product_id", "product_name", search_text(
        F.col("product_name"), F.col("product_class"), F.col("product_description")).alias("product_text"))


def relevance_pairs(labels: DataFrame, queries: DataFrame, products: DataFrame, training: bool = True) -> DataFrame:
    """Labels with query and product text; training pairs need a text, test pairs keep an empty one."""
    q = queries.filter(text_or_empty(F.col("query")) != "").select("query_id", "query")
    pairs = labels.join(q, "query_id")
    texts = product_texts(products)
    if training:
        return pairs.join(texts.filter(F.col("product_text") != ""), "product_id").select(
            "query_id", "product_id", "query", "product_text", _literal(F.col("label"), lx.PAIR_SCORES).alias("score"), "label")
    return pairs.join(texts, "product_id", "left").select(
        "query_id", "product_id", "query", text_or_empty(F.col("product_text")).alias("product_text"),
        text_or_empty(F.col("product_name")).alias("product_name"),
        _literal(F.col("label"), lx.RELEVANCE).alias("relevance"), "label")


def attach_images(products: DataFrame, images: DataFrame) -> DataFrame:
    return products.join(images.select("product_id", "image_path"), "product_id", "left").withColumn(
        "has_image", F.col("image_path").isNotNull())


def align_predictions(pred: DataFrame, truth: DataFrame, key: str = "product_id", strict: bool = True) -> DataFrame:
    """Predictions with their truth by key; a record on one side only is an error.

    Records whose prediction or truth is null are dropped (columns `prediction`, `ground_truth`).
    """
    usable = F.col("prediction").isNotNull() & F.col("ground_truth").isNotNull()
    p = pred.withColumn("_p", F.lit(True))
    t = truth.withColumn("_t", F.lit(True))
    both = p.join(t, key, "full_outer" if strict else "inner")
    if strict:
        # one expression: a separate null filter would turn the outer join into an inner one
        lonely = F.col("_p").isNull() | F.col("_t").isNull()
        error = F.raise_error(F.concat(F.lit("record on one side only: "), F.col(key).cast("string"))).cast("boolean")
        return both.filter(F.when(lonely, error).otherwise(usable)).drop("_p", "_t")
    return both.filter(usable).drop("_p", "_t")


def skip_cached(products: DataFrame, cache: DataFrame, key: str = "product_id") -> tuple[DataFrame, DataFrame]:
    """(rows still to process, cached rows of the requested products)."""
    return products.join(cache.select(key), key, "left_anti"), cache.join(products.select(key), key, "left_semi")


def resume_queue(queue: DataFrame, manifest: DataFrame, retry_failed: bool = False, key: str = "product_id") -> DataFrame:
    """Queue without finished rows and, unless retried, without failed ones."""
    done = F.col("image_count") > 0
    failed = (F.col("image_count") == 0) & F.col("status").isin(lx.FAILED_STATUSES)
    skip = manifest.filter(done if retry_failed else done | failed)
    return queue.join(skip.select(key), key, "left_anti")


def missing_ids(wanted: DataFrame, present: DataFrame, key: str = "product_id") -> DataFrame:
    return wanted.join(present.select(key), key, "left_anti").select(key)


def _grams(text: Column, size: int) -> Column:
    """Distinct pieces of `size` letters of a plain text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?=(.{{{size}}}))"), F.lit(1)))


def keyword_candidates(texts: DataFrame, keywords: DataFrame, gram: int = 3) -> DataFrame:
    """(_row, kw) pairs worth a test, from `texts` (_row, _t) and `keywords` (kw), both in plain text.

    Each keyword is filed under the one of its `gram`-letter pieces that the fewest texts hold, a shorter one under itself,
    and meets only the texts that hold that piece. Plain text has 37 letters, so at most 37**gram pieces are counted. Keywords
    with a piece that no text holds are in no text.
    """
    sizes = [r.n for r in keywords.select(F.least(F.length("kw"), F.lit(gram)).alias("n")).distinct().collect()]  # 1 .. gram
    pieces = F.concat(*[_grams(F.col("_t"), n) for n in sorted(sizes)]) if sizes else F.array().cast("array<string>")
    held = each(texts, pieces, "gram", "_row")
    common = written(held.groupBy("gram").count(), "grams")
    own = F.when(F.length("kw") < gram, F.array("kw")).otherwise(_grams(F.col("kw"), gram))
    filed = each(keywords, own, "gram", "kw").join(common, "gram", "left")
    anchors = filed.groupBy("kw").agg(F.min_by("gram", F.struct(F.coalesce("count", F.lit(0)), "gram")).alias("gram"),
                                      F.min(F.coalesce("count", F.lit(0))).alias("n")).where("n > 0")
    return held.join(anchors.select("gram", "kw"), "gram").select("_row", "kw")


def keyword_join(docs: DataFrame, vocab: DataFrame, doc_key: str, text: str, gram: int | None = None) -> DataFrame:
    """Labels of a large vocabulary whose keyword is inside the text, best keyword first.

    `vocab` has keyword and label. Keywords meet texts through their rarest `gram` letters (three, or five for more than
    5,000 keywords) and are then looked for in full, so a text is tested against few keywords however large the vocabulary
    is; the plan has one branch. Texts are written once in plain form and shuffled once, by row, to meet their candidates.
    A null text holds nothing.
    """
    kw = written(vocab.select(F.trim(plain_text(F.col("keyword"))).alias("kw"), "label").filter(F.col("kw") != "").distinct(), "keywords")
    plain = written(docs.select(F.monotonically_increasing_id().alias("_row"), doc_key, plain_text(F.col(text)).alias("_t")), "plain")
    distinct = kw.select("kw").distinct()
    pairs = keyword_candidates(plain, distinct, gram or (3 if distinct.count() <= 5_000 else 5))
    found = plain.join(pairs, "_row").where(F.contains("_t", "kw")).select(doc_key, "kw").distinct()
    return found.join(kw, "kw").groupBy(doc_key, "label").agg(
        F.min_by("kw", F.struct(-F.length("kw"), F.col("kw"))).alias("keyword"), F.count("*").alias("n_keywords"))


def attach_attributes(hits: DataFrame, catalog: DataFrame, columns: Sequence[str] = tuple(lx.BOOST_WEIGHTS)) -> DataFrame:
    """Product attributes (p_*) per hit; products without attributes stay with nulls."""
    side = catalog.select("product_id", *[F.col(c).alias(f"p_{c}") for c in columns])
    return hits.join(side.hint("merge"), "product_id", "left")  # both as long as the catalog or longer


def attach_descriptions(df: DataFrame, descriptions: DataFrame) -> DataFrame:
    side = descriptions.select("product_id", F.col("product_description").alias("_d"))
    return df.join(side, "product_id", "left").withColumn(
        "description", F.substring(text_or_empty(F.col("_d")), 1, 400)).drop("_d")


def price_calls(log: DataFrame, prices: dict[str, tuple[float, float]] = lx.TOKEN_PRICES) -> DataFrame:
    """Cost of each call; unknown models cost 0."""
    inp = _literal(F.col("model"), {k: float(v[0]) for k, v in prices.items()})
    out = _literal(F.col("model"), {k: float(v[1]) for k, v in prices.items()})
    return log.withColumn("cost", F.coalesce(
        F.col("input_tokens") / 1000.0 * inp + F.col("output_tokens") / 1000.0 * out, F.lit(0.0)))


def union_splits(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def term_overlap(words: Column, terms: Column) -> tuple[Column, Column, Column]:
    """Shared, extra and combined words."""
    return F.array_intersect(words, terms), F.array_except(words, terms), F.array_union(words, terms)
