"""Lexical search over stored postings with block bounds.

Documents are numbered by length, shorter ones first, since a term weighs more in a short document; blocks of
neighbouring numbers therefore differ in the scores they can reach. The postings of a term are kept per block,
largest part first, with that part as their bound. A query adds up the bounds of its terms per block, scores its
most promising blocks to learn a score that its k-th answer reaches, and never opens blocks below it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import each, let, text_or_empty, words
from ..session import written
from .ranking import topk_per_key
from .search import query_weights

ROUNDING = 1e-6  # scores are rounded to six digits before they are ranked


def postings_index(corpus: DataFrame, doc: str, text: str, block_docs: int = 128, k1: float = 1.5, b: float = 0.75) -> dict[str, DataFrame]:
    """Stored `postings` (term, block, bound, parts) and the term statistics of `bm25_index`.

    A row of postings holds one term's documents of one block, at most `block_docs`, as (part, pos, doc) with the part
    of the score that does not depend on the query; each file is written in order of term and block, so that a reader
    skips the pages of other terms. A frequent term is many rows, not a large one. Repeated ids are documents of
    their own; null texts are empty documents.
    """
    sized = corpus.select(F.col(doc).alias("doc"), F.lower(text_or_empty(F.col(text))).alias("_text")).withColumn("_dl", F.size(words(F.col("_text"))))
    placed = sized.repartitionByRange("_dl", "doc").sortWithinPartitions("_dl", "doc").withColumn("pos", F.monotonically_increasing_id())
    docs = written(placed.withColumn("block", F.expr(f"pos div {block_docs}")), "numbered")
    stats = docs.agg(F.count("*").alias("_N"), F.avg("_dl").alias("_avgdl"))
    mean_length = stats.first()["_avgdl"] or 1.0  # one row
    counted = each(docs, _term_counts(words(F.col("_text"))), "e", "block", "pos", "doc", "_dl").select("*", F.col("e.term").alias("term"), F.col("e.tf").alias("_tf"))
    part = F.col("_tf") * (k1 + 1) / (F.col("_tf") + k1 * (1 - b + b * F.col("_dl") / F.lit(mean_length)))
    lists = counted.select("term", "block", F.struct(part.alias("part"), "pos", "doc").alias("p")).groupBy("term", "block").agg(
        F.sort_array(F.collect_list("p"), asc=False).alias("parts"))  # at most block_docs entries
    postings = written(lists.select("term", "block", F.col("parts")[0]["part"].alias("bound"), "parts").sortWithinPartitions("term", "block"), "postings")
    total = F.lit(docs.count())
    found = postings.groupBy("term").agg(F.sum(F.size("parts")).alias("_df"))
    terms = written(found.select("term", "_df", (F.ln(total - F.col("_df") + 0.5) - F.ln(F.col("_df") + 0.5)).alias("_raw")), "terms")
    return {"postings": postings, "terms": terms, "mean_idf": terms.agg(F.avg("_raw").alias("_mean")), "stats": stats}


def _term_counts(tokens: Column) -> Column:
    """Distinct tokens with their counts, (term, tf) each, by runs of the sorted tokens: nothing is shuffled for it."""
    def runs(ordered: Column) -> Column:
        places = F.when(F.size(ordered) > 0, F.sequence(F.lit(0), F.size(ordered) - 1))
        starts = F.filter(places, lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)))
        return let(starts, lambda first: F.transform(first, lambda i, n: F.struct(
            F.get(ordered, i).alias("term"), (F.coalesce(F.get(first, n + 1), F.size(ordered)) - i).alias("tf"))))
    return let(F.array_sort(tokens), runs)


def _asked(postings: DataFrame, weights: DataFrame, most: int = 1_000) -> DataFrame:
    """Postings of the asked terms: up to `most` terms as a filter that reaches the scan, more by a join."""
    terms = weights.select("term").distinct()
    few = [r.term for r in terms.limit(most + 1).collect()]
    return postings.where(F.col("term").isin(few)) if len(few) <= most else postings.join(terms, "term", "left_semi")


def _scored(blocks: DataFrame, weights: DataFrame, postings: DataFrame) -> DataFrame:
    """Scores (_rep, block, pos, doc, score) of the documents of (_rep, block) pairs that hold a term of the query.

    Asked terms and postings meet as rows dealt by block, where a document lies whole: a posting moves once, however many
    queries ask for it, and the products of weights and postings are added up in the task that makes them.
    """
    kinds = {c: weights.schema[c].dataType for c in ("_rep", "_w")} | {"parts": postings.schema["parts"].dataType}
    wanted = blocks.select("_rep", "block").join(weights, "_rep").withColumn("parts", F.lit(None).cast(kinds["parts"]))
    held = postings.select("term", "block", "parts", *[F.lit(None).cast(kinds[c]).alias(c) for c in ("_rep", "_w")])
    dealt = wanted.unionByName(held).repartition("block")
    before = Window.partitionBy("block", "term").orderBy(F.col("parts").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lists = dealt.withColumn("parts", F.first("parts", ignorenulls=True).over(before)).where(F.col("_rep").isNotNull())
    opened = lists.select("_rep", "block", "_w", F.explode("parts").alias("p")).select("_rep", "block", "p.pos", "p.doc", (F.col("_w") * F.col("p.part")).alias("s"))
    return opened.groupBy("_rep", "block", "pos").agg(F.first("doc").alias("doc"), F.round(F.sum("s"), 6).alias("score"))


def block_plan(index: dict[str, DataFrame], weights: DataFrame, k: int, first_blocks: int = 8) -> DataFrame:
    """Stored (_rep, block, most, kth, opened): what each block can reach for each query, the score that the query's k-th
    document of its `first_blocks` best blocks has (null if they hold fewer), and whether the block must be opened."""
    held = _asked(index["postings"], weights)
    reach = written(weights.join(held.select("term", "block", "bound"), "term").groupBy("_rep", "block").agg(
        F.sum(F.greatest(F.col("_w") * F.col("bound"), F.lit(0.0))).alias("most")), "bounds")
    first = topk_per_key(reach, ["_rep"], [F.col("most").desc(), F.col("block").asc()], first_blocks)
    best = topk_per_key(_scored(first, weights, held), ["_rep"], [F.col("score").desc()], k)
    kth = best.groupBy("_rep").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    bar = reach.join(kth.drop("n"), "_rep", "left")
    return written(bar.withColumn("opened", F.col("kth").isNull() | (F.col("most") + ROUNDING >= F.col("kth"))), "block-plan")


def postings_search(index: dict[str, DataFrame], queries: DataFrame, k: int = 10, doc: str = "product_id", query: str = "query_id",
                    text: str = "query", epsilon: float = 0.25, first_blocks: int = 8) -> DataFrame:
    """(query, doc, score, rnk): the k best documents per query, the same rows as `bm25_search`.

    The work follows the postings of the asked terms in the opened blocks; queries, terms and documents of any number
    are joined as rows, and equal query texts are answered once. A block stays closed only if the sum of its bounds, in
    which terms of negative weight count nothing, is below a score that k documents are known to reach, so the answer is exact.
    """
    texts, spoken, weights = query_weights(index, queries, query, text, epsilon)
    opened = block_plan(index, weights, k, first_blocks).where("opened")
    scores = _scored(opened, weights, _asked(index["postings"], weights)).where("score <> 0")
    best = topk_per_key(scores, ["_rep"], [F.col("score").desc(), F.col("doc").asc(), F.col("pos").asc()], k)
    return texts.join(spoken, "_text").select(query, "_rep").join(best, "_rep").select(query, F.col("doc").alias(doc), "score", "rnk")
