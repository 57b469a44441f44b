"""Search and ranking queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.attributes import enrich_catalog, extract_attributes_v2
from ..operators import postings as po
from ..operators import ranking as rk
from ..operators import search as se
from ..operators.joins import attach_attributes, product_texts
from ..session import written
from . import sqlkit as k
from .catalog import SEARCH_TEXT
from .features import PRODUCTS, V2_STAGES, rich_products, v1_sql
from .registry import query
from .views import with_views

c = F.col


# --- BM25: benchmark passages against all documents ---------------------------------------
def bm25_sql(docs: str, queries: str, top: int, tag: str = "") -> str:
    """CTEs ending in bm<tag>(query_id, product_id, score, rnk); docs(product_id, text), queries(query_id, query)."""
    return f"""tk{tag} AS (SELECT product_id, {k.words('lower(text)')} AS ws FROM {docs}), st{tag} AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM tk{tag}),
 tf{tag} AS (SELECT product_id, dl, term, count(*) AS tf FROM (SELECT product_id, len(ws) AS dl, unnest(ws) AS term FROM tk{tag}) GROUP BY ALL),
 raw{tag} AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf{tag}, st{tag} GROUP BY term, n),
 idf{tag} AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM raw{tag}) ELSE raw END AS idf FROM raw{tag}),
 qt{tag} AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({k.words('lower(query)')}) AS term FROM {queries}) GROUP BY ALL),
 sc{tag} AS (SELECT query_id, product_id, round(sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
   FROM qt{tag} JOIN idf{tag} USING (term) JOIN tf{tag} USING (term), st{tag} GROUP BY 1, 2),
 bm{tag} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rnk FROM sc{tag} WHERE score <> 0 QUALIFY rnk <= {top})"""


@query("bm25_search", f"""WITH d AS (SELECT doc_id AS product_id, text FROM documents), q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {bm25_sql('d', 'q', 10)}
SELECT query_id, product_id, score, rnk::INT AS rnk FROM bm""")
def _(t):
    index = se.bm25_index(t.wide.documents, "doc_id", "text")
    q = t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("query"))
    out = se.bm25_search(index, q, 10, doc="doc_id")
    return out.select("query_id", c("doc_id").alias("product_id"), "score", "rnk")


@query("bm25_postings", f"""WITH d AS (SELECT doc_id AS product_id, text FROM documents), q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {bm25_sql('d', 'q', 10)}
SELECT query_id, product_id, score, rnk::INT AS rnk FROM bm""")
def _(t):
    index = po.postings_index(t.wide.documents, "doc_id", "text")
    return po.postings_search(index, t.benchmark.select(c("item_id").alias("query_id"), c("text").alias("query")), 10)


@query("bm25_index", f"""WITH d AS (SELECT doc_id AS product_id, text FROM documents), q AS (SELECT item_id AS query_id, text AS query FROM benchmark), {bm25_sql('d', 'q', 10)}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
SELECT term, df, round(raw, 6) AS idf FROM df JOIN raw USING (term)""")
def _(t):
    return se.bm25_index(t.wide.documents, "doc_id", "text")["terms"].select("term", c("_df").alias("df"), F.round("_raw", 6).alias("idf"))


# --- vectors: one query per label, the mean of its vectors, against all vectors ------------
_CENTRES = "vq AS (SELECT label AS query_id, list(m ORDER BY i) AS vector FROM (SELECT label, i, avg(embedding[i]::DOUBLE) AS m FROM embeddings, range(1, 65) r(i) GROUP BY ALL) GROUP BY 1)"


def centres(t):
    """Mean vector per label; the labels are a closed list of ten."""
    long = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = long.groupBy("label", "i").agg(F.avg(c("x").cast("double")).alias("m"))
    return means.groupBy(c("label").alias("query_id")).agg(F.transform(  # one entry per dimension
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda e: e["m"]).alias("vector"))


def vectors(t):
    return t.embeddings.select(c("vec_id").alias("product_id"), c("embedding").alias("vector"))


_EXACT = f"""WITH {_CENTRES}, s AS (SELECT query_id, vec_id AS product_id, round({k.dot('vector', 'embedding')}, 6) AS score FROM vq, embeddings),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rnk FROM s) """


@query("vector_topk", _EXACT + "SELECT query_id::BIGINT AS query_id, product_id, score, rnk::INT AS rnk FROM r WHERE rnk <= 20")
def _(t):
    return se.vector_topk(centres(t), vectors(t), 20)


@query("vector_topk_blocks", _EXACT + "SELECT query_id::BIGINT AS query_id, product_id, score, rnk::INT AS rnk FROM r WHERE rnk <= 20")
def _(t):
    # many pairs of blocks, forced by small block sizes
    return se.vector_topk(centres(t), vectors(t), 20, block_rows=300, block_queries=4)


@query("ivf_topk", _EXACT + "SELECT query_id::BIGINT AS query_id, product_id, score, rnk::INT AS rnk FROM r WHERE rnk <= 20")
def _(t):
    # as many probes as cells: every cell is searched, so the answer is the exact one; tests measure the recall of fewer
    return se.ivf_topk(centres(t), vectors(t), 20, nlist=16, nprobe=16)


@query("ivf_recall", """SELECT vec_id AS query_id, least(20, (SELECT count(*) FROM embeddings)) AS n_hits, TRUE AS scores_exact, TRUE AS recall_ok FROM embeddings WHERE vec_id % 20 = 0""")
def _(t):
    """Every twentieth vector against all, probing 16 of about sqrt(n) cells or what other vectors need for a recall of 0.95:
    whether the scores are the exact ones and the mean recall at 10 against the exact search is 0.9 or more."""
    q = t.embeddings.filter("vec_id % 20 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))
    index = se.ivf_index(vectors(t))
    others = t.embeddings.filter("vec_id % 20 <> 0").select(c("vec_id").alias("query_id"), c("embedding").alias("vector"))
    probes = max(min(16, len(index.centres)), se.probes_for(index, others, vectors(t), 10))
    near, exact = written(se.ivf_search(index, q, 20, probes), "near"), written(se.vector_topk(q, vectors(t), 20), "exact")
    pairs = near.join(exact.select("query_id", "product_id", c("score").alias("truth"), c("rnk").alias("place")), ["query_id", "product_id"], "full")
    found = pairs.agg((F.count(F.when((c("place") <= 10) & (c("rnk") <= 10), 1)) / F.count(F.when(c("place") <= 10, 1))).alias("recall"))
    rows = pairs.groupBy("query_id").agg(F.count("score").alias("n_hits"), F.bool_and(F.coalesce(F.abs(c("score") - c("truth")) < 1e-9, F.lit(True))).alias("scores_exact"))
    return rows.crossJoin(F.broadcast(found)).select("query_id", "n_hits", "scores_exact", (c("recall") >= 0.9).alias("recall_ok"))  # one row


@query("encode_corpus", f"""SELECT doc_id, len({k.words('lower(text)')}) > 0 AS has_words, 256 AS width, CASE WHEN len({k.words('lower(text)')}) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM documents""")
def _(t):
    df, _model = se.encode_corpus(t.wide.documents.select("doc_id", "text"), "text")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.select("doc_id", (F.size(F.filter("vector", lambda x: x != 0)) > 0).alias("has_words"), F.size("vector").alias("width"), F.round(norm, 3).alias("norm"))


# --- catalog search: staged, for one query per supplier ---------------------------------------
_CQ = "cq AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN query || ' oak' WHEN 1 THEN 'modern ' || query ELSE query END AS query FROM v_queries)"


def catalog_queries(t):
    q = c("query")
    return t.v_queries.select("query_id", F.when(c("query_id") % 3 == 0, F.concat(q, F.lit(" oak"))).when(
        c("query_id") % 3 == 1, F.concat(F.lit("modern "), q)).otherwise(q).alias("query"))


def corpus(t):
    return product_texts(t.wide.v_products).withColumnRenamed("product_text", "text")


_CORPUS = f"cp AS (SELECT product_id, product_name, {SEARCH_TEXT} AS text FROM v_products)"
_ENRICHED = f"""ex AS (SELECT *, lower(concat_ws(' ', product_name, product_name || ' ' || coalesce(product_description, '') || ' ' || coalesce(product_features, ''), product_class)) AS t FROM v_products), cat AS ({v1_sql('t', 'ex')})"""


def enriched(t):
    return enrich_catalog(t.wide.v_products).select("product_id", "attributes.*")


# word vectors of queries and products, and all their products
_DIM = 64


def _vectors_sql(name: str, src: str, key: str, text: str) -> str:
    return f"""{name} AS (SELECT {key}, b, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x FROM (SELECT {key}, b, count(*)::DOUBLE AS n FROM
   (SELECT {key}, ('0x' || substr(md5(w), 1, 4))::INT % {_DIM} AS b FROM (SELECT {key}, unnest({k.words(f'lower({text})')}) AS w FROM {src})) GROUP BY 1, 2))"""


_VECTOR = f"""{_vectors_sql('qv', 'cq', 'query_id', 'query')}, {_vectors_sql('pv', 'cp', 'product_id', 'text')},
 vs AS (SELECT query_id, product_id, sum(qv.x * pv.x) AS s FROM qv JOIN pv USING (b) GROUP BY 1, 2),
 vm AS (SELECT query_id, product_id, round(coalesce(s, 0), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(coalesce(s, 0), 6) DESC, product_id) AS rnk
   FROM (SELECT query_id, product_id FROM cq, cp) LEFT JOIN vs USING (query_id, product_id) QUALIFY rnk <= 50),
 fu AS (SELECT query_id, product_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id) AS rnk
   FROM (SELECT query_id, product_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT query_id, product_id, rnk AS r FROM bm UNION ALL SELECT query_id, product_id, rnk FROM vm) GROUP BY 1, 2) QUALIFY rnk <= 50)"""


def _stage1(first: str, more: str = "") -> str:
    return f"{with_views('v_products', 'v_queries')}, {_CQ}, {_CORPUS}, {_ENRICHED}, {bm25_sql('cp', 'cq', 50)}, {more}hits AS (SELECT b.*, query, product_name, text FROM {first} b JOIN cq USING (query_id) JOIN cp USING (product_id))"


def _stage2(stage1: str) -> str:
    return f"""{stage1}, pw AS (SELECT query_id, product_id, unnest(list_distinct({k.words('lower(query)')})) AS term, {k.words('lower(text)')} AS ws FROM hits),
 ce AS (SELECT query_id, product_id, round(coalesce(sum(CASE WHEN list_contains(ws, term) THEN greatest(raw, 0) ELSE 0 END) / nullif(sum(greatest(raw, 0)), 0), 0), 6) AS ce_score FROM pw JOIN raw USING (term) GROUP BY 1, 2),
 rr AS (SELECT hits.*, coalesce(ce_score, 0) AS ce_score, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(ce_score, 0) DESC, rnk) AS ce_rank FROM hits LEFT JOIN ce USING (query_id, product_id) QUALIFY ce_rank <= 10)"""


_STAGE1 = _stage1("bm")
_STAGE2 = _stage2(_STAGE1)


def _boost_sql(src: str, base: str, prev: str) -> str:
    qa = ", ".join(f"list_min(list_filter(regexp_extract_all(lower(query), '\\w+'), lambda w: w IN {k.inlist(v)})) AS q_{a}" for a, v in lx.QUERY_TERMS.items())
    hit = " + ".join(f"CASE WHEN q_{a} IS NOT NULL AND coalesce(p_{a}, '') <> '' AND contains(p_{a}, q_{a}) THEN {w}::DOUBLE ELSE 0 END" for a, w in lx.BOOST_WEIGHTS.items())
    return f"""b0 AS (SELECT h.*, {qa}, {', '.join(f'cat.{a} AS p_{a}' for a in lx.BOOST_WEIGHTS)} FROM {src} h LEFT JOIN cat USING (product_id)),
 b1 AS (SELECT *, coalesce({', '.join('q_' + a for a in lx.BOOST_WEIGHTS)}) IS NOT NULL AS has, ({hit})::DOUBLE AS bo FROM b0),
 b2 AS (SELECT *, CASE WHEN has THEN round(bo, 4) END AS attribute_boost, CASE WHEN has THEN round(0.7::DOUBLE * greatest(0, least(1, ({base} + 1) / 2)) + 0.3::DOUBLE * (bo / 0.5::DOUBLE), 4) END AS boosted_score FROM b1),
 b3 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY boosted_score DESC NULLS LAST, {prev}) AS final_rank FROM b2)"""


def _first(t):
    index = se.bm25_index(corpus(t), "product_id", "text")
    return index, se.bm25_search(index, catalog_queries(t), 50)


def _hits(t):
    index, first = _first(t)
    return index, first.join(catalog_queries(t).hint("merge"), "query_id").join(corpus(t).hint("merge"), "product_id")


@query("rerank", f"{_STAGE2} SELECT query_id, product_id, ce_score, ce_rank::INT AS ce_rank, rnk::INT AS rnk FROM rr")
def _(t):
    index, hits = _hits(t)
    return se.rerank(hits, queries=catalog_queries(t), index=index).select("query_id", "product_id", "ce_score", "ce_rank", "rnk")


@query("attribute_boost", f"{_STAGE1}, {_boost_sql('hits', 'score', 'rnk')} SELECT query_id, product_id, q_style, p_style, attribute_boost, boosted_score, final_rank::INT AS final_rank FROM b3")
def _(t):
    _index, hits = _hits(t)
    return se.attribute_boost(hits, enriched(t)).select("query_id", "product_id", "q_style", "p_style", "attribute_boost", "boosted_score", "final_rank")


@query("attach_attributes", f"{with_views('v_results', 'v_products')}, {_ENRICHED} SELECT query_id, r.product_id, style AS p_style, color_family AS p_color_family FROM v_results r LEFT JOIN cat USING (product_id)")
def _(t):
    return attach_attributes(t.v_results, enriched(t)).select("query_id", "product_id", "p_style", "p_color_family")


@query("staged_search", f"{_STAGE2}, {_boost_sql('rr', 'ce_score', 'ce_rank')} SELECT query_id, product_id, product_name, ce_score, boosted_score, final_rank::INT AS position FROM b3 WHERE final_rank <= 10")
def _(t):
    index, first = _first(t)
    return se.staged_search(catalog_queries(t), first, corpus(t), enriched(t), index).select(
        "query_id", "product_id", "product_name", "ce_score", "boosted_score", "position")


def _vector_first(t):
    """Top 50 by word vectors: every product against every query, in blocks."""
    encode = se.hashed_words(_DIM)
    q = catalog_queries(t).select("query_id", encode(c("query")).alias("vector"))
    return se.vector_topk(q, corpus(t).select("product_id", encode(c("text")).alias("vector")), 50)


_STAGED = "SELECT query_id, product_id, product_name, ce_score, boosted_score, final_rank::INT AS position FROM b3 WHERE final_rank <= 10"


@query("vector_first_stage", f"{_stage1('vm', _VECTOR + ', ')} SELECT query_id, product_id, score, rnk::INT AS rnk FROM vm")
def _(t):
    return _vector_first(t)


@query("staged_search_vector", f"{_stage2(_stage1('vm', _VECTOR + ', '))}, {_boost_sql('rr', 'ce_score', 'ce_rank')} {_STAGED}")
def _(t):
    index = se.bm25_index(corpus(t), "product_id", "text")
    return se.staged_search(catalog_queries(t), written(_vector_first(t), "vector-stage"), corpus(t), enriched(t), index).select(
        "query_id", "product_id", "product_name", "ce_score", "boosted_score", "position")


@query("staged_search_fused", f"{_stage2(_stage1('fu', _VECTOR + ', '))}, {_boost_sql('rr', 'ce_score', 'ce_rank')} {_STAGED}")
def _(t):
    index = po.postings_index(corpus(t), "product_id", "text")
    lexical = po.postings_search(index, catalog_queries(t), 50)
    first = written(se.fuse([lexical, _vector_first(t)]), "fused")
    return se.staged_search(catalog_queries(t), first, corpus(t), enriched(t), index).select(
        "query_id", "product_id", "product_name", "ce_score", "boosted_score", "position")


@query("tiered_boost", f"""{V2_STAGES}, q AS (SELECT *, split_part(product_name, ' ', 1) AS q_color, 'velvet' AS q_material, split_part(product_class, '|', 2) AS q_category FROM v2)
SELECT product_id, round(CASE WHEN q_color = primary_color THEN 0.3 WHEN q_color = secondary_color THEN 0.15 ELSE 0 END + CASE WHEN q_material = primary_material THEN 0.3 WHEN q_material = secondary_material THEN 0.15 ELSE 0 END
 + CASE WHEN list_contains(string_split(taxonomy_full, ' / '), q_category) THEN 0.2 ELSE 0 END, 4)::DOUBLE AS boost FROM q""")
def _(t):
    v2 = extract_attributes_v2(rich_products(t)).withColumns({
        "q_color": F.split_part("product_name", F.lit(" "), F.lit(1)), "q_material": F.lit("velvet"),
        "q_category": F.split_part("product_class", F.lit("|"), F.lit(2))})
    return v2.select("product_id", F.round(se.tiered_boost(v2), 4).alias("boost"))


@query("compare_approaches", f"""{_stage2(_stage1('bm', _VECTOR + ', '))}, {_boost_sql('rr', 'ce_score', 'ce_rank')}, u AS (SELECT query_id, rnk, product_id, 'bm25' AS s FROM bm WHERE rnk <= 5 UNION ALL SELECT query_id, rnk, product_id, 'vector' FROM vm WHERE rnk <= 5 UNION ALL SELECT query_id, ce_rank, product_id, 'reranked' FROM rr WHERE ce_rank <= 5 UNION ALL SELECT query_id, final_rank, product_id, 'boosted' FROM b3 WHERE final_rank <= 5)
SELECT query_id, rnk::INT AS rnk, max(product_id) FILTER (s = 'bm25') AS bm25, max(product_id) FILTER (s = 'vector') AS vector, max(product_id) FILTER (s = 'reranked') AS reranked, max(product_id) FILTER (s = 'boosted') AS boosted FROM u GROUP BY 1, 2""")
def _(t):
    index, first = _first(t)
    first = written(first, "first-stage")
    hits = first.join(catalog_queries(t).hint("merge"), "query_id").join(corpus(t).hint("merge"), "product_id")
    ranked = written(se.rerank(hits, queries=catalog_queries(t), index=index), "reranked")
    boosted = se.attribute_boost(ranked, enriched(t), previous="ce_rank")
    return se.compare_approaches({"bm25": first, "vector": _vector_first(t), "reranked": ranked.withColumn("rnk", c("ce_rank")), "boosted": boosted.withColumn("rnk", c("final_rank"))})


# --- image candidates ---------------------------------------------------------------------------
def _domain(x: str) -> str:
    return f"regexp_replace(regexp_extract(lower({x}), '^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^www\\.', '')"


_CAND = f"""{with_views('v_candidates')}, w AS (SELECT *, lower(concat_ws(' ', url, title, source)) AS alltext, lower(image) AS li,
  list_filter(list_distinct(regexp_extract_all(lower(product_name), '[a-z]{{3,}}')), lambda x: x NOT IN {k.inlist(lx.GENERIC_WORDS)}) AS nw, ['oak', 'modern'] AS aw FROM v_candidates),
 sc AS (SELECT *, CASE WHEN {k.any_of(_domain('image'), lx.BLOCKED_DOMAINS)} OR {k.any_of(_domain('url'), lx.BLOCKED_DOMAINS)} THEN -1.0::DOUBLE ELSE
   CASE WHEN contains({_domain('image')}, 'example.com') OR contains({_domain('url')}, 'example.com') THEN 4 WHEN contains({_domain('image')}, 'example.net') OR contains({_domain('url')}, 'example.net') THEN 3 ELSE 0 END::DOUBLE
   + CASE WHEN len(nw) > 0 THEN len(list_filter(nw, lambda x: contains(alltext, x))) / len(nw) * 10 ELSE 0 END::DOUBLE + len(list_filter(aw, lambda x: contains(alltext, x))) / 2 * 5::DOUBLE
   + CASE WHEN {k.any_of('li', lx.LARGE_HINTS)} THEN 1 ELSE 0 END - CASE WHEN {k.any_of('li', lx.THUMB_HINTS)} THEN 5 ELSE 0 END
   + CASE WHEN {' OR '.join(f"ends_with(li, '{e}')" for e in lx.IMAGE_EXTENSIONS)} THEN 0.5 ELSE 0 END::DOUBLE END AS score FROM w)"""


def scored_candidates(t):
    words_ = t.part.select(c("p_partkey").alias("product_id"), F.lit(["oak", "modern"]).alias("attr_words"))
    return se.score_image_candidates(se.score_candidates_join(t.v_candidates, words_), {"example.com": 4, "example.net": 3}, "attr_words")


@query("score_image_candidates", f"{_CAND} SELECT product_id, position, image, round(score, 4) AS score FROM sc")
def _(t):
    return scored_candidates(t).select("product_id", "position", "image", F.round("score", 4).alias("score"))


@query("best_candidate", f"""{_CAND} SELECT product_id, position, image, round(score, 4) AS score FROM sc WHERE score >= 0
QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY round(score, 6) DESC, position) = 1""")
def _(t):
    s = scored_candidates(t).select("product_id", "position", "image", F.round("score", 6).alias("score"))
    return rk.best_candidate(s, "product_id", "score", "position").withColumn("score", F.round("score", 4))
