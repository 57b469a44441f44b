"""Evaluation, error analysis, search metrics, operational reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..operators import evaluate as ev
from ..operators import joins as jo
from ..operators import ranking as rk
from ..operators import sketches as sk
from ..operators import upkeep as up
from ..session import fresh_path
from . import sqlkit as k
from .registry import query
from .views import with_views

c = F.col
PAIRS = with_views("v_pairs")


def pairs(t):
    """Truth and prediction per attribute, room types as lists."""
    return t.v_pairs.withColumns({x: F.split(x, r"\|") for x in ("gt_room_type", "pred_room_type")})


def _norm(x: str, multi: bool) -> str:
    if multi:
        return f"CASE WHEN {x} IS NOT NULL THEN list_transform(string_split({x}, '|'), lambda v: lower({k.strip('v')})) END"
    return f"CASE WHEN {x} IS NOT NULL THEN [lower({k.strip(x)})] END"


_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT product_id, product_class, model, has_image, {i} AS pos, '{a}' AS attribute, {_norm('gt_' + a, a == 'room_type')} AS gt, {_norm('pred_' + a, a == 'room_type')} AS pred FROM v_pairs"
    for i, a in enumerate(lx.EVAL_ATTRIBUTES)) + ")"


def _f1(by: str = "") -> str:
    keys = f"{by}, attribute" if by else "attribute"
    return f"""cnt AS (SELECT {keys}, sum(len(list_intersect(list_distinct(gt), list_distinct(coalesce(pred, []::VARCHAR[])))))::BIGINT AS tp,
   sum(len(list_filter(list_distinct(coalesce(pred, []::VARCHAR[])), lambda x: NOT list_contains(gt, x))))::BIGINT AS fp,
   sum(len(list_filter(list_distinct(gt), lambda x: NOT list_contains(coalesce(pred, []::VARCHAR[]), x))))::BIGINT AS fn FROM long WHERE gt IS NOT NULL GROUP BY {keys}),
 pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END::DOUBLE AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END::DOUBLE AS r FROM cnt),
 f1 AS (SELECT {keys}, round(p, 4) AS "precision", round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 4) AS f1, tp + fn AS support FROM pr)"""


@query("attribute_f1", f"{PAIRS}, {_LONG}, {_f1()} SELECT * FROM f1")
def _(t):
    return ev.attribute_f1(pairs(t))


@query("f1_by_slice", f"""{PAIRS}, {_LONG.replace("SELECT product_id", "SELECT product_id, CASE WHEN has_image THEN 'image' ELSE 'text' END AS slice")}, {_f1('slice')} SELECT * FROM f1""")
def _(t):
    return ev.attribute_f1(pairs(t).withColumn("slice", F.when(c("has_image"), "image").otherwise("text")), by=["slice"])


@query("f1_by_class", f"{PAIRS}, {_LONG}, {_f1('product_class')} SELECT * FROM f1")
def _(t):
    return ev.attribute_f1(pairs(t), by=["product_class"])


_HIT = " AND ".join(f"({_norm('gt_' + a, a == 'room_type')} IS NULL OR coalesce(list_sort({_norm('gt_' + a, a == 'room_type')}) = list_sort({_norm('pred_' + a, a == 'room_type')}), false))" for a in lx.EVAL_ATTRIBUTES)


@query("exact_match", f"{PAIRS} SELECT count(*) AS num_examples, round(avg(({_HIT})::INT), 4) AS exact_match_rate FROM v_pairs")
def _(t):
    return ev.exact_match(pairs(t))


_W = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {w}::DOUBLE" for a, w in lx.F1_WEIGHTS.items()) + " ELSE 1.0::DOUBLE END"


@query("weighted_f1", f"{PAIRS}, {_LONG}, {_f1()} SELECT round(avg(f1), 4) AS average_f1, round(sum({_W} * f1) / sum({_W}), 4) AS weighted_f1 FROM f1")
def _(t):
    return ev.weighted_f1(ev.attribute_f1(pairs(t)))


_COST = "CASE model " + " ".join(f"WHEN '{m}' THEN {v}::DOUBLE" for m, v in lx.COST_PER_1K.items()) + " END"
_LAT = "CASE model " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in lx.LATENCY_MS.items()) + " END"


@query("evaluate_models", f"""{PAIRS}, {_LONG}, {_f1('model')}, w AS (SELECT model, """ + ", ".join(
    f"max(f1) FILTER (attribute = '{a}') AS f1_{a}" for a in lx.EVAL_ATTRIBUTES) + f""", round(avg(f1), 4) AS average_f1, round(sum({_W} * f1) / sum({_W}), 4) AS weighted_f1 FROM f1 GROUP BY model),
 em AS (SELECT model, count(*) AS num_examples, round(avg(({_HIT})::INT), 4) AS exact_match_rate FROM v_pairs GROUP BY model)
SELECT w.*, num_examples, exact_match_rate, {_COST} AS cost_per_1k, {_LAT}::DOUBLE AS avg_latency_ms, row_number() OVER (ORDER BY average_f1 DESC, model DESC) = 1 AS is_best FROM w JOIN em USING (model)""")
def _(t):
    return ev.evaluate_models(pairs(t))


_SIM = k.inlist([a + "~" + b for x in lx.SIMILAR_STYLES for a, b in (x, x[::-1])])
_ERR = f"""flat AS (SELECT product_id, product_class, pos, attribute, array_to_string(list_sort(gt), '|') AS gt, array_to_string(list_sort(pred), '|') AS pred FROM long WHERE gt IS NOT NULL),
 err AS (SELECT product_id, product_class, pos::INT AS pos, attribute, pred AS predicted, gt AS ground_truth, CASE WHEN pred IS NULL THEN 'missing_attribute' WHEN attribute = 'style' AND (pred || '~' || gt) IN {_SIM} THEN 'ambiguous_style'
   WHEN attribute = 'primary_material' THEN 'multi_material' WHEN attribute = 'color_family' THEN 'color_lighting' WHEN attribute = 'product_type' THEN 'wrong_category' ELSE 'granularity_mismatch' END AS failure_mode
  FROM flat WHERE pred IS NULL OR pred <> gt)"""


@query("classify_failures", f"{PAIRS}, {_LONG}, {_ERR} SELECT * FROM err")
def _(t):
    return ev.classify_failures(pairs(t))


@query("error_report", f"""{PAIRS}, {_LONG}, {_ERR}, cf AS (SELECT attribute, ground_truth || ' -> ' || coalesce(predicted, 'None') AS item, count(*) AS n FROM err GROUP BY ALL),
 cr AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, item) AS rnk FROM cf)
SELECT 'by_attribute' AS section, attribute, NULL AS item, count(*) AS n, 0 AS rnk FROM err GROUP BY attribute
UNION ALL SELECT 'by_mode', NULL, failure_mode, count(*), 0 FROM err GROUP BY failure_mode
UNION ALL SELECT 'confusion', attribute, item, n, rnk::INT FROM cr WHERE rnk <= 5
UNION ALL SELECT * FROM (SELECT 'hardest_class', NULL, product_class, count(*) AS n, 0 FROM err WHERE product_class <> '' GROUP BY product_class ORDER BY n DESC, product_class LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'sample', attribute, failure_mode, product_id, 0 FROM err ORDER BY product_id, pos LIMIT 20)""")
def _(t):
    return ev.error_report(ev.classify_failures(pairs(t)))


@query("worst_examples", f"{PAIRS}, {_LONG}, {_ERR} SELECT product_id, count(*) AS num_errors FROM err GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def _(t):
    return ev.worst_examples(ev.classify_failures(pairs(t)))


@query("explain_match", f"""{PAIRS} SELECT product_id, contains(lower(pred_style), lower(gt_style)) AS match_style, contains(lower(pred_color_family), lower(gt_color_family)) AS match_color_family FROM v_pairs""")
def _(t):
    from ..operators.filters import explain_match
    hits = t.v_pairs.select("product_id", *[c(f"gt_{a}").alias(f"q_{a}") for a in ("style", "color_family")],
                            *[c(f"pred_{a}").alias(f"p_{a}") for a in ("style", "color_family")])
    return explain_match(hits, ["style", "color_family"]).select("product_id", "match_style", "match_color_family")


# --- search metrics -------------------------------------------------------------------------
JUDGED = with_views("v_results", "v_labels") + """, j AS (SELECT r.query_id, r.product_id, r.rnk, CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END AS rel
  FROM v_results r LEFT JOIN v_labels l USING (query_id, product_id))"""


def _metric_sql(src: str, ks=(5, 10, 20)) -> str:
    parts = ", ".join(f"sum((power(2.0, rel) - 1) / log2(rnk + 1)) FILTER (rnk <= {q}) AS d{q}, sum((power(2.0, rel) - 1) / log2(ir + 1)) FILTER (ir <= {q}) AS i{q}" for q in ks)
    return f"""id AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, rnk) AS ir FROM {src} WHERE rnk <= {max(ks)}),
 pq AS (SELECT query_id, {parts}, 1.0::DOUBLE / min(rnk) FILTER (rel >= 1) AS rr FROM id GROUP BY 1),
 allq AS (SELECT q.query_id, {', '.join(f'CASE WHEN coalesce(i{x}, 0) > 0 THEN d{x} / i{x} ELSE 0 END::DOUBLE AS ndcg_{x}' for x in ks)}, coalesce(rr, 0)::DOUBLE AS rr FROM (SELECT DISTINCT query_id FROM v_labels) q LEFT JOIN pq USING (query_id)),
 sm AS (SELECT {', '.join(f'round(avg(ndcg_{x}), 4) AS ndcg_{x}' for x in ks)}, round(avg(rr), 4) AS mrr, count(*) AS num_queries FROM allq)"""


@query("judge_results", f"{JUDGED} SELECT query_id, product_id, rnk::INT AS rnk, rel::INT AS relevance FROM j")
def _(t):
    return ev.judge_results(t.v_results, t.v_labels)


@query("ndcg_per_query", f"{JUDGED}, {_metric_sql('j')} SELECT query_id, round(ndcg_5, 6) AS ndcg_5, round(ndcg_10, 6) AS ndcg_10, round(ndcg_20, 6) AS ndcg_20, round(rr, 6) AS rr FROM allq")
def _(t):
    q = ev.query_metrics(t.v_results, t.v_labels)
    return q.select("query_id", *[F.round(x, 6).alias(x) for x in ("ndcg_5", "ndcg_10", "ndcg_20", "rr")])


_IDEAL = ", ".join(f"sum((power(2.0, rel) - 1) / log2(r + 1)) FILTER (r <= {x}) AS b{x}" for x in (5, 10, 20))


@query("ndcg_judged", f"""{JUDGED}, {_metric_sql('j')}, lr AS (SELECT query_id, CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END AS rel FROM v_labels),
 lo AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS r FROM lr), best AS (SELECT query_id, {_IDEAL} FROM lo GROUP BY 1)
SELECT query_id, {', '.join(f'round(CASE WHEN coalesce(b{x}, 0) > 0 THEN coalesce(d{x}, 0) / b{x} ELSE 0 END, 6)::DOUBLE AS ndcg_{x}' for x in (5, 10, 20))}, round(coalesce(rr, 0), 6)::DOUBLE AS rr FROM best LEFT JOIN pq USING (query_id)""")
def _(t):
    q = ev.query_metrics(t.v_results, t.kept("v_labels"), judged_ideal=True)
    return q.select("query_id", *[F.round(x, 6).alias(x) for x in ("ndcg_5", "ndcg_10", "ndcg_20", "rr")])


@query("search_metrics", f"""{JUDGED}, {_metric_sql('j')} SELECT sm.*, (SELECT round(quantile_cont(value, 0.5), 1) FROM events) AS latency_p50_ms,
  (SELECT round(quantile_cont(value, 0.95), 1) FROM events) AS latency_p95_ms, (SELECT round(quantile_cont(value, 0.99), 1) FROM events) AS latency_p99_ms FROM sm""")
def _(t):
    return ev.search_metrics(t.v_results, t.kept("v_labels"), t.v_calls.select("latency_ms"))


@query("compare_search", f"""{JUDGED}, {_metric_sql('j')}, jr AS (SELECT query_id, product_id, count(*) OVER (PARTITION BY query_id) + 1 - rnk AS rnk, rel FROM j), """
       + _metric_sql("jr").replace("id AS", "id2 AS", 1).replace("FROM id ", "FROM id2 ").replace("pq AS", "pq2 AS").replace("JOIN pq ", "JOIN pq2 ")
       .replace("allq AS", "allq2 AS").replace("FROM allq)", "FROM allq2)").replace("sm AS", "sm2 AS")
       + " SELECT 'shuffled' AS system, sm.* FROM sm UNION ALL SELECT 'reversed', sm2.* FROM sm2")
def _(t):
    results, labels = t.kept("v_results"), t.kept("v_labels")
    sizes = results.groupBy("query_id").agg(F.max("rnk").alias("_n"))
    back = results.join(sizes, "query_id").withColumn("rnk", c("_n") + 1 - c("rnk")).drop("_n")
    return ev.compare_search({"shuffled": ev.search_metrics(results, labels), "reversed": ev.search_metrics(back, labels)})


# --- classifier outputs ------------------------------------------------------------------------
# labels of the quality table as the truth; the toxic flag decides the prediction for some rows
_PRED = """pred AS (SELECT l.doc_id, d.lang, d.source, CASE WHEN l.doc_id % 11 = 0 THEN -1 ELSE quality END AS label, CASE WHEN toxic = 1 THEN 1 - quality ELSE quality END AS pred,
  (l.doc_id * 37 % 101) / 101.0::DOUBLE AS confidence FROM labels l JOIN documents d USING (doc_id))"""


def label_predictions(t):
    d = t.wide.documents.select("doc_id", "lang", "source")
    q = c("quality")
    return t.labels.join(d, "doc_id").select(
        "doc_id", "lang", "source", F.when(c("doc_id") % 11 == 0, -1).otherwise(q).alias("label"),
        F.when(c("toxic") == 1, 1 - q).otherwise(q).alias("pred"), (c("doc_id") * 37 % 101 / 101.0).alias("confidence"))


@query("level_accuracy", f"WITH {_PRED} SELECT lang, count(*) AS n, round(100.0::DOUBLE * avg((label = pred)::INT), 4) AS accuracy FROM pred WHERE label >= 0 GROUP BY 1")
def _(t):
    return ev.level_accuracy(label_predictions(t), ["lang"])


@query("confidence_profile", f"""{with_views('v_heads')} SELECT round(avg(confidence), 6) AS mean, round(quantile_cont(confidence, 0.5), 6) AS median, sum((confidence < 0.5)::INT)::BIGINT AS lt_05,
  sum((confidence < 0.8)::INT)::BIGINT AS lt_08, sum((confidence > 0.9)::INT)::BIGINT AS gt_09, round(100.0::DOUBLE * sum((confidence < 0.5)::INT) / count(*), 4) AS lt_05_pct,
  round(100.0::DOUBLE * sum((confidence < 0.8)::INT) / count(*), 4) AS lt_08_pct, round(100.0::DOUBLE * sum((confidence > 0.9)::INT) / count(*), 4) AS gt_09_pct FROM v_heads""")
def _(t):
    return ev.confidence_profile(t.v_heads)


@query("class_accuracy", f"""WITH {_PRED}, a AS (SELECT source, count(*) AS n, round(100.0::DOUBLE * avg((label = pred)::INT), 4) AS accuracy FROM pred WHERE label >= 0 GROUP BY 1)
SELECT * FROM (SELECT *, 'top' AS side FROM a ORDER BY accuracy DESC, source LIMIT 20) UNION ALL SELECT * FROM (SELECT *, 'bottom' FROM a ORDER BY accuracy, source DESC LIMIT 10)""")
def _(t):
    return ev.class_accuracy(label_predictions(t), "source")


@query("gate_summary", f"""{with_views('v_heads')}, g AS (SELECT field, product_id % 4 = 0 AS has_image, confidence AS img, 1 - confidence AS txt FROM v_heads)
SELECT field, NULL::BOOLEAN AS has_image, round(avg(img), 6) AS image, round(avg(txt), 6) AS text FROM g GROUP BY 1
UNION ALL SELECT field, has_image, round(avg(img), 6), round(avg(txt), 6) FROM g GROUP BY 1, 2""")
def _(t):
    g = t.v_heads.select("field", (c("product_id") % 4 == 0).alias("has_image"), F.array(c("confidence"), 1 - c("confidence")).alias("gate"))
    return ev.gate_summary(g)


@query("score_correlation", f"""{with_views('v_labels')}, s AS (SELECT (query_id * 31 + product_id * 17) % 97 / 97.0::DOUBLE + CASE label WHEN 'Exact' THEN 1.0 WHEN 'Partial' THEN 0.4 ELSE 0 END AS score,
   CASE label WHEN 'Exact' THEN 1.0 WHEN 'Partial' THEN 0.5 ELSE 0 END::DOUBLE AS y FROM v_labels),
 r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM s)
SELECT round(corr(score, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM r""")
def _(t):
    y = F.when(c("label") == "Exact", 1.0).when(c("label") == "Partial", 0.5).otherwise(0.0)
    bonus = F.when(c("label") == "Exact", 1.0).when(c("label") == "Partial", 0.4).otherwise(0.0)
    s = t.v_labels.select(((c("query_id") * 31 + c("product_id") * 17) % 97 / 97.0 + bonus).alias("score"), y.alias("y"))
    return ev.score_correlation(s, "score", "y")


# --- operations --------------------------------------------------------------------------------------
CALLS = with_views("v_calls")
_PRICE = ("CASE model " + " ".join(f"WHEN '{m}' THEN input_tokens / 1000.0::DOUBLE * {a}::DOUBLE + output_tokens / 1000.0::DOUBLE * {b}::DOUBLE" for m, (a, b) in lx.TOKEN_PRICES.items())
          + " ELSE 0.0::DOUBLE END")


@query("price_calls", f"{CALLS} SELECT event_id, model, round({_PRICE}, 8) AS cost FROM v_calls")
def _(t):
    return jo.price_calls(t.v_calls).select("event_id", "model", F.round("cost", 8).alias("cost"))


_SUMMARY = f"""count(*) AS total_calls, count(*) FILTER (success) AS successful_calls, round(sum({_PRICE}), 4) AS total_cost_usd, sum(input_tokens + output_tokens)::BIGINT AS total_tokens,
  round(avg(latency_ms), 1) AS avg_latency_ms, round(sum({_PRICE}) / count(*) * 1000, 2) AS cost_per_1k, round(count(*) FILTER (success) / count(*), 4) AS success_rate"""


@query("cost_summary", f"{CALLS} SELECT {_SUMMARY} FROM v_calls")
def _(t):
    return up.cost_summary(t.v_calls)


@query("cost_by_model", f"{CALLS} SELECT model, {_SUMMARY} FROM v_calls GROUP BY model")
def _(t):
    return up.cost_summary(t.v_calls, ["model"])


@query("catalog_cost", f"""{CALLS}, s AS (SELECT model, round(sum({_PRICE}) / count(*) * 1000, 2) AS cost_per_1k FROM v_calls GROUP BY model)
SELECT *, round(cost_per_1k * 40000.0::DOUBLE, 2) AS full_cost, CASE WHEN cost_per_1k * 40000.0::DOUBLE < 50000 THEN 'Yes' WHEN cost_per_1k * 40000.0::DOUBLE < 500000 THEN 'Expensive' ELSE 'No' END AS feasible FROM s""")
def _(t):
    return up.catalog_cost(up.cost_summary(t.v_calls, ["model"]).select("model", "cost_per_1k"))


@query("latency_report", """WITH p AS (SELECT value AS latency_ms, event_type = 'view' AS cached, CASE WHEN event_type = 'error' THEN 'failed' END AS error FROM events),
 ok AS (SELECT latency_ms, row_number() OVER (ORDER BY latency_ms) - 1 AS i, count(*) OVER () AS n FROM p WHERE NOT cached AND error IS NULL)
SELECT (SELECT count(*) FROM ok) AS processed, count(*) FILTER (cached) AS cached, count(error) AS errors, (SELECT min(latency_ms) FROM ok WHERE i = n // 2) AS p50,
 (SELECT min(latency_ms) FROM ok WHERE i = floor(n * 0.99::DOUBLE)) AS p99, round(count(*) * 1000.0::DOUBLE / sum(latency_ms), 4) AS throughput FROM p""")
def _(t):
    p = t.events.select(c("value").alias("latency_ms"), (c("event_type") == "view").alias("cached"),
                        F.when(c("event_type") == "error", "failed").alias("error"))
    return up.latency_report(p)


@query("daily_sketches", """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, TRUE AS p50_ok, TRUE AS p95_ok, TRUE AS users_ok, TRUE AS returning_ok FROM events GROUP BY 1""")
def _(t):
    """Sketches stored per day, merged over all days and over two halves, against exact counts: whether the quantiles, the
    distinct users and those that came back lie within the errors that the sketches state."""
    path = fresh_path(t.spark, "sketches")
    log = t.events.select("event_type", c("value"), c("user_id"), c("ts").cast("timestamp").alias("ts"))
    sk.store_days(log, path, "ts", ["event_type"], "value", "user_id")
    days = sk.stored_days(t.spark, path)
    span = days.agg(F.min("day"), F.max("day")).first()
    half = span[0] + (span[1] - span[0]) / 2 if span[0] else None
    whole = sk.merge_days(days, ["event_type"]).select("event_type", "n", sk.quantile(0.5).alias("p50"), sk.quantile(0.95).alias("p95"), sk.members().alias("users"))
    first, last = (sk.merge_days(d, ["event_type"]).select("event_type", c("theta").alias(f"theta_{i}")) for i, d in enumerate(
        (days.where(c("day") <= F.lit(half)), days.where(c("day") > F.lit(half)))))
    both = first.join(last, "event_type", "full").select("event_type", F.coalesce(sk.shared_members("theta_0", "theta_1"), F.lit(0)).alias("back"))
    facts = log.join(whole.select("event_type", "p50", "p95"), "event_type").groupBy("event_type").agg(
        F.countDistinct("user_id").alias("true_users"), *[F.avg((c("value") < c(p)).cast("double")).alias(f"{p}_low") for p in ("p50", "p95")],
        *[F.avg((c("value") <= c(p)).cast("double")).alias(f"{p}_high") for p in ("p50", "p95")])
    halves = log.groupBy("event_type", "user_id").agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).groupBy("event_type").agg(
        F.count(F.when((c("a") <= F.lit(half)) & (c("b") > F.lit(half)), 1)).alias("true_back"))
    e = sk.rank_error()
    inside = lambda p, q: c(f"{p}_low").between(0, q + e) & c(f"{p}_high").between(q - e, 1)
    j = whole.join(facts, "event_type").join(both, "event_type").join(halves, "event_type")
    return j.select("event_type", "n", c("true_users").alias("users"), inside("p50", 0.5).alias("p50_ok"), inside("p95", 0.95).alias("p95_ok"),
                    (F.abs(c("users") - c("true_users")) <= sk.distinct_error() * c("true_users") + 0.5).alias("users_ok"),
                    (F.abs(c("back") - c("true_back")) <= sk.set_error() * c("true_users") + 0.5).alias("returning_ok"))


@query("manifest_summary", f"""{with_views('v_manifest')}, tt AS (SELECT count(*) AS total, count(*) FILTER (image_count > 0) AS w, count(*) FILTER (status IN ('no_results', 'no_good_images', 'download_failed')) AS wo,
   count(*) FILTER (status IN ('no_results', 'no_good_images')) AS nr, count(*) FILTER (status = 'download_failed') AS df, sum(image_count)::BIGINT AS ti FROM v_manifest)
SELECT 'count' AS section, unnest(['total', 'with_images', 'without_images', 'no_results', 'download_failed', 'total_images']) AS item, unnest([total, w, wo, nr, df, ti]) AS n, NULL::DOUBLE AS value FROM tt
UNION ALL SELECT 'rate', 'mean_images', NULL, round(ti / w, 4) FROM tt UNION ALL SELECT 'rate', 'success_rate', NULL, round(100.0::DOUBLE * w / total, 4) FROM tt
UNION ALL SELECT 'status', coalesce(status, 'unknown'), count(*), NULL FROM v_manifest GROUP BY status
UNION ALL SELECT * FROM (SELECT 'domain', source_domain, count(*) AS n, NULL FROM v_manifest WHERE source_domain <> '' GROUP BY source_domain ORDER BY n DESC, source_domain LIMIT 15)""")
def _(t):
    return up.manifest_summary(t.v_manifest)


@query("failure_streaks", """WITH f AS (SELECT user_id % 10 AS worker, event_id, event_type IN ('error', 'view', 'click') AS failed FROM events),
 g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY worker ORDER BY event_id) AS island FROM f),
 p AS (SELECT *, CASE WHEN failed THEN sum(failed::INT) OVER (PARTITION BY worker, island ORDER BY event_id) ELSE 0 END AS pos FROM g)
SELECT worker, event_id, failed, CASE WHEN pos > 0 THEN (pos - 1) % 4 + 1 ELSE 0 END::BIGINT AS streak, pos > 0 AND pos % 4 = 0 AS flagged FROM p""")
def _(t):
    log = t.events.select((c("user_id") % 10).alias("worker"), "event_id", c("event_type").isin("error", "view", "click").alias("failed"))
    return rk.failure_streaks(log, "worker", ["event_id"], "failed", F.floor(c("event_id") / 500), 4)
