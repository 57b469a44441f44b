"""Streams, sources and sinks, learning and extension over the standing views."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions.attributes import extract_attributes_v2
from ..functions.text import classifier_text
from ..operators import extend as ex
from ..operators import learn as le
from ..operators import routing as ro
from ..operators import sampling as sa
from ..operators.cache import PredictionCache, cached_extraction
from ..session import fresh_path, written
from ..sources import heads as hd
from ..sources import readers as rd
from ..sources import writers as wr
from ..streaming import streams as st
from .catalog import _VOCAB, flat, vocab
from .features import PRODUCTS, V2_STAGES, rich_products, v1_sql
from .registry import query
from .views import with_views

c = F.col


# --- streams --------------------------------------------------------------------------------
def event_stream(t):
    return st.file_stream(t.spark, t.folder, "events").withColumn("ts", c("ts").cast("timestamp"))


_X1 = f"{PRODUCTS}, x AS (SELECT *, lower(concat_ws(' ', product_name, product_description, product_class)) AS t FROM v_products WHERE product_id IN (SELECT l_partkey FROM lineitem)) "


@query("enrich_stream", _X1 + v1_sql("t", "x"))
def _(t):
    # every shipment is an arrival of its product; repeats are ignored
    arrivals = st.file_stream(t.spark, t.folder, "lineitem").select(c("l_partkey").alias("product_id"), c("l_shipdate").cast("timestamp").alias("seen"))
    out = st.enrich_stream(arrivals.join(t.wide.v_products, "product_id"), "seen", "30 days")
    return flat(st.drain(out.select("product_id", *lx.SCHEMA1), "enrich"))


def calls_stream(t):
    """The call view over the event stream."""
    return event_stream(t).selectExpr(
        "event_id", "ts", "CASE user_id % 4 WHEN 0 THEN 'gpt-4o' WHEN 1 THEN 'gpt-4o-mini' WHEN 2 THEN 'gpt-4-turbo' ELSE 'rule-based' END AS model",
        "CAST(100 + event_id % 900 AS INT) AS input_tokens", "CAST(20 + event_id % 200 AS INT) AS output_tokens",
        "value AS latency_ms", "event_type <> 'error' AS success", "user_id")


_PRICE = ("CASE model " + " ".join(f"WHEN '{m}' THEN input_tokens / 1000.0::DOUBLE * {a}::DOUBLE + output_tokens / 1000.0::DOUBLE * {b}::DOUBLE" for m, (a, b) in lx.TOKEN_PRICES.items())
          + " ELSE 0.0::DOUBLE END")
_CLOSED = "WHERE start + INTERVAL '{w}' <= (SELECT max(ts) FROM events) - INTERVAL '{d}'"


@query("call_log_stream", f"""{with_views('v_calls')}, g AS (SELECT date_trunc('hour', ts) AS start, model, count(*) AS calls, count(*) FILTER (NOT success) AS errors, round(avg(latency_ms), 8) AS avg_latency_ms, round(sum({_PRICE}), 9) AS cost FROM v_calls GROUP BY 1, 2)
SELECT strftime(start, '%Y-%m-%d %H') AS hour, model, calls, errors, avg_latency_ms, cost FROM g {_CLOSED.format(w='1 hour', d='10 minutes')}""")
def _(t):
    out = st.drain(st.call_log_stream(calls_stream(t), "ts"), "calls")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "model", "calls", "errors",
                      F.round("avg_latency_ms", 8).alias("avg_latency_ms"), F.round("cost", 9).alias("cost"))


@query("call_log_sliding", f"""{with_views('v_calls')}, s AS (SELECT *, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL '1 hour']) AS start FROM v_calls),
 g AS (SELECT start, model, count(*) AS calls, count(*) FILTER (NOT success) AS errors FROM s GROUP BY 1, 2) SELECT strftime(start, '%Y-%m-%d %H') AS hour, model, calls, errors FROM g {_CLOSED.format(w='2 hours', d='10 minutes')}""")
def _(t):
    out = st.drain(st.call_log_stream(calls_stream(t), "ts", "2 hours", "1 hour"), "sliding")
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "model", "calls", "errors")


_TIER = "CASE WHEN event_id * 37 % 100 >= 85 THEN 1 WHEN event_id * 37 % 100 >= 70 THEN 2 ELSE 3 END"


@query("routing_stats_stream", f"""WITH r AS (SELECT date_trunc('day', ts) AS start, {_TIER} AS tier FROM events), g AS (SELECT start, count(*) AS n, {', '.join(f'round(100.0::DOUBLE * count(*) FILTER (tier = {i}) / count(*), 4) AS tier{i}_pct' for i in (1, 2, 3))} FROM r GROUP BY 1)
SELECT strftime(start, '%Y-%m-%d') AS day, n, tier1_pct, tier2_pct, tier3_pct FROM g {_CLOSED.format(w='1 day', d='1 hour')}""")
def _(t):
    routed = event_stream(t).select("ts", F.expr(_TIER).alias("routing_tier"))
    out = st.drain(st.routing_stats_stream(routed, "ts"), "tiers")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "n", "tier1_pct", "tier2_pct", "tier3_pct")


@query("streak_alerts", """WITH f AS (SELECT user_id % 10 AS worker, event_id, event_type IN ('error', 'view', 'click') AS failed FROM events),
 g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY worker ORDER BY event_id) AS island FROM f),
 p AS (SELECT *, sum(failed::INT) OVER (PARTITION BY worker, island ORDER BY event_id) AS pos FROM g WHERE failed)
SELECT worker::BIGINT AS worker, event_id::BIGINT AS event_id, 4::BIGINT AS streak FROM p WHERE pos % 4 = 0""")
def _(t):
    log = event_stream(t).select((c("user_id") % 10).cast("long").alias("worker"), c("event_id").cast("long").alias("event_id"),
                                 c("event_type").isin("error", "view", "click").alias("failed"))
    return st.drain(st.streak_alerts(log, "worker", "event_id", "failed", 4), "alerts")


@query("streak_alerts_timed", """WITH f AS (SELECT user_id % 10 AS worker, event_id, ts, event_type IN ('error', 'view', 'click') AS failed FROM events
   WHERE date_trunc('hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '10 minutes'),
 g AS (SELECT *, sum((NOT failed)::INT) OVER (PARTITION BY worker ORDER BY ts, event_id) AS island FROM f),
 p AS (SELECT *, sum(failed::INT) OVER (PARTITION BY worker, island ORDER BY ts, event_id) AS pos FROM g WHERE failed)
SELECT worker::BIGINT AS worker, event_id::BIGINT AS event_id, 4::BIGINT AS streak FROM p WHERE pos % 4 = 0""")
def _(t):
    # four arrivals, each the events of a span of time; the job stops after each and goes on from its checkpoint
    log = t.events.select((c("user_id") % 10).cast("long").alias("worker"), c("event_id").cast("long").alias("event_id"),
                          c("event_type").isin("error", "view", "click").alias("failed"), c("ts").cast("timestamp").alias("ts"))
    low, high = log.agg(F.min("ts"), F.max("ts")).first() or (None, None)
    edges = [low + (high - low) * i / 4 for i in range(1, 4)] if low else []
    bounds = zip([F.lit(None), *map(F.lit, edges)], [*map(F.lit, edges), F.lit(None)])
    steps = [log.filter((a.isNull() | (c("ts") >= a)) & (b.isNull() | (c("ts") < b))) for a, b in bounds]
    return st.drain_steps(t.spark, steps, lambda s: st.timed_streak_alerts(s, "worker", "event_id", "failed", "ts", 4, idle="60 days"), "streaks")


# --- sources and sinks ------------------------------------------------------------------------
@query("read_catalog", f"{PRODUCTS} SELECT * FROM v_products")
def _(t):
    path = fresh_path(t.spark, "catalog")
    wr.write_tsv(t.wide.v_products, path)
    return rd.read_catalog(t.spark, path)


@query("read_search_tables", f"""{with_views('v_queries', 'v_labels')} SELECT l.query_id * 1000000 + l.product_id AS id, query_id, product_id, label, query, query_class FROM v_labels l JOIN v_queries USING (query_id)""")
def _(t):
    qp, lp = fresh_path(t.spark, "queries"), fresh_path(t.spark, "labels")
    wr.write_tsv(t.v_queries, qp)
    wr.write_tsv(t.v_labels.select((c("query_id") * 1000000 + c("product_id")).alias("id"), "query_id", "product_id", "label"), lp)
    return rd.read_labels(t.spark, lp).join(rd.read_queries(t.spark, qp), "query_id").select("id", "query_id", "product_id", "label", "query", "query_class")


@query("read_jsonl", f"{PRODUCTS} SELECT product_id, product_name, product_class, category_hierarchy, product_description, product_features, CASE WHEN product_id % 3 = 0 THEN 'val' ELSE 'train' END AS split FROM v_products")
def _(t):
    path = fresh_path(t.spark, "splits")
    wr.write_jsonl(t.wide.v_products.withColumn("split", F.when(c("product_id") % 3 == 0, "val").otherwise("train")), path, ["split"])
    return rd.read_jsonl(t.spark, path, rd.fields(**{f.name: f.dataType for f in rd.CATALOG}, split=rd.S))


@query("read_jsonl_skip_bad", "SELECT count(*) FILTER (p_partkey % 10 <> 0) AS n, sum(p_partkey) FILTER (p_partkey % 10 <> 0)::BIGINT AS total FROM part")
def _(t):
    # every tenth cache line is cut in the middle and must be skipped
    path = fresh_path(t.spark, "cache")
    line = F.to_json(F.struct(c("p_partkey").alias("product_id"), c("p_name").alias("label")))
    t.part.select(F.when(c("p_partkey") % 10 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    schema = rd.fields(product_id=rd.L, label=rd.S)
    # both columns are read, so a cut line cannot pass as a narrow record
    good = rd.read_jsonl(t.spark, path, schema, on_bad="skip").filter(c("label").isNotNull())
    return good.agg(F.count("*").alias("n"), F.sum("product_id").alias("total"))


@query("read_queue", f"{V2_STAGES} SELECT product_id::VARCHAR AS product_id, style, shape, taxonomy_depth::INT AS taxonomy_depth FROM v2")
def _(t):
    path = fresh_path(t.spark, "queue")
    item = F.struct(c("product_id").cast("string").alias("product_id"), "product_name", "taxonomy", "taxonomy_depth", *lx.SCHEMA2)
    # one JSON array per file, at most 500 products each
    arrays = extract_attributes_v2(rich_products(t)).groupBy(F.floor(c("product_id") / 500).alias("part")).agg(
        F.to_json(F.collect_list(item)).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return rd.read_queue(t.spark, f"{path}/part=*").select("product_id", "style", "shape", "taxonomy_depth")


@query("read_manifest", f"{with_views('v_manifest')} SELECT product_id::VARCHAR AS product_id, image_count::INT AS image_count, status, source_domain FROM v_manifest")
def _(t):
    path = fresh_path(t.spark, "manifest")
    entry = F.struct(c("product_id").cast("string").alias("key"), F.struct(c("image_count").cast("int").alias("image_count"), "status", "source_domain").alias("value"))
    # one JSON object per file, at most 500 products each
    objects = t.v_manifest.groupBy(F.floor(c("product_id") / 500).alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    objects.write.partitionBy("part").text(path)
    return rd.read_manifest(t.spark, f"{path}/part=*").select("product_id", "image_count", "status", "source_domain")


_HEADS = ["FFD8FFE000000000", "89504E470D0A1A0A", "5249464600000000", "4749463839610000", "0000000000000000"]


@query("read_images_validated", """SELECT page_id, octet_length(encode(html)) + 8 BETWEEN 3000 AND 15000000 AND page_id % 5 < 4 AS valid,
 CASE WHEN octet_length(encode(html)) + 8 BETWEEN 3000 AND 15000000 THEN 12 ELSE 0 END::BIGINT AS bytes_read FROM pages""")
def _(t):
    """Every page as an object with the head of an image or of nothing, written to the shared folder and read back by its head."""
    content = F.concat(F.unhex(F.get(F.lit(_HEADS), (c("page_id") % 5).cast("int"))), F.encode("html", "UTF-8"))
    folder = fresh_path(t.spark, "objects")
    pages = t.wide.pages.select("page_id", F.concat(c("page_id"), F.lit(".img")).alias("name"), content.alias("content"))
    written(hd.write_objects(pages, folder, "name", "content"), "objects")
    heads = hd.read_object_heads(t.spark, folder, lx.IMAGE_BYTES)
    found = heads.select(F.regexp_extract("path", r"(\d+)\.img$", 1).cast("long").alias("page_id"), "bytes_read", rd.is_image(c("head"), c("length")).alias("_image"))
    return t.pages.select("page_id").join(found, "page_id", "left").select(
        "page_id", F.coalesce("_image", F.lit(False)).alias("valid"), F.coalesce("bytes_read", F.lit(0)).cast("long").alias("bytes_read"))


@query("write_vocab", f"{_VOCAB} SELECT kind, value, n, idx FROM vocab")
def _(t):
    path = fresh_path(t.spark, "vocab")
    wr.write_vocab(vocab(t), path)
    return t.spark.read.parquet(path).select("kind", "value", "n", "idx")


@query("write_report_tables", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(t):
    path = fresh_path(t.spark, "report")
    wr.write_report_tables({"types": t.events.groupBy("event_type").agg(F.count("*").alias("n"))}, path)
    return t.spark.read.schema("event_type string, n long").json(f"{path}/types")


# --- learning and extension ----------------------------------------------------------------------
def learning_sets(t):
    """Labelled texts for training, and the held-out ones."""
    v2 = extract_attributes_v2(rich_products(t))
    text = classifier_text(c("product_name"), c("product_class"), c("product_description"))
    marked = v2.withColumns({"text_input": text, "class_type": F.split_part("product_class", F.lit("|"), F.lit(2))})
    for i in range(4):
        marked = marked.withColumn(f"level_{i + 1}", F.get("taxonomy", F.lit(i)))
    all_rows = written(sa.holdout(marked, 0.2), "learning")
    return all_rows.filter(~c("is_val")).drop("is_val"), all_rows.filter(c("is_val")).drop("is_val")


def held_out_report(train, test, models, truth: dict[str, str]):
    """(field, n_scored, labels_known, confidence_ok): held-out rows with a known value, whether every prediction is a value
    of the training rows, and whether every confidence is a probability.  The test tables draw some values independently
    of the texts, so accuracy is checked by tests on texts that do decide it."""
    def values(df, name: str):
        pairs = [F.struct(F.lit(f).alias("field"), c(col).cast("string").alias(name)) for f, col in truth.items()]
        return df.select("product_id", F.explode(F.array(*pairs)).alias("e")).select("product_id", "e.*").filter(c(name).isNotNull())
    learned = values(train, "val").select("field", "val").distinct().withColumn("_known", F.lit(True))
    scored = le.predict_with_confidence(test, models).join(values(test, "truth"), ["product_id", "field"]).join(learned, ["field", "val"], "left")
    return scored.groupBy("field").agg(F.count("*").alias("n_scored"), F.bool_and(F.coalesce("_known", F.lit(False))).alias("labels_known"),
                                       F.bool_and(c("confidence").between(0.0, 1.0 + 1e-9)).alias("confidence_ok"))


def _held_out_sql(truth: dict[str, str]) -> str:
    counts = " UNION ALL ".join(f"SELECT '{f}' AS field, count({e}) AS n_scored, TRUE AS labels_known, TRUE AS confidence_ok FROM held" for f, e in truth.items())
    return f"""{V2_STAGES}, ho AS (SELECT product_id, row_number() OVER (ORDER BY md5('42:' || product_id), product_id) <= floor(count(*) OVER () * 0.2::DOUBLE) AS is_val FROM v2),
 held AS (SELECT v2.* FROM v2 JOIN ho USING (product_id) WHERE is_val) SELECT * FROM ({counts}) WHERE n_scored > 0"""


_LEARNED = lx.SCHEMA2
_LEVELS = {f"level_{i}": f"nullif(split_part(taxonomy_full, ' / ', {i}), '')" for i in range(1, 5)}


@query("train_attribute_models", _held_out_sql({a: a for a in _LEARNED}))
def _(t):
    train, test = learning_sets(t)
    return held_out_report(train, test, le.train_attribute_models(train, _LEARNED), {a: a for a in _LEARNED})


@query("train_taxonomy_models", _held_out_sql(_LEVELS))
def _(t):
    train, test = learning_sets(t)
    return held_out_report(train, test, le.train_taxonomy_models(train, 4), {f: f for f in _LEVELS})


@query("train_class_model", _held_out_sql({**_LEVELS, "product_class": "split_part(product_class, '|', 2)"}))
def _(t):
    train, test = learning_sets(t)
    levels = le.train_taxonomy_models(train, 4)
    return held_out_report(train, test, le.train_class_model(train, levels, "class_type"), {**{f: f for f in _LEVELS}, "product_class": "class_type"})


# predictions on texts that decide the label, value by value
_DECIDED = f"{with_views('v_decided')}, held AS (SELECT * FROM v_decided WHERE held_out)"


def decided(t):
    """Training rows with their path, and the held-out rows."""
    rows = written(t.wide.v_decided.withColumn("taxonomy", F.array("level_1", "level_2")), "decided")
    return rows.filter(~c("held_out")), rows.filter("held_out")


def _decided_sql(fields: dict[str, str], where: str = "NOT blank") -> str:
    rows = " UNION ALL ".join(f"SELECT product_id, '{f}' AS field, {e} AS val FROM held WHERE {where}" for f, e in fields.items())
    return f"{_DECIDED} SELECT product_id, field, val, FALSE AS needs_vlm FROM ({rows})"


def _shown(df, *fields: str):
    return df.filter(c("field").isin(*fields)).select("product_id", "field", "val", "needs_vlm")


@query("predict_attributes", _decided_sql({"style": "style", "primary_material": "primary_material"}))
def _(t):
    train, held = decided(t)
    models = le.train_attribute_models(train, ["style", "primary_material"])
    return _shown(le.predict_with_confidence(held.filter("NOT blank"), models), "style", "primary_material")


@query("predict_taxonomy", _decided_sql({"level_1": "level_1", "level_2": "level_2"}))
def _(t):
    train, held = decided(t)
    return _shown(le.predict_with_confidence(held.filter("NOT blank"), le.train_taxonomy_models(train, 2)), "level_1", "level_2")


@query("predict_class", _decided_sql({"product_class": "class_type"}))
def _(t):
    train, held = decided(t)
    models = le.train_class_model(train, le.train_taxonomy_models(train, 2), "class_type")
    return _shown(le.predict_with_confidence(held.filter("NOT blank"), models), "product_class")


@query("predict_with_confidence", f"""{_DECIDED} SELECT product_id, field, CASE WHEN NOT blank THEN val END AS val, blank AS needs_vlm FROM
 (SELECT product_id, blank, 'style' AS field, style AS val FROM held UNION ALL SELECT product_id, blank, 'primary_material', primary_material FROM held)""")
def _(t):
    # a product without text is predicted from the intercepts alone, which no label dominates, and must be routed
    train, held = decided(t)
    out = le.predict_with_confidence(held, le.train_attribute_models(train, ["style", "primary_material"]))
    return out.select("product_id", "field", F.when(~c("needs_vlm"), c("val")).alias("val"), "needs_vlm")


@query("predict_to_catalog", f"""{_DECIDED} SELECT product_id, CASE WHEN blank THEN 'Asked' ELSE concat(level_1, '>', level_2) END AS taxonomy,
 CASE WHEN blank THEN 'style=asked' ELSE concat('material=', primary_material, '|style=', style) END AS attributes,
 CASE WHEN blank THEN 'primary_material|style|taxonomy' ELSE '' END AS routed_fields, CASE WHEN blank THEN 'pending' ELSE 'classifier' END AS method FROM held""")
def _(t):
    """From text to catalog row: two kinds of heads, routing of weak fields, a fallback that knows the style and the taxonomy."""
    train, held = decided(t)
    features = le.text_features(train, "text_input")
    attributes = le.train_attribute_models(train, ["primary_material", "style"], features=features)
    levels = le.train_taxonomy_models(train, 2, features=features)
    heads = written(le.predict_with_confidence(held, le.TextModels(features, {**levels.heads, **attributes.heads})), "heads")
    answers = held.select("product_id", F.lit("style").alias("field"), F.lit("asked").alias("fb_val"))
    out = ro.routed_catalog(heads, answers, held.select("product_id", F.array(F.lit("Asked")).alias("fb_taxonomy")))
    shown = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("product_id", F.array_join("taxonomy", ">").alias("taxonomy"), F.array_join(shown, "|").alias("attributes"),
                      F.array_join("routed_fields", "|").alias("routed_fields"), "method")


def _plain_extract(_model, row):
    if row["product_id"] % 50 == 7:
        raise ValueError("unreadable")
    return {"style": "modern" if "steel" in (row["product_description"] or "") else None, "product_type": row["product_name"].split(" ")[1]}


@query("run_extraction", f"""{PRODUCTS}, cached AS (SELECT DISTINCT l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)
SELECT product_id, CASE WHEN product_id IN (SELECT product_id FROM cached) THEN 'cached style' WHEN product_id % 50 <> 7 AND contains(coalesce(product_description, ''), 'steel') THEN 'modern' END AS style,
 CASE WHEN product_id NOT IN (SELECT product_id FROM cached) AND product_id % 50 = 7 THEN 'ValueError: unreadable' END AS error, product_id IN (SELECT product_id FROM cached) AS cached FROM v_products""")
def _(t):
    from .catalog import images
    blank = F.struct(*[F.lit("cached style" if a == "style" else None).cast("string").alias(a) for a in lx.SCHEMA1])
    cache = images(t).select("product_id", blank.alias("prediction"), F.lit(1.0).alias("latency_ms"), F.lit("plain").alias("model"), F.lit(None).cast("string").alias("error"))
    extractor = ex.PythonExtractor("plain", lambda: None, _plain_extract)
    out = ex.run_extraction(t.wide.v_products.select("product_id", "product_name", "product_description", "product_class"), extractor, cache)
    return out.select("product_id", c("prediction.style").alias("style"), "error", "cached")


@query("cached_extraction", f"""{PRODUCTS} SELECT product_id, CASE WHEN product_id % 50 <> 7 AND contains(coalesce(product_description, ''), 'steel') THEN 'modern' END AS style,
 CASE WHEN product_id % 50 = 7 THEN 'ValueError: unreadable' END AS error, product_id % 3 = 0 AND product_id % 50 <> 7 AS cached, product_id % 50 <> 7 AS kept FROM v_products""")
def _(t):
    """A third of the catalog is predicted first, then all of it; afterwards only the unreadable products are missing."""
    name = f"predictions_{uuid.uuid4().hex}"
    cache = PredictionCache(t.spark, name, fresh_path(t.spark, name), f"struct<{', '.join(f'{a}: string' for a in lx.SCHEMA1)}>", 16)
    catalog = t.wide.v_products.select("product_id", "product_name", "product_description", "product_class")
    extractor = ex.PythonExtractor("plain", lambda: None, _plain_extract)
    cached_extraction(catalog.filter("product_id % 3 = 0"), extractor, cache)
    out = cached_extraction(catalog, extractor, cache)
    missing = cache.missing(catalog.select("product_id")).withColumn("_missing", F.lit(True))
    return out.join(missing, "product_id", "left").select("product_id", c("prediction.style").alias("style"), "error", "cached", c("_missing").isNull().alias("kept"))


@query("rule_extraction", f"{PRODUCTS}, x AS (SELECT *, lower(concat_ws(' ', product_name, product_description, product_class)) AS t FROM v_products), v AS ({v1_sql('t', 'x')}) SELECT product_id, style, replace(room_type, '|', ', ') AS room_type, 'rule-based' AS model FROM v")
def _(t):
    out = ex.run_extraction(t.wide.v_products, ex.RuleExtractor())
    return out.select("product_id", c("prediction.style").alias("style"), c("prediction.room_type").alias("room_type"), "model")
