"""Routing, merging, vector functions, model answers and text corruption."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import corrupt as co
from ..functions import modeltext as mt
from ..functions import queries as qu
from ..functions import vectors as ve
from ..operators import filters as fi
from ..operators import ranking as rk
from ..operators import routing as ro
from ..operators import upkeep as up
from ..session import fresh_path
from ..sources.readers import read_embeddings
from . import sqlkit as k
from .catalog import flat
from .features import PROCESSED_SQL, PRODUCTS, RICH, V2_STAGES, rich_products
from .registry import query
from .views import with_views

c = F.col


# --- vectors ------------------------------------------------------------------------------
def _soft(lo: int) -> str:
    v = f"list_transform(embedding[{lo}:{lo + 9}], lambda x: 10.0::DOUBLE * x)"
    return k.let(v, "v", "list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))))")


PROBS = f"WITH probs AS (SELECT vec_id, vec_id % 3 <> 0 AS has_image, {_soft(1)} AS p_img, {_soft(11)} AS p_txt, {_soft(21)} AS p_fused FROM embeddings)"


def probs(t):
    """Three 10-class distributions per vector: image, text and fused."""
    def soft(lo):
        return ve.softmax(F.transform(F.slice("embedding", lo, 10), lambda x: F.lit(10.0) * x.cast("double")))
    return t.embeddings.select("vec_id", (c("vec_id") % 3 != 0).alias("has_image"), soft(1).alias("p_img"), soft(11).alias("p_txt"), soft(21).alias("p_fused"))


@query("vector_dot", f"SELECT vec_id, round({k.dot('embedding[1:32]', 'embedding[33:64]')}, 6) AS dot, round({k.dot('embedding[1:32]', 'embedding[33:64]')} / (sqrt({k.dot('embedding[1:32]', 'embedding[1:32]')}) * sqrt({k.dot('embedding[33:64]', 'embedding[33:64]')})), 6) AS cosine FROM embeddings")
def _(t):
    a, b = F.slice("embedding", 1, 32), F.slice("embedding", 33, 32)
    return t.embeddings.select("vec_id", F.round(ve.dot(a, b), 6).alias("dot"), F.round(ve.cosine(a, b), 6).alias("cosine"))


_STATS = "list_position(p_fused, list_max(p_fused)) - 1"


@query("softmax_stats", f"{PROBS} SELECT vec_id, ({_STATS})::INT AS pred, round(list_max(p_fused), 6) AS confidence, round(list_max(p_fused) - list_sort(p_fused, 'DESC')[2], 6) AS margin FROM probs")
def _(t):
    logits = F.transform(F.slice("embedding", 21, 10), lambda x: F.lit(10.0) * x.cast("double"))
    return t.embeddings.select("vec_id", ve.softmax_stats(logits).alias("s")).select(
        "vec_id", "s.pred", F.round("s.confidence", 6).alias("confidence"), F.round("s.margin", 6).alias("margin"))


_ENT = "-list_sum(list_transform({}, lambda x: x * ln(x + 1e-8::DOUBLE)))"
_KL = "list_sum(list_transform(list_zip(p_txt, p_img), lambda z: z[1] * (ln(z[1]) - ln(z[2] + 1e-8::DOUBLE))))"


@query("entropy_kl", f"{PROBS} SELECT vec_id, round({_ENT.format('p_fused')}, 6) AS entropy, round({_KL}, 6) AS kl FROM probs")
def _(t):
    return probs(t).select("vec_id", F.round(ve.entropy(c("p_fused")), 6).alias("entropy"), F.round(ve.kl(c("p_txt"), c("p_img")), 6).alias("kl"))


@query("best_index", "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", ve.best_index(c("embedding")).alias("best"))


@query("pad_and_mask", """SELECT page_id, array_to_string(list_resize(w[1:6], 6, '-'), ' ') AS padded, list_sum(list_transform(range(1, 7), lambda i: CASE WHEN i <= len(w) THEN 1.0::DOUBLE ELSE 0 END)) AS real
FROM (SELECT page_id, string_split(url, '/') AS w FROM pages)""")
def _(t):
    return t.wide.pages.select("page_id", ve.pad_and_mask(F.split("url", "/"), 6, F.lit("-")).alias("p")).select(
        "page_id", F.array_join("p.padded", " ").alias("padded"), F.aggregate("p.mask", F.lit(0.0), lambda s, x: s + x).alias("real"))


@query("clip_norm", "SELECT vec_id, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, (embedding[1]::DOUBLE * 8 + 1) / 2)), 6) AS score FROM embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.round(ve.clip_norm(F.get("embedding", F.lit(0)).cast("double") * 8), 6).alias("score"))


@query("read_embeddings", "SELECT vec_id, round(list_sum(list_transform(CASE WHEN label = 3 THEN list_resize([0.0::DOUBLE], 64, 0.0::DOUBLE) ELSE embedding::DOUBLE[] END, lambda x: abs(x))), 4) AS l1 FROM embeddings")
def _(t):
    path = fresh_path(t.spark, "embeddings")
    t.embeddings.withColumn("embedding", F.when(c("label") != 3, c("embedding"))).write.parquet(path)
    filled = read_embeddings(t.spark, path, 64)
    return filled.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), 4).alias("l1"))


# --- routing ---------------------------------------------------------------------------------
_FLAGS = f"""{PROBS}, s AS (SELECT vec_id, has_image, list_position(p_img, list_max(p_img)) - 1 AS ip, list_max(p_img) AS ic, list_position(p_txt, list_max(p_txt)) - 1 AS tp, list_max(p_txt) AS tc,
   list_max(p_fused) AS fc, list_max(p_fused) - list_sort(p_fused, 'DESC')[2] AS fm, {_ENT.format('p_fused')} AS fe, CASE WHEN has_image THEN {_KL} ELSE 0 END AS kl FROM probs),
 fl AS (SELECT *, CASE WHEN fe > 2.0 THEN 'high_entropy' WHEN fm < 0.1 THEN 'low_margin' WHEN fc < 0.8 THEN 'low_confidence' WHEN has_image AND ip <> tp THEN 'top1_disagree' WHEN has_image AND kl > 2.0 THEN 'kl_diverge' ELSE 'none' END AS mismatch_reason FROM s),
 rt AS (SELECT *, CASE WHEN fc >= 0.85 THEN 1 WHEN fc >= 0.70 AND NOT (ic > 0.6 AND tc > 0.6 AND ip <> tp) THEN 2 ELSE 3 END AS routing_tier FROM fl),
 tiers AS (SELECT *, CASE routing_tier WHEN 1 THEN 'classifier' WHEN 2 THEN 'classifier_cautious' ELSE 'vlm_fallback' END AS method,
   CASE WHEN routing_tier = 3 THEN CASE WHEN fc >= 0.7 THEN 'modality_conflict' ELSE 'low_confidence' END END AS reason FROM rt)"""


@query("mismatch_flags", f"""{_FLAGS} SELECT vec_id, has_image, mismatch_reason <> 'none' AS mismatch, mismatch_reason, round(kl, 6) AS kl_divergence, ip::INT AS img_prediction, tp::INT AS txt_prediction,
  round(ic, 6) AS img_confidence, round(tc, 6) AS txt_confidence, round(fc, 6) AS fused_confidence, round(fm, 6) AS fused_margin, round(fe, 6) AS fused_entropy FROM fl""")
def _(t):
    f = ro.mismatch_flags(probs(t))
    return f.select(*[F.round(n, 6).alias(n) if ty == "double" else c(n) for n, ty in f.dtypes])


@query("route_tiers", f"{_FLAGS} SELECT vec_id, routing_tier::INT AS routing_tier, method, reason FROM tiers")
def _(t):
    return ro.route_tiers(ro.mismatch_flags(probs(t))).select("vec_id", "routing_tier", "method", "reason")


@query("routing_stats", f"""{_FLAGS} SELECT 'tier' AS section, 'tier' || routing_tier AS item, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tiers), 1) AS pct FROM tiers GROUP BY routing_tier
UNION ALL SELECT 'reason', reason, count(*), round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM tiers), 1) FROM tiers WHERE reason IS NOT NULL GROUP BY reason""")
def _(t):
    return up.routing_stats(ro.route_tiers(ro.mismatch_flags(probs(t))))


_WEAK = "(confidence < 0.5 OR val IS NULL OR val = '<UNK>')"
_ROUTED = f"""{with_views('v_heads')}, cut AS (SELECT product_id, min(i) FILTER (starts_with(field, 'level_') AND {_WEAK}) AS cut FROM v_heads GROUP BY 1),
 routed AS (SELECT h.product_id, string_agg(val, '>' ORDER BY i) FILTER (starts_with(field, 'level_') AND (cut IS NULL OR i < cut)) AS taxonomy,
   concat_ws('|', string_agg(field, '|' ORDER BY i) FILTER (NOT starts_with(field, 'level_') AND {_WEAK}), CASE WHEN any_value(cut) IS NOT NULL THEN 'taxonomy' END) AS routed_fields FROM v_heads h JOIN cut USING (product_id) GROUP BY 1)"""


@query("fields_to_route", f"{_ROUTED} SELECT product_id, coalesce(taxonomy, '') AS taxonomy, routed_fields FROM routed")
def _(t):
    r = ro.fields_to_route(t.v_heads)
    return r.select("product_id", F.array_join("taxonomy", ">").alias("taxonomy"), F.array_join("routed_fields", "|").alias("routed_fields"))


@query("taxonomy_prefix_cut", f"""{with_views('v_heads')}, cut AS (SELECT product_id, min(i) FILTER (starts_with(field, 'level_') AND {_WEAK}) AS cut FROM v_heads GROUP BY 1)
SELECT product_id, i::INT AS i, field, val, confidence FROM v_heads JOIN cut USING (product_id) WHERE starts_with(field, 'level_') AND (cut IS NULL OR i < cut)""")
def _(t):
    return ro.cut_levels(t.v_heads)


@query("taxonomy_prefix_array", f"{_ROUTED} SELECT product_id, coalesce(taxonomy, '') AS taxonomy FROM routed")
def _(t):
    h = t.v_heads.filter(ro.is_level(c("field"))).groupBy("product_id").agg(F.transform(  # at most one entry per level
        F.array_sort(F.collect_list(F.struct("i", "val", "confidence"))), lambda l: F.struct(l["val"].alias("value"), l["confidence"].alias("confidence"))).alias("levels"))
    return h.select("product_id", F.array_join(F.transform(rk.taxonomy_prefix_cut(c("levels")), lambda l: l["value"]), ">").alias("taxonomy"))


@query("field_routing_stats", f"""{_ROUTED}, x AS (SELECT *, (product_id % 50)::DOUBLE AS ms, CASE WHEN routed_fields <> '' THEN (product_id % 900)::DOUBLE ELSE 0 END AS fb FROM routed)
SELECT unnest(['total', 'classifier_only', 'routed']) AS item, unnest([count(*), count(*) FILTER (routed_fields = ''), count(*) FILTER (routed_fields <> '')]) AS n, NULL::DOUBLE AS value FROM x
UNION ALL SELECT 'avg_classifier_ms', NULL, round(avg(ms), 4) FROM x UNION ALL SELECT 'avg_fallback_ms', NULL, round(sum(fb) FILTER (fb > 0) / count(*) FILTER (routed_fields <> ''), 4) FROM x
UNION ALL SELECT 'field_' || f, count(*), round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM x), 4) FROM (SELECT unnest(string_split(routed_fields, '|')) AS f FROM x WHERE routed_fields <> '') GROUP BY f""")
def _(t):
    r = ro.fields_to_route(t.v_heads).withColumn("classifier_ms", (c("product_id") % 50).cast("double")).withColumn(
        "fallback_ms", F.when(F.size("routed_fields") > 0, (c("product_id") % 900).cast("double")).otherwise(0.0))
    return up.field_routing_stats(r)


_FB = "fb AS (SELECT p_partkey AS product_id, f.field, p_brand AS fb_val FROM part, (SELECT unnest(['style', 'primary_color']) AS field) f WHERE p_size > 20)"


def fallback(t):
    return t.part.filter(c("p_size") > 20).select(c("p_partkey").alias("product_id"), F.explode(F.lit(["style", "primary_color"])).alias("field"), c("p_brand").alias("fb_val"))


_MERGED = f"""{with_views('v_heads')}, {_FB}, merged AS (SELECT product_id, field, CASE WHEN {_WEAK} AND fb_val IS NOT NULL THEN fb_val WHEN NOT {_WEAK} THEN val END AS val,
  CASE WHEN {_WEAK} AND fb_val IS NOT NULL THEN 0.8 ELSE confidence END::DOUBLE AS confidence, CASE WHEN {_WEAK} AND fb_val IS NOT NULL THEN 'vlm' WHEN NOT {_WEAK} THEN 'classifier' ELSE 'pending_vlm' END AS source
  FROM v_heads LEFT JOIN fb USING (product_id, field) WHERE NOT starts_with(field, 'level_'))"""


@query("merge_fallback", f"{_MERGED} SELECT * FROM merged")
def _(t):
    return ro.merge_fallback(t.v_heads, fallback(t))


@query("merge_taxonomy", f"""{_ROUTED}, fbt AS (SELECT p_partkey AS product_id, p_type AS fb FROM part WHERE p_size > 20)
SELECT product_id, CASE WHEN contains(routed_fields, 'taxonomy') AND fb IS NOT NULL THEN fb ELSE coalesce(taxonomy, '') END AS taxonomy, coalesce(contains(routed_fields, 'taxonomy') AND fb IS NOT NULL, false) AS taxonomy_from_fallback
FROM routed LEFT JOIN fbt USING (product_id)""")
def _(t):
    fb = t.part.filter(c("p_size") > 20).select(c("p_partkey").alias("product_id"), F.array("p_type").alias("fb_taxonomy"))
    return ro.merge_taxonomy(ro.fields_to_route(t.v_heads), fb).withColumn("taxonomy", F.array_join("taxonomy", ">"))


@query("parsed_safety_net", f"""{_MERGED}, parsed AS (SELECT p_partkey AS product_id, unnest(['assembly', 'shape']) AS field, p_type AS pv FROM part WHERE p_size < 30),
 j AS (SELECT *, coalesce(field IN ('assembly', 'shape') AND (val IS NULL OR confidence < 0.3) AND coalesce(pv, '') <> '', false) AS take FROM merged FULL JOIN parsed USING (product_id, field))
SELECT product_id, field, CASE WHEN take THEN pv ELSE val END AS val, CASE WHEN take THEN 1.0 ELSE confidence END::DOUBLE AS confidence, CASE WHEN take THEN 'parsed_features' ELSE source END AS source FROM j WHERE take OR source IS NOT NULL""")
def _(t):
    parsed = t.part.filter(c("p_size") < 30).select(c("p_partkey").alias("product_id"), F.explode(F.lit(["assembly", "shape"])).alias("field"), c("p_type").alias("parsed_val"))
    return ro.parsed_safety_net(ro.merge_fallback(t.v_heads, fallback(t)), parsed)


@query("unavailable_fallback", f"""{_FLAGS}, a AS (SELECT vec_id, 0.9::DOUBLE AS ac FROM embeddings WHERE label < 5)
SELECT vec_id AS product_id, routing_tier::INT AS routing_tier, round(CASE WHEN routing_tier = 3 THEN coalesce(ac, 0.5) ELSE fc END, 6)::DOUBLE AS confidence FROM tiers LEFT JOIN a USING (vec_id)""")
def _(t):
    tiers = ro.route_tiers(ro.mismatch_flags(probs(t))).withColumnRenamed("vec_id", "product_id")
    answers = t.embeddings.filter(c("label") < 5).select(c("vec_id").alias("product_id"), F.lit(0.9).alias("answer_confidence"))
    return ro.unavailable_fallback(tiers, answers).select("product_id", "routing_tier", F.round("confidence", 6).alias("confidence"))


_ATTR_MAP = "(field, val) for attribute heads"


@query("decode_attributes", f"""{with_views('v_heads')} SELECT product_id, coalesce(string_agg(replace(replace(field, '_family', ''), 'primary_', '') || '=' || val, '|' ORDER BY i) FILTER (val <> '<UNK>'), '') AS attributes
FROM v_heads WHERE NOT starts_with(field, 'level_') GROUP BY 1""")
def _(t):
    maps = t.v_heads.filter(~ro.is_level(c("field"))).groupBy("product_id").agg(F.map_from_entries(F.transform(  # one entry per head
        F.array_sort(F.collect_list(F.struct("i", "field", "val"))), lambda e: F.struct(e["field"], e["val"]))).alias("m"))
    shown = F.transform(F.map_entries(ro.decode_attributes(c("m"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return maps.select("product_id", F.array_join(shown, "|").alias("attributes"))


@query("catalog_lines", f"""{V2_STAGES} SELECT product_id, taxonomy_full AS taxonomy, style, shape, round((product_id % 997) / 997.0::DOUBLE, 3) AS confidence FROM v2""")
def _(t):
    from ..functions.attributes import extract_attributes_v2
    df = extract_attributes_v2(rich_products(t)).select("product_id", c("taxonomy_full").alias("taxonomy"), F.struct("style", "shape").alias("attributes"),
                                                        (c("product_id") % 997 / 997.0).alias("confidence"))
    return fi.catalog_lines(df)


# --- model answers ----------------------------------------------------------------------------
ANSWERS = with_views("v_answers")
_KEYS = lx.SCHEMA1


def _value_sql(x: str) -> str:
    cut = k.strip(f"split_part({k.strip(x)}, ';', 1)")
    own = k.strip(f"regexp_replace({cut}, '(?s)(?:{'|'.join(_KEYS)}):.*$', '')")
    return k.let(own, "v", f"CASE WHEN lower(CASE WHEN length(v) > 100 THEN substr(v, 1, 50) ELSE v END) NOT IN {k.inlist(lx.NONE_WORDS)} THEN CASE WHEN length(v) > 100 THEN substr(v, 1, 50) ELSE v END END")


_CLEANKEY = "replace(lower({}), ' ', '_')"
_JSON_OBJ = "CASE WHEN json_valid({0}) AND json_type({0}) = 'OBJECT' THEN {0}::JSON END"
_STAGES = f"""{ANSWERS}, a0 AS (SELECT product_id, CASE WHEN {k.strip("coalesce(answer, '')")} <> '' THEN substr(regexp_replace(split_part(answer, chr(10) || chr(10), 1), '([\\p{{L}}\\p{{N}}_]+)(?:/[\\p{{L}}\\p{{N}}_]+){{5,}}', '\\1', 'g'), 1, 500) END AS txt FROM v_answers),
 a1 AS (SELECT *, coalesce({_JSON_OBJ.format(k.strip('txt'))}, {_JSON_OBJ.format("regexp_extract(txt, '[{][^{}]+[}]', 0)")}) AS js,
   list_filter(list_transform(list_filter(flatten(list_transform(list_filter(list_transform(string_split({k.strip('txt')}, chr(10)), lambda l: {k.strip('l')}), lambda l: l <> '' AND NOT starts_with(l, 'Product:')), lambda l: list_transform(string_split(l, ';'), lambda p: {k.strip('p')}))), lambda p: contains(p, ':')),
     lambda p: {{'key': {_CLEANKEY.format(k.strip("split_part(p, ':', 1)"))}, 'value': {k.strip("substr(p, instr(p, ':') + 1)")}}}), lambda e: e.key IN {k.inlist(_KEYS)} AND e.value <> '') AS kv FROM a0)"""


def _pick(key: str) -> str:
    js = f"list_filter(json_keys(js), lambda j: {_CLEANKEY.format(k.strip('j'))} = '{key}')[-1]"
    jv = f"json_extract_string(js, '$.\"' || {js} || '\"')"
    kv = f"list_filter(kv, lambda e: e.key = '{key}')[1].value"
    rx = k.strip(f"nullif(regexp_extract(lower(txt), '{key}\\s*[:=]\\s*([^;\\n]+)', 1), '')")
    return f"CASE WHEN len(json_keys(js)) > 0 THEN {_value_sql(jv)} WHEN len(kv) > 0 THEN {_value_sql(kv)} ELSE {_value_sql(rx)} END AS {key}"


@query("parse_model_output", f"{_STAGES} SELECT product_id, {', '.join(_pick(x) for x in _KEYS)} FROM a1")
def _(t):
    return t.wide.v_answers.select("product_id", mt.parse_model_output(c("answer")).alias("a")).select("product_id", "a.*")


@query("parse_json_output", f"""{ANSWERS}, x AS (SELECT product_id, coalesce({_JSON_OBJ.format(k.strip('answer'))}, {_JSON_OBJ.format("regexp_extract(answer, '[{][^{}]+[}]', 0)")}) AS js FROM v_answers)
SELECT product_id, array_to_string(list_transform(json_keys(js), lambda j: j || '=' || json_extract_string(js, '$."' || j || '"')), '|') AS entries FROM x""")
def _(t):
    shown = F.transform(mt.parse_json_output(c("answer")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.wide.v_answers.select("product_id", F.array_join(shown, "|").alias("entries"))


@query("parse_kv_output", _STAGES.replace("regexp_replace(split_part(answer, chr(10) || chr(10), 1), '([\\p{L}\\p{N}_]+)(?:/[\\p{L}\\p{N}_]+){5,}', '\\1', 'g')", "answer").replace(", 1, 500) END AS txt", ", 1, 100000) END AS txt")
       + " SELECT product_id, CASE WHEN len(kv) > 0 THEN array_to_string(list_transform(list_filter(kv, lambda e, i: list_position(list_transform(kv, lambda o: o.key), e.key) = i), lambda e: e.key || '=' || e.value), '|') END AS entries FROM a1")
def _(t):
    from ..functions.text import none_if_blank
    shown = F.transform(mt.parse_kv_output(none_if_blank(c("answer"))), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.wide.v_answers.select("product_id", F.array_join(shown, "|").alias("entries"))


@query("parse_regex_output", f"""{ANSWERS} SELECT product_id, concat_ws('|', {', '.join("'" + x + "=' || " + k.strip(f"nullif(regexp_extract(lower(answer), '{x}" + chr(92) + "s*[:=]" + chr(92) + "s*([^;" + chr(92) + "n]+)', 1), '')") for x in _KEYS)}) AS entries FROM v_answers""")
def _(t):
    shown = F.transform(mt.parse_regex_output(c("answer")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return t.wide.v_answers.select("product_id", F.array_join(shown, "|").alias("entries"))


@query("normalize_model_output", f"{ANSWERS} SELECT product_id, {_value_sql('answer')} AS value FROM v_answers")
def _(t):
    return t.wide.v_answers.select("product_id", mt.normalize_model_value(c("answer")).alias("value"))


_FENCE = f"""{k.strip("regexp_replace(CASE WHEN starts_with(f, '```') THEN CASE WHEN contains(f, chr(10)) THEN substr(f, instr(f, chr(10)) + 1) ELSE substr(f, 4) END ELSE f END, '```$', '')")}"""


def _from_js(col: str, key: str) -> str:
    return f"json_extract_string({col}, '$.{key}') AS {key}"


@query("parse_fenced_json", f"""{ANSWERS}, f AS (SELECT product_id, {k.strip('fenced')} AS f FROM v_answers), g AS (SELECT product_id, {_JSON_OBJ.format(_FENCE)} AS js FROM f)
SELECT product_id, {', '.join(_from_js('js', x) for x in _KEYS)} FROM g""")
def _(t):
    return t.wide.v_answers.select("product_id", mt.parse_fenced_json(c("fenced")).alias("a")).select("product_id", "a.*")


@query("parse_braced_json", f"""{ANSWERS}, g AS (SELECT product_id, {_JSON_OBJ.format("regexp_extract(fenced, '(?s)[{].*[}]', 0)")} AS js FROM v_answers)
SELECT product_id, {', '.join(_from_js('js', x) for x in _KEYS)} FROM g""")
def _(t):
    return t.wide.v_answers.select("product_id", mt.parse_fenced_json(c("fenced"), braces_only=True).alias("a")).select("product_id", "a.*")


@query("validate_vocab", f"""{PROCESSED_SQL} SELECT product_id, CASE WHEN style IN {k.inlist(list(lx.STYLE_GROUPS))} THEN style END AS style, CASE WHEN color_family IN {k.inlist(list(lx.COLOR_FAMILIES))} THEN color_family END AS color_family FROM processed""")
def _(t):
    return fi.process_products(t.wide.v_products).select(
        "product_id", mt.valid_or_null(c("style"), list(lx.STYLE_GROUPS)).alias("style"), mt.valid_or_null(c("color_family"), list(lx.COLOR_FAMILIES)).alias("color_family"))


def _alias_sql(x: str, table: dict) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {k.q(a)} THEN {k.q(b)}" for a, b in table.items()) + f" ELSE {x} END"


_ALIGN_VALUES = {
    "color": _alias_sql("lower(color)", lx.MODEL_COLORS), "material": _alias_sql("lower(material)", lx.MODEL_MATERIALS), "secondary_material": "NULL",
    "style": _alias_sql("lower(style)", lx.MODEL_STYLES), "room": "rooms", "type": "lower(ptype)", "assembly": "CASE assembly WHEN true THEN 'yes' WHEN false THEN 'no' END"}
_KEEP = "list_filter([" + ", ".join(f"{{'k': '{n}', 'v': {v}}}" for n, v in _ALIGN_VALUES.items()) + "], lambda e: e.v IS NOT NULL AND e.v NOT IN ('none', 'null', 'n/a', 'unknown', ''))"
_ALIGN_SRC = """SELECT p_partkey AS product_id, CASE p_partkey % 5 WHEN 0 THEN 'Grey' WHEN 1 THEN 'Espresso' WHEN 2 THEN NULL WHEN 3 THEN 'unknown' ELSE split_part(p_name, ' ', 1) END AS color,
  CASE p_partkey % 3 WHEN 0 THEN 'Solid Wood' WHEN 1 THEN 'canvas' ELSE NULL END AS material, CASE p_partkey % 4 WHEN 0 THEN 'MCM' WHEN 1 THEN 'boho' ELSE 'none' END AS style,
  CASE WHEN p_partkey % 2 = 0 THEN 'living room, office' END AS rooms, CASE WHEN p_partkey % 6 <> 0 THEN p_name END AS ptype, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS assembly,
  CASE WHEN p_partkey % 3 = 0 THEN 'Furniture' ELSE '' END AS path, p_partkey % 10 = 0 AS nothing FROM part"""


@query("align_model_schema", f"""WITH s AS ({_ALIGN_SRC}), e AS (SELECT *, {_KEEP} AS own FROM s), f AS (SELECT *, own || list_filter([{{'k': 'style', 'v': 'rustic'}}, {{'k': 'shape', 'v': 'round'}}], lambda g: NOT list_contains(list_transform(own, lambda o: o.k), g.k)) AS full_ FROM e)
SELECT product_id, CASE WHEN NOT nothing AND path = '' AND ptype IS NOT NULL THEN upper(split_part(ptype, ' ', 1)[1]) || substr(split_part(ptype, ' ', 1), 2) || ' ' || upper(split_part(ptype, ' ', 2)[1]) || substr(split_part(ptype, ' ', 2), 2) ELSE path END AS taxonomy,
 CASE WHEN nothing THEN 'style=rustic|shape=round' ELSE array_to_string(list_transform(full_, lambda x: x.k || '=' || x.v), '|') END AS attributes,
 CASE WHEN nothing THEN 0.5 WHEN len(full_) >= 5 THEN 0.9 WHEN len(full_) >= 3 THEN 0.8 WHEN len(full_) >= 1 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM f""")
def _(t):
    s = t.spark.sql(_ALIGN_SRC.replace("FROM part", "FROM {part}"), part=t.part)
    answer = F.when(~c("nothing"), F.struct(
        c("style"), c("material").alias("primary_material"), F.lit(None).cast("string").alias("secondary_material"), c("color").alias("color_family"),
        F.split("rooms", ", ").alias("room_type"), c("ptype").alias("product_type"), c("assembly").alias("assembly_required")))
    given = F.create_map(F.lit("style"), F.lit("rustic"), F.lit("shape"), F.lit("round"))
    path = F.filter(F.array("path"), lambda p: p != "")
    out = s.select("product_id", answer.alias("answer"), path.alias("p")).select(
        "product_id", mt.align_model_schema(c("answer"), c("p"), given).alias("r"))
    shown = F.transform(F.map_entries("r.attributes"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("product_id", F.array_join("r.taxonomy", ">").alias("taxonomy"), F.array_join(shown, "|").alias("attributes"), "r.confidence")


@query("apply_aliases", f"""SELECT p_partkey, coalesce(CASE lower(v) {' '.join(f"WHEN {k.q(a)} THEN {k.q(b)}" for a, b in lx.COLOR_ALIASES.items())} END, v) AS color
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Grey' WHEN 1 THEN 'cream' WHEN 2 THEN 'Navy' ELSE p_name END AS v FROM part)""")
def _(t):
    v = F.when(c("p_partkey") % 4 == 0, "Grey").when(c("p_partkey") % 4 == 1, "cream").when(c("p_partkey") % 4 == 2, "Navy").otherwise(c("p_name"))
    return t.part.select("p_partkey", mt.apply_aliases(v, lx.COLOR_ALIASES).alias("color"))


# --- query texts -----------------------------------------------------------------------------------
def _q_part(x: str, skip, names: dict) -> str:
    ren = "".join(f" WHEN {x} = {k.q(a)} THEN {k.q(b)}" for a, b in names.items())
    return f"CASE WHEN {x} IN {k.inlist(['', *skip])} THEN NULL{ren} ELSE {x} END"


@query("image_query", f"""{V2_STAGES} SELECT product_id, concat_ws(' ', {_q_part('primary_color', ['other', 'multi'], {'gold_metal': 'gold', 'natural_fiber': 'natural'})},
 {_q_part('primary_material', ['other', 'mixed'], {'natural_fiber': 'natural fiber', 'synthetics': 'synthetic'})}, {_q_part('shape', ['rectangular', 'other'], {})}, product_name, {_q_part('style', ['other'], {})}, 'shop') AS q FROM v2""")
def _(t):
    from ..functions.attributes import extract_attributes_v2
    v2 = extract_attributes_v2(rich_products(t))
    return v2.select("product_id", qu.image_query(c("primary_color"), c("primary_material"), c("shape"), c("product_name"), c("style"), "shop").alias("q"))


_AW = f"""list_sort(list_distinct(list_filter({k.words("lower(concat_ws(' ', " + ", ".join(f"replace({_q_part(x, ['other', 'multi', 'mixed'], {})}, '_', ' ')" for x in ['primary_color', 'primary_material', 'style']) + f", replace({_q_part('shape', ['rectangular', 'other'], {})}, '-', ' ')))")}, lambda w: length(w) >= 3)))"""


@query("attribute_words", f"{V2_STAGES} SELECT product_id, array_to_string({_AW}, '|') AS words FROM v2")
def _(t):
    from ..functions.attributes import extract_attributes_v2
    v2 = extract_attributes_v2(rich_products(t))
    return v2.select("product_id", F.array_join(qu.attribute_words(c("primary_color"), c("primary_material"), c("style"), c("shape")), "|").alias("words"))


_BARE = "concat(product_name, ' ', extra)"
for _p, _o in [(r"[^ \t\n\r]+[®™]", ""), (r"\bby\s+\w+\b", "i"), (r"""\d+[''"]\s*[xX×]\s*\d+[''"]*""", ""), (r"""\d+[''"]+""", ""), (r"\d+\s*(?:inch|in|cm|mm|ft)\b", "i"), (r"\b[A-Z]{2,}\d{2,}\b", "")]:
    _BARE = f"regexp_replace({_BARE}, '{_p}', '', 'g{_o}')"
_BARE = k.strip(f"regexp_replace({_BARE}, '\\s+', ' ', 'g')")


@query("stock_query", f"""{with_views('v_named')}, b AS (SELECT product_id, CASE WHEN product_id % 3 > 0 THEN product_class END AS cls, {_BARE} AS bare FROM v_named),
 u AS (SELECT *, CASE WHEN cls IS NOT NULL THEN concat_ws(' ', nullif(array_to_string(list_filter({k.words('lower(bare)')}, lambda w: w IN {k.inlist(lx.STOCK_ADJECTIVES)} AND NOT contains(lower(cls), w))[1:2], ' '), ''), lower(cls)) ELSE array_to_string({k.words('bare')}[1:5], ' ') END AS q FROM b)
SELECT product_id, {k.strip("CASE WHEN len(" + k.words('q') + ") <= 2 AND NOT contains(lower(q), 'furniture') THEN q || ' furniture' ELSE q END")} AS q FROM u""")
def _(t):
    cls = F.when(c("product_id") % 3 > 0, c("product_class"))
    return t.wide.v_named.select("product_id", qu.stock_query(F.concat("product_name", F.lit(" "), "extra"), cls).alias("q"))


_QTEXT = "CASE product_id % 3 WHEN 0 THEN 'Modern ' || product_name || ' chair under $' || (product_id % 900) WHEN 1 THEN product_name || ' oak table below 99.50' ELSE upper(product_name) || ' mid-century rug' END"


def _qcol():
    p = c("product_id")
    return F.when(p % 3 == 0, F.concat(F.lit("Modern "), "product_name", F.lit(" chair under $"), (p % 900).cast("string"))).when(
        p % 3 == 1, F.concat("product_name", F.lit(" oak table below 99.50"))).otherwise(F.concat(F.upper("product_name"), F.lit(" mid-century rug")))


def _qattr_sql(x: str) -> str:
    ws = f"regexp_extract_all(lower({x}), '\\w+')"
    return ", ".join(f"list_min(list_filter({ws}, lambda w: w IN {k.inlist(v)})) AS {a}" for a, v in lx.QUERY_TERMS.items())


@query("query_attributes", f"{PRODUCTS}, q AS (SELECT product_id, {_QTEXT} AS q FROM v_products) SELECT product_id, {_qattr_sql('q')} FROM q")
def _(t):
    return t.wide.v_products.select("product_id", qu.query_attributes(_qcol()).alias("a")).select("product_id", "a.*")


_KNOWN = k.inlist(sorted({x for v in lx.QUERY_TERMS.values() for x in v}))
_PRICE_RX = r"(?:under|below|less than)\s*\$?\s*(\d+(?:\.\d+)?)"


@query("query_parse", f"""{PRODUCTS}, q AS (SELECT product_id, {_QTEXT} AS q FROM v_products) SELECT product_id, {_qattr_sql('q')}, nullif(regexp_extract(lower(q), '{_PRICE_RX}', 1), '')::DOUBLE AS max_price,
 array_to_string(list_filter({k.words("regexp_replace(lower(q), '" + _PRICE_RX + "', ' ', 'g')")}, lambda w: w NOT IN {_KNOWN}), ' ') AS text FROM q""")
def _(t):
    return t.wide.v_products.select("product_id", qu.query_parse(_qcol()).alias("a")).select("product_id", "a.*")


# --- text corruption --------------------------------------------------------------------------------
def vague_sql(x: str, listed) -> str:
    kept = f"array_to_string(list_filter({k.words(x)}, lambda w: lower(regexp_replace(w, '[^a-zA-Z]', '', 'g')) NOT IN {k.inlist(listed)}), ' ')"
    return f"regexp_replace(regexp_replace({kept}, ',\\s*,', ',', 'g'), '^\\s*,|,\\s*$', '', 'g')"


@query("make_vague", f"{PRODUCTS} SELECT product_id, {vague_sql('product_description', co.VAGUE_WORDS)} AS vague, {vague_sql('product_description', co.VAGUE_WORDS_ROOMS)} AS vague_rooms FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", co.make_vague(c("product_description")).alias("vague"),
                               co.make_vague(c("product_description"), co.VAGUE_WORDS_ROOMS).alias("vague_rooms"))


def _swap_sql(x: str, truth: str, listed, salt: str) -> str:
    present = f"list_filter({k.lst(listed)}, lambda s: contains(lower({x}), s))[1]"
    wrong = f"list_filter({k.lst(listed)}, lambda s: NOT contains(lower({truth}), s))"
    choice = f"{wrong}[({k.draw(42, salt, 'product_id')} % len({wrong}) + 1)::INT]"
    return f"CASE WHEN coalesce({truth}, '') <> '' AND {present} IS NOT NULL THEN regexp_replace({x}, {present}, {choice}, 'gi') ELSE {x} END"


_ADV = f"""{PROCESSED_SQL}, s0 AS (SELECT *, coalesce(product_description, '') || ' Modern brown wood, MODERN!' AS t0 FROM processed), s1 AS (SELECT *, {_swap_sql('t0', 'color_family', lx.SWAP_COLORS, 'color')} AS t1 FROM s0),
 s2 AS (SELECT *, {_swap_sql('t1', 'primary_material', lx.SWAP_MATERIALS, 'material')} AS t2 FROM s1), s3 AS (SELECT *, {_swap_sql('t2', 'style', lx.SWAP_STYLES, 'style')} AS t3 FROM s2)"""


def _adv_source(t):
    return fi.process_products(t.wide.v_products).withColumn("t0", F.concat(F.coalesce("product_description", F.lit("")), F.lit(" Modern brown wood, MODERN!")))


@query("make_adversarial", f"{_ADV} SELECT product_id, t3 AS text FROM s3")
def _(t):
    return _adv_source(t).select("product_id", co.make_adversarial(c("t0"), c("color_family"), c("primary_material"), c("style"), 42, c("product_id")).alias("text"))


_MIX = f"""{_ADV}, mix AS (SELECT *, CASE WHEN {k.uniform(42, 'mix', 'product_id')} < 0.5 THEN 'vague' WHEN {k.uniform(42, 'mix', 'product_id')} < 0.8 THEN 'adversarial' ELSE 'original' END AS corruption FROM s3)"""


def _mixed(t):
    return co.corrupt_mix(_adv_source(t), "t0", {"color": "color_family", "material": "primary_material", "style": "style"})


@query("corrupt_mix", f"""{_MIX} SELECT product_id, corruption, t0 AS original, CASE corruption WHEN 'vague' THEN {vague_sql('t0', co.VAGUE_WORDS_ROOMS)} WHEN 'adversarial' THEN t3 ELSE t0 END AS text FROM mix""")
def _(t):
    return _mixed(t).select("product_id", "corruption", c("t0_original").alias("original"), c("t0").alias("text"))


@query("corruption_shares", f"{_MIX} SELECT corruption, count(*) AS n FROM mix GROUP BY 1")
def _(t):
    return _mixed(t).groupBy("corruption").agg(F.count("*").alias("n"))


def mask_sql(x: str, listed) -> str:
    return f"array_to_string(list_transform({k.words(x)}, lambda w: CASE WHEN regexp_replace(lower(w), '[^a-z-]', '', 'g') IN {k.inlist(listed)} THEN '[MASK]' ELSE w END), ' ')"


@query("mask_words", f"SELECT doc_id, {mask_sql('text', lx.MASK_COLORS + ['the', 'und', 'le'])} AS text FROM documents")
def _(t):
    return t.wide.documents.select("doc_id", co.mask_words(c("text"), lx.MASK_COLORS + ["the", "und", "le"]).alias("text"))


def preserved_sql(x: str) -> str:
    parts = ", ".join(f"regexp_extract_all(lower(coalesce({x}, '')), {k.q(p)}, {1 if '(' + chr(92) + 'w' in p else 0})" for p in lx.ASSEMBLY_PATTERNS + lx.MATERIAL_PATTERNS)
    return f"array_to_string({k.odistinct(f'list_filter(list_transform(flatten([{parts}]), lambda p: trim(p)), lambda p: p <> {chr(39)}{chr(39)})')}, ', ')"


_PRES_SRC = "concat(coalesce(product_description, ''), CASE product_id % 3 WHEN 0 THEN ' Made of solid oak planks; tools included, easy assembly.' WHEN 1 THEN ' Memory foam and stainless steel. No assembly required.' ELSE '' END)"


def _pres_col():
    p = c("product_id")
    return F.concat(F.coalesce("product_description", F.lit("")), F.when(p % 3 == 0, " Made of solid oak planks; tools included, easy assembly.").when(
        p % 3 == 1, " Memory foam and stainless steel. No assembly required.").otherwise(""))


@query("preserved_phrases", f"{PRODUCTS} SELECT product_id, {preserved_sql(_PRES_SRC)} AS phrases FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", co.preserved_phrases(_pres_col()).alias("phrases"))


_U = {n: k.uniform(7, n, "product_id") for n in ("level", "mask_color", "mask_shape", "mask_style", "mask_material")}
_LEVELS = f"CASE WHEN {_U['level']} < 0.15 THEN 'full' WHEN {_U['level']} < 0.3 THEN 'partial' WHEN {_U['level']} < 0.6 THEN 'name' WHEN {_U['level']} < 0.8 THEN 'minimal' ELSE 'empty' END"
_AUG = f"""{RICH}, g0 AS (SELECT product_id, product_name AS nm, product_class AS cl, substr({_PRES_SRC}, 1, 400) AS d, {_LEVELS} AS lv FROM rich), g1 AS (SELECT *, nullif({preserved_sql('d')}, '') AS keep FROM g0),
 g2 AS (SELECT *, CASE lv WHEN 'full' THEN concat_ws(' [SEP] ', nm, nullif(cl, ''), nullif(d, '')) WHEN 'partial' THEN concat_ws(' [SEP] ', nm, nullif(cl, ''), keep) WHEN 'name' THEN concat_ws(' [SEP] ', nm, keep)
   WHEN 'minimal' THEN concat_ws(' [SEP] ', array_to_string({k.words('nm')}[1:greatest(1, len({k.words('nm')}) // 3)], ' '), keep) ELSE coalesce(keep, '') END AS t0 FROM g1)"""
for _i, (_kind, _rate) in enumerate(lx.MASK_RATES):
    _l = {"color": lx.MASK_COLORS, "shape": lx.MASK_SHAPES, "style": lx.MASK_STYLES, "material": lx.MASK_MATERIALS}[_kind]
    _AUG += f", h{_i} AS (SELECT *, CASE WHEN t{_i} <> '' AND {_U['mask_' + _kind]} < {_rate} THEN {mask_sql(f't{_i}', _l)} ELSE t{_i} END AS t{_i + 1} FROM {'g2' if _i == 0 else f'h{_i - 1}'})"


@query("augment_text", f"{_AUG} SELECT product_id, t4 AS text, concat_ws(' [SEP] ', nm, nullif(cl, ''), nullif(d, '')) AS full_text FROM h3")
def _(t):
    r = rich_products(t)
    args = (c("product_name"), c("product_class"), _pres_col(), 7, c("product_id"))
    return r.select("product_id", co.augment_text(*args).alias("text"), co.augment_text(*args, training=False).alias("full_text"))
