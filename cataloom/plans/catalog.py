"""Projections, filters, profiles, selection, sampling and joins over the catalog view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import attributes as A
from ..functions import features as fe
from ..functions import text as tx
from ..operators import filters as fi
from ..operators import joins as jo
from ..operators import profile as pr
from ..operators import ranking as rk
from ..operators import sampling as sa
from ..operators import taxonomy as ta
from ..session import written
from . import sqlkit as k
from .features import PROCESSED_SQL, PRODUCTS, RICH, V2_STAGES, rich_products, v1_sql
from .registry import query
from .views import with_views

c = F.col


def processed(t):
    return fi.process_products(t.wide.v_products)


def flat(df):
    """Arrays shown as text so that results compare as plain values."""
    return df.select(*[F.array_join(n, "|").alias(n) if ty.startswith("array") else c(n) for n, ty in df.dtypes])


# --- filters and projections ------------------------------------------------------------
@query("with_features", f"{PRODUCTS} SELECT product_id, product_name FROM v_products WHERE product_features IS NOT NULL AND {k.strip('product_features')} <> ''")
def _(t):
    return fi.with_features(t.wide.v_products).select("product_id", "product_name")


@query("by_id", f"{PRODUCTS} SELECT product_id, product_name, product_class FROM v_products WHERE product_id = 42")
def _(t):
    return fi.by_id(t.v_products, 42).select("product_id", "product_name", "product_class")


_PRESENT4 = " + ".join(f"({a} IS NOT NULL)::INT" for a in ["style", "primary_material", "color_family", "product_type"])
_PRESENT7 = " + ".join(f"({a} IS NOT NULL)::INT" for a in lx.SCHEMA1)


@query("min_attributes", f"{PROCESSED_SQL} SELECT product_id, ({_PRESENT4}) >= 3 AS three_of_four FROM processed WHERE ({_PRESENT7}) >= 5")
def _(t):
    seven = fi.min_attributes(processed(t), lx.SCHEMA1, 5)
    four = ["style", "primary_material", "color_family", "product_type"]
    return seven.select("product_id", (fi.count_present(four) >= 3).alias("three_of_four"))


_IMAGES = "images AS (SELECT DISTINCT 'img/' || l_partkey || '.jpg' AS image_path, l_partkey AS product_id FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08)"


def images(t):
    """Products that were returned at a high discount stand in for those with an image file."""
    return t.lineitem.filter("l_returnflag = 'R' AND l_discount > 0.08").select(
        F.concat(F.lit("img/"), c("l_partkey").cast("string"), F.lit(".jpg")).alias("image_path"),
        c("l_partkey").alias("product_id")).distinct()


@query("with_image", f"{PRODUCTS}, {_IMAGES} SELECT product_id FROM v_products WHERE 'img/' || product_id || '.jpg' IN (SELECT image_path FROM images)")
def _(t):
    df = t.wide.v_products.withColumn("image_path", F.concat(F.lit("img/"), c("product_id").cast("string"), F.lit(".jpg")))
    return fi.with_image(df, images(t)).select("product_id")


@query("with_image_counts", f"{PRODUCTS}, {_IMAGES} SELECT count(*) FILTER ('img/' || product_id || '.jpg' IN (SELECT image_path FROM images)) AS kept, count(*) AS total FROM v_products")
def _(t):
    df = t.wide.v_products.withColumn("image_path", F.concat(F.lit("img/"), c("product_id").cast("string"), F.lit(".jpg")))
    return fi.kept_counts(df, images(t))


_JUNK = k.inlist(lx.JUNK_LEVEL1)


@query("valid_taxonomy", f"""{RICH} SELECT product_id, taxonomy_depth::INT AS depth FROM rich WHERE taxonomy_depth > 0
  AND NOT contains(split_part(taxonomy_full, ' / ', 1), 'Browse By Brand') AND split_part(taxonomy_full, ' / ', 1) NOT IN {_JUNK}""")
def _(t):
    return fi.valid_taxonomy(rich_products(t)).select("product_id", c("taxonomy_depth").alias("depth"))


@query("nan_to_null", """SELECT p_partkey, nullif(CASE WHEN p_size % 7 = 0 THEN 'nan' ELSE p_name END, 'nan') AS name,
  CASE WHEN p_size % 5 <> 0 THEN p_retailprice END AS price FROM part""")
def _(t):
    raw = t.part.select("p_partkey", F.when(c("p_size") % 7 == 0, "nan").otherwise(c("p_name")).alias("name"),
                        F.when(c("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(c("p_retailprice")).alias("price"))
    return fi.nan_to_null(raw)


@query("pad_attributes", """SELECT p_partkey AS product_id, """ + ", ".join(
    f"{e} AS {a}" for a, e in zip(lx.SCHEMA1, ["p_brand", "NULL::VARCHAR", "NULL::VARCHAR", "split_part(p_name, ' ', 1)", "NULL::VARCHAR", "NULL::VARCHAR", "NULL::VARCHAR"]))
    + " FROM part")
def _(t):
    js = F.to_json(F.struct(c("p_brand").alias("style"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("color_family"),
                            c("p_type").alias("other_key")))
    return t.part.select(c("p_partkey").alias("product_id"), fi.pad_attributes(js).alias("a")).select("product_id", "a.*")


_TRAIN = """concat_ws(chr(10), 'Product: ' || coalesce(product_name, 'Unknown'), 'Category: ' || product_class, 'Description: ' || substr(product_description, 1, 500))"""


@query("training_example", f"{PROCESSED_SQL} SELECT product_id, {_TRAIN} AS input_text, style, color_family FROM processed")
def _(t):
    ex = fi.training_examples(processed(t))
    return ex.select("product_id", "input_text", F.get_json_object("target_attributes", "$.style").alias("style"),
                     F.get_json_object("target_attributes", "$.color_family").alias("color_family"))


def _long_desc(t):
    return t.wide.v_products.join(t.wide.documents.select(c("doc_id").alias("product_id"), c("text").alias("long_text")), "product_id", "left")


_LONG = "FROM v_products LEFT JOIN documents ON doc_id = product_id"
_D = k.strip("text")


@query("classifier_text", f"""{PRODUCTS} SELECT product_id, concat_ws(' [SEP] ', {k.strip('product_name')}, nullif({k.strip("coalesce(product_class, '')")}, ''),
  CASE WHEN {_D} <> '' THEN CASE WHEN length({_D}) > 200 THEN regexp_replace(substr({_D}, 1, 200), ' [^ ]*$', '') || '...' ELSE {_D} END END) AS text {_LONG}""")
def _(t):
    return _long_desc(t).select("product_id", tx.classifier_text(c("product_name"), c("product_class"), c("long_text")).alias("text"))


SEARCH_TEXT = "concat_ws(' | ', nullif(product_name, ''), nullif(product_class, ''), nullif(product_description, ''))"


@query("search_text", f"{PRODUCTS} SELECT product_id, {SEARCH_TEXT} AS text FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", tx.search_text(c("product_name"), c("product_class"), c("product_description")).alias("text"))


@query("encoder_text", f"""{PRODUCTS} SELECT product_id, concat_ws(' ', '[TITLE] ' || nullif(product_name, ''), '[CLASS] ' || nullif(product_class, ''),
  '[DESC] ' || nullif(substr(text, 1, 300), '')) AS tagged, concat_ws(' [SEP] ', product_name, product_class, substr(nullif(text, ''), 1, 300)) AS separated {_LONG}""")
def _(t):
    return _long_desc(t).select(
        "product_id", tx.encoder_text(c("product_name"), c("product_class"), c("long_text")).alias("tagged"),
        tx.encoder_text_sep(c("product_name"), c("product_class"), c("long_text")).alias("separated"))


_FIELDS = ["level_1", "level_2", "level_3", "primary_color", "style", "assembly"]
_LINE = "CASE field " + " ".join(f"WHEN {k.q(f)} THEN {k.q(l)}" for f, l in lx.PROMPT_FIELDS.items()) + " END"


@query("prompt_column", f"""{with_views('v_heads', 'v_products')}, w AS (SELECT product_id, string_agg({_LINE}, chr(10) ORDER BY i) AS lines FROM v_heads WHERE confidence < 0.5 GROUP BY 1)
SELECT p.product_id, concat_ws(chr(10), {k.q(lx.PROMPT_HEAD)}, lines, chr(10) || 'Product text: ' || p.product_name, {k.q(lx.PROMPT_TAIL)}) AS prompt
FROM v_products p JOIN w USING (product_id)""")
def _(t):
    fields = t.v_heads.filter(c("confidence") < 0.5).groupBy("product_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", "field"))), lambda f: f["field"]).alias("fields"))  # at most 6 per product
    return t.wide.v_products.join(fields, "product_id").select(
        "product_id", tx.prompt_for_fields(c("fields"), c("product_name")).alias("prompt"))


@query("extraction_prompt", f"""{PRODUCTS} SELECT product_id, CASE WHEN product_id % 2 = 0 THEN {k.q(lx.IMAGE_PROMPT[0])} || product_name || {k.q(lx.IMAGE_PROMPT[1])}
 ELSE {k.q(lx.TEXT_PROMPT[0])} || product_name || {k.q(lx.TEXT_PROMPT[1])} END AS prompt FROM v_products""")
def _(t):
    return t.wide.v_products.select("product_id", tx.extraction_prompt(c("product_name"), c("product_id") % 2 == 0).alias("prompt"))


def _v1(t):
    return A.extract_attributes_v1(t.wide.v_products).select("product_id", *lx.SCHEMA1)


V1_CTE = f"{PRODUCTS}, x AS (SELECT *, lower(concat_ws(' ', product_name, product_description, product_class)) AS t FROM v_products), v1 AS ({v1_sql('t', 'x')})"
_FEATURE_ATTRS = PROCESSED_SQL.replace(PRODUCTS, V1_CTE, 1)


@query("hybrid_merge", f"""{_FEATURE_ATTRS} SELECT a.product_id, coalesce(a.style, v1.style) AS style, coalesce(a.primary_material, v1.primary_material) AS primary_material,
  coalesce(a.color_family, v1.color_family) AS color_family, coalesce(a.product_type, v1.product_type) AS product_type,
  v1.secondary_material, v1.room_type, v1.assembly_required FROM processed a LEFT JOIN v1 USING (product_id)""")
def _(t):
    visual = processed(t).select("product_id", *lx.SCHEMA1)
    return flat(fi.hybrid_merge(visual, _v1(t)))


@query("compare_extractions", f"""{_FEATURE_ATTRS}, ids AS (SELECT product_id FROM v_products), l AS (
 """ + " UNION ALL ".join(f"SELECT ids.product_id, '{a}' AS attribute, a.{a} AS features, v1.{a} AS keywords FROM ids LEFT JOIN processed a USING (product_id) LEFT JOIN v1 USING (product_id)"
                          for a in ["style", "primary_material", "color_family", "product_type"]) + """) SELECT * FROM l""")
def _(t):
    cols = ["product_id", "style", "primary_material", "color_family", "product_type"]
    return fi.compare_extractions({"features": processed(t).select(*cols), "keywords": _v1(t).select(*cols)})


@query("image_metadata", f"""{PROCESSED_SQL}, {_IMAGES} SELECT product_id, 'img/' || product_id || '.jpg' AS image_path, style, room_type,
  CASE WHEN image_path IS NOT NULL THEN 'shop' END AS source, CASE WHEN image_path IS NULL THEN 'no_results' ELSE 'success' END AS status
FROM processed LEFT JOIN images USING (product_id)""")
def _(t):
    found = images(t).select("product_id", c("image_path").alias("url"))
    df = processed(t).join(found, "product_id", "left").withColumns({
        "image_path": F.concat(F.lit("img/"), c("product_id").cast("string"), F.lit(".jpg")), "search_query": c("product_name"),
        "status": F.when(c("url").isNull(), "no_results").otherwise("success"), "photographer": F.lit(None).cast("string"),
        "source": F.lit("shop"), "source_id": c("product_id").cast("string"), "license": F.lit("free")})
    return fi.image_metadata(df).select("product_id", "image_path", c("ground_truth.style").alias("style"),
                                        F.array_join("ground_truth.room_type", "|").alias("room_type"),
                                        c("image_source.source").alias("source"), "status")


@query("split_input_text", f"""{PROCESSED_SQL} SELECT product_id, replace(split_part({_TRAIN}, chr(10), 1), 'Product: ', '') AS product_name,
  CASE WHEN contains({_TRAIN}, chr(10)) THEN substr({_TRAIN}, instr({_TRAIN}, chr(10)) + 1) ELSE '' END AS product_description FROM processed""")
def _(t):
    ex = fi.training_examples(processed(t))
    return ex.select("product_id", tx.split_input_text(c("input_text")).alias("s")).select("product_id", "s.*")


@query("domain_of", f"""SELECT page_id, regexp_replace(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1), '^www\\.', '') AS domain,
  {k.any_of("regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.\\-]*:)?//([^/?#]*)', 1)", ["example.net", "shop."])} AS blocked FROM pages""")
def _(t):
    return t.wide.pages.select("page_id", tx.domain_of(c("url")).alias("domain"), tx.is_blocked(c("url"), ["example.net", "shop."]).alias("blocked"))


# --- profiles --------------------------------------------------------------------------------
_UNPIVOT4 = " UNION ALL ".join(f"SELECT '{a}' AS attribute, {a} AS value FROM processed WHERE {a} IS NOT NULL"
                               for a in ["style", "primary_material", "color_family", "room_type"])


@query("value_distribution", f"""{PROCESSED_SQL}, l AS ({_UNPIVOT4}), g AS (SELECT attribute, value, count(*) AS n FROM l GROUP BY ALL),
 r AS (SELECT *, row_number() OVER (PARTITION BY attribute ORDER BY n DESC, value)::INT AS rnk, (sum(n) OVER (PARTITION BY attribute))::BIGINT AS total,
   count(*) OVER (PARTITION BY attribute) AS n_unique FROM g) SELECT *, round(100.0::DOUBLE * n / total, 4) AS pct FROM r WHERE rnk <= 3""")
def _(t):
    return pr.value_distribution(processed(t), ["style", "primary_material", "color_family", "room_type"], 3)


@query("dataset_summary", f"""{with_views('v_products', 'v_queries', 'v_labels')} SELECT 'num_products' AS metric, count(*) AS value FROM v_products
UNION ALL SELECT 'products_with_features', count(product_features) FROM v_products
UNION ALL SELECT 'num_product_classes', count(DISTINCT product_class) FROM v_products UNION ALL SELECT 'num_queries', count(*) FROM v_queries
UNION ALL SELECT 'num_labels', count(*) FROM v_labels UNION ALL SELECT 'label_' || label, count(*) FROM v_labels GROUP BY label""")
def _(t):
    return pr.dataset_summary(t.wide.v_products, t.v_queries, t.v_labels)


@query("product_classes", f"{PRODUCTS} SELECT DISTINCT product_class FROM v_products WHERE product_class IS NOT NULL")
def _(t):
    return pr.product_classes(t.wide.v_products)


_SIZES = f"{PRODUCTS}, s AS (SELECT coalesce(product_class, 'unknown') AS class, count(*) AS n FROM v_products GROUP BY 1)"


@query("category_size_buckets", f"""{_SIZES} SELECT CASE WHEN n < 5 THEN 'tiny' WHEN n < 20 THEN 'small' WHEN n < 100 THEN 'medium' ELSE 'large' END AS bucket,
  count(*) AS classes, sum(n)::BIGINT AS products FROM s GROUP BY 1""")
def _(t):
    return pr.category_sizes(t.wide.v_products)[0]


@query("category_extremes", f"""{_SIZES} SELECT * FROM (SELECT class, n, 'top' AS side FROM s ORDER BY n DESC, class LIMIT 20)
UNION ALL SELECT * FROM (SELECT class, n, 'bottom' AS side FROM s ORDER BY n, class DESC LIMIT 20)""")
def _(t):
    return pr.category_sizes(t.wide.v_products)[1]


@query("taxonomy_depths", f"""{RICH}, g AS (SELECT taxonomy_depth::INT AS depth, count(*) AS n FROM rich GROUP BY 1)
SELECT depth, n, round(100.0::DOUBLE * n / sum(n) OVER (), 4) AS pct FROM g""")
def _(t):
    return pr.taxonomy_profile(rich_products(t))[0]


@query("taxonomy_levels", f"""{RICH}, u AS (SELECT DISTINCT unnest(range(1, taxonomy_depth + 1)) AS level, unnest(string_split(taxonomy_full, ' / ')) AS name FROM rich WHERE taxonomy_depth > 0)
SELECT level::INT AS level, count(*) AS names FROM u GROUP BY 1""")
def _(t):
    return pr.taxonomy_profile(rich_products(t))[1]


_LOW = f"list_transform({k.entries('product_features')}, lambda e: {{'k': lower(e.k), 'v': lower(e.v)}})"
_FEATS = f"""{PRODUCTS}, fx AS (SELECT product_id, product_class, unnest({k.last_wins(_LOW)}) AS e FROM v_products), f AS (SELECT product_id, product_class, e.k AS k, e.v AS v FROM fx)"""


@query("feature_key_presence", f"""{_FEATS} SELECT k AS key, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM v_products), 4) AS pct,
  k IN {k.inlist(lx.TARGET_KEYS)} AS is_target FROM f GROUP BY k""")
def _(t):
    return pr.feature_key_presence(t.wide.v_products)


def _chosen(targets, exact: bool) -> str:
    order = "k <> target, k" if exact else "k"
    return (f"chosen AS (SELECT target, k AS key FROM (SELECT target, k, row_number() OVER (PARTITION BY target ORDER BY {order}) AS r "
            f"FROM (SELECT DISTINCT k FROM f) a JOIN (SELECT unnest({k.lst(targets)}) AS target) b ON contains(k, target)) WHERE r = 1)")


@query("feature_value_profile", f"""{_FEATS}, {_chosen(lx.TARGET_KEYS, True)}, g AS (SELECT k, v, count(*) AS n FROM f WHERE k IN (SELECT key FROM chosen) GROUP BY ALL),
 r AS (SELECT k AS key, v AS value, n, row_number() OVER (PARTITION BY k ORDER BY n DESC, v)::INT AS rnk, (sum(n) OVER (PARTITION BY k))::BIGINT AS total,
  count(*) OVER (PARTITION BY k) AS n_unique, (sum((n < 5)::INT) OVER (PARTITION BY k))::BIGINT AS rare FROM g)
SELECT *, round(100.0::DOUBLE * n / total, 4) AS pct FROM r WHERE rnk <= 15""")
def _(t):
    return pr.feature_value_profile(t.wide.v_products)


@query("sampling_plan", f"""{_SIZES}, x AS (SELECT cap::INT AS cap, least(n, cap) AS s FROM s, (SELECT unnest([5, 10, 15, 25, 50]) AS cap))
SELECT cap, sum(s)::BIGINT AS sampled, count(*) AS classes, sum((s >= 10)::INT)::BIGINT AS well_covered,
  sum((s >= 3 AND s < 10)::INT)::BIGINT AS partly_covered, sum((s < 3)::INT)::BIGINT AS barely_covered FROM x GROUP BY cap""")
def _(t):
    return pr.sampling_plan(t.wide.v_products)


@query("coverage_by_class", f"""{_FEATS}, {_chosen(lx.COVERAGE_TARGETS, False)}, s AS (SELECT product_class, count(*) AS n FROM v_products GROUP BY 1 ORDER BY n DESC, product_class LIMIT 30),
 h AS (SELECT product_class, target, count(*) AS h FROM f JOIN chosen ON f.k = chosen.key GROUP BY ALL)
SELECT s.product_class, s.n, """ + ", ".join(
    f"round(100.0::DOUBLE * coalesce(max(h) FILTER (target = '{a}'), 0) / s.n, 4) AS {a}" for a in lx.COVERAGE_TARGETS)
    + " FROM s LEFT JOIN h USING (product_class) GROUP BY s.product_class, s.n")
def _(t):
    return pr.coverage_by_class(t.wide.v_products)


@query("feature_count_stats", f"""{PRODUCTS}, x AS (SELECT len(string_split(product_features, '|'))::INT AS features FROM v_products WHERE product_features IS NOT NULL)
SELECT features, count(*) AS n, (SELECT quantile_cont(features, 0.5) FROM x)::DOUBLE AS median, (SELECT round(avg(features), 4) FROM x) AS mean FROM x GROUP BY 1""")
def _(t):
    return pr.feature_count_stats(t.wide.v_products)


_RICHNESS = " + ".join(f"CASE WHEN {a} IS NOT NULL THEN {w} ELSE 0 END" for a, w in lx.RICHNESS.items()) + " + CASE WHEN taxonomy_depth >= 4 THEN 1 ELSE 0 END"
SCORED = f"{V2_STAGES}, scored AS (SELECT *, ({_RICHNESS})::DOUBLE AS attr_score FROM v2)"


def scored(t):
    v2 = A.extract_attributes_v2(rich_products(t))
    return v2.withColumn("attr_score", pr.richness_score(v2))


@query("richness_score", f"{SCORED} SELECT product_id, attr_score FROM scored")
def _(t):
    return scored(t).select("product_id", "attr_score")


@query("material_check", f"""{SCORED}, ch AS (SELECT *, primary_material IN {k.inlist(lx.WOODLIKE)} AS w, primary_material IN {k.inlist(lx.FABRICLIKE)} AS s FROM scored WHERE contains(lower(product_name), 'chair'))
SELECT count(*) AS chairs, count(*) FILTER (w) AS wood, count(*) FILTER (s) AS soft, round(100.0::DOUBLE * count(*) FILTER (w) / greatest(count(*), 1), 4) AS wood_pct,
  round(100.0::DOUBLE * count(*) FILTER (s) / greatest(count(*), 1), 4) AS soft_pct FROM ch""")
def _(t):
    return pr.material_check(scored(t))


# --- selection -----------------------------------------------------------------------------------
_QUEUE = f"""{SCORED}, cl AS (SELECT *, coalesce(trim(split_part(product_class, '|', 1)), 'Unknown') AS class_clean FROM scored WHERE taxonomy_depth > 0
   AND NOT contains(split_part(taxonomy_full, ' / ', 1), 'Browse By Brand') AND split_part(taxonomy_full, ' / ', 1) NOT IN {_JUNK}),
 q0 AS (SELECT *, count(*) OVER (PARTITION BY class_clean) AS class_size, row_number() OVER (PARTITION BY class_clean ORDER BY attr_score DESC, product_id) AS class_rank FROM cl),
 q1 AS (SELECT *, CASE WHEN class_size >= 100 THEN 'large' WHEN class_size >= 20 THEN 'medium' WHEN class_size >= 5 THEN 'small' ELSE 'tiny' END AS tier,
   CASE WHEN class_size >= 100 THEN 30 WHEN class_size >= 20 THEN 50 ELSE 999 END AS cap FROM q0),
 queue AS (SELECT * FROM q1 WHERE class_rank <= cap)"""


def queue(t):
    """Balanced queue of valid products; their attributes are extracted once."""
    return rk.balanced_queue(written(fi.valid_taxonomy(scored(t)), "scored"))


@query("balanced_queue", f"{_QUEUE} SELECT product_id, class_clean, class_size, class_rank::INT AS class_rank, tier, attr_score FROM queue")
def _(t):
    return queue(t).select("product_id", "class_clean", "class_size", "class_rank", "tier", "attr_score")


@query("topk_per_query", f"""{with_views('v_results')}, s AS (SELECT query_id, product_id, (product_id * 7919 % 1000) / 1000.0::DOUBLE AS score FROM v_results),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, product_id)::INT AS rnk FROM s) SELECT * FROM r WHERE rnk <= 5""")
def _(t):
    s = t.v_results.select("query_id", "product_id", (c("product_id") * 7919 % 1000 / 1000.0).alias("score"))
    return rk.topk_per_key(s, ["query_id"], [c("score").desc(), c("product_id").asc()], 5)


@query("final_rank", f"""{with_views('v_results')}, s AS (SELECT query_id, product_id, rnk::INT AS rnk, (product_id % 5)::DOUBLE AS ce_score FROM v_results)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ce_score DESC, rnk)::INT AS final_rank FROM s""")
def _(t):
    s = t.v_results.withColumn("ce_score", (c("product_id") % 5).cast("double"))
    return rk.final_rank(s, "query_id", "ce_score", "rnk")


@query("first_relevant", f"""{with_views('v_results')}, s AS (SELECT query_id, product_id % 3 AS relevance, rnk FROM v_results)
SELECT query_id, min(rnk) FILTER (relevance >= 2)::INT AS first_relevant FROM s GROUP BY 1""")
def _(t):
    s = t.v_results.withColumn("relevance", c("product_id") % 3)
    return rk.first_relevant(s, "query_id", "rnk", "relevance", 2)


@query("sort_by_score", f"{SCORED} SELECT product_id, attr_score FROM scored ORDER BY attr_score DESC, product_id LIMIT 100")
def _(t):
    return rk.sort_by_score(scored(t).select("product_id", "attr_score"), "attr_score", "product_id", 100)


@query("latest_per_key", "SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(t):
    return rk.latest_per_key(t.events.select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


_FILES = """files AS (SELECT l_partkey AS product_id, 'images/' || l_partkey || '/' || CASE l_linenumber % 3 WHEN 0 THEN 'hero' WHEN 1 THEN 'material_crop' ELSE 'extra' END
  || '.' || CASE l_suppkey % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' ELSE 'gif' END AS path FROM lineitem GROUP BY ALL)"""


@query("pick_hero_image", f"""WITH {_FILES}, r AS (SELECT *, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS role, list_position(['jpg', 'png', 'webp'], regexp_extract(path, '\\.([^./]+)$', 1)) AS o FROM files),
 g AS (SELECT product_id, count(*) AS n, arg_min(path, o) FILTER (role = 'hero' AND o > 0) AS hero, arg_min(path, o) FILTER (role = 'material_crop' AND o > 0) AS crop FROM r GROUP BY 1)
SELECT p_partkey AS product_id, hero, crop AS material_crop, coalesce(n, 0) AS image_count, hero IS NOT NULL AS has_image FROM part LEFT JOIN g ON product_id = p_partkey""")
def _(t):
    role = F.when(c("l_linenumber") % 3 == 0, "hero").when(c("l_linenumber") % 3 == 1, "material_crop").otherwise("extra")
    ext = F.element_at(F.lit(["jpg", "png", "webp", "gif"]), (c("l_suppkey") % 4 + 1).cast("int"))
    files = t.lineitem.select(c("l_partkey").alias("product_id"), F.concat(
        F.lit("images/"), c("l_partkey").cast("string"), F.lit("/"), role, F.lit("."), ext).alias("path")).distinct()
    return rk.pick_hero_image(t.part.select(c("p_partkey").alias("product_id")), files).select(
        "product_id", "hero", "material_crop", "image_count", "has_image")


# --- taxonomy --------------------------------------------------------------------------------------
_TAXP = f"""{V2_STAGES}, tx AS (SELECT v2.*, string_split(taxonomy_full, ' / ') AS path FROM v2 WHERE taxonomy_depth > 0 AND coalesce(product_class, '') <> ''),
 px AS (SELECT tx.*, d AS depth, array_to_string(path[1:d], '/') AS prefix FROM tx, LATERAL (SELECT unnest(range(1, len(path) + 1)) AS d)),
 lookup AS (SELECT prefix AS path, depth::INT AS depth, product_class, sum((depth = len(path))::INT)::BIGINT AS full_rows, count(*) AS n FROM px GROUP BY prefix, depth, product_class)"""


def lookup(t):
    return ta.build_lookup(rich_products(t))


def extracted(t):
    """Schema-2 attributes of the catalog, extracted once for queries that read them several times."""
    return written(A.extract_attributes_v2(rich_products(t)), "extracted")


@query("build_lookup", f"{_TAXP} SELECT * FROM lookup")
def _(t):
    return lookup(t)


@query("lookup_stats", f"""{_TAXP}, f AS (SELECT path, count(*) AS c FROM lookup WHERE full_rows > 0 GROUP BY 1)
SELECT count(*) AS n_paths, sum((c > 1)::INT)::BIGINT AS n_ambiguous, (SELECT count(DISTINCT product_class) FROM lookup WHERE full_rows > 0) AS n_classes FROM f""")
def _(t):
    return ta.lookup_stats(lookup(t))


# predicted paths: the true path with its last level changed for some products
_PRED = f"""{_TAXP}, pred AS (SELECT product_id, primary_color, primary_material, style, CASE WHEN product_id % 4 = 0 THEN path || ['Unseen'] WHEN product_id % 9 = 0 THEN ['Elsewhere'] WHEN product_id % 7 = 0 THEN path[1:1] ELSE path END AS taxonomy FROM tx)"""


def predicted_paths(t):
    v2 = extracted(t).filter((F.size("taxonomy") > 0) & (c("product_class") != ""))
    return v2.withColumn("taxonomy", F.when(c("product_id") % 4 == 0, F.concat("taxonomy", F.array(F.lit("Unseen"))))
                         .when(c("product_id") % 9 == 0, F.array(F.lit("Elsewhere")))
                         .when(c("product_id") % 7 == 0, F.slice("taxonomy", 1, 1)).otherwise(c("taxonomy")))


@query("resolve_class", f"""{_PRED}, cand AS (SELECT p.product_id, l.depth, l.depth = len(p.taxonomy) AS exact, l.product_class,
   CASE WHEN coalesce(primary_color, '') <> '' AND contains(lower(l.product_class), lower(primary_color)) THEN 3 ELSE 0 END
   + CASE WHEN coalesce(primary_material, '') <> '' AND contains(lower(l.product_class), lower(primary_material)) THEN 2 ELSE 0 END
   + CASE WHEN coalesce(style, '') <> '' AND contains(lower(l.product_class), lower(style)) THEN 1 ELSE 0 END AS score
  FROM pred p JOIN lookup l ON array_to_string(p.taxonomy[1:l.depth], '/') = l.path AND l.depth <= len(p.taxonomy) AND (l.depth < len(p.taxonomy) OR l.full_rows > 0)),
 best AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY depth DESC, score DESC, product_class) AS r FROM cand)
SELECT pred.product_id, best.product_class, CASE WHEN best.product_id IS NULL THEN 'fallback' WHEN exact THEN 'exact' ELSE 'partial' END AS class_match, coalesce(depth, 0)::INT AS matched_depth
FROM pred LEFT JOIN (SELECT * FROM best WHERE r = 1) best USING (product_id)""")
def _(t):
    return ta.resolve_class(predicted_paths(t), lookup(t))


@query("valid_classes", f"""{_PRED} SELECT DISTINCT array_to_string(p.taxonomy, '/') AS path, l.product_class FROM (SELECT DISTINCT taxonomy FROM pred) p
JOIN lookup l ON l.depth <= len(p.taxonomy) AND array_to_string(p.taxonomy[1:l.depth], '/') = l.path""")
def _(t):
    return ta.valid_classes(predicted_paths(t), lookup(t))


_VOCAB = f"""{V2_STAGES}, items AS (""" + " UNION ALL ".join(f"SELECT '{a}' AS kind, {a} AS value FROM v2" for a in lx.SCHEMA2) + """
 UNION ALL SELECT 'product_class', product_class FROM v2 UNION ALL SELECT 'path', nullif(taxonomy_full, '') FROM v2
 UNION ALL SELECT 'level_' || unnest(range(1, taxonomy_depth + 1)), unnest(string_split(taxonomy_full, ' / ')) FROM v2 WHERE taxonomy_depth > 0),
 vocab AS (SELECT kind, value, count(*) AS n, row_number() OVER (PARTITION BY kind ORDER BY value) AS idx FROM items WHERE value IS NOT NULL GROUP BY kind, value)"""


def vocab(t, source=None):
    return ta.build_vocab(extracted(t) if source is None else source, lx.SCHEMA2)


@query("build_vocab", f"{_VOCAB} SELECT * FROM vocab")
def _(t):
    return vocab(t)


@query("encode_labels", f"""{_VOCAB}, tr AS (SELECT kind, value, idx FROM vocab WHERE n >= 40), want AS (""" + " UNION ALL ".join(
    [f"SELECT product_id, '{a}' AS kind, {a} AS value FROM v2" for a in lx.SCHEMA2]
    + [f"SELECT product_id, 'level_{i}', CASE WHEN taxonomy_depth >= {i} THEN split_part(taxonomy_full, ' / ', {i}) END FROM v2" for i in range(1, 5)])
    + """) SELECT product_id, kind, CASE WHEN value IS NULL THEN -1 ELSE coalesce(idx, 0) END::INT AS idx FROM want LEFT JOIN tr USING (kind, value)""")
def _(t):
    # only values seen at least 40 times are known, the others encode as unknown
    source = extracted(t)
    return ta.encode_labels(source, vocab(t, source).filter(c("n") >= 40), lx.SCHEMA2)


@query("vocab_drift", f"""{_VOCAB}, d AS (SELECT 'style' AS kind, unnest({k.lst(list(lx.STYLE_GROUPS))}) AS value UNION ALL SELECT 'primary_color', unnest({k.lst(list(lx.COLOR_FAMILIES))})),
 v AS (SELECT kind, value FROM vocab WHERE kind IN ('style', 'primary_color'))
SELECT *, 'default' AS only_in FROM (SELECT * FROM d EXCEPT ALL SELECT * FROM v) UNION ALL SELECT *, 'data' FROM (SELECT * FROM v EXCEPT ALL SELECT * FROM d)""")
def _(t):
    # the values decide, their numbers are not needed; stored, since both directions read them
    return ta.vocab_drift(written(ta.vocab_values(extracted(t), lx.SCHEMA2), "vocab"), {"style": list(lx.STYLE_GROUPS), "primary_color": list(lx.COLOR_FAMILIES)})


# --- sampling -----------------------------------------------------------------------------------------
def _split_sql(src: str, strata: str, ident: str, train: float, both: float, seed: int = 42) -> str:
    part = f"PARTITION BY {strata} " if strata else ""
    return (f"SELECT *, CASE WHEN r <= floor(n * {train}::DOUBLE) THEN 'train' WHEN r <= floor(n * {both}::DOUBLE) THEN 'val' ELSE 'test' END AS split "
            f"FROM (SELECT *, row_number() OVER ({part}ORDER BY md5('{seed}:' || {ident}), {ident}) AS r, count(*) OVER ({part}) AS n FROM {src})")


@query("stratified_split", f"{PRODUCTS}, x AS ({_split_sql('v_products', 'product_class', 'product_id', 0.8, 0.9)}) SELECT product_id, product_class, split FROM x")
def _(t):
    return sa.stratified_split(t.wide.v_products.select("product_id", "product_class"), ["product_class"])


QSPLIT = f"{with_views('v_labels', 'v_queries', 'v_products')}, qs AS ({_split_sql('(SELECT DISTINCT query_id FROM v_labels)', '', 'query_id', 0.7, 0.85)})"


@query("query_split", f"{QSPLIT} SELECT query_id, split FROM qs")
def _(t):
    return sa.query_split(t.v_labels)


@query("sample_n", f"{PRODUCTS} SELECT product_id, product_name FROM v_products ORDER BY md5('7:' || product_id), product_id LIMIT 150")
def _(t):
    return sa.sample_n(t.wide.v_products.select("product_id", "product_name"), 150, seed=7)


@query("holdout", f"""{PRODUCTS} SELECT product_id, row_number() OVER (ORDER BY md5('42:' || product_id), product_id) <= floor(count(*) OVER () * 0.1::DOUBLE) AS is_val FROM v_products""")
def _(t):
    return sa.holdout(t.wide.v_products.select("product_id"))


def _neg_sql(src: str) -> str:
    return f"""neg AS (SELECT query_id, product_id, row_number() OVER (PARTITION BY query_id ORDER BY md5('42:' || query_id || ':' || product_id), query_id, product_id) AS i,
   count(*) OVER (PARTITION BY query_id) AS n FROM {src} WHERE label = 'Irrelevant'),
 pos AS (SELECT p.query_id, p.product_id, {k.draw(42, 'neg', "(p.query_id || ':' || p.product_id)")} % s.n + 1 AS i FROM {src} p JOIN (SELECT DISTINCT query_id, n FROM neg) s USING (query_id) WHERE label <> 'Irrelevant'),
 drawn AS (SELECT pos.query_id, pos.product_id AS pos_product_id, neg.product_id AS neg_product_id FROM pos JOIN neg USING (query_id, i))"""


@query("sample_negatives", f"{with_views('v_labels')}, {_neg_sql('v_labels')} SELECT * FROM drawn")
def _(t):
    return sa.sample_negatives(t.kept("v_labels"), t.wide.v_products)


@query("search_triplets", f"""{QSPLIT}, lt AS (SELECT l.* FROM v_labels l JOIN qs USING (query_id) WHERE split = 'train'), {_neg_sql('lt')}, tx AS (SELECT product_id, {SEARCH_TEXT} AS text FROM v_products)
SELECT q.query, a.text AS positive, b.text AS negative, d.query_id, d.pos_product_id, d.neg_product_id FROM drawn d JOIN v_queries q USING (query_id)
JOIN tx a ON a.product_id = d.pos_product_id JOIN tx b ON b.product_id = d.neg_product_id""")
def _(t):
    return sa.search_datasets(t.kept("v_labels"), t.v_queries, t.wide.v_products)["triplets"]


_PAIRS = f"tx AS (SELECT product_id, product_name, {SEARCH_TEXT} AS product_text FROM v_products)"


@query("search_pairs", f"""{QSPLIT}, {_PAIRS} SELECT l.query_id, l.product_id, query, product_text, CASE label WHEN 'Exact' THEN 1.0::DOUBLE WHEN 'Partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, label
FROM v_labels l JOIN qs ON qs.query_id = l.query_id AND split = 'val' JOIN v_queries q ON q.query_id = l.query_id JOIN tx ON tx.product_id = l.product_id""")
def _(t):
    return sa.search_datasets(t.kept("v_labels"), t.v_queries, t.wide.v_products)["pairs_val"]


@query("search_test_pairs", f"""{QSPLIT}, {_PAIRS} SELECT l.query_id, l.product_id, query, coalesce(product_text, '') AS product_text, coalesce(product_name, '') AS product_name,
 CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END AS relevance, label
FROM v_labels l JOIN qs ON qs.query_id = l.query_id AND split = 'test' JOIN v_queries q ON q.query_id = l.query_id LEFT JOIN tx ON tx.product_id = l.product_id""")
def _(t):
    return sa.search_datasets(t.kept("v_labels"), t.v_queries, t.wide.v_products)["test"]


_RATES = {"Exact": 2.5, "Partial": 1.0, "Irrelevant": 0.3}


@query("balance_labels", f"""{with_views('v_labels')}, r AS (SELECT *, CASE label WHEN 'Exact' THEN 2.5::DOUBLE WHEN 'Partial' THEN 1.0::DOUBLE ELSE 0.3::DOUBLE END AS rate FROM v_labels),
 n AS (SELECT *, (floor(rate) + ({k.uniform(42, 'rate', "(query_id || ':' || product_id)")} < rate - floor(rate))::INT)::INT AS n FROM r)
SELECT query_id, product_id, label, unnest(range(1, n + 1))::INT AS copy FROM n WHERE n > 0""")
def _(t):
    return sa.balance_labels(t.v_labels, _RATES)


# repeated judgements: every shipment of a part is one vote of its supplier
_VOTES = """votes AS (SELECT l_suppkey AS query_id, l_partkey AS product_id, CASE l_linenumber % 3 WHEN 0 THEN 'Exact' WHEN 1 THEN 'Partial' ELSE 'Irrelevant' END AS label FROM lineitem)"""


@query("majority_label", f"""WITH {_VOTES}, g AS (SELECT *, count(*) AS n FROM votes GROUP BY ALL), r AS (SELECT *, (sum(n) OVER (PARTITION BY query_id, product_id))::BIGINT AS votes,
  row_number() OVER (PARTITION BY query_id, product_id ORDER BY n DESC, CASE label WHEN 'Exact' THEN 2 WHEN 'Partial' THEN 1 ELSE 0 END DESC) AS i FROM g)
SELECT query_id, product_id, label, votes FROM r WHERE i = 1""")
def _(t):
    votes = t.lineitem.select(c("l_suppkey").alias("query_id"), c("l_partkey").alias("product_id"),
                              F.when(c("l_linenumber") % 3 == 0, "Exact").when(c("l_linenumber") % 3 == 1, "Partial")
                              .otherwise("Irrelevant").alias("label"))
    return sa.majority_label(votes)


# --- joins ---------------------------------------------------------------------------------------------
@query("relevance_pairs", f"""{with_views('v_labels', 'v_queries', 'v_products')}, {_PAIRS}
SELECT query_id, product_id, query, product_text, CASE label WHEN 'Exact' THEN 1.0::DOUBLE WHEN 'Partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS score, label
FROM v_labels JOIN v_queries USING (query_id) JOIN tx USING (product_id)""")
def _(t):
    return jo.relevance_pairs(t.v_labels, t.v_queries, t.wide.v_products)


@query("attach_images", f"{PRODUCTS}, {_IMAGES} SELECT product_id, image_path, image_path IS NOT NULL AS has_image FROM v_products LEFT JOIN images USING (product_id)")
def _(t):
    return jo.attach_images(t.wide.v_products, images(t)).select("product_id", "image_path", "has_image")


@query("split_card", f"""{PRODUCTS}, {_IMAGES}, x AS ({_split_sql('(SELECT product_id, image_path IS NOT NULL AS has_image FROM v_products LEFT JOIN images USING (product_id))', 'has_image', 'product_id', 0.8, 0.9)})
SELECT split, count(*) AS n_rows, count(*) FILTER (has_image) AS with_images, count(*) FILTER (NOT has_image) AS text_only FROM x GROUP BY 1""")
def _(t):
    from ..operators.upkeep import split_card
    both = jo.attach_images(t.wide.v_products.select("product_id"), images(t))
    with_img = sa.stratified_split(both.filter("has_image"), [])
    text_only = sa.stratified_split(both.filter("NOT has_image"), [])
    return split_card(jo.union_splits(with_img, text_only))


@query("align_predictions", f"""{with_views('v_pairs')} SELECT product_id, pred_style AS prediction, gt_style AS ground_truth FROM v_pairs WHERE pred_style IS NOT NULL AND gt_style IS NOT NULL""")
def _(t):
    pred = t.v_pairs.select("product_id", c("pred_style").alias("prediction"))
    return jo.align_predictions(pred, t.v_pairs.select("product_id", c("gt_style").alias("ground_truth")))


@query("skip_cached", f"""{PRODUCTS}, {_IMAGES} SELECT product_id, product_id IN (SELECT product_id FROM images) AS cached FROM v_products""")
def _(t):
    todo, cached = jo.skip_cached(t.wide.v_products.select("product_id"), images(t).select("product_id"))
    return todo.withColumn("cached", F.lit(False)).unionByName(cached.withColumn("cached", F.lit(True)))


@query("resume_queue", f"""{with_views('v_products', 'v_manifest')} SELECT product_id, false AS retry FROM v_products WHERE product_id NOT IN (SELECT product_id FROM v_manifest WHERE image_count > 0 OR status IN {k.inlist(lx.FAILED_STATUSES)})
UNION ALL SELECT product_id, true FROM v_products WHERE product_id NOT IN (SELECT product_id FROM v_manifest WHERE image_count > 0)""")
def _(t):
    q = t.wide.v_products.select("product_id")
    return jo.resume_queue(q, t.v_manifest).withColumn("retry", F.lit(False)).unionByName(
        jo.resume_queue(q, t.v_manifest, retry_failed=True).withColumn("retry", F.lit(True)))


@query("missing_ids", f"{PRODUCTS}, {_IMAGES} SELECT product_id FROM v_products EXCEPT SELECT product_id FROM images")
def _(t):
    return jo.missing_ids(t.wide.v_products, images(t))


_PLAIN = "regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')"


@query("keyword_join", f"""WITH names AS (SELECT DISTINCT p_name AS label FROM part), kw AS (SELECT DISTINCT trim({_PLAIN.format('keyword')}) AS kw, label
  FROM (SELECT label, unnest([label] || string_split(label, ' ')) AS keyword FROM names)), d AS (SELECT doc_id, {_PLAIN.format('text')} AS t FROM documents),
 h AS (SELECT doc_id, label, kw FROM d JOIN kw ON contains(t, kw))
SELECT doc_id, label, first(kw ORDER BY length(kw) DESC, kw) AS keyword, count(*) AS n_keywords FROM h GROUP BY 1, 2""")
def _(t):
    # vocabulary: the product names of the catalog and their single words, labelled by name
    names = t.part.select(c("p_name").alias("label")).distinct()
    vocabulary = names.select("label", F.explode(F.concat(F.array("label"), F.split("label", " "))).alias("keyword"))
    return jo.keyword_join(t.wide.documents, vocabulary, "doc_id", "text")


@query("attach_descriptions", f"{PRODUCTS} SELECT product_id, substr(coalesce(text, ''), 1, 400) AS description FROM v_products LEFT JOIN documents ON doc_id = product_id")
def _(t):
    d = t.wide.documents.select(c("doc_id").alias("product_id"), c("text").alias("product_description"))
    return jo.attach_descriptions(t.wide.v_products.select("product_id"), d)


@query("union_splits", f"""{PRODUCTS}, {_IMAGES} SELECT product_id, image_path FROM v_products LEFT JOIN images USING (product_id)""")
def _(t):
    both = jo.attach_images(t.wide.v_products.select("product_id"), images(t))
    return jo.union_splits(both.filter("has_image").select("product_id", "image_path"), both.filter("NOT has_image").select("product_id")).select("product_id", "image_path")


@query("term_overlap", f"""{PRODUCTS}, w AS (SELECT product_id, list_filter(string_split(lower(product_name), ' '), lambda x: x <> '') AS w FROM v_products)
SELECT product_id, array_to_string(list_filter(w, lambda x: x IN {k.inlist(lx.COLOR_TERMS)}), '|') AS shared, array_to_string(list_filter(w, lambda x: x NOT IN {k.inlist(lx.COLOR_TERMS)}), '|') AS extra FROM w""")
def _(t):
    shared, extra, _all = jo.term_overlap(tx.words(F.lower("product_name")), F.lit(lx.COLOR_TERMS))
    return t.wide.v_products.select("product_id", F.array_join(shared, "|").alias("shared"), F.array_join(extra, "|").alias("extra"))
