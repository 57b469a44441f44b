"""Feature parsing, normalisation and attribute extraction over the catalog view."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import attributes as A
from ..functions import features as fe
from ..functions import keywords as kw
from ..functions import text as tx
from . import sqlkit as k
from .registry import query
from .views import with_views

PRODUCTS = with_views("v_products")
FEAT = F.col


def _show(entries):
    return F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["v"])), "|")


def _join(c):
    return F.array_join(c, "|")


_NONEMPTY = f"list_filter({k.entries('product_features')}, lambda e: e.k <> '' AND e.v <> '')"


@query("parse_features", f"{PRODUCTS} SELECT product_id, {k.show_entries(k.last_wins(_NONEMPTY))} AS features FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", _show(F.map_entries(fe.parse_features(F.col("product_features"))).cast(
        "array<struct<k:string,v:string>>")).alias("features"))


_LOWER = f"list_transform({k.entries('product_features')}, lambda e: {{'k': lower(e.k), 'v': lower(e.v)}})"


@query("parse_features_lower", f"{PRODUCTS} SELECT product_id, {k.show_entries(k.last_wins(_LOWER))} AS features FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", _show(F.map_entries(fe.parse_features_lower(F.col("product_features"))).cast(
        "array<struct<k:string,v:string>>")).alias("features"))


@query("parse_features_multi", f"""{PRODUCTS}, e AS (SELECT product_id, {k.multi('product_features')} AS es FROM v_products)
SELECT product_id, array_to_string(list_transform(
  list_filter(es, lambda e, i: list_position(list_transform(es, lambda o: o.k), e.k) = i),
  lambda e: e.k || '=' || array_to_string(list_transform(list_filter(es, lambda o: o.k = e.k), lambda o: o.v), ';')), '|') AS features
FROM e""")
def _(t):
    shown = F.transform(F.map_entries(fe.parse_features_multi(F.col("product_features"))),
                        lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ";")))
    return t.wide.v_products.select("product_id", _join(shown).alias("features"))


_FIRST_VALUE = "split_part(split_part(product_features, '|', 1), ':', 2)"


@query("norm_categorical", f"""{PRODUCTS} SELECT product_id,
  {k.strip("regexp_replace(lower(" + k.strip(_FIRST_VALUE) + r"), '\s*\(.*?\)\s*', '', 'g')")} AS value FROM v_products""")
def _(t):
    return t.wide.v_products.select("product_id", fe.norm_categorical(
        F.split_part(F.split_part("product_features", F.lit("|"), F.lit(1)), F.lit(":"), F.lit(2))).alias("value"))


_BOOL = "list_filter(" + k.entries("product_features") + ", lambda e: e.k = 'Assembly Required')[-1].v"


def _bool_sql(x: str) -> str:
    return (f"CASE WHEN lower({k.strip(x)}) IN {k.inlist(lx.TRUE_WORDS)} THEN true "
            f"WHEN lower({k.strip(x)}) IN {k.inlist(lx.FALSE_WORDS)} THEN false END")


@query("norm_boolean", f"{PRODUCTS} SELECT product_id, {_bool_sql(_BOOL)} AS value FROM v_products")
def _(t):
    last = F.try_element_at(F.filter(fe.raw_entries(F.col("product_features")),
                                     lambda e: e["k"] == "Assembly Required"), F.lit(-1))["v"]
    return t.wide.v_products.select("product_id", fe.norm_boolean(last).alias("value"))


def _multi_label_sql(x: str) -> str:
    return (f"list_filter(list_transform(string_split_regex(coalesce({x}, ''), '[,/;&]'), "
            f"lambda p: lower({k.strip('p')})), lambda p: p <> '')")


@query("norm_multi_label", f"{PRODUCTS} SELECT product_id, array_to_string({_multi_label_sql('category_hierarchy')}, '|') AS labels FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", _join(fe.norm_multi_label(F.col("category_hierarchy"))).alias("labels"))


def _attr_sql(name: str) -> str:
    keys = lx.ATTRIBUTE_KEYS[name]
    hit = f"list_filter(es, lambda e: lower({k.strip('e.k')}) IN {k.inlist(keys)})"
    if name == "assembly_required":
        return f"{_bool_sql(hit + '[-1].v')} AS {name}"
    if name == "room_type":
        flat = f"list_sort(list_distinct(flatten(list_transform({hit}, lambda e: {_multi_label_sql('e.v')}))))"
        return f"CASE WHEN len({hit}) > 0 THEN array_to_string({flat}, '|') END AS {name}"
    return k.strip(f"regexp_replace(lower({k.strip(hit + '[1].v')}), '\\s*\\(.*?\\)\\s*', '', 'g')") + f" AS {name}"


_ENTRIES_CTE = f"{PRODUCTS}, e AS (SELECT *, {k.last_wins(_NONEMPTY)} AS es FROM v_products)"
_ATTRS_SQL = ", ".join(_attr_sql(a) for a in lx.SCHEMA1)


def attributes_of(df):
    """The catalog with the seven schema-1 columns read from the feature string."""
    return df.withColumn("_a", fe.normalize_attributes(fe.feature_entries(F.col("product_features")))).select(
        *df.columns, "_a.*")


@query("normalize_attributes", f"{_ENTRIES_CTE} SELECT product_id, {_ATTRS_SQL} FROM e")
def _(t):
    return attributes_of(t.wide.v_products).select("product_id", *[
        _join(c).alias(c) if c == "room_type" else F.col(c) for c in lx.SCHEMA1])


@query("process_products", f"""{_ENTRIES_CTE} SELECT product_id, product_name, product_class, {_ATTRS_SQL} FROM e
WHERE product_features IS NOT NULL AND {k.strip('product_features')} <> ''""")
def _(t):
    from ..operators.filters import process_products
    return process_products(t.wide.v_products).select("product_id", "product_name", "product_class", *[
        _join(c).alias(c) if c == "room_type" else F.col(c) for c in lx.SCHEMA1])


PROCESSED_SQL = f"""{_ENTRIES_CTE}, processed AS (SELECT product_id, product_name, product_class, product_description, {_ATTRS_SQL} FROM e
WHERE product_features IS NOT NULL AND {k.strip('product_features')} <> '')"""


@query("attribute_coverage", PROCESSED_SQL + ", n AS (SELECT count(*) AS n FROM processed) " + " UNION ALL ".join(
    f"SELECT '{a}' AS attribute, count({a}) AS non_null, round(100.0::DOUBLE * count({a}) / count(*), 4) AS pct, "
    f"count(DISTINCT {a}) AS n_unique FROM processed" for a in lx.SCHEMA1))
def _(t):
    from ..operators.filters import process_products
    from ..operators.profile import coverage
    return coverage(process_products(t.wide.v_products), lx.SCHEMA1)


# --- cleaning and text layouts ---------------------------------------------------------
_WS = "[" + tx.WHITESPACE + "]+"
_ODD = f"""[^{tx.WORD_CLASS}{tx.WHITESPACE}.,;:'"-/()]+"""


def clean_sql(x: str) -> str:
    s = f"regexp_replace(coalesce({x}, ''), '<[^>]+>', ' ', 'g')"
    s = f"regexp_replace({s}, {k.q('http[^' + tx.WHITESPACE + ']+')}, '', 'g')"
    s = f"regexp_replace({s}, {k.q(_WS)}, ' ', 'g')"
    s = f"regexp_replace({s}, {k.q(_ODD)}, ' ', 'g')"
    return k.strip(s)


def truncate_sql(x: str, n: int = 500) -> str:
    last = ("greatest(" + ", ".join(
        f"CASE WHEN instr(reverse(substr(c, 1, {n})), '{m}') > 0 THEN {n} - instr(reverse(substr(c, 1, {n})), '{m}') + 1 ELSE 0 END"
        for m in ".!?") + ")")
    body = (f"CASE WHEN length(c) <= {n} THEN c WHEN {last} - 1 > {n * 0.5} THEN substr(c, 1, {last}) "
            f"ELSE regexp_replace(substr(c, 1, {n}), ' [^ ]*$', '') || '...' END")
    return k.let(clean_sql(x), "c", body)


@query("clean_text", f"SELECT page_id, {clean_sql('html')} AS text FROM pages")
def _(t):
    return t.wide.pages.select("page_id", tx.clean_text(F.col("html")).alias("text"))


@query("truncate_sentence", f"SELECT doc_id, {truncate_sql('text')} AS text FROM documents")
def _(t):
    return t.wide.documents.select("doc_id", tx.truncate_sentence(F.col("text")).alias("text"))


@query("format_input", f"""{PRODUCTS} SELECT product_id, concat_ws(chr(10), 'Product: ' || {clean_sql('product_name')},
 CASE WHEN coalesce(product_class, '') <> '' THEN 'Category: ' || {clean_sql('product_class')} END,
 CASE WHEN {truncate_sql('product_description', 500)} <> '' THEN 'Description: ' || {truncate_sql('product_description', 500)} END) AS text
FROM v_products""")
def _(t):
    c = F.col
    return t.wide.v_products.select("product_id", tx.format_input(
        c("product_name"), c("product_class"), c("product_description")).alias("text"))


@query("parse_hierarchy", f"""{PRODUCTS} SELECT product_id, array_to_string(list_filter(list_transform(string_split(
  trim({k.strip("coalesce(category_hierarchy, '')")}, '"'), '/'), lambda p: {k.strip('p')}), lambda p: p <> ''), '>') AS path FROM v_products""")
def _(t):
    return t.wide.v_products.select("product_id", F.array_join(fe.parse_hierarchy(F.col("category_hierarchy")), ">").alias("path"))


# --- keyword matching ----------------------------------------------------------------------
_MULTI_CTE = f"{PRODUCTS}, m AS (SELECT *, {k.multi('product_features')} AS es FROM v_products)"


@query("normalize_value", f"""{_MULTI_CTE} SELECT product_id,
  {k.normalize(k.multi_values('es', ['color']) + '[1]', lx.COLOR_FAMILIES)} AS color,
  {k.normalize(k.multi_values('es', ['material']) + '[1]', lx.MATERIAL_GROUPS)} AS material FROM m""")
def _(t):
    m = fe.parse_features_multi(F.col("product_features"))
    pick = lambda key: F.get(fe.values_of(m, [key]), F.lit(0))
    return t.wide.v_products.select("product_id",
                               kw.normalize_value(pick("color"), lx.COLOR_FAMILIES).alias("color"),
                               kw.normalize_value(pick("material"), lx.MATERIAL_GROUPS).alias("material"))


@query("infer_from_text", f"""SELECT doc_id, array_to_string({k.infer('text', lx.COLOR_FAMILIES)}, '|') AS colors,
  array_to_string({k.infer('text', lx.MATERIAL_GROUPS)}, '|') AS materials FROM documents""")
def _(t):
    return t.wide.documents.select("doc_id", _join(kw.infer_from_text(F.col("text"), lx.COLOR_FAMILIES)).alias("colors"),
                              _join(kw.infer_from_text(F.col("text"), lx.MATERIAL_GROUPS)).alias("materials"))


def color_name_sql(name: str) -> str:
    low = f"lower({name})"
    end = k.strip(low)
    one = k.normalize(f"regexp_extract({end}, '\\bin\\s+(\\w+)\\s*$', 1)", lx.COLOR_FAMILIES)
    two = k.normalize(f"regexp_extract({end}, '\\bin\\s+(\\w+\\s+\\w+)\\s*$', 1)", lx.COLOR_FAMILIES)
    pat = r"'(?:dark\s+|light\s+)?(\w+)\s*/\s*(?:dark\s+|light\s+)?(\w+)'"
    sides = f"flatten(list_transform(list_zip(regexp_extract_all({low}, {pat}, 1), regexp_extract_all({low}, {pat}, 2)), lambda z: [z[1], z[2]]))"
    pairs = k.normalize_list(sides, lx.COLOR_FAMILIES)
    safe = k.normalize_list(f"list_filter({k.words(low)}, lambda w: w IN {k.inlist(lx.SAFE_NAME_COLORS)})", lx.COLOR_FAMILIES)
    return (f"CASE WHEN coalesce({one}, 'other') <> 'other' THEN [{one}] WHEN coalesce({two}, 'other') <> 'other' THEN [{two}] "
            f"WHEN len({pairs}) > 0 THEN {pairs} ELSE {safe} END")


NAMED = with_views("v_named")


@query("color_from_name", f"{NAMED} SELECT product_id, array_to_string({color_name_sql('product_name')}, '|') AS colors FROM v_named")
def _(t):
    return t.wide.v_named.select("product_id", _join(A.color_from_name(F.col("product_name"))).alias("colors"))


def _colors_stage(src: str) -> str:
    return f"""c0 AS (SELECT *, {color_name_sql('product_name')} AS nc, {k.normalize_list(k.multi_values('es', lx.COLOR_FEATURE_KEYS), lx.COLOR_FAMILIES)} AS fc,
   {k.infer('taxonomy_full', lx.COLOR_FAMILIES)} AS tc, {k.infer('product_description', lx.COLOR_FAMILIES)} AS dc FROM {src}),
 c1 AS (SELECT *, coalesce(nc[1], fc[1], tc[1], dc[1]) AS primary_color FROM c0),
 c2 AS (SELECT *, list_filter(nc || fc || tc, lambda x: x <> primary_color)[1] AS secondary_color FROM c1)"""


def _materials_stage(src: str) -> str:
    low = "lower(concat_ws(' ', product_name, coalesce(product_class, '')))"
    surf = " ".join(f"WHEN contains({low}, {k.q(a)}) THEN {k.q(b)}" for a, b in lx.NAME_SURFACES)
    text = ("array_to_string(flatten(list_transform(list_filter(es, lambda e, i: list_position(list_transform(es, lambda o: o.k), e.k) = i), "
            "lambda e: list_transform(list_filter(es, lambda o: o.k = e.k), lambda o: o.v))), ' ')")
    return f"""m0 AS (SELECT *, {text} AS ftext FROM {src}),
 m1 AS (SELECT *, {k.odistinct(k.normalize_list(k.multi_values('es', lx.MATERIAL_FEATURE_KEYS), lx.MATERIAL_GROUPS) + ' || ' + k.infer('ftext', lx.MATERIAL_GROUPS))} AS ma,
   {k.infer("product_name || ' ' || coalesce(product_description, '')", lx.MATERIAL_GROUPS)} AS mb,
   (coalesce(product_class, '') IN {k.inlist(lx.UPHOLSTERED_CLASSES)} OR {k.any_of("lower(concat_ws(' ', product_name, coalesce(product_class, ''), ftext))", lx.UPHOLSTERY_SIGNALS)}) AS soft,
   CASE {surf} END AS guess FROM m0),
 m2 AS (SELECT *, CASE WHEN len(ma) > 0 THEN ma ELSE mb END AS mats FROM m1),
 m3 AS (SELECT *, coalesce(list_filter(mats, lambda x: x IN {k.inlist(lx.SURFACE_MATERIALS)})[1], guess) AS surface,
   list_filter(mats, lambda x: x IN {k.inlist(lx.FRAME_MATERIALS)})[1] AS frame FROM m2),
 m4 AS (SELECT *, CASE WHEN len(mats) = 0 THEN NULL WHEN soft AND surface IS NOT NULL THEN surface ELSE mats[1] END AS primary_material,
   CASE WHEN len(mats) = 0 THEN NULL WHEN soft AND surface IS NOT NULL THEN frame ELSE mats[2] END AS sec0 FROM m3),
 m5 AS (SELECT *, CASE WHEN sec0 = primary_material THEN mats[3] ELSE sec0 END AS secondary_material FROM m4)"""


# names from v_named, everything else from the catalog
RICH = with_views("v_products", "v_named") + f""", rich AS (
 SELECT p.product_id, n.product_name, p.product_class, p.product_description, p.product_features,
   array_to_string(list_filter(list_transform(string_split(trim({k.strip("coalesce(category_hierarchy, '')")}, '"'), '/'), lambda p: {k.strip('p')}), lambda p: p <> ''), ' / ') AS taxonomy_full,
   len(list_filter(list_transform(string_split(trim({k.strip("coalesce(category_hierarchy, '')")}, '"'), '/'), lambda p: {k.strip('p')}), lambda p: p <> '')) AS taxonomy_depth,
   {k.multi('product_features')} AS es
 FROM v_products p JOIN v_named n USING (product_id))"""


def rich_products(t):
    """Catalog with colour-carrying names, taxonomy text and depth.

    Both sides are as long as the catalog. Their files are small beside their rows, so the join is
    told to sort and merge; by file size Spark would send all names through the driver.
    """
    named = t.wide.v_named.select("product_id", "product_name").hint("merge")
    path = F.col("taxonomy")
    return t.wide.v_products.drop("product_name").join(named, "product_id").withColumn(
        "taxonomy", fe.parse_hierarchy(F.col("category_hierarchy"))).withColumns({
            "taxonomy_full": F.array_join(path, " / "), "taxonomy_depth": F.size(path)})


@query("colors_smart", f"{RICH}, {_colors_stage('rich')} SELECT product_id, primary_color, secondary_color FROM c2")
def _(t):
    c = F.col
    feature = kw.normalize_values(fe.values_of(fe.parse_features_multi(c("product_features")), lx.COLOR_FEATURE_KEYS), lx.COLOR_FAMILIES)
    return rich_products(t).select("product_id", A.colors_smart(
        A.color_from_name(c("product_name")), feature, c("taxonomy_full"), c("product_description")).alias("_c")).select("product_id", "_c.*")


@query("is_upholstered", f"{RICH}, {_materials_stage('rich')} SELECT product_id, soft FROM m1")
def _(t):
    c = F.col
    return rich_products(t).select("product_id", A.is_upholstered(
        c("product_name"), c("product_class"), fe.all_values_text(fe.parse_features_multi(c("product_features")))).alias("soft"))


@query("materials_smart", f"{RICH}, {_materials_stage('rich')} SELECT product_id, primary_material, secondary_material FROM m5")
def _(t):
    c = F.col
    return rich_products(t).select("product_id", A.materials_smart(
        fe.parse_features_multi(c("product_features")), c("product_name"), c("product_class"),
        c("product_description")).alias("_m")).select("product_id", "_m.*")


SHAPE_SQL = f"""CASE WHEN NOT {k.any_of("lower(concat_ws(' ', coalesce(product_class, ''), product_name))", lx.SHAPE_INVALID)} THEN {k.normalize_list(k.multi_values('es', lx.SHAPE_FEATURE_KEYS), lx.SHAPE_GROUPS)}[1] END"""
ASSEMBLY_SQL = k.normalize_list(k.multi_values("es", lx.ASSEMBLY_FEATURE_KEYS), lx.ASSEMBLY_GROUPS) + "[1]"
STYLE_SQL = (f"coalesce({k.normalize_list(k.multi_values('es', lx.STYLE_FEATURE_KEYS), lx.STYLE_GROUPS)}[1], "
             f"{k.infer('taxonomy_full', lx.STYLE_GROUPS)}[1], {k.infer('product_description', lx.STYLE_GROUPS)}[1])")


@query("shape_validated", f"{RICH} SELECT product_id, {SHAPE_SQL} AS shape FROM rich")
def _(t):
    c = F.col
    return rich_products(t).select("product_id", A.shape_validated(
        fe.parse_features_multi(c("product_features")), c("product_class"), c("product_name")).alias("shape"))


@query("assembly_level", f"{RICH} SELECT product_id, {ASSEMBLY_SQL} AS assembly FROM rich")
def _(t):
    return rich_products(t).select("product_id", A.assembly_level(fe.parse_features_multi(F.col("product_features"))).alias("assembly"))


@query("style_of", f"{RICH} SELECT product_id, {STYLE_SQL} AS style FROM rich")
def _(t):
    c = F.col
    return rich_products(t).select("product_id", A.style_of(
        fe.parse_features_multi(c("product_features")), c("taxonomy_full"), c("product_description")).alias("style"))


V2_STAGES = f"""{RICH}, {_colors_stage('rich')}, {_materials_stage('c2')},
 v2 AS (SELECT product_id, product_name, product_class, product_description, taxonomy_full, taxonomy_depth, primary_color, secondary_color, primary_material, secondary_material,
   {STYLE_SQL} AS style, {SHAPE_SQL} AS shape, {ASSEMBLY_SQL} AS assembly FROM m5)"""


@query("extract_attributes_v2", f"{V2_STAGES} SELECT product_id, {', '.join(lx.SCHEMA2)} FROM v2")
def _(t):
    return A.extract_attributes_v2(rich_products(t)).select("product_id", *lx.SCHEMA2)


# --- the simple keyword extractor ----------------------------------------------------------
@query("keyword_vote", f"SELECT doc_id, {k.vote('lower(text)', lx.STYLE_KEYWORDS)} AS style, {k.vote('lower(text)', lx.MATERIAL_KEYWORDS)} AS material FROM documents")
def _(t):
    low = t.wide.documents.select("doc_id", F.lower("text").alias("t"))
    return low.select("doc_id", kw.keyword_vote(F.col("t"), lx.STYLE_KEYWORDS).alias("style"),
                      kw.keyword_vote(F.col("t"), lx.MATERIAL_KEYWORDS).alias("material"))


@query("room_types", f"SELECT doc_id, {k.present('lower(text)', lx.ROOM_KEYWORDS)} AS rooms FROM documents")
def _(t):
    return t.wide.documents.select("doc_id", _join(kw.room_types(F.lower("text"))).alias("rooms"))


def _flag_sql(x: str) -> str:
    return f"CASE WHEN {k.any_of(x, lx.ASSEMBLY_TRUE)} THEN true WHEN {k.any_of(x, lx.ASSEMBLY_FALSE)} THEN false END"


@query("assembly_flag", f"{PRODUCTS} SELECT product_id, {_flag_sql('lower(product_description)')} AS flag FROM v_products")
def _(t):
    return t.wide.v_products.select("product_id", kw.assembly_flag(F.lower("product_description")).alias("flag"))


def v1_sql(text: str, src: str) -> str:
    return f"""SELECT product_id, {k.vote(text, lx.STYLE_KEYWORDS)} AS style, {k.vote(text, lx.MATERIAL_KEYWORDS)} AS primary_material,
  NULL::VARCHAR AS secondary_material, {k.vote(text, lx.COLOR_KEYWORDS)} AS color_family, {k.present(text, lx.ROOM_KEYWORDS)} AS room_type,
  lower({k.strip("nullif(product_class, '')")}) AS product_type, {_flag_sql(text)} AS assembly_required FROM {src}"""


@query("extract_attributes_v1", f"""{PRODUCTS}, x AS (SELECT *, lower(concat_ws(' ', product_name, product_description, product_class)) AS t FROM v_products)
{v1_sql('t', 'x')}""")
def _(t):
    out = A.extract_attributes_v1(t.wide.v_products)
    return out.select("product_id", *[_join(c).alias(c) if c == "room_type" else F.col(c) for c in lx.SCHEMA1])


@query("enrich_catalog", f"""{PRODUCTS}, x AS (SELECT *, lower(concat_ws(' ', product_name, product_name || ' ' || coalesce(product_description, '') || ' ' || coalesce(product_features, ''), product_class)) AS t FROM v_products)
{v1_sql('t', 'x')}""")
def _(t):
    out = A.enrich_catalog(t.wide.v_products).select("product_id", "attributes.*")
    return out.withColumn("room_type", _join(F.col("room_type")))
