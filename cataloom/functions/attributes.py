"""Attribute extraction from names, classes, features, taxonomy and descriptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from .features import all_values_text, parse_features_multi, values_of
from .keywords import (assembly_flag, first_group, infer_from_text, keyword_vote, normalize_value, normalize_values,
                       room_types)
from .text import has_any, let, one_of, strip, text_or_empty, words


def _listed(c: Column) -> Column:
    """A known group as a one-element list, else null."""
    return let(c, lambda v: F.when(v != "other", F.array(v)))


def color_from_name(name: Column) -> Column:
    """Colours named in a product name: trailing `in <colour>`, then `a/b` pairs, then safe words."""
    low = F.lower(text_or_empty(name))
    end = strip(low)
    one = _listed(normalize_value(F.regexp_extract(end, r"(?U)\bin\s+(\w+)\s*$", 1), lx.COLOR_FAMILIES))
    two = _listed(normalize_value(F.regexp_extract(end, r"(?U)\bin\s+(\w+\s+\w+)\s*$", 1), lx.COLOR_FAMILIES))
    pair = r"(?U)(?:dark\s+|light\s+)?(\w+)\s*/\s*(?:dark\s+|light\s+)?(\w+)"
    sides = F.flatten(F.zip_with(F.regexp_extract_all(low, F.lit(pair), F.lit(1)),
                                 F.regexp_extract_all(low, F.lit(pair), F.lit(2)), lambda a, b: F.array(a, b)))
    pairs = F.when(F.contains(low, F.lit("/")), normalize_values(sides, lx.COLOR_FAMILIES))
    safe = normalize_values(F.filter(words(low), lambda w: one_of(w, lx.SAFE_NAME_COLORS)), lx.COLOR_FAMILIES)
    return F.coalesce(one, two, let(pairs, lambda p: F.when(F.size(p) > 0, p)), safe)


def colors_smart(name_colors: Column, feature_colors: Column, taxonomy: Column, description: Column) -> Column:
    """Primary and secondary colour; sources in order name, features, taxonomy, description."""
    tax = infer_from_text(taxonomy, lx.COLOR_FAMILIES)
    desc = infer_from_text(description, lx.COLOR_FAMILIES)

    def decide(listed: Column) -> Column:
        return let(F.coalesce(F.get(listed, F.lit(0)), F.get(desc, F.lit(0))), lambda first: F.struct(
            first.alias("primary_color"),
            F.get(F.filter(listed, lambda c: c != first), F.lit(0)).alias("secondary_color")))
    return let(F.array_distinct(F.concat(name_colors, feature_colors, tax)), decide)


def is_upholstered(name: Column, cls: Column, features_text: Column) -> Column:
    everything = F.lower(F.concat_ws(" ", text_or_empty(name), text_or_empty(cls), text_or_empty(features_text)))
    return one_of(text_or_empty(cls), lx.UPHOLSTERED_CLASSES) | has_any(everything, lx.UPHOLSTERY_SIGNALS)


def name_surface(name: Column, cls: Column) -> Column:
    low = F.lower(F.concat_ws(" ", text_or_empty(name), text_or_empty(cls)))

    def first(v: Column) -> Column:
        chain = F
        for needle, label in lx.NAME_SURFACES:
            chain = chain.when(v.contains(needle), label)
        return chain.otherwise(None)
    return let(low, first)


def materials_smart(multi: Column, name: Column, cls: Column, description: Column) -> Column:
    """Primary and secondary material; upholstered rows show their surface, the frame is second."""
    return let(multi, lambda m: _materials(m, name, cls, description))


def _materials(multi: Column, name: Column, cls: Column, description: Column) -> Column:
    text = all_values_text(multi)
    listed = F.array_distinct(F.concat(
        normalize_values(values_of(multi, lx.MATERIAL_FEATURE_KEYS), lx.MATERIAL_GROUPS),
        infer_from_text(text, lx.MATERIAL_GROUPS)))
    from_text = infer_from_text(F.concat_ws(" ", text_or_empty(name), text_or_empty(description)), lx.MATERIAL_GROUPS)
    candidates = let(listed, lambda l: F.when(F.size(l) > 0, l).otherwise(from_text))
    soft = is_upholstered(name, cls, text)
    guess = name_surface(name, cls)

    def decide(all_: Column) -> Column:
        surface = F.coalesce(F.get(F.filter(all_, lambda m: one_of(m, lx.SURFACE_MATERIALS)), F.lit(0)), guess)
        frame = F.get(F.filter(all_, lambda m: one_of(m, lx.FRAME_MATERIALS)), F.lit(0))
        cover = F.when(soft, surface)  # the visible surface of an upholstered row, else null

        def order(over: Column) -> Column:
            return F.struct(F.coalesce(over, F.get(all_, F.lit(0))).alias("p"),
                            F.when(over.isNotNull(), frame).otherwise(F.get(all_, F.lit(1))).alias("s"),
                            F.get(all_, F.lit(2)).alias("t"))
        return F.when(F.size(all_) > 0, let(cover, order))

    def settle(d: Column) -> Column:
        return F.struct(d["p"].alias("primary_material"),
                        F.when(d["s"] == d["p"], d["t"]).otherwise(d["s"]).alias("secondary_material"))
    return let(let(candidates, decide), settle)


def shape_validated(multi: Column, cls: Column, name: Column) -> Column:
    low = F.lower(F.concat_ws(" ", text_or_empty(cls), text_or_empty(name)))
    return F.when(~has_any(low, lx.SHAPE_INVALID),
                  first_group(values_of(multi, lx.SHAPE_FEATURE_KEYS), lx.SHAPE_GROUPS))


def assembly_level(multi: Column) -> Column:
    return first_group(values_of(multi, lx.ASSEMBLY_FEATURE_KEYS), lx.ASSEMBLY_GROUPS)


def style_of(multi: Column, taxonomy: Column, description: Column) -> Column:
    return F.coalesce(first_group(values_of(multi, lx.STYLE_FEATURE_KEYS), lx.STYLE_GROUPS),
                      F.get(infer_from_text(taxonomy, lx.STYLE_GROUPS), F.lit(0)),
                      F.get(infer_from_text(description, lx.STYLE_GROUPS), F.lit(0)))


def extract_attributes_v2(df: DataFrame) -> DataFrame:
    """Seven attributes of schema 2 from the catalog columns; one projection, no shuffle.

    Expects product_name, product_class, product_description, product_features and
    taxonomy_full; adds the seven columns.
    """
    name, cls, desc, tax = (F.col(c) for c in
                            ("product_name", "product_class", "product_description", "taxonomy_full"))
    multi = F.col("_multi")
    staged = df.withColumns({
        "_multi": parse_features_multi(F.col("product_features")),
        "_name_colors": color_from_name(name),
    })
    feature_colors = normalize_values(values_of(multi, lx.COLOR_FEATURE_KEYS), lx.COLOR_FAMILIES)
    staged = staged.withColumns({
        "_color": colors_smart(F.col("_name_colors"), feature_colors, tax, desc),
        "_material": materials_smart(multi, name, cls, desc),
        "style": style_of(multi, tax, desc),
        "shape": shape_validated(multi, cls, name),
        "assembly": assembly_level(multi),
    })
    return staged.select(*df.columns, "_color.*", "_material.*", "style", "shape", "assembly")


def extract_attributes_v1(df: DataFrame, name: str = "product_name", cls: str = "product_class",
                          desc: str | Column = "product_description") -> DataFrame:
    """Seven attributes of schema 1 by keyword votes over name, description and class."""
    d = F.col(desc) if isinstance(desc, str) else desc
    text = F.lower(F.concat_ws(" ", text_or_empty(F.col(name)), F.nullif(d, F.lit("")),
                               F.nullif(F.col(cls), F.lit(""))))
    t = F.col("_text")
    return df.withColumn("_text", text).withColumns({
        "style": keyword_vote(t, lx.STYLE_KEYWORDS),
        "primary_material": keyword_vote(t, lx.MATERIAL_KEYWORDS),
        "secondary_material": F.lit(None).cast("string"),
        "color_family": keyword_vote(t, lx.COLOR_KEYWORDS),
        "room_type": room_types(t),
        "product_type": F.lower(strip(F.nullif(F.col(cls), F.lit("")))),
        "assembly_required": assembly_flag(t),
    }).drop("_text")


def enrich_catalog(df: DataFrame) -> DataFrame:
    """Schema-1 attributes of the whole catalog, feature string included in the text."""
    full = F.concat_ws(" ", text_or_empty(F.col("product_name")), text_or_empty(F.col("product_description")),
                       text_or_empty(F.col("product_features")))
    out = extract_attributes_v1(df, desc=full)
    return out.select("product_id", text_or_empty(F.col("product_name")).alias("product_name"),
                      text_or_empty(F.col("product_class")).alias("product_class"),
                      F.struct(*lx.SCHEMA1).alias("attributes"))
