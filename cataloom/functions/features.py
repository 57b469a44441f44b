"""Parsing of `key:value | key:value` feature strings and normalisation to canonical keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import let, one_of, string_list, strip, text_or_empty


def raw_entries(c: Column) -> Column:
    """Every `key:value` part in string order as array<struct<k,v>>; split at the first colon."""
    parts = F.filter(F.split(text_or_empty(c), r"\|"), lambda p: F.contains(p, F.lit(":")))
    return F.transform(parts, lambda p: F.struct(
        strip(F.substring_index(p, ":", 1)).alias("k"),
        strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("v")))


def last_value_entries(entries: Column) -> Column:
    """One entry per key, at the place of its first occurrence with the value of its last."""
    def collapse(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        return F.transform(keys, lambda k: F.struct(
            k.alias("k"), F.try_element_at(F.filter(es, lambda e: e["k"] == k), F.lit(-1))["v"].alias("v")))
    return let(entries, collapse)


def feature_entries(c: Column) -> Column:
    """Ordered entries of the feature map: empty keys and values dropped, last write wins."""
    return last_value_entries(F.filter(raw_entries(c), lambda e: (e["k"] != "") & (e["v"] != "")))


def parse_features(c: Column) -> Column:
    return F.map_from_entries(feature_entries(c))


def lower_entries(c: Column) -> Column:
    lowered = F.transform(raw_entries(c), lambda e: F.struct(F.lower(e["k"]).alias("k"), F.lower(e["v"]).alias("v")))
    return last_value_entries(lowered)


def parse_features_lower(c: Column) -> Column:
    """Keys and values in lower case, empty values kept, last write wins."""
    return F.map_from_entries(lower_entries(c))


def multi_entries(c: Column) -> Column:
    """All usable values with lower-case keys, in string order."""
    lowered = F.transform(raw_entries(c), lambda e: F.struct(F.lower(e["k"]).alias("k"), e["v"].alias("v")))
    return F.filter(lowered, lambda e: ~F.lower(e["v"]).isin("", "nan", "none"))


def parse_features_multi(c: Column) -> Column:
    """Map from lower-case key to all of its values in order."""
    def group(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.struct(
            k.alias("k"),
            F.transform(F.filter(es, lambda e: e["k"] == k), lambda e: e["v"]).alias("v"))))
    return let(multi_entries(c), group)


def values_of(multi: Column, keys: list[str]) -> Column:
    """Values of the given keys of a multi map, in key order."""
    return let(multi, lambda m: F.flatten(F.transform(
        string_list(keys), lambda k: F.coalesce(F.try_element_at(m, k), F.array().cast("array<string>")))))


def all_values_text(multi: Column) -> Column:
    return F.array_join(F.flatten(F.map_values(multi)), " ")


# --- value normalisation --------------------------------------------------------------------
def norm_categorical(c: Column) -> Column:
    return strip(F.regexp_replace(F.lower(strip(c)), r"\s*\(.*?\)\s*", ""))


def norm_boolean(c: Column) -> Column:
    v = F.lower(strip(c))
    return F.when(v.isin(lx.TRUE_WORDS), True).when(v.isin(lx.FALSE_WORDS), False)


def norm_multi_label(c: Column) -> Column:
    return F.filter(F.transform(F.split(text_or_empty(c), "[,/;&]"), lambda p: F.lower(strip(p))), lambda p: p != "")


def normalize_attributes(entries: Column, attribute_keys: dict[str, list[str]] = lx.ATTRIBUTE_KEYS) -> Column:
    """Canonical attribute struct from ordered, de-duplicated entries.

    Categorical: the first matching key.  Boolean: the last matching key, even when its
    value is unreadable.  Multi-label: the sorted union over all matching keys.
    """
    def value(es: Column, name: str, keys: list[str]) -> Column:
        found = F.filter(es, lambda e: one_of(F.lower(strip(e["k"])), keys))
        if name == "assembly_required":
            return norm_boolean(F.try_element_at(found, F.lit(-1))["v"])
        if name == "room_type":
            return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(
                F.flatten(F.transform(found, lambda e: norm_multi_label(e["v"]))))))
        return norm_categorical(F.try_element_at(found, F.lit(1))["v"])

    def canonical(es: Column) -> Column:
        return F.struct(*[value(es, name, keys).alias(name) for name, keys in attribute_keys.items()])
    return let(entries, canonical)


def parse_hierarchy(c: Column) -> Column:
    """Levels of a `a / b / c` path; quotes and blank levels dropped."""
    bare = F.btrim(strip(text_or_empty(c)), F.lit('"'))
    return F.filter(F.transform(F.split(bare, "/"), strip), lambda p: p != "")
