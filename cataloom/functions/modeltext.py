"""Reading the free-text answers of an attribute model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .features import norm_boolean, norm_multi_label
from .text import WORD_CLASS, let, string_table, strip, text_or_empty

_JSON = {"allowSingleQuotes": "false"}
_MAP = "map<string,string>"
_ENTRIES = "array<struct<key:string,value:string>>"


def _json_entries(c: Column) -> Column:
    """Entries of a JSON object in order (null when it is not one)."""
    return F.map_entries(F.from_json(c, _MAP, _JSON))


def clean_key(c: Column) -> Column:
    return F.replace(F.lower(strip(c)), F.lit(" "), F.lit("_"))


def shorten_output(c: Column, n: int = 500) -> Column:
    """Up to the first blank line; long slash lists keep their first item; `n` characters."""
    head = F.substring_index(c, "\n\n", 1)
    short = F.regexp_replace(head, f"([{WORD_CLASS}]+)(?:/[{WORD_CLASS}]+){{5,}}", "$1")
    return F.substring(short, 1, n)


def parse_json_output(c: Column) -> Column:
    """The whole text as a JSON object, else the first flat `{...}` inside it; else null."""
    whole = F.when(F.startswith(strip(c), F.lit("{")), _json_entries(strip(c)))
    inner = _json_entries(F.nullif(F.regexp_extract(c, r"\{[^{}]+\}", 0), F.lit("")))
    return F.coalesce(whole, inner)


def parse_kv_output(c: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """`key: value` pairs by line and `;`; known keys only, the first one wins; null when none."""
    lines = F.filter(F.transform(F.split(strip(c), "\n"), strip),
                     lambda l: (l != "") & ~F.startswith(l, F.lit("Product:")))
    parts = F.filter(F.transform(F.flatten(F.transform(lines, lambda l: F.split(l, ";"))), strip),
                     lambda p: F.contains(p, F.lit(":")))
    pairs = F.filter(F.transform(parts, lambda p: F.struct(
        clean_key(F.substring_index(p, ":", 1)).alias("key"),
        strip(F.substring(p, F.instr(p, ":") + 1, F.length(p))).alias("value"))),
        lambda e: e["key"].isin(keys) & (e["value"] != ""))

    def first_wins(es: Column) -> Column:
        firsts = F.filter(es, lambda e, i: F.array_position(F.transform(es, lambda o: o["key"]), e["key"]) == i + 1)
        return F.when(F.size(es) > 0, firsts)
    return let(pairs, first_wins)


def parse_regex_output(c: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """`key: value` or `key = value` anywhere in the lower-cased text."""
    low = F.lower(c)
    found = F.array(*[F.struct(F.lit(k).alias("key"),
                               F.nullif(F.regexp_extract(low, rf"{k}\s*[:=]\s*([^;\n]+)", 1), F.lit("")).alias("value"))
                      for k in keys])
    return F.transform(F.filter(found, lambda e: e["value"].isNotNull()), lambda e: F.struct(
        e["key"].alias("key"), strip(e["value"]).alias("value")))


def normalize_model_value(c: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """Trim, cut at `;` and at a following `key:`, shorten, none-like words to null."""
    cut = strip(F.substring_index(strip(c), ";", 1))
    own = strip(F.regexp_replace(cut, f"(?s)(?:{'|'.join(keys)}):.*$", ""))
    short = let(own, lambda v: F.when(F.length(v) > 100, F.substring(v, 1, 50)).otherwise(v))
    return let(short, lambda v: F.when(~F.lower(v).isin(lx.NONE_WORDS), v))


def normalize_model_output(entries: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """Struct with every key; the last entry of a key decides."""
    def last(es: Column, key: str) -> Column:
        return F.try_element_at(F.filter(es, lambda e: clean_key(e["key"]) == key), F.lit(-1))["value"]
    return let(entries, lambda es: F.struct(*[normalize_model_value(last(es, k), keys).alias(k) for k in keys]))


def parse_model_output(c: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """Raw model text to the seven keys: JSON anywhere in it, else key-value pairs, else regular expressions of its head."""
    def choose(t: Column) -> Column:
        as_json = let(parse_json_output(t), lambda j: F.when(F.size(j) > 0, j))
        return F.coalesce(as_json, let(shorten_output(t), lambda h: F.coalesce(parse_kv_output(h, keys), parse_regex_output(h, keys))))
    text = F.when(strip(text_or_empty(c)) != "", c)
    return normalize_model_output(F.coalesce(let(text, choose), F.array().cast(_ENTRIES)), keys)


def typed_answer(parsed: Column, keys: list[str] = lx.SCHEMA1) -> Column:
    """A parsed answer of strings with its rooms as an array and assembly as a boolean, as `align_model_schema` takes it.

    Null where the answer holds none of the keys."""
    def typed(key: str) -> Column:
        v = parsed[key]
        if key == "room_type":
            return F.when(v.isNotNull(), norm_multi_label(v))
        return norm_boolean(v) if key == "assembly_required" else v
    return F.when(F.coalesce(*[parsed[k] for k in keys]).isNotNull(), F.struct(*[typed(k).alias(k) for k in keys]))


def parse_fenced_json(c: Column, keys: list[str] = lx.SCHEMA1, braces_only: bool = False) -> Column:
    """JSON answer inside code fences, or from the first `{` to the last `}`."""
    text = strip(text_or_empty(c))
    if braces_only:
        text = F.coalesce(F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit("")), text)
    else:
        opened = F.when(F.startswith(text, F.lit("```")), F.when(
            F.contains(text, F.lit("\n")), F.regexp_replace(text, r"(?s)^[^\n]*\n", "")).otherwise(
            F.substring(text, F.lit(4), F.length(text)))).otherwise(text)
        text = strip(F.regexp_replace(opened, "```$", ""))
    entries = F.coalesce(_json_entries(text), F.array().cast(_ENTRIES))

    def last(es: Column, key: str) -> Column:
        return F.try_element_at(F.filter(es, lambda e: e["key"] == key), F.lit(-1))["value"]
    return let(entries, lambda es: F.struct(*[last(es, k).alias(k) for k in keys]))


def apply_aliases(c: Column, aliases: dict[str, str]) -> Column:
    table = string_table(list(aliases.items()), "k", "v")
    hit = let(F.lower(strip(c)), lambda v: F.get(F.filter(table, lambda e: e["k"] == v), F.lit(0))["v"])
    return F.coalesce(hit, c)


def align_model_schema(answer: Column, class_taxonomy: Column, class_attributes: Column) -> Column:
    """Model answer (schema 1) in the classifier's shape: taxonomy, attributes map, confidence.

    `answer` is a struct of the seven keys, null when the model gave nothing;
    `class_attributes` is map<string,string>.
    """
    def value(key: str) -> Column:
        v = answer[key]
        if key == "room_type":
            v = F.array_join(F.transform(F.filter(v, lambda r: r != ""), lambda r: F.lower(strip(r))), ", ")
        elif key == "assembly_required":
            v = F.when(v, "yes").when(~v, "no")
        else:
            v = F.lower(strip(v))
        for name, table in (("color_family", lx.MODEL_COLORS), ("primary_material", lx.MODEL_MATERIALS),
                            ("style", lx.MODEL_STYLES)):
            if key == name:
                v = apply_aliases(v, table)
        return v

    pairs = F.array(*[F.struct(F.lit(clean).alias("key"), value(k).alias("value"))
                      for k, clean in lx.MODEL_KEY_MAP.items()])
    own = F.filter(pairs, lambda e: e["value"].isNotNull() & ~e["value"].isin("none", "null", "n/a", "unknown", ""))
    given = F.coalesce(F.map_entries(class_attributes), F.array().cast(_ENTRIES))

    def merge(mine: Column) -> Column:
        rest = F.filter(given, lambda g: (g["value"] != "") & ~F.exists(mine, lambda m: m["key"] == g["key"]))
        return F.concat(mine.cast(_ENTRIES), rest)

    taxonomy = F.coalesce(class_taxonomy, F.array().cast("array<string>"))
    leaf = answer["product_type"]

    def finish(es: Column) -> Column:
        n = F.size(es)
        return F.struct(
            F.when((F.size(taxonomy) == 0) & (text_or_empty(leaf) != ""), F.array(F.initcap(leaf))).otherwise(
                taxonomy).alias("taxonomy"),
            F.map_from_entries(es).alias("attributes"),
            F.when(n >= 5, 0.90).when(n >= 3, 0.80).when(n >= 1, 0.70).otherwise(0.50).alias("confidence"))

    nothing = F.struct(taxonomy.alias("taxonomy"), F.map_from_entries(given).alias("attributes"),
                       F.lit(lx.UNAVAILABLE_CONFIDENCE).alias("confidence"))
    return F.when(answer.isNull(), nothing).otherwise(let(let(own, merge), finish))


def valid_or_null(c: Column, allowed: list[str]) -> Column:
    return F.when(c.isin(allowed), c)
