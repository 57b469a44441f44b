"""Search-query texts: building them from products and reading attributes out of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import let, strip, text_or_empty, words


def _renamed(c: Column, names: dict[str, str]) -> Column:
    chain = F
    for a, b in names.items():
        chain = chain.when(c == a, b)
    return chain.otherwise(c)


def image_query(color: Column, material: Column, shape: Column, name: Column, style: Column,
                site: str = "") -> Column:
    """`colour material shape name style site`, default-like values left out."""
    def usable(c: Column, *skip: str) -> Column:
        return F.when(~c.isin("", *skip), c)
    parts = [_renamed(usable(color, "other", "multi"), {"gold_metal": "gold", "natural_fiber": "natural"}),
             _renamed(usable(material, "other", "mixed"), {"natural_fiber": "natural fiber", "synthetics": "synthetic"}),
             usable(shape, "rectangular", "other"), name, usable(style, "other")]
    return F.concat_ws(" ", *parts, *([F.lit(site)] if site else []))


def attribute_words(color: Column, material: Column, style: Column, shape: Column) -> Column:
    """Distinct lower-case words (3+ letters) of the attribute values, sorted."""
    def usable(c: Column, *skip: str) -> Column:
        return F.when(~c.isin("", *skip), c)
    plain = [F.replace(usable(c, "other", "multi", "mixed"), F.lit("_"), F.lit(" ")) for c in (color, material, style)]
    plain.append(F.replace(usable(shape, "rectangular", "other"), F.lit("-"), F.lit(" ")))
    tokens = F.filter(words(F.concat_ws(" ", *plain)), lambda w: F.length(w) >= 3)
    return F.array_sort(F.array_distinct(F.transform(tokens, lambda w: F.lower(w))))


def name_words(name: Column, generic: list[str] = lx.GENERIC_WORDS) -> Column:
    """Distinct lower-case letter runs (3+) of a name without generic words."""
    found = F.regexp_extract_all(F.lower(text_or_empty(name)), F.lit("[a-z]{3,}"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.lit(generic))


def stock_query(name: Column, cls: Column, adjectives: list[str] = lx.STOCK_ADJECTIVES) -> Column:
    """Short stock-photo query: brand marks, sizes and model codes out, two adjectives + class."""
    # fixed values: patterns removed from the name, in this order
    removed = ["[^" + " \\t\\n\\r" + "]+[®™]", r"(?i)\bby\s+\w+\b",
               r"""\d+['"]\s*[xX×]\s*\d+['"]*""", r"""\d+['"]+""",
               r"(?i)\d+\s*(?:inch|in|cm|mm|ft)\b", r"\b[A-Z]{2,}\d{2,}\b"]
    bare = reduce(lambda c, p: F.regexp_replace(c, p, ""), removed, text_or_empty(name))
    bare = strip(F.regexp_replace(bare, r"\s+", " "))
    low_cls = F.lower(F.nullif(cls, F.lit("")))
    useful = let(low_cls, lambda lc: F.filter(words(F.lower(bare)), lambda w: w.isin(adjectives) & ~F.contains(lc, w)))
    by_class = F.concat_ws(" ", F.slice(useful, 1, 2), low_cls)
    by_name = F.array_join(F.slice(words(bare), 1, 5), " ")
    query = F.when(low_cls.isNotNull(), by_class).otherwise(by_name)
    return let(query, lambda q: strip(F.when(
        (F.size(words(q)) <= 2) & ~F.contains(F.lower(q), F.lit("furniture")),
        F.concat(q, F.lit(" furniture"))).otherwise(q)))


def query_words(query: Column) -> Column:
    return F.regexp_extract_all(F.lower(text_or_empty(query)), F.lit(r"(?U)\w+"), F.lit(0))


def query_attributes(query: Column, terms: dict[str, list[str]] = lx.QUERY_TERMS) -> Column:
    """Alphabetically first hit per term list; null where a list has none."""
    return let(query_words(query), lambda ws: F.struct(*[
        F.array_min(F.array_intersect(ws, F.lit(listed))).alias(attr) for attr, listed in terms.items()]))


def query_parse(query: Column, terms: dict[str, list[str]] = lx.QUERY_TERMS) -> Column:
    """Attributes, price limit (`under $500`) and the text that remains without them."""
    price = r"(?:under|below|less than)\s*\$?\s*(\d+(?:\.\d+)?)"
    low = F.lower(text_or_empty(query))
    limit = F.nullif(F.regexp_extract(low, price, 1), F.lit("")).cast("double")
    known = sorted({t for listed in terms.values() for t in listed})
    rest = F.filter(words(F.regexp_replace(low, price, " ")), lambda w: ~w.isin(known))
    return let(query_words(query), lambda ws: F.struct(
        *[F.array_min(F.array_intersect(ws, F.lit(listed))).alias(attr) for attr, listed in terms.items()],
        limit.alias("max_price"), F.array_join(rest, " ").alias("text")))
