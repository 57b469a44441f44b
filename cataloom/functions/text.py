"""Column functions on free text: trimming, cleaning, truncation, prompts (no UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx

# Unicode white space, as Python's str.strip/str.split see it.
WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
              "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
WORD_CLASS = r"\p{L}\p{N}_"  # a word character in any script
SPACE_RUN = f"[{WHITESPACE}]+"


def let(value: Column, body) -> Column:
    """Bind `value` once and use it many times inside `body` (a one-element transform).

    Also needed for a single use inside another lambda: the optimizer may push the
    expression of a projected column into that lambda, where it would run per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def each(df: DataFrame, values: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of an array, null elements dropped.

    An inner explode makes the optimizer add a `size(array) > 0` filter at the scan, which
    computes an expensive array twice; the outer form does not.
    """
    return df.select(*keep, F.explode_outer(values).alias(name)).filter(F.col(name).isNotNull())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def none_if_blank(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def words(c: Column) -> Column:
    """White-space tokens without empty ones."""
    return F.filter(F.split(text_or_empty(c), SPACE_RUN), lambda w: w != "")


def has_any(c: Column, needles: list[str]) -> Column:
    """True when any needle is a substring of `c`."""
    return let(c, lambda v: F.exists(string_list(list(needles)), lambda n: F.contains(v, n)))


def any_contains(c: Column, needles: list[str]) -> Column:
    """As `has_any`, written out as a short-circuit OR; for use inside a lambda."""
    return reduce(lambda a, b: a | b, [c.contains(n) for n in needles])


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_list(items: list[str]) -> Column:
    """A constant array of strings, folded to one literal."""
    return F.expr("array(" + ", ".join(_quoted(i) for i in items) + ")")


def one_of(c: Column, items: list[str]) -> Column:
    """Membership in a constant list; one parsed literal instead of a Column per item."""
    return F.array_contains(string_list(items), c)


def string_map(entries: dict[str, str]) -> Column:
    """A constant map, folded to one literal."""
    return F.expr("map(" + ", ".join(f"{_quoted(k)}, {_quoted(v)}" for k, v in entries.items()) + ")")


def string_table(rows: list[tuple[str, str]], first: str = "kw", second: str = "label") -> Column:
    """A constant array of two-field structs (folded to one literal by the optimizer)."""
    items = ", ".join(f"named_struct('{first}', {_quoted(a)}, '{second}', {_quoted(b)})" for a, b in rows)
    return F.expr(f"array({items})")


def hash_long(seed: int | str, salt: str, *ids: Column) -> Column:
    """Partition-independent 32-bit draw from (seed, salt, ids)."""
    key = F.concat_ws(":", F.lit(str(seed)), F.lit(salt), *[i.cast("string") for i in ids])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")


def hash_uniform(seed: int | str, salt: str, *ids: Column) -> Column:
    """Uniform draw in [0, 1) from (seed, salt, ids)."""
    return hash_long(seed, salt, *ids) / F.lit(4294967296.0)


# --- cleaning and truncation -----------------------------------------------------------
def clean_text(c: Column) -> Column:
    """Tags to a space, URLs out, white space collapsed, odd characters to a space, trimmed."""
    no_tags = F.regexp_replace(text_or_empty(c), "<[^>]+>", " ")
    no_urls = F.regexp_replace(no_tags, f"http[^{WHITESPACE}]+", "")
    one_space = F.regexp_replace(no_urls, SPACE_RUN, " ")
    # '"-/' is a character range (0x22-0x2F)
    plain = F.regexp_replace(one_space, rf"""[^{WORD_CLASS}{WHITESPACE}.,;:'"-/()]+""", " ")
    return strip(plain)


def cut_at_last_space(c: Column) -> Column:
    """Drop the last space and what follows; text without a space stays."""
    return F.regexp_replace(c, " [^ ]*$", "")


def truncate_sentence(c: Column, n: int = 500) -> Column:
    """Clean, then cut at the last sentence end in the second half, else at the last space."""
    def cut(full: Column) -> Column:
        head = F.substring(full, 1, n)

        def last(mark: str) -> Column:
            at = F.instr(F.reverse(head), mark)
            return F.when(at > 0, n - at + 1).otherwise(0)

        end = F.greatest(*[last(m) for m in ".!?"])
        by_sentence = F.when(end - 1 > n * 0.5, F.substring(full, F.lit(1), end))
        return F.when(F.length(full) <= n, full).otherwise(
            F.coalesce(by_sentence, F.concat(cut_at_last_space(head), F.lit("..."))))
    return let(clean_text(c), cut)


def format_input(name: Column, cls: Column, desc: Column, n: int = 500) -> Column:
    """Cleaned `Product / Category / Description` block; blank parts are left out."""
    body = truncate_sentence(desc, n)
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), clean_text(name)),
        F.when(text_or_empty(cls) != "", F.concat(F.lit("Category: "), clean_text(cls))),
        F.when(text_or_empty(body) != "", F.concat(F.lit("Description: "), body)))


# --- training and search texts ----------------------------------------------------------
def training_text(name: Column, cls: Column, desc: Column, n: int = 500) -> Column:
    """`Product / Category / Description` block of a training example, the description cut at `n` characters."""
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Product: "), F.coalesce(name, F.lit("Unknown"))),
        F.concat(F.lit("Category: "), cls),
        F.concat(F.lit("Description: "), F.substring(desc, 1, n)))


def classifier_text(name: Column, cls: Column, desc: Column, n: int = 200) -> Column:
    """`name [SEP] class [SEP] description`, the last cut near `n` characters at a space."""
    d = strip(desc)
    short = F.when(F.length(d) > n, F.concat(cut_at_last_space(F.substring(d, 1, n)), F.lit("..."))).otherwise(d)
    return F.concat_ws(" [SEP] ", strip(text_or_empty(name)), strip(none_if_blank(cls)),
                       F.when(text_or_empty(d) != "", short))


def search_text(name: Column, cls: Column, desc: Column, n: int | None = None) -> Column:
    """`name | class | description`; the whole description is searchable unless cut at `n` characters."""
    body = F.nullif(desc, F.lit(""))
    return F.concat_ws(" | ", F.nullif(name, F.lit("")), F.nullif(cls, F.lit("")), body if n is None else F.substring(body, 1, n))


def encoder_text(name: Column, cls: Column, desc: Column, n: int = 300) -> Column:
    """Tagged title, class and description, the last cut at `n` characters."""
    def part(tag: str, c: Column) -> Column:
        return F.concat(F.lit(f"[{tag}] "), F.nullif(c, F.lit("")))
    return F.concat_ws(" ", part("TITLE", name), part("CLASS", cls), part("DESC", F.substring(desc, 1, n)))


def encoder_text_sep(name: Column, cls: Column, desc: Column, n: int = 300) -> Column:
    """Title, class and description between separators, the last cut at `n` characters."""
    return F.concat_ws(" [SEP] ", text_or_empty(name), F.nullif(cls, F.lit("")),
                       F.substring(F.nullif(desc, F.lit("")), 1, n))


def prompt_for_fields(fields: Column, text: Column) -> Column:
    """One line per requested field, then the product text, then the answer format."""
    table = string_table(list(lx.PROMPT_FIELDS.items()), "field", "line")
    lines = F.transform(
        F.filter(fields, lambda f: f.isin(list(lx.PROMPT_FIELDS))),
        lambda f: F.get(F.filter(table, lambda e: e["field"] == f), F.lit(0))["line"])
    return F.concat_ws("\n", F.lit(lx.PROMPT_HEAD), lines,
                       F.when(text_or_empty(text) != "", F.concat(F.lit("\nProduct text: "), text)),
                       F.lit(lx.PROMPT_TAIL))


def extraction_prompt(text: Column, has_image: Column) -> Column:
    def wrap(parts: tuple[str, str]) -> Column:
        return F.concat(F.lit(parts[0]), text, F.lit(parts[1]))
    return F.when(has_image, wrap(lx.IMAGE_PROMPT)).otherwise(wrap(lx.TEXT_PROMPT))


def split_input_text(c: Column) -> Column:
    """Name and description out of a training text."""
    first = F.substring_index(c, "\n", 1)
    rest = F.when(F.instr(c, "\n") > 0, F.substring(c, F.length(first) + 2, F.length(c))).otherwise("")
    return F.struct(F.replace(first, F.lit("Product: "), F.lit("")).alias("product_name"),
                    rest.alias("product_description"))


# --- urls ---------------------------------------------------------------------------------
def domain_of(url: Column) -> Column:
    """Host (with port) in lower case without a leading `www.`; empty when there is none."""
    host = F.regexp_extract(F.lower(text_or_empty(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(host, r"^www\.", "")


def is_blocked(url: Column, blocked: list[str] = lx.BLOCKED_DOMAINS) -> Column:
    return let(domain_of(url), lambda d: any_contains(d, blocked))
