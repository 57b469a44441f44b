"""Deliberate corruption of training texts.  Every random choice is a hash of (seed, id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import hash_long, hash_uniform, let, text_or_empty, words

VAGUE_WORDS = sorted(set(lx.STRIP_COLORS + lx.STRIP_MATERIALS + lx.STRIP_STYLES))
VAGUE_WORDS_ROOMS = sorted(set(VAGUE_WORDS + lx.STRIP_ROOMS))


def make_vague(c: Column, listed: list[str] = VAGUE_WORDS) -> Column:
    """Drop words whose letters are a listed word; tidy commas."""
    kept = F.array_join(F.filter(words(c), lambda w: ~F.lower(F.regexp_replace(w, "[^a-zA-Z]", "")).isin(listed)), " ")
    no_double = F.regexp_replace(kept, r",\s*,", ",")
    return F.regexp_replace(no_double, r"^\s*,|,\s*$", "")


def swap_term(c: Column, truth: Column, listed: list[str], draw: Column) -> Column:
    """Replace the first listed term inside the text (all occurrences) by a wrong one."""
    terms = F.lit(listed)
    gt = F.lower(text_or_empty(truth))
    wrong = F.when(gt != "", let(gt, lambda g: F.filter(terms, lambda t: ~F.contains(g, t))))
    choice = let(wrong, lambda w: F.get(w, F.pmod(draw, F.nullif(F.size(w), F.lit(0))).cast("int")))

    def swapped(text: Column) -> Column:
        present = let(F.lower(text), lambda low: F.get(F.filter(terms, lambda t: F.contains(low, t)), F.lit(0)))
        # null when there is no truth, no wrong term or no term in the text
        return F.coalesce(F.regexp_replace(text, F.concat(F.lit("(?i)"), present), choice), text)
    return let(c, swapped)


def make_adversarial(c: Column, color: Column, material: Column, style: Column, seed: int, *ids: Column) -> Column:
    """Wrong colour, material and style words where a truth exists."""
    out = swap_term(text_or_empty(c), color, lx.SWAP_COLORS, hash_long(seed, "color", *ids))
    out = swap_term(out, material, lx.SWAP_MATERIALS, hash_long(seed, "material", *ids))
    return swap_term(out, style, lx.SWAP_STYLES, hash_long(seed, "style", *ids))


def pick_by_share(draw: Column, shares: list[tuple[str, float]]) -> Column:
    """Label of the share interval that a uniform draw falls into (last label takes the rest)."""
    chain, edge = F, 0.0
    for label, share in shares[:-1]:
        edge = round(edge + share, 6)
        chain = chain.when(draw < edge, label)
    return chain.otherwise(shares[-1][0])


def corrupt_mix(df: DataFrame, text: str, truth: dict[str, str], seed: int = 42, id_col: str = "product_id",
                shares: list[tuple[str, float]] = lx.CORRUPTION_SHARES) -> DataFrame:
    """Vague, adversarial and original texts in the given shares; the original stays in a column."""
    key = F.col(id_col)
    t = F.col(text)
    return df.withColumn("corruption", pick_by_share(hash_uniform(seed, "mix", key), shares)).withColumns({
        f"{text}_original": t,
        text: F.when(F.col("corruption") == "vague", make_vague(t, VAGUE_WORDS_ROOMS))
               .when(F.col("corruption") == "adversarial",
                     make_adversarial(t, F.col(truth["color"]), F.col(truth["material"]), F.col(truth["style"]),
                                      seed, key))
               .otherwise(t)})


def mask_words(c: Column, listed: list[str], token: str = "[MASK]") -> Column:
    masked = F.transform(words(c), lambda w: F.when(
        F.regexp_replace(F.lower(w), "[^a-z-]", "").isin(listed), token).otherwise(w))
    return F.array_join(masked, " ")


def preserved_phrases(c: Column) -> Column:
    """Assembly and material phrases of a text, distinct in order; a capture group gives the group."""
    low = F.lower(text_or_empty(c))

    def matches(p: str) -> Column:
        group = 1 if "(\\w" in p else 0
        return F.regexp_extract_all(low, F.lit("(?U)" + p), F.lit(group))
    found = F.flatten(F.array(*[matches(p) for p in lx.ASSEMBLY_PATTERNS + lx.MATERIAL_PATTERNS]))
    return F.array_join(F.array_distinct(F.filter(F.transform(found, F.trim), lambda p: p != "")), ", ")


def augment_text(name: Column, cls: Column, desc: Column, seed: int, *ids: Column, training: bool = True) -> Column:
    """Classifier text at a drawn level of detail with drawn masks; full text outside training."""
    d = F.substring(text_or_empty(desc), 1, 400)
    full = F.concat_ws(" [SEP] ", name, F.nullif(cls, F.lit("")), F.nullif(d, F.lit("")))
    if not training:
        return full
    level = pick_by_share(hash_uniform(seed, "level", *ids), lx.TEXT_LEVELS)
    keep = F.nullif(preserved_phrases(d), F.lit(""))
    tokens = words(name)
    third = F.array_join(F.slice(tokens, F.lit(1), F.greatest(F.lit(1), F.floor(F.size(tokens) / 3).cast("int"))), " ")

    def at_level(lv: Column) -> Column:
        return (F.when(lv == "full", full)
                .when(lv == "partial", F.concat_ws(" [SEP] ", name, F.nullif(cls, F.lit("")), keep))
                .when(lv == "name", F.concat_ws(" [SEP] ", name, keep))
                .when(lv == "minimal", F.concat_ws(" [SEP] ", third, keep))
                .otherwise(text_or_empty(keep)))
    out = let(level, at_level)
    lists = {"color": lx.MASK_COLORS, "shape": lx.MASK_SHAPES, "style": lx.MASK_STYLES, "material": lx.MASK_MATERIALS}

    def masked(c: Column, kind: str, rate: float) -> Column:
        draw = hash_uniform(seed, f"mask_{kind}", *ids)
        return let(c, lambda t: F.when((t != "") & (draw < rate), mask_words(t, lists[kind])).otherwise(t))
    for kind, rate in lx.MASK_RATES:
        out = masked(out, kind, rate)
    return out
