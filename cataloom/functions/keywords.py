"""Keyword matching: value groups, text inference, votes.

Keyword tables are constant arrays and maps that the optimizer folds to literals, walked
with higher-order functions.  A generated CASE chain over ~150 keywords would exceed the
JVM method limit for compilation and is slow to build and analyse.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from .text import any_contains, let, string_list, string_map, string_table, strip, text_or_empty

Groups = dict[str, list[str]]


def _minimal(keywords: list[str]) -> list[str]:
    """Keywords that are not implied by a shorter one of the same group."""
    return [k for k in keywords if not any(o != k and o in k for o in keywords)]


def _group_of(v: Column, groups: Groups) -> Column:
    """Group of a lower-cased value: exact keyword, else first group with a keyword inside."""
    exact = {}
    for label, kws in groups.items():
        for kw in kws:
            exact.setdefault(kw, label)
    inside = string_table([(kw, label) for label, kws in groups.items() for kw in _minimal(kws)])
    return F.coalesce(F.try_element_at(string_map(exact), v),
                      F.get(F.filter(inside, lambda e: F.contains(v, e["kw"])), F.lit(0))["label"], F.lit("other"))


def normalize_value(c: Column, groups: Groups) -> Column:
    """Group of one value: exact keyword, else first group with a keyword inside, else `other`."""
    return F.when(text_or_empty(c) != "", let(F.lower(strip(c)), lambda v: _group_of(v, groups)))


def normalize_values(values: Column, groups: Groups) -> Column:
    """Distinct known groups of an array of values, in order."""
    lowered = F.transform(F.filter(values, lambda v: v != ""), lambda v: F.lower(strip(v)))
    return F.array_distinct(F.filter(F.transform(lowered, lambda v: _group_of(v, groups)), lambda g: g != "other"))


def first_group(values: Column, groups: Groups) -> Column:
    return F.get(normalize_values(values, groups), F.lit(0))


def plain_text(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", " ")


def keyword_table(groups: Groups) -> list[tuple[str, str]]:
    """(keyword, label) pairs, longest keyword first; equal lengths keep the group order."""
    rows = [(re.sub("[^a-z0-9]+", " ", kw.lower()).strip(), label) for label, kws in groups.items() for kw in kws]
    return sorted((r for r in rows if r[0]), key=lambda r: -len(r[0]))


def infer_from_text(c: Column, groups: Groups) -> Column:
    """Labels with a keyword inside the text, longest keyword first."""
    table = string_table(keyword_table(groups))
    hits = let(plain_text(text_or_empty(c)), lambda t: F.filter(table, lambda e: F.contains(t, e["kw"])))
    return F.array_distinct(F.transform(hits, lambda e: e["label"]))


def keyword_vote(c: Column, groups: Groups) -> Column:
    """Label with the most keywords inside the (lower-case) text; ties to the earlier label."""
    rows = [(label, kw) for label, kws in groups.items() for kw in kws]
    table = string_table(rows, "label", "kw")
    hits = F.transform(let(c, lambda t: F.filter(table, lambda e: F.contains(t, e["kw"]))), lambda e: e["label"])
    labels = list(groups)

    def best(found: Column) -> Column:
        scored = F.transform(string_list(labels), lambda l, i: F.struct(
            F.size(F.filter(found, lambda f: f == l)).alias("n"), (-i).alias("i"), l.alias("label")))
        return F.when(F.size(found) > 0, F.array_max(scored)["label"])
    return let(hits, best)


def labels_present(c: Column, groups: Groups) -> Column:
    """All labels with a keyword inside the text, in table order; null when none."""
    rows = [(label, kw) for label, kws in groups.items() for kw in _minimal(kws)]
    table = string_table(rows, "label", "kw")
    hits = let(c, lambda t: F.filter(table, lambda e: F.contains(t, e["kw"])))
    found = F.array_distinct(F.transform(hits, lambda e: e["label"]))
    return let(found, lambda f: F.when(F.size(f) > 0, f))


def room_types(c: Column) -> Column:
    return labels_present(c, lx.ROOM_KEYWORDS)


def assembly_flag(c: Column) -> Column:
    return let(c, lambda t: F.when(any_contains(t, lx.ASSEMBLY_TRUE), True).when(any_contains(t, lx.ASSEMBLY_FALSE), False))
