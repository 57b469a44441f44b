"""Small text builders for the DuckDB reference SQL."""

from __future__ import annotations

from ..functions.keywords import keyword_table
from ..functions.text import WHITESPACE


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(i) if isinstance(i, str) else str(i) for i in items) + "]"


def inlist(items) -> str:
    return "(" + ", ".join(q(i) for i in items) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {q(WHITESPACE)})"


def let(value: str, var: str, body: str) -> str:
    return f"list_transform([{value}], lambda {var}: {body})[1]"


def odistinct(x: str) -> str:
    return let(x, "l_", "list_filter(l_, lambda e_, i_: list_position(l_, e_) = i_)")


def words(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), {q('[' + WHITESPACE + ']+')}), lambda w_: w_ <> '')"


def any_of(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(n)})" for n in needles) + ")"


def entries(col: str) -> str:
    return (f"list_transform(list_filter(string_split(coalesce({col}, ''), '|'), lambda p: contains(p, ':')), "
            f"lambda p: {{'k': {strip(_part('p'))}, 'v': {strip(_rest('p'))}}})")


def _part(p: str) -> str:
    return f"split_part({p}, ':', 1)"


def _rest(p: str) -> str:
    return f"substr({p}, instr({p}, ':') + 1)"


def last_wins(es: str) -> str:
    return let(es, "es", "list_transform(list_filter(es, lambda e, i: list_position(list_transform(es, lambda o: o.k), e.k) = i), "
                         "lambda e: {'k': e.k, 'v': list_filter(es, lambda o: o.k = e.k)[-1].v})")


def show_entries(es: str) -> str:
    return f"array_to_string(list_transform({es}, lambda e: e.k || '=' || e.v), '|')"


def multi(col: str) -> str:
    """Lower-case keys, usable values, in string order."""
    return (f"list_filter(list_transform({entries(col)}, lambda e: {{'k': lower(e.k), 'v': e.v}}), "
            f"lambda e: lower(e.v) NOT IN ('', 'nan', 'none'))")


def multi_values(es: str, keys) -> str:
    """Values of the keys in key order."""
    return (f"flatten(list_transform({lst(keys)}, lambda k: list_transform(list_filter({es}, lambda e: e.k = k), "
            f"lambda e: e.v)))")


def group_case(v: str, groups: dict) -> str:
    exact = " ".join(f"WHEN {v} IN {inlist(k)} THEN {q(g)}" for g, k in groups.items())
    inside = " ".join(f"WHEN {any_of(v, k)} THEN {q(g)}" for g, k in groups.items())
    return f"CASE {exact} {inside} ELSE 'other' END"


def normalize(x: str, groups: dict) -> str:
    return f"CASE WHEN coalesce({x}, '') <> '' THEN " + let(f"lower({strip(x)})", "v_", group_case("v_", groups)) + " END"


def normalize_list(x: str, groups: dict) -> str:
    low = f"list_transform(list_filter({x}, lambda v_: v_ <> ''), lambda v_: lower({strip('v_')}))"
    return odistinct(f"list_filter(list_transform({low}, lambda v_: {group_case('v_', groups)}), lambda g_: g_ <> 'other')")


def infer(x: str, groups: dict) -> str:
    table = "[" + ", ".join(f"{{'kw': {q(k)}, 'label': {q(v)}}}" for k, v in keyword_table(groups)) + "]"
    text = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')"
    return odistinct(f"list_transform(list_filter({table}, lambda e: contains({text}, e.kw)), lambda e: e.label)")


def vote(x: str, groups: dict) -> str:
    """Label with most keywords, first on ties, as one CASE over counts."""
    counts = [" + ".join(f"contains({x}, {q(k)})::INT" for k in kws) for kws in groups.values()]
    labels = list(groups)
    return (f"CASE WHEN list_max([{', '.join(counts)}]) > 0 THEN "
            f"{lst(labels)}[list_position([{', '.join(counts)}], list_max([{', '.join(counts)}]))] END")


def present(x: str, groups: dict) -> str:
    parts = ", ".join(f"CASE WHEN {any_of(x, k)} THEN {q(g)} END" for g, k in groups.items())
    return f"nullif(concat_ws('|', {parts}), '')"


def draw(seed, salt: str, ident: str) -> str:
    return f"('0x' || substr(md5('{seed}:{salt}:' || {ident}::VARCHAR), 1, 8))::BIGINT"


def uniform(seed, salt: str, ident: str) -> str:
    return f"({draw(seed, salt, ident)} / 4294967296.0::DOUBLE)"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z_: z_[1]::DOUBLE * z_[2]::DOUBLE))"
