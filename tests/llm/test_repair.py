"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest

from cataloom.llm.repair import damaged, repair, repair_report

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def fix(rows):
    """(cost, audit, repaired) of rows (initial, dead, truncated): all edits in all orders, cheapest and then least."""
    @cache
    def best(i, state, inserts):
        found = []
        if i == len(rows) and state in ("", "a"):
            found.append((0, "", ()))
        role = "a" if state == "u" else "u"
        if inserts < 3:
            c, audit, path = best(i, role, inserts + 1)
            found.append((c + 2, "I" + audit, (("I", role, None), *path)))
        if i < len(rows):
            initial, dead, late = rows[i]
            options = [(3, "D", state)]
            if not dead:
                options.append((2 + late, "R", role))
                if (state, initial) in NEXT:
                    options.append((late, "K", initial))
            for cost, edit, to in options:
                c, audit, path = best(i + 1, to, 0)
                found.append((c + cost, edit + audit, ((edit, to, i), *path)))
        return min(found, default=(10**9, "", ()))
    return best(0, "", 0)


def harm(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(key.encode()) % 20
        out[conv]
        if fate == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fate, text)
        out[conv] += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain(conversations):
    """Expected report by conversation."""
    out = {}
    for conv, rows in conversations.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked, blank, dup, trunc = set(), [], 0, 0, 0
        for _, role, text in rows:
            shown = text.rstrip(" \t\n\x0b\x0c\r")
            late = shown[-1:] not in (".", "!", "?")
            if not shown:
                blank += 1
            elif (role, text) in seen:
                dup += 1
            elif late:
                trunc += 1
            marked.append((role[:1], not shown or (role, text) in seen, int(late)))
            seen.add((role, text))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        cost, audit, path = fix(tuple(marked))
        full = {"u": "user", "a": "assistant"}
        lines = [f"{full[to] if e in 'IR' else rows[i][1]}:{'' if i is None else rows[i][2]}" for e, to, i in path if e != "D"]
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, blank, dup, trunc, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def found(df):
    return {r[0]: tuple(r)[1:] for r in df.collect()}


SCHEMA = "conv_id long, turn long, role string, text string"


def table(seed, convs=60, longest=12):
    r = random.Random(seed)
    rows = []
    for conv in [*range(convs), None]:
        for turn in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = r.choice(["Yes.", "No!", "half", "", None, " \n\t", "Well?  \n", "é.", f"row {turn}.", f"row {turn}"])
            rows.append((conv, r.choice([turn, turn, turn + r.randint(0, 3), None]), role, text))
    return rows


@pytest.mark.parametrize("chunk_rows", [1, 4, 2_048])
def test_as_a_search_over_all_edits(spark, chunk_rows):
    rows = table(chunk_rows) + table(5, 10)[:30]
    conversations = spark.createDataFrame([(*x, 1, "z") for x in rows], SCHEMA + ", chunk int, pos string").repartition(6)
    assert found(repair_report(conversations, damaged(conversations), chunk_rows)) == plain(harm(rows))


@pytest.mark.parametrize("passes", [0, 1, 3, 50])
def test_one_long_conversation_in_many_chunks(spark, passes):
    """Chains of chunks: roles that converge, users only (a parity that never converges) and a run of blank rows."""
    r = random.Random(11)
    rows = [(1, t, "user" if t % 2 == 0 or r.random() < 0.1 else "assistant", f"t{t}{r.choice('.?x')}") for t in range(220)]
    rows += [(2, t, "user", f"t{t}.") for t in range(151)]
    rows += [(3, t, r.choice(["user", "assistant"]), "" if 20 < t < 140 else f"t{t}.") for t in range(180)]
    rows += [(4, t, "tool", f"t{t}.") for t in range(77)] + [(5, 0, "system", "Be kind.")]
    import sys
    sys.setrecursionlimit(5_000)
    given = spark.createDataFrame([(*x, 1) for x in rows], SCHEMA + ", copies int")
    want = defaultdict(list)
    for conv, *row in rows:
        want[conv].append(tuple(row))
    got = found(repair_report(given, given, 8, passes))
    assert got == plain(want)
    assert max(x.chunk for x in repair(given, 8, passes).collect()) > 10 and got[2][5] > 0


def test_repeated_rows_collapse_before_they_are_sorted(spark):
    rows = [(7, 0, "user", "Hello."), (7, 1, "assistant", "Hi."), (7, 2, "user", "")]
    given = spark.createDataFrame([(*x, n) for x, n in zip(rows, (1, 500, 300))], SCHEMA + ", copies int")
    want = {7: [(0, "user", "Hello.")] + [(1, "assistant", "Hi.")] * 500 + [(2, "user", "")] * 300}
    got = found(repair_report(given, given))[7]
    assert got[1:4] == (300, 499, 0) and got[6] == "KK" + "D" * 799 and got[5] == 3 * 799
    assert got[4] == 499 + 299 and got[0] == 0 and got[7] == hashlib.sha256(b"user:Hello.\nassistant:Hi.").hexdigest()
    assert len(want[7]) == len(got[6])


def test_empty_and_vanished(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair_report(none, damaged(none)).count() == 0
    gone = next(t for t in range(100) if zlib.crc32(f"9:{t}".encode()) % 20 == 0)
    one = spark.createDataFrame([(9, gone, "user", "x")], SCHEMA)
    assert found(repair_report(one, damaged(one))) == {9: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_query(spark):
    from cataloom.llm.queries import QUERIES
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, folder)) == plain(harm(rows))
