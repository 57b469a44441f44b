"""SimHash, lines, vectors and repeated strings against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
import xxhash
import zstandard

from cataloom.llm import lines as line_module
from cataloom.llm.embeddings import near_vectors
from cataloom.llm.graph import components
from cataloom.llm.lines import dedup_lines
from cataloom.llm.simhash import near_duplicates, near_in_blocks
from cataloom.llm.substrings import remove_repeats, repeated_spans


def classes(n: int, linked) -> list[int]:
    """Smallest index of each node's component."""
    low = list(range(n))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x
    for a, b in linked:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def prose(rnd: random.Random, n: int) -> str:
    return " ".join("".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(2, 7))) for _ in range(n))


def documents(seed: int, lines: bool) -> list[tuple]:
    rnd = random.Random(seed)
    base = [prose(rnd, rnd.randrange(8, 60)) for _ in range(40)]
    shared = prose(rnd, 30)
    out = []
    for i in range(150):
        parts = [rnd.choice(base) for _ in range(rnd.randrange(1, 4))]
        if i % 3 == 0:
            parts.insert(rnd.randrange(len(parts) + 1), shared)
        words = " \n ".join(parts).split(" ") if lines else " ".join(parts).split(" ")
        if i % 4 == 0:
            words[rnd.randrange(len(words))] = prose(rnd, 1)
        out.append((i, " ".join(words), "x"))
    return out + [(150, None, "x"), (151, "", "x"), (152, "one", "x"), (153, "\n\n", "x"), (3, out[3][1], "x"), (154, "ab " * 4_000, "x"), (155, "z" * 900, "x")]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in range(100, 160)} | {300: 299, 299: 299}


@pytest.mark.parametrize("radius", [0, 2, 3, 5])
def test_bit_slices_find_what_popcounts_find(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 12, np.uint64, endpoint=False)
    prints = rng.choice(base, 400) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))
    end = np.where(np.arange(400) < 150, 150, 400)
    linked = [(i, j) for i in range(400) for j in range(i + 1, end[i]) if bin(int(prints[i] ^ prints[j])).count("1") <= radius]
    assert near_in_blocks(prints, end, radius).tolist() == classes(400, linked)


def test_simhash(spark):
    docs = documents(1, False)
    rows = near_duplicates(spark.createDataFrame([(a, b, 1) for a, b, _ in docs] + [(None, docs[0][1], 1)], "doc_id bigint, text string, fp int")).collect()

    def mark(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        h = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    marks = [mark(t) for _, t, _ in docs]
    group = classes(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if bin(marks[i] ^ marks[j]).count("1") <= 3])
    least = {}
    for (d, _, _), g in zip(docs, group):
        least[g] = min(d, least.get(g, d))
    want = [(d, f"{m:016x}", least[g]) for (d, _, _), m, g in zip(docs, marks, group)] + [(None, f"{marks[0]:016x}", least[group[0]])]
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, want))
    assert near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def expected_lines(docs, share=0.8):
    """Per document the lines that stay; equal rows are one document."""
    earlier, out = [], {}
    for doc, text, _ in sorted({d for d in docs if d[1] is not None}, key=lambda d: math.inf if d[0] is None else d[0]):
        stay = []
        for line in text.split("\n"):
            s = set(re.split(r"[\x20\x09-\x0D]+", line)) - {""}
            if not s or not any(len(s & e) >= share * len(s | e) - 1e-9 for e in earlier):
                stay.append(line)
            if s:
                earlier.append(s)
        out[doc] = "\n".join(stay)
    return out


@pytest.mark.parametrize("first", [4, 1])
def test_lines(spark, monkeypatch, first):
    """Also with token groups of every size taken as large ones, where lines stop at their first candidates."""
    if first == 1:
        whole = line_module.candidates
        monkeypatch.setattr(line_module, "candidates", lambda packed, share, buckets: whole(packed, share, buckets, small=2, first=1))
    docs = documents(2, True)
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string, gone string").repartition(5)).collect()
    want = expected_lines(docs)
    assert len(rows) == len(docs) and {r.gone for r in rows} == {"x"}
    for r in rows:
        assert r.text == want.get(r.doc_id), r.doc_id
        assert r.n_removed == r.n_lines - len(r.text.split("\n")) if r.text and r.n_removed < r.n_lines else True
    assert dedup_lines(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_repeated_strings(spark):
    docs = documents(4, True)
    expected, seen = {}, {}
    for doc, text in sorted({(d, t or "") for d, t, _ in docs}):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p:p + 100] in seen:
                gone[p:p + 100] = True
            else:
                seen[b[p:p + 100]] = 1
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        expected[doc] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    frame = spark.createDataFrame(docs, "doc_id bigint, text string, spans string").repartition(4)
    rows = remove_repeats(frame).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == expected[r.doc_id], r.doc_id
    # k-mers with many surroundings take another way to the same spans
    def merged(df):
        out = {}
        for r in df.collect():
            out.setdefault((r.doc, r.twin), set()).update(range(r.lo, min(r.hi, 10**6)))
        return out
    assert merged(repeated_spans(frame, hot=2)) == merged(repeated_spans(frame))
    assert remove_repeats(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(30, 12))
    x = np.concatenate([centre[rng.integers(0, 30, 500)] + rng.normal(size=(500, 12)) * rng.choice([0.02, 0.12, 0.3], (500, 1)), np.repeat(centre[:1], 40, 0)]).astype(np.float32)
    rows = [(i, v.tolist(), int(i % 3)) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 12, 1), (902, [float("nan")] + [1.0] * 11, 1), (903, [None] + [1.0] * 11, 1), (904, x[0].tolist(), None), (905, [float("inf")] * 12, 1), (906, [], 2)]
    table = spark.createDataFrame([(a, b, c, 0) for a, b, c in rows + odd + rows[:1]], "vec_id bigint, embedding array<float>, label int, node int")
    got = near_vectors(table, per_list=16, most=20).collect()
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.98) & (np.arange(540)[:, None] % 3 == np.arange(540)[None, :] % 3)
    group = classes(540, [(i, j) for i, j in zip(*np.nonzero(near)) if i < j])
    links = near.sum(1) - 1 + near[:, 0]  # row 0 is there twice
    for r in got:
        if r.vec_id >= 900:
            assert (r.n_links, r.component_id, r.kept) == (0, r.vec_id, True)
        else:
            assert (r.n_links, r.component_id, r.kept) == (links[r.vec_id], group[r.vec_id], group[r.vec_id] == r.vec_id), r.vec_id
    assert len(got) == 540 + len(odd) + 1
    assert near_vectors(spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")).count() == 0


def test_long_lines(spark):
    """Lines of hundreds of words, similar by more or less than the share, where wide bitmaps decide."""
    rnd = random.Random(9)
    docs = []
    for i in range(60):
        n = rnd.choice([100, 113, 130, 300, 449, 600])
        base = [f"w{n}x{k}" for k in range(n)]
        for k in rnd.sample(range(n), int(n * rnd.choice([0, 0.05, 0.1, 0.11, 0.12, 0.2, 0.4]))):
            base[k] = f"own{i}y{k}"
        if rnd.random() < 0.4:
            base += [f"more{i}z{k}" for k in range(int(n * rnd.choice([0.1, 0.2, 0.3])))]
        rnd.shuffle(base)
        docs.append((i, " ".join(base), "x"))
    rows = dedup_lines(spark.createDataFrame(docs, "doc_id bigint, text string, gone string").repartition(3)).collect()
    want = expected_lines(docs)
    assert {r.doc_id: r.text for r in rows} == want
    assert 5 < sum(t == "" for t in want.values()) < 55


def test_equal_lines_of_many_tasks_settle_without_a_comparison(spark):
    rnd = random.Random(5)
    shared = prose(rnd, 30)
    words = shared.split(" ")
    near = " ".join([*words[:-1], "other"])
    rows = [(i, "\n".join([" ".join(reversed(words)) if i % 2 else shared, prose(rnd, 12), *([near] if i == 39 else [])])) for i in range(40)]
    texts = line_module.placed_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(20), "doc_id", "text")
    table = line_module.rarity_table(texts, "text")
    found = line_module.candidates(line_module.prefixes(texts, table, 0.8, 4), 0.8, 4).collect()
    place = {(r.b_doc, r.b_line) for r in found if r.a_doc is None}
    assert place == {(i, 0) for i in range(1, 40)}
    assert {(r.b_doc, r.b_line, r.a_doc, r.a_line) for r in found if r.a_doc is not None} == {(39, 2, 0, 0)}


def test_texts_are_taken_apart_by_bytes():
    import pyarrow as pa
    texts = ["é" * 50_000, None, ""] * 30 + ["x" * 3_000_000, "y"]
    parts = list(line_module.parts_of(pa.array(texts)))
    assert [t for _, p in parts for t in p] == [(t or "").encode() for t in texts]
    assert [at for at, _ in parts] == [sum(len(p) for _, p in parts[:i]) for i in range(len(parts))]
    assert all(sum(map(len, p)) <= 1_000_000 or len(p) == 1 for _, p in parts)


def test_hashes_of_texts_are_carried_only_for_ids_with_two_texts(spark):
    one = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, ""), (2, None), (None, "c")], "doc_id long, text string")
    two = one.union(spark.createDataFrame([(None, "d")], one.schema))
    assert [line_module.has_twins(d, "doc_id", "text") for d in (one, two)] == [False, True]
    assert {r.twin for r in line_module.placed_texts(one, "doc_id", "text", twins=False).collect()} == {0}
    assert sorted((r.text or "", r.n_removed) for r in dedup_lines(two.union(two)).collect()) == sorted(
        (r.text or "", r.n_removed) for r in dedup_lines(two).collect() for _ in range(2))


def test_kept_powers_do_not_change_hashes():
    from cataloom.llm import anchors
    data = np.frombuffer(b"some words and some other words " * 200, np.uint8)
    at = np.arange(0, 6_000, 7)
    whole = anchors.range_hashes(data, at, at + 5)
    for n in (9, 5_000, 12, 6_400):
        some = at[at + 5 <= n]
        assert (anchors.range_hashes(data[:n], some, some + 5) == whole[:len(some)]).all()
    assert len(anchors._POWERS[0]) <= anchors.KEPT_POWERS


def test_only_texts_with_asked_lines_are_moved(spark, monkeypatch):
    """12 lines of 3,000 texts are asked for: no other text is packed for the join that fetches them."""
    texts = spark.range(3000).selectExpr("id AS doc", "id % 2 AS twin", "concat('text ', id, '\\nline ', id) AS text")
    places = spark.range(0, 3000, 250).selectExpr("id AS doc", "id % 2 AS twin", "1L AS line")
    moved = []
    inner = line_module.packed_texts
    monkeypatch.setattr(line_module, "packed_texts", lambda t: (moved.append(t.count()), inner(t))[1])
    found = line_module.fetch_lines(places, texts).collect()
    assert {(r.doc, zstandard.decompress(r.words)) for r in found} == {(i, f"line {i}".encode()) for i in range(0, 3000, 250)}
    assert moved == [12]


def test_second_pass_takes_only_lines_with_asked_tokens():
    """Of the lines of some texts only those with a token of a marked bucket become sets, with the order they have among all."""
    texts = [b"alpha beta gamma\ndelta epsilon", b"", b"beta zeta\n\neta theta beta longer-than-eight-bytes"]
    table = np.arange(line_module.BUCKETS, dtype=np.uint32)
    whole = line_module.line_sets(texts, table)
    token = line_module.token_hashes([b"beta"])[0]
    asked = np.zeros(line_module.BUCKETS, bool)
    asked[(token >> np.uint64(44)).astype(np.int64)] = True
    some = line_module.line_sets(texts, table, asked)
    keep = [i for i in range(len(whole["size"])) if token[0] in whole["token"][whole["start"][i]:whole["start"][i] + whole["size"][i]]]
    assert len(whole["size"]) == 4 and len(keep) == 3
    for k in ("size", "text", "line", "bits", "whole"):
        assert some[k].tolist() == whole[k][keep].tolist()
    assert some["token"].tolist() == [int(t) for i in keep for t in whole["token"][whole["start"][i]:whole["start"][i] + whole["size"][i]]]


def test_word_hashes_follow_the_bytes():
    words = [b"", b"a", b"a\0", b"12345678", b"123456789", b"12345678\0", b"x" * 40, b"x" * 41]
    data = np.frombuffer(b"..".join(words) + b"." + b"".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    first = np.concatenate([[0], np.cumsum(size + 2)[:-1]])
    again = int((size + 2).sum()) - 2 + 1 + np.concatenate([[0], np.cumsum(size)[:-1]])
    one, two = (line_module.word_hashes(data, at, at + size) for at in (first, again))
    assert (one == two).all() and len(set(one.tolist())) == len(words)


def test_texts_are_not_read_to_tell_ids_apart(spark, monkeypatch):
    """Where no id occurs twice, no text is hashed to see whether an id has two."""
    monkeypatch.setattr(line_module, "placed_texts", lambda *a, **k: pytest.fail("texts were read"))
    assert not line_module.has_twins(spark.createDataFrame([(1, "a"), (2, "a"), (None, "b")], "doc_id int, text string"), "doc_id", "text")


def test_prefix_tasks_hold_prefixes_and_not_whole_sets():
    """300 lines of 5,000 words: a task packs as soon as it holds `flush_rows` prefix rows, and holds no more than these."""
    import tracemalloc

    import pyarrow as pa

    class Tasks:
        def mapInArrow(self, fn, schema):
            return fn

    texts = [" ".join(f"w{i}x{k}" for k in range(5_000)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array([0] * 300), pa.array(texts)], names=["doc", "twin", "text"])
    table = np.ones(line_module.BUCKETS, np.uint32)
    task = line_module.prefixes(Tasks(), table, 0.8, 64, flush_rows=100_000)
    tracemalloc.start()
    sizes = [sum(n for b, n in zip(out.column(0).to_pylist(), out.column(1).to_pylist()) if b >= 0) for out in task(iter([batch]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 300 * 1001 and max(sizes) < 200_000
    assert peak < 100e6  # 239 MB when the sets were held whole


def test_tokens_of_a_line_stand_in_one_order_everywhere():
    """Rarity, then the token, whatever else the part holds and however little room its lines leave."""
    rnd = np.random.default_rng(4)
    words = rnd.integers(0, 2**64, 400, np.uint64, endpoint=False)
    words[:200] = (words[:200] & np.uint64(0xFFFFFFFF)) | np.uint64(3 << 44)
    for n, lines in ((0, 1), (1, 1), (3_000, 40), (3_000, 2**45)):
        token, line = words[rnd.integers(0, 400, n)], np.sort(rnd.integers(0, lines, n))
        rarity = (token >> np.uint64(44)).astype(np.uint32) % np.uint32(9)
        order = line_module.rarest_first(token, rarity, line)
        want = np.lexsort((token, token << np.uint64(20), rarity, line))
        assert sorted(order.tolist()) == list(range(n))
        assert (token[order] == token[want]).all() and (line[order] == line[want]).all()
