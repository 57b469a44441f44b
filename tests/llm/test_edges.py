"""Cases at the edges of the operators: kinds of ids, hot rows, widths, letters, padding, what is left behind."""

import random
import string
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from cataloom.llm import common, copies
from cataloom.llm.decontaminate import contaminated
from cataloom.llm.embeddings import near_vectors
from cataloom.llm.langid import identify, train
from cataloom.llm.packing import pack
from cataloom.llm.secretscan import _RUN, _encoding, base_spans, known_form, scan_secrets
from cataloom.llm.simhash import near_duplicates
from cataloom.llm.tokens import count_tokens, vocabulary


@pytest.mark.parametrize("kind, ids", [("smallint", [1, 2, None]), ("decimal(10,0)", [Decimal(1), Decimal(2), None]), ("date", None), ("string", ["a", "b", None])])
def test_ids_of_any_kind(spark, kind, ids):
    import datetime as dt
    ids = ids or [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    docs = spark.createDataFrame([(i, t, "en") for i, t in zip(ids, ["one two", "password = abcdef1", None])], f"doc_id {kind}, text string, lang string")
    for out in (count_tokens(docs), scan_secrets(docs), near_duplicates(docs), identify(docs, train(docs)), pack(docs)):
        assert {r.doc_id for r in out.collect()} == set(ids)


def test_vectors_of_two_widths_and_of_rare_ones(spark):
    r = np.random.default_rng(8)
    rows, by = [], {}
    for width, n in ((8, 300), (4, 60), (3, 2), (5, 3)):
        base = r.normal(size=(12, width))
        x = base[r.integers(0, 12, n)] + r.normal(size=(n, width)) * r.choice([0.01, 0.1, 0.5], (n, 1))
        if n < 5:
            x[1:] = x[0] + r.normal(size=(n - 1, width)) * 1e-3
        by[width] = (len(rows), x.astype(np.float32).astype(float))
        rows += [(len(rows) + i, v.tolist(), i % 2 if n > 5 else 0) for i, v in enumerate(x.astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    want = np.zeros(len(rows), int)
    for width, (at, x) in by.items():
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        label = np.array([rows[at + i][2] for i in range(len(x))])
        want[at:at + len(x)] = ((unit @ unit.T >= 0.98) & (label[:, None] == label[None])).sum(1) - 1
    for books in (16, 1):  # with one codebook all other widths make single lists
        got = near_vectors(table, books=books, most=50).collect()
        assert {x.vec_id: x.n_links for x in got} == dict(enumerate(want.tolist()))
    assert (want[360:] > 0).all()


def test_bisectors_hide_no_partner():
    from cataloom.llm.embeddings import Codebook
    r = np.random.default_rng(1)
    x = r.normal(size=(3_000, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    book = Codebook(x[:1_000], 40, 8)
    partner = x + r.normal(size=x.shape) * 0.03
    partner /= np.linalg.norm(partner, axis=1, keepdims=True)
    apart = np.linalg.norm(x - partner, axis=1)
    home, _, _ = book.encode(partner)
    visits = book.visits(x, 0.2)
    assert all(h in v for h, v, d in zip(home, visits, apart) if d <= 0.2) and np.mean([len(v) for v in visits]) < 30


def test_random_letters_by_brute_force(spark):
    r = random.Random(4)
    runs = ["".join(r.choices(a, k=n)) for a in (string.ascii_letters, string.ascii_lowercase, string.ascii_uppercase, string.ascii_letters + string.digits) for n in (20, 40, 64) for _ in range(20)]
    words = ["internationalization" * 2, "counterrevolutionaries", "Donaudampfschifffahrtsgesellschaft", "https-example-com-some-path", "get_elements_by_class_name", "d41d8cd98f00b204e9800998ecf8427e",
             "getElementsByClassNameFromDocument", "=" * 30, "1234567890" * 3]
    text = " , ".join(f"x {w} y" for w in runs + words)
    encoding = _encoding(vocabulary("byte_bpe_50k.tiktoken"))
    want = []
    base = base_spans(text)
    for m in _RUN.finditer(text):
        run = m[0]
        letters = [c for c in run if c.isalpha()]
        case = any(c.islower() for c in run[1:]) and any(c.isupper() for c in run[1:])
        limit = 2.0 if case or any(c.isdigit() for c in run) else 1.9
        if letters and not known_form(run) and not any(s < m.end() and m.start() < e for s, _, e in base) and len(run) / len(encoding.encode_ordinary(run)) <= limit:
            want.append((m.start(), m.end()))
    row = scan_secrets(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    found = [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("random")]
    assert found == want
    caught = {text[a:b] for a, b in found}
    assert len(caught & set(runs)) > 0.93 * len(runs) and not caught & set(words)


def test_a_text_in_nearly_all_rows_counts_once_in_the_sample(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    hot = spark.range(10_000).select((F.col("id") + 1_000_000).alias("doc_id"), F.lit("the same words stand here again and again").alias("text"), F.lit("en").alias("lang"))
    model = train(docs.union(hot), sample_rows=200)
    out = identify(docs, model).join(docs, "doc_id").where("held_out AND lang_pred <> 'und' AND lang IS NOT NULL")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.95
    assert train(docs, most_languages=2)["languages"] == sorted(r.lang for r in docs.where("lang IS NOT NULL").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(2).collect())


def test_many_benchmark_windows_carry_no_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    extra = spark.createDataFrame([(9_001, "A train goes 60 km in 2 h, then 90 km in 3 h, then 120 km in 5 h. Find its speed.")], "item_id long, text string")
    bench = bench.select("item_id", "text").union(extra)
    more = spark.createDataFrame([(9_001, "Before. A train goes 70 km in 4 h, then 80 km in 6 h, then 130 km in 9 h. Find its speed. After.")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(more)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    few, many = contaminated(docs, bench, literal=True), contaminated(docs, bench, literal=True, broadcast_rows=1)
    assert key(few) == key(many) and any(r[0] == 9_001 and r[4] for r in key(many))
    plan = many._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert joins
    node = many._jdf.queryExecution().optimizedPlan()
    stack, seen = [node], 0
    while stack:
        n = stack.pop()
        if n.nodeName() == "Join":
            seen += 1
            for side in (n.left(), n.right()):
                assert "text" not in [side.output().apply(i).name() for i in range(side.output().size())]
        stack += [n.children().apply(i) for i in range(n.children().size())]
    assert seen


def test_padding_is_near_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = pack(docs).select("sequence_id", "length").toPandas()
    total = int(rows.length.sum())
    assert rows.sequence_id.nunique() <= -(-total // 2048) * 1.01 + 1


def test_alike_texts_below_the_limit_leave_the_join_only_where_bits_allow(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(140)]
    rows = []
    for i in range(400):  # a fifth of the words changed: similar at about a fifth, sharing keys
        rows.append((i, " ".join(w if r.random() > 0.06 else f"{w}x{i}" for w in base)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = copies.near_copies(docs)
    assert found.select("component").distinct().count() == 400
    sets = [copies.shingle_set(t.encode(), 5) for _, t in rows[:40]]
    for x in sets:
        for y in sets:
            apart = sum(((a ^ b) & (2**64 - 1)).bit_count() for a, b in zip(copies.signature(x), copies.signature(y)))
            assert apart <= len(np.setxor1d(x, y))


def test_intermediate_tables_are_removed(spark):
    import os
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    mark = common.made_so_far()
    out = copies.one_of_each(docs)
    left = common._MADE[mark:]
    assert out.count() > 0 and all(os.path.isdir(p.removeprefix("file:")) for p in left)
    assert {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in left} <= {"rows", "marked", "labels", "copies", "gone"}
    saved = common.kept(out, "saved")
    common.forget_since(spark, mark, saved)
    assert common._MADE[mark:] == [saved.kept_path] and saved.count() > 0 and not any(os.path.isdir(p.removeprefix("file:")) for p in left)
