"""WARC round trip, decontamination, languages, secrets and the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from cataloom.llm.decontaminate import contaminated
from cataloom.llm.langid import codewords, identify, train
from cataloom.llm.queries import ORACLES, QUERIES
from cataloom.llm.secretscan import known_form, scan_secrets
from cataloom.llm.simhash import near_duplicates
from cataloom.llm.warc import archive_round_trip, look_up, read_records, url_key, url_keys, write_archives, write_index

FOLDER = "/root/testdata/sf0.001"


def test_url_keys():
    assert url_key("https://me@Blog.Example.com:80/a?b#c") == "com,example,blog:80)/a?b#c"
    assert (url_key(None), url_key("no url"), url_key("http://a.b")) == ("", ")no url", "b,a)/")


def test_archive_and_index(spark, tmp_path):
    big = "x" * 3_000
    rows = [(i, f"http://h{i % 7}.example.com/{i % 11}", f"<p>{i}</p>" * (i % 300)) for i in range(400)]
    rows += [(1000 + i, "http://hot.example.com/", big) for i in range(300)] + [(2000, None, None), (None, "odd\nurl\tx", ""), (2001, "odd\nurl\tx", "é\r\n\r\n" * 500), (2001, "odd\nurl\tx", "é\r\n\r\n" * 500)]
    pages = spark.createDataFrame([(a, b, c, 1) for a, b, c in rows], "page_id bigint, url string, html string, file int").repartition(3)
    folder = str(tmp_path)
    places = write_archives(pages, folder, roll=20_000)
    shards = write_index(places, folder, block=10, per_shard=100)
    assert shards.count() > 3 and places.select("file").distinct().count() > 3
    got = read_records(look_up(url_keys(pages), shards, folder), folder).collect()
    want = [(p, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest(), "revisit" if h == big and p != 1299 else "response", 1299 if h == big and p != 1299 else None) for p, _, h in rows]
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    one = look_up(spark.createDataFrame([("com,example,h3)/5",), ("com,none)/",)], "url_key string"), shards, folder).collect()
    assert {r.page_id for r in one} == {i for i in range(400) if i % 7 == 3 and i % 11 == 5}
    assert archive_round_trip(pages.limit(0), str(tmp_path / "empty")).count() == 0


QUESTION = "If Mr Alice has 12 apples and gives 5 km of rope to Bob, how many apples does Alice have left for sale today?"


def test_decontamination_by_hand(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, None), (3, "short one"), (4, QUESTION + " One more sentence of the second item, after the same question.")], "item_id bigint, text string")
    docs = [(10, "Intro here. " + QUESTION.replace("Alice", "Carol").replace("12", "9,000.5").replace("5 km", "7mi").replace("Bob", "Dave") + " End."),
            (11, QUESTION.replace("Alice have", "Erin have").replace("Alice has", "Carol has")), (12, QUESTION.upper().lower()), (13, None), (14, ""), (15, "clean words of no matter " * 50),
            (16, "how many apples does he have left for sale"), (None, QUESTION), (17, QUESTION), (17, QUESTION)]
    found = contaminated(spark.createDataFrame([(a, b, "x") for a, b in docs], "doc_id bigint, text string, item string"), items).collect()
    assert Counter((r.doc_id, r.item_id, r.reparameterised) for r in found) == Counter(
        [(10, i, True) for i in (1, 4)] + [(d, i, False) for d in (None, 17, 17) for i in (1, 4)])
    assert contaminated(spark.createDataFrame([], "doc_id bigint, text string"), items).count() == 0
    assert contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_decontamination_is_native_and_whole(spark):
    df = QUERIES["op3_decontamination"](spark, FOLDER)
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    found = {(r.doc_id, r.item_id) for r in df.collect()}
    docs, items = (spark.read.parquet(f"{FOLDER}/{t}.parquet").collect() for t in ("documents", "benchmark"))
    tokens = {("d", d.doc_id): re.findall(r"[^\W\d_]+|\d+", (d.text or "").lower()) for d in docs} | {("b", b.item_id): re.findall(r"[^\W\d_]+|\d+", b.text.lower()) for b in items}
    windows = {b.item_id: {tuple(tokens["b", b.item_id][i:i + 13]) for i in range(len(tokens["b", b.item_id]) - 12)} for b in items}
    want = {(d.doc_id, i) for d in docs for i, w in windows.items() if w & {tuple(tokens["d", d.doc_id][k:k + 13]) for k in range(len(tokens["d", d.doc_id]) - 12)}}
    assert found == want and want


def test_codewords_are_apart():
    for n in (2, 4, 6, 9, 40):
        c = codewords(n)
        assert len(c) == n and min((c[i] != c[j]).sum() for i in range(n) for j in range(i)) >= (1 if n == 2 else 2)


def test_languages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in identify(docs, train(docs)).collect()}
    held = [d for d in docs.collect() if zlib.crc32(str(d.doc_id).encode()) % 5 == 0]
    assert all(got[d.doc_id].held_out for d in held) and sum(r.held_out for r in got.values()) == len(held)
    assert sum(got[d.doc_id].lang_pred == d.lang for d in held) / len(held) > 0.95
    odd = spark.createDataFrame([(1, None, "de"), (2, "", "de"), (3, "123 !? Ⅷ ²", "de"), (None, "and the of that with", None), (4, "und die der " * 20_000, None), (4, "x", "de")], "doc_id bigint, text string, lang string")
    rows = identify(odd, train(docs)).orderBy("doc_id").collect()
    assert [r.lang_pred for r in rows][1:4] == ["und"] * 3 and rows[0].lang_pred == "en" and len(rows) == 6
    assert all(0 <= r.score <= 1 for r in rows)
    nothing = train(docs.limit(0))
    assert {r.lang_pred for r in identify(odd, nothing).collect()} == {"und"} and identify(odd.limit(0), nothing).count() == 0
    # lang, source and id never decide
    assert {r.lang_pred for r in identify(docs.withColumnRenamed("lang", "score").limit(50).selectExpr("doc_id + 7 AS doc_id", "text"), train(docs)).collect()} <= {"de", "en", "es", "fr"}


def test_secrets(spark):
    rnd = random.Random(4)
    pool = ['password = "hunter22"', "Token:abc", "api_key=ABC.def-123", "passwd: \"x\"", "AKIA" + "Q7" * 9, "AKIA" + "Q" * 3, "0123456789abcdef" * 2, "ab" * 13, "deadbeef",
            "zX9q+Lk2/Vb7Rt4Yw1Pm8Nc3", "é😀 words", "3f2504e0-4f89-11d3-9a0c-0305e82c3301", "src_2024/path-to/file_17", "ſecret: kelvin"]
    docs = [(i, " ".join(rnd.choice(pool) for _ in range(rnd.randrange(12))), 1) for i in range(120)] + [(900, None, 1), (900, None, 1), (None, "token=abcdef", 1), (901, "word " * 30_000, 1)]
    rows = scan_secrets(spark.createDataFrame(docs, "doc_id bigint, text string, spans int")).collect()
    want = []
    for doc, text, _ in docs:
        text = text or ""
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.ASCII) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        want.append((doc, *(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    assert sorted(map(str, (tuple(r)[:5] for r in rows))) == sorted(map(str, want))
    token = "zX9q+Lk2/Vb7Rt4Yw1Pm8Nc3"
    added = sum(r.n_random for r in rows)
    assert added == sum((t or "").split(" ").count(token) for _, t, _ in docs) > 0
    assert known_form("3f2504e0-4f89-11d3-9a0c-0305e82c3301") and known_form("a" * 40) and known_form("src_2024/path-to/file_17") and not known_form(token)
    assert scan_secrets(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_warc_query_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{FOLDER}/pages.parquet'")
    want = con.execute(ORACLES["op1_warc_index"]).fetchall()
    assert sorted(map(str, map(tuple, QUERIES["op1_warc_index"](spark, FOLDER).collect()))) == sorted(map(str, want))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with a small corpus whose bad documents are known."""
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60").collect()]
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first().text
    docs += [(100, None, "en", "s", 0), (101, "1234 5678", "en", "s", 9), (102, docs[0][1], docs[0][2], "s", 1), (103, "Some other words stand here before it. " + item.replace("\n", " "), "en", "s", 1)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_pipeline(spark, corpus):
    from test_duplicates import expected_lines
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, corpus).cache()
        seen[name] = (before, {r.doc_id: r.text for r in docs.collect()})
        assert docs.columns == columns
        assert all(r.n_chars == len(r.text) for r in docs.collect()) or name == "language_id"
    before, after = seen["language_id"]
    assert set(before) - set(after) == {100, 101}
    before, after = seen["line_dedup"]
    want = expected_lines([(k, v, "") for k, v in before.items()])
    assert after == {k: v for k, v in want.items() if v == before[k] or v.strip()} and 102 not in after
    before, after = seen["simhash_dedup"]
    found = near_duplicates(spark.createDataFrame(list(before.items()), "doc_id bigint, text string")).collect()
    assert set(after) == {r.component_id for r in found}
    before, after = seen["decontaminate"]
    assert 103 in before and 103 not in after and len(after) > 40
    assert {r.doc_id for r in corpus_pipeline.run(spark, corpus).collect()} == set(after)


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))
    assert set(ORACLES) == {"op1_warc_index", "op13_collocations"} and corpus_pipeline.ORACLE_SQL is None


HEAVY = ["Compute 3 * 4 + 5 * 6 - 7 * 8 and give the result.", "A train goes 60 km in 2 h, then 90 km in 3 h, then 120 km in 5 h. Find its speed.",
         "Solve 3x + 5 = 20 and 2y - 7 = 9 for x and y.", "What is 12 + 7 * 3 - 45 / 9 + 18?"]


def test_items_full_of_numbers_are_found(spark):
    items = spark.createDataFrame(list(enumerate(HEAVY)), "item_id int, text string")
    changed = [re.sub(r"\d+", lambda m: str(int(m[0]) * 7 + 100), t) for t in HEAVY]
    docs = [(i, f"Some words before it. {t} And others after it.") for i, t in enumerate(HEAVY + changed)] + [(20, "1 2 3 4 5 6 7 8 9 10 " * 50), (21, "What is 13 + 7 * 3 - 45 / 9 + 18?")]
    found = contaminated(spark.createDataFrame(docs, "doc_id int, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in found if not r.reparameterised} == {(i, i) for i in range(4)}
    assert {(r.doc_id, r.item_id) for r in found if r.reparameterised} == {(4, 0), (5, 1), (6, 2)}  # without words left, only the same numbers tell


def test_case_and_line_breaks_hide_nothing(spark, tmp_path):
    copies = [QUESTION, QUESTION.lower(), QUESTION.upper(), QUESTION.replace(" ", "\n"), QUESTION.replace(" ", "  "), QUESTION.replace(" ", "\u00a0"), QUESTION.replace("Alice", "Carol").replace(" ", "\r\n")]
    docs = spark.createDataFrame([(i, f"Words before. {t} Words after.", "x") for i, t in enumerate(copies)] + [(50, "clean words of no matter " * 50, "x")], "doc_id bigint, text string, lang string")
    spark.createDataFrame([(1, QUESTION)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r.reparameterised for r in QUERIES["op3_decontamination"](spark, str(tmp_path)).collect()}
    assert found == {**dict.fromkeys(range(6), False), 6: True}
    assert [r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()] == [50]
