"""Registered queries of this folder, each over its whole table, and their reference SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@register("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from .tokens import count_tokens
    return count_tokens(_table(spark, folder, "documents"))


@register("op7_packing")
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    from .packing import pack
    return pack(_table(spark, folder, "documents"))


@register("op9_secrets")
def op9_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from .secretscan import scan_secrets
    return scan_secrets(_table(spark, folder, "documents")).drop("n_random")


@register("op8_language_id")
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    from .langid import identify, train
    docs = _table(spark, folder, "documents")
    return identify(docs, train(docs))


@register("op4_simhash")
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    from .simhash import near_duplicates
    return near_duplicates(_table(spark, folder, "documents"))


@register("op10_repeated_strings")
def op10_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    from .substrings import remove_repeats
    return remove_repeats(_table(spark, folder, "documents")).drop("kept")


@register("op5_line_dedup")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .lines import dedup_lines
    cleaned = dedup_lines(_table(spark, folder, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@register("op6_embedding_dedup")
def op6_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from .embeddings import near_vectors
    return near_vectors(_table(spark, folder, "embeddings"))


@register("op3_decontamination")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    from .decontaminate import contaminated
    return contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), literal=True)


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
m AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, p.n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN m.top IS NOT NULL AND m.top <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN m.top <> p.page_id THEN m.top END AS refers_to
FROM p LEFT JOIN m ON p.n >= 1000 AND p.d = m.d
"""


@register("op1_warc_index", WARC_SQL)
def op1_warc_index(spark: SparkSession, folder: str) -> DataFrame:
    from .warc import archive_round_trip
    return archive_round_trip(_table(spark, folder, "pages")).drop("payload")


@register("op11_bpe_round_trip")
def op11_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import functions as F

    from .backtrack import decode_ids, encode_texts
    both = decode_ids(encode_texts(_table(spark, folder, "documents")))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


COLLOCATIONS_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY 1),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 5) s(k))),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f AS a FROM f WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS head, array_to_string(w[cut + 1:], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS cut FROM cand)),
sc AS (SELECT c.lang, c.phrase, a, x.f AS l, y.f AS r, cut, (2000000::HUGEINT * a // (x.f::HUGEINT + y.f))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = head JOIN f y ON y.lang = c.lang AND y.phrase = rest),
worst AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, a FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM cand))),
longer AS (SELECT lang, phrase, max(a) AS a FROM inside GROUP BY 1, 2),
out AS (SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, l, r, n.n, score
  FROM worst w JOIN n USING (lang) LEFT JOIN longer x ON x.lang = w.lang AND x.phrase = w.phrase WHERE x.a IS NULL OR 100::HUGEINT * x.a < 80::HUGEINT * w.a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score FROM out WHERE rank <= 2000
"""


@register("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    from .collocations import collocations
    return collocations(_table(spark, folder, "documents"))


@register("op12_conversation_repair")
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    from .repair import damaged, repair_report
    conversations = _table(spark, folder, "conversations")
    return repair_report(conversations, damaged(conversations))
