"""Headline queries on one data folder; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8).
"""

import json
import os
import time

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), *filter(None, [os.environ.get("PYTHONPATH")])])  # for the Python workers

from cataloom.operators.search import vector_topk
from cataloom.plans import load_all
from cataloom.plans.registry import QUERIES
from cataloom.session import local_session

HEADLINE = ["attribute_coverage", "enrich_catalog", "extract_attributes_v2", "balanced_queue", "build_lookup", "resolve_class",
            "stratified_split", "search_triplets", "bm25_search", "vector_topk", "staged_search", "search_metrics",
            "attribute_f1", "error_report", "route_tiers", "fields_to_route", "parse_model_output", "corrupt_mix",
            "augment_text", "keyword_join", "infer_from_text", "cost_summary", "latency_report", "failure_streaks",
            "score_correlation", "call_log_stream"]


def vector_topk_all_rows(spark, folder):
    """Every vector of the table as a query against all of them."""
    rows = spark.read.parquet(f"{folder}/embeddings.parquet")
    return vector_topk(rows.selectExpr("vec_id AS query_id", "embedding AS vector"), rows.selectExpr("vec_id AS product_id", "embedding AS vector"), 20)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    load_all()
    # start the executor threads, the Python workers and the code generator before any timing
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(1000).mapInPandas(lambda frames: frames, "id long").count()
    QUERIES["with_features"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name, query in {**{n: QUERIES[n] for n in HEADLINE}, "vector_topk_all_rows": vector_topk_all_rows}.items():
        start = time.perf_counter()
        query(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    products = spark.read.parquet(f"{folder}/part.parquet").count()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")), "enrich_products_per_sec": round(products / times["enrich_catalog"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
