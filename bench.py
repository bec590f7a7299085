"""Times the headline queries; prints one JSON line."""

import importlib.util
import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tenderlake.plans import catalog

QUERIES = ["j1_resolve_entities", "j9_tender_competition", "m5_rule_match", "m7_opportunity_score", "m9_radar", "m10_recommended", "a1_facet_counts", "a3_pipeline_summary", "a4_company_intelligence", "u1_upsert_overwrite", "u4_derive_submissions", "w6_status_changes", "h6_extract_pages", "j4_pair_delta", "m4_tfidf_best", "m7_stored_scores"]
LLM = ["op1_substring_dedup", "op2_fingerprints", "op3_toxicity", "op4_packing", "op5_license_scan", "op6_line_dedup", "op7_quality", "op8_mixing", "op9_ngram_join", "op10_topk_search", "op11_chat_format", "op12_collocations", "op13_source_audit"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    todo = {n: catalog.QUERIES[n] for n in QUERIES}
    if importlib.util.find_spec("tenderlake.llm"):
        from tenderlake.llm import catalog as llm

        todo |= {n: llm.QUERIES[n] for n in LLM}
    catalog.QUERIES[QUERIES[0]](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    took = {}
    for name, f in todo.items():
        began = time.time()
        f(spark, folder).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 2)
    print(json.dumps({"metric": "headline queries, wall time", "value": round(sum(took.values()), 2), "unit": "sec", "queries": took, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
