"""The queries of this package by name, and the SQL of those that SQL can express."""

from tenderlake.llm import chat_format, collocations, fingerprints, license_scan, line_dedup, mixing, ngram_join, packing, quality, source_audit, substring_dedup, topk_search, toxicity

QUERIES = {
    f.__name__: f
    for f in (
        substring_dedup.op1_substring_dedup, fingerprints.op2_fingerprints, toxicity.op3_toxicity, packing.op4_packing, license_scan.op5_license_scan,
        line_dedup.op6_line_dedup, quality.op7_quality, mixing.op8_mixing, ngram_join.op9_ngram_join, topk_search.op10_topk_search,
        chat_format.op11_chat_format, collocations.op12_collocations, source_audit.op13_source_audit,
    )
}
SQL = {"op1_substring_dedup": substring_dedup.SQL, "op8_mixing": mixing.SQL, "op11_chat_format": chat_format.SQL, "op12_collocations": collocations.SQL, "op13_source_audit": source_audit.SQL}
