"""The registered queries of this subpackage, and DuckDB SQL where it can express them."""

import corpus_pipeline
from storegrain.llm import align, bpe, chat, decontaminate, langid, line_dedup, near_dedup, passages, periodic, quality, secrets, topk, urls

QUERIES = {
    f.__name__: f
    for f in (
        bpe.op1_bpe_encoding,
        langid.op2_language_id,
        topk.op3_exact_topk,
        line_dedup.op4_line_dedup,
        chat.op5_chat_formatting,
        quality.op6_quality_classifier,
        urls.op7_url_filters,
        decontaminate.op8_benchmark_decontamination,
        near_dedup.op9_minhash_near_dedup,
        secrets.op10_secret_scans,
        align.op11_cross_tokenizer_alignment,
        periodic.op12_periodic_runs,
        passages.op13_suffix_array_dedup,
    )
} | {"pipeline": corpus_pipeline.run}
SQL = {
    "op3_exact_topk": topk.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_chat_formatting": chat.SQL,
    "op7_url_filters": urls.SQL,
    "op8_benchmark_decontamination": decontaminate.SQL,
}
