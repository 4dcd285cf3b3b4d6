"""Queries of this subpackage and, where SQL can express them, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import class_lm, decontamination, exact_dedup, filter_audit, html_text, near_dedup, packing, ranked_search, repeated_strings, secret_scan, token_rollup, token_store, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_rollup": token_rollup.op1_token_rollup,
        "op2_token_store": token_store.op2_token_store,
        "op3_class_lm": class_lm.op3_class_lm,
        "op4_best_fit_packing": packing.op4_best_fit_packing,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_html_text": html_text.op7_html_text,
        "op8_repeated_strings": repeated_strings.op8_repeated_strings,
        "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
        "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_secret_scan": secret_scan.op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_token_rollup": token_rollup.SQL, "op5_exact_dedup": exact_dedup.SQL, "op11_filter_audit": filter_audit.SQL, "op12_ranked_search": ranked_search.SQL, "op13_secret_scan": secret_scan.SQL}
