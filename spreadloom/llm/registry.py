"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, centroids, decontaminate, line_dedup, minhash, mixing, nearest, packing, substring_dedup, token_files, toxicity, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontaminate.query,
    "op2_url_filter": url_filter.query,
    "op3_minmax_hash_dedup": minhash.query,
    "op4_token_files": token_files.query,
    "op5_toxicity": toxicity.query,
    "op6_substring_dedup": substring_dedup.query,
    "op7_line_dedup": line_dedup.query,
    "op8_warc_round_trip": warc.query,
    "op9_balanced_lists": nearest.query,
    "op10_best_fit_packing": packing.query,
    "op11_centroid_clustering": centroids.query,
    "op12_entropy_mixing": mixing.query,
    "op13_token_alignment": alignment.query,
}
SQL: dict[str, str] = {"op2_url_filter": url_filter.SQL}
