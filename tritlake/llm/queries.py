"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op7_benchmark_decontamination
from .html_extract import op4_html_extraction
from .language_id import op8_language_id
from .matroska import op5_media_columns
from .mixing import OP9_SQL, op9_mix_sources
from .secret_scan import op10_secret_scan
from .simhash import op3_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .suffix_dedup import op2_suffix_array_dedup
from .token_counts import op6_token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_html_extraction": op4_html_extraction,
    "op5_media_columns": op5_media_columns,
    "op6_token_counts": op6_token_counts,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_mix_sources": op9_mix_sources,
    "op10_secret_scan": op10_secret_scan,
}
ORACLE_SQL: dict[str, str] = {"op9_mix_sources": OP9_SQL}
