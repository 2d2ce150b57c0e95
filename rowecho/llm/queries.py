"""The registered queries of the subpackage and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowecho.llm import (
    debruijn, decontam, exact_dedup, hard_negatives, langid, pieces, secrets, simhash, suffix_dedup, toxicity,
    vector_codes, warc, wrappers,
)

_QUERIES = (
    langid.op1_language_id, toxicity.op2_toxicity, exact_dedup.op3_exact_dedup, pieces.op4_sentencepiece,
    suffix_dedup.op5_suffix_dedup, secrets.op6_secret_scan, decontam.op7_decontamination,
    wrappers.op8_main_text, warc.op9_warc,
    simhash.op10_simhash_near_dedup, vector_codes.op11_vector_codes, hard_negatives.op12_hard_negatives,
    debruijn.op13_substring_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {fn.__name__: fn for fn in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return {"op3_exact_dedup": exact_dedup.SQL, "op7_decontamination": decontam.SQL,
            "op9_warc": warc.SQL, "op11_vector_codes": vector_codes.SQL, "op12_hard_negatives": hard_negatives.SQL,
            "op13_substring_dedup": debruijn.SQL}
