"""Queries of the operators of this subpackage, and their SQL."""

from tessera.llm import chat, decontaminate, licenses, media, mixing, neardup, quality, secrets, sharding, substrings


def queries():
    return {
        "op1_license_scans": licenses.op1_license_scans,
        "op2_ngram_jaccard_join": neardup.op2_ngram_jaccard_join,
        "op3_suffix_array_dedup": substrings.op3_suffix_array_dedup,
        "op4_quality_classifier": quality.op4_quality_classifier,
        "op5_sharding": sharding.op5_sharding,
        "op6_benchmark_decontamination": decontaminate.op6_benchmark_decontamination,
        "op7_secret_scans": secrets.op7_secret_scans,
        "op8_chat_formatting": chat.op8_chat_formatting,
        "op9_media_columns": media.op9_media_columns,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql():
    return {
        "op1_license_scans": licenses.op1_sql(),
        "op6_benchmark_decontamination": decontaminate.op6_sql(),
        "op7_secret_scans": secrets.op7_sql(),
        "op10_mixing": mixing.op10_sql(),
    }
