"""Queries and SQL of this subpackage, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm import ann, bpe, html_extract, license_scan, line_dedup, minhash, packing, pipeline, quality_rules, substring_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_html_extract": html_extract.op2_html_extract,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_toxicity": toxicity.op4_toxicity,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_multiprobe_ann": ann.op6_multiprobe_ann,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_license_scan": license_scan.op10_license_scan,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    sql = {"op1_line_dedup": line_dedup.SQL, "op5_substring_dedup": substring_dedup.SQL, "op10_license_scan": license_scan.SQL}
    return sql | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
