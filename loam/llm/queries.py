"""The queries of this subpackage and, where SQL can say the same, their DuckDB SQL."""

from __future__ import annotations

from loam.llm import decontaminate, html_extract, line_dedup, lm_score, near_dedup, packing, quality, secret_scan, sharding, url_filter


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries():
    return {
        "op1_line_dedup": lambda s, d: line_dedup.dedup_lines(_read(s, d, "documents")),
        "op2_minhash_near_dedup": lambda s, d: near_dedup.dedup_pairs(_read(s, d, "documents")),
        "op3_secret_scan": lambda s, d: secret_scan.scan_secrets(_read(s, d, "documents")),
        "op4_lm_score": lambda s, d: lm_score.score_documents(_read(s, d, "documents"), _read(s, d, "documents").where("doc_id % 100 = 0")),
        "op5_decontamination": lambda s, d: decontaminate.find_leaks(_read(s, d, "documents"), _read(s, d, "benchmark")),
        "op6_url_filter": lambda s, d: url_filter.filter_urls(_read(s, d, "pages")),
        "url_filter_linked": lambda s, d: url_filter.filter_urls(url_filter.linked_pages(_read(s, d, "lineitem")), url_filter.LINKED_TRUSTED, url_filter.LINKED_BLOCKED),
        "op7_html_extract": lambda s, d: html_extract.extract_text(_read(s, d, "pages")),
        "op8_quality_rules": lambda s, d: quality.quality_ledger(_read(s, d, "documents")),
        "quality_ablation": lambda s, d: quality.quality_ablation(quality.quality_ledger(_read(s, d, "documents"))),
        "op9_packing": lambda s, d: packing.pack(_read(s, d, "documents")),
        "op10_sharding": lambda s, d: sharding.place_documents(_read(s, d, "documents")),
    }


def oracle_sql():
    return {
        "op1_line_dedup": line_dedup.DEDUP_SQL,
        "op6_url_filter": url_filter.FILTER_SQL,
        "url_filter_linked": url_filter.LINKED_SQL,
        "op7_html_extract": html_extract.EXTRACT_SQL,
        "op8_quality_rules": quality.LEDGER_SQL,
        "quality_ablation": quality.ABLATION_SQL,
        "op10_sharding": sharding.PLACEMENT_SQL,
    }
