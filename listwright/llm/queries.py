"""Every operator of this subpackage as a query over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from listwright.llm.chunk_dedup import passage_report
from listwright.llm.decontaminate import contamination
from listwright.llm.html_extract import extract_main_text
from listwright.llm.licenses import license_scan
from listwright.llm.near_dup import MinHash, near_duplicates
from listwright.llm.oracles import NEAR_DUPLICATES, PRODUCT_CODES
from listwright.llm.packing import packed_windows
from listwright.llm.privacy import Disclosure, personal_data
from listwright.llm.quality import quality_rules
from listwright.llm.retrieval_packing import retrieval_pack
from listwright.llm.shared import table
from listwright.llm.simhash_dup import simhash_duplicates
from listwright.llm.token_counts import token_counts
from listwright.llm.vector_codes import product_codes
from listwright.llm.whitening import whitened_embeddings


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"), Disclosure(everywhere=True))


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_report(table(spark, sf_dir, "documents"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), MinHash(words=3, percent=85))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval_pack(table(spark, sf_dir, "documents"), checksums=True)


def op7_packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows as they are trained on, ids and positions in full, and their checksums."""
    windows = packed_windows(table(spark, sf_dir, "documents"))
    return windows.withColumns({f"{c}_crc32": F.crc32(c) for c in ("ids", "positions")})


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(table(spark, sf_dir, "embeddings"))


def op12_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return product_codes(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_decontamination, op2_personal_data, op3_repeated_passages, op4_near_duplicates, op5_token_counts,
        op6_retrieval_packing, op7_packed_windows, op8_quality_rules, op9_license_scan, op10_main_text,
        op11_whitening, op12_simhash_duplicates, op13_vector_codes,
    )
}

#: DuckDB statements for the queries that SQL can express; the others are tested by brute force.
ORACLES: dict[str, str] = {"op4_near_duplicates": NEAR_DUPLICATES, "op13_vector_codes": PRODUCT_CODES}
