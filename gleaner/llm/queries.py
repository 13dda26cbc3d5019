"""The registered queries of the training-data operators and their SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import (
    decontaminate,
    filter_audit,
    language_mixture,
    licenses,
    mixing,
    neardup,
    pii,
    pseudo_likelihood,
    quality,
    repeats,
    revisits,
    token_orc,
    whitening,
)
from gleaner.llm.common import table


def _op1(spark: SparkSession, sf: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(table(spark, sf, "documents"))


def _op2(spark: SparkSession, sf: str) -> DataFrame:
    return token_orc.tokenize_to_orc(table(spark, sf, "documents"))


def _op3(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan_licenses(licenses.document_files(table(spark, sf, "documents")))


def _op4(spark: SparkSession, sf: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def _op5(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, sf, "documents"))


def _op6(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf, "documents")).drop("kept")


def _op7(spark: SparkSession, sf: str) -> DataFrame:
    return pii.personal_data(table(spark, sf, "documents"))


def _op8(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf, "documents"), percent=85, width=3)


def _op9(spark: SparkSession, sf: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


def _op10(spark: SparkSession, sf: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.page_captures(table(spark, sf, "pages")))
    return found.withColumn("headers", revisits.header_lines(F.col("headers")))


def _op11(spark: SparkSession, sf: str) -> DataFrame:
    found = language_mixture.identify(table(spark, sf, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "languages")


def _op12(spark: SparkSession, sf: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf, "documents"), table(spark, sf, "labels"))


def _op13(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_masked_pll": _op1,
        "op2_orc_token_ids": _op2,
        "op3_license_scan": _op3,
        "op4_minhash_containment": _op4,
        "op5_mcd_quality": _op5,
        "op6_pfp_repeats": _op6,
        "op7_weak_pii": _op7,
        "op8_hyperminhash_dedup": _op8,
        "op9_sainte_lague_mix": _op9,
        "op10_revisit_resolution": _op10,
        "op11_language_mixture": _op11,
        "op12_filter_potential": _op12,
        "op13_multiplicity_whitening": _op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_license_scan": licenses.scan_sql(),
        "op4_minhash_containment": decontaminate.LEAKS_SQL,
        "op9_sainte_lague_mix": mixing.mix_sql(),
        "op10_revisit_resolution": revisits.CAPTURES_SQL,
        "op12_filter_potential": filter_audit.audit_sql(),
    }
