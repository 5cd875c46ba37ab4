"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, idfile, langid, linededup, mixing, neardup, outliers, rollup, sharding
from .common import documents


def op1_telephony_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.telephony_digests(documents(spark, sf_dir))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.document_rollup(documents(spark, sf_dir)).totals()


def op3_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(documents(spark, sf_dir))


def op5_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digests(documents(spark, sf_dir))


def op6_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idfile.write_and_read(documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_digests(documents(spark, sf_dir))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), width=4)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_telephony_audio, op2_token_rollup, op3_language_crf, op4_outliers, op5_bpe_transducer, op6_id_files, op7_line_dedup, op8_near_duplicates, op9_mix_sources, op10_shards)}


def oracle_sql() -> dict[str, str]:
    return {"op7_line_dedup": linededup.ORACLE, "op9_mix_sources": mixing.ORACLE}
