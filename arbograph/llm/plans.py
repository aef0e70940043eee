"""Queries of the problems p4, p5, p7, p8 and p9. SQL cannot express them, so there is none; the tests hold brute-force versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbograph.llm import confusables, docs, mix, parse, tokenize
from arbograph.runtime import stored, table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return docs.found(table(spark, d, "source_files"))


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    return docs.pairs(table(spark, d, "source_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return parse.bad_files(table(spark, d, "source_files"))


def p5_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return parse.verdicts(table(spark, d, "source_files"))


def p5_rates(spark: SparkSession, d: str) -> DataFrame:
    return parse.rates(table(spark, d, "source_files"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.token_ids(table(spark, d, "documents"))


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    return tokenize.round_trip(table(spark, d, "documents"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mix.shares(stored(mix.mixture(table(spark, d, "documents"), targets), "mix"), targets)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return confusables.look_alikes(table(spark, d, "documents"))


def p9_forms(spark: SparkSession, d: str) -> DataFrame:
    return confusables.forms(table(spark, d, "documents")).select("doc_id", "form")


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    return confusables.classes(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p4_found, p4_pairs, p5_found, p5_verdicts, p5_rates, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_forms, p9_classes)}
ORACLE: dict[str, str] = {}
