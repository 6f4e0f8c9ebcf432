"""The corpus operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from lakeshelf.llm import alignment, exact_dedup, filter_audit, flac, html_extract, language_id, ngram_join, packing, pieces, pii, quality, secret_scan, simhash
from lakeshelf.llm.common import table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

#: Of the registered query only; a real job passes its own secret.
PSEUDONYM_KEY = "registered-query"


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"), PIECES)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), PSEUDONYM_KEY)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORDS).drop("ids")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), PIECES))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digests(flac.decoded_media(flac.stored_media(table(spark, sf_dir, "documents"))))


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.summary(secret_scan.scan(table(spark, sf_dir, "documents")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTES, PIECES)


QUERIES = {"op12_alignment": op12_alignment, "op11_simhash": op11_simhash, "op13_filter_audit": op13_filter_audit, "op7_secrets": op7_secrets, "op10_quality": op10_quality, "op6_html_extract": op6_html_extract, "op3_media": op3_media, "op8_pieces": op8_pieces, "op1_ngram_join": op1_ngram_join, "op5_packing": op5_packing, "op9_pii": op9_pii, "op4_language_id": op4_language_id, "op2_exact_dedup": op2_exact_dedup}
ORACLE_SQL = {"op13_filter_audit": filter_audit.ORACLE_SQL, "op7_secrets": secret_scan.ORACLE_SQL, "op2_exact_dedup": exact_dedup.ORACLE_SQL}
