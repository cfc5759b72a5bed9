"""The registered queries of the corpus operators, one for each, and DuckDB SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from docloom.llm import decontaminate, exact_dedup, jaccard_join, language_id, merkle, mixing, packing, pii, quality, secrets_scan, substring_dedup, toxicity, whitening
from docloom.llm.common import read_table
from docloom.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def op1_pii(spark, sf_dir):
    return pii.personal_data(read_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.severities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_quality(spark, sf_dir):
    return quality.qualities(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark, sf_dir):
    return decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_secrets(spark, sf_dir):
    return secrets_scan.secrets(read_table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark, sf_dir):
    return language_id.languages(read_table(spark, sf_dir, "documents"))


def op10_jaccard_join(spark, sf_dir):
    return jaccard_join.similar_components(read_table(spark, sf_dir, "documents"))


def op11_packing(spark, sf_dir):
    pieces = packing.pack(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op12_whitening(spark, sf_dir):
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_merkle(spark, sf_dir):
    return merkle.verified(merkle.manifest(read_table(spark, sf_dir, "documents")))


OPERATORS = (op1_pii, op2_toxicity, op3_quality, op4_exact_dedup, op5_decontaminate, op6_secrets, op7_mixing, op8_substring_dedup, op9_language_id, op10_jaccard_join, op11_packing, op12_whitening, op13_merkle)
QUERIES = {f.__name__: f for f in OPERATORS}
