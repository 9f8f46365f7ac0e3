"""The eleven queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, linededup, mixing, neardup, pii, quality, tokens, toxicity, warc
from .common import table
from .oracle import ORACLE


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every license found in each whole document; one row per document."""
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda s: s["license"]))), ",")
    spans = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string"), F.format_number(s["coverage"], 4))), ",")
    return found.select("doc_id", "n_words", F.size("found").cast("long").alias("n_licenses"), names.alias("licenses"), spans.alias("spans"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in each document."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of each document."""
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calibrated toxicity score of each document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids written in the Simple-8b format and read back."""
    return tokens.read_tokens(tokens.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path()))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents freed of repeated three-line passages."""
    d = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", "text", "n_lines", "n_removed")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as monolithic archives, normalised, and read back by the index."""
    records = warc.read_records(warc.normalise(warc.write_monolithic(table(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality measures and verdict of each document."""
    return quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), ["doc_id"]).select("row.doc_id", *quality.MEASURES, "base_failed", "kept")


def op9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    m = mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"])
    return m.select("row.doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.size("shards") * F.col("size")).cast("long").alias("taken"), F.array_join(F.transform("shards", lambda x: x.cast("string")), ",").alias("shards"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of each document."""
    return neardup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontaminate, op3_pii, op4_toxicity, op5_tokens, op6_line_dedup, op7_warc, op8_quality, op9_mix, op10_near_dup)}

__all__ = ["ORACLE", "QUERIES", "tokenizer_path"]
