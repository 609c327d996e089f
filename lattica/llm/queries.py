"""The registered queries: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, chat, decontaminate, licenses, lines, mixing, periodic, pii, quality, secret_scan, simhash, spotsigs, toxicity
from .common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds a copy of."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and its edited text, their likeness, and the document's class of near copies."""
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"), least=spotsigs.SIMILARITY)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, n_turns, copies, rendered of every maximal conversation."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, exact and near repeats dropped, and a digest of the kept text, of every document."""
    found = lines.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.col("_lines") - F.col("_exact") - F.col("_near")
    return found.select("doc_id", F.col("_lines").alias("n_lines"), kept.alias("n_kept"), F.col("_exact").alias("n_exact"), F.col("_near").alias("n_near"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op5_quality_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, weight, gumbel_key, selected of every document."""
    return quality.importance(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.labelled_texts(docs, table(spark, sf_dir, "labels")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return found.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op7_mixing_to_target_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, digest, license_id, notices of every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op10_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_entities, kinds, text with surrogates, of every document."""
    found = pii.replace(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("_kinds").alias("n_entities"), F.array_join("_kinds", ",").alias("kinds"), "text")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans of every document, counted and digested, and all spans with those of the randomness tests."""
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("_secrets", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("_secrets", lambda x: x["kind"] != "random")
    return found.select("doc_id", of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("_secrets")).alias("spans"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the most repeated run, and digests of all runs and of the collapsed text, of every document."""
    found = periodic.runs(periodic.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    listed = F.array_join(F.transform("_runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    found = found.withColumn("best", periodic.best(F.col("_runs"))).withColumn("n_runs", F.size("_runs").cast("bigint"))
    return found.select(
        "doc_id", "n_runs", "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"), F.sha2("_collapsed", 256).alias("collapsed_sha256"),
    )


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers in every document, and what the corpus says of its links."""
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    found = align.aligned(table(spark, sf_dir, "documents").select("doc_id", "text"), groups=digest)
    return found.withColumnRenamed("groups", "groups_sha256")


QUERIES = {
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op2_spotsigs": op2_spotsigs,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_line_dedup": op4_line_dedup,
    "op5_quality_importance": op5_quality_importance,
    "op6_toxicity": op6_toxicity,
    "op7_mixing_to_target_weights": op7_mixing_to_target_weights,
    "op8_simhash_near_dedup": op8_simhash_near_dedup,
    "op9_license_scan": op9_license_scan,
    "op10_pii_surrogates": op10_pii_surrogates,
    "op11_secret_scan": op11_secret_scan,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": chat.ORACLE,
    "op7_mixing_to_target_weights": mixing.ORACLE,
    "op9_license_scan": licenses.ORACLE,
    "op12_periodic_runs": periodic.ORACLE,
}
