"""The opN_ queries: each operator over the whole of its table, with production parameters."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import binary_output, byte_bpe, decontamination, language_id, licenses, lm_scoring, near_dedup, packing, prefix_trie, repair, secrets, spotsigs, token_rollup
from .common import fresh_path, table


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def op2_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_rollup.maintained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fresh_path(spark, "ledger"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))
    digest = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of = lambda kind: F.filter("secrets", lambda s: s.kind == kind)
    return found.select(
        "doc_id",
        *(F.size(of(k)).cast("long").alias(f"n_{k}") for k in secrets.KINDS if k != "markov"),
        F.sha2(digest(F.filter("secrets", lambda s: s.kind != "markov")).cast("binary"), 256).alias("base_sha256"),
        digest(F.col("secrets")).alias("spans"),
        F.size(of("markov")).cast("long").alias("n_markov"),
    )


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out(F.col("doc_id"))
    model = language_id.fit(docs.where(~held))
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op6_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.compared(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.scores(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    joined = {c: F.array_join(c, ",") for c in ("base_labels", "labels")}
    return found.withColumns(joined).drop("spans")


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output.packed_matrix(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.report(table(spark, sf_dir, "conversations"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (op1_near_dedup, op2_token_rollup, op3_secret_scan, op4_decontamination, op5_language_id, op6_spot_signatures, op7_packing, op8_lm_scoring, op9_license_scan, op10_binary_output, op11_prefix_trie, op12_repair, op13_byte_bpe)}
ORACLE_SQL: dict[str, str] = {"op2_token_rollup": token_rollup.ORACLE_SQL, "op4_decontamination": decontamination.ORACLE_SQL}
