"""The registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from outlay.llm import convrepair, decontaminate, exactdedup, fixity, kneserney, langid, linededup, minhash, mixing, oracles, periodicity, quality, tokencount, urlrules
from outlay.llm.common import materialise, read, split_words

# A public SentencePiece file; its pieces and whole-number scores serve as a unigram vocabulary.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), k=4)


def op1_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(read(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.score_corpus(read(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
    return urlrules.judge(read(spark, sf_dir, "pages"), spark.createDataFrame(rules, "host string, path string, verdict string"))


def op5_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC files against a replica of them with flipped, lost and added records."""
    payload, page = F.col("payload"), F.col("page_id")
    flipped = F.overlay("payload", F.lit("X").cast("binary"), F.lit(20))
    hashes = [fixity.hash_of(payload).alias("hash"), F.when(page % 101 == 7, fixity.hash_of(flipped)).alias("flipped")]
    hashed = fixity.warc_payloads(read(spark, sf_dir, "pages")).select("file", "page_id", fixity.size_of(payload).alias("size"), *hashes)
    records = materialise(fixity.with_offsets(hashed), "records")
    replica = records.where(page % 97 != 11).select("file", "offset", F.coalesce("flipped", "hash").alias("hash"))
    added = records.where(page % 499 == 3).select("file", (F.col("offset") + 1).alias("offset"), "hash")
    return fixity.audit(records, replica.union(added))


def op6_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return tokencount.count_tokens(read(spark, sf_dir, "documents"), tokencount.load_vocabulary(vocabulary))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = linededup.dedup_lines(read(spark, sf_dir, "documents"))
    return clean.select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdedup.exact_duplicates(read(spark, sf_dir, "documents"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with dropped, emptied, cut, repeated and mislabelled rows, chosen by a CRC-32."""
    place = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *place)) % 20
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convrepair.Repair(damaged(read(spark, sf_dir, "conversations"))).digests()


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``; every tenth text, by the CRC-32 of its id, repeats a piece of itself up to its end."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    split = docs.select("doc_id", "text", crc.alias("h"), split_words(F.coalesce("text", F.lit(""))).alias("w")).withColumn("n", F.size("w"))
    chosen = (F.col("h") % 10 == 0) & (F.col("n") > 0)
    placed = split.withColumn("a", F.when(chosen, F.expr("int((h div 10) % n)"))).withColumn("p", F.expr("int(1 + (n - a) div (3 + (h div 10) % 8))"))
    tail = "slice(flatten(array_repeat(slice(w, a + 1, p), int(1 + (n - a) div p))), 1, n - a)"
    return placed.select("doc_id", F.when(chosen, F.expr(f"array_join(concat(slice(w, 1, a), {tail}), ' ')")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.periodic_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    top = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        top.start.alias("start"),
        top.length.alias("length"),
        top.period.alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_temperature_mixing": op1_temperature_mixing,
    "op9_language_id": op9_language_id,
    "op2_quality_rules": op2_quality_rules,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_url_filters": op4_url_filters,
    "op5_warc_fixity": op5_warc_fixity,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": op7_line_dedup,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_exact_dedup": op13_exact_dedup,
}
ORACLES = {
    "op1_temperature_mixing": oracles.MIXING,
    "op2_quality_rules": oracles.QUALITY,
    "op4_url_filters": oracles.URL_RULES,
    "op5_warc_fixity": oracles.FIXITY,
    "op7_line_dedup": oracles.LINE_DEDUP,
    "op8_minhash_near_dedup": oracles.NEAR_DUPLICATES,
    "op10_benchmark_decontamination": oracles.DECONTAMINATION,
    "op11_conversation_repair": oracles.CONVERSATION_REPAIR,
    "op12_periodic_runs": oracles.PERIODIC_RUNS,
    "op13_exact_dedup": oracles.EXACT_DEDUP,
}
