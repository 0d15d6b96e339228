"""One query ``opN_<name>`` for each operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.llm import bpe, chat, concat_packing, media, ngram_join, oracles, packing, quality, runs, token_count, toxicity, url_filter, warc, whitening
from callweave.llm.common import SPACE, table


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def tokenizer_files() -> tuple[str, str, str]:
    """The rank file, the vocabulary file and the pattern of the 50k byte-level vocabulary."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_files())


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judged(table(spark, sf_dir, "documents"), [F.col("doc_id")])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts under the pieces and scores of a model file at hand, which was trained as a BPE one: read as a unigram vocabulary they show the method, and aren't that model's own counts."""
    return token_count.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.linked(table(spark, sf_dir, "conversations"))


def op11_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = concat_packing.packed(table(spark, sf_dir, "documents"), tokenizer_files())
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def with_periods(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` where the words of some documents, chosen by a checksum of the id, repeat from a word on."""
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"))
    split = hashed.select("*", F.when(F.col("h") % 10 == 0, F.expr(f"filter(split(text, '[{SPACE}]'), x -> x <> '')".replace("\\", "\\\\"))).alias("ws"))
    counted = split.select("*", F.size("ws").alias("n"), F.expr("h div 10").alias("g")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    period = counted.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    tail = "slice(flatten(array_repeat(slice(ws, a + 1, p), cast((n - a) div p + 1 as int))), 1, n - a)"
    return period.select("doc_id", F.when((F.col("h") % 10 == 0) & (F.col("n") > 0), F.expr(f"array_join(concat(slice(ws, 1, a), {tail}), ' ')")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.detected(with_periods(table(spark, sf_dir, "documents")))
    longest = F.expr("array_max(transform(runs, r -> struct(r.length as length, -r.start as start, -r.period as period)))")
    return found.withColumn("top", longest).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(F.expr(r"array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_url_filters": op2_url_filters,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_warc": op4_warc,
    "op5_toxicity": op5_toxicity,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_media_columns": op7_media_columns,
    "op8_quality_rules": op8_quality_rules,
    "op9_token_counts": op9_token_counts,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_concatenate_and_cut": op11_concatenate_and_cut,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL = {
    "op2_url_filters": oracles.url_filter_sql(),
    "op10_chat_formatting": oracles.CHAT,
    "op4_warc": oracles.WARC,
    "op8_quality_rules": oracles.quality_sql(),
}
