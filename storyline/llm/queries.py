"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm import (
    chat_windows, lang_ppm, line_templates, multi_index, periodic_runs, pii_crf, scaled_sketch, secret_forest,
    simhash_gray, stream_bpe, suffix_family, token_alignment, vector_packing,
)
from storyline.llm.common import read_table


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "\\### Assistant: </turn> ok"
    tricky = spark.createDataFrame(
        [(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string"
    )
    turns = read_table(spark, sf_dir, "conversations").select(*tricky.columns).unionByName(tricky)
    return chat_windows.read_back(chat_windows.windows(turns, VOCABULARY))


def op3_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_family.remove_repeats(read_table(spark, sf_dir, "documents"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_lang_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = lang_ppm.predict(docs, lang_ppm.train_on(docs), ["doc_id"])
    return found.select("doc_id", lang_ppm.held_out().alias("held_out"), "lang_pred", "score")


def op5_simhash_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_gray.near_components(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = vector_packing.pack_documents(read_table(spark, sf_dir, "documents"), VOCABULARY)
    return pieces.select(
        F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


def op7_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_recurring(read_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.col("text").alias("kept_text"))


def op8_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_bpe.round_trip(read_table(spark, sf_dir, "documents"), VOCABULARY).withColumnRenamed("id", "doc_id")


def op9_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.compare_with_edits(read_table(spark, sf_dir, "documents"))


def op10_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_forest.scan(read_table(spark, sf_dir, "documents")).drop("text_hash")


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with the words of every tenth document made to repeat.

    Of h, the CRC-32 of the decimal doc_id, a multiple of ten chooses the document, the
    rest the first repeated word and the period. Without an id or words nothing changes.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")

    def repeated(words):
        n = F.size(words)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        place = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        again = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, place(i)))
        return F.when(n > 0, F.array_join(again, " ")).otherwise("")

    words = F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    planted = F.transform(F.array(words), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every whole text as a count, the longest one and digests. A null or empty text has none;
    repeated ids keep their rows, an empty table gives no rows, other columns are not read."""
    found = periodic_runs.word_runs(with_planted_repeats(read_table(spark, sf_dir, "documents")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r.length).alias("less"), r.start.alias("start"), r.period.alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n")))
    found = found.withColumn("longest", longest)
    return found.select(
        F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), F.col("longest.start").alias("start"),
        (-F.col("longest.less")).alias("length"), F.col("longest.period").alias("period"),
        F.floor(F.expr("1000 * -longest.less div longest.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the patterns' spans, and all spans. A null or empty
    text has none; repeated rows stay, an empty table gives no rows, other columns are not read."""
    docs = read_table(spark, sf_dir, "documents")
    found = pii_crf.find(docs, pii_crf.train_on(docs))
    base = F.filter("spans", lambda s: s.base)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii_crf.KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of two tokenizers over every whole text, with corpus-wide counts. Null and empty texts
    have zeros; repeated rows count each, an empty table gives no rows, other columns are not read."""
    return token_alignment.align(read_table(spark, sf_dir, "documents"), VOCABULARY, PIECES).withColumnRenamed("id", "doc_id")


QUERIES = {
    "op1_multi_index": op1_multi_index,
    "op2_chat_windows": op2_chat_windows,
    "op3_suffix_family": op3_suffix_family,
    "op4_lang_ppm": op4_lang_ppm,
    "op5_simhash_gray": op5_simhash_gray,
    "op6_vector_packing": op6_vector_packing,
    "op7_line_templates": op7_line_templates,
    "op8_stream_bpe": op8_stream_bpe,
    "op9_scaled_sketch": op9_scaled_sketch,
    "op10_secret_forest": op10_secret_forest,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_pii_crf": op12_pii_crf,
    "op13_token_alignment": op13_token_alignment,
}
SQL: dict[str, str] = {"op7_line_templates": line_templates.SQL}
