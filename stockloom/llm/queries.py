"""The operators applied to the given tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm import (
    chat,
    decontam,
    graph_search,
    jaccard,
    langid,
    lexical,
    line_runs,
    packing,
    periodic,
    quality,
    repeats,
    secrets,
    sentences,
)
from stockloom.llm.oracle import ORACLES  # noqa: F401

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str = "doc_id"):
    """The remainder that separates rows to learn from (0, 1, 3) and held-out ones (2)."""
    return F.crc32(F.col(doc_id).cast("string")) % 4


def _held_out(scored: DataFrame) -> DataFrame:
    return scored.withColumn("held_out", F.coalesce(fold() == 2, F.lit(False)))


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"), 4, (85, 100))


def repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), 100).drop("kept")


def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = graph_search.usable(table(spark, sf_dir, "embeddings"))
    return graph_search.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(fold() != 2))
    found = _held_out(langid.predict(docs, model))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), 2048)


def sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.remove_repeated_sentences(table(spark, sf_dir, "documents"))


def chat_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; as rejected the same with the last reply of the next one."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    sides = turns.withColumn("chosen", F.lit(True)).unionByName(
        chat.with_other_replies(turns).withColumn("chosen", F.lit(False))
    )
    pairs = chat.preference_pairs(sides, F.col("conv_id"), F.col("chosen"))
    return pairs.withColumns(
        {side: chat.mask_text(F.col(side)) for side in ("chosen_mask", "rejected_mask")}
    )


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(table(spark, sf_dir, "documents"))


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.benchmark_matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    hit = decontam.hit_words()
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
        F.size("near_ids").cast("long").alias("n_near_items"),
    )


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    voters = quality.fit(docs, labels.where(fold() != 2))
    found = _held_out(quality.score(docs, voters, bar=0.7))
    return found.select("doc_id", "held_out", "score", "predicted")


def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.drop_frequent_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of 12 words or more; in a tenth of the documents periods are planted first."""
    planted = periodic.rewrite_words(table(spark, sf_dir, "documents"), periodic.planted_period)
    found = periodic.find_runs(planted, shortest=12)
    longest = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    start, length, period = -longest["start"], longest["length"], -longest["period"]
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        start.alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", length * 1000, period).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda line: F.concat(line, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_ngram_jaccard": ngram_jaccard_join,
    "op2_repeated_substrings": repeated_substrings,
    "op3_graph_nearest": nearest_vectors,
    "op4_language_id": language_id,
    "op5_best_fit_packing": best_fit_packing,
    "op6_sentence_dedup": sentence_dedup,
    "op7_chat_preferences": chat_preferences,
    "op8_secret_scan": secret_scan,
    "op9_decontaminate": decontaminate,
    "op10_quality": quality_scores,
    "op11_lexical_search": lexical_search,
    "op12_line_dedup": line_dedup,
    "op13_periodic_runs": periodic_runs,
}
