"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.archives import archive_round_trip
from tablewright.llm.common import table
from tablewright.llm.decontamination import flag_contamination
from tablewright.llm.importance import bucket_counts, bucket_gains, importance_weights, resample
from tablewright.llm.linededup import drop_repeated_lines
from tablewright.llm.mainpage import extract_main_text
from tablewright.llm.merkle import merkle_manifest
from tablewright.llm.neardup import LEADER_ROUNDS, near_duplicate_classes
from tablewright.llm.oracles import IMPORTANCE, MERKLE, REPEATED_LINES
from tablewright.llm.packing import pack_documents
from tablewright.llm.pseudolikelihood import fit_window_network, score_pseudo_likelihood
from tablewright.llm.puquality import fit_quality, score_quality
from tablewright.llm.quality import judge, language_references, measure
from tablewright.llm.tokencounts import count_tokens
from tablewright.llm.toxicity import fit_toxicity, held_out, score_toxicity
from tablewright.session import scratch_path, stored

COUNTING_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
PACKING_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", "text")


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit_toxicity(docs, table(spark, folder, "labels"), ~held_out(5, 0))
    return score_toxicity(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted")


def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return count_tokens(documents(spark, folder), COUNTING_VOCABULARY).select("doc_id", "n_tokens", "best_score")


def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_classes(documents(spark, folder), rounds=LEADER_ROUNDS).drop("row")


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return extract_main_text(table(spark, folder, "pages").select("page_id", "url", "html"))


def op5_archives(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return archive_round_trip(pages, scratch_path(spark)).drop("url")


def op6_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    measured = stored(measure(docs).drop("text"))  # a text is read once; the rest needs a few numbers of each
    return judge(measured, language_references(measured)).drop("lang")


def op7_pu_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = fit_quality(docs, table(spark, folder, "labels"), ~held_out(3, 1))
    return score_quality(docs, model).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_curve_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), PACKING_VOCABULARY).drop("ids")


def op9_pseudo_likelihood(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return score_pseudo_likelihood(docs, fit_window_network(docs), keep_text=False)


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = flag_contamination(documents(spark, folder), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_importance(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    gains = bucket_gains(bucket_counts(docs), bucket_counts(table(spark, folder, "benchmark")))
    weighted = importance_weights(docs, gains).drop("text")
    return resample(weighted).select("doc_id", "n_features", "weight", "score", "rank")


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_lines(documents(spark, folder))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return merkle_manifest(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_main_text": op4_main_text,
    "op5_archives": op5_archives,
    "op6_divergence_rules": op6_divergence_rules,
    "op7_pu_quality": op7_pu_quality,
    "op8_curve_packing": op8_curve_packing,
    "op9_pseudo_likelihood": op9_pseudo_likelihood,
    "op10_decontamination": op10_decontamination,
    "op11_importance": op11_importance,
    "op12_line_dedup": op12_line_dedup,
    "op13_merkle_manifest": op13_merkle_manifest,
}

ORACLES: dict[str, str] = {
    "op11_importance": IMPORTANCE,
    "op12_line_dedup": REPEATED_LINES,
    "op13_merkle_manifest": MERKLE,
}
