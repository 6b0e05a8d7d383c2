"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklens.llm import bpe, chat, decontaminate, exact_dedup, fim, html_text, lattice, near_dup, pii, quality, ranked, secrets, warc
from tracklens.llm.common import new_path, quoted, table
from tracklens.llm.oracles import ORACLES

#: A conversation whose texts hold control strings, their escapes and other templates' marks.
PROBE_ID, PROBE_TEXT = -7, r"\### Assistant: </turn> ok"


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.counts(pii.find(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], "base_sha256", "spans", "scores")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontaminate.digests(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_word", "match_item", "match_item_word")


def decontaminate_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.longest_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return led.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.passes("base")).alias("base_failed"), quality.passes("v1").alias("kept"), "failed",
    )


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablations(quality.ledger(table(spark, sf_dir, "documents"), keep=[]))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dup.near_duplicates(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", near_dup.hex_fingerprint().alias("fingerprint"), "component_id")


def op6_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.capture_digests(warc.assemble(warc.read_records(spark, path)))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, F.concat_ws("/", "source", "lang"), quoted("source"), keep=["doc_id"])
    return secrets.digests(found).select(
        "doc_id", *[f"n_{k}" for k in secrets.KINDS], "base_sha256", "spans", "n_live", "n_copied", "n_weak", "most_owners", "most_repos"
    )


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return chat.digests(chat.conversations(rows.unionByName(probe)))


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ranked.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return exact_dedup.deduplicate(docs, exact_dedup.temporary_index(spark, docs.schema["doc_id"].dataType.simpleString()), keep=["doc_id"])


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(fim.transform(table(spark, sf_dir, "documents"), keep=["doc_id"]), ["doc_id"])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_decontaminate, op3_quality_rules, op4_bpe, op5_simhash, op6_lattice, op7_html, op8_warc, op9_secrets, op10_chat, op11_ranked, op12_exact_dedup, op13_fim, quality_ablations, decontaminate_matches)
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
