"""One query for each operator, over whole tables, and its SQL twin where SQL can say it."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sojourn.llm import codes, decontaminate, extraction, languages, manifest, minhash, oracles, packing, quality, scoring, similar, substrings, toxicity, warc
from sojourn.operators.staging import staged_table

QUERIES, ORACLES = {}, {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op2_parity_sketch_join", oracles.JACCARD)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.groups(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op7_relative_parse", oracles.REPEATS)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substrings.parse(docs).select("doc_id", "parsed.n_words", "parsed.n_removed", "parsed.kept_sha256")


@query("op8_wu_manber", oracles.LEAKS)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", *[f"match.{c}" for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_bin_slack_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op6_dictionary_warc", oracles.WARC)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.shared_folder(spark)
    archives = warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op9_family_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = languages.holdout(F.col("doc_id"), 5, 0)
    model = languages.learn(docs.filter(~held_out & F.col("doc_id").isNotNull()))
    found = languages.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), F.col("found.lang").alias("lang_pred"), F.col("found.score").alias("score"))


@query("op4_risk_controlled_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = staged_table(quality.measured(table(spark, sf_dir, "documents")))
    limits = quality.cutoffs(known, table(spark, sf_dir, "labels"))
    return quality.judge(known, limits).select(F.col("id").alias("doc_id"), *quality.COUNTS, "base_failed", "kept", "rule")


@query("op5_compression_toxicity")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = languages.holdout(F.col("doc_id"), 5, 0)
    model = toxicity.learn(docs.filter(~held_out & F.col("doc_id").isNotNull()), table(spark, sf_dir, "labels"))
    found = toxicity.score(docs, model, out="score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op1_log_bilinear_scoring")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = languages.holdout(F.col("doc_id"), 5, 1)
    found = scoring.score(docs, docs.filter(~held_out))
    return found.withColumn("held_out", held_out)


@query("op10_boosted_extraction")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = extraction.extract(pages.select("page_id", "url", "html"), extraction.learn(pages), out="text")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op11_sliced_codes", oracles.CODES)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.compress(table(spark, sf_dir, "embeddings"))


@query("op12_signature_join", oracles.NEAR)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op13_midstate_manifest", oracles.MANIFEST)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.translate("text", string.ascii_uppercase, string.ascii_lowercase)
    return manifest.verify(table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"],
                           changed=F.crc32(F.col("doc_id").cast("string")) % 3 == 0, changes={"text": text})
