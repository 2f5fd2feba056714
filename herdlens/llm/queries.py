"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from herdlens.llm import common, decontaminate, language, middle, partenum, pieces, quality, suffixes, tokens, toxicity, urls, whitening, windows, winnowing
from herdlens.session import shared_folder


def op1_urls(spark: SparkSession, folder: str) -> DataFrame:
    pages = common.table(spark, folder, "pages").select("page_id", "url")
    model = urls.fit(urls.labelled(spark))
    return urls.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    stats = common.written(quality.with_statistics(docs).drop("text"), "quality")
    model = quality.fit(stats, common.table(spark, folder, "labels"))
    return quality.score(stats, model).select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.edit_likeness(common.table(spark, folder, "documents").select("doc_id", "text"))


def op4_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return partenum.join(common.table(spark, folder, "documents").select("doc_id", "text"), width=3, percent=90)


def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    made = pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))
    return made.select(
        "doc_id", F.size("ids").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "exact", F.transform("samples", lambda s: F.size(s["ids"])).alias("sample_pieces"),
        F.transform("samples", lambda s: F.xxhash64(s["ids"])).alias("sample_hashes"), "samples.log_prob", "samples.perturbed", "samples.inclusion",
    )


def op6_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))


def tokenizer_path(name: str) -> str:
    """Where the public tokenizers' files lie; the operators take any other path as well."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op7_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    path = shared_folder(spark, "tokens")
    tokens.write(docs, tokenizer_path("byte_bpe_50k.json"), path)
    return tokens.checksums(tokens.read(spark, path))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, common.table(spark, folder, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs)
    return language.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", common.held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected"
    )


def op10_suffixes(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.digests(common.table(spark, folder, "documents"))


def op11_middle(spark: SparkSession, folder: str) -> DataFrame:
    docs = common.table(spark, folder, "documents").select("doc_id", "text")
    made = middle.rearrange(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.original("output", "form"), 256).alias("restored_sha256"),
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(common.table(spark, folder, "embeddings").select("vec_id", "embedding"))


def op13_windows(spark: SparkSession, folder: str) -> DataFrame:
    return windows.digests(common.table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (op1_urls, op2_quality, op3_fingerprints, op4_jaccard, op5_pieces, op6_decontaminate, op7_tokens, op8_toxicity, op9_language, op10_suffixes, op11_middle, op12_whitening, op13_windows)}
SQL: dict[str, str] = {}
