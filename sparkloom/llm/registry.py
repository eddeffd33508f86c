"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language_id, quality, toxicity
from sparkloom.llm.bpe import bpe_decode, bpe_encode
from sparkloom.llm.conversation_trie import conversation_trie
from sparkloom.llm.decontaminate import contaminated
from sparkloom.llm.folds import held_out, learnable
from sparkloom.llm.html_extract import extract_text
from sparkloom.llm.jaccard_join import jaccard_components
from sparkloom.llm.mixing import mix_sources
from sparkloom.llm.near_vectors import near_vectors
from sparkloom.llm.oracles import ORACLES
from sparkloom.llm.spelling import spelling_variants, word_counts
from sparkloom.llm.substrings import substring_dedup
from sparkloom.llm.token_counts import count_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of each document; a token that crosses a boundary counts where it begins."""
    return count_tokens(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 3-word shingles have Jaccard 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), shingle=3, threshold="0.9")


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of vectors of equal label with cosine 0.98 or more."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document, those that repeated 20-word passages cover, and a digest of the rest."""
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of each document, of grades 0, 1 (toxic) and 2 (severe), learned from toxic labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.score(docs, toxicity.fit(docs, grade_col="toxic", labels=labels))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of each document by co-trained views of its text and of its metadata."""
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a test item of whose five-word shingles it holds 0.8 or more."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(learnable(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page and its code points."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that a mix by source weights 1, 2, 3 takes."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each whole text by a byte-level vocabulary, and the text that they decode to, as digests."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_decode(bpe_encode(table(spark, sf_dir, "documents"), path), path)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of conversations that begin with turns of every twentieth."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that are one edit apart, and the frequent form that each leads to."""
    return spelling_variants(word_counts(table(spark, sf_dir, "documents")))


__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_embedding_near_dedup": op3_embedding_near_dedup,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_language_id": op8_language_id,
    "op9_html_extraction": op9_html_extraction,
    "op10_mixing": op10_mixing,
    "op11_bpe": op11_bpe,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_spelling_variants": op13_spelling_variants,
}
