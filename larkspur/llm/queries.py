"""The registered queries of this subpackage: thin callers of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.functions.ship import ship
from larkspur.llm import langid, pii, quality, unigram
from larkspur.llm.align import alignments
from larkspur.llm.caps import near_duplicates
from larkspur.llm.copies import exact_copies
from larkspur.llm.divergence import divergences
from larkspur.llm.jaccard import jaccard_components
from larkspur.llm.oracles import ORACLES  # noqa: F401
from larkspur.llm.packing import pack_documents
from larkspur.llm.pivots import top_k
from larkspur.llm.runindex import remove_matches
from larkspur.llm.substring import remove_repeats


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op4_substring_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words removed because a 13-word window around them starts in an earlier document: one row per document."""
    return remove_repeats(documents(spark, sf_dir), window=13)


def op1_sentencepiece_unigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded to Unigram pieces and decoded again: counts and digests, one row per document."""
    return unigram.round_trips(documents(spark, sf_dir).select("doc_id", "text"), unigram.Model(tokenizer_path("piece_bpe_32k.model")))


def op2_pii_bootstrapped_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: seed spans by fixed patterns, more by contexts learned from them."""
    return pii.find(documents(spark, sf_dir).select("doc_id", "text"))


def op3_packing_swap_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens: one row per piece."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


def op8_ngram_jaccard_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets have Jaccard 0.85 or more."""
    return jaccard_components(documents(spark, sf_dir), n=4, num=85, den=100)


def op5_suffix_run_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed because a 100-byte string around them starts earlier in the corpus: one row per document."""
    return remove_matches(documents(spark, sf_dir), window=100)


def op6_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.fit(docs, labels.where(~langid.held_out()))
    return quality.score(docs.withColumn("held_out", langid.held_out()), model, keep=("held_out",))


def op7_topk_pivot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 other vectors of largest integer inner product for every 20th vector."""
    return top_k(embeddings(spark, sf_dir), every=20, k=20, scale=64.0)


def op9_embedding_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.9 or more between embeddings, and their components."""
    return near_duplicates(embeddings(spark, sf_dir), cos=0.9)


def op10_language_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the rows outside the held-out fold."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.predict(docs.select("doc_id", "text").withColumn("held_out", langid.held_out()), model, keep=("held_out",))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups and links of the tokens that two tokenizers give every document, with the documents that hold each linked pair."""
    return alignments(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each source's terms lie from those of the other sources of its language, and the terms that mark it."""
    return divergences(documents(spark, sf_dir), least_docs=3, top=200)


def op13_exact_dedup_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose texts are equal without white space, and the one that stays: one row per document."""
    return exact_copies(documents(spark, sf_dir))


_ALL = (op1_sentencepiece_unigram, op2_pii_bootstrapped_context, op3_packing_swap_search, op4_substring_recompression, op5_suffix_run_index, op6_quality_bradley_terry, op7_topk_pivot_table, op8_ngram_jaccard_product, op9_embedding_caps, op10_language_centroids, op11_tokenizer_alignment, op12_source_divergence, op13_exact_dedup_runs)
QUERIES = {f.__name__: f for f in _ALL}

