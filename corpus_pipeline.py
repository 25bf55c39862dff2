"""From raw documents to packed training sequences, in five stages, each over all that the stage before kept.

Each stage takes (spark, docs, sf_dir), docs with the columns of `documents`, and returns those columns; the last returns pieces of
sequences. `run` writes each stage's rows as Parquet and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.ship import ship
from larkspur.llm import langid, pii, spread
from larkspur.llm.jaccard import jaccard_components
from larkspur.llm.packing import pack_documents
from larkspur.llm.queries import tokenizer_path
from larkspur.llm.substring import remove_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known to one of the learned ones; texts without a letter and texts far from all languages go.
    Null and empty texts go, repeated rows stay or go alike, and an empty table gives an empty one."""
    ship(spark)
    model = langid.fit(docs.where(~langid.held_out()))
    rows = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    return langid.predict(rows, model, keep=("text", "row")).where("not rejected").select(*(c if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by five-word shingles with Jaccard 0.8 or more.
    Null texts and texts without words link with nothing and stay; an empty table gives an empty one."""
    ship(spark)
    groups = jaccard_components(docs, n=5, num=80, den=100)
    return docs.join(groups.where("doc_id = component_id").select("doc_id"), "doc_id", "left_semi").select(docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of 13-word windows that an earlier document holds; a text that loses words has single spaces between those kept.
    All rows stay, with null texts as empty ones where nothing is left; of equal texts that of the smallest id keeps its words. An empty table gives an empty one."""
    ship(spark)
    rows = docs.select("doc_id", "text", F.struct(*(c for c in docs.columns if c != "text")).alias("row"))
    out = remove_repeats(rows, window=13, texts=True, carry=("row",))
    size = F.when(F.col("n_removed") > 0, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    new = {"text": F.col("kept_text"), "n_chars": size}
    return out.select(*(new.get(c, F.col(f"row.{c}")).alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind. All rows stay; null texts stay null; an empty table gives an empty one."""
    return pii.mask(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 4096 tokens; a null or empty text is a piece of its end id; an empty table gives none."""
    ship(spark)
    return pack_documents(docs, tokenizer_path("word_bpe_49k.json"), max_tokens=4096, end_id=1)


STAGES = [("language", language), ("near_copies", near_copies), ("repeated_passages", repeated_passages), ("personal_data", personal_data), ("packing", packing)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the last stage makes of all of `documents`. What a stage wrote on its way is removed once its rows are written, and these
    once their successor's are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = None
    for name, stage in STAGES[:-1]:
        since = spread.written() if begun is None else begun
        docs = spread.kept(stage(spark, docs, sf_dir), f"stage-{name}")
        begun = spread.written() - 1
        spread.remove_written(spark, since, begun)
    return STAGES[-1][1](spark, docs, sf_dir)
