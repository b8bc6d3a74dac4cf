"""The corpus pipeline: each stage reads what its predecessor kept, as a table with the columns of documents.

quality rules -> exact dedup -> n-gram Jaccard join -> mixing to target weights -> byte-level BPE.  The last stage returns, for
each reading of a document, doc_id, n_tokens, ids_sha256 and decoded_sha256.  The token budget of the mix is MIX_SHARE of what
reaches it, with one epoch at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from readlake.llm._shared import Scratch
from readlake.llm.bpe_tree import token_digests
from readlake.llm.exact_dedup import drop_copies
from readlake.llm.fertility import good_documents
from readlake.llm.jaccard import drop_near_copies
from readlake.llm.mixing import mixed_documents

MIX_SHARE = 0.8


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fertility rules keep; those without a text go."""
    return Scratch(spark).table(good_documents(docs), "good")  # written in batches of few rows, which bounds the memory beside Python


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the smallest doc_id; null doc_ids come last, null texts are equal to empty ones."""
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of linked documents: the one with the smallest doc_id, null ones last; null texts link with nothing."""
    return drop_near_copies(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents chosen to fill the weights of domains, languages and sources; null languages and sources are nodes of their own."""
    return mixed_documents(docs, share=MIX_SHARE, max_epochs=1.0)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, encoded and decoded; null texts have no tokens, null and repeated doc_ids pass on."""
    return Scratch(spark).table(token_digests(docs), "digests")


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_copies), ("n-gram Jaccard join", near_copies), ("mixing sources", mixture), ("byte-level BPE", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written before the next reads it."""
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{k}")
    return docs


#: The verdicts of tokenisers cannot be written in SQL.
ORACLE_SQL = None
