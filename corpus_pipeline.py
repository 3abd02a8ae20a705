"""A training corpus from raw documents: clean, deduplicate, decontaminate, mix, tokenise.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns documents
with their columns; the last returns what the token files hold of each document.

In every stage an empty table gives an empty result, extra columns stay whatever their names, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, mixing, ngram_jaccard, quality_rules, token_output
from textloom.llm.queries import table, vocabulary_path
from textloom.llm.store import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that the rules reject: null and empty texts too, as they have no words.

    A text that loses exactly the most it may stays; repeated rows go or stay alike."""
    return quality_rules.clean(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that of the least id; null and empty texts are in no group.

    Of rows of one id the one of the least text digest stays; rows of null id all stay."""
    return ngram_jaccard.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go; null and empty texts hold none. A document of exactly a twentieth of hit words goes."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, twice at most; null and empty texts are never taken.

    A null source is a source of its own; repeated rows share what the mix takes of them."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the token files; a null text is the end id alone, null ids come first, repeated rows stay."""
    return token_output.digests(docs, vocabulary_path())


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", decontaminated), ("source_mixing", mixture), ("token_output", tokens)]

#: Subset sums and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
