"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, best-fit packing.

Every stage takes an empty table, null ids, texts, languages and sources, repeated rows and extra columns (which pass
through all but the last); texts of any length are worked on whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import jaccard, lines, packing, quality
from tessera.llm.store import Workspace, shared_dir, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or lie beyond their group's fences go, null and empty texts among them; repeated rows are judged alike, ties at a fence stay."""
    return quality.keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines go, but for the first in order of doc_id (nulls first) and place; a document of nothing else goes with them. Rows equal in doc_id and text are one document."""
    return lines.without_repeats(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays (nulls last, then by text hash); rows equal in both stay once, texts without words are linked with nothing."""
    return jaccard.one_of_each(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed sequences of token ids in the shared folder, and where each document's tokens are in them; repeated rows are packed each, a null id is carried as it is."""
    import public_tokenizers as P

    return packing.op2_best_fit_packing(docs, P.path("byte_bpe_50k.tiktoken"), P.PATTERN, shared_dir(spark))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("ngram_jaccard", ngram_jaccard), ("best_fit_packing", best_fit_packing)]
#: Packing follows positions in shards and token ids, which SQL does not have; tests hold the first three stages against SQL and packing against the tokenizer and a plain search.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written and read again by the next."""
    ws, docs = Workspace(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = ws.save(docs, name)
    return docs
