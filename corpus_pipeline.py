"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of ``documents``; the last returns packed pieces. Each stage uses whole texts, however long; all but the last pass
other columns through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from idloom.llm import language, minhash, packing, quality, substring
from idloom.llm.common import discard, fold_of, materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and that the calibrated isolation forest doesn't find anomalous.

    Null and empty texts have no words and go; repeated rows and rows without an id are judged by their texts; without
    usable labels only the base rules count."""
    forest = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, forest)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the random field knows, above the score that sets texts in one language apart from
    mixtures (calibrated on held-out rows).

    Null and empty texts and those without letters go; repeated rows and ties are decided alike; without labelled rows
    nothing has a language and everything goes."""
    model = language.fit(docs, docs.where(fold_of(F.col("doc_id"), 3) != 1))
    return language.keep_known_language(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least id.

    Null and empty texts and those without words stay; of repeated rows, of rows without an id and of several texts with
    one id, each is decided by its own text."""
    return minhash.drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once (every occurrence goes, words are joined by spaces).

    Null and empty texts and texts shorter than a window stay as they are; repeated rows are each other's repeats."""
    return substring.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, packed into sequences.

    A null or empty text is one piece with the end token; repeated rows are packed each for itself; a null id stays null."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality", quality_rules),
    ("language", known_language),
    ("near_duplicates", near_duplicates),
    ("substrings", repeated_passages),
    ("packing", packed),
]

#: SQL can't express the stages (a forest, a random field, a packing heuristic); tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
