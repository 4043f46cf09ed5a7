"""From raw documents to training pieces, in five stages.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. ``run`` writes every stage's rows
to the shared folder and reads them back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.llm import mixing, quality_crf, sentencepiece_nbest, simhash, substring_dedup
from ledgerwatch.llm.tables import column, free_name, read
from ledgerwatch.session import cut_lineage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_crf.keep_good(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id."""
    return simhash.one_of_each(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words go that a window of 13 words covers which an earlier document holds too; so do texts left without words."""
    n_words, n_removed = (F.col(free_name(docs, c)) for c in ("n_words", "n_removed"))
    cleaned = substring_dedup.remove_repeats(docs).where((n_removed == 0) | (n_removed < n_words))
    chars = F.coalesce(F.length("text").cast("bigint"), F.lit(0)).alias("n_chars")
    return cleaned.select(*[chars if c == "n_chars" else column(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources come near their target weights."""
    return mixing.mix(docs)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become pieces."""
    return sentencepiece_nbest.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("substrings", substrings),
    ("mixture", mixture),
    ("pieces", pieces),
]

ORACLE_SQL = None  # no stage but mixing and substrings has a counterpart in SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
