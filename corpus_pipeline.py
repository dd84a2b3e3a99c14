"""A training corpus from ``documents``: languages, quality, near copies, benchmark passages, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what it keeps. All of them
work on whole texts of any length, keep columns that they do not know (whatever their names) and give an empty
table for an empty one; each docstring says what becomes of nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strata.llm import byte_bpe, decontaminate, jaccard, language, quality
from strata.llm.common import discard, table, written
from strata.llm.queries import VOCABULARY


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the filters know; learned from the labelled rows among them.

    Null texts, empty ones and those without letters are of no language and go; rows with a null id or a null lang are
    judged by their text like others; a tie of languages changes nothing, as only the score decides; repeated rows
    all stay or all go; without any labelled row all go."""
    return language.keep_known(docs, language.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample, by importance for the texts labelled good; the share labelled bad goes.

    Null and empty texts have weight 0 and noise, as others; the noise of a null id is that of its name, so repeated
    rows, of ids or without, are ties and all stay or all go; ties at the edge stay; without labels all stay."""
    return quality.keep_sampled(docs, table(spark, sf_dir, "labels"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id.

    Null texts and those without words are copies of nothing and stay, as do rows with a null id; repeated rows are
    one; an id with several texts is decided text by text, in an order of their hashes."""
    return jaccard.keep_first(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their benchmark passages; those that are half passages go.

    Null and empty texts have no passage and stay as they are; rows with a null id are cut like others; passages that
    touch or overlap are cut as one; repeated rows are cut alike; n_chars is counted anew, null for a null text."""
    return decontaminate.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (unsigned 32-bit integers, little-endian) and decoded, their bytes.

    Null and empty texts have no ids and decode to nothing; a null id stays null; of pairs of one rank the leftmost is
    merged first; repeated rows give repeated rows. No other column is kept."""
    ranks = byte_bpe.read_ranks(public_tokenizers.path(VOCABULARY))
    return byte_bpe.decode(byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES = [
    ("language ID", known_language),
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte-level BPE", tokens),
]

#: Learned filters and samples are beyond SQL; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{i}")
        if 0 < i < len(STAGES) - 1:
            discard(before)
    return docs
