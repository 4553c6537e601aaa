"""A corpus pipeline: toxicity, near duplicates, repeated passages, source mix, tokens.

Each stage takes all that the one before kept, as written to Parquet and read again. The first four return documents with
the columns of ``documents``; the last returns tokens.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm.common import durable, release
from lexforge.llm.mixing import Policy, apply_mix
from lexforge.llm.ngram_jaccard import drop_near_duplicates
from lexforge.llm.queries import table, tokenizer_path
from lexforge.llm.sentencepiece_codec import encode_documents
from lexforge.llm.suffix_dedup import drop_repeats
from lexforge.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the labels outside fold 0, rejects are gone."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents tied by a similarity of 0.8 or more of their five-word shingles, the one with the smallest id stays."""
    return drop_near_duplicates(docs, n=5, threshold=Fraction(4, 5))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay at their first place alone; ``n_chars`` is the new length."""
    return drop_repeats(docs, least=50)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: a row for each copy."""
    return apply_mix(docs, Policy())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, with begin and end ids, and digests of them and of what they decode to."""
    return encode_documents(docs, tokenizer_path("piece_bpe_32k.model"), keys=("doc_id", "lang", "source"), with_ids=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("repeated_passages", repeated_passages), ("mixing", mixing), ("tokens", tokens)]

#: Training and encoding are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, durable(stage(spark, docs, sf_dir), f"stage-{name}")
        release(before)  # of the stage before; the table that was given is not written by us
    return STAGES[-1][1](spark, docs, sf_dir)
