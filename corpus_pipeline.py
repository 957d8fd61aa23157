"""A training-data pipeline: each stage takes the documents its predecessor kept and returns documents.

Stages: documents scored as toxic go; of each group of near-copies (five-word shingles, similarity 0.8 or more) one stays;
passages of 35 words that also stand in a document with a smaller id are cut, so each stays where it comes first; sources are
mixed to target weights, every source at least once through; the last stage encodes the mixed texts and decodes them again.
A document that the mix repeats is then repeated.

Rows that stand twice are near-copies of each other, and one stays, whether they have an id or not; documents without words
are no copies, and stay. Null texts stay null up to the last stage, which takes them as empty; columns that documents has
besides are carried along by all stages but the last; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkwell.llm import minhash, mixing, piece_bpe, substrings, toxicity
from inkwell.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substrings.cut_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    quotas = mixing.plan(cut(mixing.sizes(docs)))
    return mixing.realise(docs, quotas).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_and_decode(docs, piece_bpe.default_model())


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeated_passages),
    ("source mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training, hashing and merging can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
