"""Corpus pipeline: language ID, near-dedup, suffix-array dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of docs. ``run`` writes each stage's rows to the shared folder
and reads them again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, language, mixing, near_dedup, suffix_dedup
from lattica.llm.common import Scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: no text, no letter, or trigrams that no mixture of languages explains."""
    return language.identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity 0.8 or more."""
    return near_dedup.keep_one(docs, size=5, percent=80)


def strip_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte strings of 100 or more that occur earlier are cut; texts that this empties go."""
    return suffix_dedup.strip(docs, min_bytes=100)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut; documents that are mostly benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), window=10, coverage=0.8)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of docs with mix_epoch, mix_block and mix_position of each drawn row (with _ added where docs has the name)."""
    plain = docs.toDF(*(c if c in ("doc_id", "text", "source") else f"c{i}" for i, c in enumerate(docs.columns)))
    out = mixing.mix(plain)
    own = [F.col(p).alias(c) for p, c in zip(plain.columns, docs.columns, strict=True)]
    for c in ("epoch", "block", "position"):
        name = f"mix_{c}"
        while name in docs.columns:
            name += "_"
        own.append(F.col(f"__{c}").alias(name))
    return out.select(*own)


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_copies),
    ("suffix_dedup", strip_repeats),
    ("decontaminate", decontaminate_texts),
    ("mixing", mix_sources),
]

#: No stage before the last is expressible in SQL (EM, minima, byte strings, automaton).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
