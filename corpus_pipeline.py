"""From raw documents to token ids: the pipeline of the training-data operators.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over a stored
table; ``run`` writes each result to the shared folder and rereads it.  All
stages but the last return the columns of ``documents`` (with whatever further
columns the input has).

1. ``quality``: documents that the classifier scores below 0.7 go; none where
   the labels that are not held out lack one of the two values.
2. ``exact``: of texts equal but for white space one stays, the longest.
3. ``near``: of each group linked by 5-word shingles at a likeness of 0.8, one
   stays, that with the smallest doc_id.
4. ``mix``: each document as many times (0 to 3) as its source's target asks.
5. ``tokens``: (doc_id, ids), a row for each copy.

Null ids and texts pass as the operators define it; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hourcast.llm import bpe, exact_dedup, mixing, near_dedup, quality
from hourcast.llm.common import Scratch, table

STAGES = [
    ("quality", quality.stage),
    ("exact", exact_dedup.stage),
    ("near", near_dedup.stage),
    ("mix", mixing.stage),
    ("tokens", bpe.stage),
]

#: The classifier and the tokenizer are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    s = Scratch(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = s.keep(stage(spark, docs, sf_dir), name)
        if before:
            s.drop(before)
        before = name
    return docs
