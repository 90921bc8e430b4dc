"""The registered queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from hourcast.llm import bpe, exact_dedup, language, lm, mixing, near_dedup, periodic, quality, rules, secrets, sharding, simhash, spelling
from hourcast.llm.common import table


def _over_documents(f: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(spark, table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": _over_documents(secrets.op1_secret_scan),
    "op2_byte_cnn": _over_documents(language.op2_byte_cnn),
    "op3_trie_bpe": _over_documents(bpe.op3_trie_bpe),
    "op4_bottom_k": _over_documents(near_dedup.op4_bottom_k),
    "op5_random_indexing": lambda spark, sf_dir: quality.op5_random_indexing(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op6_kneser_ney": _over_documents(lm.op6_kneser_ney),
    "op7_exact_dedup": _over_documents(exact_dedup.op7_exact_dedup),
    "op8_simhash": _over_documents(simhash.op8_simhash),
    "op9_entropy_mix": _over_documents(mixing.op9_entropy_mix),
    "op10_bounded_ring": _over_documents(sharding.op10_bounded_ring),
    "op11_monotone_trees": lambda spark, sf_dir: rules.op11_monotone_trees(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_bit_sliced_variants": _over_documents(spelling.op12_bit_sliced_variants),
    "op13_periodic_runs": _over_documents(periodic.op13_periodic_runs),
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op4_bottom_k": near_dedup.ORACLE,
    "op6_kneser_ney": lm.ORACLE,
    "op7_exact_dedup": exact_dedup.ORACLE,
    **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {}),
}
