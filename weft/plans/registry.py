"""The queries of the matching engine and the SQL that must give the same rows.

Each group of queries is a module with a function that adds its queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.plans.inputs import Inputs, oracle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def add(name: str, build: Callable[[Inputs], DataFrame], sql: str | None = None, *ctes: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = oracle(sql.strip(), *ctes)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["O1_minimum_slice"](spark, sf_dir)


from weft.plans import query_evaluation, query_feedback, query_labels, query_matching, query_more, query_rest, query_sources, query_vectors  # noqa: E402

for module in (query_labels, query_matching, query_evaluation, query_feedback, query_vectors, query_sources, query_more, query_rest):
    module.register(add)
