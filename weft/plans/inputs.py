"""The relations that queries work on, made from the tables by SQL that both engines read.

Two ontologies come from `part`: one of names under their nouns, one of nouns with
types. Similarities of suppliers and parts come from `lineitem`, one matcher for
each return flag. Votes come from `events`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ONE = """
one_leaf AS (SELECT p_name AS label, split_part(p_name, ' ', 2) AS above, min(p_brand) AS comment FROM {part} GROUP BY p_name),
one_all AS (
  SELECT label, above, comment FROM one_leaf
  UNION ALL SELECT DISTINCT above, 'part', '' FROM one_leaf
  UNION ALL SELECT 'part', CAST(NULL AS STRING), ''
),
one AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS id, label, replace(label, ' ', '_') AS local_name, comment, above FROM one_all),
one_edges AS (SELECT c.id AS child, p.id AS parent FROM one c LEFT JOIN one p ON c.above = p.label)
"""
TWO = """
two_leaf AS (SELECT concat(split_part(p_name, ' ', 2), ' ', lower(p_type)) AS label, concat(split_part(p_name, ' ', 2), 's') AS above, min(p_brand) AS comment FROM {part} GROUP BY 1, 2),
two_all AS (
  SELECT label, above, comment FROM two_leaf
  UNION ALL SELECT DISTINCT above, 'parts', '' FROM two_leaf
  UNION ALL SELECT 'parts', CAST(NULL AS STRING), ''
),
two AS (SELECT CAST(row_number() OVER (ORDER BY label) - 1 AS BIGINT) AS id, label, replace(label, ' ', '') AS local_name, comment, above FROM two_all),
two_edges AS (SELECT c.id AS child, p.id AS parent FROM two c LEFT JOIN two p ON c.above = p.label)
"""
SIM = "sim AS (SELECT l_suppkey AS src_id, l_partkey AS tgt_id, avg(l_quantity) / 50 AS similarity FROM {lineitem} GROUP BY 1, 2)"
MATS = "mats AS (SELECT l_returnflag AS matcher, l_suppkey AS src_id, l_partkey AS tgt_id, avg(l_quantity) / 50 AS similarity FROM {lineitem} GROUP BY 1, 2, 3)"
REF = "ref AS (SELECT DISTINCT l_suppkey AS src_id, l_partkey AS tgt_id FROM {lineitem} WHERE l_discount >= 0.05)"
#: Similarities of all concept pairs: shared letters decide, so most cells are above 0.
CELLS = """
cells AS (SELECT one.id AS src_id, two.id AS tgt_id, round(greatest(0, 1 - levenshtein(one.label, two.label) / greatest(length(one.label), length(two.label))), 6) AS similarity FROM one CROSS JOIN two)
"""
VOTES = """
votes AS (SELECT user_id AS src_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS tgt_id, event_type IN ('purchase', 'signup', 'click') AS is_correct, value FROM {events}),
counts AS (SELECT src_id, tgt_id, count(CASE WHEN is_correct THEN 1 END) AS pos, count(CASE WHEN NOT is_correct THEN 1 END) AS neg, avg(value) / 500 AS similarity FROM votes GROUP BY 1, 2)
"""
TABLES = ["part", "lineitem", "events", "supplier", "customer", "nation", "region", "orders", "documents", "embeddings", "pages"]


class Inputs:
    """The relations over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def of(self, name: str, *ctes: str) -> DataFrame:
        text = ", ".join(ctes)
        used = {t: self.table(t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(f"WITH {text} SELECT * FROM {name}", **used)

    @property
    def one(self) -> DataFrame:
        return self.of("one", ONE).select("id", "label", "local_name", "comment", F.lit("").alias("see_also"), F.lit("").alias("is_defined_by"))

    @property
    def two(self) -> DataFrame:
        return self.of("two", TWO).select("id", "label", "local_name", "comment", F.lit("").alias("see_also"), F.lit("").alias("is_defined_by"))

    @property
    def one_edges(self) -> DataFrame:
        return self.of("one_edges", ONE)

    @property
    def two_edges(self) -> DataFrame:
        return self.of("two_edges", TWO)

    @property
    def sim(self) -> DataFrame:
        return self.of("sim", SIM)

    @property
    def mats(self) -> DataFrame:
        return self.of("mats", MATS)

    @property
    def ref(self) -> DataFrame:
        return self.of("ref", REF)

    @property
    def cells(self) -> DataFrame:
        return self.of("cells", ONE, TWO, CELLS)

    @property
    def votes(self) -> DataFrame:
        return self.of("votes", VOTES)

    @property
    def counts(self) -> DataFrame:
        return self.of("counts", VOTES)


def oracle(body: str, *ctes: str) -> str:
    """The same relations for the other engine, and a query over them."""
    text = ", ".join(ctes)
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    text = text.replace("get_json_object(", "json_extract_string(")
    for name in ("one", "two", "one_edges", "two_edges", "cells"):  # each is made once, however often it is joined
        text = re.sub(rf"(^|[\s,]){name} AS \(", rf"\1{name} AS MATERIALIZED (", text)
    return (f"WITH RECURSIVE {text}, {body[5:]}" if body.startswith("WITH ") else f"WITH {text} {body}") if text else body
