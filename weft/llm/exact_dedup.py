"""Exact dedup, with DataFrame functions only.

Texts are equal when they are identical after all ASCII white space is deleted.
Rows are grouped by a 128-bit hash of the normalised text *and* by the text
itself, so the grouping key compares bytes and a hash collision can't join two
texts. Partial aggregation leaves one row for each map task and text before the
shuffle, however many copies there are. Of a group the row with the most code
points stays, then the one with the smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keyed, stored, table, text_of, without

WHITE = "[ \\t-\\r]+"
#: Rank of a row within its group: code points first, then the id, as one number.
SPAN = "20000000000000000000"


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def _members(rows: DataFrame) -> DataFrame:
    """Each row with its group: rows has _id (long), _text and other columns, which stay.

    Returns these without the text, and _md5, _sha, group_size, keep_id and kept.
    """
    rest = [c for c in rows.columns if c != "_text"]
    rows = rows.select(*rest, F.length("_text").alias("_n"), normalised(F.col("_text")).alias("_norm"))
    top = F.lit("9223372036854775808").cast("decimal(38,0)")
    rank = F.col("_n").cast("decimal(18,0)") * F.lit(SPAN).cast("decimal(20,0)")
    rank = rank.cast("decimal(38,0)") + F.when(F.col("_id").isNull(), F.lit(0)).otherwise((top - F.col("_id").cast("decimal(19,0)")).cast("decimal(38,0)"))
    md5 = F.unhex(F.md5(F.col("_norm"))).alias("_md5")
    groups = (
        rows.select(md5, "_norm", rank.cast("decimal(38,0)").alias("_rank"))
        .groupBy("_md5", "_norm")
        .agg(F.count(F.lit(1)).alias("group_size"), F.max("_rank").alias("_best"))
    )
    span = f"cast({SPAN} as decimal(20,0))"
    left = F.expr(f"_best % {span}").cast("decimal(38,0)")
    groups = groups.select(
        "_md5",
        F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha"),
        "group_size",
        F.when(left > 0, (top - left).cast("long")).alias("keep_id"),
        F.expr(f"_best div {span}").alias("_most"),
    )
    members = rows.select(*rest, "_n", md5, F.unhex(F.sha2(F.col("_norm"), 256)).alias("_sha"))
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & (F.col("_n") == F.col("_most"))
    return members.join(groups, ["_md5", "_sha"]).select(*rest, "_md5", "_sha", "group_size", "keep_id", kept.alias("kept"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Group equal texts; one row out for each row in.

    Returns id, keep_id, group_size, kept, text_sha256. Ids are whole numbers (a string that
    isn't one is an error). Only the two named columns of docs are read, so others may
    have any name.

    - null text: an empty text; all texts without visible characters are equal
    - null id: the row counts in group_size, is kept only if the whole group has no
      id, and keep_id is then null
    - several rows with one id: all counted; of a group only those with the most code
      points are kept, which are several if they are equal in that
    - empty table: no rows
    """
    out = _members(docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")))
    return out.select(F.col("_id").alias(id_col), "keep_id", "group_size", "kept", F.lower(F.hex("_sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly one row of docs for each group of equal texts, with all its columns.

    It is the one that exact_dedup() keeps; of several such rows the first by file and
    place stays. Rows are told apart by their place, so null and repeated ids are no matter.
    """
    docs, key = keyed(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"), F.col(key).alias("_key"))
    found = stored(_members(rows).select("_key", "_md5", "_sha", "kept"), "copies")
    kept = found.filter("kept")
    first = kept.groupBy("_md5", "_sha").agg(F.min("_key").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    again = kept.join(first, ["_md5", "_sha"]).filter("_key <> _first").select("_key")
    return without(docs, key, found.filter("NOT kept").select("_key").unionByName(again))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(text) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
