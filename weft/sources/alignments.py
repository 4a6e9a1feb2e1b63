"""Files of correspondences, read and written as DataFrames."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["source", "target", "similarity", "relation", "provenance"]


def _valid(x: Column) -> Column:
    """A measure outside 0..1, or none, reads as 1."""
    return F.when((x >= 0) & (x <= 1), x).otherwise(1.0)


def _whole(df: DataFrame) -> DataFrame:
    have = {"relation": F.lit("="), "provenance": F.lit(None).cast("string"), "similarity": F.lit(1.0)}
    return df.select(*(F.col(c) if c in df.columns else have[c].alias(c) for c in COLUMNS))


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Alignment XML: one Cell for each correspondence, entities as resources."""
    schema = "entity1 struct<`_rdf:resource`:string>, entity2 struct<`_rdf:resource`:string>, measure string, relation string, provenance string"
    rows = spark.read.format("xml").option("rowTag", "Cell").schema(schema).load(path)
    return _whole(rows.select(F.col("entity1.`_rdf:resource`").alias("source"), F.col("entity2.`_rdf:resource`").alias("target"), _valid(F.col("measure").try_cast("double")).alias("similarity"), F.coalesce("relation", F.lit("=")).alias("relation"), "provenance"))


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Tab-separated files; columns names each place, "-" for one that isn't used."""
    parts = F.split("value", "\t")
    rows = spark.read.text(path).filter(F.size(parts) >= len(columns))
    rows = rows.select(*(F.trim(parts[i]).alias(c) for i, c in enumerate(columns) if c != "-"))
    return _whole(rows.withColumn("similarity", _valid(F.col("similarity").try_cast("double"))) if "similarity" in columns else rows)


#: The tabular layouts: pairs; with relation; with similarity; and two with a number first.
LAYOUTS = {
    "pairs": ["source", "target"],
    "relation": ["source", "relation", "target"],
    "scored": ["source", "relation", "target", "similarity"],
    "numbered-4": ["-", "source", "target", "-"],
    "numbered-5": ["-", "source", "-", "target", "-"],
}


def read_arrows(spark: SparkSession, path: str) -> DataFrame:
    """Lines like ``source ---> target similarity relation [provenance]``; other lines are skipped."""
    line = r"^(\S+)\s+-+>\s+(\S+)\s+([0-9.]+)\s+(\S+)\s*(.*)$"
    rows = spark.read.text(path).filter(F.col("value").rlike(line))
    part = lambda i: F.regexp_extract("value", line, i)
    return rows.select(part(1).alias("source"), part(2).alias("target"), _valid(part(3).try_cast("double")).alias("similarity"), part(4).alias("relation"), F.nullif(part(5), F.lit("")).alias("provenance"))


def read_three_tokens(spark: SparkSession, path: str, source_prefix: str) -> DataFrame:
    """``a relation b`` lines where either side may be the source: the one with the prefix is."""
    w = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.size(w) == 3).select(w[0].alias("a"), w[1].alias("r"), w[2].alias("b"))
    first = F.startswith(F.col("a"), F.lit(source_prefix))
    turned = F.when(F.col("r") == "<", ">").when(F.col("r") == ">", "<").otherwise(F.col("r"))
    return _whole(rows.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("target"), F.when(first, F.col("r")).otherwise(turned).alias("relation")))


def resolved(cells: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """Correspondences by node id; a cell that is written the other way round counts too. Concepts: id, uri."""
    a = source.select(F.col("uri").alias("_s"), F.col("id").alias("src_id"))
    b = target.select(F.col("uri").alias("_t"), F.col("id").alias("tgt_id"))
    both = cells.select(F.col("source").alias("_s"), F.col("target").alias("_t"), "similarity", "relation")
    turned = cells.select(F.col("target").alias("_s"), F.col("source").alias("_t"), "similarity", "relation")
    return both.unionByName(turned).join(a, "_s").join(b, "_t").select("src_id", "tgt_id", "similarity", "relation").distinct()


def by_either_uri(cells: DataFrame) -> DataFrame:
    """(uri, other): each correspondence under both its nodes."""
    return cells.select(F.col("source").alias("uri"), F.col("target").alias("other")).unionByName(cells.select(F.col("target").alias("uri"), F.col("source").alias("other")))


def as_cells(cells: DataFrame) -> DataFrame:
    """One XML Cell for each correspondence, as text."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    entity = lambda n, c: F.concat(F.lit(f'<entity{n} rdf:resource="'), escape(F.col(c)), F.lit('"/>'))
    said = F.concat(F.lit("<map><Cell>"), entity(1, "source"), entity(2, "target"), F.lit("<measure>"), F.col("similarity").cast("string"), F.lit("</measure><relation>"), escape(F.col("relation")), F.lit("</relation></Cell></map>"))
    return cells.select(said.alias("value"))


RDF_HEAD = '<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">'
RDF_FOOT = "</rdf:RDF>"


def well_formed(lines: DataFrame, head: str = RDF_HEAD, foot: str = RDF_FOOT) -> DataFrame:
    """The lines of each partition between a head and a foot, so that each part file is a document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"value": [head]})
        yield from batches
        yield pd.DataFrame({"value": [foot]})

    return lines.select("value").mapInPandas(run, "value string")


def write_cells(cells: DataFrame, path: str) -> None:
    """A folder of part files, each an alignment document with one map element on a line."""
    well_formed(as_cells(cells)).write.text(path)


def write_arrows(cells: DataFrame, path: str) -> None:
    said = F.concat_ws(" ", "source", F.lit("--->"), "target", F.col("similarity").cast("string"), "relation", F.coalesce("provenance", F.lit("")))
    cells.select(F.trim(said).alias("value")).write.text(path)


def write_table(cells: DataFrame, path: str) -> None:
    cells.select(F.concat_ws("\t", "source", "relation", "target", F.col("similarity").cast("string")).alias("value")).write.text(path)


def write_matrix(sim: DataFrame, path: str, threshold: float = 0.0) -> None:
    """The cells above a threshold as Parquet; sources that are near in order are near in the files."""
    sim.filter(F.col("similarity") > threshold).sortWithinPartitions("src_id", "tgt_id").write.parquet(path)
