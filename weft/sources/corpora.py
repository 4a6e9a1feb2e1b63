"""Corpora, vocabularies, vectors, task files and place names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TASKS = "tasks array<struct<sourceOntology:string, targetOntology:string, matcher:struct<canonicalClassName:string>, selector:struct<canonicalClassName:string>, output:struct<filePath:string>>>"
#: The columns of a place-name dump, in order.
PLACES = "geonameid BIGINT, name STRING, asciiname STRING, alternatenames STRING, latitude DOUBLE, longitude DOUBLE, feature_class STRING, feature_code STRING, country_code STRING, cc2 STRING, admin1 STRING, admin2 STRING, admin3 STRING, admin4 STRING, population BIGINT, elevation INT, dem INT, timezone STRING, modification_date DATE"


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each task of batch files."""
    rows = spark.read.schema(TASKS).option("multiLine", True).json(path).select(F.posexplode("tasks").alias("place", "t"))
    return rows.select("place", F.col("t.sourceOntology").alias("source"), F.col("t.targetOntology").alias("target"), F.col("t.matcher.canonicalClassName").alias("matcher"), F.col("t.selector.canonicalClassName").alias("selector"), F.col("t.output.filePath").alias("output"))


def tasks_json(tasks: DataFrame) -> DataFrame:
    one = F.struct(F.col("source").alias("sourceOntology"), F.col("target").alias("targetOntology"), F.struct(F.col("matcher").alias("canonicalClassName")).alias("matcher"), F.struct(F.col("selector").alias("canonicalClassName")).alias("selector"), F.struct(F.col("output").alias("filePath")).alias("output"))
    return tasks.agg(F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("place", one.alias("t")))), lambda x: x["t"]).alias("tasks"))).alias("value"))


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=PLACES, quote="")


def tokenised(docs: DataFrame, text: str = "text", least: int = 10) -> DataFrame:
    """The documents of more than `least` tokens, as one line of tokens with single blanks."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    return docs.withColumn("tokens", words).filter(F.size("tokens") > least).withColumn("line", F.array_join("tokens", " "))


def html_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """A page's title and its text without scripts, styles and tags."""
    body = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", " ")
    bare = F.trim(F.regexp_replace(F.regexp_replace(body, "<[^>]*>", " "), r"\s+", " "))
    return pages.withColumn("title", F.trim(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))).withColumn("plain", bare)


def read_sgml(spark: SparkSession, path: str) -> DataFrame:
    """News files: id, kind, headline and text of each DOC element."""
    rows = spark.read.text(path, lineSep="</DOC>").filter(F.contains(F.col("value"), F.lit("<DOC")))
    part = lambda p: F.trim(F.regexp_replace(F.regexp_extract("value", p, 1), r"<[^>]*>|\s+", " "))
    return rows.select(F.regexp_extract("value", r'<DOC[^>]*\bid="([^"]*)"', 1).alias("id"), F.regexp_extract("value", r'<DOC[^>]*\btype="([^"]*)"', 1).alias("kind"), part(r"(?s)<HEADLINE>(.*?)</HEADLINE>").alias("headline"), part(r"(?s)<TEXT>(.*?)</TEXT>").alias("text"))


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.select(F.concat_ws(" ", "word", F.col("cnt").cast("string")).alias("value")).write.option("compression", "gzip").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    p = F.split("value", " ")
    return spark.read.text(path).filter(F.size(p) == 2).select(p[0].alias("word"), p[1].cast("long").alias("cnt"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """A word and its numbers on one line; the folder's size and dimension are what the reader finds."""
    vectors.select(F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value")).write.text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a word and numbers; a header of two numbers is skipped."""
    p = F.split(F.trim("value"), " +")
    return spark.read.text(path).filter(F.size(p) > 2).select(p[0].alias("word"), F.transform(F.slice(p, 2, F.size(p) - 1), lambda x: x.cast("double")).alias("vec"))
