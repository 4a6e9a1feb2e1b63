"""What an ontology looks like: coverage, richness, and features for choosing matchers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.normalise import is_irrelevant
from weft.operators.structure import depths


def property_coverage(annotations: DataFrame, n_concepts: int | Column) -> DataFrame:
    """predicate, n, coverage: concepts with the annotation over all concepts; each concept once."""
    n = annotations.filter(~is_irrelevant(F.col("value"))).groupBy("predicate").agg(F.count_distinct("id").alias("n"))
    return n.withColumn("coverage", F.col("n") / n_concepts)


def hierarchy_metrics(edges: DataFrame) -> DataFrame:
    """One row: mean, least and most children of inner nodes, roots, leaves, nodes, greatest and mean depth."""
    d = depths(edges)
    up = edges.filter("parent IS NOT NULL").select("child", "parent").distinct()
    kids = up.groupBy("parent").agg(F.count(F.lit(1)).alias("k"))
    shape = kids.agg(F.avg("k").alias("avg_children"), F.min("k").alias("min_children"), F.max("k").alias("max_children"), F.count(F.lit(1)).alias("n_inner"))
    size = d.agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("depth") == 0).alias("n_roots"), F.max("depth").alias("max_depth"), F.avg("depth").alias("avg_depth"))
    return size.crossJoin(shape).withColumn("n_leaves", F.col("n_nodes") - F.col("n_inner"))


def label_metrics(concepts: DataFrame, text: str = "label") -> DataFrame:
    n = F.size(F.split(F.trim(F.col(text)), " +"))
    said = concepts.filter(~is_irrelevant(F.col(text)))
    return said.agg(F.avg(n).alias("avg_words"), F.min(n).alias("min_words"), F.max(n).alias("max_words"), F.avg(F.length(text)).alias("avg_length"))


def richness(concepts: DataFrame, edges: DataFrame, relations: DataFrame, attributes: DataFrame, instances: DataFrame) -> DataFrame:
    """Relationship, inheritance, attribute and class richness, population, and shares of missing labels and comments.

    relations: a row for each property between classes; attributes: a row for each
    property with literal values; instances: id, class_id.
    """
    n = concepts.agg(F.count(F.lit(1)).alias("c"), F.avg(is_irrelevant(F.col("label")).cast("double")).alias("null_label"), F.avg(is_irrelevant(F.col("comment")).cast("double")).alias("null_comment"))
    e = edges.filter("parent IS NOT NULL").agg(F.count(F.lit(1)).alias("h"))
    r = relations.agg(F.count(F.lit(1)).alias("r"))
    a = attributes.agg(F.count(F.lit(1)).alias("a"))
    i = instances.agg(F.count(F.lit(1)).alias("i"), F.count_distinct("class_id").alias("p"))
    all_ = n.crossJoin(e).crossJoin(r).crossJoin(a).crossJoin(i)
    ratio = lambda x, y: F.when(y > 0, x / y).otherwise(0.0)
    c, h = F.col("c"), F.col("h")
    return all_.select(
        ratio(F.col("r"), F.col("r") + h).alias("relationship_richness"),
        ratio(h, c).alias("inheritance_richness"),
        ratio(F.col("a"), c).alias("attribute_richness"),
        ratio(F.col("p"), c).alias("class_richness"),
        ratio(F.col("i"), c).alias("average_population"),
        "null_label",
        "null_comment",
    )


def compared(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean over the columns of the lesser over the greater of two one-row profiles; two zeros are alike."""
    names = [x for x in a.columns if x in b.columns]
    both = a.select(*(F.col(x).alias(f"a_{x}") for x in names)).crossJoin(b.select(*(F.col(x).alias(f"b_{x}") for x in names)))
    ratios = [F.when(F.greatest(f"a_{x}", f"b_{x}") > 0, F.least(f"a_{x}", f"b_{x}") / F.greatest(f"a_{x}", f"b_{x}")).otherwise(1.0) for x in names]
    return both.select((sum(ratios[1:], ratios[0]) / len(names)).alias("likeness"))


def couple_features(a: DataFrame, b: DataFrame) -> DataFrame:
    """The columns of two one-row profiles side by side."""
    return a.select(*(F.col(x).alias(f"src_{x}") for x in a.columns)).crossJoin(b.select(*(F.col(x).alias(f"tgt_{x}") for x in b.columns)))


def choose_configuration(features: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """The configuration of the nearest known profile; known: configuration and the same features, a short list."""
    apart = sum((F.pow(F.col(n) - F.col(f"k_{n}"), F.lit(2)) for n in names[1:]), F.pow(F.col(names[0]) - F.col(f"k_{names[0]}"), F.lit(2)))
    both = features.crossJoin(known.select("configuration", *(F.col(n).alias(f"k_{n}") for n in names)))
    return both.agg(F.min_by("configuration", F.struct(apart.alias("d"), F.col("configuration"))).alias("configuration"))
