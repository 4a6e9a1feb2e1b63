"""Synonym sets built from annotations and dictionaries."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions.normalise import separate_words


def is_synonym_property(name: Column) -> Column:
    low = F.lower(name)
    return F.contains(low, F.lit("label")) | F.contains(low, F.lit("synonym"))


def is_definition_property(name: Column) -> Column:
    return F.contains(F.lower(name), F.lit("definition"))


def ontology_lexicon(concepts: DataFrame, annotations: DataFrame) -> DataFrame:
    """id, form: a concept's local name and label and the values of its synonym properties, each once."""
    own = concepts.select("id", F.explode(F.array(separate_words(F.col("local_name")), F.col("label"))).alias("form"))
    more = annotations.filter(is_synonym_property(F.col("predicate"))).select("id", F.col("value").alias("form"))
    return own.unionByName(more).select("id", F.lower(F.trim("form")).alias("form")).filter("form <> ''").distinct()


def related_synsets(lexicon: DataFrame) -> DataFrame:
    """(id, related): concepts that share a form."""
    a, b = lexicon, lexicon.select(F.col("id").alias("related"), "form")
    return a.join(b, "form").filter("id <> related").select("id", "related").distinct()


def extended(lexicon: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """id, form: own and related forms, and forms with a term replaced by its synonym at word borders."""
    related = related_synsets(lexicon).join(lexicon.withColumnRenamed("id", "related"), "related").select("id", "form")
    out = lexicon.unionByName(related)
    if terms is not None:
        first = terms.select(F.split("term", " ")[0].alias("_w"), "term", "synonym")
        at = out.select("id", "form", F.explode(F.array_distinct(F.split("form", " "))).alias("_w")).join(first, "_w")  # forms that hold a term's first word
        swapped = at.select("id", F.regexp_replace("form", F.concat(F.lit(r"\b"), "term", F.lit(r"\b")), F.col("synonym")).alias("form"))
        out = out.unionByName(swapped)
    return out.distinct()


def dictionary_lexicon(lexicon: DataFrame, dictionary: DataFrame) -> DataFrame:
    """id, form: the dictionary's forms of each synset that a concept's form belongs to."""
    words = dictionary.select("synset", F.lower("form").alias("form"))
    found = lexicon.join(words, "form").select("id", "synset").distinct()
    return found.join(words, "synset").select("id", "form").unionByName(lexicon).distinct()


def term_synonym_kernel(a: str, b: str) -> tuple[str, str] | None:
    """The middles of two synonyms after the words that both begin and end with; None if one has no middle."""
    x, y = a.split(" "), b.split(" ")
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i] != y[i]), n)
    tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
    middle = " ".join(x[head : len(x) - tail]), " ".join(y[head : len(y) - tail])
    return middle if all(middle) and (head or tail) else None


@F.pandas_udf(T.StructType([T.StructField("term", T.StringType()), T.StructField("synonym", T.StringType())]))
def term_synonym(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    found = [term_synonym_kernel(x, y) or (None, None) for x, y in zip(a, b)]
    return pd.DataFrame(found, columns=["term", "synonym"], dtype="object")


def term_synonyms(lexicon: DataFrame) -> DataFrame:
    """(term, synonym) from the synonyms of each concept that differ in the middle only, the lesser first."""
    pairs = lexicon.join(lexicon.select("id", F.col("form").alias("other")), "id").filter("form < other")
    return pairs.select(term_synonym("form", "other").alias("t")).select("t.*").filter("term IS NOT NULL").distinct()


def lookup(lexicon: DataFrame, pattern: str) -> DataFrame:
    """The forms that a pattern is found in, whatever the case."""
    return lexicon.filter(F.col("form").rlike(f"(?i){pattern}"))
