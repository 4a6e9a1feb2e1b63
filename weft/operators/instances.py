"""Matching of records that belong to concepts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions import strings as S
from weft.operators.selection import best_candidate

PAIR = ["src_id", "tgt_id"]


def statements(records: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """id, predicate, value: a record's columns as statements, without nulls."""
    parts = [F.struct(F.lit(c).alias("predicate"), F.col(c).cast("string").alias("value")) for c in columns]
    return records.select(F.col(id_col).alias("id"), F.explode(F.array(*parts)).alias("s")).select("id", "s.predicate", "s.value").filter("value IS NOT NULL")


def grouped(triples: DataFrame) -> DataFrame:
    """uri, props: a map from predicate to its values, for each subject."""
    values = triples.groupBy("id", "predicate").agg(F.sort_array(F.collect_set("value")).alias("v"))
    return values.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "v")))).alias("props"))


def candidates(source: DataFrame, target: DataFrame, key: str, kind: str | None = None) -> DataFrame:
    """Pairs whose keyword arrays share a word (and whose types are equal)."""
    a = source.select(F.col("id").alias("src_id"), F.explode(F.array_distinct(key)).alias("_k"), *([F.col(kind).alias("_t")] if kind else []))
    b = target.select(F.col("id").alias("tgt_id"), F.explode(F.array_distinct(key)).alias("_k"), *([F.col(kind).alias("_t")] if kind else []))
    return a.join(b, ["_k"] + ["_t"] * bool(kind)).select(*PAIR).distinct()


def label_score(label: Column, aliases: Column, other: Column, other_aliases: Column, measure=S.levenshtein_similarity) -> Column:
    """Similarity of the labels, averaged with the best alias pair where that is better."""
    own = measure(label, other)
    best = S.max_pairwise(aliases, other_aliases, measure)
    return F.when(best > own, (own + best) / 2).otherwise(own)


def normalised_by_best(scores: DataFrame) -> DataFrame:
    """Each matcher's scores over its greatest for the source."""
    top = scores.groupBy("matcher", "src_id").agg(F.max("similarity").alias("_t"))
    return scores.join(top, ["matcher", "src_id"]).select("matcher", *PAIR, F.when(F.col("_t") > 0, F.col("similarity") / F.col("_t")).otherwise(0.0).alias("similarity"))


def sole_candidate_bonus(sim: DataFrame, bonus: float = 0.2) -> DataFrame:
    """A source's only candidate gains the bonus, not above 1."""
    n = sim.groupBy("src_id").agg(F.count(F.lit(1)).alias("_n"))
    more = F.least(F.lit(1.0), F.col("similarity") + bonus)
    return sim.join(n, "src_id").select(*PAIR, F.when(F.col("_n") == 1, more).otherwise(F.col("similarity")).alias("similarity"))


def match_records(scores: DataFrame, weights: dict[str, float], threshold: float) -> DataFrame:
    """Scores normalised by matcher, combined, and the best candidate of each source above the threshold."""
    from weft.operators.combination import linear

    return best_candidate(linear(normalised_by_best(scores), weights), threshold)
