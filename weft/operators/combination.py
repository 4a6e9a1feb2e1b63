"""Several matchers' similarities into one.

Input is one relation scores(matcher, src_id, tgt_id, similarity); weights is a dict
of plain numbers or a relation (matcher, weight) or per-node (matcher, src_id, weight).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.functions.strings import sigmoid

PAIR = ["src_id", "tgt_id"]


def weight_of(weights: dict[str, float]) -> Column:
    known = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(known[F.col("matcher")], F.lit(0.0))


def linear(scores: DataFrame, weights: dict[str, float], total: float | None = None) -> DataFrame:
    """Weighted mean over all matchers: a missing cell counts as 0 with its weight."""
    whole = float(sum(weights.values())) if total is None else total
    return scores.groupBy(*PAIR).agg((F.sum(weight_of(weights) * F.col("similarity")) / whole).alias("similarity"))


def sigmoid_mean(scores: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Weighted mean of sigmoids; a missing cell counts as the sigmoid of 0."""
    whole, rest = float(sum(weights.values())), sigmoid(F.lit(0.0))
    w = weight_of(weights)
    return scores.groupBy(*PAIR).agg(((F.sum(w * sigmoid(F.col("similarity"))) + (whole - F.sum(w)) * rest) / whole).alias("similarity"))


def extreme(scores: DataFrame, weights: dict[str, float], kind: str = "max") -> DataFrame:
    """The similarity whose weighted value is greatest (least); what is stored is the raw similarity."""
    key = F.struct((weight_of(weights) * F.col("similarity")).alias("w"), F.col("matcher"))
    pick = F.max_by if kind == "max" else F.min_by
    return scores.groupBy(*PAIR).agg(pick("similarity", key).alias("similarity"))


def node_weighted(scores: DataFrame, quality: DataFrame) -> DataFrame:
    """Weighted mean with a weight for each matcher and source node (a local quality).

    The denominator has all matchers' weights of the source, also those without a cell.
    """
    whole = quality.groupBy("src_id").agg(F.sum("weight").alias("_whole"))
    top = scores.join(quality, ["matcher", "src_id"]).groupBy(*PAIR).agg(F.sum(F.col("weight") * F.col("similarity")).alias("_top"))
    return top.join(whole, "src_id").select(*PAIR, F.when(F.col("_whole") > 0, F.col("_top") / F.col("_whole")).otherwise(0.0).alias("similarity"))


def signatures(scores: DataFrame, matchers: list[str]) -> DataFrame:
    """One row for each pair with a column for each matcher, 0 where it has no cell."""
    wide = scores.groupBy(*PAIR).pivot("matcher", matchers).agg(F.max("similarity"))
    return wide.na.fill(0.0, matchers)


def learned(scores: DataFrame, matchers: list[str], labelled: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Naive Bayes over the matchers' votes (similarity at or above the threshold), fitted on labelled pairs.

    labelled: src_id, tgt_id, is_match. What is gathered is a count for each matcher,
    vote and class. Returns the probability of a match as similarity.
    """
    wide = signatures(scores, matchers)
    votes = [(F.col(m) >= threshold).cast("int").alias(m) for m in matchers]
    train = wide.join(labelled, PAIR).select("is_match", *votes)
    row = train.agg(
        F.count_if(F.col("is_match")).alias("n1"),
        F.count_if(~F.col("is_match")).alias("n0"),
        *(F.count_if(F.col("is_match") & (F.col(m) == 1)).alias(f"{m}_1") for m in matchers),
        *(F.count_if(~F.col("is_match") & (F.col(m) == 1)).alias(f"{m}_0") for m in matchers),
    ).first()
    odds = F.lit(0.0) + F.log(F.lit((row.n1 + 1) / (row.n0 + 1)))
    for m in matchers:
        p1, p0 = (row[f"{m}_1"] + 1) / (row.n1 + 2), (row[f"{m}_0"] + 1) / (row.n0 + 2)
        odds = odds + F.when(F.col(m) >= threshold, F.log(F.lit(p1 / p0))).otherwise(F.log(F.lit((1 - p1) / (1 - p0))))
    return wide.select(*PAIR, (1 / (1 + F.exp(-odds))).alias("similarity"))
