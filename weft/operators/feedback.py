"""Users' votes on correspondences: what to ask, how to sum votes up, what they say about other pairs."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["src_id", "tgt_id"]


def votes(feedback: DataFrame) -> DataFrame:
    """src_id, tgt_id, pos, neg; feedback has a row for each vote (is_correct)."""
    return feedback.groupBy(*PAIR).agg(F.count_if(F.col("is_correct")).alias("pos"), F.count_if(~F.col("is_correct")).alias("neg"))


def decided(counts: DataFrame) -> DataFrame:
    """Pairs with a majority, as 1 or 0; tied pairs stay forbidden and are left out."""
    return counts.filter("pos <> neg").select(*PAIR, F.when(F.col("pos") > F.col("neg"), 1.0).otherwise(0.0).alias("similarity"))


def apply_votes(sim: DataFrame, counts: DataFrame) -> DataFrame:
    """The votes' outcome where there is one, the similarity elsewhere."""
    d = decided(counts).withColumnRenamed("similarity", "_d")
    return sim.join(d, PAIR, "full").select(*PAIR, F.coalesce("_d", "similarity").alias("similarity"))


def unvalidated(sim: DataFrame, counts: DataFrame) -> DataFrame:
    return sim.join(counts.select(*PAIR), PAIR, "left_anti")


def ranked(scored: DataFrame, by: str, k: int) -> DataFrame:
    """The k pairs most worth asking about, the first of equals first."""
    return scored.orderBy(F.desc(by), *PAIR).limit(k)


def best_head(lists: list[DataFrame], seen: DataFrame) -> DataFrame:
    """Of several rankings (src_id, tgt_id, similarity, rank) the head that is the most similar, above 0; of equals the first list's.

    A list's head is its first pair that nobody has judged yet. One row at most.
    """
    heads = None
    for place, one in enumerate(lists):
        head = one.join(seen.select(*PAIR), PAIR, "left_anti").orderBy("rank", *PAIR).limit(1).select(*PAIR, "similarity", F.lit(place).alias("list"))
        heads = head if heads is None else heads.unionByName(head)
    return heads.filter("similarity > 0").orderBy(F.desc("similarity"), "list").limit(1)


def quality_rank(cross: Column, definite: Column, alpha: float = 0.5, beta: float = 0.5) -> Column:
    return alpha * cross + beta * (1 - definite)


def revalidation_rank(consensus: Column, cross: Column, impact: Column) -> Column:
    return 0.4 * (1 - consensus) + 0.2 * cross + 0.4 * impact


def combined_rank(metrics: list[Column], how: str, weights: list[float] | None = None) -> Column:
    """max, min, avg or weighted sum of several metrics."""
    if how == "max":
        return F.greatest(*metrics)
    if how == "min":
        return F.least(*metrics)
    weights = [1 / len(metrics)] * len(metrics) if how == "avg" else weights
    return sum((w * m for w, m in zip(weights[1:], metrics[1:])), weights[0] * metrics[0])


def interleaved(lists: list[tuple[DataFrame, int]]) -> DataFrame:
    """Several rankings (src_id, tgt_id, rank from 1) in turns, each with a quota for each turn; a pair once."""
    out = None
    for place, (one, quota) in enumerate(lists):
        part = one.select(*PAIR, F.floor((F.col("rank") - 1) / quota).alias("turn"), F.lit(place).alias("place"), "rank")
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*PAIR).agg(F.min(F.struct("turn", "place", "rank")).alias("o")).select(*PAIR, "o.turn", "o.place", "o.rank")


def assigned(ranked_pairs: DataFrame, users: DataFrame, seen: DataFrame, each: int) -> DataFrame:
    """For each user the best pairs they haven't voted on; users is a short list, `each` the task size."""
    open_ = users.crossJoin(ranked_pairs).join(seen.select("user_id", *PAIR), ["user_id", *PAIR], "left_anti")
    w = W.partitionBy("user_id").orderBy("rank")
    return open_.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= each)


def oracle(pairs: DataFrame, reference: DataFrame) -> DataFrame:
    """Votes as the reference would give them."""
    known = reference.select(*PAIR).distinct().withColumn("_k", F.lit(True))
    return pairs.select(*PAIR).join(known, PAIR, "left").select(*PAIR, F.coalesce("_k", F.lit(False)).alias("is_correct"))


def noisy(answers: DataFrame, error: float, seed: int = 0) -> DataFrame:
    """Answers of which a share is flipped, the same pairs for the same seed."""
    flip = F.pmod(F.xxhash64(*PAIR, F.lit(seed)), F.lit(1_000_000)) < int(error * 1_000_000)
    return answers.select(*PAIR, (F.col("is_correct") != flip).alias("is_correct"))


def _distance(matchers: list[str]) -> Column:
    squares = [F.pow(F.col(f"c.{m}") - F.col(f"t.{m}"), F.lit(2)) for m in matchers]
    return F.sqrt(sum(squares[1:], squares[0]))


def nearest_labels(signatures: DataFrame, labelled: DataFrame, matchers: list[str], within: float) -> DataFrame:
    """For each pair the label of the nearest labelled signature within a distance; the smaller label of equals.

    Equal signatures are one on both sides. Both are put on a grid whose cells are as wide
    as the distance, and a labelled signature is looked for in its cell and the cells beside it: a
    join on the cell, whatever the number of labels.
    """
    train = labelled.groupBy(*matchers).agg(F.min("label").alias("label"))
    cell = [F.floor(F.col(m) / within) for m in matchers]
    near_cells = [F.array(*(c + o for c, o in zip(cell, step))) for step in itertools.product((-1, 0, 1), repeat=len(matchers))]
    train = train.withColumn("_cell", F.explode(F.array(*near_cells))).alias("t")
    distinct = signatures.select(*matchers).distinct().withColumn("_cell", F.array(*cell)).alias("c")
    near = distinct.join(train, F.col("c._cell") == F.col("t._cell")).withColumn("d", _distance(matchers)).filter(F.col("d") <= within)
    best = near.groupBy(*(F.col(f"c.{m}").alias(m) for m in matchers)).agg(F.min(F.struct("d", "label")).alias("b"))
    return signatures.join(best, matchers).select(*PAIR, F.col("b.label").alias("label"), F.col("b.d").alias("distance"))


def euclidean_propagation(sim: DataFrame, near: DataFrame) -> DataFrame:
    """The nearest label as the new similarity."""
    return sim.join(near, PAIR, "left").select(*PAIR, F.coalesce(F.col("label").cast("double"), "similarity").alias("similarity"))


def log_propagation(sim: DataFrame, near: DataFrame, scale: float = 1.2) -> DataFrame:
    """Similarity plus (label 1) or minus (label 0) the scaled logarithm of 2 - distance, kept in 0..1."""
    step = scale * F.log(2 - F.col("distance"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity") + F.when(F.col("label") == 1, step).otherwise(-step)))
    return sim.join(near, PAIR, "left").select(*PAIR, F.when(F.col("label").isNotNull(), moved).otherwise(F.col("similarity")).alias("similarity"))


def quality_propagation(sim: DataFrame, near: DataFrame, train_quality: Column, map_quality: Column) -> DataFrame:
    """Similarity moved by train_quality * (1 - map_quality / 2) towards the label, kept in 0..1; label 1 or 0."""
    sign = F.when(F.col("label") == 1, 1).otherwise(-1)
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("similarity") + train_quality * (1 - map_quality / 2) * sign))
    return sim.join(near, PAIR, "left").select(*PAIR, F.when(F.col("label").isNotNull(), moved).otherwise(F.col("similarity")).alias("similarity"))


def regression(signatures: DataFrame, labelled: DataFrame, matchers: list[str], ridge: float = 1e-6) -> DataFrame:
    """Linear regression of the labels on the signatures; its value, kept in 0..1, is the new similarity.

    What is gathered is the normal equations: one sum for each two columns.
    """
    x = [F.lit(1.0), *(F.col(m) for m in matchers)]
    n = len(x)
    sums = labelled.agg(*(F.coalesce(F.sum(x[i] * x[j]), F.lit(0.0)).alias(f"a{i}_{j}") for i in range(n) for j in range(n)), *(F.coalesce(F.sum(x[i] * F.col("label")), F.lit(0.0)).alias(f"b{i}") for i in range(n))).first()
    a = np.array([[sums[f"a{i}_{j}"] for j in range(n)] for i in range(n)]) + ridge * np.eye(n)
    w = np.linalg.solve(a, np.array([sums[f"b{i}"] for i in range(n)])).tolist()
    value = sum((c * k for c, k in zip(x[1:], w[1:])), F.lit(w[0]))
    return signatures.select(*PAIR, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)).alias("similarity"))


def exact_propagation(sim: DataFrame, signatures: DataFrame, labelled: DataFrame, matchers: list[str]) -> DataFrame:
    """Pairs with the very signature of a labelled pair get its label; cells that compete with a confirmed one get 0."""
    label = labelled.groupBy(*matchers).agg(F.min("label").alias("label"))
    same = signatures.join(label, matchers).select(*PAIR, "label")
    yes = labelled.filter("label = 1")
    rows, columns = yes.select("src_id").distinct().withColumn("_r", F.lit(True)), yes.select("tgt_id").distinct().withColumn("_c", F.lit(True))
    own = yes.select(*PAIR).withColumn("_own", F.lit(True))
    out = sim.join(same, PAIR, "left").join(rows, "src_id", "left").join(columns, "tgt_id", "left").join(own, PAIR, "left")
    value = F.when(F.col("_own"), 1.0).when(F.col("_r") | F.col("_c"), 0.0).otherwise(F.coalesce(F.col("label").cast("double"), "similarity"))
    return out.select(*PAIR, value.alias("similarity"))


def cluster_boost(sim: DataFrame, cluster: DataFrame, is_correct: bool, share: float = 0.1) -> DataFrame:
    """(1 - share) * sim, plus share for a confirmed cluster, over the cluster's cells."""
    inside = cluster.select(*PAIR).distinct().withColumn("_in", F.lit(True))
    moved = (1 - share) * F.col("similarity") + (share if is_correct else 0.0)
    return sim.join(inside, PAIR, "left").select(*PAIR, F.when(F.col("_in"), moved).otherwise(F.col("similarity")).alias("similarity"))


def threshold_cluster(scores: DataFrame, seed: dict[str, float], band: float) -> DataFrame:
    """Pairs whose similarity by every matcher is within a band around the seed's; missing ones count as 0."""
    centre = F.create_map(*(F.lit(x) for pair in seed.items() for x in pair))
    inside = F.abs(F.col("similarity") - centre[F.col("matcher")]) <= band
    near = scores.filter(F.col("matcher").isin(list(seed)))
    counts = near.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("k"), F.collect_set("matcher").alias("have"))
    zero = [m for m, v in seed.items() if abs(v) <= band]
    lacking = F.size(F.filter(F.lit(list(seed)), lambda m: ~F.array_contains("have", m) & ~m.isin(zero) if zero else ~F.array_contains("have", m)))
    return counts.filter((F.col("k") == F.col("n")) & (lacking == 0)).select(*PAIR)


def sibling_extrapolation(sim: DataFrame, confirmed: DataFrame, src_siblings: DataFrame, tgt_siblings: DataFrame, gap: float = 0.01) -> DataFrame:
    """Sibling pairs of a confirmed pair with nearly its similarity become 1."""
    centre = confirmed.select(*PAIR).join(sim, PAIR).withColumnRenamed("similarity", "_c")
    near = centre.join(src_siblings.select(F.col("node").alias("src_id"), F.col("sibling").alias("s2")), "src_id").join(tgt_siblings.select(F.col("node").alias("tgt_id"), F.col("sibling").alias("t2")), "tgt_id")
    near = near.select(F.col("s2").alias("src_id"), F.col("t2").alias("tgt_id"), "_c").join(sim, PAIR).filter(F.abs(F.col("similarity") - F.col("_c")) <= gap).select(*PAIR).distinct()
    hit = near.unionByName(confirmed.select(*PAIR)).distinct().withColumn("_hit", F.lit(True))
    return sim.join(hit, PAIR, "left").select(*PAIR, F.when(F.col("_hit"), 1.0).otherwise(F.col("similarity")).alias("similarity"))


def centroid_clusters(signatures: DataFrame, matchers: list[str], k: int, rounds: int = 5) -> DataFrame:
    """k clusters of signatures by Lloyd's rounds; centres begin at evenly spaced points of the unit diagonal.

    What is gathered in a round is k centres. Returns src_id, tgt_id, cluster.
    """
    centres = [[(i + 0.5) / k] * len(matchers) for i in range(k)]

    def placed(df: DataFrame) -> DataFrame:
        far = [sum((F.pow(F.col(m) - c, F.lit(2)) for m, c in zip(matchers[1:], centre[1:])), F.pow(F.col(matchers[0]) - centre[0], F.lit(2))) for centre in centres]
        best = F.array_min(F.array(*(F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(far))))
        return df.withColumn("cluster", best["i"])

    for _ in range(rounds):
        for row in placed(signatures).groupBy("cluster").agg(*(F.avg(m).alias(m) for m in matchers)).collect():
            centres[row.cluster] = [row[m] for m in matchers]
    return placed(signatures).select(*PAIR, "cluster")


def concept_relevance(edges: DataFrame) -> DataFrame:
    """node, specificity (depth over greatest depth) and familial relevance (children plus siblings)."""
    from weft.operators.candidates import siblings
    from weft.operators.structure import depths

    d = depths(edges)
    top = d.agg(F.max("depth").alias("_m"))
    kids = edges.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count_distinct("child").alias("kids"))
    near = siblings(edges).groupBy("node").agg(F.count(F.lit(1)).alias("near"))
    both = d.crossJoin(F.broadcast(top)).join(kids, "node", "left").join(near, "node", "left")
    return both.select("node", F.when(F.col("_m") > 0, F.col("depth") / F.col("_m")).otherwise(0.0).alias("specificity"), (F.coalesce("kids", F.lit(0)) + F.coalesce("near", F.lit(0))).alias("family"))


def loop(sim: DataFrame, reference: DataFrame, rounds: int, each: int) -> list[dict[str, float]]:
    """Ask for the least definite unvalidated pairs, take the reference's answers, sum up, evaluate; again."""
    from weft.operators.evaluation import accuracy, definiteness
    from weft.operators.selection import at_least

    answers, now, history = None, sim, []
    for i in range(rounds):
        open_ = sim if answers is None else unvalidated(sim, votes(answers))
        asked = ranked(open_.withColumn("doubt", 1 - definiteness(F.col("similarity"))), "doubt", each)
        new = oracle(asked, reference).persist()
        if new.isEmpty():
            break
        answers = new if answers is None else answers.unionByName(new)
        now = apply_votes(sim, votes(answers))
        row = accuracy(at_least(now, 0.6), reference).first()
        history.append({"iteration": i + 1, "precision": row.precision, "recall": row.recall, "f": row.f, "delta": row.n_found + row.n_reference - 2 * row.n_correct})
    return history


def _evaluated(state: dict) -> dict:
    from weft.operators import evaluation, selection

    return state | {"quality": evaluation.accuracy(selection.at_least(state["sim"], state.get("threshold", 0.6)).select(*PAIR), state["reference"])}


#: The stages of a feedback round by name, each from a state to a state; another function under a name replaces it.
STAGES = {
    "initial": lambda state: state,
    "ranking": lambda state: state | {"ranked": unvalidated(state["sim"], state["counts"]).orderBy(F.desc("similarity"), *PAIR)},
    "validation": lambda state: state,
    "aggregation": lambda state: state | {"decided": decided(state["counts"])},
    "propagation": lambda state: state | {"sim": apply_votes(state["sim"], state["counts"])},
    "evaluation": _evaluated,
    "control": lambda state: state,
}


def run_stages(sim: DataFrame, counts: DataFrame, reference: DataFrame, stages: dict | None = None) -> DataFrame:
    """The similarities after one round of the registered stages, or of others under their names."""
    state = {"sim": sim, "counts": counts, "reference": reference}
    for name, stage in (STAGES | (stages or {})).items():
        state = stage(state)
    return state["sim"]
