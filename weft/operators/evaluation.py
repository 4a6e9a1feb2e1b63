"""How good similarities and alignments are, with and without a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PAIR = ["src_id", "tgt_id"]


def f_measure(p: Column, r: Column, alpha: float = 0.5) -> Column:
    """Weighted harmonic mean; 0 when both are 0."""
    below = (1 - alpha) * p + alpha * r
    return F.when(below > 0, p * r / below).otherwise(0.0)


def accuracy(found: DataFrame, reference: DataFrame, alpha: float = 0.5) -> DataFrame:
    """found, correct, in reference, precision, recall, f: one row. Undefined ratios are 0.

    One aggregation over both pair lists: nothing is joined.
    """
    both = found.select(*PAIR).distinct().withColumn("_f", F.lit(1)).withColumn("_r", F.lit(0))
    both = both.unionByName(reference.select(*PAIR).distinct().withColumn("_f", F.lit(0)).withColumn("_r", F.lit(1)))
    pairs = both.groupBy(*PAIR).agg(F.max("_f").alias("_f"), F.max("_r").alias("_r"))
    n = pairs.agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("_r"), F.lit(0)).alias("n_reference"), F.count_if((F.col("_f") == 1) & (F.col("_r") == 1)).alias("n_correct"))
    n = n.withColumn("precision", F.when(F.col("n_found") > 0, F.col("n_correct") / F.col("n_found")).otherwise(0.0))
    n = n.withColumn("recall", F.when(F.col("n_reference") > 0, F.col("n_correct") / F.col("n_reference")).otherwise(0.0))
    return n.withColumn("f", f_measure(F.col("precision"), F.col("recall"), alpha))


def delta(found: DataFrame, reference: DataFrame) -> DataFrame:
    """False positives plus false negatives."""
    n = accuracy(found, reference)
    return n.select((F.col("n_found") + F.col("n_reference") - 2 * F.col("n_correct")).alias("delta"))


def outcomes(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Each pair of either list as correct, error or lost."""
    a = found.select(*PAIR).distinct().withColumn("_f", F.lit(True))
    b = reference.select(*PAIR).distinct().withColumn("_r", F.lit(True))
    kind = F.when(F.col("_f") & F.col("_r"), "correct").when(F.col("_f"), "error").otherwise("lost")
    return a.join(b, PAIR, "full").select(*PAIR, kind.alias("outcome"))


def sweep(sim: DataFrame, reference: DataFrame, low: int = 20, high: int = 100) -> DataFrame:
    """Precision, recall and F of the cells at or above each threshold in hundredths.

    Each cell falls into one bin; running sums over the bins give all thresholds, so
    the cells are read once however many thresholds there are. A reference pair counts
    once; pairs in sim are distinct.
    """
    known = reference.select(*PAIR).distinct().withColumn("_r", F.lit(1))
    bins = sim.join(known, PAIR, "left").groupBy(F.floor(F.col("similarity") * 100 + 1e-9).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count("_r").alias("c"))
    spark = sim.sparkSession
    steps = spark.range(low, high + 1).select(F.col("id").alias("step"))
    total = reference.select(*PAIR).distinct().agg(F.count(F.lit(1)).alias("n_reference"))
    out = steps.join(F.broadcast(bins), F.col("bin") >= F.col("step"), "left").groupBy("step").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_found"), F.coalesce(F.sum("c"), F.lit(0)).alias("n_correct")).crossJoin(F.broadcast(total))
    p = F.when(F.col("n_found") > 0, F.col("n_correct") / F.col("n_found")).otherwise(0.0)
    r = F.when(F.col("n_reference") > 0, F.col("n_correct") / F.col("n_reference")).otherwise(0.0)
    out = out.select((F.col("step") / 100).alias("threshold"), "n_found", "n_correct", p.alias("precision"), r.alias("recall"))
    return out.withColumn("f", f_measure(F.col("precision"), F.col("recall")))


def best_threshold(swept: DataFrame) -> DataFrame:
    """The threshold with the best F, the lowest of equals."""
    return swept.agg(F.max(F.struct("f", (-F.col("threshold")).alias("t"))).alias("b")).select((-F.col("b.t")).alias("threshold"), F.col("b.f").alias("f"))


def side_sums(sim: DataFrame, side: str = "src_id") -> DataFrame:
    return sim.groupBy(side).agg(F.sum("similarity").alias("total"), F.max("similarity").alias("most"), F.count(F.lit(1)).alias("n"), F.avg("similarity").alias("mean"))


def local_confidence(sim: DataFrame, n_targets: int, per_src: int = 1, least: float = 0.01) -> DataFrame:
    """For each source the mean of its chosen cells minus the mean of its others, not below 0.

    Chosen are the per_src best at or above `least`. Missing cells count as others with 0.
    """
    rank = F.row_number().over(W.partitionBy("src_id").orderBy(F.desc("similarity"), F.desc("tgt_id")))
    chosen = (F.col("_rank") <= per_src) & (F.col("similarity") >= least)
    sums = sim.withColumn("_rank", rank).groupBy("src_id").agg(F.count_if(chosen).alias("k"), F.coalesce(F.sum(F.when(chosen, F.col("similarity"))), F.lit(0.0)).alias("a"), F.sum("similarity").alias("s"))
    first = F.when(F.col("k") > 0, F.col("a") / F.col("k")).otherwise(0.0)
    others = F.when(n_targets - F.col("k") > 0, (F.col("s") - F.col("a")) / (n_targets - F.col("k"))).otherwise(0.0)
    return sums.select("src_id", F.greatest(F.lit(0.0), first - others).alias("confidence"))


def global_confidence(local: DataFrame) -> DataFrame:
    """Mean of the local confidences that aren't 0."""
    return local.filter("confidence > 0").agg(F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"))


def cross_quality(sim: DataFrame, kind: str = "count") -> DataFrame:
    """(Non-zero cells, or sum, of a cell's row plus column) over the greatest of both sides."""
    value = F.count_if(F.col("similarity") > 0) if kind == "count" else F.sum("similarity")
    rows = sim.groupBy("src_id").agg(value.alias("_row"))
    columns = sim.groupBy("tgt_id").agg(value.alias("_column"))
    most = rows.agg(F.max("_row").alias("_x")).crossJoin(columns.agg(F.max("_column").alias("_y")))
    both = sim.join(rows, "src_id").join(columns, "tgt_id").crossJoin(F.broadcast(most))
    return both.select(*PAIR, ((F.col("_row") + F.col("_column")) / (F.col("_x") + F.col("_y"))).alias("quality"))


def variance(scores: DataFrame, n_matchers: int, scale: float = 1.0) -> DataFrame:
    """Population variance of each pair's similarities over all matchers, missing ones as 0."""
    sums = scores.groupBy(*PAIR).agg((F.sum("similarity") / n_matchers).alias("m"), (F.sum(F.col("similarity") * F.col("similarity")) / n_matchers).alias("q"))
    return sums.select(*PAIR, (scale * F.greatest(F.lit(0.0), F.col("q") - F.col("m") * F.col("m"))).alias("variance"))


def definiteness(x: Column) -> Column:
    return 2 * F.abs(x - 0.5)


def consensus(pos: Column, neg: Column, most: int = 5) -> Column:
    """How far votes agree: 0 on a tie, 1 when one side has the majority of the most votes there can be."""
    needed = most // 2 + 1
    return F.when(pos == neg, 0.0).when((pos == needed) | (neg == needed), 1.0).otherwise(F.abs(pos - neg) / needed)


def expanded_consensus(pos: Column, neg: Column, similarity: Column, threshold: float, most: int = 5) -> Column:
    """As above; a single vote is joined by the automatic score as a second one."""
    alone, yes = pos + neg == 1, similarity > threshold
    return consensus(pos + F.when(alone & yes, 1).otherwise(0), neg + F.when(alone & ~yes, 1).otherwise(0), most)


def revalidation_rate(pos: Column, neg: Column, most: int = 5) -> Column:
    return (pos + neg) / most


def user_disagreement(pos: Column, neg: Column) -> Column:
    p = pos / (pos + neg)
    return F.when(pos + neg > 0, 4 * p * (1 - p)).otherwise(0.0)


def propagation_impact(pos: Column, neg: Column, most: int = 5) -> Column:
    """How near both sides are to the majority, the nearer over the farther; 0 once it is reached."""
    needed = most // 2 + 1
    a, b = needed - pos, needed - neg
    return F.when((a == 0) | (b == 0), 0.0).otherwise(F.least(a, b) / F.greatest(a, b))


def matcher_confidence(scores: DataFrame, threshold: float) -> DataFrame:
    """For each pair the mean distance of the matchers' similarities from the threshold."""
    return scores.groupBy(*PAIR).agg(F.avg(F.abs(F.lit(threshold) - F.col("similarity"))).alias("confidence"))


def contention(scores: DataFrame, threshold: float) -> DataFrame:
    """Where matchers are on both sides of the threshold, the greatest minus the second distance from it; else 1."""
    distance = F.abs(F.col("similarity") - threshold)
    both = scores.groupBy(*PAIR).agg(F.count_if(F.col("similarity") > threshold).alias("p"), F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_set(distance), asc=False).alias("d"))
    apart = F.when(F.size("d") > 1, F.element_at("d", 1) - F.element_at("d", 2)).otherwise(F.element_at("d", 1))
    return both.select(*PAIR, F.when((F.col("p") > 0) & (F.col("p") < F.col("n")), apart).otherwise(1.0).alias("contention"))


def similarity_distance(sim: DataFrame) -> DataFrame:
    """For each cell the least gap to another cell of its row or column: its neighbours in order of similarity."""
    gaps = []
    for side, other in (("src_id", "tgt_id"), ("tgt_id", "src_id")):
        w = W.partitionBy(side).orderBy("similarity", other)
        gaps += [F.col("similarity") - F.lag("similarity").over(w), F.lead("similarity").over(w) - F.col("similarity")]
    return sim.select(*PAIR, F.least(*gaps).alias("distance"))


def coupling(sim: DataFrame) -> DataFrame:
    """Distinct best targets over sources: 1 when no two sources share one."""
    best = F.max(F.struct("similarity", "tgt_id"))
    tops = sim.groupBy("src_id").agg(best.alias("b"))
    return tops.agg((F.count_distinct("b.tgt_id") / F.count(F.lit(1))).alias("coupling"))


def order_preservation(pairs: DataFrame, above_src: DataFrame, above_tgt: DataFrame) -> DataFrame:
    """Share of pairs of mappings whose ancestor order agrees on both sides.

    above_*: (low, high) closures. Only ordered pairs are joined; the pairs without
    any order are counted, not made.
    """
    a = pairs.select("src_id", "tgt_id")
    lower = a.select(F.col("src_id").alias("s1"), F.col("tgt_id").alias("t1"))
    upper = a.select(F.col("src_id").alias("s2"), F.col("tgt_id").alias("t2"))
    s = lower.join(above_src, F.col("s1") == F.col("low")).drop("low").join(upper, F.col("high") == F.col("s2")).select("s1", "t1", "s2", "t2", F.lit(1).alias("s"), F.lit(0).alias("t"))
    t = lower.join(above_tgt, F.col("t1") == F.col("low")).drop("low").join(upper, F.col("high") == F.col("t2")).select("s1", "t1", "s2", "t2", F.lit(0).alias("s"), F.lit(1).alias("t"))
    either = s.unionByName(t).groupBy("s1", "t1", "s2", "t2").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    apart = either.agg(F.count_if(F.col("s") != F.col("t")).alias("apart"))
    n = a.agg(F.count(F.lit(1)).alias("n"))
    both = n.crossJoin(apart).withColumn("all", F.col("n") * (F.col("n") - 1) / 2)
    return both.select(F.when(F.col("all") > 0, 1 - F.col("apart") / F.col("all")).otherwise(1.0).alias("preservation"))


def ranking_accuracy(ranked: DataFrame, order: str, wrong: str, group: str) -> DataFrame:
    """Running share of wrong answers along a ranking, within each group."""
    w = W.partitionBy(group).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.select(group, order, (F.sum(F.col(wrong).cast("int")).over(w) / F.count(F.lit(1)).over(w)).alias("share"))


def relation_accuracy(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Counts of found correspondences with the reference's relation, with another, and without a reference, for each relation."""
    a = found.select(*PAIR, "relation").distinct()
    b = reference.select(*PAIR, F.col("relation").alias("_r")).distinct()
    both = a.join(b, PAIR, "left")
    return both.groupBy("relation").agg(F.count_if(F.col("relation") == F.col("_r")).alias("correct"), F.count_if(F.col("relation") != F.col("_r")).alias("other"), F.count_if(F.col("_r").isNull()).alias("unknown"))


def plain_accuracy(found: DataFrame, reference: DataFrame) -> DataFrame:
    """Precision, recall and F without guards: undefined ratios are null."""
    n = accuracy(found, reference).select("n_found", "n_reference", "n_correct")
    n = n.select((F.col("n_correct") / F.nullif(F.col("n_found"), F.lit(0))).alias("precision"), (F.col("n_correct") / F.nullif(F.col("n_reference"), F.lit(0))).alias("recall"))
    return n.withColumn("f", 2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)))


def lattice_distances(edges: DataFrame, nodes: DataFrame, upper: bool = True) -> DataFrame:
    """a, b, distance over the greatest there can be: ancestors (or descendants) of both less twice the most of a common one's.

    nodes: node, the mapped ones. Counts include the node itself; nodes without a common one have their whole counts.
    """
    from weft.operators.candidates import closure

    up = closure(edges).select("low", "high") if upper else closure(edges).select(F.col("high").alias("low"), F.col("low").alias("high"))
    all_nodes = edges.select(F.col("child").alias("n")).union(edges.filter("parent IS NOT NULL").select("parent")).distinct()
    self_up = up.unionByName(all_nodes.select(F.col("n").alias("low"), F.col("n").alias("high")))
    counts = self_up.groupBy(F.col("low").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    has_parent, has_child = edges.filter("parent IS NOT NULL").select(F.col("child").alias("n")).distinct(), edges.filter("parent IS NOT NULL").select(F.col("parent").alias("n")).distinct()
    n, roots, leaves = all_nodes.count(), all_nodes.join(has_parent, "n", "left_anti").count(), all_nodes.join(has_child, "n", "left_anti").count()
    widest = float(n - 1 + (roots != 1) + (leaves != 1))
    mine = nodes.select("node").distinct()
    way = mine.join(self_up, F.col("node") == F.col("low")).join(counts.withColumnRenamed("n", "high"), "high").select("node", "high", "k")
    common = way.select(F.col("node").alias("a"), "high", "k").join(way.select(F.col("node").alias("b"), "high"), "high").groupBy("a", "b").agg(F.max("k").alias("c"))
    pairs = mine.select(F.col("node").alias("a")).crossJoin(mine.select(F.col("node").alias("b"))).filter("a <> b")
    pairs = pairs.join(common, ["a", "b"], "left").join(counts.select(F.col("n").alias("a"), F.col("k").alias("ka")), "a").join(counts.select(F.col("n").alias("b"), F.col("k").alias("kb")), "b")
    return pairs.select("a", "b", ((F.col("ka") + F.col("kb") - 2 * F.coalesce("c", F.lit(0))) / max(widest, 1.0)).alias("distance"))


def distance_preservation(alignment: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, upper: bool = True) -> DataFrame:
    """One minus the mean difference of the two sides' normalised distances over all pairs of mappings.

    An alignment's pairs of mappings are what the measure is defined on: it is meant for alignments, not for matrices.
    """
    a = lattice_distances(src_edges, alignment.select(F.col("src_id").alias("node")), upper).withColumnRenamed("distance", "_x")
    b = lattice_distances(tgt_edges, alignment.select(F.col("tgt_id").alias("node")), upper).withColumnRenamed("distance", "_y")
    one, two = alignment.select(F.col("src_id").alias("s1"), F.col("tgt_id").alias("t1")), alignment.select(F.col("src_id").alias("s2"), F.col("tgt_id").alias("t2"))
    both = one.crossJoin(two).filter((F.col("s1") < F.col("s2")) | ((F.col("s1") == F.col("s2")) & (F.col("t1") < F.col("t2"))))
    both = both.join(a, (F.col("s1") == a.a) & (F.col("s2") == a.b), "left").join(b, (F.col("t1") == b.a) & (F.col("t2") == b.b), "left")
    return both.agg((1 - F.avg(F.abs(F.coalesce("_x", F.lit(0.0)) - F.coalesce("_y", F.lit(0.0))))).alias("preservation"))


def inter_coupling(scores: DataFrame) -> DataFrame:
    """matcher, coupling: share of a matcher's best targets that are best for another matcher too."""
    tops = scores.groupBy("matcher", "src_id").agg(F.max(F.struct("similarity", "tgt_id")).alias("b")).select("matcher", "src_id", F.col("b.tgt_id").alias("tgt_id"))
    agree = tops.groupBy("src_id", "tgt_id").agg(F.count(F.lit(1)).alias("n"))
    return tops.join(agree, PAIR).groupBy("matcher").agg((F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("coupling"))


def merged_quality(a: DataFrame, b: DataFrame) -> DataFrame:
    """Mean of two qualities; each is src_id, weight for a local or weight alone for a global one."""
    if "src_id" in a.columns and "src_id" in b.columns:
        both = a.withColumnRenamed("weight", "_a").join(b.withColumnRenamed("weight", "_b"), "src_id")
        return both.select("src_id", ((F.col("_a") + F.col("_b")) / 2).alias("weight"))
    both = a.withColumnRenamed("weight", "_a").crossJoin(b.withColumnRenamed("weight", "_b"))
    return both.select(*(c for c in ("src_id",) if c in both.columns), ((F.col("_a") + F.col("_b")) / 2).alias("weight"))


#: Qualities of a whole matcher's result: a function of its similarities and of how many targets there are.
QUALITY = {
    "mean": lambda sim, n_targets: sim.agg(F.avg("similarity").alias("value")),
    "definiteness": lambda sim, n_targets: sim.agg(F.avg(definiteness(F.col("similarity"))).alias("value")),
    "fill": lambda sim, n_targets: sim.agg((F.count(F.lit(1)) / (F.count_distinct("src_id") * F.lit(n_targets))).alias("value")),
}


def measured(sim: DataFrame, n_targets: int, names: list[str] | None = None) -> DataFrame:
    """metric, value: the registered qualities, all or those named."""
    out = None
    for name in names or sorted(QUALITY):
        one = QUALITY[name](sim, n_targets).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out
