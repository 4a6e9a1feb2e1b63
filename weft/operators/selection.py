"""From similarities to correspondences.

Everything works on a sparse relation sim(src_id, tgt_id, similarity); a missing
row counts as 0. Every order has the ids as last keys, so ties are decided alike on
any partitioning.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.cut import kept as _checked

PAIR = ["src_id", "tgt_id"]


def at_least(sim: DataFrame, threshold: float) -> DataFrame:
    return sim.filter(F.col("similarity") >= threshold)


def above(sim: DataFrame, threshold: float) -> DataFrame:
    return sim.filter(F.col("similarity") > threshold)


def top_per(sim: DataFrame, side: str, n: int = 1, threshold: float = 0.0) -> DataFrame:
    """The n best cells of each row (side "src") or column ("tgt"), of equals the later one.

    Spark ranks within each map task first (a group limit below the shuffle), so of a
    key with very many cells only n for each task are moved.
    """
    key, other = ("src_id", "tgt_id") if side == "src" else ("tgt_id", "src_id")
    best = [F.desc("similarity"), F.desc(other)]
    return at_least(sim, threshold).withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(*best))).filter(F.col("_rank") <= n).drop("_rank")


def mutual_best(sim: DataFrame) -> DataFrame:
    """Cells that are the best of their row and of their column."""
    row, column = W.partitionBy("src_id"), W.partitionBy("tgt_id")
    marked = sim.withColumn("_row", F.max("similarity").over(row)).withColumn("_column", F.max("similarity").over(column))
    return marked.filter((F.col("similarity") == F.col("_row")) & (F.col("similarity") == F.col("_column"))).drop("_row", "_column")


def copied(previous: DataFrame) -> DataFrame:
    """An earlier selection as it is."""
    return previous.select(*PAIR, "similarity")


def global_top(sim: DataFrame, k: int, mask: DataFrame | None = None) -> DataFrame:
    """The k best cells, of equals the first; a mask keeps only its own pairs."""
    some = sim if mask is None else sim.join(mask.select(*PAIR), PAIR, "left_semi")
    return some.orderBy(F.desc("similarity"), *PAIR).limit(k)


def ordered(sim: DataFrame, threshold: float = 0.0, descending: bool = False) -> DataFrame:
    first = F.desc("similarity") if descending else F.asc("similarity")
    return above(sim, threshold).orderBy(first, *PAIR)


def greedy(sim: DataFrame, threshold: float = 0.0, per_src: int = 1, per_tgt: int = 1) -> DataFrame:
    """Repeated global maximum with removal of its row and column, of equals the last cell.

    A cell that is the best of its row and its column under one total order is taken
    by the greedy order whatever happens elsewhere, so all such cells are taken at
    once, and a few rounds do what one cell at a time would. With limits above one the
    best per_src and per_tgt cells of both sides are taken.
    """
    left = _checked(at_least(sim, threshold).select(*PAIR, "similarity").withColumn("_s", F.lit(per_src)).withColumn("_t", F.lit(per_tgt)))
    order = [F.desc("similarity"), F.desc("src_id"), F.desc("tgt_id")]
    taken: list[DataFrame] = []
    while not left.isEmpty():
        ranked = left.withColumn("_i", F.row_number().over(W.partitionBy("src_id").orderBy(*order))).withColumn("_j", F.row_number().over(W.partitionBy("tgt_id").orderBy(*order)))
        now = _checked(ranked.filter((F.col("_i") <= F.col("_s")) & (F.col("_j") <= F.col("_t"))).select(*PAIR, "similarity"))
        taken.append(now)
        used_s = now.groupBy("src_id").agg(F.count(F.lit(1)).alias("_us"))
        used_t = now.groupBy("tgt_id").agg(F.count(F.lit(1)).alias("_ut"))
        left = left.join(now.select(*PAIR), PAIR, "left_anti").join(used_s, "src_id", "left").join(used_t, "tgt_id", "left")
        left = left.withColumn("_s", F.col("_s") - F.coalesce("_us", F.lit(0))).withColumn("_t", F.col("_t") - F.coalesce("_ut", F.lit(0)))
        left = _checked(left.filter("_s > 0 AND _t > 0").drop("_us", "_ut"))
    out = sim.select(*PAIR, "similarity").limit(0)
    for part in taken:
        out = out.unionByName(part)
    return out


def stable_many(sim: DataFrame, n: int, m: int, threshold: float = 0.0) -> DataFrame:
    """At most n targets for a source and m sources for a target: rows propose, columns keep their best.

    Deferred acceptance: in each round a source offers its best cells that haven't
    been refused, a target keeps its m best offers and refuses the others for good.
    """
    left = _checked(at_least(sim, threshold).select(*PAIR, "similarity"))
    while True:
        offers = left.withColumn("_i", F.row_number().over(W.partitionBy("src_id").orderBy(F.desc("similarity"), F.desc("tgt_id")))).filter(F.col("_i") <= n)
        judged = _checked(offers.withColumn("_j", F.row_number().over(W.partitionBy("tgt_id").orderBy(F.desc("similarity"), F.desc("src_id")))).drop("_i"))
        refused = judged.filter(F.col("_j") > m).select(*PAIR)
        if refused.isEmpty():
            return judged.select(*PAIR, "similarity")
        left = _checked(left.join(refused, PAIR, "left_anti"))


def assign(weights: np.ndarray) -> list[tuple[int, int]]:
    """Row and column of a maximum-weight matching, weights not negative, 0 for no edge.

    Shortest augmenting paths with potentials, row by row; O(n^2 m).
    """
    turned = weights.shape[0] > weights.shape[1]
    cost = -(weights.T if turned else weights).astype(np.int64)
    n, m = cost.shape
    u, v = np.zeros(n + 1, np.int64), np.zeros(m + 1, np.int64)
    owner = np.zeros(m + 1, np.int64)  # of column j, from 1; row 0 is none
    far = np.iinfo(np.int64).max // 4
    for i in range(1, n + 1):
        owner[0], column = i, 0
        least, before, done = np.full(m + 1, far), np.zeros(m + 1, np.int64), np.zeros(m + 1, bool)
        while owner[column]:
            done[column] = True
            row = owner[column]
            free = np.flatnonzero(~done[1:]) + 1
            slack = cost[row - 1, free - 1] - u[row] - v[free]
            better = slack < least[free]
            least[free[better]], before[free[better]] = slack[better], column
            nearest = free[least[free].argmin()]
            step = least[nearest]
            u[owner[done]] += step
            v[done] -= step
            least[free] -= step
            column = nearest
        while column:
            owner[column], column = owner[before[column]], before[column]
    pairs = [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    pairs = [(j, i) for i, j in pairs] if turned else pairs
    return sorted((i, j) for i, j in pairs if weights[i, j] > 0)


def _assign_block(cells: pd.DataFrame) -> pd.DataFrame:
    """The best matching of one connected block; dense only within the block."""
    rows, i = np.unique(cells.src_id, return_inverse=True)
    columns, j = np.unique(cells.tgt_id, return_inverse=True)
    weights = np.zeros((len(rows), len(columns)), np.int64)
    weights[i, j] = np.floor(cells.similarity.to_numpy() * 1000 + 0.5)
    chosen = assign(weights)
    exact = dict(zip(zip(i, j), cells.similarity))
    return pd.DataFrame([(rows[a], columns[b], exact[a, b]) for a, b in chosen], columns=["src_id", "tgt_id", "similarity"])


def labelled_blocks(sim: DataFrame) -> DataFrame:
    """The cells with the label of their connected block: sources pass labels to targets and back."""
    nodes = _checked(sim.select("src_id").distinct().withColumn("block", F.col("src_id")))
    while True:
        down = sim.join(nodes, "src_id").groupBy("tgt_id").agg(F.min("block").alias("block"))
        up = _checked(sim.join(down, "tgt_id").groupBy("src_id").agg(F.min("block").alias("block")))
        changed = up.join(nodes.withColumnRenamed("block", "_old"), "src_id").filter("block <> _old")
        if changed.isEmpty():
            return sim.join(up, "src_id")
        nodes = up


def best_assignment(sim: DataFrame, threshold: float) -> DataFrame:
    """Maximum-weight 1-1 matching of the cells at or above the threshold, weights in thousandths.

    Connected blocks are independent, so each is solved by itself. A block is one
    dense matrix in one task: the threshold decides how large blocks get.
    """
    blocks = labelled_blocks(_checked(at_least(sim, threshold).select(*PAIR, "similarity")))
    kinds = dict(sim.dtypes)
    return blocks.groupBy("block").applyInPandas(lambda x: _assign_block(x), f"src_id {kinds['src_id']}, tgt_id {kinds['tgt_id']}, similarity double")


def select(sim: DataFrame, threshold: float = 0.6, per_src: int | None = 1, per_tgt: int | None = 1) -> DataFrame:
    """Correspondences under a cardinality; None is any number."""
    if per_src is None and per_tgt is None:
        return at_least(sim, threshold)
    if per_tgt is None:
        return top_per(sim, "src", per_src, threshold)
    if per_src is None:
        return top_per(sim, "tgt", per_tgt, threshold)
    if per_src == per_tgt == 1:
        return best_assignment(sim, threshold)
    return stable_many(sim, per_src, per_tgt, threshold)


def merge(*alignments: DataFrame) -> DataFrame:
    """Each pair once, with the similarity of the first alignment that has it."""
    out = None
    for place, one in enumerate(alignments):
        part = one.select(*PAIR, "similarity").withColumn("_place", F.lit(place))
        out = part if out is None else out.unionByName(part)
    return out.groupBy(*PAIR).agg(F.min_by("similarity", "_place").alias("similarity"))


def completion(sim: DataFrame, mapped: DataFrame) -> DataFrame:
    """Cells whose nodes are both unmapped, and the cells of the mapping itself."""
    free = sim.join(mapped.select("src_id").distinct(), "src_id", "left_anti").join(mapped.select("tgt_id").distinct(), "tgt_id", "left_anti")
    return free.select(*PAIR, "similarity").unionByName(mapped.select(*PAIR, "similarity"))


def mapped_flags(sim: DataFrame, mapped: DataFrame) -> DataFrame:
    """Both nodes mapped: the cell stays; one mapped: 0; none: left to be scored (null)."""
    s = mapped.select("src_id").distinct().withColumn("_s", F.lit(True))
    t = mapped.select("tgt_id").distinct().withColumn("_t", F.lit(True))
    both = sim.join(s, "src_id", "left").join(t, "tgt_id", "left")
    value = F.when(F.col("_s") & F.col("_t"), F.col("similarity")).when(F.col("_s") | F.col("_t"), 0.0)
    return both.select(*PAIR, value.alias("similarity"))


def integrate_reference(sim: DataFrame, reference: DataFrame) -> DataFrame:
    """Reference mappings win; other cells stay only if both their nodes are free."""
    return completion(sim, reference)


def dense(sim: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """All cells, missing ones as 0. The sides are node lists: their product is what is asked for."""
    return sources.crossJoin(targets).join(sim, PAIR, "left").select(*PAIR, F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def pruned(sim: DataFrame, threshold: float) -> DataFrame:
    """For each row: the cells at or above the threshold as count and sum, and the others as count and sum."""
    kept = F.col("similarity") >= threshold
    return sim.groupBy("src_id").agg(
        F.count_if(kept).alias("n_kept"),
        F.coalesce(F.sum(F.when(kept, F.col("similarity"))), F.lit(0.0)).alias("sum_kept"),
        F.count_if(~kept).alias("n_pruned"),
        F.coalesce(F.sum(F.when(~kept, F.col("similarity"))), F.lit(0.0)).alias("sum_pruned"),
    )


def best_candidate(sim: DataFrame, threshold: float) -> DataFrame:
    """The best target of each source, strictly above the threshold; of equals the first."""
    best = F.struct(F.col("similarity"), (-F.col("tgt_id")).alias("o"))
    out = above(sim, threshold).groupBy("src_id").agg(F.max(best).alias("b"))
    return out.select("src_id", (-F.col("b.o")).alias("tgt_id"), F.col("b.similarity").alias("similarity"))


def triangle_votes(ab: DataFrame, ac: DataFrame, bc: DataFrame) -> DataFrame:
    """Mappings of a and b with the votes of a third side: 1 if some c maps to both, -1 if a's c maps to another b."""
    legs = ab.select(F.col("src_id").alias("a"), F.col("tgt_id").alias("b"), "similarity")
    legs = legs.join(ac.select(F.col("src_id").alias("a"), F.col("tgt_id").alias("c")), "a", "left")
    legs = legs.join(bc.select(F.col("src_id").alias("b2"), F.col("tgt_id").alias("c")), "c", "left")
    vote = F.max(F.when(F.col("b2") == F.col("b"), 1).when(F.col("b2").isNotNull(), -1).otherwise(0))
    return legs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"), vote.alias("vote"))


def transpose(sim: DataFrame) -> DataFrame:
    return sim.select(F.col("tgt_id").alias("src_id"), F.col("src_id").alias("tgt_id"), "similarity")


def plus(a: DataFrame, b: DataFrame, sign: int = 1) -> DataFrame:
    """Cell by cell sum (or difference) of two sparse matrices."""
    both = a.select(*PAIR, "similarity").unionByName(b.select(*PAIR, (F.col("similarity") * sign).alias("similarity")))
    return both.groupBy(*PAIR).agg(F.sum("similarity").alias("similarity"))


def times(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of two sparse matrices: a join on the inner index."""
    left = a.select("src_id", F.col("tgt_id").alias("_k"), F.col("similarity").alias("_x"))
    right = b.select(F.col("src_id").alias("_k"), "tgt_id", F.col("similarity").alias("_y"))
    return left.join(right, "_k").groupBy(*PAIR).agg(F.sum(F.col("_x") * F.col("_y")).alias("similarity"))


def repaired(alignment: DataFrame, src_up: DataFrame, tgt_up: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Mappings without those that contradict a surer one.

    Two mappings contradict each other when their sources have one below the other and their
    targets are in disjoint branches; *_up: (low, high), disjoint: (a, b) of targets. Of
    two the less similar goes, unless what it contradicts is itself gone: the surest are
    decided first, a round at a time.
    """
    reach = tgt_up.select("low", "high").unionByName(tgt_up.select(F.col("low"), F.col("low").alias("high"))).unionByName(tgt_up.select(F.col("high").alias("low"), "high")).distinct()
    pairs = disjoint.select("a", "b").unionByName(disjoint.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    apart = pairs.join(reach.select(F.col("low").alias("t1"), F.col("high").alias("a")), "a", "left").join(reach.select(F.col("low").alias("t2"), F.col("high").alias("b")), "b", "left")
    apart = apart.select(F.coalesce("t1", "a").alias("t1"), F.coalesce("t2", "b").alias("t2")).distinct()
    m = _checked(alignment.select(*PAIR, "similarity"))
    one, two = m.select(*(F.col(c).alias(f"{c}_1") for c in m.columns)), m.select(*(F.col(c).alias(f"{c}_2") for c in m.columns))
    lines = src_up.select(F.col("low").alias("src_id_1"), F.col("high").alias("src_id_2"))
    clash = one.join(lines, "src_id_1").join(two, "src_id_2").join(apart, (F.col("tgt_id_1") == F.col("t1")) & (F.col("tgt_id_2") == F.col("t2")), "left_semi")
    key = lambda i: F.struct(F.col(f"similarity_{i}").alias("s"), (-F.col(f"src_id_{i}")).alias("a"), (-F.col(f"tgt_id_{i}")).alias("b"))
    pair = lambda i: F.struct(F.col(f"src_id_{i}").alias("src_id"), F.col(f"tgt_id_{i}").alias("tgt_id"))
    strong = key(1) > key(2)
    edges = _checked(clash.select(F.when(strong, pair(1)).otherwise(pair(2)).alias("keep"), F.when(strong, pair(2)).otherwise(pair(1)).alias("drop")).distinct())
    gone = m.select(F.struct(*PAIR).alias("drop")).limit(0)
    while not edges.isEmpty():
        safe = edges.select("keep").distinct().join(edges.select(F.col("drop").alias("keep")), "keep", "left_anti")
        out = _checked(edges.join(safe, "keep", "left_semi").select("drop").distinct())
        gone = gone.unionByName(out)
        edges = _checked(edges.join(safe, "keep", "left_anti").join(out, "drop", "left_anti").join(out.withColumnRenamed("drop", "keep"), "keep", "left_anti"))
    return m.join(gone.select("drop.src_id", "drop.tgt_id"), PAIR, "left_anti")
