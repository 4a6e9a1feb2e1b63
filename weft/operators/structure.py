"""Refinement of similarities along hierarchies and graphs: sim in, sim out.

edges are (child, parent), a null parent for a root; a missing cell is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import candidates as C
from weft.operators.cut import kept as _cut

PAIR = ["src_id", "tgt_id"]


def depths(edges: DataFrame) -> DataFrame:
    """node, depth: edges on the longest way up; 0 for roots."""
    up = edges.filter("parent IS NOT NULL").select("child", "parent")
    nodes = edges.select(F.col("child").alias("node")).union(up.select("parent")).distinct()
    level = nodes.join(up, nodes.node == up.child, "left_anti").withColumn("depth", F.lit(0))
    found = level = _cut(level)
    while not level.isEmpty():
        level = _cut(level.join(up, level.node == up.parent).select(F.col("child").alias("node"), (F.col("depth") + 1).alias("depth")).distinct())
        found = found.unionByName(level)
    return found.groupBy("node").agg(F.max("depth").alias("depth"))


def _sides(src_edges: DataFrame, tgt_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    a = src_edges.filter("parent IS NOT NULL").select(F.col("child").alias("src_id"), F.col("parent").alias("ps")).distinct()
    b = tgt_edges.filter("parent IS NOT NULL").select(F.col("child").alias("tgt_id"), F.col("parent").alias("pt")).distinct()
    return a, b


def descendant_inheritance(sim: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, mcp: float = 0.75) -> DataFrame:
    """mcp * sim + (1 - mcp) * mean over source parents of the best target parent, with the parents' new values.

    A pair's level is the lesser depth of its two nodes; levels are done from the top,
    one join each. Pairs with a root keep their value.
    """
    up_s, up_t = _sides(src_edges, tgt_edges)
    n_parents = up_s.groupBy("src_id").agg(F.count(F.lit(1)).alias("k"))
    down_s, down_t = depths(src_edges), depths(tgt_edges)
    ds = down_s.select(F.col("node").alias("src_id"), F.col("depth").alias("ds"))
    dt = down_t.select(F.col("node").alias("tgt_id"), F.col("depth").alias("dt"))
    cells = _cut(sim.join(ds, "src_id").join(dt, "tgt_id").withColumn("level", F.least("ds", "dt")).select(*PAIR, "similarity", "level"))
    deepest = min(down_s.agg(F.max("depth")).first()[0] or 0, down_t.agg(F.max("depth")).first()[0] or 0)
    done = cells.filter("level = 0").select(*PAIR, "similarity")
    for level in range(1, deepest + 1):
        above = done.select(F.col("src_id").alias("ps"), F.col("tgt_id").alias("pt"), F.col("similarity").alias("above"))
        from_above = above.join(up_s, "ps").join(up_t, "pt").join(ds, "src_id").join(dt, "tgt_id").filter(F.least("ds", "dt") == level)
        best = from_above.groupBy(*PAIR, "ps").agg(F.max("above").alias("m"))
        mean = best.join(n_parents, "src_id").groupBy(*PAIR).agg((F.sum("m") / F.max("k")).alias("inherited"))
        own = cells.filter(F.col("level") == level).select(*PAIR, "similarity")
        now = own.join(mean, PAIR, "full").select(*PAIR, (mcp * F.coalesce("similarity", F.lit(0.0)) + (1 - mcp) * F.coalesce("inherited", F.lit(0.0))).alias("similarity"))
        done = _cut(done.unionByName(now))
    return done


def path_inheritance(sim: DataFrame, up_src: DataFrame, up_tgt: DataFrame, mcp: float = 0.75) -> DataFrame:
    """The older form: mcp * sim + 2 (1 - mcp) / (n (n + 1)) * sum of (n + 1 - i) * sim of the i-th parents.

    up_*: (low, high, distance) of trees; n is the shorter way up. Pairs with a root
    keep their value.
    """
    length_s = up_src.groupBy(F.col("low").alias("src_id")).agg(F.max("distance").alias("ls"))
    length_t = up_tgt.groupBy(F.col("low").alias("tgt_id")).agg(F.max("distance").alias("lt"))
    cells = sim.join(length_s, "src_id", "left").join(length_t, "tgt_id", "left").withColumn("n", F.coalesce(F.least("ls", "lt"), F.lit(0)))
    cells = cells.withColumn("n", F.when(F.col("ls").isNull() | F.col("lt").isNull(), 0).otherwise(F.col("n")))
    a = up_src.select(F.col("low").alias("src_id"), F.col("high").alias("ps"), F.col("distance").alias("i"))
    b = up_tgt.select(F.col("low").alias("tgt_id"), F.col("high").alias("pt"), F.col("distance").alias("i"))
    above = sim.select(F.col("src_id").alias("ps"), F.col("tgt_id").alias("pt"), F.col("similarity").alias("above"))
    terms = cells.select(*PAIR, "n").join(a, "src_id").join(b, ["tgt_id", "i"]).join(above, ["ps", "pt"])
    sums = terms.groupBy(*PAIR).agg(F.sum((F.col("n") + 1 - F.col("i")) * F.col("above")).alias("s"))
    out = cells.join(sums, PAIR, "left")
    value = mcp * F.col("similarity") + 2 * (1 - mcp) / (F.col("n") * (F.col("n") + 1)) * F.coalesce("s", F.lit(0.0))
    return out.select(*PAIR, F.when(F.col("n") > 0, value).otherwise(F.col("similarity")).alias("similarity"))


def sibling_contribution(sim: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, mcp: float = 0.75) -> DataFrame:
    """mcp * sim + (1 - mcp) * mean over source siblings of the best target sibling; as it is without siblings.

    The two best cells of a source below each target parent are enough to know its best other than any
    child, so pairs of siblings aren't made on the target's side.
    """
    a = C.siblings(src_edges).select(F.col("node").alias("src_id"), F.col("sibling").alias("ss"))
    n = a.groupBy("src_id").agg(F.count(F.lit(1)).alias("n"))
    below = _sides(src_edges, tgt_edges)[1]
    families = below.groupBy("pt").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("pt")
    has_sibling = below.join(families, "pt", "left_semi").select("tgt_id").distinct().withColumn("more", F.lit(True))
    near = sim.select(F.col("src_id").alias("ss"), F.col("tgt_id").alias("st"), F.col("similarity").alias("near")).join(below.withColumnRenamed("tgt_id", "st"), "st")
    first = W.partitionBy("ss", "pt").orderBy(F.desc("near"), "st")
    top = near.withColumn("i", F.row_number().over(first)).filter("i <= 2")
    best = top.join(below, "pt").filter("st <> tgt_id").groupBy("ss", "tgt_id").agg(F.max("near").alias("m"))
    sums = a.join(best, "ss").groupBy(*PAIR).agg(F.sum("m").alias("s"))
    out = sim.join(n, "src_id", "left").join(has_sibling, "tgt_id", "left").join(sums, PAIR, "left")
    mean = F.coalesce("s", F.lit(0.0)) / F.col("n")
    value = F.when(F.col("n").isNotNull() & F.col("more"), mcp * F.col("similarity") + (1 - mcp) * mean).otherwise(F.col("similarity"))
    return out.select(*PAIR, value.alias("similarity"))


def boost_mutual_best(sim: DataFrame, factor: float = 1.1) -> DataFrame:
    """Cells that are best of row and column times the factor, not above 1."""
    rows = sim.groupBy("src_id").agg(F.max("similarity").alias("_r"))
    columns = sim.groupBy("tgt_id").agg(F.max("similarity").alias("_c"))
    both = sim.join(rows, "src_id").join(columns, "tgt_id")
    best = (F.col("similarity") == F.col("_r")) & (F.col("similarity") == F.col("_c"))
    return both.select(*PAIR, F.when(best, F.least(F.lit(1.0), F.col("similarity") * factor)).otherwise(F.col("similarity")).alias("similarity"))


def roots(edges: DataFrame) -> DataFrame:
    """node, root: the topmost ancestor (the least of several), a root's own."""
    up = C.closure(edges)
    tops = up.select(F.col("high").alias("t")).distinct().join(edges.filter("parent IS NOT NULL").select(F.col("child").alias("t")), "t", "left_anti")
    found = up.join(tops, up.high == tops.t).groupBy(F.col("low").alias("node")).agg(F.min("t").alias("root"))
    nodes = edges.select(F.col("child").alias("node")).union(edges.filter("parent IS NOT NULL").select("parent")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def group_finder(sim: DataFrame, src_group: DataFrame, tgt_group: DataFrame, damping: float = 0.8) -> DataFrame:
    """Groups (node, root) are matched by the sums of their nodes' best cells; cells across other groups are damped.

    Each source group goes with the target group of the greatest sum, of equals the least.
    """
    a = src_group.select(F.col("node").alias("src_id"), F.col("root").alias("rs"))
    b = tgt_group.select(F.col("node").alias("tgt_id"), F.col("root").alias("rt"))
    cells = sim.join(a, "src_id").join(b, "tgt_id")
    best = cells.groupBy("src_id", "rs", "rt").agg(F.max("similarity").alias("m"))
    sums = best.groupBy("rs", "rt").agg(F.sum("m").alias("s"))
    match = sums.groupBy("rs").agg(F.max(F.struct("s", (-F.col("rt")).alias("o"))).alias("b")).select("rs", (-F.col("b.o")).alias("matched"))
    out = cells.join(match, "rs")
    return out.select(*PAIR, F.when(F.col("rt") == F.col("matched"), F.col("similarity")).otherwise(F.col("similarity") * damping).alias("similarity"))


def connectivity_graph(src_graph: DataFrame, tgt_graph: DataFrame) -> DataFrame:
    """Edges between pairs of nodes, forward and back, with a coefficient.

    Graphs are (label, from_id, to_id). A pair's edges of one label share 1 between
    them, in each direction.
    """
    both = C.label_join(src_graph, tgt_graph).select("label", F.struct("from_a", "from_b").alias("u"), F.struct("to_a", "to_b").alias("v"))
    plain = both.select("label", F.col("u.from_a").alias("a1"), F.col("u.from_b").alias("b1"), F.col("v.to_a").alias("a2"), F.col("v.to_b").alias("b2")).distinct()
    out = plain.groupBy("label", "a1", "b1").agg(F.count(F.lit(1)).alias("n"))
    back = plain.groupBy("label", "a2", "b2").agg(F.count(F.lit(1)).alias("n"))
    forth = plain.join(out, ["label", "a1", "b1"]).select("a1", "b1", "a2", "b2", (1 / F.col("n")).alias("w"))
    reverse = plain.join(back, ["label", "a2", "b2"]).select(F.col("a2").alias("a1"), F.col("b2").alias("b1"), F.col("a1").alias("a2"), F.col("b1").alias("b2"), (1 / F.col("n")).alias("w"))
    return forth.unionByName(reverse)


def pair_scoped_graph(src_graph: DataFrame, tgt_graph: DataFrame) -> DataFrame:
    """The edges of each pair's own part of the connectivity graph: the pair and its neighbours alone.

    There a neighbour has no other edge of the label, so all that it holds goes to the pair.
    """
    both = connectivity_graph(src_graph, tgt_graph)
    return both.select("a1", "b1", "a2", "b2").distinct().withColumn("w", F.lit(1.0))


def flood_by_sql(edges: DataFrame, start: DataFrame, rounds: int) -> DataFrame:
    """Flooding said in SQL: edges (label, a1, b1, a2, b2) are completed by those back that are missing, an edge's
    coefficient is one over the edges that leave its beginning under its label, and in each round a pair
    with edges adds what its ends hold, by coefficient, before all are divided by the greatest.
    """
    spark = edges.sparkSession
    edges = edges.select("label", "a1", "b1", "a2", "b2")
    back = spark.sql("SELECT label, a2 AS a1, b2 AS b1, a1 AS a2, b1 AS b2 FROM {e} EXCEPT SELECT * FROM {e}", e=edges)
    graph = _cut(spark.sql("SELECT *, 1.0D / count(*) OVER (PARTITION BY label, a1, b1) AS w FROM (SELECT DISTINCT * FROM {e} UNION ALL SELECT * FROM {b})", e=edges, b=back))
    now = _cut(start.select(*PAIR, "similarity"))
    for _ in range(rounds):
        held = spark.sql("SELECT a1 AS src_id, b1 AS tgt_id, sum(w * v.similarity) AS s FROM {g} JOIN {v} v ON a2 = v.src_id AND b2 = v.tgt_id GROUP BY a1, b1", g=graph, v=now)
        new = spark.sql("SELECT v.src_id, v.tgt_id, v.similarity + coalesce(s, 0) AS s FROM {v} v LEFT JOIN {h} h ON v.src_id = h.src_id AND v.tgt_id = h.tgt_id", v=now, h=held)
        now = _cut(spark.sql("SELECT src_id, tgt_id, s / greatest(1e-300D, (SELECT max(s) FROM {n})) AS similarity FROM {n}", n=new))
    return now


def flood(graph: DataFrame, start: DataFrame, rounds: int = 10, least_change: float = 0.01) -> DataFrame:
    """Similarity flooding: each round adds the neighbours' similarities by coefficient and divides by the greatest.

    graph: connectivity_graph(); start: sim with a row for each pair of the graph that
    begins above 0. Ends when the Euclidean change is below least_change or after
    `rounds`. The graph is cut once, the values every round.
    """
    graph = _cut(graph)
    now = _cut(start.select(*PAIR, "similarity"))
    for _ in range(rounds):
        sent = now.select(F.col("src_id").alias("a1"), F.col("tgt_id").alias("b1"), "similarity").join(graph, ["a1", "b1"])
        sent = sent.select(F.col("a2").alias("src_id"), F.col("b2").alias("tgt_id"), (F.col("similarity") * F.col("w")).alias("similarity"))
        summed = now.select(*(F.col(c).alias(c) for c in (*PAIR, "similarity"))).unionByName(sent).groupBy(*PAIR).agg(F.sum("similarity").alias("similarity"))
        top = summed.agg(F.max("similarity").alias("_top"))
        new = _cut(summed.crossJoin(F.broadcast(top)).select(*PAIR, F.when(F.col("_top") > 0, F.col("similarity") / F.col("_top")).otherwise(0.0).alias("similarity")))
        if least_change > 0:
            gap = new.withColumnRenamed("similarity", "x").join(now.withColumnRenamed("similarity", "y"), PAIR, "full").agg(F.sqrt(F.sum(F.pow(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)), F.lit(2)))).alias("d")).first().d
            now = new
            if gap is None or gap < least_change:
                break
        else:
            now = new
    return now


def relative(sim: DataFrame) -> DataFrame:
    """Each cell over the greatest of its row."""
    top = sim.groupBy("src_id").agg(F.max("similarity").alias("_t"))
    return sim.join(top, "src_id").select(*PAIR, F.when(F.col("_t") > 0, F.col("similarity") / F.col("_t")).otherwise(0.0).alias("similarity"))


def top_two_mean(evidence: DataFrame) -> DataFrame:
    """Each pair's mean of its two best kinds of evidence; evidence: kind, src_id, tgt_id, similarity."""
    best = F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, 2)
    pairs = evidence.groupBy(*PAIR).agg(best.alias("b"))
    return pairs.select(*PAIR, (F.aggregate("b", F.lit(0.0), lambda s, x: s + x) / F.size("b")).alias("similarity"))


def structural_evidence(sim: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, threshold: float = 0.8, rounds: int = 4) -> DataFrame:
    """Iterative instance-and-structure matching: pairs at the threshold lend their parents and children evidence.

    Each round a pair's evidence from above (share of matched parents) and from below
    (share of matched children) is put beside its own similarity, and the mean of the
    two best is its new one if greater; it ends when no further pair reaches the threshold.
    """
    up_s, up_t = _sides(src_edges, tgt_edges)
    n_children = up_s.groupBy(F.col("ps").alias("src_id")).agg(F.count(F.lit(1)).alias("k"))
    n_parents = up_s.groupBy("src_id").agg(F.count(F.lit(1)).alias("k"))
    now = _cut(sim.select(*PAIR, "similarity"))
    matched = now.filter(F.col("similarity") >= threshold).count()
    for _ in range(rounds):
        good = now.filter(F.col("similarity") >= threshold).select(*PAIR)
        below = good.join(up_s, "src_id").join(up_t, "tgt_id").groupBy(F.col("ps").alias("src_id"), F.col("pt").alias("tgt_id")).agg(F.count_distinct("src_id").alias("m")).join(n_children, "src_id").select(*PAIR, (F.col("m") / F.col("k")).alias("similarity"))
        parents = good.select(F.col("src_id").alias("ps"), F.col("tgt_id").alias("pt"))
        above = parents.join(up_s, "ps").join(up_t, "pt").groupBy(*PAIR).agg(F.count_distinct("ps").alias("m")).join(n_parents, "src_id").select(*PAIR, (F.col("m") / F.col("k")).alias("similarity"))
        evidence = now.withColumn("kind", F.lit("own")).unionByName(below.withColumn("kind", F.lit("below"))).unionByName(above.withColumn("kind", F.lit("above")))
        new = top_two_mean(evidence).withColumnRenamed("similarity", "x").join(now, PAIR, "left")
        now = _cut(new.select(*PAIR, F.greatest("x", F.coalesce("similarity", F.lit(0.0))).alias("similarity")))
        before, matched = matched, now.filter(F.col("similarity") >= threshold).count()
        if matched == before:
            break
    return now


def level_bonus(sim: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, threshold: float = 0.6, bonus: tuple[float, ...] = (1.15, 1.25, 1.4)) -> DataFrame:
    """Greedy best pairs from the roots down: each is multiplied by its level's bonus, not above 1.

    Only below a best pair at the threshold are further pairs tried; the last bonus
    holds for all deeper levels.
    """
    from weft.operators.selection import greedy

    up_s, up_t = _sides(src_edges, tgt_edges)
    ds = depths(src_edges).filter("depth = 0").select(F.col("node").alias("src_id"))
    dt = depths(tgt_edges).filter("depth = 0").select(F.col("node").alias("tgt_id"))
    open_ = sim.join(ds, "src_id", "left_semi").join(dt, "tgt_id", "left_semi")
    found, level = None, 0
    while not open_.isEmpty():
        best = greedy(open_, threshold).select(*PAIR)
        factor = bonus[min(level, len(bonus) - 1)]
        found = best.withColumn("f", F.lit(factor)) if found is None else found.unionByName(best.withColumn("f", F.lit(factor)))
        below = best.withColumnRenamed("src_id", "ps").withColumnRenamed("tgt_id", "pt").join(up_s, "ps").join(up_t, "pt").select(*PAIR).distinct()
        open_ = _cut(sim.join(below, PAIR, "left_semi").join(found, PAIR, "left_anti"))
        level += 1
    if found is None:
        return sim.select(*PAIR, "similarity")
    factors = found.groupBy(*PAIR).agg(F.max("f").alias("f"))
    return sim.join(factors, PAIR, "left").select(*PAIR, F.when(F.col("f").isNotNull(), F.least(F.lit(1.0), F.col("similarity") * F.col("f"))).otherwise(F.col("similarity")).alias("similarity"))


def parent_filter(unmapped: DataFrame, mapped: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame, least: float = 0.6, otherwise: float = 0.3) -> DataFrame:
    """Unmapped pairs: 0 where both have parents and none of the parents' pairs reaches `least`, else `otherwise`."""
    up_s, up_t = _sides(src_edges, tgt_edges)
    good = mapped.filter(F.col("similarity") >= least).select(F.col("src_id").alias("ps"), F.col("tgt_id").alias("pt"), F.lit(True).alias("ok"))
    pairs = unmapped.select(*PAIR).join(up_s, "src_id", "left").join(up_t, "tgt_id", "left").join(good, ["ps", "pt"], "left")
    state = pairs.groupBy(*PAIR).agg(F.max(F.col("ps").isNotNull() & F.col("pt").isNotNull()).alias("parents"), F.max(F.coalesce("ok", F.lit(False))).alias("ok"))
    return state.select(*PAIR, F.when(F.col("parents") & ~F.col("ok"), 0.0).otherwise(otherwise).alias("similarity"))


def heights(edges: DataFrame) -> DataFrame:
    """node, height: edges on the longest way down; 0 for leaves."""
    turned = edges.filter("parent IS NOT NULL").select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    nodes = edges.select("child").distinct().withColumn("parent", F.lit(None).cast(dict(edges.dtypes)["parent"]))
    return depths(turned.unionByName(nodes)).withColumnRenamed("depth", "height")


def shape_similarity(src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """Likeness of subtrees from the leaves up: two leaves 1, a leaf and an inner node none, else the children's greedy
    matches' mean times the lesser over the greater number of children.

    One step for each height; the children's pairs of two nodes are one group.
    """
    import pandas as pd

    from weft.operators.matchers import greedy_mean_kernel

    up_s, up_t = _sides(src_edges, tgt_edges)
    hs = heights(src_edges).select(F.col("node").alias("src_id"), F.col("height").alias("hs"))
    ht = heights(tgt_edges).select(F.col("node").alias("tgt_id"), F.col("height").alias("ht"))
    kids_s = up_s.groupBy(F.col("ps").alias("src_id")).agg(F.count(F.lit(1)).alias("ks"))
    kids_t = up_t.groupBy(F.col("pt").alias("tgt_id")).agg(F.count(F.lit(1)).alias("kt"))
    done = _cut(hs.filter("hs = 0").select("src_id").crossJoin(ht.filter("ht = 0").select("tgt_id")).withColumn("similarity", F.lit(1.0)))
    inner_s, inner_t = (_cut(x) for x in (hs.filter("hs > 0").join(kids_s, "src_id"), ht.filter("ht > 0").join(kids_t, "tgt_id")))
    top = max(inner_s.agg(F.max("hs")).first()[0] or 0, inner_t.agg(F.max("ht")).first()[0] or 0)
    kinds = dict(done.dtypes)

    def score(cells: pd.DataFrame) -> pd.DataFrame:
        first = cells.iloc[0]
        matched = greedy_mean_kernel({(a, b): s for a, b, s in zip(cells.cs, cells.ct, cells.s)}, min(first.ks, first.kt))
        return pd.DataFrame({"src_id": [first.src_id], "tgt_id": [first.tgt_id], "similarity": [matched * min(first.ks, first.kt) / max(first.ks, first.kt)]})

    for level in range(1, top + 1):
        pairs = inner_s.crossJoin(inner_t).filter(F.greatest("hs", "ht") == level)
        below = done.select(F.col("src_id").alias("cs"), F.col("tgt_id").alias("ct"), F.col("similarity").alias("s"))
        of_s, of_t = up_s.select(F.col("src_id").alias("cs"), F.col("ps").alias("src_id")), up_t.select(F.col("tgt_id").alias("ct"), F.col("pt").alias("tgt_id"))
        cells = pairs.join(of_s, "src_id").join(of_t, "tgt_id").join(below, ["cs", "ct"])
        now = cells.select(*PAIR, "ks", "kt", "cs", "ct", "s").groupBy(*PAIR).applyInPandas(score, f"src_id {kinds['src_id']}, tgt_id {kinds['tgt_id']}, similarity double")
        done = _cut(done.unionByName(now))
    return done.filter("similarity > 0")


def partial_reference_scope(reference: DataFrame, src_edges: DataFrame, tgt_edges: DataFrame) -> DataFrame:
    """Pairs of nodes below one pair of a partial reference: what is matched inside its trees."""
    up_s, up_t = C.closure(src_edges), C.closure(tgt_edges)
    a = reference.select(F.col("src_id").alias("rs"), F.col("tgt_id").alias("rt"))
    below = a.join(up_s.select(F.col("low").alias("src_id"), F.col("high").alias("rs")), "rs").join(up_t.select(F.col("low").alias("tgt_id"), F.col("high").alias("rt")), "rt")
    return below.select(*PAIR).distinct()
