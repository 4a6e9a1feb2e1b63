"""Votes: ranking, aggregation, propagation, clusters and streams."""

from __future__ import annotations

import tempfile

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators import candidates as C
from weft.operators import combination, evaluation, feedback, selection
from weft.operators.cut import shared_folder
from weft.plans.inputs import CELLS, MATS, ONE, REF, SIM, TWO, VOTES, Inputs
from weft.streaming import feedback as streams

M = ["A", "N", "R"]


def signatures(x: Inputs):
    return combination.signatures(x.mats, M)


def labelled(x: Inputs):
    """Pairs that all three matchers have, judged by whether they are in the reference."""
    some = x.mats.groupBy("src_id", "tgt_id").agg(F.count(F.lit(1)).alias("k")).filter("k = 3").select("src_id", "tgt_id")
    return signatures(x).join(some, ["src_id", "tgt_id"]).join(x.ref.withColumn("label", F.lit(1)), ["src_id", "tgt_id"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


SIGN = 'sg AS (SELECT src_id, tgt_id, coalesce(max(similarity) FILTER (matcher = \'A\'), 0) AS a, coalesce(max(similarity) FILTER (matcher = \'N\'), 0) AS n, coalesce(max(similarity) FILTER (matcher = \'R\'), 0) AS r, count(*) AS k FROM mats GROUP BY 1, 2), lb AS (SELECT sg.*, CASE WHEN ref.src_id IS NULL THEN 0 ELSE 1 END AS label FROM sg LEFT JOIN ref USING (src_id, tgt_id) WHERE k = 3)'
NEAR = "nr AS (SELECT sg.src_id, sg.tgt_id, lb.label, sqrt(pow(sg.a - lb.a, 2) + pow(sg.n - lb.n, 2) + pow(sg.r - lb.r, 2)) AS d FROM sg CROSS JOIN lb WHERE sqrt(pow(sg.a - lb.a, 2) + pow(sg.n - lb.n, 2) + pow(sg.r - lb.r, 2)) <= 0.3 QUALIFY row_number() OVER (PARTITION BY sg.src_id, sg.tgt_id ORDER BY d, lb.label) = 1)"


def near(x: Inputs):
    return feedback.nearest_labels(signatures(x), labelled(x), M, 0.3)


def shared(x: Inputs) -> str:
    """A new folder that executors share, for what a query writes on its way."""
    base = shared_folder(x.spark)
    if base is None:
        master = x.spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="weft-")
    return f"{base}/weft-{x.spark.sql('SELECT uuid()').first()[0]}"


def streamed(x: Inputs, mode: str):
    rows = streams.events(x.spark, x.sf_dir)
    if mode == "complete":
        pairs = rows.select(F.col("user_id").alias("src_id"), F.get_json_object("props", "$.k").cast("long").alias("tgt_id"), F.col("event_type").isin("purchase", "signup", "click").alias("is_correct"))
        made, schema = streams.running_votes(pairs), "src_id long, tgt_id long, pos long, neg long"
    else:
        made, schema = streams.volume(rows), "start timestamp, event_type string, n long"
    out = shared(x)
    streams.run_available(made, f"{out}/result", f"{out}/state", mode)
    return x.spark.read.schema(schema).parquet(f"{out}/result")


def register(add) -> None:
    rounded = lambda df: df.select("src_id", "tgt_id", F.round("similarity", 6).alias("similarity"))
    add(
        "M2_disagreement_rank",
        lambda x: feedback.ranked(feedback.unvalidated(evaluation.variance(x.mats, 3).withColumn("variance", F.round("variance", 6)), x.ref), "variance", 50),
        "WITH v AS (SELECT src_id, tgt_id, round(greatest(0, sum(similarity * similarity) / 3 - (sum(similarity) / 3) * (sum(similarity) / "
        "3)), 6) AS variance FROM mats GROUP BY 1, 2) SELECT v.* FROM v ANTI JOIN ref USING (src_id, tgt_id) "
        "ORDER BY variance DESC, src_id, tgt_id LIMIT 50",
        MATS,
        REF,
    )
    cross = "q AS (SELECT src_id, tgt_id, similarity, (count(*) OVER (PARTITION BY src_id) + count(*) OVER (PARTITION BY tgt_id)) / ((SELECT max(c) FROM (SELECT count(*) AS c FROM sim GROUP BY src_id)) + (SELECT max(c) FROM (SELECT count(*) AS c FROM sim GROUP BY tgt_id))) AS quality FROM sim)"
    add(
        "M3_quality_rank",
        lambda x: x.sim.join(evaluation.cross_quality(x.sim), ["src_id", "tgt_id"]).select("src_id", "tgt_id", F.round(feedback.quality_rank(F.col("quality"), evaluation.definiteness(F.col("similarity"))), 6).alias("rank")),
        f"WITH {cross} SELECT src_id, tgt_id, round(0.5 * quality + 0.5 * (1 - 2 * abs(similarity - 0.5)), 6) AS rank FROM q",
        SIM,
    )
    agree = "CASE WHEN pos = neg THEN 0 WHEN pos = 3 OR neg = 3 THEN 1 ELSE abs(pos - neg) / 3 END"
    impact = "CASE WHEN pos = 3 OR neg = 3 THEN 0 ELSE least(3 - pos, 3 - neg) / greatest(3 - pos, 3 - neg) END"
    revalidation = lambda p, n: feedback.revalidation_rank(evaluation.consensus(p, n), F.col("similarity"), evaluation.propagation_impact(p, n))
    add(
        "M4_revalidation_rank",
        lambda x: x.counts.select("src_id", "tgt_id", F.round(revalidation(F.col("pos"), F.col("neg")), 6).alias("rank")),
        f"SELECT src_id, tgt_id, round(0.4 * (1 - {agree}) + 0.2 * similarity + 0.4 * {impact}, 6) AS rank FROM counts",
        VOTES,
    )
    both = lambda: [evaluation.definiteness(F.col("similarity")), F.col("similarity")]
    for how, value in (("max", "greatest(2 * abs(similarity - 0.5), similarity)"), ("min", "least(2 * abs(similarity - 0.5), similarity)"), ("avg", "(2 * abs(similarity - 0.5) + similarity) / 2")):
        add(
            f"M5_rank_{how}",
            lambda x, h=how: x.sim.select("src_id", "tgt_id", F.round(feedback.combined_rank(both(), h), 6).alias("rank")),
            f"SELECT src_id, tgt_id, round({value}, 6) AS rank FROM sim",
            SIM,
        )
    tops = lambda x, by: feedback.ranked(x.sim, by, 30).withColumn("rank", F.row_number().over(W.orderBy(F.desc("similarity"), "src_id", "tgt_id")))
    add(
        "M8_interleaved",
        lambda x: feedback.interleaved([(tops(x, "similarity"), 2), (tops(x, "similarity"), 1)]),
        "WITH t AS (SELECT src_id, tgt_id, row_number() OVER (ORDER BY similarity DESC, src_id, tgt_id) AS rank FROM sim QUALIFY rank <= 30) "
        "SELECT src_id, tgt_id, (rank - 1) // 2 AS turn, 0 AS place, rank::INT AS rank FROM t",
        SIM,
    )
    add(
        "M9_assigned",
        lambda x: feedback.assigned(tops(x, "similarity").select("src_id", "tgt_id", "rank"), x.table("events").select("user_id").distinct(), x.votes.select(F.col("src_id").alias("user_id"), F.col("src_id"), F.col("tgt_id")).distinct(), 5),
        "WITH t AS (SELECT src_id, tgt_id, row_number() OVER (ORDER BY similarity DESC, src_id, tgt_id) AS rank FROM sim "
        "QUALIFY rank <= 30), o AS (SELECT u.user_id, t.* FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN t WHERE NOT EXISTS (SELECT 1 "
        "FROM votes v WHERE v.src_id = u.user_id AND t.src_id = v.src_id AND t.tgt_id = v.tgt_id)) "
        "SELECT user_id, src_id, tgt_id, rank::INT AS rank, (row_number() OVER (PARTITION BY user_id ORDER BY rank))::INT AS place FROM o "
        "QUALIFY place <= 5",
        SIM,
        VOTES,
    )
    add(
        "M11_relevance",
        lambda x: feedback.concept_relevance(x.one_edges).withColumn("specificity", F.round("specificity", 6)),
        "WITH d AS (SELECT child AS node, 0 AS depth FROM one_edges WHERE parent IS NULL UNION ALL SELECT e.child, d.depth + 1 FROM d "
        "JOIN one_edges e ON e.parent = d.node) SELECT node, round(depth / (SELECT max(depth) FROM d), 6) AS specificity, (SELECT count(*) "
        "FROM one_edges e WHERE e.parent = d.node) + (SELECT count(*) FROM one_edges a JOIN one_edges b ON a.parent = b.parent "
        "AND a.child <> b.child WHERE a.child = d.node) AS family FROM d",
        ONE,
    )
    add(
        "M13_oracle",
        lambda x: feedback.oracle(x.sim, x.ref),
        "SELECT src_id, tgt_id, ref.src_id IS NOT NULL AS is_correct FROM sim LEFT JOIN ref USING (src_id, tgt_id)",
        SIM,
        REF,
    )
    add("M14_noisy", lambda x: feedback.noisy(feedback.oracle(x.sim, x.ref), 0.1))
    add("M15_votes", lambda x: feedback.votes(x.votes), "SELECT src_id, tgt_id, pos, neg FROM counts", VOTES)
    add(
        "M15_decided",
        lambda x: feedback.decided(x.counts),
        "SELECT src_id, tgt_id, CASE WHEN pos > neg THEN 1 ELSE 0 END::DOUBLE AS similarity FROM counts WHERE pos <> neg",
        VOTES,
    )
    add(
        "M15_applied",
        lambda x: rounded(feedback.apply_votes(x.counts.select("src_id", "tgt_id", "similarity"), x.counts)),
        "SELECT src_id, tgt_id, round(CASE WHEN pos > neg THEN 1 WHEN pos < neg THEN 0 ELSE similarity END, 6)::DOUBLE AS similarity "
        "FROM counts",
        VOTES,
    )
    add("M15_stream", lambda x: streamed(x, "complete"), "SELECT src_id, tgt_id, pos, neg FROM counts", VOTES)
    add(
        "M15_stream_volume",
        lambda x: streamed(x, "append"),
        "SELECT time_bucket(INTERVAL 1 hour, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 "
        "HAVING time_bucket(INTERVAL 1 hour, ts) + INTERVAL 1 hour <= (SELECT max(ts) FROM events) - INTERVAL 10 minutes",
    )
    add(
        "M16_euclidean",
        lambda x: rounded(feedback.euclidean_propagation(x.sim, near(x))),
        f"WITH {SIGN}, {NEAR} SELECT src_id, tgt_id, round(coalesce(label, similarity), 6)::DOUBLE AS similarity FROM sim LEFT "
        f"JOIN nr USING (src_id, tgt_id)",
        SIM,
        MATS,
        REF,
    )
    add(
        "M17_log_distance",
        lambda x: rounded(feedback.log_propagation(x.sim, near(x))),
        f"WITH {SIGN}, {NEAR} SELECT src_id, tgt_id, round(CASE WHEN label IS NULL THEN similarity ELSE greatest(0, least(1, similarity + CASE "
        f"WHEN label = 1 THEN 1.2 ELSE -1.2 END * ln(2 - d))) END, 6)::DOUBLE AS similarity FROM sim LEFT JOIN nr USING (src_id, tgt_id)",
        SIM,
        MATS,
        REF,
    )
    add("M18_regression", lambda x: rounded(feedback.regression(signatures(x), labelled(x), M)))
    add(
        "M19_quality",
        lambda x: rounded(feedback.quality_propagation(x.sim, near(x), F.lit(0.2), evaluation.definiteness(F.col("similarity")))),
        f"WITH {SIGN}, {NEAR} SELECT src_id, tgt_id, round(CASE WHEN label IS NULL THEN similarity ELSE greatest(0, least(1, similarity + CASE "
        f"WHEN label = 1 THEN 0.2 ELSE -0.2 END * (1 - abs(similarity - 0.5)))) END, 6)::DOUBLE AS similarity FROM sim LEFT "
        f"JOIN nr USING (src_id, tgt_id)",
        SIM,
        MATS,
        REF,
    )
    add(
        "M20_exact",
        lambda x: rounded(feedback.exact_propagation(x.sim, signatures(x), labelled(x), M)),
        f"WITH {SIGN}, e AS (SELECT a, n, r, min(label) AS label FROM lb GROUP BY 1, 2, 3), s AS (SELECT sg.src_id, sg.tgt_id, e.label FROM sg "
        f"JOIN e USING (a, n, r)), y AS (SELECT * FROM lb WHERE label = 1) SELECT sim.src_id, sim.tgt_id, round(CASE WHEN EXISTS (SELECT 1 "
        f"FROM y WHERE y.src_id = sim.src_id AND y.tgt_id = sim.tgt_id) THEN 1 WHEN sim.src_id IN (SELECT src_id "
        f"FROM y) OR sim.tgt_id IN (SELECT tgt_id FROM y) THEN 0 ELSE coalesce(s.label, similarity) END, 6)::DOUBLE AS similarity FROM sim LEFT "
        f"JOIN s USING (src_id, tgt_id)",
        SIM,
        MATS,
        REF,
    )
    add(
        "M21_learned",
        lambda x: rounded(combination.learned(x.mats, M, labelled(x).select("src_id", "tgt_id", (F.col("label") == 1).alias("is_match")))),
    )
    seed = {"A": 0.5, "N": 0.5, "R": 0.5}
    inside = "t AS (SELECT src_id, tgt_id FROM mats GROUP BY 1, 2 HAVING count(*) = 3 AND count(*) FILTER (abs(similarity - 0.5) <= 0.2) = 3)"
    add("M23_threshold_cluster", lambda x: feedback.threshold_cluster(x.mats, seed, 0.2), f"WITH {inside} SELECT * FROM t", MATS)
    add(
        "M22_cluster_boost",
        lambda x: rounded(feedback.cluster_boost(x.sim, feedback.threshold_cluster(x.mats, seed, 0.2), True)),
        f"WITH {inside} SELECT src_id, tgt_id, round(CASE WHEN t.src_id IS NULL THEN similarity "
        f"ELSE 0.9 * similarity + 0.1 END, 6) AS similarity FROM sim LEFT JOIN t USING (src_id, tgt_id)",
        SIM,
        MATS,
    )
    add("M24_centroids", lambda x: feedback.centroid_clusters(signatures(x), M, 4))
    sib = "a AS (SELECT x.child AS n, y.child AS s FROM one_edges x JOIN one_edges y ON x.parent = y.parent AND x.child <> y.child), b AS (SELECT x.child AS n, y.child AS s FROM two_edges x JOIN two_edges y ON x.parent = y.parent AND x.child <> y.child)"
    add(
        "M25_siblings",
        lambda x: rounded(feedback.sibling_extrapolation(x.cells, selection.top_per(x.cells, "src", 1, 0.5), C.siblings(x.one_edges), C.siblings(x.two_edges))),
        f"WITH {sib}, k AS (SELECT * FROM cells WHERE similarity >= 0.5 QUALIFY row_number() OVER (PARTITION BY src_id "
        f"ORDER BY similarity DESC, tgt_id DESC) = 1), h AS (SELECT src_id, tgt_id FROM k UNION SELECT c.src_id, c.tgt_id FROM k JOIN a "
        f"ON a.n = k.src_id JOIN b ON b.n = k.tgt_id JOIN cells c ON c.src_id = a.s AND c.tgt_id = b.s "
        f"WHERE abs(c.similarity - k.similarity) <= 0.01) SELECT src_id, tgt_id, round(CASE WHEN h.src_id IS NULL THEN similarity "
        f"ELSE 1 END, 6)::DOUBLE AS similarity FROM cells LEFT JOIN h USING (src_id, tgt_id)",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "M26_iterations",
        lambda x: x.spark.createDataFrame(feedback.loop(x.cells.persist(), x.cells.filter("similarity >= 0.55").select("src_id", "tgt_id"), 2, 20), "iteration int, precision double, recall double, f double, delta long"),
    )
