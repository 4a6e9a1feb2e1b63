"""Evaluation, quality measures and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.operators import candidates as C
from weft.operators import evaluation as E
from weft.operators import profiling, selection
from weft.plans.inputs import CELLS, MATS, ONE, REF, SIM, TWO, VOTES, Inputs

T = 0.6
FOUND = f"found AS (SELECT src_id, tgt_id FROM sim WHERE similarity >= {T})"
N = "n AS (SELECT (SELECT count(*) FROM found) AS f, (SELECT count(*) FROM ref) AS r, (SELECT count(*) FROM found SEMI JOIN ref USING (src_id, tgt_id)) AS c)"


def found(x: Inputs):
    return selection.at_least(x.sim, T)


def r6(df, *columns):
    return df.select(*(F.round(c, 6).alias(c) if c in columns else c for c in df.columns))


def register(add) -> None:
    add(
        "I1_row_sums",
        lambda x: r6(E.side_sums(x.sim).withColumn("mean", F.round(F.col("mean") + 1e-9, 5)), "total"),
        "SELECT src_id, round(sum(similarity), 6) AS total, max(similarity) AS most, count(*) AS n, round(avg(similarity) + 1e-9, 5) AS mean "
        "FROM sim GROUP BY 1",
        SIM,
    )
    add(
        "I1_column_sums",
        lambda x: r6(E.side_sums(x.sim, "tgt_id").withColumn("mean", F.round(F.col("mean") + 1e-9, 5)), "total"),
        "SELECT tgt_id, round(sum(similarity), 6) AS total, max(similarity) AS most, count(*) AS n, round(avg(similarity) + 1e-9, 5) AS mean "
        "FROM sim GROUP BY 1",
        SIM,
    )
    add(
        "I2_extremes",
        lambda x: x.sim.agg(F.max("similarity").alias("most"), F.count("similarity").alias("n")),
        "SELECT max(similarity) AS most, count(similarity) AS n FROM sim",
        SIM,
    )
    p, r = "CASE WHEN f > 0 THEN c / f ELSE 0 END", "CASE WHEN r > 0 THEN c / r ELSE 0 END"
    add(
        "I4_accuracy",
        lambda x: r6(E.accuracy(found(x), x.ref), "precision", "recall", "f"),
        f"WITH {FOUND}, {N}, q AS (SELECT f AS n_found, r AS n_reference, c AS n_correct, {p} AS p, {r} AS r FROM n) "
        f"SELECT n_found, n_reference, n_correct, round(p, 6)::DOUBLE AS precision, round(r, 6)::DOUBLE AS recall, round(2 * p * r / (p + r), "
        f"6) AS f FROM q",
        SIM,
        REF,
    )
    add(
        "I4_outcomes",
        lambda x: E.outcomes(found(x), x.ref),
        f"WITH {FOUND} SELECT coalesce(a.src_id, b.src_id) AS src_id, coalesce(a.tgt_id, b.tgt_id) AS tgt_id, CASE "
        f"WHEN a.src_id IS NULL THEN 'lost' WHEN b.src_id IS NULL THEN 'error' ELSE 'correct' END AS outcome FROM found a FULL JOIN ref b "
        f"ON a.src_id = b.src_id AND a.tgt_id = b.tgt_id",
        SIM,
        REF,
    )
    add("I6_delta", lambda x: E.delta(found(x), x.ref), f"WITH {FOUND}, {N} SELECT f + r - 2 * c AS delta FROM n", SIM, REF)
    swept = "w AS (SELECT s.step, (SELECT count(*) FROM b WHERE bin >= s.step) AS f, (SELECT count(*) FROM b WHERE bin >= s.step AND k) AS c FROM (SELECT unnest(range({0}, 101)) AS step) s), b AS (SELECT floor(similarity * 100 + 1e-9) AS bin, ref.src_id IS NOT NULL AS k FROM sim LEFT JOIN ref USING (src_id, tgt_id)), t AS (SELECT count(*) AS r FROM ref), q AS (SELECT step / 100 AS threshold, f AS n_found, c AS n_correct, CASE WHEN f > 0 THEN c / f ELSE 0 END AS p, c / r AS r FROM w CROSS JOIN t)"
    table = "SELECT threshold, n_found, n_correct, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM q"
    order = lambda s: "b AS" + s.split(", b AS")[1].split(", t AS")[0] + ", " + s.split(", b AS")[0] + ", t AS" + s.split(", t AS")[1]
    add("I7_sweep", lambda x: r6(E.sweep(x.sim, x.ref), "precision", "recall", "f"), f"WITH {order(swept.format(20))} {table}", SIM, REF)
    add(
        "I7_best_threshold",
        lambda x: r6(E.best_threshold(r6(E.sweep(x.sim, x.ref), "f")), "f"),
        f"WITH {order(swept.format(20))}, z AS ({table}) SELECT threshold, f FROM z ORDER BY f DESC, threshold LIMIT 1",
        SIM,
        REF,
    )
    add("I9_sweep_all", lambda x: r6(E.sweep(x.sim, x.ref, 0, 100), "precision", "recall", "f"), f"WITH {order(swept.format(0))} {table}", SIM, REF)
    n_t = lambda x: x.table("part").count()
    local = "k AS (SELECT src_id, similarity, row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) = 1 AND similarity >= 0.01 AS k FROM sim), lc AS (SELECT src_id, greatest(0, sum(similarity) FILTER (k) - sum(CASE WHEN k THEN 0 ELSE similarity END) / ((SELECT count(*) FROM part) - 1)) AS confidence FROM k GROUP BY 1)"
    add(
        "I10_local_confidence",
        lambda x: r6(E.local_confidence(x.sim, n_t(x)), "confidence"),
        f"WITH {local} SELECT src_id, round(confidence, 6) AS confidence FROM lc",
        SIM,
    )
    add(
        "I11_global_confidence",
        lambda x: r6(E.global_confidence(E.local_confidence(x.sim, n_t(x))), "confidence"),
        f"WITH {local} SELECT round(avg(confidence), 6) AS confidence FROM lc WHERE confidence > 0",
        SIM,
    )
    up = "{1} AS (SELECT child AS low, parent AS high FROM {0} WHERE parent IS NOT NULL UNION SELECT {1}.low, e.parent FROM {1} JOIN {0} e ON {1}.high = e.child WHERE e.parent IS NOT NULL)"
    tops = "m AS (SELECT src_id, tgt_id FROM cells QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) = 1)"
    add(
        "I12_order",
        lambda x: r6(E.order_preservation(selection.top_per(x.cells, "src"), C.closure(x.one_edges).select("low", "high"), C.closure(x.two_edges).select("low", "high")), "preservation"),
        f"WITH {up.format('one_edges', 'ua')}, {up.format('two_edges', 'ub')}, {tops}, d AS (SELECT count(*) FILTER ((ua.low IS NULL) <> "
        f"(ub.low IS NULL)) AS d FROM m a CROSS JOIN m b LEFT JOIN ua ON ua.low = a.src_id AND ua.high = b.src_id LEFT JOIN ub "
        f"ON ub.low = a.tgt_id AND ub.high = b.tgt_id) SELECT round(1 - d / ((SELECT count(*) FROM m) * ((SELECT count(*) "
        f"FROM m) - 1) / 2), 6) AS preservation FROM d",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "I14_coupling",
        lambda x: r6(E.coupling(x.sim), "coupling"),
        "WITH b AS (SELECT src_id, tgt_id FROM sim QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) = 1) "
        "SELECT round(count(DISTINCT tgt_id) / count(*), 6) AS coupling FROM b",
        SIM,
    )
    spread = "greatest(0, sum(similarity * similarity) / 3 - (sum(similarity) / 3) * (sum(similarity) / 3))"
    for name, scale in (("I18_variance", 1.0), ("I19_scaled_variance", 4.0)):
        add(
            name,
            lambda x, s=scale: r6(E.variance(x.mats, 3, s), "variance"),
            f"SELECT src_id, tgt_id, round({scale} * {spread}, 6) AS variance FROM mats GROUP BY 1, 2",
            MATS,
        )
    for name, kind, value in (("I20_cross_count", "count", "count(*) FILTER (similarity > 0)"), ("I21_cross_sum", "sum", "sum(similarity)")):
        add(
            name,
            lambda x, k=kind: r6(E.cross_quality(x.sim, k), "quality"),
            f"WITH a AS (SELECT src_id, {value} AS v FROM sim GROUP BY 1), b AS (SELECT tgt_id, {value} AS v FROM sim GROUP BY 1) "
            f"SELECT src_id, tgt_id, round((a.v + b.v) / ((SELECT max(v) FROM a) + (SELECT max(v) FROM b)), 6) AS quality FROM sim "
            f"JOIN a USING (src_id) JOIN b USING (tgt_id)",
            SIM,
        )
    add(
        "I22_definiteness",
        lambda x: x.sim.select("src_id", "tgt_id", F.round(E.definiteness(F.col("similarity")), 6).alias("v")),
        "SELECT src_id, tgt_id, round(2 * abs(similarity - 0.5), 6) AS v FROM sim",
        SIM,
    )
    vote = lambda value: lambda x: x.counts.select("src_id", "tgt_id", F.round(value(F.col("pos"), F.col("neg")), 6).alias("v"))
    agree = "CASE WHEN pos = neg THEN 0 WHEN pos = 3 OR neg = 3 THEN 1 ELSE abs(pos - neg) / 3 END"
    add("I23_consensus", vote(E.consensus), f"SELECT src_id, tgt_id, round({agree}, 6)::DOUBLE AS v FROM counts", VOTES)
    add(
        "I24_expanded_consensus",
        lambda x: x.counts.select("src_id", "tgt_id", F.round(E.expanded_consensus(F.col("pos"), F.col("neg"), F.col("similarity"), 0.1), 6).alias("v")),
        f"WITH c AS (SELECT src_id, tgt_id, pos + CASE WHEN pos + neg = 1 AND similarity > 0.1 THEN 1 ELSE 0 END AS pos, neg + CASE "
        f"WHEN pos + neg = 1 AND similarity <= 0.1 THEN 1 ELSE 0 END AS neg FROM counts) SELECT src_id, tgt_id, round({agree}, 6)::DOUBLE AS v "
        f"FROM c",
        VOTES,
    )
    add("I25_revalidation", vote(E.revalidation_rate), "SELECT src_id, tgt_id, round((pos + neg) / 5, 6) AS v FROM counts", VOTES)
    add(
        "I26_user_disagreement",
        vote(E.user_disagreement),
        "SELECT src_id, tgt_id, round(4 * (pos / (pos + neg)) * (1 - pos / (pos + neg)), 6) AS v FROM counts",
        VOTES,
    )
    add(
        "I27_impact",
        vote(E.propagation_impact),
        "SELECT src_id, tgt_id, round(CASE WHEN pos = 3 OR neg = 3 THEN 0 "
        "ELSE least(3 - pos, 3 - neg) / greatest(3 - pos, 3 - neg) END, 6)::DOUBLE AS v FROM counts",
        VOTES,
    )
    add(
        "I28_matcher_confidence",
        lambda x: r6(E.matcher_confidence(x.mats, 0.5), "confidence"),
        "SELECT src_id, tgt_id, round(avg(abs(0.5 - similarity)), 6) AS confidence FROM mats GROUP BY 1, 2",
        MATS,
    )
    add(
        "I29_contention",
        lambda x: r6(E.contention(x.mats, 0.5), "contention"),
        "WITH d AS (SELECT src_id, tgt_id, count(*) FILTER (similarity > 0.5) AS p, count(*) AS n, list_reverse_sort(list(DISTINCT "
        "abs(similarity - 0.5))) AS d FROM mats GROUP BY 1, 2) SELECT src_id, tgt_id, round(CASE WHEN p > 0 "
        "AND p < n THEN d[1] - coalesce(d[2], 0) ELSE 1 END, 6) AS contention FROM d",
        MATS,
    )
    add(
        "I30_similarity_distance",
        lambda x: r6(E.similarity_distance(x.sim), "distance"),
        "SELECT src_id, tgt_id, round(least(similarity - lag(similarity) OVER a, lead(similarity) OVER a - similarity, similarity - "
        "lag(similarity) OVER b, lead(similarity) OVER b - similarity), 6) AS distance FROM sim WINDOW a AS (PARTITION BY src_id "
        "ORDER BY similarity, tgt_id), b AS (PARTITION BY tgt_id ORDER BY similarity, src_id)",
        SIM,
    )
    add(
        "I31_confidence",
        lambda x: x.sim.select("src_id", "tgt_id", F.round(F.abs(F.lit(T) - F.col("similarity")), 6).alias("v")),
        f"SELECT src_id, tgt_id, round(abs({T} - similarity), 6) AS v FROM sim",
        SIM,
    )
    add(
        "I33_ranking_accuracy",
        lambda x: E.ranking_accuracy(x.table("events").withColumn("wrong", F.col("event_type") == "error"), "event_id", "wrong", "user_id").withColumn("share", F.round("share", 6)),
        "SELECT user_id, event_id, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id "
        "ORDER BY event_id ROWS UNBOUNDED PRECEDING), 6) AS share FROM events",
    )

    notes = lambda x: x.one.select("id", F.explode(F.array(*(F.struct(F.lit(p).alias("predicate"), F.col(p).alias("value")) for p in ("label", "comment")))).alias("s")).select("id", "s.*")
    add(
        "J1_coverage",
        lambda x: r6(profiling.property_coverage(notes(x), x.one.count()), "coverage"),
        "SELECT 'label' AS predicate, count(*) AS n, CAST(1 AS DOUBLE) AS coverage FROM one UNION ALL "
        "SELECT 'comment', count(*) FILTER (comment <> ''), round(count(*) FILTER (comment <> '') / count(*), 6) FROM one",
        ONE,
    )
    shape = "d AS (SELECT child AS node, 0 AS depth FROM one_edges WHERE parent IS NULL UNION ALL SELECT e.child, d.depth + 1 FROM d JOIN one_edges e ON e.parent = d.node), k AS (SELECT parent, count(*) AS k FROM one_edges WHERE parent IS NOT NULL GROUP BY 1)"
    metrics = "SELECT count(*) AS n_nodes, count(*) FILTER (depth = 0) AS n_roots, max(depth) AS max_depth, round(avg(depth), 6) AS avg_depth, (SELECT round(avg(k), 6) FROM k) AS avg_children, (SELECT min(k) FROM k) AS min_children, (SELECT max(k) FROM k) AS max_children, (SELECT count(*) FROM k) AS n_inner, count(*) - (SELECT count(*) FROM k) AS n_leaves FROM d"
    add("J2_hierarchy", lambda x: r6(profiling.hierarchy_metrics(x.one_edges), "avg_depth", "avg_children"), f"WITH {shape} {metrics}", ONE)
    add(
        "J3_labels",
        lambda x: r6(profiling.label_metrics(x.two), "avg_words", "avg_length"),
        "SELECT round(avg(len(string_split(label, ' '))), 6) AS avg_words, min(len(string_split(label, ' ')))::INT AS min_words, "
        "max(len(string_split(label, ' ')))::INT AS max_words, round(avg(length(label)), 6) AS avg_length FROM two",
        TWO,
    )
    rich = lambda x: profiling.richness(x.one, x.one_edges, x.one_edges.limit(0), notes(x).select("predicate").distinct(), x.table("part").join(x.one, F.col("p_name") == F.col("label")).select(F.col("p_partkey").alias("id"), F.col("id").alias("class_id")))
    add(
        "J4_richness",
        lambda x: r6(rich(x), "inheritance_richness", "attribute_richness", "class_richness", "average_population", "null_label", "null_comment"),
        "SELECT CAST(0 AS DOUBLE) AS relationship_richness, round((n - 1) / n, 6) AS inheritance_richness, round(2 / n, 6) AS "
        "attribute_richness, round(leaf / n, 6) AS class_richness, round((SELECT count(*) "
        "FROM part) / n, 6) AS average_population, CAST(0 AS DOUBLE) AS null_label, round((n - leaf) / n, 6) AS null_comment "
        "FROM (SELECT count(*) AS n, (SELECT count(DISTINCT p_name) FROM part) AS leaf FROM one)",
        ONE,
    )
    add(
        "J5_compared",
        lambda x: r6(profiling.compared(profiling.label_metrics(x.one), profiling.label_metrics(x.two)), "likeness"),
        "WITH a AS (SELECT avg(len(string_split(label, ' '))) AS w, min(len(string_split(label, ' '))) AS x, max(len(string_split(label, ' "
        "'))) AS y, avg(length(label)) AS z FROM one), b AS (SELECT avg(len(string_split(label, ' '))) AS w, min(len(string_split(label, ' "
        "'))) AS x, max(len(string_split(label, ' '))) AS y, avg(length(label)) AS z FROM two) "
        "SELECT round((least(a.w, b.w) / greatest(a.w, b.w) + least(a.x, b.x) / greatest(a.x, b.x) + least(a.y, b.y) / greatest(a.y, b.y) + "
        "least(a.z, b.z) / greatest(a.z, b.z)) / 4, 6) AS likeness FROM a CROSS JOIN b",
        ONE,
        TWO,
    )
    add(
        "J6_couple",
        lambda x: profiling.couple_features(r6(profiling.hierarchy_metrics(x.one_edges), "avg_depth", "avg_children"), r6(profiling.hierarchy_metrics(x.two_edges), "avg_depth", "avg_children")),
    )
    add(
        "J8_configuration",
        lambda x: profiling.choose_configuration(profiling.label_metrics(x.one), x.spark.createDataFrame([("short", 1.0, 8.0), ("long", 6.0, 40.0)], "configuration string, avg_words double, avg_length double"), ["avg_words", "avg_length"]),
        "SELECT 'short' AS configuration",
    )
