"""Dealt and sparse pair scoring, flooding variants, coherent mappings, writers, loaders and registries."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import strings as S
from weft.operators import candidates as C
from weft.operators import conflicts, evaluation, feedback, matchers, selection, structure
from weft.plans import pipelines
from weft.plans.inputs import CELLS, MATS, ONE, REF, SIM, TWO, VOTES, Inputs
from weft.plans.query_feedback import shared
from weft.plans.query_matching import rounded, words
from weft.plans.query_sources import LINKS, again, cells, loaded, n_triples, rdf_xml, triples
from weft.sources import alignments, ontologies, trees


def dispatched(x: Inputs):
    """Ontology one by each loader."""
    out = None
    for language, write in (("owl", lambda p: alignments.well_formed(rdf_xml(x)).write.text(p)), ("nt", lambda p: n_triples(x).write.text(p)), ("parquet", lambda p: triples(x).write.parquet(p))):
        path = f"{shared(x)}/{language}"
        write(path)
        one = loaded(ontologies.load(x.spark, path, language)).withColumn("language", F.lit(language))
        out = one if out is None else out.unionByName(one)
    return out


def stored_triples(x: Inputs):
    """A store that is opened, added to, removed from and read."""
    store = ontologies.TripleStore(x.spark, shared(x))
    t = triples(x)
    store.add(t)
    store.add(t.filter("NOT is_literal"))
    store.remove(t.filter(F.col("p") == f"{ontologies.RDFS}subClassOf"))
    return store.read().select("s", "o")


def from_database(x: Inputs):
    """A table written to and read from a database that driver and executors share."""
    url = trees.write_embedded(x.table("nation").select("n_nationkey", "n_name"), shared(x), "nation")
    return trees.read_database(x.spark, url, "nation", **trees.EMBEDDED).select(F.col("n_nationkey"), F.col("n_name"))


def ran_tasks(x: Inputs):
    """Two tasks from loading to saving, and what they saved."""
    folder, sides = shared(x), {"one": pipelines.Side(x.one, x.one_edges), "two": pipelines.Side(x.two, x.two_edges)}
    tasks = [{"source": "one", "target": "two", "matcher": m, "selector": "threshold", "threshold": t, "output": m} for m, t in (("all-one", 0.5), ("all-zero", 0.0))]
    pipelines.run_tasks(tasks, sides.__getitem__, lambda found, name: found.write.parquet(f"{folder}/{name}"))
    saved = [x.spark.read.parquet(f"{folder}/{t['output']}").withColumn("task", F.lit(t["output"])) for t in tasks]
    return saved[0].unionByName(saved[1])


def mapped_ontologies(x: Inputs):
    """Three ontologies of numbers, mapped one to one by each return flag's best cells."""
    ends = {"A": (0, 1), "N": (0, 2), "R": (1, 2)}
    one_to_one = selection.top_per(selection.top_per(x.mats.filter("matcher = 'A'").drop("matcher"), "src"), "tgt").withColumn("m", F.lit("A"))
    for m in ("N", "R"):
        one_to_one = one_to_one.unionByName(selection.top_per(selection.top_per(x.mats.filter(F.col("matcher") == m).drop("matcher"), "src"), "tgt").withColumn("m", F.lit(m)))
    onto = lambda k: F.coalesce(*(F.when(F.col("m") == m, F.lit(e[k]).cast("long")) for m, e in ends.items()))
    return one_to_one.select(onto(0).alias("src_onto"), "src_id", onto(1).alias("tgt_onto"), "tgt_id", "similarity")


def rankings(x: Inputs):
    """Three rankings of the pairs that users judged: by disagreement, doubt and nearness to the threshold."""
    q = x.counts.withColumn("similarity", F.round("similarity", 6))
    by = {0: -F.least("pos", "neg"), 1: F.abs(F.col("similarity") - 0.5), 2: F.abs(F.col("similarity") - 0.6)}
    return [q.select("src_id", "tgt_id", "similarity", F.round(rank, 6).alias("rank")) for rank in by.values()]


GRAPH = "SELECT 'subClassOf' AS label, a.child AS a1, b.child AS b1, a.parent AS a2, b.parent AS b2 FROM one_edges a CROSS JOIN two_edges b WHERE a.parent IS NOT NULL AND b.parent IS NOT NULL"
BOTH = f"ed AS MATERIALIZED (SELECT DISTINCT a1, b1, a2, b2 FROM (SELECT a1, b1, a2, b2 FROM ({GRAPH}) UNION ALL SELECT a2, b2, a1, b1 FROM ({GRAPH})))"


def flooded(rounds: int, weight: str, pulled: bool) -> str:
    """CTEs r0 to r<rounds> over edges ed with a weight; a pair takes from its edges' ends or beginnings."""
    here, there = ("a1, b1", "a2 = src_id AND b2 = tgt_id") if pulled else ("a2, b2", "a1 = src_id AND b1 = tgt_id")
    steps = ["pg AS MATERIALIZED (SELECT *, " + weight + " AS w FROM ed)", "r0 AS MATERIALIZED (SELECT src_id, tgt_id, similarity AS s FROM cells)"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT src_id, tgt_id, s / max(s) OVER () AS s FROM (SELECT src_id, tgt_id, sum(s) AS s FROM (SELECT * FROM r{i - 1} UNION ALL SELECT {here}, s * w FROM r{i - 1} JOIN pg ON {there}) GROUP BY 1, 2))")
    return ", ".join(steps)


CORPUS = """cnt AS (SELECT side, id, w, count(*) AS n FROM (SELECT 's' AS side, id, unnest(string_split(label, ' ')) AS w FROM one UNION ALL SELECT 't', id, unnest(string_split(label, ' ')) FROM two) GROUP BY 1, 2, 3),
df AS (SELECT w, count(*) AS df FROM cnt GROUP BY 1), nn AS (SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM two) AS n),
wt AS (SELECT side, id, w, cnt.n * ln(1 + nn.n / df) AS v FROM cnt JOIN df USING (w) CROSS JOIN nn), u AS (SELECT side, id, w, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM wt)"""


def register(add) -> None:
    graph = lambda e: e.filter("parent IS NOT NULL").select(F.lit("subClassOf").alias("label"), F.col("child").alias("from_id"), F.col("parent").alias("to_id"))
    # A: loaders and writers
    add(
        "A5_dispatch",
        dispatched,
        f"SELECT l.below, l.above, v.language FROM ({LINKS}) l CROSS JOIN (VALUES ('owl'), ('nt'), ('parquet')) v(language)",
        ONE,
    )
    add("A7_database", from_database, "SELECT n_nationkey, n_name FROM nation")
    add(
        "A8_store",
        stored_triples,
        f"SELECT 'http://one/n' || id AS s, '{ontologies.OWL}Class' AS o FROM one UNION ALL SELECT 'http://one/n' || id, label FROM one",
        ONE,
    )
    text = lambda s, p: s.read.text(p)
    add(
        "A29_cell_lines",
        again(lambda x, p: alignments.as_cells(cells(x)).write.text(p), text),
        """SELECT '<map><Cell><entity1 rdf:resource="http://s/' || src_id || '"/><entity2 rdf:resource="http://t/' || tgt_id || '"/><measure>' || round(similarity, 4) || '</measure><relation>=</relation></Cell></map>' AS value FROM sim""",
        SIM,
    )
    add(
        "A30_arrow_lines",
        again(lambda x, p: alignments.write_arrows(cells(x), p), text),
        "SELECT 'http://s/' || src_id || ' ---> http://t/' || tgt_id || ' ' || round(similarity, 4) || ' =' AS value FROM sim",
        SIM,
    )
    add(
        "A30_table_lines",
        again(lambda x, p: alignments.write_table(cells(x), p), text),
        "SELECT 'http://s/' || src_id || chr(9) || '=' || chr(9) || 'http://t/' || tgt_id || chr(9) || round(similarity, 4) AS value FROM sim",
        SIM,
    )
    lines = again(lambda x, p: x.table("part").select(F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("value")).write.text(p), text)
    add(
        "A39_lines",
        lambda x: lines(x).groupBy("value").agg(F.count(F.lit(1)).alias("n")),
        "SELECT p_name || ' ' || p_type || ' ' || p_brand AS value, count(*) AS n FROM part GROUP BY 1",
    )
    add(
        "A39_words",
        lambda x: lines(x).select(F.explode(F.split("value", " ")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")),
        "SELECT unnest(string_split(p_name || ' ' || p_type || ' ' || p_brand, ' ')) AS word, count(*) AS n FROM part GROUP BY 1",
    )
    # B, C: what is stored, dealt and scored
    add(
        "B3_sparse_write",
        again(lambda x, p: alignments.write_matrix(x.cells, p, 0.4), lambda s, p: s.read.parquet(p)),
        "SELECT * FROM cells WHERE similarity > 0.4",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "C2_dealt_pairs",
        lambda x: C.dealt_pairs(x.one, x.two, 4),
        "SELECT one.id AS src_id, two.id AS tgt_id, ((two.id - one.id) % 4 + 4) % 4 AS stage FROM one CROSS JOIN two",
        ONE,
        TWO,
    )
    add(
        "C3_sparse_pairs",
        lambda x: rounded(C.similar_pairs(x.one, x.two, 0.55)),
        "SELECT one.id AS src_id, two.id AS tgt_id, round(1 - levenshtein(one.label, two.label) / greatest(length(one.label), "
        "length(two.label)), 6) AS similarity FROM one CROSS JOIN two "
        "WHERE 1 - levenshtein(one.label, two.label) / greatest(length(one.label), length(two.label)) >= 0.55",
        ONE,
        TWO,
    )
    names = lambda x, k: x.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("label")).filter(f"s_suppkey % 2 = {k}")
    add(
        "C3_sparse_names",
        lambda x: rounded(C.similar_pairs(names(x, 0), names(x, 1), 0.9)),
        "SELECT a.s_suppkey AS src_id, b.s_suppkey AS tgt_id, round(1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), "
        "length(b.s_name)), 6) AS similarity FROM supplier a JOIN supplier b ON a.s_suppkey % 2 = 0 AND b.s_suppkey % 2 = 1 "
        "WHERE 1 - levenshtein(a.s_name, b.s_name) / greatest(length(a.s_name), length(b.s_name)) >= 0.9",
    )
    alike = "(1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)))"
    add(
        "D15_soft_words",
        lambda x: rounded(matchers.soft_vector_words(words(x.one), words(x.two))),
        f"WITH {CORPUS}, m AS (SELECT a.id AS src_id, b.id AS tgt_id, a.w, a.v AS x, b.v AS y, {alike} AS l FROM u a JOIN u b ON a.side = 's' AND b.side = 't' WHERE {alike} >= 0.8), q AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY src_id, tgt_id, w ORDER BY l DESC, y DESC) = 1) SELECT src_id, tgt_id, round(sum(x * y * l), 6) AS similarity FROM q GROUP BY 1, 2",
        ONE,
        TWO,
    )
    # G: flooding over pairs' own graphs, and in SQL
    add(
        "G10_flooding_partial",
        lambda x: rounded(structure.relative(structure.flood(structure.pair_scoped_graph(graph(x.one_edges), graph(x.two_edges)), x.cells, 3, 0.0))),
        f"WITH {BOTH}, {flooded(3, '1.0', False)} SELECT src_id, tgt_id, round(s / max(s) OVER (PARTITION BY src_id), 6) AS similarity FROM r3",
        ONE,
        TWO,
        CELLS,
    )
    edges = lambda x: C.label_join(graph(x.one_edges), graph(x.two_edges)).select("label", F.col("from_a").alias("a1"), F.col("from_b").alias("b1"), F.col("to_a").alias("a2"), F.col("to_b").alias("b2"))
    add(
        "G11_flooding_sql",
        lambda x: rounded(structure.flood_by_sql(edges(x), x.cells, 3)),
        f"WITH {BOTH}, {flooded(3, '1.0 / count(*) OVER (PARTITION BY a1, b1)', True)} SELECT src_id, tgt_id, round(s, 6) AS similarity FROM r3",
        ONE,
        TWO,
        CELLS,
    )
    # H: selections
    add("H19_copied", lambda x: selection.copied(selection.at_least(x.sim, 0.6)), "SELECT * FROM sim WHERE similarity >= 0.6", SIM)
    add("H22_resolved", lambda x: conflicts.resolved(mapped_ontologies(x)).withColumn("similarity", F.round("similarity", 6)))
    # M, O
    ranked = "q AS (SELECT src_id, tgt_id, round(similarity, 6) AS similarity, pos, neg FROM counts), j AS (SELECT * FROM q ANTI JOIN ref USING (src_id, tgt_id))"
    heads = " UNION ALL ".join(f"(SELECT src_id, tgt_id, similarity, {i} AS list FROM j ORDER BY {by}, src_id, tgt_id LIMIT 1)" for i, by in enumerate(("-least(pos, neg)", "round(abs(similarity - 0.5), 6)", "round(abs(similarity - 0.6), 6)")))
    add(
        "M7_best_head",
        lambda x: feedback.best_head(rankings(x), x.ref),
        f"WITH {ranked}, h AS ({heads}) SELECT * FROM h WHERE similarity > 0 ORDER BY similarity DESC, list LIMIT 1",
        VOTES,
        REF,
    )
    add(
        "M29_matcher_sets",
        lambda x: x.spark.createDataFrame([(s, i, m) for s, ms in pipelines.INITIAL.items() for i, m in enumerate(ms)], "set string, place int, matcher string"),
        "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {i}, '{m}')" for s, ms in pipelines.INITIAL.items() for i, m in enumerate(ms)) + ") t(set, place, matcher)",
    )
    add(
        "M29_initial",
        lambda x: pipelines.initial(pipelines.Side(x.one, x.one_edges), pipelines.Side(x.two, x.two_edges), "orthogonal").groupBy("matcher").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("similarity"), 6).alias("most")),
    )
    add(
        "O5_batch",
        ran_tasks,
        "SELECT one.id AS src_id, two.id AS tgt_id, v.s::DOUBLE AS similarity, v.task FROM one CROSS JOIN two CROSS "
        "JOIN (VALUES (1, 'all-one'), (0, 'all-zero')) v(s, task)",
        ONE,
        TWO,
    )
    add(
        "O9_selectors",
        lambda x: pipelines.SELECTORS["threshold"](x.sim, 0.6).withColumn("selector", F.lit("threshold")).unionByName(pipelines.SELECTORS["mutual"](x.sim, 0.6).withColumn("selector", F.lit("mutual"))),
        "WITH t AS (SELECT * FROM sim WHERE similarity >= 0.6) SELECT *, 'threshold' AS selector FROM t UNION ALL SELECT *, 'mutual' FROM (SELECT * FROM t QUALIFY similarity = max(similarity) OVER (PARTITION BY src_id) AND similarity = max(similarity) OVER (PARTITION BY tgt_id))",
        SIM,
    )
    add(
        "O10_quality",
        lambda x: evaluation.measured(x.sim, x.table("part").count()).withColumn("value", F.round("value", 6)),
        "SELECT 'mean' AS metric, round(avg(similarity), 6) AS value FROM sim UNION ALL "
        "SELECT 'definiteness', round(avg(2 * abs(similarity - 0.5)), 6) FROM sim UNION ALL "
        "SELECT 'fill', round(count(*) / ((SELECT count(DISTINCT src_id) FROM sim) * (SELECT count(*) FROM part)), 6) FROM sim",
        SIM,
    )
    measure = "least(levenshtein(one.label, two.label), least(length(one.label), length(two.label))) / least(length(one.label), length(two.label))"
    add(
        "O11_measure_contract",
        lambda x: rounded(C.all_pairs(x.one.select("id", "label"), x.two.select("id", "label")).withColumn("similarity", S.MEASURES["edit"](F.col("src_label"), F.col("tgt_label")))),
        f"SELECT one.id AS src_id, two.id AS tgt_id, round(1 - {measure}, 6) AS similarity FROM one CROSS JOIN two",
        ONE,
        TWO,
    )
    add(
        "O12_stages",
        lambda x: rounded(feedback.run_stages(x.sim, x.counts, x.ref)),
        "SELECT src_id, tgt_id, round(CASE WHEN pos > neg THEN 1.0 WHEN neg > pos THEN 0.0 ELSE s.similarity END, 6)::DOUBLE AS similarity "
        "FROM sim s FULL JOIN counts c USING (src_id, tgt_id) WHERE s.similarity IS NOT NULL OR pos <> neg",
        SIM,
        VOTES,
    )
