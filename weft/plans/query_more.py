"""Further operators of the inventory: loaders, dictionary matchers, repair, structural quality, ranking, senses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from weft.functions import normalise as N
from weft.functions import strings as S
from weft.operators import candidates as C
from weft.operators import combination, embedding, evaluation, feedback, instances, lexicon, matchers, selection, structure
from weft.plans.inputs import CELLS, MATS, ONE, REF, SIM, TWO, VOTES, Inputs
from weft.plans.query_matching import DICT, UP, dictionary, rounded, words
from weft.plans.query_sources import again, cells
from weft.sources import alignments, corpora, ontologies, trees

TAGS = "tag AS (SELECT id, unnest(string_split(label, ' ')) AS form FROM {0})"


def relation_cells(x: Inputs):
    rel = F.when(F.col("similarity") >= 0.5, "=").otherwise("<")
    return x.cells.filter("similarity >= 0.4").withColumn("relation", rel)


RC = "rc AS (SELECT *, CASE WHEN similarity >= 0.5 THEN '=' ELSE '<' END AS relation FROM cells WHERE similarity >= 0.4)"


def xml_tree(x: Inputs):
    """Ontology one as one nested XML document."""
    rows = x.of("one", ONE).select("label", "above").collect()  # a list of concepts
    below: dict = {}
    for r in rows:
        below.setdefault(r.above, []).append(r.label)
    say = lambda label: f'<c id="{label}" label="{label}">' + "".join(map(say, sorted(below.get(label, [])))) + "</c>"
    return x.spark.createDataFrame([("".join(map(say, below[None])),)], "value string")


#: Trees of three levels. The roots' children are matched by taking their best pairs one after another.
SHAPES = """
WITH k AS (SELECT e.child AS id, count(c.child) AS k, e.parent IS NULL AS root FROM one_edges e LEFT JOIN one_edges c ON c.parent = e.child GROUP BY 1, 3),
l AS (SELECT e.child AS id, count(c.child) AS k, e.parent IS NULL AS root FROM two_edges e LEFT JOIN two_edges c ON c.parent = e.child GROUP BY 1, 3),
pr AS (
  SELECT k.id AS i, l.id AS j, least(k.k, l.k) / greatest(k.k, l.k) AS s, row_number() OVER (ORDER BY least(k.k, l.k) / greatest(k.k, l.k) DESC, k.id, l.id) AS n
  FROM k CROSS JOIN l WHERE k.k > 0 AND l.k > 0 AND NOT k.root AND NOT l.root
), g AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS r, []::BIGINT[] AS c, 0::DOUBLE AS t
  UNION ALL
  SELECT pr.n, CASE WHEN list_contains(r, i) OR list_contains(c, j) THEN r ELSE list_append(r, i) END,
    CASE WHEN list_contains(r, i) OR list_contains(c, j) THEN c ELSE list_append(c, j) END,
    t + CASE WHEN list_contains(r, i) OR list_contains(c, j) THEN 0 ELSE s END
  FROM g JOIN pr ON pr.n = g.n + 1
), top AS (SELECT max(t) AS t FROM g)
SELECT k.id AS src_id, l.id AS tgt_id,
  round(CASE WHEN k.k = 0 THEN 1 WHEN k.root THEN t / greatest(k.k, l.k) ELSE least(k.k, l.k) / greatest(k.k, l.k) END, 6)::DOUBLE AS similarity
FROM k CROSS JOIN l CROSS JOIN top WHERE (k.k = 0) = (l.k = 0) AND (k.k = 0 OR k.root = l.root)
"""


def linked(o: ontologies.Ontology):
    names = o.concepts.select("id", "label")
    a, b = names.select(F.col("id").alias("child"), F.col("label").alias("below")), names.select(F.col("id").alias("parent"), F.col("label").alias("above"))
    return o.edges.join(a, "child").join(b, "parent", "left").select("below", "above")


def turtle(x: Inputs):
    body = F.concat(F.lit('x:s'), "s_suppkey", F.lit(' a x:Supplier ;\n  x:name "'), "s_name", F.lit('" ;\n  x:nation '), "s_nationkey", F.lit(" ."))
    return x.table("supplier").agg(F.concat(F.lit("@prefix x: <http://x/> .\n"), F.array_join(F.sort_array(F.collect_list(body)), "\n")).alias("value"))


def register(add) -> None:
    # A
    add(
        "A3_xml_tree",
        lambda x: linked(trees.from_xml(xml_tree(x).withColumn("doc", F.lit(1)), "doc", "value")),
        "SELECT label AS below, above FROM one",
        ONE,
    )
    add(
        "A11_turtle",
        again(lambda x, p: turtle(x).write.text(p), lambda s, p: instances.grouped(trees.turtle_triples(s.read.text(p, wholetext=True), "value").select(F.col("s").alias("id"), ontologies.local_name(F.col("p")).alias("predicate"), F.col("o").alias("value"))).select("id", F.element_at("props", "name")[0].alias("name"), F.element_at("props", "nation")[0].alias("nation"))),
        "SELECT 'http://x/s' || s_suppkey AS id, s_name AS name, s_nationkey::STRING AS nation FROM supplier",
    )
    add(
        "A17_places",
        again(lambda x, p: x.table("supplier").select(F.concat_ws("\t", "s_suppkey", "s_name", "s_name", F.lit(""), F.lit("1.5"), F.lit("2.5"), F.lit("P"), F.lit("PPL"), "s_nationkey", *[F.lit("")] * 5, F.lit("10"), F.lit(""), F.lit("3"), F.lit("UTC"), F.lit("2020-01-02")).alias("value")).write.text(p), lambda s, p: corpora.read_places(s, p).select("geonameid", "name", "latitude", "country_code", "population", F.col("modification_date").cast("string").alias("day"))),
        "SELECT s_suppkey AS geonameid, s_name AS name, 1.5::DOUBLE AS latitude, s_nationkey::STRING AS country_code, 10::BIGINT AS "
        "population, '2020-01-02' AS day FROM supplier",
    )
    add(
        "A18_keyword_index",
        lambda x: C.keyword_index(x.table("part").withColumnRenamed("p_partkey", "id"), "p_name"),
        "SELECT word, id, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word, p_partkey AS id FROM part) GROUP BY 1, 2",
    )
    add(
        "A18_search",
        lambda x: C.search(C.keyword_index(x.table("part").withColumnRenamed("p_partkey", "id"), "p_name"), ["ring", "small"]),
        "SELECT p_partkey AS id, (p_name LIKE '% ring')::BIGINT + (p_name LIKE 'small %')::BIGINT AS hits FROM part "
        "WHERE p_name LIKE '% ring' OR p_name LIKE 'small %'",
    )
    add(
        "A19_expanded_keywords",
        lambda x: C.expanded_keywords(words(x.one), x.spark.createDataFrame([("ring", "finger band")], "short string, long string")).select("id", F.array_join("words", " ").alias("w")),
        f"WITH {TAGS.format('one')} SELECT id, string_agg(DISTINCT form, ' ' ORDER BY form) AS w FROM (SELECT * FROM tag UNION ALL "
        f"SELECT id, unnest(['finger', 'band']) FROM tag WHERE form = 'ring') GROUP BY 1",
        ONE,
    )
    add(
        "A21_old_cells",
        again(lambda x, p: cells(x).select(F.concat(F.lit("<align entity1='"), "source", F.lit("' entity2='"), "target", F.lit("' measure='"), F.col("similarity").cast("string"), F.lit("'/>")).alias("value")).write.text(p), trees.read_old_cells),
        "SELECT 'http://s/' || src_id AS source, 'http://t/' || tgt_id AS target, round(similarity, 4) AS similarity, '=' AS relation, "
        "CAST(NULL AS STRING) AS provenance FROM sim",
        SIM,
    )
    add(
        "A32_stored_result",
        again(lambda x, p: x.sim.withColumn("align_type", F.lit("class")).write.partitionBy("align_type").parquet(p), lambda s, p: s.read.parquet(p).filter("align_type = 'class'")),
        "SELECT *, 'class' AS align_type FROM sim",
        SIM,
    )
    add(
        "A34_xml_tasks",
        again(lambda x, p: alignments.well_formed(x.table("nation").select(F.concat(F.lit('<task name="'), "n_name", F.lit('" source="a" target="b" matcher="base"/>')).alias("value")), "<tasks>", "</tasks>").write.text(p), trees.read_xml_tasks),
        "SELECT n_name AS name, 'a' AS source, 'b' AS target, 'base' AS matcher FROM nation",
    )
    # B
    add("B8_relation", lambda x: relation_cells(x).filter("relation = '='"), f"WITH {RC} SELECT * FROM rc WHERE relation = '='", ONE, TWO, CELLS)
    add(
        "B9_named_nodes",
        lambda x: x.one.filter(~F.startswith(F.col("label"), F.lit("_:"))).select("id", "label"),
        "SELECT id, label FROM one WHERE label NOT LIKE '\\_:%' ESCAPE '\\'",
        ONE,
    )
    add(
        "B10_available_weights",
        lambda x: x.one.crossJoin(x.two.select(F.col("comment").alias("c2"), F.col("label").alias("l2"))).select("label", "l2", matchers.available_weights({"local_name": 0.3, "label": 0.7}, (F.col("comment"), F.col("c2")), (F.col("label"), F.col("l2")))["label"].alias("w")),
        "SELECT one.label, two.label AS l2, CASE WHEN one.comment = '' OR two.comment = '' THEN 1.0 ELSE 0.7 END::DOUBLE AS w FROM one CROSS "
        "JOIN two",
        ONE,
        TWO,
    )
    add(
        "B13_candidate_labels",
        lambda x: x.table("supplier").select("s_suppkey", N.candidate_label(F.concat("s_name", F.lit(", A Big (old)"))).alias("t")),
        "SELECT s_suppkey, 'Big ' || s_name AS t FROM supplier",
    )
    # C
    add(
        "C15_restrictions",
        lambda x: C.restricted_classes(x.spark.sql("SELECT concat('c', s_suppkey) AS s, 'subClassOf' AS p, concat('r', s_suppkey) AS o FROM {t} UNION ALL SELECT concat('r', s_suppkey), 'onProperty', 'nation' FROM {t} UNION ALL SELECT concat('r', s_suppkey), 'hasValue', cast(s_nationkey AS string) FROM {t}", t=x.table("supplier"))),
        "SELECT 'c' || s_suppkey AS class, 'nation' AS property, s_nationkey::STRING AS filler FROM supplier",
    )
    add(
        "C16_third",
        lambda x: C.inferred_by_third(x.one.select(F.col("id").alias("src_id"), F.col("id").alias("tgt_id")), x.one_edges, x.one, x.one),
        "SELECT parent AS src_id, child AS tgt_id, '>' AS relation FROM one_edges WHERE parent IS NOT NULL",
        ONE,
    )
    # D, E
    comments = "cnt AS (SELECT side, id, w, count(*) AS n FROM (SELECT 's' AS side, id, unnest(string_split(comment, '#')) AS w FROM one UNION ALL SELECT 't', id, unnest(string_split(comment, '#')) FROM two) GROUP BY 1, 2, 3), df AS (SELECT w, count(*) AS df FROM cnt GROUP BY 1), nn AS (SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM two) AS n), wt AS (SELECT side, id, w, cnt.n * ln(1 + nn.n / df) AS v FROM cnt JOIN df USING (w) CROSS JOIN nn), u AS (SELECT side, id, w, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM wt)"
    add(
        "D14_corpus_cosine",
        lambda x: rounded(matchers.vector_words(*(c.select("id", F.split("comment", "#").alias("words")) for c in (x.one, x.two)))),
        f"WITH {comments} SELECT a.id AS src_id, b.id AS tgt_id, round(sum(a.v * b.v), 6) AS similarity FROM u a JOIN u b ON a.side = 's' "
        f"AND b.side = 't' AND a.w = b.w GROUP BY 1, 2",
        ONE,
        TWO,
    )
    add(
        "E7_treated",
        lambda x: x.table("part").select("p_partkey", F.lower(N.separate_words(F.concat("p_type", F.lit("-"), "p_brand"))).alias("t")),
        "SELECT p_partkey, lower(p_type || ' ' || p_brand) AS t FROM part",
    )
    add(
        "E13_function_words",
        lambda x: x.table("documents").select("doc_id", F.size(N.function_words(F.split(F.lower("text"), " "))).cast("long").alias("n")),
        "SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda w: w IN ('at', 'by', 'for', 'from', 'in', 'of', 'on', 'to', "
        "'with', 'is', 'has'))) AS n FROM documents",
    )
    add(
        "E17_synonym_test",
        lambda x: x.one.select(F.col("label").alias("a")).crossJoin(x.two.select(F.col("label").alias("b"))).join(dictionary(x).select(F.col("form").alias("a"), "synset"), "a").join(dictionary(x).select(F.col("form").alias("b"), "synset"), ["b", "synset"]).select("a", "b").distinct(),
        f"WITH {DICT} SELECT DISTINCT one.label AS a, two.label AS b FROM one JOIN dict x ON x.form = one.label JOIN dict y USING (synset) "
        f"JOIN two ON two.label = y.form",
        ONE,
        TWO,
    )
    # F
    tag = lambda c: words(c).select("id", F.explode("words").alias("form"))
    own = lambda c: c.select("id", F.col("label").alias("form"))
    add(
        "F8_weighted_synonyms",
        lambda x: matchers.weighted_synonyms([(tag(x.one), tag(x.two), 0.8), (own(x.one), own(x.two), 1.0)]),
        "SELECT one.id AS src_id, two.id AS tgt_id, CASE WHEN one.label = two.label THEN 1.0 ELSE 0.8 END::DOUBLE AS similarity FROM one "
        "JOIN two ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    hyper = lambda x: x.spark.sql("SELECT DISTINCT split_part(p_name, ' ', 2) AS low, 'thing' AS high, 1 AS distance FROM {part}", part=x.table("part"))
    add(
        "F10_hypernyms_meet",
        lambda x: matchers.hypernyms_meet(x.one, x.two, dictionary(x), hyper(x)),
        f"WITH {DICT} SELECT DISTINCT one.id AS src_id, two.id AS tgt_id, CAST(1 AS DOUBLE) AS similarity FROM one JOIN dict a "
        f"ON one.label = a.form CROSS JOIN dict b JOIN two ON two.label = b.form WHERE a.synset <> b.synset",
        ONE,
        TWO,
    )
    add(
        "F13_mediating",
        lambda x: rounded(C.mediated(matchers.lexical_synonyms(x.one, x.one, dictionary(x)), matchers.lexical_synonyms(x.one, x.two, dictionary(x)))),
        f"WITH {DICT}, s AS (SELECT one.id, a.synset FROM one JOIN dict a ON one.label = a.form), t AS (SELECT two.id, b.synset FROM two "
        f"JOIN dict b ON two.label = b.form) SELECT DISTINCT s.id AS src_id, t.id AS tgt_id, round(0.95 * 0.95, 6)::DOUBLE AS similarity FROM s "
        f"JOIN t USING (synset)",
        ONE,
        TWO,
    )
    add(
        "F15_by_relation",
        lambda x: rounded(matchers.by_relation(relation_cells(x), x.cells.filter("similarity < 0.45 AND similarity >= 0.3").withColumn("relation", F.lit(">")).withColumn("similarity", F.col("similarity") + 0.1)), "relation"),
        f"WITH {RC}, d AS (SELECT src_id, tgt_id, similarity + 0.1 AS s FROM cells WHERE similarity < 0.45 AND similarity >= 0.3) "
        f"SELECT src_id, tgt_id, CASE WHEN d.s IS NULL OR coalesce(rc.similarity, -1) >= d.s THEN relation "
        f"ELSE '>' END AS relation, round(greatest(coalesce(rc.similarity, -1), coalesce(d.s, -1)), 6) AS similarity FROM rc FULL "
        f"JOIN d USING (src_id, tgt_id)",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "F15_compound_heads",
        lambda x: matchers.compound_heads(x.one),
        "SELECT id, string_split(label, ' ')[-1] AS head FROM one WHERE label LIKE '% %'",
        ONE,
    )
    add(
        "F16_shape",
        lambda x: rounded(structure.shape_similarity(x.one_edges, x.two_edges)),
        SHAPES,
        ONE,
        TWO,
    )
    add(
        "F17_subclass",
        lambda x: rounded(matchers.subclass_scores(x.one, x.one.filter("label = 'part'").unionByName(x.one), dictionary(x).unionByName(x.spark.createDataFrame([("thing", "part")], "synset string, form string")), hyper(x)), "relation"),
        f"WITH {DICT}, s AS (SELECT one.id, a.synset FROM one JOIN dict a ON one.label = a.form), r AS (SELECT id FROM one "
        f"WHERE label = 'part') SELECT r.id AS src_id, s.id AS tgt_id, '>' AS relation, CAST(0.5 AS DOUBLE) AS similarity FROM s CROSS JOIN r "
        f"UNION SELECT s.id, r.id, '<', 0.5 FROM s CROSS JOIN r",
        ONE,
    )
    add(
        "F19_imported",
        lambda x: alignments.resolved(cells(x), x.sim.select(F.col("src_id").alias("id")).distinct().withColumn("uri", F.concat(F.lit("http://s/"), "id")), x.sim.select(F.col("tgt_id").alias("id")).distinct().withColumn("uri", F.concat(F.lit("http://t/"), "id"))).select("src_id", "tgt_id", "similarity"),
        "SELECT src_id, tgt_id, round(similarity, 4) AS similarity FROM sim",
        SIM,
    )
    # G
    add(
        "G13_greedy_mean",
        lambda x: x.cells.groupBy("src_id").applyInPandas(lambda g: pd.DataFrame({"src_id": [g.src_id.iloc[0]], "score": [round(matchers.greedy_mean_kernel({(0, t): s for t, s in zip(g.tgt_id, g.similarity)}, 1), 6)]}), "src_id long, score double"),
        "SELECT src_id, round(max(similarity), 6) AS score FROM cells GROUP BY 1",
        ONE,
        TWO,
        CELLS,
    )
    nouns = "r AS (SELECT one.id AS rs, two.id AS rt FROM one JOIN two ON two.label = one.label || 's')"
    add(
        "G15_reference_scope",
        lambda x: structure.partial_reference_scope(x.one.select(F.col("id").alias("src_id"), F.concat("label", F.lit("s")).alias("l")).join(x.two.select(F.col("id").alias("tgt_id"), F.col("label").alias("l")), "l"), x.one_edges, x.two_edges),
        f"WITH {UP.format('one_edges').replace('up', 'ua')}, {UP.format('two_edges').replace('up', 'ub')}, {nouns} "
        f"SELECT DISTINCT ua.low AS src_id, ub.low AS tgt_id FROM r JOIN ua ON ua.high = rs JOIN ub ON ub.high = rt",
        ONE,
        TWO,
    )
    # H
    add(
        "H7_classified",
        lambda x: rounded(feedback.regression(combination.signatures(x.mats, ["A", "N", "R"]), combination.signatures(x.mats, ["A", "N", "R"]).join(x.ref.withColumn("label", F.lit(1.0)), ["src_id", "tgt_id"], "left").na.fill(0.0, ["label"]), ["A", "N", "R"])),
    )
    add(
        "H8_any_to_two",
        lambda x: selection.select(x.sim, 0.6, None, 2),
        "SELECT * FROM sim WHERE similarity >= 0.6 QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY similarity DESC, src_id DESC) <= 2",
        SIM,
    )
    add("H9_any_any", lambda x: selection.select(x.sim, 0.6, None, None), "SELECT * FROM sim WHERE similarity >= 0.6", SIM)
    add(
        "H23_repaired",
        lambda x: rounded(selection.repaired(selection.top_per(x.cells, "src", 1, 0.3), C.closure(x.one_edges), C.closure(x.two_edges), C.siblings(x.two_edges).select(F.col("node").alias("a"), F.col("sibling").alias("b")))),
    )
    add("H25_filled", lambda x: x.sim.withColumn("similarity", F.lit(0.5)), "SELECT src_id, tgt_id, 0.5::DOUBLE AS similarity FROM sim", SIM)
    # I
    r6 = lambda df, c: df.withColumn(c, F.round(c, 6))
    add(
        "I3_pruned_mean",
        lambda x: selection.pruned(x.sim, 0.6).select("src_id", F.round((F.col("sum_kept") + F.col("sum_pruned")) / (F.col("n_kept") + F.col("n_pruned")) + 1e-9, 5).alias("mean")),
        "SELECT src_id, round(avg(similarity) + 1e-9, 5) AS mean FROM sim GROUP BY 1",
        SIM,
    )
    add(
        "I5_plain",
        lambda x: evaluation.plain_accuracy(x.sim.filter("similarity >= 0.6"), x.ref).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f"))),
        "WITH f AS (SELECT src_id, tgt_id FROM sim WHERE similarity >= 0.6), n AS (SELECT (SELECT count(*) FROM f SEMI "
        "JOIN ref USING (src_id, tgt_id)) / (SELECT count(*) FROM f) AS p, (SELECT count(*) FROM f SEMI "
        "JOIN ref USING (src_id, tgt_id)) / (SELECT count(*) FROM ref) AS r) "
        "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f FROM n",
        SIM,
        REF,
    )
    add(
        "I8_by_relation",
        lambda x: evaluation.relation_accuracy(relation_cells(x), relation_cells(x).filter("similarity < 0.6").withColumn("relation", F.lit("="))),
        f"WITH {RC} SELECT relation, count(*) FILTER (relation = '=' "
        f"AND similarity < 0.6) AS correct, count(*) FILTER (relation = '<') AS other, count(*) FILTER (similarity >= 0.6) AS unknown FROM rc "
        f"GROUP BY 1",
        ONE,
        TWO,
        CELLS,
    )
    for name, upper in (("I13_upper", True), ("I13_lower", False)):
        add(
            name,
            lambda x, u=upper: r6(evaluation.distance_preservation(selection.top_per(x.cells, "src"), x.one_edges, x.two_edges, u), "preservation"),
        )
    add(
        "I15_inter_coupling",
        lambda x: r6(evaluation.inter_coupling(x.mats), "coupling"),
        "WITH t AS (SELECT matcher, src_id, tgt_id FROM mats QUALIFY row_number() OVER (PARTITION BY matcher, src_id "
        "ORDER BY similarity DESC, tgt_id DESC) = 1), n AS (SELECT src_id, tgt_id, count(*) AS n FROM t GROUP BY 1, 2) "
        "SELECT matcher, round(count(*) FILTER (n > 1) / count(*), 6) AS coupling FROM t JOIN n USING (src_id, tgt_id) GROUP BY 1",
        MATS,
    )
    add(
        "I16_inverse",
        lambda x: x.sim.select("src_id", "tgt_id", F.round(1 - F.col("similarity"), 6).alias("v")),
        "SELECT src_id, tgt_id, round(1 - similarity, 6) AS v FROM sim",
        SIM,
    )
    best = lambda x, m: x.mats.filter(F.col("matcher") == m).groupBy("src_id").agg(F.max("similarity").alias("weight"))
    add(
        "I17_merged",
        lambda x: r6(evaluation.merged_quality(best(x, "A"), best(x, "N")), "weight"),
        "SELECT src_id, round((max(similarity) FILTER (matcher = 'A') + max(similarity) FILTER (matcher = 'N')) / 2, 6) AS weight FROM mats "
        "GROUP BY 1 HAVING count(*) FILTER (matcher = 'A') > 0 AND count(*) FILTER (matcher = 'N') > 0",
        MATS,
    )
    add(
        "I32_f_by_user",
        lambda x: r6(x.votes.groupBy("src_id").agg(F.avg(F.col("is_correct").cast("double")).alias("p"), F.avg((F.col("value") > 50).cast("double")).alias("r")).select("src_id", evaluation.f_measure(F.col("p"), F.col("r")).alias("f")), "f"),
        "WITH q AS (SELECT src_id, avg(is_correct::INT) AS p, avg((value > 50)::INT) AS r FROM votes GROUP BY 1) SELECT src_id, round(CASE "
        "WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f FROM q",
        VOTES,
    )
    # J, K, L
    add(
        "J7_annotation_pairs",
        lambda x: C.all_pairs(x.one.select("id", "comment").filter("comment <> ''"), x.two.select("id", "comment").filter("comment <> ''")).filter("src_comment = tgt_comment").select("src_id", "tgt_id"),
        "SELECT one.id AS src_id, two.id AS tgt_id FROM one JOIN two ON one.comment = two.comment AND one.comment <> ''",
        ONE,
        TWO,
    )
    add(
        "K2_properties",
        lambda x: x.spark.createDataFrame([("prefLabel",), ("hasSynonym",), ("definition",), ("age",)], "name string").select("name", lexicon.is_synonym_property(F.col("name")).alias("s"), lexicon.is_definition_property(F.col("name")).alias("d")),
        "SELECT * FROM (VALUES ('prefLabel', true, false), ('hasSynonym', true, false), ('definition', false, true), ('age', false, false)) "
        "t(name, s, d)",
    )
    add(
        "L3_token_overlap",
        lambda x: rounded(matchers.token_similarity(words(x.one), words(x.two), kind="jaccard")),
        "SELECT one.id AS src_id, two.id AS tgt_id, round(len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) / "
        "len(list_distinct(list_concat(string_split(one.label, ' '), string_split(two.label, ' ')))), 6) AS similarity FROM one JOIN two "
        "ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    add(
        "L4_statements",
        lambda x: rounded(C.shared_predicates(instances.statements(x.one, "id", ["label"]), instances.statements(x.two, "id", ["label"]), C.all_pairs(x.one.select("id"), x.two.select("id")), S.longest_edit_similarity)),
        "SELECT one.id AS src_id, two.id AS tgt_id, round(1 - levenshtein(one.label, two.label) / greatest(length(one.label), "
        "length(two.label)), 6) AS similarity FROM one CROSS JOIN two",
        ONE,
        TWO,
    )
    # M
    add(
        "M6_single_rank",
        lambda x: feedback.ranked(x.counts.withColumn("similarity", F.round("similarity", 6)).select("src_id", "tgt_id", "similarity"), "similarity", 40),
        "SELECT src_id, tgt_id, round(similarity, 6) AS similarity FROM counts ORDER BY round(similarity, 6) DESC, src_id, tgt_id LIMIT 40",
        VOTES,
    )
    add(
        "M10_information",
        lambda x: feedback.ranked(feedback.unvalidated(x.sim.withColumn("doubt", F.round(1 - evaluation.definiteness(F.col("similarity")), 6)), x.ref).select("src_id", "tgt_id", "doubt"), "doubt", 40),
        "SELECT src_id, tgt_id, round(1 - 2 * abs(similarity - 0.5), 6) AS doubt FROM sim ANTI JOIN ref USING (src_id, tgt_id) "
        "ORDER BY doubt DESC, src_id, tgt_id LIMIT 40",
        SIM,
        REF,
    )
    add(
        "M12_concept_candidates",
        lambda x: selection.top_per(x.sim.join(x.sim.groupBy("src_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "src_id").limit(10).select("src_id"), "src_id", "left_semi"), "src", 3),
        "WITH t AS (SELECT src_id FROM sim GROUP BY 1 ORDER BY count(*) DESC, src_id LIMIT 10) SELECT * FROM sim SEMI JOIN t USING (src_id) "
        "QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) <= 3",
        SIM,
    )
    # N
    def senses(g: pd.DataFrame) -> pd.DataFrame:
        v = np.stack(g.sort_values("vec_id").embedding.to_numpy()).astype(float)
        chosen, _, _ = embedding.choose_senses(v, np.zeros((0, v.shape[1])), np.zeros(0, int), "growing", 1.0)
        return pd.DataFrame({"label": [g.label.iloc[0]], "n_senses": [int(chosen.max()) + 1]})

    add("N8_senses", lambda x: x.table("embeddings").groupBy("label").applyInPandas(senses, "label int, n_senses long"))
    add(
        "N10_sense_words",
        lambda x: embedding.ranked(embedding.vocabulary(x.table("documents"), least=5), 50).select("word", F.when(F.col("id") < 10, 5).otherwise(1).cast("long").alias("senses")),
        "SELECT word, CASE WHEN row_number() OVER (ORDER BY cnt DESC, word) <= 10 THEN 5 ELSE 1 END::BIGINT AS senses "
        "FROM (SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(lower(coalesce(text, '')), ' ')) AS word FROM documents) "
        "WHERE word <> '' GROUP BY 1 HAVING count(*) >= 5) ORDER BY cnt DESC, word LIMIT 50",
    )
    # O, P
    add(
        "O6_pairs_of_ontologies",
        lambda x: x.cells.filter("similarity >= 0.5").groupBy(F.lit("one").alias("a"), F.lit("two").alias("b")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT 'one' AS a, 'two' AS b, count(*) AS n FROM cells WHERE similarity >= 0.5",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "O14_schema_finder",
        lambda x: lexicon.lookup(x.one.select("id", F.col("label").alias("form")), "ring").join(x.one_edges.select(F.col("child").alias("id"), "parent"), "id"),
        "SELECT one.id, label AS form, parent FROM one JOIN one_edges ON child = id WHERE label LIKE '%ring%'",
        ONE,
    )
    add("P2_scored_instances", lambda x: selection.ordered(x.sim, 0.9, True), "SELECT * FROM sim WHERE similarity > 0.9", SIM)
