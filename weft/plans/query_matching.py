"""Filters, candidate joins, matchers, structural refinement, combination and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import strings as S
from weft.operators import candidates as C
from weft.operators import combination, instances, lexicon, matchers, selection, structure
from weft.plans.inputs import CELLS, MATS, ONE, REF, SIM, TWO, Inputs

T = 0.6
WEIGHTS = {"A": 1.0, "N": 2.0, "R": 1.0}

def rounded(df, *more):
    return df.select("src_id", "tgt_id", *more, F.round("similarity", 6).alias("similarity"))


def words(c):
    return c.select("id", S.tokens(F.col("label")).alias("words"))


def dictionary(x: Inputs):
    """A dictionary from the tables: a noun, its plural and its types are one synset."""
    return x.spark.sql("SELECT DISTINCT split_part(p_name, ' ', 2) AS synset, explode(array(concat(split_part(p_name, ' ', 2), 's'), p_name, concat(split_part(p_name, ' ', 2), ' ', lower(p_type)))) AS form FROM {part}", part=x.table("part"))


DICT = "dict AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS synset, unnest([split_part(p_name, ' ', 2) || 's', p_name, split_part(p_name, ' ', 2) || ' ' || lower(p_type)]) AS form FROM part)"
UP = "up AS (SELECT child AS low, parent AS high, 1 AS distance FROM {0} WHERE parent IS NOT NULL UNION ALL SELECT up.low, e.parent, up.distance + 1 FROM up JOIN {0} e ON up.high = e.child WHERE e.parent IS NOT NULL)"
COUNTS = "SELECT id, w, count(*) AS n FROM (SELECT id, unnest(string_split(label, ' ')) AS w FROM {0}) GROUP BY 1, 2"


def until_still(start: str, rounds: int = 10, least: float = 0.01) -> str:
    """CTEs of flooding over pg from a start, up to `fixed`: the first round that changes less than `least`, or the last."""
    steps = [f"r0 AS MATERIALIZED ({start})"]
    for i in range(1, rounds + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT src_id, tgt_id, s / max(s) OVER () AS s FROM (SELECT src_id, tgt_id, sum(s) AS s FROM (SELECT * FROM r{i - 1} UNION ALL SELECT a2, b2, s * w FROM r{i - 1} JOIN pg ON a1 = src_id AND b1 = tgt_id) GROUP BY 1, 2))")
    gaps = " UNION ALL ".join(f"SELECT {i} AS i, sqrt(sum(pow(coalesce(x.s, 0) - coalesce(y.s, 0), 2))) AS gap FROM r{i} x FULL JOIN r{i - 1} y USING (src_id, tgt_id)" for i in range(1, rounds + 1))
    every = " UNION ALL ".join(f"SELECT {i} AS i, * FROM r{i}" for i in range(1, rounds + 1))
    return ", ".join([*steps, f"gaps AS MATERIALIZED ({gaps})", f"fixed AS (SELECT src_id, tgt_id, s FROM ({every}) WHERE i = (SELECT coalesce(min(i) FILTER (gap < {least}), {rounds}) FROM gaps))"])


LEV = "(1 - least(levenshtein({0}, {1}), least(length({0}), length({1}))) / least(length({0}), length({1})))"
LABELS = f"""WITH p AS (SELECT one.id AS src_id, two.id AS tgt_id, string_split(one.label, ' ') AS a, string_split(two.label, ' ') AS b FROM one CROSS JOIN two),
q AS (SELECT src_id, tgt_id, {LEV.format('a[1]', 'b[1]')} AS own, list_max(flatten(list_transform(a, lambda w: list_transform(b, lambda v: {LEV.format('w', 'v')})))) AS best FROM p)
SELECT src_id, tgt_id, round(CASE WHEN best > own THEN (own + best) / 2 ELSE own END, 6) AS similarity FROM q"""
RECORDS = """WITH n AS (SELECT matcher, src_id, tgt_id, similarity / max(similarity) OVER (PARTITION BY matcher, src_id) AS s FROM mats),
l AS (SELECT src_id, tgt_id, sum(CASE matcher WHEN 'N' THEN 2.0 ELSE 1.0 END * s) / 4 AS s FROM n GROUP BY 1, 2)
SELECT src_id, tgt_id, round(s, 6) AS similarity FROM l WHERE s > 0.5 QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY s DESC, tgt_id) = 1"""
MIDDLES = f"""WITH {DICT}, p AS (SELECT string_split(a.form, ' ') AS x, string_split(b.form, ' ') AS y FROM dict a JOIN dict b ON a.synset = b.synset AND a.form < b.form),
h AS (SELECT *, coalesce(list_filter(range(least(len(x), len(y))), lambda i: x[i + 1] <> y[i + 1])[1], least(len(x), len(y))) AS head FROM p),
t AS (SELECT *, coalesce(list_filter(range(least(len(x), len(y)) - head), lambda i: x[len(x) - i] <> y[len(y) - i])[1], least(len(x), len(y)) - head) AS tail FROM h)
SELECT DISTINCT array_to_string(x[head + 1 : len(x) - tail], ' ') AS term, array_to_string(y[head + 1 : len(y) - tail], ' ') AS synonym FROM t
WHERE len(x) > head + tail AND len(y) > head + tail AND head + tail > 0"""
AROUND = "nr{1} AS (SELECT child AS a, parent AS b FROM {0}_edges WHERE parent IS NOT NULL UNION SELECT parent, child FROM {0}_edges WHERE parent IS NOT NULL UNION SELECT x.child, y.child FROM {0}_edges x JOIN {0}_edges y ON x.parent = y.parent AND x.child <> y.child), d{1} AS (SELECT id, label FROM {0} UNION ALL SELECT a, label FROM nr{1} JOIN {0} ON id = b)"
PROFILED = f"""WITH {AROUND.format('one', 1)}, {AROUND.format('two', 2)},
cnt AS (SELECT side, id, w, count(*) AS n FROM (SELECT 's' AS side, id, unnest(string_split(label, ' ')) AS w FROM d1 UNION ALL SELECT 't', id, unnest(string_split(label, ' ')) FROM d2) GROUP BY 1, 2, 3),
df AS (SELECT w, count(*) AS df FROM cnt GROUP BY 1), nn AS (SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM two) AS n),
wt AS (SELECT side, id, w, cnt.n * ln(1 + nn.n / df) AS v FROM cnt JOIN df USING (w) CROSS JOIN nn), u AS (SELECT side, id, w, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM wt)
SELECT a.id AS src_id, b.id AS tgt_id, round(sum(a.v * b.v), 6) AS similarity FROM u a JOIN u b ON a.side = 's' AND b.side = 't' AND a.w = b.w GROUP BY 1, 2"""


def register(add) -> None:
    # B: filters
    add("B1_threshold", lambda x: selection.at_least(x.sim, T), f"SELECT * FROM sim WHERE similarity >= {T}", SIM)
    add("B2_alignment_cut", lambda x: selection.above(x.sim, T), f"SELECT * FROM sim WHERE similarity > {T}", SIM)
    add(
        "B4_pruned_rows",
        lambda x: selection.pruned(x.sim, T).select("src_id", "n_kept", F.round("sum_kept", 6).alias("sum_kept"), "n_pruned", F.round("sum_pruned", 6).alias("sum_pruned")),
        f"SELECT src_id, count(*) FILTER (similarity >= {T}) AS n_kept, round(coalesce(sum(similarity) FILTER (similarity >= {T}), 0), 6) AS "
        f"sum_kept, count(*) FILTER (similarity < {T}) AS n_pruned, round(coalesce(sum(similarity) FILTER (similarity < {T}), 0), 6) AS "
        f"sum_pruned FROM sim GROUP BY 1",
        SIM,
    )
    mapped = "m AS (SELECT * FROM sim WHERE similarity = 1.0)"
    done = lambda x: x.sim.filter("similarity = 1.0")
    add(
        "B5_completion",
        lambda x: selection.completion(x.sim, done(x)),
        f"WITH {mapped} SELECT * FROM sim WHERE src_id NOT IN (SELECT src_id FROM m) AND tgt_id NOT IN (SELECT tgt_id FROM m) UNION ALL "
        f"SELECT * FROM m",
        SIM,
    )
    add(
        "B6_completion_flags",
        lambda x: selection.mapped_flags(x.sim, done(x)),
        f"WITH {mapped} SELECT src_id, tgt_id, CASE WHEN src_id IN (SELECT src_id FROM m) AND tgt_id IN (SELECT tgt_id FROM m) THEN similarity "
        f"WHEN src_id IN (SELECT src_id FROM m) OR tgt_id IN (SELECT tgt_id FROM m) THEN 0 END AS similarity FROM sim",
        SIM,
    )
    add(
        "B7_namespace",
        lambda x: matchers.namespace_filter(x.cells, x.one.withColumnRenamed("label", "uri"), x.two.withColumnRenamed("label", "uri"), "small", "ring"),
        "SELECT cells.* FROM cells JOIN one ON one.id = src_id JOIN two ON two.id = tgt_id WHERE one.label LIKE 'small%' "
        "AND two.label LIKE 'ring%'",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "B11_manual_filter",
        lambda x: x.sim.join(x.ref, ["src_id", "tgt_id"], "left_anti"),
        "SELECT sim.* FROM sim ANTI JOIN ref USING (src_id, tgt_id)",
        SIM,
        REF,
    )
    add("B12_parent_filter", lambda x: structure.parent_filter(x.cells.filter("similarity < 0.5"), x.cells, x.one_edges, x.two_edges), """SELECT c.src_id, c.tgt_id, CASE WHEN a.parent IS NOT NULL AND b.parent IS NOT NULL AND NOT coalesce(p.similarity >= 0.6, false) THEN 0.0 ELSE 0.3 END::DOUBLE AS similarity
        FROM cells c JOIN one_edges a ON a.child = c.src_id JOIN two_edges b ON b.child = c.tgt_id LEFT JOIN cells p ON p.src_id = a.parent AND p.tgt_id = b.parent WHERE c.similarity < 0.5""", ONE, TWO, CELLS)
    # C: candidate joins
    add(
        "C1_all_pairs",
        lambda x: C.all_pairs(x.one.select("id"), x.two.select("id")),
        "SELECT one.id AS src_id, two.id AS tgt_id FROM one CROSS JOIN two",
        ONE,
        TWO,
    )
    add(
        "C5_name_join",
        lambda x: C.key_join(x.one.select("id", F.element_at(S.tokens(F.col("label")), -1).alias("k")), x.two.select("id", F.element_at(S.tokens(F.col("label")), 1).alias("k")), "k"),
        "SELECT one.id AS src_id, two.id AS tgt_id, CAST(1 AS DOUBLE) AS similarity FROM one JOIN two "
        "ON string_split(one.label, ' ')[-1] = string_split(two.label, ' ')[1]",
        ONE,
        TWO,
    )
    add(
        "C6_key_ladder",
        lambda x: C.ladder(x.one.select("id", "label", F.element_at(S.tokens(F.col("label")), -1).alias("w")), x.two.select("id", "label", F.element_at(S.tokens(F.col("label")), 1).alias("w")), [("label", 1.0), ("w", 0.9)]),
        "SELECT one.id AS src_id, two.id AS tgt_id, CASE WHEN one.label = two.label THEN 1.0 ELSE 0.9 END::DOUBLE AS similarity FROM one "
        "JOIN two ON string_split(one.label, ' ')[-1] = string_split(two.label, ' ')[1] OR one.label = two.label",
        ONE,
        TWO,
    )
    add(
        "C7_synonym_join",
        lambda x: C.synonym_join(x.one.select("id", S.tokens(F.col("label")).alias("forms")), x.two.select("id", S.tokens(F.initcap("label")).alias("forms"))),
        "SELECT one.id AS src_id, two.id AS tgt_id FROM one JOIN two "
        "ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    nations = lambda x, t, k: x.table(t).select(F.col(k[0]).alias("src_id"), F.col(k[1]).alias("tgt_id"), F.lit(0.9).alias("similarity"))
    add(
        "C8_mediated",
        lambda x: rounded(C.mediated(nations(x, "supplier", ("s_suppkey", "s_nationkey")), nations(x, "nation", ("n_nationkey", "n_regionkey")))),
        "SELECT s_suppkey AS src_id, n_regionkey AS tgt_id, CAST(0.81 AS DOUBLE) AS similarity FROM supplier JOIN nation "
        "ON s_nationkey = n_nationkey",
    )
    graph = lambda e, x: e.filter("parent IS NOT NULL").select(F.lit("subClassOf").alias("label"), F.col("child").alias("from_id"), F.col("parent").alias("to_id"))
    add(
        "C9_edge_label_join",
        lambda x: C.label_join(graph(x.one_edges, x), graph(x.two_edges, x)),
        "SELECT 'subClassOf' AS label, a.child AS from_a, a.parent AS to_a, b.child AS from_b, b.parent AS to_b FROM one_edges a CROSS "
        "JOIN two_edges b WHERE a.parent IS NOT NULL AND b.parent IS NOT NULL",
        ONE,
        TWO,
    )
    nouns = "start AS (SELECT one.id AS a, two.id AS b FROM one JOIN two ON string_split(one.label, ' ')[-1] = string_split(two.label, ' ')[1])"
    noun = lambda c, at: c.select("id", F.element_at(S.tokens(F.col("label")), at).alias("k"))
    add(
        "C10_neighbour_pairs",
        lambda x: C.reachable_pairs(C.label_join(graph(x.one_edges, x), graph(x.two_edges, x)), C.key_join(noun(x.one, -1), noun(x.two, 1), "k").select(F.col("src_id").alias("a"), F.col("tgt_id").alias("b"))),
        f"WITH {nouns}, r AS (SELECT a, b FROM start UNION SELECT x.parent, y.parent FROM r JOIN one_edges x ON x.child = r.a JOIN two_edges y ON y.child = r.b WHERE x.parent IS NOT NULL AND y.parent IS NOT NULL) SELECT * FROM r",
        ONE,
        TWO,
    )
    add(
        "C11_candidates",
        lambda x: instances.candidates(words(x.one), words(x.two), "words"),
        "SELECT one.id AS src_id, two.id AS tgt_id FROM one JOIN two "
        "ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    add(
        "C12_shared_predicates",
        lambda x: rounded(C.shared_predicates(instances.statements(x.table("supplier"), "s_suppkey", ["s_nationkey"]).withColumn("predicate", F.lit("n")), instances.statements(x.table("nation").withColumn("k", F.col("n_nationkey")), "n_nationkey", ["k"]).withColumn("predicate", F.lit("n")), C.all_pairs(x.table("supplier").select(F.col("s_suppkey").alias("id")), x.table("nation").select(F.col("n_nationkey").alias("id"))), S.equality)),
        "SELECT s_suppkey AS src_id, n_nationkey AS tgt_id, CAST(s_nationkey = n_nationkey AS DOUBLE) AS similarity FROM supplier CROSS "
        "JOIN nation",
    )
    add(
        "C13_closure",
        lambda x: C.closure(x.one_edges),
        f"WITH {UP.format('one_edges')} SELECT low, high, min(distance) AS distance FROM up GROUP BY 1, 2",
        ONE,
    )
    add(
        "C13_siblings",
        lambda x: C.siblings(x.two_edges),
        "SELECT DISTINCT a.child AS node, b.child AS sibling FROM two_edges a JOIN two_edges b ON a.parent = b.parent AND a.child <> b.child",
        TWO,
    )
    own = "s AS (SELECT low, high FROM up UNION SELECT id, id FROM two)"
    add(
        "C14_common_ancestors",
        lambda x: C.common_ancestors(C.closure(x.two_edges), x.two.select(F.col("id").alias("a")).crossJoin(x.two.select(F.col("id").alias("b")))),
        f"WITH {UP.format('two_edges')}, {own} SELECT x.low AS a, y.low AS b, count(*) AS shared FROM s x JOIN s y ON x.high = y.high "
        f"GROUP BY 1, 2",
        TWO,
    )
    add(
        "C17_triangle",
        lambda x: selection.triangle_votes(*(x.table("nation").select(F.col("n_nationkey").alias("src_id"), F.col(c).alias("tgt_id"), F.lit(1.0).alias("similarity")) for c in ("n_regionkey", "n_nationkey")), x.table("region").select(F.col("r_regionkey").alias("src_id"), F.col("r_regionkey").alias("tgt_id"))),
        "SELECT n_nationkey AS a, n_regionkey AS b, CAST(1 AS DOUBLE) AS similarity, CASE WHEN n_nationkey = n_regionkey THEN 1 "
        "WHEN n_nationkey < 5 THEN -1 ELSE 0 END AS vote FROM nation",
    )
    add("C18_contained", lambda x: C.contained(x.sim, x.ref), "SELECT sim.* FROM sim SEMI JOIN ref USING (src_id, tgt_id)", SIM, REF)
    add(
        "C19_append",
        lambda x: C.append_missing(x.ref, x.sim.select("src_id", "tgt_id")),
        "SELECT src_id, tgt_id FROM ref UNION SELECT src_id, tgt_id FROM sim",
        SIM,
        REF,
    )
    add(
        "C20_token_blocks",
        lambda x: C.token_blocks(words(x.one), words(x.two), "words"),
        "SELECT one.id AS src_id, two.id AS tgt_id, len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) AS shared "
        "FROM one JOIN two ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    # F: matchers
    add("F1_base_similarity", lambda x: matchers.base_similarity(x.one, x.two))
    add("F2_parametric", lambda x: rounded(matchers.parametric(x.one, x.two)), """SELECT src_id, tgt_id, round(0.7 * l + 0.2 * CASE WHEN ca = '' AND cb = '' THEN 1 WHEN ca = '' OR cb = '' THEN 0 ELSE 1 - least(levenshtein(ca, cb), least(length(ca), length(cb))) / least(length(ca), length(cb)) END + 0.1, 6) AS similarity
        FROM (SELECT one.id AS src_id, two.id AS tgt_id, replace(lower(one.comment), '#', '#') AS ca, lower(two.comment) AS cb, 1 - least(levenshtein(one.label, two.label), least(length(one.label), length(two.label))) / least(length(one.label), length(two.label)) AS l FROM one CROSS JOIN two)""", ONE, TWO)
    corpus = f"cnt AS (SELECT 's' AS side, * FROM ({COUNTS.format('one')}) UNION ALL SELECT 't', * FROM ({COUNTS.format('two')})), df AS (SELECT w, count(*) AS df FROM cnt GROUP BY 1), nn AS (SELECT (SELECT count(*) FROM one) + (SELECT count(*) FROM two) AS n), wt AS (SELECT side, id, w, cnt.n * ln(1 + nn.n / df) AS v FROM cnt JOIN df USING (w) CROSS JOIN nn), u AS (SELECT side, id, w, v / sqrt(sum(v * v) OVER (PARTITION BY side, id)) AS v FROM wt)"
    add(
        "F3_vector_words",
        lambda x: rounded(matchers.vector_words(words(x.one), words(x.two))),
        f"WITH {corpus} SELECT a.id AS src_id, b.id AS tgt_id, round(sum(a.v * b.v), 6) AS similarity FROM u a JOIN u b ON a.side = 's' "
        f"AND b.side = 't' AND a.w = b.w GROUP BY 1, 2",
        ONE,
        TWO,
    )
    add(
        "F4_profiled_words",
        lambda x: rounded(matchers.vector_words(matchers.virtual_documents(x.one, x.one_edges), matchers.virtual_documents(x.two, x.two_edges))),
        PROFILED,
        ONE,
        TWO,
    )
    add(
        "F5_pairwise_words",
        lambda x: rounded(matchers.token_similarity(words(x.one), words(x.two), kind="dice")),
        "SELECT one.id AS src_id, two.id AS tgt_id, round(2 * len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) "
        "/ (len(string_split(one.label, ' ')) + len(string_split(two.label, ' '))), 6) AS similarity FROM one JOIN two "
        "ON len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) > 0",
        ONE,
        TWO,
    )
    add("F6_advanced", lambda x: rounded(matchers.advanced_similarity(x.one, x.two)))
    add(
        "F7_synonyms",
        lambda x: matchers.lexical_synonyms(x.one, x.two, dictionary(x)),
        f"WITH {DICT} SELECT DISTINCT one.id AS src_id, two.id AS tgt_id, CAST(0.95 AS DOUBLE) AS similarity FROM one JOIN dict a "
        f"ON one.label = a.form JOIN dict b ON a.synset = b.synset JOIN two ON two.label = b.form",
        ONE,
        TWO,
    )
    hyper = lambda x: x.spark.sql("SELECT DISTINCT split_part(p_name, ' ', 2) AS low, 'thing' AS high, 1 AS distance FROM {part}", part=x.table("part"))
    add(
        "F9_hypernyms",
        lambda x: rounded(matchers.hypernym_similarity(x.one, x.two, dictionary(x), hyper(x))),
        f"WITH {DICT} SELECT one.id AS src_id, two.id AS tgt_id, round(max(CASE WHEN a.synset = b.synset THEN 1 "
        f"ELSE 1.0 / 3 END), 6)::DOUBLE AS similarity FROM one JOIN dict a ON one.label = a.form CROSS JOIN dict b JOIN two "
        f"ON two.label = b.form GROUP BY 1, 2",
        ONE,
        TWO,
    )

    def profiled(c, e):
        up = C.closure(e).select("low", "high")
        label = c.select(F.col("id").alias("_i"), F.col("label").alias("_l"))
        above = up.join(label, up.high == label._i).groupBy(F.col("low").alias("id")).agg(F.collect_list("_l").alias("above"))
        below = up.join(label, up.low == label._i).groupBy(F.col("high").alias("id")).agg(F.collect_list("_l").alias("below"))
        none = F.array().cast("array<string>")
        return c.select("id", "label").join(above, "id", "left").join(below, "id", "left").select("id", "label", F.coalesce("above", none).alias("above"), F.coalesce("below", none).alias("below"))

    add("F12_concepts", lambda x: rounded(matchers.concept_similarity(profiled(x.one, x.one_edges), profiled(x.two, x.two_edges))))
    add("F14_hierarchy", lambda x: matchers.hierarchy_relations(x.cells.filter("similarity >= 0.5").withColumn("similarity", F.lit(1.0)), C.closure(x.one_edges).select("low", "high"), C.closure(x.two_edges).select("low", "high")), f"""WITH {UP.format('one_edges').replace('up', 'ua')}, {UP.format('two_edges').replace('up', 'ub')}, eq AS (SELECT src_id, tgt_id FROM cells WHERE similarity >= 0.5)
        SELECT src_id, tgt_id, '=' AS relation FROM eq UNION SELECT low, tgt_id, '<' FROM eq JOIN ua ON src_id = high UNION SELECT high, tgt_id, '>' FROM eq JOIN ua ON src_id = low UNION SELECT src_id, high, '<' FROM eq JOIN ub ON tgt_id = low UNION SELECT src_id, low, '>' FROM eq JOIN ub ON tgt_id = high""", ONE, TWO, CELLS)
    add(
        "F21_constant",
        lambda x: matchers.constant(x.one, x.two, 1.0),
        "SELECT one.id AS src_id, two.id AS tgt_id, CAST(1 AS DOUBLE) AS similarity FROM one CROSS JOIN two",
        ONE,
        TWO,
    )
    add("F21_random", lambda x: matchers.random_scores(x.one, x.two))
    # G: structure
    levels = "z AS (SELECT src_id, tgt_id, similarity AS s FROM cells JOIN one_edges a ON a.child = src_id JOIN two_edges b ON b.child = tgt_id WHERE a.parent IS NULL OR b.parent IS NULL UNION ALL SELECT a.child, b.child, 0.75 * c.similarity + 0.25 * z.s FROM z JOIN one_edges a ON a.parent = z.src_id JOIN two_edges b ON b.parent = z.tgt_id JOIN cells c ON c.src_id = a.child AND c.tgt_id = b.child)"
    add(
        "G1_inheritance",
        lambda x: rounded(structure.descendant_inheritance(x.cells, x.one_edges, x.two_edges)),
        f"WITH {levels} SELECT src_id, tgt_id, round(s, 6) AS similarity FROM z",
        ONE,
        TWO,
        CELLS,
    )
    add("G2_path_inheritance", lambda x: rounded(structure.path_inheritance(x.cells, C.closure(x.one_edges), C.closure(x.two_edges))), f"""WITH {UP.format('one_edges').replace('up', 'ua')}, {UP.format('two_edges').replace('up', 'ub')}, la AS (SELECT low, max(distance) AS l FROM ua GROUP BY 1), lb AS (SELECT low, max(distance) AS l FROM ub GROUP BY 1)
        SELECT c.src_id, c.tgt_id, round(CASE WHEN la.l IS NULL OR lb.l IS NULL THEN c.similarity ELSE 0.75 * c.similarity + 0.5 / (least(la.l, lb.l) * (least(la.l, lb.l) + 1)) * coalesce((SELECT sum((least(la.l, lb.l) + 1 - ua.distance) * p.similarity) FROM ua JOIN ub ON ua.distance = ub.distance JOIN cells p ON p.src_id = ua.high AND p.tgt_id = ub.high WHERE ua.low = c.src_id AND ub.low = c.tgt_id), 0) END, 6) AS similarity
        FROM cells c LEFT JOIN la ON la.low = c.src_id LEFT JOIN lb ON lb.low = c.tgt_id""", ONE, TWO, CELLS)
    sib = "a AS (SELECT x.child AS n, y.child AS s FROM one_edges x JOIN one_edges y ON x.parent = y.parent AND x.child <> y.child), b AS (SELECT x.child AS n, y.child AS s FROM two_edges x JOIN two_edges y ON x.parent = y.parent AND x.child <> y.child)"
    add(
        "G3_siblings",
        lambda x: rounded(structure.sibling_contribution(x.cells, x.one_edges, x.two_edges).withColumn("similarity", F.col("similarity") + 1e-9)),
        f"WITH {sib}, m AS (SELECT c.src_id, c.tgt_id, a.s, max(p.similarity) AS m FROM cells c JOIN a ON a.n = c.src_id JOIN b "
        f"ON b.n = c.tgt_id JOIN cells p ON p.src_id = a.s AND p.tgt_id = b.s GROUP BY 1, 2, 3), q AS (SELECT src_id, tgt_id, avg(m) AS m "
        f"FROM m GROUP BY 1, 2) SELECT c.src_id, c.tgt_id, round(CASE WHEN q.m IS NULL THEN c.similarity "
        f"ELSE 0.75 * c.similarity + 0.25 * q.m END + 1e-9, 6) AS similarity FROM cells c LEFT JOIN q USING (src_id, tgt_id)",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "G4_boost",
        lambda x: rounded(structure.boost_mutual_best(x.sim)),
        "SELECT src_id, tgt_id, round(CASE WHEN similarity = max(similarity) OVER (PARTITION BY src_id) "
        "AND similarity = max(similarity) OVER (PARTITION BY tgt_id) THEN least(1.0, similarity * 1.1) ELSE similarity END, 6) AS similarity "
        "FROM sim",
        SIM,
    )
    add("G5_level_bonus", lambda x: rounded(structure.level_bonus(x.cells, x.one_edges, x.two_edges, 0.3)))
    groups = "g AS (SELECT src_id, tgt_id, similarity, coalesce(pa.parent, a.parent, a.child) AS rs, coalesce(pb.parent, b.parent, b.child) AS rt FROM cells JOIN one_edges a ON a.child = src_id LEFT JOIN one_edges pa ON pa.child = a.parent JOIN two_edges b ON b.child = tgt_id LEFT JOIN two_edges pb ON pb.child = b.parent)"
    subgroup = lambda e: e.select(F.col("child").alias("node"), F.coalesce("parent", "child").alias("root"))
    near = "g AS (SELECT src_id, tgt_id, similarity, coalesce(a.parent, a.child) AS rs, coalesce(b.parent, b.child) AS rt FROM cells JOIN one_edges a ON a.child = src_id JOIN two_edges b ON b.child = tgt_id)"
    for name, made, cte in (("G6_groups", lambda x: rounded(structure.group_finder(x.cells, structure.roots(x.one_edges), structure.roots(x.two_edges))), groups), ("G6_subgroups", lambda x: rounded(structure.group_finder(x.cells, subgroup(x.one_edges), subgroup(x.two_edges))), near)):
        add(
            name,
            made,
            f"WITH {cte}, m AS (SELECT src_id, rs, rt, max(similarity) AS m FROM g GROUP BY 1, 2, 3), s AS (SELECT rs, rt, sum(m) AS s FROM m "
            f"GROUP BY 1, 2), t AS (SELECT rs, rt AS best FROM s QUALIFY row_number() OVER (PARTITION BY rs ORDER BY s DESC, rt) = 1) "
            f"SELECT src_id, tgt_id, round(CASE WHEN rt = best THEN similarity ELSE similarity * 0.8 END, 6) AS similarity FROM g JOIN t USING (rs)",
            ONE,
            TWO,
            CELLS,
        )
    pcg = lambda x: structure.connectivity_graph(graph(x.one_edges, x), graph(x.two_edges, x))
    edges = "f AS (SELECT a.child AS a1, b.child AS b1, a.parent AS a2, b.parent AS b2 FROM one_edges a CROSS JOIN two_edges b WHERE a.parent IS NOT NULL AND b.parent IS NOT NULL), pg AS (SELECT a1, b1, a2, b2, 1.0 / count(*) OVER (PARTITION BY a1, b1) AS w FROM f UNION ALL SELECT a2, b2, a1, b1, 1.0 / count(*) OVER (PARTITION BY a2, b2) FROM f)"
    add(
        "G7_graph",
        lambda x: pcg(x).withColumn("w", F.round("w", 6)),
        f"WITH {edges} SELECT a1, b1, a2, b2, round(w, 6)::DOUBLE AS w FROM pg",
        ONE,
        TWO,
    )
    rounds = "".join(f", r{i} AS (SELECT src_id, tgt_id, s / max(s) OVER () AS s FROM (SELECT src_id, tgt_id, sum(s) AS s FROM (SELECT * FROM r{i - 1} UNION ALL SELECT a2, b2, s * w FROM r{i - 1} JOIN pg ON a1 = src_id AND b1 = tgt_id) GROUP BY 1, 2))" for i in range(1, 4))
    add(
        "G7_flooding",
        lambda x: rounded(structure.flood(pcg(x), x.cells, 3, 0.0)),
        f"WITH {edges}, r0 AS (SELECT src_id, tgt_id, similarity AS s FROM cells){rounds} SELECT src_id, tgt_id, round(s, 6) AS similarity "
        f"FROM r3",
        ONE,
        TWO,
        CELLS,
    )
    every, anchors = "SELECT one.id AS src_id, two.id AS tgt_id, 1.0::DOUBLE AS s FROM one CROSS JOIN two", "SELECT src_id, tgt_id, similarity AS s FROM cells WHERE similarity >= 0.5"
    add(
        "G8_flooding_independent",
        lambda x: rounded(structure.relative(structure.flood(pcg(x), matchers.constant(x.one, x.two, 1.0)))),
        f"WITH {edges}, {until_still(every)} SELECT src_id, tgt_id, round(CASE "
        f"WHEN max(s) OVER (PARTITION BY src_id) > 0 THEN s / max(s) OVER (PARTITION BY src_id) ELSE 0 END, 6) AS similarity FROM fixed",
        ONE,
        TWO,
    )
    add(
        "G9_flooding_anchored",
        lambda x: rounded(structure.flood(pcg(x), x.cells.filter("similarity >= 0.5"))),
        f"WITH {edges}, {until_still(anchors)} SELECT src_id, tgt_id, round(s, 6) AS similarity FROM fixed",
        ONE,
        TWO,
        CELLS,
    )
    add("G12_structural_evidence", lambda x: rounded(structure.structural_evidence(x.cells, x.one_edges, x.two_edges, 0.5)))
    add(
        "G16_reference_integration",
        lambda x: selection.integrate_reference(x.sim.filter("similarity < 1.0"), done(x)),
        f"WITH {mapped} SELECT * FROM sim WHERE similarity < 1.0 AND src_id NOT IN (SELECT src_id FROM m) AND tgt_id NOT IN (SELECT tgt_id "
        f"FROM m) UNION ALL SELECT * FROM m",
        SIM,
    )
    # H: combination and selection
    weight = "CASE matcher WHEN 'N' THEN 2.0 ELSE 1.0 END"
    add(
        "H1_linear",
        lambda x: rounded(combination.linear(x.mats, WEIGHTS)),
        f"SELECT src_id, tgt_id, round(sum({weight} * similarity) / 4, 6) AS similarity FROM mats GROUP BY 1, 2",
        MATS,
    )
    for kind, order in (("max", "DESC"), ("min", "ASC")):
        add(
            f"H2_{kind}",
            lambda x, k=kind: combination.extreme(x.mats, WEIGHTS, k),
            f"SELECT src_id, tgt_id, similarity FROM mats QUALIFY row_number() OVER (PARTITION BY src_id, tgt_id "
            f"ORDER BY {weight} * similarity {order}, matcher {order}) = 1",
            MATS,
        )
    add(
        "H3_sigmoid",
        lambda x: rounded(combination.sigmoid_mean(x.mats, WEIGHTS)),
        f"SELECT src_id, tgt_id, round((sum({weight} / (1 + exp(-5 * (similarity - 0.5)))) + (4 - sum({weight})) / (1 + exp(2.5))) / 4, 6) AS "
        f"similarity FROM mats GROUP BY 1, 2",
        MATS,
    )
    add(
        "H4_node_weighted",
        lambda x: rounded(combination.node_weighted(x.mats, x.mats.groupBy("matcher", "src_id").agg(F.max("similarity").alias("weight")))),
        "WITH q AS (SELECT matcher, src_id, max(similarity) AS w FROM mats GROUP BY 1, 2), t AS (SELECT src_id, sum(w) AS t FROM q GROUP BY 1) "
        "SELECT src_id, tgt_id, round(sum(w * similarity) / max(t), 6) AS similarity FROM mats JOIN q USING (matcher, src_id) "
        "JOIN t USING (src_id) GROUP BY 1, 2",
        MATS,
    )
    add(
        "H5_learned",
        lambda x: rounded(combination.learned(x.mats, ["A", "N", "R"], x.sim.join(x.ref.withColumn("is_match", F.lit(True)), ["src_id", "tgt_id"], "left").select("src_id", "tgt_id", F.coalesce("is_match", F.lit(False)).alias("is_match")))),
    )
    add(
        "H6_signatures",
        lambda x: combination.signatures(x.mats, ["A", "N", "R"]),
        "SELECT src_id, tgt_id, coalesce(max(similarity) FILTER (matcher = 'A'), 0) AS \"A\", coalesce(max(similarity) FILTER (matcher = 'N'), "
        "0) AS \"N\", coalesce(max(similarity) FILTER (matcher = 'R'), 0) AS \"R\" FROM mats GROUP BY 1, 2",
        MATS,
    )
    for n in (1, 3):
        add(
            f"H10_top_{n}_source",
            lambda x, n=n: selection.top_per(x.sim, "src", n, T),
            f"SELECT * FROM sim WHERE similarity >= {T} QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) <= {n}",
            SIM,
        )
        add(
            f"H11_top_{n}_target",
            lambda x, n=n: selection.top_per(x.sim, "tgt", n, T),
            f"SELECT * FROM sim WHERE similarity >= {T} QUALIFY row_number() OVER (PARTITION BY tgt_id ORDER BY similarity DESC, src_id DESC) <= {n}",
            SIM,
        )
    add("H12_stable_many", lambda x: rounded(selection.stable_many(x.cells, 2, 3, 0.3)))
    add("H13_assignment", lambda x: rounded(selection.best_assignment(x.cells, 0.3)))
    add(
        "H14_mutual_best",
        lambda x: selection.mutual_best(x.sim),
        "SELECT * FROM sim QUALIFY similarity = max(similarity) OVER (PARTITION BY src_id) "
        "AND similarity = max(similarity) OVER (PARTITION BY tgt_id)",
        SIM,
    )
    add("H15_greedy", lambda x: rounded(selection.greedy(x.sim, T)))
    add("H16_global_top", lambda x: selection.global_top(x.sim, 100), "SELECT * FROM sim ORDER BY similarity DESC, src_id, tgt_id LIMIT 100", SIM)
    add(
        "H16_masked_top",
        lambda x: selection.global_top(x.sim, 100, x.ref),
        "SELECT sim.* FROM sim SEMI JOIN ref USING (src_id, tgt_id) ORDER BY similarity DESC, src_id, tgt_id LIMIT 100",
        SIM,
        REF,
    )
    add("H17_ordered", lambda x: selection.ordered(x.sim, T), f"SELECT * FROM sim WHERE similarity > {T}", SIM)
    add(
        "H18_dense",
        lambda x: selection.dense(x.cells.filter("similarity >= 0.5"), x.one.select(F.col("id").alias("src_id")), x.two.select(F.col("id").alias("tgt_id"))),
        "SELECT src_id, tgt_id, CASE WHEN similarity >= 0.5 THEN similarity ELSE 0 END AS similarity FROM cells",
        ONE,
        TWO,
        CELLS,
    )
    add(
        "H20_merge",
        lambda x: selection.merge(x.sim.filter(f"similarity >= {T}"), x.sim.withColumn("similarity", F.lit(0.0))),
        f"SELECT src_id, tgt_id, CASE WHEN similarity >= {T} THEN similarity ELSE 0 END AS similarity FROM sim",
        SIM,
    )
    add(
        "H21_best_candidate",
        lambda x: selection.best_candidate(x.sim, T),
        f"SELECT * FROM sim WHERE similarity > {T} QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id) = 1",
        SIM,
    )
    add("H24_transpose", lambda x: selection.transpose(x.sim), "SELECT tgt_id AS src_id, src_id AS tgt_id, similarity FROM sim", SIM)
    add(
        "H24_minus",
        lambda x: rounded(selection.plus(*(x.mats.filter(F.col("matcher") == m).drop("matcher") for m in "AN"), -1)),
        "SELECT src_id, tgt_id, round(sum(CASE matcher WHEN 'A' THEN similarity ELSE -similarity END), 6) AS similarity FROM mats "
        "WHERE matcher IN ('A', 'N') GROUP BY 1, 2",
        MATS,
    )
    add(
        "H24_times",
        lambda x: rounded(selection.times(x.cells, selection.transpose(x.cells))),
        "SELECT a.src_id, b.src_id AS tgt_id, round(sum(a.similarity * b.similarity), 6) AS similarity FROM cells a JOIN cells b "
        "ON a.tgt_id = b.tgt_id GROUP BY 1, 2",
        ONE,
        TWO,
        CELLS,
    )
    # K: lexicons
    notes = lambda x: x.one.select("id", F.lit("altLabel").alias("predicate"), F.reverse("label").alias("value"))
    lex = "lex AS (SELECT DISTINCT id, form FROM (SELECT id, label AS form FROM one UNION ALL SELECT id, reverse(label) FROM one))"
    add("K1_lexicon", lambda x: lexicon.ontology_lexicon(x.one, notes(x)), f"WITH {lex} SELECT * FROM lex", ONE)
    tagged = lambda x: words(x.one).select("id", F.explode("words").alias("form"))
    tags = "tag AS (SELECT id, unnest(string_split(label, ' ')) AS form FROM one)"
    add(
        "K1_related",
        lambda x: lexicon.related_synsets(tagged(x)),
        f"WITH {tags} SELECT DISTINCT a.id, b.id AS related FROM tag a JOIN tag b ON a.form = b.form AND a.id <> b.id",
        ONE,
    )
    add(
        "K3_dictionary",
        lambda x: lexicon.dictionary_lexicon(x.one.select("id", F.col("label").alias("form")), dictionary(x)),
        f"WITH {DICT} SELECT DISTINCT id, b.form FROM one JOIN dict a ON label = a.form JOIN dict b USING (synset) UNION SELECT id, label "
        f"FROM one",
        ONE,
    )
    add("K4_term_synonyms", lambda x: lexicon.term_synonyms(dictionary(x).select(F.col("synset").alias("id"), "form")), MIDDLES)
    add(
        "K5_extended",
        lambda x: lexicon.extended(tagged(x)),
        f"WITH {tags}, r AS (SELECT DISTINCT a.id, b.id AS o FROM tag a JOIN tag b ON a.form = b.form) SELECT DISTINCT r.id, tag.form FROM r "
        f"JOIN tag ON tag.id = r.o",
        ONE,
    )
    add("K6_lookup", lambda x: lexicon.lookup(tagged(x), "^R.D$"), f"WITH {tags} SELECT * FROM tag WHERE regexp_matches(form, '(?i)^R.D$')", ONE)
    # L: instances
    add(
        "L1_statements",
        lambda x: instances.statements(x.table("customer"), "c_custkey", ["c_name", "c_mktsegment"]),
        "SELECT c_custkey AS id, 'c_name' AS predicate, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment "
        "FROM customer",
    )
    add(
        "L2_labels",
        lambda x: rounded(C.all_pairs(words(x.one).withColumn("l", F.element_at("words", 1)), words(x.two).withColumn("l", F.element_at("words", 1))).select("src_id", "tgt_id", instances.label_score(F.col("src_l"), F.col("src_words"), F.col("tgt_l"), F.col("tgt_words")).alias("similarity"))),
        LABELS,
        ONE,
        TWO,
    )
    add(
        "L5_normalised",
        lambda x: instances.normalised_by_best(x.mats).withColumn("similarity", F.round("similarity", 6)),
        "SELECT matcher, src_id, tgt_id, round(similarity / max(similarity) OVER (PARTITION BY matcher, src_id), 6) AS similarity FROM mats",
        MATS,
    )
    add("L5_match", lambda x: rounded(instances.match_records(x.mats, WEIGHTS, 0.5)), RECORDS, MATS)
    add(
        "L6_sole_candidate",
        lambda x: rounded(instances.sole_candidate_bonus(selection.transpose(x.sim))),
        "SELECT tgt_id AS src_id, src_id AS tgt_id, round(CASE WHEN count(*) OVER (PARTITION BY tgt_id) = 1 THEN least(1.0, similarity + 0.2) "
        "ELSE similarity END, 6) AS similarity FROM sim",
        SIM,
    )
