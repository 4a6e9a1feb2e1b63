"""Files written and read again, set operations, and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import strings as S
from weft.operators import candidates as C
from weft.operators import combination, evaluation, instances, selection
from weft.plans import pipelines
from weft.plans.inputs import ONE, REF, SIM, TWO, Inputs
from weft.plans.query_feedback import shared
from weft.sources import alignments, corpora, ontologies


def cells(x: Inputs):
    """The similarities of suppliers and parts as correspondences by URI."""
    return x.sim.select(F.concat(F.lit("http://s/"), "src_id").alias("source"), F.concat(F.lit("http://t/"), "tgt_id").alias("target"), F.round("similarity", 4).alias("similarity"), F.lit("=").alias("relation"), F.lit(None).cast("string").alias("provenance"))


WRITTEN = "SELECT 'http://s/' || src_id AS source, 'http://t/' || tgt_id AS target, round(similarity, 4) AS similarity, '=' AS relation, CAST(NULL AS STRING) AS provenance FROM sim"


def again(write, read):
    """Write in the shared folder, read back."""

    def run(x: Inputs):
        path = f"{shared(x)}/file"
        write(x, path)
        return read(x.spark, path)

    return run


def triples(x: Inputs):
    """Ontology one as statements."""
    c = x.one.join(x.one_edges, F.col("id") == F.col("child")).select("id", "label", "parent")
    uri = lambda i: F.concat(F.lit("http://one/n"), i)
    link = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"), F.lit(False).alias("is_literal"))
    name = F.struct(F.lit(f"{ontologies.RDFS}label").alias("p"), F.col("label").alias("o"), F.lit(True).alias("is_literal"))
    parts = F.array(link(f"{ontologies.RDF}type", F.lit(f"{ontologies.OWL}Class")), name, link(f"{ontologies.RDFS}subClassOf", F.when(F.col("parent").isNotNull(), uri(F.col("parent")))))
    return c.select(uri(F.col("id")).alias("s"), F.explode(parts).alias("t")).select("s", "t.p", "t.o", "t.is_literal").filter("o IS NOT NULL")


def n_triples(x: Inputs):
    o = F.when(F.col("is_literal"), F.concat(F.lit('"'), "o", F.lit('"'))).otherwise(F.concat(F.lit("<"), "o", F.lit(">")))
    return triples(x).select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), o, F.lit(" .")).alias("value"))


def rdf_xml(x: Inputs):
    c = x.one.join(x.one_edges, F.col("id") == F.col("child"))
    above = F.when(F.col("parent").isNotNull(), F.concat(F.lit('<rdfs:subClassOf rdf:resource="http://one/n'), "parent", F.lit('"/>'))).otherwise("")
    return c.select(F.concat(F.lit('<owl:Class rdf:about="http://one/n'), "id", F.lit('"><rdfs:label>'), "label", F.lit("</rdfs:label>"), above, F.lit("</owl:Class>")).alias("value"))


def loaded(o: ontologies.Ontology):
    names = o.concepts.select("id", "label")
    child, parent = names.select(F.col("id").alias("child"), F.col("label").alias("below")), names.select(F.col("id").alias("parent"), F.col("label").alias("above"))
    return o.edges.join(child, "child").join(parent, "parent", "left").select("below", "above")


LINKS = "SELECT label AS below, above FROM one"


def indented(x: Inputs):
    """Ontology one as lines with tabs, document order by name."""
    c = x.of("one", ONE)
    key = F.when(F.col("above").isNull(), F.lit("")).when(F.col("above") == "part", F.col("label")).otherwise(F.concat("above", F.lit("/"), "label"))
    depth = F.when(F.col("above").isNull(), 0).when(F.col("above") == "part", 1).otherwise(2)
    return c.select(F.lit(1).alias("doc"), key.alias("place"), F.concat(F.repeat(F.lit("\t"), depth), "label").alias("line"))


def side(x: Inputs, name: str) -> pipelines.Side:
    return pipelines.Side(x.one, x.one_edges) if name == "one" else pipelines.Side(x.two, x.two_edges)


def minimum_slice(x: Inputs):
    """Two measures of all labels, combined, the best target of each source, judged by shared nouns."""
    pairs = C.all_pairs(x.one.select("id", "label"), x.two.select("id", "label"))
    a, b = F.col("src_label"), F.col("tgt_label")
    scores = pairs.select("src_id", "tgt_id", F.explode(F.array(F.struct(F.lit("edit").alias("matcher"), S.levenshtein_similarity(a, b).alias("similarity")), F.struct(F.lit("words").alias("matcher"), S.token_measure(S.tokens(a), S.tokens(b), "jaccard").alias("similarity")))).alias("s")).select("src_id", "tgt_id", "s.*")
    sim = combination.linear(scores, {"edit": 1.0, "words": 3.0}).withColumn("similarity", F.round("similarity", 6))
    best = selection.top_per(sim, "src", 1, 0.3)
    noun = lambda c, at: c.select("id", F.element_at(S.tokens(F.col("label")), at).alias("k"))
    found = evaluation.accuracy(best, C.key_join(noun(x.one, -1), noun(x.two, 1), "k"))
    return found.select("n_found", "n_correct", "n_reference", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f")))


SLICE = """
WITH s AS (SELECT one.id AS src_id, two.id AS tgt_id, string_split(one.label, ' ')[-1] = string_split(two.label, ' ')[1] AS k,
  round(((1 - least(levenshtein(one.label, two.label), least(length(one.label), length(two.label))) / least(length(one.label), length(two.label)))
   + 3 * len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))) / (len(list_distinct(string_split(one.label, ' '))) + len(list_distinct(string_split(two.label, ' '))) - len(list_intersect(string_split(one.label, ' '), string_split(two.label, ' '))))) / 4, 6) AS similarity FROM one CROSS JOIN two),
b AS (SELECT * FROM s WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY src_id ORDER BY similarity DESC, tgt_id DESC) = 1),
n AS (SELECT count(*) AS f, count(*) FILTER (k) AS c, (SELECT count(*) FROM s WHERE k) AS r FROM b)
SELECT f AS n_found, c AS n_correct, r AS n_reference, round(c / f, 6) AS precision, round(c / r, 6) AS recall, round(2 * (c / f) * (c / r) / (c / f + c / r), 6) AS f FROM n
"""


def register(add) -> None:
    rounded = lambda df: df.select("src_id", "tgt_id", F.round("similarity", 6).alias("similarity"))
    # A: sources and sinks
    add(
        "A1_rdf_xml",
        lambda x: loaded(again(lambda y, p: alignments.well_formed(rdf_xml(y)).write.text(p), lambda s, p: ontologies.load(s, p, "owl"))(x)),
        LINKS,
        ONE,
    )
    add("A2_n_triples", lambda x: loaded(again(lambda y, p: n_triples(y).write.text(p), lambda s, p: ontologies.load(s, p, "nt"))(x)), LINKS, ONE)
    add("A4_indented", lambda x: loaded(ontologies.from_indented(indented(x), "place", "line", "doc")), LINKS, ONE)
    add(
        "A6_triple_store",
        lambda x: loaded(again(lambda y, p: triples(y).write.parquet(p), lambda s, p: ontologies.load(s, p, "parquet"))(x)),
        LINKS,
        ONE,
    )
    add(
        "A9_instances",
        lambda x: ontologies.instances(triples(x)).select("uri", F.element_at("props", "label")[0].alias("label")),
        "SELECT 'http://one/n' || id AS uri, label FROM one",
        ONE,
    )
    add(
        "A10_grouped_statements",
        lambda x: instances.grouped(instances.statements(x.table("supplier"), "s_suppkey", ["s_name", "s_nationkey"])).select("id", F.element_at("props", "s_name")[0].alias("name"), F.element_at("props", "s_nationkey")[0].alias("nation")),
        "SELECT s_suppkey AS id, s_name AS name, s_nationkey::STRING AS nation FROM supplier",
    )
    add(
        "A12_repair",
        lambda x: ontologies.repaired(x.table("region").select(F.concat("r_name", F.lit("\\q \\n")).alias("value"))),
        "SELECT r_name || '\\\\q \\n' AS value FROM region",
    )
    add("A20_cells", again(lambda x, p: alignments.write_cells(cells(x), p), alignments.read_cells), WRITTEN, SIM)
    add(
        "A22_table",
        again(lambda x, p: alignments.write_table(cells(x), p), lambda s, p: alignments.read_table(s, p, alignments.LAYOUTS["scored"])),
        WRITTEN,
        SIM,
    )
    add(
        "A23_numbered",
        again(lambda x, p: cells(x).select(F.concat_ws("\t", F.lit("1"), "source", F.lit("-"), "target", F.lit("x")).alias("value")).write.text(p), lambda s, p: alignments.read_table(s, p, alignments.LAYOUTS["numbered-5"])),
        WRITTEN.replace("round(similarity, 4)", "CAST(1 AS DOUBLE)"),
        SIM,
    )
    add("A24_arrows", again(lambda x, p: alignments.write_arrows(cells(x), p), alignments.read_arrows), WRITTEN, SIM)
    concepts = lambda x, k, u: x.sim.select(F.col(k).alias("id")).distinct().withColumn("uri", F.concat(F.lit(u), "id"))
    turned = lambda c: c.select(F.col("target").alias("source"), F.col("source").alias("target"), "similarity", "relation")
    add(
        "A25_resolved",
        lambda x: alignments.resolved(turned(cells(x)), concepts(x, "src_id", "http://s/"), concepts(x, "tgt_id", "http://t/")),
        "SELECT src_id, tgt_id, round(similarity, 4) AS similarity, '=' AS relation FROM sim",
        SIM,
    )
    add(
        "A26_by_either_uri",
        lambda x: alignments.by_either_uri(cells(x)),
        "SELECT 'http://s/' || src_id AS uri, 'http://t/' || tgt_id AS other FROM sim UNION ALL "
        "SELECT 'http://t/' || tgt_id, 'http://s/' || src_id FROM sim",
        SIM,
    )
    add(
        "A27_pairs",
        again(lambda x, p: cells(x).select(F.concat_ws("\t", "source", "target").alias("value")).write.text(p), lambda s, p: alignments.read_table(s, p, alignments.LAYOUTS["pairs"])),
        WRITTEN.replace("round(similarity, 4)", "CAST(1 AS DOUBLE)"),
        SIM,
    )
    add(
        "A28_three_tokens",
        again(lambda x, p: cells(x).select(F.concat_ws(" ", "target", F.lit("<"), "source").alias("value")).write.text(p), lambda s, p: alignments.read_three_tokens(s, p, "http://s/")),
        WRITTEN.replace("round(similarity, 4)", "CAST(1 AS DOUBLE)").replace("'='", "'>'"),
        SIM,
    )
    add(
        "A31_matrix",
        again(lambda x, p: alignments.write_matrix(x.sim, p, 0.6), lambda s, p: s.read.parquet(p)),
        "SELECT * FROM sim WHERE similarity > 0.6",
        SIM,
    )
    add(
        "A33_tasks",
        again(lambda x, p: corpora.tasks_json(x.table("nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("source"), F.lit("t").alias("target"), F.lit("base").alias("matcher"), F.lit("greedy").alias("selector"), F.lit("o").alias("output"))).write.text(p), corpora.read_tasks),
        "SELECT n_nationkey AS place, n_name AS source, 't' AS target, 'base' AS matcher, 'greedy' AS selector, 'o' AS output FROM nation",
    )
    news = lambda x: x.table("documents").select(F.concat(F.lit('<DOC id="'), "doc_id", F.lit('" type="'), "lang", F.lit('"><HEADLINE>'), "source", F.lit("</HEADLINE><TEXT>"), "n_chars", F.lit("</TEXT></DOC>")).alias("value"))
    add(
        "A35_sgml",
        again(lambda x, p: news(x).write.text(p), corpora.read_sgml),
        "SELECT doc_id::STRING AS id, lang AS kind, source AS headline, n_chars::STRING AS text FROM documents",
    )
    bare = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b.*?</script>', ' ', 'gis'), '<style\b.*?</style>', ' ', 'gis'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')"
    add(
        "A35_html",
        lambda x: corpora.html_text(x.table("pages")).select("page_id", F.length("title").cast("long").alias("n_title"), F.length("plain").cast("long").alias("n_text"), F.sha2("plain", 256).alias("plain")),
        rf"SELECT page_id, length(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))) AS n_title, length(trim({bare})) AS n_text, "
        rf"sha256(trim({bare})) AS plain FROM pages",
    )
    add(
        "A36_vectors",
        again(lambda x, p: corpora.write_vectors(x.table("embeddings").select(F.concat(F.lit("w"), "vec_id").alias("word"), F.col("embedding").alias("vec")), p), lambda s, p: corpora.read_vectors(s, p).select("word", F.round(F.aggregate("vec", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))),
        "SELECT 'w' || vec_id AS word, round(list_sum(list_transform(embedding, lambda v: v::DOUBLE)), 4) AS total FROM embeddings",
    )
    add(
        "A37_vocabulary",
        again(lambda x, p: corpora.write_vocabulary(x.table("documents").groupBy(F.col("source").alias("word")).agg(F.count(F.lit(1)).alias("cnt")), p), corpora.read_vocabulary),
        "SELECT source AS word, count(*) AS cnt FROM documents GROUP BY 1",
    )
    add(
        "A38_tokenised",
        lambda x: corpora.tokenised(x.table("documents")).select("doc_id", F.size("tokens").cast("long").alias("n"), F.sha2("line", 256).alias("line")),
        r"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS w "
        r"FROM documents) SELECT doc_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS line FROM t WHERE len(w) > 10",
    )
    # O: pipelines
    add("O1_minimum_slice", minimum_slice, SLICE, ONE, TWO)
    for name in pipelines.PLANS:
        add(f"O_plan_{name}", lambda x, n=name: rounded(pipelines.run(side(x, "one"), side(x, "two"), pipelines.PLANS[n])))
    add("O7_matchers", lambda x: x.spark.createDataFrame([(n,) for n in sorted(pipelines.MATCHERS)], "name string"))
    # P: order, limits and sets
    add("P1_sorted", lambda x: x.sim.orderBy("similarity", "src_id", "tgt_id"), "SELECT * FROM sim", SIM)
    add(
        "P3_limit",
        lambda x: x.sim.orderBy(F.desc("similarity"), "src_id", "tgt_id").limit(25),
        "SELECT * FROM sim ORDER BY similarity DESC, src_id, tgt_id LIMIT 25",
        SIM,
    )
    pair = lambda x: x.sim.filter("similarity >= 0.6").select("src_id", "tgt_id")
    some = "SELECT src_id, tgt_id FROM sim WHERE similarity >= 0.6"
    add("P4_union", lambda x: pair(x).unionByName(x.ref), f"{some} UNION ALL SELECT * FROM ref", SIM, REF)
    add("P5_intersect", lambda x: pair(x).intersect(x.ref), f"{some} INTERSECT SELECT * FROM ref", SIM, REF)
    add("P6_except", lambda x: pair(x).exceptAll(x.ref), f"{some} EXCEPT ALL SELECT * FROM ref", SIM, REF)
    add("P7_distinct", lambda x: x.sim.select("similarity").distinct(), "SELECT DISTINCT similarity FROM sim", SIM)
    word = lambda c: c.select(F.explode(S.tokens(F.col("label"))).alias("w"))
    tags = "SELECT unnest(string_split(label, ' ')) AS w FROM {}"
    add(
        "P8_multiset_intersection",
        lambda x: word(x.one).intersectAll(word(x.two)),
        f"{tags.format('one')} INTERSECT ALL {tags.format('two')}",
        ONE,
        TWO,
    )
    add("P8_multiset_union", lambda x: word(x.one).unionAll(word(x.two)), f"{tags.format('one')} UNION ALL {tags.format('two')}", ONE, TWO)
