from __future__ import annotations

from weft.operators import evaluation, selection
from weft.sources import trees


def test_turtle():
    text = '@prefix x: <http://x/> .\n# note\nx:a a x:T ; x:p "one, two; three." , "b"@en ; x:q 5 .\n<http://y> x:r x:a .\n'
    assert trees.turtle_statements(text) == [
        ("http://x/a", trees.RDF + "type", "http://x/T", False),
        ("http://x/a", "http://x/p", "one, two; three.", True),
        ("http://x/a", "http://x/p", "b", True),
        ("http://x/a", "http://x/q", "5", True),
        ("http://y", "http://x/r", "http://x/a", False),
    ]


def test_xml_tree_reuses_ids(spark):
    docs = spark.createDataFrame([(1, '<r id="r"><x id="a" label="A"/><g><x id="b"/><x id="a"/></g></r>')], "doc int, body string")
    o = trees.from_xml(docs, "doc", "body")
    name = {r.id: r.uri for r in o.concepts.collect()}
    assert {(name[r.child], name.get(r.parent)) for r in o.edges.collect()} == {("r", None), ("a", "r"), ("b", "r")}


def test_repair_drops_the_weaker_of_two(spark):
    up = spark.createDataFrame([(1, 0), (2, 0)], "low long, high long")
    sim = spark.createDataFrame([(1, 1, 0.9), (0, 2, 0.5), (2, 2, 0.4)], "src_id long, tgt_id long, similarity double")
    disjoint = spark.createDataFrame([(1, 2)], "a long, b long")
    none = spark.createDataFrame([], "low long, high long")
    assert {(r.src_id, r.tgt_id) for r in selection.repaired(sim, up, none, disjoint).collect()} == {(1, 1), (2, 2)}


def test_distances_of_equal_trees_are_kept(spark):
    edges = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1)], "child long, parent long")
    same = spark.createDataFrame([(i, i, 1.0) for i in range(4)], "src_id long, tgt_id long, similarity double")
    for upper in (True, False):
        assert evaluation.distance_preservation(same, edges, edges, upper).first()[0] == 1.0
