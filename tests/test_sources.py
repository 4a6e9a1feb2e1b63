"""Files of all layouts, written by hand and read."""

from __future__ import annotations

import datetime
import decimal
import os
import subprocess
import sys
from pathlib import Path

import pyspark
import pytest

from weft.sources import alignments, corpora, ontologies, trees


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
  <owl:Class rdf:about="http://x#Thing1"><rdfs:label>Thing one</rdfs:label><rdfs:comment>first</rdfs:comment></owl:Class>
  <owl:Class rdf:about="http://x#Thing2"><rdfs:subClassOf rdf:resource="http://x#Thing1"/></owl:Class>
  <owl:Class rdf:about="http://x#Thing3"><rdfs:subClassOf rdf:resource="http://x#Thing1"/><rdfs:subClassOf rdf:resource="http://x#Thing2"/></owl:Class>
  <owl:ObjectProperty rdf:about="http://x#p"><rdfs:label>P</rdfs:label></owl:ObjectProperty>
  <owl:ObjectProperty rdf:about="http://x#q"><rdfs:subPropertyOf rdf:resource="http://x#p"/></owl:ObjectProperty>
</rdf:RDF>
"""


def test_owl(spark, tmp_path):
    o = ontologies.load(spark, write(tmp_path / "a.owl", OWL), "owl")
    concepts = {(r.kind, r.id): (r.local_name, r.label, r.comment) for r in o.concepts.collect()}
    assert concepts == {("class", 0): ("Thing1", "Thing one", "first"), ("class", 1): ("Thing2", None, None), ("class", 2): ("Thing3", None, None), ("property", 0): ("p", "P", None), ("property", 1): ("q", None, None)}
    assert {tuple(r) for r in o.edges.collect()} == {("subClassOf", 0, None), ("subClassOf", 1, 0), ("subClassOf", 2, 0), ("subClassOf", 2, 1), ("subPropertyOf", 0, None), ("subPropertyOf", 1, 0)}


def test_n_triples(spark, tmp_path):
    text = '<http://x#a> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .\n_:b <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://www.w3.org/2002/07/owl#Class> .\n# no statement\n<http://x#a> <http://www.w3.org/2000/01/rdf-schema#label> "A \\"b\\""@en .\n'
    o = ontologies.load(spark, write(tmp_path / "a.nt", text), "nt")
    assert [(r.uri, r.label) for r in o.concepts.collect()] == [("http://x#a", 'A "b"')]


def test_indented(spark):
    lines = ["root", "\ta", "\t\tb", "\tc", "\t\tb", "other"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc int, place int, line string")
    o = ontologies.from_indented(df, "place", "line", "doc")
    name = {r.id: r.label for r in o.concepts.collect()}
    assert {(name[r.child], name.get(r.parent)) for r in o.edges.collect()} == {("root", None), ("a", "root"), ("b", "a"), ("c", "root"), ("b", "c"), ("other", None)}


@pytest.mark.parametrize(
    "layout, text, want",
    [
        ("pairs", "s\tt\n\n", ("s", "t", 1.0, "=")),
        ("relation", "s\t<\tt\n", ("s", "t", 1.0, "<")),
        ("scored", "s\t=\tt\t0.25\n", ("s", "t", 0.25, "=")),
        ("scored", "s\t=\tt\t7\n", ("s", "t", 1.0, "=")),
        ("numbered-4", "1\ts\tt\tx\n", ("s", "t", 1.0, "=")),
        ("numbered-5", "1\ts\tx\tt\ty\n", ("s", "t", 1.0, "=")),
    ],
)
def test_tables(spark, tmp_path, layout, text, want):
    rows = alignments.read_table(spark, write(tmp_path / "a.tsv", text), alignments.LAYOUTS[layout]).collect()
    assert [(r.source, r.target, r.similarity, r.relation) for r in rows] == [want]


def test_arrows_and_cells(spark, tmp_path):
    text = "Matching\n---\ns ---> t 0.5 =\nu ---> v 0.9 < by hand\n"
    rows = alignments.read_arrows(spark, write(tmp_path / "a.txt", text))
    assert [tuple(r) for r in rows.collect()] == [("s", "t", 0.5, "=", None), ("u", "v", 0.9, "<", "by hand")]
    alignments.write_cells(rows, str(tmp_path / "cells"))
    back = alignments.read_cells(spark, str(tmp_path / "cells"))
    assert sorted(tuple(r)[:4] for r in back.collect()) == [("s", "t", 0.5, "="), ("u", "v", 0.9, "<")]


def test_repair(spark):
    rows = spark.createDataFrame([(r"a\q b\n c\\",)], "value string")
    assert ontologies.repaired(rows).first().value == r"a\\q b\n c\\"


def test_corpora(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0, -0.5]), ("b", [0.25, 2.0])], "word string, vec array<double>")
    corpora.write_vectors(vectors, str(tmp_path / "v"))
    assert sorted(map(tuple, corpora.read_vectors(spark, str(tmp_path / "v")).collect())) == [("a", [1.0, -0.5]), ("b", [0.25, 2.0])]
    sgml = '<DOC id="N1" type="story" >\n<HEADLINE>\nBig\nnews\n</HEADLINE>\n<TEXT>\n<P>one</P>\n<P>two</P>\n</TEXT>\n</DOC>\n'
    row = corpora.read_sgml(spark, write(tmp_path / "n.sgml", sgml)).first()
    assert (row.id, row.kind, row.headline, row.text.split()) == ("N1", "story", "Big news", ["one", "two"])
    pages = spark.createDataFrame([("<html><title>T</title><script>x<y</script><p>a</p> b</html>",)], "html string")
    assert corpora.html_text(pages).first().plain == "T a b"


def test_database_keeps_values(spark, tmp_path):
    rows = [
        (1, 'a "b",\n c', 1.5, datetime.date(2020, 1, 2), decimal.Decimal("1.25"), True, bytearray(b"\0x"), datetime.datetime(2020, 1, 2, 3, 4, 5, 678901)),
        (2, "", None, None, None, False, None, None),
        (2, None, 0.0, None, None, None, None, None),
        (4, " é🙂 ", -2.0, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "a long, b string, c double, d date, e decimal(10,2), f boolean, g binary, h timestamp")
    for name, some in (("T1", df.repartition(3)), ("T2", df.limit(0))):  # a folder with a blank, another table beside the first
        url = trees.write_embedded(some, f"file://{tmp_path}/a b", name)
        got = trees.read_database(spark, url, name, **trees.EMBEDDED)
        assert got.dtypes == df.dtypes and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, some.collect()), key=str)


CLUSTER = """
import sys
from pyspark.sql import SparkSession
from weft.plans import registry

spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://" + sys.argv[2]).getOrCreate()
for _ in range(2):
    df = registry.QUERIES["A7_database"](spark, sys.argv[1])
    print("ROWS", df.repartition(4).count(), df.distinct().count())
spark.stop()
"""


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables here")
def test_database_is_read_by_executors(tmp_path):
    """Executors are processes of their own, which see the shared folder alone."""
    (tmp_path / "home" / "work").mkdir(parents=True)
    for p in Path(pyspark.__file__).parent.iterdir():  # the executors' logs go to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": f"{tmp_path}/home", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_SCALA_VERSION": "2.13", "PYSPARK_PYTHON": sys.executable, "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    said = subprocess.run([sys.executable, "-c", CLUSTER, "/root/testdata/sf0.001", f"{tmp_path}/shared"], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert said.stdout.count("ROWS 25 25") == 2, said.stderr[-3000:]
