"""Ontologies from files: concept, edge and annotation relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.numbering import numbered

RDF, RDFS, OWL = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "http://www.w3.org/2000/01/rdf-schema#", "http://www.w3.org/2002/07/owl#"


@dataclass
class Ontology:
    """concepts: id, kind, uri, local_name, label, comment, see_also, is_defined_by;
    edges: hierarchy, child, parent (null under the root); annotations: id, predicate, value."""

    concepts: DataFrame
    edges: DataFrame
    annotations: DataFrame


def local_name(uri: Column) -> Column:
    return F.regexp_extract(uri, r"([^#/]*)[#/]?$", 1)


_TRIPLE = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"\S*)\s*\.\s*$'


def unescaped(text: Column) -> Column:
    """A literal's body with its escapes decoded: one backslash and letter, or 4 or 8 hexadecimal digits of a code point.

    Only bodies with a backslash are cut up. Pieces are an escape or what stands between two.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+)"), 1)
    short = F.create_map(*(F.lit(x) for pair in {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f"}.items() for x in pair))

    def of(piece: Column) -> Column:
        second = F.substring(piece, 2, 1)
        point = F.decode(F.unhex(F.lpad(F.substring(piece, 3, 8), 8, "0")), "UTF-32")
        return F.when(~F.startswith(piece, F.lit("\\")), piece).when(second.isin("u", "U") & (F.length(piece) > 2), point).otherwise(F.coalesce(short[second], second))

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pieces, of), "")).otherwise(text)


def rejected_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an N-Triples file that read_triples() skips, but for comments and blank ones."""
    return spark.read.text(path).filter(~F.col("value").rlike(_TRIPLE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """N-Triples: s, p, o, is_literal; lines that aren't statements are skipped (rejected_lines() has them)."""
    rows = spark.read.text(path).filter(F.col("value").rlike(_TRIPLE))
    part = lambda i: F.regexp_extract("value", _TRIPLE, i)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    literal = F.regexp_extract(part(3), r'^"((?:[^"\\]|\\.)*)"', 1)
    is_literal = F.startswith(part(3), F.lit('"'))
    return rows.select(bare(part(1)).alias("s"), part(2).alias("p"), F.when(is_literal, unescaped(literal)).otherwise(bare(part(3))).alias("o"), is_literal.alias("is_literal"))


def repaired(lines: DataFrame) -> DataFrame:
    """Backslashes that begin no valid escape are doubled."""
    return lines.select(F.regexp_replace("value", r'(?<!\\)((?:\\\\)*)\\(?![tbnrf"\'\\uU])', r"$1\\\\").alias("value"))


def read_rdf_xml(spark: SparkSession, path: str) -> DataFrame:
    """Triples of the flat form of RDF/XML: classes and properties with their direct children."""
    out = None
    ref = "struct<`_rdf:resource`:string>"
    for tag, kind in (("owl:Class", f"{OWL}Class"), ("rdfs:Class", f"{RDFS}Class"), ("owl:ObjectProperty", f"{OWL}ObjectProperty"), ("owl:DatatypeProperty", f"{OWL}DatatypeProperty"), ("rdf:Property", f"{RDF}Property")):
        schema = f"`_rdf:about` string, `_rdf:ID` string, `rdfs:label` array<string>, `rdfs:comment` array<string>, `rdfs:subClassOf` array<{ref}>, `rdfs:subPropertyOf` array<{ref}>, `rdfs:seeAlso` array<{ref}>, `rdfs:isDefinedBy` array<{ref}>"
        rows = spark.read.format("xml").option("rowTag", tag).option("nullValue", "").schema(schema).load(path)
        s = F.coalesce("`_rdf:about`", F.concat(F.lit("#"), F.col("`_rdf:ID`")))
        said = lambda c, p: F.transform(F.coalesce(F.col(f"`rdfs:{c}`"), F.array().cast("array<string>")), lambda v: F.struct(F.lit(f"{RDFS}{p}").alias("p"), F.trim(v).alias("o"), F.lit(True).alias("is_literal")))
        link = lambda c: F.transform(F.coalesce(F.col(f"`rdfs:{c}`"), F.array().cast(f"array<{ref}>")), lambda v: F.struct(F.lit(f"{RDFS}{c}").alias("p"), v["_rdf:resource"].alias("o"), F.lit(False).alias("is_literal")))
        own = F.array(F.struct(F.lit(f"{RDF}type").alias("p"), F.lit(kind).alias("o"), F.lit(False).alias("is_literal")))
        parts = F.flatten(F.array(own, said("label", "label"), said("comment", "comment"), link("subClassOf"), link("subPropertyOf"), link("seeAlso"), link("isDefinedBy")))
        one = rows.filter(s.isNotNull()).select(s.alias("s"), F.explode(parts).alias("t")).select("s", "t.p", "t.o", "t.is_literal").filter("o IS NOT NULL")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def from_triples(triples: DataFrame) -> Ontology:
    """Concepts numbered by URI within their kind; blank nodes are no concepts."""
    kinds = {f"{OWL}Class": "class", f"{RDFS}Class": "class", f"{OWL}ObjectProperty": "property", f"{OWL}DatatypeProperty": "property", f"{RDF}Property": "property"}
    known = F.create_map(*(F.lit(x) for pair in kinds.items() for x in pair))
    typed = triples.filter((F.col("p") == f"{RDF}type") & F.col("o").isin(list(kinds)) & ~F.startswith(F.col("s"), F.lit("_:")))
    typed = typed.groupBy(F.col("s").alias("uri")).agg(F.min(known[F.col("o")]).alias("kind"))
    value = lambda p: F.min(F.when(F.col("p") == f"{RDFS}{p}", F.col("o")))
    said = triples.groupBy(F.col("s").alias("uri")).agg(value("label").alias("label"), value("comment").alias("comment"), value("seeAlso").alias("see_also"), value("isDefinedBy").alias("is_defined_by"))
    # places in the whole order less the kind's first are places within the kind
    placed = numbered(typed.join(said, "uri", "left"), [F.col("kind"), F.col("uri")])
    first = placed.groupBy("kind").agg(F.min("number").alias("first"))
    concepts = placed.join(F.broadcast(first), "kind").select((F.col("number") - F.col("first")).alias("id"), "kind", "uri", local_name(F.col("uri")).alias("local_name"), "label", "comment", "see_also", "is_defined_by")
    ids = concepts.select("uri", "id", "kind")
    parts = None
    for p, kind in (("subClassOf", "class"), ("subPropertyOf", "property")):
        child = ids.filter(F.col("kind") == kind).select(F.col("uri").alias("s"), F.col("id").alias("child"))
        parent = ids.filter(F.col("kind") == kind).select(F.col("uri").alias("o"), F.col("id").alias("parent"))
        links = triples.filter(F.col("p") == f"{RDFS}{p}").select("s", "o").distinct().join(parent, "o")
        one = child.join(links, "s", "left").select(F.lit(p).alias("hierarchy"), "child", "parent")
        parts = one if parts is None else parts.unionByName(one)
    notes = triples.filter("is_literal").join(ids.select(F.col("uri").alias("s"), "id"), "s").select("id", local_name(F.col("p")).alias("predicate"), F.col("o").alias("value"))
    return Ontology(concepts, parts, notes)


def from_indented(lines: DataFrame, order: str, text: str, document: str) -> Ontology:
    """Tabs are the hierarchy: a line's parent is the last line before it with one tab less; a name is one node.

    lines: document, order (the line's place in it) and text. Each level looks for
    its parents by a running maximum over the lines of its document.
    """
    depth = F.length(F.regexp_extract(text, "^(\t*)", 1))
    rows = lines.select(document, F.col(order).alias("_o"), depth.alias("_d"), F.trim(F.regexp_replace(text, "\t", " ")).alias("label")).filter("label <> ''")
    deepest = rows.agg(F.max("_d")).first()[0] or 0
    before = W.partitionBy(document).orderBy("_o").rowsBetween(W.unboundedPreceding, -1)
    above = F.coalesce(*(F.when(F.col("_d") == d, F.last(F.when(F.col("_d") == d - 1, F.col("label")), ignorenulls=True).over(before)) for d in range(1, deepest + 1))) if deepest else F.lit(None).cast("string")
    linked = rows.withColumn("above", above)
    concepts = numbered(linked.select("label").distinct(), [F.col("label")], "id").select("id", F.lit("class").alias("kind"), F.concat(F.lit("#"), "label").alias("uri"), F.col("label").alias("local_name"), "label")
    child = concepts.select(F.col("label"), F.col("id").alias("child"))
    parent = concepts.select(F.col("label").alias("above"), F.col("id").alias("parent"))
    edges = linked.select("label", "above").distinct().join(child, "label").join(parent, "above", "left").select(F.lit("tree").alias("hierarchy"), "child", "parent")
    return Ontology(concepts, edges, concepts.select("id", F.lit("label").alias("predicate"), F.col("label").alias("value")))


def load(spark: SparkSession, path: str, language: str) -> Ontology:
    """An ontology by its file's language: owl, rdfs, nt or parquet (stored triples)."""
    if language in ("owl", "rdfs"):
        return from_triples(read_rdf_xml(spark, path))
    if language == "nt":
        return from_triples(read_triples(spark, path))
    if language == "parquet":
        return from_triples(spark.read.parquet(path))
    raise ValueError(f"no loader for {language}")


def instances(triples: DataFrame, types: str = f"{RDF}type") -> DataFrame:
    """uri, type, props: the subjects that have a type, with a map of their other statements."""
    typed = triples.filter(F.col("p") == types).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("type"))
    values = triples.filter(F.col("p") != types).groupBy(F.col("s").alias("uri"), local_name(F.col("p")).alias("k")).agg(F.sort_array(F.collect_set("o")).alias("v"))
    props = values.groupBy("uri").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("props"))
    return typed.join(props, "uri", "left")


class TripleStore:
    """Statements in a folder that any store can hold: what is added or removed is appended, the last word on a statement counts."""

    KEY = ("s", "p", "o", "is_literal")

    def __init__(self, spark: SparkSession, path: str):
        """Open the store; an empty or missing folder is an empty store."""
        self.spark, self.path = spark, path
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
        self.turn = (self._log().agg(F.max("turn")).first()[0] or 0) if there else 0

    def _log(self) -> DataFrame:
        return self.spark.read.schema("s string, p string, o string, is_literal boolean, turn long, is_added boolean").parquet(self.path)

    def _append(self, triples: DataFrame, is_added: bool) -> None:
        self.turn += 1
        triples.select(*self.KEY, F.lit(self.turn).cast("long").alias("turn"), F.lit(is_added).alias("is_added")).write.mode("append").parquet(self.path)

    def add(self, triples: DataFrame) -> None:
        self._append(triples, True)

    def remove(self, triples: DataFrame) -> None:
        self._append(triples, False)

    def read(self) -> DataFrame:
        """s, p, o, is_literal of the statements that are there."""
        if not self.turn:
            return self.spark.createDataFrame([], "s string, p string, o string, is_literal boolean")
        last = self._log().groupBy(*self.KEY).agg(F.max_by("is_added", "turn").alias("there"))
        return last.filter("there").drop("there")
