"""Candidate pairs by joins on keys, and joins over hierarchies."""

from __future__ import annotations

from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.cut import kept

PAIR = ["src_id", "tgt_id"]


def key_join(source: DataFrame, target: DataFrame, key: str, similarity: float = 1.0) -> DataFrame:
    """Pairs with one key; source and target: id, and the key. Empty and null keys join nothing."""
    a = source.filter(F.col(key) != "").select(F.col("id").alias("src_id"), F.col(key).alias("_key"))
    b = target.filter(F.col(key) != "").select(F.col("id").alias("tgt_id"), F.col(key).alias("_key"))
    return a.join(b, "_key").select(*PAIR, F.lit(similarity).alias("similarity"))


def ladder(source: DataFrame, target: DataFrame, steps: list[tuple[str, float]]) -> DataFrame:
    """The best score of several key joins: exact names first, then more and more normalised ones."""
    out = None
    for key, score in steps:
        one = key_join(source, target, key, score)
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*PAIR).agg(F.max("similarity").alias("similarity"))


def token_blocks(source: DataFrame, target: DataFrame, words: str, most: int | None = None) -> DataFrame:
    """Pairs that share a word, with how many; words is an array column.

    Words in more than `most` targets are left out as keys where a bound is given:
    that is a blocking rule of the caller's, so it has no default.
    """
    a = source.select(F.col("id").alias("src_id"), F.explode(F.array_distinct(words)).alias("_w"))
    b = target.select(F.col("id").alias("tgt_id"), F.explode(F.array_distinct(words)).alias("_w"))
    if most is not None:
        b = b.join(b.groupBy("_w").count().filter(F.col("count") <= most).select("_w"), "_w", "left_semi")
    return a.join(b, "_w").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("shared"))


def all_pairs(source: DataFrame, target: DataFrame) -> DataFrame:
    """Every source with every target: for two concept lists, whose product is the task itself."""
    a = source.select(*(F.col(c).alias(f"src_{c}") for c in source.columns))
    b = target.select(*(F.col(c).alias(f"tgt_{c}") for c in target.columns))
    return a.crossJoin(b)


def dealt_pairs(source: DataFrame, target: DataFrame, parts: int) -> DataFrame:
    """Every source with every target in blocks: each side in `parts` chunks by id, `parts` stages of disjoint blocks.

    Blocks are joined on their target chunk, so a block is one key of bounded size instead of a
    product of whole sides; a stage's blocks share no chunk and can be scored by themselves.
    """
    a = source.select(F.col("id").alias("src_id")).withColumn("stage", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    a = a.withColumn("_chunk", F.pmod(F.col("src_id") + F.col("stage"), F.lit(parts)))
    b = target.select(F.col("id").alias("tgt_id"), F.pmod("id", F.lit(parts)).alias("_chunk"))
    return a.join(b, "_chunk").select(*PAIR, "stage")


def similar_pairs(source: DataFrame, target: DataFrame, threshold: float, text: str = "label") -> DataFrame:
    """The pairs whose edit similarity reaches a threshold above 0.5, without the product of both sides.

    Different texts are compared once, whatever their copies, and only those that share a key. The
    length of a pair's longer text bounds its edits, and so says which keys it is found by: shortened
    forms where there are few of them, letter pairs elsewhere. Neither loses a pair. Empty texts are
    like none.
    """
    if threshold <= 0.5:
        raise ValueError("a threshold above 0.5 is needed: below it texts may share no letter pair")
    sides = [s.filter(F.length(text) > 0).select(F.col(text).alias(f"{n}_text")).distinct() for s, n in ((source, "src"), (target, "tgt"))]
    texts = ["src_text", "tgt_text"]
    pairs = _by_forms(*sides, threshold).unionByName(_by_letter_pairs(*sides, threshold)).distinct()
    scored = pairs.select(*texts, (1 - F.levenshtein(*texts) / F.greatest(*map(F.length, texts))).alias("similarity")).filter(F.col("similarity") >= threshold)
    ids = lambda side, name: side.select(F.col("id").alias(f"{name}_id"), F.col(text).alias(f"{name}_text"))
    return scored.join(ids(source, "src"), "src_text").join(ids(target, "tgt"), "tgt_text").select(*PAIR, "similarity")


#: Texts of a length are joined on their shortened forms if there are at most so many of them.
FORMS = 512


def _edits(longer: Column, threshold: float) -> Column:
    """The most edits of a similar pair whose longer text has this length."""
    return F.floor(longer * (1 - threshold) + 1e-9).cast("int")


def _few_forms(longer: Column, threshold: float) -> Column:
    edits, few = _edits(longer, threshold), F.lit(False)
    for k in range(1, FORMS):
        if comb(2 * k + 1, k) > FORMS:  # edits are fewer than half the letters
            break
        few = few | ((edits == k) & (longer <= next(n for n in range(2 * k, FORMS + 2) if comb(n + 1, k) > FORMS)))
    return (edits == 0) | few


def _longer(length: Column, threshold: float) -> Column:
    """The lengths that the longer text of a similar pair can have, by the length of either text."""
    return F.sequence(length, F.floor(length / threshold + 1e-6).cast("int"))


def _by_forms(source: DataFrame, target: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts that are equal after as many letters are taken out as a similar pair allows.

    Of a pair with k edits at most, the longer text loses k letters and the shorter one k less the
    difference of lengths: what no edit touches is left in both.
    """

    def keyed(side: DataFrame, name: str) -> DataFrame:
        own = F.col(f"{name}_text")
        without = lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))
        lengths = F.filter(_longer(F.length(own), threshold), lambda n: _few_forms(n, threshold))
        cut = side.select(own, F.explode(lengths).alias("_longer")).withColumn("_cut", _edits(F.col("_longer"), threshold) - F.col("_longer") + F.length(own)).filter("_cut >= 0")
        forms = F.aggregate(F.slice(F.array(*map(F.lit, range(FORMS.bit_length()))), 1, F.col("_cut")), F.array(own), lambda found, _: F.array_distinct(F.flatten(F.transform(found, without))))
        return cut.select(own, "_longer", F.explode(forms).alias("_form")).withColumn("_form", F.xxhash64("_form"))

    return keyed(source, "src").join(keyed(target, "tgt"), ["_longer", "_form"]).select("src_text", "tgt_text")


def _by_letter_pairs(source: DataFrame, target: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts that share one of their rarest letter pairs, of lengths that have too many forms.

    An edit changes two letter pairs of a padded text at most, so of those of a similar pair all but
    two for each edit are shared. Then one of the rarest in each text is shared as well, if one more
    than may be lost are taken in the same order. A letter pair that comes again counts as another one.
    """

    def counted(side: DataFrame, name: str) -> DataFrame:
        own = F.col(f"{name}_text")
        padded = F.concat(F.lit("#"), own, F.lit("#"))
        grams = F.transform(F.sequence(F.lit(1), F.length(own) + 1), lambda i: F.substring(padded, i, F.lit(2)))
        long = side.filter(F.exists(_longer(F.length(own), threshold), lambda n: ~_few_forms(n, threshold)))
        found = long.select(own, F.explode(grams).alias("_gram")).groupBy(own, "_gram").agg(F.count(F.lit(1)).cast("int").alias("_n"))
        return found.select(own, "_gram", F.explode(F.sequence(F.lit(1), "_n")).alias("_nth"))

    a, b = counted(source, "src"), counted(target, "tgt")
    often = a.select("_gram", "_nth").unionByName(b.select("_gram", "_nth")).groupBy("_gram", "_nth").agg(F.count(F.lit(1)).alias("_often"))

    def rarest(found: DataFrame, name: str) -> DataFrame:
        place = F.row_number().over(W.partitionBy(f"{name}_text").orderBy("_often", "_gram", "_nth"))
        most = F.floor(F.length(f"{name}_text") * (2 * (1 - threshold)) + 1e-6) + 1
        return found.join(often, ["_gram", "_nth"]).withColumn("_place", place).filter(F.col("_place") <= most).select(f"{name}_text", "_gram", "_nth")

    lengths = F.length("src_text"), F.length("tgt_text")
    met = rarest(a, "src").join(rarest(b, "tgt"), ["_gram", "_nth"])
    near = F.abs(lengths[0] - lengths[1]) <= _edits(F.greatest(*lengths), threshold)
    return met.filter(near & ~_few_forms(F.greatest(*lengths), threshold)).select("src_text", "tgt_text")


def mediated(to_bridge: DataFrame, from_bridge: DataFrame) -> DataFrame:
    """Source to target over a bridge: the product of both similarities, the best bridge of each pair."""
    a = to_bridge.select("src_id", F.col("tgt_id").alias("_b"), F.col("similarity").alias("_x"))
    b = from_bridge.select(F.col("src_id").alias("_b"), "tgt_id", F.col("similarity").alias("_y"))
    return a.join(b, "_b").groupBy(*PAIR).agg(F.max(F.col("_x") * F.col("_y")).alias("similarity"))


def synonym_join(source: DataFrame, target: DataFrame, forms: str = "forms") -> DataFrame:
    """Pairs whose synonym sets share a form, whatever its case."""
    a = source.select(F.col("id").alias("src_id"), F.explode(forms).alias("_f")).withColumn("_f", F.lower("_f"))
    b = target.select(F.col("id").alias("tgt_id"), F.explode(forms).alias("_f")).withColumn("_f", F.lower("_f"))
    return a.distinct().join(b.distinct(), "_f").select(*PAIR).distinct()


def shared_predicates(source: DataFrame, target: DataFrame, pairs: DataFrame, measure) -> DataFrame:
    """Mean literal similarity of candidate pairs over their shared predicates.

    source, target: id, predicate, value. A predicate with several values counts its
    best pair of values. Pairs without a shared predicate get -1.
    """
    a = source.select(F.col("id").alias("src_id"), "predicate", F.col("value").alias("_x"))
    b = target.select(F.col("id").alias("tgt_id"), "predicate", F.col("value").alias("_y"))
    best = pairs.select(*PAIR).join(a, "src_id").join(b, ["tgt_id", "predicate"]).groupBy(*PAIR, "predicate").agg(F.max(measure(F.col("_x"), F.col("_y"))).alias("s"))
    mean = best.groupBy(*PAIR).agg(F.avg("s").alias("similarity"))
    return pairs.select(*PAIR).join(mean, PAIR, "left").select(*PAIR, F.coalesce("similarity", F.lit(-1.0)).alias("similarity"))


def closure(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(low, high, distance) for all ancestors; edges: child, parent; the least distance of several ways.

    Every round doubles the distance that is known, so log2(depth) joins suffice; a
    circle ends when nothing new is found. With a depth only ways of at most so many
    edges are returned.
    """
    known = edges.filter("parent IS NOT NULL").select(F.col("child").alias("low"), F.col("parent").alias("high"), F.lit(1).alias("distance")).distinct()
    size = known.count()
    while True:
        far = known.alias("a").join(known.alias("b"), F.col("a.high") == F.col("b.low")).select(F.col("a.low").alias("low"), F.col("b.high").alias("high"), (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        known = known.unionByName(far).groupBy("low", "high").agg(F.min("distance").alias("distance"))
        known = kept(known)
        before, size = size, known.count()
        if size == before:
            return known if depth is None else known.filter(F.col("distance") <= depth)


def siblings(edges: DataFrame) -> DataFrame:
    """(node, sibling) of nodes with a common parent."""
    a = edges.filter("parent IS NOT NULL")
    both = a.select("parent", F.col("child").alias("node")).join(a.select("parent", F.col("child").alias("sibling")), "parent")
    return both.filter("node <> sibling").select("node", "sibling").distinct()


def common_ancestors(up: DataFrame, pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """How many ancestors two nodes share, themselves included; up: (low, high)."""
    nodes = up.select(F.col("low").alias("n")).union(up.select("high")).distinct()
    self_up = up.select("low", "high").unionByName(nodes.select(F.col("n").alias("low"), F.col("n").alias("high")))
    x = pairs.join(self_up.withColumnRenamed("low", a), a)
    y = pairs.join(self_up.withColumnRenamed("low", b), b)
    return x.join(y, [a, b, "high"]).groupBy(a, b).agg(F.count(F.lit(1)).alias("shared"))


def label_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Edges of two graphs with one label: (label, from, to) on each side."""
    a = left.select("label", F.col("from_id").alias("from_a"), F.col("to_id").alias("to_a"))
    return a.join(right.select("label", F.col("from_id").alias("from_b"), F.col("to_id").alias("to_b")), "label")


def reachable_pairs(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Pairs of nodes reached from start pairs along equal labels; edges: as label_join() gives them."""
    step = edges.select(F.col("from_a").alias("a"), F.col("from_b").alias("b"), F.col("to_a").alias("a2"), F.col("to_b").alias("b2"))
    seen = start.select("a", "b").distinct()
    last = seen
    while not last.isEmpty():
        last = last.join(step, ["a", "b"]).select(F.col("a2").alias("a"), F.col("b2").alias("b")).distinct().join(seen, ["a", "b"], "left_anti")
        last = kept(last)
        seen = seen.unionByName(last)
    return seen


def contained(pairs: DataFrame, alignment: DataFrame, with_relation: bool = False) -> DataFrame:
    return pairs.join(alignment, PAIR + ["relation"] * with_relation, "left_semi")


def append_missing(alignment: DataFrame, more: DataFrame) -> DataFrame:
    return alignment.unionByName(more.join(alignment, PAIR, "left_anti").dropDuplicates(PAIR))


def tf_idf_vectors(docs: DataFrame, words: str = "words") -> DataFrame:
    """(id, word, weight): counts times log of documents over documents with the word, of length 1."""
    counted = docs.select("id", F.explode(words).alias("word")).groupBy("id", "word").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    frequency = counted.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weighted = counted.join(frequency, "word").crossJoin(F.broadcast(n)).select("id", "word", (F.col("tf") * F.log(1 + F.col("n") / F.col("df"))).alias("w"))
    length = weighted.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
    return weighted.join(length, "id").select("id", "word", (F.col("w") / F.col("l")).alias("weight"))


def cosine_join(source: DataFrame, target: DataFrame) -> DataFrame:
    """Cosine of all pairs that share a word; both sides: (id, word, weight) of length 1."""
    a = source.select(F.col("id").alias("src_id"), "word", F.col("weight").alias("_x"))
    b = target.select(F.col("id").alias("tgt_id"), "word", F.col("weight").alias("_y"))
    return a.join(b, "word").groupBy(*PAIR).agg(F.sum(F.col("_x") * F.col("_y")).alias("similarity"))


def first_of(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_r = 1").drop("_r")


def restricted_classes(triples: DataFrame) -> DataFrame:
    """class, property, filler of restrictions that classes are under; triples: s, p (local names), o."""
    sub = triples.filter("p = 'subClassOf'").select(F.col("s").alias("class"), F.col("o").alias("r"))
    on = triples.filter("p = 'onProperty'").select(F.col("s").alias("r"), F.col("o").alias("property"))
    filler = triples.filter("p IN ('someValuesFrom', 'allValuesFrom', 'hasValue')").select(F.col("s").alias("r"), F.col("o").alias("filler"))
    return sub.join(on, "r").join(filler, "r").select("class", "property", "filler").distinct()


def inferred_by_third(equal: DataFrame, third_edges: DataFrame, third: DataFrame, target: DataFrame) -> DataFrame:
    """Sources that equal a class of a third ontology are above the targets that its subclasses' names equal.

    equal: src_id, tgt_id (the third's id); third_edges: child, parent; third, target: id, label.
    """
    below = equal.join(third_edges.filter("parent IS NOT NULL"), equal.tgt_id == F.col("parent")).select("src_id", F.col("child").alias("id"))
    named = below.join(third, "id").select("src_id", F.lower("label").alias("_l"))
    return named.join(target.select(F.col("id").alias("tgt_id"), F.lower("label").alias("_l")), "_l").select(*PAIR, F.lit(">").alias("relation")).distinct()


def expanded_keywords(source: DataFrame, abbreviations: DataFrame, words: str = "words") -> DataFrame:
    """id, words: the words and the words that their abbreviations stand for; abbreviations: short, long."""
    own = source.select("id", F.explode(words).alias("w"))
    more = own.join(abbreviations, F.lower("w") == F.lower("short")).select("id", F.explode(F.split(F.lower("long"), " ")).alias("w"))
    return own.unionByName(more).groupBy("id").agg(F.array_sort(F.collect_set("w")).alias("words"))


def keyword_index(records: DataFrame, text: str) -> DataFrame:
    """word, id, n: a posting for each word of a record's text."""
    words = records.select("id", F.explode(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " +")).alias("word"))
    return words.filter("word <> ''").groupBy("word", "id").agg(F.count(F.lit(1)).alias("n"))


def search(index: DataFrame, words: list[str]) -> DataFrame:
    """id, hits: the records that hold any of a few words, with how many of them."""
    return index.filter(F.col("word").isin([w.lower() for w in words])).groupBy("id").agg(F.count_distinct("word").alias("hits"))
