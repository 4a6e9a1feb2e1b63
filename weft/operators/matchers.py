"""Matchers that compare node with node: two concept relations in, sim out.

Concepts: id, kind, uri, local_name, label, comment, see_also, is_defined_by; what a
matcher doesn't read may be missing.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weft.functions import normalise as N
from weft.functions import strings as S
from weft.operators import candidates as C
from weft.operators.cut import kept

PAIR = ["src_id", "tgt_id"]
FIELDS = {"local_name": 0.0, "label": 0.7, "comment": 0.2, "see_also": 0.05, "is_defined_by": 0.05}
Measure = Callable[[Column, Column], Column]


def base_similarity(source: DataFrame, target: DataFrame) -> DataFrame:
    """Equal names 1; equal normalised names or labels 0.95, 0.9, 0.9 or 0.95, 0.9, 0.8 as normalising goes on.

    Keys are made once for each concept and joined: no pair is compared that
    doesn't share one.
    """

    def keyed(c: DataFrame) -> DataFrame:
        wider = (N.Options(), N.Options(stem=True), N.Options(digits=True, stem=True))
        keys = [N.normalise(F.col(field), o).alias(f"{field}_{i}") for field in ("local_name", "label") for i, o in enumerate(wider)]
        return c.select("id", F.col("local_name").alias("name"), *keys)

    steps = [("name", 1.0), *((f"local_name_{i}", s) for i, s in enumerate((0.95, 0.9, 0.9))), *((f"label_{i}", s) for i, s in enumerate((0.95, 0.9, 0.8)))]
    return C.ladder(keyed(source), keyed(target), steps)


def available_weights(weights: dict[str, float], pairs_name: tuple[Column, Column], pairs_label: tuple[Column, Column]) -> dict[str, Column]:
    """Weights by field: where a name (or label) says nothing on a side, the other takes its weight."""
    no_name = N.is_irrelevant(pairs_name[0]) | N.is_irrelevant(pairs_name[1])
    no_label = N.is_irrelevant(pairs_label[0]) | N.is_irrelevant(pairs_label[1])
    both = weights["local_name"] + weights["label"]
    out = {f: F.lit(w) for f, w in weights.items()}
    out["local_name"] = F.when(no_label, both).when(no_name, 0.0).otherwise(weights["local_name"])
    out["label"] = F.when(no_label, 0.0).when(no_name, both).otherwise(weights["label"])
    return out


def parametric(source: DataFrame, target: DataFrame, measure: Measure = S.levenshtein_similarity, weights: dict[str, float] | None = None, options: N.Options = N.Options(), pairs: DataFrame | None = None) -> DataFrame:
    """Weighted mean of field similarities: both empty 1, one empty 0.

    All pairs, or only the candidate pairs that are given.
    """
    weights = FIELDS if weights is None else weights

    def clean(c: DataFrame, side: str) -> DataFrame:
        fields = [N.normalise(F.coalesce(F.col(f), F.lit("")), options).alias(f"{side}_{f}") for f in weights]
        return c.select(F.col("id").alias(f"{side}_id"), *fields)

    a, b = clean(source, "src"), clean(target, "tgt")
    both = a.crossJoin(b) if pairs is None else pairs.select(*PAIR).join(a, "src_id").join(b, "tgt_id")
    used = available_weights(weights, (F.col("src_local_name"), F.col("tgt_local_name")), (F.col("src_label"), F.col("tgt_label")))

    def field(f: str) -> Column:
        x, y = F.col(f"src_{f}"), F.col(f"tgt_{f}")
        return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(measure(x, y))

    parts = [used[f] * field(f) for f, w in weights.items() if w or f in ("local_name", "label")]
    total = sum(parts[1:], parts[0]) / float(sum(weights.values()))
    return both.select(*PAIR, total.alias("similarity"))


def virtual_documents(concepts: DataFrame, edges: DataFrame, text: str = "label") -> DataFrame:
    """id, words: the words of a node and of its parents, children and siblings."""
    own = concepts.select("id", N.normalise(F.col(text)).alias("t"))
    near = edges.filter("parent IS NOT NULL").select(F.col("child").alias("a"), F.col("parent").alias("b"))
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(C.siblings(edges).select(F.col("node").alias("a"), F.col("sibling").alias("b")))
    around = near.distinct().join(own.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "t")
    all_ = own.unionByName(around).select("id", F.explode(S.tokens(F.col("t"))).alias("w"))
    return all_.groupBy("id").agg(F.sort_array(F.collect_list("w")).alias("words"))


def vector_words(source: DataFrame, target: DataFrame) -> DataFrame:
    """TF-IDF cosine of two lists of documents (id, words), the corpus being both together."""
    corpus = source.select(F.concat(F.lit("s"), "id").alias("id"), "words").unionByName(target.select(F.concat(F.lit("t"), "id").alias("id"), "words"))
    vectors = C.tf_idf_vectors(corpus)
    side = lambda x: vectors.filter(F.col("id").startswith(x)).select(F.expr("cast(substring(id, 2) as bigint)").alias("id"), "word", "weight")
    return C.cosine_join(side("s"), side("t"))


def soft_vector_words(source: DataFrame, target: DataFrame, least: float = 0.8) -> DataFrame:
    """As vector_words(), but a word also goes with the likest word of the other side, from `least` up.

    A word's part is both weights times the words' similarity; of equally like words that with the
    greater weight counts, then the first. Words are compared once, not once for each pair.
    """
    corpus = source.select(F.concat(F.lit("s"), "id").alias("id"), "words").unionByName(target.select(F.concat(F.lit("t"), "id").alias("id"), "words"))
    vectors = C.tf_idf_vectors(corpus)
    side = lambda x, name: vectors.filter(F.col("id").startswith(x)).select(F.expr("cast(substring(id, 2) as bigint)").alias(f"{name}_id"), F.col("word").alias(f"{name}_word"), F.col("weight").alias(f"{name}_weight"))
    a, b = side("s", "src"), side("t", "tgt")
    words = lambda v, name: kept(v.select(F.col(f"{name}_word").alias("label")).distinct()).withColumn("id", F.col("label"))
    alike = C.similar_pairs(words(a, "src"), words(b, "tgt"), least).select(F.col("src_id").alias("src_word"), F.col("tgt_id").alias("tgt_word"), "similarity")
    met = a.join(alike, "src_word").join(b, "tgt_word")
    best = met.groupBy(*PAIR, "src_word", "src_weight").agg(F.max(F.struct("similarity", "tgt_weight")).alias("b"))
    return best.groupBy(*PAIR).agg(F.sum(F.col("src_weight") * F.col("b.tgt_weight") * F.col("b.similarity")).alias("similarity"))


def token_similarity(source: DataFrame, target: DataFrame, words: str = "words", kind: str = "cosine") -> DataFrame:
    """A token measure for the pairs that share a word; both sides: id and an array of words."""
    shared = C.token_blocks(source, target, words).select(*PAIR)
    a = source.select(F.col("id").alias("src_id"), F.col(words).alias("_a"))
    b = target.select(F.col("id").alias("tgt_id"), F.col(words).alias("_b"))
    return shared.join(a, "src_id").join(b, "tgt_id").select(*PAIR, S.token_measure(F.col("_a"), F.col("_b"), kind).alias("similarity"))


def advanced_kernel(a: str, b: str) -> float:
    """Mean similarity of words assigned one to one, best first, over the greater number of content words.

    Function words on one side alone refute; shared ones add 0.05; at most 1.
    """
    words = [[w for w in s.split(" ") if w] for s in (a, b)]
    grammar = [{w for w in ws if w in N.PREPOSITIONS} for ws in words]
    content = [[w for w in ws if w not in N.PREPOSITIONS] for ws in words]
    if not content[0] or not content[1] or (grammar[0] and grammar[1] and not grammar[0] & grammar[1]):
        return 0.0
    scored = sorted(((-S.substring_kernel(x, y), i, j) for i, x in enumerate(content[0]) for j, y in enumerate(content[1])))
    left, right, total = set(), set(), 0.0
    for s, i, j in scored:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
            total -= s
    bonus = 0.05 * len(grammar[0] & grammar[1])
    return min(1.0, total / max(map(len, content)) + bonus)


@F.pandas_udf(T.DoubleType())
def advanced(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([advanced_kernel(x, y) for x, y in zip(a.fillna(""), b.fillna(""))], dtype="float64")


def advanced_similarity(source: DataFrame, target: DataFrame, field: str = "label") -> DataFrame:
    a = source.select(F.col("id").alias("src_id"), N.normalise(F.col(field)).alias("_a"))
    b = target.select(F.col("id").alias("tgt_id"), N.normalise(F.col(field)).alias("_b"))
    return a.crossJoin(b).select(*PAIR, advanced(F.col("_a"), F.col("_b")).alias("similarity"))


def lexical_synonyms(source: DataFrame, target: DataFrame, dictionary: DataFrame, score: float = 0.95) -> DataFrame:
    """Pairs whose labels are equal or have a synset in common; dictionary: synset, form."""

    def synsets(c: DataFrame) -> DataFrame:
        return c.select("id", F.lower("label").alias("form")).join(dictionary.select("synset", F.lower("form").alias("form")), "form").select("id", "synset")

    a = synsets(source).select(F.col("id").alias("src_id"), "synset")
    hit = a.join(synsets(target).select(F.col("id").alias("tgt_id"), "synset"), "synset").select(*PAIR).distinct()
    return hit.withColumn("similarity", F.lit(score))


def shared_forms(source: DataFrame, target: DataFrame, score: float = 0.95) -> DataFrame:
    """Pairs whose labels or local names are one form, whatever their case and separators."""
    forms = lambda c: c.select("id", F.array(N.normalise(F.col("label")), N.normalise(F.col("local_name"))).alias("forms"))
    return C.synonym_join(forms(source), forms(target)).withColumn("similarity", F.lit(score))


def hypernym_similarity(source: DataFrame, target: DataFrame, dictionary: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """Best of synonymy (1) and 1 / (1 + steps) to a common hypernym; hypernyms: (low, high, distance) closure."""
    mine = lambda c: c.select("id", F.lower("label").alias("form")).join(dictionary.select("synset", F.lower("form").alias("form")), "form").select("id", "synset")

    def ways(c: DataFrame, side: str) -> DataFrame:
        own = mine(c)
        up = own.join(hypernyms, own.synset == hypernyms.low).select("id", F.col("high").alias("synset"), "distance")
        return own.withColumn("distance", F.lit(0)).unionByName(up).select(F.col("id").alias(f"{side}_id"), "synset", F.col("distance").alias(f"_{side}"))

    return ways(source, "src").join(ways(target, "tgt"), "synset").groupBy(*PAIR).agg(F.max(1 / (1 + F.col("_src") + F.col("_tgt"))).alias("similarity"))


def concept_similarity(source: DataFrame, target: DataFrame, weights: tuple[float, float, float] = (0.75, 0.75, 0.75)) -> DataFrame:
    """Multiset Jaccard of descendants' and ancestors' labels and the common subsequence of labels, weighted.

    Both sides: id, label, above (labels of ancestors) and below (of descendants).
    """
    pairs = C.all_pairs(source, target)
    parts = [
        weights[0] * S.multiset_jaccard(F.col("src_below"), F.col("tgt_below")),
        weights[1] * S.multiset_jaccard(F.col("src_above"), F.col("tgt_above")),
        weights[2] * S.subsequence(F.col("src_label"), F.col("tgt_label")),
    ]
    return pairs.select(*PAIR, ((parts[0] + parts[1] + parts[2]) / sum(weights)).alias("similarity"))


def hierarchy_relations(seeds: DataFrame, up_src: DataFrame, up_tgt: DataFrame) -> DataFrame:
    """Relations that equal pairs (similarity 1) imply: a source's ancestors' and descendants' place over the target.

    up_*: (low, high). A descendant of the source is under the target (<), an ancestor
    of the source is above it (>). Seeds themselves are =.
    """
    equal = seeds.filter("similarity = 1.0").select(*PAIR)
    sub = equal.join(up_src, equal.src_id == up_src.high).select(F.col("low").alias("src_id"), "tgt_id", F.lit("<").alias("relation"))
    sup = equal.join(up_src, equal.src_id == up_src.low).select(F.col("high").alias("src_id"), "tgt_id", F.lit(">").alias("relation"))
    sub_t = equal.join(up_tgt, equal.tgt_id == up_tgt.low).select("src_id", F.col("high").alias("tgt_id"), F.lit("<").alias("relation"))
    sup_t = equal.join(up_tgt, equal.tgt_id == up_tgt.high).select("src_id", F.col("low").alias("tgt_id"), F.lit(">").alias("relation"))
    return equal.withColumn("relation", F.lit("=")).unionByName(sub).unionByName(sup).unionByName(sub_t).unionByName(sup_t).distinct()


def namespace_filter(sim: DataFrame, source: DataFrame, target: DataFrame, src_ns: str, tgt_ns: str) -> DataFrame:
    a = source.filter(F.col("uri").startswith(src_ns)).select(F.col("id").alias("src_id"))
    b = target.filter(F.col("uri").startswith(tgt_ns)).select(F.col("id").alias("tgt_id"))
    return sim.join(a, "src_id", "left_semi").join(b, "tgt_id", "left_semi")


def constant(source: DataFrame, target: DataFrame, value: float) -> DataFrame:
    return C.all_pairs(source.select("id"), target.select("id")).withColumn("similarity", F.lit(value))


def random_scores(source: DataFrame, target: DataFrame, seed: int = 0) -> DataFrame:
    """Scores between 0 and 1 that depend on the pair and the seed alone."""
    pairs = C.all_pairs(source.select("id"), target.select("id"))
    return pairs.withColumn("similarity", F.pmod(F.xxhash64("src_id", "tgt_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000)


def weighted_synonyms(lexicons: list[tuple[DataFrame, DataFrame, float]]) -> DataFrame:
    """Pairs that share a form of a lexicon, by the best weight of the lexicons where they do.

    Each lexicon comes as its source side and its target side (id, form).
    """
    out = None
    for source, target, weight in lexicons:
        a = source.select(F.col("id").alias("src_id"), F.lower("form").alias("form")).distinct()
        b = target.select(F.col("id").alias("tgt_id"), F.lower("form").alias("form")).distinct()
        one = a.join(b, "form").select(*PAIR).distinct().withColumn("similarity", F.lit(weight))
        out = one if out is None else out.unionByName(one)
    return out.groupBy(*PAIR).agg(F.max("similarity").alias("similarity"))


def hypernyms_meet(source: DataFrame, target: DataFrame, dictionary: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """1 for pairs whose synsets are disjoint but have a hypernym in common; hypernyms: (low, high)."""

    def synsets(c: DataFrame, side: str) -> DataFrame:
        words = dictionary.select("synset", F.lower("form").alias("form"))
        return c.select(F.col("id").alias(f"{side}_id"), F.lower("label").alias("form")).join(words, "form").select(f"{side}_id", "synset").distinct()

    a, b = synsets(source, "src"), synsets(target, "tgt")
    up = lambda s, side: s.join(hypernyms, F.col("synset") == F.col("low")).select(f"{side}_id", "high").distinct()
    meet = up(a, "src").join(up(b, "tgt"), "high").select(*PAIR).distinct()
    same = a.join(b, "synset").select(*PAIR).distinct()
    return meet.join(same, PAIR, "left_anti").withColumn("similarity", F.lit(1.0))


def subclass_scores(source: DataFrame, target: DataFrame, dictionary: DataFrame, hypernyms: DataFrame) -> DataFrame:
    """Sources whose synset is among a target's hypernyms (or the other way round), 1 / (1 + log2(1 + steps))."""
    words = dictionary.select("synset", F.lower("form").alias("form"))
    a = source.select(F.col("id").alias("src_id"), F.lower("label").alias("form")).join(words, "form").select("src_id", F.col("synset").alias("s")).distinct()
    b = target.select(F.col("id").alias("tgt_id"), F.lower("label").alias("form")).join(words, "form").select("tgt_id", F.col("synset").alias("t")).distinct()
    above = b.join(hypernyms, F.col("t") == F.col("low")).join(a, F.col("high") == F.col("s")).select(*PAIR, F.lit(">").alias("relation"), "distance")
    below = a.join(hypernyms, F.col("s") == F.col("low")).join(b, F.col("high") == F.col("t")).select(*PAIR, F.lit("<").alias("relation"), "distance")
    score = 1 / (1 + F.log2(1 + F.col("distance")))
    return above.unionByName(below).groupBy(*PAIR, "relation").agg(F.max(score).alias("similarity"))


def by_relation(own: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Two relation-valued matrices in one: equal relations take the greater score, others the surer one's."""
    a = own.select(*PAIR, F.col("relation").alias("_ra"), F.col("similarity").alias("_a"))
    b = dictionary.select(*PAIR, F.col("relation").alias("_rb"), F.col("similarity").alias("_b"))
    both = a.join(b, PAIR, "full")
    first = F.col("_rb").isNull() | (F.coalesce("_a", F.lit(-1.0)) >= F.coalesce("_b", F.lit(-1.0)))
    return both.select(*PAIR, F.when(first, F.col("_ra")).otherwise(F.col("_rb")).alias("relation"), F.greatest("_a", "_b").alias("similarity"))


def greedy_mean_kernel(scores: dict[tuple[int, int], float], most: int) -> float:
    """Best cells one after another, each row and column once; their sum over the greater side."""
    rows, columns, total = set(), set(), 0.0
    for (i, j), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if i not in rows and j not in columns:
            rows.add(i)
            columns.add(j)
            total += s
    return total / most if most else 0.0


def compound_heads(concepts: DataFrame, field: str = "label") -> DataFrame:
    """id, head: the last word of a label of several words, which names what it is a kind of."""
    words = S.tokens(N.normalise(F.col(field)))
    return concepts.select("id", words.alias("_w")).filter(F.size("_w") > 1).select("id", F.element_at("_w", -1).alias("head"))
