"""Whole matching runs: named matchers, selectors and the pipelines that put them together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weft.functions import strings as S
from weft.functions.normalise import normalise
from weft.operators import combination, evaluation, matchers, selection, structure
from weft.operators.cut import kept

PAIR = ["src_id", "tgt_id"]
#: (source concepts, target concepts) -> sim
Matcher = Callable[[DataFrame, DataFrame], DataFrame]
MATCHERS: dict[str, Matcher] = {
    "base": matchers.base_similarity,
    "parametric": matchers.parametric,
    "advanced": matchers.advanced_similarity,
    "synonyms": matchers.shared_forms,
    "words": lambda s, t: matchers.vector_words(*(c.select("id", S.tokens(normalise(F.col("label"))).alias("words")) for c in (s, t))),
    "all-one": lambda s, t: matchers.constant(s, t, 1.0),
    "all-zero": lambda s, t: matchers.constant(s, t, 0.0),
    "random": matchers.random_scores,
}
#: sim -> alignment
SELECTORS: dict[str, Callable[..., DataFrame]] = {
    "one-to-one": selection.best_assignment,
    "greedy": selection.greedy,
    "threshold": selection.at_least,
    "mutual": lambda sim, threshold: selection.mutual_best(selection.at_least(sim, threshold)),
}


@dataclass
class Side:
    concepts: DataFrame
    edges: DataFrame


def register(name: str, matcher: Matcher) -> None:
    MATCHERS[name] = matcher


def scores(source: Side, target: Side, names: list[str]) -> DataFrame:
    """All matchers' similarities in one relation with a matcher column."""
    out = None
    for name in names:
        one = MATCHERS[name](source.concepts, target.concepts).select("src_id", "tgt_id", "similarity").withColumn("matcher", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def refined(sim: DataFrame, source: Side, target: Side, how: str) -> DataFrame:
    steps = {
        "inherit": lambda s: structure.descendant_inheritance(s, source.edges, target.edges),
        "siblings": lambda s: structure.sibling_contribution(s, source.edges, target.edges),
        "groups": lambda s: structure.group_finder(s, structure.roots(source.edges), structure.roots(target.edges)),
        "evidence": lambda s: structure.structural_evidence(s, source.edges, target.edges),
        "none": lambda s: s,
    }
    return steps[how](sim)


@dataclass
class Plan:
    """Matchers, how they are weighted, what refines them and how correspondences are chosen."""

    names: list[str]
    refine: str = "none"
    weights: dict[str, float] | None = None
    selector: str = "one-to-one"
    threshold: float = 0.6


#: The pipelines by year of design, and one for ontologies that look little alike.
PLANS = {
    "first": Plan(["base", "parametric", "words"], "inherit"),
    "second": Plan(["advanced", "parametric", "words"], "groups"),
    "third": Plan(["base", "parametric", "words"], "evidence"),
    "dissimilar": Plan(["base", "advanced", "parametric", "words"], "siblings", threshold=0.5),
}


#: Sets of matchers that a feedback loop begins with: ones that look at different things, those of them that
#: need no product of both sides, and the first with what refines them.
INITIAL = {
    "orthogonal": ["base", "advanced", "parametric", "words", "synonyms"],
    "large": ["base", "words", "synonyms"],
    "best": ["base", "advanced", "parametric", "words", "synonyms", "siblings", "inherit"],
}


def initial(source: Side, target: Side, which: str) -> DataFrame:
    """All similarities of an initial set in one relation; refinements work on the mean of the matchers."""
    names = INITIAL[which]
    scored = scores(source, target, [n for n in names if n in MATCHERS])
    out = scored
    for how in (n for n in names if n not in MATCHERS):
        sim = combination.linear(scored, {n: 1.0 for n in names if n in MATCHERS})
        out = out.unionByName(refined(sim, source, target, how).select(*PAIR, "similarity").withColumn("matcher", F.lit(how)))
    return out


def quality_weights(scored: DataFrame, n_targets: int) -> DataFrame:
    """matcher, src_id, weight: each matcher's local confidence."""
    names = [r.matcher for r in scored.select("matcher").distinct().collect()]  # the matchers' names
    out = None
    for name in sorted(names):
        one = evaluation.local_confidence(scored.filter(F.col("matcher") == name), n_targets).select(F.lit(name).alias("matcher"), "src_id", F.col("confidence").alias("weight"))
        out = one if out is None else out.unionByName(one)
    return out


def run(source: Side, target: Side, plan: Plan) -> DataFrame:
    """An alignment: src_id, tgt_id, similarity."""
    scored = scores(source, target, plan.names)
    if plan.weights is None:
        scored = kept(scored)
        sim = combination.node_weighted(scored, quality_weights(scored, target.concepts.count()))
    else:
        sim = combination.linear(scored, plan.weights)
    return SELECTORS[plan.selector](refined(sim, source, target, plan.refine), plan.threshold)


def run_tasks(tasks: list[dict], load: Callable[[str], Side], save: Callable[[DataFrame, str], None]) -> None:
    """Each task's matcher and selector over its two ontologies; task: source, target, matcher, selector, output."""
    for task in tasks:
        source, target = load(task["source"]), load(task["target"])
        sim = MATCHERS[task["matcher"]](source.concepts, target.concepts)
        save(SELECTORS[task["selector"]](sim, task.get("threshold", 0.6)), task["output"])
