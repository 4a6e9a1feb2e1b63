"""Operators on small relations, with ties, against brute force where it is short."""

from __future__ import annotations

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.operators import candidates, combination, embedding, evaluation, feedback, lexicon, matchers, selection, structure

SIM = "src_id long, tgt_id long, similarity double"


def sim(spark, cells):
    return spark.createDataFrame([(a, b, float(s)) for a, b, s in cells], SIM)


def cells(df):
    return {(r.src_id, r.tgt_id): r.similarity for r in df.collect()}


def test_f_measure(spark):
    f = lambda p, r: spark.range(1).select(evaluation.f_measure(F.lit(float(p)), F.lit(float(r)))).first()[0]
    for (p, r), want in {(0.6, 0.7): 0.646153846, (0, 0): 0.0, (1e-7, 0): 0.0, (1e-7, 1e-7): 1e-7, (0, 1): 0.0, (1, 1): 1.0, (1, 0.1): 0.181818182, (0.1, 1): 0.181818182}.items():
        assert f(p, r) == pytest.approx(want, abs=1e-9)


def test_population_variance(spark):
    scores = spark.createDataFrame([(m, 1, 1, s) for m, s in zip("abcd", (0.6, 0.3, 0.4, 0.88))], "matcher string, src_id long, tgt_id long, similarity double")
    assert evaluation.variance(scores, 4).first().variance == pytest.approx(0.049075, abs=1e-8)


def test_assignment_beats_greedy(spark):
    some = sim(spark, [(0, 0, 0.9), (0, 1, 0.8), (1, 0, 0.8), (1, 1, 0.1), (5, 7, 0.7)])
    assert cells(selection.best_assignment(some, 0.05)) == {(0, 1): 0.8, (1, 0): 0.8, (5, 7): 0.7}
    assert cells(selection.greedy(some)) == {(0, 0): 0.9, (1, 1): 0.1, (5, 7): 0.7}


def test_assignment_against_all_permutations():
    own = np.random.default_rng(1)
    for _ in range(200):
        n, m = own.integers(1, 6, 2)
        w = own.integers(0, 9, (n, m)) * own.integers(0, 2, (n, m))
        chosen = selection.assign(w)
        assert len({i for i, _ in chosen}) == len({j for _, j in chosen}) == len(chosen)
        long = w if n <= m else w.T
        best = max(sum(long[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(long.shape[1]), long.shape[0]))
        assert sum(w[i, j] for i, j in chosen) == best


def brute_greedy(rows, per_src=1, per_tgt=1):
    out, used_s, used_t = {}, {}, {}
    for a, b, s in sorted(rows, key=lambda r: (-r[2], -r[0], -r[1])):
        if used_s.get(a, 0) < per_src and used_t.get(b, 0) < per_tgt:
            out[a, b] = s
            used_s[a], used_t[b] = used_s.get(a, 0) + 1, used_t.get(b, 0) + 1
    return out


@pytest.mark.parametrize("limits", [(1, 1), (2, 1)])
def test_greedy_against_one_cell_at_a_time(spark, limits):
    own = random.Random(4)
    rows = [(a, b, own.randrange(1, 6) / 5) for a in range(12) for b in range(9) if own.random() < 0.6]
    assert cells(selection.greedy(sim(spark, rows), 0.0, *limits)) == brute_greedy(rows, *limits)


def test_stable_many(spark):
    own = random.Random(5)
    rows = [(a, b, own.random()) for a in range(10) for b in range(8)]
    got, weight = cells(selection.stable_many(sim(spark, rows), 2, 3)), {(a, b): s for a, b, s in rows}
    for a, b, s in rows:  # no pair would rather have each other
        mine = [weight[p] for p in got if p[0] == a]
        theirs = [weight[p] for p in got if p[1] == b]
        if (a, b) not in got:
            assert not ((len(mine) < 2 or s > min(mine)) and (len(theirs) < 3 or s > min(theirs)))


def test_tie_rules(spark):
    flat = sim(spark, [(a, b, 0.5) for a in range(2) for b in range(2)])
    assert set(cells(selection.top_per(flat, "src"))) == {(0, 1), (1, 1)}
    assert set(cells(selection.greedy(flat))) == {(1, 1), (0, 0)}
    assert set(cells(selection.global_top(flat, 1))) == {(0, 0)}
    assert set(cells(selection.best_candidate(flat, 0.1))) == {(0, 0), (1, 0)}


def test_empty_relations(spark):
    none = sim(spark, [])
    for made in (selection.greedy(none), selection.best_assignment(none, 0.5), selection.stable_many(none, 1, 1), selection.mutual_best(none), structure.boost_mutual_best(none)):
        assert made.collect() == []
    row = evaluation.accuracy(none, none).first()
    assert (row.precision, row.recall, row.f) == (0.0, 0.0, 0.0)


EDGES = "child long, parent long"


def test_inheritance_over_two_parents(spark):
    a = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (3, 2)], EDGES)
    b = spark.createDataFrame([(0, None), (1, 0), (2, 1)], EDGES)
    some = {(i, j): (i + j) / 10 for i in range(4) for j in range(3)}
    new = {}

    def value(i, j):
        up = {0: [], 1: [0], 2: [0], 3: [1, 2]}[i]
        above = {0: [], 1: [0], 2: [1]}[j]
        if not up or not above:
            return some[i, j]
        return 0.75 * some[i, j] + 0.25 * sum(max(value(p, q) for q in above) for p in up) / len(up)

    new = {k: value(*k) for k in some}
    got = cells(structure.descendant_inheritance(sim(spark, [(*k, v) for k, v in some.items()]), a, b))
    assert got.keys() == new.keys() and all(got[k] == pytest.approx(new[k]) for k in new)


def test_closure_with_a_circle(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], EDGES)
    up = {(r.low, r.high): r.distance for r in candidates.closure(edges).collect()}
    assert up[4, 3] == 3 and up[1, 1] == 3 and len(up) == 12


def test_flooding_prefers_the_consistent_pair(spark):
    one = spark.createDataFrame([("x", 0, 1), ("y", 0, 2)], "label string, from_id long, to_id long")
    start = sim(spark, [(a, b, 1.0) for a in range(3) for b in range(3)])
    got = cells(structure.flood(structure.connectivity_graph(one, one), start))
    assert got[1, 1] > got.get((1, 2), 0) and got[2, 2] > got.get((2, 1), 0) and max(got.values()) == 1.0


def test_combination(spark):
    scores = spark.createDataFrame([("a", 1, 1, 0.8), ("b", 1, 1, 0.4), ("a", 1, 2, 0.6)], "matcher string, src_id long, tgt_id long, similarity double")
    assert cells(combination.linear(scores, {"a": 1.0, "b": 3.0})) == {(1, 1): pytest.approx(0.5), (1, 2): pytest.approx(0.15)}
    assert cells(combination.extreme(scores, {"a": 1.0, "b": 3.0}))[1, 1] == 0.4  # the weighted value decides, the raw one is kept


def test_learned_combination_separates(spark):
    own, rows, labels = random.Random(2), [], []
    for i in range(200):
        good = i % 2 == 0
        rows += [("a", i, i, 0.9 if good else 0.1), ("b", i, i, own.random())]
        labels.append((i, i, good))
    scores = spark.createDataFrame(rows, "matcher string, src_id long, tgt_id long, similarity double")
    got = cells(combination.learned(scores, ["a", "b"], spark.createDataFrame(labels, "src_id long, tgt_id long, is_match boolean")))
    assert all((v > 0.5) == (k[0] % 2 == 0) for k, v in got.items())


def test_matchers(spark):
    schema = "id long, label string, local_name string, comment string, see_also string, is_defined_by string"
    a = spark.createDataFrame([(0, "Red House", "RedHouse", "", "", ""), (1, "writers", "x", "", "", "")], schema)
    b = spark.createDataFrame([(0, "red-house", "redHouse", "", "", ""), (1, "Writer", "y", "", "", "")], schema)
    base = cells(matchers.base_similarity(a, b))
    assert base == {(0, 0): 0.95, (1, 1): 0.9}
    assert matchers.advanced_kernel("house of cards", "cards house") == pytest.approx(1.0)
    assert matchers.advanced_kernel("train to rome", "train from rome") == 0.0
    assert cells(matchers.parametric(a, b))[0, 0] == pytest.approx(1.0)


def test_lexicon(spark):
    lex = spark.createDataFrame([(1, "heart attack"), (1, "heart infarction"), (2, "brain attack")], "id long, form string")
    assert [tuple(r) for r in lexicon.term_synonyms(lex).collect()] == [("attack", "infarction")]
    terms = lexicon.term_synonyms(lex)
    assert (2, "brain infarction") in {tuple(r) for r in lexicon.extended(lex, terms).collect()}


def test_votes_and_propagation(spark):
    votes = spark.createDataFrame([(1, 1, True), (1, 1, True), (1, 1, False), (2, 2, True), (2, 2, False)], "src_id long, tgt_id long, is_correct boolean")
    counts = feedback.votes(votes)
    assert cells(feedback.decided(counts)) == {(1, 1): 1.0}
    assert cells(feedback.apply_votes(sim(spark, [(1, 1, 0.2), (2, 2, 0.3)]), counts)) == {(1, 1): 1.0, (2, 2): 0.3}
    ask = lambda p, n: spark.range(1).select(evaluation.consensus(F.lit(p), F.lit(n))).first()[0]
    assert (ask(1, 1), ask(3, 1), ask(2, 1)) == (0.0, 1.0, pytest.approx(1 / 3))


def test_regression_recovers_a_line(spark):
    own = random.Random(1)
    rows = [(i, i, own.random(), own.random()) for i in range(50)]
    signatures = spark.createDataFrame(rows, "src_id long, tgt_id long, a double, b double")
    labelled = signatures.withColumn("label", 0.2 + 0.5 * F.col("a") + 0.3 * F.col("b"))
    got = cells(feedback.regression(signatures, labelled, ["a", "b"]))
    assert all(got[i, i] == pytest.approx(0.2 + 0.5 * a + 0.3 * b, abs=1e-4) for i, _, a, b in rows)


def test_training_brings_companions_together(spark):
    own, rows = random.Random(3), []
    for i in range(300):
        group = [["sun", "moon", "star"], ["fish", "crab", "whale"]][i % 2]
        rows.append((i, " ".join(own.choices(group, k=12))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(1)
    vocab = embedding.ranked(embedding.vocabulary(docs), 10)
    for cbow in (False, True):
        vec = {r.word: np.array(r.vec) for r in embedding.train(docs, vocab, dim=8, epochs=3, rate=0.1, cbow=cbow).collect()}
        near = lambda a, b: vec[a] @ vec[b] / (np.linalg.norm(vec[a]) * np.linalg.norm(vec[b]))  # noqa: B023, E731
        assert near("sun", "moon") > near("sun", "crab") and near("fish", "whale") > near("star", "whale")


@pytest.mark.parametrize("cbow", [False, True])
def test_training_pairs_words_across_steps(spark, cbow):
    docs = spark.createDataFrame([(1, " ".join(["x"] * 8192 + ["b"]))], "doc_id long, text string")
    vec = {r.word: np.array(r.vec) for r in embedding.train(docs, embedding.ranked(embedding.vocabulary(docs), 2), dim=8, cbow=cbow).collect()}
    start = np.random.default_rng(1).uniform(-0.5 / 8, 0.5 / 8, (2, 8))
    assert not np.allclose(vec["b"], start[1])


@pytest.mark.parametrize("name", ["N6_skip_gram", "N7_cbow"])
def test_every_frequent_word_has_a_vector(spark, tmp_path, name):
    from weft.plans import registry

    docs = spark.createDataFrame([(d, " ".join(f"w{i}" for i in range(d % 2, 5000, 2))) for d in range(10)], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert registry.QUERIES[name](spark, str(tmp_path)).select("word").distinct().count() == 5000


def test_senses():
    centres, counts = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([1, 1])
    chosen, _, _ = embedding.choose_senses(np.array([[2.0, 0.1], [0.0, 3.0]]), centres.copy(), counts.copy(), "dot")
    assert chosen.tolist() == [0, 1]
    chosen, grown, _ = embedding.choose_senses(np.array([[9.0, 9.0], [1.0, 0.1]]), centres.copy(), counts.copy(), "growing", 2.0)
    assert chosen.tolist() == [2, 0] and len(grown) == 3


def test_sampling_and_subsampling(spark):
    vocab = spark.createDataFrame([("a", 16), ("b", 1), ("c", 1)], "word string, cnt long")
    upper = {r.word: r.upper for r in embedding.running_share(vocab).collect()}
    assert upper == {"a": pytest.approx(0.8), "b": pytest.approx(0.9), "c": pytest.approx(1.0)}
    keep = spark.range(1).select(embedding.keep_probability(F.lit(100), F.lit(1000), 0.001)).first()[0]
    assert keep == pytest.approx((math.sqrt(100) + 1) * 0.01)


def test_sibling_contribution_over_several_parents(spark):
    """Against the definition, with nodes of several parents, none and no siblings."""
    import random

    from weft.operators import structure

    own = random.Random(4)
    for _ in range(4):
        sides = []
        for n in (7, 8):
            edges = {(c, p) for c in range(1, n) for p in own.sample(range(c), min(c, own.randrange(1, 3)))}
            sides.append(sorted(edges, key=str) + [(0, None)])
        cells = {(s, t): round(own.random(), 3) for s in range(7) for t in range(8) if own.random() < 0.8}

        def siblings(edges, x):
            parents = {p for c, p in edges if c == x and p is not None}
            return {c for c, p in edges if p in parents and c != x}

        want = {}
        for (s, t), v in cells.items():
            a, b = siblings(sides[0], s), siblings(sides[1], t)
            mean = sum(max(cells.get((x, y), 0.0) for y in b) for x in a) / len(a) if a and b else None
            want[s, t] = v if mean is None else 0.75 * v + 0.25 * mean
        frames = [spark.createDataFrame(e, "child long, parent long") for e in sides]
        sim = spark.createDataFrame([(*k, v) for k, v in cells.items()], "src_id long, tgt_id long, similarity double")
        got = {(r.src_id, r.tgt_id): r.similarity for r in structure.sibling_contribution(sim, *frames).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
