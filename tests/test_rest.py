"""Coherent mappings, sparse scoring, the triple store, escapes and initial matcher sets, against plain versions."""

from __future__ import annotations

import random

import pytest

from weft.operators import candidates, conflicts, feedback, selection
from weft.plans import pipelines
from weft.sources import ontologies


def random_mappings(seed: int) -> list[tuple[int, int, int, int, float]]:
    own, rows = random.Random(seed), []
    for i in range(4):
        for j in range(i + 1, 4):
            right = list(range(12))
            for k in range(3):  # a few wrong ones
                a, b = own.sample(range(12), 2)
                right[a], right[b] = right[b], right[a]
            rows += [(i, a, j, right[a], round(own.random(), 3)) for a in range(12) if own.random() < 0.8]
    return rows


def coherent(rows) -> bool:
    """Whether each node has one partner in each other ontology, and partners of partners agree."""
    at = {}
    for i, a, j, b, _ in rows:
        if (i, a, j) in at or (j, b, i) in at:
            return False
        at[i, a, j], at[j, b, i] = b, a
    return all(at.get((i, a, k)) == c for (i, a, j), b in at.items() for k in range(4) if k not in (i, j) for c in [at.get((j, b, k))])


@pytest.mark.parametrize("seed", range(6))
def test_conflicts_end_in_coherent_mappings(seed):
    rows = random_mappings(seed)
    net = conflicts.Net(rows)
    best = max(net.vote, key=lambda m: (net.vote[m], net.similarity[m], tuple(-x for x in m)))
    found = net.resolve()
    assert coherent(found) and best in {r[:4] for r in found}


def test_votes_count_triples():
    agree = [(0, 1, 1, 1, 0.5), (0, 1, 2, 1, 0.5), (1, 1, 2, 1, 0.5)]
    assert set(conflicts.Net(agree).vote.values()) == {1}
    net = conflicts.Net([(0, 1, 1, 1, 0.9), (0, 1, 2, 1, 0.5), (1, 1, 2, 2, 0.4)])
    assert set(net.vote.values()) == {-1}
    assert net.resolve() == [(0, 1, 1, 1, 0.9), (0, 1, 2, 1, 0.5), (1, 1, 2, 1, 0.9)]  # what follows has the strength of its reason


def test_blocks_are_resolved_as_the_whole(spark):
    rows = []
    for seed in range(3):
        rows += [(i, a + 100 * seed, j, b + 100 * seed, s) for i, a, j, b, s in random_mappings(seed)]
    df = spark.createDataFrame(rows, "src_onto long, src_id long, tgt_onto long, tgt_id long, similarity double")
    got = sorted(map(tuple, conflicts.resolved(df).collect()))
    assert got == sorted(conflicts.Net(rows).resolve()) and coherent(got)
    assert conflicts.resolved(df.limit(0)).collect() == []


def test_similar_pairs_lose_none(spark):
    own = random.Random(5)
    words = ["".join(own.choices("ab c", k=own.randrange(0, 9))) for _ in range(70)]
    sides = [spark.createDataFrame(list(enumerate(words[:35])), "id long, label string"), spark.createDataFrame(list(enumerate(words[35:])), "id long, label string")]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            old, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    for threshold in (0.51, 0.6, 0.9):
        got = {(r.src_id, r.tgt_id) for r in candidates.similar_pairs(*sides, threshold).collect()}
        want = {(i, j) for i, a in enumerate(words[:35]) for j, b in enumerate(words[35:]) if a and b and 1 - distance(a, b) / max(len(a), len(b)) >= threshold}
        assert got == want
    with pytest.raises(ValueError):
        candidates.similar_pairs(*sides, 0.5)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_similar_pairs_of_all_lengths(spark):
    """Lengths with few forms, lengths with many, and pairs across; copies and missing texts."""
    own = random.Random(6)

    def edited(word):
        for _ in range(own.randrange(5)):
            i = own.randrange(len(word) + 1)
            word = word[:i] + own.choice(["", "a", "é", "🙂"]) + word[i + own.randrange(2) :]
        return word

    words = ["".join(own.choices("abé🙂", k=own.randrange(1, 34))) for _ in range(60)]
    left, right = [*words, *words[:5], None, "#"], [*map(edited, words), *map(edited, words), *words[:5], None, "##"]
    sides = [spark.createDataFrame(list(enumerate(s)), "id long, label string") for s in (left, right)]
    for threshold in (0.51, 0.7, 0.8, 0.9, 1.0):
        got = [(r.src_id, r.tgt_id) for r in candidates.similar_pairs(*sides, threshold).collect()]
        want = [(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and 1 - edit_distance(a, b) / max(len(a), len(b)) >= threshold]
        assert sorted(got) == want


def joined_rows(df) -> int:
    """The rows that come out of all joins of a query while it is collected."""
    df.collect()

    def rows(node):
        below = [node.children().apply(i) for i in range(node.children().size())]
        return (node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0) + sum(map(rows, below))

    return rows(df._jdf.queryExecution().executedPlan())


@pytest.mark.parametrize("copies", [1, 3])
def test_names_with_a_common_beginning_make_few_pairs(spark, copies):
    names = [(i + 400 * k, f"Supplier#{i:09d}") for i in range(400) for k in range(copies)]
    sides = [spark.createDataFrame([r for r in names if r[0] % 2 == k], "id long, label string") for k in (0, 1)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = candidates.similar_pairs(*sides, 0.9)
        assert joined_rows(found) < 20_000 and found.count() == 1000 * copies**2
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_triple_store_keeps_the_last_word(spark, tmp_path):
    rows = lambda *s: spark.createDataFrame([(x, "p", "o", False) for x in s], "s string, p string, o string, is_literal boolean")
    path = f"file://{tmp_path}/store"
    store = ontologies.TripleStore(spark, path)
    assert store.read().collect() == []
    store.add(rows("a", "b", "b"))
    store.remove(rows("b", "x"))
    store = ontologies.TripleStore(spark, path)  # opened again
    store.add(rows("c"))
    assert sorted(r.s for r in store.read().collect()) == ["a", "c"]
    store.add(rows("b"))
    assert sorted(r.s for r in store.read().collect()) == ["a", "b", "c"]


def test_escapes_of_literals(spark):
    bodies = [r"A \"b\"", r"tab\there", r"new\nline", r"été \U0001F642", r"back\\slash\\n", "plain é", ""]
    want = ['A "b"', "tab\there", "new\nline", "été 🙂", "back\\slash\\n", "plain é", ""]
    df = spark.createDataFrame(list(enumerate(bodies)), "i int, t string")
    assert [r.u for r in df.select("i", ontologies.unescaped(df.t).alias("u")).orderBy("i").collect()] == want


def test_rejected_lines_are_told(spark, tmp_path):
    (tmp_path / "a.nt").write_text('<http://x#a> <http://x#p> "v" .\n# a comment\n\nno statement\n')
    assert [r.value for r in ontologies.rejected_lines(spark, str(tmp_path / "a.nt")).collect()] == ["no statement"]
    assert ontologies.read_triples(spark, str(tmp_path / "a.nt")).count() == 1


def test_initial_sets_are_their_matchers(spark):
    schema = "id long, label string, local_name string, comment string, see_also string, is_defined_by string"
    concepts = spark.createDataFrame([(0, "thing", "thing", "", "", ""), (1, "small ring", "smallRing", "x", "", ""), (2, "big ring", "bigRing", "", "", "")], schema)
    side = pipelines.Side(concepts, spark.createDataFrame([(0, None), (1, 0), (2, 0)], "child long, parent long"))
    found = pipelines.initial(side, side, "best")
    assert {r.matcher for r in found.select("matcher").distinct().collect()} == set(pipelines.INITIAL["best"])
    for name in pipelines.INITIAL["orthogonal"]:
        own = pipelines.MATCHERS[name](concepts, concepts).select("src_id", "tgt_id", "similarity")
        assert sorted(map(tuple, found.filter(f"matcher = '{name}'").select("src_id", "tgt_id", "similarity").collect())) == sorted(map(tuple, own.collect()))


def test_stages_can_be_replaced(spark):
    sim = spark.createDataFrame([(1, 1, 0.4), (2, 2, 0.5)], "src_id long, tgt_id long, similarity double")
    counts = spark.createDataFrame([(1, 1, 2, 0), (2, 2, 1, 1)], "src_id long, tgt_id long, pos long, neg long")
    assert {r.src_id: r.similarity for r in feedback.run_stages(sim, counts, sim).collect()} == {1: 1.0, 2: 0.5}
    halved = {"control": lambda state: state | {"sim": state["sim"].selectExpr("src_id", "tgt_id", "similarity / 2 AS similarity")}}
    assert {r.src_id: r.similarity for r in feedback.run_stages(sim, counts, sim, halved).collect()} == {1: 0.5, 2: 0.25}


def tree(own: random.Random, n: int) -> dict[int, int | None]:
    return {0: None, **{c: own.randrange(c) for c in range(1, n)}}


def frames(spark, own, a=9, b=10, share=0.8):
    """Two trees and the similarities of some of their pairs, plain and as tables."""
    up, low = tree(own, a), tree(own, b)
    cells = {(s, t): round(own.random(), 2) for s in up for t in low if own.random() < share}
    edges = [spark.createDataFrame(sorted(x.items()), "child long, parent long") for x in (up, low)]
    return up, low, cells, edges, spark.createDataFrame([(*k, v) for k, v in cells.items()], "src_id long, tgt_id long, similarity double")


def as_dict(df):
    return {(r.src_id, r.tgt_id): round(r.similarity, 9) for r in df.collect()}


def test_level_bonus_against_a_plain_version(spark):
    from weft.operators import structure

    own = random.Random(8)
    for _ in range(3):
        up, low, cells, edges, sim = frames(spark, own)
        factor, level = {}, 0
        left = {k for k in cells if up[k[0]] is None and low[k[1]] is None}
        while left:
            best, used_s, used_t = [], set(), set()
            for s, t in sorted((k for k in left if cells[k] >= 0.3), key=lambda k: (-cells[k], -k[0], -k[1])):
                if s not in used_s and t not in used_t:
                    best.append((s, t))
                    used_s.add(s)
                    used_t.add(t)
            factor |= {k: (1.15, 1.25, 1.4)[min(level, 2)] for k in best}
            left = {(s, t) for s, t in cells if (up[s], low[t]) in best and (s, t) not in factor}
            level += 1
        want = {k: round(min(1.0, v * factor[k]) if k in factor else v, 9) for k, v in cells.items()}
        assert as_dict(structure.level_bonus(sim, *edges, 0.3)) == want


def test_structural_evidence_against_a_plain_version(spark):
    from weft.operators import structure

    own = random.Random(9)
    for _ in range(2):
        up, low, cells, edges, sim = frames(spark, own)
        now, kids = dict(cells), {p: [c for c in up if up[c] == p] for p in up}
        matched = sum(v >= 0.7 for v in now.values())
        for _ in range(4):
            good = [k for k, v in now.items() if v >= 0.7]
            evidence = {k: [v] for k, v in now.items()}
            below, above = {}, {}
            for s, t in good:
                if up[s] is not None and low[t] is not None:
                    below.setdefault((up[s], low[t]), set()).add(s)
                for c in kids[s]:
                    for d in (d for d in low if low[d] == t):
                        above.setdefault((c, d), set()).add(s)
            for k, found in below.items():
                evidence.setdefault(k, []).append(len(found) / len(kids[k[0]]))
            for k, found in above.items():
                evidence.setdefault(k, []).append(len(found) / 1)
            new = {k: max(sum(sorted(v)[-2:]) / len(v[-2:] if len(v) < 2 else sorted(v)[-2:]), now.get(k, 0.0)) for k, v in evidence.items()}
            before, now = matched, new
            matched = sum(v >= 0.7 for v in now.values())
            if matched == before:
                break
        got = as_dict(structure.structural_evidence(sim, *edges, 0.7))
        assert got.keys() == now.keys() and all(abs(got[k] - now[k]) < 1e-8 for k in now)


def test_repair_against_a_plain_version(spark):
    own = random.Random(10)
    for _ in range(2):
        up, low, cells, edges, _ = frames(spark, own, 8, 9, 0.35)
        above = lambda parents, x: set() if parents[x] is None else {parents[x]} | above(parents, parents[x])
        apart = {(a, b) for a in low for b in low if a < b and low[a] == low[b]}
        kept = []
        for s, t in sorted(cells, key=lambda k: (-cells[k], k[0], k[1])):
            lines = lambda x: {x} | above(low, x)
            clash = any((s in above(up, x) or x in above(up, s)) and any((min(a, b), max(a, b)) in apart for a in lines(t) for b in lines(y)) for x, y in kept)
            if not clash:
                kept.append((s, t))
        sim = spark.createDataFrame([(*k, v) for k, v in cells.items()], "src_id long, tgt_id long, similarity double")
        closed = [candidates.closure(e) for e in edges]
        got = selection.repaired(sim, *closed, spark.createDataFrame(sorted(apart), "a long, b long"))
        assert {(r.src_id, r.tgt_id) for r in got.collect()} == set(kept)
