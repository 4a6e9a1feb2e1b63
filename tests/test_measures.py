"""String measures and normalising against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weft.functions import normalise as N
from weft.functions import strings as S


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(
    "measure, a, b, want",
    [
        (S.levenshtein_similarity, "kitten", "sitting", 1 - 3 / 6),
        (S.levenshtein_similarity, "", "", 1.0),
        (S.levenshtein_similarity, "", "a", 0.0),
        (S.levenshtein_similarity, "a", "xyzzy", 0.0),
        (S.equality, "a", "a", 1.0),
        (S.qgram_similarity, "ab", "ab", 1.0),
        (S.qgram_similarity, "ab", "cd", 0.0),
        (S.longest_edit_similarity, "abcd", "abcx", 0.75),
        (S.literal_similarity, "2", "2.0", 1.0),
    ],
)
def test_expressions(spark, measure, a, b, want):
    assert value(spark, measure(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_kernels():
    assert S.jaro_winkler_kernel("abc", "abc") == 1.0
    assert S.jaro_winkler_kernel("ab", "xy") == 0.0
    assert S.jaro_winkler_kernel("martha", "marhta") == pytest.approx((1 + 1 + 5 / 6) / 3 + 0.3 * (1 - (1 + 1 + 5 / 6) / 3))
    assert S.substring_kernel("university", "universal") == pytest.approx(2 * 7 / 19)
    assert S.substring_kernel("ab", "ab") == 0.0  # runs of two letters don't count
    assert S.penalised_substring_kernel("abcdef", "abcdef") == 1.0
    assert S.penalised_substring_kernel("abcxdef", "abcydef") == pytest.approx(12 / 14 - 1 / 7)
    assert S.isub_kernel("Part_Of", "part of") > 0.9
    assert S.isub_kernel("a", "a") == 1.0
    assert S.subsequence_kernel("abc", "abc") == 0.5
    assert S.subsequence_kernel("", "") == 0.0


def test_token_measures(spark):
    a, b = F.array(*map(F.lit, "aab")), F.array(*map(F.lit, "abc"))
    assert value(spark, S.token_measure(a, b, "jaccard")) == pytest.approx(2 / 3)
    assert value(spark, S.token_measure(a, b, "dice")) == pytest.approx(4 / 5)
    assert value(spark, S.token_measure(a, b, "cosine")) == pytest.approx(2 / 6**0.5)
    assert value(spark, S.token_measure(a, b, "euclidean")) == pytest.approx(1 - 2**0.5 / 18**0.5)
    assert value(spark, S.multiset_jaccard(a, b)) == pytest.approx(2 / 6)
    assert value(spark, S.common_tokens(a, b)) == 3
    assert value(spark, S.token_measure(F.array().cast("array<string>"), b, "dice")) == 0.0


def test_person_names(spark):
    name = lambda s: F.array(*map(F.lit, s.split()))
    near = lambda a, b: value(spark, S.person_name_similarity(name(a), name(b)))
    assert near("John Smith", "John Smith") == 1.0
    assert near("John A Smith", "John Smith") == pytest.approx(0.97)
    assert near("John A Smith", "John B Smith") == pytest.approx(0.9)
    assert near("Smith", "John Smith") == 1.0


def test_stemmer():
    stem = N.Stemmer().stem
    known = {"caresses": "caress", "ponies": "poni", "cats": "cat", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit", "hopefulness": "hope", "electrical": "electr", "adjustment": "adjust", "probate": "probat", "rate": "rate", "controll": "control", "sky": "sky"}
    assert {w: stem(w) for w in known} == known


def test_normalise(spark):
    say = lambda s, **o: value(spark, N.normalise(F.lit(s), N.Options(**o)))
    assert say("hasHOMEPage_of-Café (x)") == "has homepage of cafe x"
    assert say("the houses of x2", stop_words=True, digits=True, stem=True) == "hous x"
    assert value(spark, N.clean_label(F.lit("Doe, Jane (1970)"), F.lit("person"))) == "Jane Doe"
    assert value(spark, N.clean_label(F.lit("Acme Corp."), F.lit("organization"))) == "Acme"
    assert value(spark, N.american_spelling(F.lit("colour organise theatre"))) == "color organize theater"
    assert value(spark, N.candidate_label(F.lit("Doe, J Jane (x)"))) == "Jane Doe"
    assert value(spark, N.strip_marks(F.lit("Ångström"))) == "Angstrom"
