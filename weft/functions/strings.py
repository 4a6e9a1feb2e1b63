"""String similarities as column functions.

Built-in expressions where Spark has them; the measures that cut strings step by
step are Arrow functions over whole batches, which remember pairs they have seen.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _paired(kernel: Callable[[str, str], float]) -> Callable[[Column, Column], Column]:
    """A kernel on two strings as a column function; a null on either side gives null."""

    def over(a: pd.Series, b: pd.Series) -> pd.Series:
        known = lru_cache(maxsize=1 << 16)(kernel)
        return pd.Series([None if x is None or y is None else known(x, y) for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(over, T.DoubleType())


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the shorter length, not below 0; empty texts equal only each other."""
    least = F.least(F.length(a), F.length(b))
    score = 1 - F.least(F.levenshtein(a, b), least) / least
    return F.when(least > 0, score).when(a == b, 1.0).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def jaro_winkler_kernel(a: str, b: str) -> float:
    """Jaro-Winkler without marking matched letters; transpositions are steps backwards."""
    if a == b:
        return 1.0
    a, b = sorted((a, b), key=len)
    reach, common, back, before = len(b) // 2, 0, 0, None
    for i, letter in enumerate(a):
        low = max(0, i - reach)
        at = b.find(letter, low, max(low, min(len(b), i + reach)))
        if at >= 0:
            common += 1
            back += before is not None and at < before
            before = at
    if not common:
        return 0.0
    score = (common / len(a) + common / len(b) + (common - back) / common) / 3
    return score + _prefix(a, b) * (1 - score) / 10


def _prefix(a: str, b: str) -> int:
    """Letters that both begin with, four at most."""
    n = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        n += 1
    return n


def _common_block(a: str, b: str) -> tuple[int, int, int]:
    """The longest run that a greedy scan finds in both: its length and where it is.

    For each place in a the scan goes through b from match to match, so a run that
    begins inside an earlier match of the same place isn't seen.
    """
    best, in_a, in_b = 0, 0, 0
    for i in range(len(a)):
        if len(a) - i <= best:
            break
        j = 0
        while len(b) - j > best:
            j = b.find(a[i], j)
            if j < 0:
                break
            n = 1
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if n > best:
                best, in_a, in_b = n, i, j
            j += n
    return best, in_a, in_b


def _common_blocks(a: str, b: str) -> tuple[int, int, str, str]:
    """Letters in common runs of three or more, how many runs, and what is left of both."""
    letters = runs = 0
    while a and b:
        n, i, j = _common_block(a, b)
        a, b = a[:i] + a[i + n :], b[:j] + b[j + n :]
        if n <= 2:
            break
        letters, runs = letters + n, runs + 1
    return letters, runs, a, b


def substring_kernel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 2 * _common_blocks(a, b)[0] / total if total else 0.0


def penalised_substring_kernel(a: str, b: str) -> float:
    """Common runs less fragmentation, with a prefix bonus on the leftovers; may be below 0."""
    if not a or not b:
        return 0.0
    letters, runs, rest_a, rest_b = _common_blocks(a, b)
    common = 2 * letters / (len(a) + len(b))
    return common - max(0.0, (runs - 1) / min(len(a), len(b))) + 0.1 * _prefix(rest_a, rest_b) * (1 - common)


def _edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def isub_kernel(a: str, b: str) -> float:
    """Commonality less Hamacher difference (p = 0.6) plus a prefix bonus; short texts by edit distance."""
    if len(a) <= 2 or len(b) <= 2:
        edit = _edit_distance(a, b)
        rest = len(a) + len(b) - edit
        return math.exp(-edit / rest) if rest else float(not edit)
    bare = [s.lower().replace(".", "").replace("_", "").replace(" ", "") for s in (a, b)]
    if not bare[0] or not bare[1]:
        return float(bool(bare[0]) != bool(bare[1]))
    letters = _common_blocks(*bare)[0]
    common = 2 * letters / (len(bare[0]) + len(bare[1]))
    x, y = (1 - letters / len(s) for s in bare)
    apart = x + y - x * y
    difference = x * y / (0.6 + 0.4 * apart) if apart else 0.0
    return max(0.0, common - difference + 0.1 * _prefix(a, b) * (1 - common))


def subsequence_kernel(a: str, b: str) -> float:
    """The longest common subsequence over the sum of the lengths: at most one half."""
    row = [0] * (len(b) + 1)
    for x in a:
        corner = 0
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], corner + 1 if x == y else max(row[j], row[j - 1])
    return row[-1] / (len(a) + len(b)) if a or b else 0.0


jaro_winkler = _paired(jaro_winkler_kernel)
substring = _paired(substring_kernel)
penalised_substring = _paired(penalised_substring_kernel)
isub = _paired(isub_kernel)
subsequence = _paired(subsequence_kernel)


def longest_edit_similarity(a: Column, b: Column) -> Column:
    """One minus the edit distance over the longer length."""
    most = F.greatest(F.length(a), F.length(b))
    return F.when(most > 0, 1 - F.levenshtein(a, b) / most).otherwise(F.when(a.isNotNull() & b.isNotNull(), 1.0))


def substring_edit(a: Column, b: Column) -> Column:
    return 0.65 * penalised_substring(a, b) + 0.35 * longest_edit_similarity(a, b)


def substring_edit_synonym(a: Column, b: Column, synonyms: Column) -> Column:
    """As above, and 1 where the dictionary says that both mean the same."""
    return F.when(synonyms, 1.0).otherwise(substring_edit(a, b))


def equality(a: Column, b: Column) -> Column:
    return F.when(a == b, 1.0).otherwise(F.when(a.isNotNull() & b.isNotNull(), 0.0))


def grams(text: Column, n: int = 3) -> Column:
    """Runs of n letters of the text with n - 1 marks before and after it."""
    marks = "#" * (n - 1)
    padded = F.concat(F.lit(marks), text, F.lit(marks))
    return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.substring(padded, i, F.lit(n)))


def shared(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.transform(F.array_distinct(a), lambda t: F.least(count(a, t), count(b, t))), F.lit(0), lambda s, x: s + x)


def qgram_similarity(a: Column, b: Column) -> Column:
    x, y = grams(a), grams(b)
    return 2 * shared(x, y) / (F.size(x) + F.size(y))


def tokens(text: Column) -> Column:
    """Words between blanks."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def token_measure(a: Column, b: Column, kind: str) -> Column:
    """Cosine, Jaccard, Dice or Euclidean similarity of two token arrays; 0 if either is empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    if kind == "cosine":
        score = both / F.sqrt(F.size(x) * F.size(y))
    elif kind == "jaccard":
        score = both / F.size(F.array_union(x, y))
    elif kind == "dice":
        score = 2 * both / (F.size(x) + F.size(y))
    elif kind == "euclidean":
        count = lambda xs, t: F.size(F.filter(xs, lambda w: w == t))
        squares = F.transform(F.array_union(x, y), lambda t: F.pow(count(a, t) - count(b, t), F.lit(2)))
        distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, v: s + v))
        most = F.sqrt(F.pow(F.size(a), F.lit(2)) + F.pow(F.size(b), F.lit(2)))
        score = (most - distance) / most
    else:
        raise ValueError(f"no token measure {kind}")
    return F.when((F.size(x) > 0) & (F.size(y) > 0), score).otherwise(0.0)


def common_tokens(a: Column, b: Column) -> Column:
    """How many of a's tokens, repeated ones too, are in b."""
    return F.size(F.filter(a, lambda t: F.array_contains(b, t)))


def multiset_jaccard(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens of both: one half at most."""
    total = F.size(a) + F.size(b)
    return F.when(total > 0, shared(a, b) / total).otherwise(0.0)


def max_pairwise(a: Column, b: Column, measure: Callable[[Column, Column], Column]) -> Column:
    """The best similarity of any string of one list to any of the other."""
    return F.array_max(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: measure(x, y)))))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-5 * (x - 0.5)))


def literal_similarity(a: Column, b: Column, measure: Callable[[Column, Column], Column] = qgram_similarity) -> Column:
    """Equal numbers are 1; other numbers and texts compare as strings, numbers with two decimals."""
    x, y = a.try_cast("double"), b.try_cast("double")
    shown = lambda n, s: F.when(n.isNotNull(), F.format_string("%.2f", n)).otherwise(s)
    return F.when(x == y, 1.0).otherwise(measure(shown(x, a), shown(y, b)))


def person_names(name: Column) -> dict[str, Column]:
    """First, middle and last name of an array of words; one word alone is ambiguous."""
    n = F.size(name)
    return {
        "first": F.when(n > 1, F.element_at(name, 1)),
        "middle": F.when(n > 2, F.element_at(name, 2)),
        "last": F.when(n > 1, F.element_at(name, -1)),
        "alone": F.when(n == 1, F.element_at(name, 1)),
    }


def person_name_similarity(a: Column, b: Column, measure: Callable[[Column, Column], Column] = levenshtein_similarity) -> Column:
    """Western names: last times first; a tenth for middle names if both have one, 3 % less if one has."""
    x, y = person_names(a), person_names(b)
    full = measure(x["last"], y["last"]) * measure(x["first"], y["first"])
    middles = x["middle"].isNotNull().cast("int") + y["middle"].isNotNull().cast("int")
    return (
        F.when(x["alone"].isNotNull() & y["alone"].isNotNull(), measure(x["alone"], y["alone"]))
        .when(x["alone"].isNotNull(), F.greatest(measure(x["alone"], y["last"]), measure(x["alone"], y["first"])))
        .when(y["alone"].isNotNull(), F.greatest(measure(x["last"], y["alone"]), measure(x["first"], y["alone"])))
        .when(middles == 0, full)
        .when(middles == 2, 0.9 * full + 0.1 * measure(x["middle"], y["middle"]))
        .otherwise(0.97 * full)
    )


#: The measures that a matcher can be given by name.
MEASURES: dict[str, Callable[[Column, Column], Column]] = {
    "edit": levenshtein_similarity,
    "equal": equality,
    "isub": isub,
    "jaro-winkler": jaro_winkler,
    "q-gram": qgram_similarity,
    "substring": substring,
    "penalised-substring": penalised_substring,
    "substring-edit": substring_edit,
}
