"""Normalisation of labels."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The short list of words that say nothing about a concept.
STOP_WORDS = ["a", "an", "as", "at", "by", "about", "for", "from", "of", "or", "and", "&", "the", "to", "@en"]
#: Words whose presence on one side alone speaks against a match.
PREPOSITIONS = ["at", "by", "for", "from", "in", "of", "on", "to", "with"]
#: What organisations add to their names.
COMPANY_SUFFIXES = ["inc", "corp", "co", "ltd", "llc", "plc", "gmbh", "ag", "sa"]
RELATIONS = {"=": "equivalence", "<": "subclass", ">": "superclass", "(": "subclass", ")": "superclass", "[": "related-sub", "]": "related-super", "{": "part-sub", "}": "part-super", "~": "related", "?": "unknown"}
ENTITY_TYPES = ["person", "organization", "location", "event", "work"]


@dataclass(frozen=True)
class Options:
    blanks: bool = True
    punctuation: bool = True
    digits: bool = False
    diacritics: bool = True
    stop_words: bool = False
    stem: bool = False
    #: A longer list in place of STOP_WORDS.
    other_stop_words: tuple[str, ...] = ()


def separate_words(text: Column) -> Column:
    """Camel case and separators become blanks; a run of capitals is one word."""
    spaced = F.regexp_replace(text, "([A-Z]+)", " $1")
    return F.trim(F.regexp_replace(spaced, r"[-_\s]+", " "))


@F.pandas_udf(T.StringType())
def strip_marks(text: pd.Series) -> pd.Series:
    return text.map(lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)))


#: Letters with marks and what they become without, for a built-in expression.
MARKED, BARE = "áàâäãåéèêëíìîïóòôöõúùûüçñ", "aaaaaaeeeeiiiiooooouuuucn"


def normalise(text: Column, options: Options = Options()) -> Column:
    out = separate_words(text) if options.blanks else text
    out = F.lower(out)
    if options.diacritics:
        out = F.translate(out, MARKED, BARE)
    if options.punctuation:
        out = F.regexp_replace(out, r"[.,;:!?'\"/\\()\[\]{}]", "")
    if options.digits:
        out = F.regexp_replace(out, "[0-9]", "")
    words = F.filter(F.split(out, " "), lambda w: w != "")
    dropped = list(options.other_stop_words) or (STOP_WORDS if options.stop_words else [])
    if dropped:
        words = F.filter(words, lambda w: ~w.isin(dropped))
    joined = F.array_join(words, " ")
    return stem_words(joined) if options.stem else joined


def is_irrelevant(text: Column) -> Column:
    return F.trim(F.coalesce(text, F.lit(""))) == ""


def keywords(text: Column) -> Column:
    """Lower-case words without punctuation and stop words, each once, in order."""
    words = F.split(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(STOP_WORDS)))


def is_acronym(text: Column) -> Column:
    return (F.length(text) < 5) & (F.upper(text) == text) & (F.length(text) > 0)


def american_spelling(text: Column) -> Column:
    """our to or, isation to ization, ise to ize, re to er, at the ends of words."""
    out = F.regexp_replace(text, r"our\b", "or")
    out = F.regexp_replace(out, r"isation\b", "ization")
    out = F.regexp_replace(out, r"ise\b", "ize")
    return F.regexp_replace(out, r"tre\b", "ter")


def last_words(text: Column, n: int) -> Column:
    words = F.split(text, " ")
    return F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - n + 1), F.lit(n)), " ")


def smart_concat(*parts: Column) -> Column:
    """The parts that say something, with one blank between."""
    return F.concat_ws(" ", *(F.when(~is_irrelevant(p), F.trim(p)) for p in parts))


def clean_label(text: Column, kind: Column) -> Column:
    """By entity type: persons in natural order, organisations without suffix, others without brackets."""
    bare = F.trim(F.regexp_replace(text, r"\([^)]*\)", ""))
    swapped = F.regexp_replace(bare, r"^([^,]+), *(.+)$", "$2 $1")
    firm = F.trim(F.regexp_replace(bare, r"(?i)[ ,]+(" + "|".join(COMPANY_SUFFIXES) + r")\.?$", ""))
    return F.when(kind == "person", swapped).when(kind == "organization", firm).otherwise(bare)


def entity_type(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(low.rlike("pers|people|customer"), "person").when(low.rlike("org|compan|supplier"), "organization")
    return out.when(low.rlike("loc|place|nation|region|geo"), "location").when(low.rlike("event"), "event").otherwise("unknown")


def relation_of(symbol: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in RELATIONS.items() for x in pair))
    return F.coalesce(known[symbol], F.lit("unknown"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", F.round(x * 100, digits))


def candidate_label(text: Column) -> Column:
    """A label as a search phrase: no brackets, commas swapped, no words of one letter."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\([^)]*\)", ""), r"^([^,]+), *(.+)$", "$2 $1")
    return F.array_join(F.filter(F.split(F.trim(bare), " +"), lambda w: F.length(w) > 1), " ")


def function_words(words: Column) -> Column:
    return F.filter(words, lambda w: w.isin(PREPOSITIONS + ["is", "has"]))


class Stemmer:
    """Porter's algorithm of 1980, from its published rules."""

    VOWELS = "aeiou"
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    def consonant(self, w: str, i: int) -> bool:
        return w[i] not in self.VOWELS and not (w[i] == "y" and i > 0 and self.consonant(w, i - 1))

    def measure(self, w: str) -> int:
        kinds = "".join("c" if self.consonant(w, i) else "v" for i in range(len(w)))
        return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:]))

    def voweled(self, w: str) -> bool:
        return any(not self.consonant(w, i) for i in range(len(w)))

    def doubled(self, w: str) -> bool:
        return len(w) > 1 and w[-1] == w[-2] and self.consonant(w, len(w) - 1)

    def closed(self, w: str) -> bool:
        """Consonant, vowel, consonant other than w, x, y."""
        n = len(w)
        return n > 2 and self.consonant(w, n - 1) and not self.consonant(w, n - 2) and self.consonant(w, n - 3) and w[-1] not in "wxy"

    def longest(self, w: str, rules: list[tuple[str, str]]) -> str:
        for end, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                return stem + to if self.measure(stem) > 0 else w
        return w

    def stem(self, w: str) -> str:
        if len(w) < 3:
            return w
        for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
            if w.endswith(end):
                w = w[: len(w) - len(end)] + to
                break
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for end in ("ed", "ing"):
                if w.endswith(end) and self.voweled(w[: -len(end)]):
                    w = w[: -len(end)]
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif self.doubled(w) and w[-1] not in "lsz":
                        w = w[:-1]
                    elif self.measure(w) == 1 and self.closed(w):
                        w += "e"
                    break
        if w.endswith("y") and self.voweled(w[:-1]):
            w = w[:-1] + "i"
        w = self.longest(self.longest(w, self.STEP2), self.STEP3)
        for end in sorted(self.STEP4, key=len, reverse=True):
            if w.endswith(end):
                stem = w[: len(w) - len(end)]
                if self.measure(stem) > 1 and (end != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e") and (self.measure(w[:-1]) > 1 or self.measure(w[:-1]) == 1 and not self.closed(w[:-1])):
            w = w[:-1]
        return w[:-1] if self.measure(w) > 1 and self.doubled(w) and w.endswith("l") else w


@F.pandas_udf(T.StringType())
def stem_words(text: pd.Series) -> pd.Series:
    stemmer, known = Stemmer(), {}

    def one(word: str) -> str:
        if word not in known:
            known[word] = stemmer.stem(word)
        return known[word]

    return text.map(lambda s: None if s is None else " ".join(map(one, s.split(" "))))
