"""Language identification with spans.

Each word's script (a range of code points) narrows the languages it can be in;
each word has a score in each of them, from a bounded table of frequent words or,
for other words, from letter trigrams. Viterbi's path over the words, with a penalty
for each switch, labels the spans of mixed-language texts.

A path that stays in the best single language is optimal if no stretch of words
gains more than half the penalty by another: of r > 1 stretches at most r are in
others, and r - 1 switches cost at least r halves. Only the other texts take Viterbi's
recursion, all of a batch at once.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import filtered, only, released, remove, ship, stored, table, text_of, type_of

#: About so many labelled rows are learned from; the model keeps so many words and trigrams, the most frequent.
TRAIN_ROWS = 20_000
TABLE_WORDS = 60_000
TABLE_TRIGRAMS = 150_000
CACHED_WORDS = 200_000
#: Longer runs of letters are cut into pieces of so many.
LONGEST = 64
SWITCH = 14.0
CLIP = 6.0
UNDETERMINED = "und"
MIN_SCORE = 0.2

#: First code points of script ranges; fixed values of the Unicode standard.
SCRIPT_STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x900, 0xE00, 0x1100, 0x1200, 0x1E00, 0x1F00, 0x2000, 0x3040, 0x3400, 0xA000, 0xAC00, 0xD7B0, 0x10000]
SCRIPT_NAMES = ["latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "southeast", "hangul", "other", "latin", "greek", "symbol", "kana", "han", "other", "hangul", "other", "other"]

#: Lower-case letters among the first 256 code points.
_SHORT = re.compile(f"[a-zªµºß-öø-ÿ]{{1,{LONGEST}}}")


def script_of(word: str) -> str:
    """The script of a word's first letter; words_of() cuts where it changes."""
    return SCRIPT_NAMES[bisect.bisect_right(SCRIPT_STARTS, ord(word[0])) - 1]


def _ranges(points: list[int]) -> str:
    """The inside of a character class that holds the code points, which ascend."""
    out, at = [], 0
    while at < len(points):
        end = at
        while end + 1 < len(points) and points[end + 1] == points[end] + 1:
            end += 1
        out.append(f"\\U{points[at]:08x}-\\U{points[end]:08x}")
        at = end + 1
    return "".join(out)


@cache
def _any_script() -> tuple[re.Pattern, re.Pattern]:
    """Runs of letters of one script, with the marks on them, and runs of any letters; by Unicode's categories."""
    letters: dict[str, list[int]] = {}
    marks: list[int] = []
    for point in range(0x110000):
        kind = unicodedata.category(chr(point))[0]
        if kind == "L":
            letters.setdefault(script_of(chr(point)), []).append(point)
        elif kind == "M":
            marks.append(point)
    more = _ranges(marks)
    every = _ranges(sorted(chain(*letters.values())))
    return re.compile("|".join(f"[{own}][{own}{more}]{{0,{LONGEST - 1}}}" for own in map(_ranges, letters.values()))), re.compile(f"[{every}][{every}{more}]*")


def _is_short(low: str) -> bool:
    try:
        low.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def words_of(low: str) -> list[str]:
    """The words of a lower-case text: runs of letters of one script, long ones in pieces."""
    if _is_short(low):
        return _SHORT.findall(low)
    out: list[str] = []
    one_script, letters = _any_script()
    for run in letters.findall(low):
        if len(run) <= LONGEST and run.isascii():
            out.append(run)
        else:
            out += one_script.findall(run)
    return out


def starts_of(low: str) -> list[int]:
    """Where each of words_of() begins."""
    return [m.start() for m in (_SHORT if _is_short(low) else _any_script()[0]).finditer(low)]


def is_held_out(id_col: str) -> Column:
    """Rows never learned from: a quarter, by the id's checksum."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class Model:
    """What was learned; small enough to broadcast (TABLE_WORDS words and TABLE_TRIGRAMS trigrams at most).

    words, trigrams and letters are (item, language, count), the last over all that was learned from;
    totals are the words of each language.
    """

    def __init__(self, words: list[tuple[str, str, int]], trigrams: list[tuple[str, str, int]] = (), letters: list[tuple[str, str, int]] = (), totals: dict[str, int] | None = None):
        self.uid = uuid.uuid4().hex
        totals = totals or {}
        self.languages = sorted(totals)
        place = {x: i for i, x in enumerate(self.languages)}
        n = len(self.languages)

        def table_of(items: list[tuple[str, str, int]], name: Callable[[str], str] = str) -> dict[str, np.ndarray]:
            out: dict[str, np.ndarray] = {}
            for item, lang, k in items:
                out.setdefault(name(item), np.zeros(n))[place[lang]] += k
            return out

        def rows_of(items: dict[str, np.ndarray]) -> tuple[dict[str, int], np.ndarray]:
            """The place of each item, and the values with a row of zeros at the end for all others."""
            return {x: i for i, x in enumerate(items)}, np.array([*items.values(), np.zeros(n)]).reshape(len(items) + 1, n)

        total = np.array([totals[x] for x in self.languages], float)
        by_script = table_of(letters, script_of)
        sums = np.sum(list(by_script.values()), axis=0) if by_script else np.zeros(n)  # letters, which are as many as trigrams
        able = {s: v > 0.001 * np.maximum(sums, 1) for s, v in by_script.items()}
        self.scripts = {s: can for s, can in able.items() if can.any() and not can.all()}
        self.words, self.word_scores = rows_of({w: self.centred(np.log((v + 0.1) / (total + 1))) for w, v in table_of(words).items()})
        self.trigrams, self.trigram_scores = rows_of({t: np.log((v + 0.5) / (sums + 1)) for t, v in table_of(trigrams).items()})

    @staticmethod
    def centred(score: np.ndarray) -> np.ndarray:
        """Relative to the best language, and bounded, so that no word outvotes a passage."""
        return np.maximum(score - score.max(-1, keepdims=True), -CLIP)

    def score(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word: of the table, or else the sum of its trigrams'."""
        other = len(self.word_scores) - 1
        known = np.array([self.words.get(w, other) for w in words])
        out = self.word_scores[known]
        rest = np.flatnonzero(known == other)
        if len(rest):
            get, none = self.trigrams.get, len(self.trigram_scores) - 1
            padded = [f" {words[i]} " for i in rest]
            found = np.array([get(p[i : i + 3], none) for p in padded for i in range(len(p) - 2)])
            sizes = np.array([len(p) - 2 for p in padded])
            out[rest] = self.centred(np.add.reduceat(self.trigram_scores[found], np.cumsum(sizes) - sizes))
        if self.scripts:
            for i, w in enumerate(words):
                if (can := self.scripts.get(script_of(w))) is not None:
                    out[i] = np.where(can, out[i], -2 * CLIP)
        return out


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = TRAIN_ROWS) -> Model:
    """Fit on about `rows` labelled rows that are not held out, chosen by a hash of id and text.

    Totals, scripts and trigrams are counted over all words of these rows; only then are the tables
    cut to the most frequent words and trigrams.
    """
    ship(docs.sparkSession)
    known = docs.filter(F.col(lang_col).isNotNull() & ~is_held_out(id_col))
    n = known.select(id_col).count()
    share = min(1.0, rows / max(n, 1))
    chosen = known if share == 1.0 else known.filter(F.pmod(F.xxhash64(F.col(id_col), F.col(text_col), F.lit("train")), F.lit(1_000_000)) < math.ceil(share * 1_000_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            langs, words = zip(*seen) if seen else ((), ())
            made = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(langs, pa.string()), pa.array(seen.values(), pa.int64())], ["word", "lang", "n"])
            seen.clear()
            return made

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1)):
                name = lang.as_py()
                seen.update((name, word) for word in words_of(text.as_py().lower()))
                if len(seen) > 200_000:
                    yield flush()
        yield flush()

    passing: list[str] = []
    counts = chosen.select(text_of(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(released(run), "word string, lang string, n long")
    counts = stored(counts.groupBy("word", "lang").agg(F.sum("n").alias("n")), "words", passing)
    padded = F.concat(F.lit(" "), "word", F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring(padded, i, F.lit(3)))
    trigrams = stored(counts.select("lang", "n", F.explode(cut).alias("t")).groupBy("t", "lang").agg(F.sum("n").alias("n")), "trigrams", passing)
    letters = trigrams.groupBy(F.substring("t", 2, 1).alias("t"), "lang").agg(F.sum("n").alias("n"))  # the letters of the scripts at most
    totals = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    top = lambda df, item, most: [tuple(r) for r in df.select(item, "lang", "n").orderBy(F.desc("n"), item, "lang").limit(most).collect()]
    model = Model(top(counts, "word", TABLE_WORDS), top(trigrams, "t", TABLE_TRIGRAMS), [tuple(r) for r in letters.select("t", "lang", "n").collect()], totals)
    remove(passing)
    return model


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH) -> list[np.ndarray]:
    """The best path of each text; scores holds the texts' words one after another.

    All texts take each step together, longest first. Equal scores stay in the
    language they are in, then take the first in order.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    size, n = lengths[order], scores.shape[1]
    best = scores[starts].astype(float)
    back = []
    for t in range(1, int(size[0])):
        k = int(np.searchsorted(-size, -t))  # texts of more than t words
        best_k, top = best[:k], best[:k].argmax(1)
        jump = best_k[np.arange(k), top] - penalty
        stay = best_k >= jump[:, None]
        back.append(np.where(stay, np.arange(n), top[:, None]).astype(np.int16))
        best[:k] = np.where(stay, best_k, jump[:, None]) + scores[starts[:k] + t]
    paths: list[np.ndarray] = [np.zeros(0, np.int16)] * len(lengths)
    for i, row in enumerate(order):
        path = np.empty(size[i], np.int16)
        path[-1] = best[i].argmax()
        for t in range(int(size[i]) - 1, 0, -1):
            path[t - 1] = back[t - 1][i, path[t]]
        paths[row] = path
    return paths


class Labeler(dict):
    """Numbers of known words; what is known of them are rows of tables that grow and are bounded."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.clear()
        shape = (CACHED_WORDS // 4 + 1, len(self.model.languages))
        self.scores, self.shares, self.letters = np.zeros(shape), np.zeros(shape), np.zeros(shape[0], np.int64)

    def learn_of(self, words: list[str]) -> None:
        """Number words that have no number."""
        at, end = len(self), len(self) + len(words)
        while end > len(self.letters):
            self.scores, self.shares, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.scores, self.shares, self.letters))
        self.scores[at:end] = score = self.model.score(words)
        share = np.exp(score)
        self.shares[at:end] = share / share.sum(1, keepdims=True)
        self.letters[at:end] = list(map(len, words))
        self.update(zip(words, range(at, end)))

    def label(self, texts: list[str], with_spans: bool = True) -> list[tuple[str, float, str]]:
        """(language, score, spans) of each text; texts without letters are undetermined."""
        languages = self.model.languages
        if len(self) > CACHED_WORDS:
            self.reset()
        words = [words_of(t.lower()) for t in texts]
        rows = [i for i, w in enumerate(words) if w]
        out: list[tuple[str, float, str]] = [(UNDETERMINED, 0.0, "")] * len(texts)
        if not rows or not languages:
            return out
        if new := set(chain.from_iterable(words)).difference(self):
            self.learn_of(list(new))
        lengths = np.array([len(words[i]) for i in rows])
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, int(lengths.sum()))
        scores, letters = self.scores[numbers], self.letters[numbers]
        starts = np.cumsum(lengths) - lengths
        main = np.add.reduceat(scores, starts).argmax(1)
        each = np.repeat(main, lengths)
        gain = scores - scores[np.arange(len(each)), each][:, None]
        # the sum of all gains is no less than that of any stretch
        mixed = [k for k in np.flatnonzero(np.add.reduceat(np.maximum(gain, 0), starts).max(1) > SWITCH / 2).tolist() if self.gains(scores[starts[k] : starts[k] + lengths[k]], main[k]) > SWITCH / 2]
        weight = np.add.reduceat(letters, starts)
        sure = np.add.reduceat(self.shares[numbers, each] * letters, starts) / weight
        for row, top, score in zip(rows, main.tolist(), np.minimum(sure, 1.0).tolist()):
            out[row] = languages[top], score, f"{languages[top]}:0:{len(texts[row])}"
        if mixed:
            held = np.concatenate([np.arange(starts[k], starts[k] + lengths[k]) for k in mixed])
            for k, path in zip(mixed, viterbi(scores[held], lengths[mixed])):
                own = slice(starts[k], starts[k] + lengths[k])
                by_language = np.bincount(path, letters[own], len(languages))
                top = int(by_language.argmax())
                here = path == top
                score = float((self.shares[numbers[own], path][here] * letters[own][here]).sum() / weight[k])
                out[rows[k]] = languages[top], min(1.0, score), self.spans(texts[rows[k]], path) if with_spans else ""
        return out

    @staticmethod
    def gains(scores: np.ndarray, main: int) -> float:
        """The most that any stretch of words gains by one other language."""
        sums = np.cumsum(scores - scores[:, main : main + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(np.vstack([np.zeros(sums.shape[1]), sums[:-1]]), axis=0), 0)
        return float((sums - low).max())

    def spans(self, text: str, path: np.ndarray) -> str:
        turns = np.flatnonzero(np.diff(path)) + 1
        if not len(turns):
            return f"{self.model.languages[path[0]]}:0:{len(text)}"
        starts = starts_of(text.lower())  # where its length is another, places are those in the lower-case text
        cuts = [0, *(starts[t] for t in turns), len(text)]
        return ",".join(f"{self.model.languages[path[t]]}:{a}:{b}" for t, a, b in zip([0, *turns], cuts, cuts[1:]))


def labeler_of(model: Model) -> Labeler:
    """The model's labeler; later tasks of a worker find it with its words."""
    return only(model.uid, lambda: Labeler(model))


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, spans; one row out for each row in.

    spans is ``lang:start:end`` in code points, comma-joined. Null texts, texts without
    letters, and all texts if nothing was learned are `und` with score 0. A text in
    a script that no learned language has gets the likeliest learned language, with a
    low score; of equally likely ones the first by name. Letters are those of Unicode's
    categories L; a run of letters is cut where its script changes and after 64 letters, so texts
    without spaces are scored whole. Ids pass through, of any type, null and repeated ones
    too; only the two named columns are read; an empty table gives no rows. No shuffle.
    """
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = labeler_of(sent.value).label
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                lang, score, spans = zip(*label(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(spans)], ["id", "lang_pred", "score", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(released(run), f"id {type_of(docs, id_col)}, lang_pred string, score double, spans string").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, least: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose language is determined with a score of `least` or more, with all their columns.

    Each row is judged by its own text: null and repeated ids are no matter. Null texts and texts
    without letters go; an empty table gives no rows.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, id_col, text_col))

    def keeps() -> Callable[[list[str]], np.ndarray]:
        label = labeler_of(model.value).label
        return lambda texts: np.array([lang != UNDETERMINED and score >= least for lang, score, _ in label(texts, False)], bool)

    return filtered(docs, text_col, keeps)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, learn(docs))
    return found.select("doc_id", is_held_out("doc_id").alias("held_out"), "lang_pred", "score", "spans")
