"""Vocabularies, training and search of word vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weft.operators.cut import kept
from weft.operators.numbering import numbered


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), " "), lambda w: w != "")


def vocabulary(docs: DataFrame, text: str = "text", least: int = 1, stop_words: list[str] | None = None) -> DataFrame:
    """word, cnt of all words that occur at least so often."""
    words = docs.select(F.explode(words_of(F.coalesce(text, F.lit("")))).alias("word"))
    out = words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") >= least)
    return out.filter(~F.col("word").isin(stop_words)) if stop_words else out


def ranked(vocab: DataFrame, size: int | None = None) -> DataFrame:
    """The most frequent words (all, if no size is given) with their places from 0, equals by the word."""
    if size is None:
        return numbered(vocab.select("word", "cnt"), [F.desc("cnt"), F.col("word")], "id")
    top = vocab.orderBy(F.desc("cnt"), "word").limit(size)
    return top.select("word", "cnt", (F.row_number().over(W.orderBy(F.desc("cnt"), "word")) - 1).alias("id"))


def running_share(vocab: DataFrame, power: float = 0.75) -> DataFrame:
    """word, cnt, upper: the cumulative share of cnt^power, frequent words first.

    Words of one count have equal weights, so sums run over distinct counts, of which
    there are few, and a word's share follows from its place in the whole order.
    """
    vocab = kept(vocab.select("word", "cnt"))  # counted once for the totals and the order
    counts = vocab.groupBy("cnt").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.pow(F.col("cnt"), F.lit(power)))
    upto = W.orderBy(F.desc("cnt")).rowsBetween(W.unboundedPreceding, W.currentRow)
    total = counts.agg(F.sum(F.col("n") * F.col("w")).alias("total"))
    counts = counts.withColumn("upto", F.sum(F.col("n") * F.col("w")).over(upto)).withColumn("last", F.sum("n").over(upto)).crossJoin(F.broadcast(total))
    placed = numbered(vocab.select("word", "cnt"), [F.desc("cnt"), F.col("word")]).join(counts, "cnt")
    return placed.select("word", "cnt", ((F.col("upto") - (F.col("last") - 1 - F.col("number")) * F.col("w")) / F.col("total")).alias("upper"))


def keep_probability(cnt: Column, total: Column, sample: float) -> Column:
    """Chance that an occurrence of a word stays under subsampling."""
    x = sample * total / cnt
    return F.least(F.lit(1.0), (F.sqrt(1 / x) + 1) * x)


def contexts(docs: DataFrame, window: int, id_col: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """id, word, context, offset: words within a window shrunk by a draw for each place.

    The draw hangs on document, place and seed alone. Arrays are sliced within the row:
    nothing is joined or shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), words_of(F.coalesce(text, F.lit(""))).alias("w")).filter(F.size("w") > 1)

    def around(word: Column, pos: Column) -> Column:
        reach = window - F.pmod(F.xxhash64("id", pos, F.lit(seed)), F.lit(window)).cast("int")
        offsets = F.filter(F.sequence(F.greatest(-pos, -reach), F.least(F.size("w") - 1 - pos, reach)), lambda d: d != 0)
        return F.transform(offsets, lambda d: F.struct(word.alias("word"), F.element_at("w", (pos + d + 1).cast("int")).alias("context"), d.alias("offset")))

    return rows.select("id", F.inline(F.flatten(F.transform("w", around))))


def train_kernel(inputs: np.ndarray, outputs: np.ndarray, centre: np.ndarray, context: np.ndarray, draws: np.ndarray, rate: float, cbow: bool = False) -> None:
    """One step over many pairs, with negatives: logistic gradients by word, in place.

    A word's gradients are summed and divided by the root of their number, so that a frequent
    word doesn't leap.

    centre: word ids, or for CBOW lists of context ids padded by -1; context: the word that
    is predicted; draws: negative ids for each pair.
    """
    if cbow:
        there = centre >= 0
        hidden = np.where(there[:, :, None], inputs[centre], 0).sum(1) / np.maximum(there.sum(1), 1)[:, None]
    else:
        hidden = inputs[centre]
    words = np.column_stack([context, draws])
    truth = np.zeros(words.shape)
    truth[:, 0] = 1
    truth[:, 1:][draws == context[:, None]] = 1
    out = outputs[words]
    error = (truth - 1 / (1 + np.exp(-np.clip(np.einsum("ij,ikj->ik", hidden, out), -30, 30)))) * rate
    back = np.einsum("ik,ikj->ij", error, out)
    _add(outputs, words.ravel(), (error[:, :, None] * hidden[:, None, :]).reshape(-1, hidden.shape[1]))
    if cbow:
        rows, columns = np.nonzero(there)
        _add(inputs, centre[rows, columns], back[rows])
    else:
        _add(inputs, centre, back)


def _add(weights: np.ndarray, words: np.ndarray, steps: np.ndarray) -> None:
    known, place, times = np.unique(words, return_inverse=True, return_counts=True)
    sums = np.zeros((len(known), weights.shape[1]))
    np.add.at(sums, place, steps)
    weights[known] += sums / np.sqrt(times)[:, None]


def train(docs: DataFrame, vocab: DataFrame, dim: int = 16, window: int = 2, negatives: int = 5, rate: float = 0.05, epochs: int = 1, cbow: bool = False, seed: int = 1, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """word, vec: skip-gram (or CBOW) with negatives; partitions train copies, which are averaged after each epoch.

    vocab: the word list of ranked(). The weights are sent with each epoch, so that the
    list's size times dim is what a task holds four times (inputs and outputs, sent and
    trained); texts stay where they are, and of the weights only those that a partition
    changed go back. Windows reach through the whole text, which is trained on in steps
    of 4096 words. With the same partitions and seed the result is the same.
    """
    spark = docs.sparkSession
    known = vocab.select("id", "word", "cnt").toArrow().sort_by("id")
    place = {w: i for i, w in enumerate(known["word"].to_pylist())}
    share = np.cumsum(known["cnt"].to_numpy().astype(float) ** 0.75)
    share /= share[-1] if len(share) else 1
    draw = np.random.default_rng(seed)
    inputs, outputs = draw.uniform(-0.5 / dim, 0.5 / dim, (len(known), dim)), np.zeros((len(known), dim))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text, F.lit("")).alias("text"))

    words = spark.sparkContext.broadcast((place, share))
    for epoch in range(epochs):
        sent = spark.sparkContext.broadcast((inputs, outputs))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            place, share = words.value
            first, second = sent.value
            a, b, seen = first.copy(), second.copy(), 0
            for batch in batches:
                for key, body in zip(batch.id, batch.text):
                    ids = np.array([place[w] for w in body.lower().split(" ") if w in place], np.int64)
                    if len(ids) < 2:
                        continue
                    own = np.random.default_rng([seed, epoch, int(key) & 0x7FFFFFFF])
                    seen += len(ids)
                    for at in range(0, len(ids), 4096):
                        part = ids[at : at + 4096]
                        reach = own.integers(1, window + 1, len(part))
                        offsets = np.array([d for d in range(-window, window + 1) if d])
                        near = np.arange(at, at + len(part))[:, None] + offsets
                        good = (near >= 0) & (near < len(ids)) & (np.abs(offsets) <= reach[:, None])
                        if cbow:
                            centre = np.where(good, ids[np.clip(near, 0, len(ids) - 1)], -1)
                            some = good.any(1)
                            centre, context = centre[some], part[some]
                        else:
                            i, j = np.nonzero(good)
                            centre, context = part[i], ids[near[i, j]]
                        if len(context):
                            draws = np.searchsorted(share, own.random((len(context), negatives)))
                            train_kernel(a, b, centre, context, np.minimum(draws, len(share) - 1), rate, cbow)
            if seen:
                yield pd.DataFrame({"id": [-1], "weight": [float(seen)], "a": [np.zeros(dim)], "b": [np.zeros(dim)]})
                moved = np.flatnonzero((a != first).any(1) | (b != second).any(1))
                for at in range(0, len(moved), 8192):
                    own = moved[at : at + 8192]
                    yield pd.DataFrame({"id": own, "weight": 0.0, "a": list((a[own] - first[own]) * seen), "b": list((b[own] - second[own]) * seen)})

        parts = rows.mapInPandas(run, "id long, weight double, a array<double>, b array<double>")
        add = lambda c: F.array(*(F.sum(F.col(c)[i]) for i in range(dim)))
        sums = parts.groupBy("id").agg(F.sum("weight").alias("w"), add("a").alias("a"), add("b").alias("b")).toArrow().combine_chunks().sort_by("id")
        if sums.num_rows:
            moved, total = sums["id"].to_numpy()[1:], sums["w"][0].as_py()
            for weights, name in ((inputs, "a"), (outputs, "b")):
                weights[moved] += sums[name].combine_chunks().flatten().to_numpy().reshape(-1, dim)[1:] / total
        sent.unpersist()
    vectors = pa.ListArray.from_arrays(np.arange(0, inputs.size + 1, dim, dtype=np.int32), inputs.ravel())
    return spark.createDataFrame(pa.table({"word": known["word"], "vec": vectors}), "word string, vec array<double>")


def choose_senses(vectors: np.ndarray, centres: np.ndarray, counts: np.ndarray, how: str, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sense of each context vector, and the centres and counts after it.

    "dot": the greatest product; "means": the nearest centre, which moves; "growing": as
    "means", but a vector farther than the penalty from all centres founds a new one.
    """
    chosen = []
    for v in vectors:
        if how == "dot":
            chosen.append(int((centres @ v).argmax()))
            continue
        far = np.linalg.norm(centres / np.maximum(counts, 1)[:, None] - v, axis=1) if len(centres) else np.zeros(0)
        if how == "growing" and (not len(far) or far.min() > penalty):
            centres, counts = np.vstack([centres.reshape(-1, len(v)), v]), np.append(counts, 1)
            chosen.append(len(centres) - 1)
            continue
        s = int(far.argmin())
        centres[s] += v
        counts[s] += 1
        chosen.append(s)
    return np.array(chosen), centres, counts


def normalised(vectors: DataFrame, vec: str) -> DataFrame:
    length = F.sqrt(F.aggregate(F.transform(vec, lambda x: x.cast("double") * x), F.lit(0.0), lambda s, x: s + x))
    return vectors.withColumn(vec, F.transform(vec, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(0.0)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 30, id_col: str = "vec_id", vec: str = "embedding", sense: str | None = None) -> DataFrame:
    """query_id, id, cosine, rank: the k vectors of greatest absolute cosine to each query, itself excluded.

    With a sense column (named as it is in the result) k vectors of each sense are given.

    queries is a set that the caller bounds; it is compared block by block with all
    vectors, and each task keeps its own k best before any row moves.
    """
    senses = [sense] if sense else []
    a = normalised(vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v"), *senses), "v")
    b = normalised(queries.select(F.col(id_col).alias("query_id"), F.col(vec).alias("q")), "q")
    scored = a.crossJoin(b).filter("id <> query_id").select("query_id", "id", *senses, F.abs(dot(F.col("v"), F.col("q"))).alias("cosine"))
    w = W.partitionBy("query_id", *senses).orderBy(F.desc("cosine"), "id")
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def mean_query(vectors: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row: the mean of the normalised vectors."""
    n = normalised(vectors, vec)
    return n.agg(F.array(*(F.avg(F.col(vec)[i]) for i in range(dim))).alias(vec))
