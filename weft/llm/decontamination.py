"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are its runs of 13 words (a shorter item is one window). A
window occurs in a document only if all its shingles do, so its rarest shingle in
the corpus is a prefix that every match must hold. One scan of the corpus counts the
benchmark's shingles, a second looks for the prefix shingles alone and takes the
words around each. These are joined with the windows on the shingle; a window that doesn't fit
into the document (length and position) is dropped, and the others are verified word by word.

A scan knows the wanted shingles by a bit table of bounded size, so there are two scans
whatever the benchmark's size, and what it lets through by chance is dropped by the
joins. Documents aren't shuffled, only the places of prefixes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import BitTable, keyed, released, remove, ship, stored, table, text_of, type_of, without
from weft.llm.hashing import WordHasher, byte_table, run_hashes

WINDOW = 13
SHINGLE = 5
#: A document is contaminated when one word in so many is hit.
ONE_IN = 20
#: Most bits of the table of wanted shingles: 64 MB.
BITS = 1 << 29
#: Windows that may be broadcast: their words and some numbers, 200 bytes each, 20 MB.
BROADCAST_WINDOWS = 100_000

_WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_HASHER: list[WordHasher] = []


def hasher() -> WordHasher:
    if not _HASHER:
        _HASHER.append(WordHasher(byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))))
    return _HASHER[0]


def words_of(text: str) -> list[str]:
    """The words that hasher() hashes, A-Z in lower case."""
    return [w.decode() for w in _WORDS.findall(text.encode().lower())]


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item, text) to (item, window, length, shingles): an item's distinct windows, their words and shingles in order."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            words, (hashes,) = words_of(text), hasher().words([text.encode()])
            size = min(WINDOW, len(words))
            n = min(SHINGLE, size)
            shingles = run_hashes(hashes, n).view(np.int64) if size else np.zeros(0, np.int64)
            found = {" ".join(words[i : i + size]): i for i in range(len(words) - size + 1)} if size else {}
            at = list(found.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(at), pa.string()), pa.array(list(found), pa.string()), pa.array([size] * len(at), pa.int32()), pa.array([shingles[i : i + size - n + 1] for i in at], pa.list_(pa.int64()))],
                ["item", "window", "length", "shingles"],
            )


def _counts(sent, lengths: list[int]):
    """Rows (text) to (shingle, count): how often wanted shingles occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for words in hasher().words([t.as_py().encode() for t in batch.column(0)]):
                for n in lengths:
                    hashes = run_hashes(words, n)
                    found.append(hashes[wanted.find(hashes)])
            shingles, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles.view(np.int64)), pa.array(count, pa.int64())], ["shingle", "count"])

    return run


HITS = "array<struct<prefix:long,at:long,first:long,around:array<string>>>"


def _hits(sent, lengths: list[int]):
    """Rows (id, text) to (id, row, n_words, hits): a number for the row, and where it may hold prefixes.

    Around a prefix are the words that a window may reach: those of the shingle alone if
    it is shorter than SHINGLE, for then it is the whole window.
    """
    kind = pa.list_(pa.struct([("prefix", pa.int64()), ("at", pa.int64()), ("first", pa.int64()), ("around", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted, number = sent.value, TaskContext.get().partitionId() << 40
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                sizes, hits = [], []
                for text, hashed in zip(batch.column(1), hasher().words([t.as_py().encode() for t in batch.column(1)])):
                    sizes.append(len(hashed))
                    own, words = [], None
                    for n in lengths:
                        hashes = run_hashes(hashed, n)
                        found = wanted.find(hashes)
                        if len(found):
                            words = words_of(text.as_py()) if words is None else words
                            back, on = (WINDOW - SHINGLE, WINDOW) if n == SHINGLE else (0, n)
                            for prefix, at in zip(hashes[found].view(np.int64).tolist(), found.tolist()):
                                first = max(0, at - back)
                                own.append({"prefix": prefix, "at": at, "first": first, "around": words[first : at + on]})
                    hits.append(own)
                rows = pa.array(np.arange(number, number + len(sizes)))
                number += len(sizes)
                yield pa.RecordBatch.from_arrays([batch.column(0), rows, pa.array(sizes, pa.int64()), pa.array(hits, kind)], ["id", "row", "n_words", "hits"])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated; one row out for each row in.

    A null, empty or wordless text has no words and isn't contaminated; a null or
    wordless item has no windows; rows with one item id are one item, and an item without id is
    named "null"; ids pass through, of any type, repeated and null ones too; without documents
    there are no rows; without items nothing is hit. Only the named columns are read.
    """
    spark, passing = docs.sparkSession, []
    ship(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), text_of(item_text_col).alias("text"))
    made = stored(items.mapInArrow(released(_windows), "item string, window string, length int, shingles array<long>"), "windows", passing)
    windows = made.select("window", "length", "shingles").dropDuplicates(["window"])
    each = stored(windows.select("window", "length", F.posexplode("shingles").alias("offset", "shingle")), "shingles", passing)
    lengths = sorted(min(SHINGLE, r.length) for r in made.select("length").distinct().collect())  # 13 at most
    lengths = sorted(set(lengths))

    wanted = spark.sparkContext.broadcast(BitTable.of(each.select("shingle").distinct(), "shingle", BITS))
    counts = rows.select("text").mapInArrow(released(_counts(wanted, lengths)), "shingle long, count long")
    counts = counts.groupBy("shingle").agg(F.sum("count").alias("count"))
    counts = counts.join(each.select("shingle").distinct(), "shingle", "left_semi")  # without what the bit table let through
    rarity = F.struct(F.coalesce("count", F.lit(0)), "shingle", "offset")
    prefixes = each.join(counts, "shingle", "left").groupBy("window", "length").agg(F.min(rarity).alias("least"))
    prefixes = stored(prefixes.select("window", "length", F.col("least.shingle").alias("prefix"), F.col("least.offset").alias("offset")), "prefixes", passing)

    sent = spark.sparkContext.broadcast(BitTable.of(prefixes.select("prefix").distinct(), "prefix", BITS))
    found = stored(rows.mapInArrow(released(_hits(sent, lengths)), f"id {type_of(docs, id_col)}, row long, n_words long, hits {HITS}"), "hits")
    few = prefixes.count() <= BROADCAST_WINDOWS
    places = found.filter(F.size("hits") > 0).select("row", "n_words", F.inline("hits"))
    places = places.join(prefixes.hint("broadcast" if few else "merge"), "prefix").withColumn("start", F.col("at") - F.col("offset"))
    places = places.filter("start >= 0 AND start + length <= n_words")
    said = F.array_join(F.slice("around", (F.col("start") - F.col("first") + 1).cast("int"), F.col("length")), " ")
    places = stored(places.filter(said == F.col("window")).select("row", "start", (F.col("start") + F.col("length")).alias("end"), "window"), "places", passing)

    # spans in order; what a span adds to those before it
    reach = F.aggregate(
        F.array_sort("spans"),
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda s, x: F.struct(F.greatest(s["end"], x["end"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["end"] - F.greatest(s["end"], x["start"]))).alias("n")),
    )
    hit = places.groupBy("row").agg(F.collect_set(F.struct("start", "end")).alias("spans")).select("row", reach["n"].alias("n_hit"))
    owners = made.select("window", "item").distinct()
    if few:
        owners = owners.hint("broadcast" if owners.count() <= BROADCAST_WINDOWS else "merge")
    named = places.select("row", "window").distinct().join(owners, "window").groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hit = stored(hit.join(named, "row"), "contamination")
    remove(passing)
    out = found.select("id", "row", "n_words").join(hit, "row", "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0)).cast("long"), F.array().cast("array<string>")
    own = F.coalesce("items", none)
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(own).cast("long").alias("n_items"),
        F.sha2(F.array_join(own, ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * ONE_IN >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns.

    Rows are told apart by their place, so null and repeated ids are no matter.
    """
    docs, key = keyed(docs)
    found = contamination(docs.select(F.col(key).alias("id"), F.col(text_col).alias("text")), benchmark, "id")
    return without(docs, key, found.filter("contaminated").select("id"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(13, len(w)) AS n FROM i WHERE len(w) > 0))
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), h AS (
  SELECT doc_id, dw.n, p, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win
), hit AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT doc_id, p, n FROM h)) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
