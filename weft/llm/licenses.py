"""License scans, with DataFrame functions only.

A template's shingles are its runs of five words (all of a shorter template's
words are one). Texts are cut into overlapping windows of 2c shingles at every c-th,
c being the least power of two that is no less than the template's count, so each
passage of the template's length lies within one window. MinHash bands of one
row retrieve templates: with containment of 0.8 or more, window and template
have a Jaccard similarity of at least 0.19, and one of 64 bands collides with a
probability of 1 - 0.81^64, above 0.999998. What is retrieved is verified by exact
containment: a window matches if it holds 80 % of the template's shingles.

A band can collide only where the window holds the shingle that is the template's
minimum in it, so only windows around such shingles are hashed; and only texts
that hold one of a few words, without which four fifths of no template can be there,
have shingles made of them at all. Bands, minima and sets are small tables that are joined,
so the plan is the same for any number of templates.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.common import keyed, remove, stored, table, text_of
from weft.llm.license_texts import TEMPLATES

SHINGLE, BANDS = 5, 64
#: Least containment, in hundredths.
LEAST = 80
#: Templates whose tables are broadcast: 64 bands of 40 bytes each, 25 MB; and rows of candidates that are.
BROADCAST_TEMPLATES, BROADCAST_ROWS = 10_000, 100_000


def words_of(text: Column) -> Column:
    """Runs of a-z and 0-9, after lower-casing."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def shingles_of(words: Column, n: int) -> Column:
    """The hash of each n words in a row; empty if there are fewer."""
    at = F.sequence(F.lit(1), F.size(words) - n + 1)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(F.slice(words, i, n)))).otherwise(F.array().cast("array<bigint>"))


def _placed(shingles: Column, n: int) -> Column:
    """n, at and shingle of each."""
    return F.transform(shingles, lambda h, i: F.struct(F.lit(n).alias("n"), i.cast("long").alias("at"), h.alias("shingle")))


def minima(shingles: Column) -> Column:
    """For each band the least hash of the shingles."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda j: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, j))))


class Templates:
    """The templates as tables, joined on shingle length n and window step."""

    def __init__(self, spark: SparkSession, templates: dict[str, str], passing: list[str]):
        rows = spark.createDataFrame(sorted(templates.items()), "name string, text string").repartition(1).withColumn("words", words_of(F.col("text")))
        size = F.least(F.lit(SHINGLE), F.size("words"))
        by_size = F.element_at(F.array(*(shingles_of(F.col("words"), n) for n in range(1, SHINGLE + 1))), F.col("n"))
        # an exchange between steps: what one makes isn't made again for each use in the next
        rows = rows.filter(F.size("words") > 0).select("name", "words", size.alias("n")).withColumn("runs", by_size).repartition(1)
        step = F.pow(2, F.ceil(F.log2(F.size("runs")))).cast("long")
        rows = rows.select("name", "words", "n", step.alias("step"), F.array_distinct("runs").alias("shingles")).repartition(1)
        rows = stored(rows.withColumn("minima", minima(F.col("shingles"))), "templates", passing)
        self.hint = "broadcast" if len(templates) <= BROADCAST_TEMPLATES else "merge"
        #: name, shingles
        self.sets = rows.select("name", "shingles").hint(self.hint)
        least = rows.select("name", "n", "step", "shingles", F.posexplode("minima").alias("band", "least"))
        #: n, step, band, least, name
        self.bands = least.drop("shingles").hint(self.hint)
        key = F.filter("shingles", lambda h: F.xxhash64(h, F.col("band")) == F.col("least"))
        #: n, step, shingle: those that are some template's least in some band
        self.keys = stored(least.select("n", "step", F.explode(key).alias("shingle")).distinct().coalesce(1), "template-keys", passing).hint(self.hint)
        self.words = [r.words for r in rows.select("words").collect()]  # as many as there are templates

    def anchors(self) -> list[str]:
        """Words one of which every text with a match holds; long words first, since they are rare.

        A match lacks at most a fifth of a template's shingles, so words that stand in one
        more than that are enough.
        """
        left = []
        for words in self.words:
            n = min(SHINGLE, len(words))
            left.append([set(x) for x in {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}])
        need = [len(runs) - math.ceil(len(runs) * LEAST / 100) + 1 for runs in left]
        found: list[str] = []
        while any(n > 0 for n in need):
            gain: dict[str, int] = {}
            for runs, n in zip(left, need):
                for w in set().union(*runs) if n > 0 else ():
                    gain[w] = gain.get(w, 0) + min(n, sum(w in x for x in runs)) * len(w) ** 2
            found.append(max(gain, key=lambda w: (gain[w], w)))
            for i, runs in enumerate(left):
                need[i] -= sum(found[-1] in x for x in runs)
                left[i] = [x for x in runs if found[-1] not in x]
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_licenses, licenses, n_windows; one row out for each row in.

    templates: name and text of each, TEMPLATES if none are given. licenses: the names of
    the matching templates, sorted and comma-joined; n_windows: how many pairs of window
    and template match. Null, empty and short texts match nothing; ids pass through, of any
    type, null and repeated ones too (rows are told apart by their place); an empty table gives no
    rows; only the two named columns are read.
    """
    passing: list[str] = []
    known = Templates(docs.sparkSession, TEMPLATES if templates is None else templates, passing)
    docs, key = keyed(docs)
    docs = docs.select(F.col(key).alias("_row"), F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))
    anchors = F.lit(known.anchors()).cast("array<string>")
    # the lower-case text is bound once by the outer function, and not made again for each anchor
    some = F.exists(F.array(F.lower("_text")), lambda low: F.exists(anchors, lambda word: F.contains(low, word)))
    texts = stored(docs.filter(some).select("_row", words_of(F.col("_text")).alias("_words")), "license-words", passing)

    # where a window may be that a band retrieves
    each = F.flatten(F.array(*(_placed(shingles_of(F.col("_words"), n), n) for n in range(1, SHINGLE + 1))))
    found = texts.select("_row", F.inline(each)).join(known.keys, ["n", "shingle"])
    place = F.floor(F.col("at") / F.col("step")).cast("long")
    found = found.select("_row", "n", "step", F.explode(F.array(place - 1, place)).alias("window")).filter("window >= 0").distinct()
    windows = stored(found.groupBy("_row").agg(F.collect_set(F.struct("n", "step", "window")).alias("_windows")), "license-windows", passing)

    # those windows' bands, what they retrieve and whether it is there
    few = windows.count() <= BROADCAST_ROWS
    again = texts.join(windows.hint("broadcast" if few else "merge"), "_row")
    again = again.select("_row", F.array(*(shingles_of(F.col("_words"), n) for n in range(1, SHINGLE + 1))).alias("_by_n"), "_windows")
    held = lambda w: F.slice(F.element_at("_by_n", w["n"]), (w["window"] * w["step"] + 1).cast("int"), (w["step"] * 2).cast("int"))
    cut = F.transform("_windows", lambda w: F.struct(w["n"].alias("n"), w["step"].alias("step"), w["window"].alias("window"), held(w).alias("_held")))
    again = again.select("_row", F.inline(cut)).select("*", F.posexplode(minima(F.col("_held"))).alias("band", "least"))
    again = again.join(known.bands, ["n", "step", "band", "least"]).join(known.sets, "name")
    true = F.size(F.array_intersect("_held", "shingles")) * 100 >= F.size("shingles") * LEAST
    matches = again.filter(true).select("_row", "name", "window").distinct()
    matches = matches.groupBy("_row").agg(F.array_sort(F.collect_set("name")).alias("_names"), F.count(F.lit(1)).alias("n_windows"))
    matches = stored(matches, "license-matches")
    remove(passing)

    few = matches.count() <= BROADCAST_ROWS
    out = docs.select("_row", "_id").join(matches.hint("broadcast" if few else "merge"), "_row", "left")
    names = F.coalesce("_names", F.array().cast("array<string>"))
    return out.select(
        F.col("_id").alias(id_col),
        F.size(names).cast("long").alias("n_licenses"),
        F.array_join(names, ",").alias("licenses"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


OP7_SQL = """
WITH t(name, body) AS (VALUES %s),
tw AS (SELECT name, list_filter(regexp_split_to_array(lower(body), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM t),
ts AS (
  SELECT name, n, length, (2 ** ceil(log2(length)))::BIGINT AS step, s, count(*) OVER (PARTITION BY name) AS size
  FROM (SELECT DISTINCT name, n, len(w) - n + 1 AS length, array_to_string(w[p : p + n - 1], ' ') AS s
        FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS p FROM (SELECT *, least(5, len(w)) AS n FROM tw)))
),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents),
ds AS (
  SELECT doc_id, n, p - 1 AS p, array_to_string(w[p : p + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM dw, (SELECT DISTINCT n FROM ts) WHERE len(w) >= n)
),
hit AS (
  SELECT DISTINCT doc_id, name, size, s, unnest([p // step, p // step - 1]) AS win FROM ds JOIN ts USING (n, s)
),
m AS (SELECT doc_id, name, win FROM hit WHERE win >= 0 GROUP BY doc_id, name, size, win HAVING count(*) * 100 >= size * 80),
r AS (SELECT doc_id, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses, count(*) AS n_windows FROM m GROUP BY doc_id)
SELECT doc_id, coalesce(n_licenses, 0) AS n_licenses, coalesce(licenses, '') AS licenses, coalesce(n_windows, 0) AS n_windows
FROM documents LEFT JOIN r USING (doc_id)
""" % ", ".join("('{}', '{}')".format(name, body.replace("'", "''")) for name, body in TEMPLATES.items())
