"""Vocabularies and word vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions.normalise import STOP_WORDS
from weft.operators import embedding as V
from weft.plans.inputs import Inputs

WORDS = "w AS (SELECT word, count(*) AS cnt FROM (SELECT unnest(string_split(lower(coalesce(text, '')), ' ')) AS word FROM documents) WHERE word <> '' GROUP BY 1)"


def vocab(x: Inputs, least: int = 5):
    return V.vocabulary(x.table("documents"), least=least)


def register(add) -> None:
    add("N1_vocabulary", lambda x: V.vocabulary(x.table("documents")), f"WITH {WORDS} SELECT word, cnt FROM w")
    add(
        "N2_ranked",
        lambda x: V.ranked(V.vocabulary(x.table("documents"), least=5, stop_words=STOP_WORDS), 1000).withColumn("id", F.col("id").cast("long")),
        f"WITH {WORDS} SELECT word, cnt, row_number() OVER (ORDER BY cnt DESC, word) - 1 AS id FROM w WHERE cnt >= 5 "
        f"AND word NOT IN ({', '.join(repr(s) for s in STOP_WORDS)}) ORDER BY cnt DESC, word LIMIT 1000",
    )
    add(
        "N3_sampling_table",
        lambda x: V.running_share(vocab(x)).withColumn("upper", F.round("upper", 6)),
        f"WITH {WORDS} SELECT word, cnt, round(sum(pow(cnt, 0.75)) OVER (ORDER BY cnt DESC, word ROWS UNBOUNDED PRECEDING) / sum(pow(cnt, "
        f"0.75)) OVER (), 6) AS upper FROM w WHERE cnt >= 5",
    )
    add(
        "N4_subsampling",
        lambda x: vocab(x).crossJoin(F.broadcast(vocab(x).agg(F.sum("cnt").alias("total")))).select("word", F.round(V.keep_probability(F.col("cnt"), F.col("total"), 0.001), 6).alias("p")),
        f"WITH {WORDS}, v AS (SELECT * FROM w WHERE cnt >= 5), t AS (SELECT 0.001 * sum(cnt)::DOUBLE AS s FROM v) "
        f"SELECT word, round(least(1.0, (sqrt(cnt / s) + 1) * s / cnt), 6) AS p FROM v CROSS JOIN t",
    )
    add(
        "N5_contexts",
        lambda x: V.contexts(x.table("documents"), 2).groupBy("offset").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("docs")),
    )
    add(
        "N5_full_window",
        lambda x: V.contexts(x.table("documents"), 1).groupBy("offset").agg(F.count(F.lit(1)).alias("n")).select(F.col("offset").cast("long").alias("offset"), "n"),
        "WITH d AS (SELECT len(list_filter(string_split(lower(coalesce(text, '')), ' '), lambda w: w <> '')) AS k FROM documents) "
        "SELECT unnest([-1, 1])::BIGINT AS \"offset\", sum(k - 1)::BIGINT AS n FROM d WHERE k > 1",
    )
    add("N6_skip_gram", lambda x: V.train(x.table("documents"), V.ranked(vocab(x)), dim=8))
    add("N7_cbow", lambda x: V.train(x.table("documents"), V.ranked(vocab(x)), dim=8, cbow=True))
    queries = lambda x: x.table("embeddings").filter("vec_id % 50 = 0")
    unit = "u AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda z: z::DOUBLE * z)))) AS v FROM embeddings)"
    add(
        "N11_neighbours",
        lambda x: V.neighbours(x.table("embeddings"), queries(x), 30).select("query_id", "id", F.round("cosine", 6).alias("cosine")),
        f"WITH {unit} SELECT q.vec_id AS query_id, u.vec_id AS id, round(abs(list_dot_product(q.v, u.v)), 6) AS cosine FROM u q JOIN u "
        f"ON q.vec_id % 50 = 0 AND q.vec_id <> u.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id "
        f"ORDER BY abs(list_dot_product(q.v, u.v)) DESC, u.vec_id) <= 30",
    )
    add(
        "N11_mean_query",
        lambda x: V.mean_query(x.table("embeddings").select("embedding"), "embedding", 64).select(F.posexplode("embedding").alias("i", "v")).select(F.col("i").cast("long").alias("i"), F.round("v", 6).alias("v")),
        f"WITH {unit} SELECT i - 1 AS i, round(avg(v[i]), 6) AS v FROM (SELECT v, unnest(range(1, 65)) AS i FROM u) GROUP BY 1",
    )
    add(
        "N12_by_sense",
        lambda x: V.neighbours(x.table("embeddings"), queries(x), 10, sense="label").select("query_id", "label", "id", F.round("cosine", 6).alias("cosine")),
        f"WITH {unit.replace('SELECT vec_id,', 'SELECT vec_id, label,')} SELECT q.vec_id AS query_id, u.label, u.vec_id AS id, round(abs(list_dot_product(q.v, u.v)), 6) AS cosine FROM u q JOIN u ON q.vec_id % 50 = 0 AND q.vec_id <> u.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id, u.label ORDER BY abs(list_dot_product(q.v, u.v)) DESC, u.vec_id) <= 10",
    )
