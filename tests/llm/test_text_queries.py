"""The registered queries against SQL on the smallest tables, held-out accuracy, and the pipeline."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no tables here")


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(map(str, frame.itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", ["op1_jaccard_join", "op2_decontamination", "op6_exact_dedup", "op7_license_scan", "op8_chat"])
def test_against_sql(spark, name):
    from weft.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got, want = QUERIES[name](spark, str(DATA)).toPandas(), con.execute(ORACLES[name]).df()
    assert canonical(got) == canonical(want)


def test_held_out_languages(spark):
    from weft.llm.language import op5_language

    found = op5_language(spark, str(DATA)).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = found.filter("held_out AND lang IS NOT NULL")
    assert held.filter("lang_pred = lang").count() >= 0.95 * held.count() > 0


def test_pipeline(spark):
    """Each stage's kept rows against what its operator says of its own input, one row a group."""
    import corpus_pipeline
    from weft.llm import decontamination, exact_dedup, jaccard_join, language
    from weft.llm.common import stored
    from weft.llm.registry import QUERIES

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = docs.limit(3).unionByName(docs.limit(1).selectExpr("cast(null AS bigint) AS doc_id", "text", "lang", "source", "n_chars"))
    docs = docs.unionByName(extra).unionByName(docs.limit(2).selectExpr("doc_id", "concat(text, ' quite another text zq') AS text", "lang", "source", "n_chars"))
    columns, total = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, str(DATA)), name)
        if name == corpus_pipeline.STAGES[-1][0]:
            assert docs.count() == before.count() < total
            break
        assert docs.columns == columns
        texts = lambda df: sorted(r.text or "" for r in df.select("text").collect())
        if name == "language_id":
            model = language.learn(before)
            label = language.Labeler(model).label(texts(before))
            want = [t for t, (lang, score, _) in zip(texts(before), label) if lang != "und" and score >= language.MIN_SCORE]
            assert texts(docs) == want
        elif name == "exact_dedup":
            best = {}
            for t in texts(before):
                bare = "".join(t.split())
                best[bare] = max(best.get(bare, t), t, key=len)
            assert sorted(map(len, best.values())) == sorted(map(len, texts(docs))) and len(best) == docs.count()
        elif name == "near_duplicates":
            found = jaccard_join.jaccard_join(before)
            lone = found.filter("n_shingles = 0").count()
            assert docs.count() == lone + found.filter("n_shingles > 0").select("component_id").distinct().count()
        else:
            rows = decontamination.contamination(before.withColumn("doc_id", before.text), spark.read.parquet(f"{DATA}/benchmark.parquet"))
            assert texts(docs) == sorted(r.doc_id for r in rows.filter("NOT contaminated").collect())
    assert corpus_pipeline.run(spark, str(DATA)).count() > 0
    assert exact_dedup.drop_copies(docs.limit(0).selectExpr("doc_id", "'x' AS text")).count() == 0
    assert set(QUERIES) == {f"op{n}_{x}" for n, x in (q[2:].split("_", 1) for q in QUERIES)} and len(QUERIES) == 10
