"""String measures and normalisation over the labels of both ontologies."""

from __future__ import annotations

from pyspark.sql import functions as F

from weft.functions import normalise as N
from weft.functions import strings as S
from weft.plans.inputs import ONE, TWO, Inputs


def pairs(x: Inputs):
    return x.one.select(F.col("id").alias("src_id"), F.col("label").alias("a")).crossJoin(x.two.select(F.col("id").alias("tgt_id"), F.col("label").alias("b")))


def measured(measure):
    return lambda x: pairs(x).select("src_id", "tgt_id", F.round(measure(F.col("a"), F.col("b")), 6).alias("similarity"))


def sql(value: str) -> str:
    return f"SELECT one.id AS src_id, two.id AS tgt_id, round({value}, 6) AS similarity FROM one CROSS JOIN two"


A, B = "one.label", "two.label"
WORDS_A, WORDS_B = f"string_split({A}, ' ')", f"string_split({B}, ' ')"
BOTH = f"len(list_intersect({WORDS_A}, {WORDS_B}))"
DISTINCT = f"len(list_distinct({WORDS_A})), len(list_distinct({WORDS_B}))"


def register(add) -> None:
    add(
        "D1_levenshtein",
        measured(S.levenshtein_similarity),
        sql(f"CASE WHEN least(length({A}), length({B})) = 0 THEN CAST({A} = {B} AS DOUBLE) ELSE 1 - least(levenshtein({A}, {B}), least(length({A}), length({B}))) / least(length({A}), length({B})) END"),
        ONE,
        TWO,
    )
    add("D2_jaro_winkler", measured(S.jaro_winkler))
    grams = lambda t: f"list_transform(range(1, length({t}) + 3), lambda i: substring('##' || {t} || '##', i, 3))"
    common = f"list_sum(list_transform(list_distinct({grams(A)}), lambda g: least(len(list_filter({grams(A)}, lambda y: y = g)), len(list_filter({grams(B)}, lambda z: z = g)))))"
    add("D3_qgram", measured(S.qgram_similarity), sql(f"2 * coalesce({common}, 0) / (length({A}) + length({B}) + 4)"), ONE, TWO)
    add("D4_substring", measured(S.substring))
    add("D5_penalised_substring", measured(S.penalised_substring))
    add("D6_isub", measured(S.isub))
    add("D7_substring_edit", measured(S.substring_edit))
    add(
        "D8_substring_edit_synonym",
        measured(lambda a, b: S.substring_edit_synonym(a, b, F.element_at(S.tokens(a), 1) == F.element_at(S.tokens(b), 1))),
    )
    add("D9_equal", measured(S.equality), sql(f"CAST({A} = {B} AS DOUBLE)"), ONE, TWO)
    add(
        "D10_measures",
        lambda x: pairs(x).select("src_id", "tgt_id", *(F.round(m(F.col("a"), F.col("b")), 6).alias(n.replace("-", "_")) for n, m in S.MEASURES.items())),
    )
    add(
        "D11_max_pairwise",
        measured(lambda a, b: S.max_pairwise(S.tokens(a), S.tokens(b), S.levenshtein_similarity)),
        sql(f"list_max(flatten(list_transform({WORDS_A}, lambda w: list_transform({WORDS_B}, lambda v: 1 - least(levenshtein(w, v), least(length(w), length(v))) / least(length(w), length(v))))))"),
        ONE,
        TWO,
    )
    add(
        "D12_common_tokens",
        lambda x: pairs(x).select("src_id", "tgt_id", S.common_tokens(S.tokens(F.col("a")), S.tokens(F.col("b"))).cast("long").alias("n")),
        f"SELECT one.id AS src_id, two.id AS tgt_id, len(list_filter({WORDS_A}, lambda w: list_contains({WORDS_B}, w))) AS n FROM one CROSS "
        f"JOIN two",
        ONE,
        TWO,
    )
    n, m = DISTINCT.split(", len(")[0], "len(" + DISTINCT.split(", len(")[1]
    for kind, value in {"cosine": f"{BOTH} / sqrt({n} * {m})", "jaccard": f"{BOTH} / ({n} + {m} - {BOTH})", "dice": f"2 * {BOTH} / ({n} + {m})"}.items():
        add(f"D13_{kind}", measured(lambda a, b, k=kind: S.token_measure(S.tokens(a), S.tokens(b), k)), sql(value), ONE, TWO)
    add(
        "D13_euclidean",
        measured(lambda a, b: S.token_measure(S.tokens(a), S.tokens(b), "euclidean")),
        sql(f"1 - sqrt({n} + {m} - 2 * {BOTH}) / sqrt(len({WORDS_A}) ** 2 + len({WORDS_B}) ** 2)"),
        ONE,
        TWO,
    )
    add("D16_subsequence", measured(S.subsequence))
    add(
        "D17_multiset_jaccard",
        measured(lambda a, b: S.multiset_jaccard(S.tokens(a), S.tokens(b))),
        sql(f"{BOTH} / (len({WORDS_A}) + len({WORDS_B}))"),
        ONE,
        TWO,
    )
    add("D18_person_name", measured(lambda a, b: S.person_name_similarity(S.tokens(a), S.tokens(b))))
    add(
        "D19_literal",
        lambda x: x.table("part").select("p_size", "p_retailprice").distinct().select("p_size", "p_retailprice", F.round(S.literal_similarity(F.col("p_size").cast("string"), F.floor("p_retailprice").cast("string"), S.longest_edit_similarity), 6).alias("similarity")),
        "WITH t AS (SELECT DISTINCT p_size, p_retailprice, format('{:.2f}', p_size::DOUBLE) AS a, format('{:.2f}', floor(p_retailprice)::DOUBLE) AS b FROM part) SELECT p_size, p_retailprice, CASE WHEN a = b THEN 1.0 ELSE round(1 - levenshtein(a, b) / greatest(length(a), length(b)), 6) END::DOUBLE AS similarity FROM t",
    )
    add(
        "D20_keywords",
        measured(lambda a, b: S.common_tokens(N.keywords(a), N.keywords(b)) / F.greatest(F.size(N.keywords(a)), F.size(N.keywords(b)))),
        sql(f"{BOTH} / greatest({n}, {m})"),
        ONE,
        TWO,
    )
    add(
        "D21_sigmoid",
        measured(lambda a, b: S.sigmoid(S.levenshtein_similarity(a, b))),
        sql(f"1 / (1 + exp(-5 * (1 - least(levenshtein({A}, {B}), least(length({A}), length({B}))) / least(length({A}), length({B})) - 0.5)))"),
        ONE,
        TWO,
    )

    parts = lambda x: x.table("part")
    add(
        "E1_normalise",
        lambda x: parts(x).select("p_partkey", N.normalise(F.concat(F.initcap("p_name"), F.lit("_"), F.col("p_type"), F.lit(" (x)"))).alias("t")),
        "SELECT p_partkey, lower(p_name) || ' ' || lower(p_type) || ' x' AS t FROM part",
    )
    add(
        "E1_normalise_stem",
        lambda x: x.table("documents").select("doc_id", F.xxhash64(N.normalise(F.coalesce("text", F.lit("")), N.Options(stem=True, stop_words=True))).alias("t")),
    )
    add(
        "E2_stop_words",
        lambda x: x.table("documents").select("doc_id", F.size(F.filter(F.split(F.lower("text"), " "), lambda w: w.isin(N.STOP_WORDS))).cast("long").alias("n")),
        "SELECT doc_id, len(list_filter(string_split(lower(text), ' '), lambda w: w IN (" + ", ".join(f"'{w}'" for w in N.STOP_WORDS) + "))) AS n FROM documents",
    )
    add("E3_stem", lambda x: parts(x).select("p_partkey", N.stem_words(F.col("p_name")).alias("t")))
    add(
        "E4_strip_marks",
        lambda x: x.table("documents").select("doc_id", F.sha2(F.translate(F.lower(F.coalesce("text", F.lit(""))), N.MARKED, N.BARE), 256).alias("t")),
        f"SELECT doc_id, sha256(translate(lower(coalesce(text, '')), '{N.MARKED}', '{N.BARE}')) AS t FROM documents",
    )
    add(
        "E5_separate_words",
        lambda x: parts(x).select("p_partkey", N.separate_words(F.regexp_replace(F.initcap("p_name"), " ", "")).alias("t")),
        "SELECT p_partkey, upper(split_part(p_name, ' ', 1)[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', "
        "2)[1]) || split_part(p_name, ' ', 2)[2:] AS t FROM part",
    )
    add(
        "E6_last_words",
        lambda x: x.table("documents").select("doc_id", F.sha2(N.last_words(F.coalesce("text", F.lit("")), 3), 256).alias("t")),
        "SELECT doc_id, sha256(array_to_string(string_split(coalesce(text, ''), ' ')[-3:], ' ')) AS t FROM documents",
    )
    add(
        "E8_smart_concat",
        lambda x: parts(x).select("p_partkey", N.smart_concat(F.col("p_name"), F.lit(" "), F.col("p_brand")).alias("t")),
        "SELECT p_partkey, p_name || ' ' || p_brand AS t FROM part",
    )
    kinds, k = "CASE s_suppkey % 3 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' ELSE 'location' END", "s_suppkey % 3"
    add(
        "E9_clean_label",
        lambda x: x.table("supplier").select("s_suppkey", N.clean_label(F.concat("s_name", F.when(F.expr(f"{k} = 0"), ", Ann (1970)").when(F.expr(f"{k} = 1"), " (EU), Inc.").otherwise(" (old) town")), F.when(F.expr(f"{k} = 0"), "person").when(F.expr(f"{k} = 1"), "organization").otherwise("location")).alias("t")),
        f"SELECT s_suppkey, CASE {kinds} WHEN 'person' THEN 'Ann ' || s_name WHEN 'organization' THEN s_name ELSE s_name || '  town' END AS t FROM supplier",
    )
    add(
        "E10_acronym",
        lambda x: x.table("nation").select("n_nationkey", N.is_acronym(F.substr("n_name", F.lit(1), F.pmod("n_nationkey", F.lit(7)))).alias("upper"), N.is_acronym(F.initcap(F.substr("n_name", F.lit(1), F.lit(3)))).alias("mixed")),
        "SELECT n_nationkey, length(n_name[1 : n_nationkey % 7]) BETWEEN 1 AND 4 "
        "AND upper(n_name[1 : n_nationkey % 7]) = n_name[1 : n_nationkey % 7] AS upper, false AS mixed FROM nation",
    )
    add(
        "E11_keywords",
        lambda x: parts(x).select("p_partkey", F.array_join(N.keywords(F.concat_ws(" ", F.lit("The"), "p_name", F.lit("of"), "p_name")), " ").alias("t")),
        "SELECT p_partkey, p_name AS t FROM part",
    )
    british = "CASE r_regionkey % 4 WHEN 0 THEN 'colour of the theatre' WHEN 1 THEN 'organisation' WHEN 2 THEN 'organise it' ELSE 'our hour' END"
    american = "CASE r_regionkey % 4 WHEN 0 THEN 'color of the theater' WHEN 1 THEN 'organization' WHEN 2 THEN 'organize it' ELSE 'or hor' END"
    add(
        "E12_spelling",
        lambda x: x.table("region").select("r_regionkey", N.american_spelling(F.concat(F.lower("r_name"), F.lit(" "), F.expr(british))).alias("t")),
        f"SELECT r_regionkey, lower(r_name) || ' ' || {american} AS t FROM region",
    )
    said = "CASE n_nationkey % 6 WHEN 0 THEN 'Customer' WHEN 1 THEN 'a Company' WHEN 2 THEN 'GeoRegion' WHEN 3 THEN 'some event' WHEN 4 THEN 'PEOPLE' ELSE 'thing' END"
    meant = "CASE n_nationkey % 6 WHEN 0 THEN 'person' WHEN 1 THEN 'organization' WHEN 2 THEN 'location' WHEN 3 THEN 'event' WHEN 4 THEN 'person' ELSE 'unknown' END"
    add(
        "E14_entity_type",
        lambda x: x.table("nation").select("n_nationkey", N.entity_type(F.expr(said)).alias("t")),
        f"SELECT n_nationkey, {meant} AS t FROM nation",
    )
    known = ", ".join(f"('{k}', '{v}')" for k, v in N.RELATIONS.items())
    add(
        "E15_relation",
        lambda x: x.spark.createDataFrame([(s,) for s in [*N.RELATIONS, "!"]], "symbol string").select("symbol", N.relation_of(F.col("symbol")).alias("t")),
        f"SELECT * FROM (VALUES {known}, ('!', 'unknown')) t(symbol, t)",
    )
    add(
        "E16_percent",
        lambda x: x.table("lineitem").groupBy("l_returnflag").agg(F.avg("l_discount").alias("d")).select("l_returnflag", N.percent(F.col("d"), 2).alias("t")),
        "SELECT l_returnflag, format('{:.2f}%', round(avg(l_discount) * 100, 2)) AS t FROM lineitem GROUP BY 1",
    )
