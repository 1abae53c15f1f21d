import math
import random

import numpy as np
from pyspark.sql import functions as F

from foliant.functions import quality as Q
from foliant.functions import text as T
from foliant.functions import years as Y
from foliant.operators.components import connected_components
from foliant.operators.graph import distances
from foliant.operators.search import exact_score, fused, fuzzy_score, ranking_metrics, vector_search
from foliant.registry import Registry


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("v")).first().v


def test_names_and_texts_have_one_form(spark):
    assert one(spark, "Capitão Antonio Benedicto d'Araujo", T.normalize_name) == one(spark, "Capitao Antonio Benedito de Araujo", T.normalize_name)
    assert one(spark, "Dr. João", T.normalize_text) == "doutor joao"
    assert one(spark, "busque informacoes sobre os botelhos", T.focus_query) == "botelhos"
    assert one(spark, None, T.normalize_name) is None
    assert one(spark, "João de Souza e Mello", T.person_key) == "João Souza Mello"
    assert one(spark, "a b", T.url_quote) == "a%20b"


def test_years(spark):
    rows = [("Ano 1840", 1840, 1840), ("1840", 1840, 1840), ("Janeiro 1825", None, 1825), ("?", None, None), (None, None, None)]
    for text, strict, anywhere in rows:
        assert one(spark, text, Y.year_strict) == strict
        assert one(spark, text, Y.year_any) == anywhere


def test_readable_text_scores_above_noise(spark):
    good = "O governo da provincia nomeou\no inspector da alfandega do Recife\npara o cargo de director"
    score = lambda x: one(spark, x, lambda c: Q.ocr_metrics(T.clean_text(c))["score"])
    assert score(good) > score("NUMER0 !!\nJ0RNL\nX7 %%\nA8B C9D")
    assert score("") == 0.0


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(5, 5), (None, 3), (7, None), (1, 2), (1, 2)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {x: find(x) for x in list(parent)}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_long_chain_of_components(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r.component for r in connected_components(df, "a", "b").select("component").distinct().collect()] == [0]


def test_distances(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 3), (4, 1)], "src long, dst long")
    got = {r.node: r.hops for r in distances(edges, spark.createDataFrame([(1,)], "node long"), 2).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2}


def test_vector_search_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(50, 8))
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None), (98, [0.0] * 8)], "vec_id long, embedding array<double>")
    got = vector_search(df, df.where("vec_id % 10 = 0"), "vec_id", "embedding", k=3, block=13).collect()
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    for i in range(0, 50, 10):
        s = np.round(u @ u[i], 6)
        best = [j for j in np.lexsort((np.arange(50), -s)) if j != i][:3]
        assert [r.neighbour for r in sorted((r for r in got if r["query"] == i), key=lambda r: r["rank"])] == best


def test_ranking_metrics(spark):
    results = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 12, 1)], "query long, doc long, rank int")
    relevant = spark.createDataFrame([(1, 11), (2, 99), (3, 1)], "query long, doc long")
    got = {r["query"]: r for r in ranking_metrics(results, relevant).collect()}
    assert (got[1].hit, got[1].rr, got[1].ndcg) == (1.0, 0.5, round(1 / math.log2(3), 6))
    assert got[2].hit == got[3].hit == 0.0


def test_scores(spark):
    tokens = ["camara", "municipal"]
    assert one(spark, "a camara municipal", lambda c: exact_score(c, tokens)) > one(spark, "municipal da camara", lambda c: exact_score(c, tokens)) > 0
    assert fuzzy_score(["benedito"], ["benedicto"]) > 0 and fuzzy_score(["benedito"], []) == 0
    r = spark.createDataFrame([(0.91, 0.62)], "a double, b double").select(fused(F.col("a"), F.col("b")).alias("v")).first()
    assert round(r.v, 4) == 1.0


def test_registry_refuses_a_second_query_of_a_name():
    reg = Registry()
    reg.add("a", lambda s, d: None)
    try:
        reg.add("a", lambda s, d: None)
    except ValueError:
        return
    raise AssertionError


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
