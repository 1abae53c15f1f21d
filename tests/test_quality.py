"""Golden rows of quality, selection, model calls, streams and resolution."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import quality as Q
from foliant.operators import models
from foliant.plans.judging import DATE_SIGNS, DATED, judged, new_wins
from foliant.plans.resolving import blocked

METRICS = "struct<score:double,valid_word_ratio:double,odd_char_ratio:double,short_line_ratio:double,chars:long>"


def wins(spark, old, new):
    return spark.createDataFrame([(old, new)], f"o {METRICS}, n {METRICS}").select(new_wins().alias("w")).first().w


def test_a_new_text_wins_by_a_gain_without_harm_or_to_rescue_a_bad_one(spark):
    old = (0.80, 0.80, 0.010, 0.20, 1000)
    assert wins(spark, old, (0.84, 0.82, 0.005, 0.20, 1000))  # strong
    assert wins(spark, old, (0.82, 0.81, 0.008, 0.17, 900))  # moderate
    assert not wins(spark, old, (0.82, 0.81, 0.008, 0.19, 900))  # lines no longer
    assert not wins(spark, old, (0.82, 0.81, 0.008, 0.17, 700))  # much shorter
    assert not wins(spark, old, (0.99, 0.85, 0.020, 0.10, 1000))  # more odd characters
    bad = (0.50, 0.40, 0.030, 0.50, 1000)
    assert wins(spark, bad, (0.95, 0.90, 0.040, 0.60, 700)) and not wins(spark, bad, (0.95, 0.90, 0.040, 0.60, 500))


def test_dated_text_with_names_and_headings_is_better_than_noise(spark):
    good = "DIARIO DE PERNAMBUCO\nRecife, 7 de novembro de 1825. O Capitão João Affonso Botelho e Manoel Pereira\ncompareceram perante o Juiz Municipal da cidade."
    rows = spark.createDataFrame([(1, good, None), (2, "x7 %% #@\nA8B C9D ~~\n|| ^^ 0l", None), (3, "", None), (4, good, 0.0)], "doc_id long, text string, alike double")
    got = {r.doc_id: r for r in judged(rows, "doc_id").collect()}
    assert got[1].historiographic > got[2].historiographic and got[1].named > got[2].named and got[1].dated and not got[2].dated and got[1].heading > 0
    assert got[2].bad > got[1].bad and got[2].advice != "manter" and got[1].advice == "manter"
    assert got[4].historiographic < got[1].historiographic and got[4].bad > got[1].bad and got[3].historiographic <= 0.3


def test_legible_names(spark):
    rows = [("João Affonso Botelho", True, True, True), ("Nosso Senhor Jesus", False, True, True), ("the king Botelho", False, True, True), ("Juiz Antonio Barros", True, False, True), ("Ra- tisquien Botelho", True, False, True), ("Brtx", False, False, False), ("Copaaá Silva", False, False, True), (None, False, False, False)]
    df = spark.createDataFrame(rows, "n string, a boolean, b boolean, c boolean")
    for r in df.select("*", Q.legible_name(F.col("n")).alias("x"), Q.legible_label(F.col("n")).alias("y"), Q.legible_for_merge(F.col("n")).alias("z")).collect():
        assert (r.x, r.y, r.z) == (r.a, r.b, r.c), r


def test_noise_and_its_reasons(spark):
    df = spark.createDataFrame([("person", "Deos Guarde."), ("person", "João Affonso Botelho"), ("place", "Deos Guarde")], "t string, n string")
    none = F.array().cast("array<string>")
    got = [(round(r.s, 2), list(r.r)) for r in df.select(*[x.alias(k) for k, x in zip("sr", Q.noise_of(F.col("t"), F.col("n"), F.lit(None).cast("string"), none))]).collect()]
    assert got == [(0.96, ["phrase"]), (0.0, []), (0.0, [])]


def test_model_calls():
    def broken(_):
        raise ValueError

    long = "\n\n".join(f"paragrafo {i} " + "x" * 900 for i in range(9))
    assert models.correct("curto", broken) == "curto" and models.correct("y" * 50, broken) == "y" * 50
    assert models.correct(long, lambda t: t.upper()) == long.upper() and models.correct(long, lambda t: None) == long
    assert all(len(p) <= 5000 for p in models.packed(long, 5000)) and models.packed("", 10) == []
    assert models.tidy("appro-\nvou  isto") == "approvou isto"
    assert models.retried("a", models.slow_at(100)) == "a" and models.retried("a", models.slow_at(500)) is None
    assert abs(sum(x * x for x in models.embed("camara municipal")) - 1) < 1e-9 and models.embed("") == [0.0] * 16
    assert '"child_of"' in models.extract("João Affonso Botelho, filho de Manoel Botelho.")


def test_blocking_matches_all_pairs(spark):
    names = ["joao botelho", "joao affonso botelho", "botelho", "maria lima", "anna maria lima", "joao", "lima barros", "joao botelho"]
    rows = [(i, "person", n, [n, "x y"] if i in (3, 6) else [n]) for i, n in enumerate(names)]
    got = {(r.x, r.y) for r in blocked(spark.createDataFrame(rows, "id long, type string, b string, al array<string>")).collect()}
    inside = lambda a, b: f" {a} " in f" {b} "
    want = {(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and (inside(a, b) or inside(b, a) or {i, j} == {3, 6})}
    assert got == want


def test_dates_are_found_as_by_the_shared_pattern(spark):
    texts = ["7 de maio de 1825", "x7 de maio de 1825", "ç17 de maio de 18256", "117 de maio de 1825", "17 de maio\nde 1825.", "anno de 1825", "panno de 1825", "anno de 18257", "hoje ha", "_hoje ha", "-hoje\tha", "hoje", "1 17 de m de 1825 x", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(F.col("t").rlike(DATED).alias("a"), F.col("t").rlike(DATE_SIGNS).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] and {r.a for r in rows} == {True, False}


@pytest.mark.parametrize("name", ["q_bad_page", "bench_correct"])
def test_the_texts_of_pages_are_gathered_once(spark, tmp_path, name):
    import __spark_entry__ as entry

    rows = [("a_1.txt", "O governo da provincia\nnomeou", 1), ("a_1_corrigido.txt", "O governo da província\nnomeou", 2), ("a_2.txt", "x7 %%", 1)]
    spark.createDataFrame(rows, "text_path string, body string, n long").select("text_path", "body", F.timestamp_seconds("n").alias("ingested_at")).write.parquet(f"{tmp_path}/page_texts.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    assert df._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
    assert df.count() == {"q_bad_page": 2, "bench_correct": 1}[name]
