"""Queries of quality: which text is better, which page is bad, which name is noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import quality as Q
from foliant.functions import text as T
from foliant.operators.retrieval import compared
from foliant.plans.prelude import registrar
from foliant.plans.relational import long_count
from foliant.plans.textual import base_of
from foliant.sources.evidence import Evidence

reg, q = registrar()

#: The vocabulary of lives, and the signs of a date.
LIVES = (
    "filho|filha|viuva|viúva|casad[oa]|casamento|matrimonio|matrimônio|noiva|noivo|desposou|batismo|baptismo|baptiz|nasceu|nascido|nascida|faleceu|falleceo|falecido|obito|óbito|enterr|"
    "sepulta|defunto|defunta|funeral|doença|doente|molestia|moléstia|epidemia|febre|colera|cólera|lazareto|hospital|reo |réu |absolvid|condenad|sentença|tribunal|jury|promotor|crime|"
    "preso|prisão|cadeia|pronunciad|denuncia|denúncia|querela|nomead[oa]|eleit[oa]|presidente|governador|prefeito|inspector|commandante|secretario|secretário|morador|residente|domiciliad|"
    "embarcou|partiu|chegou|desembarcou|passageiro|escravo|escrava|liberto|liberta|forro|alforria|fugido|fugida|compra|venda|arremat|hipoteca|devedor|credor|fiador|herança|herdeiro|"
    "inventario|inventário|testamento|assinado|assignado|requerimento|procuração|desertor|desertou|recruta|destacamento|guarnição"
)
DATE_SIGNS = r"(?:^|[^a-z0-9_])(?:\d{1,2}\s+de\s+[a-zà-ÿ]+\s+de\s+\d{4}|anno\s+de\s+\d{4})(?:[^a-z0-9_]|$)|(?:^|[^a-z0-9_])hoje\s+[a-zà-ÿ]+"
#: DATE_SIGNS for Java: no letter is looked at twice.
DATED = r"(?=[\dah])(?<![a-z0-9_])(?:\d{1,2}\s+de\s+[a-zà-ÿ]+\s+de\s+\d{4}(?![a-z0-9_])|anno\s+de\s+\d{4}(?![a-z0-9_])|hoje\s+[a-zà-ÿ]+)"
NAMED = f"(?:D\\.|Dr\\.?|Sr\\.?|Sra\\.|[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][a-záàâãéêíóôõúç]+)(?:\\s+(?:(?:de|da|do|dos|das|d['’]|e)\\s+)?[A-ZÁÀÂÃÉÊÍÓÔÕÚÇ][a-záàâãéêíóôõúç]+){{1,3}}"


def texts(e: Evidence) -> DataFrame:
    return e.table("documents").where("text is not null").select("doc_id", "text")


TEXT = "from documents where text is not null"
BIO = f"len(regexp_extract_all(lower(text), '{LIVES}'))"
WORDS = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''))"


def lives() -> Column:
    return F.regexp_count(F.lower("text"), F.lit(LIVES))


def words() -> Column:
    return F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))


q("rx_bio", f"select doc_id, {BIO} v {TEXT}")(lambda e: texts(e).select("doc_id", lives().cast("long").alias("v")))
q("rx_date_signal", f"select doc_id, regexp_matches(lower(text), '{DATE_SIGNS}') v {TEXT}")(lambda e: texts(e).select("doc_id", F.lower("text").rlike(DATE_SIGNS).alias("v")))
q("flt_dense_page", f"select doc_id, {BIO}::bigint hits from (select doc_id, text {TEXT}) where {WORDS} >= 30 and length(text) - length(replace(text, '|', '')) > 1 and {BIO} >= 3")(
    lambda e: texts(e).where((words() >= 30) & (F.length("text") - F.length(F.replace("text", F.lit("|"))) > 1) & (lives() >= 3)).select("doc_id", lives().cast("long").alias("hits"))
)
REAL = "len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: length(regexp_replace(w, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 2))"


def real_words() -> Column:
    return F.size(F.filter(F.split("text", r"\s+"), lambda w: F.length(F.regexp_replace(w, "[^A-Za-zÀ-ÿ]", "")) >= 2))


q("flt_unreadable_text", f"select doc_id {TEXT} and ({REAL} < 15 or {REAL} / greatest({WORDS}, 1) < 0.4)")(lambda e: texts(e).where((real_words() < 15) | (real_words() / F.greatest(words(), F.lit(1)) < 0.4)).select("doc_id"))
HEADS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, e' \\t\\r')), lambda x: x <> '')"
HEADING = f"round(len(list_filter({HEADS}[1:12], lambda x: regexp_replace(x, '[^A-Za-zÀ-ÿ]', '', 'g') <> '' and upper(regexp_replace(x, '[^A-Za-zÀ-ÿ]', '', 'g')) = regexp_replace(x, '[^A-Za-zÀ-ÿ]', '', 'g') and len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) <= 8)) / greatest(least(len({HEADS}), 12), 1), 4)"


def heading() -> Column:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x, F.lit(" \t\r"))), lambda x: x != "")
    few = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: w != "")) <= 8
    heads = F.filter(F.transform(F.filter(F.slice(lines, 1, 12), few), lambda x: F.regexp_replace(x, "[^A-Za-zÀ-ÿ]+", "")), lambda x: (x != "") & (F.upper(x) == x))
    return F.round(F.size(heads) / F.greatest(F.least(F.size(lines), F.lit(12)), F.lit(1)), 4)


q("q_heading", f"select doc_id, {HEADING} v {TEXT} and not contains(text, 'ß')")(lambda e: texts(e).where("not contains(text, 'ß')").select("doc_id", heading().alias("v")))


def judged(rows: DataFrame, ident: str) -> DataFrame:
    """`rows` (ident, text, alike) with the metrics of the text, its historiographic score, how bad it is and what to do; alike, the likeness to a corrected text, may be null."""
    m = Q.ocr_metrics(T.clean_text(F.col("text")))
    named = F.round(F.least(F.lit(1.0), F.regexp_count("text", F.lit(NAMED)) / F.greatest(F.lit(2.0), F.greatest(words(), F.lit(1)) / 18)), 4)
    c = rows.select(ident, "alike", F.struct(*[v.alias(k) for k, v in m.items()]).alias("m"), named.alias("named"), heading().alias("heading"), F.lower("text").rlike(DATED).alias("dated"))
    good = 0.35 * F.col("m.valid_word_ratio") + 0.20 * (1 - F.col("m.odd_char_ratio")) + 0.10 * (1 - F.col("m.short_line_ratio")) + 0.15 * F.col("named") + 0.10 * F.col("heading") + F.when(F.col("dated"), 0.10).otherwise(0.0)
    bad = 0.35 * (1 - F.col("m.valid_word_ratio")) + 0.30 * F.col("m.odd_char_ratio") + 0.20 * F.col("m.short_line_ratio") + F.when(F.col("dated"), 0.0).otherwise(0.08) + F.when(F.col("named") < 0.15, 0.07).otherwise(0.0)
    one = lambda x: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)
    score, worst = one(F.when(F.col("alike").isNull(), good).otherwise(0.8 * good + 0.2 * F.col("alike"))), one(bad + F.coalesce(0.15 * (1 - F.col("alike")), F.lit(0.0)))
    advice = F.when(F.col("bad") >= 0.7, "reprocessar").when(F.col("bad") >= 0.4, "revisar").otherwise("manter")
    return c.select(ident, "m.*", "named", "heading", "dated", "alike", score.alias("historiographic"), worst.alias("bad")).withColumn("advice", advice)


def documents(e: Evidence) -> DataFrame:
    return judged(texts(e).withColumn("alike", F.lit(None).cast("double")), "doc_id")


def scanned(e: Evidence) -> DataFrame:
    """(path, text, fixed): the latest text of each page as scanned, and as corrected where there is one."""
    t = e.table("page_texts").withColumn("fixed", F.col("text_path").endswith("_corrigido.txt"))
    body = lambda c: F.max_by("body", F.when(F.col("fixed") == c, F.struct("ingested_at", F.length("body"), "body")))
    return t.groupBy(base_of("text_path").alias("path")).agg(body(False).alias("text"), body(True).alias("fixed")).where("path is not null")


def pages(e: Evidence) -> DataFrame:
    return judged(compared(scanned(e).where("text is not null"), "text", "fixed", "alike"), "path")


q("q_historio")(lambda e: documents(e).select("doc_id", "named", "heading", "dated", F.col("historiographic").alias("score")))
q("q_bad_page")(lambda e: pages(e).select("path", "alike", F.col("historiographic").alias("score"), "bad", "advice"))


@q("q_compare")
def q_compare(e: Evidence) -> DataFrame:
    """(path, selected, reason): whether the corrected text takes the place of the scanned one: by a strong gain, a moderate one without harm, or to rescue a bad one."""
    both = scanned(e).where("text is not null and fixed is not null")
    m = lambda c: F.struct(*[v.alias(k) for k, v in Q.ocr_metrics(T.clean_text(F.col(c))).items()])
    return both.select("path", m("text").alias("o"), m("fixed").alias("n")).select("path", new_wins().alias("w")).select(
        "path", F.when(F.col("w"), "new").otherwise("existing").alias("selected"), F.when(F.col("w"), "new_ocr_won").otherwise("existing_ocr_kept").alias("reason")
    )


def new_wins() -> Column:
    """Whether the metrics n of a new text win over those of the old one, o."""
    gain, valid = F.expr("round(n.score - o.score, 6)"), F.expr("round(n.valid_word_ratio - o.valid_word_ratio, 6)")
    odd, short, chars = F.expr("round(o.odd_char_ratio - n.odd_char_ratio, 6)"), F.expr("round(o.short_line_ratio - n.short_line_ratio, 6)"), F.expr("n.chars - o.chars")
    strong = (gain >= 0.035) & (valid >= 0.01) & (odd >= 0.004)
    moderate = (gain >= 0.02) & (valid >= 0.005) & (odd >= 0.002) & (short >= 0.02) & (chars >= -200)
    return strong | moderate | F.expr("(o.odd_char_ratio >= 0.025 or o.score <= 0.55) and n.score >= 0.8 and n.valid_word_ratio >= o.valid_word_ratio and n.chars >= greatest(80, 0.6 * o.chars)")


for _n, _c in (("flt_legible_name", Q.legible_name), ("flt_graph_legible", Q.legible_label), ("flt_merge_legible", Q.legible_for_merge)):
    q(_n)(lambda e, c=_c: e.table("entities").select("id", c(F.col("canonical_name")).alias("v")))


def noisy(e: Evidence) -> DataFrame:
    score, rules = Q.noise_of(F.col("type"), F.col("canonical_name"), F.col("attrs")["identity_status"], F.coalesce("hints", F.array().cast("array<string>")))
    return e.entities.select("id", "type", F.round(score, 2).alias("score"), F.array_join(F.array_distinct(rules), "|").alias("reasons"))


q("q_entity_noise")(lambda e: noisy(e).select("id", "score", (F.col("score") >= 0.45).alias("noise"), "reasons"))
q("er_noise")(lambda e: noisy(e).where("score >= 0.45").groupBy("type", "reasons").agg(long_count("entities"), F.max("score").alias("score")))

# benches of texts that were read and corrected in several ways


def variants(e: Evidence) -> DataFrame:
    """(path, label, delivered, text): every delivery of a page's text is a candidate reading of it."""
    t = e.table("page_texts").where("body is not null and text_path is not null")
    return t.select(base_of("text_path").alias("path"), F.when(F.col("text_path").endswith("_corrigido.txt"), "corrected").otherwise("scanned").alias("label"), F.col("ingested_at").alias("delivered"), F.col("body").alias("text"))


def measured(e: Evidence) -> DataFrame:
    return variants(e).select("path", "label", "delivered", *[v.alias(k) for k, v in Q.ocr_metrics(T.clean_text(F.col("text"))).items()])


q("ocr_variants")(lambda e: measured(e).withColumn("place", F.expr("row_number() over (partition by path order by score desc, valid_word_ratio desc, chars desc, label, delivered)")).select("path", "label", "score", "place"))
q("bench_ocr")(lambda e: measured(e).groupBy("label").agg(long_count("candidates"), *[F.round(F.avg(c), 4).alias(c) for c in ("score", "valid_word_ratio", "odd_char_ratio", "short_line_ratio")]))


@q("bench_correct")
def bench_correct(e: Evidence) -> DataFrame:
    """(path, changed, real_before, real_after): how much a correction changed and the share of real words before and after."""
    both = scanned(e).where("text is not null and fixed is not null").withColumn("real_after", F.round(Q.real_word_ratio(F.col("fixed")), 4))
    return compared(both, "text", "fixed", "alike").select("path", F.round(1 - F.col("alike"), 4).alias("changed"), F.round(Q.real_word_ratio(F.col("text")), 4).alias("real_before"), "real_after")
