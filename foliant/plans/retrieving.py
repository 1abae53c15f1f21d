"""Queries of retrieval: normal forms, likeness, lexical, vector and hybrid search, answers and metrics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.years import year_any
from foliant.operators import retrieval as R
from foliant.operators.search import exact_score
from foliant.plans.prelude import registrar
from foliant.plans.relational import long_count, top
from foliant.plans.textual import COS, neighbours
from foliant.sources.evidence import Evidence
from foliant.tables import arrow_map

reg, q = registrar()

ASKED = "busque informacoes sobre a Câmara Municipal do Arrecife Novo"
TOKENS = list(R.Profile.of(ASKED).tokens)


def texts(e: Evidence) -> DataFrame:
    return e.table("documents").where("text is not null")


def over_texts(df: DataFrame, ident: str, columns: list[str], value: Callable, kind: str = "double") -> DataFrame:
    """(ident, v): `value` of the columns of each row, in Arrow workers."""
    at = {"double": pa.float64(), "string": pa.string(), "long": pa.int64()}[kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [value(*x) for x in zip(*(b.column(k).to_pylist() for k in range(1, len(columns) + 1)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, at)], names=["id", "v"])

    rows = df.select(F.col(ident).alias("id"), *columns)
    return arrow_map(rows, run, f"id {dict(rows.dtypes)['id']}, v {kind}").withColumnRenamed("id", ident)


# normal forms

SPELT = "case t " + " ".join(f"when '{k}' then '{v}'" for k, v in T.TOKEN_SPELLING.items()) + " else t end"
PLAIN = "trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[‘’`´]', '''', 'g'), '\\bd''([a-z])', 'de \\1', 'g'), '[^a-z0-9'']+', ' ', 'g'))"
NORMAL = f"list_transform(string_split({PLAIN}, ' '), lambda t: {SPELT})"
STOPS = ", ".join(f"'{w}'" for w in T.STOPWORDS)
SIGNIFICANT = f"list_filter({NORMAL}, lambda t: length(t) >= 2 and t not in ({STOPS}))"
#: Letters that both engines fold alike: texts in other scripts are compared by rows only.
WESTERN = "not regexp_matches(text, '[^\\x00-\\xFF’‘—–“”…]')"
WESTERN_SPARK = "not text rlike '[^\\\\x00-\\\\xFF’‘—–“”…]'"


def western(e: Evidence) -> DataFrame:
    return texts(e).where(WESTERN_SPARK)


for _n, _sql, _c in (
    ("fn_normalize_text", f"array_to_string({NORMAL}, ' ')", T.normalize_text),
    ("fn_tokenize_sig", f"array_to_string({SIGNIFICANT}, ' ')", lambda c: F.array_join(T.significant_tokens(c), " ")),
    ("fn_focus_query", f"case when len({SIGNIFICANT}) > 0 then array_to_string({SIGNIFICANT}, ' ') else array_to_string({NORMAL}, ' ') end", T.focus_query),
):
    q(_n, f"select doc_id, md5({_sql}) v from documents where text is not null and {WESTERN}")(lambda e, c=_c: western(e).select("doc_id", F.md5(c(F.col("text"))).alias("v")))

FORMS = "case when w like '%s' and length(w) >= 5 then '|' || w[:-2] else '' end || case when w like '%es' and length(w) >= 6 then '|' || w[:-3] else '' end"


@q("fn_token_forms", f"select distinct w, w || {FORMS} forms from (select unnest(string_split(base_normalized_name, ' ')) w from entities where base_normalized_name is not null)")
def fn_token_forms(e: Evidence) -> DataFrame:
    """Each token of the names with its forms without a plural ending."""
    w = F.col("w")
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    forms = F.concat_ws("|", w, F.when(w.endswith("s") & (F.length(w) >= 5), cut(1)), F.when(w.endswith("es") & (F.length(w) >= 6), cut(2)))
    words = e.table("entities").where("base_normalized_name is not null").select(F.explode(F.split("base_normalized_name", " ")).alias("w"))
    return words.distinct().select("w", forms.alias("forms"))


@q("ir_profile")
def ir_profile(e: Evidence) -> DataFrame:
    """What a question is asked with: its normal form, tokens and variants in order."""
    p = R.Profile.of(ASKED)
    return e.spark.createDataFrame([(p.normal, "|".join(p.tokens), n, v) for n, v in enumerate(p.variants)], "normal string, tokens string, place int, variant string")


@q("set_variant_product", "select a || ' ' || b || ' ' || c v from (values ('dr'), ('doutor')) x(a0), lateral (select case a0 when 'dr' then 'doutor' else a0 end a), (values ('antonio')) y(b), (values ('botelho'), ('botelhos')) z(c) group by all")
def set_variant_product(e: Evidence) -> DataFrame:
    """All combinations of the tokens' variants, each once, the question itself among them."""
    return e.spark.createDataFrame([(v,) for v in R.Profile.of("Dr. Antonio Botelhos").variants], "v string")


# likeness

q("fn_seq_ratio")(lambda e: R.token_matches(R.words_of(e.table("documents"), "doc_id", "text").select("word"), TOKENS, 0.5))


@q("fn_text_sim")
def fn_text_sim(e: Evidence) -> DataFrame:
    """How alike the whole text of a page is as scanned and as corrected."""
    t = e.table("page_texts").withColumn("path", F.regexp_replace("text_path", r"_corrigido\.txt$", ".txt")).withColumn("corrected", F.col("text_path").endswith("_corrigido.txt"))
    body = lambda c: F.max_by("body", F.when(F.col("corrected") == c, F.struct("ingested_at", F.length("body"))))
    both = t.groupBy("path").agg(body(False).alias("scanned"), body(True).alias("fixed")).where("scanned is not null and fixed is not null")
    return R.compared(both, "scanned", "fixed", "v").select("path", "v")


q("fn_lcs_block")(lambda e: over_texts(texts(e).withColumn("t", T.normalize_text(F.col("text"))), "doc_id", ["t"], lambda t: R.common_block(t, "municipalidade").size, "long"))
q("fn_evidence_snippet")(lambda e: over_texts(texts(e), "doc_id", ["text"], lambda t: R.evidence_snippet(ASKED, t), "string"))


@q("ir_token_match")
def ir_token_match(e: Evidence) -> DataFrame:
    """For each text and token of the question the most alike word and its first place; the different words are compared once."""
    words = R.words_of(e.table("documents"), "doc_id", "text")
    near = words.join(R.token_matches(words.select("word"), TOKENS, 0.5), "word")
    best = F.max(F.struct("likeness", (-F.col("place")).alias("back"))).alias("b")
    return near.groupBy(F.col("id").alias("doc_id"), "token").agg(best).select("doc_id", "token", "b.likeness", (-F.col("b.back")).alias("place"))


AT = f"list_filter([coalesce(list_position(w, t), 0) for t in {TOKENS}], lambda x: x > 0)"
PLACES = f"select doc_id, w, {AT} as found from (select doc_id, {NORMAL} w from documents where text is not null and {WESTERN})"


def places(e: Evidence) -> DataFrame:
    words = F.split(T.normalize_text(F.col("text")), " ")
    found = F.filter(F.array(*[F.array_position(words, F.lit(t)) for t in TOKENS]), lambda x: x > 0)
    return western(e).select("doc_id", found.alias("found"))


ORDERED = "case when len(found) < 2 then 0.0::double when found = list_sort(found) then 1.0::double else 0.35::double end"
CLOSE = "case when len(found) < 2 then 0.0::double else 1 - least(list_max(found) - list_min(found) + 1, 40) / 40 end"


def ordered(c: str = "found") -> Column:
    return F.when(F.size(c) < 2, 0.0).when(F.col(c) == F.array_sort(c), 1.0).otherwise(0.35)


def close(c: str = "found") -> Column:
    return F.when(F.size(c) < 2, 0.0).otherwise(1 - F.least(F.array_max(c) - F.array_min(c) + 1, F.lit(40)) / 40)


q("fn_ordered_ratio", f"select doc_id, {ORDERED} v from ({PLACES})")(lambda e: places(e).select("doc_id", ordered().alias("v")))
q("fn_compactness", f"select doc_id, round({CLOSE}, 6) v from ({PLACES})")(lambda e: places(e).select("doc_id", F.round(close(), 6).alias("v")))
q("fn_clamp_round", "select doc_id, round(greatest(0.0, least(1.0, length(text) / 1000 - 0.2)), 3) v from documents where text is not null")(
    lambda e: texts(e).select("doc_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.length("text") / 1000 - 0.2)), 3).alias("v"))
)

# search

NEED = -(-6 * len(TOKENS) // 10)
EXACT = f"select doc_id, case when len(found) >= {NEED} then round(0.6::double * len(found) / {len(TOKENS)} + 0.2::double * case when contains(array_to_string(w, ' '), '{' '.join(TOKENS)}') then 1 else 0 end + 0.1::double * {ORDERED} + 0.1::double * {CLOSE}, 4) else 0 end score from ({PLACES})"


def exact(e: Evidence) -> DataFrame:
    """(doc_id, score) of the texts that hold enough tokens as they are."""
    return western(e).select("doc_id", F.round(exact_score(T.normalize_text(F.col("text")), TOKENS), 4).alias("score")).where("score > 0")


q("ir_score_exact", f"select * from ({EXACT}) where score > 0")(exact)
q("ir_score_text")(lambda e: R.lexical_search(e.table("documents"), "doc_id", "text", ASKED, None))
q("ir_lexical")(lambda e: R.lexical_search(e.table("documents"), "doc_id", "text", ASKED, 50))

NEAR_SQL = "select v.vec_id doc_id, round(greatest(0, list_cosine_similarity(q.embedding::double[], v.embedding::double[])), 3) score from embeddings q join embeddings v on q.vec_id = 1 and v.vec_id <> 1"


def nearness(e: Evidence) -> DataFrame:
    """(doc_id, score) of every vector to the vector of document 1, the question's; never below 0."""
    v = e.table("embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    asked = F.broadcast(v.where("vec_id = 1").select(F.col("v").alias("q")))  # one row
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return v.where("vec_id <> 1").join(asked).select(F.col("vec_id").alias("doc_id"), F.round(F.greatest(F.lit(0.0), dot("q", "v") / F.sqrt(dot("q", "q") * dot("v", "v"))), 3).alias("score"))


q("fn_cosine_score", NEAR_SQL)(nearness)
FETCH = 30
LISTS = f"a as (select doc_id, score t from ({EXACT}) where score > 0 order by score desc, doc_id limit {FETCH}), b as (select doc_id, score s from ({NEAR_SQL}) order by score desc, doc_id limit {FETCH})"
FUSED = "round(case when t is not null and s is not null then least(1.0::double, greatest(t, s) + 0.12::double * least(t, s) + 0.05::double) else greatest(coalesce(t, 0), coalesce(s, 0)) end, 6)"
MODE = "case when t is not null and s is not null then 'hibrida' when t is not null then 'textual_historico' else 'semantica' end"


def lists(e: Evidence) -> tuple[DataFrame, DataFrame]:
    return tuple(top(x, F.desc("score"), F.asc("doc_id"), n=FETCH) for x in (exact(e), nearness(e)))  # type: ignore[return-value]


q("jn_search_hybrid", f"with {LISTS} select doc_id, coalesce(t, 0)::double text_score, coalesce(s, 0)::double semantic_score from a full join b using (doc_id)")(
    lambda e: (lambda t, s: t.withColumnRenamed("score", "t").join(s.withColumnRenamed("score", "s"), "doc_id", "full_outer").select("doc_id", F.coalesce("t", F.lit(0.0)).alias("text_score"), F.coalesce("s", F.lit(0.0)).alias("semantic_score")))(*lists(e))
)
q("fn_hybrid_fuse", f"with {LISTS} select doc_id, {FUSED} score, {MODE} as mode from a full join b using (doc_id)")(lambda e: R.hybrid(*lists(e), "doc_id", 2 * FETCH).select("doc_id", "score", "mode"))
q("cq_search", f"with {LISTS} select doc_id, {FUSED} score, {MODE} as mode from a full join b using (doc_id) order by score desc, coalesce(t, 0) desc, coalesce(s, 0) desc, doc_id limit 10")(
    lambda e: R.hybrid(*lists(e), "doc_id", 10).select("doc_id", "score", "mode")
)
q("ir_hybrid")(lambda e: R.hybrid(R.lexical_search(e.table("documents"), "doc_id", "text", ASKED, FETCH), lists(e)[1], "doc_id", 10))
YEAR = "try_cast(nullif(regexp_extract(ano, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int)"
q("ir_api_search", f"select x.doc_id, x.score from ({EXACT}) x join documents d using (doc_id) where {YEAR.replace('ano', 'd.ano')} between 1820 and 1890 and x.score >= 0.45 order by x.score desc, x.doc_id limit 10")(
    lambda e: top(exact(e).join(texts(e).where(year_any(F.col("ano")).between(1820, 1890)).select("doc_id"), "doc_id", "left_semi").where("score >= 0.45"), F.desc("score"), F.asc("doc_id"), n=10)
)
PROBLEM = "case when text is null or trim(text) = '' then 'no text' when task is null or trim(task) = '' then 'no task' else '' end"
q("ir_cases", f"select item_id, task, {PROBLEM} problem from (select *, count(*) over (partition by item_id) k from benchmark_items) where k = 1 union all select item_id, min(task), 'repeated id' from benchmark_items group by 1 having count(*) > 1")(
    lambda e: e.table("benchmark_items").groupBy("item_id").agg(F.min("task").alias("task"), F.min("text").alias("text"), F.count("*").alias("k")).select("item_id", "task", F.when(F.col("k") > 1, "repeated id").otherwise(F.expr(PROBLEM)).alias("problem"))
)

# answers

BEST = f"select * from (select x.doc_id, x.score, d.source, d.bib, d.ano, left(d.text, 80) as snippet, row_number() over (order by x.score desc, x.doc_id) k from ({EXACT}) x join documents d using (doc_id) where x.score > 0) where k <= 8"


def sources(e: Evidence) -> DataFrame:
    """The eight best texts with their card and the head of their text, in order (k)."""
    best = top(exact(e), F.desc("score"), F.asc("doc_id"), n=8)
    rows = best.join(texts(e).select("doc_id", "source", "bib", "ano", F.left("text", F.lit(80)).alias("snippet")), "doc_id")
    return rows.withColumn("k", F.expr("row_number() over (order by score desc, doc_id)"))  # eight rows


q("ir_rag_context", f"select string_agg('[' || k || '] ' || source || ', ' || bib || ', ' || coalesce(ano, '?') || ': ' || snippet, ' --- ' order by k) context, count(*) sources from ({BEST})")(
    lambda e: sources(e).agg(F.array_sort(F.collect_list(F.struct("k", F.concat(F.lit("["), "k", F.lit("] "), "source", F.lit(", "), "bib", F.lit(", "), F.coalesce("ano", F.lit("?")), F.lit(": "), "snippet").alias("t")))).alias("c"))
    .select(F.array_join(F.transform("c", lambda x: x["t"]), " --- ").alias("context"), F.size("c").cast("long").alias("sources"))
)
#: The headings of an answer.
HEADINGS = ["Resumo interpretativo", "Pessoas e entidades citadas", "Evidências dos jornais", "Fontes"]


def section(n: int) -> str:
    """The pattern of what stands under a heading, up to the next one or the end."""
    later = "|".join(HEADINGS[n + 1 :])
    stop = rf"\n\s*(?:#+\s*)?(?:\d+\.\s*)?(?:{later})\s*:?\s*\n|\z" if later else r"\z"
    return rf"(?is)(?:^|\n)\s*(?:#+\s*)?(?:\d+\.\s*)?{HEADINGS[n]}\s*:?\s*\n(.*?)(?:{stop})"


#: An answer for each page: the place of a model's is taken by what is known of the page, under the same headings.
ANSWERS = f"""
select page_id, '1. {HEADINGS[0]}:' || chr(10) || 'A pagina nomeia ' || count(*) || ' nomes.' || chr(10) || chr(10) || '## {HEADINGS[1]}' || chr(10) || '- ' || string_agg(name, chr(10) || '* ' order by name)
  || chr(10) || '{HEADINGS[2]}:' || chr(10) || '• ' || min(name) || chr(10) || '{HEADINGS[3]}' || chr(10) || page_id answer
from (select page_id, canonical_name as name, row_number() over (partition by page_id order by canonical_name) k from (select distinct page_id, canonical_name from star)) where k <= 10 group by page_id"""


def answers(e: Evidence) -> DataFrame:
    names = e.star.select("page_id", F.col("canonical_name").alias("name")).distinct()
    names = names.withColumn("k", F.expr("row_number() over (partition by page_id order by name)")).where("k <= 10")
    g = names.groupBy("page_id").agg(F.array_sort(F.collect_list("name")).alias("n"))
    a = F.concat(
        F.lit(f"1. {HEADINGS[0]}:\nA pagina nomeia "), F.size("n").cast("string"), F.lit(f" nomes.\n\n## {HEADINGS[1]}\n- "), F.array_join("n", "\n* "),
        F.lit(f"\n{HEADINGS[2]}:\n• "), F.col("n")[0], F.lit(f"\n{HEADINGS[3]}\n"), F.col("page_id").cast("string"),
    )
    return g.select("page_id", a.alias("answer"))


def sql_section(n: int) -> str:
    return f"trim(regexp_extract(answer, '{section(n)}', 1), e' \\n\\r\\t')"


def spark_section(n: int) -> Column:
    return F.regexp_replace(F.regexp_extract("answer", section(n), 1), r"^\s+|\s+$", "")


def sql_bullets(of: str) -> str:
    return f"list_transform(list_filter(list_transform(string_split({of}, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: case when x[1] in ('-', '*', '•') then trim(x[2:]) else x end)"


def bullets(of: Column) -> Column:
    lines = F.filter(F.transform(F.split(of, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(lines, lambda x: F.when(F.left(x, F.lit(1)).isin("-", "*", "•"), F.trim(F.substring(x, 2, 100000))).otherwise(x))


q("fn_section", f"select page_id, {sql_section(0)} v from ({ANSWERS})")(lambda e: answers(e).select("page_id", spark_section(0).alias("v")))
q("fn_bulletize", f"select page_id, array_to_string({sql_bullets('answer')}, '|') v from ({ANSWERS})")(lambda e: answers(e).select("page_id", F.array_join(bullets(F.col("answer")), "|").alias("v")))
q("ir_rag_answer", f"select page_id, {sql_section(0)} summary, array_to_string({sql_bullets(sql_section(1))}, '|') people, array_to_string({sql_bullets(sql_section(2))}, '|') evidence, {sql_section(3)} sources from ({ANSWERS})")(
    lambda e: answers(e).select("page_id", spark_section(0).alias("summary"), *[F.array_join(bullets(spark_section(n)), "|").alias(c) for n, c in ((1, "people"), (2, "evidence"))], spark_section(3).alias("sources"))
)
q("cq_rag", f"select k::bigint k, source, bib, coalesce(ano, '?') ano, snippet from (select *, min(k) over (partition by bib, ano) m from ({BEST})) where k = m")(
    lambda e: sources(e).groupBy("bib", "ano").agg(F.min(F.struct("k", "source", "snippet")).alias("b")).select(F.col("b.k").cast("long").alias("k"), "b.source", "bib", F.coalesce("ano", F.lit("?")).alias("ano"), "b.snippet")
)

# metrics: a neighbour of the same label is a hit

RANKED = f"with r as (select * from (select *, row_number() over (partition by query order by score desc, neighbour) rank from ({COS})) where rank <= 5)"
PER_QUERY = RANKED + """, n as (select a.vec_id query, (select count(*) from embeddings b where b.label = a.label) - 1 n from embeddings a where a.vec_id % 20 = 0),
g as (select r.query, count(*) found, min(rank) first, sum(1 / log2(rank + 1)) dcg from r join embeddings a on a.vec_id = r.query join embeddings b on b.vec_id = r.neighbour and a.label = b.label group by 1),
m as (select n.query, case when found > 0 then 1.0::double else 0.0::double end hit, round(coalesce(found / n, 0), 6) recall, round(coalesce(1 / first, 0), 6) rr, coalesce(first, 0)::int first,
  round(coalesce(dcg, 0), 6) dcg, round(coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0), 6) ndcg from n left join g using (query) where n > 0)"""


def evaluated(e: Evidence) -> DataFrame:
    """(query, hit, recall, rr, first, dcg, ndcg) at 5. What is relevant is counted by label, never listed."""
    label = e.table("embeddings").select("vec_id", "label")
    size = label.groupBy("label").agg(F.count("*").alias("k"))
    asked = label.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), "label").join(size, "label").select("query", "label", (F.col("k") - 1).alias("n")).where("n > 0")
    hits = neighbours(e).where("rank <= 5").join(asked, "query").join(label.select(F.col("vec_id").alias("neighbour"), F.col("label").alias("own")), "neighbour").where("own = label")
    g = hits.groupBy("query").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("g"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(5)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    some = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return asked.join(g, "query", "left").select(
        "query", F.when(F.col("found") > 0, 1.0).otherwise(0.0).alias("hit"), some(F.col("found") / F.col("n")).alias("recall"), some(1 / F.col("first")).alias("rr"), F.coalesce("first", F.lit(0)).alias("first"), some(F.col("g")).alias("dcg"), some(F.col("g") / ideal).alias("ndcg")
    )


MEANS = [("hit", "hit"), ("recall", "recall"), ("rr", "mrr"), ("ndcg", "ndcg")]
q("ir_evaluate", PER_QUERY + " select query, hit, recall, rr, first, ndcg from m")(lambda e: evaluated(e).drop("dcg"))
q("fn_dcg", PER_QUERY + " select query, dcg from m")(lambda e: evaluated(e).select("query", "dcg"))
q("ir_aggregate", PER_QUERY + " select count(*) queries, " + ", ".join(f"round(avg({a}), 4) {b}" for a, b in MEANS) + " from m")(lambda e: evaluated(e).agg(long_count("queries"), *[F.round(F.avg(a), 4).alias(b) for a, b in MEANS]))
q("agg_ir_metrics", PER_QUERY + " select a.label, count(*) queries, count(*) filter (where m.first = 0) misses, " + ", ".join(f"round(avg({a}), 4) {b}" for a, b in MEANS) + " from m join embeddings a on a.vec_id = m.query group by 1")(
    lambda e: evaluated(e).join(e.table("embeddings").select(F.col("vec_id").alias("query"), "label"), "query").groupBy("label").agg(long_count("queries"), F.count_if(F.col("first") == 0).alias("misses"), *[F.round(F.avg(a), 4).alias(b) for a, b in MEANS])
)
