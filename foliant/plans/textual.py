"""Sources, text functions, quality, extraction, chunking, retrieval, sinks, graphs, registers and streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import quality as Q
from foliant.functions import text as T
from foliant.functions import years as Y
from foliant.operators.components import connected_components
from foliant.operators.graph import distances
from foliant.operators.search import exact_score, fused, fuzzy_search, ranking_metrics, vector_search
from foliant.plans import relational as R
from foliant.plans.prelude import with_star
from foliant.plans.relational import LEFT, RIGHT, alias_set, first_by, long_count, top
from foliant.registry import Registry
from foliant.sources.evidence import Evidence
from foliant.streaming import windows as S

reg = Registry()


def q(name: str, sql: str | None = None) -> Callable:
    def keep(build: Callable[[Evidence], DataFrame]) -> Callable:
        reg.add(name, lambda spark, d: build(Evidence(spark, d)), None if sql is None else with_star(sql))
        return build

    return keep


def docs(e: Evidence) -> DataFrame:
    return e.table("documents").where("text is not null")


def scalar(name: str, value: Callable[[], Column], sql: str) -> None:
    """A query of one function over all texts: doc_id and the value."""
    q(name, f"select doc_id, {sql} v from documents where text is not null")(lambda e: docs(e).select("doc_id", value().alias("v")))


def TEXT() -> Column:
    return F.col("text")


def NAMES() -> Column:
    return F.col("canonical_name")


COMPACT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"

# text functions

scalar("fn_compact_ws", lambda: F.md5(T.compact(TEXT())), f"md5({COMPACT})")
scalar("fn_truncate", lambda: F.left(TEXT(), F.lit(200)), "left(text, 200)")
scalar("fn_format_count", lambda: T.format_count(F.length(TEXT()) * 1000), "translate(format('{:,}', length(text) * 1000), ',', '.')")
scalar("fn_snippet_radius", lambda: T.snippet(TEXT(), F.lit("municipal")), f"case when instr(lower({COMPACT}), 'municipal') > 0 then case when instr(lower({COMPACT}), 'municipal') - 110 > 1 then '...' else '' end || substring({COMPACT}, greatest(instr(lower({COMPACT}), 'municipal') - 110, 1)::int, (least(instr(lower({COMPACT}), 'municipal') + 9 + 110, length({COMPACT}) + 1) - greatest(instr(lower({COMPACT}), 'municipal') - 110, 1))::int) || case when least(instr(lower({COMPACT}), 'municipal') + 9 + 110, length({COMPACT}) + 1) <= length({COMPACT}) then '...' else '' end else substring({COMPACT}, 1, 220) end")
scalar("q_real_words", lambda: F.round(Q.real_word_ratio(TEXT()), 6), "round(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '' and length(regexp_replace(w, '[^A-Za-zÀ-ÿ]', '', 'g')) >= 2)) / nullif(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')), 0), 6)")
q("fn_clean_text")(lambda e: docs(e).select("doc_id", T.clean_text(TEXT()).alias("v")))


def over_entities(name: str, value: Callable[[], Column], sql: str | None) -> None:
    q(name, None if sql is None else f"select id, {sql} v from entities")(lambda e: e.table("entities").select("id", value().alias("v")))


FOLD = "lower(strip_accents(canonical_name))"
over_entities("fn_strip_accents", lambda: T.strip_accents(NAMES()), "strip_accents(canonical_name)")
over_entities("fn_normalize_name", lambda: T.normalize_name(NAMES()), f"trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace({FOLD}, '’', ''''), '\\bd['' ]', 'de ', 'g'), 'benedicto', 'benedito'), 'affonso', 'afonso'), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
over_entities("fn_norm_parish", lambda: T.normalize_parish(NAMES()), f"trim(regexp_replace(regexp_replace(regexp_replace(trim({FOLD}), '\\bd['' ]\\b', 'de ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))")
over_entities("fn_slug", lambda: T.slug(T.strip_accents(NAMES())), "trim(regexp_replace(lower(strip_accents(canonical_name)), '[^a-z0-9._-]+', '-', 'g'), '-')")
over_entities("fn_page_url", lambda: F.concat(F.lit("/pagina?q="), T.url_quote(T.strip_accents(NAMES()))), "'/pagina?q=' || url_encode(strip_accents(canonical_name))")
over_entities("fn_node_ids", lambda: F.concat(F.lit("entity_"), F.col("id")), "'entity_' || id")
over_entities("fn_parse_year", lambda: Y.year_any(F.col("first_seen_year")), "try_cast(nullif(regexp_extract(first_seen_year, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int)")
over_entities("fn_year_sql", lambda: Y.year_strict(F.col("first_seen_year")), "case when regexp_matches(trim(regexp_replace(first_seen_year, '^(?i:ano) ', '')), '^[0-9]{4}$') then trim(regexp_replace(first_seen_year, '^(?i:ano) ', ''))::int end")
YA, YB = (f"try_cast(nullif(regexp_extract({x}, '(1[0-9]{{3}}|20[0-9]{{2}})', 1), '') as int)" for x in ("first_seen_year", "last_seen_year"))
over_entities("fn_format_period", lambda: Y.period(Y.year_any(F.col("first_seen_year")), Y.year_any(F.col("last_seen_year"))), f"case when {YA} = {YB} then {YA}::varchar when {YA} is not null and {YB} is not null then {YA} || ' a ' || {YB} when {YA} is not null then 'desde ' || {YA} when {YB} is not null then 'até ' || {YB} end")
over_entities("fn_merge_year", lambda: F.least(Y.year_any(F.col("first_seen_year")), Y.year_any(F.col("last_seen_year"))), f"least({YA}, {YB})")
over_entities("fn_years_compatible", lambda: Y.years_compatible(Y.year_any(F.col("first_seen_year")), Y.year_any(F.col("last_seen_year"))), f"coalesce(abs({YA} - {YB}) <= 60, true)")
over_entities("fn_decade", lambda: Y.decade(Y.year_any(F.col("first_seen_year"))), f"(({YA} // 10) * 10)::int")


@q("q_discovery_noise")
def q_discovery_noise(e: Evidence) -> DataFrame:
    s = F.round(Q.discovery_noise(F.col("type"), NAMES(), F.col("attrs")["identity_status"], F.coalesce("hints", F.array().cast("array<string>"))), 2)
    return e.entities.select("id", s.alias("score"), Q.is_discovery_noise(F.col("type"), s).alias("noise"))




@q("q_ocr_score")
def q_ocr_score(e: Evidence) -> DataFrame:
    return docs(e).select("doc_id", T.clean_text(TEXT()).alias("text")).select("doc_id", *[v.alias(k) for k, v in Q.ocr_metrics(TEXT()).items()])


def candidates(e: Evidence) -> DataFrame:
    """Each delivery of a page's text as an OCR candidate with its metrics."""
    cleaned = e.table("page_texts").select("text_path", T.clean_text(F.coalesce("body", F.lit(""))).alias("text"))
    return cleaned.select(base_of("text_path").alias("path"), "text_path", *[v.alias(k) for k, v in Q.ocr_metrics(TEXT()).items()])


@q("q_select_best")
def q_select_best(e: Evidence) -> DataFrame:
    return candidates(e).where("chars > 0").groupBy("path").agg(F.max(F.struct("score", "valid_word_ratio", "chars", "text_path")).alias("b")).select("path", "b.*")


q("flt_legible_chunk")(lambda e: docs(e).select("doc_id", F.when(F.length("text") < 10, False).when(F.size(F.split(TEXT(), r"\s+")) < 30, True).otherwise(Q.real_word_ratio(TEXT(), 3) >= 0.35).alias("legible")))

# sources


def base_of(c: str) -> Column:
    return F.regexp_replace(c, r"_corrigido\.txt$", ".txt")


q("src_pending", "select distinct text_path from page_texts p where text_path not like '%\\_corrigido.txt' escape '\\' and not exists (select 1 from page_texts c where c.text_path = regexp_replace(p.text_path, '[.]txt$', '_corrigido.txt'))")(
    lambda e: e.table("page_texts").where(~F.col("text_path").endswith("_corrigido.txt")).select("text_path").distinct().join(
        e.table("page_texts").where(F.col("text_path").endswith("_corrigido.txt")).select(base_of("text_path").alias("text_path")), "text_path", "left_anti")
)
q("src_ocr_tasks", "select id, image_path from pages p where image_path is not null and not exists (select 1 from page_texts t where t.text_path = p.text_path)")(
    lambda e: e.table("pages").where("image_path is not null").select("id", "image_path", "text_path").join(e.table("page_texts").select("text_path"), "text_path", "left_anti").select("id", "image_path")
)
q("src_page_lookup", "select id, text_path from pages where bib = (select min(bib) from pages) and pagina like '0000%1'")(
    lambda e: e.pages.where("pagina like '0000%1'").join(F.broadcast(e.pages.agg(F.min("bib").alias("bib"))), "bib", "left_semi").select("id", "text_path")
)
q("src_page_fallback", "select p.id, coalesce(c.text_path, r.text_path) text_path from pages p left join (select distinct text_path from page_texts) r on r.text_path = p.text_path left join (select distinct text_path from page_texts) c on c.text_path = regexp_replace(p.text_path, '[.]txt$', '_corrigido.txt')")(
    lambda e: (lambda f: e.table("pages").select("id", "text_path").withColumn("corr", F.regexp_replace("text_path", r"\.txt$", "_corrigido.txt")).join(f.select(F.col("text_path").alias("corr"), F.lit(1).alias("has_c")), "corr", "left")
               .join(f.select("text_path", F.lit(1).alias("has_r")), "text_path", "left").select("id", F.coalesce(F.when(F.col("has_c") == 1, F.col("corr")), F.when(F.col("has_r") == 1, F.col("text_path"))).alias("text_path")))(e.table("page_texts").select("text_path").distinct())
)
q("src_catalog_crawl", "select bib, arg_min(jornal, id) jornal from pages where jornal is not null group by 1")(lambda e: e.pages.where("jornal is not null").groupBy("bib").agg(F.min_by("jornal", "id").alias("jornal")))
for _n in ("src_catalog_list",):
    q(_n, "select bib, max(jornal) nome, count(*) paginas from pages group by 1")(R.cq_catalog)

# chunking

q("ch_fixed", "select doc_id, g.i::int chunk, md5(substring(text, (g.i * 800 + 1)::int, 1000)) chunk_md5 from documents, range(0, greatest(1, ceil((length(text) - 200) / 800))::int) g(i) where text is not null")(
    lambda e: docs(e).select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil((F.length("text") - 200) / 800)).cast("int") - 1)).alias("chunk")).select("doc_id", "chunk", F.md5(F.expr("substring(text, chunk * 800 + 1, 1000)")).alias("chunk_md5")))
q("ch_two_window", "select doc_id, 0 part, left(text, 6000) piece from documents where text is not null union all select doc_id, 1, substring(text, 5501) from documents where length(text) > 6000")(
    lambda e: docs(e).select("doc_id", F.left(TEXT(), F.lit(6000)).alias("a"), F.when(F.length(TEXT()) > 6000, F.expr("substring(text, 5501)")).alias("b")).select("doc_id", F.posexplode(F.filter(F.array("a", "b"), lambda x: x.isNotNull())).alias("part", "piece")))


@q("ch_paragraph")
def ch_paragraph(e: Evidence) -> DataFrame:
    """Paragraphs packed into pieces of at most 1,000 characters, greedily; a longer paragraph stays whole."""
    paragraphs = F.filter(F.split(TEXT(), r"\n\s*\n"), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    join = lambda s, x: F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit("\n\n"), x))
    fits = lambda s, x: (s["now"] == "") | (F.length(s["now"]) + 2 + F.length(x) <= 1000)
    step = lambda s, x: F.struct(F.when(fits(s, x), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits(s, x), join(s, x)).otherwise(x).alias("now"))
    packed = F.aggregate(paragraphs, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda x: x != ""))
    return docs(e).select("doc_id", F.posexplode(packed).alias("chunk", "piece"))


@q("ch_recursive")
def ch_recursive(e: Evidence) -> DataFrame:
    """Recursive splitting for texts within limits of a line: paragraphs, then lines, then sentences packed up to 1,000 characters."""
    pieces = F.filter(F.split(TEXT(), r"\n\s*\n|\n|(?<=\. )"), lambda x: F.trim(x) != "")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"))
    fits = lambda s, x: (s["now"] == "") | (F.length(s["now"]) + 1 + F.length(x) <= 1000)
    tail = lambda s: F.element_at(F.split(s, r"(?<=\. )"), -1)
    carried = lambda s: F.when(F.length(tail(s["now"])) <= 200, tail(s["now"])).otherwise("")
    step = lambda s, x: F.struct(F.when(fits(s, x), s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits(s, x), F.trim(F.concat_ws(" ", s["now"], x))).otherwise(F.trim(F.concat_ws(" ", carried(s), x))).alias("now"))
    packed = F.aggregate(pieces, start, step, lambda s: F.filter(F.concat(s["done"], F.array(s["now"])), lambda x: x != ""))
    return docs(e).select("doc_id", F.posexplode(packed).alias("chunk", "piece"))


q("ch_doc")(lambda e: ch_recursive(e).select("doc_id", "chunk", F.concat(F.lit("d"), "doc_id", F.lit("_chunk"), "chunk").alias("id"), F.length("piece").alias("n")))

# retrieval

COS = "select q.vec_id query, v.vec_id neighbour, round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) score from embeddings q join embeddings v on q.vec_id <> v.vec_id where q.vec_id % 20 = 0"


def neighbours(e: Evidence) -> DataFrame:
    """Every vector whose id is divisible by 20 is a query against all vectors."""
    v = e.table("embeddings").select("vec_id", "embedding")
    return vector_search(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding")


for _n in ("ir_vector",):
    q(_n, f"select query, neighbour, score, rank from (select *, (row_number() over (partition by query order by score desc, neighbour))::int as rank from ({COS})) where rank <= 10")(neighbours)
q("ir_index_stats", "select count(*) vectors, count(distinct label) labels from embeddings")(lambda e: e.table("embeddings").agg(long_count("vectors"), F.count_distinct("label").alias("labels")))
# sinks as set transforms

MKEY = ["entity_id", "page_id", "chunk_id", "surface_form"]
q("snk_upsert_relation", "select subject_entity_id, predicate, coalesce(object_entity_id, 0) object_id, coalesce(object_literal, '') literal, max(confidence) confidence, arg_max(status, id) status, min(id) id from relations group by 1, 2, 3, 4")(
    lambda e: e.relations.groupBy("subject_entity_id", "predicate", F.coalesce("object_entity_id", F.lit(0)).alias("object_id"), F.coalesce("object_literal", F.lit("")).alias("literal")).agg(F.max("confidence").alias("confidence"), F.max_by("status", "id").alias("status"), F.min("id").alias("id")))
MERGE = "with lm as (select least(source_entity_id, target_entity_id) a, greatest(source_entity_id, target_entity_id) b, arg_max(review_status, id) s from entity_merge_reviews group by 1, 2), ed as (select a u, b v from lm where s = 'approved' and a <> b union select b, a from lm where s = 'approved' and a <> b), h1 as (select u, least(u, min(v)) c from ed group by 1), h2 as (select e.u, least(min(h.c), any_value(g.c)) c from ed e join h1 h on h.u = e.v join h1 g on g.u = e.u group by 1), h3 as (select e.u, least(min(h.c), any_value(g.c)) c from ed e join h2 h on h.u = e.v join h2 g on g.u = e.u group by 1), h4 as (select e.u, least(min(h.c), any_value(g.c)) c from ed e join h3 h on h.u = e.v join h3 g on g.u = e.u group by 1), h5 as (select e.u, least(min(h.c), any_value(g.c)) c from ed e join h4 h on h.u = e.v join h4 g on g.u = e.u group by 1), h6 as (select e.u, least(min(h.c), any_value(g.c)) c from ed e join h5 h on h.u = e.v join h5 g on g.u = e.u group by 1), re as (select m.id, coalesce(h.c, m.entity_id) target, m.page_id, m.chunk_id, m.surface_form from entity_mentions m left join h6 h on h.u = m.entity_id)"


def merge_map(e: Evidence) -> DataFrame:
    """(node, component): entities under approved merges and what they become, chains followed to the end."""
    last = e.table("entity_merge_reviews").groupBy(F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b")).agg(F.max_by("review_status", "id").alias("s"))
    return connected_components(last.where("s = 'approved'"), "a", "b")



# graphs

NODES = "select type, count(*) nodes from (select 'person_or_place' type, id::varchar id from act union all select 'page', id::varchar from pages union all select 'publication', bib from (select distinct bib from pages) union all select 'literal', l from (select distinct predicate || '_' || lower(object_literal) l from relations where object_entity_id is null and predicate is not null and object_literal is not null)) group by 1"


def graph_nodes(e: Evidence) -> DataFrame:
    lit = e.relations.where("object_entity_id is null").select(F.lit("literal").alias("type"), F.concat("predicate", F.lit("_"), F.lower("object_literal")).alias("id")).where("id is not null").distinct()
    return e.active.select(F.lit("person_or_place").alias("type"), F.col("id").cast("string").alias("id")).union(e.pages.select(F.lit("page"), F.col("id").cast("string"))).union(e.pages.select(F.lit("publication"), "bib").distinct()).union(lit)


for _n in ("gr_build_nodes",):
    q(_n, NODES)(lambda e: graph_nodes(e).groupBy("type").agg(long_count("nodes")))
q("gr_build_edges", "select distinct entity_id src, page_id dst, 'mentioned_in' predicate from entity_mentions union all select distinct subject_entity_id, object_entity_id, predicate from relations where object_entity_id is not null")(
    lambda e: e.mentions.select(F.col("entity_id").alias("src"), F.col("page_id").alias("dst"), F.lit("mentioned_in").alias("predicate")).distinct().union(e.relations.where("object_entity_id is not null").select("subject_entity_id", "object_entity_id", "predicate").distinct()))
q("gr_filter", "select id from relations where predicate in ('spouse_of', 'child_of', 'parent_of') and confidence >= 0.3")(lambda e: e.relations.where("predicate in ('spouse_of', 'child_of', 'parent_of') and confidence >= 0.3").select("id"))
LAYER = {"family": ["child_of", "parent_of", "widow_of", "spouse_of"], "roles": ["holds_role", "appointed_to"], "justice": ["accused_of", "absolved", "victim_of"], "slavery": ["slave_of"], "residence": ["resident_of"], "events": ["deceased", "signed_by"]}
LAYER_SQL = "case " + " ".join(f"when predicate in ({', '.join(repr(p) for p in ps)}) then '{k}'" for k, ps in LAYER.items()) + " end"


def layer_of(p: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, ps in LAYER.items():
        out = F.when(p.isin(*ps), k).otherwise(out)
    return out


q("gr_layer_of", f"select id, {LAYER_SQL} layer from relations")(lambda e: e.relations.select("id", layer_of(F.col("predicate")).alias("layer")))
q("gr_layered", f"select layer, id from (select id, {LAYER_SQL} layer, confidence from relations) where layer is not null and confidence >= 0.4 qualify row_number() over (partition by layer order by confidence desc, id) <= 30")(
    lambda e: first_by(e.relations.select("id", layer_of(F.col("predicate")).alias("layer"), "confidence").where("layer is not null and confidence >= 0.4"), ["layer"], F.desc("confidence"), F.asc("id"), n=30).select("layer", "id"))
q("gr_featured", f"select a, b, shared from ({R.CO_SQL}) where a in (select id from act where type = 'person') and b in (select id from act where type = 'person') order by shared desc, a, b limit 25")(
    lambda e: (lambda p: top(R.co_mentions(e).join(p.withColumnRenamed("id", "a"), "a", "left_semi").join(p.withColumnRenamed("id", "b"), "b", "left_semi").select("a", "b", "shared"), F.desc("shared"), F.asc("a"), F.asc("b"), n=25))(e.active.where("type = 'person'").select("id")))
q("gr_edge_evidence", f"select a.page_id, a.id a, b.id b from (select page_id, arg_max(id, (coalesce(confidence, -1), -id)) id from entity_mentions where entity_id = {LEFT} group by 1) a join (select page_id, arg_max(id, (coalesce(confidence, -1), -id)) id from entity_mentions where entity_id = {RIGHT} group by 1) b using (page_id)")(
    lambda e: (lambda f: f(LEFT, "a").join(f(RIGHT, "b"), "page_id"))(lambda n, name: e.mentions.where(f"entity_id = {n}").groupBy("page_id").agg(F.max_by("id", F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("id"))).alias(name))))


def walk(name: str, edge_sql: str, start_sql: str, depth: int, edges: Callable, start: Callable) -> None:
    """A traversal of so many hops, and its SQL with one CTE a hop."""
    sql = f"with ed(src, dst) as ({edge_sql}), d0 as ({start_sql})"
    for k in range(1, depth + 1):
        sql += f", d{k} as (select dst node from ed where src in (select node from d{k - 1}))"
    sql += " select node, min(hops)::int hops from (" + " union all ".join(f"select node, {k} hops from d{k}" for k in range(depth + 1)) + ") where node is not null group by 1"
    q(name, sql)(lambda e: distances(edges(e), start(e), depth))


OUT_SQL = "select subject_entity_id, object_entity_id from relations where object_entity_id is not null"
FAM_SQL = "select subject_entity_id, object_entity_id from relations where predicate in ('child_of', 'parent_of', 'spouse_of', 'widow_of') and object_entity_id is not null union select object_entity_id, subject_entity_id from relations where predicate in ('child_of', 'parent_of', 'spouse_of', 'widow_of') and object_entity_id is not null"


def out_edges(e: Evidence) -> DataFrame:
    return e.relations.where("object_entity_id is not null").select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"))


def family_edges(e: Evidence) -> DataFrame:
    f = e.relations.where("predicate in ('child_of', 'parent_of', 'spouse_of', 'widow_of') and object_entity_id is not null").select(F.col("subject_entity_id").alias("src"), F.col("object_entity_id").alias("dst"))
    return f.union(f.select("dst", "src")).distinct()


for _n in ("gr_ego",):
    walk(_n, OUT_SQL, f"select {LEFT}::bigint node", 2, out_edges, lambda e: e.table("entities").where(f"id = {LEFT}").select(F.col("id").alias("node")))
for _n in ("gr_family_tree",):
    walk(_n, FAM_SQL, "select min(subject_entity_id) node from relations where predicate = 'child_of' and object_entity_id is not null", 3, family_edges, lambda e: e.relations.where("predicate = 'child_of' and object_entity_id is not null").agg(F.min("subject_entity_id").alias("node")))

# streams

#: Windows that the watermark, a day behind the last event, has passed.
CLOSED = "(select max(ts) - interval 1 day from events)"
reg.add("st_tumbling", S.tumbling_counts, f"select time_bucket(interval '1 hour', ts) start, event_type, count(*) events from events group by 1, 2 having start + interval 1 hour <= {CLOSED}")
reg.add("st_sliding", S.sliding_counts, f"select time_bucket(interval '1 hour', ts) - to_hours(k) start, count(*) events from events, range(0, 2) r(k) group by 1 having start + interval 2 hours <= {CLOSED}")
reg.add("st_first_seen", S.first_seen, "select distinct event_id from events")
reg.add(
    "st_sessions", S.user_sessions,
    f"select user_id, min(ts) start, count(*) events from (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) n from (select user_id, ts, case when lag(ts) over (partition by user_id order by ts) > ts - interval 30 minutes then 0 else 1 end fresh from events)) group by user_id, n having max(ts) + interval 30 minutes <= {CLOSED}",
)


def register(to: Registry) -> None:
    for name, build in reg.builders.items():
        to.add(name, build, reg.sql.get(name))


