"""Filters, joins, aggregates, windows, tops and set operations over the evidence star."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.years import period, year_any
from foliant.plans.prelude import with_star
from foliant.registry import Registry
from foliant.sources.evidence import Evidence, latest

#: Entities that the queries about one or two entities are asked for.
LEFT, RIGHT = 1, 2
N = 20

reg = Registry()


def q(name: str, sql: str | None = None) -> Callable:
    """Register a builder that takes the evidence."""

    def keep(build: Callable[[Evidence], DataFrame]) -> Callable:
        reg.add(name, lambda spark, d: build(Evidence(spark, d)), None if sql is None else with_star(sql))
        return build

    return keep


def long_count(name: str, c: str | Column = "*") -> Column:
    return F.count(c).cast("long").alias(name)


def top(df: DataFrame, *order: Column, n: int = N) -> DataFrame:
    return df.orderBy(*order).limit(n)


def first_by(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The n first rows of each key; Spark cuts each partition to n before the shuffle."""
    return df.withColumn("rank_", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank_") <= n).drop("rank_")


# filters


@q("flt_scope", "select count(*) pages from pg where bib = (select min(bib) from pages) and yr between 1820 and 1880")
def flt_scope(e: Evidence) -> DataFrame:
    return scope(e.pages, year_from=1820, year_to=1880).join(e.pages.agg(F.min("bib").alias("bib")), "bib", "left_semi").agg(long_count("pages"))


def scope(pages: DataFrame, bib: str | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """The pages within the given bounds; a bound on the year drops pages without one."""
    for ok in [F.col("bib") == bib if bib else None, F.col("yr") >= year_from if year_from else None, F.col("yr") <= year_to if year_to else None]:
        pages = pages if ok is None else pages.where(ok)
    return pages


@q("flt_year_results", "select doc_id, try_cast(nullif(regexp_extract(ano, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int) yr from documents where try_cast(nullif(regexp_extract(ano, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int) between 1830 and 1860")
def flt_year_results(e: Evidence) -> DataFrame:
    return e.table("documents").select("doc_id", year_any(F.col("ano")).alias("yr")).where("yr between 1830 and 1860")


@q("flt_active", "select id, eff from act")
def flt_active(e: Evidence) -> DataFrame:
    return e.active.select("id", "eff")


@q("flt_effective_row", "select id, coalesce(attrs->>'effective_identity_status', attrs->>'identity_status', 'resolved') status from ent")
def flt_effective_row(e: Evidence) -> DataFrame:
    return e.entities.select("id", F.coalesce(F.col("attrs")["effective_identity_status"], F.col("attrs")["identity_status"], F.lit("resolved")).alias("status"))


@q("flt_like_entity", "select id from entities where base_normalized_name ilike '%camara%' or canonical_name ilike '%camara%' or aliases_json ilike '%camara%'")
def flt_like_entity(e: Evidence) -> DataFrame:
    return e.table("entities").where("base_normalized_name ilike '%camara%' or canonical_name ilike '%camara%' or aliases_json ilike '%camara%'").select("id")


@q("flt_like_reverse", "select id from entities where contains('camara municipal do arrecife novo de pernambuco', base_normalized_name)")
def flt_like_reverse(e: Evidence) -> DataFrame:
    return e.table("entities").where(F.contains(F.lit("camara municipal do arrecife novo de pernambuco"), F.col("base_normalized_name"))).select("id")


@q("flt_keywords_or", "select id from entities where regexp_matches(lower(canonical_name), 'companhia|camara|mesa')")
def flt_keywords_or(e: Evidence) -> DataFrame:
    return e.table("entities").where(F.lower("canonical_name").rlike("companhia|camara|mesa")).select("id")


@q("flt_in_list", "select id, entity_id from entity_mentions where entity_id in (select id from entities where type = 'place')")
def flt_in_list(e: Evidence) -> DataFrame:
    return e.mentions.select("id", "entity_id").join(e.table("entities").where("type = 'place'").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").select("id", "entity_id")


@q("flt_not_exists", "select id from entities e where not exists (select 1 from rev r where r.entity_id = e.id)")
def flt_not_exists(e: Evidence) -> DataFrame:
    return e.table("entities").select("id").join(e.identity_reviews.select(F.col("entity_id").alias("id")), "id", "left_anti")


@q("flt_exists_json_text", "select id from ent where attrs->>'identity_status' in ('ambiguous', 'contextual')")
def flt_exists_json_text(e: Evidence) -> DataFrame:
    return e.entities.where(F.col("attrs")["identity_status"].isin("ambiguous", "contextual")).select("id")


@q("flt_chunk_minlen", "select doc_id from documents where length(trim(text)) >= 50")
def flt_chunk_minlen(e: Evidence) -> DataFrame:
    return e.table("documents").where("length(trim(text)) >= 50").select("doc_id")


@q("flt_score_min", "select id, confidence from entity_mentions where confidence >= 0.45 order by confidence desc, id limit 50")
def flt_score_min(e: Evidence) -> DataFrame:
    return top(e.mentions.where("confidence >= 0.45").select("id", "confidence"), F.desc("confidence"), F.asc("id"), n=50)


@q("flt_generic_journal", "select id, case when lower(trim(jornal)) in ('', '?') or lower(trim(jornal)) = 'acervo ' || bib then null else jornal end jornal from pages")
def flt_generic_journal(e: Evidence) -> DataFrame:
    j = F.lower(F.trim("jornal"))
    return e.pages.select("id", F.when(~(j.isin("", "?") | (j == F.concat(F.lit("acervo "), "bib"))), F.col("jornal")).alias("jornal"))


@q("flt_head_tail_label", "select id, regexp_replace(trim(ano), '^(?i:ano) ', '') ano, regexp_replace(trim(edicao), '^(?i:edição) ', '') edicao from pages")
def flt_head_tail_label(e: Evidence) -> DataFrame:
    return e.pages.select("id", F.regexp_replace(F.trim("ano"), "^(?i)ano ", "").alias("ano"), F.regexp_replace(F.trim("edicao"), "^(?iu)edição ", "").alias("edicao"))


@q("flt_editorial_name", "select p.id, coalesce(nullif(nullif(trim(p.jornal), '?'), ''), c.nome) nome from pages p left join (select bib, mode(jornal) filter (where jornal not in ('', '?')) m, max(jornal) filter (where trim(jornal) not in ('', '?')) nome from pages group by bib) c using (bib)")
def flt_editorial_name(e: Evidence) -> DataFrame:
    names = e.pages.where("trim(jornal) not in ('', '?')").groupBy("bib").agg(F.max("jornal").alias("nome"))
    return e.pages.join(names, "bib", "left").select("id", F.coalesce(F.nullif(F.nullif(F.trim("jornal"), F.lit("?")), F.lit("")), "nome").alias("nome"))


# joins


@q("jn_mention_page", "select p.bib, count(*) mentions from entity_mentions m join pg p on m.page_id = p.id group by 1")
def jn_mention_page(e: Evidence) -> DataFrame:
    return e.mentions.select("page_id").join(e.pages.select(F.col("id").alias("page_id"), "bib"), "page_id").groupBy("bib").agg(long_count("mentions"))


@q("jn_mention_entity_page", "select type, bib, count(*) mentions from star group by 1, 2")
def jn_mention_entity_page(e: Evidence) -> DataFrame:
    return e.star.groupBy("type", "bib").agg(long_count("mentions"))


@q("jn_entity_left", "select e.id, count(m.id) mentions from entities e left join entity_mentions m on m.entity_id = e.id group by 1")
def jn_entity_left(e: Evidence) -> DataFrame:
    counts = e.mentions.groupBy("entity_id").agg(F.count("id").alias("mentions"))
    return e.table("entities").select("id").join(counts, F.col("id") == F.col("entity_id"), "left").select("id", F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


@q("jn_rel_endpoints", "select r.id, s.canonical_name subject, r.predicate, coalesce(o.canonical_name, r.object_literal) object from relations r join entities s on s.id = r.subject_entity_id left join entities o on o.id = r.object_entity_id")
def jn_rel_endpoints(e: Evidence) -> DataFrame:
    return endpoints(e).select("id", "subject", "predicate", "object")


def endpoints(e: Evidence) -> DataFrame:
    """Relations with the names of both ends; a literal stands for a missing object."""
    n = e.table("entities").select("id", "canonical_name")
    s = n.select(F.col("id").alias("subject_entity_id"), F.col("canonical_name").alias("subject"))
    o = n.select(F.col("id").alias("object_entity_id"), F.col("canonical_name").alias("o"))
    return e.relations.join(s, "subject_entity_id").join(o, "object_entity_id", "left").withColumn("object", F.coalesce("o", "object_literal")).drop("o")


@q("jn_rel_evidence", "select r.id, count(v.page_id) evidences, count(p.yr) dated from relations r left join evd v on v.relation_id = r.id left join pg p on p.id = v.page_id group by 1")
def jn_rel_evidence(e: Evidence) -> DataFrame:
    v = e.evidence.join(e.pages.select(F.col("id").alias("page_id"), "yr"), "page_id", "left").groupBy("relation_id").agg(F.count("page_id").alias("a"), F.count("yr").alias("b"))
    return e.relations.select("id").join(v, F.col("id") == F.col("relation_id"), "left").select("id", F.coalesce("a", F.lit(0)).cast("long").alias("evidences"), F.coalesce("b", F.lit(0)).cast("long").alias("dated"))


def ends(e: Evidence) -> DataFrame:
    """(entity_id, id, predicate): one row for each end of a relation, instead of a join on either end."""
    return e.relations.select("id", "predicate", F.explode(F.array_distinct(F.array("subject_entity_id", "object_entity_id"))).alias("entity_id")).where("entity_id is not null")


@q("jn_or_endpoint", "select e.id, count(distinct r.id) relations from entities e join relations r on r.subject_entity_id = e.id or r.object_entity_id = e.id group by 1")
def jn_or_endpoint(e: Evidence) -> DataFrame:
    return ends(e).join(e.table("entities").select(F.col("id").alias("entity_id")), "entity_id", "left_semi").groupBy(F.col("entity_id").alias("id")).agg(F.count_distinct("id").alias("relations"))


def co_mentions(e: Evidence, least: int = 2) -> DataFrame:
    """(a, b, shared): entities named on `least` pages together, each pair once, from distinct (page, entity) rows of the entities that are named on so many pages at all."""
    m = e.mentions.select("page_id", "entity_id").distinct()
    m = m.join(m.groupBy("entity_id").agg(F.count("*").alias("k")).where(F.col("k") >= least).select("entity_id"), "entity_id", "left_semi")
    a, b = m.withColumnRenamed("entity_id", "a"), m.withColumnRenamed("entity_id", "b")
    return a.join(b, "page_id").where("a < b").groupBy("a", "b").agg(long_count("shared")).where(F.col("shared") >= least)


CO_SQL = "select m1.entity_id a, m2.entity_id b, count(distinct m1.page_id) shared from entity_mentions m1 join entity_mentions m2 on m1.page_id = m2.page_id and m1.entity_id < m2.entity_id group by 1, 2 having shared >= 2"
for _name in ("jn_self_comention", "agg_comention_pairs"):
    q(_name, CO_SQL)(co_mentions)


def anchor_pages(e: Evidence, entity: int) -> DataFrame:
    return e.mentions.where(F.col("entity_id") == entity).select("page_id").distinct()


@q("jn_self_anchor", f"select m2.entity_id, count(distinct m2.page_id) pages from entity_mentions m1 join entity_mentions m2 on m1.page_id = m2.page_id and m2.entity_id <> m1.entity_id where m1.entity_id = {LEFT} group by 1")
def jn_self_anchor(e: Evidence) -> DataFrame:
    return e.mentions.where(f"entity_id <> {LEFT}").join(anchor_pages(e, LEFT), "page_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("page_id").alias("pages"))


TRIPLE = f"select entity_id, count(distinct page_id) pages from entity_mentions where entity_id not in ({LEFT}, {RIGHT}) and page_id in (select page_id from entity_mentions where entity_id = {LEFT}) and page_id in (select page_id from entity_mentions where entity_id = {RIGHT}) group by 1"


def bridges(e: Evidence) -> DataFrame:
    """Entities on the pages that name both."""
    m = e.mentions.where(f"entity_id not in ({LEFT}, {RIGHT})")
    return m.join(anchor_pages(e, LEFT), "page_id", "left_semi").join(anchor_pages(e, RIGHT), "page_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("page_id").alias("pages"))


for _name in ("jn_triple_bridge", "agg_bridges"):
    q(_name, TRIPLE)(bridges)


@q("jn_both_directions", "select least(subject_entity_id, object_entity_id) a, greatest(subject_entity_id, object_entity_id) b, count(*) relations from relations where object_entity_id is not null group by 1, 2")
def jn_both_directions(e: Evidence) -> DataFrame:
    r = e.relations.where("object_entity_id is not null")
    return r.groupBy(F.least("subject_entity_id", "object_entity_id").alias("a"), F.greatest("subject_entity_id", "object_entity_id").alias("b")).agg(long_count("relations"))


@q("jn_enrich", "select d.doc_id, coalesce(c.nome, d.source) nome from documents d left join (select bib, max(jornal) filter (where trim(jornal) not in ('', '?')) nome from pages group by 1) c using (bib)")
def jn_enrich(e: Evidence) -> DataFrame:
    names = e.pages.where("trim(jornal) not in ('', '?')").groupBy("bib").agg(F.max("jornal").alias("nome"))
    return e.table("documents").select("doc_id", "bib", "source").join(names, "bib", "left").select("doc_id", F.coalesce("nome", "source").alias("nome"))


LATEST_BODY = "select regexp_replace(text_path, '_corrigido[.]txt$', '.txt') path, max(case when text_path like '%\\_corrigido.txt' escape '\\' then 1 else 0 end) corrected, arg_max(coalesce(body, ''), (text_path like '%\\_corrigido.txt' escape '\\', ingested_at, length(coalesce(body, '')), coalesce(body, ''))) body from page_texts group by 1"


def page_bodies(e: Evidence) -> DataFrame:
    """(path, corrected, body): of each page path the corrected text before the scanned one, the latest delivery of it."""
    t = e.table("page_texts").withColumn("c", F.col("text_path").endswith("_corrigido.txt")).withColumn("body", F.coalesce("body", F.lit("")))
    return t.groupBy(F.regexp_replace("text_path", r"_corrigido\.txt$", ".txt").alias("path")).agg(
        F.max(F.col("c").cast("int")).alias("corrected"), F.max_by("body", F.struct("c", "ingested_at", F.length("body"), "body")).alias("body")
    )


for _name in ("jn_prefer_corrected",):
    q(_name, f"select path, corrected, md5(body) body_md5 from ({LATEST_BODY})")(lambda e: page_bodies(e).select("path", "corrected", F.md5("body").alias("body_md5")))


@q("jn_index_anti", "select id from entity_mentions m where not exists (select 1 from entities e where e.id = m.entity_id and e.type = 'person')")
def jn_index_anti(e: Evidence) -> DataFrame:
    return e.mentions.select("id", "entity_id").join(e.table("entities").where("type = 'person'").select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select("id")


@q("jn_existing_entity", "select s.surface_form, min(e.id) entity_id from (select distinct surface_form from entity_mentions where surface_form <> '') s left join entities e on lower(e.canonical_name) = lower(s.surface_form) group by 1")
def jn_existing_entity(e: Evidence) -> DataFrame:
    ids = e.table("entities").groupBy(F.lower("canonical_name").alias("k")).agg(F.min("id").alias("entity_id"))
    return e.mentions.where("surface_form <> ''").select("surface_form").distinct().join(ids, F.lower("surface_form") == F.col("k"), "left").select("surface_form", "entity_id")


# aggregates


@q("agg_scope_counts", "select (select count(*) from pg) pages, (select count(*) from entity_mentions m join pg p on p.id = m.page_id) mentions")
def agg_scope_counts(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"))
    return e.pages.join(m, "id", "left").agg(long_count("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mentions"))


@q("agg_timeline", "select p.yr, count(distinct p.id) pages, count(m.id) mentions from pg p left join entity_mentions m on m.page_id = p.id where p.yr is not null group by 1")
def agg_timeline(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"))
    return e.pages.where("yr is not null").join(m, "id", "left").groupBy("yr").agg(long_count("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mentions"))


@q("agg_journals", "select p.bib, p.jornal, count(distinct p.id) pages, count(m.id) mentions from pg p left join entity_mentions m on m.page_id = p.id group by 1, 2")
def agg_journals(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"))
    return e.pages.join(m, "id", "left").groupBy("bib", "jornal").agg(long_count("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mentions"))


@q("agg_top_entities", f"select * from (select type, entity_id, any_value(canonical_name) canonical_name, count(*) mentions, min(yr) first_year, max(yr) last_year from star group by 1, 2) qualify row_number() over (partition by type order by mentions desc, entity_id) <= {N}")
def agg_top_entities(e: Evidence) -> DataFrame:
    g = e.star.groupBy("type", "entity_id").agg(F.first("canonical_name").alias("canonical_name"), long_count("mentions"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"))
    return first_by(g, ["type"], F.desc("mentions"), F.asc("entity_id"), n=N)


def role_rows(e: Evidence) -> DataFrame:
    v = e.evidence.join(e.pages.select(F.col("id").alias("page_id"), "yr"), "page_id", "left")
    return endpoints(e).where("predicate in ('holds_role', 'appointed_to')").join(v.withColumnRenamed("relation_id", "id").withColumnRenamed("confidence", "v_confidence"), "id")


ROLE_SQL = "select r.*, coalesce(o.canonical_name, r.object_literal) object, v.page_id, v.confidence v_confidence, p.yr from relations r join evd v on v.relation_id = r.id left join pg p on p.id = v.page_id left join entities o on o.id = r.object_entity_id join entities s on s.id = r.subject_entity_id where r.predicate in ('holds_role', 'appointed_to')"


@q("agg_roles", f"select object, count(*) evidences, max(yr) last_year from ({ROLE_SQL}) group by 1")
def agg_roles(e: Evidence) -> DataFrame:
    return role_rows(e).groupBy("object").agg(long_count("evidences"), F.max("yr").alias("last_year"))


@q("agg_primary_role", f"select subject_entity_id, object, evidences from (select subject_entity_id, object, count(*) evidences, round(avg(v_confidence), 6) conf from ({ROLE_SQL}) group by 1, 2) qualify row_number() over (partition by subject_entity_id order by evidences desc, conf desc nulls last, object) = 1")
def agg_primary_role(e: Evidence) -> DataFrame:
    g = role_rows(e).groupBy("subject_entity_id", "object").agg(long_count("evidences"), F.round(F.avg("v_confidence"), 6).alias("conf"))
    return first_by(g, ["subject_entity_id"], F.desc("evidences"), F.desc_nulls_last("conf"), F.asc("object")).drop("conf")


CACHE_SQL = """select m.entity_id, m.mentions, m.strong, m.first_year, m.last_year, coalesce(r.n, 0) relations from
  (select entity_id, count(*) mentions, count(*) filter (where confidence >= 0.6) strong, min(yr) first_year, max(yr) last_year from star group by 1 having count(*) >= 2) m
  left join (select e.id, count(distinct r.id) n from entities e join relations r on (r.subject_entity_id = e.id or r.object_entity_id = e.id) and coalesce(r.predicate, '') <> 'mentioned_with' group by 1) r on r.id = m.entity_id"""


def stats_cache(e: Evidence, least: int = 2) -> DataFrame:
    """Per active entity: mentions, strong ones, year span and relations other than co-mentions."""
    m = e.star.groupBy("entity_id").agg(long_count("mentions"), F.count_if(F.col("confidence") >= 0.6).alias("strong"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year")).where(F.col("mentions") >= least)
    r = ends(e).where("coalesce(predicate, '') <> 'mentioned_with'").groupBy("entity_id").agg(F.count_distinct("id").alias("n"))
    return m.join(r, "entity_id", "left").select("entity_id", "mentions", "strong", "first_year", "last_year", F.coalesce("n", F.lit(0)).cast("long").alias("relations"))


for _name in ("agg_stats_cache",):
    q(_name, CACHE_SQL)(stats_cache)


@q("jn_cache_entity", f"select c.entity_id, e.canonical_name, c.mentions from ({CACHE_SQL}) c join entities e on e.id = c.entity_id where e.type = 'institution'")
def jn_cache_entity(e: Evidence) -> DataFrame:
    return stats_cache(e).join(e.table("entities").where("type = 'institution'").select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select("entity_id", "canonical_name", "mentions")


CLOUD = """select surname, mentions, people, round(mentions / max(mentions) over (), 3) weight from (
  select lower(strip_accents(list_last(string_split(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g')), ' ')))) surname, count(*) mentions, count(distinct entity_id) people from star
  where type = 'person' and length(list_last(string_split(trim(regexp_replace(canonical_name, '\\s+', ' ', 'g')), ' '))) >= 3 group by 1 having mentions >= 3)"""


def surname_cloud(e: Evidence) -> DataFrame:
    """Surnames of persons by mentions, with the share of the most mentioned one."""
    s = e.star.where("type = 'person'").groupBy("entity_id", "canonical_name").agg(F.count("*").alias("n")).withColumn("s", T.last_token(F.col("canonical_name"))).where("length(s) >= 3")
    g = s.groupBy(F.lower(T.strip_accents(F.col("s"))).alias("surname")).agg(F.sum("n").cast("long").alias("mentions"), long_count("people")).where("mentions >= 3")
    most = g.agg(F.max("mentions").alias("most"))
    return g.crossJoin(F.broadcast(most)).select("surname", "mentions", "people", F.round(F.col("mentions") / F.col("most"), 3).alias("weight"))  # one row


for _name in ("agg_surname_cloud",):
    q(_name, CLOUD)(surname_cloud)


GROUPS = "select base_normalized_name base, count(*) variants, sum(n)::bigint mentions, min(fy) first_year, max(ly) last_year, string_agg(distinct canonical_name, '|' order by canonical_name) names from (select e.id, e.base_normalized_name, e.canonical_name, count(s.id) n, min(s.yr) fy, max(s.yr) ly from act e left join star s on s.entity_id = e.id where e.type = 'person' group by 1, 2, 3) group by 1"


def surname_groups(e: Evidence) -> DataFrame:
    """Active persons by base name, with totals and the names they are written by."""
    m = e.star.groupBy("entity_id").agg(F.count("*").alias("n"), F.min("yr").alias("fy"), F.max("yr").alias("ly"))
    g = e.active.where("type = 'person'").select(F.col("id").alias("entity_id"), "base_normalized_name", "canonical_name").join(m, "entity_id", "left")
    return g.groupBy(F.col("base_normalized_name").alias("base")).agg(
        long_count("variants"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mentions"), F.min("fy").alias("first_year"), F.max("ly").alias("last_year"),
        F.array_join(F.array_sort(F.collect_set("canonical_name")), "|").alias("names"),
    )


for _name in ("agg_surname_groups",):
    q(_name, GROUPS)(surname_groups)


@q("agg_entity_basic", "select e.id, count(m.id) mentions, max(p.yr) last_year from entities e left join entity_mentions m on m.entity_id = e.id left join pg p on p.id = m.page_id group by 1")
def agg_entity_basic(e: Evidence) -> DataFrame:
    m = e.mentions.join(e.pages.select(F.col("id").alias("page_id"), "yr"), "page_id", "left").groupBy("entity_id").agg(F.count("*").alias("n"), F.max("yr").alias("last_year"))
    return e.table("entities").select("id").join(m, F.col("id") == F.col("entity_id"), "left").select("id", F.coalesce("n", F.lit(0)).cast("long").alias("mentions"), "last_year")


SEARCH = "select e.id, count(s.id) mentions, min(s.yr) first_year, max(s.yr) last_year from act e left join star s on s.entity_id = e.id where e.base_normalized_name like '%silva%' or lower(e.aliases_json) like '%silva%' group by 1 order by mentions desc, e.id limit 10"


def search_entities(e: Evidence) -> DataFrame:
    m = e.star.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"))
    hits = e.active.where("base_normalized_name like '%silva%' or lower(aliases_json) like '%silva%'").select("id").join(m, "id", "left")
    return top(hits.select("id", F.coalesce("n", F.lit(0)).cast("long").alias("mentions"), "first_year", "last_year"), F.desc("mentions"), F.asc("id"), n=10)


for _name in ("agg_search_entities",):
    q(_name, SEARCH)(search_entities)


def relation_evidence(e: Evidence, predicates: list[str]) -> DataFrame:
    r = e.relations.where(F.col("predicate").isin(*predicates)).select("id", "subject_entity_id", "predicate", "object_entity_id")
    v = e.evidence.join(e.pages.select(F.col("id").alias("page_id"), "yr"), "page_id", "left")
    return r.join(v, r.id == v.relation_id).groupBy("id", "subject_entity_id", "predicate", "object_entity_id").agg(F.count_distinct("page_id").alias("pages"), long_count("evidences"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"))


REL_EV = "select r.id, r.subject_entity_id, r.predicate, r.object_entity_id, count(distinct v.page_id) pages, count(*) evidences, min(p.yr) first_year, max(p.yr) last_year from relations r join evd v on v.relation_id = r.id left join pg p on p.id = v.page_id where r.predicate in ({}) group by all"
q("agg_comention_rel", REL_EV.format("'mentioned_with'"))(lambda e: relation_evidence(e, ["mentioned_with"]))
q("agg_family_rel", REL_EV.format("'spouse_of', 'child_of', 'parent_of', 'widow_of'") + " order by evidences desc, r.id limit 1")(
    lambda e: top(relation_evidence(e, ["spouse_of", "child_of", "parent_of", "widow_of"]), F.desc("evidences"), F.asc("id"), n=1)
)


HOT = f"select p.id page_id, coalesce(m.n, 0) mentions, coalesce(m.e, 0) entities, coalesce(r.n, 0) relations from pg p left join (select page_id, count(*) n, count(distinct entity_id) e from entity_mentions group by 1) m on m.page_id = p.id left join (select page_id, count(distinct relation_id) n from evd group by 1) r on r.page_id = p.id order by mentions desc, entities desc, relations desc, p.id limit {N}"


@q("agg_hotspots", HOT)
def agg_hotspots(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy("page_id").agg(F.count("*").alias("m"), F.count_distinct("entity_id").alias("k"))
    r = e.evidence.groupBy("page_id").agg(F.count_distinct("relation_id").alias("r"))
    zero = lambda c, n: F.coalesce(c, F.lit(0)).cast("long").alias(n)
    p = e.pages.select(F.col("id").alias("page_id")).join(m, "page_id", "left").join(r, "page_id", "left")
    return top(p.select("page_id", zero("m", "mentions"), zero("k", "entities"), zero("r", "relations")), F.desc("mentions"), F.desc("entities"), F.desc("relations"), F.asc("page_id"))


@q("agg_page_focus", "select page_id, entity_id, n mentions from (select page_id, entity_id, count(*) n from star group by 1, 2) qualify row_number() over (partition by page_id order by n desc, entity_id) <= 6")
def agg_page_focus(e: Evidence) -> DataFrame:
    return first_by(e.star.groupBy("page_id", "entity_id").agg(long_count("mentions")), ["page_id"], F.desc("mentions"), F.asc("entity_id"), n=6)


@q("agg_relation_highlights", f"select r.id, case when r.subject_entity_id = {LEFT} then coalesce(o.canonical_name, r.object_literal) else s.canonical_name end counterpart, count(v.page_id) evidences, round(avg(coalesce(v.confidence, r.confidence)), 6) confidence from relations r join entities s on s.id = r.subject_entity_id left join entities o on o.id = r.object_entity_id left join evd v on v.relation_id = r.id where r.subject_entity_id = {LEFT} or r.object_entity_id = {LEFT} group by 1, 2")
def agg_relation_highlights(e: Evidence) -> DataFrame:
    r = endpoints(e).where(f"subject_entity_id = {LEFT} or object_entity_id = {LEFT}").withColumn("counterpart", F.when(F.col("subject_entity_id") == LEFT, F.col("object")).otherwise(F.col("subject")))
    v = e.evidence.select(F.col("relation_id").alias("id"), "page_id", F.col("confidence").alias("vc"))
    return r.join(v, "id", "left").groupBy("id", "counterpart").agg(F.count("page_id").alias("evidences"), F.round(F.avg(F.coalesce("vc", "confidence")), 6).alias("confidence"))


@q("agg_entity_timeline", f"select yr, count(*) mentions from star where entity_id = {RIGHT} and yr is not null group by 1")
def agg_entity_timeline(e: Evidence) -> DataFrame:
    return e.star.where(f"entity_id = {RIGHT} and yr is not null").groupBy("yr").agg(long_count("mentions"))


@q("agg_entity_journals", "select entity_id, jornal, count(*) mentions from star group by 1, 2")
def agg_entity_journals(e: Evidence) -> DataFrame:
    return e.star.groupBy("entity_id", "jornal").agg(long_count("mentions"))


@q("agg_co_mentions", f"select s.entity_id, count(distinct s.page_id) pages, min(s.yr) first_year, max(s.yr) last_year from star s where s.entity_id <> {LEFT} and s.page_id in (select page_id from entity_mentions where entity_id = {LEFT}) group by 1")
def agg_co_mentions(e: Evidence) -> DataFrame:
    return e.star.where(f"entity_id <> {LEFT}").join(anchor_pages(e, LEFT), "page_id", "left_semi").groupBy("entity_id").agg(F.count_distinct("page_id").alias("pages"), F.min("yr").alias("first_year"), F.max("yr").alias("last_year"))


@q("agg_compare_timeline", f"select p.yr, count(*) filter (where m.entity_id = {LEFT}) a, count(*) filter (where m.entity_id = {RIGHT}) b from entity_mentions m join pg p on p.id = m.page_id where m.entity_id in ({LEFT}, {RIGHT}) and p.yr is not null group by 1")
def agg_compare_timeline(e: Evidence) -> DataFrame:
    m = e.mentions.where(f"entity_id in ({LEFT}, {RIGHT})").join(e.pages.where("yr is not null").select(F.col("id").alias("page_id"), "yr"), "page_id")
    return m.groupBy("yr").agg(F.count_if(F.col("entity_id") == LEFT).alias("a"), F.count_if(F.col("entity_id") == RIGHT).alias("b"))


@q("agg_shared_page_count", f"select count(*) pages from (select page_id from entity_mentions where entity_id = {LEFT} intersect select page_id from entity_mentions where entity_id = {RIGHT})")
def agg_shared_page_count(e: Evidence) -> DataFrame:
    return anchor_pages(e, LEFT).intersect(anchor_pages(e, RIGHT)).agg(long_count("pages"))


@q("agg_shared_journals", f"select p.jornal, count(distinct p.id) pages from pg p where p.id in (select page_id from entity_mentions where entity_id = {LEFT}) and p.id in (select page_id from entity_mentions where entity_id = {RIGHT}) group by 1")
def agg_shared_journals(e: Evidence) -> DataFrame:
    both = anchor_pages(e, LEFT).intersect(anchor_pages(e, RIGHT)).withColumnRenamed("page_id", "id")
    return e.pages.join(both, "id", "left_semi").groupBy("jornal").agg(F.count_distinct("id").alias("pages"))


DIRECT = "select r.id, coalesce(l.st, r.status) status, count(v.page_id) evidences, max(p.yr) last_year from relations r left join lrrev l on l.relation_id = r.id left join evd v on v.relation_id = r.id left join pg p on p.id = v.page_id where r.object_entity_id is not null group by all"


@q("agg_direct_relations", DIRECT)
def agg_direct_relations(e: Evidence) -> DataFrame:
    r = effective_relations(e).where("object_entity_id is not null").select("id", "status")
    v = e.evidence.join(e.pages.select(F.col("id").alias("page_id"), "yr"), "page_id", "left").select(F.col("relation_id").alias("id"), "page_id", "yr")
    return r.join(v, "id", "left").groupBy("id", "status").agg(F.count("page_id").alias("evidences"), F.max("yr").alias("last_year"))


def effective_relations(e: Evidence) -> DataFrame:
    """Relations whose status is that of their latest review, if there is one."""
    last = latest(e.relation_reviews, "relation_id").withColumnRenamed("relation_id", "id")
    return e.relations.join(last, "id", "left").withColumn("status", F.coalesce("review_status", "status")).drop("review_status")


@q("agg_period", "select p.yr, p.bib, count(distinct p.id) pages, count(m.id) mentions from pg p left join entity_mentions m on m.page_id = p.id where p.yr = 1850 group by 1, 2")
def agg_period(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n"))
    return e.pages.where("yr = 1850").join(m, "id", "left").groupBy("yr", "bib").agg(long_count("pages"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("mentions"))


def trail(e: Evidence, where: str) -> DataFrame:
    return top(e.star.where(where).groupBy("entity_id").agg(long_count("mentions"), F.count_distinct("page_id").alias("pages")), F.desc("mentions"), F.asc("entity_id"))


TRAIL = "select entity_id, count(*) mentions, count(distinct page_id) pages from star where {} group by 1 order by mentions desc, entity_id limit 20"
q("agg_trail_institutions", TRAIL.format("type = 'institution' and regexp_matches(lower(canonical_name), 'companhia|camara')"))(lambda e: trail(e, "type = 'institution' and lower(canonical_name) rlike 'companhia|camara'"))
q("agg_trail_places", TRAIL.format("type = 'place'"))(lambda e: trail(e, "type = 'place'"))


@q("agg_trail_people", "select r.subject_entity_id entity_id, r.object_literal as role, count(*) relations from relations r join act a on a.id = r.subject_entity_id and a.type = 'person' where r.predicate = 'holds_role' group by 1, 2")
def agg_trail_people(e: Evidence) -> DataFrame:
    people = e.active.where("type = 'person'").select(F.col("id").alias("subject_entity_id"))
    return e.relations.where("predicate = 'holds_role'").join(people, "subject_entity_id", "left_semi").groupBy(F.col("subject_entity_id").alias("entity_id"), F.col("object_literal").alias("role")).agg(long_count("relations"))


@q("agg_trail_pages", "select page_id, count(distinct entity_id) entities from star where regexp_matches(lower(canonical_name), 'companhia|camara') group by 1")
def agg_trail_pages(e: Evidence) -> DataFrame:
    return e.star.where(F.lower("canonical_name").rlike("companhia|camara")).groupBy("page_id").agg(F.count_distinct("entity_id").alias("entities"))


@q("agg_mentions_summary", "select entity_id, yr, count(*) mentions from star group by 1, 2")
def agg_mentions_summary(e: Evidence) -> DataFrame:
    return e.star.groupBy("entity_id", "yr").agg(long_count("mentions"))


@q("agg_relations_summary", "select predicate, count(*) relations, count(*) filter (where coalesce(l.st, r.status) in ('confirmed', 'probable')) strong from relations r left join lrrev l on l.relation_id = r.id group by 1")
def agg_relations_summary(e: Evidence) -> DataFrame:
    return effective_relations(e).groupBy("predicate").agg(long_count("relations"), F.count_if(F.col("status").isin("confirmed", "probable")).alias("strong"))


CORPUS = "select (select count(*) from pages) pages, (select count(distinct bib) from pages) collections, (select count(*) from pages where image_path is not null) images, (select count(distinct text_path) from page_texts where text_path not like '%\\_corrigido.txt' escape '\\') texts, (select count(distinct chunk_id) from entity_mentions) chunks, round((select count(*) from pages where image_path is not null) * 100 / nullif((select count(*) from pages), 0), 1) pct"


def corpus_stats(e: Evidence) -> DataFrame:
    p = e.table("pages").agg(long_count("pages"), F.count_distinct("bib").alias("collections"), F.count("image_path").alias("images"))
    t = e.table("page_texts").where(~F.col("text_path").endswith("_corrigido.txt")).agg(F.count_distinct("text_path").alias("texts"))
    c = e.mentions.agg(F.count_distinct("chunk_id").alias("chunks"))
    return p.crossJoin(t).crossJoin(c).withColumn("pct", F.round(F.col("images") * 100 / F.nullif("pages", F.lit(0)), 1))  # one row each


for _name in ("agg_corpus_stats",):
    q(_name, CORPUS)(corpus_stats)


@q("agg_dup_names", "select type, canonical_name, count(*) n, min(id) keep, string_agg(id::varchar, ',' order by id) ids from act group by 1, 2 having n >= 2")
def agg_dup_names(e: Evidence) -> DataFrame:
    g = e.active.groupBy("type", "canonical_name").agg(long_count("n"), F.min("id").alias("keep"), F.array_sort(F.collect_list("id")).alias("ids")).where("n >= 2")
    return g.withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


PARISH = {
    "agg_parish_types": ("select lower(record_type) record_type, count(*) records from parish_records group by 1", lambda p: p.groupBy(F.lower("record_type").alias("record_type")).agg(long_count("records"))),
    "agg_parish_families": (
        "select father_name, mother_name, count(*) children from parish_records where lower(record_type) = 'baptism' and trim(father_name) not in ('', '?') and trim(mother_name) not in ('', '?') group by 1, 2 having children >= 2",
        lambda p: p.where("lower(record_type) = 'baptism' and trim(father_name) not in ('', '?') and trim(mother_name) not in ('', '?')").groupBy("father_name", "mother_name").agg(long_count("children")).where("children >= 2"),
    ),
    "agg_parish_range": (
        "select min(try_cast(nullif(regexp_extract(event_date, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int)) first_year, max(try_cast(nullif(regexp_extract(event_date, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int)) last_year from parish_records",
        lambda p: p.agg(F.min(year_any(F.col("event_date"))).alias("first_year"), F.max(year_any(F.col("event_date"))).alias("last_year")),
    ),
    "agg_parishes": ("select distinct parish, island from parish_records", lambda p: p.select("parish", "island").distinct()),
}
for _name, (_sql, _build) in PARISH.items():
    q(_name, _sql)(lambda e, build=_build: build(e.table("parish_records")))


@q("agg_node_degree", "select n, count(*) degree from (select subject_entity_id n from relations where object_entity_id is not null union all select object_entity_id from relations where object_entity_id is not null) group by 1")
def agg_node_degree(e: Evidence) -> DataFrame:
    return e.relations.where("object_entity_id is not null").select(F.explode(F.array("subject_entity_id", "object_entity_id")).alias("n")).groupBy("n").agg(long_count("degree"))


@q("agg_collapse_review", "select type, base_normalized_name base, count(*) variants, arg_max(id, (n, length(canonical_name), -id)) best, sum(n)::bigint mentions from (select a.type, a.id, a.base_normalized_name, a.canonical_name, count(m.id) n from act a left join entity_mentions m on m.entity_id = a.id group by all) group by 1, 2")
def agg_collapse_review(e: Evidence) -> DataFrame:
    m = e.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    a = e.active.select("id", "type", "base_normalized_name", "canonical_name").join(m, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return a.groupBy("type", F.col("base_normalized_name").alias("base")).agg(
        long_count("variants"), F.max_by("id", F.struct("n", F.length("canonical_name"), -F.col("id"))).alias("best"), F.sum("n").cast("long").alias("mentions")
    )


# windows


@q("win_latest_identity", "select entity_id, st status from lrev")
def win_latest_identity(e: Evidence) -> DataFrame:
    return latest(e.identity_reviews, "entity_id").withColumnRenamed("review_status", "status")


@q("win_latest_relation", "select r.id, coalesce(l.st, r.status) status from relations r left join lrrev l on l.relation_id = r.id")
def win_latest_relation(e: Evidence) -> DataFrame:
    return effective_relations(e).select("id", "status")


@q("win_latest_merge", "select source_entity_id, target_entity_id, arg_max(review_status, id) status from entity_merge_reviews group by 1, 2")
def win_latest_merge(e: Evidence) -> DataFrame:
    return latest(e.table("entity_merge_reviews"), ["source_entity_id", "target_entity_id"]).withColumnRenamed("review_status", "status")


@q("win_best_mention_page", "select page_id, entity_id, id from entity_mentions qualify row_number() over (partition by page_id, entity_id order by confidence desc nulls last, id) = 1")
def win_best_mention_page(e: Evidence) -> DataFrame:
    return first_by(e.mentions.select("page_id", "entity_id", "id", "confidence"), ["page_id", "entity_id"], F.desc_nulls_last("confidence"), F.asc("id")).drop("confidence")


@q("win_spotlight", "select page_id, id from entity_mentions where length(snippet) >= 40 qualify row_number() over (partition by page_id order by confidence desc nulls last, length(snippet) desc, id) = 1")
def win_spotlight(e: Evidence) -> DataFrame:
    m = e.mentions.select("page_id", "id", "confidence", F.length("snippet").alias("n")).where("n >= 40")
    return first_by(m, ["page_id"], F.desc_nulls_last("confidence"), F.desc("n"), F.asc("id")).select("page_id", "id")


@q("win_top_snippet", "select entity_id, id from entity_mentions qualify row_number() over (partition by entity_id order by (coalesce(confidence, 0) >= 0.6) desc, confidence desc nulls last, length(coalesce(snippet, '')) desc, page_id, id) = 1")
def win_top_snippet(e: Evidence) -> DataFrame:
    m = e.mentions.select("entity_id", "id", "page_id", "confidence", F.length(F.coalesce("snippet", F.lit(""))).alias("n")).withColumn("strong", F.coalesce("confidence", F.lit(0.0)) >= 0.6)
    return first_by(m, ["entity_id"], F.desc("strong"), F.desc_nulls_last("confidence"), F.desc("n"), F.asc("page_id"), F.asc("id")).select("entity_id", "id")


MILESTONES = " union all ".join(
    f"(select '{k}' milestone, entity_id, id from star qualify row_number() over (partition by entity_id order by {o}) = 1)"
    for k, o in (("first", "yr nulls last, id"), ("last", "yr desc nulls last, id"), ("strongest", "confidence desc nulls last, id"))
)


@q("win_milestones", MILESTONES)
def win_milestones(e: Evidence) -> DataFrame:
    s = e.star.select("entity_id", "id", "yr", "confidence")
    orders = {"first": F.asc_nulls_last("yr"), "last": F.desc_nulls_last("yr"), "strongest": F.desc_nulls_last("confidence")}
    parts = [first_by(s, ["entity_id"], o, F.asc("id")).select(F.lit(k).alias("milestone"), "entity_id", "id") for k, o in orders.items()]
    return parts[0].union(parts[1]).union(parts[2])


def best_evidence(e: Evidence, n: int) -> DataFrame:
    """The n best pieces of evidence of each relation; those of two entities are ranked once for all relations between them."""
    order = [F.desc_nulls_last("confidence"), F.asc_nulls_last("page_id"), F.asc_nulls_last("chunk_id"), F.asc_nulls_last("quote")]
    of_pairs = first_by(e.pair_evidence, ["subject_entity_id", "object_entity_id"], *order, n=n)
    return first_by(e.of_relations(of_pairs).unionByName(e.literal_evidence), ["relation_id"], *order, n=n)


for _name, _n in (("win_evidence_top5", 5), ("win_evid_top50", 50)):
    q(_name, f"select relation_id, page_id, chunk_id, quote from evd qualify row_number() over (partition by relation_id order by confidence desc nulls last, page_id, chunk_id, quote) <= {_n}")(
        lambda e, n=_n: best_evidence(e, n).drop("confidence")
    )


@q("win_per_predicate", "select predicate, id from relations qualify row_number() over (partition by predicate order by confidence desc nulls last, id desc) <= 10")
def win_per_predicate(e: Evidence) -> DataFrame:
    return first_by(e.relations.select("predicate", "id", "confidence"), ["predicate"], F.desc_nulls_last("confidence"), F.desc("id"), n=10).drop("confidence")


@q("win_mentions_top25", "select entity_id, id from entity_mentions qualify row_number() over (partition by entity_id order by confidence desc nulls last, id) <= 25")
def win_mentions_top25(e: Evidence) -> DataFrame:
    return first_by(e.mentions.select("entity_id", "id", "confidence"), ["entity_id"], F.desc_nulls_last("confidence"), F.asc("id"), n=25).drop("confidence")


@q("win_rel_top50", "select subject_entity_id, id from relations qualify row_number() over (partition by subject_entity_id order by confidence desc nulls last, id) <= 50")
def win_rel_top50(e: Evidence) -> DataFrame:
    return first_by(e.relations.select("subject_entity_id", "id", "confidence"), ["subject_entity_id"], F.desc_nulls_last("confidence"), F.asc("id"), n=50).drop("confidence")


TL = "select p.yr, count(distinct p.id) pages, count(m.id) mentions from pg p left join entity_mentions m on m.page_id = p.id where p.yr is not null group by 1"


@q("win_spike", f"select yr, mentions, previous, round(mentions / previous, 6) ratio from (select yr, mentions, lag(mentions) over (order by yr) previous from ({TL})) where previous > 0 and mentions / previous >= 1.5 order by ratio desc, mentions desc, yr limit 1")
def win_spike(e: Evidence) -> DataFrame:
    # one row per year: the order is global, the input a few hundred rows
    t = agg_timeline(e).withColumn("previous", F.lag("mentions").over(Window.orderBy("yr"))).where("previous > 0").withColumn("ratio", F.round(F.col("mentions") / F.col("previous"), 6))
    return top(t.where("mentions / previous >= 1.5").select("yr", "mentions", "previous", "ratio"), F.desc("ratio"), F.desc("mentions"), F.asc("yr"), n=1)


@q("win_peak_years", f"select * from ({TL}) order by mentions desc, pages desc, yr limit 5")
def win_peak_years(e: Evidence) -> DataFrame:
    return top(agg_timeline(e), F.desc("mentions"), F.desc("pages"), F.asc("yr"), n=5)


@q("win_target_year", f"select yr from ({TL}) order by mentions desc, pages desc, yr limit 1")
def win_target_year(e: Evidence) -> DataFrame:
    return top(agg_timeline(e), F.desc("mentions"), F.desc("pages"), F.asc("yr"), n=1).select("yr")


@q("win_card_cap", f"with c as (select s.entity_id, s.type, count(distinct s.page_id) pages from star s where s.entity_id <> {LEFT} and s.page_id in (select page_id from entity_mentions where entity_id = {LEFT}) group by 1, 2), r as (select *, row_number() over (partition by type order by pages desc, entity_id) k from c), o as (select entity_id, case when k <= 10 then type else 'other' end card, pages, k from r) select entity_id, card, pages from o qualify row_number() over (partition by card order by pages desc, entity_id) <= 10")
def win_card_cap(e: Evidence) -> DataFrame:
    c = e.star.where(f"entity_id <> {LEFT}").join(anchor_pages(e, LEFT), "page_id", "left_semi").groupBy("entity_id", "type").agg(F.count_distinct("page_id").alias("pages"))
    ranked = c.withColumn("k", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("pages"), "entity_id")))
    carded = ranked.withColumn("card", F.when(F.col("k") <= 10, F.col("type")).otherwise("other"))
    return first_by(carded, ["card"], F.desc("pages"), F.asc("entity_id"), n=10).select("entity_id", "card", "pages")


@q("win_rowcount_noop", f"select page_id, count(*) density from entity_mentions where entity_id in ({LEFT}, {RIGHT}) group by 1 order by density desc, page_id desc limit 5")
def win_rowcount_noop(e: Evidence) -> DataFrame:
    return top(e.mentions.where(f"entity_id in ({LEFT}, {RIGHT})").groupBy("page_id").agg(long_count("density")), F.desc("density"), F.desc("page_id"), n=5)


FEATURED = f"with c as (select *, row_number() over (order by mentions desc, entity_id) - 1 k, count(*) over () n from ({CACHE_SQL}) where mentions >= 10 and strong >= 2) select entity_id, mentions, strong from c where k = 42 % n"


def featured(e: Evidence, seed: int = 42) -> DataFrame:
    """The candidate whose place in the list is `seed` modulo its length: two passes over distributed ranks, no global sort of all rows."""
    c = stats_cache(e).where("mentions >= 10 and strong >= 2").select("entity_id", "mentions", "strong")
    n = c.agg(F.count("*").alias("n"))
    ahead = c.select(F.col("mentions").alias("m2")).groupBy("m2").agg(F.count("*").alias("k"))
    before = ahead.withColumn("upto", F.sum("k").over(Window.orderBy(F.desc("m2")))).withColumn("start", F.col("upto") - F.col("k"))
    ranked = c.join(before, c.mentions == before.m2).withColumn("k", F.col("start") + F.row_number().over(Window.partitionBy("mentions").orderBy("entity_id")) - 1)
    return ranked.crossJoin(F.broadcast(n)).where(F.col("k") == F.pmod(F.lit(seed), F.col("n"))).select("entity_id", "mentions", "strong")  # one row


for _name in ("win_featured_pick",):
    q(_name, FEATURED)(featured)

# tops and sets


@q("top_multi_key", "select bib, jornal, count(*) pages from pages group by 1, 2 order by pages desc, bib, jornal nulls last limit 12")
def top_multi_key(e: Evidence) -> DataFrame:
    return top(e.pages.groupBy("bib", "jornal").agg(long_count("pages")), F.desc("pages"), F.asc("bib"), F.asc_nulls_last("jornal"), n=12)


@q("top_overfetch", "select entity_id, count(*) mentions from star where type = 'person' group by 1 order by mentions desc, entity_id limit 8")
def top_overfetch(e: Evidence) -> DataFrame:
    return top(e.star.where("type = 'person'").groupBy("entity_id").agg(long_count("mentions")), F.desc("mentions"), F.asc("entity_id"), n=8)


@q("top_py_sort_tuple", "select entity_id, count(*) mentions, max(canonical_name) canonical_name from star group by 1 order by mentions desc, canonical_name desc, entity_id desc limit 20")
def top_py_sort_tuple(e: Evidence) -> DataFrame:
    return top(e.star.groupBy("entity_id").agg(long_count("mentions"), F.max("canonical_name").alias("canonical_name")), F.desc("mentions"), F.desc("canonical_name"), F.desc("entity_id"))


@q("top_score_cut", "select id, confidence from entity_mentions order by confidence desc nulls last, id limit 50")
def top_score_cut(e: Evidence) -> DataFrame:
    return top(e.mentions.select("id", "confidence"), F.desc_nulls_last("confidence"), F.asc("id"), n=50)


@q("top_degree_cap", f"select n, degree from (select n, count(*) degree from (select subject_entity_id n from relations where object_entity_id is not null union all select object_entity_id from relations where object_entity_id is not null) group by 1) order by (n = {LEFT}) desc, degree desc, n limit 30")
def top_degree_cap(e: Evidence) -> DataFrame:
    return top(agg_node_degree(e), F.desc(F.col("n") == LEFT), F.desc("degree"), F.asc("n"), n=30)


@q("top_per_token", "with t as (select a.id, unnest(list_distinct(regexp_split_to_array(a.base_normalized_name, ' '))) token from act a where a.type = 'person'), m as (select entity_id, count(*) n from entity_mentions group by 1) select token, t.id, coalesce(m.n, 0) mentions from t left join m on m.entity_id = t.id where length(token) >= 4 qualify row_number() over (partition by token order by coalesce(m.n, 0) desc, t.id) <= 10")
def top_per_token(e: Evidence) -> DataFrame:
    t = e.active.where("type = 'person'").select("id", F.explode(F.array_distinct(F.split("base_normalized_name", " "))).alias("token")).where("length(token) >= 4")
    m = e.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    return first_by(t.join(m, "id", "left").select("token", "id", F.coalesce("n", F.lit(0)).cast("long").alias("mentions")), ["token"], F.desc("mentions"), F.asc("id"), n=10)


@q("set_union_rows", "select 'm' src, page_id from entity_mentions union all select 'p', id from pages")
def set_union_rows(e: Evidence) -> DataFrame:
    return e.mentions.select(F.lit("m").alias("src"), "page_id").unionByName(e.pages.select(F.lit("p").alias("src"), F.col("id").alias("page_id")))


@q("set_distinct_rows", "select distinct bib, jornal from pages")
def set_distinct_rows(e: Evidence) -> DataFrame:
    return e.pages.select("bib", "jornal").distinct()


@q("set_diff", "select id from pages except select page_id from entity_mentions")
def set_diff(e: Evidence) -> DataFrame:
    return e.pages.select("id").subtract(e.mentions.select("page_id"))


@q("set_intersect", "select id from pages intersect select page_id from entity_mentions")
def set_intersect(e: Evidence) -> DataFrame:
    return e.pages.select("id").intersect(e.mentions.select("page_id"))


@q("set_edge_dedup", "select distinct subject_entity_id, object_entity_id, predicate from relations where object_entity_id is not null and subject_entity_id <> object_entity_id")
def set_edge_dedup(e: Evidence) -> DataFrame:
    return e.relations.where("object_entity_id is not null and subject_entity_id <> object_entity_id").select("subject_entity_id", "object_entity_id", "predicate").distinct()


@q("set_source_dedup", "select bib, pagina, min(id) id from pages group by 1, 2")
def set_source_dedup(e: Evidence) -> DataFrame:
    return e.pages.groupBy("bib", "pagina").agg(F.min("id").alias("id"))


@q("set_name_dedup", "select lower(trim(surface_form)) form, min(id) id from entity_mentions where surface_form is not null group by 1")
def set_name_dedup(e: Evidence) -> DataFrame:
    return e.mentions.where("surface_form is not null").groupBy(F.lower(F.trim("surface_form")).alias("form")).agg(F.min("id").alias("id"))


ALIAS = "case when json_valid(aliases_json) then list_sort(list_distinct(list_filter(list_transform(from_json(aliases_json, '[\"VARCHAR\"]'), lambda x: lower(trim(x))), lambda x: x not in ('', '?')))) end"


def alias_set(c: str = "aliases_json") -> Column:
    read = F.from_json(c, "array<string>", {"allowSingleQuotes": "false"})
    return F.array_sort(F.array_distinct(F.filter(F.transform(read, lambda x: F.lower(F.trim(x))), lambda x: ~x.isin("", "?"))))


for _name in ("set_sorted_set",):
    q(_name, f"select id, array_to_string({ALIAS}, '|') aliases from entities")(lambda e: e.table("entities").select("id", F.array_join(alias_set(), "|").alias("aliases")))


@q("set_alias_intersect", f"with a as (select id, base_normalized_name b, unnest({ALIAS}) x from entities where type = 'person') select a1.id a, a2.id b, count(*) shared from a a1 join a a2 on a1.x = a2.x and a1.id < a2.id where a1.x <> a1.b group by 1, 2")
def set_alias_intersect(e: Evidence) -> DataFrame:
    a = e.table("entities").where("type = 'person'").select("id", F.col("base_normalized_name").alias("base"), F.explode(alias_set()).alias("x"))
    l, r = a.where("x <> base").select(F.col("id").alias("a"), "x"), a.select(F.col("id").alias("b"), "x")
    return l.join(r, "x").where("a < b").groupBy("a", "b").agg(long_count("shared"))


@q("set_token_intersect", "with t as (select id, unnest(list_distinct(regexp_split_to_array(base_normalized_name, ' '))) x from entities where type = 'institution') select a.id a, b.id b, count(*) shared from t a join t b on a.x = b.x and a.id < b.id where a.x not in ('de', 'da', 'do', 'das', 'dos', 'e') group by 1, 2 having count(*) >= 3")
def set_token_intersect(e: Evidence) -> DataFrame:
    t = e.table("entities").where("type = 'institution'").select("id", F.explode(F.array_distinct(F.split("base_normalized_name", " "))).alias("x")).where("x not in ('de', 'da', 'do', 'das', 'dos', 'e')")
    a, b = t.withColumnRenamed("id", "a"), t.withColumnRenamed("id", "b")
    return a.join(b, "x").where("a < b").groupBy("a", "b").agg(long_count("shared")).where("shared >= 3")


@q("cq_catalog", "select bib, max(jornal) nome, count(*) paginas from pages group by 1")
def cq_catalog(e: Evidence) -> DataFrame:
    return e.pages.groupBy("bib").agg(F.max("jornal").alias("nome"), long_count("paginas"))


def register(to: Registry) -> None:
    for name, build in reg.builders.items():
        to.add(name, build, reg.sql.get(name))

