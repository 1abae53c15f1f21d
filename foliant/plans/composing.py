"""The public entry points: each query gives the sections of one payload as rows (section, key, n), at most TOP rows a section, and their small neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import models
from foliant.operators.graph import distances
from foliant.plans import relational as R
from foliant.plans.prelude import registrar
from foliant.plans.relational import LEFT, RIGHT, long_count
from foliant.plans.textual import out_edges
from foliant.plans.retrieving import over_texts
from foliant.sources.evidence import Evidence

reg, q = registrar()

#: Rows of a section.
TOP = 8


def sections(*parts: tuple[str, DataFrame]) -> DataFrame:
    """Frames (key, n) under their section, each cut to its TOP rows by n, then key."""
    out: DataFrame | None = None
    for name, df in parts:
        rows = df.select(F.lit(name).alias("section"), F.col("key").cast("string").alias("key"), F.col("n").cast("long").alias("n")).orderBy(F.desc("n"), F.asc("key")).limit(TOP)
        out = rows if out is None else out.unionAll(rows)
    assert out is not None
    return out


def sql_sections(**parts: str) -> str:
    return " union all ".join(f"(select '{k}' section, key::varchar as key, n::bigint n from ({v}) order by n desc, key limit {TOP})" for k, v in parts.items())


def counted(df: DataFrame, by: str | Column, n: Column | None = None) -> DataFrame:
    return df.groupBy((F.col(by) if isinstance(by, str) else by).alias("key")).agg((F.count("*") if n is None else n).alias("n")).where("key is not null")


def star_of(e: Evidence, entity: int) -> DataFrame:
    return e.star.where(F.col("entity_id") == entity)


PEERS = "select s.entity_id as key, count(distinct s.page_id) n from star s where s.entity_id <> {0} and s.page_id in (select page_id from entity_mentions where entity_id = {0}) group by 1"
PREDICATES = "select predicate as key, count(*) n from relations where (subject_entity_id = {0} or object_entity_id = {0}) and predicate is not null group by 1"


def peers(e: Evidence, entity: int) -> DataFrame:
    return counted(e.star.where(F.col("entity_id") != entity).join(R.anchor_pages(e, entity), "page_id", "left_semi"), "entity_id", F.count_distinct("page_id"))


def predicates(e: Evidence, entity: int) -> DataFrame:
    return counted(e.relations.where((F.col("subject_entity_id") == entity) | (F.col("object_entity_id") == entity)), "predicate")


@q(
    "cq_overview",
    sql_sections(
        pages="select 'pages' as key, count(*) n from pages", years="select yr as key, count(*) n from star where yr is not null group by 1", journals="select jornal as key, count(*) n from star where jornal is not null group by 1",
        **{k: f"select entity_id as key, count(*) n from star where type = '{k}' group by 1" for k in ("person", "place", "institution")},
        roles="select object_literal as key, count(*) n from relations where predicate = 'holds_role' and object_literal is not null group by 1",
        families="select id as key, (select count(*) from evd where relation_id = r.id) n from relations r where predicate in ('child_of', 'parent_of', 'spouse_of', 'widow_of')",
        hotspots="select page_id as key, count(*) n from entity_mentions group by 1",
    ),
)
def cq_overview(e: Evidence) -> DataFrame:
    family = e.relations.where("predicate in ('child_of', 'parent_of', 'spouse_of', 'widow_of')").select(F.col("id").alias("relation_id"))
    proof = family.join(e.evidence.groupBy("relation_id").agg(F.count("*").alias("k")), "relation_id", "left").select(F.col("relation_id").alias("key"), F.coalesce("k", F.lit(0)).alias("n"))
    return sections(
        ("pages", e.pages.agg(F.count("*").alias("n")).withColumn("key", F.lit("pages"))), ("years", counted(e.star, "yr")), ("journals", counted(e.star, "jornal")),
        *[(k, counted(e.star.where(F.col("type") == k), "entity_id")) for k in ("person", "place", "institution")],
        ("roles", counted(e.relations.where("predicate = 'holds_role'"), "object_literal")), ("families", proof), ("hotspots", counted(e.mentions, "page_id")),
    )


@q("cq_entity", sql_sections(mentions=f"select chunk_id as key, count(*) n from entity_mentions where entity_id = {LEFT} and chunk_id is not null group by 1", relations=PREDICATES.format(LEFT), evidences=f"select page_id as key, count(*) n from evd where relation_id in (select id from relations where subject_entity_id = {LEFT} or object_entity_id = {LEFT}) group by 1", journals=f"select jornal as key, count(*) n from star where entity_id = {LEFT} and jornal is not null group by 1"))
def cq_entity(e: Evidence) -> DataFrame:
    own = e.relations.where(f"subject_entity_id = {LEFT} or object_entity_id = {LEFT}").select(F.col("id").alias("relation_id"))
    return sections(
        ("mentions", counted(e.mentions.where(f"entity_id = {LEFT}"), "chunk_id")), ("relations", predicates(e, LEFT)),
        ("evidences", counted(e.evidence.join(own, "relation_id", "left_semi"), "page_id")), ("journals", counted(star_of(e, LEFT), "jornal")),
    )


SPAN = f"select 'first' as key, min(yr) n from star where entity_id = {LEFT} union all select 'last', max(yr) from star where entity_id = {LEFT}"


@q("cq_story", sql_sections(timeline=f"select yr as key, count(*) n from star where entity_id = {LEFT} and yr is not null group by 1", milestones=SPAN, connections=PEERS.format(LEFT), highlights=PREDICATES.format(LEFT), journals=f"select jornal as key, count(distinct page_id) n from star where entity_id = {LEFT} and jornal is not null group by 1"))
def cq_story(e: Evidence) -> DataFrame:
    own = star_of(e, LEFT)
    span = own.agg(F.min("yr").alias("a"), F.max("yr").alias("b")).select(F.inline(F.array(F.struct(F.lit("first").alias("key"), F.col("a").alias("n")), F.struct(F.lit("last").alias("key"), F.col("b").alias("n")))))
    return sections(("timeline", counted(own, "yr")), ("milestones", span), ("connections", peers(e, LEFT)), ("highlights", predicates(e, LEFT)), ("journals", counted(own, "jornal", F.count_distinct("page_id"))))


BOTH = f"select page_id from entity_mentions where entity_id = {LEFT} intersect select page_id from entity_mentions where entity_id = {RIGHT}"
YEARS2 = f"select p.yr, count(*) filter (where m.entity_id = {LEFT}) a, count(*) filter (where m.entity_id = {RIGHT}) b from entity_mentions m join pg p on p.id = m.page_id where m.entity_id in ({LEFT}, {RIGHT}) and p.yr is not null group by 1"


@q(
    "cq_compare",
    sql_sections(
        left=f"select yr as key, a n from ({YEARS2})", right=f"select yr as key, b n from ({YEARS2})", overlap=f"select yr as key, least(a, b) n from ({YEARS2}) where a > 0 and b > 0", pages=f"select 'shared' as key, count(*) n from ({BOTH})",
        journals=f"select jornal as key, count(*) n from pages where id in ({BOTH}) and jornal is not null group by 1",
        bridges=f"select s.entity_id as key, count(distinct s.page_id) n from star s where s.page_id in ({BOTH}) and s.entity_id not in ({LEFT}, {RIGHT}) group by 1",
    ),
)
def cq_compare(e: Evidence) -> DataFrame:
    years, both = R.agg_compare_timeline(e), R.anchor_pages(e, LEFT).intersect(R.anchor_pages(e, RIGHT))
    as_key = lambda n: years.select(F.col("yr").alias("key"), n.alias("n"))
    return sections(
        ("left", as_key(F.col("a"))), ("right", as_key(F.col("b"))), ("overlap", years.where("a > 0 and b > 0").select(F.col("yr").alias("key"), F.least("a", "b").alias("n"))), ("pages", both.agg(F.count("*").alias("n")).withColumn("key", F.lit("shared"))),
        ("journals", counted(e.table("pages").join(both.withColumnRenamed("page_id", "id"), "id", "left_semi"), "jornal")),
        ("bridges", counted(e.star.where(~F.col("entity_id").isin(LEFT, RIGHT)).join(both, "page_id", "left_semi"), "entity_id", F.count_distinct("page_id"))),
    )


@q("cq_period", sql_sections(pages="select 'pages' as key, count(*) n from pg where yr = 1850", **{k: f"select entity_id as key, count(*) n from star where yr = 1850 and type = '{k}' group by 1" for k in ("person", "place", "institution")}, journals="select jornal as key, count(*) n from star where yr = 1850 and jornal is not null group by 1", events="select r.predicate as key, count(*) n from evd v join relations r on r.id = v.relation_id join pg p on p.id = v.page_id where p.yr = 1850 and r.predicate is not null group by 1"))
def cq_period(e: Evidence) -> DataFrame:
    year = e.star.where("yr = 1850")
    events = e.evidence.join(e.pages.where("yr = 1850").select(F.col("id").alias("page_id")), "page_id", "left_semi").join(e.relations.select(F.col("id").alias("relation_id"), "predicate"), "relation_id")
    return sections(
        ("pages", e.pages.where("yr = 1850").agg(F.count("*").alias("n")).withColumn("key", F.lit("pages"))), *[(k, counted(year.where(F.col("type") == k), "entity_id")) for k in ("person", "place", "institution")],
        ("journals", counted(year, "jornal")), ("events", counted(events, "predicate")),
    )


#: Themes: (type, words of the names).
TRAILS = {"governo": ("institution", "camara|governo|secretaria"), "comercio": ("institution", "companhia|alfandega|associa"), "igreja": ("institution", "igreja|irmandade"), "lugares": ("place", "a|e|o")}


def themed(e: Evidence, name: str) -> DataFrame:
    kind, words = TRAILS[name]
    return e.star.where((F.col("type") == kind) & F.lower("canonical_name").rlike(words))


THEMED = "select * from star where type = '{0}' and regexp_matches(lower(canonical_name), '{1}')"
q("cq_trails", sql_sections(**{k: f"select entity_id as key, count(*) n from ({THEMED.format(*v)}) group by 1" for k, v in TRAILS.items()}))(lambda e: sections(*[(k, counted(themed(e, k), "entity_id")) for k in TRAILS]))
COMERCIO = THEMED.format(*TRAILS["comercio"])
q("cq_trail", sql_sections(entities=f"select entity_id as key, count(*) n from ({COMERCIO}) group by 1", pages=f"select page_id as key, count(distinct entity_id) n from ({COMERCIO}) group by 1", years=f"select yr as key, count(*) n from ({COMERCIO}) where yr is not null group by 1"))(
    lambda e: (lambda t: sections(("entities", counted(t, "entity_id")), ("pages", counted(t, "page_id", F.count_distinct("entity_id"))), ("years", counted(t, "yr"))))(themed(e, "comercio"))
)

# graphs

LINKS = f"({R.CO_SQL})"
LAYERS = {"family": ["child_of", "parent_of", "widow_of", "spouse_of"], "roles": ["holds_role", "appointed_to"], "justice": ["accused_of", "absolved", "victim_of"]}
BOUND = "select subject_entity_id a, object_entity_id b, predicate, id from relations where object_entity_id is not null and confidence >= 0.4"
LAYER_SQL = " union all ".join(f"(select '{k}' layer, a, b from ({BOUND}) where predicate in ({', '.join(repr(p) for p in v)}) order by id limit 30)" for k, v in LAYERS.items())
CAPPED = f"with l as (select distinct * from ({LAYER_SQL} union all (select 'comention', a, b from {LINKS} order by shared desc, a, b limit 30))), d as (select id, count(*) k from (select a id from l union all select b from l) group by 1), t as (select id from d order by k desc, id limit 30)"


def layered(e: Evidence) -> DataFrame:
    """(layer, a, b): thirty relations a layer by id and thirty co-mentions, of the thirty nodes with the most edges."""
    r = e.relations.where("object_entity_id is not null and confidence >= 0.4").select(F.col("subject_entity_id").alias("a"), F.col("object_entity_id").alias("b"), "predicate", "id")
    rows = R.top(R.co_mentions(e), F.desc("shared"), F.asc("a"), F.asc("b"), n=30).select(F.lit("comention").alias("layer"), "a", "b")
    for k, v in LAYERS.items():
        rows = rows.union(R.top(r.where(F.col("predicate").isin(*v)), F.asc("id"), n=30).select(F.lit(k), "a", "b"))
    rows = rows.distinct()
    degree = rows.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("k"))
    best = R.top(degree, F.desc("k"), F.asc("id"), n=30).select("id")
    return rows.join(best.withColumnRenamed("id", "a"), "a", "left_semi").join(best.withColumnRenamed("id", "b"), "b", "left_semi")


q("cq_layered", CAPPED + " select layer, a, b from l where a in (select id from t) and b in (select id from t)")(layered)
FEATURED = f"with f as (select a, b, shared from {LINKS} where a in (select id from act where type = 'person') and b in (select id from act where type = 'person') order by shared desc, a, b limit 25)"
q("cq_featured_graph", FEATURED + " select id, count(*) degree, sum(shared)::bigint weight from (select a id, shared from f union all select b, shared from f) group by 1")(
    lambda e: (lambda p: R.top(R.co_mentions(e).join(p.withColumnRenamed("id", "a"), "a", "left_semi").join(p.withColumnRenamed("id", "b"), "b", "left_semi"), F.desc("shared"), F.asc("a"), F.asc("b"), n=25))(e.active.where("type = 'person'").select("id"))
    .select(F.explode(F.array("a", "b")).alias("id"), "shared").groupBy("id").agg(long_count("degree"), F.sum("shared").alias("weight"))
)
EGO = f"with ed as (select subject_entity_id src, object_entity_id dst from relations where object_entity_id is not null), d1 as (select dst node from ed where src = {LEFT}), d2 as (select dst node from ed where src in (select node from d1)), r as (select {LEFT}::bigint node union select node from d1 union select node from d2), w as (select r.node, count(m.id) n from r left join entity_mentions m on m.entity_id = r.node group by 1), t as (select node from w order by (node = {LEFT}) desc, n desc, node limit 30)"


@q("top_subgraph_30", EGO + " select distinct src, dst from ed where src in (select node from t) and dst in (select node from t)")
def top_subgraph_30(e: Evidence) -> DataFrame:
    """The edges among the centre and the 29 most mentioned of the entities within two steps."""
    edges = out_edges(e)
    near = distances(edges, e.table("entities").where(f"id = {LEFT}").select(F.col("id").alias("node")), 2).select("node").distinct()
    n = e.mentions.groupBy(F.col("entity_id").alias("node")).agg(F.count("*").alias("n"))
    best = R.top(near.join(n, "node", "left").withColumn("n", F.coalesce("n", F.lit(0))), F.desc(F.col("node") == LEFT), F.desc("n"), F.asc("node"), n=30).select("node")
    return edges.distinct().join(best.withColumnRenamed("node", "src"), "src", "left_semi").join(best.withColumnRenamed("node", "dst"), "dst", "left_semi")


q("gr_subgraph", EGO + f" select r.node, count(distinct m.page_id) pages from r left join entity_mentions m on m.entity_id = r.node group by 1")(
    lambda e: distances(out_edges(e), e.table("entities").where(f"id = {LEFT}").select(F.col("id").alias("node")), 2).select("node").distinct()
    .join(e.mentions.select(F.col("entity_id").alias("node"), "page_id").distinct().groupBy("node").agg(F.count("*").alias("k")), "node", "left").select("node", F.coalesce("k", F.lit(0)).alias("pages"))
)
q("cq_page", "select p.id, coalesce(c.text_path, r.text_path) text_path, (select count(*) from entity_mentions m where m.page_id = p.id) mentions from pages p left join (select distinct text_path from page_texts) r on r.text_path = p.text_path left join (select distinct text_path from page_texts) c on c.text_path = regexp_replace(p.text_path, '[.]txt$', '_corrigido.txt')")(
    lambda e: (lambda t: e.table("pages").select("id", "text_path").withColumn("fixed", F.regexp_replace("text_path", r"\.txt$", "_corrigido.txt")).join(t.select(F.col("p").alias("fixed"), F.col("p").alias("c")), "fixed", "left").join(t.select(F.col("p").alias("text_path"), F.col("p").alias("r")), "text_path", "left"))(e.table("page_texts").select(F.col("text_path").alias("p")).distinct())
    .join(e.mentions.groupBy(F.col("page_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("c", "r").alias("text_path"), F.coalesce("n", F.lit(0)).cast("long").alias("mentions"))
)
q("cq_reviews", sql_sections(identity="select st as key, count(*) n from lrev group by 1", relation="select st as key, count(*) n from lrrev group by 1", merge="select s as key, count(*) n from (select arg_max(review_status, id) s from entity_merge_reviews group by least(source_entity_id, target_entity_id), greatest(source_entity_id, target_entity_id)) group by 1"))(
    lambda e: sections(
        ("identity", counted(e.identity_reviews.groupBy("entity_id").agg(F.max_by("review_status", "id").alias("s")), "s")), ("relation", counted(e.relation_reviews.groupBy("relation_id").agg(F.max_by("review_status", "id").alias("s")), "s")),
        ("merge", counted(e.table("entity_merge_reviews").groupBy(F.least("source_entity_id", "target_entity_id"), F.greatest("source_entity_id", "target_entity_id")).agg(F.max_by("review_status", "id").alias("s")), "s")),
    )
)
q("snk_rebuild_cache", "select type, count(*) entities, sum(n)::bigint mentions from (select entity_id, count(*) n from entity_mentions group by 1 having count(*) >= 2) join entities on id = entity_id group by 1")(
    lambda e: models.rebuilt(e.mentions.groupBy("entity_id").agg(F.count("*").alias("n")).where("n >= 2")).join(e.table("entities").select(F.col("id").alias("entity_id"), "type"), "entity_id").groupBy("type").agg(long_count("entities"), F.sum("n").alias("mentions"))
)
ROW = "'<tr><td>' || bib || '</td><td>' || coalesce(nome, '?') || '</td><td>' || paginas || '</td></tr>'"
q("tf_catalog_row", f"select regexp_extract(row_, '<td>(.*?)</td><td>(.*?)</td><td>([0-9]+)</td>', 1) bib, regexp_extract(row_, '<td>(.*?)</td><td>(.*?)</td><td>([0-9]+)</td>', 2) nome, regexp_extract(row_, '<td>(.*?)</td><td>(.*?)</td><td>([0-9]+)</td>', 3)::bigint paginas from (select {ROW} row_ from (select bib, max(jornal) nome, count(*) paginas from pages group by 1))")(
    lambda e: R.cq_catalog(e).select(F.concat(F.lit("<tr><td>"), "bib", F.lit("</td><td>"), F.coalesce("nome", F.lit("?")), F.lit("</td><td>"), F.col("paginas").cast("string"), F.lit("</td></tr>")).alias("row"))
    .select(*[F.regexp_extract("row", "<td>(.*?)</td><td>(.*?)</td><td>([0-9]+)</td>", i).alias(n) for i, n in ((1, "bib"), (2, "nome"), (3, "paginas"))]).withColumn("paginas", F.col("paginas").cast("long"))
)

# models: any callable; these stand in where none is given


def documents(e: Evidence) -> DataFrame:
    return e.table("documents").where("text is not null")


q("llm_correct")(lambda e: over_texts(documents(e), "doc_id", ["text"], lambda t: models.correct(t, models.tidy), "string"))
q("llm_retry")(lambda e: over_texts(documents(e), "doc_id", ["text"], lambda t: models.retried(t, models.slow_at(90)), "string"))
q("llm_extract")(lambda e: over_texts(documents(e).where("length(text) > 20"), "doc_id", ["text"], models.extract, "string"))
q("llm_embed")(lambda e: over_texts(documents(e), "doc_id", ["text"], lambda t: ",".join(f"{x:.4f}" for x in models.embed(t)), "string"))
