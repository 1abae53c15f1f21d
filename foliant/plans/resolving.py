"""Queries of entity resolution and of the parish registers: candidates, scores, merges, kinship graphs and matches with the newspapers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import quality as Q
from foliant.functions import text as T
from foliant.functions.years import year_any
from foliant.operators.graph import distances
from foliant.plans import textual as X
from foliant.plans.extracting import FOLDED
from foliant.plans.prelude import registrar
from foliant.plans.relational import first_by, long_count, top
from foliant.sources.evidence import STATUS_RANK, Evidence
from foliant.tables import cut

reg, q = registrar()

# candidates for a merge

PEOPLE_SQL = f"""
p as (select a.id, a.type, a.base_normalized_name b, a.canonical_name as name, a.eff, coalesce(m.n, 0) mentions,
  list_distinct(list_filter(list_transform(list_concat([a.canonical_name], coalesce(case when json_valid(a.aliases_json) then from_json(a.aliases_json, '["VARCHAR"]') end, [])), lambda x: {FOLDED.format('x')}), lambda x: x <> '')) al,
  list_filter(coalesce(from_json(a.attrs->'identity_hints', '["VARCHAR"]'), []), lambda h: h like 'title:%' or h like 'role:%') h
  from act a left join (select entity_id, count(*) n from entity_mentions group by 1) m on m.entity_id = a.id where a.base_normalized_name <> ''),
c as (select x.id entity, y.id candidate, x.type, x.b = y.b same, len(list_filter(list_intersect(x.al, y.al), lambda z: z <> x.b)) > 0 shared,
  x.b <> y.b and (contains(' ' || y.b || ' ', ' ' || x.b || ' ') or contains(' ' || x.b || ' ', ' ' || y.b || ' ')) part, len(list_intersect(x.h, y.h)) > 0 hint, y.mentions, y.name
  from p x join p y on x.type = y.type and x.id <> y.id),
s as (select *, round(5 * same::int + 3 * shared::int + 2 * part::int + 1.5::double * hint::int + least(mentions, 25) / 25, 2) score,
  concat_ws('|', case when same then 'base' end, case when shared then 'alias' end, case when part then 'part' end, case when hint then 'title' end) reasons from c where same or shared or part)"""


def resolvable(e: Evidence) -> DataFrame:
    """(id, type, b, name, eff, mentions, al, h): the active entities with their base name, normal aliases and title or role hints."""
    counts = e.mentions.groupBy(F.col("entity_id").alias("id")).agg(long_count("n"))
    listed = F.coalesce(F.from_json("aliases_json", "array<string>", {"allowSingleQuotes": "false"}), F.array().cast("array<string>"))
    names = F.transform(F.concat(F.array("canonical_name"), listed), T.normalize_name)
    return e.active.where("base_normalized_name <> ''").join(counts, "id", "left").select(
        "id", "type", F.col("base_normalized_name").alias("b"), F.col("canonical_name").alias("name"), "eff", F.coalesce("n", F.lit(0)).alias("mentions"),
        F.array_distinct(F.filter(names, lambda x: x != "")).alias("al"), F.filter(F.coalesce("hints", F.array().cast("array<string>")), lambda h: h.rlike("^(title|role):")).alias("h"),
    )


def blocked(p: DataFrame) -> DataFrame:
    """(type, x, y): the pairs of entities that share a base name or an alias, or of which one's base name stands in the other's, in words.

    A part is met on its rarest word only, so common words bring no pairs together; a name that stands in another has all its words there.
    """
    one = p.select("type", "id", F.explode(F.array_distinct(F.concat(F.array(F.concat(F.lit("="), "b")), "al"))).alias("key"))
    equal = one.select("type", F.col("id").alias("x"), "key").join(one.select("type", F.col("id").alias("y"), "key"), ["type", "key"]).where("x <> y").select("type", "x", "y")
    words = p.select("type", "id", "b", F.explode(F.array_distinct(F.split("b", " "))).alias("word"))
    often = words.groupBy("type", "word").agg(F.count("*").alias("n"))
    rarest = words.join(often, ["type", "word"]).groupBy("type", "id").agg(F.min(F.struct("n", "word", "b")).alias("r")).select("type", F.col("id").alias("x"), F.col("r.word").alias("word"), F.col("r.b").alias("bx"))
    inside = rarest.join(words.select("type", F.col("id").alias("y"), F.col("b").alias("by"), "word"), ["type", "word"]).where("x <> y and bx <> by and contains(concat(' ', by, ' '), concat(' ', bx, ' '))")
    both = inside.select("type", "x", "y").unionByName(inside.select("type", F.col("y").alias("x"), F.col("x").alias("y")))
    return equal.unionByName(both).distinct()


def merge_scores(e: Evidence) -> DataFrame:
    """(entity, candidate, type, score, reasons, mentions, name): every candidate of every entity; mentions and name are the candidate's."""
    p = resolvable(e)
    left = p.select(F.col("id").alias("x"), F.struct("b", "al", "h").alias("l"))
    right = p.select(F.col("id").alias("y"), F.struct("b", "al", "h", "mentions", "name").alias("r"))
    m = blocked(p).join(left, "x").join(right, "y")
    same = F.col("l.b") == F.col("r.b")
    shared = F.size(F.filter(F.array_intersect("l.al", "r.al"), lambda a: a != F.col("l.b"))) > 0
    part = ~same & F.expr("contains(concat(' ', r.b, ' '), concat(' ', l.b, ' ')) or contains(concat(' ', l.b, ' '), concat(' ', r.b, ' '))")
    hint = F.arrays_overlap("l.h", "r.h")
    points = 5 * same.cast("int") + 3 * shared.cast("int") + 2 * part.cast("int") + 1.5 * hint.cast("int") + F.least("r.mentions", F.lit(25)) / 25
    reasons = F.concat_ws("|", F.when(same, "base"), F.when(shared, "alias"), F.when(part, "part"), F.when(hint, "title"))
    return m.where(same | shared | part).select(F.col("x").alias("entity"), F.col("y").alias("candidate"), "type", F.round(points, 2).alias("score"), reasons.alias("reasons"), "r.mentions", "r.name")




def order() -> list[Column]:
    return [F.desc("score"), F.desc("mentions"), F.desc("name"), F.asc("candidate")]


RANKED = "row_number() over (partition by entity order by score desc, mentions desc, name desc, candidate)"
q("jn_merge_block", f"with {PEOPLE_SQL} select entity, candidate from s")(lambda e: merge_scores(e).select("entity", "candidate"))
q("er_score", f"with {PEOPLE_SQL} select entity, candidate, score, reasons from s")(lambda e: merge_scores(e).select("entity", "candidate", "score", "reasons"))
q("q_merge_score", f"with {PEOPLE_SQL} select type, reasons, count(*) pairs, max(score) best from s group by 1, 2")(lambda e: merge_scores(e).groupBy("type", "reasons").agg(long_count("pairs"), F.max("score").alias("best")))
q("er_candidates", f"with {PEOPLE_SQL} select entity, candidate, score from s qualify {RANKED} <= 5")(lambda e: first_by(merge_scores(e), ["entity"], *order(), n=5).select("entity", "candidate", "score"))
q("set_candidate_dedup", f"with {PEOPLE_SQL} select type, candidate, score from (select type, candidate, score, mentions, name from s qualify row_number() over (partition by type, candidate order by score desc, mentions desc, name desc, entity) = 1) qualify row_number() over (partition by type order by score desc, mentions desc, name desc, candidate) <= 3")(
    lambda e: first_by(first_by(merge_scores(e), ["type", "candidate"], F.desc("score"), F.desc("mentions"), F.desc("name"), F.asc("entity")), ["type"], *order(), n=3).select("type", "candidate", "score")
)
STATUS = "case {0} " + " ".join(f"when '{k}' then {v}" for k, v in STATUS_RANK.items()) + " else 0 end"
PAIRED = f"with {PEOPLE_SQL}, d as (select distinct least(entity, candidate) a, greatest(entity, candidate) b from s), o as (select d.a, d.b, (y.mentions, {STATUS.format('y.eff')}, length(y.name), y.name) > (x.mentions, {STATUS.format('x.eff')}, length(x.name), x.name) up from d join p x on x.id = d.a join p y on y.id = d.b)"


def directed(e: Evidence, pairs: DataFrame) -> DataFrame:
    """(a, b, source, target) of pairs (a, b): the one with fewer mentions, lower status, shorter and lesser name becomes the other; ties go to the left."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in STATUS_RANK.items() for x in kv])[F.col("eff")], F.lit(0))
    p = resolvable(e).select("id", F.struct("mentions", rank.alias("s"), F.length("name").alias("l"), "name").alias("k"))
    d = pairs.join(p.select(F.col("id").alias("a"), F.col("k").alias("ka")), "a").join(p.select(F.col("id").alias("b"), F.col("k").alias("kb")), "b")
    up = F.col("kb") > F.col("ka")
    return d.select("*", F.when(up, F.col("a")).otherwise(F.col("b")).alias("source"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("target")).drop("ka", "kb")


def unordered(scores: DataFrame) -> DataFrame:
    return scores.groupBy(F.least("entity", "candidate").alias("a"), F.greatest("entity", "candidate").alias("b")).agg(F.max("score").alias("score"))


q("er_direction", PAIRED + " select case when up then a else b end source, case when up then b else a end target from o")(lambda e: directed(e, unordered(merge_scores(e))).select("source", "target"))
SEEN = "select least(source_entity_id, target_entity_id) a, greatest(source_entity_id, target_entity_id) b from entity_merge_reviews group by 1, 2 having arg_max(review_status, id) in ('approved', 'rejected')"
QUEUE = f"with {PEOPLE_SQL}, t as (select * from s qualify {RANKED} <= 3), u as (select least(entity, candidate) a, greatest(entity, candidate) b, max(score) score from t where score >= 5 group by 1, 2) select u.a, u.b, u.score from u join p x on x.id = u.a join p y on y.id = u.b where not exists (select 1 from ({SEEN}) v where v.a = u.a and v.b = u.b)"


def queue(e: Evidence) -> DataFrame:
    """(a, b, score): the pairs to be reviewed, of the three best candidates of each entity those of 5 and more that nobody has decided."""
    pairs = unordered(first_by(merge_scores(e), ["entity"], *order(), n=3).where("score >= 5"))
    log = e.table("entity_merge_reviews").groupBy(F.least("source_entity_id", "target_entity_id").alias("a"), F.greatest("source_entity_id", "target_entity_id").alias("b")).agg(F.max_by("review_status", "id").alias("s"))
    return pairs.join(log.where("s in ('approved', 'rejected')"), ["a", "b"], "left_anti")


q("er_queue", QUEUE)(queue)


@q("er_review_queue")
def er_review_queue(e: Evidence) -> DataFrame:
    """(section, id, other, weight): what waits for a reviewer: identities and relations without a review, suspect names, pairs to merge; noise is no identity to review."""
    noise = F.round(Q.entity_noise(F.col("type"), F.col("canonical_name"), F.col("attrs")["identity_status"], F.coalesce("hints", F.array().cast("array<string>"))), 2)
    ents = e.active.select("id", noise.alias("noise"), F.col("attrs")["identity_status"].alias("status"))
    none = F.lit(None).cast("long")
    open_ids = ents.where("noise < 0.45 and status in ('ambiguous', 'contextual')").join(e.identity_reviews.select(F.col("entity_id").alias("id")), "id", "left_anti")
    open_rels = e.relations.select("id", "confidence").join(e.relation_reviews.select(F.col("relation_id").alias("id")), "id", "left_anti")
    parts = [
        open_ids.select(F.lit("identity").alias("section"), "id", none.alias("other"), F.lit(0.0).alias("weight")),
        open_rels.select(F.lit("relation"), "id", none, F.coalesce("confidence", F.lit(0.0))),
        ents.where("noise >= 0.45").select(F.lit("suspect"), "id", none, "noise"),
        queue(e).select(F.lit("merge"), "a", "b", "score"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


q("cq_review_queue")(lambda e: er_review_queue(e).groupBy("section").agg(long_count("waiting"), F.max("weight").alias("most")))

# merges


@q("er_exact_dup", "select a.id, first_value(a.id) over w target from (select a.id, a.type, lower(trim(a.canonical_name)) k, coalesce(n, 0) n, count(*) over (partition by a.type, lower(trim(a.canonical_name))) g from act a left join (select entity_id, count(*) n from entity_mentions group by 1) m on m.entity_id = a.id where trim(a.canonical_name) <> '') a where g > 1 window w as (partition by a.type, a.k order by a.n desc, a.id)")
def er_exact_dup(e: Evidence) -> DataFrame:
    """(id, target) of the active entities of one type and name: the one with the most mentions, of equals the smallest id, takes the others in."""
    counts = e.mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("n"))
    p = e.active.where("trim(canonical_name) <> ''").select("id", "type", F.lower(F.trim("canonical_name")).alias("k")).join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = p.groupBy("type", "k").agg(F.max(F.struct("n", (-F.col("id")).alias("neg"))).alias("t"), F.count("*").alias("g")).where("g > 1")
    return p.join(g, ["type", "k"]).select("id", (-F.col("t.neg")).alias("target"))


@q("er_auto")
def er_auto(e: Evidence) -> DataFrame:
    """(source, target, score): merges without a reviewer. Each legible person goes into its best legible candidate that outranks it by mentions and id,
    with a score of 5.5 at least and 200 mentions at most of its own. Targets always outrank their sources, so there are no circles."""
    own = resolvable(e).where("type = 'person'").where(Q.legible_for_merge(F.col("name"))).where("mentions >= 2").select(F.col("id").alias("entity"), F.col("mentions").alias("have"))
    good = merge_scores(e).where("score >= 5.5").join(own, "entity").join(own.select(F.col("entity").alias("candidate")), "candidate", "left_semi")
    better = good.where("have <= 200 and (mentions > have or mentions = have and candidate < entity)")
    return first_by(better, ["entity"], *order()).select(F.col("entity").alias("source"), F.col("candidate").alias("target"), "score")


MERGED = X.MERGE + ", mp as (select e.id, coalesce(h.c, e.id) target from entities e left join h6 h on h.u = e.id)"


def merged_into(e: Evidence) -> DataFrame:
    """(id, target) of every entity under the approved merges, chains followed to the end."""
    m = X.merge_map(e).select(F.col("node").alias("id"), "component")
    return e.table("entities").select("id").join(m, "id", "left").select("id", F.coalesce("component", "id").alias("target"))


@q("snk_merge_entities", MERGED + " select distinct coalesce(s.target, r.subject_entity_id) subject_id, r.predicate, coalesce(o.target, r.object_entity_id, 0) object_id, coalesce(r.object_literal, '') literal from relations r left join mp s on s.id = r.subject_entity_id left join mp o on o.id = r.object_entity_id where coalesce(coalesce(s.target, r.subject_entity_id) <> coalesce(o.target, r.object_entity_id), true)")
def snk_merge_entities(e: Evidence) -> DataFrame:
    """The relations after the merges: ends moved to the target, relations of an entity with itself gone, repeated ones folded."""
    m = merged_into(e)
    r = e.relations.join(m.select(F.col("id").alias("subject_entity_id"), F.col("target").alias("s")), "subject_entity_id", "left").join(m.select(F.col("id").alias("object_entity_id"), F.col("target").alias("o")), "object_entity_id", "left")
    r = r.withColumn("s", F.coalesce("s", "subject_entity_id")).withColumn("o", F.coalesce("o", "object_entity_id")).where("coalesce(s <> o, true)")
    return r.select(F.col("s").alias("subject_id"), "predicate", F.coalesce("o", F.lit(0)).alias("object_id"), F.coalesce("object_literal", F.lit("")).alias("literal")).distinct()


YA = "try_cast(nullif(regexp_extract({0}, '(1[0-9]{{3}}|20[0-9]{{2}})', 1), '') as int)"


@q(
    "er_merge",
    MERGED + f""", men as (select target, count(*) mentions from (select distinct coalesce(x.target, m.entity_id) target, m.page_id, m.chunk_id, m.surface_form from entity_mentions m left join mp x on x.id = m.entity_id) group by 1)
select mp.target, count(*) members, max(coalesce(mentions, 0)) mentions, min(least({YA.format('e.first_seen_year')}, {YA.format('e.last_seen_year')})) first_year, max(greatest({YA.format('e.first_seen_year')}, {YA.format('e.last_seen_year')})) last_year,
  array_to_string(list_sort(list_distinct(flatten(list(list_concat([e.canonical_name], coalesce(case when json_valid(e.aliases_json) then from_json(e.aliases_json, '["VARCHAR"]') end, [])))))), '|') aliases
from mp join entities e on e.id = mp.id left join men on men.target = mp.target group by mp.target having count(*) > 1""",
)
def er_merge(e: Evidence) -> DataFrame:
    """What each target of the merges has become: its members, mentions without repeats, years from the first to the last, and the names of all members."""
    m = merged_into(e)
    mentions = e.mentions.join(m.withColumnRenamed("id", "entity_id"), "entity_id", "left").select(F.coalesce("target", "entity_id").alias("target"), "page_id", "chunk_id", "surface_form").distinct()
    mentions = mentions.groupBy("target").agg(F.count("*").alias("mentions"))
    rows = e.table("entities").join(m, "id")
    listed = F.coalesce(F.from_json("aliases_json", "array<string>", {"allowSingleQuotes": "false"}), F.array().cast("array<string>"))
    a, b = year_any(F.col("first_seen_year")), year_any(F.col("last_seen_year"))
    names = rows.select("target", F.explode(F.concat(F.array("canonical_name"), listed)).alias("name")).where("name is not null").groupBy("target").agg(F.array_join(F.array_sort(F.collect_set("name")), "|").alias("aliases"))
    g = rows.groupBy("target").agg(long_count("members"), F.min(F.least(a, b)).alias("first_year"), F.max(F.greatest(a, b)).alias("last_year")).where("members > 1")
    return g.join(names, "target", "left").join(mentions, "target", "left").withColumn("mentions", F.coalesce("mentions", F.lit(0)))


# registers: kinship

NORM = "trim(regexp_replace(regexp_replace(regexp_replace(trim(lower(strip_accents({0}))), '\\bd['' ]\\b', 'de ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: What stands for an unknown parent.
UNKNOWN = ["", "?", "incognito", "incognita", "pai incognito", "mae incognita", "pai incerto", "pais incognitos", "desconhecido", "nao mencionado"]
NOT_UNKNOWN = "({})".format(", ".join(f"'{u}'" for u in UNKNOWN))
#: (column of the one, predicate, column of the other)
KIN = [
    ("person_name", "child_of", "father_name"), ("person_name", "child_of", "mother_name"), ("person_name", "spouse", "spouse_name"), ("father_name", "child_of", "paternal_grandfather"),
    ("father_name", "child_of", "paternal_grandmother"), ("mother_name", "child_of", "maternal_grandfather"), ("mother_name", "child_of", "maternal_grandmother"),
]
GOD = "select unnest(from_json(godparents_json, '[\"VARCHAR\"]')) g, person_name from parish_records where json_valid(godparents_json)"
PR_SQL = "select distinct src, predicate, dst from (" + " union all ".join(f"select {NORM.format(a)} src, '{p}' predicate, {NORM.format(b)} dst from parish_records" for a, p, b in KIN) + f" union all select {NORM.format('g')}, 'godparent_of', {NORM.format('person_name')} from ({GOD})) where src not in {NOT_UNKNOWN} and dst not in {NOT_UNKNOWN} and src <> dst"


def kinship(e: Evidence) -> DataFrame:
    """(src, predicate, dst) between normal names: parents, grandparents through the parent, spouses and godparents; unknown ones and oneself left out."""
    p, n = e.table("parish_records"), lambda c: T.normalize_parish(F.col(c))
    rows = p.select(F.inline(F.array(*[F.struct(n(a).alias("src"), F.lit(k).alias("predicate"), n(b).alias("dst")) for a, k, b in KIN])))
    god = p.select(F.explode(F.from_json("godparents_json", "array<string>", {"allowSingleQuotes": "false"})).alias("g"), "person_name").select(n("g").alias("src"), F.lit("godparent_of").alias("predicate"), n("person_name").alias("dst"))
    both = rows.unionByName(god)
    return both.where(~F.col("src").isin(*UNKNOWN) & ~F.col("dst").isin(*UNKNOWN) & (F.col("src") != F.col("dst"))).distinct()


q("pr_graph", PR_SQL)(kinship)


def bounded_walk(depth: int) -> str:
    sql = f"with ed(src, dst) as (select src, dst from ({PR_SQL}) union select dst, src from ({PR_SQL})), d0 as (select min(src) node from ed)"
    for k in range(1, depth + 1):
        sql += f", d{k} as (select dst node from ed where src in (select node from d{k - 1}))"
    return sql + " select node, min(hops)::int hops from (" + " union all ".join(f"select node, {k} hops from d{k}" for k in range(depth + 1)) + ") where node is not null group by 1"


@q("pr_subgraph", bounded_walk(2))
def pr_subgraph(e: Evidence) -> DataFrame:
    """The people within two steps of the first name, in any direction."""
    k = kinship(e).select("src", "dst")
    both = k.union(k.select("dst", "src")).distinct()
    return distances(both, both.agg(F.min("src").alias("node")), 2)


YEAR4 = "try_cast(nullif(regexp_extract(event_date, '([0-9]{4})', 1), '') as int)"


def sql_id(c: str, back: int) -> str:
    n = NORM.format(c)
    return f"case when {n} not in {NOT_UNKNOWN} then {n} || coalesce('_' || ((({YEAR4} - {back}) // 10) * 10), '') end"


TREE = " union ".join(
    f"select {sql_id(parent, up)} parent, {sql_id(child, down)} child from parish_records"
    for parent, up, child, down in (("father_name", 25, "person_name", 0), ("mother_name", 25, "person_name", 0), ("paternal_grandfather", 50, "father_name", 25), ("maternal_grandfather", 50, "mother_name", 25))
)
GENERATIONS = 5


@q(
    "pr_trees",
    f"with recursive ed as (select distinct * from ({TREE}) where parent <> child), roots as (select distinct parent root from ed where parent not in (select child from ed)), reach(root, node, depth) as (select root, root, 0 from roots union select r.root, e.child, r.depth + 1 from reach r join ed e on e.parent = r.node where r.depth < {GENERATIONS}) "
    "select root, count(distinct node) descendants, max(depth)::int generations from (select root, node, min(depth) depth from reach group by 1, 2) group by 1 having count(distinct node) >= 3",
)
def pr_trees(e: Evidence) -> DataFrame:
    """(root, descendants, generations): people are name and decade, parents 25 years earlier, grandfathers 50; roots have no parents. Descendants count the root
    and go five generations down, one join a generation."""
    p = e.table("parish_records")
    year = F.nullif(F.regexp_extract("event_date", "([0-9]{4})", 1), F.lit("")).cast("int")

    def ident(c: str, back: int) -> Column:
        n = T.normalize_parish(F.col(c))
        decade = (F.floor((year - back) / 10) * 10).cast("int").cast("string")
        return F.when(~n.isin(*UNKNOWN), F.concat(n, F.coalesce(F.concat(F.lit("_"), decade), F.lit(""))))

    links = [("father_name", 25, "person_name", 0), ("mother_name", 25, "person_name", 0), ("paternal_grandfather", 50, "father_name", 25), ("maternal_grandfather", 50, "mother_name", 25)]
    edges = p.select(F.inline(F.array(*[F.struct(ident(a, x).alias("parent"), ident(b, y).alias("child")) for a, x, b, y in links]))).where("parent <> child").distinct()
    edges = cut(edges)
    roots = edges.select(F.col("parent").alias("root")).distinct().join(edges.select(F.col("child").alias("root")), "root", "left_anti")
    front = roots.select("root", F.col("root").alias("node")).withColumn("depth", F.lit(0))
    seen = front
    for k in range(1, GENERATIONS + 1):
        front = cut(front.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct().withColumn("depth", F.lit(k)))
        seen = seen.unionByName(front)
    least = seen.groupBy("root", "node").agg(F.min("depth").alias("depth"))
    return least.groupBy("root").agg(long_count("descendants"), F.max("depth").alias("generations")).where("descendants >= 3")


@q("pr_stats", f"select 'records' metric, lower(record_type) key, count(*) v from parish_records group by 2 union all select 'parishes', '', count(distinct (parish, island)) from parish_records union all select 'edges', predicate, count(*) from ({PR_SQL}) group by 2 union all select 'people', '', count(*) from (select src from ({PR_SQL}) union select dst from ({PR_SQL}))")
def pr_stats(e: Evidence) -> DataFrame:
    """(metric, key, v): records by type, parishes, and people and edges of the kinship graph."""
    p, k = e.table("parish_records"), cut(kinship(e))
    parts = [
        p.groupBy(F.lit("records").alias("metric"), F.lower("record_type").alias("key")).agg(long_count("v")),
        p.where("parish is not null or island is not null").select("parish", "island").distinct().agg(long_count("v")).select(F.lit("parishes"), F.lit(""), "v"),
        k.groupBy(F.lit("edges"), "predicate").agg(long_count("v")),
        k.select("src").union(k.select("dst")).distinct().agg(long_count("v")).select(F.lit("people"), F.lit(""), "v"),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.union(x)
    return out


@q("pr_search", "select id, person_name, event_date from parish_records where person_name ilike '%silva%' or father_name ilike '%silva%' or mother_name ilike '%silva%' order by event_date nulls first, id limit 20")
def pr_search(e: Evidence) -> DataFrame:
    rows = e.table("parish_records").where("person_name ilike '%silva%' or father_name ilike '%silva%' or mother_name ilike '%silva%'").select("id", "person_name", "event_date")
    return top(rows, F.asc_nulls_first("event_date"), F.asc("id"), n=20)


# registers and newspapers

#: Names that are too common to look for, and prepositions that don't count as common words.
COMMON = ["jesus", "sousa", "silva", "costa", "maria", "santos", "jose", "joze", "manoel", "antonio", "francisco", "joao", "anna", "joaquim", "pedro"]
PREPOSITIONS = ["de", "da", "do", "das", "dos", "e"]
_IN = lambda xs: ", ".join(f"'{x}'" for x in xs)
FIELDS = ("father_name", "mother_name", "person_name")
XREF = f"""
with n as (select id, f, trim(nm) nm, {NORM.format('nm')} k, {YEAR4} yr from (""" + " union all ".join(f"select id, {i} f, {c} nm, event_date from parish_records" for i, c in enumerate(FIELDS)) + f""") where length(trim(nm)) >= 5 and contains(trim(nm), ' ')),
sub as (select *, list_filter(string_split(k, ' '), lambda x: length(x) >= 4 and x not in ({_IN(COMMON)}))[1:2] toks from n),
one as (select * from sub where len(toks) > 0 qualify row_number() over (partition by k order by id, f) = 1),
pe as (select e.id, e.canonical_name nm, {NORM.format('e.canonical_name')} k, count(*) mentions, min({YA.format('p.ano')}) yr from entities e join entity_mentions m on m.entity_id = e.id join pages p on p.id = m.page_id where e.type = 'person' and length(e.canonical_name) >= 8 group by all having count(*) >= 2),
w as (select id, mentions, unnest(list_distinct(string_split(k, ' '))) x from pe),
blk as (select x, id from w where length(x) >= 4 and x not in ({_IN(COMMON)}) qualify row_number() over (partition by x order by mentions desc, id) <= 10),
pr as (select distinct one.k, blk.id from (select k, unnest(toks) x from one) one join blk using (x)),
sc as (select one.id record_id, one.f, one.k name_key, pe.id entity_id, pe.mentions, pe.yr - one.yr gap, one.k = pe.k same,
  list_filter(list_distinct(string_split(one.k, ' ')), lambda x: x not in ({_IN(PREPOSITIONS)})) ta, list_filter(list_distinct(string_split(pe.k, ' ')), lambda x: x not in ({_IN(PREPOSITIONS)})) tb from pr join one on one.k = pr.k join pe on pe.id = pr.id),
st as (select *, list_intersect(ta, tb) common, len(list_intersect(ta, tb)) / greatest(len(ta), len(tb), 1) overlap from sc),
b as (select *, case when same then 0.95::double when overlap >= 0.8 then 0.85::double when overlap >= 0.5 then 0.65::double when len(common) >= 2 then 0.5::double when len(common) = 1 and length(common[1]) >= 5 then 0.35::double end base from st),
t as (select *, case when gap is null then base when f = 2 then case when gap between 15 and 70 then base + 0.1::double when gap < 0 or gap > 80 then base * 0.3::double else base end else case when gap between 0 and 80 then base + 0.05::double when gap < -20 or gap > 100 then base * 0.3::double else base end end timed from b where base is not null),
cf as (select record_id, f, name_key, entity_id, mentions, least(round(timed + case when f < 2 and len(common) >= 2 then 0.05::double else 0 end + 1e-9, 2), 0.99) confidence from t)"""


def blocks(e: Evidence) -> tuple[DataFrame, DataFrame]:
    """(people of the newspapers, (x, entity_id): the ten most mentioned of them for each word of four letters that isn't a common name)."""
    m = e.mentions.join(e.table("pages").select(F.col("id").alias("page_id"), year_any(F.col("ano")).alias("yr")), "page_id")
    m = m.groupBy(F.col("entity_id")).agg(F.count("*").alias("mentions"), F.min("yr").alias("pe_yr")).where("mentions >= 2")
    pe = e.table("entities").where("type = 'person' and length(canonical_name) >= 8").select(F.col("id").alias("entity_id"), T.normalize_parish(F.col("canonical_name")).alias("pk")).join(m, "entity_id")
    words = pe.select("entity_id", "mentions", F.explode(F.array_distinct(F.split("pk", " "))).alias("x")).where((F.length("x") >= 4) & ~F.col("x").isin(*COMMON))
    return pe, first_by(words, ["x"], F.desc("mentions"), F.asc("entity_id"), n=10).select("x", "entity_id")


def cross_reference(e: Evidence) -> DataFrame:
    """(record_id, f, name_key, entity_id, mentions, confidence): names of the registers, fathers' and mothers' too, and people of the newspapers.

    Of a name the first record counts; it is looked for by its first two words that tell something, among the ten most mentioned people of each. The confidence
    comes from the words in common, the years between (by whether a child or a parent is meant) and the fuller names of parents.
    """
    pe, block = blocks(e)
    year = F.nullif(F.regexp_extract("event_date", "([0-9]{4})", 1), F.lit("")).cast("int")
    rows = e.table("parish_records").select("id", year.alias("yr"), F.inline(F.array(*[F.struct(F.lit(i).alias("f"), F.trim(c).alias("nm")) for i, c in enumerate(FIELDS)])))
    rows = rows.where("length(nm) >= 5 and contains(nm, ' ')").withColumn("k", T.normalize_parish(F.col("nm")))
    rows = rows.withColumn("toks", F.slice(F.filter(F.split("k", " "), lambda x: (F.length(x) >= 4) & ~x.isin(*COMMON)), 1, 2)).where("size(toks) > 0")
    one = first_by(rows, ["k"], F.asc("id"), F.asc("f"))
    met = one.select("k", F.explode("toks").alias("x")).join(block, "x").select("k", "entity_id").distinct().join(one, "k").join(pe, "entity_id")
    told = lambda c: F.filter(F.array_distinct(F.split(c, " ")), lambda x: ~x.isin(*PREPOSITIONS))
    met = met.withColumns({"ta": told("k"), "tb": told("pk"), "gap": F.col("pe_yr") - F.col("yr")}).withColumn("common", F.array_intersect("ta", "tb"))
    n, gap, child = F.size("common"), F.col("gap"), F.col("f") == 2
    overlap = n / F.greatest(F.size("ta"), F.size("tb"), F.lit(1))
    base = F.when(F.col("k") == F.col("pk"), 0.95).when(overlap >= 0.8, 0.85).when(overlap >= 0.5, 0.65).when(n >= 2, 0.5).when((n == 1) & (F.length(F.get("common", F.lit(0))) >= 5), 0.35)
    b = F.col("base")
    own = F.when(gap.between(15, 70), b + 0.1).when((gap < 0) | (gap > 80), b * 0.3).otherwise(b)
    parent = F.when(gap.between(0, 80), b + 0.05).when((gap < -20) | (gap > 100), b * 0.3).otherwise(b)
    timed = F.when(gap.isNull(), b).when(child, own).otherwise(parent)
    met = met.withColumn("base", base).where("base is not null").withColumn("c", F.least(F.round(timed + F.when(~child & (n >= 2), 0.05).otherwise(0.0) + 1e-9, 2), F.lit(0.99)))
    return met.select(F.col("id").alias("record_id"), "f", F.col("k").alias("name_key"), "entity_id", "mentions", F.col("c").alias("confidence"))


q("jn_substring_block", XREF + " select x, id entity_id from blk")(lambda e: blocks(e)[1])
q("pr_conf", XREF + " select record_id, name_key, entity_id, confidence from cf")(lambda e: cross_reference(e).select("record_id", "name_key", "entity_id", "confidence"))
q("pr_crossref", XREF + " select record_id, f, entity_id, confidence, mentions from cf where confidence >= 0.4")(lambda e: cross_reference(e).where("confidence >= 0.4").select("record_id", "f", "entity_id", "confidence", "mentions"))
q("gr_bridges", XREF + ", o as (select * from cf where confidence >= 0.6 qualify row_number() over (partition by entity_id order by confidence desc, name_key) = 1) select entity_id, name_key, confidence from o order by confidence desc, mentions desc, entity_id limit 80")(
    lambda e: top(first_by(cross_reference(e).where("confidence >= 0.6"), ["entity_id"], F.desc("confidence"), F.asc("name_key")), F.desc("confidence"), F.desc("mentions"), F.asc("entity_id"), n=80).select("entity_id", "name_key", "confidence")
)
