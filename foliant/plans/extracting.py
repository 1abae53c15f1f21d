"""Queries of the extraction from text: entities, relations and identities of documents, and the functions they are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicon as L
from foliant.functions import quality as Q
from foliant.functions import text as T
from foliant.operators import extraction as X
from foliant.plans.prelude import registrar
from foliant.plans.relational import long_count
from foliant.sources.evidence import Evidence

reg, q = registrar()


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def texts(e: Evidence) -> DataFrame:
    return e.table("documents").where("text is not null").select("doc_id", "bib", "ano", "text")


# patterns: what they match, by engines alone


def matched(name: str, pattern: str, group: int) -> None:
    """The matches of a pattern and how often each occurs in a text."""
    sql = f"select doc_id, name, count(*) n from (select doc_id, unnest(regexp_extract_all(text, {quoted(pattern)}, {group})) as name from documents where text is not null) group by 1, 2"

    @q(name, sql)
    def build(e: Evidence) -> DataFrame:
        found = F.explode(F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group)))
        return texts(e).select("doc_id", found.alias("name")).groupBy("doc_id", "name").agg(long_count("n"))


def bare(pattern: str) -> str:
    """A pattern without named groups and word boundaries, which engines read differently."""
    return pattern.replace(r"\b", "").replace("(?P<title>", "(?:").replace("(?P<name>", "(").replace("(?P<place>", "(").replace("(?P<subject>", "(").replace("(?P<object>", "(")


matched("rx_person", bare(L.PERSON.pattern), 1)
matched("rx_institution", bare(L.INSTITUTION.pattern), 0)
matched("rx_place", bare(L.PLACE.pattern), 1)
matched("rx_residence", bare(f"{L.NAME}{L.RESIDENCE.pattern}"), 1)
matched("rx_year", "(1[0-9]{3}|20[0-9]{2})", 1)
matched("rx_named_signal", f"[{L.UPPER}][{L.LOWER}]+(?: (?:(?:de|da|do|das|dos|e) )?[{L.UPPER}][{L.LOWER}]+)+", 0)
RELATIONS = [(p, bare(pattern.pattern), 2 if "(?P<object>" in pattern.pattern else 1) for p, pattern, _, _ in L.RELATIONS]
AFTER = [(p, "(?i)" + pattern.pattern.replace(r"[\w\s", "[a-z0-9_À-ÿ ").replace(f"[{L.UPPER}]", f"[{L.UPPER}{L.LOWER}]")) for p, pattern, _ in L.AFTER_NAMES]


def _all(pattern: str, group: int) -> Column:
    return F.regexp_extract_all(F.col("text"), F.lit(pattern), F.lit(group))


@q(
    "rx_relations",
    "select distinct * from ("
    + " union all ".join(
        f"select doc_id, '{k}' predicate, unnest(regexp_extract_all(text, {quoted(p)}, 1)) subject, "
        + (f"unnest(regexp_extract_all(text, {quoted(p)}, 2))" if n == 2 else "''")
        + f" object from documents where text is not null{'' if n == 2 else ' and len(regexp_extract_all(text, ' + quoted(p) + ')) > 0'}"
        for k, p, n in RELATIONS
    )
    + ")",
)
def rx_relations(e: Evidence) -> DataFrame:
    """What each of the ten patterns matches, before any rule."""

    def found(kind: str, pattern: str, groups: int) -> Column:
        objects = _all(pattern, 2) if groups == 2 else F.transform(_all(pattern, 1), lambda _: F.lit(""))
        pairs = F.arrays_zip(_all(pattern, 1).alias("s"), objects.alias("o"))
        return F.transform(pairs, lambda x: F.struct(F.lit(kind).alias("predicate"), x["s"].alias("subject"), x["o"].alias("object")))

    return texts(e).select("doc_id", F.inline(F.concat(*[found(*r) for r in RELATIONS]))).distinct()


@q(
    "rx_ocr_tolerant",
    "select distinct * from (" + " union all ".join(f"select doc_id, '{k}' predicate, unnest(regexp_extract_all(text, {quoted(p)}, 1)) object from documents where text is not null" for k, p in AFTER) + ")",
)
def rx_ocr_tolerant(e: Evidence) -> DataFrame:
    """What the patterns for badly read text match anywhere, in any case."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(_all(pattern, 1), lambda x: F.struct(F.lit(kind).alias("predicate"), x.alias("object")))

    return texts(e).select("doc_id", F.inline(F.concat(*[found(*r) for r in AFTER]))).distinct()


# entities and relations with all their rules


def facts(e: Evidence, with_relations: bool = True) -> DataFrame:
    return X.facts(texts(e), "doc_id", "text", "ano", with_relations).withColumnRenamed("id", "doc_id")


def found(e: Evidence) -> DataFrame:
    rows = facts(e, False).select("doc_id", F.posexplode("entities").alias("place", "x")).select("doc_id", "place", "x.*")
    return rows.withColumn("aliases", F.array_join("aliases", "|")).withColumn("hints", F.array_join("hints", "|")).withColumn("confidence", F.round("confidence", 6))


def said(e: Evidence) -> DataFrame:
    return facts(e).select("doc_id", F.inline("relations")).withColumn("confidence", F.round("confidence", 6))


ENTITY = ["doc_id", "name", "normalized", "surface", "aliases", "confidence", "role", "title"]
RELATION = ["doc_id", "subject", "predicate", "object", "literal", "confidence", "status", "quote"]
q("tf_people")(lambda e: found(e).where("type = 'person'").select(*ENTITY))
q("tf_institutions")(lambda e: found(e).where("type = 'institution'").select(*ENTITY[:6]))
q("tf_places")(lambda e: found(e).where("type = 'place'").select(*ENTITY[:6]))
q("tf_entities")(lambda e: found(e).select("doc_id", "place", "type", "name", "confidence"))
q("tf_identity")(lambda e: found(e).select("doc_id", "type", "normalized", "identity_key", "status", F.round("identity_confidence", 6).alias("confidence"), "hints"))
q("tf_rel_role")(lambda e: said(e).where("method = 'title_heuristic'").select(*RELATION))
q("tf_rel_pattern")(lambda e: said(e).where("method = 'pattern_heuristic' and predicate <> 'resident_of'").select(*RELATION))
q("tf_rel_residence")(lambda e: said(e).where("predicate = 'resident_of'").select(*RELATION))
q("tf_rel_ocr")(lambda e: said(e).where("method = 'ocr_tolerant_heuristic'").select(*RELATION))
q("tf_rel_cooccur")(lambda e: said(e).where("predicate = 'mentioned_with'").select(*RELATION))


@q("tf_chunk_to_facts")
def tf_chunk_to_facts(e: Evidence) -> DataFrame:
    """For each text the numbers of entities, mentions, relations and evidence it yields; the evidence of a relation is its quote, else its subject."""
    quotes = F.filter("relations", lambda r: F.coalesce(F.nullif(r["quote"], F.lit("")), r["subject"]).isNotNull())
    return facts(e).select("doc_id", *[F.size(c).cast("long").alias(n) for c, n in (("entities", "entities"), ("entities", "mentions"), ("relations", "relations"), (quotes, "evidences"))])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(long_count("texts"), F.sum(F.size("entities")).cast("long").alias("entities"), F.sum(F.size("relations")).cast("long").alias("relations"))


@q("tf_process_bib")
def tf_process_bib(e: Evidence) -> DataFrame:
    """The texts of one collection."""
    first = e.table("documents").agg(F.min("bib").alias("bib"))
    rows = texts(e).join(F.broadcast(first), "bib", "left_semi")
    return _counted(X.facts(rows.select("doc_id", "text", "ano"), "doc_id", "text", "ano"))


@q("tf_process_all")
def tf_process_all(e: Evidence) -> DataFrame:
    """The texts of every collection, and the totals of each."""
    return _counted(facts(e).join(texts(e).select("doc_id", "bib"), "doc_id"), "bib")


@q("tf_rag_people")
def tf_rag_people(e: Evidence) -> DataFrame:
    """For each surname of the people of collection one, the ten first names in its sources that hold it."""
    people = found(e).where("type = 'person'").select("doc_id", "name", F.element_at(F.split("normalized", " "), -1).alias("surname")).distinct()
    first = people.groupBy("surname", "name").agg(F.min("doc_id").alias("doc_id"))
    top = F.slice(F.array_sort(F.collect_list(F.struct("doc_id", "name"))), 1, 10)
    ranked = first.withColumn("k", F.expr("row_number() over (partition by surname order by doc_id, name)")).where("k <= 10")
    return ranked.groupBy("surname").agg(F.array_join(F.transform(top, lambda x: x["name"]), "|").alias("names"))


# names

FOLDED = "trim(regexp_replace(regexp_replace(replace(replace(regexp_replace(replace(lower(strip_accents({0})), '’', ''''), '\\bd['' ]', 'de ', 'g'), 'benedicto', 'benedito'), 'affonso', 'afonso'), '[^a-z0-9''\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
TITLE_OF = "case {0} " + " ".join(f"when '{k}' then '{v}'" for k, v in L.TITLES.items()) + " else '' end"
OUTER = "trim(regexp_replace(regexp_replace(canonical_name, '^[ ,.;:-]+|[ ,.;:-]+$', '', 'g'), '\\s+', ' ', 'g'))"
PARTICLE_LIST = ", ".join(f"'{p}'" for p in sorted(L.PARTICLES))
MAIN = f"case when len(string_split({OUTER}, ' ')) <= 2 then {OUTER} else array_to_string(list_filter(string_split({OUTER}, ' '), lambda x: {FOLDED.format('x')} not in ({PARTICLE_LIST})), ' ') end"


def main_name(c: Column) -> Column:
    outer = T.compact(F.regexp_replace(c, r"^[ ,.;:-]+|[ ,.;:-]+$", ""))
    words = F.split(outer, " ")
    return F.when(F.size(words) <= 2, outer).otherwise(F.array_join(F.filter(words, lambda w: ~T.normalize_name(w).isin(*sorted(L.PARTICLES))), " "))


def title_label(c: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in L.TITLES.items() for x in kv])
    return F.coalesce(labels[T.normalize_name(c)], F.lit(""))


@q("fn_canon_person", f"select id, {MAIN} v, {TITLE_OF.format(FOLDED.format('split_part(canonical_name, chr(32), 1)'))} title from entities")
def fn_canon_person(e: Evidence) -> DataFrame:
    name = F.col("canonical_name")
    return e.table("entities").select("id", main_name(name).alias("v"), F.coalesce(title_label(F.split_part(name, F.lit(" "), F.lit(1))), F.lit("")).alias("title"))


CAPITALS = f"array_to_string(list_transform(string_split({FOLDED.format('n')}, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
ALIASES = (
    "[n, case when n ilike '%affonso%' then regexp_replace(n, 'affonso', 'Afonso', 'gi') end, case when n ilike '%benedicto%' then regexp_replace(n, 'benedicto', 'Benedito', 'gi') end, "
    f"case when n ilike '%d''%' then regexp_replace(n, '\\bd[''’]', 'de ', 'gi') end, case when n ilike '% de %' then regexp_replace(n, '\\bde\\s+([{L.UPPER}])', 'd''\\1', 'g') end, {CAPITALS}]"
)


@q("fn_aliases", f"select id, array_to_string(list_sort(list_distinct(list_filter({ALIASES}, lambda x: trim(x) <> ''))), '|') v from (select id, trim(canonical_name) n from entities where canonical_name is not null and not regexp_matches(canonical_name, '[^\\x00-\\x7F]'))")
def fn_aliases(e: Evidence) -> DataFrame:
    """The spellings under which a name may be searched (names in plain letters, where engines agree on what a word is)."""
    n = F.col("n")
    like = lambda x: F.lower(n).contains(x)
    out = F.array(
        n,
        F.when(like("affonso"), F.regexp_replace(n, "(?i)affonso", "Afonso")),
        F.when(like("benedicto"), F.regexp_replace(n, "(?i)benedicto", "Benedito")),
        F.when(like("d'"), F.regexp_replace(n, r"(?i)\bd['’]", "de ")),
        F.when(like(" de "), F.regexp_replace(n, rf"\bde\s+([{L.UPPER}])", "d'$1")),
        F.array_join(F.transform(F.split(T.normalize_name(n), " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1000))), " "),
    )
    names = e.table("entities").where(r"canonical_name is not null and not canonical_name rlike '[^\\x00-\\x7F]'").select("id", F.trim("canonical_name").alias("n"))
    return names.select("id", F.array_join(F.array_sort(F.array_distinct(F.filter(out, lambda x: F.trim(x) != ""))), "|").alias("v"))


TITLED = f"{FOLDED.format('split_part(canonical_name, chr(32), 1)')} in ({', '.join(repr(k) for k in L.TITLES)})"


@q("fn_person_conf", f"select id, round(least(0.55::double + 0.07::double * least(len(string_split(canonical_name, ' ')), 5) + case when {TITLED} then 0.08::double else 0 end, 0.96), 6) v from entities where canonical_name is not null")
def fn_person_conf(e: Evidence) -> DataFrame:
    name = F.col("canonical_name")
    titled = title_label(F.split_part(name, F.lit(" "), F.lit(1))) != ""
    return e.table("entities").where(name.isNotNull()).select("id", F.round(F.least(0.55 + 0.07 * F.least(F.size(F.split(name, " ")), F.lit(5)) + F.when(titled, 0.08).otherwise(0.0), F.lit(0.96)), 6).alias("v"))


q("tf_truncated", "select id, (length(list_last(string_split(canonical_name, ' '))) <= 3 and regexp_matches(list_last(string_split(canonical_name, ' ')), '^\\p{Lu}') and len(string_split(canonical_name, ' ')) >= 2) or (length(list_last(string_split(canonical_name, ' '))) >= 3 and not regexp_matches(list_last(string_split(canonical_name, ' ')), '(?i)[aeiouáàâãéêíóôõú]')) v from entities")(
    lambda e: e.table("entities").select("id", Q.looks_truncated(F.col("canonical_name")).alias("v"))
)


@q("tf_resolve_name", f"select m.id, coalesce(e.canonical_name, m.raw) v from (select id, {MAIN.replace('canonical_name', 'surface_form')} raw, {FOLDED.format('surface_form')} k from entity_mentions where surface_form <> '') m left join (select {FOLDED.format('canonical_name')} k, arg_min(canonical_name, id) canonical_name from entities where canonical_name is not null group by 1) e using (k)")
def tf_resolve_name(e: Evidence) -> DataFrame:
    """The entity's name for a raw name of the same normal form, else the raw name without particles."""
    known = e.table("entities").where("canonical_name is not null").groupBy(T.normalize_name(F.col("canonical_name")).alias("k")).agg(F.min_by("canonical_name", "id").alias("known"))
    raw = e.mentions.where("surface_form <> ''").select("id", main_name(F.col("surface_form")).alias("raw"), T.normalize_name(F.col("surface_form")).alias("k"))
    return raw.join(known, "k", "left").select("id", F.coalesce("known", "raw").alias("v"))


CANDIDATES = f"""
select r.id relation_id, c.entity_id, a.base_normalized_name = {FOLDED.format('r.object_literal')} exact, a.eff, a.identity_confidence conf, length(a.canonical_name) size
from relations r join (select distinct subject_entity_id, page_id from (select r.subject_entity_id, m.page_id from relations r join entity_mentions m on m.entity_id = r.subject_entity_id where r.object_literal is not null)) p on p.subject_entity_id = r.subject_entity_id
join (select distinct entity_id, page_id from entity_mentions) c on c.page_id = p.page_id
join (select *, coalesce(try_cast(attrs->>'identity_confidence' as double), 0) identity_confidence from ent) a on a.id = c.entity_id
where r.object_literal is not null"""


@q(
    "tf_resolve_rel_entity",
    f"with c as (select distinct * from ({CANDIDATES})) select relation_id, arg_max(entity_id, (exact, eff = 'resolved', eff = 'contextual', conf, size, -entity_id)) entity_id from c group by 1",
)
def tf_resolve_rel_entity(e: Evidence) -> DataFrame:
    """For a relation whose object is a text: the entity on the subject's pages that it means, one of the same name before others, then by status, confidence and length of name."""
    on_pages = e.mentions.select("entity_id", "page_id").distinct()
    asked = e.relations.where("object_literal is not null").select(F.col("id").alias("relation_id"), "subject_entity_id", T.normalize_name(F.col("object_literal")).alias("target"))
    pages = on_pages.withColumnRenamed("entity_id", "subject_entity_id").join(asked.select("subject_entity_id").distinct(), "subject_entity_id", "left_semi")
    near = pages.join(on_pages, "page_id").select("subject_entity_id", "entity_id").distinct()
    facts_of = e.entities.select(F.col("id").alias("entity_id"), "base_normalized_name", "eff", F.coalesce(F.expr("try_cast(attrs['identity_confidence'] as double)"), F.lit(0.0)).alias("conf"), F.length("canonical_name").alias("size"))
    c = asked.join(near, "subject_entity_id").join(facts_of, "entity_id")
    order = F.struct((F.col("base_normalized_name") == F.col("target")).alias("exact"), (F.col("eff") == "resolved").alias("r"), (F.col("eff") == "contextual").alias("c"), "conf", "size", (-F.col("entity_id")).alias("neg"))
    return c.groupBy("relation_id").agg(F.max_by("entity_id", order).alias("entity_id"))


# records in the answers of a model, read back


@q("tf_json_records", "select id, coalesce(attrs->>'title', '') title, coalesce(attrs->>'role', '') as role, attrs is null as scraped from ent where attributes_json like '%{%'")
def tf_json_records(e: Evidence) -> DataFrame:
    """The record in a text: its JSON if it can be parsed, else the fields that a pattern finds in what is left of it."""
    scrape = lambda k: F.when(F.col("attrs").isNotNull(), F.coalesce(F.col("attrs")[k], F.lit(""))).otherwise(F.lit(""))
    return e.entities.where("attributes_json like '%{%'").select("id", scrape("title").alias("title"), scrape("role").alias("role"), F.col("attrs").isNull().alias("scraped"))


@q("rx_json_block", "select id, regexp_extract(attributes_json, '(?s)(\\{.*\\}|\\[.*\\])', 1) v from entities where attributes_json is not null")
def rx_json_block(e: Evidence) -> DataFrame:
    """The object or array inside a text."""
    return e.table("entities").where("attributes_json is not null").select("id", F.regexp_extract("attributes_json", r"(?s)(\{.*\}|\[.*\])", 1).alias("v"))


FIELDS = {"title": "title", "status": "identity_status", "key": "identity_key", "confidence": "identity_confidence"}


@q("rx_field_fallback", "select id, " + ", ".join(f"""regexp_extract(attributes_json, '"{k}": *"?([^",}}]*)', 1) "{n}" """ for n, k in FIELDS.items()) + " from entities where attributes_json is not null and not json_valid(attributes_json)")
def rx_field_fallback(e: Evidence) -> DataFrame:
    """The fields of a record whose JSON is broken, by a pattern for each."""
    broken = e.entities.where("attributes_json is not null and attrs is null")
    return broken.select("id", *[F.regexp_extract("attributes_json", f'"{k}": *"?([^",}}]*)', 1).alias(n) for n, k in FIELDS.items()])


q("rx_repeat")(lambda e: e.table("entities").where("canonical_name is not null").select("id", T.strip_accents(F.col("canonical_name")).rlike(r"(.)\1{2,}").alias("v")))
