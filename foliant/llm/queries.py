"""The queries of the training-data operators; SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, leakage, lookalike, matching, scans, splitting, survivorship, terms, variants
from foliant.registry import Registry
from foliant.tables import table

P1_SQL = """
with recursive latest as (
  select least(source_entity_id, target_entity_id) a, greatest(source_entity_id, target_entity_id) b, arg_max(review_status, id) s
  from entity_merge_reviews where source_entity_id is not null and target_entity_id is not null group by 1, 2),
edges as (select a u, b v from latest where s = 'approved' and a <> b union select b, a from latest where s = 'approved' and a <> b),
reach(node, seen) as (select u, u from edges union select r.node, e.v from reach r join edges e on r.seen = e.u),
comp as (select node, min(seen) component from reach group by node),
member as (select e.*, c.component from entities e join comp c on e.id = c.node),
grp as (select component, min(id) group_id from member group by component having count(*) > 1),
scored as (
  select g.group_id, m.id, m.updated_at,
    len(list_filter(regexp_split_to_array(coalesce(m.canonical_name, ''), '[\\s,]+'), lambda w: regexp_full_match(w, '\\pL{3,}') and not regexp_matches(w, '[ªº]'))) n_words,
    case when trim(coalesce(m.aliases_json, '')) not like '[%]' then -1
      else len(list_distinct(list_filter(list_transform(regexp_extract_all(m.aliases_json, '"[^"]*"|''[^'']*'''), lambda x: x[2:-2]), lambda x: x not in ('', '?')))) end n_aliases,
    case when not coalesce(json_valid(m.attributes_json), false) then null else m.attributes_json::json end obj
  from member m join grp g using (component)),
ranked as (
  select *, coalesce(6 - list_position(['resolved', 'contextual', 'ambiguous', 'rejected', 'merged'],
      coalesce(nullif(obj->>'effective_identity_status', ''), obj->>'identity_status')), 0) status,
    case when obj is null then -1 else len(list_filter(json_keys(obj), lambda k: coalesce(json_extract(obj, '$."' || k || '"')::varchar, 'null') not in ('null', '""', '"?"', '[]'))) end n_keys
  from scored)
select group_id, 'canonical_name' field, arg_max(id, (n_words, status, coalesce(updated_at, timestamp '1000-01-01'), -id)) entity_id from ranked group by 1
union all
select group_id, 'aliases_json', arg_max(id, (n_aliases, status, coalesce(updated_at, timestamp '1000-01-01'), -id)) from ranked group by 1
union all
select group_id, 'attributes_json', arg_max(id, (status, n_keys, coalesce(updated_at, timestamp '1000-01-01'), -id)) from ranked group by 1
"""

P2_TERMS_SQL = """
with t as (
  select 'surface_form' field, id, list_distinct(regexp_extract_all(lower(surface_form), '[\\pL\\pN]+')) terms, regexp_extract_all(lower(surface_form), '[\\pL\\pN]+') alls
  from entity_mentions where surface_form <> ''
  union all
  select 'predicate', id, [lower(trim(predicate, e' \\t\\n\\r'))], [lower(trim(predicate, e' \\t\\n\\r'))] from relations where trim(predicate, e' \\t\\n\\r') <> ''),
n as (select field, count(*) n_rows from t group by 1),
df as (select field, term, count(*) records from (select field, unnest(terms) term from t) group by 1, 2),
tf as (select field, term, count(*) total from (select field, unnest(alls) term from t) group by 1, 2),
m as (select df.field, df.term, tf.total, df.records,
  case when records <= 2 then 'rare' when records * 100 > n_rows * 3 then 'common' end mark
  from df join tf using (field, term) join n using (field))
"""

P3_SQL = r"""
with latest as (
  select regexp_replace(text_path, '_corrigido\.txt$', '.txt') path,
    arg_max(coalesce(body, ''), (text_path like '%\_corrigido.txt' escape '\', ingested_at, length(trim(coalesce(body, ''), e' \t\r\n')))) body
  from page_texts group by 1),
cased as (select p.id page_id, l.body from pages p join latest l on regexp_replace(p.text_path, '_corrigido\.txt$', '.txt') = l.path
  where length(trim(l.body, e' \t\r\n')) > 1000),
pieces as (
  select page_id,
    list_max(list_transform(regexp_split_to_array(body, '\r\n([ \t]*\r\n)+|\n([ \t]*\n)+|\r([ \t]*\r)+'), lambda x: length(trim(x, e' \t\r\n')))) p,
    list_max(list_transform(regexp_split_to_array(body, '\r\n|\r|\n'), lambda x: length(trim(x, e' \t\r\n')))) l,
    list_max(list_transform(regexp_split_to_array(regexp_replace(body, '([.!?])\s+', e'\\1\n', 'g'), '\r\n|\r|\n'), lambda x: length(trim(x, e' \t\r\n')))) s,
    list_max(list_transform(regexp_split_to_array(body, '\s+'), lambda x: length(x))) w
  from cased)
select page_id, case when p <= 1000 then 'paragraph' when l <= 1000 then 'line' when s <= 1000 then 'sentence' when w <= 1000 then 'word' else 'character' end cut
from pieces
"""


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return survivorship.entity_survivors(table(spark, d, "entities"), table(spark, d, "entity_merge_reviews")).select("group_id", "field", "entity_id")


def p1_golden(spark: SparkSession, d: str) -> DataFrame:
    """The surviving record of each group: one column for each field."""
    rows = survivorship.entity_survivors(table(spark, d, "entities"), table(spark, d, "entity_merge_reviews"))
    names = ["canonical_name", "aliases_json", "attributes_json"]
    return rows.groupBy("group_id").agg(*[F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in names])


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return terms.term_marks(table(spark, d, "entity_mentions"), table(spark, d, "relations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).where("mark is not null").select("field", "term", "mark")


def p2_terms(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "term", "total", "records", "mark")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.page_splits(table(spark, d, "pages"), table(spark, d, "page_texts"))
    return rows.where("cut is not null").select("page_id", "cut")


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = splitting.page_splits(table(spark, d, "pages"), table(spark, d, "page_texts"))
    return rows.select("page_id", F.posexplode("pieces").alias("piece", "p")).select("page_id", "piece", "p.start", "p.end", "p.kind", "p.text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_entity_pairs(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


def p4_clusters(spark: SparkSession, d: str) -> DataFrame:
    return variants.same_entities(table(spark, d, "entities"), table(spark, d, "entity_mentions"))


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_people(table(spark, d, "parish_records"), table(spark, d, "entities"), table(spark, d, "entity_mentions"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_links(spark, d).where("confidence >= 0.5").select("parish_record_id", "entity_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.scan_findings(table(spark, d, "entity_mentions"), table(spark, d, "parish_records"))


def p5_texts(spark: SparkSession, d: str) -> DataFrame:
    return scans.repaired_texts(table(spark, d, "entity_mentions"), table(spark, d, "parish_records"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items")).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    rows = leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark_items"))
    return rows.select("doc_id", "item_id", "held", "words", F.posexplode("passages").alias("passage", "p")).select("doc_id", "item_id", "held", "words", "passage", "p.start", "p.end")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_pairs(table(spark, d, "documents"))


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.look_canonical(table(spark, d, "documents"))


def register(to: Registry) -> None:
    to.add("p1_found", p1_found, P1_SQL)
    to.add("p1_golden", p1_golden)
    to.add("p2_found", p2_found, P2_TERMS_SQL + "select field, term, mark from m where mark is not null")
    to.add("p2_terms", p2_terms, P2_TERMS_SQL + "select field, term, total, records, mark from m")
    to.add("p3_found", p3_found, P3_SQL)
    to.add("p3_pieces", p3_pieces)
    to.add("p4_found", p4_found)
    to.add("p4_clusters", p4_clusters)
    to.add("p6_found", p6_found)
    to.add("p6_links", p6_links)
    to.add("p5_found", p5_found)
    to.add("p5_texts", p5_texts)
    to.add("p7_ids", p7_ids)
    to.add("p8_found", p8_found)
    to.add("p8_passages", p8_passages)
    to.add("p9_found", p9_found)
    to.add("p9_canonical", p9_canonical)
