"""Smaller functions, table functions and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.years import year_any
from foliant.operators.search import likeness
from foliant.plans import relational as R
from foliant.plans import textual as X
from foliant.plans.prelude import with_star
from foliant.plans.relational import first_by, long_count, top
from foliant.registry import Registry
from foliant.sources.evidence import Evidence
from foliant.tables import arrow_map

reg = Registry()


def q(name: str, sql: str | None = None) -> Callable:
    def keep(build: Callable[[Evidence], DataFrame]) -> Callable:
        reg.add(name, lambda spark, d: build(Evidence(spark, d)), None if sql is None else with_star(sql))
        return build

    return keep


q("fn_cost", "select doc_id, round(length(text) / 3.5 * 12.5 / 1000000, 8) cost from documents where text is not null")(lambda e: X.docs(e).select("doc_id", F.round(F.length("text") / 3.5 * 12.5 / 1000000, 8).alias("cost")))
q("fn_surname_raw", "select id, case when instr(canonical_name, ' ') > 0 then substring(canonical_name, instr(canonical_name, ' ') + 1) else canonical_name end v from entities")(
    lambda e: e.table("entities").select("id", F.when(F.instr("canonical_name", " ") > 0, F.expr("substring(canonical_name, instr(canonical_name, ' ') + 1)")).otherwise(F.col("canonical_name")).alias("v")))
q("fn_page_key", "select id, bib || ':' || coalesce(pagina, '') v, split_part(bib || ':' || coalesce(pagina, ''), ':', 2) pagina from pages")(
    lambda e: e.table("pages").select("id", F.concat("bib", F.lit(":"), F.coalesce("pagina", F.lit(""))).alias("v")).withColumn("pagina", F.split_part("v", F.lit(":"), F.lit(2))))
q("fn_day_of_year_seed", "select id, dayofyear(created_at)::bigint seed from pages")(lambda e: e.table("pages").select("id", F.dayofyear("created_at").cast("long").alias("seed")))
YR = "try_cast(nullif(regexp_extract(event_date, '(1[0-9]{3}|20[0-9]{2})', 1), '') as int)"
q("fn_generation_years", f"select id, {YR} child, {YR} - 25 parent, {YR} - 50 grandparent from parish_records")(
    lambda e: e.table("parish_records").select("id", year_any(F.col("event_date")).alias("child")).withColumns({"parent": F.col("child") - 25, "grandparent": F.col("child") - 50}))
q("fn_range_split", "select k part, (k * (n // 4) + 1)::bigint lo, (case when k = 3 then n else (k + 1) * (n // 4) end)::bigint hi from (select count(*) n from pages), range(0, 4) r(k)")(
    lambda e: e.pages.agg(F.count("*").alias("n")).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part")).select(
        "part", (F.col("part") * F.floor(F.col("n") / 4) + 1).cast("long").alias("lo"), F.when(F.col("part") == 3, F.col("n")).otherwise((F.col("part") + 1) * F.floor(F.col("n") / 4)).cast("long").alias("hi")))
q("fn_url_quote", "select id, replace(url_encode(strip_accents(canonical_name)), '+', '%20') v from entities")(lambda e: e.table("entities").select("id", T.url_quote(T.strip_accents(F.col("canonical_name"))).alias("v")))
q("fn_levenshtein", "select id, levenshtein(base_normalized_name, 'camara municipal')::bigint d from entities")(lambda e: e.table("entities").select("id", F.levenshtein("base_normalized_name", F.lit("camara municipal")).cast("long").alias("d")))


q("src_fallback", "select path, body_from from (select text_path path, 'text' body_from from page_texts union select p.text_path, 'none' from pages p where p.text_path is not null and not exists (select 1 from page_texts t where t.text_path = p.text_path))")(
    lambda e: (lambda t: t.select(F.col("text_path").alias("path"), F.lit("text").alias("body_from")).union(e.table("pages").select("text_path").where("text_path is not null").distinct().join(t, "text_path", "left_anti").select("text_path", F.lit("none"))))(e.table("page_texts").select("text_path").distinct()))
for _n in ("snk_progress",):
    q(_n, "select bib, count(*) filter (where d) done, count(*) filter (where not d) failed from (select p.bib, t.text_path is not null d from pages p left join (select distinct text_path from page_texts) t on t.text_path = p.text_path) group by 1")(
        lambda e: e.table("pages").select("bib", "text_path").join(e.table("page_texts").select("text_path").distinct().withColumn("d", F.lit(1)), "text_path", "left").groupBy("bib").agg(F.count_if(F.col("d").isNotNull()).alias("done"), F.count_if(F.col("d").isNull()).alias("failed")))
q("agg_worker_totals", "select source_collection, count(*) processed, count(*) filter (where person_name is null or trim(person_name) in ('', '?')) skipped from parish_records group by 1")(
    lambda e: e.table("parish_records").groupBy("source_collection").agg(long_count("processed"), F.count_if(F.expr("person_name is null or trim(person_name) in ('', '?')")).alias("skipped")))
q("cq_edge", "select r.id, r.predicate, v.page_id from relations r join evd v on v.relation_id = r.id where r.predicate = 'spouse_of' qualify row_number() over (partition by r.id order by v.confidence desc nulls last, v.page_id, v.chunk_id) <= 6")(
    lambda e: first_by(e.relations.where("predicate = 'spouse_of'").select("id", "predicate").join(e.evidence.withColumnRenamed("relation_id", "id"), "id"), ["id"], F.desc_nulls_last("confidence"), F.asc("page_id"), F.asc("chunk_id"), n=6).select("id", "predicate", "page_id"))


def corrected(e: Evidence) -> DataFrame:
    """Pages before and after correction: the model's place is taken by the texts that were delivered corrected."""
    t = e.table("page_texts").withColumn("c", F.col("text_path").endswith("_corrigido.txt"))
    g = t.groupBy(X.base_of("text_path").alias("path")).agg(F.max(F.when(F.col("c"), F.length("body"))).alias("corrected"), F.max(F.when(~F.col("c"), F.length("body"))).alias("scanned"))
    return g.select("path", F.col("corrected").cast("long").alias("corrected"), F.col("scanned").cast("long").alias("scanned"))




def register(to: Registry) -> None:
    for name, build in reg.builders.items():
        to.add(name, build, reg.sql.get(name))
