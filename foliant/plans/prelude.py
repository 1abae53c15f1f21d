"""Shared SQL of the checks: the evidence star in DuckDB's dialect, and how plans are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from foliant.registry import Registry
from foliant.sources.evidence import Evidence

YEAR = "case when regexp_matches(trim(regexp_replace({c}, '^(?i:ano) ', '')), '^[0-9]{{4}}$') then trim(regexp_replace({c}, '^(?i:ano) ', ''))::int end"

PRE = f"""
with pg as (select id, bib, pagina, jornal, ano, edicao, text_path, {YEAR.format(c="ano")} yr from pages),
rev as (select event_id id, user_id + 1 entity_id, case event_type when 'error' then 'rejected' when 'purchase' then 'resolved' when 'click' then 'contextual' when 'view' then 'ambiguous' when 'signup' then 'merged' end review_status, ts created_at from events),
rrev as (select event_id id, user_id + 1 relation_id, case event_type when 'error' then 'rejected' when 'purchase' then 'confirmed' when 'click' then 'probable' when 'view' then 'hypothesis' when 'signup' then 'hypothesis' end review_status, ts created_at from events),
lrev as (select entity_id, arg_max(review_status, id) st from rev group by 1),
lrrev as (select relation_id, arg_max(review_status, id) st from rrev group by 1),
ent0 as (select *, case when json_valid(attributes_json) then attributes_json::json end attrs from entities),
ent as (select e.*, coalesce(l.st, e.attrs->>'effective_identity_status', e.attrs->>'identity_status', 'resolved') eff from ent0 e left join lrev l on e.id = l.entity_id),
act as (select * from ent where eff not in ('rejected', 'merged')),
bestm as (select entity_id, arg_max(id, (coalesce(confidence, -1), -id)) mid from entity_mentions group by 1),
evd as (
  select r.id relation_id, m.page_id, m.chunk_id, m.snippet quote, m.confidence from relations r join entity_mentions m on m.entity_id = r.object_entity_id
  where exists (select 1 from entity_mentions s where s.entity_id = r.subject_entity_id and s.page_id = m.page_id)
  union all
  select r.id, m.page_id, m.chunk_id, m.snippet, m.confidence from relations r join bestm b on b.entity_id = r.subject_entity_id join entity_mentions m on m.id = b.mid where r.object_entity_id is null),
star as (select m.id, m.entity_id, m.page_id, m.surface_form, m.snippet, m.confidence, p.bib, p.pagina, p.jornal, p.yr, a.type, a.canonical_name
  from entity_mentions m join pg p on m.page_id = p.id join act a on m.entity_id = a.id)
"""


def with_star(sql: str) -> str:
    """`sql` with the star's tables in front; its own WITH goes on from theirs."""
    sql = sql.strip()
    if sql.startswith("with recursive "):
        return PRE.replace("with pg", "with recursive pg", 1) + "," + sql[len("with recursive") :]
    return PRE + ("," + sql[4:] if sql.startswith("with ") else sql)


def registrar() -> tuple[Registry, Callable[..., Callable]]:
    """A registry, and a decorator (name, SQL) for builders that take the evidence."""
    reg = Registry()

    def q(name: str, sql: str | None = None) -> Callable:
        def keep(build: Callable[[Evidence], DataFrame]) -> Callable:
            reg.add(name, lambda spark, d: build(Evidence(spark, d)), None if sql is None else with_star(sql))
            return build

        return keep

    return reg, q
