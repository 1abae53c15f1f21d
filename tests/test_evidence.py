"""The evidence of relations against its SQL, with repeated, missing and very frequent values."""

import random
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

NAMES = ["win_evidence_top5", "win_evid_top50", "snk_add_evidence", "snk_dedup_evidence"]


def tables(at, mentions, relations):
    m = pa.schema([("id", pa.int64()), ("entity_id", pa.int64()), ("page_id", pa.int64()), ("chunk_id", pa.string()), ("surface_form", pa.string()), ("snippet", pa.string()), ("confidence", pa.float64())])
    r = pa.schema([("id", pa.int64()), ("subject_entity_id", pa.int64()), ("object_entity_id", pa.int64())])
    pq.write_table(pa.table([*map(list, zip(*mentions))], schema=m), at / "entity_mentions.parquet")
    pq.write_table(pa.table([*map(list, zip(*relations))], schema=r), at / "relations.parquet")
    return str(at)


def rows_of(spark, name, at):
    return Counter(tuple(r) for r in entry.queries()[name](spark, at).collect())


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_are_as_in_sql(spark, tmp_path, name):
    r = random.Random(3)
    one = lambda n: r.choice([None, *range(n)])
    mentions = [(i, one(9), one(6), r.choice([None, "x", "y"]), "s", r.choice([None, "", "q", "w"]), r.choice([None, 0.1, 0.5, 0.9])) for i in range(400)]
    relations = [(r.choice([None, 1, 2, 3, *range(60)]), one(9), one(9)) for _ in range(80)]
    at = tables(tmp_path, mentions, relations)
    con = duckdb.connect()
    for t, columns in (("entity_mentions", None), ("relations", None), ("pages", "id bigint, bib text, pagina text, jornal text, ano text, edicao text, text_path text"), ("events", "event_id bigint, user_id bigint, event_type text, ts timestamp"), ("entities", "id bigint, type text, canonical_name text, attributes_json text")):
        con.execute(f"create table {t} ({columns})" if columns else f"create table {t} as select * from '{at}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    df = entry.queries()[name](spark, at).select(*columns)
    assert Counter(map(tuple, df.collect())) == Counter(cursor.fetchall())


@pytest.mark.parametrize("name", NAMES)
def test_mentions_of_a_frequent_object_do_not_meet_all_its_relations(spark, tmp_path, name):
    n = 1500
    mentions = [(i, 0, i, "c", "s", f"q{i}", 0.5) for i in range(n)] + [(n + i, 1 + i, i, "c", "s", "q", 0.5) for i in range(n)]
    at = tables(tmp_path, mentions, [(i, 1 + i, 0) for i in range(n)])
    df = entry.queries()[name](spark, at)
    df.collect()
    rows, plans = 0, [df._jdf.queryExecution().executedPlan()]
    while plans:
        p = plans.pop()
        name_of = p.getClass().getSimpleName()
        if name_of == "AdaptiveSparkPlanExec":
            plans.append(p.executedPlan())
        elif hasattr(p, "plan") and name_of.endswith("QueryStageExec"):
            plans.append(p.plan())
        if p.metrics().contains("numOutputRows"):
            rows = max(rows, p.metrics().apply("numOutputRows").value())
        children = p.children()
        plans += [children.apply(k) for k in range(children.size())]
    assert 0 < rows <= 4 * n, rows
