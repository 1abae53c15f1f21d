"""Best representative of each duplicate group, field by field, in one aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.components import connected_components

#: Identity statuses, best first.
STATUSES = ["resolved", "contextual", "ambiguous", "rejected", "merged"]


def survivors(rows: DataFrame, group: str, ident: str, updated: str, fields: dict[str, tuple[Column, list[Column]]]) -> DataFrame:
    """One row per group and field: (group, field, entity_id, value).

    fields: name -> (value, priorities); priorities are compared in order, larger first.
    A single aggregation takes, per field, the maximum of
    struct(value is not null, priorities..., updated, -ident, value): a value beats no value,
    then priority, then the later timestamp (null is earliest), then the smaller id.
    Rows with a null group or id take no part. If all values of a field are null, the row that wins
    the remaining comparison is named with a null value. Repeated rows change nothing.
    """
    best = [
        F.max(
            F.struct(
                value.isNotNull().alias("has"),
                *[p.alias(f"p{i}") for i, p in enumerate(order)],
                F.col(updated).alias("at"),
                (-F.col(ident)).alias("neg"),
                value.alias("value"),
            )
        ).alias(name)
        for name, (value, order) in fields.items()
    ]
    won = rows.where(F.col(group).isNotNull() & F.col(ident).isNotNull()).groupBy(F.col(group).alias("group_id")).agg(*best)
    parts = [
        F.struct(F.lit(n).alias("field"), (-F.col(n)["neg"]).alias("entity_id"), F.col(n)["value"].cast("string").alias("value"))
        for n in fields
    ]
    return won.select("group_id", F.inline(F.array(*parts)))


def approved_groups(reviews: DataFrame, source: str, target: str, status: str, order: str) -> DataFrame:
    """(node, component) over the pairs whose latest review, in either direction, says approved.

    The highest `order` holds. Rows with a null end or null order are ignored; a review of
    an entity against itself links nothing.
    """
    pair = reviews.select(
        F.least(source, target).alias("a"),
        F.greatest(source, target).alias("b"),
        F.col(status).alias("s"),
        F.col(order).alias("o"),
        F.col(source).isNotNull().alias("x"),
        F.col(target).isNotNull().alias("y"),
    ).where("x and y and o is not null and a <> b")
    latest = pair.groupBy("a", "b").agg(F.max_by("s", "o").alias("s"))
    return connected_components(latest.where("s = 'approved'"), "a", "b")


def readable_list(text: Column) -> Column:
    """The strings of a JSON list, also one written with single quotes; null if it can't be read."""
    closed = F.trim(text).rlike(r"(?s)^\[.*\]$")
    return F.when(closed, F.from_json(text, "array<string>", {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}))


def readable_object(text: Column) -> Column:
    """The members of a JSON object as strings; null if it is null, cut off or no object."""
    closed = F.trim(text).rlike(r"(?s)^\{.*\}$")
    return F.when(closed, F.from_json(text, "map<string,string>"))


def status_rank(attributes: Column) -> Column:
    """0 for none or unreadable, up to len(STATUSES) for the best; effective_identity_status goes first."""
    said = F.coalesce(F.nullif(attributes["effective_identity_status"], F.lit("")), attributes["identity_status"])
    rank = F.lit(0)
    for n, s in enumerate(reversed(STATUSES), 1):
        rank = F.when(said == s, F.lit(n)).otherwise(rank)
    return F.coalesce(rank, F.lit(0))


def entity_survivors(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """(group_id, field, entity_id, value) of the merge groups of `entities`.

    A group is a set of two or more rows of entities joined by approved reviews; group_id is
    its smallest id. Null, broken or empty JSON, null names and null timestamps rank
    below everything else and never drop a row; other columns of the inputs are not looked at.
    """
    groups = approved_groups(reviews, "source_entity_id", "target_entity_id", "review_status", "id")
    rows = entities.select("id", "canonical_name", "aliases_json", "attributes_json", "updated_at").join(
        groups.withColumnRenamed("node", "id"), "id"
    )
    sizes = rows.groupBy("component").agg(F.min("id").alias("group_id"), F.count_distinct("id").alias("n")).where("n > 1")
    rows = rows.join(sizes.select("component", "group_id"), "component")
    rows = rows.withColumn("obj", readable_object(F.col("attributes_json"))).withColumn("lst", readable_list(F.col("aliases_json")))
    rows = rows.withColumn("status", status_rank(F.col("obj")))
    words = F.size(F.filter(F.split(F.coalesce("canonical_name", F.lit("")), r"[\s,]+"), lambda w: w.rlike(r"^[\p{L}&&[^ªº]]{3,}$")))
    aliases = F.coalesce(F.size(F.array_distinct(F.filter("lst", lambda x: x.isNotNull() & ~x.isin("", "?")))), F.lit(-1))
    keys = F.coalesce(
        F.size(F.map_keys(F.map_filter("obj", lambda k, v: v.isNotNull() & ~v.isin("", "?", "[]")))), F.lit(-1)
    )
    aliases = F.when(F.col("lst").isNull(), F.lit(-1)).otherwise(aliases)
    keys = F.when(F.col("obj").isNull(), F.lit(-1)).otherwise(keys)
    return survivors(
        rows,
        "group_id",
        "id",
        "updated_at",
        {
            "canonical_name": (F.col("canonical_name"), [words, F.col("status")]),
            "aliases_json": (F.col("aliases_json"), [aliases, F.col("status")]),
            "attributes_json": (F.col("attributes_json"), [F.col("status"), keys]),
        },
    )
