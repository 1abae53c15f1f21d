"""The evidence star: pages, entities, mentions, relations, their evidence and the review logs."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.years import year_strict
from foliant.tables import table

#: What an event of the events table says when it stands for an identity review.
EVENT_STATUS = {"error": "rejected", "purchase": "resolved", "click": "contextual", "view": "ambiguous", "signup": "merged"}
#: Likewise for a relation review.
EVENT_RELATION_STATUS = {"error": "rejected", "purchase": "confirmed", "click": "probable", "view": "hypothesis", "signup": "hypothesis"}
#: What a piece of evidence says.
QUOTED = ["page_id", "chunk_id", "quote", "confidence"]
STATUS_RANK = {"resolved": 3, "contextual": 2, "ambiguous": 1, "rejected": 0, "merged": -1}


def latest(log: DataFrame, key: str | list[str], order: str = "id", status: str = "review_status") -> DataFrame:
    """(key..., status): the last entry of an append-only log for each key."""
    keys = [key] if isinstance(key, str) else key
    return log.groupBy(*keys).agg(F.max_by(status, order).alias(status))


class Evidence:
    """The tables under one folder; the review logs and the evidence of relations are derived."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages").select("id", "bib", "pagina", "jornal", "ano", "edicao", "text_path", year_strict(F.col("ano")).alias("yr"))

    @cached_property
    def mentions(self) -> DataFrame:
        return self.table("entity_mentions")

    @cached_property
    def relations(self) -> DataFrame:
        return self.table("relations")

    @cached_property
    def identity_reviews(self) -> DataFrame:
        """(id, entity_id, review_status, created_at) out of the events: user n reviews entity n + 1."""
        return self.table("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("entity_id"), _map(EVENT_STATUS, F.col("event_type")).alias("review_status"), F.col("ts").alias("created_at")
        )

    @cached_property
    def relation_reviews(self) -> DataFrame:
        """(id, relation_id, review_status, created_at) out of the events: user n reviews relation n + 1."""
        return self.table("events").select(
            F.col("event_id").alias("id"), (F.col("user_id") + 1).alias("relation_id"), _map(EVENT_RELATION_STATUS, F.col("event_type")).alias("review_status"), F.col("ts").alias("created_at")
        )

    @cached_property
    def entities(self) -> DataFrame:
        """entities with attrs (map, null if unreadable), hints (array) and eff, the effective status: review, else attributes, else resolved."""
        attrs = F.from_json("attributes_json", "map<string,string>")
        e = self.table("entities").withColumn("attrs", attrs).withColumn("hints", F.from_json(F.col("attrs")["identity_hints"], "array<string>"))
        e = e.join(latest(self.identity_reviews, "entity_id").select(F.col("entity_id").alias("id"), "review_status"), "id", "left")
        return e.withColumn("eff", F.coalesce("review_status", F.col("attrs")["effective_identity_status"], F.col("attrs")["identity_status"], F.lit("resolved"))).drop("review_status")

    @cached_property
    def active(self) -> DataFrame:
        return self.entities.where("eff not in ('rejected', 'merged')")

    @cached_property
    def shared_pages(self) -> DataFrame:
        """(subject_entity_id, object_entity_id, page_id): the pages that name both ends of a relation, once for all relations between the two.

        The end that stands on fewer pages is spread over its pages, the other one is looked up there.
        """
        there = self.mentions.where("entity_id is not null and page_id is not null").select("entity_id", "page_id").distinct()
        size = there.groupBy("entity_id").agg(F.count("*").alias("n"))
        pairs = self.relations.select("subject_entity_id", "object_entity_id").distinct()
        pairs = pairs.join(size.toDF("subject_entity_id", "s"), "subject_entity_id").join(size.toDF("object_entity_id", "o"), "object_entity_id")
        ends = pairs.select("*", F.expr("if(s <= o, subject_entity_id, object_entity_id)").alias("rare"), F.expr("if(s <= o, object_entity_id, subject_entity_id)").alias("other"))
        spread = ends.join(there.withColumnRenamed("entity_id", "rare"), "rare")
        return spread.join(there.withColumnRenamed("entity_id", "other"), ["other", "page_id"], "left_semi").select("subject_entity_id", "object_entity_id", "page_id")

    @cached_property
    def pair_evidence(self) -> DataFrame:
        """(subject_entity_id, object_entity_id, page_id, chunk_id, quote, confidence): the object's mentions on pages that name the subject, once for all relations between the two."""
        m = self.mentions.select(F.col("entity_id").alias("object_entity_id"), "page_id", "chunk_id", F.col("snippet").alias("quote"), "confidence")
        return self.shared_pages.join(m, ["object_entity_id", "page_id"]).select("subject_entity_id", "object_entity_id", *QUOTED)

    def of_relations(self, rows: DataFrame) -> DataFrame:
        """`rows` of pairs (subject_entity_id, object_entity_id, ..) for each relation (relation_id, ..) between the two."""
        r = self.relations.select(F.col("id").alias("relation_id"), "subject_entity_id", "object_entity_id")
        return r.join(rows, ["subject_entity_id", "object_entity_id"]).drop("subject_entity_id", "object_entity_id")

    @cached_property
    def literal_evidence(self) -> DataFrame:
        """(relation_id, page_id, chunk_id, quote, confidence): the subject's best mention for each relation with a literal object."""
        m = self.mentions.select("id", "entity_id", *[c if c != "quote" else F.col("snippet").alias("quote") for c in QUOTED])
        best = m.groupBy(F.col("entity_id").alias("subject_entity_id")).agg(F.max_by(F.struct(*QUOTED), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("id"))).alias("b"))
        return self.relations.where("object_entity_id is null").select(F.col("id").alias("relation_id"), "subject_entity_id").join(best, "subject_entity_id").select("relation_id", "b.*")

    @cached_property
    def repeated_relations(self) -> DataFrame:
        """(relation_id): the ids that stand in more than one row of relations."""
        return self.relations.groupBy(F.col("id").alias("relation_id")).agg(F.count("*").alias("n")).where("n > 1").select("relation_id")

    @cached_property
    def evidence(self) -> DataFrame:
        """(relation_id, page_id, chunk_id, quote, confidence): mentions of a relation's object on pages that name its
        subject; for a literal object the subject's best mention."""
        return self.of_relations(self.pair_evidence).unionByName(self.literal_evidence)

    @cached_property
    def star(self) -> DataFrame:
        """mentions with their page and their active entity."""
        p = self.pages.select(F.col("id").alias("page_id"), "bib", "pagina", "jornal", "yr")
        e = self.active.select(F.col("id").alias("entity_id"), "type", "canonical_name")
        return self.mentions.select("id", "entity_id", "page_id", "surface_form", "snippet", "confidence").join(p, "page_id").join(e, "entity_id")


def _map(values: dict[str, str], c: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(c == k, v).otherwise(out)
    return out
