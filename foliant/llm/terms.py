"""Frequencies of all terms and term sequences by suffix sorting."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import arrow_map

#: Terms of a suffix that are kept; the operator counts all sequences up to this length.
MAX_TERMS = 3
#: Groups into which the suffixes of one first term are split, by their second term.
SALTS = 16

_ROUTED = "field string, suffix array<string>, seen int, n bigint"
_COUNTED = "field string, gram array<string>, total bigint, records bigint"
_ROUTED_PA = pa.schema([("field", pa.string()), ("suffix", pa.list_(pa.string())), ("seen", pa.int32()), ("n", pa.int64())])
_COUNTED_PA = pa.schema([("field", pa.string()), ("gram", pa.list_(pa.string())), ("total", pa.int64()), ("records", pa.int64())])


def truncated_suffixes(terms: list[str], most: int) -> Iterator[tuple[tuple[str, ...], int]]:
    """Each suffix of `terms`, cut to `most` terms, with the length of its longest prefix that an earlier suffix has.

    That length stands for the record in the record sets: the suffix is the first of its
    record for all longer prefixes and for no others, so sets become sums.
    """
    seen: set[tuple[str, ...]] = set()
    for i in range(len(terms)):
        suffix = tuple(terms[i : i + most])
        known = 0
        for k in range(1, len(suffix) + 1):
            gram = suffix[:k]
            if gram in seen:
                known = k
            else:
                seen.add(gram)
        yield suffix, known


def _emit(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums: dict[tuple, int] = {}
            for field, terms, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for suffix, known in truncated_suffixes(terms, most):
                    key = (field, suffix, known)
                    sums[key] = sums.get(key, 0) + n
            if sums:
                f, s, k = zip(*sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f, pa.string()), pa.array(map(list, s), pa.list_(pa.string())), pa.array(k, pa.int32()), pa.array(sums.values(), pa.int64())],
                    schema=_ROUTED_PA,
                )

    return run


class _Stack:
    """Counts of the prefixes of the suffix at hand; deeper ones are added to their parents when they end."""

    def __init__(self) -> None:
        self.field: str | None = None
        self.terms: list[str] = []
        self.total: list[int] = []
        self.records: list[int] = []
        self.out: list[tuple[str, list[str], int, int]] = []

    def shrink(self, depth: int) -> None:
        while len(self.terms) > depth:
            self.out.append((self.field, list(self.terms), self.total[-1], self.records[-1]))
            self.terms.pop()
            total, records = self.total.pop(), self.records.pop()
            if self.terms:
                self.total[-1] += total
                self.records[-1] += records

    def push(self, field: str, suffix: list[str], known: int, n: int) -> None:
        same = 0
        if field == self.field:
            for a, b in zip(self.terms, suffix):
                if a != b:
                    break
                same += 1
        self.shrink(same)
        self.field = field
        for t in suffix[same:]:
            self.terms.append(t)
            self.total.append(0)
            self.records.append(0)
        self.total[-1] += n
        self.records[-1] += n
        if known:
            self.records[known - 1] -= n


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stack = _Stack()

    def flush() -> pa.RecordBatch:
        f, g, t, r = zip(*stack.out)
        stack.out = []
        return pa.RecordBatch.from_arrays(
            [pa.array(f, pa.string()), pa.array(g, pa.list_(pa.string())), pa.array(t, pa.int64()), pa.array(r, pa.int64())], schema=_COUNTED_PA
        )

    for b in batches:
        for field, suffix, known, n in zip(*(b.column(i).to_pylist() for i in range(4))):
            stack.push(field, suffix, known, n)
        if len(stack.out) >= 20_000:
            yield flush()
    stack.shrink(0)
    if stack.out:
        yield flush()


def gram_counts(rows: DataFrame, max_terms: int = MAX_TERMS, salts: int = SALTS) -> DataFrame:
    """(field, gram, total, records) for all term sequences of up to `max_terms` terms.

    rows: field string, terms array<string>, n bigint (how many records hold these very terms).
    total counts occurrences, records the records that hold the gram at least once.
    Null or empty term lists and null terms count nowhere.

    Suffixes are cut to max_terms terms, summed within each Arrow batch, routed by field, first
    term and a salt from the second term, sorted in reverse lexicographic order, and folded
    by a stack whose depth is max_terms. A first term that holds a third of all rows is spread over
    `salts` groups; its own count is then summed from as many rows. Record sets are kept as sums
    (see truncated_suffixes), so memory doesn't grow with the rows.
    """
    clean = rows.select("field", F.filter("terms", lambda t: t.isNotNull()).alias("terms"), F.col("n").cast("long").alias("n")).where("size(terms) > 0")
    suffixes = arrow_map(clean, _emit(max_terms), _ROUTED)
    routed = (
        suffixes.withColumn("first", F.col("suffix")[0])
        .withColumn("salt", F.pmod(F.xxhash64(F.coalesce(F.get("suffix", F.lit(1)), F.lit(""))), F.lit(salts)))
        .repartition("field", "first", "salt")
        .sortWithinPartitions("field", F.col("suffix").desc())
        .select("field", "suffix", "seen", "n")
    )
    return arrow_map(routed, _fold, _COUNTED).groupBy("field", "gram").agg(F.sum("total").alias("total"), F.sum("records").alias("records"))


def mention_and_predicate_terms(mentions: DataFrame, relations: DataFrame) -> DataFrame:
    """(field, terms, n) of entity_mentions.surface_form (words) and relations.predicate (whole values).

    Equal values are counted before anything else. A null or empty surface form and a null or blank
    predicate count nowhere; '?' is a record without terms.
    """
    forms = (
        mentions.groupBy(F.col("surface_form").alias("v"))
        .agg(F.count("*").alias("n"))
        .where("v is not null and v <> ''")
        .select(F.lit("surface_form").alias("field"), F.regexp_extract_all(F.lower("v"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)).alias("terms"), "n")
    )
    said = F.lower(F.regexp_replace("v", r"^\s+|\s+$", ""))
    predicates = (
        relations.groupBy(F.col("predicate").alias("v"))
        .agg(F.count("*").alias("n"))
        .select(F.lit("predicate").alias("field"), F.array(said).alias("terms"), "n")
        .where("terms[0] <> ''")
    )
    return forms.unionByName(predicates)


def term_marks(mentions: DataFrame, relations: DataFrame, rare: int = 2, common_percent: int = 3, max_terms: int = MAX_TERMS) -> DataFrame:
    """(field, term, total, records, rows, mark) of every term; mark is 'rare', 'common' or null.

    rare: in at most `rare` records; common: in more than `common_percent` % of the field's records
    that count. A term that is both is rare. Empty tables give no rows.
    """
    base = mention_and_predicate_terms(mentions, relations)
    rows = base.groupBy("field").agg(F.sum("n").alias("rows"))  # two rows
    terms = gram_counts(base, max_terms).where("size(gram) = 1").select("field", F.col("gram")[0].alias("term"), "total", "records")
    mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") * 100 > F.col("rows") * common_percent, "common")
    return terms.join(F.broadcast(rows), "field").withColumn("mark", mark)
