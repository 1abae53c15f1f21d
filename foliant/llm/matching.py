"""People of the parish registers found among the entities, without a common key."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm import names
from foliant.llm.variants import OPEN_LEFT, OPEN_RIGHT, entity_facts, entity_forms, first_letters, first_names_fit, head_links, same_entities
from foliant.tables import arrow_map, cut

#: BM25: saturation and length normalisation.
K1, B = 1.2, 0.5
#: A person is written about from this age on, and to this many years after birth.
AGE_FROM, AGE_TO = 13, 92
#: Ages at marriage and at death.
MARRY_FROM, MARRY_TO, OLDEST = 14, 55, 95
#: Documents of a record that go on, by score; those that tie with the last one, too.
TOP = 20
#: Weight of the terms of relatives other than the father, and years of a span of the join's key.
RELATIVE, SPAN = 0.5, 40
#: Confidence from which a document that is not its record's nearest is kept.
SURE = 0.5
#: Records with a known father, and a document whose father is known, on which the calibration is fitted, at most.
CALIBRATION_ROWS = 20_000

_UNKNOWN = re.compile(r"(?i)^\W*$|inc[oó]gnit|desconhec|expost|n[aã]o consta|ignora|sem nome")


def birth_span(kind: str | None, event: str | None, birth: str | None, collection: str | None) -> tuple[int, int] | None:
    """The years in which the person of a record can be born; None if the record names no time at all.

    A collection's own range of years stands in for a missing date.
    """
    born = names.years(birth)
    if born:
        return born[0], born[0]
    at = names.years(event)
    if not at and (m := re.search(r"-(\d{4})-(\d{4})$", collection or "")):
        at = int(m[1]), int(m[2])
    if not at:
        return None
    k = (kind or "").strip().lower()[:1]
    if k == "m":
        return at[0] - MARRY_TO, at[1] - MARRY_FROM
    if k in ("d", "o"):
        return at[0] - OLDEST, at[1]
    return at[0] - 1, at[1]


def death_year(kind: str | None, event: str | None, collection: str | None) -> int | None:
    """The last year of the person of a death record."""
    if not (kind or "").strip().lower().startswith(("d", "o")):
        return None
    at = names.years(event)
    if not at and (m := re.search(r"-(\d{4})-(\d{4})$", collection or "")):
        at = int(m[1]), int(m[2])
    return at[1] if at else None


def time_fits(lo: int | None, hi: int | None, born: tuple[int | None, int | None], died: int | None) -> bool:
    """Whether someone born in `born` can be written about from lo to hi. Unknown years contradict nothing."""
    if lo is None or born[0] is None:
        return True
    if died is not None and lo > died + 2:
        return False
    return lo >= born[0] + AGE_FROM and hi <= born[1] + AGE_TO


#: time_fits in SQL, so that pairs of other times never reach a worker.
TIME_FITS = f"(d.lo is null or r.b0 is null or coalesce(d.lo <= r.died + 2, true) and d.lo >= r.b0 + {AGE_FROM} and d.hi <= r.b1 + {AGE_TO})"


def _name(text: str | None) -> list[str] | None:
    if not text or _UNKNOWN.search(text):
        return None
    got = names.person(text)
    return got[0] if got else None


def _place(text: str | None) -> str | None:
    return names.spelt(names.plain(text).replace(" ", "")) if text and text.strip(" ?") else None


def given_terms(tokens: list[str]) -> set[str]:
    """The index terms of given names: full ones and their initials."""
    return {"i:" + t[:1] for t in tokens[:-1]} | {"g:" + t for t in tokens[:-1] if names.is_full(t)}


def relative_terms(names_of: list[list[str] | None]) -> set[str]:
    return {"f:" + t for n in names_of for t in n or [] if names.is_full(t)}


_RECORD = "id bigint, tokens array<string>, suffix string, father array<string>, kin array<string>, places array<string>, b0 int, b1 int, died int"
_NAMED_IN = ["mother_name", "spouse_name", "paternal_grandfather", "paternal_grandmother", "maternal_grandfather", "maternal_grandmother"]
_RECORD_COLUMNS = ["id", "record_type", "event_date", "birth_date", "person_name", "father_name", "source_collection", "place", "parish", "island", "godparents_json", *_NAMED_IN]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for i, kind, event, birth, name, father, collection, place, parish, island, godparents, *others in zip(*(b.column(k).to_pylist() for k in range(len(_RECORD_COLUMNS)))):
            got = None if not name or _UNKNOWN.search(name) else names.person(name)
            if got and got[1] != "byname" and len(got[0]) > 1:
                span = birth_span(kind, event, birth, collection) or (None, None)
                kin = sorted(relative_terms([_name(x) for x in [*others, *names.aliases(godparents)]]))
                places = [x for x in map(_place, (place, parish, island)) if x]
                out.append((i, got[0], got[1], _name(father), kin, places, *span, death_year(kind, event, collection)))
        cols = list(zip(*out)) or [[]] * 9
        kinds = [pa.int64(), pa.list_(pa.string()), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "tokens", "suffix", "father", "kin", "places", "b0", "b1", "died"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens, father, kin, places) -> (id, [(term, weight)]) without the surname."""
    for b in batches:
        out = []
        for tokens, father, kin, places in zip(*(b.column(k).to_pylist() for k in range(1, 5))):
            terms = {t: RELATIVE for t in kin or []} | {t: 1.0 for t in given_terms(tokens) | relative_terms([father]) | {"p:" + x for x in places or []}}
            out.append([{"term": t, "weight": w} for t, w in sorted(terms.items())])
        kind = pa.list_(pa.struct([("term", pa.string()), ("weight", pa.float64())]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["id", "terms"])


def _form_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, tokens) -> (id, terms) of one spelling."""
    for b in batches:
        out = [sorted({"s:" + t[-1]} | given_terms(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["id", "terms"])


def _fact_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, fathers, places) -> (id, terms)."""
    for b in batches:
        out = []
        for fathers, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            out.append(sorted(relative_terms([f.split() for f in fathers or []]) | {"p:" + x for x in map(_place, places or []) if x}))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.string()))], names=["id", "terms"])


def _named(rows: DataFrame, known: DataFrame, col: str) -> DataFrame:
    """`rows` with a nickname at the head of the token column `col` replaced."""
    out = rows.withColumn("nick", F.get(col, F.lit(0))).join(known, "nick", "left")
    return out.withColumn(col, F.when(F.col("name").isNotNull() & (F.size(col) > 1), F.concat(F.array("name"), F.slice(col, F.lit(2), F.size(col)))).otherwise(F.col(col))).drop("nick", "name")


def postings(terms: DataFrame) -> DataFrame:
    """(term, doc, impact): the inverted index of (id, term), each pair once; impact is what the term adds to a BM25 score where a query asks for it with weight 1."""
    one = terms.select(F.col("id").alias("doc"), "term").distinct()
    size = one.groupBy("doc").agg(F.count("*").alias("length"))
    whole = size.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"))
    frequency = one.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    impact = idf * (K1 + 1) / (1 + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return one.join(size, "doc").join(frequency, "term").join(F.broadcast(whole)).select("term", "doc", impact.alias("impact"))  # whole is one row


def top_documents(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int = TOP) -> DataFrame:
    """`pairs` (query, doc, head_score, ..) with score, for each query the k of the highest score and those that tie with the last.

    queries: (query, term, weight); index: postings(). The score is head_score, what the best surname adds, and the sum of weight x impact over the
    other terms that both share. No document outside the top k is scored in full if its bound says so: a pair goes no further if head_score and
    the sum of the query's upper bounds (weight x the highest impact of each term) lie below the k-th best head_score of the query.
    """
    highest = index.groupBy("term").agg(F.max("impact").alias("highest"))
    bound = queries.join(highest, "term").groupBy("query").agg(F.sum(F.col("weight") * F.col("highest")).alias("rest"))
    by = Window.partitionBy("query").orderBy(F.desc("head_score"))
    placed = pairs.withColumn("n", F.row_number().over(by)).withColumn("kth", F.max(F.when(F.col("n") == k, F.col("head_score"))).over(Window.partitionBy("query")))
    open_ = placed.join(bound, "query", "left").where("kth is null or head_score + coalesce(rest, 0) >= kth").drop("rest", "kth", "n")
    hits = open_.select("query", "doc").join(queries, "query").join(index, ["term", "doc"]).groupBy("query", "doc").agg(F.sum(F.col("weight") * F.col("impact")).alias("hits"))
    full = open_.join(hits, ["query", "doc"], "left").withColumn("score", F.round(F.col("head_score") + F.coalesce("hits", F.lit(0.0)), 9)).drop("hits")
    return full.withColumn("n", F.rank().over(Window.partitionBy("query").orderBy(F.desc("score")))).where(F.col("n") <= k).drop("n")


def candidates(records: DataFrame, forms: DataFrame, links: DataFrame) -> DataFrame:
    """(query, doc, r, d, head, other): all pairs of a record and a spelling of a document whose surnames a link joins, whose first names can be one, whose
    suffixes are equal and whose times fit; a few of them twice.

    The time and the first letter are part of the key: a record meets the documents of the spans in which its person can begin to be written about, and those
    without a time; and those under the letters of its first name, or of more frequent ones of which one of the two can be a misreading (see first_letters).
    """
    first = lambda c: F.col(c)["tokens"][0]
    letters = cut(first_letters(records.select(F.col("tokens")[0].alias("first")).unionByName(forms.select(F.col("tokens")[0].alias("first")))))
    spelt_as = lambda df, key: df.withColumn("first", first(key)).join(letters, "first").withColumn("letter", F.explode("letters")).drop("first", "letters")
    r = records.select(F.col("id").alias("query"), F.struct("tokens", "suffix", "father", "places", "b0", "b1", "died").alias("r"), F.element_at("tokens", -1).alias("head"))
    r = spelt_as(r.join(links.where("type = 'person'").select("head", "other"), "head"), "r")
    d = forms.select(F.col("id").alias("doc"), F.struct("tokens", "suffix", "fathers", "places", "lo", "hi").alias("d"), F.element_at("tokens", -1).alias("other"))
    span = F.coalesce(F.floor(F.col("d.lo") / SPAN).cast("int"), F.lit(OPEN_RIGHT))
    d = spelt_as(d, "d").withColumn("span", F.explode(F.array(span, F.lit(OPEN_LEFT))))
    spans = F.sequence(F.floor((F.col("r.b0") + AGE_FROM) / SPAN).cast("int"), F.floor((F.col("r.b1") + AGE_TO) / SPAN).cast("int"))
    r = r.withColumn("span", F.explode(F.when(F.col("r.b0").isNull(), F.array(F.lit(OPEN_LEFT))).otherwise(F.concat(spans, F.array(F.lit(OPEN_RIGHT))))))
    alike = first_names_fit(first("r"), first("d"))
    return r.join(d, ["other", "letter", "span"]).select("query", "doc", "r", "d", "head", "other").where(alike & F.expr(f"coalesce(r.suffix, '') = coalesce(d.suffix, '') and {TIME_FITS}"))


_PAIR = "query bigint, doc bigint, other string, head_likeness double, likeness double, full int, extra int, kin int, same_place int, timed int"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Name and father of each candidate pair; names that contradict each other go, and surnames two edits apart where neither the father nor
    two full names without a gap speak for them. kin: 1 same father, -1 another, 0 unknown."""
    for b in batches:
        # The names first: few pairs go on, and only their other columns are read.
        both = [(x.split(" "), y.split(" ")) for x, y in zip(b.column(3).to_pylist(), b.column(7).to_pylist())]
        scores = [names.name_match(x, y) for x, y in both]
        at = [n for n, s in enumerate(scores) if s[0] > 0]
        b = b.take(pa.array(at, pa.int32()))
        keep, out = [], []
        for n, (at_n, fa, pl_a, b0, fb, pl_b, lo) in enumerate(zip(at, *(b.column(k).to_pylist() for k in (4, 5, 6, 8, 9, 10)))):
            (ta, tb), (score, full, extra) = both[at_n], scores[at_n]
            kin = 0 if not fa or not fb else 1 if any(names.same_parent(fa, f.split()) for f in fb) else -1
            head = names.head_likeness(ta[-1], tb[-1])
            if kin < 1 and (full < 2 or extra) and head < 1 - 1.5 / max(len(ta[-1]), len(tb[-1])):
                continue
            same = bool(pl_a and pl_b) and not set(pl_a).isdisjoint(filter(None, map(_place, pl_b)))
            keep.append(n)
            out.append((head, score, full, extra, kin, int(same), int(lo is not None and b0 is not None)))
        at = pa.array(keep, pa.int32())
        cols = list(zip(*out)) or [[]] * 7
        kinds = [pa.float64()] * 2 + [pa.int32()] * 5
        yield pa.RecordBatch.from_arrays(
            [b.column(k).take(at) for k in range(3)] + [pa.array(c, t) for c, t in zip(cols, kinds)],
            names=["query", "doc", "other", "head_likeness", "likeness", "full", "extra", "kin", "same_place", "timed"],
        )


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps records that can be the same entry's or the same person's as the best record of their entity."""
    for b in batches:
        ok = []
        for fa, b0, b1, fb, c0, c1 in zip(*(b.column(k).to_pylist() for k in range(3, 9))):
            kin = not fa or not fb or names.same_parent(fa, fb)
            ok.append(kin and (b0 is None or c0 is None or max(b0, c0) <= min(b1, c1) + 2))
        yield b.filter(pa.array(ok, pa.bool_())).select(["query", "doc", "confidence"])


def _ranked(pairs: DataFrame) -> DataFrame:
    """`pairs` with n, the place among the documents of the query, and gap, the score's distance from the best other one's as a share of the greater."""
    by = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    other = F.when(F.col("n") == 1, F.coalesce(F.col("second"), F.lit(0.0))).otherwise(F.col("top"))
    ranked = pairs.withColumns({"n": F.row_number().over(by), "second": F.lead("score").over(by), "top": F.first("score").over(by)})
    return ranked.withColumn("gap", (F.col("score") - other) / F.greatest("score", other)).drop("second", "top")


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model with intercept, by Newton's method."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def accidental(fathers: list[tuple[list[str], list[str]]]) -> float:
    """How often the test for one father passes for two that have nothing to do with each other: the pairs' sides shifted against each other."""
    other = [d for _, d in fathers[1:]] + [d for _, d in fathers[:1]]
    met = sum(any(names.same_parent(r, f.split()) for f in d) for (r, _), d in zip(fathers, other))
    return (met + 1) / (len(fathers) + 50)


def calibrated(checked: DataFrame, fathers: DataFrame, rows: int) -> tuple[list[str], list[float], float]:
    """(features, weights of the logistic model, chance of an accidental agreement of fathers), fitted on at most `rows` records.

    checked: the documents with a known father of these records, two at least where there are two.

    A father that agrees is taken as a true pair, another as a false one. Where there is nothing to fit on, weights that ask for a good name stand in.
    """
    features = ["gap", "likeness", "full", "extra", "same_place", "timed"]
    sample = _ranked(checked).where("n = 1").limit(rows).join(fathers, ["query", "doc"]).toArrow().sort_by("query")  # not toPandas(): pandas alone takes 46 MB of the driver
    chance = accidental([*zip(sample["r_father"].to_pylist(), sample["d_fathers"].to_pylist())])
    kin = sample["kin"].to_numpy()
    if len(set(kin.tolist())) == 2:
        x = np.column_stack([sample[c].to_numpy().astype(float) for c in features])
        return features, fit_logistic(x, (kin == 1).astype(float)).tolist(), chance
    return features, [0.0, 1.0, 1.0, 0.5, -0.5, 1.0, 0.0], chance


def match_people(parish: DataFrame, entities: DataFrame, mentions: DataFrame, calibration_rows: int = CALIBRATION_ROWS, k: int = TOP) -> DataFrame:
    """(parish_record_id, entity_id, confidence): the record's person and the row of entities are the same.

    Rows of entities that mean one person (see variants) are one document of an inverted index over all spellings of its fullest name, relatives and places (a shorter
    spelling would hide that a name contradicts); the years are tested.
    A record asks for its person's names, the father's, those of other relatives and godparents at a lower weight, place, parish and island. Candidates are all spellings with an alike
    surname (found by what is left with letters left out, confirmed by edit distance) and a time that fits; pairs whose names contradict each other go, then those of another father.
    Of the rest each record keeps the k documents of the highest BM25 score with ties, found with upper bounds (see top_documents).
    Of them stay the record's nearest document and each that is as sure (a person may stand in several documents), where the record is the document's nearest
    or can be another reading or entry of that one's person. The confidence is a logistic function of the score's gap to the best other
    document, the names' likeness and the place, calibrated on at most `calibration_rows` records whose father and
    whose document's father are known; where the pair's own fathers agree, the odds are divided by the chance that they do so by accident. Records without a
    readable name and entities without one match nothing; missing dates, places and fathers contradict nothing.
    """
    facts = cut(entity_facts(entities).dropDuplicates(["id"]))
    forms, known = entity_forms(facts, mentions)
    forms = cut(forms)
    clusters = cut(same_entities(entities, mentions, facts, forms))
    people = facts.where("type = 'person'").join(clusters.withColumnRenamed("entity_id", "id"), "id")
    attributes = cut(people.groupBy(F.col("cluster").alias("id")).agg(F.collect_set("family").alias("fathers"), F.collect_set("place").alias("places"), F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    full = F.size(F.filter("tokens", lambda t: (F.length(t) > 2) & ~F.contains(t, F.lit("."))))
    spelt = forms.where("type = 'person' and suffix <> 'byname' and size(tokens) > 1").join(clusters.withColumnRenamed("entity_id", "id"), "id").select(F.col("cluster").alias("id"), "tokens", "suffix", full.alias("full")).distinct()
    spelt = cut(spelt.withColumn("most", F.max("full").over(Window.partitionBy("id"))).where("full = most").select("id", "tokens", "suffix"))
    rows = parish.where("id is not null").select(*_RECORD_COLUMNS)
    records = cut(_named(_named(arrow_map(rows, _records, _RECORD).dropDuplicates(["id"]), known, "tokens"), known, "father"))
    queries = cut(arrow_map(records.select("id", "tokens", "father", "kin", "places"), _query_terms, "id bigint, terms array<struct<term:string,weight:double>>"))
    queries = queries.select(F.col("id").alias("query"), F.inline("terms")).select("query", F.xxhash64("term").alias("term"), "weight", F.col("term").startswith("f:").alias("kin"))
    terms = arrow_map(spelt.select("id", "tokens"), _form_terms, "id bigint, terms array<string>").unionByName(arrow_map(attributes.select("id", "fathers", "places"), _fact_terms, "id bigint, terms array<string>"))
    index = cut(postings(terms.select("id", F.explode("terms").alias("term")).select("id", F.xxhash64("term").alias("term"))))
    heads = lambda df: df.select(F.lit("person").alias("type"), F.element_at("tokens", -1).alias("head"))
    links = cut(head_links(heads(records).union(heads(spelt))))
    met = candidates(records, spelt.join(attributes, "id"), links)
    wide = met.select("query", "doc", "other", *[F.col(f"r.{c}").alias(f"r_{c}") for c in ("tokens", "father", "places", "b0")], *[F.col(f"d.{c}").alias(f"d_{c}") for c in ("tokens", "fathers", "places", "lo")])
    wide = wide.withColumns({c: F.array_join(c, " ") for c in ("r_tokens", "d_tokens")})  # a worker reads strings faster than lists
    passed = arrow_map(wide, _check, _PAIR).withColumn("term", F.xxhash64(F.concat(F.lit("s:"), "other"))).join(index, ["term", "doc"])
    best = F.max(F.struct("likeness", "full", (-F.col("extra")).alias("less"))).alias("b")
    pairs = passed.groupBy("query", "doc").agg(best, F.max(F.col("head_likeness") * F.col("impact")).alias("head_score"), *[F.max(c).alias(c) for c in ("kin", "same_place", "timed")])
    pairs = cut(pairs.select("query", "doc", "head_score", "b.likeness", "b.full", (-F.col("b.less")).alias("extra"), "kin", "same_place", "timed"))
    known_fathers = records.select(F.col("id").alias("query"), F.col("father").alias("r_father")).join(pairs.where("kin <> 0").select("query", "doc"), "query").join(attributes.select(F.col("id").alias("doc"), F.col("fathers").alias("d_fathers")), "doc")
    told = pairs.where("kin <> 0")
    asked = told.select("query").distinct().orderBy(F.xxhash64("query")).limit(calibration_rows)
    scored = cut(top_documents(told.join(asked, "query"), queries.where("not kin").drop("kin"), index, 2))  # what the fathers say isn't in the scores it is fitted on
    queries = queries.drop("kin")
    features, w, chance = calibrated(scored, known_fathers, calibration_rows)
    z = F.lit(w[0])
    for c, weight in zip(features, w[1:]):
        z = z + F.col(c) * weight
    odds = F.exp(z) / F.when(F.col("kin") == 1, chance).otherwise(1.0)
    fits = _ranked(top_documents(pairs.where("kin >= 0"), queries, index, k)).withColumn("confidence", F.round(odds / (1 + odds), 4))
    near = cut(fits.where(f"(n = 1 or confidence >= {SURE}) and (full > 0 or kin = 1 or same_place = 1 or gap > 0.2)"))
    nearest = near.withColumn("best", F.max_by("query", F.struct("kin", F.col("n") == 1, "score", "query")).over(Window.partitionBy("doc")))
    other = records.select(F.col("id").alias("best"), F.col("father").alias("o_father"), F.col("b0").alias("o0"), F.col("b1").alias("o1"))
    mutual = nearest.join(records.select(F.col("id").alias("query"), "father", "b0", "b1"), "query").join(other, "best")
    mutual = arrow_map(mutual.select("query", "doc", "confidence", "father", "b0", "b1", "o_father", "o0", "o1"), _agree, "query bigint, doc bigint, confidence double")
    return mutual.join(clusters.withColumnRenamed("cluster", "doc"), "doc").select(F.col("query").alias("parish_record_id"), "entity_id", "confidence")
