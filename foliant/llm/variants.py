"""Rows that name the same person or organisation in different spellings.

Two sets of keys find the pairs: what is left of the surname or town with letters left out, which names with initials share with the full ones, and MinHash bands
over the whole name, whose parts may be misread anywhere, the first letter too, or stand in another order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm import names
from foliant.tables import arrow_map, cut

#: Recall that a banding must reach at the likeness it is tuned for.
RECALL = 0.9
#: Letters from which on heads (surnames or towns) and first names can be one or two edits apart by names.head_likeness and names.token_likeness.
HEAD_EDITS, FIRST_EDITS = (4, 8), (3, 6)
#: Letters at the beginning of a word that are left out by turns. Words at most so many edits apart keep a form in common, whatever stands behind.
FORMS_OF = 14
#: Padded trigrams of the tokens of a whole name, which are full.
Q_NAME, NAME_LIKENESS, NAME_HASHES = 3, 0.6, 128
#: Years that may lie between two rows of one person; namesakes of other times lie further apart.
YEARS = 25
#: Keys, beside the spans of years, under which rows meet of which one has no years.
OPEN_LEFT, OPEN_RIGHT = -1_000_000, -1_000_001
#: Likeness of two names that counts as a link.
LINK = 0.8
#: Different rows of one entity in which a nickname stands for a name, at least.
NICKNAMES = 3


def bands_for(likeness: float, recall: float, hashes: int) -> tuple[int, int]:
    """(bands, rows a band): the most selective banding of at most `hashes` values whose collision curve 1 - (1 - s^rows)^bands reaches `recall` at `likeness`."""
    best = (hashes, 1)
    for rows in range(1, 9):
        bands = hashes // rows
        if 1 - (1 - likeness**rows) ** bands >= recall:
            best = (bands, rows)
    return best


def padded_grams(word: str, q: int) -> set[str]:
    w = "#" * (q - 1) + word + "#" * (q - 1)
    return {w[i : i + q] for i in range(len(w) - q + 1)}


@lru_cache(maxsize=200_000)
def _fnv(text: str) -> int:
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def band_keys(grams: set[str], bands: int, rows: int) -> list[int]:
    """The MinHash band values of a set of q-grams."""
    one = np.array([_fnv(g) for g in grams], dtype=np.uint64)
    seeds = np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = one[None, :] ^ seeds[:, None]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    low = x.min(axis=1).reshape(bands, rows)
    out = np.zeros(bands, dtype=np.uint64)
    for k in range(rows):
        out = (out * np.uint64(0x100000001B3)) ^ low[:, k]
    return (out ^ np.arange(bands, dtype=np.uint64)).astype(np.int64).tolist()


def left_out(word: str, edits: tuple[int, int]) -> list[str]:
    """What is left of the beginning of a word if up to as many letters are left out as its length allows edits: none below edits[0] letters, one, from edits[1] on two.

    Two words that are so many edits apart (a swap of neighbours is one) have one of these in common; none is lost.
    """
    most = sum(len(word) >= n for n in edits)
    w = word[:FORMS_OF]
    return sorted({"".join(x) for k in range(most + 1) for x in combinations(w, len(w) - k)})


def head_keys(head: str) -> list[str]:
    """The forms by which a head meets the heads that are alike."""
    return left_out(head, HEAD_EDITS)


def _first_forms(first: str) -> list[str]:
    """The forms of a full first name; initials and abbreviations never mean one that begins otherwise."""
    return left_out(first, FIRST_EDITS) if names.is_full(first) else []


def name_keys(tokens: list[str]) -> list[int]:
    """The band values of a whole name; none unless two tokens are full."""
    full = [t for t in tokens if names.is_full(t)]
    if len(full) < 2:
        return []
    return band_keys(set().union(*(padded_grams(t, Q_NAME) for t in full)), *bands_for(NAME_LIKENESS, RECALL, NAME_HASHES))


_FORMS = "id bigint, type string, tokens array<string>, suffix string, n bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, type, form, n) -> one row per form that can be read as a name."""
    for b in batches:
        out = []
        for i, kind, form, n in zip(*(b.column(k).to_pylist() for k in range(4))):
            got = (names.person if kind == "person" else names.organisation)(form) if form else None
            if got and got[0]:
                out.append((i, kind, got[0], got[1], n))
        cols = list(zip(*out)) or [[]] * 5
        kinds = [pa.int64(), pa.string(), pa.list_(pa.string()), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "type", "tokens", "suffix", "n"])


_FACTS = "id bigint, type string, lo int, hi int, family string, place string, names array<string>"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Years, hints and names of each row of entities."""
    for b in batches:
        out = []
        for i, kind, name, listed, attributes, first, last in zip(*(b.column(k).to_pylist() for k in range(7))):
            span = names.years(first, last) or (None, None)
            hint = names.hints(attributes)
            father = names.person(hint.get("family", ""))
            all_names = [x for x in [name, *names.aliases(listed)] if x and x.strip(" ?")]
            out.append((i, kind, *span, " ".join(father[0]) if father else None, hint.get("place"), all_names))
        cols = list(zip(*out)) or [[]] * 7
        kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["id", "type", "lo", "hi", "family", "place", "names"])


def entity_facts(entities: DataFrame) -> DataFrame:
    """(id, type, lo, hi, family, place, names) of the persons and institutions."""
    rows = entities.select("id", "type", "canonical_name", "aliases_json", "attributes_json", "first_seen_year", "last_seen_year")
    return arrow_map(rows.where("id is not null and type in ('person', 'institution')"), _facts, _FACTS)


def nicknames(forms: DataFrame, least: int = NICKNAMES) -> DataFrame:
    """(nick, name): first tokens that stand for another one in forms of one row that agree in all other tokens.

    Learnt from the rows themselves: `least` different rows must say so, and the other name must be the more frequent.
    """
    p = forms.where("type = 'person' and size(tokens) > 1").select(
        "id", F.col("tokens")[0].alias("first"), F.array_join(F.slice("tokens", F.lit(2), F.size("tokens")), " ").alias("rest")
    )
    p = p.where("length(first) > 2 and not contains(first, '.') and not contains(rest, '.')").distinct()
    often = p.groupBy("first").agg(F.count_distinct("id").alias("times"))
    a, b = p.withColumnRenamed("first", "nick"), p.withColumnRenamed("first", "name")
    pairs = a.join(b, ["id", "rest"]).where("nick <> name and levenshtein(nick, name) > 1").groupBy("nick", "name").agg(F.count_distinct("id").alias("rows"))
    pairs = pairs.where(F.col("rows") >= least)
    pairs = pairs.join(often.withColumnRenamed("first", "nick").withColumnRenamed("times", "a"), "nick").join(often.withColumnRenamed("first", "name").withColumnRenamed("times", "b"), "name")
    return pairs.where("b > a").groupBy("nick").agg(F.max_by("name", F.struct("rows", "name")).alias("name"))


def entity_forms(facts: DataFrame, mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, type, tokens, suffix, n), the different names of each row of entities, from its own columns and its mentions, with nicknames replaced, where n is how
    often each is written; and the nicknames. They are learnt from the names as they are written: where they are replaced, next to nothing is left to learn from."""
    own = facts.select("id", "type", F.explode("names").alias("form")).withColumn("n", F.lit(1).cast("bigint"))
    said = mentions.groupBy(F.col("entity_id").alias("id"), F.col("surface_form").alias("form")).agg(F.count("*").alias("n")).where("form is not null and form not in ('', '?')")
    said = said.join(facts.select("id", "type"), "id").select("id", "type", "form", "n")
    forms = cut(arrow_map(own.unionByName(said), _parse, _FORMS).groupBy("id", "type", "tokens", "suffix").agg(F.sum("n").alias("n")))
    known = cut(nicknames(forms))
    named = forms.withColumn("nick", F.col("tokens")[0]).join(known, "nick", "left")
    tokens = F.when((F.col("type") == "person") & F.col("name").isNotNull() & (F.size("tokens") > 1), F.concat(F.array("name"), F.slice("tokens", F.lit(2), F.size("tokens")))).otherwise(F.col("tokens"))
    return named.select("id", "type", tokens.alias("tokens"), "suffix", "n").groupBy("id", "type", "tokens", "suffix").agg(F.sum("n").alias("n")), known


def best_names(forms: DataFrame) -> DataFrame:
    """(id, tokens, suffix, full): the fullest name of each row, of equally full ones the most written; a byname only if there is no other."""
    full = F.size(F.filter("tokens", lambda t: (F.length(t) > 2) & ~F.contains(t, F.lit("."))))
    order = F.struct((F.col("suffix") != "byname").alias("real"), (F.length(F.element_at("tokens", -1)) > 2).alias("head"), full.alias("full"), "n", "tokens", "suffix")
    return forms.groupBy("id").agg(F.max(order).alias("b")).select("id", "b.tokens", "b.suffix", F.col("b.full").alias("full"))


def _met_by(forms: Callable[[str], list[str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(type, word) -> (type, word, form)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [forms(word) for word in b.column(1).to_pylist()]
            at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([v for k in keys for v in k], pa.string())], names=["type", "word", "form"])

    return run


def _name_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(type, name) -> (type, name, bucket)."""
    for b in batches:
        keys = [name_keys(name.split(" ")) for name in b.column(1).to_pylist()]
        at = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([v for k in keys for v in k], pa.int64())], names=["type", "name", "bucket"])


def _alike_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([names.head_likeness(x, y) > 0 for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.bool_()))


def _apart(a: list[str], b: list[str]) -> bool:
    """Whether two names mean one although their heads or first letters keep them apart in the banding of heads."""
    if a[0][:1] == b[0][:1] and names.head_likeness(a[-1], b[-1]) > 0:
        return False
    return names.name_match(a, b)[0] >= LINK or names.reordered(a, b)


def _names_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array([_apart(x.split(" "), y.split(" ")) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())], pa.bool_()))


def _both_ways(pairs: DataFrame, key: str) -> DataFrame:
    ends = F.array(F.struct(F.col(key).alias("x"), F.col("other").alias("y")), F.struct(F.col("other").alias("x"), F.col(key).alias("y")))
    return pairs.select("type", F.explode(ends).alias("e")).select("type", F.col("e.x").alias(key), F.col("e.y").alias("other"))


def heads_fit(a: Column, b: Column) -> Column:
    """Whether two heads can be alike by names.head_likeness, as far as the JVM can tell: no pair that is alike is lost.

    Up to seven letters they are one edit apart, longer ones two; a swap of neighbours, one edit there, counts twice for levenshtein() and leaves the letters as they are.
    """
    apart = F.levenshtein(a, b, 4)
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    swapped = letters(a) == letters(b)
    one = (apart == 0) | (apart == 1) | ((apart == 2) & swapped)
    two = apart.isin(0, 1, 2) | ((apart == 3) & (F.levenshtein(letters(a), letters(b)) <= 2)) | ((apart == 4) & swapped)
    return (F.abs(F.length(a) - F.length(b)) <= 2) & F.when(F.least(F.length(a), F.length(b)) < 8, one).otherwise(two)


def _sharing(words: DataFrame, forms: Callable[[str], list[str]]) -> DataFrame:
    """(type, word, other): the pairs of different words, the smaller first, that have a form in common, once for each."""
    banded = arrow_map(words, _met_by(forms), "type string, word string, form string").select("type", "word", F.xxhash64("form").alias("form"))
    return banded.join(banded.withColumnRenamed("word", "other"), ["type", "form"]).where("word < other")


def head_links(heads: DataFrame) -> DataFrame:
    """(type, head, other): each different head with itself and with all those that names.head_likeness accepts."""
    heads = cut(heads.select("type", "head").distinct())
    met = _sharing(heads, head_keys).where(heads_fit(F.col("word"), F.col("other"))).select("type", F.col("word").alias("head"), "other").distinct()
    alike = arrow_map(met, _alike_heads, "type string, head string, other string")
    return _both_ways(alike, "head").unionByName(heads.select("type", "head", F.col("head").alias("other")))


def first_letters(firsts: DataFrame) -> DataFrame:
    """(first, letters): the letters under which a first name is looked for: its own and those of more frequent ones that it can be a misreading of.

    firsts: (first), as often as it is written. Of two that can be one and begin apart, the rarer has the other's letter.
    """
    often = cut(firsts.groupBy("first").agg(F.count("*").alias("n")))
    met = _sharing(often.select(F.lit("person").alias("type"), "first"), _first_forms).where("left(word, 1) <> left(other, 1)").select("word", "other").distinct()
    met = met.where(first_names_fit(F.col("word"), F.col("other")))
    met = met.join(often.withColumnsRenamed({"first": "word", "n": "a"}), "word").join(often.withColumnsRenamed({"first": "other", "n": "b"}), "other")
    low, high = F.expr("if(struct(a, word) < struct(b, other), word, other)"), F.expr("if(struct(a, word) < struct(b, other), other, word)")
    own = often.select("first", F.left("first", F.lit(1)).alias("letter"))
    return own.unionByName(met.select(low.alias("first"), F.left(high, F.lit(1)).alias("letter"))).groupBy("first").agg(F.collect_set("letter").alias("letters"))


def name_links(nodes: DataFrame) -> DataFrame:
    """(type, name, other): different whole names that mean one and that heads and first letters keep apart: by a misread first name, or turned against
    each other, so that the first token of each stands in the other. What can be neither goes before a worker sees it."""
    banded = arrow_map(nodes.where("type = 'person'").select("type", "name").distinct(), _name_bands, "type string, name string, bucket bigint")
    first, last = (lambda c: F.substring_index(c, " ", 1)), (lambda c: F.substring_index(c, " ", -1))
    a, b = banded, banded.withColumnRenamed("name", "other")
    misread = (F.left("name", F.lit(1)) != F.left("other", F.lit(1))) & (F.levenshtein(first("name"), first("other")) <= 2)
    inside = lambda x, y: F.contains(F.concat(F.lit(" "), F.col(y), F.lit(" ")), F.concat(F.lit(" "), first(x), F.lit(" ")))
    turned = (last("name") != last("other")) & inside("name", "other") & inside("other", "name") & (first("name") != first("other"))
    met = a.join(b, ["type", "bucket"]).where((F.col("name") < F.col("other")) & (misread | turned)).select("type", "name", "other").distinct()
    return _both_ways(arrow_map(met, _names_apart, "type string, name string, other string"), "name")


def link_score(kind: str, a: list[str], b: list[str], years_apart: int | None, family_a: str | None, family_b: str | None, same_place: bool, same_suffix: bool = True) -> float:
    """The strength of the link between two names, 0 if there is none.

    years_apart is None where a side has no year. Persons whose fathers are both named and differ are not linked. Where one is named as
    the younger ('Filho') and the other isn't, the father must speak for it. Where only initials
    and the surname agree, two initials or the father, the place or the very years must speak for it.
    """
    if years_apart is not None and years_apart > YEARS:
        return 0.0
    if kind == "institution":
        score, full, extra = names.name_match(a, b, loose_tail=False)
        return score if score >= LINK else 0.0
    score, full, extra = names.name_match(a, b)
    if score < LINK:
        if not names.reordered(a, b):
            return 0.0
        score, full, extra = 0.9, len(a), 0
    kin = False
    if family_a and family_b:
        kin = names.same_parent(family_a.split(), family_b.split())
        if not kin:
            return 0.0
    if not same_suffix and not kin:
        return 0.0
    if full == 0:
        initials = min(len(a), len(b)) - 1
        if not (kin or same_place or initials >= 2 or years_apart is not None and years_apart <= 3):
            return 0.0
    return score + 0.02 * min(full, 3) - 0.04 * extra + 0.05 * kin


def _names_link(kind: str, a: str, b: str) -> bool:
    """Whether the names alone allow a link (see link_score)."""
    x, y = a.split(" "), b.split(" ")
    return names.name_match(x, y, loose_tail=kind != "institution")[0] >= LINK or kind != "institution" and names.reordered(x, y)


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        # The names first: few pairs go on, and only their other columns are read.
        b = b.filter(pa.array([_names_link(*x) for x in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)))], pa.bool_()))
        scores = [
            0.0 if sa != sb and "byname" in (sa, sb)
            else link_score(kind, ta.split(" "), tb.split(" "), None if la is None or lb is None else max(0, la - hb, lb - ha), fa, fb, bool(pa_ and pa_ == pb), sa == sb)
            for kind, ta, tb, la, ha, lb, hb, fa, fb, pa_, pb, sa, sb in zip(*(b.column(k).to_pylist() for k in range(2, 15)))
        ]
        keep = pa.array([s > 0 for s in scores], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([s for s in scores if s > 0], pa.float64())], names=["u", "v", "score"])


def first_names_fit(a: Column, b: Column) -> Column:
    """Whether two first names can be one by names.token_likeness, as far as the JVM can tell: no pair that is alike is lost.

    Initials and abbreviations begin alike; of full ones, up to five letters one edit apart, longer ones two, where a swap of neighbours counts twice for levenshtein().
    """
    short = F.contains(a, F.lit(".")) | F.contains(b, F.lit(".")) | (F.length(a) < 3) | (F.length(b) < 3)
    apart = F.levenshtein(a, b)
    sorted_ = lambda c: F.array_sort(F.split(c, ""))
    five = (apart <= 1) | ((apart == 2) & (sorted_(a) == sorted_(b)))
    return F.when(short, F.left(a, F.lit(1)) == F.left(b, F.lit(1))).when(F.least(F.length(a), F.length(b)) < 6, five).otherwise(apart <= 4)


def near_pairs(nodes: DataFrame, links: DataFrame, key: str, same: list[str]) -> DataFrame:
    """The pairs (a_.., b_..) of nodes, a_node below b_node, whose `key` a link joins and whose years lie at most YEARS apart; missing years lie near all.

    links: (type, key, other). The years are part of the join's key, as spans of YEARS: a node meets others of its own and the neighbouring spans, each pair in the
    first span they share, so namesakes of other times never meet.
    """
    cols = ["node", "tokens", "suffix", "lo", "hi", "family", "place"]
    span = lambda c: F.floor(F.col(c) / YEARS).cast("int")
    n = nodes.withColumn("from", span("lo")).withColumn("to", span("hi"))
    n = n.select("type", *same, F.col(key).alias("key"), "from", "to", *cols)
    left = n.select("type", *same, F.col("key").alias(key), "from", "to", *[F.col(c).alias(f"a_{c}") for c in cols]).join(links, ["type", key])
    right = n.select("type", *same, F.col("key").alias("other"), F.col("from").alias("b_from"), F.col("to").alias("b_to"), *[F.col(c).alias(f"b_{c}") for c in cols])
    on = ["type", *same, "other"]
    wanted = ["a_node", "b_node", "type", *[f"{p}_{c}" for c in ("tokens",) for p in "ab"], "a_lo", "a_hi", "b_lo", "b_hi", "a_family", "b_family", "a_place", "b_place", "a_suffix", "b_suffix"]
    # One join for all: a left node without years meets all right ones under OPEN_LEFT, one with years those without under OPEN_RIGHT, so no pair meets under two keys of these.
    open_left, open_right = F.array(F.lit(OPEN_LEFT)), F.array(F.lit(OPEN_RIGHT))
    left = left.withColumn("k", F.explode(F.when(F.col("a_lo").isNull(), open_left).otherwise(F.concat(F.sequence("from", "to"), open_right))))
    right = right.withColumn("k", F.explode(F.concat(F.when(F.col("b_lo").isNull(), open_right).otherwise(F.sequence(F.col("b_from") - 1, F.col("b_to") + 1)), open_left)))
    near = f"k = greatest(from, b_from - 1) and greatest(a_lo - b_hi, b_lo - a_hi) <= {YEARS}"
    return left.join(right, [*on, "k"]).where(f"a_node < b_node and (k in ({OPEN_LEFT}, {OPEN_RIGHT}) or {near})").select(*wanted)


def stars(edges: DataFrame, rank: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, star): star clustering of the graph (u, v, score; each edge once), rank: (node, full).

    In each round the undecided nodes that outrank all their undecided neighbours, by full names, then degree, then a hash of the node,
    become centres; their undecided neighbours join the centre of the strongest link. As nodes of equal names and degree are ranked at random, the
    rounds grow with the logarithm of the longest chain, not with its length; an error is raised if `most_rounds` don't do. Nodes without
    edges are not in the result. Only edges between undecided nodes are carried on, so the rounds shrink.
    """
    both = edges.union(edges.select("v", "u", "score"))
    degree = both.groupBy("u").agg(F.count("*").alias("degree"))
    order = degree.join(rank, degree.u == rank.node).select("u", F.struct(F.col("full"), F.col("degree"), F.xxhash64("u").alias("dice"), F.col("u").alias("own")).alias("r"))
    first = live = cut(both.join(order, "u").withColumnRenamed("r", "ru").join(order.select(F.col("u").alias("v"), F.col("r").alias("rv")), "v").select("u", "v", "score", "ru", "rv"))
    done: DataFrame | None = None
    for _ in range(most_rounds):
        if live.isEmpty():
            break
        top = live.groupBy("u", "ru").agg(F.max("rv").alias("m"))
        centres = top.where("ru > m").select(F.col("u").alias("node"), F.col("u").alias("star"))
        # No neighbour of a centre is one.
        joined = (
            live.join(centres.select(F.col("star").alias("v")), "v")
            .groupBy(F.col("u").alias("node"))
            .agg(F.max_by("v", F.struct("score", "rv")).alias("star"))
        )
        now = cut(centres.union(joined))
        done = now if done is None else done.union(now)
        gone = now.select("node")
        live = cut(live.join(gone.withColumnRenamed("node", "u"), "u", "left_anti").join(gone.withColumnRenamed("node", "v"), "v", "left_anti").select("u", "v", "score", "ru", "rv"))
    else:
        if not live.isEmpty():
            raise RuntimeError(f"stars did not settle in {most_rounds} rounds")
    if done is None:
        return rank.select("node", F.col("node").alias("star")).limit(0)
    # What has lost all its neighbours to centres is a star of its own.
    return first.select(F.col("u").alias("node")).distinct().join(done, "node", "left").select("node", F.coalesce("star", "node").alias("star"))


def same_entities(entities: DataFrame, mentions: DataFrame, facts: DataFrame | None = None, forms: DataFrame | None = None) -> DataFrame:
    """(entity_id, cluster): the rows of entities that mean the same person or organisation share a cluster, named by its smallest id.

    Rows with the same fullest name, father and decade are one node; nodes that meet in a MinHash band, by their heads and initials or by their whole names,
    are verified by Monge-Elkan likeness with years and fathers, and clustered by star clustering. Places, unreadable names and
    rows without a year are handled: places are left out, a row without any name is alone, missing years contradict nothing. Repeated
    ids count once.
    """
    facts = cut(entity_facts(entities).dropDuplicates(["id"])) if facts is None else facts
    best = cut(best_names(entity_forms(facts, mentions)[0] if forms is None else forms))
    rows = facts.select("id", "type", "lo", "hi", "family", "place").join(best, "id")
    rows = rows.withColumn("decade", F.floor(F.col("lo") / 10))
    group = ["type", "tokens", "suffix", "decade", "family"]
    nodes = cut(
        rows.groupBy(*group).agg(F.min("id").alias("node"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("full").alias("full"), F.min("place").alias("place"))
        .withColumn("head", F.element_at("tokens", -1))
        .withColumn("initial", F.substring(F.col("tokens")[0], 1, 1))
        .withColumn("name", F.array_join("tokens", " "))
    )
    members = rows.select("id", *group).join(
        nodes.select(*[F.col(c).alias(f"_{c}") for c in group], "node"),
        F.expr(" and ".join(f"{c} <=> _{c}" for c in group)),
    ).select("id", "node")
    linkable = nodes.where("length(head) > 2")
    near = near_pairs(linkable, cut(head_links(linkable)), "head", ["initial"]).where(first_names_fit(F.col("a_tokens")[0], F.col("b_tokens")[0]))
    met = near.unionByName(near_pairs(linkable, cut(name_links(linkable)), "name", []))
    met = met.withColumns({c: F.array_join(c, " ") for c in ("a_tokens", "b_tokens")})  # a worker reads strings faster than lists
    edges = cut(arrow_map(met, _links, "u bigint, v bigint, score double"))
    star = stars(edges, nodes.select("node", "full"))
    named = star.join(star.groupBy("star").agg(F.min("node").alias("cluster")), "star").select("node", "cluster")  # a node is the smallest id of its rows
    return members.join(named, "node", "left").select(F.col("id").alias("entity_id"), F.coalesce("cluster", "node").alias("cluster"))


def same_entity_pairs(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id_a, entity_id_b), smaller first: all pairs of rows of one cluster of same_entities()."""
    c = cut(same_entities(entities, mentions))
    a, b = c.withColumnRenamed("entity_id", "entity_id_a"), c.withColumnRenamed("entity_id", "entity_id_b")
    return a.join(b, "cluster").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")
