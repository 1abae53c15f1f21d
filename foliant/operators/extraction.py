"""People, institutions, places and the relations between them, read out of text; one pass over each text in Arrow workers."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import lexicon as L
from foliant.tables import arrow_map


@lru_cache(maxsize=200_000)
def plain_name(text: str) -> str:
    """normalize_name() of foliant.functions.text for one value."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower().replace("’", "'")
    t = re.sub(r"\bd[' ]", "de ", t).replace("benedicto", "benedito").replace("affonso", "afonso")
    return " ".join(re.sub(r"[^a-z0-9'\s]", " ", t).split())


@lru_cache(maxsize=200_000)
def main_name(surface: str) -> str:
    """A name without outer punctuation and, beyond two words, without particles."""
    words = surface.strip(" ,.;:-").split()
    kept = [w for w in words if len(words) <= 2 or plain_name(w) not in L.PARTICLES]
    return " ".join(kept or words)


def spellings(name: str, surface: str) -> list[str]:
    """The forms under which a person may be searched: as read, without particles, modern spellings, d' for de and back, and the normal form in capitals."""
    low = name.lower()
    out = {surface.strip(), name, " ".join(w.capitalize() for w in plain_name(name).split())}
    for old, new in (("Affonso", "Afonso"), ("Benedicto", "Benedito")):
        if old.lower() in low:
            out.add(re.sub(old, new, name, flags=re.IGNORECASE))
    if "d'" in low:
        out.add(re.sub(r"\bd['’]", "de ", name, flags=re.IGNORECASE))
    if " de " in low:
        out.add(re.sub(rf"\bde\s+([{L.UPPER}])", r"d'\1", name))
    return sorted(x for x in out if x.strip())


def person_confidence(name: str, titled: bool) -> float:
    return min(0.55 + 0.07 * min(len(name.split()), 5) + 0.08 * titled, 0.96)


def cut_off(name: str) -> bool:
    """Whether a name ends in a fragment: a short capitalised last word after others, or one without a vowel."""
    words = name.split()
    if not words:
        return True
    last = words[-1]
    return len(words) > 1 and len(last) <= 3 and last[0].isupper() or len(last) >= 3 and not re.search("[aeiouáàâãéêíóôõú]", last, re.IGNORECASE)


@dataclass
class Entity:
    type: str
    name: str
    normalized: str
    surface: str
    aliases: list[str]
    confidence: float
    role: str = ""
    title: str = ""


@dataclass
class Relation:
    subject: str
    predicate: str
    object: str
    literal: str
    confidence: float
    status: str
    quote: str
    method: str


def people(text: str) -> list[Entity]:
    """Persons by normal name, each as it is named most confidently (the first of equals)."""
    best: dict[str, Entity] = {}
    for m in L.PERSON.finditer(text):
        name = main_name(m["name"])
        normal = plain_name(name)
        if len(normal.split()) < 2 or L.INSTITUTION_WORDS & set(normal.split()):
            continue
        title = L.TITLES.get(plain_name(m["title"] or ""), "")
        e = Entity("person", name, normal, f"{m['title'] or ''} {m['name']}".strip(), spellings(name, m["name"]), person_confidence(name, bool(m["title"])), title if plain_name(title) in L.ROLES else "", title)
        if normal not in best or e.confidence > best[normal].confidence:
            best[normal] = e
    return list(best.values())


def _named(kind: str, surfaces: Iterator[str], confidence: float) -> list[Entity]:
    last: dict[str, Entity] = {}
    for s in surfaces:
        s = " ".join(s.strip(" ,.;:-").split())
        if normal := plain_name(s):
            last[normal] = Entity(kind, s, normal, s, [s], confidence)
    return list(last.values())


def institutions(text: str) -> list[Entity]:
    return _named("institution", (m[0] for m in L.INSTITUTION.finditer(text)), 0.82)


def places(text: str) -> list[Entity]:
    """Places after a preposition; general words and single ones of four letters or fewer are none."""
    found = _named("place", (m["place"] for m in L.PLACE.finditer(text)), 0.72)
    return [e for e in found if (w := e.normalized.split())[0] not in L.NO_PLACES and (len(w) > 1 or len(w[0]) > 4)]


def entities(text: str) -> list[Entity]:
    return sorted([*people(text), *institutions(text), *places(text)], key=lambda e: (-e.confidence, e.type, e.name))


@dataclass
class Reading:
    """The relations of one text. Each source of relations is asked in turn; of the same statement the first one stays."""

    text: str
    found: list[Entity]
    by_name: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self.by_name = {}
        for e in self.found:
            self.by_name.setdefault(e.normalized, e.name)
        self.persons = [e for e in self.found if e.type == "person"]

    def known(self, raw: str) -> str:
        """The entity's name if the text names one so, else the raw name without particles."""
        return self.by_name.get(plain_name(raw)) or main_name(raw)

    def roles(self) -> Iterator[Relation]:
        for e in self.found:
            if e.role and not cut_off(e.name):
                yield Relation(e.name, "holds_role", "", e.role, min(e.confidence, 0.94), "probable", e.surface, "title_heuristic")

    def stated(self) -> Iterator[Relation]:
        for kind, pattern, confidence, status in L.RELATIONS:
            for m in pattern.finditer(self.text):
                got = m.groupdict()
                if cut_off(got["subject"]) or got["subject"].split()[0].lower() in L.NO_SUBJECTS or "object" in got and cut_off(got["object"]):
                    continue
                predicate = "deceased" if kind == "deceased_after" else kind
                name, literal = "", predicate.replace("_", " ")
                if "object" in got:
                    name, literal = ("", got["object"].strip(" ,.;:")) if predicate in L.LITERAL_OBJECTS else (self.known(got["object"]), "")
                yield Relation(self.known(got["subject"]), predicate, name, literal, confidence, status, m[0].strip(), "pattern_heuristic")

    def residences(self) -> Iterator[Relation]:
        if not any(w in self.text for w in L.RESIDENTS):
            return
        for e in self.persons:
            if L.INSTITUTION_SUBJECTS & set(e.normalized.split()):
                continue
            for alias in filter(None, map(str.strip, (e.surface, e.name, *e.aliases))):
                if found := self._resides(alias):
                    place, quote = found
                    yield Relation(e.name, "resident_of", "", place, 0.78, "hypothesis", quote, "pattern_heuristic")
                    break

    def _resides(self, alias: str) -> tuple[str, str] | None:
        """(place, quote) of the first place in the text where `alias` is followed by a residence."""
        at = self.text.find(alias)
        while at >= 0:
            if m := L.RESIDENCE.match(self.text, at + len(alias)):
                return m["place"].strip(" ,.;:"), self.text[at : m.end()].strip()
            at = self.text.find(alias, at + 1)
        return None

    def after_names(self) -> Iterator[Relation]:
        """What follows a name in badly read text; the first form of the name that is long enough is looked for, in any case; one statement a place."""
        low = self.text.lower()
        for e in self.persons:
            alias = next((a for a in (e.surface.strip(), e.name) if len(a) >= 5), None)
            if alias is None or cut_off(e.name):
                continue
            at = low.find(alias.lower())
            while at >= 0:
                end = at + len(alias)
                yield from self._after(e, at, end)
                at = low.find(alias.lower(), at + 1)

    def _after(self, e: Entity, at: int, end: int) -> Iterator[Relation]:
        for predicate, pattern, confidence in L.AFTER_NAMES:
            if not (m := pattern.match(self.text[end : end + 200])):
                continue
            raw = re.split(r"[,;.|\n]", m[1].strip(" ,.;:-\n|"))[0].strip()
            if len(raw) < 3 or cut_off(raw):
                continue
            name, literal = ("", raw) if predicate == "appointed_to" else (self.known(raw), "")
            r = Relation(e.name, predicate, name, literal, confidence, "hypothesis", self.text[at : end + m.end()].strip()[:200], "ocr_tolerant_heuristic")
            if name != e.name and self.new(r):
                yield r
                return

    def together(self) -> Iterator[Relation]:
        for n, e in enumerate(self.persons):
            for other in self.persons[n + 1 :]:
                yield Relation(e.name, "mentioned_with", other.name, "", 0.58, "hypothesis", f"{e.surface} / {other.surface}", "cooccurrence_heuristic")

    def new(self, r: Relation) -> bool:
        return (r.subject, r.predicate, r.object, r.literal) not in self.seen

    def relations(self) -> list[Relation]:
        self.seen: set[tuple[str, str, str, str]] = set()
        out = []
        for source in (self.roles, self.stated, self.residences, self.after_names, self.together):
            for r in source():
                if self.new(r) and not (r.object and r.object == r.subject):
                    self.seen.add((r.subject, r.predicate, r.object, r.literal))
                    out.append(r)
        return out


def identity(e: Entity, found: list[Entity], year: str | None) -> tuple[str, str, float, list[str]]:
    """(key, status, confidence, hints) of an entity among those of its text."""
    if e.type != "person":
        return e.normalized, "resolved", e.confidence, []
    hints = [f"title:{plain_name(e.title)}"] if e.title else [f"role:{plain_name(e.role)}"] if e.role else []
    around = [x for x in found if x.type != "person" and x.name != e.name][:2]
    hints += [f"{'inst' if x.type == 'institution' else 'place'}:{plain_name(x.name)}" for x in around]
    words = e.normalized.split()
    family = [x.normalized for x in found if x.type == "person" and x.name != e.name and words and words[-1] in x.normalized.split()][:2]
    hints += [f"family:{x}" for x in family]
    if len(words) >= 3 and not hints:
        return e.normalized, "resolved", min(0.95, e.confidence), []
    if len(words) <= 2 and year and year != "?":
        hints.append(f"year:{year}")
    if not hints:
        return e.normalized, "resolved", e.confidence, []
    sure = bool(e.title or e.role or family) or len(words) >= 3
    return f"{e.normalized}::{'+'.join(hints)}", "contextual" if sure else "ambiguous", min(0.9, e.confidence), hints


_S = pa.string()
_ENTITY = [("type", _S), ("name", _S), ("normalized", _S), ("surface", _S), ("aliases", pa.list_(_S)), ("confidence", pa.float64()), ("role", _S), ("title", _S)]
_IDENTITY = [("identity_key", _S), ("status", _S), ("identity_confidence", pa.float64()), ("hints", pa.list_(_S))]
_RELATION = [("subject", _S), ("predicate", _S), ("object", _S), ("literal", _S), ("confidence", pa.float64()), ("status", _S), ("quote", _S), ("method", _S)]
_ENTITY_DDL = "type string, name string, normalized string, surface string, aliases array<string>, confidence double, role string, title string, identity_key string, status string, identity_confidence double, hints array<string>"
_RELATION_DDL = "subject string, predicate string, object string, literal string, confidence double, status string, quote string, method string"


def _facts(with_relations: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ents, rels = [], []
            for text, year in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = entities(text or "")
                said = Reading(text or "", found).relations() if with_relations else []
                ents.append([{**vars(e), **dict(zip(("identity_key", "status", "identity_confidence", "hints"), identity(e, found, year)))} for e in found])
                rels.append([{k: getattr(r, k) for k, _ in _RELATION} for r in said])
            cols = [b.column(0), pa.array(ents, pa.list_(pa.struct(_ENTITY + _IDENTITY))), pa.array(rels, pa.list_(pa.struct(_RELATION)))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "entities", "relations"])

    return run


def facts(texts: DataFrame, ident: str, text: str, year: str | None = None, with_relations: bool = True) -> DataFrame:
    """(id, entities, relations) of every row: what its text names, in order of confidence, each with its identity among the others, and what it says of them
    (nothing if with_relations is false).

    `year` (a column of text, null and '?' for none) goes into the identities of short names. Null and empty texts name nothing; a repeated
    row is read again; other columns don't matter.
    """
    rows = texts.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"), (F.col(year).cast("string") if year else F.lit(None).cast("string")).alias("year"))
    return arrow_map(rows, _facts(with_relations), f"id {dict(texts.dtypes)[ident]}, entities array<struct<{_colons(_ENTITY_DDL)}>>, relations array<struct<{_colons(_RELATION_DDL)}>>")


def _colons(ddl: str) -> str:
    return ",".join(f"{n}:{t}" for n, t in (x.split(" ", 1) for x in ddl.split(", ")))
