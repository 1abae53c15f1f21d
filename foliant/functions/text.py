"""Normal forms of text as column expressions; all of them stay on the JVM."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of a search question that carry no meaning.
STOPWORDS = [
    "a", "o", "os", "as", "e", "de", "da", "do", "das", "dos", "d", "em", "na", "no", "sobre", "busque", "buscar",
    "informacao", "informacoes", "quem", "quais", "qual", "dados", "me", "traga", "trazer",
]
#: Tokens with one spelling, and particles dropped from long names.
TOKEN_SPELLING = {"benedicto": "benedito", "benedicta": "benedita", "capitam": "capitao", "dr": "doutor", "d": "de"}
NAME_PARTICLES = ["de", "da", "do", "das", "dos", "e", "em", "para", "por", "com", "sem"]


@cache
def _accents() -> tuple[str, str]:
    """Letters with accents up to U+024F and Greek and Cyrillic ones, and their bases, by Unicode decomposition."""
    pairs = []
    for n in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        base = unicodedata.normalize("NFD", chr(n))
        if len(base) > 1 and all(unicodedata.combining(c) for c in base[1:]):
            pairs.append((chr(n), base[0]))
    marks = "".join(map(chr, range(0x300, 0x370)))
    return "".join(p[0] for p in pairs) + marks, "".join(p[1] for p in pairs)


def strip_accents(c: Column) -> Column:
    gone, kept = _accents()
    return F.translate(c, gone, kept)


def compact(c: Column) -> Column:
    """White space runs as one space, none outside."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case, no accents, d' before a letter as 'de', other signs as spaces, one spelling per token."""
    plain = F.regexp_replace(strip_accents(F.lower(c)), "[‘’`´]", "'")
    plain = F.regexp_replace(plain, r"(?U)\bd'([a-z])", "de $1")
    plain = compact(F.regexp_replace(plain, "[^a-z0-9']+", " "))
    spelling = F.create_map(*[F.lit(x) for kv in TOKEN_SPELLING.items() for x in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda t: F.coalesce(spelling[t], t)), " ")


def normalize_name(c: Column) -> Column:
    """normalize_text for names: benedicto and affonso in one spelling, apostrophes kept."""
    plain = F.regexp_replace(F.lower(strip_accents(c)), "’", "'")
    plain = F.regexp_replace(plain, r"\bd[' ]", "de ")
    plain = F.replace(F.replace(plain, F.lit("benedicto"), F.lit("benedito")), F.lit("affonso"), F.lit("afonso"))
    return compact(F.regexp_replace(plain, r"[^a-z0-9'\s]", " "))


def normalize_parish(c: Column) -> Column:
    """The register's normal form: letters and digits only, d' as de."""
    plain = F.regexp_replace(F.trim(F.lower(strip_accents(c))), r"\bd[' ]\b", "de ")
    return compact(F.regexp_replace(plain, r"[^a-z0-9\s]", " "))


def significant_tokens(c: Column) -> Column:
    """Tokens of normalize_text of two letters or more that aren't stop words."""
    return F.filter(F.split(normalize_text(c), " "), lambda t: (F.length(t) >= 2) & ~t.isin(*STOPWORDS))


def focus_query(c: Column) -> Column:
    """The significant tokens joined, else the normalised question."""
    kept = F.array_join(significant_tokens(c), " ")
    return F.when(kept != "", kept).otherwise(normalize_text(c))


def clean_text(c: Column) -> Column:
    """Lines with two letters or digits at least, trimmed; runs of empty lines and spaces shortened."""
    lines = F.transform(F.split(c, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    kept = F.filter(lines, lambda x: x.rlike(r"[\p{L}\p{N}][^\p{L}\p{N}]*[\p{L}\p{N}]"))
    return F.trim(F.regexp_replace(F.array_join(kept, "\n"), " {3,}", " "))


def person_key(c: Column) -> Column:
    """A name without outer punctuation and, beyond two tokens, without particles."""
    bare = compact(F.regexp_replace(c, r"^[ ,.;:-]+|[ ,.;:-]+$", ""))
    tokens = F.split(bare, " ")
    return F.when(F.size(tokens) <= 2, bare).otherwise(F.array_join(F.filter(tokens, lambda t: ~F.lower(t).isin(*NAME_PARTICLES)), " "))


def last_token(c: Column) -> Column:
    return F.element_at(F.split(compact(c), " "), -1)


def snippet(text: Column, needle: Column, radius: int = 110) -> Column:
    """`radius` characters around the first occurrence in any case, '...' where cut; else the head of the text."""
    flat = compact(text)
    at = F.instr(F.lower(flat), F.lower(needle))
    start = F.greatest(at - radius, F.lit(1))
    stop = F.least(at + F.length(needle) + radius, F.length(flat) + 1)
    around = F.concat(F.when(start > 1, "...").otherwise(""), F.substring(flat, start, stop - start), F.when(stop <= F.length(flat), "...").otherwise(""))
    return F.when((at > 0) & (F.length(needle) > 0), around).otherwise(F.substring(flat, 1, 2 * radius))


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9._-]+", "-"), F.lit("-"))


def url_quote(c: Column) -> Column:
    """Percent-encoding with %20 for spaces."""
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def format_count(c: Column) -> Column:
    """Thousands parted by points."""
    return F.translate(F.format_number(c, 0), ",", ".")


def label(c: Column, prefix: str) -> Column:
    """A label without its prefix and a space, in any case."""
    return F.regexp_replace(F.trim(c), f"(?i)^{prefix} ", "")


def known(c: Column) -> Column:
    """Null for '', '?' and blanks."""
    return F.when(~F.trim(c).isin("", "?"), c)
