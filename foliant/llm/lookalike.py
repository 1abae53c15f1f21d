"""Texts that look the same but differ in their characters, brought to one form."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.tables import cut

#: Letters that look like a Latin letter, then that letter.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ν": "v", "ο": "o", "ρ": "p", "ϲ": "c", "Ϲ": "C", "ϳ": "j", "Ϳ": "J",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    "Օ": "O", "օ": "o", "Տ": "S", "հ": "h", "ո": "n", "ս": "u", "ց": "g", "զ": "q",
    "ɑ": "a", "ɡ": "g",
    "‐": "-", "‑": "-",
}
#: Ligatures and other single characters that look like several.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st", "ĳ": "ij", "Ĳ": "IJ", "ǉ": "lj", "ǌ": "nj", "…": "..."}


@cache
def look_map() -> dict[str, str]:
    """Every character that looks like another single one: full-width and half-width forms, mathematical letters and digits of all styles, spaces,
    single-letter Roman numerals (all by their Unicode decomposition, of all planes), LOOK_ALIKES, and letters with accents over a base in LOOK_ALIKES.
    Circled and raised characters look different and are left."""
    out = dict(LOOK_ALIKES)
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x20000)]):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        to = [chr(int(x, 16)) for x in rest.split()]
        if kind in ("<wide>", "<narrow>", "<font>") and len(to) == 1:
            out[c] = out.get(to[0], to[0])
        elif unicodedata.category(c) == "Zs":
            out[c] = " "
        elif kind == "<compat>" and unicodedata.category(c) == "Nl" and len(to) == 1:
            out[c] = to[0]
        elif kind and kind[0] != "<":
            full = unicodedata.normalize("NFD", c)
            if full[0] in LOOK_ALIKES:
                one = unicodedata.normalize("NFC", LOOK_ALIKES[full[0]] + full[1:])
                if len(one) == 1:
                    out[c] = one
    return out


@cache
def skeleton_map() -> tuple[str, str]:
    """For translate(): look-alikes and accented letters become their base letter; ASCII other than letters and
    digits, spaces, marks and characters without a form of their own go."""
    look, keep, drop = look_map(), {}, []
    for n in [*range(0xAC00), *range(0xD7B0, 0xD800), *range(0xF900, 0x10000), *(ord(c) for c in look if c > "\uffff"), *range(0xE0000, 0xE01F0)]:
        c = chr(n)
        if c in LIGATURES:
            drop.append(c)  # and the letters it stands for, see skeleton()
            continue
        base = unicodedata.normalize("NFD", look.get(c, c))[0]
        base = look.get(base, base)
        kind = unicodedata.category(base)
        if kind in ("Cc", "Cf", "Zs", "Zl", "Zp", "Mn", "Me") or (base < "\x80" and not base.isalnum()):
            drop.append(c)
        elif base != c:
            keep[c] = base
    return "".join(keep) + "".join(drop), "".join(keep.values())


def look_form(text: Column) -> Column:
    """`text` with look-alikes, ligatures, spaces and line ends mapped; accents and invisible characters are left to the collation."""
    look = look_map()
    out = F.translate(text, "".join(look), "".join(look.values()))
    for c, to in LIGATURES.items():
        out = F.replace(out, F.lit(c), F.lit(to))
    return F.replace(out, F.lit("\r\n"), F.lit("\n"))


def skeleton(text: Column) -> Column:
    """A form that is equal for all texts that look the same; texts that look different may share it, too."""
    some = text
    for c, to in LIGATURES.items():
        if to.isalpha():
            some = F.replace(some, F.lit(c), F.lit(to))
    gone, kept = skeleton_map()
    return F.translate(F.regexp_replace(some, "[ᄀ-ᇿ가-힣]", ""), gone, kept)


#: Two 64-bit hashes that stand for a text together.
_T = ["t", "u"]


def _hashed(texts: DataFrame) -> DataFrame:
    return texts.withColumns({"t": F.xxhash64("text"), "u": F.xxhash64(F.lit(1), F.col("text"))})


def _keys(texts: DataFrame, ident: str, text: str) -> DataFrame:
    rows = texts.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(r"[^\p{Z}\p{C}]"))
    return _hashed(rows).select("doc_id", *_T, F.xxhash64(skeleton(F.col("text"))).alias("s"))


def _classes(texts: DataFrame, ident: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(keys of all rows, members): members are the rows whose look some other text shares, with canonical_id.

    Only hashes are shuffled for all rows. Texts are compared under the collation only where two different ones share
    a skeleton; exact copies count once there.
    """
    keys = cut(_keys(texts, ident, text))
    mixed = keys.groupBy("s").agg(*[f(c).alias(f"{f.__name__}_{c}") for f in (F.min, F.max) for c in _T]).where("min_t <> max_t or min_u <> max_u").select("s")
    near = keys.join(mixed, "s")
    one = near.groupBy("s", *_T).agg(F.min("doc_id").alias("doc_id"))
    values = (
        _hashed(texts.select(F.col(ident).alias("doc_id"), F.col(text).alias("text")))
        .join(one, ["doc_id", *_T])
        .groupBy("s", *_T, "doc_id")
        .agg(F.min("text").alias("text"))
        .select("s", *_T, "doc_id", F.collate(look_form(F.col("text")), "UNICODE").alias("value"))
    )
    values = cut(values.withColumn("value", F.col("value").cast("string"))).withColumn("value", F.collate("value", "UNICODE"))
    canonical = values.groupBy("s", "value").agg(F.min("doc_id").alias("canonical_id"), F.count("*").alias("n"))
    named = values.join(canonical.where("n > 1"), ["s", "value"]).select("s", *_T, "canonical_id")
    return keys, near.join(named, ["s", *_T])


def look_pairs(texts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_a, doc_id_b), smaller first: rows whose texts differ as strings and look the same.

    Look-alike-mapped values are grouped under the accent-sensitive UNICODE collation, which equates composed and combining
    accents and skips invisible characters. Null, empty and blank texts and exact copies make no pair. A row repeated
    with the same id pairs like one row.
    """
    _, members = _classes(texts, ident, text)
    m = members.select("canonical_id", *_T, "doc_id").distinct()
    side = lambda x: m.select("canonical_id", F.col("t").alias(f"t_{x}"), F.col("u").alias(f"u_{x}"), F.col("doc_id").alias(f"doc_id_{x}"))
    return side("a").join(side("b"), "canonical_id").where("doc_id_a < doc_id_b and (t_a <> t_b or u_a <> u_b)").select("doc_id_a", "doc_id_b").distinct()


def look_canonical(texts: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, canonical_id), one row per row of `texts` with a text that isn't blank: the smallest doc_id whose text looks the same."""
    keys, members = _classes(texts, ident, text)
    copies = keys.groupBy(*_T).agg(F.min("doc_id").alias("first_id"))
    named = members.select(*_T, "s", "canonical_id").distinct()
    return keys.join(copies, _T).join(named, [*_T, "s"], "left").select("doc_id", F.least("first_id", F.coalesce("canonical_id", "first_id")).alias("canonical_id"))
