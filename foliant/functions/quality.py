"""Scores of text and of names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import normalize_name, strip_accents

#: Vocabularies of the noise rules, normalised.
VESSELS = ["sumaca", "barca", "barco", "bergantim", "corveta", "escuna", "fragata", "galeota", "navio", "vapor"]
PLACES = ["bairro", "cidade", "freguesia", "ilha", "largo", "povoacao", "porto", "praia", "provincia", "recife", "rio", "rua", "villa", "vila"]
INSTITUTIONS = [
    "associacao", "companhia", "comp", "sociedade", "instituto", "camara", "alfandega", "mesa", "consulado", "secretaria", "thezouro",
    "thesouro", "igreja", "tribunal", "junta", "prefeitura", "governo", "presidencia", "typographia", "tipografia",
]
PLACE_STOPS = ["rua", "villa", "vila", "cidade", "provincia", "bairro", "sessao", "tipografia", "typographia", "diario", "boa", "comp", "dito", "dita", "art", "anno"]
EDITORIAL = ["sessao", "summario", "sumario", "indice", "artigo", "edicao", "numero", "folha", "pagina", "texto", "formula"]
SINGLES = ["boa", "comp", "art", "dito", "dita", "idem", "anno", "nos", "sua", "seus", "elle", "ella"]
STARTS = ["villa", "vila", "rio", "rua", "bairro", "sumaca", "vapor"]
FALSE_PHRASES = [
    "deos guarde", "deus guarde", "guarde deos", "guarde deus", "diario pernambuco", "diario de pernambuco", "rio grande sul", "rio grande", "villa conde",
    "vila conde", "porto alegre", "santa luzia", "sumaca santa luzia", "praca uniao", "le citoyen", "forte mattos", "forte mato",
    "proclamacao assemblea geral brazil", "proclamacao assemblea geral brasil",
]
DISCOVERY_PHRASES = [
    "diario", "diario de pernambuco", "tipografia", "tipografia do diario", "sessao", "boa", "comp", "art", "acervo", "praca", "conselho", "forte mattos", "forte mato",
]
DISCOVERY_SINGLES = ["boa", "comp", "art", "diario", "sessao", "tipografia", "dito", "dita", "idem", "acervo", "praca", "conselho"]
CONTEXT_ONLY = [
    "administrador", "alferes", "assemblea", "assembleia", "brasil", "brigadeiro", "camara", "capitao", "citoyen", "commandante", "comandante", "conselheiro",
    "coronel", "desembargador", "director", "diretor", "forte", "general", "geral", "governo", "inspector", "juiz", "junta", "major", "militar", "padre", "praca",
    "prefeito", "presidente", "proclamacao", "secretario", "tenente", "trem", "uniao", "vigario", "brazil",
]

VOWELS = "[aeiouyáàâãéêíóôõúAEIOUYÁÀÂÃÉÊÍÓÔÕÚ]"
#: A word of three letters or more, and a line that holds eight letters.
WORD = r"[A-Za-zÀ-ÿ][A-Za-zÀ-ÿ'-]{2,}"
EIGHT = "(?:[A-Za-zÀ-ÿ][^A-Za-zÀ-ÿ]*+){8}"


def real_word_ratio(text: Column, letters: int = 2) -> Column:
    """The share of tokens with so many letters at least."""
    tokens = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    real = F.filter(tokens, lambda t: F.length(F.regexp_replace(t, "[^A-Za-zÀ-ÿ]+", "")) >= letters)
    return F.size(real) / F.nullif(F.size(tokens), F.lit(0))


def ocr_metrics(text: Column) -> dict[str, Column]:
    """chars, valid_word_ratio, short_line_ratio, odd_char_ratio and score of a text that clean_text() has gone over."""
    # text and counts are bound once each, as the element of an array of one
    parts = F.struct(text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"), F.filter(F.split(text, "\n"), lambda x: x != "").alias("lines"))
    counts = F.transform(F.array(parts), _counts)[0]
    found = F.transform(F.array(counts), _scores)[0]
    return {k: found[k] for k in ("chars", "valid_word_ratio", "short_line_ratio", "odd_char_ratio", "score")}


def _counts(parts: Column) -> Column:
    t, words, lines = parts["text"], parts["words"], parts["lines"]
    n = lambda c, name: c.cast("double").alias(name)
    return F.struct(
        n(F.length(t), "chars"),
        n(F.size(lines), "lines"),
        n(F.size(words), "long"),
        n(F.size(F.filter(words, lambda w: w.rlike(VOWELS))), "valid"),
        n(F.size(F.filter(lines, lambda x: ~x.rlike(EIGHT))), "short"),
        n(F.length(F.regexp_replace(t, r"""[A-Za-zÀ-ÿ0-9\s,.;:!?()'"-]+""", "")), "odd"),
        n(F.length(F.regexp_replace(t, "[^A-Za-zÀ-ÿ]+", "")), "letters"),
        n(F.length(F.regexp_replace(t, "[^A-ZÀ-Þ]+", "")), "upper"),
    )


def _scores(c: Column) -> Column:
    per = lambda x, y, none: F.coalesce(c[x] / F.nullif(c[y], F.lit(0.0)), F.lit(none))
    vwr, short, odd, upper = per("valid", "long", 0.0), per("short", "lines", 1.0), per("odd", "chars", 0.0), per("upper", "letters", 0.0)
    score = (
        0.52 * vwr
        + 0.18 * F.least(c["valid"] / 120, F.lit(1.0))
        + 0.14 * F.least(per("chars", "lines", 0.0) / 50, F.lit(1.0))
        + 0.10 * (1 - short)
        + 0.06 * F.greatest(F.lit(0.0), 1 - 8 * odd)
    )
    score = score * F.when(c["chars"] < 120, 0.55).otherwise(1.0) * F.when((upper > 0.72) & (vwr < 0.55), 0.8).otherwise(1.0)
    score = F.when(c["chars"] == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    return F.struct(
        c["chars"].cast("long").alias("chars"), F.round(vwr, 4).alias("valid_word_ratio"), F.round(short, 4).alias("short_line_ratio"),
        F.round(odd, 4).alias("odd_char_ratio"), F.round(score, 4).alias("score"),
    )


def _has(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*map(F.lit, words)))


#: The rules of noise_of(), in order.
NOISE = ["phrase", "vessel", "place", "institution", "place word", "place start", "editorial", "generic", "year only", "two short"]


def noise_of(kind: Column, name: Column, status: Column, hints: Column) -> tuple[Column, Column]:
    """(noise score, the rules that hold) of a person's name; the score is that of the strongest rule, 0 for other kinds. The weights are fixed values."""
    n = normalize_name(F.coalesce(name, F.lit("")))
    t = F.filter(F.split(n, " "), lambda x: x != "")
    first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    rules = [
        (n.isin(*FALSE_PHRASES), 0.96),
        (_has(t, VESSELS), 0.83),
        (_has(t, PLACES), 0.76),
        (_has(t, INSTITUTIONS), 0.74),
        (_has(t, PLACE_STOPS), 0.70),
        (first.isin(*STARTS), 0.78),
        (_has(t, EDITORIAL), 0.76),
        ((F.size(t) == 1) & first.isin(*SINGLES), 0.85),
        (F.coalesce(status.isin("ambiguous", "contextual") & (F.size(hints) > 0) & F.forall(hints, lambda h: h.startswith("year:")), F.lit(False)), 0.58),
        ((F.size(t) == 2) & F.forall(t, lambda x: F.length(x) <= 4), 0.52),
    ]
    return F.when(kind == "person", F.greatest(F.lit(0.0), *[F.when(c, v).otherwise(0.0) for c, v in rules])).otherwise(0.0), F.when(
        kind == "person", F.array_compact(F.array(*[F.when(c, F.lit(name)) for (c, _), name in zip(rules, NOISE)]))
    ).otherwise(F.array().cast("array<string>"))


def entity_noise(kind: Column, name: Column, status: Column, hints: Column) -> Column:
    """The noise score of a person's name, the largest of the rules that hold; 0 for other kinds."""
    return noise_of(kind, name, status, hints)[0]


def discovery_noise(kind: Column, name: Column, status: Column, hints: Column) -> Column:
    """The noise score for public lists."""
    n = normalize_name(F.coalesce(name, F.lit("")))
    t = F.filter(F.split(n, " "), lambda x: x != "")
    first = F.coalesce(F.get(t, F.lit(0)), F.lit(""))
    bare = F.when((F.size(t) > 0) & F.forall(t, lambda x: x.isin(*CONTEXT_ONLY)), 0.93).otherwise(0.0)
    person = F.greatest(entity_noise(kind, name, status, hints), bare)
    both = F.greatest(F.when(n.isin(*DISCOVERY_PHRASES), 0.96).otherwise(0.0), F.when((F.size(t) == 1) & first.isin(*DISCOVERY_SINGLES), 0.9).otherwise(0.0))
    place = F.greatest(
        both,
        F.when(_has(t, INSTITUTIONS), 0.8).otherwise(0.0),
        F.when(_has(t, EDITORIAL), 0.88).otherwise(0.0),
        F.when((F.size(t) == 1) & (F.length(first) <= 4), 0.72).otherwise(0.0),
    )
    institution = F.greatest(
        both,
        F.when(n.isin("comp", "companhia do", "companhia da"), 0.9).otherwise(0.0),
        F.when((F.size(t) == 1) & first.isin("comp", "art", "dito", "dita"), 0.86).otherwise(0.0),
    )
    return F.when(kind == "person", person).when(kind == "place", place).when(kind == "institution", institution).otherwise(both)


def is_discovery_noise(kind: Column, score: Column) -> Column:
    return F.when(kind == "person", score >= 0.55).otherwise(score >= 0.6)


#: Formulas and foreign words that no name holds; names that make a short one recognisable; words that begin no name; letters that misread text doubles up.
FORMULAS = (
    r"\b(?:nosso\s+senhor|nossa\s+se|reino\s+d|rainha\s+nossa|legitimidade|soberan[cç]|nussimento|divisaô|successaõ|successora|santo\s+antão|inspecção|"
    r"juiz\s+paz|brejo\s+d|massa\s+ma)\b"
)
FOREIGN = r"\b(?:sheep|skins|french|the|and|with|from|king|queen)\b"
FAMILIAR = [
    "antonio", "joze", "jose", "joaquim", "francisco", "manoel", "manuel", "joao", "luiz", "pedro", "maria", "anna", "rosa", "thomaz", "carlos", "silva", "ferreira",
    "pereira", "souza", "costa", "mello", "santos", "oliveira", "lima", "rodrigues", "pinto", "barros", "ramos", "gomes", "lopes", "alves", "moreira", "rocha", "bastos",
    "cavalcante", "monteiro",
]
OFFICES, OFFICE_STARTS = ["juiz", "chefe", "mestre", "coronel ", "tenente ", "capitão "], ["juiz", "chefe", "mestre", "mr", "dr"]
NAME_PREPOSITIONS = ["de", "da", "do", "das", "dos", "e", "d'"]
ODD_PAIRS = r"(?i)[ôõêã][^aeiouáàâãéêíóôõúsrnlm\s]"
NAME_VOWEL = "(?i)[aeiouáàâãéêíóôõú]"


def _substantive(name: Column) -> Column:
    return F.filter(F.split(F.trim(name), r"\s+"), lambda t: ~F.lower(t).isin(*NAME_PREPOSITIONS, ""))


def legible_name(name: Column) -> Column:
    """Whether a name looks like one: long enough, no formula or foreign word, vowels in its tokens, no letter three times in a row, no cut end."""
    tokens = _substantive(name)
    two = F.filter(tokens, lambda t: F.length(t) == 2)
    ok = (
        (F.length(name) >= 5)
        & ~name.rlike("(?iu)" + FORMULAS)
        & ~name.rlike("(?i)" + FOREIGN)
        & (F.size(tokens) > 0)
        & ~F.exists(tokens, lambda t: (F.length(t) <= 1) | ~t.rlike(NAME_VOWEL))
        & ~((F.size(tokens) >= 3) & (F.size(two) >= 2))
        & ~strip_accents(name).rlike(r"(.)\1{2,}")
        & (F.length(F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))) > 3)
        & (F.length(F.trim(F.regexp_replace(F.regexp_replace(name, r"[^a-záàâãéêíóôõúçA-ZÁÀÂÃÉÊÍÓÔÕÚÇ\s'-]", ""), r"\s+", " "))) >= 0.85 * F.length(F.trim(name)))
    )
    return F.coalesce(ok, F.lit(False))


def legible_label(name: Column) -> Column:
    """The stricter test for labels of a graph: two words, no loose hyphen, no office, no odd pair of letters, a familiar name among short ones."""
    tokens, low = _substantive(name), F.lower(name)
    office = F.exists(F.array(*map(F.lit, OFFICES)), lambda o: F.contains(low, o)) & F.split_part(low, F.lit(" "), F.lit(1)).isin(*OFFICE_STARTS)
    familiar = F.exists(tokens, lambda t: F.regexp_replace(F.lower(t), "s+$", "").isin(*FAMILIAR))
    bad = F.exists(tokens, lambda t: (F.length(t) <= 1) | ((F.length(t) >= 3) & ~t.rlike(NAME_VOWEL)) | t.rlike(ODD_PAIRS))
    ok = (
        (F.length(name) >= 5)
        & (F.size(F.split(F.trim(name), r"\s+")) >= 2)
        & ~F.contains(name, F.lit("- "))
        & ~F.contains(name, F.lit(" -"))
        & ~strip_accents(name).rlike(r"(.)\1{2,}")
        & ~office
        & (F.size(tokens) > 0)
        & ~bad
        & (F.length(F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(""))) > 4)
        & (familiar | (F.size(tokens) >= 3))
    )
    return F.coalesce(ok, F.lit(False))


def legible_for_merge(name: Column) -> Column:
    """The test before a merge without a reviewer: two words of two letters, a vowel, no letter three times in a row."""
    real = F.filter(F.split(F.trim(name), r"\s+"), lambda t: F.length(t) >= 2)
    ok = (F.length(name) >= 5) & (F.size(real) >= 2) & F.exists(real, lambda t: t.rlike(NAME_VOWEL)) & ~F.lower(name).rlike(r"(.)\1{2,}")
    return F.coalesce(ok, F.lit(False))


def looks_truncated(name: Column) -> Column:
    """Whether the last token is a cut-off piece: three letters or fewer after others, or none but consonants."""
    tokens = F.split(F.trim(name), r"\s+")
    last = F.element_at(tokens, -1)
    return ((F.length(last) <= 3) & last.rlike(r"^\p{Lu}") & (F.size(tokens) >= 2)) | ((F.length(last) >= 3) & ~last.rlike("(?i)[aeiouáàâãéêíóôõú]"))
