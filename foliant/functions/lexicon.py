"""Patterns and word lists of the extraction from text."""

from __future__ import annotations

import re

#: Titles, folded, and their label.
TITLES = {
    "dr": "Doutor", "doutor": "Doutor", "doutora": "Doutora", "sr": "Senhor", "sra": "Senhora", "senhor": "Senhor", "senhora": "Senhora", "capitao": "Capitão",
    "coronel": "Coronel", "major": "Major", "tenente": "Tenente", "padre": "Padre", "vigario": "Vigário", "conselheiro": "Conselheiro", "desembargador": "Desembargador",
    "comendador": "Comendador", "barao": "Barão", "visconde": "Visconde", "d": "D.",
}
#: Titles that are a role.
ROLES = {"capitao", "major", "tenente", "coronel", "padre", "vigario", "doutor", "doutora", "conselheiro", "desembargador", "comendador", "barao", "visconde"}
#: Words that mark an institution, in names and in the subjects of a residence.
INSTITUTION_WORDS = {
    "associacao", "companhia", "comp", "sociedade", "instituto", "camara", "alfandega", "mesa", "consulado", "secretaria", "thezouro", "thesouro", "igreja",
    "tribunal", "junta", "prefeitura", "governo", "presidencia", "typographia", "tipografia",
}
INSTITUTION_SUBJECTS = {"associacao", "companhia", "sociedade", "instituto", "camara", "igreja", "alfandega", "commercio", "commercial", "partido", "junta", "tribunal"}
#: First words that aren't a place, particles left out of long names, and first words that aren't a person.
NO_PLACES = {"rua", "villa", "vila", "cidade", "provincia", "bairro", "sessao", "tipografia", "typographia", "diario", "boa", "comp", "dito", "dita", "art", "anno"}
PARTICLES = {"de", "da", "do", "das", "dos", "e", "em", "para", "por", "com", "sem"}
NO_SUBJECTS = {"na", "no", "em", "da", "do", "ao", "pela", "pelo"}

#: Patterns of names, institutions and places.
UPPER, LOWER = "A-ZÁÀÂÃÉÊÍÓÔÕÚÇ", "a-záàâãéêíóôõúç"
WORD = f"(?:[{UPPER}][{LOWER}]+|d['’][{UPPER}][{LOWER}]+)"
NAME = rf"{WORD}(?:\s+(?:(?:de|da|do|das|dos|e|d['’])\s+)?{WORD}){{1,6}}"
PERSON = re.compile(
    r"\b(?:(?P<title>D\.|Dr\.?|Doutor|Doutora|Sr\.?|Sra\.?|Senhor|Senhora|Capit[aã]o|Coronel|Major|Tenente|Padre|Vig[aá]rio|Conselheiro|Desembargador|Comendador|Bar[aã]o|Visconde)\s+)?"
    rf"(?P<name>{NAME})\b"
)
INSTITUTION = re.compile(
    r"\b(?:Associaç[aã]o|Association|Sociedade|Companhia|Comp\.?|Instituto|C[aâ]mara|Alf[aâ]ndega|Mesa|Consulado|Secretaria|Thesouro|Typographia|Igreja|Tribunal|Junta|Governo|Presid[eê]ncia)"
    rf"(?:\s+(?:[{UPPER}][{LOWER}]+|de|do|da|dos|das|e)){{0,10}}\b"
)
PLACE = re.compile(rf"\b(?:em|na|no|para)\s+(?P<place>[{UPPER}][{LOWER}]+(?:\s+(?:de|do|da|dos|das)\s+[{UPPER}][{LOWER}]+){{0,3}})\b")

#: Fixed values: (predicate, pattern, confidence, status) of relations between a subject and an object, in this order.
RELATIONS = [
    (p, re.compile(pattern), confidence, status)
    for p, pattern, confidence, status in [
        ("spouse_of", rf"(?P<subject>{NAME})\s*,?\s*(?:e sua esposa|E sua esposa|casado com|Casado com|consorte de|Consorte de)\s+(?P<object>{NAME})", 0.88, "probable"),
        ("child_of", rf"(?P<subject>{NAME})\s*,?\s*(?:filho|filha|Filho|Filha)\s+(?:leg[ií]tim[oa]\s+)?de\s+(?P<object>{NAME})", 0.92, "probable"),
        ("parent_of", rf"(?P<subject>{NAME})\s*,?\s*(?:pai|m[aã]e|Pai|M[aã]e)\s+de\s+(?P<object>{NAME})", 0.90, "probable"),
        ("widow_of", rf"(?P<subject>{NAME})\s*,?\s*(?:vi[uú]va)\s+de\s+(?P<object>{NAME})", 0.83, "hypothesis"),
        ("member_of", rf"(?P<subject>{NAME})\s*,?\s*(?:s[óo]cio|membro|integrante|presidente|secret[aá]rio)\s+(?:do|da)\s+(?P<object>[{UPPER}][^,;\n]{{4,80}})", 0.82, "probable"),
        ("appointed_to", rf"(?P<subject>{NAME})\s*,?\s*(?:nomeado|nomeada|nomeio|eleito|eleita)\s+(?:para\s+)?(?:o\s+cargo\s+de\s+|ao\s+cargo\s+de\s+|para\s+)?(?P<object>[{UPPER}][^,;.\n]{{3,60}})", 0.85, "probable"),
        ("deceased", rf"(?:faleceu|falleceo|falleceu)\s+(?:o|a|os|as)?\s*(?P<subject>{NAME})", 0.80, "hypothesis"),
        ("deceased_after", rf"(?P<subject>{NAME})\s*,?\s*(?:faleceu|falleceo|falleceu|falecido|falecida)", 0.80, "hypothesis"),
        ("traveled_to", rf"(?P<subject>{NAME})\s*,?\s*(?:embarcou|partiu|chegou|desembarcou)\s+(?:no\s+porto\s+de\s+|para\s+|de\s+|em\s+)(?P<object>[{UPPER}][{LOWER}]+(?:\s+(?:de|do|da)\s+[{UPPER}][{LOWER}]+){{0,2}})", 0.75, "hypothesis"),
        ("signed_by", rf"(?:assinado|assignado|firmado)\s+(?:por|pelo|pela)\s+(?P<subject>{NAME})", 0.78, "hypothesis"),
    ]
]
#: Predicates whose object stays a text.
LITERAL_OBJECTS = {"member_of", "resident_of", "appointed_to", "traveled_to"}
#: What follows a person's name where that person lives somewhere.
RESIDENCE = re.compile(rf"(?:[^.;\n]{{0,120}}?)\s*,\s*(?:morador|residente|domiciliado)\s+(?:na|no|em)\s+(?P<place>[{UPPER}][^,;\n]{{2,60}})")
#: One of these words stands in every residence.
RESIDENTS = ("morador", "residente", "domiciliado")
#: Fixed values: (predicate, pattern, confidence) of what follows a name in badly read text, in any case.
AFTER_NAMES = [
    (p, re.compile(pattern, re.IGNORECASE), confidence)
    for p, pattern, confidence in [
        ("child_of", rf",?\s*filh[oa]\s+(?:leg[ií]tim[oa]\s+)?d[eao]\s+([{UPPER}][\w\s',\-]{{3,50}})", 0.88),
        ("widow_of", rf",?\s*vi[uú]va\s+d[eoa]\s+([{UPPER}][\w\s',\-]{{3,50}})", 0.80),
        ("spouse_of", rf",?\s*casad[oa]\s+com\s+([{UPPER}][\w\s',\-]{{3,50}})", 0.85),
        ("appointed_to", rf",?\s*nomead[oa]\s+(?:para\s+)?(?:o\s+cargo\s+d[eao]\s+)?([{UPPER}][\w\s]{{3,50}})", 0.82),
    ]
]
