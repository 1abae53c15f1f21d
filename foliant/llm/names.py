"""Names as people write them: parts, spellings, abbreviations, and how alike two are."""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

#: Particles, words that end a name without being its surname, and titles, folded.
PARTICLES = {"de", "da", "do", "das", "dos", "e", "d", "del", "la"}
SUFFIXES = ("neto", "filho", "junior", "sobrinho", "filha", "sobrinha")
TITLES = {
    "d", "dona", "dom", "sr", "sra", "senhor", "senhora", "dr", "doutor", "pe", "padre", "frei", "fr", "vigario", "vig", "cura", "conego", "con", "conselheiro", "cons",
    "comendador", "com", "comor", "desembargador", "des", "tenente", "ten", "alferes", "alf", "capitao", "cap", "capm", "major", "maj", "coronel", "cel", "cor",
    "barao", "visconde", "conde", "sargento", "sarg", "general", "gen", "vigo", "padr", "conso", "dezor",
}
#: Words that begin a byname ("the lame one of the quay"), folded; it is no name, but may be all there is.
BYNAMES = {"o", "a", "tio", "tia", "compadre", "comadre", "nho", "nha"}


def plain(text: str) -> str:
    """Lower case, without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def spelt(token: str) -> str:
    """One spelling for the spellings of a time: ph is f, y is i, z is s, h is silent but for the first letter, which an initial may stand for, letters aren't doubled."""
    t = token.replace("ph", "f").replace("y", "i").replace("z", "s").replace("'", "").replace("’", "")
    t = t[:1] + t[1:].replace("h", "")
    out = []
    for c in t:
        if not out or out[-1] != c:
            out.append(c)
    return "".join(out)


def parts(name: str) -> list[str]:
    """Tokens of a name in order, folded, the part before a comma last; an abbreviation keeps its '.' ('mont.o')."""
    p = plain(name.replace("º", "~o").replace("ª", "~a").replace("°", "~o"))
    if "," in p:
        head, _, rest = p.partition(",")
        p = f"{rest} {head}"
    out = []
    for word in p.split():
        word = word.strip("\"'()[];:?!-")
        dots = word.rstrip(".").count(".")
        if dots and all(len(x) <= 1 for x in word.rstrip(".").split(".")):
            out += [x + "." for x in word.rstrip(".").split(".") if x]  # M.R.B.
            continue
        abbreviated = "." in word or "~" in word
        left, _, right = word.replace("~", ".").replace("..", ".").partition(".")
        left, right = (re.sub(r"[^\w'’]", "", x) for x in (left, right))
        if not left:
            continue
        out.append(f"{left}.{right}" if abbreviated or len(left) == 1 and left != "e" else left)
    return out


_DOTTED_TITLE = re.compile(r"[A-ZÀ-Þ]\.[a-zà-ÿ]{1,3}\.?$")


def person(name: str) -> tuple[list[str], str] | None:
    """(tokens, suffix): given names and surname without titles and particles; None if nothing is left.

    suffix is one of SUFFIXES, 'byname' or ''.
    """
    head, _, rest = name.strip().partition(" ")
    if rest.strip() and _DOTTED_TITLE.match(head) and plain(head.replace(".", "")) in TITLES:
        name = rest  # P.e, D.r: a title with a small letter, no initials
    t = parts(name)
    if t and (first := plain(name).split()[0]) in BYNAMES:
        return [spell(x) for x in t[1:] if x not in PARTICLES] or [first], "byname"
    while len(t) > 1 and t[0].replace(".", "") in TITLES:
        if t[0] == "d." and len(t[1].rstrip(".")) < 3:
            break  # an initial
        t = t[1:]
    t = [x for x in t if x not in PARTICLES]
    suffix = ""
    if len(t) > 2 and any(distance(t[-1], s, 1) <= 1 for s in SUFFIXES):
        suffix = min(SUFFIXES, key=lambda s: distance(t[-1], s, 3))
        t = t[:-1]
    t = [spell(x) for x in t]
    return (t, suffix) if t and any(len(x) > 2 for x in t) or len(t) > 1 else None


def organisation(name: str) -> tuple[list[str], str] | None:
    """(tokens, ''): the words of an institution without particles."""
    t = [spell(x) for x in parts(name) if x not in PARTICLES]
    return (t, "") if len(t) > 1 or t and len(t[0]) > 2 else None


def spell(token: str) -> str:
    left, dot, right = token.partition(".")
    return spelt(left) + dot + spelt(right)


def is_full(token: str) -> bool:
    return "." not in token and len(token) > 2


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between a and b, or most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, older[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
    return row[-1]


@lru_cache(maxsize=500_000)
def token_likeness(a: str, b: str) -> float:
    """1 equal; below: alike up to few edits; an abbreviation that fits; an initial that fits; 0 otherwise."""
    if a == b:
        return 0.9 if len(a) <= 2 else 1.0
    if "." in b and "." not in a:
        a, b = b, a
    if "." in a:
        left, _, right = a.partition(".")
        other = b.replace(".", "")
        if not other.startswith(left[:1]):
            return 0.0
        if "." in b:
            short = min(len(left), len(b.partition(".")[0]))
            return 0.85 if left[:short] == other[:short] else 0.0
        if len(left) == 1:
            return 0.85 if not right or other.endswith(right) else 0.8
        if other.startswith(left):
            return 0.93
        it = iter(other)
        return 0.88 if all(c in it for c in left) else 0.0
    n = min(len(a), len(b))
    most = 0 if n < 3 else 1 if n < 6 else 2
    d = distance(a, b, most)
    return 1 - d / max(len(a), len(b)) if d <= most else 0.0


def head_likeness(a: str, b: str) -> float:
    """For surnames and places, which tell families and towns apart: one edit, from eight letters on two."""
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 8 else 2
    d = distance(a, b, most)
    return 1 - d / max(len(a), len(b)) if d <= most else 0.0


def monge_elkan(a: list[str], b: list[str]) -> float:
    """The mean over the tokens of each side of the best likeness on the other, the smaller of both means."""
    one = lambda x, y: sum(max(token_likeness(s, t) for t in y) for s in x) / len(x)
    return min(one(a, b), one(b, a)) if a and b else 0.0


def name_match(a: list[str], b: list[str], loose_tail: bool = True) -> tuple[float, int, int]:
    """(likeness, full tokens that agree, tokens of one side only); likeness 0 if the names contradict each other.

    Surnames must agree, first tokens too, and the tokens between in order; tokens between may be missing on
    one side (loose_tail), never on both. The likeness is Monge-Elkan's over the tokens that both have.
    """
    if not a or not b:
        return 0.0, 0, 0
    head = head_likeness(a[-1], b[-1])
    if not head:
        return 0.0, 0, 0
    x, y = (a[:-1], b[:-1]) if len(a) <= len(b) else (b[:-1], a[:-1])
    if not x:
        return (head, 1, len(y)) if not y else (0.0, 0, 0)
    pairs, at = [], 0
    missed = 0
    for k, s in enumerate(x):
        for j in range(at, len(y)):
            if k == 0 and j > 0:
                break
            if token_likeness(s, y[j]) > 0:
                pairs.append((s, y[j]))
                at = j + 1
                break
        else:
            missed += 1
            continue
        if k == 0 and at == 0:
            missed += 1
    if missed or not pairs or pairs[0][0] != x[0]:
        return 0.0, 0, 0
    extra = len(y) - len(pairs)
    if extra and not loose_tail:
        return 0.0, 0, 0
    score = monge_elkan([s for s, _ in pairs] + [a[-1]], [t for _, t in pairs] + [b[-1]])
    full = sum(is_full(s) and is_full(t) for s, t in pairs)
    return score, full, extra


def reordered(a: list[str], b: list[str]) -> bool:
    """Whether two names have the same three or more full tokens, one turned against the other ('Silva Anna Rosa')."""
    if len(a) != len(b) or len(a) < 3 or a == b or not all(map(is_full, (*a, *b))):
        return False
    return any(all(token_likeness(x, y) > 0 for x, y in zip(a, b[k:] + b[:k])) for k in range(1, len(b)))


def same_parent(a: list[str], b: list[str]) -> bool:
    """Whether two writings can mean one parent: the names match, or most tokens of the shorter one have a like on the other side."""
    if name_match(a, b)[0] > 0:
        return True
    x, y = (a, b) if len(a) <= len(b) else (b, a)
    return bool(x) and sum(max(token_likeness(s, t) for t in y) for s in x) / len(x) >= 0.6


def years(*texts: str | None) -> tuple[int, int] | None:
    """The first and last year (1500 to 2099) that the texts name."""
    found = [int(y) for t in texts for y in re.findall(r"(?<!\d)(?:1[5-9]|20)\d\d(?!\d)", t or "")]
    return (min(found), max(found)) if found else None


def hints(attributes: str | None) -> dict[str, str]:
    """family and place among the identity hints of attributes_json, also of a cut-off one; else of its identity_key."""
    out: dict[str, str] = {}
    for kind in ("family", "place", "title"):
        if m := re.search(rf'{kind}:([^"+\]]+)', attributes or ""):
            out[kind] = m[1].strip()
    return out


def aliases(text: str | None) -> list[str]:
    """The names in aliases_json; none if it can't be read."""
    if not text:
        return []
    try:
        got = json.loads(text)
    except ValueError:
        got = [x or y for x, y in re.findall(r"\"([^\"]*)\"|'([^']*)'", text)] if text.strip().startswith("[") else []
    return [x for x in got if isinstance(x, str) and x.strip(" ?")] if isinstance(got, list) else []
