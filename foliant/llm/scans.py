"""Repair of text from scanned pages: edge lines, cut words and misread characters."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.tables import arrow_map, cut_table

#: What is printed, then what is read in its place.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("a", "u"), ("o", "0"), ("i", "1"), ("l", "1"), ("l", "|"), ("s", "5"), ("g", "9"), ("s", "ſ"), ("s", "f"), ("r", "v"), ("v", "y"),
    ("n", "u"), ("u", "n"), ("t", "f"), ("f", "t"), ("h", "b"), ("b", "h"), ("q", "g"), ("b", "6"), ("z", "2"), ("B", "8"),
    ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("in", "m"), ("li", "h"), ("h", "li"), ("nn", "m"), ("ri", "n"), ("ii", "u"),
]
#: Confusions that are also looked for two at a time in one word.
COMMON = CONFUSIONS[:19]
#: A word is taken as misread if the word it is confusable with stands in so many times as many texts, and in so many at least.
RATIO, RATIO_TWO, LEAST = 20, 60, 5
#: A right word of fewer letters is a short one, with a ratio of its own; letters of a word with two confusions, at least.
LETTERS, RATIO_SHORT, LETTERS_TWO = 4, 60, 6

HYPHENS = "-¬‐­=⸗‑"
_LINE = re.compile(r"\r\n|\r|\n")
_SURE_NUMBER = re.compile(r"(?:[\[(] ?\d{1,4} ?[\])]|[-—–.] ?\d{1,4} ?[-—–.]|(?:Pag|Pg|P|Fl|Fls|Folha)\. ?\d{1,4}(?: ?v)?\.?)$")
_BARE_NUMBER = re.compile(r"(?:\d{1,4}|[IVXLCDM]{1,8})\.?$")
_HEADERS = [
    re.compile(r"=+ *(?P<t>\S.*?) *=+$"),
    re.compile(r"\d{1,4} {3,}(?P<t>\S.*?) {3,}\d{4}$"),
    re.compile(r"(?P<t>[^a-zà-ÿ]{3,}?) ?— N\. ?\d+$"),
    re.compile(r"(?P<t>[A-ZÀ-Þ][^\d]{2,70}?)\. — \d{4}$"),
    re.compile(r"(?P<t>(?:[^\W\d_] {1,3}){3,}[^\W\d_])$"),
]
_DATED = re.compile(r"(?P<t>[A-ZÀ-Þ][^\d,]{2,70}?), \d{1,2} de \w+ de \d{4}$")
_DIGIT_LETTERS = str.maketrans("0159", "oisg")
#: What stands around a word; a '|' may be a misread letter of it.
_OUTER = re.compile(r"^(?:[^\w|]|_)+|(?:[^\w|]|_)+$")
_ENDED = tuple(".!?:;»\"”")


def title_key(title: str) -> str:
    """The letters of a title, without case, accents, spaces and misread digits."""
    plain = unicodedata.normalize("NFKD", title.lower().translate(_DIGIT_LETTERS))
    return "".join(c for c in plain if c.isalpha())


def _header(line: str) -> tuple[str, bool] | None:
    """(title key, sure) of a line that is, or may be, a running header."""
    for form in _HEADERS:
        if m := form.match(line):
            return title_key(m["t"]), True
    if m := _DATED.match(line):
        return title_key(m["t"]), False
    letters = [c for c in line if c.isalpha()]
    if len(letters) >= 4 and not any(c.islower() for c in letters):
        return title_key(line), False
    return None


def _titled(line: str) -> bool:
    """Whether a line is written as a title: two words or more, the longer ones with a capital, no digit and no end of a sentence."""
    words = line.split()
    long = [w for w in words if len(w) > 3]
    return 2 <= len(words) <= 9 and bool(long) and all(w[0].isupper() for w in long) and line[-1].isalpha() and not any(c.isdigit() for c in line)


def edge_lines(lines: list[str], titles: frozenset[str]) -> tuple[dict[int, str], list[str], list[str]]:
    """({line number: 'running_header' or 'page_number'}, keys of the sure headers, keys of the weak ones).

    A sure header has a form that only headers have; a weak one is a line without small letters or with a date, or the first
    or last line written as a title, and is a header if its key is in `titles`. A line that is a bare number belongs to the text where the next word would have
    fitted on the line before it (a wrapped line ends where the next word doesn't fit), and at the end of a text whose
    sentence it completes.
    """
    kinds: dict[int, str] = {}
    sure, weak, bare = [], [], []
    if sum(1 for x in lines if x.strip()) < 2:
        return kinds, sure, weak
    for i, line in enumerate(lines):
        s = line.strip()
        if not s:
            kinds[i] = ""
        elif _SURE_NUMBER.match(s):
            kinds[i] = "page_number"
        elif _BARE_NUMBER.match(s):
            bare.append(i)
        elif head := _header(s):
            if head[1]:
                sure.append(head[0])
                kinds[i] = "running_header"
            else:
                weak.append(head[0])
                if head[0] in titles:
                    kinds[i] = "running_header"
    solid = [i for i in range(len(lines)) if i not in kinds and i not in bare]
    for i in dict.fromkeys((*solid[:1], *solid[-1:])):
        if _titled(s := lines[i].strip()) and (key := title_key(s)) not in weak:
            weak.append(key)
            if key in titles:
                kinds[i] = "running_header"
                solid.remove(i)
    width = max((len(lines[i].rstrip()) for i in solid), default=0)
    for i in bare:
        before = max((k for k in solid if k < i), default=None)
        after = min((k for k in solid if k > i), default=None)
        p = lines[before].rstrip() if before is not None else ""
        if before is None:
            is_number = after is not None
        elif p[-1] in HYPHENS or p.endswith(_ENDED):
            is_number = True
        elif after is None:
            is_number = False
        else:
            is_number = len(p) + 1 + len(lines[after].split()[0]) > width
        if is_number:
            kinds[i] = "page_number"
    return kinds, sure, weak


def _bare(token: str) -> str:
    return _OUTER.sub("", token)


def read_text(text: str, titles: frozenset[str] = frozenset()) -> dict:
    """Edge lines, cut words (left, right) and the other words of a text."""
    lines = _LINE.split(text)
    kinds, sure, weak = edge_lines(lines, titles)
    solid = [lines[i].split() for i in range(len(lines)) if kinds.get(i) is None]
    cuts, words = [], set()
    carried = False
    for n, tokens in enumerate(solid):
        if carried:
            tokens = tokens[1:]
        carried = False
        if tokens and n + 1 < len(solid) and len(last := tokens[-1]) > 1 and last[-1] in HYPHENS and last[-2].isalnum():
            left, right = _bare(last[:-1]), _bare(solid[n + 1][0])
            if left and right and solid[n + 1][0][0].isalnum():
                cuts.append((left, right))
                tokens, carried = tokens[:-1], len(solid[n + 1]) > 0
        words.update(w for w in map(_bare, tokens) if w)
    edges = [(kind, lines[i].strip()) for i, kind in kinds.items() if kind]
    return {"edges": edges, "sure": sure, "weak": weak, "cuts": cuts, "words": list(words)}


_PAIR = pa.struct([("l", pa.string()), ("r", pa.string())])
_EDGE = pa.struct([("kind", pa.string()), ("item", pa.string())])
_READ = "tid binary, text string, sure array<string>, weak array<string>, edges array<struct<kind:string,item:string>>, cuts array<struct<l:string,r:string>>, words array<string>"


def _rows(out: list[tuple[bytes, str | None, dict]]) -> pa.RecordBatch:
    rows = [x[2] for x in out]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[0] for x in out], pa.binary()),
            pa.array([x[1] for x in out], pa.string()),
            pa.array([r["sure"] for r in rows], pa.list_(pa.string())),
            pa.array([r["weak"] for r in rows], pa.list_(pa.string())),
            pa.array([[{"kind": k, "item": i} for k, i in r["edges"]] for r in rows], pa.list_(_EDGE)),
            pa.array([[{"l": x, "r": y} for x, y in r["cuts"]] for r in rows], pa.list_(_PAIR)),
            pa.array([r["words"] for r in rows], pa.list_(pa.string())),
        ],
        names=["tid", "text", "sure", "weak", "edges", "cuts", "words"],
    )


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text) -> its row with no weak header taken as one; `text` is carried on where there are weak ones, however many."""
    for b in batches:
        out = []
        for tid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            r = read_text(text)
            out.append((tid, text if r["weak"] else None, r))
        yield _rows(out)


def _read_titled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(tid, text, titles) -> the row of a text some of whose weak headers are known titles."""
    for b in batches:
        yield _rows([(tid, None, read_text(text, frozenset(titles))) for tid, text, titles in zip(*(b.column(k).to_pylist() for k in range(3)))])


def char_value(c: str) -> int:
    """What one character adds to the anagram hash of its word."""
    return ord(c) ** 3 % 2**45


def anagram_hash(word: Column) -> Column:
    """The sum of char_value over the characters: equal for anagrams; a confusion changes it by the same amount in any word."""
    code = lambda c: F.ascii(c).cast("bigint")
    one = lambda c: F.pmod(code(c) * code(c) * code(c), F.lit(2**45))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda s, c: s + F.when(c == "", F.lit(0).cast("bigint")).otherwise(one(c)))


def _difference(pair: tuple[str, str]) -> int:
    return sum(map(char_value, pair[0])) - sum(map(char_value, pair[1]))


def _steps(pairs: list[tuple[str, str]], h: Column) -> Column:
    """[(number of the confusion, hash with it undone)] for the confusions that the word may contain."""
    each = [F.when(F.contains("word", F.lit(r)), F.struct(F.lit(k).alias("k"), (h + _difference((t, r))).alias("h"))) for k, (t, r) in enumerate(pairs)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def undone(word: str, pair: tuple[str, str]) -> set[str]:
    """What `word` becomes with one occurrence of what is read replaced by what is printed."""
    printed, read = pair
    return {word[:i] + printed + word[i + len(read) :] for i in range(len(word)) if word.startswith(read, i)}


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        keep = []
        for word, right, one, two in zip(*(b.column(i).to_pylist() for i in range(4))):
            made = undone(word, CONFUSIONS[one])
            keep.append(right in made if two < 0 else any(right in undone(w, CONFUSIONS[two]) for w in made))
        yield b.filter(pa.array(keep, pa.bool_()))


def corrections(words: DataFrame, ratio: int = RATIO, ratio_two: int = RATIO_TWO, least: int = LEAST) -> DataFrame:
    """(word, right) for the words that are taken as misread.

    words: (word, n), n the texts that hold the word. Each word is joined with the frequent ones whose anagram hash differs
    from its own by the value of one or two confusions it may contain; what the hash finds is verified by undoing the
    confusions, and the right word is the most frequent that is left, of several the last in order. Words are compared as they are
    written, so a word with capitals needs a frequent one with the same capitals: names are spelt in many ways that aren't misreadings. A
    word that stands nowhere whole (n = 0) counts as once if it is short or has capitals. A lone digit may be a letter, a lone letter is left
    as it may be an initial ('Venancio c. Silva'), and a longer number is none.
    """
    read = words.where(F.col("word").rlike(r"\p{L}|^\d$")).withColumn("h", anagram_hash(F.col("word")))
    right = read.where((F.col("n") >= least) & F.col("word").rlike(r"^[\p{L}\p{M}'’-]+$")).select(F.col("word").alias("right"), F.col("n").alias("m"), F.col("h"))
    one = read.select("word", "n", F.explode(_steps(CONFUSIONS, F.col("h"))).alias("p")).select("word", "n", F.col("p.k").alias("one"), "p.h")
    two = (
        one.where((F.col("one") < len(COMMON)) & (F.length("word") >= LETTERS_TWO))
        .select("word", "n", "one", F.explode(_steps(COMMON, F.col("h"))).alias("p"))
        .where("p.k >= one")
        .select("word", "n", "one", F.col("p.k").alias("two"), "p.h")
    )
    probe = one.withColumn("two", F.lit(-1)).select("word", "n", "one", "two", "h").unionByName(two)
    short = F.length("right") < LETTERS
    times = F.when(F.col("two") >= 0, ratio_two).when(short, RATIO_SHORT).otherwise(ratio)
    seen = F.when(short | (F.lower("word") != F.col("word")), F.greatest("n", F.lit(1))).otherwise(F.col("n"))
    initial = (F.length("right") == 1) & F.col("word").rlike(r"\p{L}")
    met = probe.join(right, "h").where(~initial & (F.col("m") >= seen * times) & (F.col("word") != F.col("right")))
    checked = arrow_map(met.select("word", "right", "one", "two", "m"), _verify, "word string, right string, one int, two int, m bigint")
    return checked.groupBy("word").agg(F.max_by("right", F.struct(F.col("two") < 0, "m", "right")).alias("right"))


def _tid(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.unhex(F.md5(text))


def _sources(mentions: DataFrame, parish: DataFrame) -> DataFrame:
    return (
        mentions.select(F.lit("entity_mentions").alias("source_table"), F.col("id").alias("record_id"), F.col("source_text").alias("text"))
        .union(parish.select(F.lit("parish_records"), "id", "raw_text"))
        .where(F.col("text").rlike(r"\S") & F.col("record_id").isNotNull())
        .withColumn("tid", _tid(F.col("text")))
    )


class Findings:
    """What stands in the texts: `reads` (one row a text), `words` (word, n), `right` (word, right) and `cuts` (l, r, whole, right)."""

    def __init__(self, texts: DataFrame) -> None:
        """texts: (tid, text), each text once."""
        once = cut_table(arrow_map(texts.select("tid", "text"), _read, _READ))
        known = once.select(F.explode("sure").alias("key")).groupBy("key").count().where("count > 1").select("key")
        weak = once.where("size(weak) > 0").select("tid", F.explode(F.array_distinct("weak")).alias("key"))
        titles = cut_table(weak.join(known, "key").groupBy("tid").agg(F.collect_set("key").alias("titles")))
        titled = arrow_map(once.where("text is not null").select("tid", "text").join(titles, "tid"), _read_titled, _READ)
        cols = ["tid", "edges", "cuts", "words"]
        self.reads = once.join(titles, "tid", "left_anti").select(*cols).unionByName(cut_table(titled.select(*cols)))
        self.words = self.reads.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
        self.words = cut_table(self.words)
        seen = self.words.groupBy(F.lower("word").alias("form")).agg(F.sum("n").alias("n"))
        pairs = self.reads.select(F.explode("cuts").alias("c")).groupBy("c.l", "c.r").agg(F.count("*").alias("times"))
        joined = (
            pairs.withColumn("form", F.lower(F.concat("l", "r")))
            .join(seen, "form", "left")
            .withColumnRenamed("n", "plain")
            .withColumn("form", F.lower(F.concat_ws("-", "l", "r")))
            .join(seen, "form", "left")
        )
        own = F.coalesce("n", F.lit(0)) > F.coalesce("plain", F.lit(0))
        clitic = F.col("n").isNull() & F.col("plain").isNull() & F.lower("r").isin("se", "lhe", "lhes")
        cuts = joined.select("l", "r", "times", F.when(own | clitic, F.concat_ws("-", "l", "r")).otherwise(F.concat("l", "r")).alias("whole"))
        unseen = cuts.groupBy(F.col("whole").alias("word")).agg(F.lit(0).cast("bigint").alias("n"))
        self.right = cut_table(corrections(self.words.unionByName(unseen).groupBy("word").agg(F.max("n").alias("n"))))
        self.cuts = cuts.join(self.right.withColumnRenamed("word", "whole"), "whole", "left").select("l", "r", "whole", "right")

    def items(self) -> DataFrame:
        """(tid, kind, item), distinct."""
        edges = self.reads.select("tid", F.explode("edges").alias("e")).select("tid", "e.kind", "e.item")
        misread = self.reads.select("tid", F.explode("words").alias("word")).join(self.right, "word").select("tid", F.lit("misread").alias("kind"), F.col("right").alias("item"))
        cuts = self.reads.select("tid", F.explode("cuts").alias("c")).select("tid", "c.l", "c.r").join(self.cuts, ["l", "r"])
        whole = cuts.select("tid", F.lit("hyphenation").alias("kind"), F.coalesce("right", "whole").alias("item"))
        wrong = cuts.where("right is not null").select("tid", F.lit("misread").alias("kind"), F.col("right").alias("item"))
        return edges.unionByName(misread).unionByName(whole).unionByName(wrong).distinct()


def _texts(sources: DataFrame) -> DataFrame:
    return sources.select("text").distinct().select(_tid(F.col("text")).alias("tid"), "text")


def scan_findings(mentions: DataFrame, parish: DataFrame) -> DataFrame:
    """(source_table, record_id, kind, item), distinct, of entity_mentions.source_text and parish_records.raw_text.

    kind is 'hyphenation', 'misread', 'running_header' or 'page_number'. A text that several records share is read once. Null, empty
    and blank texts have no findings; a text of one line has no edge lines and no cut words.
    """
    sources = _sources(mentions, parish)
    found = Findings(_texts(sources)).items()
    return sources.select("source_table", "record_id", "tid").distinct().join(found, "tid").select("source_table", "record_id", "kind", "item")


def repaired(text: str, edges: list[str], cuts: dict[tuple[str, str], str], words: dict[str, str]) -> str:
    """`text` without its edge lines, with cut words joined, misread ones replaced and the lines of a paragraph joined."""
    gone = set(edges)
    paragraphs: list[list[str]] = [[]]
    for line in _LINE.split(text):
        s = line.strip()
        if s in gone:
            continue
        if not s:
            if paragraphs[-1] and not (paragraphs[-1][-1][-1] in HYPHENS):
                paragraphs.append([])
            continue
        tokens = s.split()
        at = paragraphs[-1]
        if at and at[-1][-1] in HYPHENS and (whole := cuts.get((_bare(at[-1][:-1]), _bare(tokens[0])))):
            head, tail = at[-1][:-1], tokens[0]
            at[-1] = head[: head.find(_bare(head))] + whole + tail[tail.find(_bare(tail)) + len(_bare(tail)) :]
            tokens = tokens[1:]
        at += tokens

    def fixed(token: str) -> str:
        core = _bare(token)
        return token.replace(core, words[core], 1) if core in words else token

    return "\n\n".join(" ".join(map(fixed, p)) for p in paragraphs if p)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text, edges, cuts, words in zip(*(b.column(i).to_pylist() for i in range(1, 5))):
            joined = {(c["l"], c["r"]): c["whole"] for c in cuts or []}
            out.append(repaired(text, [e["item"] for e in edges], joined, {w["word"]: w["right"] for w in words or []}))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["tid", "text"])


def repaired_texts(mentions: DataFrame, parish: DataFrame) -> DataFrame:
    """(source_table, record_id, text): every text that isn't blank as continuous paragraphs parted by empty lines."""
    sources = _sources(mentions, parish)
    texts = _texts(sources)
    f = Findings(texts)
    cuts = f.reads.select("tid", F.explode("cuts").alias("c")).select("tid", "c.l", "c.r").join(f.cuts, ["l", "r"])
    cuts = cuts.groupBy("tid").agg(F.collect_set(F.struct("l", "r", F.coalesce("right", "whole").alias("whole"))).alias("cuts"))
    words = f.reads.select("tid", F.explode("words").alias("word")).join(f.right, "word").groupBy("tid").agg(F.collect_set(F.struct("word", "right")).alias("words"))
    rows = texts.join(f.reads.select("tid", "edges"), "tid").join(cuts, "tid", "left").join(words, "tid", "left").select("tid", "text", "edges", "cuts", "words")
    done = arrow_map(rows, _repair, "tid binary, text string")
    return sources.select("source_table", "record_id", "tid").join(done, "tid").select("source_table", "record_id", "text")
