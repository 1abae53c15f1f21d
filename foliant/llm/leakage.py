"""Evaluation passages that stand, whole or in part, in a corpus."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import arrow_map

from foliant.llm.lookalike import LIGATURES, skeleton_map

#: Items that share one automaton; more are scanned in further passes over the text.
BLOCK_ITEMS = 20_000
#: Items that the operator takes at once; at some 500 bytes each they stay below 100 MB.
MOST_ITEMS = 200_000
#: Words of a seed, every run of so many words of an item; a seed is their letters and digits without spaces.
SEED_WORDS = 3
#: A text is read closely for an item if so many seeds as this share of the item's words stand in it, and so many within a band: passages of half
#: the item of which one word in eight is damaged or dropped have more. No seed is left out for being common.
CALL, CALL_BAND = 0.2, 0.15
#: Half the width of a band: seeds are in one if their distance from their place in the item differs by less, in letters.
BAND = 48
#: Hits that are looked at together.
HITS = 50_000
#: Share of an item's words that a document must hold.
SHARE = 0.5
#: Words of a passage, at least; words of the item that may be missing between two that are read in one passage.
PASSAGE_WORDS, PASSAGE_GAP = 8, 6

_GONE, _KEPT = skeleton_map()
_TABLE = {ord(c): (_KEPT[i] if i < len(_KEPT) else None) for i, c in enumerate(_GONE)}
_WORD = re.compile(r"\S+")
_BEYOND = re.compile(r"[^\x00-\xff]")


def _mapped(text: str) -> str:
    for c, to in LIGATURES.items():
        if to.isalpha():
            text = text.replace(c, to)
    return text.translate(_TABLE).lower()


_LATIN = [_mapped(chr(i)) for i in range(256)]
_LATIN_TABLE = bytes(x.encode("latin-1")[0] if x else i for i, x in enumerate(_LATIN))
_LATIN_GONE = bytes(i for i, x in enumerate(_LATIN) if not x)


@lru_cache(maxsize=100_000)
def _one(c: str) -> str:
    return _mapped(c)


def letters(text: str) -> str:
    """Letters and digits only, look-alikes mapped, without accents, in lower case."""
    try:
        plain = text.encode("latin-1")
    except UnicodeEncodeError:
        try:
            plain = _BEYOND.sub(lambda m: _one(m[0]), text).encode("latin-1")
        except UnicodeEncodeError:
            return _mapped(text)
    return plain.translate(_LATIN_TABLE, _LATIN_GONE).decode("latin-1")


def letters_with_offsets(text: str) -> tuple[str, list[int]]:
    """letters(text) and, for each of its characters, the offset in `text` it comes from."""
    out, at = [], []
    for i, c in enumerate(text):
        for x in letters(c):
            out.append(x)
            at.append(i)
    return "".join(out), at


def item_words(text: str) -> list[str]:
    """The words of an item in the form of letters(); what has no letters or digits is no word."""
    return [w for w in map(letters, _WORD.findall(text)) if w]


class Index:
    """One Aho-Corasick automaton over the seeds of some items, and for each seed all places where it stands in them."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        import ahocorasick

        self.words = {i: w for i, t in items if (w := item_words(t or ""))}
        self.offsets: dict[int, list[int]] = {}
        self.items = list(self.words)
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, i in enumerate(self.items):
            w, at, offsets = self.words[i], 0, []
            for x in w:
                offsets.append(at)
                at += len(x)
            self.offsets[i] = offsets
            for k in range(max(1, len(w) - SEED_WORDS + 1)):
                seed = "".join(w[k : k + SEED_WORDS])
                where[seed].append((n, offsets[k] + len(seed) - 1))
        self.scan = ahocorasick.Automaton() if where else None
        for n, seed in enumerate(where):
            self.scan.add_word(seed, n)
        if self.scan is not None:
            self.scan.make_automaton()
        self.count = np.array([len(v) for v in where.values()], dtype=np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.place = np.array([x for v in where.values() for x in v], dtype=np.int64).reshape(-1, 2)
        size = np.array([len(w) for w in self.words.values()], dtype=np.int64)
        self.need, self.band_need = np.maximum(1, (CALL * size).astype(np.int64)), np.maximum(1, (CALL_BAND * size).astype(np.int64))
        self.longest = max((o[-1] for o in self.offsets.values()), default=0) + 2 * BAND + 64

    def _banded(self, docs: np.ndarray, ends: np.ndarray, seeds: np.ndarray, part: bool) -> set[tuple[int, int]]:
        """(text, number of the item) of those with enough seeds, and enough of them within a band; of a part of a text, the latter only."""
        n = self.count[seeds]
        row = np.repeat(np.arange(len(seeds)), n)
        at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[seeds], n)
        item, shift = self.place[at, 0], self.place[at, 1]
        band = (ends[row] - shift + self.longest) // BAND
        wide = int(band.max()) + 2
        keys, times = np.unique((docs[row] * len(self.items) + item) * wide + band, return_counts=True)
        next_too = np.append(np.where(np.diff(keys) == 1, times[1:], 0), 0)
        owner = keys // wide
        start = np.flatnonzero(np.diff(owner, prepend=-1))
        total, best = np.add.reduceat(times, start), np.maximum.reduceat(times + next_too, start)
        hit = owner[start]
        which = hit % len(self.items)
        hit = hit[((total >= self.need[which]) | part) & (best >= self.band_need[which])]
        return set(zip((hit // len(self.items)).tolist(), (hit % len(self.items)).tolist()))

    def called(self, texts: list[str]) -> list[tuple[int, int]]:
        """(number of the text, item): the items of which enough seeds stand close together in a text (in letters() form), in order."""
        if self.scan is None:
            return []
        found: set[tuple[int, int]] = set()
        hits: list[tuple[int, int]] = []
        counts: list[tuple[int, int]] = []

        def look(part: bool = False) -> None:
            nonlocal hits, counts
            if hits:
                flat = np.fromiter(chain.from_iterable(hits), dtype=np.int64, count=2 * len(hits)).reshape(-1, 2)
                docs = np.repeat(np.array([d for d, _ in counts]), np.array([c for _, c in counts]))
                found.update(self._banded(docs, flat[:, 0], flat[:, 1], part))
            hits, counts = [], []

        for n, text in enumerate(texts):
            here: list[tuple[int, int]] = []
            parted = False
            for hit in self.scan.iter(text):
                here.append(hit)
                if len(here) >= HITS:  # a very long text, looked at in parts that overlap by the longest item
                    look()
                    hits, counts, parted = here, [(n, len(here))], True
                    look(True)
                    here = [h for h in here if h[0] > hit[0] - self.longest]
            if parted:
                look()
            hits.extend(here)
            counts.append((n, len(here)))
            if parted or len(hits) >= HITS:
                look(parted)
        look()
        return sorted((n, self.items[k]) for n, k in found)

    def passages(self, item: int, text: str) -> tuple[int, int, list[tuple[int, int, int, int]]]:
        """(words held, words of the item, passages): up to two passages as (first word, word after the last, start, end in `text`).

        Anchors are pairs of neighbouring words of the item that stand side by side in `text`; a passage
        is a run of anchors in order whose distance from their place in the item drifts little. It holds the
        words of its anchors and single words between them, which may be dropped, replaced or damaged.
        """
        w, offsets = self.words[item], self.offsets[item]
        if len(w) == 1:
            at = text.find(w[0])
            return (1, 1, [(0, 1, at, at + len(w[0]))]) if at >= 0 else (0, 1, [])
        anchors = []
        for k in range(len(w) - 1):
            pair = w[k] + w[k + 1]
            if len(pair) < 5 and len(w) > 2:
                continue
            at = text.find(pair)
            while at >= 0:
                anchors.append((at - offsets[k], at, k))
                at = text.find(pair, at + 1)
        anchors.sort()
        runs: list[list[tuple[int, int, int]]] = []
        for a in anchors:
            if runs and a[0] - runs[-1][-1][0] <= 12:
                runs[-1].append(a)
            else:
                runs.append([a])
        spans = []
        for run in runs:
            run.sort(key=lambda a: a[1])
            part: list[tuple[int, int, int]] = []
            for a in [*run, None]:
                if part and (a is None or not part[-1][2] <= a[2] <= part[-1][2] + 2 + PASSAGE_GAP):
                    read = {k for _, _, k in part} | {k + 1 for _, _, k in part}
                    held = read | {k + 1 for k in read if k + 2 in read}
                    if len(held) >= min(PASSAGE_WORDS, len(w)):
                        last = part[-1][2]
                        spans.append((held, part[0][2], last + 2, part[0][1], part[-1][1] + len(w[last]) + len(w[last + 1])))
                    part = []
                if a is not None:
                    part.append(a)
        spans.sort(key=lambda s: -len(s[0]))
        most, best = 0, []
        for n, a in enumerate(spans):
            if len(a[0]) > most:
                most, best = len(a[0]), [a]
            for b in spans[n + 1 :]:
                if len(a[0]) + len(b[0]) <= most:
                    break
                x, y = (a, b) if a[3] <= b[3] else (b, a)
                if y[3] >= x[4] and len(a[0] | b[0]) > most:
                    most, best = len(a[0] | b[0]), [x, y]
        return most, len(w), [s[1:] for s in best]


_HERE: dict[object, list[Index]] = {}
_FOUND = "doc_id {kind}, item_id {item}, held int, words int, passages array<struct<start:int,end:int>>"


def _scan(shipped, name: str, share: float, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HERE:
            _HERE.clear()
            items = shipped.value
            _HERE[name] = [Index(items[n : n + block]) for n in range(0, len(items), block)]
        for b in batches:
            docs, items, held, words, where = [], [], [], [], []
            texts = b.column(1).to_pylist()
            forms = list(map(letters, texts))
            calls = ((n, i, index) for index in _HERE[name] for n, i in index.called(forms))
            offsets: dict[int, list[int]] = {}
            for n, i, index in calls:
                most, of, spans = index.passages(i, forms[n])
                if most >= share * of:
                    if n not in offsets:
                        offsets = {n: letters_with_offsets(texts[n])[1]}
                    at = offsets[n]
                    docs.append(n)
                    items.append(i)
                    held.append(most)
                    words.append(of)
                    where.append([{"start": at[s], "end": at[e - 1] + 1} for _, _, s, e in spans])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(docs, pa.int32())),
                    pa.array(items, pa.int64()),
                    pa.array(held, pa.int32()),
                    pa.array(words, pa.int32()),
                    pa.array(where, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                ],
                names=["doc_id", "item_id", "held", "words", "passages"],
            )

    return run


def leaks(texts: DataFrame, items: DataFrame, ident: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, held, words, passages) for each text that holds at least `share` of an item's words.

    The words count in their order, as one or two passages; case, accents, spacing, punctuation and look-alike characters
    don't matter. passages are character offsets in the text as it is. Null, empty and blank texts and items
    match nothing; a repeated row is reported once for each time it stands there, two items of one text both.

    Items are a held-out set of evaluation passages, which doesn't grow with the corpus; they are gathered on
    the driver, at most MOST_ITEMS of them (an error says so beyond), and shipped to the workers; each text is
    scanned once for each `block` of items, without a shuffle. A text is aligned with an item where enough seeds of three words stand, and close
    together (see CALL_WORDS); no seed is left out for being common. An item of less than three words is its own seed.
    """
    some = [(r[0], r[1]) for r in items.select(F.col(item_id).cast("long"), F.col(item_text)).distinct().limit(MOST_ITEMS + 1).collect()]
    if len(some) > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: scan for parts of them in turn")
    shipped = texts.sparkSession.sparkContext.broadcast(sorted(some, key=lambda x: (x[0] is None, x[0])))
    name = f"{shipped._jbroadcast.id()}-{len(some)}"
    rows = texts.select(F.col(ident).alias("doc_id"), F.col(text).cast("string").alias("text")).where("text <> ''")
    return arrow_map(rows, _scan(shipped, name, share, block), _FOUND.format(kind=dict(rows.dtypes)["doc_id"], item="bigint"))
