"""Token ids of a public byte-level BPE tokenizer, merged by segment trees."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import arrow_map, local_file

#: Fixed value: the pre-tokenizer's pattern, which belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
#: Pieces longer than this are merged one by one, shorter ones many at a time.
BATCHED_BYTES = 32
#: Distinct pieces whose ids a worker keeps; beyond it the oldest are forgotten, which only costs time.
CACHED_PIECES = 400_000

_NONE = np.iinfo(np.int64).max
_LOOSE_SPACE = re.compile(r"\s ").search
_part = re.compile(r"(?<=\S)(?= )").split


class Merges:
    """The merge table: sorted keys left * 2**20 + right, and for each the rank and the merged id."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray, byte_ids: np.ndarray) -> None:
        self.keys, self.ranks, self.merged, self.byte_ids = keys, ranks, merged, byte_ids
        self.pairs: dict[int, tuple[int, int]] | None = None

    @classmethod
    def read(cls, path: str) -> Merges:
        """From a tokenizers JSON file with a byte-level BPE model."""
        with open(local_file(path), encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids = model["vocab"]
        rows = []
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            rows.append((ids[a] << 20 | ids[b], rank, ids[a + b]))
        table = np.array(sorted(rows), dtype=np.int64)
        return cls(table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy(), np.array([ids[c] for c in _byte_letters()], dtype=np.int64))

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged id) of each pair; the rank of a pair that doesn't merge is _NONE >> 20."""
        key = (left << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], _NONE >> 20), self.merged[at]

    def one(self, left: int, right: int) -> tuple[int, int] | None:
        if self.pairs is None:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.merged.tolist())))
        return self.pairs.get(left << 20 | right)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: itself if printable, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge_long(piece: bytes, merges: Merges) -> list[int]:
    """Ids of one piece of any length: a segment tree over the ranks of its adjacent pairs.

    A leaf holds (rank, position); the root is the leftmost pair of the lowest rank. A merge changes
    the leaves of at most three pairs, each in a logarithmic number of steps.
    """
    ids = merges.byte_ids[np.frombuffer(piece, dtype=np.uint8)].tolist()
    n = len(ids)
    width = 1
    while width < n:
        width *= 2
    none = (_NONE, 0)
    tree = [none] * (2 * width)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def leaf(i: int) -> tuple[int, int]:
        j = after[i]
        pair = merges.one(ids[i], ids[j]) if j < n else None
        return (pair[0], i) if pair else none

    for i in range(n):
        tree[width + i] = leaf(i)
    for k in range(width - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def update(i: int, value: tuple[int, int]) -> None:
        k = width + i
        tree[k] = value
        while k > 1:
            k //= 2
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                break
            tree[k] = low

    alive = [True] * n
    while tree[1][0] != _NONE:
        i = tree[1][1]
        j = after[i]
        ids[i] = merges.one(ids[i], ids[j])[1]
        alive[j] = False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        update(j, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    return [x for x, ok in zip(ids, alive) if ok]


def merge_many(pieces: list[bytes], merges: Merges) -> list[list[int]]:
    """Ids of each piece, for pieces of similar length: their segment trees are the rows of one array."""
    count = len(pieces)
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=count)
    width = 1
    while width < lengths.max():
        width *= 2
    cols = np.arange(width)
    filled = cols < lengths[:, None]
    ids = np.full((count, width + 1), -1, dtype=np.int64)
    ids[:, :width][filled] = merges.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
    after = np.tile(np.arange(1, width + 2), (count, 1))
    before = np.tile(np.arange(-1, width), (count, 1))
    rank, _ = merges.look(ids[:, :width], ids[:, 1:])
    tree = np.full((count, 2 * width), _NONE, dtype=np.int64)
    tree[:, width:] = np.where(rank == _NONE >> 20, _NONE, rank << 20 | cols)
    k = width
    while k > 1:
        k //= 2
        tree[:, k : 2 * k] = np.minimum(tree[:, 2 * k : 4 * k : 2], tree[:, 2 * k + 1 : 4 * k : 2])

    def update(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        k = at + width
        tree[rows, k] = value
        for _ in range(width.bit_length() - 1):
            k = k >> 1
            tree[rows, k] = np.minimum(tree[rows, 2 * k], tree[rows, 2 * k + 1])

    def leaves(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        rank, _ = merges.look(ids[rows, at], ids[rows, after[rows, at]])
        return np.where(rank == _NONE >> 20, _NONE, rank << 20 | at)

    rows = np.flatnonzero(tree[:, 1] != _NONE)
    while len(rows):
        i = tree[rows, 1] & 0xFFFFF
        j = after[rows, i]
        ids[rows, i] = merges.look(ids[rows, i], ids[rows, j])[1]
        ids[rows, j] = -1
        nxt = after[rows, j]
        after[rows, i] = nxt
        before[rows, np.minimum(nxt, width)] = i
        update(rows, j, np.full(len(rows), _NONE))
        update(rows, i, leaves(rows, i))
        prev = before[rows, i]
        has = prev >= 0
        if has.any():
            update(rows[has], prev[has], leaves(rows[has], prev[has]))
        rows = rows[tree[rows, 1] != _NONE]
    kept = ids[:, :width] >= 0
    sizes = kept.sum(axis=1)
    flat = ids[:, :width][kept].tolist()
    out, at = [], 0
    for n in sizes.tolist():
        out.append(flat[at : at + n])
        at += n
    return out


class Encoder:
    """Splits texts into pieces and keeps the ids of what it has met.

    A space after other than white space always begins a piece, so a text is first parted there, and
    the ids of such a part, which don't depend on its neighbours, are kept as bytes: a text is then one
    lookup a part. The pieces of a new part are found by the pattern and merged by segment trees.
    """

    def __init__(self, merges: Merges, pattern: str = PATTERN, cached: int = CACHED_PIECES) -> None:
        import regex

        self.merges, self.find, self.cached = merges, regex.compile(pattern).findall, cached
        self.known: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}  # without the space they begin with

    def _learn(self, pieces: set[str]) -> None:
        new = [(p, p.encode("utf-8", "surrogatepass")) for p in pieces]
        low = 0
        for most in (4, 8, 16, BATCHED_BYTES):
            some = [x for x in new if low < len(x[1]) <= most]
            low = most
            if some:
                ids = merge_many([b for _, b in some], self.merges)
                self.known.update((p, np.array(i, dtype=np.int32).tobytes()) for (p, _), i in zip(some, ids))
        for p, b in new:
            if len(b) > BATCHED_BYTES:
                self.known[p] = np.array(merge_long(b, self.merges), dtype=np.int32).tobytes()

    def _bytes(self, strings: list[str]) -> list[bytes]:
        """The ids of each string, found without regard to what is kept of parts."""
        pieces = [self.find(s) for s in strings]
        new = set(chain.from_iterable(pieces)).difference(self.known)
        if new:
            self._learn(new)
        known = self.known.__getitem__
        return [b"".join(map(known, p)) for p in pieces]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of text k are ids[offsets[k]:offsets[k + 1]]; of null and empty texts none."""
        if len(self.known) + len(self.parts) > self.cached:
            self.known.clear()
            self.parts.clear()
        parted, heads = [], []
        for t in texts:
            t = t or ""
            if _LOOSE_SPACE(t):
                head, *rest = _part(t)
                parts = [r[1:] for r in rest]
            else:
                head, *parts = t.split(" ")
            heads.append(head)
            parted.append(parts)
        new = list(set(chain.from_iterable(parted)).difference(self.parts))
        if new:
            self.parts.update(zip(new, self._bytes([" " + p for p in new])))
        known = self.parts.__getitem__
        found = [h + b"".join(map(known, p)) for h, p in zip(self._bytes(heads), parted)]
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        return np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), np.frombuffer(b"".join(found), dtype=np.int32)


_HERE: dict[object, Encoder] = {}


def _encode(shipped, pattern: str, cached: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _HERE.get(shipped.id)  # a worker serves many tasks
        if encoder is None:
            _HERE.clear()
            encoder = _HERE[shipped.id] = Encoder(Merges(*shipped.value), pattern, cached)
        for b in batches:
            for start in range(0, max(1, b.num_rows), 1000):
                some = b.slice(start, 1000)
                offsets, ids = encoder.encode(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "ids"])

    return run


def encode_texts(texts: DataFrame, ident: str, text: str, vocabulary: str = f"{TOKENIZERS}/byte_bpe_50k.json", pattern: str = PATTERN, cached: int = CACHED_PIECES) -> DataFrame:
    """(ident, ids array<int>) of every row, without special tokens, the text taken as it is.

    Null and empty texts give an empty list; strings that spell a special token are ordinary text; repeated
    rows are encoded each. There is no shuffle. The merge table, whose size the vocabulary
    file fixes (about 1 MB), is broadcast.
    """
    m = Merges.read(vocabulary)
    shipped = texts.sparkSession.sparkContext.broadcast((m.keys, m.ranks, m.merged, m.byte_ids))
    name = f"{shipped._jbroadcast.id()}-{vocabulary}"
    kind = dict(texts.dtypes)[ident]
    rows = texts.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, _encode(_Shipped(shipped, name), pattern, cached), f"id {kind}, ids array<int>").withColumnRenamed("id", ident)


class _Shipped:
    """A broadcast and a name for it that survives pickling."""

    def __init__(self, broadcast, ident: str) -> None:
        self.broadcast, self.id = broadcast, ident

    @property
    def value(self):
        return self.broadcast.value
