"""Cutting long texts at natural boundaries, with overlap."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import arrow_map

#: Kinds of boundary, best first; 'character' is the cut where there is none.
LEVELS = ["paragraph", "line", "sentence", "word"]
LIMIT = 1000
OVERLAP = 200

_SPACE = np.zeros(0x110000, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True


@dataclass
class Tokens:
    """The words of a text by prefix sums: word k stands from starts[k] to ends[k], in characters; levels[k] is the kind of the
    white space between the words k and k + 1 (an index of LEVELS)."""

    starts: np.ndarray
    ends: np.ndarray
    levels: np.ndarray


def tokens(text: str) -> Tokens:
    """The words of `text`, from prefix sums over the lengths of words and of the white space between them.

    White space is a boundary of level 0 if it holds an empty or blank line, 1 with a line end (\\n, \\r\\n or \\r), 2 after . ! or ?, else 3.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    space = _SPACE[codes]
    turns = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1, append=1))
    lengths = np.diff(turns, prepend=0)  # white space and words in turn
    sums = np.cumsum(lengths)
    starts, ends = sums[0::2], sums[1::2]
    feed = codes == 10
    cr = codes == 13
    cr[:-1] &= ~feed[1:]
    breaks = np.concatenate(([0], np.cumsum(feed | cr)))
    lines = breaks[starts[1:]] - breaks[ends[:-1]] if len(starts) else np.zeros(0, dtype=np.int64)
    stops = np.isin(codes[ends[:-1] - 1], (33, 46, 63)) if len(starts) else np.zeros(0, dtype=bool)
    return Tokens(starts, ends, np.where(lines > 1, 0, np.where(lines == 1, 1, np.where(stops, 2, 3))))


def fragments(t: Tokens, limit: int) -> tuple[list[int], int]:
    """(cuts, level): the sorted numbers of the words after which the text may be cut, and the finest kind of boundary among them.

    Boundaries of a kind are taken wherever a fragment between better ones exceeds `limit`; level is len(LEVELS) where a word itself exceeds it, -1
    where no cut is needed.
    """
    last = len(t.starts) - 1
    cuts = np.array([last])
    level = -1
    for k in range(len(LEVELS) + 1):
        first = np.concatenate(([0], cuts[:-1] + 1))
        long = t.ends[cuts] - t.starts[first] > limit
        if not long.any():
            break
        level = k
        if k == len(LEVELS):
            break
        at = np.flatnonzero(t.levels == k)
        cuts = np.union1d(cuts, at[long[np.searchsorted(cuts, at)]])
    return cuts.tolist(), level


def pieces(t: Tokens, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, str]], str | None]:
    """([(start, end, kind of the cut at its end)], finest kind of cut needed or None).

    Each piece holds at most `limit` characters and neither starts nor ends with white space. It ends at the last boundary of the
    sorted array under the limit, found by binary search, and the next one starts at the first word at most `overlap` back from there, or later
    where the fragment that follows wouldn't fit otherwise. A word longer than `limit` is cut hard every `limit` characters, each piece
    starting `overlap` back. The last piece ends with the text ('end').
    """
    if not len(t.starts):
        return [], None
    cuts, level = fragments(t, limit)
    needed = None if level < 0 else [*LEVELS, "character"][level]
    starts, ends, kinds = t.starts.tolist(), t.ends.tolist(), t.levels.tolist()
    stops = [ends[c] for c in cuts]
    out: list[tuple[int, int, str]] = []
    at, stop, done = starts[0], ends[-1], 0
    while stop - at > limit:
        i = bisect_right(stops, at + limit, done) - 1
        if i >= done:
            end, kind = stops[i], LEVELS[kinds[cuts[i]]]
            done = i + 1
            room = stops[done] - limit
        else:
            end, kind = at + limit, "character"
            room = 0
        out.append((at, end, kind))
        back = max(end - overlap, at + 1)
        if kind == "character":
            word = bisect_left(starts, back)
            at = starts[word] if word < len(starts) and starts[word] <= end else back
        else:
            follows = cuts[done - 1] + 1
            at = starts[min(bisect_left(starts, max(back, min(room, starts[follows]))), follows)]
    out.append((at, stop, "end"))
    return out, needed


_PIECE = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("text", pa.string())])
_SCHEMA = "key string, n_chars int, cut string, pieces array<struct<start:int,end:int,kind:string,text:string>>"


def _split(limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chars, cuts, found = [], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                t = tokens(text)
                spans, needed = pieces(t, limit, overlap)
                chars.append(int(t.ends[-1] - t.starts[0]) if spans else 0)
                cuts.append(needed)
                found.append([{"start": s, "end": e, "kind": k, "text": text[s:e]} for s, e, k in spans])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(chars, pa.int32()), pa.array(cuts, pa.string()), pa.array(found, pa.list_(_PIECE))], names=["key", "n_chars", "cut", "pieces"]
            )

    return run


def split_texts(texts: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, n_chars, cut, pieces) of every row of `texts`, without a shuffle.

    n_chars is the length without outer white space; cut is null where that is within `limit`, else the finest kind of boundary that the
    pieces needed (see fragments). Null, empty and blank texts have n_chars 0 and no pieces. A text of any length is cut whole.
    """
    rows = texts.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    return arrow_map(rows, _split(limit, overlap), _SCHEMA)


def page_bodies(page_texts: DataFrame) -> DataFrame:
    """(path, body): of each page the corrected sibling before the text as scanned, and of each the latest delivery (of equal times
    the longest). One aggregation, combined before its shuffle; superseded deliveries go no further. Rows without a path are left out."""
    path = F.regexp_replace("text_path", r"_corrigido\.txt$", ".txt")
    order = F.struct(F.col("text_path").endswith("_corrigido.txt"), F.col("ingested_at"), F.length(F.trim(F.coalesce("body", F.lit("")))))
    return page_texts.where("text_path is not null").groupBy(path.alias("path")).agg(F.max_by("body", order).alias("body"))


def page_splits(pages: DataFrame, page_texts: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(page_id, n_chars, cut, pieces) of every row of pages whose text_path leads to a body.

    The delivery that holds is chosen first (see page_bodies) and cut once. A page with a null path or a path that leads nowhere has no
    row; pages that share a path have one row each.
    """
    cut = split_texts(page_bodies(page_texts), "path", "body", limit, overlap)
    path = F.regexp_replace("text_path", r"_corrigido\.txt$", ".txt")
    rows = pages.select(F.col("id").alias("page_id"), path.alias("key")).where("key is not null")
    return rows.join(cut, "key").select("page_id", "n_chars", "cut", "pieces")
