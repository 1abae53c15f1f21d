"""The ratio of whole texts that difflib gives, for many pairs at once."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import numpy as np

#: Letters of the pairs that are compared at once, places where two letters in a row agree that are kept at once, and those from which one pair is left to difflib.
LETTERS, SEEDS, TOO_MANY = 400_000, 2_000_000, 6_000_000
#: Letters compared at a time where a match is extended.
STEP = 32

Pair = tuple[str, str]


def ratios(pairs: Sequence[Pair]) -> list[float]:
    """SequenceMatcher(None, a, b).ratio() of each pair."""
    out: list[float] = []
    for some in _packed(pairs):
        out += [2.0 * m / n if (n := len(a) + len(b)) else 1.0 for (a, b), m in zip(some, _matches(some))]
    return out


def _packed(pairs: Sequence[Pair]) -> Iterator[list[Pair]]:
    some, letters = [], 0
    for p in pairs:
        some.append(p)
        letters += len(p[0]) + len(p[1])
        if letters > LETTERS:
            yield some
            some, letters = [], 0
    if some:
        yield some


def _joined(texts: list[str], gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(letters, number of the text of each letter, start of each text); a gap of `gap`, which no letter equals, stands around the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes + STEP) - sizes
    letters = np.full(int((sizes + STEP).sum()) + STEP, gap, np.int64)
    which = np.repeat(np.arange(len(texts)), sizes)
    letters[np.arange(len(which)) + STEP * (which + 1)] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.full(len(letters), -1, np.int64)
    of[np.arange(len(which)) + STEP * (which + 1)] = which
    return letters, of, starts


def _matches(pairs: list[Pair]) -> np.ndarray:
    """The letters in the matching blocks of each pair.

    difflib looks for the longest run of rare letters that two ranges share (of equals the first), extends it by any letters and goes on to its left and right.
    Here all ranges of all pairs go down one level at a time. The runs of two letters or more are found once; a run is cut to the range it falls in, and none
    falls in two. Ranges that share single letters only are read from left to right in _single().
    """
    a, of_a, start_a = _joined([p[0] for p in pairs], -1)
    b, of_b, start_b = _joined([p[1] for p in pairs], -2)
    size_a, size_b = (np.array([len(p[k]) for p in pairs], np.int64) for k in (0, 1))
    letters, at, count = np.unique((of_b << 21 | b)[of_b >= 0], return_inverse=True, return_counts=True)
    rare = (size_b < 200)[letters >> 21] | (count <= (size_b // 100 + 1)[letters >> 21])
    seed_b = np.zeros(len(b), bool)
    seed_b[of_b >= 0] = rare[at]
    key = of_a << 21 | a
    place = np.minimum(np.searchsorted(letters, key), max(len(letters) - 1, 0))
    seed_a = (of_a >= 0) & (letters[place] == key) & rare[place] if len(letters) else np.zeros(len(a), bool)
    two_a, two_b = (np.flatnonzero(s[:-1] & s[1:]) for s in (seed_a, seed_b))
    key_a, key_b = ((of[at] << 42) | (x[at] << 21) | x[at + 1] for of, x, at in ((of_a, a, two_a), (of_b, b, two_b)))
    order = np.argsort(key_b, kind="stable")
    first = np.searchsorted(key_b[order], key_a, "left")
    times = np.searchsorted(key_b[order], key_a, "right") - first
    if times.sum() > SEEDS and len(pairs) > 1:
        half = len(pairs) // 2
        return np.concatenate([_matches(pairs[:half]), _matches(pairs[half:])])
    if times.sum() > TOO_MANY:
        return np.array([sum(m.size for m in difflib.SequenceMatcher(None, *p).get_matching_blocks()) for p in pairs], np.int64)

    # runs: places on one diagonal that follow each other
    i = np.repeat(two_a, times)
    j = two_b[order][np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
    diagonal = np.sort((i - j + len(b)) << 32 | i)
    head = np.flatnonzero(np.diff(diagonal, prepend=-9) != 1)
    run_n = np.diff(head, append=len(diagonal)) + 1
    run_i = diagonal[head] & 0xFFFFFFFF
    run_j = run_i - (diagonal[head] >> 32) + len(b)
    run_range = of_a[run_i]

    total, single = np.zeros(len(pairs), np.int64), []
    pair, a0, a1, b0, b1 = np.arange(len(pairs)), start_a, start_a + size_a, start_b, start_b + size_b
    while len(pair):
        best = np.zeros(len(pair), np.int64)
        np.maximum.at(best, run_range, run_n)
        single.append(np.column_stack([pair, a0, a1, b0, b1])[best == 0])
        far = np.iinfo(np.int64).max
        longest = np.flatnonzero(run_n == best[run_range])
        bi, bj = np.full(len(pair), far), np.full(len(pair), far)
        np.minimum.at(bi, run_range[longest], run_i[longest])
        longest = longest[run_i[longest] == bi[run_range[longest]]]
        np.minimum.at(bj, run_range[longest], run_j[longest])

        found = np.flatnonzero(best)
        fi, fj, fn = bi[found], bj[found], best[found]
        before = _alike(a, b, fi - 1, fj - 1, np.minimum(fi - a0[found], fj - b0[found]), -1)
        fi, fj, fn = fi - before, fj - before, fn + before
        fn = fn + _alike(a, b, fi + fn, fj + fn, np.minimum(a1[found] - fi - fn, b1[found] - fj - fn), 1)
        np.add.at(total, pair[found], fn)

        # the ranges to the left, then those to the right; each run goes to the one it falls in
        new = [np.concatenate(x) for x in zip((pair[found], a0[found], fi, b0[found], fj), (pair[found], fi + fn, a1[found], fj + fn, b1[found]))]
        some = (new[1] < new[2]) & (new[3] < new[4])
        number = np.where(some, np.cumsum(some) - 1, -1)
        slot = np.full(len(pair), -1, np.int64)
        slot[found] = np.arange(len(found))
        s = slot[run_range]
        left = (run_i < fi[s]) & (run_j < fj[s])
        run_range = number[np.where(left, s, s + len(found))]
        pair, a0, a1, b0, b1 = (x[some] for x in new)
        there = run_range >= 0
        run_i, run_j, run_n, run_range = run_i[there], run_j[there], run_n[there], run_range[there]
        skip = np.maximum(np.maximum(a0[run_range] - run_i, b0[run_range] - run_j), 0)
        run_n = np.minimum(np.minimum(a1[run_range] - run_i, b1[run_range] - run_j), run_n) - skip
        run_i, run_j = run_i + skip, run_j + skip
        long = run_n > 1
        run_i, run_j, run_n, run_range = run_i[long], run_j[long], run_n[long], run_range[long]

    rest = np.concatenate(single) if single else np.zeros((0, 5), np.int64)
    rest[:, 1:3] -= start_a[rest[:, 0], None]
    rest[:, 3:5] -= start_b[rest[:, 0], None]
    common: dict[int, set[str]] = {}
    for c in letters[~rare].tolist():
        common.setdefault(c >> 21, set()).add(chr(c & 0x1FFFFF))
    for p, *where in rest.tolist():
        total[p] += _single(*pairs[p], common.get(p, set()), *where)
    return total


def _alike(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many letters agree from a[i] and b[j] on, in direction `way`, at most `most`."""
    out = np.zeros(len(i), np.int64)
    at, steps = np.flatnonzero(most > 0), np.arange(STEP) * way
    while len(at):
        other = a[i[at, None] + way * out[at, None] + steps] != b[j[at, None] + way * out[at, None] + steps]
        n = np.where(other.any(axis=1), other.argmax(axis=1), STEP)
        out[at] += n
        at = at[(n == STEP) & (out[at] < most[at])]
    return np.minimum(out, np.maximum(most, 0))


def _single(a: str, b: str, common: set[str], a0: int, a1: int, b0: int, b1: int) -> int:
    """The letters in the matching blocks of a[a0:a1] and b[b0:b1], which share no two rare letters in a row: the longest run is the first rare letter they share."""
    total, absent = 0, set()
    while a0 < a1 and b0 < b1:
        i, j = a0, -1
        while i < a1:
            c = a[i]
            if c not in common and c not in absent:
                if (j := b.find(c, b0, b1)) >= 0:
                    break
                absent.add(c)
            i += 1
        if j < 0:
            return total + _ahead(a, b, a0, a1, b0, b1)
        end_i, end_j = i + 1, j + 1
        while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        n = _ahead(a, b, end_i, a1, end_j, b1)
        total += end_i - i + n + _ahead(a, b, a0, i, b0, j)
        a0, b0 = end_i + n, end_j + n
    return total


def _ahead(a: str, b: str, a0: int, a1: int, b0: int, b1: int) -> int:
    """How many letters agree at the start of a[a0:a1] and b[b0:b1]."""
    n, most = 0, min(a1 - a0, b1 - b0)
    while n < most and a[a0 + n] == b[b0 + n]:
        n += 1
    return n
