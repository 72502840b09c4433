"""Repeated passages by collinear chaining of shared seeds.

Equal texts are one node; all that follows is between different texts.  Seeds are the
minimizers of ``SEED``-word runs: of any ``WINDOW`` runs in a row the one of least
hash.  Two texts that share ``SEED + WINDOW - 1`` words in a row share a seed.  A seed
of ``FEW`` places at most links all of them.  One of more places links each to its
hub, the least of the places whose neighbouring seeds are the most common: an edited
passage meets the form that most texts have, so links grow with the seeds, not with
the pairs.  Stretches of ``LEAST`` words whose seeds have many places are linked by
the hash of all their words as well, so a text meets one that holds the whole stretch,
however common its parts are.  What a text holds beyond the passages found by way of
hubs is then compared with all: any passage holds a core, two runs of equal words with one
gap between them that make a passage by themselves, and the longer run has ``HALF`` words
at least.  Each such run outside a text's passages meets every other place of it, one for
all places of equal surroundings, word by word, and is linked to those whose cores about
it reach farthest.  The links of a pair are anchors; anchors on one
diagonal are joined, and a Fenwick tree finds the best chains of ordered anchors under
a gap cost.  Chains are then aligned word by word, and aligned stretches of ``LEAST``
words whose five-word shingles are similar to ``ALIKE`` are repeated passages of both.
"""

from __future__ import annotations

import atexit
import math
import uuid
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import by_bytes, keep, new_path, tidy

SEED, WINDOW, FEW = 5, 12, 4
#: Words of a passage and similarity of its two texts, at least.
LEAST, ALIKE = 50, 0.8
#: Cost of a word skipped on either side, words between anchors joined on a diagonal,
#: words of a chain worth aligning, words fetched about a chain.  A passage of LEAST
#: words with one word changed has 34 words in a row, so two seeds 7 places apart, or 16
#: in a row on both sides, so a seed on each: 12 words at least.
GAP, JOIN, WORTH, ABOUT = 0.2, 24, 12, 64
#: Seeds on either side, and words they lie within, that tell the forms of a passage apart.
BESIDE, WITHIN = 3, 30
#: Words in a row that the texts of any passage have in common: an edit of LEAST words
#: leaves half of them.  Of the RUN-word runs in them the one of least hash is looked up.
HALF, RUN = 25, 16
#: Words of a core's gap at most (the alignment cuts at wider ones), partners linked of those
#: that reach farthest (one may owe it to equal short hashes), places of a run met at once,
#: pairs of places compared at once.
SKIP, BEST, CHUNK, BLOCK = 8, 2, 256, 1 << 15
#: What is looked up of crowded texts.
SEEDS, STRETCHES, HALVES = range(3)
#: Bytes of text in a bucket, about.
BUCKET = 64 << 20
#: Bytes of text that a task hashes at once, about.
SLICE = 1 << 20
#: Equal words beyond an edit that outweigh it: a word changed costs ``align`` as many.
EDGE = 5


#: Base of the words' polynomial hashes and its inverse, modulo 2 ** 64.
_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def words(text: str) -> list[str]:
    return text.lower().split()


def _powers(size: int) -> list[np.ndarray]:
    """The powers of the base and of its inverse, ``size`` at least."""
    if not _POWERS or len(_POWERS[0]) < size:
        size = max(size, 1 << 20)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, x, np.uint64)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS


def numbers(texts: list[list]) -> tuple[np.ndarray, np.ndarray]:
    """A number for each word (strings or UTF-8) of all texts, and where each text starts and the last one ends."""
    ends = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    full = [t for t in texts if t]
    if full and isinstance(full[0][0], bytes):
        joined = b"".join(b" ".join(t) + b" " for t in full)
    else:
        joined = "".join(" ".join(t) + " " for t in full).encode("utf-8", "surrogatepass")
    octets = np.frombuffer(joined, np.uint8)
    if not len(octets):
        return np.zeros(0, np.uint64), ends
    power, inverse = _powers(len(octets) + 1)
    last = np.flatnonzero(octets == 32)
    first = np.concatenate([[0], last[:-1] + 1])
    total = np.concatenate([[np.uint64(0)], np.cumsum((octets.astype(np.uint64) + np.uint64(1)) * power[: len(octets)])])
    n = (total[last] - total[first]) * inverse[first]
    n ^= n >> np.uint64(32)
    return n * np.uint64(0xD6E8FEB86659FD93), ends


def _hashes(n: np.ndarray) -> np.ndarray:
    """A hash of each run of SEED words."""
    h = np.zeros(max(len(n) - SEED + 1, 0), np.uint64)
    for k in range(SEED if len(h) else 0):
        h = (h + n[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(31)
    return h


def seeds(n: np.ndarray, ends: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the minimizers of texts' word numbers, the first of equal ones."""
    ends = np.array([0, len(n)]) if ends is None else ends
    h = _hashes(n)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least, at = h, np.arange(len(h))

    def either(shift: int) -> None:
        nonlocal least, at
        left, right = least[:-shift], least[shift:]
        at = np.where(left <= right, at[:-shift], at[shift:])
        least = np.minimum(left, right)

    size = np.diff(ends) - SEED + 1
    taken = np.zeros(len(h), bool)
    if len(h) >= WINDOW:
        width = 1
        while 2 * width <= WINDOW:
            either(width)
            width *= 2
        if width < WINDOW:
            either(WINDOW - width)
        # windows within a text
        inside = np.zeros(len(at) + 1, np.int32)
        long = size >= WINDOW
        np.add.at(inside, ends[:-1][long], 1)
        np.add.at(inside, ends[:-1][long] + size[long] - WINDOW + 1, -1)
        taken[at[np.cumsum(inside[:-1]) > 0]] = True
    for k in np.flatnonzero((size > 0) & (size < WINDOW)).tolist():
        taken[ends[k] + h[ends[k] : ends[k] + size[k]].argmin()] = True
    at = np.flatnonzero(taken)
    return h[at].view(np.int64), at


def crowded(at: np.ndarray, many: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of LEAST words can lie that only seeds of many places link: word ranges.

    ``at`` are the places of seeds that other texts hold.  Two minimizers in a row are
    WINDOW runs apart at most, and a run of LEAST words holds a row of them that spans
    ``LEAST - SEED - 2 * WINDOW + 2`` places.
    """
    if not many.any():
        return []
    cuts = np.flatnonzero(np.diff(at) > WINDOW) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
    some = np.add.reduceat(many.astype(np.int64), first) > 0
    wide = at[last] - at[first] >= LEAST - SEED - 2 * WINDOW + 2
    room = LEAST - SEED
    return [(max(int(at[x]) - room, 0), int(at[y]) + SEED + room) for x, y in zip(first[some & wide], last[some & wide])]


def stretches(n: np.ndarray, at: np.ndarray, many: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, positions) of the runs of LEAST words that seeds of few places do not link.

    ``at`` are the places of the seeds, ``many`` and ``few`` of those that other
    documents hold.  Whether a place well inside a run is a seed depends on the run
    alone, so a run with a seed there that no other document holds is in no other
    document.
    """
    size = len(n) - LEAST + 1
    if size <= 0 or not len(many):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = np.where(np.isin(at, many), 2, np.where(np.isin(at, few), 1, 0))
    w = np.arange(size)
    low, high = np.searchsorted(at, w + WINDOW - 1), np.searchsorted(at, w + LEAST - SEED - WINDOW + 1, side="right")
    lone = np.concatenate([[0], np.cumsum(kind == 0)])
    scarce = at[kind == 1]
    first, last = np.searchsorted(scarce, w + WINDOW - 1), np.searchsorted(scarce, w + LEAST - SEED - WINDOW + 1, side="right") - 1
    linked = np.zeros(size, bool)
    some = last > first
    linked[some] = scarce[last[some]] - scarce[first[some]] + SEED >= WORTH
    w = w[(lone[high] == lone[low]) & ~linked]
    h = _long_hashes(n, w, LEAST).view(np.int64)
    # of words said over and over, runs that overlap by half and hold all of them
    order = np.lexsort((w, h))
    near = (np.diff(h[order]) == 0) & (np.diff(w[order]) < HALF)
    first = np.flatnonzero(np.insert(~near, 0, True))[: len(w)]
    half = (w[order] - np.repeat(w[order][first], np.diff(np.append(first, len(w))))) // HALF
    same = near & (np.diff(half) == 0)
    stays = np.sort(order[~(np.append(same, False) & np.insert(same, 0, False))]) if len(w) else order
    return h[stays], w[stays]


def _long_hashes(n: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """A hash of the ``most`` words from each of the places ``at``."""
    # hashes of 1, 2, 4 ... words; those of ``most`` are put together from them
    h, size, out = n, 1, np.zeros(len(at), np.uint64)
    while size <= most:
        if most & size:
            out = (out + h[at]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
            at = at + size
        if 2 * size <= most:
            h = (h[:-size] * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (h[size:] + (h[:-size] >> np.uint64(29)))
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        size *= 2
    return out


def halves(n: np.ndarray, ends: np.ndarray, many: np.ndarray, few: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hashes, positions, firsts, sizes): where texts' runs of HALF words that seeds of few places do not link are looked up.

    Each such run is looked up by the least of its RUN-word runs; a position stands for
    the runs from ``first`` on, ``size`` of them.
    ``many`` and ``few`` are the places of seeds that other documents hold.  The seed of
    each window in a run depends on the run alone, so a run with one that no other
    document holds is in no other document.
    """
    none = np.zeros(0, np.int64)
    if len(n) < HALF:
        return (none,) * 4
    h = _hashes(n)
    kind = np.zeros(len(h), np.int8)
    kind[few], kind[many] = 1, 2
    view = np.lib.stride_tricks.sliding_window_view
    low = view(h, WINDOW).argmin(axis=1) + np.arange(len(h) - WINDOW + 1)
    lone = np.concatenate([[0], np.cumsum(kind[low] == 0)])
    windows = HALF - SEED - WINDOW + 2
    w = np.flatnonzero(lone[windows:] == lone[:-windows])
    w = w[w + HALF <= ends[np.searchsorted(ends, w, side="right")]]  # within a text
    scarce = np.flatnonzero(kind == 1)
    scarce = scarce[np.isin(scarce, low)]
    first, last = np.searchsorted(scarce, low[w]), np.searchsorted(scarce, low[w + windows - 1], side="right") - 1
    linked = np.zeros(len(w), bool)
    some = last > first
    linked[some] = scarce[last[some]] - scarce[first[some]] + SEED >= WORTH
    w = w[~linked]
    if not len(w):
        return (none,) * 4
    short = _long_hashes(n, np.arange(len(n) - RUN + 1), RUN)
    p = view(short, HALF - RUN + 1)[w].argmin(axis=1) + w
    new = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
    out, p, first, size = short[p[new]].view(np.int64), p[new], w[new], w[np.append(new[1:], len(w)) - 1] - w[new] + 1
    # of words said over and over, the first and the last: what lies beside them tells texts apart
    order = np.lexsort((p, out))
    near = (np.diff(out[order]) == 0) & (np.diff(p[order]) < RUN)
    stays = np.sort(order[~(np.append(near, False) & np.insert(near, 0, False))])
    return out[stays], p[stays], first[stays], size[stays]


def around(n: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the RUN words from each place and of ABOUT words of its text on either side."""
    power, inverse = _powers(len(n) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum((n | np.uint64(1)) * power[: len(n)])])
    which = np.searchsorted(ends, at, side="right")
    low, high = np.maximum(at - ABOUT, ends[which - 1]), np.minimum(at + RUN + ABOUT, ends[which])
    x = (total[high] - total[low]) * inverse[low]
    x ^= x >> np.uint64(32)
    x = (x + (at - low).astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) + (high - at).astype(np.uint64)
    return (x ^ (x >> np.uint64(29))).view(np.int64)


def contexts(n: np.ndarray, starts: np.ndarray, stops: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Short hashes of the RUN words from each place and of ABOUT words on either side, 0 beyond its text."""
    where = at[:, None] + np.arange(-ABOUT, RUN + ABOUT)
    inside = (where >= starts[:, None]) & (where < stops[:, None])
    short = np.maximum((n >> np.uint64(48)).astype(np.uint16), 1)
    return np.where(inside, short[np.where(inside, where, 0)], 0).astype(np.uint16)


def _ones(bits: np.ndarray) -> np.ndarray:
    """How many of the lowest bits are set in a row."""
    off = ~bits
    return np.bitwise_count((off & (np.uint64(0) - off)) - np.uint64(1)).astype(np.int64)


def _beyond(a: np.ndarray, b: np.ndarray, x: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
    """(reach, skipped here, skipped there, words, unsure): the core that reaches farthest on one side.

    ``a`` and ``b`` are words outward from a run of which ``x`` of them are part, ``size``
    words long.  Runs of ``m`` words together about a gap of ``u`` and ``v`` words are
    similar to ALIKE if ``m >= 40 + 4 * (u + v)``, and the alignment keeps the second if
    it outweighs the gap.  Without a core the reach is -1; it is unsure where the words
    that are known end within the second run.
    """
    top, us, vs, words_, unsure = (np.full(len(x), k, np.int64) for k in (-1, 0, 0, 0, 0))
    top[size >= LEAST] = x[size >= LEAST]
    for shift in range(-SKIP, SKIP + 1):
        same = np.zeros(a.shape, bool)
        here, there = (slice(None, ABOUT - shift), slice(shift, None)) if shift >= 0 else (slice(-shift, None), slice(None, ABOUT + shift))
        same[:, here] = (a[:, here] == b[:, there]) & (a[:, here] != 0)
        bits = np.packbits(same, axis=1, bitorder="little").view("<u8")[:, 0]
        for u in range(max(0, -shift), SKIP + 1 - max(0, shift)):
            v, at = u + shift, x + u
            if not (u or v):
                continue
            r = np.where(at < ABOUT, _ones(np.where(at < ABOUT, bits >> np.minimum(at, ABOUT - 1).astype(np.uint64), np.uint64(0))), 0)
            wide = EDGE * max(u, v)
            fits = (r >= wide) & (size > wide)
            core = fits & (size + r >= max(40 + 4 * (u + v), LEAST - min(u, v)))
            end = (at + r >= ABOUT) | (x + v + r >= ABOUT)
            unsure |= (r > 0) & end & ~core & (size > wide)
            new = core & (at + r > top)
            top[new], us[new], vs[new], words_[new] = (at + r)[new], u, v, r[new]
    return top, us, vs, words_, unsure > 0


def cores(mine: np.ndarray, theirs: np.ndarray, i: np.ndarray, j: np.ndarray, open_: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pair, here, there, words): anchors, from the places on, of the pairs to link.

    Of the pairs (i, j) of contexts each open run of an ``i`` (bits of ``open_``) has the
    BEST whose cores reach farthest on either side.
    """
    a, b = mine[i], theirs[j]
    same = (a == b) & (a != 0)
    stop = np.ones((len(i), 1), bool)
    x = np.argmax(np.hstack([~same[:, ABOUT + RUN :], stop]), axis=1)
    y = np.argmax(np.hstack([~same[:, ABOUT - 1 :: -1], stop]), axis=1)
    low, high = np.maximum(HALF - RUN - y, 0), np.minimum(x, HALF - RUN)
    hit = np.where(high >= low, open_[i] & ((2 << high) - (1 << low)), 0)
    some = np.flatnonzero(hit)
    i, x, y, hit, a, b = i[some], x[some], y[some], hit[some], a[some], b[some]
    size = x + RUN + y
    right = _beyond(a[:, ABOUT + RUN :], b[:, ABOUT + RUN :], x, size)
    left = _beyond(a[:, ABOUT - 1 :: -1], b[:, ABOUT - 1 :: -1], y, size)
    taken = right[4] & (right[0] < 0) | left[4] & (left[0] < 0)
    for reach in (right[0], left[0]):
        for k in range(HALF - RUN + 1):
            who = np.flatnonzero((reach >= 0) & (hit >> k & 1 > 0))
            who = who[np.lexsort((-reach[who], i[who]))]
            for _ in range(BEST if len(who) else 0):
                first = np.concatenate([[True], np.diff(i[who]) != 0])[: len(who)]
                taken[who[first]] = True
                who = who[~first]
    t = np.flatnonzero(taken)
    p, q, n = [-y[t]], [-y[t]], [size[t]]
    for (_, u, v, r, _), sign in ((right, 1), (left, -1)):
        u, v, r = u[t], v[t], r[t]
        p.append(RUN + x[t] + u if sign > 0 else -y[t] - u - r)
        q.append(RUN + x[t] + v if sign > 0 else -y[t] - v - r)
        n.append(r)
    pair, p, q, n = np.tile(some[t], 3), np.concatenate(p), np.concatenate(q), np.concatenate(n)
    return pair[n > 0], p[n > 0], q[n > 0], n[n > 0]


def surroundings(at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A hash of the seeds beside each of a text's shared seeds, with their distances."""
    out = np.zeros(len(at), np.uint64)
    for step in (*range(-BESIDE, 0), *range(1, BESIDE + 1)):
        part = np.zeros(len(at), np.uint64)
        here, there = (slice(None, -step), slice(step, None)) if step > 0 else (slice(-step, None), slice(None, step))
        if abs(step) < len(at):
            apart = at[there] - at[here]
            part[here] = np.where(np.abs(apart) <= WITHIN, h[there].view(np.uint64) + apart.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0))
        out = (out + part) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def chains(anchors) -> list[list[tuple[int, int, int]]]:
    """Best chains of anchors (place here, place there, words), as lists of the same."""
    # anchors near each other on a diagonal are one piece
    a = np.asarray(anchors, np.int64).reshape(-1, 3)
    a = a[np.lexsort((a[:, 0], a[:, 0] - a[:, 1]))]
    new = np.ones(len(a), bool)
    new[1:] = (np.diff(a[:, 0] - a[:, 1]) != 0) | (np.diff(a[:, 0]) > JOIN)
    first = np.flatnonzero(new)
    ends = np.maximum.reduceat(a[:, 0] + a[:, 2], first)
    pieces = [(int(p), int(r), int(q) - int(p)) for (p, r, _), q in zip(a[first], ends)]
    if len(pieces) == 1:
        return [pieces]
    pieces.sort()
    # a piece is asked for at its start and offered at its end
    ends = sorted({r + n for _, r, n in pieces})
    rank = {r: k + 1 for k, r in enumerate(ends)}
    best: list[tuple[float, int]] = [(0.0, -1)] * (len(ends) + 1)
    events = sorted([(p, 1, k) for k, (p, _, _) in enumerate(pieces)] + [(p + n, 0, k) for k, (p, _, n) in enumerate(pieces)])
    score, back = [0.0] * len(pieces), [-1] * len(pieces)
    starts = np.searchsorted(ends, [r for _, r, _ in pieces], side="right")
    for _, ask, k in events:
        p, r, n = pieces[k]
        if ask:
            # a seed stands for a window of words: seeds on both sides of an edit are one chain
            score[k], at = float(n + WINDOW - 1), int(starts[k])
            top, who = max_prefix(best, at)
            if who >= 0 and (gain := top - GAP * (p + r)) > 0:
                score[k] += gain
                back[k] = who
        else:
            raise_prefix(best, rank[r + n], (score[k] + GAP * (p + n + r + n), k))
    used, out = [False] * len(pieces), []
    for k in sorted(range(len(pieces)), key=lambda k: (-score[k], k)):
        chain = []
        while k >= 0 and not used[k]:
            used[k] = True
            chain.append(pieces[k])
            k = back[k]
        if chain:
            out.append(chain[::-1])
    return out


def max_prefix(tree: list[tuple[float, int]], at: int) -> tuple[float, int]:
    """Greatest entry among the first ``at`` of a Fenwick tree of maxima."""
    top = (-1.0, -1)
    while at > 0:
        if tree[at][1] >= 0 and tree[at][0] > top[0]:
            top = tree[at]
        at -= at & -at
    return top


def raise_prefix(tree: list[tuple[float, int]], at: int, entry: tuple[float, int]) -> None:
    while at < len(tree):
        if tree[at][1] < 0 or entry[0] > tree[at][0]:
            tree[at] = entry
        at += at & -at


def _grow(a: list[str], b: list[str], p: int, r: int, step: int, low: tuple[int, int], high: tuple[int, int]) -> list[tuple[int, int, int]]:
    """Runs of equal words from (p, r) on, between ``low`` and ``high``; a few words may be skipped if ``EDGE`` equal ones follow."""
    runs = []
    while True:
        n = 0
        while low[0] <= p + n * step < high[0] and low[1] <= r + n * step < high[1] and a[p + n * step] == b[r + n * step]:
            n += 1
        if n:
            runs.append((p, r, n) if step > 0 else (p - n + 1, r - n + 1, n))
        p, r = p + n * step, r + n * step
        for x, y in ((1, 1), (0, 1), (1, 0), (2, 2), (0, 2), (2, 0), (3, 3), (1, 2), (2, 1)):
            i, j = p + x * step, r + y * step
            if not (low[0] <= i < high[0] and low[1] <= j < high[1]):
                continue
            u, v = (a[i : i + EDGE], b[j : j + EDGE]) if step > 0 else (a[max(i - EDGE + 1, 0) : i + 1], b[max(j - EDGE + 1, 0) : j + 1])
            if len(u) == EDGE and u == v:
                p, r = i, j
                break
        else:
            return runs


def _runs(a: list[str], b: list[str], chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Runs of equal words (here, there, words) along a chain and beyond its ends."""
    runs: list[tuple[int, int, int]] = []

    def same(p: int, r: int, n: int) -> None:
        if n > 0 and a[p : p + n] == b[r : r + n]:
            if runs and runs[-1][0] + runs[-1][2] == p and runs[-1][1] + runs[-1][2] == r:
                runs[-1] = (runs[-1][0], runs[-1][1], runs[-1][2] + n)
            else:
                runs.append((p, r, n))
        elif n > 1:
            same(p, r, n // 2)
            same(p + n // 2, r + n // 2, n - n // 2)

    at = None
    for p, r, n in chain:
        n = min(n, len(a) - p, len(b) - r)
        if n <= 0 or p < 0 or r < 0:
            continue
        if at and p >= at[0] and r >= at[1]:
            x, y = a[at[0] : p], b[at[1] : r]
            if len(x) == len(y) and (len(x) <= JOIN or 2 * sum(map(str.__eq__, x, y)) > len(x)):
                same(at[0], at[1], len(x))
            elif len(x) + len(y) <= 400:
                runs += [(at[0] + m.a, at[1] + m.b, m.size) for m in SequenceMatcher(None, x, y, False).get_matching_blocks() if m.size]
            else:  # a long gap is followed from both sides
                left = _grow(a, b, *at, 1, at, (p, r))
                low = (left[-1][0] + left[-1][2], left[-1][1] + left[-1][2]) if left else at
                runs += left + _grow(a, b, p - 1, r - 1, -1, low, (p, r))[::-1]
        same(p, r, n)
        at = (p + n, r + n)
    if not runs:
        return runs
    runs.sort()
    (p, r, _), (q, s, n) = runs[0], runs[-1]
    whole = (0, 0), (len(a), len(b))
    runs += _grow(a, b, p - 1, r - 1, -1, *whole) + _grow(a, b, q + n, s + n, 1, *whole)
    runs.sort()
    out = runs[:1]
    for p, r, n in runs[1:]:  # those that follow each other are one
        q, s, m = out[-1]
        if (q + m, s + m) == (p, r):
            out[-1] = (q, s, m + n)
        else:
            out.append((p, r, n))
    return out


def _alike(a: list[str], b: list[str], runs: list[tuple[int, int, int]]) -> float:
    """Similarity of the five-word shingles, repeats counted, of the stretches that runs of equal words span.

    Shingles within the runs are in both; of the others those that are equal.
    """
    both, rest = 0, []
    for text, side in ((a, 0), (b, 1)):
        at, left = runs[0][side], []
        for run in runs:
            if run[2] >= 5:
                both += run[2] - 4 if side else 0
                left += range(at, run[side])
                at = run[side] + run[2] - 4
        left += range(at, runs[-1][side] + runs[-1][2] - 4)
        rest.append(left)
    total = [runs[-1][side] + runs[-1][2] - runs[0][side] - 4 for side in (0, 1)]
    if rest[0] and rest[1]:
        x, y = (Counter([tuple(t[k : k + 5]) for k in left]) for t, left in zip((a, b), rest))
        both += sum((x & y).values())
    return both / (sum(total) - both)


def _widest(part: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """First and last run, of EDGE words each, of the stretches of LEAST words and similar to ALIKE that are in no wider one.

    Similar by the shingles within runs.
    """
    p, r, n = np.array(part).T
    upto, out, top = np.concatenate([[0], np.cumsum(np.maximum(n - 4, 0))]), [], -1
    for at in range(0, len(part), 256):
        i = slice(at, at + 256)
        here, there = (p + n)[None, :] - p[i, None], (r + n)[None, :] - r[i, None]
        both = upto[None, 1:] - upto[:-1][i, None]
        fits = (np.minimum(here, there) >= LEAST) & (both >= ALIKE * (here + there - 8 - both)) & (n >= EDGE) & (n[i, None] >= EDGE)
        last = np.where(fits.any(axis=1), len(part) - 1 - fits[:, ::-1].argmax(axis=1), -1)
        for k, x in enumerate(last.tolist()):
            if x > top:
                out.append((at + k, x))
                top = x
    return out


def align(a: list[str], b: list[str], chain: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end here, start, end there, similarity) along a chain."""
    # stretches are cut where edits outweigh what is equal; the similarity decides later
    cost, drop = 5.0, 40.0
    parts: list[list[tuple[int, int, int]]] = []
    part: list[tuple[int, int, int]] = []
    score = top = 0.0
    best = 0
    for run in _runs(a, b, chain):
        if part:
            p, r, n = part[-1]
            if run[0] < p + n or run[1] < r + n:
                continue
            score -= cost * max(run[0] - p - n, run[1] - r - n)
            if score <= 0 or score < top - drop:
                parts.append(part[:best])
                part, score, top, best = [], 0.0, 0.0, 0
        part.append(run)
        score += run[2]
        if score >= top:
            top, best = score, len(part)
    parts.append(part[:best])
    out = []
    whole = len(parts)
    while parts:
        part = parts.pop()
        uncut, whole = len(parts) < whole, min(whole, len(parts))
        if not part:
            continue
        s, t = part[0][0], part[0][1]
        e, f = part[-1][0] + part[-1][2], part[-1][1] + part[-1][2]
        if min(e - s, f - t) < LEAST:
            continue
        alike = _alike(a, b, part)
        if alike >= ALIKE:
            out.append((s, e, t, f, alike))
        elif len(part) > 1:
            # all that are similar enough, whatever the cuts below leave of them
            for x, y in _widest(part) if uncut else ():
                some = part[x : y + 1]
                p, r, n = some[-1]
                out.append((some[0][0], p + n, some[0][1], r + n, _alike(a, b, some)))
            # cut at the widest gap, of equal ones at that nearest an end
            cuts = [(max(y[0] - x[0] - x[2], y[1] - x[1] - x[2]), -min(y[0] - s, e - y[0]), k + 1) for k, (x, y) in enumerate(zip(part, part[1:]))]
            k = max(cuts)[2]
            parts += [part[:k], part[k:]]
    return sorted(set(out))


def merge(spans: list[dict]) -> list[dict]:
    """Overlapping spans of a document as one, with the partner of its longest span."""
    out: list[dict] = []
    for x in sorted(spans, key=lambda x: (x["s"], -x["e"], -x["alike"])):
        if out and x["s"] < out[-1]["e"]:
            y = out[-1]
            if x["e"] - x["s"] > y["long"]:
                y |= {k: x[k] for k in ("other", "t", "alike")} | {"long": x["e"] - x["s"]}
            y["e"] = max(y["e"], x["e"])
        else:
            out.append(dict(x) | {"long": x["e"] - x["s"]})
    return out


def _by_id(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d, t, key): one row per id, bucketed by it, so that later joins on the id move no texts."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")).where("d is not null and t is not null")
    size = given.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / BUCKET))
    # texts of one id follow each other, kept apart by a word of their own
    whole = given.groupBy("d").agg(F.array_sort(F.collect_set("t")).alias("t")).select("d", F.concat_ws(" \0 ", "t").alias("t"))
    name, path = f"passage_texts_{uuid.uuid4().hex}", new_path(spark, "passage-texts")
    whole = whole.select("d", "t", F.md5("t").alias("key"))
    whole.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "d").sortBy("d").saveAsTable(name)
    atexit.register(_forget, spark, name)
    return spark.table(name)


def _forget(spark, name: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session is gone, and the name with it
        pass


def _slice(first: Column, last: Column) -> tuple[Column, Column]:
    """Bounds of a slice that holds the words from ``first`` to ``last`` and ``ABOUT`` beside them.

    Slices start at quarters of their size, which is a power of two: a text has a few
    for each size, whoever asks for them, and none is over 2.5 times what is asked.
    """
    low, high = F.greatest(first - ABOUT, F.lit(0)), last + ABOUT
    size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(high - low, F.lit(2 * ABOUT))))).cast("int")
    start = low - low % (size / 4).cast("int")
    return start.cast("int"), (start + size + (size / 4).cast("int")).cast("int")


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start_word, n_words, other_id, other_start, similarity): the repeated stretches of each document.

    Every document that holds a passage of ``LEAST`` words or more of another
    document has a row for it; a stretch found by way of several partners is one
    row, with the partner that shares most of it.  Words are split at blanks and
    lower-cased.  A whole copy of a document is one long passage: documents of equal
    texts have one row each, for the whole text, with the least other id.

    Null, empty and short texts have no row, nor do rows without an id.  Very long
    texts are read whole.  Repeated rows of one id are one document, which is no
    partner of itself; different texts of one id are read one after the other, by code
    point.  An empty table gives an empty result; other columns are ignored.  A passage
    begins and ends with EDGE words or more that both texts have, and the run of its core
    of HALF words or more is always reported; of words beyond an edit that only a further
    partner has in common some may be left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    given = _by_id(docs, id_col, text_col)
    # equal texts are one node, the least id's
    keys = given.select("key", "d").groupBy("key").agg(F.min("d").alias("rep"), F.max("d").alias("most")).where("rep != most")
    keys = keep(keys, "passage-copies")
    copies = keep(given.select("key", "d").join(keys, "key").select("d", "rep"), "passage-copied")
    nodes = given.join(copies.where("d != rep").select("d"), "d", "left_anti").select("d", "t")

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 1, SLICE):
                n, ends = numbers(list(map(words, some.column(1).to_pylist())))
                h, at = seeds(n, ends)
                which = np.searchsorted(ends, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h), some.column(0).take(pa.array(which)), pa.array((at - ends[which]).astype(np.int32))], names=["h", "d", "p"])

    placed = keep(nodes.mapInArrow(tidy(seed), f"h bigint, d {kind}, p int"), "passage-seeds")
    # partial minima and maxima: a seed of a third of all documents is no load
    ends = F.min(F.struct("d", "p")).alias("low"), F.max(F.struct("d", "p")).alias("high")
    shared = placed.groupBy("h").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("k")).where("low != high").select("h", "k")
    met = keep(placed.join(keep(shared, "passage-shared"), "h"), "passage-met")
    pair = lambda x, y: (x["d"].alias("a"), y["d"].alias("b"), x["p"].alias("p"), y["p"].alias("r"))
    # a seed of few places links all of them
    few = met.where(F.col("k") <= FEW).groupBy("h").agg(F.array_sort(F.collect_list(F.struct("d", "p"))).alias("all"))
    few = few.select("all", F.explode("all").alias("x")).select("x", F.explode(F.filter("all", lambda y: y["d"] > F.col("x.d"))).alias("y"))
    few = few.select(*pair(F.col("x"), F.col("y")), F.lit(SEED).alias("n"))
    # gathered per document: at most its own seeds
    held = met.groupBy("d").agg(F.collect_list(F.struct("p", "h", (F.col("k") > FEW).alias("many"))).alias("x")).where(F.exists("x", lambda y: y["many"]))

    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 1, SLICE):
                cols: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
                size, places = [], []
                flat, ends = some.column(2).flatten(), some.column(2).offsets.to_numpy()
                at, hash_, much = (flat.field(f).to_numpy(zero_copy_only=False) for f in range(3))
                split = [words(t) for t in some.column(1).to_pylist()]
                n, starts = numbers(split)

                def add(kind: int, h: np.ndarray, c: np.ndarray, p: np.ndarray) -> int:
                    for col, x in zip(cols, (np.full(len(p), kind), h, c, p)):
                        col.append(x)
                    return len(p)

                for k, (x, y) in enumerate(zip((ends - ends[0]).tolist(), (ends[1:] - ends[0]).tolist())):
                    order = np.argsort(at[x:y]) + x
                    p, h, many = at[order].astype(np.int64), hash_[order], much[order]
                    size.append(add(SEEDS, h[many], surroundings(p, h)[many], p[many]))
                    places.append(p + starts[k])
                    much[x:y] = many
                    if ranges := crowded(p, many):
                        found, seen = split[k], set()
                        parts, bounds = numbers([found[low:high] for low, high in ranges])
                        for (low, _), u, v in zip(ranges, bounds[:-1].tolist(), bounds[1:].tolist()):
                            run, q = stretches(parts[u:v], seeds(parts[u:v])[1], p[many] - low, p[~many] - low)
                            new = np.array([z not in seen for z in (q + low).tolist()], bool)  # ranges may overlap
                            run, q = run[new], q[new] + low
                            seen.update(q.tolist())
                            size[-1] += add(STRETCHES, run, np.zeros(len(q), np.int64), q)
                p = np.concatenate([np.zeros(0, np.int64), *places])
                h, p, first, runs = halves(n, starts, p[much], p[~much])
                which = np.searchsorted(starts, p, side="right") - 1
                add(HALVES, h, around(n, starts, p), p - starts[which])
                whose = np.concatenate([np.repeat(np.arange(len(size)), size), which])
                kind, h, c, p = (np.concatenate(x) for x in cols)
                lead = np.concatenate([np.zeros(sum(size), np.int64), first - starts[which]])
                runs = np.concatenate([np.zeros(sum(size), np.int64), runs])
                arrays = [pa.array(kind.astype(np.int8)), pa.array(h), pa.array(c), some.column(0).take(pa.array(whose)), pa.array(p.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(runs.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(arrays, names=["kind", "h", "c", "d", "p", "s", "runs"])

    crowd = given.join(held, "d").select("d", "t", "x").mapInArrow(tidy(beside), f"kind tinyint, h bigint, c bigint, d {kind}, p int, s int, runs int")
    crowd = keep(crowd, "passage-crowd")
    # the hub of a seed: the least place of its most common surroundings
    forms = crowd.where(f"kind = {SEEDS}").groupBy("h", "c").agg(F.count("*").alias("n"), F.min(F.struct("d", "p")).alias("low"))
    hubs = keep(forms.groupBy("h").agg(F.min(F.struct(-F.col("n"), "low")).alias("x")).select("h", F.col("x.low").alias("hub")), "passage-hubs")
    ordered = lambda y: F.when(F.col("d") < y["d"], F.struct(F.struct("d", "p").alias("x"), y.alias("y"))).otherwise(F.struct(y.alias("x"), F.struct("d", "p").alias("y")))
    many = crowd.where(f"kind = {SEEDS}").join(hubs, "h").where("d != hub.d").select(ordered(F.col("hub")).alias("z"))
    many = many.select(*pair(F.col("z.x"), F.col("z.y")), F.lit(SEED).alias("n"))

    def told(runs: DataFrame, n: int) -> DataFrame:
        """Links of runs (d, p, y) of n words: of those in a row to one partner on one diagonal the first and the last."""
        runs = runs.groupBy("d", F.col("y.d").alias("o"), (F.col("y.p") - F.col("p")).alias("off")).agg(F.min("p").alias("p"), F.max("p").alias("q"))
        runs = runs.select("d", "o", "off", F.explode(F.array_distinct(F.array("p", "q"))).alias("p")).select("d", "p", F.struct(F.col("o").alias("d"), (F.col("p") + F.col("off")).alias("p")).alias("y"))
        return runs.select(ordered(F.col("y")).alias("z")).select(*pair(F.col("z.x"), F.col("z.y")), F.lit(n).alias("n"))

    common = keep(crowd.where(f"kind = {STRETCHES}").groupBy("h").agg(*ends).where("low.d != high.d"), "passage-runs")
    runs = crowd.where(f"kind = {STRETCHES}").join(common, "h").select("d", "p", F.when(F.col("low.d") != F.col("d"), F.col("low")).otherwise(F.col("high")).alias("y"))
    links = few.unionByName(many).unionByName(told(runs, LEAST))
    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            flat, ends = b.column(2).flatten(), b.column(2).offsets.to_numpy()
            places = np.stack([flat.field(f).to_numpy() for f in range(3)], axis=1) if len(flat) else np.zeros((0, 3), np.int32)
            for k, (x, y) in enumerate(zip((ends - ends[0]).tolist(), (ends[1:] - ends[0]).tolist())):
                mine = places[x:y]
                if (mine[:, 0] + mine[:, 2]).max() - mine[:, 0].min() < WORTH:
                    continue
                for c in chains(mine):
                    if c[-1][0] + c[-1][2] - c[0][0] >= WORTH:
                        rows.append((k, *([x[f] for x in c] for f in range(3))))
            cols = list(zip(*rows)) if rows else [[]] * 4
            ints = pa.list_(pa.int32())
            at = pa.array(list(cols[0]), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *[pa.array(list(c), ints) for c in cols[1:]]], names=["a", "b", "p", "r", "n"])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                w, asked = words(b.column(1)[k].as_py()), b.column(2)[k].as_py()
                ids = b.column(0).take(pa.array([k] * len(asked), pa.int64()))
                s, e = ([x[c] for x in asked] for c in ("s", "e"))
                yield pa.RecordBatch.from_arrays([ids, pa.array(s, pa.int32()), pa.array(e, pa.int32()), pa.array([" ".join(w[x:y]) for x, y in zip(s, e)], pa.string())], names=["d", "s", "e", "text"])

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            # texts are read some at a time
            for some in (b.slice(at, 200).to_pylist() for at in range(0, b.num_rows, 200)):
                split = {t: t.split(" ") for t in {x[c] for x in some for c in ("here", "there")}}
                for x in some:
                    s, t = x["s"], x["t"]
                    c = [(p - s, r - t, n) for p, r, n in zip(x["p"], x["r"], x["n"])]
                    for p, q, u, v, alike in align(split[x["here"]], split[x["there"]], c):
                        rows += [(x["a"], p + s, q + s, x["b"], u + t, alike), (x["b"], u + t, v + t, x["a"], p + s, alike)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            i = b.schema.field(0).type
            types = (i, pa.int32(), pa.int32(), i, pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(cols, types)], names=["d", "s", "e", "other", "t", "alike"])

    def passed(links: DataFrame) -> DataFrame:
        """(d, s, e, other, t, alike): the passages along the links, in both their documents."""
        # gathered per pair: at most FEW + 3 times the places of one text, and its runs
        anchors = links.groupBy("a", "b").agg(F.collect_list(F.struct("p", "r", "n")).alias("x"), F.count("*").alias("k"), F.max("n").alias("n")).where(f"k > 1 or n >= {RUN}").select("a", "b", "x")

        found = anchors.mapInArrow(tidy(chain), f"a {kind}, b {kind}, p array<int>, r array<int>, n array<int>")
        end = lambda c: F.element_at(c, -1) + F.element_at("n", -1)
        own, lent = _slice(F.element_at("p", 1), end("p")), _slice(F.element_at("r", 1), end("r"))
        found = keep(found.withColumns({"s": own[0], "e": own[1], "t": lent[0], "f": lent[1]}), "passage-chains")
        want = found.select(F.col("a").alias("d"), F.struct("s", "e").alias("w")).union(found.select("b", F.struct("t", "f"))).distinct()
        # gathered per document: a few slices for each power of two
        texts = given.join(want.groupBy("d").agg(F.collect_list("w").alias("w")), "d").select("d", "t", "w")

        slices = keep(texts.mapInArrow(tidy(fetch), f"d {kind}, s int, e int, text string"), "passage-slices")
        here = slices.select(F.col("d").alias("a"), "s", "e", F.col("text").alias("here"))
        there = slices.select(F.col("d").alias("b"), F.col("s").alias("t"), F.col("e").alias("f"), F.col("text").alias("there"))
        pairs = found.join(here, ["a", "s", "e"]).join(there, ["b", "t", "f"]).select("a", "b", "p", "r", "n", "s", "t", "here", "there")

        return pairs.mapInArrow(tidy(aligned), f"d {kind}, s int, e int, other {kind}, t int, alike double")

    first = keep(passed(links), "passage-spans")
    # the rest: a run of HALF words in no passage yet meets all others, one of each surroundings
    mine = crowd.where(f"kind = {HALVES}").groupBy("d").agg(F.collect_list(F.struct("h", "c", "p", "s", "runs")).alias("x"))
    had = first.groupBy("d", "s").agg(F.max("e").alias("e")).groupBy("d").agg(F.collect_list(F.struct("s", "e")).alias("y"))

    def outside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, size = b.column(1).flatten(), np.diff(b.column(1).offsets.to_numpy())
            h, c, p, s, runs = flat.flatten()
            n, s = runs.to_numpy().astype(np.int64), s.to_numpy()
            starts = np.cumsum(n) - n
            w = np.arange(n.sum()) + np.repeat(s - starts, n)  # where each run is
            upto = np.concatenate([starts, [len(w)]])[np.concatenate([[0], np.cumsum(size)])]
            open_ = np.ones(len(w), bool)
            for x, y, spans in zip(upto[:-1].tolist(), upto[1:].tolist(), b.column(2).to_pylist()):
                if spans:
                    known = sorted((z["s"], z["e"]) for z in spans)
                    far = np.maximum.accumulate(np.array([0, *(e for _, e in known)]))
                    open_[x:y] = far[np.searchsorted([s for s, _ in known], w[x:y], side="right")] < w[x:y] + HALF
            bits = open_.astype(np.int64) << (w - np.repeat(p.to_numpy(), n) + HALF - RUN)
            left = np.bitwise_or.reduceat(bits, starts) if len(n) else bits
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)))
            yield pa.RecordBatch.from_arrays([h, c, ids, p, pa.array(left.astype(np.int32))], names=["h", "c", "d", "p", "open"])

    halved = mine.join(had, "d", "left").select("d", "x", "y").mapInArrow(tidy(outside), f"h bigint, c bigint, d {kind}, p int, open int")
    halved = keep(halved, "passage-halves")
    # places of equal surroundings are one; partial minima and maxima
    each = halved.groupBy("h", "c").agg(*ends, F.bit_or("open").alias("open"))
    each = keep(each.select("h", "c", "low", "high", "open"), "passage-each")
    met_by = each.groupBy("h").agg(F.count("*").alias("n"), F.bit_or("open").alias("some"), F.max(F.col("low.d") != F.col("high.d")).alias("two"))
    met_by = keep(met_by.where("some != 0 and (n > 1 or two)").select("h", F.ceil(F.col("n") / CHUNK).cast("int").alias("m")), "passage-met-by")
    # gathered per document: at most its own places
    want = each.join(met_by, "h").select(F.col("low.d").alias("d"), F.struct("h", "c", F.col("low.p").alias("p"), F.xxhash64("low.d").alias("lo"), F.xxhash64("high.d").alias("hi"), "open", "m").alias("x"))
    want = want.groupBy("d").agg(F.collect_list("x").alias("x"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in by_bytes(b, 0, SLICE):
                size = np.diff(some.column(1).offsets.to_numpy())
                h, c, p, lo, hi, left, m = some.column(1).flatten().flatten()
                n, starts = numbers(list(map(words, some.column(0).to_pylist())))
                which = np.repeat(np.arange(len(size)), size)
                for at in range(0, len(which), BLOCK):
                    k = slice(at, at + BLOCK)
                    found = contexts(n, starts[which[k]], starts[which[k] + 1], starts[which[k]] + p.to_numpy()[k])
                    near = pa.Array.from_buffers(pa.binary(found.shape[1] * 2), len(found), [None, pa.py_buffer(found.tobytes())]).cast(pa.binary())
                    yield pa.RecordBatch.from_arrays([*(v[k] for v in (h, c, lo, hi, left, m)), near], names=["h", "c", "lo", "hi", "open", "m", "near"])

    shingles = given.join(want, "d").select("t", "x").mapInArrow(tidy(near), "h bigint, c bigint, lo bigint, hi bigint, open int, m int, near binary")
    # the places of a run in chunks, and each chunk with all of the run
    chunks = shingles.groupBy("h", "m", F.expr("pmod(xxhash64(c), m)").alias("i")).agg(F.collect_list(F.struct("c", "lo", "hi", "open", "near")).alias("x"))
    chunks = keep(chunks, "passage-near")
    asks = chunks.where("m > 1 and exists(x, y -> y.open != 0)").select("h", F.explode(F.expr("sequence(0L, m - 1L)")).alias("i"), "x")
    asks = asks.join(chunks.where("m > 1").select("h", "i", F.col("x").alias("y")), ["h", "i"]).select("h", "x", "y")
    asks = chunks.where("m = 1").select("h", "x", F.lit(None).cast(chunks.schema["x"].dataType).alias("y")).union(asks)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts(lists) -> tuple[np.ndarray, ...]:
            c, lo, hi, left, found = lists.flatten().flatten()
            found = np.frombuffer(b"".join(found.to_pylist()), np.uint16).reshape(-1, RUN + 2 * ABOUT)
            return *(v.to_numpy() for v in (c, lo, hi, left)), found

        def linked(h, mine, theirs, pairs) -> pa.RecordBatch:
            k, i, j = (np.concatenate(x) for x in zip(*pairs))
            # not with the one document that holds both
            i, j, k = (v[~((mine[1][i] == mine[2][i]) & (theirs[1][j] == theirs[2][j]) & (mine[1][i] == theirs[1][j]) | (mine[0][i] == theirs[0][j]) & (mine[1][i] == mine[2][i]))] for v in (i, j, k))
            out = [np.zeros(0, np.int64)] * 4
            if len(i):
                out = cores(mine[4], theirs[4], i, j, mine[3])
            pair, p, q, n = out
            arrays = [h[k[pair]], mine[0][i[pair]], theirs[0][j[pair]], *(v.astype(np.int32) for v in (p, q, n))]
            return pa.RecordBatch.from_arrays([pa.array(v) for v in arrays], names=["h", "c", "e", "u", "v", "n"])

        for whole in batches:
            # some rows at a time
            for b in (whole.slice(at, 500) for at in range(0, whole.num_rows, 500)):
                h, x, y = b.column(0).to_numpy(), b.column(1), b.column(2)
                mine, ends = parts(x), x.offsets.to_numpy() - x.offsets[0].as_py()
                alone = y.is_null().to_numpy(zero_copy_only=False)
                others, stops = parts(y), y.offsets.to_numpy() - y.offsets[0].as_py()
                theirs = tuple(np.concatenate(v) for v in zip(mine, others))
                pairs, held = [], 0
                for k in range(b.num_rows):
                    i = np.flatnonzero(mine[3][ends[k] : ends[k + 1]]) + ends[k]
                    j = np.arange(ends[k], ends[k + 1]) if alone[k] else np.arange(stops[k], stops[k + 1]) + ends[-1]
                    pairs.append((np.full(len(i) * len(j), k), np.repeat(i, len(j)), np.tile(j, len(i))))
                    held += len(i) * len(j)
                    if held >= BLOCK:
                        yield linked(h, mine, theirs, pairs)
                        pairs, held = [], 0
                if pairs:
                    yield linked(h, mine, theirs, pairs)

    found = keep(asks.mapInArrow(tidy(meet), "h bigint, c bigint, e bigint, u int, v int, n int"), "passage-cores")
    rest = found.join(halved.where("open != 0").select("h", "c", "d", "p"), ["h", "c"]).join(each.select("h", F.col("c").alias("e"), "low", "high"), ["h", "e"])
    rest = rest.withColumn("y", F.when(F.col("low.d") != F.col("d"), F.col("low")).otherwise(F.col("high"))).where("y.d != d")
    rest = rest.select("d", (F.col("p") + F.col("u")).alias("p"), F.struct("y.d", (F.col("y.p") + F.col("v")).alias("p")).alias("y"), "n")
    rest = rest.select(ordered(F.col("y")).alias("z"), "n").select(*pair(F.col("z.x"), F.col("z.y")), "n").distinct()
    spans = first.unionByName(passed(rest))
    # of spans with one start the longest, so that a hub of many has as many as its words at most
    spans = spans.groupBy("d", "s").agg(F.max(F.struct("e", "alike", F.struct("other", "t").alias("o"))).alias("x"))
    spans = spans.select("d", F.struct("s", "x.e", "x.o.other", "x.o.t", "x.alike").alias("x")).groupBy("d").agg(F.collect_list("x").alias("x"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, x["s"], x["e"] - x["s"], x["other"], x["t"], x["alike"]) for d, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for x in merge(found)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            i = b.schema.field(0).type
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (i, pa.int64(), pa.int64(), i, pa.int64(), pa.float64()))], names=["d", "s", "n", "other", "t", "alike"])

    def long(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [len(words(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["rep", "n"])

    schema = f"d {kind}, s bigint, n bigint, other {kind}, t bigint, alike double"
    second = copies.where("d != rep").groupBy("rep").agg(F.min("d").alias("second"))
    size = given.join(second.select(F.col("rep").alias("d")), "d").select("d", "t").mapInArrow(tidy(long), f"rep {kind}, n bigint").where(f"n >= {LEAST}")
    size = keep(size.join(second, "rep"), "passage-whole")
    whole = copies.join(size, "rep").select("d", F.lit(0).cast("long").alias("s"), "n", F.when(F.col("d") == F.col("rep"), F.col("second")).otherwise(F.col("rep")).alias("other"), F.lit(0).cast("long").alias("t"), F.lit(1.0).alias("alike"))
    out = spans.mapInArrow(tidy(merged), schema).join(size.select(F.col("rep").alias("d")), "d", "left_anti").unionByName(whole)
    return out.select(F.col("d").alias(id_col), F.col("s").alias("start_word"), F.col("n").alias("n_words"), F.col("other").alias(f"other_{id_col.removeprefix('doc_')}"), F.col("t").alias("other_start"), F.col("alike").alias("similarity"))
