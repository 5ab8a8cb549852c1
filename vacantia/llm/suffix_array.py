"""Suffix arrays by induced sorting, and permuted common prefixes, of arrays in memory.

Suffixes are S (smaller than the next one) or L; an S suffix behind an L one is a leftmost S. Their
substrings are sorted by inducing from any order of them, named, and the string of names is sorted by
the same method, recursively; from the order of the leftmost S suffixes all others are induced in two
scans. Over a small alphabet the scans go bucket by bucket, each bucket in waves of whole arrays; over
the large ones of the names they go position by position.
"""

from __future__ import annotations

import numpy as np

SMALL = 512


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of all suffixes in order; a suffix that is a prefix of another comes first."""
    text = np.asarray(text, np.int64)
    n = len(text)
    if n < 2:
        return np.arange(n)
    kind = s_types(text)
    leftmost = np.flatnonzero(kind[1:] & ~kind[:-1]) + 1
    induce = _by_bucket if int(text.max()) < SMALL else _by_position
    if len(leftmost) > 1:
        order = induce(text, kind, leftmost)
        order = _only(order, leftmost, n)
        names, distinct = _named(text, kind, leftmost, order)
        if distinct < len(leftmost):
            leftmost = leftmost[suffix_array(names)]
        else:
            leftmost = order
    return induce(text, kind, leftmost)


def _only(order: np.ndarray, leftmost: np.ndarray, n: int) -> np.ndarray:
    mark = np.zeros(n, bool)
    mark[leftmost] = True
    return order[mark[order]]


def s_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is L, as the empty suffix is least."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    smaller = np.append(text[:-1] < text[1:], False)
    at = np.where(differs, np.arange(n), n)
    following = np.minimum.accumulate(at[::-1])[::-1]
    return smaller[following]


def _named(text, kind, leftmost, order) -> tuple[np.ndarray, int]:
    """Names of the leftmost substrings, in the order of their positions: equal ones have one name."""
    n = len(text)
    length = np.diff(np.append(leftmost, n))
    rank = np.zeros(n, np.int64)
    rank[leftmost] = np.arange(len(leftmost))
    own = length[rank[order]] + 1  # up to the next leftmost position, that one included
    ends = order + own
    same = (own[1:] == own[:-1]) & (ends[1:] <= n) & (ends[:-1] <= n)
    i = np.flatnonzero(same)
    a, b, left, step = order[i], order[i + 1], own[i], 0
    alive = np.ones(len(i), bool)
    while len(live := np.flatnonzero(alive & (left > step))):
        differs = (text[a[live] + step] != text[b[live] + step]) | (kind[a[live] + step] != kind[b[live] + step])
        alive[live[differs]] = False
        step += 1
    equal = np.zeros(len(order), bool)
    equal[i[alive] + 1] = True
    names = np.cumsum(~equal) - 1
    out = np.zeros(n, np.int64)
    out[order] = names
    return out[leftmost], int(names[-1]) + 1


def _deal(found: np.ndarray, text: np.ndarray, buckets: list[list]) -> None:
    """Append positions to the buckets of their characters, in order."""
    chars = text[found]
    order = np.argsort(chars, kind="stable")
    chars, found = chars[order], found[order]
    cuts = np.flatnonzero(np.diff(chars)) + 1
    for part in np.split(found, cuts):
        buckets[text[part[0]]].append(part)


def _by_bucket(text: np.ndarray, kind: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    size, n = int(text.max()) + 1, len(text)
    ls: list[list] = [[] for _ in range(size)]
    ss: list[list] = [[] for _ in range(size)]
    seeds: list[list] = [[] for _ in range(size)]
    _deal(leftmost, text, seeds) if len(leftmost) else None
    ls[text[n - 1]].append(np.array([n - 1]))

    def wave(p: np.ndarray, want: bool, char: int, out: list[list]) -> np.ndarray:
        """Deal what p induces; what falls into p's own bucket is returned."""
        p = p[p > 0] - 1
        p = p[kind[p] == want]
        own = text[p] == char
        if not own.all():
            _deal(p[~own], text, out)
        return p[own]

    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    for c in range(size):
        part = join(ls[c])
        ls[c] = [part]
        while len(part := wave(part, False, c, ls)):
            ls[c].append(part)
        for part in seeds[c]:
            wave(part, False, c, ls)
        ls[c] = [join(ls[c])]
    # S suffixes are dealt from the right end; each list runs from the largest down.
    for c in range(size - 1, -1, -1):
        part = join(ss[c])
        ss[c] = [part]
        while len(part := wave(part, True, c, ss)):
            ss[c].append(part)
        wave(ls[c][0][::-1], True, c, ss)
        ss[c] = [join(ss[c])]
    return np.concatenate([x for c in range(size) for x in (ls[c][0], ss[c][0][::-1])])


def _by_position(text: np.ndarray, kind: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    n = len(text)
    sizes = np.bincount(text)
    ends = np.cumsum(sizes)
    # The character before a position if it starts an L (or S) suffix, else -1; place n, also read as
    # the last one, stands for what is not known yet.
    earlier = np.append(-1, text[:-1])
    is_s = np.append(False, kind[:-1])
    before_l = [*np.where(is_s, -1, earlier).tolist(), -1]
    before_s = [*np.where(is_s, earlier, -1).tolist(), -1]
    order = [-1] * n
    tail = ends.tolist()
    for p, c in zip(leftmost[::-1].tolist(), text[leftmost[::-1]].tolist(), strict=True):
        tail[c] -= 1
        order[tail[c]] = p
    head = (ends - sizes).tolist()
    # The last suffix comes from the empty one, before everything else in its bucket.
    last = int(text[n - 1])
    order[head[last]] = n - 1
    head[last] += 1
    for p in order:  # reads what the loop itself has put further right
        c = before_l[p]
        if c >= 0:
            at = head[c]
            order[at] = p - 1
            head[c] = at + 1
    tail = ends.tolist()
    for p in reversed(order):  # and further left
        c = before_s[p]
        if c >= 0:
            at = tail[c] - 1
            order[at] = p - 1
            tail[c] = at
    return np.array(order, np.int64)


def common_prefixes(text: np.ndarray, order: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix, before): how many characters each suffix shares with the one before it in the order,
    by position, no more than either has `room` for, and where that one starts (-1: none).

    A prefix that goes on to the left is one longer there, so only those that don't are compared
    character by character, eight at a time; the others follow from the nearest on their left.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    data = np.append(text.astype(np.uint8), np.zeros(16, np.uint8))
    words = np.zeros(n + 8, np.uint64)
    for k in range(8):
        words |= data[k : k + n + 8].astype(np.uint64) << np.uint64(8 * k)
    at = np.arange(n)
    known = np.zeros(n, np.int64)
    follows = (at > 0) & (before > 0)
    follows[1:] &= (data[at[1:] - 1] == data[before[1:] - 1]) & (before[at[1:] - 1] == before[1:] - 1)
    # Nothing goes on over the end of a room.
    follows[1:] &= (room[at[1:] - 1] == room[at[1:]] + 1) & (room[before[1:] - 1] == room[before[1:]] + 1)
    todo = np.flatnonzero(~follows & (before >= 0))
    most = np.minimum(room[todo], room[before[todo]])
    a, b, length = todo, before[todo], np.zeros(len(todo), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        equal = words[a[live] + length[live]] == words[b[live] + length[live]]
        stop = live[~equal]
        differs = words[a[stop] + length[stop]] ^ words[b[stop] + length[stop]]
        low = differs & (~differs + np.uint64(1))
        length[stop] += (np.log2(low.astype(np.float64)).astype(np.int64)) // 8
        live = live[equal]
        length[live] += 8
        live = live[length[live] < most[live]]
    known[todo] = np.minimum(length, most)
    source = np.maximum.accumulate(np.where(follows, 0, at))
    prefix = np.where(follows, known[source] - (at - source), known)
    return np.maximum(prefix, 0), before
