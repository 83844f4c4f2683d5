"""Burrows-Wheeler transform and common prefixes of a collection of strings, built column by column.

Round ``j`` inserts the suffix of length ``j`` of every string, that is one symbol each, into the order of all shorter
suffixes. Where it belongs follows from the transform alone: the suffix ``cX`` stands at the number of symbols below
``c`` plus the number of ``c`` before ``X``. Its common prefix with its neighbour ``cY`` is one more than that of ``X``
and ``Y``, the smallest of the prefixes between them, so prefixes are carried from round to round and strings are never
compared.

The transform and the prefixes are a file that each round reads and writes once from front to back; the strings are a
file of columns, of which a round reads one. So the rounds hold one symbol's state (a hundred bytes) a string and a block
of the file, but no strings. Which suffix stands where is found at the end by walking all strings backward through the
finished transform at once, for which that is read whole. The files take some hundred bytes a string of the task's own
scratch space, and go with the task.
"""

from __future__ import annotations

import os

import numpy as np

#: Entries that are read at a time.
CHUNK = 1 << 22


class Collection:
    """Strings of at most 255 bytes as a file of columns in ``folder``: column ``j`` has the symbol before each string's last ``j`` bytes.

    Symbols are numbered in byte order from 1; 0 stands before a whole string.
    """

    def __init__(self, folder: str, matrix: np.ndarray, lengths: np.ndarray):
        self.folder, self.lengths, n = folder, lengths.astype(np.int64), len(lengths)
        used = np.zeros(256, dtype=bool)
        for a in range(0, n, 1 << 14):
            used |= np.bincount(matrix[a : a + (1 << 14)].ravel(), minlength=256) > 0
        self.sigma = int(used.sum()) + 1
        self.type = np.dtype("u1") if self.sigma <= 256 else np.dtype("<u2")
        code = np.cumsum(used).astype(self.type)
        self.columns = int(self.lengths.max(initial=0)) + 1
        with open(self.path, "wb") as f:
            for a in range(0, n, 1 << 14):
                rows, size = code[matrix[a : a + (1 << 14)]], self.lengths[a : a + (1 << 14)]
                at = np.arange(len(size))
                for j in range(self.columns):
                    f.seek((j * n + a) * self.type.itemsize)
                    np.where(size > j, rows[at, np.maximum(size - 1 - j, 0)], 0).astype(self.type).tofile(f)

    @property
    def path(self) -> str:
        return os.path.join(self.folder, "columns")

    def column(self, j: int) -> np.ndarray:
        n = len(self.lengths)
        return np.fromfile(self.path, self.type, n, offset=j * n * self.type.itemsize)


class _File:
    """The sequential file of one round, an entry a suffix: a word of its symbol and, above, its common prefix with the one before."""

    def __init__(self, strings: Collection, number: int):
        self.path, self.symbol, self.bits = os.path.join(strings.folder, str(number)), strings.type, 8 * strings.type.itemsize
        self.type = np.dtype("<u2") if self.bits == 8 else np.dtype("<u4")

    def symbols(self, entries: np.ndarray) -> np.ndarray:
        return entries.astype(self.symbol)  # the lower part

    def prefixes(self, entries: np.ndarray) -> np.ndarray:
        return (entries >> self.type.type(self.bits)).astype(np.uint8)

    def entries(self, symbols: np.ndarray, prefixes: np.ndarray | int = 0) -> np.ndarray:
        return (np.asarray(prefixes).astype(self.type) << self.type.type(self.bits)) | symbols.astype(self.type)

    def blocks(self):
        with open(self.path, "rb") as f:
            while len(entries := np.fromfile(f, self.type, CHUNK)):
                yield entries


def least_between(x: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest of ``x[left], ..., x[right]`` for each pair, from minima over runs of powers of two."""
    out = np.empty(len(left), dtype=x.dtype)
    level = (np.frexp((right - left + 1).astype(float))[1] - 1).astype(np.uint8)
    order = np.argsort(level, kind="stable")
    cut = np.searchsorted(level[order], np.arange(int(level.max(initial=0)) + 2))
    for k in range(len(cut) - 1):
        own = order[cut[k] : cut[k + 1]]
        out[own] = np.minimum(x[left[own]], x[right[own] - (1 << k) + 1])
        if k + 2 < len(cut):
            x = np.minimum(x[: -(1 << k)], x[1 << k :])
    return out


def transformed(strings: Collection, common: int) -> _File:
    """The finished transform with common prefixes up to ``common``."""
    n, sigma, small = len(strings.lengths), strings.sigma, strings.type
    # the empty suffixes, in the strings' order
    now = _File(strings, 0)
    symbol = strings.column(0) if n else np.zeros(0, small)
    now.entries(symbol).tofile(now.path)
    totals = np.bincount(symbol, minlength=sigma)
    live = np.flatnonzero(symbol)
    at = live.copy()  # where the latest suffix of each live string stands
    for j in range(1, strings.columns):
        if not len(live):
            break
        below = n + np.cumsum(totals) - totals - totals[0]
        # 1. read symbols and prefixes: the new places, and the prefixes that change
        puts, whose = [], []
        changed: list[tuple[np.ndarray, np.ndarray]] = []
        size = int(totals.sum())
        seen, start, k = np.zeros(sigma, dtype=np.int64), 0, 0
        least, fresh = np.full(sigma, 255, dtype=np.uint8), np.zeros(sigma, dtype=bool)  # since each symbol's last place; whether that is new
        for entries in now.blocks():
            bwt, prefix, m = now.symbols(entries), now.prefixes(entries), len(entries)
            stop = int(np.searchsorted(at, start + m))
            counts = totals if m == size else np.bincount(bwt, minlength=sigma)
            begin = np.cumsum(counts) - counts
            order = np.argsort(bwt, kind="stable")  # by symbol, and inside one as they stand
            base = below + seen - begin
            new = np.zeros(m, dtype=bool)
            new[at[k:stop] - start] = True
            placed = new[order]
            r = np.flatnonzero(placed)
            p = order[r]
            puts.append(base[bwt[p]] + r)
            whose.append(k + np.searchsorted(at[k:stop] - start, p))
            # a new suffix and the one that follows it among those of its symbol get new prefixes
            placed[1:] |= placed[:-1].copy()
            placed[begin[fresh & (counts > 0)]] = True
            q = np.flatnonzero(placed)
            p = order[q]
            c = bwt[p]
            first = q == begin[c]
            value = least_between(prefix, np.where(first, 0, order[np.maximum(q - 1, 0)] + 1), p)
            value = np.where(first, np.minimum(value, least[c]), value)
            value = np.where(first & (seen[c] == 0), 0, np.minimum(value, common - 1) + 1)
            ok = c > 0
            changed.append((base[c[ok]] + q[ok], value[ok].astype(np.uint8)))
            seen += counts
            start, k = start + m, stop
            if start < size:  # for the next block: the least prefix from each symbol's last place to this one's end
                here = np.flatnonzero(counts)
                last = order[(begin + counts - 1)[here]]
                least = np.minimum(least, prefix.min())
                ends = last == m - 1
                least[here[ends]] = 255
                least[here[~ends]] = least_between(prefix, last[~ends] + 1, np.full((~ends).sum(), m - 1))
                fresh[here] = new[last]
        (where, value), put, who = changed[0], puts[0], whose[0]
        if m < size:  # places rise inside a block only
            put, who, where, value = (np.concatenate(x) for x in (puts, whose, *zip(*changed, strict=True)))
            order = np.argsort(put, kind="stable")
            put, who = put[order], who[order]
            order = np.argsort(where, kind="stable")
            where, value = where[order], value[order]
        live = live[who]
        new = strings.column(j)[live]
        entering = now.entries(new)
        # 2. read the file and write it with the new suffixes in place
        then = _File(strings, j)
        before = put - np.arange(len(put))  # in the old order
        start, k, f, wrote = 0, 0, 0, 0
        with open(then.path, "wb") as out:
            for entries in now.blocks() if m < size else [entries]:
                end = start + len(entries)
                stop = int(np.searchsorted(before, end, side="right" if end == size else "left"))
                own = put[k:stop] - wrote
                stay = np.ones(len(entries) + stop - k, dtype=bool)
                stay[own] = False
                both = np.empty(len(stay), dtype=now.type)
                both[stay] = entries
                both[own] = entering[k:stop]
                g = int(np.searchsorted(where, wrote + len(stay)))
                at = where[f:g] - wrote
                both[at] = now.entries(now.symbols(both[at]), value[f:g])
                both.tofile(out)
                start, k, f, wrote = end, stop, g, wrote + len(stay)
        os.remove(now.path)
        now = then
        totals += np.bincount(new, minlength=sigma)
        at, live = put[new > 0], live[new > 0]
    return now


def sorted_suffixes(strings: Collection, common: int) -> tuple[np.ndarray, np.ndarray]:
    """Names (string * 256 + length) of the suffixes of at least ``common`` bytes in order, and the common prefix of each with the one before, up to ``common``."""
    last = transformed(strings, common)
    entries = np.fromfile(last.path, last.type)
    bwt = last.symbols(entries)
    n, totals = len(strings.lengths), np.bincount(bwt, minlength=strings.sigma)
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), dtype=np.int64)  # from each suffix to the one with the symbol before it
    step[order] = np.arange(len(bwt)) + n - totals[0]
    del order
    names = np.full(len(bwt), -1, dtype=np.int64)
    who = at = np.arange(n)
    for j in range(strings.columns):
        if j >= common:
            names[at] = (who << 8) + j
        go = bwt[at] > 0
        who, at = who[go], step[at[go]]
    long = names >= 0
    return names[long], last.prefixes(entries[long])
