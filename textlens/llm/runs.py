"""Periodic runs of words by the linear-time method for tandem repeats of Gusfield and Stoye.

A tandem repeat is a block that stands twice in a row. Documents of a batch are one word string, each ended by a symbol of
its own, so that nothing repeats across an end.

1. Blocks of the Lempel-Ziv decomposition: the right half of a repeat's leftmost occurrence touches two blocks at most, so
   comparing the places around each block's start at the distances that the block allows gives, for each kind of repeat,
   an occurrence or a stretch of repeats that begins before it: a leftmost-covering set, of linear size.
2. Walks along suffix links in the suffix tree complete the vocabulary: from the locus of ``(start, 2k)`` a link and one
   edge lead to that of ``(start + 1, 2k)``, and the walk ends with the stretch or after ``k`` rotations. Each locus is
   marked once.
3. A marked node's leaves are all occurrences of its repeat. Occurrences of one period at consecutive places merge into
   a run. Only repeats of a primitive block are marked, so a run has its smallest period.

The suffix tree is held as the suffix array with the names of all substrings of power-of-two length: a node is an interval
of the array, equal names of two overlapping substrings make equal strings, and names descend to common extensions. All
steps are taken for a whole batch of documents at once.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_name, in_pieces

#: A run has at least so many words, and so many periods.
LEAST, PERIODS = 6, 4
#: Bytes of text of a batch, places compared together, symbols from which names are kept in files.
PIECE, TOGETHER, LARGE = 4 << 20, 4_000_000, 3_000_000
RUNS = T.ArrayType(T.StructType([T.StructField(c, T.LongType(), False) for c in ("start", "length", "period")]), False)


class SuffixTree:
    """Suffix array ``sa`` of ``s`` and ``names[k]``: for each place, where the suffixes with the same first ``2**k`` symbols begin in ``sa``."""

    def __init__(self, s: np.ndarray):
        self.s, n = s, len(s)
        sa = np.argsort(s, kind="stable").astype(np.int32)
        first = s[sa]
        start = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
        size = np.diff(np.r_[start, n])
        name = np.empty(n, dtype=np.int32)
        name[sa] = np.repeat(start, size)
        self.sa, self.names, self.shared = sa, [self._kept(name)], np.zeros(n, dtype=np.int8)
        open_ = sa[np.repeat(size > 1, size)]
        step = 1
        while len(open_):
            self.shared[open_] += 1
            key = name[open_].astype(np.int64) * (n + 1) + name[open_ + step]  # in range, as the document's end isn't shared
            order = np.argsort(key)
            open_, key = open_[order], key[order]
            group = name[open_].astype(np.int64)
            begin = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            slot = group + np.arange(len(group)) - np.repeat(begin, np.diff(np.r_[begin, len(group)]))
            sa[slot] = open_
            begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[begin, len(key)])
            name = name.copy()
            name[open_] = np.repeat(slot[begin], size)
            self.names.append(self._kept(name))
            open_ = open_[np.repeat(size > 1, size)]
            step *= 2

    @staticmethod
    def _kept(name: np.ndarray) -> np.ndarray:
        """In memory, or for a very long text in a file of the task, which goes with it."""
        if len(name) < LARGE:
            return name
        with tempfile.TemporaryFile() as f:
            out = np.memmap(f, dtype=name.dtype, shape=name.shape)
        out[:] = name
        return out

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols from places ``i`` and ``j`` (never the same) agree."""
        i, j = i.copy(), j.copy()
        out, limit = np.zeros(len(i), dtype=np.int64), np.minimum(self.shared[i], self.shared[j])
        for k in range(len(self.names) - 2, -1, -1):
            at = np.flatnonzero(limit > k)
            at = at[self.names[k][i[at]] == self.names[k][j[at]]]
            if len(at):
                out[at] += 1 << k
                i[at] += 1 << k
                j[at] += 1 << k
                limit[at] = np.minimum(np.minimum(self.shared[i[at]], self.shared[j[at]]), k)
        return out

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the symbols up to and with places ``i < j`` agree, backwards."""
        i, j = i.copy(), j.copy()
        out = np.zeros(len(i), dtype=np.int64)
        todo = np.flatnonzero(i >= 0)
        todo = todo[self.s[i[todo]] == self.s[j[todo]]]
        for k in range(len(self.names) - 2, -1, -1):
            a, b = i[todo] - (1 << k) + 1, j[todo] - (1 << k) + 1
            ok = a >= 0
            ok[ok] = self.names[k][a[ok]] == self.names[k][b[ok]]
            at = todo[ok]
            out[at] += 1 << k
            i[at] -= 1 << k
            j[at] -= 1 << k
        return out

    def longest_earlier(self) -> np.ndarray:
        """For each place, the longest string from there that also starts earlier."""
        sa, n = self.sa.astype(np.int64), len(self.s)
        common = np.zeros(n + 1, dtype=np.int64)
        common[1:n] = self.ahead(sa[:-1], sa[1:])
        best = np.zeros(n, dtype=np.int64)
        for back in (True, False):
            # the nearest suffix of the array that starts earlier: each takes over what a later one has found
            near = np.arange(n) + (-1 if back else 1)
            least = (common[:-1] if back else common[1:]).copy()
            todo = np.flatnonzero(least > 0)
            while True:
                todo = todo[least[todo] > 0]
                todo = todo[sa[near[todo]] > sa[todo]]
                if not len(todo):
                    break
                via = near[todo]
                least[todo], near[todo] = np.minimum(least[todo], least[via]), near[via]
            best[sa] = np.maximum(best[sa], least)
        return best

    def blocks(self) -> np.ndarray:
        """Where the blocks of the decomposition start, and the end."""
        longest, out, i = self.longest_earlier().tolist(), [], 0
        while i < len(longest):
            out.append(i)
            i += longest[i] or 1
        return np.array([*out, len(longest)], dtype=np.int64)

    def nodes(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct loci of substrings: length, and the interval of ``sa`` below each."""
        if not len(start):
            return start, start, start
        top = len(self.names) - 1
        level = np.minimum(np.frexp(length.astype(np.float64))[1] - 1, top)
        pairs = np.empty((3, len(start)), dtype=np.int64)
        pairs[2] = length
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            pairs[0, at] = self.names[k][start[at]]
            # names at the top are of suffixes, each its own
            pairs[1, at] = self.names[k][start[at] + np.where(length[at] >= 2 << k, 0, length[at] - (1 << k))]
        _, one = np.unique(pairs, axis=1, return_index=True)
        start, length, level, pairs = start[one], length[one], level[one], pairs[:, one]
        own = self.names[top][start].astype(np.int64)
        low, high = own.copy(), own.copy()
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            shift = np.where(length[at] >= 2 << k, 0, length[at] - (1 << k))

            def same(slot: np.ndarray, at=at, shift=shift, k=k) -> np.ndarray:
                p = self.sa[slot].astype(np.int64)
                return (self.names[k][p] == pairs[0, at]) & (self.names[k][np.minimum(p + shift, len(self.s) - 1)] == pairs[1, at])

            for side, edge, way in ((low, 0, -1), (high, len(self.s) - 1, 1)):
                good, bad = own[at], np.full(len(at), edge + way)
                while (np.abs(bad - good) > 1).any():
                    mid = (good + bad) // 2
                    ok = same(np.clip(mid, 0, len(self.s) - 1)) & (mid >= 0) & (mid < len(self.s))
                    good, bad = np.where(ok, mid, good), np.where(ok, bad, mid)
                side[at] = good
        return length, low, high


def _leftmost_covering(tree: SuffixTree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, period and length of stretches of tandem repeats that cover the leftmost of each kind."""
    h = tree.blocks()
    size = np.diff(h)
    found = []
    left = np.r_[0, size[:-1]]  # distances to the left of a block's start: up to the block before it
    right = size + np.r_[size[1:], 0]  # and to the right: up to the next block's end
    for way, most in ((-1, left), (1, right)):
        ends = np.cumsum(most)
        begin = 0
        while begin < len(most):
            stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + TOGETHER, "right")))
            n = most[begin:stop]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            at = np.repeat(h[:-1][begin:stop], n)
            begin = stop
            i, j = (at - k, at) if way < 0 else (at, at + k)
            ok = np.flatnonzero(j < len(tree.s))
            ok = ok[tree.s[i[ok]] == tree.s[j[ok]]]
            i, j, k = i[ok], j[ok], k[ok]
            ahead, behind = tree.ahead(i, j), tree.behind(i - 1, j - 1)
            ok = ahead + behind >= k
            found.append(np.stack([(i - behind)[ok], k[ok], (ahead + behind + k)[ok]]))
    return tuple(np.unique(np.concatenate(found, axis=1), axis=1)) if found else (h[:0],) * 3


def _primitive(tree: SuffixTree, start: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Whether the block of ``k`` symbols isn't itself a shorter block repeated: tried for each prime factor of ``k``."""
    out = np.ones(len(k), dtype=bool)
    if not len(k):
        return out
    factor = np.zeros(int(k.max()) + 1, dtype=np.int64)
    for p in range(2, len(factor)):
        if p * p >= len(factor):
            break
        if not factor[p]:
            factor[p * p :: p] = np.where(factor[p * p :: p] == 0, p, factor[p * p :: p])
    factor = np.where(factor == 0, np.arange(len(factor)), factor)
    rest = k.copy()
    while True:
        at = np.flatnonzero((rest > 1) & out)
        if not len(at):
            return out
        p = factor[rest[at]]
        d = k[at] // p
        out[at] = tree.ahead(start[at], start[at] + d) < k[at] - d
        rest[at] //= p


def tandem_runs(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of every maximal run of two periods and more, by start within a period."""
    tree = SuffixTree(s)
    start, k, length = _leftmost_covering(tree)
    ok = _primitive(tree, start, k)
    start, k, length = start[ok], k[ok], length[ok]
    steps = np.minimum(length - 2 * k + 1, k)
    walk = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    length, low, high = tree.nodes(np.repeat(start, steps) + walk, np.repeat(2 * k, steps))
    leaves = high - low + 1
    slot = np.repeat(low - np.cumsum(leaves) + leaves, leaves) + np.arange(leaves.sum())
    where = np.unique(np.repeat(length // 2, leaves) * (len(s) + 1) + tree.sa[slot])  # period, then place
    if not len(where):
        return start[:0], start[:0], start[:0]
    begin = np.flatnonzero(np.r_[True, np.diff(where) != 1])
    period, first = np.divmod(where[begin], len(s) + 1)
    last = where[np.r_[begin[1:], len(where)] - 1] % (len(s) + 1)
    return first, last - first + 2 * period, period


def runs_of(texts: list[list[int]], least: int = LEAST, periods: int = PERIODS) -> list[np.ndarray]:
    """For each word sequence the rows ``start, length, period`` of its runs, by start, then period."""
    size = np.array([len(x) + 1 for x in texts], dtype=np.int64)
    stop = np.cumsum(size)
    s = np.empty(int(stop[-1]) if len(stop) else 0, dtype=np.int32)
    for x, z in zip(texts, stop.tolist(), strict=True):
        s[z - len(x) - 1 : z - 1] = x
    top = int(s[np.setdiff1d(np.arange(len(s)), stop - 1)].max(initial=-1)) + 1
    s[stop - 1] = top + np.arange(len(stop))
    start, length, period = tandem_runs(s)
    ok = length >= np.maximum(least, periods * period)
    doc = np.searchsorted(stop, start[ok], "right")
    rows = np.stack([start[ok] - (stop - size)[doc], length[ok], period[ok]], 1)
    order = np.lexsort((rows[:, 2], rows[:, 0], doc))
    return np.split(rows[order], np.searchsorted(doc[order], np.arange(1, len(texts))))


def collapsed(words: list[bytes], runs: np.ndarray) -> bytes:
    """The words without what runs repeat: all of a run after its first period goes."""
    if not len(runs):
        return b" ".join(words)
    change = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()])


def periodic_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, periods: int = PERIODS) -> DataFrame:
    """``docs`` with ``runs`` (``start, length, period`` in words, by start, then period) and ``collapsed``, the words left
    by one copy of each run's period, joined by one space; either name gets underscores in front if ``docs`` has it.

    Runs are maximal, have their smallest period, ``least`` words and ``periods`` periods at least. Words are split at
    ASCII white space and compared as they are. Null and wordless texts have no run and an empty ``collapsed``; equal rows
    have equal results; an empty table gives no row. A text is never cut: a very long one is a batch of its own, whose
    names of substrings are kept in files of the task.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField(free_name(docs.columns, "runs"), RUNS), T.StructField(free_name(docs.columns, "collapsed"), T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([pa.field(c, pa.int64(), False) for c in ("start", "length", "period")]))
        for batch in in_pieces(batches, text_col, PIECE):
            known: dict[bytes, int] = {}  # equal word sequences are searched once
            number: dict[bytes, int] = {}
            of, texts, short = [], [], []
            for t in batch.column(text_col).cast(pa.binary()).to_pylist():
                words = (t or b"").split()
                whole = b" ".join(words)
                if whole not in known:
                    known[whole] = len(texts)
                    texts.append([number.setdefault(w, len(number)) for w in words])
                of.append(known[whole])
            found = runs_of(texts, least, periods)
            short = [collapsed(whole.split(), r) if len(r) else whole for whole, r in zip(known, found, strict=True)]
            del texts, number
            rows = [found[i] for i in of]
            flat = np.concatenate(rows) if rows else np.zeros((0, 3), dtype=np.int64)
            items = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in range(3)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32)), items)
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array([short[i] for i in of], pa.binary()).cast(pa.string())], names=schema.names)

    return docs.mapInArrow(work, schema)
