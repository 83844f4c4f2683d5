"""Segmentation by the most probable path through a dictionary, for whole batches of texts.

The dictionary is a double-array trie over the letters that occur in it: the child of ``state`` by a letter is
``base[state] + letter`` if ``check`` names ``state`` there. All places of a batch walk it at once, which gives the words
that start at each place. Between places that no word spans, paths are independent; in all such stretches the best way
from a place to the stretch's end is found together, from the ends to the starts. Weights are whole numbers, so that sums,
and so the paths, don't depend on the order of addition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import free_name, pieces

#: Units of a word's weight, the natural logarithm of its share.
UNIT = 1 << 24
#: Terms of a dictionary that every worker holds, at most.
MOST = 2_000_000


@dataclass(frozen=True)
class DoubleArray:
    letters: np.ndarray  # sorted code points
    base: np.ndarray
    check: np.ndarray
    weight: np.ndarray  # of the word that ends in a state; 0 for none, as weights are below 0
    longest: int

    @staticmethod
    def of(words: dict[str, int]) -> DoubleArray:
        """The trie of words with weights below zero."""
        order = sorted(words)
        codes = [np.frombuffer(w.encode("utf-32-le", "surrogatepass"), dtype="<u4") for w in order]
        letters = np.unique(np.concatenate([*codes, np.zeros(0, dtype="<u4")]))
        longest = max(map(len, codes), default=0)
        table = np.zeros((len(order), longest + 1), dtype=np.int64)  # 0 past the end
        for row, c in zip(table, codes, strict=True):
            row[: len(c)] = np.searchsorted(letters, c) + 1
        own = np.array([words[w] for w in order], dtype=np.int64)
        width = len(letters) + 1
        room = 4 * width + 2 * int((table > 0).sum())
        base, check, weight, b = np.zeros(room, dtype=np.int64), np.full(room, -1, dtype=np.int64), np.zeros(room, dtype=np.int64), 0
        check[0] = 0  # the root's own place
        state, low, high = np.zeros(min(1, len(order)), dtype=np.int64), np.zeros(1, dtype=np.int64)[: len(order)], np.array([len(order)])[: len(order)]
        for depth in range(longest):
            # a node's children are the runs of equal letters in its words that go on
            size = high - low
            row = np.repeat(low - np.cumsum(size) + size, size) + np.arange(size.sum())
            node = np.repeat(np.arange(len(state)), size)
            c = table[row, depth]
            row, node, c = row[c > 0], node[c > 0], c[c > 0]
            if not len(row):
                break
            first = np.flatnonzero(np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])])
            node, c, low, high = node[first], c[first], row[first], np.r_[row[first[1:] - 1], row[-1]] + 1
            begin = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            many = np.diff(np.r_[begin, len(node)])
            at = np.zeros(len(node), dtype=np.int64)
            for i, k in zip(begin[many > 1].tolist(), many[many > 1].tolist(), strict=True):
                base, check, weight, b = _fitting(base, check, weight, c[i : i + k], width, max(0, b - 256))
                base[state[node[i]]] = b
                at[i : i + k] = b + c[i : i + k]
                check[at[i : i + k]] = state[node[i]]
            single = begin[many == 1]
            free = np.flatnonzero(check[width:] < 0)[: len(single)] + width  # an only child fits anywhere
            if len(free) < len(single):
                more = len(single) - len(free)
                free = np.r_[free, len(check) + np.arange(more)]
                base, check, weight = (np.r_[x, np.full(more + 4 * width, fill, dtype=np.int64)] for x, fill in ((base, 0), (check, -1), (weight, 0)))
            base[state[node[single]]] = free - c[single]
            at[single] = free
            check[free] = state[node[single]]
            ends = table[low, depth + 1] == 0
            weight[at[ends]] = own[low[ends]]
            state = at
        pad = np.zeros(width, dtype=np.int64)
        return DoubleArray(letters, np.r_[base, pad], np.r_[check, pad - 1], np.r_[weight, pad], longest)

    def words(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, length and weight of every word that stands in ``codes``."""
        letter = np.searchsorted(self.letters, codes)
        letter = np.where(self.letters[np.minimum(letter, len(self.letters) - 1)] == codes, letter + 1, 0) if len(self.letters) else np.zeros(len(codes), dtype=np.int64)
        place, state, found = np.flatnonzero(letter), np.zeros(int((letter > 0).sum()), dtype=np.int64), []
        for length in range(1, self.longest + 1):
            inside = place + length <= len(codes)
            place, state = place[inside], state[inside]
            c = letter[place + length - 1]
            to = self.base[state] + c
            on = (c > 0) & (self.check[to] == state) & (to > 0)
            place, state = place[on], to[on]
            if not len(place):
                break
            ends = self.weight[state] < 0
            found.append((place[ends], np.full(int(ends.sum()), length), self.weight[state[ends]]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (place[:0],) * 3


def _fitting(base: np.ndarray, check: np.ndarray, weight: np.ndarray, c: np.ndarray, width: int, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The first base from ``start`` at which all children are free, and the arrays, longer if need be."""
    while True:
        b = np.arange(start, min(start + 128, len(check) - width))
        if not len(b):
            base, check, weight = (np.r_[x, np.full(4 * width + 1024, fill, dtype=np.int64)] for x, fill in ((base, 0), (check, -1), (weight, 0)))
            continue
        ok = np.flatnonzero((check[b[:, None] + c] < 0).all(axis=1))
        if len(ok):
            return base, check, weight, int(b[ok[0]])
        start = int(b[-1]) + 1


def weights(freq: dict[str, int]) -> tuple[dict[str, int], int]:
    """Each word's weight, and that of a letter that is no word: as if it occurred once."""
    total = max(2, sum(freq.values()))
    of = lambda n: min(-1, math.floor(math.log(n / total) * UNIT))
    return {w: of(n) for w, n in freq.items() if n > 0 and w}, of(1)


def cuts(codes: np.ndarray, letter: np.ndarray, trie: DoubleArray, unknown: int) -> np.ndarray:
    """Where words begin, as a mask over ``codes``, of which those of ``letter`` are segmented; ties take the longer first word."""
    n = len(codes)
    place, length, weight = trie.words(np.where(letter, codes, 0))
    # a stretch goes on while some word spans the next place
    span = np.zeros(n + 1, dtype=np.int64)
    long = length > 1
    span += np.bincount(place[long] + 1, minlength=n + 1)
    span -= np.bincount((place + length)[long], minlength=n + 1)
    spanned = np.cumsum(span[:-1]) > 0
    out = letter & ~spanned
    held = np.zeros(n, dtype=bool)
    held[:-1] = spanned[1:]
    some = np.flatnonzero(held | spanned)  # places in stretches of more than one letter
    if not len(some):
        return out
    stops = np.flatnonzero(np.r_[~spanned, True])  # each stretch's end is the next place that isn't spanned
    left = stops[np.searchsorted(stops, some, "right")] - some
    # edges of these places: words, and the letter alone where it is no word
    alone = np.zeros(n, dtype=bool)
    alone[some] = True
    alone[place[length == 1]] = False
    keep = (held | spanned)[place]
    lone = np.flatnonzero(alone)
    place, length, weight = np.r_[place[keep], lone], np.r_[length[keep], np.ones(len(lone), dtype=np.int64)], np.r_[weight[keep], np.full(len(lone), unknown)]
    remain = np.zeros(n, dtype=np.int64)
    remain[some] = left
    order = np.argsort(place * (trie.longest + 1) + length)
    order = order[np.argsort(remain[place[order]], kind="stable")]
    place, length, weight = place[order], length[order], weight[order]
    best, step = np.zeros(n + 1, dtype=np.int64), np.ones(n, dtype=np.int64)
    level = np.searchsorted(remain[place], np.arange(1, int(left.max()) + 2))
    for a, z in zip(level[:-1].tolist(), level[1:].tolist(), strict=True):
        if a == z:
            continue
        p, k = place[a:z], length[a:z]
        to = p + k
        value = weight[a:z] + np.where(spanned[np.minimum(to, n - 1)] & (to < n), best[to], 0)
        begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        top = np.maximum.reduceat(value, begin)
        winner = np.maximum.reduceat(np.where(value == np.repeat(top, np.diff(np.r_[begin, z - a])), k, 0), begin)
        best[p[begin]], step[p[begin]] = top, winner
    at = some[~spanned[some]]
    while len(at):
        out[at] = True
        at = at + step[at]
        at = at[at < n]
        at = at[spanned[at]]
    return out


def segmented(texts: list[str | None], letters: np.ndarray, trie: DoubleArray, unknown: int) -> list[list[str] | None]:
    """The words of each text; ``letters`` says of each code point whether it is segmented, others stand between words."""
    codes = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letters[codes]
    if not len(codes):
        return [None if t is None else [] for t in texts]
    begin = np.flatnonzero(cuts(codes, letter, trie, unknown))
    # a word ends where the next begins, or a letter run does
    ends = np.r_[begin[1:], len(codes)] if len(begin) else begin
    gap = np.flatnonzero(np.r_[~letter, True])
    ends = np.minimum(ends, gap[np.searchsorted(gap, begin)])
    out, offset, i = [], 0, 0
    bounds = np.searchsorted(begin, np.cumsum([len(t or "") + 1 for t in texts])).tolist()
    begin, ends = begin.tolist(), ends.tolist()
    for t, z in zip(texts, bounds, strict=True):
        out.append(None if t is None else [t[begin[k] - offset : ends[k] - offset] for k in range(i, z)])
        offset, i = offset + len(t or "") + 1, z
    return out


def letter_table(pattern: str) -> np.ndarray:
    """Of each code point whether the body of a bracket like ``a-zÀ-ÿ`` has it."""
    out = np.zeros(0x110000, dtype=bool)
    i = 0
    while i < len(pattern):
        if i + 2 < len(pattern) and pattern[i + 1] == "-":
            out[ord(pattern[i]) : ord(pattern[i + 2]) + 1] = True
            i += 3
        else:
            out[ord(pattern[i])] = True
            i += 1
    return out


def built(dictionary: DataFrame, letters: str, most: int = MOST) -> tuple[DoubleArray, int]:
    """The trie of a dictionary ``term, freq`` and the weight of an unknown letter, for all workers to hold.

    Frequencies of equal terms add up; null and empty terms, those with other characters than ``letters`` (the body of a bracket) and
    those without a frequency are left out. More than ``most`` terms are an error.
    """
    some = dictionary.where((F.col("freq") > 0) & F.col("term").rlike(f"^[{letters}]+$"))
    rows = some.groupBy("term").agg(F.sum("freq").alias("freq")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the dictionary has more than {most} terms")
    own, unknown = weights({r["term"]: r["freq"] for r in rows})
    return DoubleArray.of(own), unknown


def with_words(df: DataFrame, dictionary: DataFrame, letters: str, text_col: str = "text", out_col: str = "words", most: int = MOST) -> DataFrame:
    """``df`` with the words of each text: for every run of letters the path of greatest weight.

    A letter that begins no word stands alone. Null texts have null; a name that ``df`` has gets underscores in front.
    """
    held = df.sparkSession.sparkContext.broadcast(built(dictionary, letters, most))
    schema = T.StructType([*df.schema.fields, T.StructField(free_name(df.columns, out_col), T.ArrayType(T.StringType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = letter_table(letters)
        for batch in pieces(batches, text_col):
            words = segmented(batch.column(text_col).to_pylist(), table, *held.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string()))], names=schema.names)

    return df.mapInArrow(work, schema)
