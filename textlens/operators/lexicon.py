"""Counts of many terms in one pass over each text, by an Aho-Corasick automaton over UTF-8 bytes.

The automaton's transitions are complete (failures are folded in), so a byte costs one look-up whatever the number of terms.
A batch of texts is one byte string cut into lanes of equal length that step together; each lane first reads as many bytes
before its own as the longest term has, after which its state no longer depends on where it began. A byte that no text
has stands between texts and leads to the root.

Lexicons are tables of any size: they are dealt into parts whose automata have at most ``CELLS`` transitions, each part is
read, built and broadcast alone, and texts are passed over once a part. Nothing is shuffled but the terms.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import free_name, pieces

#: Transitions of an automaton (4 bytes each), and the least length of a lane.
CELLS, LANE = 16 << 20, 1024
_GAP = b"\xff"


@dataclass(frozen=True)
class Automaton:
    """``step[state * classes + class_of[byte]]`` is the next state; ``term[state]`` the term that ends there, ``link[state]`` the next shorter one's state."""

    class_of: np.ndarray
    classes: int
    step: np.ndarray
    term: np.ndarray
    link: np.ndarray
    size: np.ndarray  # bytes of each term
    bordered: np.ndarray  # whether a term can overlap itself

    @staticmethod
    def of(terms: list[str]) -> Automaton:
        """The automaton of distinct terms that aren't empty."""
        data = [t.encode("utf-8", "surrogatepass") for t in terms]
        used = sorted(set().union(*data)) if data else []
        class_of = np.zeros(256, dtype=np.int32)
        class_of[used] = np.arange(1, len(used) + 1)
        classes, edges, ends = len(used) + 1, {}, []
        parent, by, depth = [0], [0], [0]
        for t in data:
            s = 0
            for b in t:
                key = s << 8 | b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(s)
                    by.append(b)
                    depth.append(depth[s] + 1)
                s = edges[key]
            ends.append(s)
        n = len(parent)
        parent, by, depth = np.array(parent), class_of[by], np.array(depth)
        step, fail = np.zeros((n, classes), dtype=np.int32), np.zeros(n, dtype=np.int32)
        term, link = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        term[ends] = np.arange(len(data))
        order = np.argsort(depth, kind="stable")
        levels = np.split(order, np.searchsorted(depth[order], np.arange(1, int(depth.max()) + 1)))
        for here, below in zip(levels, [*levels[1:], order[:0]], strict=True):
            if here[0]:
                # the row of the parent's failure is whole, as that lies two levels up at least
                fail[here] = np.where(depth[here] > 1, step[fail[parent[here]], by[here]], 0)
                step[here] = step[fail[here]]
                link[here] = np.where(term[fail[here]] >= 0, fail[here], link[fail[here]])
            step[parent[below], by[below]] = below
        bordered = np.array([any(t.endswith(t[:k]) for k in range(1, len(t))) for t in data], dtype=bool)
        return Automaton(class_of, classes, step.ravel(), term, link, np.array([len(t) for t in data], dtype=np.int64), bordered)

    def matches(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The place of the last byte and the term of every occurrence, overlapping ones too."""
        warm = int(self.size.max(initial=1)) - 1
        length = max(LANE, 8 * warm, -(-len(data) // 16384))
        lanes = -(-len(data) // length)
        if not lanes or not len(self.size):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        padded = np.zeros(warm + lanes * length, dtype=np.int32)
        padded[warm : warm + len(data)] = self.class_of[data]
        columns = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lanes, warm + length), (4 * length, 4)).T)
        ends = (self.term >= 0) | (self.link > 0)
        state, found_at, found = np.zeros(lanes, dtype=np.int32), [], []
        for i, column in enumerate(columns):
            state = self.step[state * self.classes + column]
            if i >= warm:
                hit = np.flatnonzero(ends[state])
                if len(hit):
                    found_at.append(hit * length + (i - warm))
                    found.append(state[hit])
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at, state = np.concatenate(found_at), np.concatenate(found)
        out_at, out = [], []
        while len(state):
            own = self.term[state] >= 0
            out_at.append(at[own])
            out.append(self.term[state[own]].astype(np.int64))
            state = self.link[state]
            at, state = at[state > 0], state[state > 0]
        return np.concatenate(out_at), np.concatenate(out)

    def counts(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, term and number of occurrences that don't overlap, counted from the left as a replacement would; by text, then term."""
        joined = _GAP.join([t or b"" for t in texts])
        stop = np.cumsum([len(t or b"") + 1 for t in texts])
        at, term = self.matches(np.frombuffer(joined, dtype=np.uint8))
        order = np.lexsort((at, term))
        at, term = at[order], term[order]
        # a term that can overlap itself: an occurrence that begins before the last counted one's end isn't one
        close = self.bordered[term] & np.r_[False, (term[1:] == term[:-1]) & (at[1:] - at[:-1] < self.size[term[1:]])]
        keep = ~close
        places = np.flatnonzero(close)
        for i, begins in zip(places.tolist(), np.r_[True, np.diff(places) != 1].tolist() if len(places) else [], strict=True):
            if begins:
                last = at[i - 1]
            if at[i] - last >= self.size[term[i]]:
                keep[i], last = True, at[i]
        key, n = np.unique(np.searchsorted(stop, at[keep], "right") * max(1, len(self.size)) + term[keep], return_counts=True)
        text, of = np.divmod(key, max(1, len(self.size)))
        return text, of, n


def _parts(lexicon: DataFrame, term_col: str, cells: int) -> Iterator[list[str]]:
    """The distinct terms in parts whose automata are small enough; null and empty ones are left out."""
    terms = lexicon.select(F.col(term_col).alias("term")).where("term <> ''").distinct()
    size = terms.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    used = terms.select(F.explode(F.array_distinct(F.regexp_extract_all(F.hex("term"), F.lit(".."), F.lit(0))))).distinct().count()
    parts = -(-size * (used + 1) // cells) or 1  # a state for each byte, at most
    for i in range(parts):
        own = terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i) if parts > 1 else terms
        yield sorted(r["term"] for r in own.collect())


def term_counts(df: DataFrame, lexicon: DataFrame, id_col: str = "doc_id", text_col: str = "text", term_col: str = "term", cells: int = CELLS) -> DataFrame:
    """``id, term, n`` for the terms of a lexicon table that occur in each row.

    Occurrences of one term don't overlap; a term inside another counts for both. Null and empty terms and null texts
    have none; repeated terms are one, repeated rows count each. Other columns of either table are not looked at.
    """
    field = df.schema[id_col]
    schema = T.StructType([T.StructField(id_col, field.dataType), T.StructField("term", T.StringType()), T.StructField("n", T.LongType())])
    out = None
    for terms in _parts(lexicon, term_col, cells):
        held = df.sparkSession.sparkContext.broadcast((Automaton.of(terms), pa.array(terms, pa.string())))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            automaton, names = held.value
            for batch in pieces(batches):
                text, term, n = automaton.counts(batch.column("text").cast(pa.binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(text, pa.int64())), names.take(pa.array(term, pa.int64())), pa.array(n, pa.int64())], names=[id_col, "term", "n"])

        rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
        out = rows if out is None else out.unionByName(rows)
    return out


def with_counts(df: DataFrame, terms: list[str], text_col: str, out_col: str) -> DataFrame:
    """``df`` with an array of the counts of a fixed list's terms, in its order; null for a null text."""
    held = df.sparkSession.sparkContext.broadcast(Automaton.of(terms))
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.ArrayType(T.LongType(), False))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in pieces(batches, text_col):
            texts = batch.column(text_col).cast(pa.binary()).to_pylist()
            text, term, n = automaton.counts(texts)
            each = np.zeros((len(texts), len(terms)), dtype=np.int64)
            each[text, term] = n
            gone = np.array([t is None for t in texts], dtype=bool)
            stops = np.r_[0, np.cumsum(np.where(gone, 0, len(terms)))].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(stops, mask=np.r_[gone, False]), pa.array(each[~gone].ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return df.mapInArrow(work, schema)


def _flagged(df: DataFrame, lexicon: DataFrame, flag: str, text_col: str, term_col: str, cells: int) -> DataFrame:
    """``df`` with whether each text contains some term; a text that is known to is not searched for the next part."""
    out = df.withColumn(flag, F.lit(False))
    schema = T.StructType([*df.schema.fields, T.StructField(flag, T.BooleanType())])
    for terms in _parts(lexicon, term_col, cells):
        held = df.sparkSession.sparkContext.broadcast(Automaton.of(terms))

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in pieces(batches, text_col):
                hit = batch.column(flag).to_numpy(zero_copy_only=False).copy()
                todo = np.flatnonzero(~hit)
                texts = batch.column(text_col).take(pa.array(todo, pa.int64())).cast(pa.binary()).to_pylist()
                hit[todo[held.value.counts(texts)[0]]] = True
                yield batch.set_column(batch.schema.get_field_index(flag), flag, pa.array(hit, pa.bool_()))

        out = out.mapInArrow(work, schema)
    return out


def with_any(df: DataFrame, lexicon: DataFrame, text_col: str = "text", term_col: str = "term", cells: int = CELLS) -> DataFrame:
    """Rows that contain some term of a lexicon table of any size."""
    flag = free_name(df.columns, "hit")
    return _flagged(df, lexicon, flag, text_col, term_col, cells).where(F.col(flag)).drop(flag)


def without_any(df: DataFrame, lexicon: DataFrame, text_col: str = "text", term_col: str = "term", cells: int = CELLS) -> DataFrame:
    """Rows that contain none; null texts contain none."""
    flag = free_name(df.columns, "hit")
    return _flagged(df, lexicon, flag, text_col, term_col, cells).where(~F.col(flag)).drop(flag)

