"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4, 16 and more segments, as long as their numbers are fewer than the vector's, each known by its mean
and deviation. For two vectors the inner product is at most the sum over segments of ``length * (mean * mean +
deviation * deviation)`` (equivalently, a lower bound of their distance), and finer segments give tighter bounds. A
query's first threshold comes from a few candidates spread over its first block. Then candidates run past the queries block by
block: a pair whose coarse bound can't reach the query's k-th best score so far goes, the rest meet the finer bounds, and
survivors are scored exactly. A level that lately left out less than it costs rests, and is tried again from time to time.

Candidates and queries are written once as packed blocks in the shared folder. A task takes some blocks of each and
reads them there, so no vector is shuffled; what is shuffled are the best of each query from each task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, get_file, put_file, release, shared_dir, unzipped, written, zipped

#: Segments of the levels, and the part of a vector's length that a level's numbers may have.
LEVELS, CHEAPER = (1, 4, 16, 64, 256, 1024), 0.75
#: Candidates of the first block that give the first thresholds, for each of the best; blocks after which a resting level is tried again.
SEEDS, AGAIN = 8, 16
#: Bytes of doubles in a file, in the queries that a task holds, and in the candidates that it reads at most.
FILE, TURN, GROUP = 16 << 20, 32 << 20, 512 << 20
#: Queries and candidates that are compared at a time.
ROWS, COLUMNS = 1024, 4096
#: A query's survivors are gathered where they are less than this part of a block, else the block is multiplied whole for it.
SPARSE = 1 / 4
#: Part of the product of two lengths that a bound is raised by: floats of up to a few thousand components lose less.
SLACK = 1e-4
LONG = (-(2**63), 2**63 - 1)


def segments(v: np.ndarray, s: int) -> np.ndarray:
    """``sqrt(length)`` times mean and deviation of each of ``s`` segments (fewer if there are fewer components)."""
    d = v.shape[1]
    if not d:
        return np.zeros((len(v), 0))
    cut = np.unique(np.arange(min(s, d)) * d // min(s, d))
    n = np.diff(np.r_[cut, d])
    mean = np.add.reduceat(v, cut, axis=1) / n
    square = np.add.reduceat((v - np.repeat(mean, n, axis=1)) ** 2, cut, axis=1)
    return np.concatenate([mean * np.sqrt(n), np.sqrt(square)], axis=1)


class Vectors:
    """Whole-number vectors as ``mantissa * 2 ** exponent`` (one exponent a vector; 0 where all numbers are small), ids, rows."""

    def __init__(self, mantissa: np.ndarray, exponent: np.ndarray, ids: np.ndarray, known: np.ndarray, rows: np.ndarray):
        self.m, self.e, self.ids, self.known, self.rows = mantissa, exponent, ids, known, rows
        self.most = np.inf if exponent.any() else float(np.abs(mantissa).max(initial=0))

    def __getitem__(self, some) -> Vectors:
        return Vectors(self.m[some], self.e[some], self.ids[some], self.known[some], self.rows[some])

    def stats(self, kind=np.float64) -> list[np.ndarray]:
        """What bounds are products of, for each level; the last column is slack beyond what rounding can take from them."""
        slack = SLACK**0.5 * np.sqrt((self.m**2).sum(1, keepdims=True))
        return [np.concatenate([segments(self.m, s), slack], axis=1).astype(kind) for s in LEVELS if 2 * s <= CHEAPER * self.m.shape[1]]

    def whole(self, i: int) -> list[int]:
        """The numbers of a vector."""
        m, e = np.frexp(self.m[i])
        move = (e + self.e[i] - 53).tolist()
        return [n << s if s >= 0 else n >> -s for n, s in zip(map(int, np.ldexp(m, 53).tolist()), move, strict=True)]

    @classmethod
    def joined(cls, some: list[Vectors]) -> Vectors:
        return cls(*(np.concatenate(x) for x in zip(*((v.m, v.e, v.ids, v.known, v.rows) for v in some), strict=True)))

    def pack(self) -> bytes:
        small = next((t for t in ("i1", "<i2", "<i4") if self.most <= np.iinfo(t).max), "<f8")
        return small[-2:].encode() + zipped(self.m.astype(small), self.e.astype("<i4"), self.ids, self.known, self.rows)

    @classmethod
    def unpack(cls, data: bytes, dim: int) -> Vectors:
        m, e, ids, known, rows = unzipped(data[2:], {b"i1": "i1", b"i2": "<i2", b"i4": "<i4", b"f8": "<f8"}[data[:2]], "<i4", "<i8", "?", "<i8")
        return cls(m.reshape(len(ids), dim).astype(np.float64), e, ids, known, rows)

    @classmethod
    def of(cls, x: np.ndarray, scale: float, ids: np.ndarray, known: np.ndarray, rows: np.ndarray) -> Vectors:
        """Vectors of ``floor(scale * x)`` for finite ``x``; also where the product leaves the doubles."""
        with np.errstate(over="ignore"):
            v = np.floor(scale * x)
        if np.abs(v).max(initial=0) < 2**31:
            return cls(v, np.zeros(len(v), dtype=np.int32), ids, known, rows)
        m, e = np.frexp(np.where(np.isfinite(v), v, x))
        more, up = np.frexp(scale * m)
        m, e = np.where(np.isfinite(v), m, more), e + np.where(np.isfinite(v), 0, up)
        top = np.where(m != 0, e, -(1 << 20)).max(1, initial=-(1 << 20))
        top = np.where(top > -(1 << 20), np.maximum(top, 1), 1)
        return cls(np.ldexp(m, e - top[:, None]), top.astype(np.int32), ids, known, rows)


class Best:
    """The best ``k`` of each query so far: score, whether its id is known, and id, as parallel arrays."""

    def __init__(self, queries: Vectors, k: int):
        self.q, self.k = queries, k
        self.kind = np.float32 if queries.most < 2**20 else np.float64
        self.stats = queries.stats(self.kind)
        self.who, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.known = np.zeros(0, dtype=bool)
        self.least = np.full(len(queries.ids), -np.inf)
        self.exact: dict[int, int] = {}
        self.pairs = self.multiplied = self.blocks = 0
        self.rest = [0] * len(self.stats)  # blocks for which a level rests

    def add(self, c: Vectors) -> None:
        """Compare all queries with some candidates."""
        if len(c.ids) > SEEDS * self.k and not np.isfinite(self.least).all():
            seed = np.zeros(len(c.ids), dtype=bool)
            seed[:: len(c.ids) // (SEEDS * self.k)] = True
            self._compare(c[seed])
            c = c[~seed]
        if len(c.ids):
            self._compare(c)

    def _compare(self, c: Vectors) -> None:
        exact = self.q.most * c.most * max(c.m.shape[1], 1)
        stats = c.stats(self.kind)
        found = []
        self.blocks += 1
        for start in range(0, len(self.q.ids), ROWS):
            a = np.arange(start, min(len(self.q.ids), start + ROWS))
            found += self._small(a, c, stats, np.float32 if exact < 2**24 else np.float64) if exact < 2**53 else self._large(a, c, stats)
        if found:
            self._merge(*(np.concatenate(x) for x in zip(*found, strict=True)), c)

    def _small(self, a: np.ndarray, c: Vectors, stats: list[np.ndarray], kind) -> list:
        """Pairs and scores where doubles (or floats) hold every sum exactly."""
        b = np.arange(len(c.ids))
        self.pairs += len(a) * len(b)
        may = np.ones((len(a), len(b)), dtype=bool)
        least = self.least[a]
        if np.isfinite(least).any():
            for level, (own, other) in enumerate(zip(self.stats, stats, strict=True)):
                if self.blocks < self.rest[level]:
                    continue
                met = int(may.sum())
                may &= own[a] @ other[b].T >= least[:, None]
                if (met - int(may.sum())) * self.q.m.shape[1] < may.size * own.shape[1]:
                    self.rest[level] = self.blocks + AGAIN
                rows, columns = may.any(1), may.any(0)
                a, b, least, may = a[rows], b[columns], least[rows], may[np.ix_(rows, columns)]
                if not may.size:
                    return []
        few = may.sum(1) < SPARSE * len(b)
        may &= self.q.rows[a][:, None] != c.rows[b][None, :]
        theirs, out = c.m[b].astype(kind), []

        def best(score: np.ndarray, least: float) -> np.ndarray:
            most = np.partition(score, len(score) - self.k)[len(score) - self.k] if len(score) > self.k else -np.inf
            return np.flatnonzero(score >= max(most, least))

        for i in np.flatnonzero(few).tolist():
            j = np.flatnonzero(may[i])
            self.multiplied += len(j)
            score = theirs[j] @ self.q.m[a[i]].astype(kind)
            top = best(score, least[i])
            out.append((np.full(len(top), a[i]), b[j[top]], score[top].astype(np.int64)))
        some = np.flatnonzero(~few)
        self.multiplied += len(some) * len(b)
        for i, score in zip(some.tolist(), self.q.m[a[some]].astype(kind) @ theirs.T, strict=True):
            score[~may[i]] = -np.inf
            top = best(score, least[i])
            top = top[may[i][top]]
            out.append((np.full(len(top), a[i]), b[top], score[top].astype(np.int64)))
        return out

    def _large(self, a: np.ndarray, c: Vectors, stats: list[np.ndarray]) -> list:
        """The same for numbers of any size: products of mantissas choose what can be among the best, whole numbers score it."""
        out, d = [], c.m.shape[1]
        top = int(c.e.max(initial=0))
        lift = (c.e - top).astype(np.int64)
        bound = [np.ldexp((own[a] @ other.T).astype(np.float64), lift) for own, other in zip(self.stats, stats, strict=True)]
        product = self.q.m[a] @ c.m.T
        size = np.abs(self.q.m[a]) @ np.abs(c.m).T
        slack = np.ldexp((d + 4) * 2.0**-50 * size, lift) + 2.0**-1000
        near = np.ldexp(product, lift)
        for i, q in enumerate(a.tolist()):
            self.pairs += len(c.ids)
            may = c.rows != self.q.rows[q]
            base = int(self.q.e[q]) + top
            if self.least[q] > -np.inf:
                least = _parts(self.exact[q], base)
                for x in bound:
                    may &= x[i] + 2.0**-1000 >= least - abs(least) * 1e-12
            own = np.flatnonzero(may)
            self.multiplied += len(c.ids)
            if len(own) > self.k:
                low = near[i, own] - slack[i, own]
                own = own[near[i, own] + slack[i, own] >= np.partition(low, len(own) - self.k)[len(own) - self.k]]
            numbers = self.q.whole(q)
            score = [sum(x * y for x, y in zip(numbers, c.whole(j), strict=True)) for j in own.tolist()]
            column = np.empty(len(score), dtype=object)
            column[:] = score
            out.append((np.full(len(own), q), own, column))
        return out

    def _merge(self, a: np.ndarray, b: np.ndarray, score: np.ndarray, c: Vectors) -> None:
        if score.dtype == object and self.score.dtype != object:
            self.score = self.score.astype(object)
        who, score, own, known = np.r_[self.who, a], np.r_[self.score, score], np.r_[self.id, c.ids[b]], np.r_[self.known, c.known[b]]
        if score.dtype == object:
            order = np.array(sorted(range(len(who)), key=lambda i: (who[i], -score[i], not known[i], own[i])), dtype=np.int64)
        else:
            order = np.lexsort((own, ~known, ~score, who))  # ~x falls as x rises, without overflow
        who, score = who[order], score[order]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep, last = place < self.k, place == self.k - 1
        self.who, self.score, self.id, self.known = who[keep], score[keep], own[order][keep], known[order][keep]
        self.least[who[last]] = [_parts(x, 0) for x in score[last].tolist()]
        self.exact |= zip(who[last].tolist(), score[last].tolist(), strict=True)

    def rows(self) -> pa.RecordBatch:
        """``query_id, row, vec_id, score, exact, key``: ``key`` orders scores outside the longs, which ``exact`` spells."""
        score = self.score.tolist()
        out = [not LONG[0] <= s <= LONG[1] for s in score]
        return pa.RecordBatch.from_arrays(
            [pa.array(self.q.ids[self.who]), pa.array(self.q.rows[self.who]), pa.array(self.id, mask=~self.known), pa.array([min(max(s, LONG[0]), LONG[1]) for s in score], pa.int64()), pa.array([str(s) if o else None for s, o in zip(score, out, strict=True)], pa.string()), pa.array([_key(s) if o else "" for s, o in zip(score, out, strict=True)], pa.string())],
            names=["query_id", "row", "vec_id", "score", "exact", "key"],
        )


def _parts(n: int, base: int) -> float:
    """``n / 2**base``, infinite beyond the doubles."""
    shift = max(0, abs(n).bit_length() - 60)
    with np.errstate(over="ignore"):
        return float(np.ldexp(float(n >> shift), max(-5000, min(5000, shift - base))))


def _key(n: int) -> str:
    """Text that sorts as whole numbers of the same sign do."""
    digits = str(abs(n))
    return f"{len(digits):09d}{digits}" if n > 0 else f"{10**9 - 1 - len(digits):09d}" + digits.translate(str.maketrans("0123456789", "9876543210"))


def _packed(vectors: DataFrame, base: str, id_col: str, vector_col: str, scale: float, every: int) -> DataFrame:
    """Writes blocks of quantised vectors; their files: ``dim, kind`` (0: queries, 1: candidates), ``size`` in bytes of doubles, ``path``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row, number = part << 40, 0
        held: dict[tuple[int, int], list[Vectors]] = {}
        size: dict[tuple[int, int], int] = {}

        def put(key: tuple[int, int]) -> Iterator[pa.RecordBatch]:
            nonlocal number
            some = held.pop(key)
            # small and large numbers don't share a block
            for large in (False, True):
                own = [v[np.flatnonzero((v.e != 0) == large)] for v in some]
                own = [v for v in own if len(v.ids)]
                if own:
                    path = f"{base}/{part}-{number}"
                    number += 1
                    v = Vectors.joined(own)
                    put_file(path, v.pack())
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]]), pa.array([8 * len(v.ids) * max(key[0], 1)]), pa.array([path])], names=["dim", "kind", "size", "path"])
            size.pop(key)

        for batch in batches:
            lists = batch.column("v")
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
            first = np.cumsum(sizes) - sizes
            rows = row + np.arange(len(sizes))
            row += len(sizes)
            for d in np.unique(sizes).tolist():
                own = np.flatnonzero(sizes == d)
                x = flat[first[own][:, None] + np.arange(d)]
                own, x = own[np.isfinite(x).all(1)], x[np.isfinite(x).all(1)]  # nulls are not finite here
                small = (np.abs(x) < 2.0**30 / abs(scale)).all(1)
                for some in (small, ~small):
                    at = own[some]
                    if not len(at):
                        continue
                    v = Vectors.of(x[some], scale, ids[at], known[at], rows[at])
                    # Python's %: a negative id is divisible as its absolute value is
                    asks = np.flatnonzero(known[at] & (ids[at] % every == 0))
                    for key, w in (((d, 0), v[asks]), ((d, 1), v)):
                        if len(w.ids):
                            held.setdefault(key, []).append(w)
                            size[key] = size.get(key, 0) + 8 * len(w.ids) * max(d, 1)
            while sum(size.values()) > FILE:
                yield from put(max(size, key=size.get))
        for key in [*held]:
            yield from put(key)
        release()

    slim = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("v is not null")
    return slim.mapInArrow(work, "dim bigint, kind bigint, size bigint, path string")


def search(asks: list[str], offers: list[str], dim: int, k: int) -> list[Best]:
    """The best of the queries in some files among the candidates in others."""
    asked = [Vectors.unpack(get_file(path), dim) for path in asks]
    kinds = ([v for v in asked if v.most < np.inf], [v for v in asked if v.most == np.inf])
    best = [Best(Vectors.joined(some), k) for some in kinds if some]
    for path in offers:
        v = Vectors.unpack(get_file(path), dim)
        for i in range(0, len(v.ids), COLUMNS):
            for b in best:
                b.add(v[i : i + COLUMNS])
    return best


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, scale: float = 64.0) -> DataFrame:
    """``query_id, rank, vec_id, score, exact`` of the ``k`` highest inner products for each row whose id is divisible by ``every``.

    Components become ``floor(scale * x)``, whole numbers of any size. All rows but the query's own are candidates; ties
    go to the smaller id, a null id being the largest; fewer candidates give fewer ranks. Null vectors and those with null
    or non-finite components take no part; vectors meet those of their own length only. A null id is no query. Repeated
    rows are queries and candidates of their own. Ranks follow the exact scores; a score that is no long is null, and
    ``exact`` spells it. An empty table gives no row; other columns are not read.
    """
    spark = vectors.sparkSession
    base = shared_dir(spark, "topk")
    files = written(_packed(vectors, base, id_col, vector_col, scale, every), "topk-files")
    total, asked = files.agg(F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("size"))), F.lit(0)), F.coalesce(F.sum(F.when(F.col("kind") == 0, F.col("size"))), F.lit(0))).first()
    turns = max(1, -(-asked // TURN))
    # fewer candidates a task where the turns are fewer than the cores
    group = max(1, min(GROUP, total * turns // (2 * spark.sparkContext.defaultParallelism) + 1))
    upto = F.sum("size").over(Window.partitionBy("dim", "kind").orderBy("path")) - F.col("size")
    cut = files.withColumn("g", F.floor(upto / F.when(F.col("kind") == 0, TURN).otherwise(group)))
    lists = cut.groupBy("dim", "kind", "g").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    asks, offers = (lists.where(F.col("kind") == i).select("dim", F.col("paths").alias(name)) for i, name in ((0, "asks"), (1, "offers")))
    cells = written(asks.join(offers, "dim"), "topk-cells")
    n = max(1, cells.count())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, mine, theirs in zip(*(batch.column(c).to_pylist() for c in ("dim", "asks", "offers")), strict=True):
                best = search(mine, theirs, dim, k)
                for b in best:
                    yield b.rows()
        release()

    found = cells.repartition(n).mapInArrow(work, "query_id bigint, row bigint, vec_id bigint, score bigint, exact string, key string")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), F.col("key").desc(), F.col("vec_id").asc_nulls_last())
    ranked = written(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "topk-best")
    drop_written(spark, base)
    return ranked.select("query_id", "rank", "vec_id", F.when(F.col("exact").isNull(), F.col("score")).alias("score"), "exact")
