"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints within ``RADIUS`` bits agree in one of ``RADIUS + 1`` bit blocks, so each goes to a group per block. Where
so few bits would make groups of a large corpus too long, more blocks are cut and several of them make a key: of ``b``
blocks in ``g`` parts at least ``b - RADIUS`` agree, so that many that some part has ``t`` of them. In a group fingerprints are sorted by Gray rank, where neighbours share bits; nodes over runs of them hold the bits that all below
have in common as a mask and a pattern. Two nodes are compared by the differences of their common bits: these only grow
on the way down, and beyond ``RADIUS`` the whole pair of subtrees is left out. Leaves that link are joined by union-find
on the spot, so that a group gives at most one link a fingerprint, however many of its pairs are near.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_pieces, kept_rows, written

SHINGLE, RADIUS, SEED, FANOUT = 4, 4, 42, 8
#: Fingerprints that one meets in its group at about the cost of one more group.
MEETS = 5000
#: Rows of a block group that one task takes at most; larger groups are cut and each pair of parts is a task's work.
GROUP = 100_000


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The hash of each word shingle, repeats included; that of the whole text if it has fewer words, none without words."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[min(shingle, len(words)) - 1 :]
    return np.array([h(whole[a:b], SEED) for a, b in zip(start[: len(stop)].tolist(), stop.tolist(), strict=True)], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits: bit i is set if it is set in over half of the hashes; 0 of none."""
    ones = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The bits that are set in over half of the shingles' hashes; 0 without words."""
    return majority(shingle_hashes(text, shingle))


def with_fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with its texts' fingerprints as a signed long of the same bits. Null texts have no words."""
    from pyspark.sql.types import LongType, StructField, StructType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_pieces(batches, text_col, 4 << 20):
            fps = np.array([fingerprint(t, shingle) for t in batch.column(text_col).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, name])

    return docs.mapInArrow(work, StructType([*docs.schema.fields, StructField(name, LongType())]))


def keys(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of bits: two words that differ in at most ``radius`` bits are equal under one of them, at least.

    Of all cuts into blocks that which makes least work of ``n`` words: those shuffled, and what they meet in their groups.
    """
    best: tuple[float, list[int]] | None = None
    for b in range(radius + 1, min(64, 5 * radius + 1) + 1):
        cut = [64 * i // b for i in range(b + 1)]
        masks = [(1 << z) - (1 << a) for a, z in zip(cut, cut[1:], strict=False)]
        for g in range(1, b + 1):
            t = (b - radius - 1) // g + 1
            parts = [masks[i::g] for i in range(g)]
            number = sum(comb(len(p), t) for p in parts)
            if 0 < number <= 512:
                cost = number * (1 + n / 2 ** (64 * t / b) / MEETS)
                if best is None or cost < best[0]:
                    best = cost, [sum(c) for p in parts for c in combinations(p, t)]
    return best[1]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def near_forest(group: np.ndarray, fp: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For rows sorted by group, the smallest row of the same group reachable over links of at most ``radius`` bits."""
    n = len(fp)
    order = np.lexsort((gray_rank(fp), group))
    g, f = group[order], fp[order]
    # levels of (first child, stop, mask, pattern); the lowest are the rows
    levels = [(np.arange(n), np.arange(n) + 1, np.full(n, ~np.uint64(0)), f)]
    owner = g
    while True:
        m = len(owner)
        start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        size = np.diff(np.r_[start, m])
        if size.max() == 1:
            break
        per = -(-size // FANOUT)
        first = np.repeat(start, per) + FANOUT * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        stop = np.minimum(first + FANOUT, np.repeat(start + size, per))
        _, _, mask, pattern = levels[-1]
        ones, some = np.bitwise_and.reduceat(pattern, first), np.bitwise_or.reduceat(pattern, first)
        levels.append((first, stop, np.bitwise_and.reduceat(mask, first) & ~(ones ^ some), ones))
        owner = owner[first]
    parent = np.arange(n)

    def join(a: np.ndarray, b: np.ndarray) -> None:
        """Union of the rows a[i] and b[i]: hook the larger root to the smaller, shorten, again until nothing changes."""
        while True:
            ra, rb = parent[a], parent[b]
            differ = ra != rb
            if not differ.any():
                return
            a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
            np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent[:] = up

    roots = np.arange(len(levels[-1][0]))
    todo = [(len(levels) - 1, roots[i : i + 4096], roots[i : i + 4096]) for i in range(0, len(roots), 4096)]
    while todo:
        level, a, b = todo.pop()
        if level == 0:
            join(a, b)
            continue
        first, stop, _, _ = levels[level]
        _, _, mask, pattern = levels[level - 1]
        i, j = np.divmod(np.arange(FANOUT * FANOUT), FANOUT)
        ca, cb = (first[a][:, None] + i).ravel(), (first[b][:, None] + j).ravel()
        ok = (ca < np.repeat(stop[a], len(i))) & (cb < np.repeat(stop[b], len(i)))
        ok &= (ca < cb) if level == 1 else (ca <= cb)
        ca, cb = ca[ok], cb[ok]
        differ = np.bitwise_count((pattern[ca] ^ pattern[cb]) & mask[ca] & mask[cb])
        ca, cb = ca[differ <= radius], cb[differ <= radius]
        todo += [(level - 1, ca[k : k + 4096], cb[k : k + 4096]) for k in range(0, len(ca), 4096)]
    low = np.full(n, n)
    np.minimum.at(low, parent, order)  # the smallest original row of each tree
    out = np.empty(n, dtype=np.int64)
    out[order] = low[parent]
    return out


def links(classes: DataFrame, radius: int = RADIUS, group: int = GROUP, rows: int | None = None) -> DataFrame:
    """Links ``a > b`` between class ids that connect every class within reach, from ``rep, fp`` (distinct fingerprints; ``rows`` of them)."""
    masks = keys(classes.count() if rows is None else rows, radius)
    each = classes.select("rep", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks])).alias("block", "bits"))
    large = each.groupBy("block", "bits").count().where(F.col("count") > group).select("block", "bits", F.ceil(F.col("count") / group).alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    cells = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda i: F.least(i, part) * F.col("parts") + F.greatest(i, part)))
    each = each.join(written(large, "simhash-large"), ["block", "bits"], "left").withColumn("cell", F.explode(cells))
    key = ["block", "bits", "cell"]
    sorted_ = each.select(*key, "rep", "fp").repartition(*key).sortWithinPartitions(*key)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(rows: list[np.ndarray]) -> pa.RecordBatch:
            block, bits, cell, rep, fp = (np.concatenate(x) for x in zip(*rows, strict=True))
            change = np.r_[True, (block[1:] != block[:-1]) | (bits[1:] != bits[:-1]) | (cell[1:] != cell[:-1])]
            low = near_forest(np.cumsum(change), fp.view(np.uint64), radius)
            a, b = rep, rep[low]
            differ = a != b
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)[differ]), pa.array(np.minimum(a, b)[differ])], names=["a", "b"])

        held: list = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*key, "rep", "fp")]
            held.append(cols)
            if sum(len(c[0]) for c in held) >= group:  # keep the last, perhaps unfinished group
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = (whole[0] == whole[0][-1]) & (whole[1] == whole[1][-1]) & (whole[2] == whole[2][-1])
                cut = int(np.argmax(last))
                if cut:
                    yield solve([[c[:cut] for c in whole]])
                held = [[c[cut:] for c in whole]]
        if held and sum(len(c[0]) for c in held):
            yield solve(held)

    return sorted_.mapInArrow(work, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) of every node with a link; alternating large and small stars, each round a written table."""
    stars = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    for _ in range(100):
        # large star: a node's larger neighbours go to its smallest one
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        stars = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = stars.groupBy("a").agg(F.min("b").alias("m"))
        moved = stars.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        stars = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError("no fixed point in 100 rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, row_col: str | None = None) -> DataFrame:
    """``doc_id, fp, component_id`` of every row (and ``row``, if ``row_col`` names one).

    Rows whose fingerprints differ in at most ``radius`` bits are linked; ``component_id`` is the smallest id reachable, itself
    included. Null and wordless texts have fingerprint zero and link like any other. Repeated rows share their id and
    component; null ids take part but never name a component (it is null if no other id is in it); an empty table gives no row. Ids are
    integers. Other columns are not read.
    """
    keep = [F.col(id_col).cast("long").alias("doc_id"), *([F.col(row_col).alias("row")] if row_col else [])]
    prints = with_fingerprints(docs.select(*keep, F.col(text_col).alias("text")), "text", "fp", shingle).drop("text")
    return linked(written(prints, "simhash-prints"), radius)


def linked(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (a table with ``doc_id, fp``) with ``component_id``."""
    # classes are named by their own fingerprint here, as ids may be null
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("rep"), "fp", "least"), "simhash-classes")
    trees = written(components(links(classes, radius)), "simhash-trees")
    of = classes.join(trees, classes.rep == trees.node, "left").select("fp", "least", F.coalesce("component", "rep").alias("c"))
    named = of.groupBy("c").agg(F.min("least").alias("component_id"))
    return prints.join(of.join(named, "c").select("fp", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that with the smallest id (the first row read, if ids repeat); the columns of ``docs``."""
    row = free_name(docs.columns, "simhash_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    found = written(near_duplicates(numbered, id_col, text_col, shingle, radius, row), "simhash-found")
    # components without any id are kept apart by their fingerprints' class
    stay = found.groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("f")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "row")).alias("x")).select(F.col("x.row").alias(row))
    return kept_rows(numbered, row, stay).select(*docs.columns)
