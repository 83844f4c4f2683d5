"""Near copies by SimHash, confirmed and completed by exact Jaccard similarity of word shingles.

SimHash comes first: texts whose fingerprints are connected within its radius are compared with the first text of their
component over their whole sets, and those that hold are linked. It misses most pairs that are only just similar enough,
so a prefix filter over all sets adds what it left out; what SimHash linked is not compared again.

Two sets whose Jaccard similarity is at least ``T`` share one of the first ``n - ceil(T n) + 1`` elements of each, in any
order of all shingles that both follow (prefix filter). Shingles are ordered by how often their bucket of a table of fixed
size occurs, so that groups by a shingle are small. In a group, pairs of sizes that allow ``T`` are verified over their
whole sets unless they are linked already, so that a group of near copies takes a comparison a text, not one a pair.
Shingles are known by 48 bits of their hashes; only equal hashes of different shingles could change a similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, filesystem, free_name, get_file, in_pieces, kept_rows, put_file, release, shared_dir, written
from . import simhash
from .simhash import components

SHINGLE = 5
#: The least similarity of near copies, as numerator and denominator.
T = (4, 5)
#: Bytes of a hash; buckets of the table of counts and its slices.
WIDTH, BUCKETS, SLICES = 6, 1 << 22, 64
#: Shingles of a task that reads sets, prefix elements of a part, members from which a group isn't listed as pairs, shingles held.
READ, PART, LISTED, HELD = 4_000_000, 1_000_000, 32, 4_000_000
_LOW, _AT = np.uint64((1 << 48) - 1), (1 << 36) - 1


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; that of the whole text if it has fewer words."""
    return np.unique(simhash.shingle_hashes(text, shingle) & _LOW)


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // WIDTH, 8), dtype=np.uint8)
    out[:, :WIDTH] = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH)
    return out.view("<u8").ravel()


class Sets:
    """Reads sets by place: the number of the file above 36 bits, the first hash in it below."""

    def __init__(self, base: str):
        self.base, self.files, self.sets, self.size = base, {}, {}, 0

    def read(self, loc: int, n: int) -> np.ndarray:
        part = loc >> 36
        if part not in self.files:
            if len(self.files) >= 64:
                self.files.clear()
            fs, path = filesystem(f"{self.base}/{part}")
            self.files[part] = fs.open_input_file(path)
        return unpacked(self.files[part].read_at(n * WIDTH, (loc & _AT) * WIDTH))

    def __call__(self, loc: int, n: int) -> np.ndarray:
        """The set, kept for the next time."""
        if loc not in self.sets:
            if self.size > HELD:
                self.sets.clear()
                self.size = 0
            self.sets[loc] = self.read(loc, n)
            self.size += n
        return self.sets[loc]


def with_sets(docs: DataFrame, base: str, text_col: str, shingle: int) -> DataFrame:
    """``docs`` without the text but with its SimHash fingerprint and the place, size and digest of its set, which goes to a file of the task."""
    from pyspark.sql.types import StructType

    rest = [c for c in docs.columns if c != text_col]
    schema = StructType([docs.schema[c] for c in rest]).add("loc", "long").add("n", "integer").add("digest", "binary").add("fp", "long")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from xxhash import xxh3_128_digest

        part, at = TaskContext.get().partitionId(), 0
        fs, path = filesystem(f"{base}/{part}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own = f"{path}.{uuid4().hex}.tmp"
        with fs.open_output_stream(own) as out:
            for batch in in_pieces(batches, text_col, 4 << 20):
                loc, n, digest, fp = [], [], [], []
                for t in batch.column(text_col).to_pylist():
                    hashes = simhash.shingle_hashes(t, shingle)
                    fp.append(simhash.majority(hashes))
                    s = np.unique(hashes & _LOW)
                    data = packed(s)
                    out.write(data)
                    loc.append(part << 36 | at if len(s) else -1)
                    n.append(len(s))
                    digest.append(xxh3_128_digest(data))
                    at += len(s)
                arrays = [*[batch.column(c) for c in rest], pa.array(loc, pa.int64()), pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.array(np.array(fp, dtype=np.uint64).view(np.int64))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "loc", "n", "digest", "fp"])
        fs.move(own, path)

    return docs.mapInArrow(work, schema)


def similar_enough(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets have a similarity of ``T``."""
    both = np.concatenate([x, y])
    both.sort()
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared * (T[0] + T[1]) >= T[0] * len(both)


def simhash_links(classes: DataFrame, base: str) -> DataFrame:
    """Links ``a, b`` of similarity ``T`` between sets ``loc, n, fp`` and the first of their component by SimHash."""
    prints = classes.where("n > 0").select("loc", "n", "fp")
    reps = written(prints.groupBy("fp").agg(F.min("loc").alias("rep")).select("rep", "fp"), "similar-prints")
    trees = written(components(simhash.links(reps)), "similar-near")
    first = reps.join(trees, reps.rep == trees.node, "left").select("fp", F.coalesce("component", "rep").alias("b"))
    near = prints.select(F.col("loc").alias("a"), F.col("n").alias("a_n"), "fp").join(first, "fp").where("a <> b")
    near = near.join(prints.select(F.col("loc").alias("b"), F.col("n").alias("b_n")), "b").select("a", "a_n", "b", "b_n")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(base)
        for batch in batches:
            a, a_n, b, b_n = (batch.column(c).to_pylist() for c in ("a", "a_n", "b", "b_n"))
            hold = [similar_enough(sets.read(p, i), sets(q, j)) for p, i, q, j in zip(a, a_n, b, b_n, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(hold, pa.bool_()))

    # a component's pairs are many tasks' work
    return near.repartition("a", "b").sortWithinPartitions("b").mapInArrow(work, "a bigint, b bigint")


def bucket_counts(sets: DataFrame, base: str) -> str:
    """The file with the count of each bucket over all sets (``loc, n``), up to 65535."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, total = Sets(base).read, np.zeros(BUCKETS, dtype=np.int32)
        for batch in batches:
            held, size = [], 0
            for loc, n in zip(batch.column("loc").to_pylist(), batch.column("n").to_pylist(), strict=True):
                held.append(read(loc, n) & np.uint64(BUCKETS - 1))
                size += n
                if size > READ // 4:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS).astype(np.int32)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=BUCKETS).astype(np.int32)
        if total.any():
            cut = np.minimum(total, 65535).astype("<u2").reshape(SLICES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in cut], pa.binary())], names=["slice", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, data in zip(batch.column("slice").to_pylist(), batch.column("data").to_pylist(), strict=True):
                x = np.frombuffer(pa.decompress(data, BUCKETS // SLICES * 2, "zstd"), dtype="<u2").astype(np.int64)
                sums[k] = np.minimum(sums.get(k, 0) + x, 65535)
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int32()), pa.array([x.astype("<u2").tobytes() for x in sums.values()], pa.binary())], names=["slice", "data"])

    form = "slice int, data binary"
    whole = np.zeros((SLICES, BUCKETS // SLICES), dtype="<u2")
    for r in sets.mapInArrow(count, form).repartition(SLICES // 4, "slice").mapInArrow(add, form).collect():
        whole[r["slice"]] = np.frombuffer(bytes(r["data"]), dtype="<u2")
    put_file(f"{base}/counts", whole.tobytes())
    return f"{base}/counts"


def prefixes(sets: DataFrame, base: str, counts: str, parts: int) -> DataFrame:
    """The prefix elements of all sets ``loc, n, known``, by part and packed: ``part, k`` and the elements, places, sizes and known components."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, table = Sets(base).read, None
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            x, loc, n, known = (np.concatenate(c) for c in zip(*held, strict=True))
            part = (x % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, x, loc, n, known = part[order], x[order], loc[order], n[order], known[order]
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist()
            data = [pa.compress(packed(x[a:b]) + loc[a:b].tobytes() + n[a:b].tobytes() + known[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(cut, cut[1:], strict=False)]
            return pa.RecordBatch.from_arrays([pa.array(part[cut[:-1]]), pa.array(np.diff(cut).astype(np.int32)), pa.array(data, pa.binary())], names=["part", "k", "data"])

        for batch in batches:
            if table is None:
                table = np.frombuffer(get_file(counts), dtype="<u2").astype(np.uint64) << np.uint64(48)
            for loc, n, known in zip(*(batch.column(c).to_pylist() for c in ("loc", "n", "known")), strict=True):
                s = read(loc, n)
                first = n - -(-n * T[0] // T[1]) + 1
                x = np.partition(table[(s & np.uint64(BUCKETS - 1)).astype(np.int64)] | s, first - 1)[:first] & _LOW
                held.append((x, np.full(first, loc, dtype=np.int64), np.full(first, n, dtype=np.int32), np.full(first, known, dtype=np.int64)))
                size += first
                if size >= PART:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        release()

    return sets.mapInArrow(work, "part int, k int, data binary")


def linked_pairs(x: np.ndarray, loc: np.ndarray, n: np.ndarray, sets: Sets, listed: int = LISTED, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of similarity ``T`` between places that share an element, enough to connect all that are linked with what is
    connected already (``known``: each place's component)."""
    order = np.lexsort((loc, x))
    x, loc, n, known = x[order], loc[order], n[order].astype(np.int64), None if known is None else known[order]
    start = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, dtype=np.int64)
    size = np.diff(np.r_[start, len(x)])
    names, at = np.unique(loc, return_inverse=True)
    sizes = np.zeros(len(names), dtype=np.int64)
    sizes[at] = n
    parent, out, failed = list(range(len(names))), [], set()
    if known is not None:
        of = np.zeros(len(names), dtype=np.int64)
        of[at] = known
        _, first, which = np.unique(of, return_index=True, return_inverse=True)
        parent = first[which].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def test(i: int, j: int) -> None:
        a, b = root(i), root(j)
        if a == b or (min(i, j), max(i, j)) in failed:
            return
        p, q = (int(names[k]) for k in (i, j))
        if similar_enough(sets(p, int(sizes[i])), sets(q, int(sizes[j]))):
            parent[max(a, b)] = min(a, b)
            out.append((p, q))
        else:
            if len(failed) > 1_000_000:
                failed.clear()
            failed.add((min(i, j), max(i, j)))

    for s, k in zip(start[size > listed].tolist(), size[size > listed].tolist(), strict=True):
        members = at[s : s + k]
        members = members[np.argsort(sizes[members], kind="stable")]
        roots = np.array([root(m) for m in members.tolist()])
        stops = np.searchsorted(sizes[members], sizes[members] * T[1] // T[0], "right").tolist()
        for i, stop in enumerate(stops):
            if (roots[i:] == roots[i]).all():  # earlier members are done with
                break
            links_before = len(out)
            for j in (i + np.flatnonzero(roots[i:stop] != roots[i])).tolist():
                test(int(members[i]), int(members[j]))
            if len(out) > links_before:
                roots = np.array([root(m) for m in members.tolist()])
    small = np.repeat((size > 1) & (size <= listed), size)
    x, at = x[small], at[small]
    pairs = []
    for d in range(1, listed):
        i = np.flatnonzero(x[d:] == x[:-d])
        if not len(i):
            break
        a, b = at[i], at[i + d]
        fits = np.minimum(sizes[a], sizes[b]) * T[1] >= np.maximum(sizes[a], sizes[b]) * T[0]
        pairs.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[fits])
    if pairs:
        for i, j in np.unique(np.concatenate(pairs), axis=0).tolist():
            test(i, j)
    return out


def links(parts: DataFrame, base: str, count: int) -> DataFrame:
    """Links ``a, b`` between places, from the parts of ``prefixes``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(base)

        def solve(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            x, loc, n, known = [], [], [], []
            for k, data in rows:
                data = pa.decompress(data, k * (WIDTH + 20), "zstd", asbytes=True)
                x.append(unpacked(data[: k * WIDTH]))
                loc.append(np.frombuffer(data, dtype=np.int64, count=k, offset=k * WIDTH))
                n.append(np.frombuffer(data, dtype=np.int32, count=k, offset=k * (WIDTH + 8)))
                known.append(np.frombuffer(data, dtype=np.int64, count=k, offset=k * (WIDTH + 12)))
            found = linked_pairs(*map(np.concatenate, (x, loc, n)), sets, known=np.concatenate(known))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([q for _, q in found], pa.int64())], names=["a", "b"])

        held, now = [], None
        for batch in batches:
            for part, k, data in zip(*(batch.column(c).to_pylist() for c in ("part", "k", "data")), strict=True):
                if held and part != now:
                    yield solve(held)
                    held = []
                held.append((k, data))
                now = part
        if held:
            yield solve(held)
        release()

    return parts.repartition(count, "part").sortWithinPartitions("part").mapInArrow(work, "a bigint, b bigint")


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component of texts with a Jaccard similarity of at least ``T``, that with the smallest id (the
    first row read, if ids repeat; null ids last); the columns of ``docs``. Wordless and null texts are alike. Texts are taken
    whole, however long; an empty table gives no row."""
    spark = docs.sparkSession
    row = free_name(docs.columns, "similar_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "similar-docs")
    base = shared_dir(spark, "similar-sets")
    of = with_sets(numbered.select(F.col(row).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), base, "text", shingle)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("best")
    of = written(of, "similar-digests")  # once, as its tasks write files
    classes = written(of.groupBy("digest").agg(best, F.min("loc").alias("loc"), F.first("n").alias("n"), F.first("fp").alias("fp")).drop("digest"), "similar-classes")
    near = written(simhash_links(classes, base), "similar-simhash")
    known = written(components(near), "similar-known")
    total = classes.agg(F.sum("n")).first()[0] or 0
    tasks = -(-total // READ) + 1
    sets = classes.where("n > 0").join(known, F.col("loc") == F.col("node"), "left").select("loc", "n", F.coalesce("component", "loc").alias("known"))
    sets = written(sets.repartitionByRange(max(tasks, 12), "loc").sortWithinPartitions("loc"), "similar-order")
    parts = max(12, -(-total // (5 * PART)))
    found = links(prefixes(sets, base, bucket_counts(sets, base), parts), base, parts)
    trees = written(components(near.unionByName(found)), "similar-trees")
    stay = classes.join(trees, classes.loc == trees.node, "left").groupBy(F.coalesce("component", "loc").alias("c")).agg(F.min("best").alias("best"))
    stay = written(stay.select(F.col("best.row").alias(row)), "similar-stay")
    drop_written(spark, base)
    return kept_rows(numbered, row, stay).select(*docs.columns)
