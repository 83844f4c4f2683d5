"""Near copies by SetSketch registers: banded, estimated jointly by likelihood, then verified.

A set's sketch has ``M`` registers. Each is the least of an exponential variable of each element, on a scale of powers of
``BASE`` and truncated to ``0..Q + 1``: so the registers of a union are the larger ones of its parts, and two registers
are equal with a probability that grows with the sets' similarity. Elements draw their variables as the arrival times of
one Poisson process each, which deals every arrival to a random register; a process is followed until it is later than
all registers of its set.

Sets that agree in all registers of some band meet. Each group's first set meets all others as pairs; groups whose sets are
then still in several components are searched by blocks, but only for pairs of different components. A pair's registers
(above, below, equal) and the sets' known sizes have a likelihood in the intersection, whose maximum says whether the
pair is worth a comparison of the whole sets, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_written, filesystem, in_pieces, kept_rows, release, rows_of, shared_dir, written
from .simhash import components

SHINGLE, SEED = 4, 42
#: The least similarity of linked sets, as numerator and denominator.
LEAST = (80, 100)
#: Registers, those of a band, base of their scale, its zero point and their largest value. At a similarity of 0.8 a band agrees
#: with probability 0.26 at least, and 48 bands miss a pair with one of 4e-7.
BANDS, BAND, BASE, SCALE, Q = 48, 6, 1.001, 20.0, (1 << 16) - 2
M = BANDS * BAND
#: Estimates below are no candidates: 5 standard deviations of the error at 0.8, which is as rare as a pair that no band has.
CUT = 0.68
#: Bytes of a stored hash and of what stands before a set, sets of a task's block on either side, hashes that a task holds, pairs of a task.
WIDTH, HEAD, FEW, MANY, HELD, PAIRS = 6, 8 + 2 * M, 256, 4096, 8_000_000, 20_000
_AT = (1 << 36) - 1


def shingles(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's word shingles; that of the whole sequence if it has fewer words."""
    from xxhash import xxh64_intdigest as h

    words = (text or b"").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    whole = b" ".join(words)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    start = np.cumsum(size + 1) - size - 1
    stop = (start + size)[min(shingle, len(words)) - 1 :]
    return np.unique(np.array([h(whole[a:b], SEED) for a, b in zip(start[: len(stop)].tolist(), stop.tolist(), strict=True)], dtype=np.uint64))


def _random(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The registers of each set, a row each; zeros for an empty set."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    least = np.full((len(sets), M), np.inf)
    x = np.concatenate([*sets, np.zeros(0, dtype=np.uint64)])
    owner, time, turn = np.repeat(np.arange(len(sets)), size), np.zeros(len(x)), 0
    while len(x):
        begin = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        rows = owner[begin]
        some = int(np.clip(M * len(rows) // len(x), 1, 256))  # arrivals of each element, by how many registers wait for it
        steps = np.arange(turn + 1, turn + some + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        turn += some
        u = _random(x[:, None] + steps)
        times = np.concatenate([time[:, None], -np.log(((u >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / M], axis=1).cumsum(axis=1)[:, 1:]
        register = ((u & np.uint64(4095)) * np.uint64(M) >> np.uint64(12)).astype(np.int64)
        np.minimum.at(least.reshape(-1), (owner[:, None] * M + register).ravel(), times.ravel())
        time = times[:, -1]
        go = time < np.repeat(least[rows].max(axis=1), np.diff(np.r_[begin, len(owner)]))
        x, owner, time = x[go], owner[go], time[go]
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(least / SCALE) / np.log(BASE)), 0, Q + 1).astype(np.uint16)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A hash of each band's number and registers, a row for each set."""
    r = registers.reshape(len(registers), BANDS, BAND).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), r.shape[:2]).copy()
    for i in range(BAND):
        key = _random(key * np.uint64(0x9E3779B97F4A7C15) + r[:, :, i])
    return key.view(np.int64)


def estimates(above: np.ndarray, below: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The similarities of greatest likelihood: of sets of sizes ``n`` and ``m`` of whose registers ``above`` are larger in the first, ``below`` in the second.

    The likelihood's logarithm is concave in the similarity, so its slope is halved in on.
    """
    u, v = n / (n + m), m / (n + m)
    part, log = (BASE - 1) / BASE, np.log(BASE)
    equal = M - above - below
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(30):
        j = (low + high) / 2
        a, b = 1 - part * np.maximum(u - v * j, 0), 1 - part * np.maximum(v - u * j, 0)
        pa_, pb = -np.log(a) / log, -np.log(b) / log
        da, db = -part * v / a / log, -part * u / b / log
        tiny = 1e-300
        slope = above * da / np.maximum(pa_, tiny) + below * db / np.maximum(pb, tiny) - equal * (da + db) / np.maximum(1 - pa_ - pb, tiny)
        up = slope > 0
        low, high = np.where(up, j, low), np.where(up, high, j)
    return (low + high) / 2


class Stored:
    """Reads sets and sketches by place: the number of the file above 36 bits, the position in it below."""

    def __init__(self, base: str):
        self.base, self.files, self.heads, self.sets, self.size = base, {}, {}, {}, 0

    def _read(self, loc: int, skip: int, size: int) -> bytes:
        part = loc >> 36
        if part not in self.files:
            if len(self.files) >= 64:
                self.files.clear()
            fs, path = filesystem(f"{self.base}/{part}")
            self.files[part] = fs.open_input_file(path)
        return self.files[part].read_at(size, (loc & _AT) + skip)

    def head(self, locs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and registers, kept for a while."""
        if len(self.heads) > 4 * MANY:
            self.heads.clear()
        for loc in locs:
            if loc not in self.heads:
                self.heads[loc] = self._read(loc, 0, HEAD)
        data = np.frombuffer(b"".join(self.heads[loc] for loc in locs), dtype=np.uint8).reshape(-1, HEAD)
        return data[:, :8].copy().view("<i8").ravel(), data[:, 8:].copy().view("<u2")

    def whole(self, loc: int, n: int) -> np.ndarray:
        """The hashes, kept for a while."""
        if loc not in self.sets:
            if self.size > HELD:
                self.sets.clear()
                self.size = 0
            out = np.zeros((n, 8), dtype=np.uint8)
            out[:, :WIDTH] = np.frombuffer(self._read(loc, HEAD, n * WIDTH), dtype=np.uint8).reshape(-1, WIDTH)
            self.sets[loc] = out.view("<u8").ravel()
            self.size += n
        return self.sets[loc]

    def similar(self, a: int, b: int, n: int, m: int) -> bool:
        """Whether two whole sets are."""
        both = np.concatenate([self.whole(a, n), self.whole(b, m)])
        both.sort()
        shared = int(np.count_nonzero(both[1:] == both[:-1]))
        return LEAST[1] * shared >= LEAST[0] * (n + m - shared)


def likely(n: np.ndarray, m: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The estimates of pairs whose sizes allow the similarity; -1 for others and those below ``CUT``."""
    out = np.full(len(n), -1.0)
    ok = np.flatnonzero(LEAST[1] * np.minimum(n, m) >= LEAST[0] * np.maximum(n, m))
    out[ok] = estimates(above[ok], below[ok], n[ok], m[ok])
    return np.where(out >= CUT, out, -1.0)


def with_sketches(docs: DataFrame, base: str, text_col: str, shingle: int) -> DataFrame:
    """``docs`` without the text but with ``n, loc, digest, keys`` of its set; sketch and set go to a file of the task."""
    rest = [c for c in docs.columns if c != text_col]
    schema = T.StructType([docs.schema[c] for c in rest]).add("n", "integer").add("loc", "long").add("digest", "binary").add("keys", T.ArrayType(T.LongType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        from xxhash import xxh3_128_digest

        part, at = TaskContext.get().partitionId(), 0
        fs, path = filesystem(f"{base}/{part}")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        own = f"{path}.{uuid4().hex}.tmp"
        with fs.open_output_stream(own) as out:
            for batch in in_pieces(batches, text_col, 2 << 20):
                sets = [shingles(t, shingle) for t in batch.column(text_col).cast(pa.binary()).to_pylist()]
                registers = sketches(sets)
                keys, loc, digest = band_keys(registers).tolist(), [], []
                for i, s in enumerate(sets):
                    loc.append(part << 36 | at if len(s) else None)
                    digest.append(xxh3_128_digest(s.astype("<u8").tobytes()))
                    if len(s):
                        data = len(s).to_bytes(8, "little") + registers[i].astype("<u2").tobytes() + np.ascontiguousarray(s.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WIDTH]).tobytes()
                        out.write(data)
                        at += len(data)
                    else:
                        keys[i] = None
                arrays = [*[batch.column(c) for c in rest], pa.array([len(s) for s in sets], pa.int32()), pa.array(loc, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, names=[*rest, "n", "loc", "digest", "keys"])
        fs.move(own, path)

    return docs.mapInArrow(work, schema)


def linked(pairs: DataFrame, base: str) -> DataFrame:
    """Of a table of pairs ``a, b`` (places) those whose sets are similar: estimated first, then compared whole."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored = Stored(base)
        for batch in batches:
            keep = []
            for s in range(0, batch.num_rows, 512):
                a, b = (batch.column(c).slice(s, 512).to_pylist() for c in ("a", "b"))
                (n, ra), (m, rb) = stored.head(a), stored.head(b)
                for i in np.flatnonzero(likely(n, m, (ra > rb).sum(1), (ra < rb).sum(1)) >= 0).tolist():
                    if stored.similar(a[i], b[i], int(n[i]), int(m[i])):
                        keep.append(s + i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))
        release()

    tasks = max(12, pairs.count() // PAIRS)
    return pairs.repartitionByRange(tasks, "a", "b").sortWithinPartitions("a", "b").mapInArrow(work, "a bigint, b bigint")


def across(members: DataFrame, base: str) -> DataFrame:
    """Links ``a, b`` between different components of a group.

    ``members`` has ``key, leader, loc, c`` of the groups that aren't one component. One of a pair is outside the leader's
    component; those are few, and their blocks meet the blocks of all. A pair is looked at in the first band that it agrees in,
    and as long as its components aren't linked there: so it is compared once at most.
    """
    lead = members.where("loc = leader").select("key", F.col("c").alias("lead"))
    members = members.join(lead, "key").withColumn("asks", F.col("c") != F.col("lead"))
    sizes = written(members.groupBy("key").agg(F.count_if("asks").alias("few"), F.count("*").alias("many")), "setsketch-sizes")
    tasks = max(12, int(sizes.agg(F.sum(F.col("few").cast("double") * F.col("many"))).first()[0] or 0) // (PAIRS * 25))
    blocks = sizes.select("key", F.ceil(F.col("few") / FEW).alias("few"), F.ceil(F.col("many") / MANY).alias("many"))
    placed = members.join(blocks, "key").withColumn("f", F.pmod(F.xxhash64("loc"), F.col("few"))).withColumn("w", F.pmod(F.xxhash64("loc", F.lit(1)), F.col("many")))
    upto = lambda x: F.sequence(F.lit(0).cast("long"), F.col(x) - 1)
    row = ["key", "f", "w", "asked", "loc", "c", "asks"]
    asking = placed.where("asks").withColumn("w", F.explode(upto("many"))).withColumn("asked", F.lit(False)).select(row)
    asked = placed.withColumn("f", F.explode(upto("few"))).withColumn("asked", F.lit(True)).select(row)
    cells = asking.unionByName(asked).repartition(tasks, "key", "f", "w").sortWithinPartitions("key", "f", "w", "asked", "loc")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stored, now, ask, held = Stored(base), None, [], []

        def solve() -> Iterator[pa.RecordBatch]:
            if not (ask and held):
                return
            (la, ca, _), (lb, cb, minor) = (tuple(np.array(x) for x in zip(*rows, strict=True)) for rows in (ask, held))
            (na, ra), (nb, rb) = stored.head(la.tolist()), stored.head(lb.tolist())
            band = int(np.flatnonzero(band_keys(ra[:1])[0] == now[0])[0])
            names, of = np.unique(np.r_[ca, cb], return_inverse=True)
            root, ia, ib = np.arange(len(names)), of[: len(ca)], of[len(ca) :]
            cut, out = rb.reshape(len(rb), BANDS, BAND), []
            for i in range(len(la)):
                # of two that both ask, the smaller one's question counts
                ok = np.flatnonzero((root[ib] != root[ia[i]]) & (~minor | (lb > la[i])))
                if not len(ok):
                    continue
                agree = (cut[ok] == ra[i].reshape(BANDS, BAND)).all(axis=2)
                ok = ok[agree.argmax(axis=1) == band]
                similarity = likely(np.full(len(ok), na[i]), nb[ok], (ra[i] > rb[ok]).sum(1), (ra[i] < rb[ok]).sum(1))
                for k in np.argsort(-similarity, kind="stable")[: int((similarity >= 0).sum())].tolist():
                    j = int(ok[k])
                    if root[ib[j]] != root[ia[i]] and stored.similar(int(la[i]), int(lb[j]), int(na[i]), int(nb[j])):
                        out.append((int(la[i]), int(lb[j])))
                        root[root == root[ib[j]]] = root[ia[i]]
            if out:
                yield rows_of("a bigint, b bigint", out)

        for batch in batches:
            for key, f, w, is_asked, loc, c, asks in zip(*(batch.column(x).to_pylist() for x in row), strict=True):
                if (key, f, w) != now:
                    yield from solve()
                    now, ask, held = (key, f, w), [], []
                (held if is_asked else ask).append((loc, c, asks))
        yield from solve()
        release()

    return cells.mapInArrow(work, "a bigint, b bigint")


def similar_links(classes: DataFrame, base: str) -> DataFrame:
    """Links ``a, b`` between the places of similar sets from ``loc, keys`` (distinct sets), enough to connect all that are linked."""
    bands = classes.select("loc", F.explode("keys").alias("key"))
    heads = bands.groupBy("key").agg(F.min("loc").alias("leader"), F.max("loc").alias("last")).where("leader < last").drop("last")
    # one plan at every size
    members = written(bands.join(heads.hint("merge"), "key"), "setsketch-members")
    stars = written(members.where("loc <> leader").select(F.col("leader").alias("a"), F.col("loc").alias("b")).distinct(), "setsketch-pairs")
    first = written(linked(stars, base), "setsketch-stars")
    trees = written(components(first), "setsketch-trees")
    placed = written(members.join(trees, members.loc == trees.node, "left").select("key", "leader", "loc", F.coalesce("component", "loc").alias("c")), "setsketch-placed")
    apart = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.count("*").alias("k")).where("low < high and k > 2").select("key")
    return first.unionByName(written(across(placed.join(apart, "key"), base), "setsketch-across"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row.

    Rows whose sets of word shingles have a similarity of at least ``LEAST`` are linked; ``component_id`` is the smallest id
    reachable, itself included, and ``kept`` says whether that is the row's own. Equal sets are one class and always
    linked. Null and wordless texts have an empty set and no link. Repeated ids are rows of their own that share a component only if
    linked; a null id never names a component (one without any id has null, and its rows are kept); an empty table
    gives no row. Texts are taken whole; ids are integers; other columns are not read.
    """
    spark = docs.sparkSession
    base = shared_dir(spark, "setsketch-sets")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = written(with_sketches(rows, base, "text", shingle), "setsketch-rows")  # once, as its tasks write files
    some = rows.where("n > 0")
    classes = some.groupBy("digest").agg(F.min("doc_id").alias("least"), F.min(F.struct("loc", "row")).alias("one")).select("digest", "least", "one.*")
    classes = written(classes, "setsketch-classes")
    one = kept_rows(some.select("row", "loc", "keys"), "row", classes.select("row"))
    trees = written(components(similar_links(one, base)), "setsketch-components")
    of = classes.join(trees, classes.loc == trees.node, "left").select("digest", "least", F.coalesce("component", "loc").alias("c"))
    named = of.groupBy("c").agg(F.min("least").alias("component_id"))
    found = rows.join(of.join(named, "c").select("digest", "component_id", F.lit(True).alias("linked")), "digest", "left")
    out = found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out = written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "setsketch-out")
    drop_written(spark, base)
    return out
