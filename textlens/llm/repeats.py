"""Removal of passages that repeat across documents, by the sorted suffixes of a document collection.

Every 50-byte string lies in the fragment of its minimizer (the 20-byte string in it with the smallest hash), so equal
strings meet in the fragments of one minimizer, which are at most ``SPAN + RUN - 1`` bytes long. Minimizers that only
one document has are left out first; the fragments of the others are dealt to buckets by minimizer. In a bucket the
fragments are a collection whose suffixes are sorted column by column (see ``bwt``): neighbours with a common prefix of
50 bytes are occurrences of one string, and the smallest document of each run is what its occurrences are told.
So hashing decides only which fragments meet, the sorted suffixes which of their strings are equal.

A minimizer that very many units have (a run of spaces, a line of every file) would bring all its contexts to one
bucket. Its fragments are cut into their single 50-byte strings, which are dealt by their own hashes.

Texts are kept in unit files in the shared folder, written once and read by later passes; between passes only sorted
hashes, fragments and answers are shuffled.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bwt import Collection, sorted_suffixes
from .common import get_file, grouped, in_pieces, put_file, rows_of, shared_dir, unzipped, written, zipped

SPAN, GRAM = 50, 20
#: Strings of 50 bytes in a fragment at most: as many as share one occurrence of a minimizer.
RUN = SPAN - GRAM + 1
#: Bytes of text in a unit file, about how many are dealt to a bucket, and units from which a minimizer's strings are dealt one by one.
UNIT, BUCKET, HOT = 8 << 20, 4 << 20, 2000
#: Fragments that are sorted together, about: small enough for the caches.
STRINGS = 16_000
#: Tasks of a pass at most; beyond, a task takes several buckets or units, one after the other.
TASKS = 1 << 15
BITS = 48
NONE = np.iinfo(np.int64).max


def _hashes(data: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the 20 bytes from each place."""
    w = data.astype(np.uint64)
    for step in (1, 2, 4):  # eight bytes from each place
        w = w[:-step] | (w[step:] << np.uint64(8 * step))
    n = len(data) - GRAM + 1
    h = w[:n] * np.uint64(0x9E3779B97F4A7C15) + w[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F) + w[12 : n + 12] * np.uint64(0x165667B19E3779F9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h >> np.uint64(64 - BITS)


def runs(data: np.ndarray, stops: np.ndarray, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of 50-byte strings with one minimizer: first place, number (``RUN`` at most) and hash; none crosses a document's end in ``stops``."""
    starts, counts, values = [], [], []
    n = len(data) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for a in range(0, n, block):
        z = min(n, a + block)
        m = _hashes(data[a : z + SPAN - 1])
        for step in (1, 2, 4, 8):
            m = np.minimum(m[:-step], m[step:])
        m = np.minimum(m[: z - a], m[RUN - 16 : RUN - 16 + z - a])  # the minimum of 31
        # what changes: the minimum, and the few places where documents end or have no room for another string
        ends = stops[np.searchsorted(stops, a, side="right") : np.searchsorted(stops, z - 1, side="right") + 1]
        last = np.maximum(ends - SPAN + 1, np.r_[0, ends[:-1]])
        change = np.empty(z - a, dtype=bool)
        change[0] = True
        np.not_equal(m[1:], m[:-1], out=change[1:])
        cut = np.r_[ends, last] - a
        change[cut[(cut > 0) & (cut < z - a)]] = True
        first = np.flatnonzero(change)
        size = np.diff(np.r_[first, len(m)])
        fits = stops[np.searchsorted(stops, first + a, side="right")] - first - a >= SPAN
        per = np.where(fits, -(-size // RUN), 0)
        at = np.repeat(first, per) + RUN * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
        starts.append(at + a)
        counts.append(np.minimum(RUN, np.repeat(first + size, per) - at))
        values.append(m[at])
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(values)


def _alike(matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of a byte matrix: the first row of each kind, and the kind of every row."""
    if not len(matrix):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = matrix.view("<u8")
    h = length.astype(np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    order = np.argsort(h, kind="stable")
    new = np.ones(len(order), dtype=bool)
    for a in range(1, len(order), 1 << 16):
        z = min(len(order), a + (1 << 16))
        x, y = order[a:z], order[a - 1 : z - 1]
        new[a:z] = (length[x] != length[y]) | (words[x] != words[y]).any(1)
    kind = np.empty(len(order), dtype=np.int64)
    kind[order] = np.cumsum(new) - 1
    return order[new], kind


WIDTH = -(-(SPAN + RUN - 1) // 8) * 8


def _matrix(view: np.ndarray, at: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Fragments as rows, padded with zeros, from the view of ``WIDTH`` bytes at each place."""
    out = np.zeros((len(at), WIDTH), dtype=np.uint8)
    for a in range(0, len(at), 1 << 16):
        rows = view[at[a : a + (1 << 16)]]
        out[a : a + (1 << 16)] = np.where(np.arange(WIDTH) < (count[a : a + (1 << 16)] + SPAN - 1)[:, None], rows, 0)
    return out


class _Unit:
    """A unit file: documents' ids (null is larger than any), ends and bytes."""

    def __init__(self, ids: np.ndarray, stops: np.ndarray, data: np.ndarray, known: np.ndarray):
        self.ids, self.stops, self.data, self.known = ids, stops, data, known

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> _Unit:
        ids = batch.column("doc_id")
        texts = batch.column("text").cast(pa.large_binary()).fill_null(b"")
        buffers = texts.buffers()
        ends = np.frombuffer(buffers[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(buffers[2], np.uint8)[ends[0] : ends[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
        return cls(ids.fill_null(int(NONE)).to_numpy(zero_copy_only=False), ends[1:] - ends[0], data, ids.is_valid().to_numpy(zero_copy_only=False))

    def put(self, path: str) -> None:
        put_file(path, zipped(self.ids, self.stops, self.data, self.known))

    @classmethod
    def get(cls, path: str) -> _Unit:
        return cls(*unzipped(get_file(path), "<i8", "<i8", "u1", "?"))

    def doc_at(self, at: np.ndarray) -> np.ndarray:
        return self.ids[np.searchsorted(self.stops, at, side="right")]

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Minimizers are small hashes; multiplied by an odd number they are spread evenly again, one to one."""
        at, count, value = runs(self.data, self.stops)
        return at, count, (value * np.uint64(0x9E3779B97F4B)) & np.uint64((1 << BITS) - 1)


PARTS = "unit bigint, bucket bigint, blob binary"


def bucket_bits(total: int) -> int:
    """Buckets are ``2 ** bucket_bits``, so that none is dealt more than about ``BUCKET`` of ``total`` bytes, however many these are."""
    return min(40, max(4, (total // BUCKET).bit_length()))


def _answers(fragments: list[np.ndarray], counts: np.ndarray, docs: np.ndarray) -> list[np.ndarray]:
    """For distinct fragments (taken out of the list) with the smallest document of each: the smallest document of each of their 50-byte strings."""
    out = np.repeat(docs, counts)
    first = np.cumsum(counts) - counts
    with tempfile.TemporaryDirectory() as folder:
        strings = Collection(folder, fragments.pop(), counts + SPAN - 1)
        names, prefix = sorted_suffixes(strings, SPAN)
    if len(names):
        frag = names >> 8
        group = np.flatnonzero(prefix < SPAN)
        least = np.minimum.reduceat(docs[frag], group)
        offset = counts[frag] + SPAN - 1 - (names & 255)
        out[first[frag] + offset] = np.repeat(least, np.diff(np.r_[group, len(names)]))
    return np.split(out, first[1:]) if len(counts) else []


def _meeting(matrix: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which fragments have a 50-byte string whose hash another string among them has: no string of the others occurs twice."""
    held = [np.zeros(0, np.uint64)]
    for a in range(0, len(counts), 1 << 12):
        w = matrix[a : a + (1 << 12)].astype(np.uint64)
        for step in (1, 2, 4):  # eight bytes from each place
            w = w[:, :-step] | (w[:, step:] << np.uint64(8 * step))
        h = np.full((len(w), RUN), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for at in (*range(0, SPAN - 8, 8), SPAN - 8):
            h ^= w[:, at : at + RUN]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        held.append(h[np.arange(RUN) < counts[a : a + (1 << 12), None]])
    value = np.concatenate(held)
    order = np.argsort(value)
    value = value[order]
    same = value[1:] == value[:-1]
    frag = np.repeat(np.arange(len(counts)), counts)[order]
    out = np.zeros(len(counts), dtype=bool)
    out[frag[1:][same]] = True
    out[frag[:-1][same]] = True
    return out


def _by_parts(matrix: np.ndarray, first: np.ndarray, counts: np.ndarray, docs: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """The answers to the fragments ``first``, from collections of about ``STRINGS`` each: equal strings are of one part.

    Most fragments share their minimizer and no 50 bytes; those have their own document as the answer and are not sorted.
    """
    size = counts[first]
    out = np.split(np.repeat(docs, size), np.cumsum(size)[:-1]) if len(size) else []
    meet = np.flatnonzero(_meeting(matrix[first], size))
    shift = max(0, 8 - (len(meet) // STRINGS).bit_length())
    part = part[first[meet]] >> shift
    for k in np.unique(part).tolist():
        own = meet[part == k]
        for i, x in zip(own.tolist(), _answers([matrix[first[own]]], size[own], docs[own]), strict=True):
            out[i] = x
    return out


def _string_hashes(view: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 48-bit hash of the 50 bytes from each place."""
    out = np.full(len(at), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for a in range(0, len(at), 1 << 16):
        some = np.zeros((len(at[a : a + (1 << 16)]), 56), dtype=np.uint8)
        some[:, :SPAN] = view[at[a : a + (1 << 16)], :SPAN]
        for w in some.view("<u8").T:
            h = (out[a : a + (1 << 16)] ^ w) * np.uint64(0xBF58476D1CE4E5B9)
            out[a : a + (1 << 16)] = h ^ (h >> np.uint64(31))
    return (out * np.uint64(0x94D049BB133111EB)) >> np.uint64(64 - BITS)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row (and ``kept``, the remaining bytes, if asked for).

    A byte goes if a 50-byte string over it also starts in a row with a smaller id; overlaps count and all strings are those of the
    input. Null texts are empty; a null id is larger than any other; rows with equal ids take nothing from each other.
    Texts are bytes, so what remains may cut a character. An empty table gives no row; other columns are not read.
    """
    spark = docs.sparkSession
    base = shared_dir(spark, "repeats")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = bucket_bits(int(total))
    buckets = min(1 << bits, TASKS)
    lift = np.uint64(BITS - bits)

    def by_bucket(values: np.ndarray) -> list[tuple[int, int, int]]:
        """Slices of sorted hashes: bucket, start, stop."""
        b = (values >> lift).astype(np.int64)
        at = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
        return [*zip(b[at].tolist(), at.tolist(), np.r_[at[1:], len(b)].tolist(), strict=True)] if len(b) else []

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Write unit files; emit each unit's minimizers, with a bit for those that two of its documents have."""
        number = TaskContext.get().partitionId() << 20
        for batch in in_pieces(batches, "text", UNIT):
            unit = _Unit.of(batch)
            unit.put(f"{base}/unit-{number}")
            at, _, value = unit.runs()
            doc = np.searchsorted(unit.stops, at, side="right")
            order = np.argsort(value)
            value, doc = value[order], doc[order]
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
            shared = np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first) if len(value) else np.zeros(0, bool)
            own = value[first]
            rows = [(number, b, np.ascontiguousarray(own[a:z].astype("<u8").view("u1").reshape(-1, 8)[:, : BITS // 8]).tobytes() + np.packbits(shared[a:z]).tobytes()) for b, a, z in by_bucket(own)]
            number += 1
            yield rows_of(PARTS, rows)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each unit, which of its minimizers another document has too, and which are those of very many units."""
        for bucket, rows in grouped(batches, "bucket"):
            values, flags, sizes = [], [], []
            for r in rows:
                n = len(r["blob"]) * 8 // (BITS + 1)
                raw = np.zeros((n, 8), dtype="u1")
                raw[:, : BITS // 8] = np.frombuffer(r["blob"], "u1", n * (BITS // 8)).reshape(n, -1)
                values.append(raw.view("<u8").ravel())
                flags.append(np.unpackbits(np.frombuffer(r["blob"], "u1", offset=n * (BITS // 8)), count=n).astype(bool))
                sizes.append(n)
            value, flag = np.concatenate(values), np.concatenate(flags)
            order = np.argsort(value, kind="stable")
            v = value[order]
            first = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            units = np.repeat(np.diff(np.r_[first, len(v)]), np.diff(np.r_[first, len(v)]))
            flag[order[units > 1]] = True
            hot = np.zeros(len(v), dtype=bool)
            hot[order[units >= HOT]] = True
            at = np.cumsum(sizes) - sizes
            out = [(r["unit"], bucket, np.packbits(flag[a : a + n]).tobytes() + (np.packbits(hot[a : a + n]).tobytes() if hot[a : a + n].any() else b"")) for r, a, n in zip(rows, at.tolist(), sizes, strict=True) if flag[a : a + n].any()]
            if out:
                yield rows_of(PARTS, out)

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The fragments of each unit's shared minimizers, each content once, with the smallest document that has it."""
        for number, rows in grouped(batches, "unit"):
            unit = _Unit.get(f"{base}/unit-{number}")
            at, count, value = unit.runs()
            order = np.argsort(value, kind="stable")  # the same order in every try of the task
            at, count, value = at[order], count[order], value[order]
            first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]]) if len(value) else np.zeros(0, np.int64)
            own, times = value[first], np.diff(np.r_[first, len(value)])
            shared, hot = np.zeros(len(own), dtype=bool), np.zeros(len(own), dtype=bool)
            bitmap = {r["bucket"]: np.frombuffer(r["blob"], "u1") for r in rows}
            for b, a, z in by_bucket(own):
                if b in bitmap:
                    n = (z - a + 7) // 8
                    shared[a:z] = np.unpackbits(bitmap[b][:n], count=z - a).astype(bool)
                    if len(bitmap[b]) > n:
                        hot[a:z] = np.unpackbits(bitmap[b][n:], count=z - a).astype(bool)
            view = np.lib.stride_tricks.sliding_window_view(np.concatenate([unit.data, np.zeros(WIDTH, np.uint8)]), WIDTH)
            keep, single = np.repeat(shared & ~hot, times), np.repeat(hot, times)
            if single.any():
                n = count[single]
                one = np.repeat(at[single] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                at, count, value = np.r_[at[keep], one], np.r_[count[keep], np.ones(len(one), dtype=count.dtype)], np.r_[value[keep], _string_hashes(view, one)]
                order = np.argsort(value, kind="stable")
                at, count, value = at[order], count[order], value[order]
            else:
                at, count, value = at[keep], count[keep], value[keep]
            doc = unit.doc_at(at)
            kinds = np.empty(len(at), dtype=np.int64)
            out = []
            for b, a, z in by_bucket(value):
                matrix = _matrix(view, at[a:z], count[a:z])
                first, kind = _alike(matrix, count[a:z])
                least = np.full(len(first), NONE)
                np.minimum.at(least, kind, doc[a:z])
                kinds[a:z] = kind
                n = count[a:z][first]
                whole = matrix[first][np.arange(WIDTH) < (n + SPAN - 1)[:, None]]
                part = (value[a:z][first] >> (lift - np.uint64(8))).astype("u1")  # of the bucket, by the minimizer's next bits
                out.append((number, b, zipped(n.astype("u1"), least, whole, part)))
            put_file(f"{base}/hot-{number}", zipped(at.astype("<i8"), count.astype("u1"), kinds.astype("<u4"), (value >> lift).astype("<u8")))
            yield rows_of(PARTS, out)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sort the suffixes of a bucket's fragments; answer each unit."""
        for bucket, rows in grouped(batches, "bucket"):
            counts, docs_, matrices, sizes, parts = [], [], [], [], []
            for r in rows:
                n, least, whole, part = unzipped(r.pop("blob"), "u1", "<i8", "u1", "u1")
                parts.append(part)
                n = n.astype(np.int64)
                matrix = np.zeros((len(n), WIDTH), dtype=np.uint8)
                matrix[np.arange(WIDTH) < (n + SPAN - 1)[:, None]] = whole
                counts.append(n)
                docs_.append(least)
                matrices.append(matrix)
                sizes.append(len(n))
            count, doc, matrix = np.concatenate(counts), np.concatenate(docs_), np.concatenate(matrices)
            del matrices
            first, kind = _alike(matrix, count)
            least = np.full(len(first), NONE)
            np.minimum.at(least, kind, doc)
            answer = _by_parts(matrix, first, count, least, np.concatenate(parts))
            at = 0
            out = []
            for r, n in zip(rows, sizes, strict=True):
                out.append((r["unit"], bucket, zipped(np.concatenate([answer[k] for k in kind[at : at + n].tolist()]))))
                at += n
            yield rows_of(PARTS, out)

    result = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in grouped(batches, "unit"):
            unit = _Unit.get(f"{base}/unit-{number}")
            start = np.zeros(len(unit.data), dtype=bool)
            blobs = {r["bucket"]: r["blob"] for r in rows if r["bucket"] >= 0}
            if blobs:
                at, count, kind, bucket = unzipped(get_file(f"{base}/hot-{number}"), "<i8", "u1", "<u4", "<u8")
                count = count.astype(np.int64)
                for b in np.unique(bucket).tolist():
                    a, z = np.searchsorted(bucket, [b, b + 1])
                    n, k = count[a:z], kind[a:z]
                    size = np.zeros(int(k.max()) + 1, dtype=np.int64)
                    size[k] = n
                    (least,) = unzipped(blobs[b], "<i8")
                    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    told = least[np.repeat((np.cumsum(size) - size)[k], n) + place]
                    place += np.repeat(at[a:z], n)
                    start[place[told < unit.doc_at(place)]] = True
            reach = np.cumsum(start, dtype=np.int64)
            reach[SPAN:] -= reach[:-SPAN].copy()
            gone = reach > 0
            begin = np.r_[0, unit.stops[:-1]].astype(np.int64)
            out = []
            for i, (a, z) in enumerate(zip(begin.tolist(), unit.stops.tolist(), strict=True)):
                g = gone[a:z]
                kept = unit.data[a:z][~g].tobytes()
                spans = int(g[:1].sum() + (g[1:] & ~g[:-1]).sum())
                out.append((int(unit.ids[i]) if unit.known[i] else None, z - a, int(g.sum()), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])))
            yield rows_of(result, out)

    minimizers = slim.mapInArrow(collect, PARTS)
    hot = written(minimizers.repartition(buckets, "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(shared, PARTS), "repeats-shared")
    # listed now that the scan above has run; a task that is run again rewrites the same files
    files = spark.read.format("binaryFile").option("pathGlobFilter", "unit-*[0-9]").load(base) if total or not docs.isEmpty() else None
    if files is None:
        return spark.createDataFrame([], result)
    units = written(files.select(F.regexp_extract("path", r"unit-(\d+)$", 1).cast("long").alias("unit"), F.lit(-1).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("blob")), "repeats-units")
    n = min(TASKS, max(1, units.count()))
    cut = hot.repartition(n, "unit").sortWithinPartitions("unit", "bucket").mapInArrow(fragments, PARTS)
    told = written(cut.repartition(buckets, "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(solve, PARTS), "repeats-told")
    return units.unionByName(told).repartition(n, "unit").sortWithinPartitions("unit", "bucket").mapInArrow(remove, result)
