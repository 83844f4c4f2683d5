"""What the operators of this subpackage share: the shared folder, written tables, packed columns."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for one run of an operator, under ``spark.checkpoint.dir``.

    The setting is read from the session. Only where it is unset and the master is local a folder of this machine is
    used; a cluster without the setting is an error, as its executors share no such folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = spark.conf.get("textlens.local.shared", None)
        if not base:
            base = "file://" + tempfile.mkdtemp(prefix="textlens-")
            spark.conf.set("textlens.local.shared", base)
    if "://" not in base and not base.startswith("file:"):
        base = _qualified(spark, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _SCRATCH:
        _SCRATCH[-1].append(path)
    return path


#: Folders of the operators that run now, for each ``finished`` that is open.
_SCRATCH: list[list[str]] = []


def finished(run: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``run`` gives, as a table in the shared folder; all that it wrote there on the way is removed."""
    _SCRATCH.append([])
    try:
        out = run()
        spark, made = out.sparkSession, _SCRATCH[-1]
        _SCRATCH[-1] = []
        done = written(out, name)
        _SCRATCH[-1] = made
    finally:
        made = _SCRATCH.pop()
    for path in made:
        drop_written(spark, path)
    return done


def _qualified(spark: SparkSession, path: str) -> str:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return str(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString())


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, so a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    out = df if partitions is None else df.coalesce(partitions)
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, for tasks that read byte ranges or files of their own."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def put_file(uri: str, data: bytes) -> None:
    """Write a file so that a second try of the same task leaves the same whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(part) as out:
        out.write(data)
    fs.move(part, path)


def get_file(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as f:
        return f.read()


def zipped(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed block of bytes."""
    raw = b"".join(len(b := np.ascontiguousarray(x).tobytes()).to_bytes(8, "little") + b for x in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unzipped(blob: bytes, *types: str) -> list[np.ndarray]:
    """The arrays of ``zipped``, of the given types."""
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    out, at = [], 0
    for t in types:
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(np.frombuffer(raw, t, n // np.dtype(t).itemsize, at + 8))
        at += 8 + n
    return out


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, wherever ``body`` uses it (also inside further lambdas)."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def free_name(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken``, in any letter case."""
    low = {c.lower() for c in taken}
    while base.lower() in low:
        base = "_" + base
    return base


def in_pieces(batches: Iterator[pa.RecordBatch], text: str, most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text, so that memory doesn't grow with the batch's texts."""
    for batch in batches:
        n, start, held = batch.num_rows, 0, 0
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        for i in range(n):
            if held and held + sizes[i] > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        if start < n:
            yield batch.slice(start, n - start)
    release()


def release() -> None:
    """Give freed memory back to the system: Python workers wait for the next task and would hold it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of sorted batches, gathered by key."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row[key] != now and held:
                yield now, held
                held = []
            now = row[key]
            held.append(row)
    if held:
        yield now, held


def rows_of(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a batch of a schema like ``a bigint, b binary``."""
    names, types = zip(*(x.split() for x in schema.split(", ")), strict=True)
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "int": pa.int32()}
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types, strict=True)], names=names)


def kept_rows(numbered: DataFrame, row: str, stay: DataFrame) -> DataFrame:
    """The rows of ``numbered`` whose ``row`` (of ``monotonically_increasing_id``) is one of ``stay``, without that column.

    What stays is written as one small file of bits for each partition that the rows were numbered in, and looked up where
    the rows are read. So rows with their texts are never shuffled, however many stay.
    """
    spark = numbered.sparkSession
    base = shared_dir(spark, "kept-rows")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def put() -> pa.RecordBatch:
            at = np.concatenate(held)
            bits = np.zeros(int(at[-1]) + 1, dtype=bool)
            bits[at] = True
            put_file(f"{base}/{now}", np.packbits(bits).tobytes())
            return rows_of("part bigint, n bigint", [(now, len(at))])

        for batch in batches:
            part, at = batch.column("part").to_numpy(), batch.column("at").to_numpy()
            cut = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
            for i, z in zip(cut, cut[1:], strict=False):
                if z > i:
                    if held and part[i] != now:
                        yield put()
                        held = []
                    now = int(part[i])
                    held.append(at[i:z])
        if held:
            yield put()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bits = None, np.zeros(0, dtype=bool)
        for batch in batches:
            rows = batch.column(row).to_numpy()
            keep = np.zeros(len(rows), dtype=bool)
            for part in np.unique(rows >> 33).tolist():
                if part != now:
                    try:
                        bits = np.unpackbits(np.frombuffer(get_file(f"{base}/{part}"), dtype=np.uint8)).astype(bool)
                    except FileNotFoundError:  # nothing of it stays
                        bits = np.zeros(0, dtype=bool)
                    now = part
                own = np.flatnonzero(rows >> 33 == part)
                at = rows[own] & ((1 << 33) - 1)
                keep[own[at < len(bits)]] = bits[at[at < len(bits)]]
            yield batch.filter(pa.array(keep)).drop_columns([row])

    placed = stay.select(F.shiftright(row, 33).alias("part"), F.col(row).bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    written(placed.repartition("part").sortWithinPartitions("part", "at").mapInArrow(write, "part bigint, n bigint"), "kept-parts")
    rest = numbered.drop(row)
    return numbered.mapInArrow(read, rest.schema)
