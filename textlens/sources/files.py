"""A data source of text files in folders by category, for reading and writing: ``category, name, bytes, text``.

    spark.dataSource.register(CorpusFiles)
    spark.read.format("corpus").load(folder).where("category = 'a' and bytes >= 2048")
    df.write.format("corpus").mode("append").save(folder)

Reading plans its partitions by the files' sizes; conditions on category and bytes choose folders and files before any is
opened. A schema can also ask for ``path string`` and ``content binary``; without text and content no file is opened. The
option ``folders`` (a JSON list of names, ``""`` for the folder itself) says which folders are read. Tasks decode: UTF-8, else GBK, else UTF-8 with replacements. Writing puts each task's files into folders of its
own attempt, which the commit moves into place; what didn't end well is removed.

The driver goes over the files one by one and holds no list of them: of a plan the names and sizes, compressed by
partition, and in a commit 16 bytes for each file of one category. (Where files aren't local, a folder is listed at once.)
"""

from __future__ import annotations

import hashlib
import json
import os
import pickle
import tempfile
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)
from pyspark.sql.types import StructType

SCHEMA = "category string, name string, bytes long, text string"
#: Bytes and files of a partition (and files of a folder that a task writes), bytes of a batch, folders that a commit moves from at a time.
PART, FILES, BATCH, MOVES = 64 << 20, 20_000, 8 << 20, 16
ENDING, STAGING = ".txt", "_staging"
_KINDS = {"bytes": pa.int64(), "content": pa.binary()}
_COMPARED = {GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y}


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), os.path.abspath(uri))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share: under ``spark.checkpoint.dir``, or on a local master without it in a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="textlens-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def decoded(data: bytes) -> str:
    for encoding in ("utf-8", "gbk"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("utf-8", "replace")


def _folder(name: str) -> str:
    """A name as one part of a path."""
    if not name:
        return "%"
    out = quote(name, safe=" ")
    # what means something in a path, or is ours, is written as codes
    return "".join(f"%{b:02X}" for b in name[0].encode()) + quote(name[1:], safe=" ") if name[0] in "._" else out


def _name(part: str) -> str:
    return "" if part == "%" else unquote(part)


def _listed(fs: pafs.FileSystem, folder: str, sizes: bool = True) -> Iterator[tuple[str, int]]:
    """Name and size (0, if not asked for) of each file in a folder, without a list of them where the folder is local."""
    if isinstance(fs, pafs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for x in entries:
                if x.is_file():
                    yield x.name, x.stat().st_size if sizes else 0
    else:
        for x in fs.get_file_info(pafs.FileSelector(folder)):
            if x.type == pafs.FileType.File:
                yield x.base_name, x.size


@dataclass
class Files(InputPartition):
    """Category, path and size of each file; held as the compressed names and sizes by folder."""

    packed: bytes

    @classmethod
    def of(cls, folders: list[tuple[str, str, list[tuple[str, int]]]]) -> Files:
        return cls(zlib.compress(pickle.dumps([(category, path, sorted(files)) for category, path, files in folders if files]), 1))

    @property
    def rows(self) -> list[tuple[str, str, int]]:
        return [(category, f"{path}/{name}", size) for category, path, files in pickle.loads(zlib.decompress(self.packed)) for name, size in files]


class CorpusReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, folders: list[str] | None = None):
        self.path, self.schema, self.folders = path, schema, folders
        self.categories: set[str] | None = None
        self.sizes: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, EqualNullSafe, In)) and f.attribute == ("category",):
                # a null never equals a category
                some = {x for x in (f.value if isinstance(f, In) else [f.value]) if x is not None}
                self.categories = some if self.categories is None else self.categories & some
            elif type(f) in _COMPARED and f.attribute == ("bytes",):
                self.sizes.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        fs, root = filesystem(self.path)
        out, held, n, size = [], [], 0, 0
        folders = self.folders
        if folders is None:
            folders = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory and not x.base_name.startswith("_")]
        for folder in sorted(folders):
            category, path = _name(folder), f"{root}/{folder}" if folder else root
            if self.categories is not None and category not in self.categories:
                continue
            held.append((category, path, []))
            for name, length in _listed(fs, path):
                if name.endswith(ENDING) and all(_COMPARED[type(f)](length, f.value) for f in self.sizes):
                    if n and (size + length > PART or n >= FILES):
                        out.append(Files.of(held))
                        held, n, size = [(category, path, [])], 0, 0
                    held[-1][2].append((name, length))
                    n, size = n + 1, size + length
        return [*out, Files.of(held)] if n else out or [Files.of([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(self.path)
        asked = set(self.schema.names)
        held: list[dict] = []
        size = 0
        for category, path, n in partition.rows:
            row = {"category": category, "name": _name(os.path.basename(path)[: -len(ENDING)]), "path": path, "bytes": n}
            if asked & {"text", "content"}:
                with fs.open_input_stream(path) as f:
                    row["content"] = f.read()
            if "text" in asked:
                row["text"] = decoded(row["content"])
            held.append(row)
            size += n
            if size > BATCH:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], _KINDS.get(c, pa.string())) for c in self.schema.names], names=self.schema.names)


@dataclass
class Written(WriterCommitMessage):
    """The folders that a task wrote, each named like its category's."""

    folders: list[str]


class CorpusWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        if not {"category", "name", "text"} <= set(schema.names):
            raise ValueError("category, name and text are needed")
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = filesystem(self.path)
        folder, made, counts, done = f"{root}/{STAGING}/{self.job}/{uuid.uuid4().hex}", {}, {}, []
        for batch in iterator:
            for category, name, text in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("category", "name", "text")), strict=True):
                if category is None or name is None:
                    raise ValueError("a text without a category or a name has no place")
                if counts.get(category, 0) % FILES == 0:
                    made[category] = f"{folder}/{counts.get(category, 0) // FILES}/{_folder(str(category))}"
                    fs.create_dir(made[category], recursive=True)
                    done.append(made[category])
                counts[category] = counts.get(category, 0) + 1
                path = f"{made[category]}/{_folder(str(name))}{ENDING}"
                if fs.get_file_info(path).type != pafs.FileType.NotFound:
                    raise ValueError(f"two texts are named {category}/{name}")
                with fs.open_output_stream(path) as f:
                    f.write((text or "").encode("utf-8", "surrogatepass"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = filesystem(self.path)
        written: dict[str, list[str]] = {}
        for message in messages:
            for folder in message.folders if message else []:
                written.setdefault(folder.rsplit("/", 1)[1], []).append(folder)
        for category, folders in written.items():
            there = f"{root}/{category}"
            if not self.overwrite and fs.get_file_info(there).type == pafs.FileType.Directory:
                folders = [*folders, there]
            if self._clash(fs, folders):
                self._clear()
                raise ValueError("some text would take another's place")
        if self.overwrite:
            for x in fs.get_file_info(pafs.FileSelector(root)):
                if x.type == pafs.FileType.Directory and x.base_name != STAGING:
                    fs.delete_dir(x.path)

        def place(folder: str) -> None:
            to = f"{root}/{folder.rsplit('/', 1)[1]}"
            for name in [name for name, _ in _listed(fs, folder, False)]:  # as many as a task puts into a folder
                fs.move(f"{folder}/{name}", f"{to}/{name}")

        for category in written:
            fs.create_dir(f"{root}/{category}", recursive=True)
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(place, [folder for folders in written.values() for folder in folders]))
        self._clear()

    @staticmethod
    def _clash(fs: pafs.FileSystem, folders: list[str]) -> bool:
        """Whether two folders have a file of one name, by digests of 128 bits."""
        marks = bytearray()
        for folder in folders:
            for name, _ in _listed(fs, folder, False):
                marks += hashlib.blake2b(name.encode("utf-8", "surrogateescape"), digest_size=16).digest()
        own = np.frombuffer(marks, "S16")  # of one length, so that ending in zeros makes none equal to another
        own = np.sort(own)
        return bool((own[1:] == own[:-1]).any())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, root = filesystem(self.path)
        if fs.get_file_info(f"{root}/{STAGING}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{root}/{STAGING}/{self.job}")
        if fs.get_file_info(f"{root}/{STAGING}").type != pafs.FileType.NotFound and not fs.get_file_info(pafs.FileSelector(f"{root}/{STAGING}")):
            fs.delete_dir(f"{root}/{STAGING}")


class CorpusFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpus"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CorpusReader:
        folders = self.options.get("folders")
        return CorpusReader(self.options["path"], schema, json.loads(folders) if folders else None)

    def writer(self, schema: StructType, overwrite: bool) -> CorpusWriter:
        return CorpusWriter(self.options["path"], schema, overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to the session, with filters pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CorpusFiles)
