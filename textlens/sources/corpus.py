"""Text files as a corpus: ``doc_id, category, path, text``."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..operators import corpus
from . import files as source

FLAT = "corpus"
SCHEMA = "doc_id string, category string, path string, length long, text string"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _folders(spark: SparkSession, path: str) -> list[str] | None:
    """Names of sub-folders; None if the folder is missing."""
    fs, p = _fs(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else None


@F.pandas_udf(StringType())
def _gbk(contents: Iterator[pd.Series]) -> Iterator[pd.Series]:
    def read(b: bytes) -> str:
        try:
            return b.decode("gbk")
        except UnicodeDecodeError:
            return b.decode("utf-8", "replace")

    for c in contents:
        yield c.map(lambda b: read(bytes(b)) if b is not None else None)


def tolerant(content: Column) -> Column:
    """Text of bytes: UTF-8 (a leading mark stays), else GBK, else UTF-8 with replacements. Only bytes that aren't UTF-8 leave the JVM."""
    s = content.cast("string")
    return F.when(F.is_valid_utf8(s), s).otherwise(_gbk(F.when(~F.is_valid_utf8(s), content)))


def replaced(content: Column) -> Column:
    """UTF-8 with replacements."""
    return F.make_valid_utf8(content.cast("string"))


def _local(spark: SparkSession, path: str, folders: list[str], *columns: str) -> DataFrame | None:
    """``path, length`` and more columns of the files in folders below ``path``; None if Spark alone can reach them."""
    fs, p = _fs(spark, path)
    root = fs.makeQualified(p).toString()
    if not root.startswith("file:/"):
        return None
    source.register(spark)
    found = spark.read.format("corpus").schema(", ".join(["path string", "bytes long", *columns])).option("folders", json.dumps(folders)).load(root)
    return found.select(F.concat(F.lit("file:"), F.col("path")).alias("path"), F.col("bytes").alias("length"), *(c.split()[0] for c in columns))


def _empty(spark: SparkSession, path: str, folders: list[str], where: list[str]) -> DataFrame:
    """Of ``_files`` those without a byte, by a listing."""
    found = _local(spark, path, folders)
    if found is None:
        rows = []
        for folder in where:
            fs, p = _fs(spark, folder)
            listed = fs.listStatusIterator(p)
            while listed.hasNext():
                s = listed.next()
                if s.getLen() == 0 and s.isFile() and s.getPath().getName().endswith(source.ENDING):
                    rows.append((s.getPath().toString(), 0))
        found = spark.createDataFrame(rows, "path string, length long")
    return found.where("length <= 0").withColumn("content", F.lit("").cast("binary"))


def _files(spark: SparkSession, path: str, folders: list[str], least_kb: float | None) -> DataFrame:
    """``path, length, content`` of the ``.txt`` files in folders below ``path``. Spark's sources leave out files without a byte; where no least size does so too, a listing adds them."""
    where = [f"{path.rstrip('/')}/{f}" if f else path for f in folders]
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", f"*{source.ENDING}").load(where).select("path", "length", "content")
    except Exception as e:  # noqa: BLE001  a glob without any match
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = spark.createDataFrame([], "path string, length long, content binary")
    return found if least_kb is not None and least_kb > 0 else found.unionByName(_empty(spark, path, folders, where))


def _plain(path: Column) -> Column:
    """A path without the codes that ``files`` writes; as it is, where a ``%`` begins none."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


def scan(spark: SparkSession, path: str, category: str | None = None, read=tolerant, least_kb: float | None = None, most_kb: float | None = None) -> DataFrame:
    """The ``.txt`` files one level below ``path``, or in ``path`` if it has no sub-folder (then the category is ``corpus``).

    A category and sizes prune files before any is read. A missing folder, or category where there are others, gives no row.
    """
    folders = _folders(spark, path)
    if folders is None or (folders and category is not None and category not in folders):
        return spark.createDataFrame([], SCHEMA)
    where = [f for f in folders if category in (None, f)] or [""]
    found = _local(spark, path, where, "category string", "content binary")
    if found is None:
        found = _files(spark, path, where, least_kb).withColumn("category", _plain(F.element_at(F.split("path", "/"), -2)))
    if least_kb is not None:
        found = found.where(F.col("length") >= math.ceil(least_kb * 1024))
    if most_kb is not None:
        found = found.where(F.col("length") <= math.floor(most_kb * 1024))
    parent = F.col("category") if folders else F.lit(FLAT)
    return found.select(F.md5("path").alias("doc_id"), parent.alias("category"), _plain(F.col("path")).alias("path"), "length", read(F.col("content")).alias("text"))


def pick(spark: SparkSession, path: str, category: str, n: int, least_kb: float = 0, most_kb: float = 99999, seed: int = 42) -> DataFrame:
    """``n`` files of a size range from the category's folder, or from ``path`` itself where that is missing; no health filter."""
    folders = _folders(spark, path)
    if folders is None:
        return spark.createDataFrame([], SCHEMA)
    root = f"{path.rstrip('/')}/{category}" if category in folders else path
    fs, _ = _fs(spark, root)
    if not any(s.getPath().getName().endswith(".txt") for s in fs.listStatus(_fs(spark, root)[1])):
        return spark.createDataFrame([], SCHEMA)
    found = _files(spark, root, [""], least_kb).where(F.col("length").between(least_kb * 1024, most_kb * 1024))
    rows = found.select(F.md5("path").alias("doc_id"), F.lit(category if category in folders else FLAT).alias("category"), _plain(F.col("path")).alias("path"), "length", replaced(F.col("content")).alias("text"))
    return corpus.sample(rows, n, seed, None)


def story(spark: SparkSession, path: str) -> DataFrame:
    """One file as a row, with ``\\n`` line ends; a missing file is an error."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    return spark.read.text(path, wholetext=True).select(F.lit(path).alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
