"""Packing by power-of-two decomposition.

A document of ``n`` tokens is cut into ``n // max_len`` pieces of ``max_len`` and one piece for each binary digit of the
rest, longest first. Every piece is a sequence of its own whose length is a power of two, so no sequence crosses
documents and none is padded. Sequences of equal length form a bucket, from which batches are drawn: each bucket is
a folder of its own in the shared folder, written by the tasks that cut the documents, so nothing is shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_pieces, shared_dir
from . import tokens

MAX_LEN, END = 2048, 1


def pieces(n: int, max_len: int = MAX_LEN) -> list[int]:
    """Lengths of the pieces of ``n`` tokens, in text order."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", max_len: int = MAX_LEN, end: int = END, with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``, ``ids`` if asked for, and ``bucket``.

    ``tokenizer`` is the path of a tokenizer file that every executor has; ``max_len`` is a power of two. Null and empty texts have the end token only; rows with
    null or equal ids are packed each on its own; an empty table gives no row; other columns are not read. Tasks number
    their sequences (upper bits: the task), so ids agree between runs as long as the table's files do. The result is a
    table in the shared folder with a folder for each bucket (its length), which a reader prunes by ``bucket``.
    """
    if max_len < 1 or max_len & (max_len - 1):
        raise ValueError("max_len has to be a power of two")
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, `offset` bigint" + ", ids array<int>" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokens.tokenizer(tokenizer)
        number = TaskContext.get().partitionId() << 40
        for batch in in_pieces(batches, "text", 4 << 20):
            doc, start, length, crc, total, ids = [], [], [], [], [], []
            for d, got in enumerate(tok.encode_all(batch.column("text"))):
                own = np.append(got.astype("<u4"), np.uint32(end))
                at, raw = 0, own.tobytes()
                for n in pieces(len(own), max_len):
                    doc.append(d)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(own))
                    if with_ids:
                        ids.append(own[at : at + n])
                    at += n
            order = np.argsort(np.array(length), kind="stable")
            pick = lambda x: pa.array(np.array(x, dtype="int64")[order])
            out = [batch.column("doc_id").take(pick(doc)), pick(start), pick(length), pick(crc), pick(total), pa.array(number + np.arange(len(order))), pa.array(np.zeros(len(order), dtype="int64"))]
            number += len(order)
            if with_ids:
                parts = [ids[i] for i in order]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype("int32")
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype("int32"))))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    packed = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, schema)
    return in_buckets(packed, shared_dir(docs.sparkSession, "packing"))


def in_buckets(packed: DataFrame, path: str) -> DataFrame:
    """``packed`` as a table at ``path`` with one folder per length, ready for batches of equal length."""
    packed.withColumn("bucket", F.col("length")).write.option("compression", "zstd").partitionBy("bucket").parquet(path)
    schema = T.StructType([*packed.schema.fields, T.StructField("bucket", T.LongType())])
    return packed.sparkSession.read.schema(schema).parquet(path)
