"""Overlap of documents with reference texts by character n-grams.

Every place of every story is an n-gram, so none of them becomes a row before it is one of a source: stories' n-grams are
hashed in whole Arrow batches and looked up in the sources' hashes, behind a map of bits that is sized by them and lets one
place in ``SPARE`` through. Only what hits goes on as text to be joined exactly. Sources of more than ``GRAMS`` distinct
n-grams are dealt by hash to passes over the stories, so that what a worker holds is bounded whatever their number.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrow import pieces
from ..profiles import LanguageProfile

GRAM, STRIDE = 16, 5
#: Hashes of n-grams that a pass holds (8 bytes each), and bits of the map for each.
GRAMS, SPARE = 4 << 20, 16
# White space outside ASCII.
_SPACES = [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def _dropped(marks: str) -> np.ndarray:
    """For each code point, whether normalisation drops it: marks, white space and digits of any script."""
    out = np.fromiter((unicodedata.category(chr(c)) == "Nd" for c in range(0x110000)), dtype=bool, count=0x110000)
    out[[*map(ord, marks), *range(9, 14), 32, *_SPACES]] = True
    return out


def _clean(texts: list[str | None], marks: str) -> tuple[np.ndarray, np.ndarray]:
    """The normalised texts as code points one after the other, and where each ends."""
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    keep = ~_dropped(marks)[codes]
    stops = np.cumsum([len(t or "") for t in texts])
    return codes[keep], np.r_[0, np.cumsum(keep)][stops]


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` code points from each place, by doubling."""
    if len(codes) < n:
        return np.zeros(0, dtype=np.uint64)
    one = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    one ^= one >> np.uint64(32)
    odd = np.uint64(0xC2B2AE3D27D4EB4F)
    out, done, power, size = None, 0, one, 1
    while True:
        if n & size:
            out = power.copy() if out is None else out[: len(codes) - done - size + 1] * odd + power[done : len(codes) - size + 1]
            done += size
        if done == n:
            break
        power = (power[:-size] * odd + power[size:]) * np.uint64(0x165667B19E3779F9)
        power ^= power >> np.uint64(29)
        size *= 2
    return out * np.uint64(0xBF58476D1CE4E5B9)


def _rows(batch: pa.RecordBatch, codes: np.ndarray, doc: np.ndarray, at: np.ndarray, n: int, h: np.ndarray) -> pa.RecordBatch:
    text = codes.astype("<u4").tobytes()
    grams = [text[4 * i : 4 * (i + n)].decode("utf-32-le", "surrogatepass") for i in at.tolist()]
    return pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(doc)), pa.array(grams, pa.string()), pa.array(h.view(np.int64))], names=["id", "gram", "hash"])


@dataclass(frozen=True)
class Wanted:
    """Sorted hashes, and a map with the bit of each one's leading ``bits`` bits set."""

    hashes: np.ndarray
    bits: int
    found: np.ndarray

    @staticmethod
    def of(hashes: np.ndarray, bits: int | None = None) -> Wanted:
        bits = bits or max(15, int(SPARE * len(hashes)).bit_length())
        found = np.zeros(1 << bits, dtype=bool)
        found[hashes >> np.uint64(64 - bits)] = True
        return Wanted(np.sort(hashes), bits, np.packbits(found, bitorder="little"))

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where ``h`` has one of the hashes."""
        slot = h >> np.uint64(64 - self.bits)
        at = np.flatnonzero(self.found[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1)
        near = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        return at[self.hashes[near] == h[at]] if len(self.hashes) else at


def _places(stops: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in it and characters from there to its end."""
    doc = np.searchsorted(stops, at, side="right")
    return doc, at - np.r_[0, stops][doc], stops[doc] - at


def wanted_grams(sources: DataFrame, p: LanguageProfile, source_id: str = "source_id", n: int = GRAM, stride: int = STRIDE) -> DataFrame:
    """``source, gram, hash, places``: every ``stride``-th n-gram of each source; that which ends the text is no start (a text of ``n`` characters has none)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, stops = _clean(batch.column("text").to_pylist(), p.dropped)
            h = hashes(codes, n)
            doc, place, left = _places(stops, np.arange(len(h)))
            at = np.flatnonzero((place % stride == 0) & (left > n))
            yield _rows(batch, codes, doc[at], at, n, h[at])

    schema = T.StructType([T.StructField("id", sources.schema[source_id].dataType), T.StructField("gram", T.StringType()), T.StructField("hash", T.LongType())])
    rows = sources.select(F.col(source_id).alias("id"), "text").mapInArrow(work, schema)
    return rows.groupBy(F.col("id").alias(source_id), "gram", "hash").agg(F.count("*").alias("places"))


def passes(wanted: DataFrame, grams: int = GRAMS, bits: int | None = None) -> Iterator[Wanted]:
    """The sources' hashes, in parts of about ``grams``; the driver holds one part at a time."""
    distinct = wanted.select("hash").distinct()
    turns = -(-distinct.count() // grams) or 1
    for turn in range(turns):
        own = distinct.where(F.pmod(F.xxhash64("hash"), F.lit(turns)) == turn) if turns > 1 else distinct
        yield Wanted.of(own.toArrow()["hash"].to_numpy().view(np.uint64), bits)


def hits(stories: DataFrame, wanted: Wanted, p: LanguageProfile, story_id: str = "doc_id", n: int = GRAM) -> DataFrame:
    """``story, gram``: the distinct n-grams of each story row whose hash is wanted."""
    held = stories.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            codes, stops = _clean(batch.column("text").to_pylist(), p.dropped)
            h = hashes(codes, n)
            at = held.value.places(h)
            doc, _, left = _places(stops, at)
            at, doc = at[left >= n], doc[left >= n]
            _, first = np.unique(np.stack([doc.astype(np.uint64), h[at]]), axis=1, return_index=True) if len(at) else (None, np.zeros(0, dtype=np.int64))
            yield _rows(batch, codes, doc[first], at[first], n, h[at[first]])

    schema = T.StructType([T.StructField("id", stories.schema[story_id].dataType), T.StructField("gram", T.StringType()), T.StructField("hash", T.LongType())])
    return stories.select(F.col(story_id).alias("id"), "text").mapInArrow(work, schema).select(F.col("id").alias(story_id), "gram")


def overlap(stories: DataFrame, sources: DataFrame, p: LanguageProfile, story_id: str = "doc_id", source_id: str = "source_id", n: int = GRAM, stride: int = STRIDE, grams: int = GRAMS, bits: int | None = None) -> DataFrame:
    """``story, source, matches`` for pairs that share some: the number of the source's places whose n-gram is in the story.

    Rows with equal story ids are one story. ``grams`` bounds the hashes of a pass, ``bits`` fixes the size of its map.
    """
    wanted = wanted_grams(sources, p, source_id, n, stride)
    # a gram's row meets all its sources at once; rows of one story with equal ids are made distinct among the hits only
    have = reduce(DataFrame.unionByName, [hits(stories, part, p, story_id, n) for part in passes(wanted, grams, bits)]).distinct()
    return have.join(wanted.drop("hash"), "gram").groupBy(story_id, source_id).agg(F.sum("places").alias("matches"))


def overlap_report(stories: DataFrame, sources: DataFrame, p: LanguageProfile, story_id: str = "doc_id", source_id: str = "source_id") -> DataFrame:
    """``story, source, matches, verdict``: FAIL for each pair that shares some, one OK without a source for each story that shares none."""
    found = overlap(stories, sources, p, story_id, source_id)
    out = stories.select(story_id).distinct().join(found, story_id, "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    return out.withColumn("verdict", F.when(F.col("matches") == 0, "OK").otherwise("FAIL"))


def overlap_grid(stories: DataFrame, sources: DataFrame, p: LanguageProfile, story_id: str = "doc_id", source_id: str = "source_id", most: int = 1000, cells: int = 1_000_000) -> DataFrame:
    """Every asked pair with its matches and verdict, as a report of at most ``most`` stories and ``cells`` pairs; ``overlap_report`` takes any number."""
    if (asked := stories.limit(most + 1).count()) > most:
        raise ValueError(f"a grid takes at most {most} stories")
    if asked * sources.limit(cells // max(asked, 1) + 1).count() > cells:
        raise ValueError(f"a grid takes at most {cells} pairs")
    pairs = stories.select(story_id).crossJoin(sources.select(source_id))
    found = overlap(stories, sources, p, story_id, source_id)
    out = pairs.join(found, [story_id, source_id], "left").withColumn("matches", F.coalesce("matches", F.lit(0)).cast("long"))
    return out.withColumn("verdict", F.when(F.col("matches") == 0, "OK").otherwise("FAIL"))


def originals(stories: DataFrame, sources: DataFrame, p: LanguageProfile, story_id: str = "doc_id", source_id: str = "source_id") -> DataFrame:
    """Stories without any match."""
    return stories.join(overlap(stories, sources, p, story_id, source_id).select(story_id).distinct(), story_id, "left_anti")
