"""Divergence of the sources of each language: smoothed term shares, priced by inclusion and exclusion over supports.

With ``p(t) = 1 + floor(UNIT * (count + SMOOTH) / (N + SMOOTH * V))`` a source's share of a term that it lacks is one
constant, so for two sources ``a`` and ``b`` the sum of ``|p_a - p_b|`` over all ``V`` terms is

* ``|p_a - b0|`` over a's terms and ``|a0 - p_b|`` over b's, where ``a0`` and ``b0`` are the constants: each is priced from
  a histogram of the source's counts, not from its terms,
* ``|a0 - b0|`` for each term that neither has: the constants alone give it,
* and a correction for each term that both have: from a sparse join of the term's postings.

A term is counted in its own task before anything is shuffled, histograms and constants meet in blocks, and a pair's
corrections are summed where its postings meet, so no task holds a language, a source or a term whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_pieces, release, written

#: Least documents of a kept term, smoothing, unit of a share, terms reported for each source.
LEAST, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Counted terms that a task holds, bytes of a text that are split together, histogram entries and sources of a block, postings of a part.
HELD, PIECE, BLOCK, SOURCES, PART = 300_000, 1 << 20, 4096, 256, 100_000
# Bytes of a term are ASCII letters and all bytes above ASCII; A-Z count as a-z.
_TERM = bytes((c + 32 if 65 <= c <= 90 else c) if 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The text's terms, in lists of bounded size."""
    text, at = text.translate(_TERM), 0
    while at < len(text):
        stop = text.find(b" ", at + PIECE)
        stop = len(text) if stop < 0 else stop
        yield text[at:stop].split()
        at = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs`` from ``lang, source, text``: occurrences and documents, summed as far as a task can."""
    schema = "lang string, source string, term string, n bigint, docs bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in total.items():
                if n:
                    ends = [pa.repeat(pa.scalar(x, pa.string()), len(n)) for x in (lang, source)]
                    of = pa.array(list(n), pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*ends, of, pa.array(n.values(), pa.int64()), pa.array([seen[t] for t in n], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            total.clear()

        for batch in in_pieces(batches, "text", 4 << 20):
            cols = [batch.column(c).to_pylist() for c in ("lang", "source")]
            for lang, source, text in zip(*cols, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                n, seen = total.setdefault((lang, source), (Counter(), Counter()))
                own: set[bytes] = set()
                for piece in terms(text):
                    n.update(piece)
                    own.update(piece)
                seen.update(own)
            if sum(len(n) for n, _ in total.values()) > HELD:
                yield from rows()
        yield from rows()
        release()

    return docs.select("lang", "source", "text").mapInArrow(work, schema)


def share(n: str, total: str, kept: str) -> Column:
    """The share in units, exact for any counts; 0 where no term is kept. The names are SQL expressions."""
    return F.expr(f"coalesce(1 + (cast({UNIT} as decimal(10,0)) * cast({n} + {SMOOTH} as decimal(19,0))) div nullif(cast({total} + {SMOOTH} * {kept} as decimal(20,0)), 0), 0)").cast("long")


def kept_postings(counts: DataFrame, least: int) -> DataFrame:
    """``lang, term, source, n, lang_n, first`` of the terms in at least ``least`` documents of their language; ``first`` marks one row a term."""
    # dealt by language and term once: what is summed by source and then over sources is in one place
    summed = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    marked = summed.withColumn("seen", F.sum("docs").over(of_term)).withColumn("lang_n", F.sum("n").over(of_term)).withColumn("first", F.row_number().over(of_term.orderBy("source")) == 1)
    return marked.where(F.col("seen") >= least).select("lang", "term", "source", "n", "lang_n", "first")


def _one_sided(groups: DataFrame, priced: DataFrame) -> DataFrame:
    """``lang, a, b, v`` (``a < b``): every pair's one-sided sums and constants, each from one source's side."""
    count = priced.groupBy("lang", "sid", "p").agg(F.count("*").alias("n"))
    lacking = groups.select("lang", "sid", F.col("p0").alias("p"), (F.col("kept") - F.col("support")).alias("n"))
    place = F.floor((F.row_number().over(Window.partitionBy("lang", "sid").orderBy("p")) - 1) / BLOCK)
    blocks = count.unionByName(lacking).withColumn("block", place).groupBy("lang", "sid", "block").agg(F.sort_array(F.collect_list(F.struct("p", "n"))).alias("h"))
    blocks = blocks.select("lang", "sid", F.col("h.p").alias("p"), F.col("h.n").alias("n"), F.lit(False).alias("later"))
    # both sides' sums have |a0 - b0| once too often for each term: the smaller source takes it back
    again = groups.select("lang", "sid", F.array("p0").alias("p"), F.array(-F.col("kept")).alias("n"), F.lit(True).alias("later"))
    others = groups.groupBy("lang", F.floor(F.col("sid") / (4 * SOURCES)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("sid", "p0"))).alias("o")).select("lang", F.col("o.sid").alias("other"), F.col("o.p0").alias("zero"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, sid, p, n, later, other, zero in zip(*(batch.column(c).to_pylist() for c in ("lang", "sid", "p", "n", "later", "other", "zero")), strict=True):
                p, n, other, zero = (np.array(x, dtype=np.int64) for x in (p, n, other, zero))
                stay = other > sid if later else other != sid
                other, zero = other[stay], zero[stay]
                cut = np.searchsorted(p, zero)  # below it |p - zero| is zero - p
                many, much = np.r_[0, np.cumsum(n)], np.r_[0, np.cumsum(n * p)]
                v = zero * (2 * many[cut] - many[-1]) + much[-1] - 2 * much[cut]
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(v)), pa.array(np.minimum(other, sid)), pa.array(np.maximum(other, sid)), pa.array(v)], names=["lang", "a", "b", "v"])

    return blocks.unionByName(again).join(others, "lang").mapInArrow(work, "lang string, a bigint, b bigint, v bigint")


def _both_sided(groups: DataFrame, priced: DataFrame, parts: int) -> DataFrame:
    """``lang, a, b, v`` (``a < b``): the corrections of the terms that both have, a row for each pair and part."""
    mine = F.floor(F.col("sid") / SOURCES)
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("sources") - 1) / SOURCES)), lambda b: F.struct(F.least(b, mine).alias("low"), F.greatest(b, mine).alias("high")))
    rows = priced.select("lang", "term", "sid", "p", "p0", F.pmod(F.xxhash64("term"), F.lit(parts)).alias("part"), F.explode(cells).alias("c")).select("lang", "part", "c.*", "term", "sid", "p", "p0")
    key = ["lang", "part", "low", "high"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        now, total = None, np.zeros((2 * SOURCES, 2 * SOURCES), dtype=np.int64)

        def put() -> pa.RecordBatch:
            lang, _, low, high = now
            i, j = np.nonzero(total)
            of = lambda x: np.where(x < SOURCES, low * SOURCES + x, high * SOURCES + x - SOURCES)
            a, b, v = of(i), of(j), total[i, j]
            total[:] = 0
            return pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(v)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(v)], names=["lang", "a", "b", "v"])

        def add(cell: pa.Table) -> None:
            """Whole terms of one cell."""
            low, high = cell["low"][0].as_py(), cell["high"][0].as_py()
            sid, p, zero = (cell[c].to_numpy() for c in ("sid", "p", "p0"))
            term = pc.run_end_encode(cell["term"].combine_chunks())
            ends = term.run_ends.to_numpy()
            size = np.diff(np.r_[0, ends])
            group = np.repeat(np.arange(len(ends)), size)
            side = np.where(sid // SOURCES == low, sid % SOURCES, SOURCES + sid % SOURCES)
            for d in range(1, int(size.max())):
                i = np.flatnonzero(group[d:] == group[:-d])
                j = i + d
                if low != high:  # pairs within one block have their own cell
                    apart = (side[i] < SOURCES) != (side[j] < SOURCES)
                    i, j = i[apart], j[apart]
                v = np.abs(p[i] - p[j]) - np.abs(p[i] - zero[j]) - np.abs(zero[i] - p[j]) + np.abs(zero[i] - zero[j])
                np.add.at(total, (side[i], side[j]), v)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            change = np.zeros(max(len(table) - 1, 0), dtype=bool)
            for c in key:
                change |= pc.not_equal(table[c].slice(1), table[c].slice(0, len(table) - 1)).to_numpy()
            cut = [0, *(np.flatnonzero(change) + 1).tolist(), len(table)]
            for start, stop in zip(cut, cut[1:], strict=False):
                cell = table.slice(start, stop - start)
                if not len(cell):
                    continue
                k = tuple(cell[c][0].as_py() for c in key)
                if now is not None and k != now:
                    yield put()
                now = k
                if stop == len(table):  # the last term may go on
                    last = pc.index(pc.equal(cell["term"], cell["term"][len(cell) - 1]), True).as_py()
                    held = cell.slice(last)
                    cell = cell.slice(0, last)
                if len(cell):
                    add(cell)
        if held is not None and len(held):
            add(held)
            yield put()

    dealt = rows.repartition(max(parts, 12), *key).sortWithinPartitions(*key, "term")
    return dealt.mapInArrow(work, "lang string, a bigint, b bigint, v bigint")


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every ``(lang, source)`` that occurs.

    Part ``pair``: ``item`` is each other source of the language, ``value`` the distance of the two over all kept terms.
    Part ``term``: the ``top`` terms whose share in the source is above that in its language, ``value`` the difference.
    Kept are the terms in at least ``least`` rows of a language. Null texts, languages and sources are empty strings;
    repeated rows count each; a language without kept terms has pairs of value 0 and no terms; equal values are ranked by
    the item's UTF-8; very long texts are split in pieces; an empty table gives no row; other columns are not looked at.
    """
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    postings = written(kept_postings(term_counts(rows), least), "divergence-postings")
    of_source = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"))
    of_lang = postings.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count_if("first").alias("kept"))
    named = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["total", "support", "lang_total", "kept"])
    named = named.withColumn("sid", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")).withColumn("sources", F.count("*").over(Window.partitionBy("lang")))
    groups = written(named.withColumn("p0", share("0", "total", "kept")), "divergence-groups")
    priced = postings.join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "kept"))
    parts = -(-postings.count() // PART) or 1
    pairs = _one_sided(groups, priced).unionByName(_both_sided(groups, priced, parts)).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    name = lambda sid, source: groups.select("lang", F.col("sid").alias(sid), F.col("source").alias(source))
    pairs = pairs.join(name("a", "one"), ["lang", "a"]).join(name("b", "two"), ["lang", "b"])
    pairs = pairs.select("lang", "value", F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item")))).alias("x")).select("lang", "x.*", "value")
    above = priced.withColumn("value", F.col("p") - share("lang_n", "lang_total", "kept")).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).select(columns).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term")).select(columns))
