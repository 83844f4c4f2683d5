"""Cross-entropy difference of a target and a background language model.

Both are bigram models over one vocabulary (the tokenizer's ids and a start mark), with the same smoothing: a bigram's
count is interpolated with the word's own share, ``(c(v, w) + MU * p(w)) / (c(v) + MU)`` with ``p(w) = (c(w) + ALPHA) / (N +
ALPHA * V)``. The target is trained on the rows of good labels, the background on all rows. A document is scored by
what the models learned from all other rows: its own counts are taken out of both. The score is the mean over its
tokens of background loss minus target loss in nats: above zero it reads like the target.

Token ids are kept in unit files in the shared folder. Units send their distinct bigrams with counts to buckets of
bigrams, and buckets answer each unit with the sums over all units; so what is shuffled are a unit's distinct bigrams,
never its tokens, and no worker holds the table of all bigrams. The plan is the same at every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, get_file, grouped, in_pieces, put_file, release, rows_of, shared_dir, unzipped, written, zipped
from . import tokens as words

MU, ALPHA = 20.0, 0.1
#: Tokens and rows of a unit at most, tokens that are dealt to a bucket, and tokens that are scored at a time.
UNIT, ROWS, BUCKET, STEP = 3_000_000, 200_000, 4_000_000, 500_000
PARTS = "unit bigint, bucket bigint, blob binary"


class Bigrams:
    """Bigrams as numbers of ``bits`` bits, multiplied by an odd number so that ranges of them are even; one to one."""

    def __init__(self, size: int, buckets: int):
        self.size, self.bits = size, max((size * size - 1).bit_length(), 8)
        self.mask = np.uint64((1 << self.bits) - 1)
        self.odd = 0x9E3779B97F4A7C15 & int(self.mask) | 1
        self.back = pow(self.odd, -1, 1 << self.bits)
        self.lift = np.uint64(max(0, self.bits - buckets.bit_length() + 1))
        self.kind = "<u4" if self.bits <= 32 else "<u8"

    def of(self, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The bigram that ends at each token; ``first`` are the places of documents' first tokens, which follow the start mark."""
        before = np.r_[ids[:1], ids[:-1]].astype(np.uint64)
        before[first] = self.size - 1
        return (before * np.uint64(self.size) + ids.astype(np.uint64)) * np.uint64(self.odd) & self.mask

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod((keys.astype(np.uint64) * np.uint64(self.back) & self.mask).astype(np.int64), self.size)

    def slices(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """Bucket, start and stop of each bucket's part of sorted bigrams."""
        b = (own >> self.lift).astype(np.int64)
        cut = np.flatnonzero(np.r_[True, b[1:] != b[:-1], True]) if len(b) else np.zeros(1, dtype=np.int64)
        return [(int(b[a]), int(a), int(z)) for a, z in zip(cut, cut[1:], strict=False)]


def tokens(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, base: str, kind: np.dtype) -> DataFrame:
    """Writes unit files of token ids and documents' ends; ``unit, pos, doc_id, n`` of each row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = words.tokenizer(tokenizer)
        number = TaskContext.get().partitionId() << 24
        held: list[np.ndarray] = []
        ids: list[pa.Array] = []
        size = rows = 0

        def put() -> pa.RecordBatch:
            nonlocal number, held, ids, size, rows
            n = np.array([len(x) for x in held], dtype=np.int64)
            put_file(f"{base}/unit-{number}", zipped(np.concatenate(held).astype(kind), np.cumsum(n)))
            out = pa.RecordBatch.from_arrays([pa.array(np.full(len(n), number)), pa.array(np.arange(len(n), dtype=np.int32)), pa.concat_arrays(ids), pa.array(n)], names=["unit", "pos", "doc_id", "n"])
            number += 1
            held, ids, size, rows = [], [], 0, 0
            return out

        for batch in in_pieces(batches, "text", 4 << 20):
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                if rows and rows + some.num_rows > ROWS:
                    yield put()
                held += tok.encode_all(some.column("text"))
                ids.append(some.column("doc_id"))
                size, rows = sum(map(len, held[rows:])) + size, len(held)
                if size >= UNIT:
                    yield put()
        if held:
            yield put()
        release()

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(work, f"unit bigint, pos int, doc_id {id_type}, n bigint")


def _vocabulary(told: DataFrame, size: int) -> np.ndarray:
    """Sums of the buckets' counts of contexts and words, two models each: one small array, by way of a few partial sums."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 * size, dtype=np.int64)
        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                total += unzipped(blob, "<i8")[0]
        yield rows_of(PARTS, [(-1, -1, zipped(total))])

    parts = told.where("unit = -1")
    some = max(1, int(parts.count() ** 0.5))
    last = parts.repartition(some).mapInArrow(add, PARTS).coalesce(1).mapInArrow(add, PARTS).first()
    return unzipped(bytes(last["blob"]), "<i8")[0].reshape(4, size)


def cross_entropy_difference(docs: DataFrame, labels: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, target_loss, background_loss, score`` of every row.

    ``labels`` has ``doc_id, quality, toxic``; a document is target if all its labels are 1 and 0. Losses are means per token; without a token
    (null or empty text) they and the score are null. Rows with null ids are scored but no target; repeated rows count
    and are scored each, so a copy is known to the models that score the other. Without (other) target rows the target
    model knows nothing but the vocabulary. An empty table gives no row; other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    base = shared_dir(spark, "lm")
    size = max(Tokenizer.from_file(tokenizer).get_vocab().values()) + 2
    kind = np.dtype("<u2") if size - 1 <= 1 << 16 else np.dtype("<u4")
    rows = written(tokens(docs, tokenizer, id_col, text_col, base, kind), "lm-rows")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    total = int(rows.agg(F.sum("n")).first()[0] or 0)
    buckets = 1 << max(4, (total // BUCKET).bit_length())
    grams = Bigrams(size, buckets)
    good = labels.groupBy(F.col("doc_id").alias("good_id")).agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(1))).alias("x")).where("q = 1 and x = 0").select("good_id")
    # only ids are joined
    flagged = rows.join(good, rows.doc_id == good.good_id, "left").select("unit", F.struct("pos", "doc_id", F.col("good_id").isNotNull().alias("good")).alias("d"))
    units = written(flagged.groupBy("unit").agg(F.sort_array(F.collect_list("d")).alias("docs")), "lm-units")
    n_units = max(1, units.count())

    def unit_of(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids, documents' ends, distinct bigrams and which of them each token ends."""
        ids, stops = unzipped(get_file(f"{base}/unit-{number}"), kind, "<i8")
        first = np.r_[0, stops[:-1]][np.diff(np.r_[0, stops]) > 0]
        own, which = np.unique(grams.of(ids, first).astype(grams.kind), return_inverse=True)
        return ids, stops, own, which

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Distinct bigrams of each unit for each bucket, with counts over all documents and over target documents."""
        for batch in batches:
            for number, members in zip(batch.column("unit").to_pylist(), batch.column("docs").to_pylist(), strict=True):
                _, stops, own, which = unit_of(number)
                target = np.repeat([d["good"] for d in members], np.diff(np.r_[0, stops])).astype(bool)
                n, t = np.bincount(which, minlength=len(own)).astype("<u4"), np.bincount(which[target], minlength=len(own)).astype("<u4")
                yield rows_of(PARTS, [(number, b, zipped(own[a:z], n[a:z], t[a:z])) for b, a, z in grams.slices(own)])
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's sums, for each unit those of its bigrams; with unit -1 the sums by context and by word."""
        vocabulary = np.zeros((4, size), dtype=np.int64)
        for bucket, parts in grouped(batches, "bucket"):
            keys, n, t = zip(*(unzipped(r.pop("blob"), grams.kind, "<u4", "<u4") for r in parts), strict=True)
            ends = np.cumsum([len(x) for x in keys])
            own, which = np.unique(np.concatenate(keys), return_inverse=True)
            # whole numbers below 2**53
            sums = [np.bincount(which, weights=np.concatenate(x), minlength=len(own)).astype("<i8") for x in (n, t)]
            v, w = grams.words(own)
            for i, (at, x) in enumerate(((v, sums[0]), (v, sums[1]), (w, sums[0]), (w, sums[1]))):
                vocabulary[i] += np.bincount(at, weights=x, minlength=size).astype(np.int64)
            for r, a, z in zip(parts, np.r_[0, ends[:-1]], ends, strict=True):
                yield rows_of(PARTS, [(r["unit"], bucket, zipped(sums[0][which[a:z]], sums[1][which[a:z]]))])
        if vocabulary.any():
            yield rows_of(PARTS, [(-1, -1, zipped(vocabulary.ravel()))])
        release()

    counted = units.repartition(n_units, "unit").mapInArrow(count, PARTS)
    told = written(counted.repartition(buckets, "bucket").sortWithinPartitions("bucket", "unit").mapInArrow(add, PARTS), "lm-told")
    shared = spark.sparkContext.broadcast(_vocabulary(told, size))  # bounded by the vocabulary

    def losses(ids: np.ndarray, n: np.ndarray, which: np.ndarray, counts: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
        """Background and target loss of some documents, each without its own counts."""
        doc = np.repeat(np.arange(len(n)), n)
        ends = np.cumsum(n)
        first, last = (ends - n)[n > 0], ends[n > 0] - 1
        _, of, times = np.unique(doc * np.int64(len(counts[0])) + which, return_inverse=True, return_counts=True)
        own_gram = times[of]
        _, of, times = np.unique(doc * np.int64(size) + ids, return_inverse=True, return_counts=True)
        own_word = times[of]
        # a word is a context as often as it occurs, but for the last place
        followed = own_word - (ids == ids[np.repeat(last, n[n > 0])])
        before, own_context = np.r_[ids[:1], ids[:-1]].astype(np.int64), np.r_[followed[:1], followed[:-1]]
        before[first], own_context[first] = size - 1, 1
        context, word = shared.value[:2], shared.value[2:]
        out = []
        for i in range(2):
            out_of = np.ones(len(doc), dtype=np.int64) if i == 0 else target[doc].astype(np.int64)
            p = (word[i][ids] - out_of * own_word + ALPHA) / (word[i].sum() - out_of * n[doc] + ALPHA * size)
            loss = np.log(context[i][before] - out_of * own_context + MU) - np.log(counts[i][which] - out_of * own_gram + MU * p)
            out.append(np.bincount(doc, weights=loss, minlength=len(n)))
        return out

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, parts in grouped(batches, "unit"):
            members = next(r["docs"] for r in parts if r["bucket"] < 0)
            ids, stops, own, which = unit_of(number)
            answers = [unzipped(r.pop("blob"), "<i8", "<i8") for r in parts if r["bucket"] >= 0]
            counts = [np.concatenate(x) if x else np.zeros(1, np.int64) for x in (zip(*answers, strict=True) if answers else ((), ()))]
            n, target = np.diff(np.r_[0, stops]), np.array([d["good"] for d in members], dtype=bool)
            sums = np.zeros((2, len(n)))
            a = 0
            while a < len(n):
                z = max(a + 1, int(np.searchsorted(stops, (stops[a - 1] if a else 0) + STEP, side="right")))
                x, y = int(stops[a - 1]) if a else 0, int(stops[z - 1])
                if y > x:
                    sums[:, a:z] = losses(ids[x:y], n[a:z], which[x:y], counts, target[a:z])
                a = z
            none = n == 0
            b, t = (np.where(none, np.nan, s / np.maximum(n, 1)) for s in sums)
            yield pa.RecordBatch.from_arrays([pa.array([d["doc_id"] for d in members], id_arrow), pa.array(n), *(pa.array(s, mask=none) for s in (t, b, b - t))], names=["doc_id", "n_tokens", "target_loss", "background_loss", "score"])
        release()

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    asked = units.select("unit", F.lit(-1).cast("long").alias("bucket"), "docs", F.lit(None).cast("binary").alias("blob"))
    answered = told.where("unit >= 0").select("unit", "bucket", F.lit(None).cast(units.schema["docs"].dataType).alias("docs"), "blob")
    out = f"doc_id {id_type}, n_tokens bigint, target_loss double, background_loss double, score double"
    scored = written(asked.unionByName(answered).repartition(n_units, "unit").sortWithinPartitions("unit", "bucket").mapInArrow(score, out), "lm-scores")
    drop_written(spark, base)
    return scored
