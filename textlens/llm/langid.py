"""Language ID of mixed-language text: script ranges narrow the candidates, Viterbi over words labels the spans.

Each word (a run of letters) is scored per language by its letter trigrams, whose counts come from all training rows
and are held in ``BUCKETS`` hashed cells per language, so the model's size is bounded. Languages that don't use the
word's script pay a penalty that no word's letters make up for, so they are chosen only where no language uses it. The best labelling of a text's words pays ``SWITCH`` for each change of language.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, in_pieces, written

BUCKETS, SWITCH, SMOOTH, OFF_SCRIPT = 1 << 16, 8.0, 0.1, 60.0
#: Languages of a model at most: each takes a row of counts in every task, so more (a dirty column) are an error.
LANGUAGES = 500
#: Words of a block: the labelling runs over all blocks of a batch side by side, so long texts need no more steps.
BLOCK = 192
#: Bytes of text that are labelled together; arrays take some 60 times as much.
PIECE = 1 << 20

#: First code point of each script range, and its script; ranges end where the next starts.
SCRIPTS = {
    0x0000: "Latin", 0x0370: "Greek", 0x0400: "Cyrillic", 0x0530: "Armenian", 0x0590: "Hebrew", 0x0600: "Arabic", 0x0700: "Other", 0x0750: "Arabic", 0x0780: "Other",
    0x0900: "Devanagari", 0x0980: "Bengali", 0x0A00: "Other", 0x0B80: "Tamil", 0x0C00: "Other", 0x0E00: "Thai", 0x0E80: "Other", 0x10A0: "Georgian", 0x1100: "Hangul", 0x1200: "Other",
    0x1E00: "Latin", 0x1F00: "Greek", 0x2000: "Other", 0x3040: "Kana", 0x3100: "Other", 0x3400: "Han", 0xA000: "Other", 0xAC00: "Hangul", 0xD7B0: "Other", 0xF900: "Han", 0xFB00: "Latin", 0xFB07: "Other", 0x20000: "Han", 0x323B0: "Other",
}
NAMES = sorted(set(SCRIPTS.values()))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # language x bucket: log probability of a trigram
    uses: np.ndarray  # language x script: whether the language is a candidate for the script's words


class _Letters:
    """Words of a batch of texts as arrays over code points."""

    table: np.ndarray | None = None
    marks: np.ndarray | None = None

    def __init__(self, texts: list[str | None]):
        if _Letters.table is None:
            # letters, and the vowel signs and accents that belong to them
            for name, some in (("table", "LM"), ("marks", "M")):
                setattr(_Letters, name, np.fromiter((unicodedata.category(chr(c))[0] in some for c in range(0x110000)), dtype=bool, count=0x110000))
        low = [(t or "").lower() for t in texts]
        points = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        letter = _Letters.table[np.minimum(points, 0x10FFFF)]
        starts = np.cumsum([1, *(len(t) + 1 for t in low)])[:-1]  # of texts
        edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
        self.first, self.stop = edge[::2], edge[1::2]  # of words
        marks = _Letters.marks[np.minimum(points, 0x10FFFF)]
        if marks.any():  # marks alone are no word
            bare = np.cumsum(letter & ~marks)
            word = bare[self.stop - 1] > bare[self.first - 1]
            for a, z in zip(self.first[~word].tolist(), self.stop[~word].tolist(), strict=True):
                letter[a:z] = False
            self.first, self.stop = self.first[word], self.stop[word]
        self.size = (self.stop - self.first).astype(np.int64)
        at = np.flatnonzero(letter)
        seq = np.where(letter, points, 0x20).astype(np.uint64)
        h = seq[at - 1] * np.uint64(0x9E3779B97F4A7C15) + seq[at] * np.uint64(0xC2B2AE3D27D4EB4F) + seq[at + 1] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        self.bucket = ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).astype(np.int64) % BUCKETS
        self.from_ = np.cumsum(self.size) - self.size  # of words in bucket
        self.doc = np.searchsorted(starts, self.first, side="right") - 1
        bounds = np.array([*SCRIPTS])
        ids = np.array([NAMES.index(s) for s in SCRIPTS.values()])
        self.script = ids[np.searchsorted(bounds, points[self.first], side="right") - 1]


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model from all rows with text and language. Counts are summed on the executors; the driver gets at most ``BUCKETS`` and the number of scripts for each language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], np.ndarray] = {}
        for batch in in_pieces(batches, "text", PIECE):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            words = _Letters(batch.column("text").to_pylist())
            per_letter = np.repeat(words.doc, words.size)
            for lang in set(langs):
                own = langs == lang
                for kind, found, n in (("gram", words.bucket[own[per_letter]], BUCKETS), ("script", words.script[own[words.doc]], len(NAMES))):
                    if (lang, kind) not in totals:
                        if len(totals) >= 2 * LANGUAGES:
                            raise ValueError(f"more than {LANGUAGES} languages")
                        totals[lang, kind] = np.zeros(n, dtype=np.int64)
                    totals[lang, kind] += np.bincount(found, minlength=n)
        for (lang, kind), n in totals.items():
            hit = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array([kind] * len(hit), pa.string()), pa.array(hit), pa.array(n[hit])], names=["lang", "kind", "at", "n"])

    known = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sums = written(known.mapInArrow(count, "lang string, kind string, at bigint, n bigint").groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")), "langid-counts")
    if sums.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    sums = sums.toPandas()  # at most BUCKETS and the number of scripts for each language
    languages = sorted(set(sums["lang"]))
    grams, scripts = np.zeros((len(languages), BUCKETS)), np.zeros((len(languages), len(NAMES)))
    row = sums["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(dtype=int)
    for kind, to in (("gram", grams), ("script", scripts)):
        of = (sums["kind"] == kind).to_numpy()
        to[row[of], sums["at"].to_numpy()[of]] = sums["n"].to_numpy()[of]
    total = grams.sum(1, keepdims=True)
    scores = np.log((grams + SMOOTH) / (total + SMOOTH * BUCKETS)).astype(np.float32)
    return Model(languages, scores, scripts >= 0.01 * np.maximum(1, scripts.sum(1, keepdims=True)))


def label_words(emit: np.ndarray, doc: np.ndarray, switch: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """The best label of each word: maximum of the summed ``emit`` (word x language) less ``switch`` per change inside a text.

    Exact Viterbi in blocks: what each block makes of every state it may be entered with is computed for all blocks
    together, the blocks of a text are then chained, and labels are read backwards the same way. Ties go to the state
    that stays, then to the smaller language.
    """
    n, k = emit.shape
    if not n:
        return np.zeros(0, dtype=np.int64)
    new = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[new, n])
    per = -(-size // block)
    first = np.repeat(new, per) + block * (np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per))
    long = np.minimum(block, np.repeat(new + size, per) - first)
    b = len(first)
    order = np.argsort(-long, kind="stable")  # blocks that still have a word at step t are a prefix
    first, long = first[order], long[order]
    live = np.searchsorted(-long, -np.arange(block), side="left")
    place = np.empty(b, dtype=np.int64)
    place[order] = np.arange(b)

    def chain(step) -> None:
        """Call ``step`` with the j-th blocks of all texts that have one, for each j."""
        for j in range(per.max()):
            at = (np.cumsum(per) - per)[per > j] + j
            step(place[at], place[at - 1] if j else None)

    # 1. through each block from every state of the word before it
    through = np.full((b, k, k), -np.inf)
    through[:, np.arange(k), np.arange(k)] = 0
    for t in range(block):
        if not (m := live[t]):
            break
        v = through[:m]
        through[:m] = np.maximum(v, v.max(2, keepdims=True) - switch) + emit[first[:m] + t][:, None, :]
    # 2. scores with which each block is entered; a text's first word has no change
    enter = np.zeros((b, k))
    leave = np.zeros((b, k))

    def forward(now, before):
        if before is not None:
            enter[now] = leave[before]
        leave[now] = (enter[now][:, :, None] + through[now]).max(1)

    chain(forward)
    # 3. where each state of each word comes from
    came = np.zeros((n, k), dtype=np.uint8 if k < 256 else np.uint16)
    v = enter.copy()
    for t in range(block):
        if not (m := live[t]):
            break
        best = v[:m].argmax(1)
        top = v[:m][np.arange(m), best] - switch
        came[first[:m] + t] = np.where(v[:m] >= top[:, None], np.arange(k), best[:, None])
        v[:m] = np.maximum(v[:m], top[:, None]) + emit[first[:m] + t]
    # 4. the state before a block for each state at its end, then the ends of all blocks, then all labels
    back = np.tile(np.arange(k), (b, 1))
    for t in range(block - 1, -1, -1):
        if m := live[t]:
            back[:m] = np.take_along_axis(came[first[:m] + t].astype(np.int64), back[:m], 1)
    end = np.zeros(b, dtype=np.int64)
    lasts = place[np.cumsum(per) - 1]
    end[lasts] = v[lasts].argmax(1)
    for j in range(per.max() - 1, 0, -1):
        at = (np.cumsum(per) - per)[per > j] + j
        end[place[at - 1]] = back[place[at], end[place[at]]]
    labels = np.zeros(n, dtype=np.int64)
    state = end.copy()
    for t in range(block - 1, -1, -1):
        if m := live[t]:
            labels[first[:m] + t] = state[:m]
            state[:m] = came[first[:m] + t, state[:m]]
    return labels


def _label(texts: list[str | None], model: Model, switch: float) -> tuple[_Letters, np.ndarray]:
    words = _Letters(texts)
    if not len(words.first) or not model.languages:
        return words, np.zeros(len(words.first), dtype=np.int64)
    emit = np.add.reduceat(model.scores.T[words.bucket], words.from_, axis=0).astype(np.float64)
    may = model.uses.T[words.script]
    emit -= OFF_SCRIPT * (~may & may.any(1, keepdims=True))
    return words, label_words(emit, words.doc, switch)


def spans(text: str | None, model: Model, switch: float = SWITCH) -> list[tuple[int, int, str]]:
    """Spans ``(start, stop, language)`` of one text, in code points of its lower-cased form, from first to last letter of each."""
    words, labels = _label([text], model, switch)
    out: list[tuple[int, int, str]] = []
    for a, z, x in zip((words.first - 1).tolist(), (words.stop - 1).tolist(), labels.tolist(), strict=True):
        if out and out[-1][2] == model.languages[x]:
            out[-1] = (out[-1][0], z, model.languages[x])
        else:
            out.append((a, z, model.languages[x]))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score", switch: float = SWITCH) -> DataFrame:
    """``docs`` with the language that has most letters and its share of all letters.

    ``und`` and 0 where the text is null or has no letter, or if nothing was learned. Whole texts count. All columns stay, whatever
    their names; the two new ones have to be new. Rows are judged one by one, so repeated rows agree; no row gives none.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    if {lang_name.lower(), score_name.lower()} & {c.lower() for c in docs.columns}:
        raise ValueError("the new columns' names are taken")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS cells a language

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = max(1, len(model.languages))
        for batch in in_pieces(batches, text_col, max(1 << 16, PIECE // max(1, k * k // 64))):  # arrays hold the square of the languages a block
            texts = batch.column(text_col).to_pylist()
            words, labels = _label(texts, model, switch)
            share = np.bincount(words.doc * k + labels, weights=words.size, minlength=len(texts) * k).reshape(len(texts), k)
            total = share.sum(1)
            ok = (total > 0) & bool(model.languages)
            best = share.argmax(1)
            names = np.array([*model.languages, "und"], dtype=object)[np.where(ok, best, -1)]
            score = np.where(ok, share.max(1) / np.maximum(total, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score)], names=[*batch.schema.names, lang_name, score_name])

    schema = StructType([*docs.schema.fields, StructField(lang_name, StringType()), StructField(score_name, DoubleType())])
    return docs.mapInArrow(work, schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", switch: float = SWITCH) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row; learned from the rows that are not held out."""
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(slim, model, "text", switch=switch).drop("text")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` with a language: without those that are ``und`` or whose main language has under ``least`` of the letters.

    Null, empty and letterless texts go; repeated rows are judged each; null ids are judged but not learned from; texts of any
    length are scored whole; an empty table gives no row, and one without labelled rows for training keeps none. Columns of
    any name pass.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col)
    lang = free_name(docs.columns, "lang_pred")
    score = free_name(docs.columns, "lang_score")
    return predict(docs, model, text_col, lang, score).where((F.col(lang) != "und") & (F.col(score) >= least)).select(*docs.columns)
