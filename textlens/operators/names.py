"""Candidate person names in Chinese text: patterns by kind of surname, then checks against a dictionary."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

from .. import lexicons as L
from ..functions import text as X
from ..functions.arrow import pieces

_HAN = "[一-鿿]"
_COMPOUND = "|".join(L.COMPOUND_SURNAMES)
_SURE = L.STRONG_SURNAMES + L.MEDIUM_SURNAMES
# what a letter may be, as bits; letters beyond the basic plane are none of these
HAN, SURE, WEAK, COMPOUND, AFTER, UNLIKELY, NUMERAL = (1 << i for i in range(7))
_KINDS = np.zeros(1 << 16, dtype=np.uint8)
_KINDS[0x4E00 : 0x9FFF + 1] = HAN
for _chars, _kind in ((_SURE, SURE), (L.WEAK_SURNAMES, WEAK), ([x[0] for x in L.COMPOUND_SURNAMES], COMPOUND), (L.NAME_CONTEXT, AFTER), (L.UNLIKELY_SECOND, UNLIKELY), (L.NUMERALS, NUMERAL)):
    _KINDS[[ord(c) for c in _chars]] |= _kind
_PAIRS = np.array([ord(a) << 16 | ord(b) for a, b in L.COMPOUND_SURNAMES], dtype=np.uint32)


def _at(n: Column, i: int) -> Column:
    return F.substring(n, i, 1)


def _in(c: Column, chars: str) -> Column:
    return c.rlike(f"^[{chars}]")


def _apart(at: np.ndarray, size: int) -> np.ndarray:
    """Which of the sorted places a search from the left takes, if each match takes ``size`` letters.

    A place that none before reaches is taken; what follows from it is marked by jumps of doubled length.
    """
    n = len(at)
    taken = np.ones(n + 1, dtype=bool)
    taken[1:n] = np.diff(at) >= size
    jump = np.append(np.searchsorted(at, at + size), n)
    while True:
        before = np.count_nonzero(taken)
        taken[jump[taken]] = True
        if np.count_nonzero(taken) == before:
            return taken[:n]
        jump = jump[jump]


def _keys(letters: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` letters from each place as one number, in the order of the names."""
    out = np.zeros(len(at), dtype=np.uint64)
    for i in range(size):
        out |= letters[at + i].astype(np.uint64) << np.uint64(48 - 16 * i)
    return out


def _candidates(kinds: np.ndarray, letters: np.ndarray, at: np.ndarray) -> dict[int, list[np.ndarray]]:
    """Places of the matches, by the name's length, among the places ``at`` of surnames.

    Patterns: a surname of each kind with one or two letters before a context letter; a weak one with one letter has no Han
    letter before it. Each is searched by itself, from the left.
    """
    own = kinds[at]
    han = [(kinds[at + i] & HAN) > 0 for i in (1, 2, 3)]
    ends = {i: (kinds[at + i] & AFTER) > 0 for i in (2, 3, 4)}
    sure, weak = (own & SURE) > 0, (own & WEAK) > 0
    first = (own & COMPOUND) > 0
    first[first] = np.isin(letters[at[first]].astype(np.uint32) << 16 | letters[at[first] + 1], _PAIRS)
    found = [
        (3, first & han[1] & ends[3]),
        (4, first & han[1] & han[2] & ends[4]),
        (2, sure & han[0] & ends[2]),
        (3, sure & han[0] & han[1] & ends[3]),
        (3, weak & han[0] & han[1] & ends[3]),
        (2, weak & han[0] & ends[2] & ((kinds[at - 1] & HAN) == 0)),
    ]
    out: dict[int, list[np.ndarray]] = {2: [], 3: [], 4: []}
    for size, hit in found:
        places = at[hit]
        out[size].append(places[_apart(places, size)])
    return out


def _good(kinds: np.ndarray, letters: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Which names no rule on their letters excludes."""
    if size == 4:
        return np.ones(len(at), dtype=bool)
    second = kinds[at + 1]
    if size == 2:
        return (second & (UNLIKELY | SURE | WEAK)) == 0
    return ((second & (UNLIKELY | NUMERAL)) == 0) & (letters[at + 1] != letters[at])


def _found(texts: list[str], with_before: bool) -> tuple[np.ndarray, list[str], np.ndarray, list[list[str]] | None]:
    """Of each candidate in a batch of texts: its text's number, the name, how often it occurs, and the letters before it."""
    whole = "\0" + "".join(t + "\0" for t in texts) + "\0" * 4
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), "<u4")
    letters = np.where(points < 1 << 16, points, 0).astype(np.uint16)
    kinds = _KINDS[letters]
    stops = np.cumsum([len(t) + 1 for t in texts])  # of the texts' end marks
    at = np.flatnonzero(kinds & (SURE | WEAK | COMPOUND))
    rows, names_, times, heads = [], [], [], []
    for size, places in _candidates(kinds, letters, at).items():
        where = np.concatenate(places)
        where = where[_good(kinds, letters, where, size)]
        if not len(where):
            continue
        known, name = np.unique(_keys(letters, where, size), return_inverse=True)
        pairs = np.unique(np.searchsorted(stops, where) * len(known) + name)
        # all places of these names, by text and name
        inside = at[np.logical_and.reduce([(kinds[at + i] & HAN) > 0 for i in range(1, size)])]
        key = _keys(letters, inside, size)
        name = np.minimum(np.searchsorted(known, key), len(known) - 1)
        inside, name = inside[known[name] == key], name[known[name] == key]
        pair = np.searchsorted(stops, inside) * len(known) + name
        rank = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
        inside, rank = inside[pairs[rank] == pair], rank[pairs[rank] == pair]
        order = np.argsort(rank, kind="stable")
        inside, rank = inside[order], rank[order]
        taken = _apart(rank * (len(points) + size) + inside, size)
        inside, rank = inside[taken], rank[taken]
        rows.append(pairs // len(known))
        spelt = [k.to_bytes(8, "big").decode("utf-16-be")[:size] for k in known.tolist()]
        names_ += [spelt[k] for k in (pairs % len(known)).tolist()]
        times.append(np.bincount(rank, minlength=len(pairs)))
        if with_before:
            starts = np.isin(inside - 1, np.append(0, stops))
            own = ["" if first else whole[i - 1] for i, first in zip(inside.tolist(), starts.tolist(), strict=True)]
            cut = np.searchsorted(rank, np.arange(len(pairs) + 1)).tolist()
            heads += [list(dict.fromkeys(own[a:z])) for a, z in zip(cut, cut[1:], strict=False)]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), names_, np.concatenate([none, *times]), heads if with_before else None


def verified(rows: DataFrame, dictionary: DataFrame, compat: bool = False) -> DataFrame:
    """``doc_id, name, times, before`` rows (``before``: the characters before the name) that hold against ``term, freq``.

    ``compat`` drops all three-letter names of sure surnames. A distinct name (with what is before it) is looked up once.
    """
    def look(df: DataFrame, value: Column, name: str) -> DataFrame:
        d = dictionary.select(F.col("term").alias(f"_{name}"), F.col("freq").alias(name))
        return df.join(d, value == F.col(f"_{name}"), "left").drop(f"_{name}").withColumn(name, F.coalesce(name, F.lit(-1)))

    n = F.col("name")
    own = look(look(rows.select("name").distinct(), n, "freq"), F.left(n, F.lit(2)), "freq2")
    heads = rows.select(F.explode("before").alias("_before"), _at(n, 1).alias("_first")).distinct()
    weak, three = _in(n, L.WEAK_SURNAMES), F.length(n) == 3
    compound = n.rlike(f"^(?:{_COMPOUND})")
    low = F.col("freq") <= F.when(weak, 200).otherwise(500)
    # whether some occurrence is free doesn't matter for every kind
    sure = F.when(compound, True).when(weak & ~three, low | n.isin(L.NAME_WHITELIST)).when(~weak & three, low & F.lit(not compat))
    freely = F.when(weak, low & (F.col("freq2") <= 200)).otherwise(low)
    judged = own.select("name", sure.alias("_sure"), freely.alias("_freely"))
    looked = look(heads, F.concat("_before", "_first"), "freq_before")
    bound = F.when(_in(F.col("_first"), L.WEAK_SURNAMES), 200).otherwise(500)
    bad = looked.where(~((F.col("_before") == "") | ~F.col("_before").rlike(_HAN) | (F.col("freq_before") <= bound)))
    bad = bad.groupBy("_first").agg(F.collect_set("_before").alias("_bound"))  # characters that start a word with this surname
    out = rows.join(judged, "name").join(bad, _at(n, 1) == F.col("_first"), "left")
    free = F.exists("before", lambda b: ~F.coalesce(F.array_contains("_bound", b), F.lit(False)))
    return out.where(F.coalesce(F.col("_sure"), F.col("_freely") & free)).select("doc_id", "name", "times", "before")


def named(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_before: bool = True) -> DataFrame:
    """``doc_id, name, times, before`` of each candidate (``before`` if asked for).

    Batches of texts are searched as one row of letters, so that the work is that of the letters, whatever the number of
    names; no text is shuffled.
    """
    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([slim.schema["doc_id"]]).add("name", "string").add("times", "long")
    if with_before:
        schema.add("before", ArrayType(StringType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(t or b"").decode("utf-8", "replace") for t in batch.column("text").cast(pa.binary()).to_pylist()]
            row, name, times, before = _found(texts, with_before)
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(name, pa.string()), pa.array(times, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(before, pa.list_(pa.string()))] if with_before else [])], names=schema.names)

    return slim.mapInArrow(work, schema)


def names(df: DataFrame, dictionary: DataFrame | None = None, compat: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, name, times``: one name of each group that starts alike.

    A group is the first two letters, for compound surnames the first three (``compat``: two). Its best member doesn't end
    in a verb of speech, then occurs most, then is longest, then is last in code-point order.
    """
    rows = named(df, id_col, text_col, dictionary is not None)
    if dictionary is not None:
        rows = verified(rows, dictionary, compat)
    n = F.col("name")
    group = F.left(n, F.lit(2) if compat else F.when(n.rlike(f"^(?:{_COMPOUND})"), 3).otherwise(2))
    best = F.max(F.struct((~_in(F.right(n, F.lit(1)), L.SPEECH_TAIL)).alias("clean"), F.col("times"), F.length(n).alias("size"), n.alias("name"))).alias("x")
    return rows.groupBy("doc_id", group.alias("g")).agg(best).select("doc_id", "x.name", "x.times")


def prefix_pairs(names_: Column) -> Column:
    """``struct(short, long)`` for each two names of an array of which one begins with the other.

    A walk over the sorted names keeps a stack of those that the present one begins with: a name that it doesn't begin
    with can't begin any later one. So the work is that of the pairs there are.
    """
    empty = F.struct(F.array().cast("array<string>").alias("stack"), F.array().cast("array<struct<short:string,long:string>>").alias("pairs"))

    def step(state: Column, name: Column) -> Column:
        found = lambda kept: F.struct(F.array_append(kept, name).alias("stack"), F.concat(state["pairs"], F.transform(kept, lambda a: F.struct(a.alias("short"), name.alias("long")))).alias("pairs"))
        return X.bind(F.filter(state["stack"], lambda a: F.startswith(name, a)), found)

    return F.aggregate(F.sort_array(F.array_distinct(names_)), empty, step)["pairs"]


def capitalised(t: Column, least: int = 3) -> Column:
    """Distinct capitalised words of Latin script with so many letters at least: what may be a name there."""
    words = F.regexp_extract_all(t, F.lit("([A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)"), F.lit(1))
    return F.filter(F.array_distinct(words), lambda w: F.length(w) >= least)


def latin_aliases(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, short, long``: capitalised words of a document of which one begins with the other; in its own row, without a shuffle."""
    return df.select(F.col(id_col).alias("doc_id"), F.inline(prefix_pairs(capitalised(F.col(text_col)))))


def aliases(df: DataFrame, dictionary: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, short, long``: names of a document of which one starts with the other, before one is chosen for a group.

    What only adds a verb of speech is no other name.
    """
    rows = named(df, id_col, text_col, dictionary is not None)
    if dictionary is not None:
        rows = verified(rows, dictionary)
    pairs = rows.groupBy("doc_id").agg(F.collect_set("name").alias("c")).select("doc_id", F.inline(prefix_pairs(F.col("c"))))
    return pairs.where(~_in(F.right("long", F.lit(1)), L.SPEECH_TAIL))


def alias_findings(found: DataFrame) -> DataFrame:
    """``doc_id, severity, rule, value, term``: a warning for each document with names of which one may be another's short form."""
    pair = F.concat("short", F.lit(" → "), "long")
    listed = found.groupBy("doc_id").agg(F.count("*").cast("double").alias("value"), F.array_join(F.sort_array(F.collect_set(pair)), ", ").alias("term"))
    return listed.select("doc_id", F.lit("warn").alias("severity"), F.lit("aliases").alias("rule"), "value", "term")


def cast_findings(found: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, severity, rule, value, term``: how many names a document has, and the first eight of them in order."""
    n = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.array_join(F.slice(F.sort_array(F.collect_set("name")), 1, 8), ",").alias("term"))
    rows = docs.select("doc_id").join(n, "doc_id", "left").withColumn("value", F.coalesce("n", F.lit(0)).cast("double"))
    return rows.select("doc_id", F.when((F.col("value") > 10) | (F.col("value") == 0), "warn").otherwise("pass").alias("severity"), F.lit("names").alias("rule"), "value", F.coalesce("term", F.lit("")).alias("term"))


def tiers(found: DataFrame) -> DataFrame:
    """``doc_id`` and how many names have compound, strong, medium and weak surnames."""
    n = F.col("name")
    kinds = {"compound": n.rlike(f"^(?:{_COMPOUND})"), "strong": _in(n, L.STRONG_SURNAMES), "medium": _in(n, L.MEDIUM_SURNAMES), "weak": _in(n, L.WEAK_SURNAMES)}
    return found.groupBy("doc_id").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
