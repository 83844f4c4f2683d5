"""Deterministic punctuation rewrites. All work on split pieces, so no character is exploded into rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..profiles import LanguageProfile


def raise_exclamations(t: Column, p: LanguageProfile, target: float) -> Column:
    """Turn every k-th period into an exclamation until there are ``target`` a sentence, k as even as it goes.

    Not the first character and none after a character of ``not_before_period``; those places are passed over.
    """
    if target <= 0:
        return t
    need = F.greatest(F.lit(0), (X.sentence_count(t, p) * target).cast("int") - X.literal_count(t, p.exclamation).cast("int"))

    def of(a: Column, need: Column) -> Column:
        periods = F.size(a) - 1
        step = F.greatest(F.lit(1), F.floor(periods / F.greatest(need, F.lit(1))).cast("int"))
        fits = lambda k: (k % step == 0) & ~F.element_at(a, k).rlike(rf"[{p.not_before_period}]\z") & ~((k == 1) & (F.element_at(a, 1) == ""))
        hits = F.slice(F.filter(F.sequence(F.lit(1), periods), fits), F.lit(1), need)
        mark = lambda i, hits: F.when(F.array_contains(hits, i + 1), p.exclamation).otherwise(p.period)
        join = lambda hits: F.array_join(F.transform(a, lambda x, i: F.concat(x, F.when(i >= periods, F.lit("")).otherwise(mark(i, hits)))), "")
        return F.when((periods > 0) & (need > 0), X.bind(hits, join)).otherwise(t)

    pieces = F.split(t, rf"\Q{p.period}\E", -1)
    return X.bind(F.struct(pieces.alias("a"), need.alias("n")), lambda s: of(s["a"], s["n"]))


def insert_commas(t: Column, p: LanguageProfile, least: int = 12, most: int = 30) -> Column:
    """A comma after the middle letter of sentences with ``least`` to ``most`` letters and none yet, unless that ends the sentence."""

    def of(s: Column) -> Column:
        n = X.letter_count(s, p)
        pattern = F.concat(F.lit(f"(?s)^((?:[^{p.letters}]*[{p.letters}]){{"), F.floor(n / 2).cast("string"), F.lit("})(?=.)"))
        return F.when(n.between(least, most) & ~F.contains(s, F.lit(p.comma)), F.regexp_replace(s, pattern, F.lit(f"$1{p.comma}"))).otherwise(s)

    return F.array_join(F.transform(X.sentence_pieces(t, p), of), "")


def adjusted(df: DataFrame, p: LanguageProfile, target: float, text_col: str = "text") -> DataFrame:
    """Both rewrites in order, with the counts before and after."""
    t = F.col(text_col)
    n = lambda c, mark: X.literal_count(c, mark)
    out = df.withColumn("rewritten", insert_commas(raise_exclamations(t, p, target), p))
    r = F.col("rewritten")
    return out.withColumns({"excl_before": n(t, p.exclamation), "excl_after": n(r, p.exclamation), "comma_before": n(t, p.comma), "comma_after": n(r, p.comma)})


def comma_pairs(t: Column, p: LanguageProfile) -> Column:
    """The two letters around each comma, without it."""
    found = F.regexp_extract_all(t, F.lit(f"(?=([{p.letters}]{p.comma}[{p.letters}]))"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.concat(F.left(x, F.lit(1)), F.right(x, F.lit(1)))))


def one_word(dictionary: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of ``pair`` rows, those that the most probable segmentation leaves whole: the pair's share beats its letters' product.

    ``dictionary`` has ``term, freq``; a letter that it lacks counts once.
    """
    total = dictionary.agg(F.greatest(F.sum("freq"), F.lit(1)).alias("total"))
    d = lambda name: dictionary.select(F.col("term").alias(f"_{name}"), F.col("freq").alias(name))
    rows = pairs.join(d("whole"), F.col("pair") == F.col("_whole")).join(d("a"), F.left("pair", F.lit(1)) == F.col("_a"), "left").join(d("b"), F.right("pair", F.lit(1)) == F.col("_b"), "left").crossJoin(F.broadcast(total))
    one = lambda c: F.log(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)))
    return rows.where((F.col("whole") > 0) & (one("whole") - F.log("total") >= one("a") + one("b") - 2 * F.log("total"))).select("pair")


def clean_commas(df: DataFrame, p: LanguageProfile, words: DataFrame, text_col: str = "text", most: int = 1_000_000) -> DataFrame:
    """``df`` with ``cleaned`` and ``removed``: commas between letters whose pair is one word (``words.pair``) go.

    Each comma depends on its original neighbours only, so a row is cleaned where it stands, whatever its id; the pairs,
    at most ``most``, are held by every worker, and rows with no such pair stay in the JVM.
    """
    rows = words.select("pair").distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} pairs")
    held = df.sparkSession.sparkContext.broadcast({r["pair"] for r in rows})
    comma = p.comma

    @F.pandas_udf(T.StringType())
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(text: str) -> str:
            pieces = text.split(comma)
            joins = ("" if a[-1:] + b[:1] in held.value else comma for a, b in zip(pieces, pieces[1:], strict=False))
            return pieces[0] + "".join(j + b for j, b in zip(joins, pieces[1:], strict=False))

        for texts in batches:
            yield texts.map(lambda t: one(t) if t is not None else None)

    t = F.col(text_col)
    cleaned = F.when(F.size(comma_pairs(t, p)) > 0, clean(t)).otherwise(t)
    return df.withColumn("cleaned", cleaned).withColumn("removed", (F.length(t) - F.length("cleaned")).cast("long"))
