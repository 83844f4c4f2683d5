"""Filters, samples and counts of a corpus: ``doc_id, category, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.arrow import free_name
from ..profiles import LanguageProfile

LEAST_LETTERS, LEAST_DOCS = 500, 3


def with_letters(df: DataFrame, p: LanguageProfile, text_col: str = "text") -> DataFrame:
    return df.withColumn("letters", X.letter_count(F.col(text_col), p))


def healthy(df: DataFrame, p: LanguageProfile, text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """Rows with enough letters."""
    return with_letters(df, p, text_col).where(F.col("letters") >= least)


def rejected(df: DataFrame, p: LanguageProfile, text_col: str = "text", least: int = LEAST_LETTERS) -> DataFrame:
    """The other rows, for the record."""
    return with_letters(df, p, text_col).where(F.coalesce(F.col("letters"), F.lit(0)) < least)


def category_counts(df: DataFrame, category_col: str = "category") -> DataFrame:
    return df.groupBy(category_col).agg(F.count("*").alias("docs")).orderBy(category_col)


def draw_key(seed: int | str, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}-"), F.col(id_col).cast("string")))


def sample(df: DataFrame, n: int, seed: int | str = 42, category_col: str | None = "category", id_col: str = "doc_id", most: int = 100_000) -> DataFrame:
    """``n`` documents of each category (all, if it has fewer), drawn by a seeded hash of the id; rows of one id are one document.

    Only ids and categories are ranked, and each task passes on no more than ``n`` of a category. Up to ``most`` drawn ids are
    looked up where the rows are read, so that no text is sorted or shuffled; more of them are joined.
    """
    names = [free_name(df.columns, x) for x in ("drawn_id", "drawn_category", "drawn_key")]
    an_id, cat, key = names
    slim = df.select(F.col(id_col).alias(an_id), (F.col(category_col) if category_col else F.lit(0)).alias(cat), draw_key(seed, id_col).alias(key))
    ranked = slim.withColumn("rank", F.dense_rank().over(Window.partitionBy(cat).orderBy(key))).where(F.col("rank") <= n).select(an_id, cat).distinct()
    rows = ranked.limit(most + 1).collect()
    drawn = F.broadcast(df.sparkSession.createDataFrame(rows, ranked.schema)) if len(rows) <= most else ranked
    same = F.col(id_col).eqNullSafe(F.col(an_id))
    return df.join(drawn, same & F.col(category_col).eqNullSafe(F.col(cat)) if category_col else same, "left_semi")


def guarded(df: DataFrame, p: LanguageProfile, categories: list[str], category_col: str = "category", text_col: str = "text", least: int = LEAST_LETTERS) -> tuple[DataFrame, Observation]:
    """``healthy`` rows, and an observation that has, after any action on them, what that one pass met: ``docs`` and ``healthy`` of
    all rows and, as ``docs_0``, ``healthy_0`` and on, of the given categories. ``enough`` then judges it."""
    seen = Observation()
    letters = free_name(df.columns, "letters")
    counted = df.withColumn(letters, X.letter_count(F.col(text_col), p))
    good = F.coalesce(F.col(letters) >= least, F.lit(False))
    each = [x for i, c in enumerate(categories) for own in [F.col(category_col).eqNullSafe(F.lit(c))] for x in (F.count_if(own).alias(f"docs_{i}"), F.count_if(own & good).alias(f"healthy_{i}"))]
    return counted.observe(seen, F.count(F.lit(1)).alias("docs"), F.count_if(good).alias("healthy"), *each).where(good), seen


def enough(seen: Observation, categories: list[str], least: int = LEAST_DOCS) -> list[tuple[str, int, int]]:
    """``category, healthy, rejected`` of what an observation met; an error if fewer than ``least`` documents were healthy."""
    got = seen.get
    if got["healthy"] < least:
        raise ValueError(f"at least {least} documents are needed, found {got['healthy']}")
    return [(c, got[f"healthy_{i}"], got[f"docs_{i}"] - got[f"healthy_{i}"]) for i, c in enumerate(categories)]


def require(df: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The same rows; an error if there are too few."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"at least {least} documents are needed, found {found}")
    return df


def _any_of(terms: DataFrame, text_col: str, term_col: str, most: int) -> Column:
    """Whether the text contains some term; the terms are held by every task, so there may be ``most`` of them."""
    rows = terms.select(term_col).where(F.col(term_col).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has more than {most} terms")
    return F.exists(F.array(*[F.lit(r[0]) for r in rows]).cast("array<string>"), lambda k: F.contains(F.col(text_col), k))


def with_any(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most: int = 10_000) -> DataFrame:
    """Rows that contain some term of a lexicon table of at most ``most`` terms."""
    return df.where(_any_of(terms, text_col, term_col, most))


def without_any(df: DataFrame, terms: DataFrame, text_col: str = "text", term_col: str = "term", most: int = 10_000) -> DataFrame:
    """Rows that contain none; null texts contain none."""
    return df.where(~F.coalesce(_any_of(terms, text_col, term_col, most), F.lit(False)))


def term_counts(df: DataFrame, terms: list[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ord, term, n`` for the terms that occur; one pass over the text, rows only for hits."""
    each = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(k).alias("term"), X.literal_count(F.col(text_col), k).alias("n")) for i, k in enumerate(terms)])
    return df.select(F.col(id_col), F.inline(F.filter(each, lambda x: x["n"] > 0)))


def union_all(*frames: DataFrame) -> DataFrame:
    """Given and sampled rows together, repeats kept."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def frequencies(df: DataFrame, dictionary: DataFrame, term_col: str = "term") -> DataFrame:
    """``df`` with ``freq``, the term's dictionary frequency, -1 if it has none; a ``freq`` that ``df`` has is an error."""
    if "freq" in df.columns:
        raise ValueError("the rows have a column freq already")
    key = free_name(df.columns, "dictionary_term")
    d = dictionary.select(F.col("term").alias(key), F.col("freq"))
    return df.join(d, F.col(term_col) == F.col(key), "left").drop(key).withColumn("freq", F.coalesce("freq", F.lit(-1)).cast("long"))
