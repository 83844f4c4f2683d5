"""Per-document fingerprints, frequent terms, and terms shared by a category's documents."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..profiles import LanguageProfile


def latin_tokens(t: Column) -> Column:
    return F.regexp_extract_all(F.lower(t), F.lit("[a-zà-ÿ]{2,}"), F.lit(0))


def bag_of(words: Column) -> Column:
    """An array of ``struct(term, n, first_pos)`` from an array of words: sorted with their places, then cut where the word changes."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.element_at(s, i)["term"] != F.get(s, i - 2)["term"]))
        cut = lambda b: F.transform(b, lambda i, k: F.struct(F.element_at(s, i)["term"].alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s) + 1) - i).cast("long").alias("n"), F.element_at(s, i)["pos"].alias("first_pos")))
        return F.when(F.size(s) > 0, X.bind(starts, cut)).otherwise(F.array().cast("array<struct<term:string,n:bigint,first_pos:int>>"))

    placed = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    return X.bind(F.sort_array(F.filter(placed, lambda x: F.length(x["term"]) >= 2)), runs)


def _words(p: LanguageProfile, tokens: Callable[[Column], Column], text_col: str, whole: bool) -> Column:
    t = F.col(text_col)
    return F.coalesce(tokens(t if whole else X.head_letters(t, X.letter_count(t, p), p)), F.array().cast("array<string>"))


def head_terms(df: DataFrame, p: LanguageProfile, tokens: Callable[[Column], Column] = latin_tokens, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """``doc_id, term, n, first_pos``: the bag of words of each row with where each comes first.

    ``whole`` takes all the text; otherwise only the letters of its head, as the Chinese profile does.
    """
    return df.select(id_col, F.inline(bag_of(_words(p, tokens, text_col, whole))))


def _top(bag: Column, stop: list[str], most: int, keep: int) -> Column:
    """Of the ``most`` frequent terms (ties: the one met first) the first ``keep`` that are no stop words."""
    order = F.sort_array(F.transform(bag, lambda x: F.struct((-x["n"]).alias("m"), x["first_pos"].alias("p"), x["term"].alias("term"))))
    return F.slice(F.filter(F.slice(order, 1, most), lambda x: ~x["term"].isin(stop)), 1, keep)


def top_terms(df: DataFrame, p: LanguageProfile, stop: list[str], tokens: Callable[[Column], Column] = latin_tokens, id_col: str = "doc_id", text_col: str = "text", whole: bool = True, most: int = 40, keep: int = 8) -> DataFrame:
    """``doc_id, rank, term, n`` of each row, without a shuffle."""
    top = df.select(id_col, F.posexplode(_top(bag_of(_words(p, tokens, text_col, whole)), stop, most, keep)).alias("i", "x"))
    return top.select(id_col, (F.col("i") + 1).alias("rank"), "x.term", (-F.col("x.m")).alias("n"))


def _measures(p: LanguageProfile, text_col: str) -> list[Column]:
    t = F.col(text_col)
    return [
        X.per_sentence(X.literal_count(t, p.exclamation), F.col("sentences")).alias("excl_per_sent"),
        X.per_sentence(X.literal_count(t, p.comma), F.col("sentences")).alias("comma_per_sent"),
        X.quote_in_head(t, F.col("chars")).alias("uses_quotes"),
        X.opening_lines(t, p).alias("opening_30_lines"),
    ]


def fingerprint(df: DataFrame, p: LanguageProfile, tokens: Callable[[Column], Column] = latin_tokens, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """All measures (ratios are raw doubles) and ``top_terms`` (an array of up to eight) of each row, in one projection."""
    t = F.col(text_col)
    base = df.select(id_col, text_col, X.letter_count(t, p).alias("chars"), F.greatest(X.sentence_count(t, p), F.lit(1)).cast("long").alias("sentences"))
    top = F.transform(_top(bag_of(_words(p, tokens, text_col, whole)), p.lists["stop"], 40, 8), lambda x: x["term"])
    return base.select(id_col, "chars", "sentences", *_measures(p, text_col), top.alias("top_terms"))


def term_documents(bag: DataFrame, docs: DataFrame, category_col: str = "category", id_col: str = "doc_id") -> DataFrame:
    """``category, term, docs``: in how many of the category's documents a term is. The bag has a row per document and term already."""
    return bag.select(id_col, "term").join(docs.select(id_col, category_col), id_col).groupBy(category_col, "term").agg(F.count("*").alias("docs"))


def shared_terms(counted: DataFrame, least: int = 3) -> DataFrame:
    return counted.where(F.col("docs") >= least)


def own_terms(counted: DataFrame, least: int = 3) -> DataFrame:
    return counted.where(F.col("docs") < least)


def category_terms(df: DataFrame, p: LanguageProfile, tokens: Callable[[Column], Column] = latin_tokens, category_col: str = "category", text_col: str = "text", whole: bool = True) -> DataFrame:
    """``category, term, docs, of``: in how many of all the category's documents each term is.

    A document gives each of its terms once, in its own row; counts are summed in the tasks before they are shuffled, so a
    term that all documents have is a row a task. Null categories are one.
    """
    words = F.filter(F.array_distinct(_words(p, tokens, text_col, whole)), lambda w: F.length(w) >= 2)
    counted = df.select(F.col(category_col).alias("category"), F.explode(words).alias("term")).groupBy("category", "term").agg(F.count("*").alias("docs"))
    sizes = df.groupBy(F.col(category_col).alias("size_of")).agg(F.count("*").alias("of"))
    return counted.join(sizes, F.col("category").eqNullSafe(F.col("size_of"))).drop("size_of")


def common_terms(counted: DataFrame, share: tuple[int, int] = (3, 5)) -> DataFrame:
    """Of ``category_terms`` those in at least a share of the category's documents, as numerator and denominator."""
    return counted.where(F.col("docs") * share[1] >= F.col("of") * share[0])


def terms_of_one(counted: DataFrame, least: int = 3) -> DataFrame:
    """Of ``category_terms`` those that only one category has, in ``least`` of its documents at least."""
    alone = counted.groupBy("term").agg(F.count("*").alias("categories"), F.first("category").alias("category"), F.sum("docs").alias("docs"))
    return alone.where((F.col("categories") == 1) & (F.col("docs") >= least)).select("category", "term", "docs")


def rounded(value: Column, places: int) -> Column:
    """A ratio to some places, half up, without trailing zeros: ``0.5``, ``1.0``, ``0.333``."""
    unit = 10**places

    def text(n: Column) -> Column:
        tail = F.regexp_replace(F.lpad((n % unit).cast("string"), places, "0"), "(?<=[0-9])0+$", "")
        return F.concat(F.floor(n / unit).cast("string"), F.lit("."), tail)

    return X.bind(F.floor(value * unit + 0.5).cast("long"), text)


def rules_block(words: dict[str, str], lists: dict[str, list[str]]) -> str:
    """The rules of a context, with the banned patterns and templates."""
    return words["rules"].format(patterns=", ".join(lists["patterns_context"]), templates=", ".join(lists["templates_context"]))


def context(prints: DataFrame, words: dict[str, str], lists: dict[str, list[str]] | None = None, name_col: str = "name", order_col: str = "doc_id", most: int = 1000) -> DataFrame:
    """One row: an opening, a block for each source in order with five terms each, the table of dimensions, the constraints, the rules if there are ``lists``, and the output line.

    ``words`` are the profile's texts. All sources stand in one text, so more than ``most`` are an error.
    """
    if prints.limit(most + 1).count() > most:
        raise ValueError(f"a context takes at most {most} sources")
    line = lambda key, /, **cols: F.concat(*[x for i, piece in enumerate(re.split(r"\{(\w+)\}", words[key])) for x in ([F.lit(piece)] if i % 2 == 0 else [cols[piece]])])
    sources = prints.select(F.struct(F.col(order_col).alias("o"), F.col(name_col).cast("string").alias("name"), "chars", "sentences", "excl_per_sent", "comma_per_sent", "top_terms", "opening_30_lines").alias("x"))
    all_of = sources.agg(F.sort_array(F.collect_list("x")).alias("x"))

    def block(x: Column, i: Column) -> Column:
        s = lambda c: x[c].cast("string")
        return F.concat_ws(
            "\n", line("source", i=(i + 1).cast("string"), name=s("name")), line("counts", chars=s("chars"), sentences=s("sentences")), line("ratios", exclamations=rounded(x["excl_per_sent"], 3), commas=rounded(x["comma_per_sent"], 2)),
            line("terms", terms=F.array_join(F.slice(x["top_terms"], 1, 5), ", ")), line("lines", opening=s("opening_30_lines")), F.lit(""),
        )

    parts = [F.lit(words["opening"]), F.lit(words["sources"]), F.when(F.size("x") > 0, F.array_join(F.transform("x", block), "\n")), F.lit(words["dimensions"]), F.lit(words["constraints"])]
    if lists is not None:
        parts.append(F.lit(rules_block(words, lists)))
    return all_of.select(F.concat_ws("\n", *parts, F.lit(words["output"])).alias("context"))
