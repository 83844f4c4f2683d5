"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Cutoffs are not set by hand. Labelled good documents of each stratum (a language) are the holdout; for each rule and
each cutoff of a fixed grid, the number of good documents that it would reject gives an exact binomial tail. A cutoff
is certified if the tail at the permitted risk is at most ``delta`` divided by the number of all tests (Bonferroni:
strata times rules times grid); the strictest certified cutoff is used, and a rule without one is off in its stratum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, free_name, let, written

#: The statistics that the rules use, each "rejected if above", with the grid of cutoffs, strictest first.
RULES = {
    "symbols_per_100_words": [2.0, 3.0, 5.0, 8.0, 12.0, 20.0, 35.0, 60.0],
    "dup_lines_per_100_lines": [5.0, 10.0, 15.0, 20.0, 30.0, 40.0, 55.0, 75.0],
    "repeat_words_per_100_words": [2.0, 4.0, 6.0, 9.0, 12.0, 16.0, 20.0, 25.0],
    "chars_per_word": [7.0, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0],
}
RISK, DELTA = 0.02, 0.1


def _repeated(w: Column, n: int) -> Column:
    """Words of the array ``w`` that lie in ``n``-word windows found twice or more; by hash, sorting and a merge of the windows' places."""

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def places(s: Column) -> Column:
            last = F.size(s) - 1
            near = lambda k, d: F.get(s, k + d)["h"]  # noqa: E731  null outside
            twin = lambda e, k: F.when(F.coalesce(near(k, -1) == e["h"], F.lit(False)) | ((k < last) & F.coalesce(near(k, 1) == e["h"], F.lit(False))), e["i"])
            return F.sort_array(F.filter(F.transform(s, twin), lambda x: x.isNotNull()))

        add = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(n), F.coalesce(F.get(p, k + 1) - x, F.lit(n)))), F.lit(0).cast("long"), lambda a, x: a + x)
        return let(let(pairs, places), add)

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.xxhash64(F.slice(w, i, n)))
    return F.when(F.size(w) <= n, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))


def statistics(text: Column, window: int = 8) -> Column:
    """A struct of the text's counts: ``n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words``; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE, -1))
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeated(w, window).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    word_chars = F.length(F.translate(t, SPACE, "")).cast("long")
    symbols = (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long")
    return let(
        F.struct(of_words.alias("w"), of_lines.alias("l"), word_chars.alias("c"), symbols.alias("s")),
        lambda x: F.struct(x["w"]["n"].alias("n_words"), x["c"].alias("word_chars"), x["s"].alias("n_symbols"), x["l"]["n"].alias("n_lines"), x["l"]["d"].alias("n_dup_lines"), x["w"]["r"].alias("n_repeat_words")),
    )


def _value(rule: str) -> Column:
    per = lambda a, b: F.when(F.col(b) > 0, F.lit(100.0) * F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "symbols_per_100_words": per("n_symbols", "n_words"),
        "dup_lines_per_100_lines": per("n_dup_lines", "n_lines"),
        "repeat_words_per_100_words": per("n_repeat_words", "n_words"),
        "chars_per_word": per("word_chars", "n_words") / 100,
    }[rule]


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial(n, p), exactly summed; 1 where k is at the mean or beyond, which no test can certify."""
    step = lambda a, i: let(a["t"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p))), lambda t: F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s")))
    first = n * F.log(F.lit(1 - p))
    total = F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>")), F.struct(first.alias("t"), F.exp(first).alias("s")), step)["s"]
    return F.when(k >= n * p, F.lit(1.0)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """``stratum, rule, cutoff, good, rejected``: the certified cutoffs from measured rows and labels ``doc_id, quality, toxic``.

    A document is good if all its labels say so; contradictory or null labels make it not good. ``risk`` is shared by
    the rules, so that all together reject at most that part of a stratum's good documents.
    """
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q"), F.max(F.coalesce(F.col("toxic"), F.lit(1))).alias("t")).where("q = 1 and t = 0").select("doc_id")
    held = measured.where("not base_failed").join(good, "doc_id", "left_semi")
    tests = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), (_value(r) > c).alias("hit")) for r, grid in RULES.items() for c in grid])
    counted = held.select("stratum", F.explode(tests).alias("x")).groupBy("stratum", "x.rule", "x.cutoff").agg(F.count("*").alias("good"), F.count_if("x.hit").alias("rejected"))
    counted = written(counted, "quality-tests", 1)
    family = max(1, counted.count())
    passed = counted.where(binomial_tail(F.col("rejected"), F.col("good"), risk / len(RULES)) <= delta / family)
    return passed.groupBy("stratum", "rule").agg(F.min(F.struct("cutoff", "good", "rejected")).alias("x")).select("stratum", "rule", "x.*")


def rate(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """Counts, base rules and verdict of each row of ``docs``.

    Gives ``doc_id``, the counts of ``statistics``, ``base_failed`` (under 20 words, or over 30 % of the words repeat),
    ``rejected_by`` (the rules beyond their certified cutoff) and ``kept``. Null texts are empty and fail; a null
    stratum is one of its own; rows with equal or null ids are rated each; empty labels certify nothing, so that only
    the base rules reject. Other columns are not looked at.
    """
    measured = docs.select(F.col(id_col).alias("doc_id"), F.col(stratum_col).alias("stratum"), statistics(F.col(text_col)).alias("x")).select("doc_id", "stratum", "x.*")
    measured = written(measured.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))), "quality-counts")
    found = cutoffs(measured, labels, risk, delta).groupBy(F.col("stratum").alias("s")).pivot("rule", list(RULES)).agg(F.first("cutoff"))
    judged = measured.join(written(found, "quality-cutoffs", 1), F.col("stratum").eqNullSafe(F.col("s")), "left")
    hits = F.filter(F.array(*[F.when(_value(r) > F.col(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    return judged.withColumn("rejected_by", hits).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0)).drop("s", *RULES)
