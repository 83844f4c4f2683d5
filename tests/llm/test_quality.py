import math
import re

import pytest
from pyspark.sql import functions as F

from textlens.llm import quality, queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text, window=8):
    text = text or ""
    words = WORD.findall(text)
    seen = {}
    for i in range(len(words) - window + 1):
        seen.setdefault(tuple(words[i : i + window]), []).append(i)
    hit = set()
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + window))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


TEXTS = [None, "", " \n\t ", "a", "a b c d e f g h", "a b c d e f g h " * 3, "a " * 9, "x\ny\nx\n \n \nx", "é#é $% <|>　z", ("w%d " * 50) % tuple(range(50)) + ("v%d " * 12) % tuple(range(12)) + "q " + ("v%d " * 12) % tuple(range(12)), "lo ng " * 4000]


def test_counts_of_edge_cases(spark):
    rows = [(i, t, None) for i, t in enumerate(TEXTS)] + [(3, "a", None), (None, "a", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("n_words", F.lit("clash"))
    labels = spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int")
    out = quality.rate(docs, labels).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out}
    for i, t in enumerate(TEXTS):
        n, *rest = want = counts(t)
        r = by[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, i
        assert r.base_failed == (n < 20 or 100 * rest[3] > 30 * n)
        assert r.kept == (not r.base_failed)  # nothing certified without labels


def test_counts_of_all_documents(spark, sf):
    out = {r.doc_id: r for r in queries.op8_quality_rules(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        r = out[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(d.text)
        assert not (r.base_failed and r.kept)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.rate(docs, labels).count() == 0


@pytest.mark.parametrize("k,n", [(0, 1), (0, 2000), (3, 1500), (9, 5000), (40, 5000)])
def test_binomial_tail(spark, k, n):
    p = 0.005
    want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p)) for i in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(k).cast("long"), F.lit(n).cast("long"), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def test_only_certified_cutoffs_reject(spark):
    """Of 4,000 good rows 1 has many symbols: cutoffs that spare the others are certified; a small stratum gets none."""
    text = " ".join(f"w{i}" for i in range(40))
    marks = " ".join(f"#{i}###" for i in range(20))
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit(text + " " + marks)).otherwise(F.lit(text)).alias("text"), F.when(F.col("id") < 3900, F.lit("en")).alias("lang"))
    bad = spark.createDataFrame([(9000, text + " " + marks, "en"), (9001, text + " " + marks, None)], docs.schema)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    out = {r.doc_id: r for r in quality.rate(docs.union(bad), labels).where("doc_id in (7, 8, 9000, 9001)").collect()}
    assert not out[9000].kept and out[9000].rejected_by == ["symbols_per_100_words"]
    assert out[9001].kept and out[8].kept


def test_very_long_texts(spark):
    """A text of 300,000 words: distinct, all equal, and one window twice at its ends."""
    n = 300_000
    words = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ")
    head = F.lit(" ".join(map(str, range(1, 9))))
    docs = spark.range(1).select(F.explode(F.array(F.struct(F.lit(1).alias("doc_id"), words.alias("text")), F.struct(F.lit(2).alias("doc_id"), F.repeat(F.lit("w "), n).alias("text")), F.struct(F.lit(3).alias("doc_id"), F.concat(words, F.lit(" "), head).alias("text")))).alias("d")).select("d.*")
    got = {r.doc_id: r.s for r in docs.select("doc_id", quality.statistics(F.col("text")).alias("s")).collect()}
    assert [(got[i].n_words, got[i].n_repeat_words) for i in (1, 2, 3)] == [(n, 0), (n, n), (n + 8, 16)]
