import math
from collections import Counter

import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlens.llm import lm, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)
SIZE = max(TOK.get_vocab().values()) + 2


def plain(rows, good):
    """``rows``: (doc_id, text); by direct counting, each row without its own counts."""
    ids = [TOK.encode(t or "", add_special_tokens=False).ids for _, t in rows]

    def count(x):
        return Counter(zip([SIZE - 1, *x], x)), Counter([SIZE - 1, *x][: len(x)]), Counter(x)

    models = []
    for take in (lambda d: True, lambda d: d in good):
        sums = (Counter(), Counter(), Counter())
        for (d, _), x in zip(rows, ids, strict=True):
            if take(d):
                for s, c in zip(sums, count(x), strict=True):
                    s.update(c)
        models.append((*sums, sum(sums[2].values()), take))
    out = []
    for (d, _), x in zip(rows, ids, strict=True):
        loss = []
        own_bi, own_ctx, own_uni = count(x)
        for bi, ctx, uni, n, take in models:
            k = int(take(d))
            p = lambda w: (uni[w] - k * own_uni[w] + lm.ALPHA) / (n - k * len(x) + lm.ALPHA * SIZE)  # noqa: B023, E731
            loss.append(sum(-math.log((bi[v, w] - k * own_bi[v, w] + lm.MU * p(w)) / (ctx[v] - k * own_ctx[v] + lm.MU)) for v, w in zip([SIZE - 1, *x], x)) / len(x) if x else None)
        out.append((d, len(x), *loss))
    return sorted(out, key=str)


def check(got, want):
    got = sorted(((r.doc_id, r.n_tokens, r.background_loss, r.target_loss, r.score) for r in got), key=str)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, (_, n, b, t) in zip(got, want, strict=True):
        if n:
            assert g[2:] == (pytest.approx(b, rel=1e-10), pytest.approx(t, rel=1e-10), pytest.approx(b - t, abs=1e-10))
        else:
            assert g[2:] == (None, None, None)


def test_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = {r.doc_id for r in labels if r.quality == 1 and r.toxic == 0}
    got = queries.op7_cross_entropy(spark, sf).collect()
    check(got, plain(rows, good))
    known = {r.doc_id: r.quality == 1 for r in labels}
    mean = lambda x: sum(x) / len(x)
    assert mean([r.score for r in got if known.get(r.doc_id) is True]) > mean([r.score for r in got if known.get(r.doc_id) is False])


@pytest.mark.parametrize("unit", [lm.UNIT, 5])
def test_edge_cases(spark, monkeypatch, unit):
    monkeypatch.setattr(lm, "UNIT", unit)
    rows = [(1, "good old words are good"), (1, "good old words are good"), (2, None), (3, ""), (None, "bad words"), (4, "spam spam"), (5, "word " * 30000), (6, "good"), (7, "word")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).withColumn("ids", F.lit("clash")).withColumn("unit", F.lit(0)).withColumn("GOOD_ID", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (6, None, 0), (4, 0, 0), (5, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    check(lm.cross_entropy_difference(docs, labels, PATH).collect(), plain(rows, {1}))
    check(lm.cross_entropy_difference(docs, labels.limit(0), PATH).collect(), plain(rows, set()))
    check(lm.cross_entropy_difference(docs.where("doc_id in (2, 3)"), labels, PATH).collect(), [(2, 0, None, None), (3, 0, None, None)])
    assert lm.cross_entropy_difference(docs.limit(0), labels, PATH).count() == 0


def test_counts_beyond_the_whole_numbers_of_floats(spark):
    """One word 18 million times in 18 rows, twice in one: every count is exact."""
    docs = spark.range(18).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a "), 1_000_000).alias("text")).unionByName(spark.createDataFrame([(99, "a a")], "doc_id long, text string"))
    [a] = TOK.encode("a", add_special_tokens=False).ids
    labels = spark.createDataFrame([(i, 1, 0) for i in range(17)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm.cross_entropy_difference(docs, labels, PATH).collect()}
    for d, n, starts in ((99, 18_000_000, 18), (0, 17_000_002, 18), (17, 17_000_002, 18)):
        own = got[d].n_tokens
        p = (n + lm.ALPHA) / (n + lm.ALPHA * SIZE)
        loss = lambda pair, context: math.log(context + lm.MU) - math.log(pair + lm.MU * p)  # noqa: B023, E731
        want = (loss(starts, starts) + (own - 1) * loss(n - starts, n - starts)) / own
        assert got[d].background_loss == pytest.approx(want, rel=1e-9)
