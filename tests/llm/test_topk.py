import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlens.llm import queries, topk


def plain(rows, k=20, every=20):
    """``rows``: (id, vector); exact integers."""
    ok = [(i, [math.floor(64 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, (i, q) in enumerate(ok):
        if i is not None and i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0) for m, (j, v) in enumerate(ok) if m != n and len(v) == len(q))
            out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(scored[:k])]
    return sorted(out, key=str)


def ranked(df):
    """Rows as above; a score that is no long is spelt."""
    rows = [(r.query_id, r.rank, r.vec_id, r.score if r.exact is None else int(r.exact)) for r in df.collect()]
    assert all(r.score is None or r.exact is None for r in df.collect())
    return sorted(rows, key=str)


def test_all_embeddings(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op9_top_k(spark, sf).collect()), key=str) == plain(rows)


@pytest.mark.parametrize("size,k", [(7, 3), (4096, 20)])
def test_ties_repeats_and_bad_vectors(spark, monkeypatch, size, k):
    for name in ("COLUMNS", "ROWS"):
        monkeypatch.setattr(topk, name, size)
    for name in ("FILE", "TURN", "GROUP"):
        monkeypatch.setattr(topk, name, size * 100)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(np.float32(x)) for x in rng.integers(-3, 4, 5) / 64]) for i in range(-40, 120)]
    rows += [(20, rows[60][1]), (20, rows[60][1]), (7, rows[60][1]), (None, [1.0] * 5), (140, None), (160, [float("nan")] * 5), (180, [float("inf")] + [0.0] * 4), (200, [None, 1.0, 1.0, 1.0, 1.0]), (220, []), (240, []), (260, [1.0, 2.0]), (261, [3.0, -0.01])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3).withColumn("rank", F.lit("clash"))
    assert ranked(topk.top_k(df, k=k)) == plain(rows, k)
    assert topk.top_k(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_of_any_size_are_exact(spark, seed):
    """Whole numbers beyond 32 bits, 53 bits, a long and the doubles, mixed with small ones, cancelling and tied."""
    rng = np.random.default_rng(seed)
    sizes = [1.0, 2.0**20, 2.0**26, 1e9, 2.0**40, 1e17, 1e150, 1e300, 1.7e308]
    rows = [(i, [float(rng.choice(sizes)) * float(rng.choice([-1, -0.5, 0, 0.3, 1])) for _ in range(4)]) for i in range(120)]
    rows += [(i, [1e308, 1.0, -1e308, 2.0**30 + i % 3]) for i in range(200, 230)] + [(400, [1e9, 1.0, 0.0, 0.0]), (401, [1e9, 1.0, 0.0, 0.0]), (None, [2.0**60, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert ranked(topk.top_k(df, k=5)) == plain(rows, 5)


def test_scores_beyond_a_long_are_spelt(spark):
    df = spark.createDataFrame([(20, [2.0**60]), (1, [2.0**60]), (2, [-(2.0**70)]), (3, [-(2.0**60)]), (4, [1 / 64])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_k(df).orderBy("rank").collect()]
    assert got == [(20, 1, 1, None, str(2**132)), (20, 2, 4, None, str(2**66)), (20, 3, 3, None, str(-(2**132))), (20, 4, 2, None, str(-(2**142)))]


def vectors(v):
    n = len(v)
    return topk.Vectors(v.astype(float), np.zeros(n, dtype=np.int32), np.arange(n), np.ones(n, dtype=bool), np.arange(n))


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(2)
    centres = rng.integers(-40, 41, (30, 16)).repeat(4, axis=1)
    v = (centres[rng.integers(0, 30, 3000)] + rng.integers(-2, 3, (3000, 64))).astype(float)
    exact = v[:50] @ v.T
    last = np.full(exact.shape, np.inf)
    for s in (1, 4, 16, 32):
        bound = topk.segments(v[:50], s) @ topk.segments(v, s).T
        assert (bound >= exact - 1e-6).all() and (bound <= last + 1e-6).all()
        last = bound


def own_path(spark, table, folder):
    """Pairs and multiplied pairs of the search over the files that the operator writes for a table."""
    files = topk._packed(table, f"file://{folder}", "vec_id", "embedding", 64.0, 20).collect()
    found = topk.search(*[[f.path for f in files if f.kind == kind] for kind in (0, 1)], files[0].dim, 20)
    return sum(b.pairs for b in found), sum(b.multiplied for b in found)


def test_multiplied_pairs_of_a_structured_table(spark, tmp_path):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 16)).repeat(4, axis=1) / 8
    v = centres[rng.integers(0, 60, 20000)] + rng.normal(size=(20000, 64)) / 200
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(2)
    pairs, multiplied = own_path(spark, table, tmp_path)
    assert pairs == 1000 * 20000 and multiplied < 0.35 * pairs


def test_multiplied_pairs_of_the_supplied_table(spark, tmp_path):
    """Unit vectors of equal variance in every direction: no coarse bound leaves out what it costs, so nearly all is multiplied, as README says."""
    pairs, multiplied = own_path(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), tmp_path)
    assert pairs == 100 * 2000 and multiplied <= pairs
    print(f"multiplied: {multiplied / pairs:.4f}")
