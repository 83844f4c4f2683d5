import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textlens.llm import queries, simhash


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, radius=4):
    """``rows``: (doc_id, fingerprint); union over all pairs of distinct fingerprints."""
    fps = np.array(sorted({f for _, f in rows}), dtype=np.uint64)
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= radius) + i + 1:
            parent[root(int(j))] = root(i)
    at = {int(f): i for i, f in enumerate(fps)}
    least = {}
    for d, f in rows:
        r = root(at[f])
        least[r] = min(d, least.get(r, d))
    return {(d, f): least[root(at[f])] for d, f in rows}


def test_all_documents(spark, sf):
    docs = [(r.doc_id, plain_fingerprint(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_components(docs)
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in queries.op6_simhash(spark, sf).collect()}
    assert got == want


@pytest.mark.parametrize("radius", [1, 3, 4, 6])
def test_some_key_holds_all_words_within_the_radius(radius):
    rng = np.random.default_rng(radius)
    for n in (1, 10**6, 10**9, 10**11):
        masks = np.array(simhash.keys(n, radius), dtype=np.uint64)
        flips = np.zeros(3000, dtype=np.uint64)
        for i in range(3000):
            for bit in rng.choice(64, radius, replace=False):
                flips[i] |= np.uint64(1) << np.uint64(bit)
        assert ((flips[:, None] & masks) == 0).any(1).all()
    sizes = [n / 2 ** int(np.bitwise_count(np.array(simhash.keys(n, radius), dtype=np.uint64)).min()) for n in (10**6, 10**9, 10**11)]
    assert max(sizes) < 10**6  # groups don't grow with the square of the corpus


@pytest.mark.parametrize("group,rows", [(100_000, None), (40, None), (100_000, 10**9), (100_000, 10**11)])
def test_random_fingerprints_and_large_groups(spark, group, rows):
    """Chains and clouds of near fingerprints; with small parts, groups are cut and each pair of parts is searched."""
    rng = np.random.default_rng(5)
    fps = set(rng.integers(0, 1 << 64, 300, dtype=np.uint64).tolist()) | {0, 1, 3, 1 << 63}
    centre = int(rng.integers(0, 1 << 63))
    fps |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))}
    chain = int(rng.integers(0, 1 << 63))
    for b in range(0, 60, 3):
        chain ^= 0b111 << b
        fps.add(chain)
    expected, rows = rows, [(i, f) for i, f in enumerate(sorted(fps, key=lambda x: x * 7919 % 10007))]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(d, signed(f)) for d, f in rows] + [(5, signed(rows[5][1]))], "doc_id long, fp long")
    classes = df.groupBy("fp").agg(F.min("doc_id").alias("least")).select(F.col("fp").alias("rep"), "fp", "least")
    trees = {r.node: r.component for r in simhash.components(simhash.links(classes, group=group, rows=expected)).collect()}
    least = {}
    for d, f in rows:
        c = trees.get(signed(f), signed(f))
        least[c] = min(d, least.get(c, d))
    assert {(d, f): least[trees.get(signed(f), signed(f))] for d, f in rows} == plain_components(rows)


def test_edge_cases(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(7, None), (3, ""), (9, " \n\t"), (5, "One Two"), (6, "ONE two"), (6, "ONE two"), (None, "one two"), (1, "x " * 30000), (20, text), (21, text + " end"), (None, "alone with nothing near")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    out = simhash.near_duplicates(docs).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out if r.doc_id is not None}
    assert [got[i].component_id for i in (7, 3, 9)] == [3, 3, 3] and got[3].fp == 0
    assert [got[i].component_id for i in (5, 6)] == [5, 5]
    assert got[21].component_id == 20 and got[1].component_id == 1
    assert sorted(str(r.component_id) for r in out if r.doc_id is None) == ["5", "None"]
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "20", "3", "5", "None"]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
