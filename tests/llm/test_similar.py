from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textlens.llm import similar, simhash
from textlens.llm.common import shared_dir, written


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """The smallest id of each component of texts with a similarity of 0.8, by all pairs that share a shingle."""
    sets = {d: plain_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    at = defaultdict(list)
    for d, s in sets.items():
        for x in s or {b""}:
            at[x].append(d)
    shared = Counter(p for ds in at.values() for p in combinations(sorted(ds), 2))
    near = 0
    for (a, b), k in shared.items():
        if not sets[a] or 5 * k >= 4 * (len(sets[a]) + len(sets[b]) - k):
            near += sets[a] != sets[b]
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    return {d for d in parent if root(d) == d}, near


def test_stage_drops_all_copies_of_similarity_08(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, near = plain_kept([(r.doc_id, r.text) for r in docs.collect()])
    assert near >= 9
    assert {r.doc_id for r in corpus_pipeline.deduplicate(spark, docs, sf).collect()} == want


def test_edges_and_thresholds(spark):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    fresh = lambda k: " ".join(words[:-k] + [f"x{i}" for i in range(k)])  # noqa: E731  100 - k of them
    rows = [(1, " ".join(words)), (2, fresh(11)), (3, fresh(12)), (4, None), (5, " \n"), (6, "One  two"), (7, "one TWO"), (7, "one two"), (None, "one two"), (None, "alone")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("loc", F.lit("clash")).withColumn("similar_row", F.lit(0))
    kept = similar.drop_similar(docs)
    assert kept.columns == docs.columns
    # 89 shared of 111 are 0.802, 88 of 112 are 0.786; the third comes in by the second
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "4", "6", "None"]
    assert similar.drop_similar(docs.where("doc_id in (1, 3)")).count() == 2
    assert similar.drop_similar(docs.limit(0)).count() == 0


@pytest.mark.parametrize("listed", [2, 32, 1000])
def test_links_connect_as_all_pairs_do(listed):
    """Groups listed as pairs or searched member by member give the components of all pairs."""
    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 40, 60, dtype=np.uint64)) for _ in range(4)]
    sets = {i: np.unique(np.r_[rng.choice(base[i % 4], int(rng.integers(44, 60)), replace=False), rng.integers(0, 1 << 40, int(rng.integers(0, 6)), dtype=np.uint64)]) for i in range(160)}
    x = np.concatenate([*sets.values()])
    loc, n = np.repeat([*sets], [*map(len, sets.values())]), np.repeat([*map(len, sets.values())], [*map(len, sets.values())])
    found = similar.linked_pairs(x, loc, n, lambda p, _: sets[p], listed)

    def classes(edges):
        name = dict(zip(sets, sets, strict=True))
        for a, b in edges:
            old, new = name[max(a, b, key=name.get)], min(name[a], name[b])
            name = {k: new if v == old else v for k, v in name.items()}
        return name

    share = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    near = [(a, b) for a, b in combinations(sets, 2) if 9 * share(a, b) >= 4 * (len(sets[a]) + len(sets[b]))]
    assert 4 < len(set(classes(near).values())) < 160
    assert classes(found) == classes(near) and len(found) < 160


def test_simhash_links_come_first(spark, monkeypatch):
    """What SimHash brings together within four bits, and whole sets confirm, is linked, and the stage takes it from there."""
    rng = np.random.default_rng(4)
    base = [[f"w{k}" for k in rng.integers(0, 5000, 400)] for _ in range(12)]
    texts = {}
    for i, words in enumerate(base):
        for j in range(4):
            texts[i * 10 + j] = " ".join([f"x{i}{j}" if k and k % 97 == 0 and k // 97 <= j else w for k, w in enumerate(words)])
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(3)
    folder = shared_dir(spark, "test-sets")
    sets = written(similar.with_sets(docs, folder, "text", 5), "test")
    at = {r.loc: r for r in sets.collect()}
    assert {r.doc_id: r.fp & (1 << 64) - 1 for r in at.values()} == {d: simhash.fingerprint(t, 5) for d, t in texts.items()}
    found = {(at[r.a].doc_id, at[r.b].doc_id) for r in similar.simhash_links(sets, folder).collect()}
    share = lambda a, b: len(plain_set(texts[a]) & plain_set(texts[b])) / len(plain_set(texts[a]) | plain_set(texts[b]))
    assert len(found) >= 12 and all(share(a, b) >= 0.8 for a, b in found)

    calls, plain = [], similar.simhash_links
    monkeypatch.setattr(similar, "simhash_links", lambda *a: calls.append(1) or plain(*a))
    assert {r.doc_id for r in similar.drop_similar(docs).collect()} == plain_kept([*texts.items()])[0] and calls


def test_what_is_connected_is_not_compared_again():
    x, loc, n = np.repeat(np.arange(9, dtype=np.uint64), 4), np.tile(np.arange(4), 9), np.full(36, 9)
    read = []
    sets = lambda p, _: read.append(p) or np.arange(9, dtype=np.uint64)
    assert similar.linked_pairs(x, loc, n, sets, known=np.full(36, 2)) == [] and not read
    assert similar.linked_pairs(x, loc, n, sets, 2, known=np.tile([0, 0, 2, 2], 9)) in ([(0, 2)], [(1, 2)], [(0, 3)], [(1, 3)])
    assert len(read) == 2 and len(similar.linked_pairs(x, loc, n, sets)) == 3
