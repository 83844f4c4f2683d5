import hashlib
import os
import tempfile
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.llm import bwt, queries, repeats

FIXED = np.random.default_rng(3)


def plain(rows, span=50):
    """``rows``: (doc_id, text or None)."""
    ids = [np.iinfo(np.int64).max if i is None else i for i, _ in rows]
    texts = [t if isinstance(t, bytes) else (t or "").encode() for _, t in rows]
    least = {}
    for i, t in zip(ids, texts):
        for k in range(len(t) - span + 1):
            s = t[k : k + span]
            least[s] = min(i, least.get(s, i))
    out = []
    for (i, _), own, t in zip(rows, ids, texts):
        gone = np.zeros(len(t), dtype=bool)
        for k in range(len(t) - span + 1):
            if least[t[k : k + span]] < own:
                gone[k : k + span] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_all_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op2_repeats(spark, sf).collect()), key=str) == plain(rows)


def test_buckets_stay_small_at_any_size():
    for total in (0, 10**6, 10**9, 10**12, 10**14, 10**16):
        assert total / (1 << repeats.bucket_bits(total)) <= repeats.BUCKET


@pytest.mark.parametrize("unit,hot", [(1 << 20, 2000), (3000, 2000), (3000, 2), (3000, 1)])
def test_edge_cases(spark, monkeypatch, unit, hot):
    """Also with units and tasks that are few and minimizers whose strings are dealt one by one."""
    monkeypatch.setattr(repeats, "UNIT", unit)
    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "TASKS", 3 if hot < 2000 else 1 << 15)
    monkeypatch.setattr(repeats, "BUCKET", 1000 if hot == 2 else 4 << 20)
    words = ["w%d" % i for i in range(60)]
    prose = lambda n: " ".join(FIXED.choice(words, n))
    a, b, c = prose(100), prose(30), "é" * 40
    rows = [(5, a), (3, a[7:300]), (9, b + a[20:120] + b), (9, b), (None, a), (None, a), (1, None), (2, ""), (4, "x" * 49), (6, "x" * 49), (7, "x" * 50), (8, "y" + "x" * 500), (10, "ab" * 300), (11, "ab" * 26), (12, c), (13, "-" + c), (14, a[:49]), (15, a[:50]), (16, "\x00" * 60), (17, "\x00" * 55), (18, prose(3000) + a), (19, "x" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("n_bytes", F.lit("clash"))
    got = repeats.remove_repeats(docs, with_text=True).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == plain(rows)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0
    assert [tuple(r)[:4] for r in repeats.remove_repeats(docs.where("doc_id = 2")).collect()] == [(2, 0, 0, 0)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(min_size=0, max_size=30).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=20), st.integers(1, 12), st.integers(3, 50))
def test_columns_sort_all_suffixes(strings, common, chunk):
    old, bwt.CHUNK = bwt.CHUNK, chunk
    try:
        matrix = np.zeros((len(strings), 40), dtype=np.uint8)
        for i, s in enumerate(strings):
            matrix[i, : len(s)] = np.frombuffer(s, np.uint8)
        with tempfile.TemporaryDirectory() as folder:
            names, prefix = bwt.sorted_suffixes(bwt.Collection(folder, matrix, np.array([len(s) for s in strings])), common)
    finally:
        bwt.CHUNK = old
    got = [strings[n >> 8][len(strings[n >> 8]) - (n & 255) :] for n in names.tolist()]
    want = sorted(s[i:] for s in strings for i in range(len(s) - common + 1))
    assert got == want
    every = sorted([s[i:] for s in strings for i in range(len(s) + 1)])
    shared = lambda a, b: min(common, len(os.path.commonprefix([a, b])))
    full = [0] + [shared(a, b) for a, b in zip(every, every[1:], strict=False)]
    assert prefix.tolist() == [x for x, s in zip(full, every, strict=True) if len(s) >= common]


def test_parts_answer_as_the_whole_does(monkeypatch):
    """Fragments in parts by the hash of what they share give the answers of one collection."""
    rng = np.random.default_rng(6)
    core = rng.integers(97, 123, (40, 50), dtype=np.uint8)
    which, counts = rng.integers(0, 40, 400), rng.integers(1, 32, 400)
    matrix = np.zeros((400, repeats.WIDTH), dtype=np.uint8)
    for i, (w, n) in enumerate(zip(which, counts, strict=True)):
        a = rng.integers(0, n)
        matrix[i, :a] = 65 + w
        matrix[i, a : a + 50] = core[w]
        matrix[i, a + 50 : n + 49] = 97 + w % 26
    first, docs = rng.permutation(400)[:300], rng.integers(0, 1000, 300)
    whole = repeats._answers([matrix[first]], counts[first], docs)
    for strings in (8000, 100, 10):
        monkeypatch.setattr(repeats, "STRINGS", strings)
        parts = repeats._by_parts(matrix, first, counts, docs, (which * 37 % 256).astype("u1"))
        assert all((a == b).all() for a, b in zip(parts, whole, strict=True))


def test_fragments_that_share_no_50_bytes_are_not_sorted(monkeypatch):
    """Of fragments around one minimizer only those enter the transform that have a 50-byte string in common, and answers stay."""
    rng = np.random.default_rng(9)
    counts = np.full(300, 31)
    matrix = rng.integers(97, 123, (300, repeats.WIDTH), dtype=np.uint8)
    matrix[:, 30:50] = 65  # the minimizer
    matrix[7, 10:60] = matrix[3, 10:60]
    matrix[11, 30:79] = matrix[5, 30:79]  # 49 bytes
    sorted_, answers = [], repeats._answers
    monkeypatch.setattr(repeats, "_answers", lambda f, n, d: sorted_.append(len(n)) or answers(f, n, d))
    docs = np.arange(300)
    got = repeats._by_parts(matrix, docs, counts, docs, np.zeros(300, "u1"))
    assert sorted_ == [2]
    assert all((a == b).all() for a, b in zip(got, answers([matrix], counts, docs), strict=True))
    assert (got[7] == [3 if k == 10 else 7 for k in range(31)]).all()


def test_rounds_hold_no_strings():
    """What the rounds hold of a string doesn't depend on its length: the columns stay in the file."""
    rng = np.random.default_rng(8)

    def peak(n, size):
        matrix = rng.integers(97, 101, (n, size), dtype=np.uint8)
        with tempfile.TemporaryDirectory() as folder:
            strings = bwt.Collection(folder, matrix, np.full(n, size))
            del matrix
            tracemalloc.start()
            try:
                bwt.transformed(strings, size + 1)
                return tracemalloc.get_traced_memory()[1]
            finally:
                tracemalloc.stop()

    old, bwt.CHUNK = bwt.CHUNK, 1 << 12
    try:
        short, long = ((peak(6000, size) - peak(2000, size)) / 4000 for size in (40, 160))
        # held strings would add 120 bytes each or more
        assert long < 200 and long - short < 40, (short, long)
    finally:
        bwt.CHUNK = old
