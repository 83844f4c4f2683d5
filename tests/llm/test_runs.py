import hashlib
import random
import re
import zlib

import pytest

from textlens.llm import queries, runs


def plain(w, least=6, periods=4):
    """Every run by comparing all words at every distance."""
    found = []
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            n = j - i + q
            if j > i and n >= max(least, periods * q) and all(w[i : j + q - d] != w[i + d : j + q] for d in range(1, q)):
                found.append((i, n, q))
            i = max(j, i + 1)
    return sorted(found)


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def cycled(doc_id, text):
    """The words that the query searches."""
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 or not n or doc_id is None:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def expected(doc_id, text):
    w = cycled(doc_id, text)
    found = plain(w)
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(collapsed(w, found)))


@pytest.mark.parametrize("seed", range(4))
def test_random_words(seed):
    r = random.Random(seed)
    for _ in range(150):
        docs = []
        for _ in range(r.randint(1, 6)):
            d = [r.randrange(r.choice([1, 2, 3, 5])) for _ in range(r.randint(0, 40))]
            if d and r.random() < 0.5:
                a = r.randrange(len(d))
                p = 1 + (len(d) - a) // (3 + r.randrange(8))
                d = [d[i] if i < a else d[a + (i - a) % p] for i in range(len(d))]
            docs.append(d)
        for least, periods in ((6, 4), (2, 2), (9, 3)):
            assert [[tuple(x) for x in g.tolist()] for g in runs.runs_of(docs, least, periods)] == [plain(d, least, periods) for d in docs]


def test_fibonacci_words_have_many_runs():
    a, b = [0], [0, 1]
    while len(b) < 400:
        a, b = b, b + a
    assert [tuple(x) for x in runs.runs_of([b], 2, 2)[0].tolist()] == plain(b, 2, 2)
    assert [tuple(x) for x in runs.runs_of([b, b], 6, 3)[1].tolist()] == plain(b, 6, 3)


def test_query_against_brute_force(spark, sf, tmp_path):
    """Every document is there; those of up to 700 words are searched again."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = {r[0]: r[1] for r in docs if len((r[1] or "").split()) <= 700}
    got = {r["doc_id"]: tuple(r) for r in queries.op12_periodic_runs(spark, sf).collect()}
    assert sorted(got) == sorted(r[0] for r in docs)
    assert len(short) > 700 and sum(got[i][1] > 0 for i in short) > 50
    for i, t in short.items():
        assert got[i] == expected(i, t), i


def test_edges(spark):
    """Nulls, empty and white texts, repeated rows, clashing names, long runs of one word."""
    long = "ab " * 20000 + "x y " * 9000
    rows = [(1, None, "r"), (2, "", None), (3, " \t\n ", "r"), (4, "a a a a a a b", "r"), (4, "a a a a a a b", "r"), (None, "b\va\vb\va b a b a b", "r"), (5, long, "r"), (6, "é é é é é é é", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(2)
    out = runs.periodic_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "_runs", "collapsed"]
    got = sorted(((r["doc_id"], [tuple(x) for x in r["_runs"]], r["collapsed"]) for r in out.collect()), key=str)
    want = [(5, [(0, 20000, 1), (20000, 18000, 2)], "ab x y")]
    for i, t, _ in rows:
        if t != long:
            w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
            want.append((i, plain(w), collapsed(w, plain(w))))
    assert got == sorted(want, key=str)
    assert runs.periodic_runs(df.limit(0)).collect() == []


def test_names_in_files_give_the_same(monkeypatch):
    docs = [[i % 7 for i in range(100)], [1, 2] * 50, list(range(30))]
    want = [g.tolist() for g in runs.runs_of(docs)]
    monkeypatch.setattr(runs, "LARGE", 10)
    monkeypatch.setattr(runs, "TOGETHER", 20)
    assert [g.tolist() for g in runs.runs_of(docs)] == want
