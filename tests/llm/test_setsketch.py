import random
import re

import numpy as np
import pytest

from textlens.llm import setsketch


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def plain(rows):
    """All pairs of whole sets, and a walk over their links."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(spark, rows, parts=4):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, digest string, n int").repartition(parts)
    return sorted(map(tuple, setsketch.near_copies(df).collect()), key=str)


def changed(r, words, k):
    out = list(words)
    for _ in range(k):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return " ".join(out)


def families(r, sizes, words=120):
    rows = []
    for size in sizes:
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(20, words))]
        rows += [changed(r, base, r.choice([0, 1, 1, 2, 3, 4, 6])) for _ in range(size)]
    r.shuffle(rows)
    return list(enumerate(rows, 10))


def test_families_of_copies(spark):
    rows = families(random.Random(1), [1] * 150 + [2] * 60 + [5] * 20 + [40])
    assert got(spark, rows) == plain(rows)


def test_large_groups_are_searched_by_blocks(spark, monkeypatch):
    """A chain of changes links a group whose first set reaches few of the others."""
    monkeypatch.setattr(setsketch, "FEW", 3)
    monkeypatch.setattr(setsketch, "MANY", 7)
    r = random.Random(2)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        base[r.randrange(150)] = f"y{i}"
        rows.append((i, " ".join(base)))
        rows.append((1000 + i, changed(r, base, 9)))
    assert got(spark, rows) == plain(rows)


def test_edges(spark):
    """Nulls, empty, short and equal texts, repeated and null ids, long texts."""
    long = " ".join(f"w{i % 9000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A B c"), (6, "a b"), (7, "b a"), (7, "b a"), (7, "z"), (None, "q r s t u v w"), (9, "Q r s t u v w"), (None, "only here but nobody else does"), (11, long), (12, long + " end"), (13, "é É"), (14, "é é")]
    assert got(spark, rows) == plain(rows)
    assert got(spark, []) == []


def test_registers_merge_and_estimate():
    r = np.random.default_rng(3)
    for n, m, both in ((500, 500, 440), (40, 45, 40), (2000, 2300, 1900), (300, 300, 0)):
        sums = []
        for _ in range(40):
            x = r.integers(0, 2**63, n + m - both, dtype=np.uint64)
            a, b = x[:n], x[n - both :]
            ka, kb, ku = setsketch.sketches([a, b, x])
            assert (np.maximum(ka, kb) == ku).all()
            sums.append(setsketch.estimates(*(np.array([v]) for v in ((ka > kb).sum(), (ka < kb).sum(), n, m)))[0])
        assert abs(np.mean(sums) - both / (n + m - both)) < 0.02
        assert np.std(sums) < 0.05


def test_sets_sketched_together_or_alone_agree():
    r = np.random.default_rng(4)
    sets = [r.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 7, 300, 5000)]
    together = setsketch.sketches(sets)
    assert all((setsketch.sketches([s])[0] == t).all() for s, t in zip(sets, together, strict=True))


@pytest.mark.parametrize("n", [3, 10, 400])
def test_similar_sets_share_a_band(n):
    r = np.random.default_rng(n)
    missed = 0
    for _ in range(150):
        both = -(-8 * n // 9)  # similarity of about 0.8
        x = r.integers(0, 2**63, 2 * n - both, dtype=np.uint64)
        keys = setsketch.band_keys(setsketch.sketches([x[:n], x[n - both :]]))
        missed += both / (2 * n - both) >= 0.8 and not (keys[0] == keys[1]).any()
    assert missed == 0
