import random

import numpy as np
import pytest
from textlens.functions import trie


def plain(text, w, unknown, letters):
    """The path of greatest weight of each run of letters, place by place."""
    out, i = [], 0
    while i < len(text):
        j = i
        while j < len(text) and text[j] in letters:
            j += 1
        run = text[i:j]
        best = [(0, 0)] * (len(run) + 1)
        for k in range(len(run) - 1, -1, -1):
            best[k] = max((w.get(run[k:e], unknown) + best[e][0], e) for e in range(k + 1, len(run) + 1) if e == k + 1 or run[k:e] in w)
        k = 0
        while k < len(run):
            out.append(run[k : best[k][1]])
            k = best[k][1]
        i = j + 1
    return out


@pytest.mark.parametrize("seed", range(4))
def test_paths(seed):
    r = random.Random(seed)
    letters = "abcdé中x"
    table = np.zeros(0x110000, dtype=bool)
    table[[ord(c) for c in letters]] = True
    for _ in range(150):
        some = letters[: r.randint(1, 6)]
        freq = {"".join(r.choices(some, k=r.randint(1, 5))): r.choice([1, 1, 2, 5, 50]) for _ in range(r.randint(0, 40))}
        w, unknown = trie.weights(freq)
        texts = [*("".join(r.choices([*some, " ", ".", "x"], [5] * len(some) + [1, 1, 1], k=r.randint(0, 60))) for _ in range(r.randint(1, 5))), None, ""]
        got = trie.segmented(texts, table, trie.DoubleArray.of(w), unknown)
        assert got == [None if t is None else plain(t, w, unknown, letters) for t in texts]


def test_a_large_dictionary_keeps_all_its_words():
    r = random.Random(9)
    words = {"".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(2, 9))): -1 - i for i in range(20_000)}
    d = trie.DoubleArray.of(words)
    text = " ".join(words)
    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    at, length, weight = d.words(codes)
    found = {(text[p : p + n]): v for p, n, v in zip(at.tolist(), length.tolist(), weight.tolist(), strict=True)}
    assert found == words


def test_column(spark):
    """Nulls, other letters, repeated and odd terms, clashing names, a long text."""
    words = spark.createDataFrame([("ab", 3), ("ab", 4), ("abc", 2), ("c", 0), (None, 5), ("", 5), ("a b", 9), ("cd", 5)], "term string, freq long")
    long = "abcd" * 30_000
    df = spark.createDataFrame([(1, "abcd.xab", "w"), (2, None, "w"), (3, "", None), (4, long, "w"), (5, "1 2", "w")], "doc_id long, text string, words string").repartition(2)
    out = {x.doc_id: x["_words"] for x in trie.with_words(df, words, "a-z").collect()}
    assert out == {1: ["ab", "cd", "x", "ab"], 2: None, 3: [], 4: ["ab", "cd"] * 30_000, 5: []}
    with pytest.raises(ValueError, match="more than 2"):
        trie.with_words(df, words, "a-z", most=2)
    assert {x.doc_id: x["_words"] for x in trie.with_words(df.where("doc_id = 1"), words.limit(0), "a-z").collect()} == {1: list("abcdxab")}
