import random

import pytest
from textlens.operators import lexicon


def texts(r, letters, n, size):
    return ["".join(r.choices([*letters, "x"], [6] * len(letters) + [1], k=r.randint(0, size))) for _ in range(n)]


def terms(r, letters, n):
    return sorted({"".join(r.choices(letters, k=r.randint(1, 6))) for _ in range(n)})


def counted(automaton, names, docs):
    x, y, n = automaton.counts([None if s is None else s.encode() for s in docs])
    return {(i, names[j]): c for i, j, c in zip(x.tolist(), y.tolist(), n.tolist(), strict=True)}


@pytest.mark.parametrize("seed", range(3))
def test_counts_are_those_of_replacing(seed):
    r = random.Random(seed)
    for k in range(80):
        letters = "abé方"[: r.randint(1, 4)]
        names = terms(r, letters, r.randint(0, 30))
        docs = [*texts(r, letters, r.randint(1, 5), 4000 if k % 20 == 0 else 60), None, ""]
        want = {(i, t): s.count(t) for i, s in enumerate(docs) if s for t in names if t in s}
        assert counted(lexicon.Automaton.of(names), names, docs) == want


def test_terms_longer_than_a_lane_and_at_its_borders():
    long = "ab" * 3000
    docs = [long * 3, "y" * 1023 + "needle" + "y" * 5000, "needl", "e" + "needle" * 400]
    names = [long, "needle", "e" * 2]
    want = {(i, t): s.count(t) for i, s in enumerate(docs) for t in names if t in s}
    assert counted(lexicon.Automaton.of(names), names, docs) == want


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, hit string, part string").repartition(3)


def test_parts_of_a_lexicon_give_the_same(spark):
    """Nulls, empty texts and terms, repeated rows and terms, clashing names; one automaton or many."""
    r = random.Random(7)
    names = terms(r, "abc", 60)
    docs = [*texts(r, "abc", 40, 30), None, "", "zzz", "zzz"]
    df = frame(spark, [(i, t, "h", None) for i, t in enumerate(docs)])
    words = spark.createDataFrame([(t,) for t in [*names, *names[:3], None, ""]], "term string")
    want = sorted((i, t, s.count(t)) for i, s in enumerate(docs) if s for t in names if t in s)
    some = sorted({i for i, _, _ in want})
    for cells in (1 << 24, 300):
        assert len(list(lexicon._parts(words, "term", cells))) == (1 if cells > 300 else -(-sum(map(len, names)) * 4 // 300))
        assert sorted(map(tuple, lexicon.term_counts(df, words, cells=cells).collect())) == want
        any_, none = lexicon.with_any(df, words, cells=cells), lexicon.without_any(df, words, cells=cells)
        assert any_.columns == none.columns == df.columns
        assert sorted(x.doc_id for x in any_.collect()) == some
        assert sorted(x.doc_id for x in none.collect()) == [i for i in range(len(docs)) if i not in some]
    empty = words.limit(0)
    assert lexicon.term_counts(df, empty).collect() == [] and lexicon.with_any(df, empty).count() == 0 and lexicon.without_any(df, empty).count() == len(docs)
    assert lexicon.term_counts(df.limit(0), words).collect() == []


def test_no_text_is_shuffled(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    words = spark.createDataFrame([("the",), ("la",)], "term string")
    for df in (lexicon.term_counts(docs, words), lexicon.without_any(docs, words)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_counts_of_a_list_stand_in_their_row(spark):
    df = frame(spark, [(1, "aXbXc", "", ""), (2, None, "", ""), (3, "", "", "")])
    assert {x.doc_id: x.n for x in lexicon.with_counts(df, ["X", "aX", "q"], "text", "n").collect()} == {1: [2, 1, 0], 2: None, 3: [0, 0, 0]}
