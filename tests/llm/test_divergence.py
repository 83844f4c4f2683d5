import re
from collections import Counter, defaultdict

from textlens.llm import divergence


def plain(rows, least=30, top=50):
    """The whole table by dense sums over every kept term."""
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n[lang, source].update(words)
        docs[lang].update(set(words))
    kept = {lang: sorted(t for t, k in docs[lang].items() if k >= least) for lang, _ in groups}
    share = lambda c, ts: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in ts) + 5 * len(ts)) for t in ts}
    out = []
    for lang, source in groups:
        ts = kept[lang]
        p, whole = share(n[lang, source], ts), share(sum((n[g] for g in groups if g[0] == lang), Counter()), ts)
        pairs = [(other, sum(abs(p[t] - x) for t, x in share(n[lang, other], ts).items())) for k, other in groups if k == lang and other != source]
        above = [(t, p[t] - whole[t]) for t in ts if n[lang, source][t] and p[t] > whole[t]]
        for part, items, most in (("pair", pairs, None), ("term", above, top)):
            items.sort(key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, i + 1) for i, (item, v) in enumerate(items[:most])]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x") for r in rows], "lang string, source string, text string, term string").repartition(3)
    out = divergence.audit(df, **more)
    assert out.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, out.collect()))


def test_nulls_ties_and_small_groups(spark):
    rows = [("en", "a", "One two two, THREE3four"), ("en", "b", "two é É three"), ("en", "c", None), ("en", "d", ""), ("en", None, "one_one"), (None, None, "x y"), ("", "", "x"), ("de", "a", "eins"), ("de", "b", "zwei"), ("en", "a", "One two two, THREE3four")]
    for least in (1, 2, 3, 9):
        assert got(spark, rows, least=least, top=2) == plain(rows, least, 2)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_many_sources_meet_in_cells_and_blocks(spark, monkeypatch):
    import random

    r = random.Random(5)
    for name, value in (("SOURCES", 3), ("BLOCK", 4), ("PART", 40), ("HELD", 7), ("PIECE", 5)):
        monkeypatch.setattr(divergence, name, value)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(r.choice(["en", "fr"]), f"s{r.choice([0, 0, 0, *range(11)]):02d}", " ".join(r.choices(words, [2**-i for i in range(20)], k=r.randint(0, 30)))) for _ in range(150)]
    assert got(spark, rows, least=2, top=3) == plain(rows, 2, 3)


def test_large_counts_stay_exact(spark):
    df = spark.createDataFrame([(999_999_999_999, 30_000_000_000_007, 3)], "n long, t long, v long")
    assert df.select(divergence.share("n", "t", "v")).first()[0] == 1 + 10**9 * (999_999_999_999 + 5) // (30_000_000_000_007 + 15)
