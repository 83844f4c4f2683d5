import random
import re
import time

import pytest
from pyspark.sql import functions as F

from textlens import lexicons as L
from textlens.operators import corpus, names, rules, templates
from textlens.profiles import LATIN


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_samples_draw_ids_without_moving_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = corpus.sample(docs, 5, 42, "lang")
    assert out.columns == docs.columns
    got = sorted((x.lang, x.doc_id) for x in out.collect())
    want = []
    rows = docs.select("lang", "doc_id", corpus.draw_key(42, "doc_id").alias("k")).collect()
    for lang in {x.lang for x in rows}:
        want += [(lang, x.doc_id) for x in sorted((x for x in rows if x.lang == lang), key=lambda x: x.k)[:5]]
    assert got == sorted(want)
    text = plan(out)
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text and "Sort " not in text
    # beyond the bound the drawn ids are joined, with the same rows
    assert sorted((x.lang, x.doc_id) for x in corpus.sample(docs, 5, 42, "lang", most=3).collect()) == got


def test_samples_of_repeated_and_null_ids(spark):
    rows = [(i % 4, f"t{i}", "c", "x") for i in range(12)] + [(None, "n", None, "x"), (None, "m", "c", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, category string, drawn_key string")
    out = corpus.sample(df, 2, 1)
    assert out.columns == df.columns
    got = [(x.doc_id, x.text, x.category) for x in out.collect()]
    assert (None, "n", None) in got and len({i for i, _, c in got if c == "c"}) == 2
    assert all(sum(1 for i, _, c in got if i == k and c == "c") == 3 for k in {i for i, _, c in got if c == "c" and i is not None})
    assert corpus.sample(df.limit(0), 2).count() == 0


def test_guard_and_counts_come_from_one_pass(spark):
    rows = [(i, "abc" * (i % 3), "x" if i % 2 else None, 1) for i in range(20)] + [(99, None, "y", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, category string, letters int").repartition(3)
    good, seen = corpus.guarded(df, LATIN, ["x", "y"], least=3)
    assert good.count() == sum(i % 3 > 0 for i in range(20))
    got = corpus.enough(seen, ["x", "y"])
    want = [i for i in range(20) if i % 2]
    assert got == [("x", sum(i % 3 > 0 for i in want), sum(i % 3 == 0 for i in want)), ("y", 0, 1)]
    with pytest.raises(ValueError, match="at least 50"):
        corpus.enough(seen, ["x", "y"], least=50)


def chained(rows, roles):
    out = []
    for c, t, r, text in rows:
        found = None
        for role in roles:
            before = [(u, x) for d, u, q, x in rows if d == c and q == role and x and t is not None and u is not None and u < t]
            if before:
                found = max(before)[1]
                break
        out.append((c, t, r, text, found))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_chained_turns(spark, chunk):
    r = random.Random(chunk)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([*range(20), None]), r.choice(["a", "b", "c", None]), r.choice(["", "x", "y", "z", None])) for _ in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("previous", F.lit(1)).repartition(3)
    out = templates.chained(df, ["b", "a"], chunk=chunk)
    assert out.columns == [*df.columns, "_previous"]
    assert sorted(((x.conv_id, x.turn, x.role, x.text, x["_previous"]) for x in out.collect()), key=str) == chained(rows, ["b", "a"])
    assert templates.chained(df.limit(0), ["a"]).count() == 0


def plain_named(t):
    """Candidates by regular expressions, each counted in the whole text, with the letters before it."""
    han, every = "[一-鿿]", L.STRONG_SURNAMES + L.MEDIUM_SURNAMES + L.WEAK_SURNAMES
    sure, weak, two, then = f"[{L.STRONG_SURNAMES}{L.MEDIUM_SURNAMES}]", f"[{L.WEAK_SURNAMES}]", "(?:" + "|".join(L.COMPOUND_SURNAMES) + ")", f"(?=[{L.NAME_CONTEXT}])"
    patterns = [two + han, two + han * 2, sure + han, sure + han * 2, weak + han * 2, f"(?<!{han}){weak}{han}"]
    out = {}
    for n in {x for p in patterns for x in re.findall(f"({p}){then}", t)}:
        odd = n[1] in L.UNLIKELY_SECOND or len(n) == 3 and (n[1] in L.NUMERALS or n[0] == n[1])
        if len(n) == 4 or not odd and not (len(n) == 2 and n[1] in every):
            places = [m.start() for m in re.finditer(n, t)]
            out[n] = len(places), {t[i - 1] if i else "" for i in places}
    return out


def test_names_of_odd_texts(spark):
    r = random.Random(5)
    letters = "慕容欧阳李李周苏方方白的一说，。走雪雪山🙂a\0\n "
    texts = {i: "".join(r.choices(letters, k=r.randint(0, 120))) for i in range(300)} | {300: "李雪李雪李，李雪李，" * 50, 301: "", 302: "方雪，方雪说", 303: "李" * 999 + "，"}
    df = spark.createDataFrame([*texts.items(), (304, None)], "id int, t string").repartition(3)
    got = {i: {} for i in texts}
    for x in names.named(df, "id", "t").collect():
        got[x.doc_id][x.name] = x.times, set(x.before)
    assert got == {i: plain_named(t) for i, t in texts.items()}
    assert {(x.doc_id, x.name, x.times) for x in names.named(df, "id", "t", False).collect()} == {(i, n, k) for i, own in got.items() for n, (k, _) in own.items()}


def test_names_take_the_work_of_the_text_whatever_their_number(spark):
    """Each name used to be looked for in the whole text."""
    r = random.Random(6)
    text = "".join(r.choice("李周苏方") + chr(r.randint(0x4E00, 0x9FFF)) + chr(r.randint(0x4E00, 0x9FFF)) + "，" for _ in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    began = time.time()
    got = {x.name: x.times for x in names.named(df).collect()}
    assert time.time() - began < 30 and len(got) > 50_000
    assert all(got[n] == text.count(n) for n in r.sample(sorted(got), 200))


def test_pairs_of_names_by_a_stack(spark):
    r = random.Random(4)
    sets = [["".join(r.choices("ABé", k=r.randint(1, 4))) for _ in range(r.randint(0, 25))] for _ in range(40)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate([*sets, None])], "id int, s array<string>")
    for x in df.select("id", names.prefix_pairs(F.col("s")).alias("p")).collect():
        s = {*sets[x.id]} if x.id < len(sets) else set()
        assert sorted(map(tuple, x.p or [])) == sorted((a, b) for a in s for b in s if a != b and b.startswith(a))


def test_a_set_of_rules_measures_what_it_reads(spark):
    df = spark.createDataFrame([(1, "One; two! Three, four.")], "doc_id long, text string")
    for kind in (rules.check_rules, rules.audit_rules):
        m = rules.measured(df, LATIN, only=kind.reads)
        assert m.select("m.*").columns == list(kind.reads)
        assert rules.findings(df, LATIN, rules=kind).collect() == rules.measured(df, LATIN).select("doc_id", F.inline(rules._present(kind(LATIN)))).collect()
    assert "Chapter" not in plan(rules.findings(df, LATIN, rules=rules.audit_rules))


def test_names_that_are_taken_are_errors(spark):
    df = spark.createDataFrame([("the", 1)], "term string, freq long")
    with pytest.raises(ValueError, match="freq"):
        corpus.frequencies(df, df)
    with pytest.raises(ValueError, match="previous"):
        templates.previous_turn(spark.createDataFrame([(1, 1, "t", "p")], "conv_id int, turn int, text string, previous string"))
