import math
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from textlens.llm import langid, queries


def best_score(emit, doc, switch, labels):
    total = 0.0
    for i, x in enumerate(labels):
        total += emit[i, x] - (switch if i and doc[i] == doc[i - 1] and labels[i - 1] != x else 0)
    return total


def viterbi(emit, doc, switch):
    total, n = 0.0, len(emit)
    i = 0
    while i < n:
        v = emit[i].copy()
        i += 1
        while i < n and doc[i] == doc[i - 1]:
            v = np.maximum(v, v.max() - switch) + emit[i]
            i += 1
        total += v.max()
    return total


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=6), st.integers(1, 4), st.integers(1, 7), st.integers(0, 1000))
def test_blocks_give_the_best_labelling(sizes, k, block, seed):
    rng = np.random.default_rng(seed)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    emit = rng.integers(-6, 1, (len(doc), k)).astype(float)
    labels = langid.label_words(emit, doc, 3.0, block)
    assert best_score(emit, doc, 3.0, labels) == pytest.approx(viterbi(emit, doc, 3.0))


def test_held_out_accuracy_on_all_documents(spark, sf):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op5_language_id(spark, sf).collect()
    assert sorted(r.doc_id for r in out) == sorted(docs)
    right = held = 0
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        if not any(c.isalpha() for c in docs[r.doc_id].text):
            assert r.lang_pred == "und"
        elif r.held_out:
            held += 1
            right += r.lang_pred == docs[r.doc_id].lang
    assert right >= 0.97 * held


def plain(rows):
    """``rows``: (id, text, lang) -> (prediction, score), by dictionaries of trigrams and a walk over the words."""
    mask = (1 << 64) - 1

    def bucket(a, b, c):
        h = (a * 0x9E3779B97F4A7C15 + b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & mask
        h ^= h >> 29
        return ((h * 0xBF58476D1CE4E5B9) & mask) >> 48

    def words(text):
        for m in regex.finditer(r"[\p{L}\p{M}]+", (text or "").lower()):
            if regex.search(r"\p{L}", m[0]):
                w = [32, *map(ord, m[0]), 32]
                script = next(s for c, s in sorted(langid.SCRIPTS.items(), reverse=True) if c <= w[1])
                yield len(m[0]), script, [bucket(*w[i : i + 3]) for i in range(len(m[0]))]

    grams, scripts = {}, {}
    for i, text, lang in rows:
        if text is not None and lang is not None and zlib.crc32(str(i).encode()) % 4 != 2:
            for _, script, found in words(text):
                grams.setdefault(lang, Counter()).update(found)
                scripts.setdefault(lang, Counter())[script] += 1
    langs = sorted(grams)
    total = {x: sum(grams[x].values()) for x in langs}
    uses = {x: {s for s, n in scripts[x].items() if n >= 0.01 * sum(scripts[x].values())} for x in langs}
    loss = {x: lambda g, x=x: math.log((grams[x][g] + langid.SMOOTH) / (total[x] + langid.SMOOTH * langid.BUCKETS)) for x in langs}
    out = {}
    for i, text, _ in rows:
        best, back, sizes = None, [], []
        for size, script, found in words(text):
            may = [x for x in langs if script in uses[x]]
            emit = [sum(map(loss[x], found)) - (langid.OFF_SCRIPT if may and x not in may else 0) for x in langs]
            if best is None:
                best, came = emit, [*range(len(langs))]
            else:
                top = max(range(len(langs)), key=lambda k: (best[k], -k))
                came = [k if best[k] >= best[top] - langid.SWITCH else top for k in range(len(langs))]
                best = [max(best[k], best[top] - langid.SWITCH) + emit[k] for k in range(len(langs))]
            back.append(came)
            sizes.append(size)
        if not sizes or not langs:
            out[i] = ("und", 0.0)
            continue
        state, letters = max(range(len(langs)), key=lambda k: (best[k], -k)), [0] * len(langs)
        for came, size in zip(reversed(back), reversed(sizes), strict=True):
            letters[state] += size
            state = came[state]
        k = max(range(len(langs)), key=lambda k: (letters[k], -k))
        out[i] = (langs[k], letters[k] / sum(letters))
    return out


def test_predictions_by_a_plain_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    want = plain([tuple(r) for r in docs])
    for r in queries.op5_language_id(spark, sf).collect():
        assert (r.lang_pred, r.score) == (want[r.doc_id][0], pytest.approx(want[r.doc_id][1], abs=0.02)), r.doc_id


def test_marks_belong_to_words_and_many_languages_are_an_error(spark, monkeypatch):
    hindi = "यह एक घर है और वह बगीचा है"
    words = langid._Letters([hindi, "́ ̈", "é"])
    assert [(hindi[a - 1 : z - 1]) for a, z in zip(words.first[:8], words.stop[:8], strict=True)] == hindi.split() and words.doc.tolist() == [0] * 8 + [2]
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(30)] + [(99, "́ ̈", None)], "doc_id long, text string, lang string").coalesce(1)
    assert langid.identify(docs.where("doc_id > 5")).where("doc_id = 99").first().lang_pred == "und"
    monkeypatch.setattr(langid, "LANGUAGES", 5)
    with pytest.raises(Exception, match="more than 5 languages"):
        langid.train(docs)


def test_mixed_text_scripts_and_edge_cases(spark):
    en, fr, ru = "the house and the garden with old trees", "la maison et le jardin avec les arbres", "старый дом и большой сад"
    rows = [(1000 + i, t * 30, x) for i, (t, x) in enumerate([(en, "en"), (fr, "fr"), (ru, "ru")] * 20)] + [(1100, None, "en"), (1101, en, None), (None, "x", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(1)).withColumn("held_out", F.lit("clash"))
    model = langid.train(docs.drop("score"))
    assert model.languages == ["en", "fr", "ru"]
    mixed = f"{en} {en}. {fr} {fr}! {ru}"
    got = langid.spans(mixed, model)
    assert [x for _, _, x in got] == ["en", "fr", "ru"]
    assert [mixed[a:b] for a, b, _ in got][2] == ru
    tests = [(1, None), (2, ""), (3, "123 ... 456"), (4, mixed), (5, "中文"), (6, ru + " " + en), (6, ru + " " + en), (None, fr), (7, (en + " ") * 20000)]
    out = langid.identify(spark.createDataFrame([(i, t, None) for i, t in tests], docs.drop("score", "held_out").schema).unionByName(docs.drop("score", "held_out"))).collect()
    assert len(out) == len(tests) + len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is None or 0 < r.doc_id < 8}
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and [by[i].score for i in (1, 2, 3)] == [0.0] * 3
    assert by[7].lang_pred == "en" and by[7].score == 1.0
    assert by[4].lang_pred in ("en", "fr") and by[4].score < 0.6
    empty = docs.limit(0).drop("score", "held_out")
    assert langid.identify(empty).count() == 0
    kept = langid.keep_identified(docs.drop("held_out"))
    assert kept.columns == ["doc_id", "text", "lang", "score"] and kept.count() == 60 + 2


def test_nothing_learned_is_und(spark):
    docs = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in langid.identify(docs).collect()] == [(1, False, "und", 0.0)]


def test_rows_without_anything_to_learn_from(spark):
    """Without labels nothing is identified; an empty table gives no row; columns of any name pass."""
    docs = spark.createDataFrame([(1, "some words here", None, "x"), (None, None, None, "y")], "doc_id long, text string, lang string, lang_pred string")
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns and out.count() == 0
    assert langid.keep_identified(docs.limit(0)).count() == 0
