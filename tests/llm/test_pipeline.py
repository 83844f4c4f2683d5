import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
import test_langid
import test_mixing
import test_packing
import test_pseudonyms
import test_similar
from textlens.llm import mixing
from textlens.llm.common import finished, shared_dir, written


def test_stages_keep_what_they_should(spark, sf):
    first = spark.read.parquet(f"{sf}/documents.parquet")
    docs, seen = first, {}
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), "test")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.dtypes == first.dtypes, name
        seen[name], docs = out, out
    n = {k: v.count() for k, v in seen.items()}
    assert 0.95 * first.count() <= n["language ID"] <= first.count()
    assert n["SimHash near-dedup"] == n["PII pseudonyms"] <= seen["language ID"].select(F.sha2("text", 256)).distinct().count()
    texts = "\n".join(r.text for r in seen["PII pseudonyms"].select("text").collect())
    assert not re.search(r"@mail\d\.example\.com", texts)
    assert [tuple(r) for r in seen["PII pseudonyms"].where("n_chars <> length(text)").collect()] == []
    tokens = {r[0]: r[1] for r in seen["packing"].groupBy("doc_id").agg(F.sum("length")).collect()}
    assert set(tokens) == {r.doc_id for r in seen["source mix"].select("doc_id").distinct().collect()}
    rows = corpus_pipeline.run(spark, sf)
    assert rows.columns == seen["packing"].columns and rows.count() == n["packing"]


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (None, None, None, None, None), (1, "", "en", None, 0), (2, "a", None, "s", 1)]])
def test_edge_cases(spark, sf, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("taken", F.lit("clash")).withColumn("row", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
        stage(spark, docs, sf).count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)  # one or two ids each: one piece


def test_every_stage_gives_what_its_restatement_says(spark):
    """The whole chain on a small table; each stage by other means, on what the stage before gave."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = lambda df: sorted((tuple(r) for r in df.select("doc_id", "text", "lang", "source").collect()), key=str)

    before = rows(docs)
    said = test_langid.plain([r[:3] for r in before])
    docs = written(stages["language ID"](spark, docs, sf), "test")
    now = rows(docs)
    assert now == [r for r in before if said[r[0]][0] != "und" and said[r[0]][1] >= 0.5]

    kept, _ = test_similar.plain_kept([r[:2] for r in now])
    docs = written(stages["SimHash near-dedup"](spark, docs, sf), "test")
    assert rows(docs) == (now := [r for r in now if r[0] in kept])

    docs = written(stages["PII pseudonyms"](spark, docs, sf), "test")
    after = rows(docs)
    for old, new in zip(now, after, strict=True):
        assert old[0] == new[0] and old[2:] == new[2:]
        if not any(re.search(test_pseudonyms.LOOSE[kind], old[1]) for kind in ("iban", "date", "ssn")):
            assert new[1] == test_pseudonyms.apply(old[1])[0]
    now = after

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    order = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    taken = test_mixing.plain([(d, words(t), s, t) for d, t, s in order])
    docs = written(stages["source mix"](spark, docs, sf), "test")
    got = {}
    for r in docs.collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for (d, t, _), n in zip(order, taken, strict=True):
        own = sorted(got.get(d, []), key=len, reverse=True)
        whole = n // words(t) if words(t) else 0
        assert [x == t for x in own].count(True) >= whole and sum(map(words, own)) == n and all(t.startswith(x) for x in own)

    packed = stages["packing"](spark, docs.where("doc_id % 3 = 0").dropDuplicates(["doc_id"]), sf)
    some = {r.doc_id: None for r in packed.select("doc_id").distinct().collect()}
    texts = {r.doc_id: r.text for r in docs.where("doc_id % 3 = 0").dropDuplicates(["doc_id"]).collect()}
    assert set(some) == set(texts)
    whole = stages["packing"](spark, docs, sf).groupBy("doc_id").agg(F.sum("length")).collect()
    want = {}
    for r in docs.collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + len(test_packing.TOK.encode(r.text, add_special_tokens=False).ids) + 1
    assert {r[0]: r[1] for r in whole} == want


NAMES = "lang_pred lang_score score held_out similar_row loc n digest best none c node component pseudonyms kinds mix_row mix_size mix_taken mix_pass row size taken tie key sid low high nb bucket first upto stop start b times range_no place weight target unit pos a z simhash_row fp rep".split()


@pytest.mark.parametrize("case", [str.lower, str.upper])
@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_pass_columns_named_like_their_own(spark, sf, stage, case):
    """Every name that some operator uses inside, in both cases, all at once."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 40")
    more = docs.select("*", *[F.col("doc_id").alias(case(n)) for n in NAMES])
    out = dict(corpus_pipeline.STAGES)[stage](spark, more, sf)
    if stage == corpus_pipeline.STAGES[-1][0]:
        assert out.select("doc_id").distinct().count() == docs.count()
        return
    assert out.columns == more.columns
    rows = out.collect()
    assert rows and all(r[case(n)] == r.doc_id for r in rows for n in NAMES)


def test_what_an_operator_wrote_on_the_way_is_removed(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    base = shared_dir(spark, "x").rsplit("/", 1)[0].removeprefix("file:")
    before = set(os.listdir(base)) if os.path.isdir(base) else set()
    out = finished(lambda: mixing.mix(docs), "kept")
    left = set(os.listdir(base)) - before
    assert out.count() == docs.count() and len(left) == 1 and next(iter(left)).startswith("kept-")
