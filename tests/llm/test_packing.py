import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textlens.llm import packing, queries
from textlens.llm.tokens import WordTokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def check(rows, texts):
    """``texts``: by doc_id. Every id in one piece; gapless offsets; sequences at a power of two."""
    by, seqs = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(by) == set(texts)
    for d, t in texts.items():
        ids = np.array([*TOK.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length in {1 << b for b in range(12)}
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
    for rs in seqs.values():
        assert len(rs) == 1 and rs[0].offset == 0


def test_all_documents(spark, sf):
    check(queries.op1_packing(spark, sf).collect(), {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()})


def test_buckets_hold_equal_lengths(spark, sf):
    """Each file of the result holds sequences of one length, and a bucket is read without the others."""
    out = queries.op1_packing(spark, sf)
    assert out.where("bucket <> length").count() == 0
    files = out.select(F.input_file_name().alias("f"), "length").distinct().groupBy("f").count().collect()
    assert files and all(r["count"] == 1 and re.search("bucket=[0-9]+/", r.f) for r in files)
    one = out.where("bucket = 512")
    assert {r.length for r in one.collect()} == {512} and len(one.inputFiles()) and "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()


def test_edge_cases_and_ids(spark):
    texts = {1: None, 2: "", 3: " \n", 4: "Don't <|endoftext|>x it's (A) “quoted” 123abc é é ΣΑΣ İx ﬁ 中文。", 5: "word " * 9000, 6: "a b　c\x1cd"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").selectExpr("*", "0 as start", "'x' as sequence_id")
    rows = packing.pack(docs, PATH).collect()
    check(rows, texts)
    assert all(zlib.crc32(np.array(r.ids, dtype="<u4").tobytes()) == r.ids_crc32 for r in rows)
    assert packing.pack(docs.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    got = packing.pack(twice, PATH).collect()
    assert sum(r.length for r in got) == 6 and len({r.sequence_id for r in got}) == len(got)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list("abcXYZ .,!'\"()<|>éÉ\n\t#1́Σß$%&*+-/=@[\\]^_`{}~¿ς")), st.characters(exclude_categories=["Cs"]))))
def test_words_give_the_ids_of_the_whole_text(text):
    global OWN
    OWN = globals().get("OWN") or WordTokenizer(PATH, most=50)
    assert OWN.encode_all([text])[0].tolist() == TOK.encode(text, add_special_tokens=False).ids


@given(st.integers(0, 50_000))
def test_pieces(n):
    got = packing.pieces(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 2048 for x in got) and sorted(got, reverse=True) == got
