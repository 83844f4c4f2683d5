"""Golden cases with the Chinese profile, and own restatements of the rewrites and overlap in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textlens.functions import segment
from textlens.functions import text as X
from textlens.operators import corpus, fingerprint, names, overlap, rewrite, rules, templates
from textlens.profiles import LATIN, ZH


def one(spark, column, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in rows.orderBy("i").select(column(F.col("text"))).collect()]


def test_counts_and_sentences(spark):
    t = "他说：「走。」\n！！！！？！；"
    assert one(spark, lambda c: X.letter_count(c, ZH), t, "", None) == [3, 0, None]
    assert [one(spark, lambda c, k=k: X.literal_count(c, k), t)[0] for k in ("！！！", "？！", "；", "aa")] == [1, 1, 1, 0]
    assert one(spark, lambda c: X.sentences(c, ZH), "甲。乙！！丙？\n。") == [["甲", "乙", "丙"]]
    assert one(spark, lambda c: X.sentence_pieces(c, ZH), "甲。乙！") == [["甲。", "乙！", ""]]


def test_sections_and_headings(spark):
    assert one(spark, lambda c: X.heading_counts(c, ZH)[0], "x\n1\n2\ny") == [2]
    assert one(spark, lambda c: X.heading_counts(c, ZH)[3], "x\n一\n二\n三\ny") == [2]
    assert one(spark, lambda c: X.sections(c, ZH), "序\n第一章 甲\n打脸\n第二章：乙\n重生", "x\n1\n2\ny", "x") == [["序", "甲\n打脸", "乙\n重生"], ["x", "1", "2\ny"], ["x"]]


def test_lines_dialogue_and_endings(spark):
    assert one(spark, lambda c: X.opening_lines(c, ZH), " a \n\n=x\n试读b\nc", "　甲　\r\n乙") == ["a\nc", "甲\n乙"]
    t = '他想。“走吧。”她说：「好」"嗯"'
    assert (one(spark, lambda c: X.dialogue_spans(c, ZH), t), one(spark, lambda c: X.dialogue_cues(c, ZH), t)) == ([2], [2])
    assert one(spark, lambda c: X.total_count(X.tail(c), ZH.lists["open_endings"]), "未完待续……") == [4]
    assert one(spark, lambda c: X.normalised(c, ZH), "甲，　１2\t乙「…」") == ["甲乙「…」"]
    assert one(spark, X.newlines, "a\r\nb\rc") == ["a\nb\nc"]
    assert one(spark, lambda c: X.json_params(c), '{"a":"b"}', "bad", '{"a":1,"b":[1],"c":""}') == [{"a": "b"}, {}, {"a": "1", "b": "[1]"}]


def plain_excl(t, target):
    total = len([s for s in re.split("[。！？]", t) if re.search("[一-鿿]", s)])
    need = int(total * target) - t.count("！")
    if target <= 0 or need <= 0 or "。" not in t:
        return t
    step, k, out, done = max(1, t.count("。") // need), 0, [], 0
    for i, c in enumerate(t):
        if c == "。":
            k += 1
            if k % step == 0 and done < need and i and not re.match("[0-9a-zA-Z]", t[i - 1]):
                c, done = "！", done + 1
        out.append(c)
    return "".join(out)


def plain_commas(t):
    out = []
    for s in re.split("(?<=[。！？])", t):
        han = [m.end() for m in re.finditer("[一-鿿]", s)]
        if 12 <= len(han) <= 30 and "，" not in s and han[len(han) // 2 - 1] < len(s):
            at = han[len(han) // 2 - 1]
            s = s[:at] + "，" + s[at:]
        out.append(s)
    return "".join(out)


def test_rewrites_equal_plain_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choices("甲乙丙丁。。！？，a1\n", k=rng.randrange(0, 60))) for _ in range(300)] + ["".join(rng.choices("甲乙丙丁戊己" * 4 + "。！，x", k=rng.randrange(0, 90))) for _ in range(300)]
    for target in (0.0, 0.3, 0.5, 2.0):
        assert one(spark, lambda c, target=target: rewrite.raise_exclamations(c, ZH, target), *texts) == [plain_excl(t, target) for t in texts]
    assert one(spark, lambda c: rewrite.insert_commas(c, ZH), *texts) == [plain_commas(t) for t in texts]


def test_rewrite_fixtures(spark):
    assert one(spark, lambda c: rewrite.raise_exclamations(c, ZH, 0.5), "一。二。三a。四。五。六。", "一。二a。三。四。", "一！二。") == ["一。二！三a。四！五。六！", "一。二a。三。四！", "一！二。"]
    assert one(spark, lambda c: rewrite.insert_commas(c, ZH), "一二三四五六七八九十甲乙。短句。\n一二三四五六七八九十甲乙丙") == ["一二三四五六，七八九十甲乙。短句。\n一二三四五六，七八九十甲乙丙"]
    df = rewrite.adjusted(spark.createDataFrame([("一。二。",)], "text string"), ZH, 1.0).first()
    assert (df.rewritten, df.excl_before, df.excl_after) == ("一！二！", 0, 2)


def plain_overlap(story, source):
    clean = lambda t: re.sub(r"[，。！？：；、\s\d]", "", t)
    a, b = clean(story), clean(source)
    return sum(b[i : i + 16] in a for i in range(0, len(b) - 16, 5))


def test_overlap(spark):
    alphabet = [chr(0x4E00 + i) for i in range(200)]
    rng = random.Random(2)
    base = "".join(rng.choices(alphabet, k=300))
    cut = spark.createDataFrame([(n, base[:n]) for n in (0, 15, 16, 17, 21, 22, 27)] + [(99, None)], "source_id int, text string")
    assert {r.source_id: r["count"] for r in overlap.wanted_grams(cut, ZH).groupBy("source_id").count().collect()} == {17: 1, 21: 1, 22: 2, 27: 3}
    stories = [(i, base[:50] + "，" + base[i * 10 : i * 10 + 40 + i]) for i in range(8)] + [(9, ""), (10, "无关")]
    sources = [(1, base), (2, base[40:140] * 2), (3, "短"), (4, "")]
    s, r = spark.createDataFrame(stories, "doc_id int, text string"), spark.createDataFrame(sources, "source_id int, text string")
    got = {(x.doc_id, x.source_id): (x.matches, x.verdict) for x in overlap.overlap_grid(s, r, ZH).collect()}
    assert got == {(i, j): (n, "FAIL" if n else "OK") for i, a in stories for j, b in sources for n in (plain_overlap(a, b),)}
    assert {x.doc_id for x in overlap.originals(s, r, ZH).collect()} == {9, 10}
    report = {(x.doc_id, x.source_id): x.verdict for x in overlap.overlap_report(s, r, ZH).collect()}
    assert report == {k: "FAIL" for k, (_, verdict) in got.items() if verdict == "FAIL"} | {(9, None): "OK", (10, None): "OK"}
    with pytest.raises(ValueError):
        overlap.overlap_grid(s, r, ZH, most=5)


def test_overlap_drops_what_the_old_pattern_dropped(spark):
    """Every code point of the basic plane: the look-up's own normalisation is that of the column function."""
    from textlens.functions import text as X

    points = [chr(c) for c in range(1, 0x10000) if not 0xD800 <= c < 0xE000]
    rows = spark.createDataFrame([(c,) for c in points], "c string").select("c", X.normalised(F.col("c"), ZH).alias("n")).collect()
    table = overlap._dropped(ZH.dropped)
    assert [r.c for r in rows if (r.n == "") != bool(table[ord(r.c)])] == []


def test_overlap_with_chance_hits_and_characters_beyond_the_basic_plane(spark):
    rng = random.Random(4)
    base = "".join(rng.choices("😀𠀀甲é", k=4000))
    stories = [(i, base[i * 100 : i * 100 + 60] + "".join(rng.choices("abc", k=300))) for i in range(20)] + [(30, None)]
    sources = [(1, base), (2, "".join(rng.choices("abc", k=3000)))]
    s, r = spark.createDataFrame(stories, "doc_id int, text string"), spark.createDataFrame(sources, "source_id int, text string")
    got = {(x.doc_id, x.source_id): x.matches for x in overlap.overlap(s, r, ZH, bits=15).collect()}  # many n-grams share a bit
    assert got == {(i, j): n for i, a in stories for j, b in sources if (n := plain_overlap(a or "", b))}


@pytest.mark.parametrize("compat,words,want", [(False, None, {"苏暖", "赵天豪"}), (True, [("无", 1)], {"苏暖"}), (False, [("赵天豪", 900)], {"苏暖"})])
def test_names(spark, compat, words, want):
    df = spark.createDataFrame([(1, "赵天豪说，苏暖走。苏暖暖笑。张三说。")], "doc_id int, text string")
    d = spark.createDataFrame(words, "term string, freq long") if words else None
    found = names.names(df, d, compat)
    assert {r.name for r in found.collect()} == want
    assert names.cast_findings(found, df).first().severity == "pass"
    assert sorted(tuple(r) for r in names.aliases(df).collect()) == [(1, "苏暖", "苏暖暖"), (1, "苏暖", "苏暖走")]
    known = spark.createDataFrame([("苏暖走", 900)], "term string, freq long")
    assert sorted(tuple(r) for r in names.aliases(df, known).collect()) == [(1, "苏暖", "苏暖暖")]


def test_names_of_compound_surnames_and_none(spark):
    df = spark.createDataFrame([(1, "慕容雪笑，慕容白走。"), (2, "谢谢周总监。方方的走。")], "doc_id int, text string")
    assert {(r.doc_id, r.name) for r in names.names(df, compat=True).collect()} == {(1, "慕容白走")}
    assert names.cast_findings(names.names(df), df).where("doc_id = 2").first().severity == "warn"
    assert names.tiers(names.names(df)).first().compound == 2


def test_segmentation_and_fingerprint(spark):
    words = spark.createDataFrame([("方向", 50), ("你好", 40), ("好", 10), ("方", 1), ("向你", 1)], "term string, freq long")
    cut = segment.segmenter(words)
    assert one(spark, cut, "方向你好，好x方", None) == [["方向", "你好", "好", "方"], None]
    with pytest.raises(ValueError):
        segment.segmenter(words, 3)
    df = spark.createDataFrame([(1, "方向你好。你好！\n" * 5), (2, ""), (3, "你好方向" * 3)], "doc_id int, text string")
    got = {r.doc_id: r for r in fingerprint.fingerprint(df, ZH, cut, whole=False).collect()}
    assert got[1].top_terms == ["你好", "方向"] and got[3].top_terms == ["你好", "方向"] and got[2].top_terms == []
    assert (got[1].chars, got[1].sentences, got[1].excl_per_sent, got[2].sentences) == (30, 10, 0.5, 1)


def test_rules_on_chinese_text(spark):
    text = "序：系统绑定\n第一章 甲\n打脸！\n第二章 乙\n他心想。终于成功。" + "甲" * 210
    found = rules.findings(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), ZH)
    got = {(r.rule, r.term): (r.severity, r.value) for r in found.where("doc_id = 1").collect()}
    assert got["length", ""][0] == "issue" and got["climax", ""] == ("pass", 1.0) and got["setup", ""][0] == "pass"
    assert got["thinking", "心想"] == ("warn", 1.0) and got["long_paragraph", ""] == ("warn", 1.0) and got["ending_power", ""] == ("pass", 2.0)
    assert ("emotion_density", "") not in {(r.rule, r.term) for r in found.where("doc_id = 2").collect()}
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")
    for t in rules.totals(df, ZH).collect():
        assert (t.passes, t.warns, t.issues) == tuple(found.where((F.col("doc_id") == t.doc_id) & (F.col("severity") == s)).count() for s in ("pass", "warn", "issue"))
    audit = rules.findings(spark.createDataFrame([(1, "无句")], "doc_id int, text string").withColumn("text", F.lit("abc")), ZH, rules=rules.audit_rules)
    assert {(r.rule, r.value) for r in audit.collect()} >= {("exclamations_per_sentence", None), ("fixed_rules", 0.0)}


def test_samples_and_guards(spark):
    df = spark.range(100).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("category"))
    a, b = (sorted(tuple(r) for r in corpus.sample(df, 5, s).collect()) for s in (1, 1))
    assert a == b and len(a) == 15 and a != sorted(tuple(r) for r in corpus.sample(df, 5, 2).collect())
    assert corpus.sample(df, 1000).count() == 100 and corpus.sample(df, 7, 1, None).count() == 7
    with pytest.raises(ValueError):
        corpus.require(df.limit(2))
    with pytest.raises(ValueError):
        templates.stage_index("unknown")
    assert LATIN.lexicon(spark).count() > 20 and ZH.genre("nothing") is ZH.genres["default"]
