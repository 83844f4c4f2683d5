import duckdb
import pytest
from pyspark.sql import functions as F

from textlens import queries, table_queries
from textlens.functions import segment
from textlens.plans import cli, jobs
from textlens.profiles import LATIN, ZH
from textlens.sources import corpus, sinks
from textlens.streaming import documents


@pytest.fixture
def tree(tmp_path):
    for cat, n in (("甲类", 4), ("b", 3)):
        (tmp_path / "in" / cat).mkdir(parents=True)
        for i in range(n):
            (tmp_path / "in" / cat / f"{i}.txt").write_text(f"第{i}篇。" + "你好方向" * 200, encoding="utf-8")
    (tmp_path / "in" / "root.txt").write_text("ignored")
    (tmp_path / "in" / "b" / "bad.txt").write_bytes("短文".encode("gbk"))
    (tmp_path / "in" / "b" / "note.md").write_text("no")
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "x.txt").write_bytes(b"\xef\xbb\xbfabc\xff\xfe\x00")
    return tmp_path


def test_scan(spark, tree):
    rows = corpus.scan(spark, f"{tree}/in").collect()
    assert sorted((r.category, r.path.rsplit("/", 1)[1]) for r in rows) == sorted([("b", f"{i}.txt") for i in range(3)] + [("b", "bad.txt")] + [("甲类", f"{i}.txt") for i in range(4)])
    assert next(r.text for r in rows if r.path.endswith("bad.txt")) == "短文"
    assert {r.category for r in corpus.scan(spark, f"{tree}/in", "甲类").collect()} == {"甲类"}
    assert corpus.scan(spark, f"{tree}/in", "c").count() == 0 and corpus.scan(spark, f"{tree}/none").count() == 0
    flat = corpus.scan(spark, f"{tree}/flat").first()
    assert flat.category == "corpus" and flat.text.startswith("﻿abc")
    assert corpus.pick(spark, f"{tree}/in", "b", 2, 1, 100).count() == 2
    assert corpus.pick(spark, f"{tree}/in", "b", 9, 0, 0.5).count() == 1
    assert corpus.pick(spark, f"{tree}/flat", "b", 9).first().category == "corpus"
    with pytest.raises(FileNotFoundError):
        corpus.story(spark, f"{tree}/none.txt")


@pytest.mark.parametrize("where", ["local", "elsewhere"])
def test_files_without_a_byte(spark, tree, where):
    """Spark's own sources leave them out; ``viewfs`` stands for a store that only Spark reaches."""
    for name in ("in/b/empty.txt", "in/b/100%.txt", "in/b/a+b.txt", "flat/empty.txt"):
        (tree / name).write_bytes(b"")
    (tree / "in" / "none").mkdir()
    (tree / "in" / "none" / "0.txt").write_bytes(b"")
    root = str(tree)
    if where == "elsewhere":
        spark.sparkContext._jsc.hadoopConfiguration().set(f"fs.viewfs.mounttable.{tree.name}.link./t", f"file://{tree}")
        root = f"viewfs://{tree.name}/t"
    names = lambda rows: sorted((r.category, r.path.rsplit("/", 1)[1], r.length) for r in rows.where("text = ''").collect())
    own = [("b", "100%.txt", 0), ("b", "a+b.txt", 0), ("b", "empty.txt", 0)]
    assert names(corpus.scan(spark, f"{root}/in")) == [*own, ("none", "0.txt", 0)] and corpus.scan(spark, f"{root}/in").count() == 12
    assert names(corpus.scan(spark, f"{root}/in", "b", most_kb=0.5)) == own and names(corpus.scan(spark, f"{root}/in", "b", least_kb=0.001)) == []
    assert names(corpus.scan(spark, f"{root}/flat")) == [("corpus", "empty.txt", 0)] and corpus.scan(spark, f"{root}/flat").count() == 2
    assert names(corpus.pick(spark, f"{root}/in", "b", 99)) == own and corpus.pick(spark, f"{root}/in", "b", 99).count() == 7
    assert names(corpus.pick(spark, f"{root}/in", "b", 99, 0.001)) == [] and names(corpus.pick(spark, f"{root}/flat", "b", 9)) == [("corpus", "empty.txt", 0)]


def test_a_scan_takes_one_level(spark, tree):
    (tree / "in" / "b" / "deep").mkdir()
    for name in ("deep/x.txt", "_x.txt", ".x.txt"):
        (tree / "in" / "b" / name).write_text("x")
    assert sorted(r.path.rsplit("/", 1)[1] for r in corpus.scan(spark, f"{tree}/in", "b").where("text = 'x'").collect()) == [".x.txt", "_x.txt"]


def test_scanned_documents_with_empty_texts(spark, tmp_path):
    rows = [(0, "", "en"), (1, "a", "en"), (2, "", "fr"), (3, "﻿é\r\n", ""), (4, "", "ü%+ "), (5, "\0", "_x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    documents = duckdb.read_parquet(f"{tmp_path}/documents.parquet/*.parquet")
    want = documents.query("documents", queries.ORACLE_SQL["scanned_documents"]).fetchall()
    got = table_queries.scanned_documents(spark, str(tmp_path)).collect()
    assert len(want) == 6 and sorted(map(tuple, got)) == sorted(want)


def test_jobs_and_sinks(spark, tree):
    words = spark.createDataFrame([("方向", 50), ("你好", 40)], "term string, freq long")
    o = jobs.Options(f"{tree}/in", "甲类", 3, "人设", None, {"主题": "海"})
    context = jobs.distil(spark, o, segment.segmenter(words))
    text = context.first()[0]
    assert text.count("### 源文") == 3 and "你好" in text and "生成硬性约束" not in text
    cut = segment.segmenter(words)
    both, picked = jobs.fuse(spark, o, [f"{tree}/in/b/0.txt", f"{tree}/in/b/1.txt"], cut)
    text = both.first()[0]
    names = [line.split(": ")[1] for line in text.split("\n") if line.startswith("### 源文")]
    assert names[:2] == ["0.txt", "1.txt"] and len(names) == 5 and picked.count() == 3
    assert text.startswith("你是") and "- 禁用: 圣母" in text and "一切都在, 她心想" in text and text.endswith("说明。\n") and "| 独特道具 |" in text
    with pytest.raises(ValueError):
        jobs.fuse(spark, o, [f"{tree}/in/b/0.txt"], cut, least_kb=100)
    with pytest.raises(ValueError):
        jobs.fuse(spark, jobs.Options(f"{tree}/in"), [], cut)
    files = spark.createDataFrame([("prompt_character.md", "头\n<!-- FILE_SECTION: 人设生成器 -->\n说\n---\n模板A\n---\nB")], "file string, content string")
    outputs = spark.createDataFrame([("灵感风暴_result.txt", "前文")], "file string, text string")
    prompt = jobs.stage_prompt(spark, o, files, outputs, context).first().prompt
    assert "模板A" in prompt and "前文" in prompt and "- 主题: 海" in prompt and "### " in prompt
    story = spark.createDataFrame([("s", "方，向对。" * 3)], "doc_id string, text string")
    assert jobs.adjust(story, ZH, 1.0, words).first().rewritten == "方向对！" * 3
    assert jobs.check(story, ZH, None, words).where("rule = 'names'").count() == 1
    found, pairs = jobs.audit(story, spark.createDataFrame([("x", "y")], "source_id string, text string"))
    path = f"{tree}/s.md"
    report = sinks.write_report(found, path, "audit")
    assert report == f"{tree}/s.md_audit.txt" and "fixed_rules" in open(report, encoding="utf-8").read() and pairs.count() == 1
    assert sinks.put_placeholder(f"{tree}/o/story.txt") and sinks.put_placeholder(f"{tree}/o/story.txt")
    with open(f"{tree}/o/story.txt", "w", encoding="utf-8") as f:
        f.write("done")
    assert not sinks.put_placeholder(f"{tree}/o/story.txt")
    with pytest.raises(ValueError):
        sinks.write_rewritten(story, f"{tree}/s.txt", f"{tree}/./s.txt")
    sinks.write_findings(found, f"{tree}/findings")
    assert spark.read.parquet(f"{tree}/findings").count() == found.count()


def test_command_line(spark, tree, monkeypatch, capsys):
    assert cli.parameters("{bad")[0] == {} and cli.parameters('{"a": [1]}')[0] == {"a": "[1]"}
    answers = iter(["a=b", "c= ", ""])
    assert cli.asked(None, lambda _: next(answers)) == {"a": "b"}
    answers = iter(["古代言情", " ", "女频"])
    assert cli.asked("脑洞", lambda _: next(answers)) == {"小说类型": "古代言情", "目标受众": "女频"}
    story = tree / "story.txt"
    story.write_text("One. Two! \"Three\"\r\nfour.", encoding="utf-8")
    assert cli.main(["check", str(story), "--profile", "latin", "-o", f"{tree}/out", "--unknown"]) == 0
    assert "ascii_quotes" in (tree / "story_check_report.txt").read_text(encoding="utf-8")
    assert cli.main(["audit", str(story), str(story), "--profile", "latin", "-o", f"{tree}/out"]) == 0
    assert cli.main(["check", f"{tree}/missing.txt", "-o", f"{tree}/out"]) == 1
    assert "ignored" in capsys.readouterr().err
    report = (tree / "story_check_report.txt").read_text(encoding="utf-8")
    assert "letters: 15\ngenre: default" in report and "  dialogue_density: 26.7\n" in report and "  paragraph_length: 11\n" in report and "total: " in report
    for i in range(3):
        (tree / "in" / "b" / f"{i}.txt").write_text("Some words. And more!", encoding="utf-8")
    assert cli.main(["fuse", str(story), "--corpus", f"{tree}/in", "-c", "b", "-n", "2", "--max-kb", "0.5", "--profile", "latin", "-o", f"{tree}/out"]) == 0
    text = "".join(p.read_text(encoding="utf-8") for p in (tree / "out" / "fusion_context").glob("part-*"))
    assert text.count("### ") == 3 and "No passage of 16 characters" in text and "None of these patterns: of the" in text
    assert "drawn from b:" in capsys.readouterr().out
    assert cli.main(["fuse", str(story), "--profile", "latin", "-o", f"{tree}/out"]) == 1


def test_streams(spark, tree, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs.limit(40).write.parquet(f"{tree}/stream")
    live = spark.readStream.schema(docs.schema).parquet(f"{tree}/stream")
    q = documents.write_stream(documents.stream_findings(live, LATIN), f"{tree}/found", f"{tree}/ck")
    q.awaitTermination(120)
    still = spark.read.parquet(f"{tree}/stream")
    assert spark.read.parquet(f"{tree}/found").count() == documents.stream_findings(still, LATIN).count() > 0
    assert documents.stream_healthy(live, LATIN).isStreaming
    assert F is not None
