import os
import tracemalloc

import pytest
from textlens.sources import files


@pytest.fixture
def rows(spark, tmp_path):
    files.register(spark)
    data = [("a", "1", "one\r\ntwo\n"), ("a", "2/x", ""), ("b c", ".hidden", "é方"), ("_z", "1", "x" * 5000), ("", "", "none"), ("ü%", "%", "﻿mark")]
    df = spark.createDataFrame(data, "category string, name string, text string").repartition(3)
    return data, df, str(tmp_path / "corpus")


def read(spark, folder, where="true"):
    return spark.read.format("corpus").load(folder).where(where)


def test_round_trip(spark, rows):
    data, df, folder = rows
    df.write.format("corpus").mode("append").save(folder)
    assert sorted((x.category, x.name, x.text) for x in read(spark, folder).collect()) == sorted(data)
    assert all(x.bytes == len(x.text.encode()) for x in read(spark, folder).collect())
    assert not any(x.startswith("_staging") for x in os.listdir(folder))
    # a second time the names are taken, and nothing changes
    with pytest.raises(Exception, match="another's place"):
        df.write.format("corpus").mode("append").save(folder)
    assert read(spark, folder).count() == len(data) and not any(x.startswith("_staging") for x in os.listdir(folder))
    df.where("category = 'a'").write.format("corpus").mode("overwrite").save(folder)
    assert sorted(x.name for x in read(spark, folder).collect()) == ["1", "2/x"]


def test_conditions_choose_files_before_they_are_opened(spark, rows):
    data, df, folder = rows
    df.write.format("corpus").mode("append").save(folder)
    for where, want in {"category = 'a' and bytes > 0": ["1"], "category in ('a', '_z') and bytes >= 1 and bytes < 5001": ["1", "1"], "category = 'a' and category = 'b c'": [], "category = 'a' or bytes = 5000": ["1", "1", "2/x"], "text = 'none'": [""]}.items():
        assert sorted(x.name for x in read(spark, folder, where).collect()) == want
    # unreadable files don't matter where the category leaves them out
    for name in os.listdir(f"{folder}/a"):
        os.replace(f"{folder}/a/{name}", f"{folder}/a/{name}.gone.txt")
        os.mkdir(f"{folder}/a/{name}")
    assert read(spark, folder, "category = '_z'").count() == 1
    reader = files.CorpusReader(folder, None)
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not

    left = [Not(EqualTo(("text",), "x")), GreaterThan(("name",), "a")]
    assert list(reader.pushFilters([EqualTo(("category",), "_z"), GreaterThan(("bytes",), 10), *left])) == left
    assert [[x[2] for x in p.rows] for p in reader.partitions()] == [[5000]]


def test_partitions_follow_sizes(spark, rows, monkeypatch):
    _, df, folder = rows
    df.write.format("corpus").mode("append").save(folder)
    monkeypatch.setattr(files, "PART", 4000)
    parts = [[x[2] for x in p.rows] for p in files.CorpusReader(folder, None).partitions()]
    assert sorted(x for p in parts for x in p) == [0, 4, 5, 7, 9, 5000] and len(parts) == 3 and all(sum(p) <= 4000 or len(p) == 1 for p in parts)


def test_other_encodings_and_endings(spark, tmp_path):
    files.register(spark)
    os.makedirs(tmp_path / "k")
    for name, data in {"g.txt": "短文".encode("gbk"), "u.txt": "短文".encode(), "bad.txt": b"ab\xff", "n.md": b"no"}.items():
        (tmp_path / "k" / name).write_bytes(data)
    assert {x.name: x.text for x in read(spark, str(tmp_path)).collect()} == {"g": "短文", "u": "短文", "bad": "ab�"}


def test_a_failed_job_leaves_nothing(spark, rows):
    _, df, folder = rows
    bad = df.unionByName(spark.createDataFrame([(None, "n", "t")], df.schema))
    with pytest.raises(Exception, match="no place"):
        bad.write.format("corpus").mode("append").save(folder)
    assert [x for _, _, names in os.walk(folder) for x in names] == []


@pytest.mark.parametrize("what", ["plan", "commit"])
def test_the_driver_holds_no_list_of_the_files(spark, tmp_path, monkeypatch, what):
    """What the driver holds of one more file: a plan a few compressed bytes, a commit a digest and its sorted copy."""
    monkeypatch.setattr(files, "FILES", 1000)

    def peak(n):
        root = tmp_path / f"{what}{n}"
        folders = [root / "c"] if what == "plan" else [root / "_staging" / "job" / str(k) / "0" / "c" for k in range(n // 1000)]
        for f in folders:
            f.mkdir(parents=True)
        for i in range(n):
            (folders[i % len(folders)] / f"{i}.txt").touch()
        writer, reader = files.CorpusWriter(str(root), files.StructType.fromDDL(files.SCHEMA), False), files.CorpusReader(str(root), None)
        tracemalloc.start()
        try:
            if what == "plan":
                parts = reader.partitions()
            else:
                writer.commit([files.Written([str(f)]) for f in folders])
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        parts = parts if what == "plan" else reader.partitions()
        assert sorted(x[1] for p in parts for x in p.rows) == sorted(f"{root}/c/{i}.txt" for i in range(n))
        assert all(len(p.rows) <= 1000 for p in parts)
        return most

    assert (peak(12_000) - peak(4_000)) / 8000 < 100


def test_names_of_two_tasks_or_folders_clash(spark, tmp_path, monkeypatch):
    files.register(spark)
    monkeypatch.setattr(files, "FILES", 2)
    twice = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y"), ("a", "3", "z"), ("a", "1", "w")], "category string, name string, text string")
    for n in (1, 4):
        with pytest.raises(Exception, match="another's place|two texts are named"):
            twice.repartition(n).write.format("corpus").mode("append").save(str(tmp_path / str(n)))
        assert [x for _, _, names in os.walk(tmp_path / str(n)) for x in names] == []
    twice.where("text <> 'w'").coalesce(1).write.format("corpus").mode("append").save(str(tmp_path / "ok"))
    assert sorted(x.name for x in read(spark, str(tmp_path / "ok")).collect()) == ["1", "2", "3"]
