import gzip
import hashlib

from pyspark.sql import functions as F

from textlens.llm import queries, warc


def plain(rows):
    """(page_id, html) -> what the contract asks for."""
    least = {}
    for i, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            least[h] = min(i, least.get(h, i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        first = least.get(h)
        again = first is not None and i != first
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def test_all_pages(spark, sf):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert sorted((tuple(r) for r in queries.op3_warc(spark, sf).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str) == plain(rows)


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: %d\r\n\r\nfake\r\n\r\n"


def test_magic_in_payloads_small_ranges_and_edge_cases(spark, tmp_path):
    long = "é" * 3000
    rows = [(i, FAKE % n + "x" * i) for i, n in enumerate((4, 0, 10**12, 50, 4000))]
    rows += [(10, None), (11, ""), (12, "short"), (13, "short"), (20, long), (19, long), (19, long), (None, long), (None, "only nulls " * 20), (None, "only nulls " * 20), (30, "WARC/1.0\r\n" * 400), (31, "\r\n\r\n" * 50), (32, "a\x00b" * 40), (33, FAKE % 4 * 30)]
    pages = spark.createDataFrame([(i, "http://x/\r\nWARC-Type: y" if i else None, h) for i, h in rows], "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(2)
    got = warc.round_trip(pages).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows)
    path = f"file://{tmp_path}/small"
    warc.write_archives(pages.coalesce(1), path)
    for size in (64, 1000, 1 << 20):  # records longer than ranges, ranges without records
        got = warc.read_records(spark, path, size).collect()
        assert sorted((str(r.page_id), r.record_type) for r in got) == sorted((str(x[0]), x[3]) for x in plain(rows))
    empty = pages.limit(0)
    assert warc.round_trip(empty).count() == 0


def test_damaged_archive_gives_records_before_the_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>{i}</p>" * 20) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/a")
    file = next((tmp_path / "a").glob("part-*"))
    data = file.read_bytes()
    at = data.index(b"<urn:page:20>")
    cut = data.rindex(b"WARC/1.0", 0, at)
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "part-0.txt").write_bytes(data[:cut] + b"junk" + data[cut:])
    got = {r.page_id for r in warc.read_records(spark, f"file://{tmp_path}/b", 2000).collect()}
    assert got == set(range(20))
    assert [(r.path.rsplit("/", 1)[1], r["at"]) for r in warc.breaks(spark, f"file://{tmp_path}/b", 2000).collect()] == [("part-0.txt", cut)]
    assert warc.breaks(spark, f"file://{tmp_path}/a", 2000).collect() == []


def record(i, payload, version="1.0", extra=""):
    digest = hashlib.sha256(payload).hexdigest()
    return f"WARC/{version}\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\n{extra}WARC-Payload-Digest: sha256:{digest}\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload + b"\r\n\r\n"


def test_long_urls_and_line_ends_are_kept(spark, tmp_path):
    url = "data:text/plain," + "x" * 100_000 + "\r\nend"
    pages = spark.createDataFrame([(i, url if i % 3 == 0 else "u", f"<p>{i}</p>" * 20) for i in range(30)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(pages, f"file://{tmp_path}/a")
    text = next((tmp_path / "a").glob("part-*")).read_bytes().decode()
    assert text.count("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A") + "\r\n") == 10
    for size in (1000, 70_000, 1 << 20):
        assert sorted(r.page_id for r in warc.read_records(spark, f"file://{tmp_path}/a", size).collect()) == [*range(30)]


def test_gzip_members_and_both_versions(spark, tmp_path):
    """One member a record, one for all, and payloads that hold whole members of their own."""
    inner = gzip.compress(record(999, b"inner" * 50))
    payloads = {i: bytes(f"page {i} " * 40, "ascii") + (inner if i % 4 == 0 else b"") for i in range(40)}
    parts = [record(i, p, "1.1" if i % 2 else "1.0", "X: " + "y" * 70_000 + "\r\n" if i == 7 else "") for i, p in payloads.items()]
    (tmp_path / "each.warc.gz").write_bytes(b"".join(gzip.compress(p, i % 10) for i, p in enumerate(parts[:30])))
    (tmp_path / "all.warc.gz").write_bytes(gzip.compress(b"".join(parts[30:])))
    (tmp_path / "plain.warc").write_bytes(b"".join(record(100 + i, p, "1.1") for i, p in payloads.items()))
    for size in (1000, 1 << 20):
        got = {r.page_id: r for r in warc.read_records(spark, f"file://{tmp_path}", size).collect()}
        assert set(got) == {*payloads, *(100 + i for i in payloads)}
        for i, p in payloads.items():
            for r in (got[i], got[100 + i]):
                assert (r.payload_bytes, r.payload_digest, r.stated_digest) == (len(p), hashlib.sha256(p).hexdigest(), hashlib.sha256(p).hexdigest())
    data = (tmp_path / "each.warc.gz").read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc.gz").write_bytes(data[: len(data) // 2])
    some = [r.page_id for r in warc.read_records(spark, f"file://{tmp_path}/cut", 500).collect()]
    assert sorted(some) == [*range(len(some))] and 0 < len(some) < 30
    starts = [0]
    for i, p in enumerate(parts[:30]):
        starts.append(starts[-1] + len(gzip.compress(p, i % 10)))
    assert [r["at"] for r in warc.breaks(spark, f"file://{tmp_path}/cut", 500).collect()] == [max(x for x in starts if x <= len(data) // 2)]
    (tmp_path / "whole").mkdir()
    (tmp_path / "whole" / "a.warc.gz").write_bytes(data)
    assert warc.breaks(spark, f"file://{tmp_path}/whole", 500).collect() == []


def test_folded_headers_anywhere(spark, tmp_path):
    """Lines that go on, some longer than a block, in the middle of a file; values are joined by a space."""
    long = "X: a\r\n " + "b" * 70_000 + "\r\n\tc\r\n"
    parts = [record(i, f"page {i} ".encode() * 30, extra=("X: one\r\n  two\r\n\tthree\r\n", "", long)[i % 3]) for i in range(30)]
    (tmp_path / "f.warc").write_bytes(b"".join(parts))
    for size in (700, 1 << 20):
        assert sorted(r.page_id for r in warc.read_records(spark, f"file://{tmp_path}", size).collect()) == [*range(30)]
    fields, _, n = warc.parse_header(lambda: b"", parts[0])
    assert fields["x"] == "one two three" and parts[0][n:].startswith(b"page 0 ")
    assert warc.parse_header(lambda: b"", b"WARC/1.0\r\n folded\r\nContent-Length: 1\r\n\r\n") is None
