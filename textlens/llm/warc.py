"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Reading is split into byte ranges, so a task can't know whether the magic it finds starts a record or lies in a
payload. Tasks therefore emit every candidate with its successor, the offset at which the next record has to start if
this one is real. From the first byte of each file the successors form the one true chain; pointer jumping (doubling
the step each round) finds what it reaches. Tasks follow chains inside their range at once, so jumps go from range to
range and the rounds are the logarithm of a file's ranges. Magic in payloads is never reached.

In ``.gz`` archives the links of the chain are gzip members: a candidate is what decompresses to its checksum and starts
with a record, its successor the byte after. A member may hold one record or many.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import filesystem, shared_dir, written

MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
GZIP = b"\x1f\x8b\x08"
#: Bytes of a task's range, of a block that is read, and of the longest header: beyond, a record is an error.
RANGE, BLOCK, HEADER = 4 << 20, 1 << 16, 64 << 20
LEAST_REVISIT = 100
RECORDS = "page_id bigint, record_type string, refers_to bigint, stated_digest string, payload_bytes bigint, payload_digest string"
#: Where a chain broke, beside the columns of records.
BREAK = "broken_path string, broken_at bigint"


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null; line ends in values are written as in URLs."""
    bare = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), bare, F.lit("\r\n")), F.lit(""))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2000-01-01T00:00:00Z") -> None:
    """Write a record per row, in files that Spark's text writer commits.

    Among rows with equal payloads of at least 100 bytes, those with the smallest id are responses and the others
    revisits that refer to it, without payload. Null payloads are empty; of repeated rows with the smallest id each is
    a response; a null id is larger than any other (if all are null, all are responses). No row gives no record.
    """
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest"), F.octet_length(html).cast("long").alias("n"))
    first = rows.where(F.col("n") >= LEAST_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("copies")).where("copies > 1 and first is not null").select("digest", "first")
    rows = rows.join(written(first, "warc-first"), "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.when(revisit, F.lit("")).otherwise(F.col("html"))
    head = F.concat(
        F.lit("WARC/1.0\r\n"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(F.col("id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        _line("WARC-Refers-To", F.when(revisit, urn(F.col("first")))),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        _line("Content-Length", F.octet_length(body)),
        F.lit("\r\n"),
    )
    rows.select(F.concat(head, body).alias("record")).write.option("lineSep", "\r\n\r\n").text(path)


def parse_header(more: Callable[[], bytes], data: bytes = b"") -> tuple[dict[str, str], bytes, int] | None:
    """The fields of a record header, what was read beyond it, and its length with the blank line; None if it isn't one.

    ``more`` gives the next bytes, so headers may be longer than a block; what is no header is left at its first odd line.
    A line that begins with white space goes on with the field before it.
    """
    seen = 0  # up to where lines are known to be fields
    while True:
        end = data.find(b"\r\n\r\n", max(0, seen - 4))
        whole = data[seen : end + 2] if end >= 0 else data[seen : data.rfind(b"\r\n") + 2] if b"\r\n" in data[seen:] else b""
        if not seen and (whole or len(data) >= 10) and not MAGIC.match(data):
            return None
        lines = whole.split(b"\r\n")[int(not seen) : -1]
        if any(b":" not in line and line[:1] not in (b" ", b"\t") for line in lines) or (not seen and lines and lines[0][:1] in (b" ", b"\t")):
            return None
        if end >= 0:
            break
        seen += len(whole)
        block = more()
        if not block:
            return None
        data += block
        if len(data) > HEADER:
            raise ValueError(f"a header of more than {HEADER} bytes")
    pairs = (line.partition(b":") for line in re.sub(rb"\r\n[ \t]+", b" ", data[:end]).split(b"\r\n")[1:])
    fields = {name.strip().lower().decode("ascii", "replace"): value.strip().decode("utf-8", "replace") for name, _, value in pairs}
    size = fields.get("content-length", "")
    return (fields, data[end + 4 :], end + 4) if size.isascii() and size.isdigit() else None


def _reader(f, at: int) -> Callable[[], bytes]:
    """Blocks of a file from a place."""
    place = at

    def more() -> bytes:
        nonlocal place
        f.seek(place)
        block = f.read(BLOCK)
        place += len(block)
        return block

    return more


class _Member:
    """A gzip member as it is decompressed: ``read`` gives its bytes block by block, ``stop`` is the byte after it once they are all read."""

    def __init__(self, f, at: int):
        self.f, self.place, self.z, self.stop, self.rest = f, at, zlib.decompressobj(31), None, b""

    def read(self) -> bytes:
        while self.stop is None:
            if not self.rest:
                self.f.seek(self.place)
                self.rest = self.f.read(BLOCK)
                self.place += len(self.rest)
                if not self.rest:
                    raise zlib.error("the member is cut off")
            out = self.z.decompress(self.rest, 1 << 20)
            self.rest = self.z.unconsumed_tail
            if self.z.eof:
                self.stop = self.place - len(self.z.unused_data)
            if out:
                return out
        return b""


def _successor(f, at: int, packed: bool) -> int | None:
    """Where the next record (or member) has to start if there is one here."""
    if packed:
        member, head = _Member(f, at), b""
        try:
            while block := member.read():
                head = (head + block)[:10]
            return member.stop if MAGIC.match(head) else None
        except zlib.error:
            return None
    try:
        found = parse_header(_reader(f, at))
    except ValueError:  # not one that a reader would take, unless the chain comes here
        return None
    return at + found[2] + int(found[0]["content-length"]) + 4 if found else None


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each range: candidates, their successors, and where the chain from each leaves the range (null if it breaks)."""
    for batch in batches:
        for path, fid, start, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "fid", "start", "stop")), strict=True):
            fs, p = filesystem(path)
            packed = path.endswith(".gz")
            with fs.open_input_file(p) as f:
                f.seek(start)
                data = f.read(stop - start + 10)
                own = stop - start
                succ: dict[int, int] = {}
                for m in re.finditer(re.escape(GZIP) if packed else MAGIC, data):
                    if m.start() < own and (to := _successor(f, start + m.start(), packed)) is not None:
                        succ[start + m.start()] = to
            leaves: dict[int, int | None] = {}
            for o in sorted(succ, reverse=True):
                leaves[o] = succ[o] if succ[o] >= stop else leaves.get(succ[o])
            if succ:
                yield pa.RecordBatch.from_arrays([pa.array([fid] * len(succ)), pa.array([*succ]), pa.array([*succ.values()]), pa.array([leaves[o] for o in succ], pa.int64())], names=["fid", "at", "successor", "leaves"])


def reached(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``fid, at``: the offsets at which the chain from the start of each file enters a range, by pointer jumping."""
    jumps = candidates.where("leaves is not null").select("fid", "at", F.col("leaves").alias("to"))
    # only starts of files and places that some chain goes to can lie on a chain between ranges
    enter = jumps.select("fid", F.col("to").alias("at")).unionByName(files.select("fid", F.lit(0).cast("long").alias("at"))).distinct()
    jumps = written(jumps.join(enter, ["fid", "at"], "left_semi"), "warc-jumps")
    found = written(files.where("length > 0").select("fid", F.lit(0).cast("long").alias("at")), "warc-reached")
    for _ in range(64):
        if jumps.isEmpty():
            return found
        found = written(found.unionByName(found.join(jumps, ["fid", "at"]).select("fid", F.col("to").alias("at"))).distinct(), "warc-reached")
        then = jumps.select("fid", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(then, ["fid", "to"]).select("fid", "at", F.col("then").alias("to")), "warc-jumps")
    return found


def _record(fields: dict[str, str], block: bytes, more: Callable[[], bytes]) -> tuple[tuple | None, bytes]:
    """The row of a record whose header was read (None if its payload is cut off), and what was read beyond its end."""
    number = lambda urn: int(urn[10:-1]) if re.fullmatch("<urn:page:-?[0-9]+>", urn or "") else None
    size = left = int(fields["content-length"])
    digest = hashlib.sha256()
    while left and (block or (block := more())):
        digest.update(block[:left])
        left, block = left - min(left, len(block)), block[left:]
    row = (number(fields.get("warc-record-id")), fields.get("warc-type"), number(fields.get("warc-refers-to")), fields.get("warc-payload-digest", "").removeprefix("sha256:"), size - left, digest.hexdigest())
    while len(block) < 4 and (then := more()):
        block += then
    return None if left else row, block[4:]


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walk the verified chain inside each range, reading payloads in blocks; a row of its own says where it breaks."""
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in f"{RECORDS}, {BREAK}".split(", "))])
    for batch in batches:
        for path, at, stop in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "stop")), strict=True):
            rows, whole = [], True
            fs, p = filesystem(path)
            with fs.open_input_file(p) as f:
                if path.endswith(".gz"):
                    while whole and at < stop:
                        member, rest, n = _Member(f, at), b"", 0
                        try:
                            while found := parse_header(member.read, rest):
                                row, rest = _record(found[0], found[1], member.read)
                                if row is None:
                                    whole = False
                                    break
                                rows.append((*row, None, None))
                                n += 1
                            while member.read():  # what is no record
                                pass
                        except zlib.error:
                            whole = False
                        if whole and n:
                            at = member.stop
                        else:
                            whole = False
                else:
                    more, rest = _reader(f, at), b""
                    while whole and at < stop:
                        found = parse_header(more, rest)
                        row, rest = _record(found[0], found[1], more) if found else (None, b"")
                        if row is None:
                            whole = False
                        else:
                            rows.append((*row, None, None))
                            at += found[2] + int(found[0]["content-length"]) + 4
            if not whole:
                rows.append((*[None] * 6, path, at))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def read_all(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The rows of ``read_records``, and for each file whose chain breaks before its end one of nulls with ``broken_path, broken_at``."""
    files = spark.read.format("binaryFile").load(path).select("path", F.xxhash64("path").alias("fid"), "length")
    files = written(files, "warc-files")
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = files.where("length > 0").select("path", "fid", F.explode(starts).alias("start"), F.col("length")).withColumn("stop", F.least(F.col("start") + range_bytes, F.col("length")))
    tasks = max(1, int(ranges.count()))
    found = written(ranges.repartition(tasks, "fid", "start").mapInArrow(_candidates, "fid bigint, at bigint, successor bigint, leaves bigint"), "warc-candidates")
    enter = reached(found, files)
    walk = enter.join(files, "fid").where("at < length").withColumn("stop", F.least((F.floor(F.col("at") / range_bytes) + 1) * range_bytes, F.col("length")))
    return walk.select("path", "at", "stop").repartition(tasks, "path", "at").mapInArrow(_records, f"{RECORDS}, {BREAK}")


def read_records(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The records of all archives in a folder: page id, type, what it refers to, stated digest, and size and digest of the payload as read.

    Versions 1.0 and 1.1; files that end in ``.gz`` are gzip members, one or many. Bytes that the chain from a file's start
    doesn't reach are no record, whatever they look like; a damaged file gives its records up to the damage, and
    ``breaks`` says where that is. Headers may have folded lines and any length up to ``HEADER``; a longer one on the chain
    is an error, not a loss. An empty folder gives no row.
    """
    return read_all(spark, path, range_bytes).where("broken_at is null").drop("broken_path", "broken_at")


def breaks(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """``path, at``: the files whose records don't lead to their end, and the first byte that no record explains."""
    return read_all(spark, path, range_bytes).where("broken_at is not null").select(F.col("broken_path").alias("path"), F.col("broken_at").alias("at"))


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and resolve revisits to the payloads they refer to.

    Gives ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row. Null payloads are empty, null
    ids and URLs are left out of the record; repeated rows are records of their own; a payload is never held whole, however
    long; an empty table gives no row; other columns are not looked at. An archive that doesn't read to its end is an error.
    """
    spark = pages.sparkSession
    path = shared_dir(spark, "warc")
    write_archives(pages, path, **columns)
    records = written(read_all(spark, path), "warc-records")
    broken = records.where("broken_at is not null").select("broken_path", "broken_at").limit(3).collect()
    if broken:
        raise ValueError(f"archives that end too early: {[tuple(r) for r in broken]}")
    plain = records.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to"))
    meant = plain.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    again = records.where("record_type = 'revisit'").select("page_id", "refers_to", F.col("stated_digest").alias("payload_digest"), "record_type").join(meant, ["refers_to", "payload_digest"], "left")
    return plain.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
