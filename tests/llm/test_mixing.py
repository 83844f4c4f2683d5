import re
from fractions import Fraction
from itertools import accumulate

import pytest
import xxhash
from pyspark.sql import functions as F

from textlens.llm import mixing, queries


def fair(sizes, weights=(5, 2, 1), cap=3):
    """By rounds: share by weight, stop at the cap, share the excess again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, done = sum(sizes.values()), {}
    while len(done) < len(order):
        free = [s for s in order if s not in done]
        level = (total - sum(done.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return done | {s: level * w[s] for s in free}
        done |= {s: float(cap * sizes[s]) for s in over}
    return done


def plain(rows, block=64, cap=3):
    """``rows``: (id, size, source, text) -> taken, by walking the schedule slot by slot over shuffled words."""
    sizes = {}
    for _, n, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + n
    want = fair(sizes)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    slots = {s: int(want[s] // sizes[s]) * -(-sizes[s] // block) + int(want[s] % sizes[s] / block + 0.5) if sizes[s] else 0 for s in order}
    total, high = sum(slots.values()), dict(zip(order, accumulate(slots[s] for s in order), strict=True))
    rank, times = dict.fromkeys(order, 0), {s: [0] * -(-sizes[s] // block) for s in order}
    for i in range(total):
        at = int(Fraction(i * mixing.STEP % 2**40, 2**40) * total)
        s = next(x for x in order if at < high[x])
        if rank[s] < len(times[s]) * cap:
            times[s][rank[s] % len(times[s])] += 1
        rank[s] += 1

    def key(r):
        h = xxhash.xxh64_intdigest(str(r[0] if r[0] is not None else "").encode(), xxhash.xxh64_intdigest(b"mix", 42))
        tie = xxhash.xxh64_intdigest(r[3].encode(), 42) if r[3] is not None else 42
        return tuple(x - (1 << 64) if x >> 63 else x for x in (h, tie))

    out, at = {}, dict.fromkeys(order, 0)
    buckets = max(1, int(len(rows) ** 0.5))
    for k in sorted(range(len(rows)), key=lambda k: (key(rows[k])[0] % buckets, key(rows[k]))):
        _, n, s, _ = rows[k]
        out[k] = sum(times[s][w // block] for w in range(at[s], at[s] + n))
        at[s] += n
    return [out[k] for k in range(len(rows))]


def test_taken_words_by_a_walk_of_the_schedule(spark, sf):
    got = {r.doc_id: (r["size"], r.taken) for r in queries.op10_source_mix(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source", "text").collect()
    rows = [(d.doc_id, got[d.doc_id][0], d.source, d.text) for d in docs]
    assert [got[d.doc_id][1] for d in docs] == plain(rows)


@pytest.mark.parametrize("name", ["_taken", "_size", "_pass", "mix_row", "MIX_ROW", "mix_taken", "Mix_Pass", "taken", "row", "tie", "key", "size", "bucket", "sid", "n_bytes", "Stop"])
def test_columns_of_any_name_pass_and_parts_are_prefixes(spark, name):
    texts = {i: f" a{i}\n\tb  c\n" * (i % 7 + 1) for i in range(60)}
    docs = spark.createDataFrame([(i, t, f"s{i % 3}", -i) for i, t in texts.items()], f"doc_id long, text string, source string, `{name}` long")
    out = mixing.mixed_documents(docs, block=5)
    assert out.columns == docs.columns
    rows = out.collect()
    assert rows and all(texts[r.doc_id].startswith(r.text) and r[name] == -r.doc_id for r in rows)
    assert any(r.text != texts[r.doc_id] for r in rows)


def test_contract_on_all_documents(spark, sf):
    out = queries.op10_source_mix(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in out) == sorted(docs)
    sizes, taken = {}, {}
    for r in out:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text)) and r.source == docs[r.doc_id].source
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = fair(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 64 * 5
    again = {r.doc_id: r.taken for r in queries.op10_source_mix(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_edge_cases(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b", None), (2, None, "y"), (3, "", "x"), (4, "w " * 5000, "z"), (5, "v " * 400, "X")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit(0)).withColumn("taken", F.lit("clash"))
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    got = {r.source: r for r in out}
    want = fair({"x": 6, None: 2, "y": 0, "z": 5000, "X": 400})
    for s, r in got.items():
        assert r.target == pytest.approx(want[s]), s
    assert all(0 <= r.taken <= 3 * r["size"] for r in out)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("size = 0 and doc_id in (2, 3)")).collect()} == {0}
    assert sorted(t for (t,) in mixing.mixed_documents(docs.where("doc_id = 1")).select("text").collect()) == ["a b c"] * 2


def test_prefixes_of_the_schedule_are_mixed(spark):
    plan = spark.createDataFrame([(1, 0, 500), (2, 500, 800), (3, 800, 1000)], "sid int, low long, high long")
    slots = sorted(tuple(r) for r in mixing.schedule(plan, 1000).collect())
    assert [s[0] for s in slots] == list(range(1000))
    seen = {1: 0, 2: 0, 3: 0}
    for i, sid, rank in slots:
        assert rank == seen[sid]
        seen[sid] += 1
        for s, share in ((1, 0.5), (2, 0.3), (3, 0.2)):
            assert abs(seen[s] - share * (i + 1)) < 4


def test_mixed_documents_take_what_the_mix_says(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {r[0]: r[1] for r in mixed.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text")))).collect()}
    want = {r.doc_id: r.taken for r in mixing.mix(docs).where("taken > 0").collect()}
    assert got == want


def test_narrow_sources_of_a_long_plan_get_their_slots(spark):
    """Of 2**33 and 2**38 slots those that can fall to some narrow sources, found by turning the points back."""
    back = pow(mixing.STEP, -1, 2**40)
    for total, widths in ((2**33, (1, 2, 3, 7, 100)), (2**38 - 12345, (1, 2, 3, 7, 100))):
        low, plan, slots = total // 3, [], []
        for sid, width in enumerate(widths):
            plan.append((sid, low, low + width))
            points = range(-(-low * 2**40 // total), -(-(low + width) * 2**40 // total))
            slots += [i for i in (p * back % 2**40 for p in points) if i < total]
            low += width + 1000
        rest = [(9, 0, plan[0][1]), (10, low, total)]
        df = spark.createDataFrame([(i,) for i in {*slots, *range(500)}], "slot long")
        got = {}
        for r in mixing.slot_sources(df, spark.createDataFrame([*plan, *rest], "sid int, low long, high long"), total).collect():
            at = int(Fraction(r.slot * mixing.STEP % 2**40, 2**40) * total)
            assert any(s == r.sid and a <= at < z for s, a, z in [*plan, *rest])
            got[r.sid] = got.get(r.sid, 0) + 1
        for sid, width in enumerate(widths):
            assert abs(got.get(sid, 0) - width) <= 4, (total, sid)


def test_a_plan_beyond_the_points_is_refused(spark):
    plan = spark.createDataFrame([(1, 0, 5)], "sid int, low long, high long")
    with pytest.raises(ValueError, match="at most"):
        mixing.schedule(plan, 2**40 + 1)
