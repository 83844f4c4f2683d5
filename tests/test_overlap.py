import random

import numpy as np
import pytest
from textlens.operators import overlap
from textlens.profiles import LATIN


@pytest.mark.parametrize("sources", [40, 4000])
def test_rows_of_hits_are_real_ones_at_any_number_of_sources(spark, sources):
    """Passes and maps follow the sources: what comes out of the look-up is what the join keeps."""
    r = random.Random(sources)
    text = lambda k: "".join(r.choices("abcdefghij", k=k))
    have = [(i, text(200)) for i in range(sources)]
    stories = [(i, text(3000) + have[r.randrange(sources)][1][20:80]) for i in range(60)]
    s = spark.createDataFrame(stories, "doc_id long, text string").repartition(3)
    w = overlap.wanted_grams(spark.createDataFrame(have, "source_id long, text string").repartition(3), LATIN)
    parts = list(overlap.passes(w, 20_000))
    assert len(parts) == -(-sum(len(x.hashes) for x in parts) // 20_000)
    rows = sum(overlap.hits(s, x, LATIN).count() for x in parts)
    wanted = {x[i : i + 16] for _, x in have for i in range(0, len(x) - 16, 5)}
    found = sum(len({t[i : i + 16] for i in range(len(t) - 15)} & wanted) for _, t in stories)
    assert found > 0 and found <= rows <= 1.05 * found
    for x in parts:
        # the map lets few of the places through that it needn't
        h = np.random.default_rng(1).integers(0, 2**63, 100_000, dtype=np.uint64) * np.uint64(2)
        slot = h >> np.uint64(64 - x.bits)
        assert (x.found[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).mean() < 0.1


def test_passes_give_the_same_pairs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    one, many = (sorted(map(tuple, overlap.overlap(docs, items, LATIN, source_id="item_id", grams=g).collect())) for g in (1 << 22, 700))
    assert one == many and len(one) > 10


def test_no_source_has_no_pair(spark):
    s = spark.createDataFrame([(1, "some text that is long enough")], "doc_id long, text string")
    assert overlap.overlap(s, spark.createDataFrame([], "source_id long, text string"), LATIN).collect() == []
