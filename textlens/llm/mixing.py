"""Mixing sources to target weights with a low-discrepancy schedule. DataFrame functions only.

Every document is a run of words in its source's shuffled order; a source is cut into blocks of ``block`` words.
A schedule of slots decides which source comes next: slot ``i`` stands at the golden-ratio point ``frac(i * phi)``,
which is looked up in the cumulative weights. The k-th slot of a source takes its k-th block, again from the first
when all are used. So any prefix of the schedule is mixed to the weights, and what a document gives is the part of it
that the taken blocks cover, times how often they are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, free_name, written

WEIGHTS = (5, 2, 1)
#: The golden ratio as a step in 2**40 points; odd, so that each point comes once in a period.
STEP, BITS = 679_528_507_925, 40
#: Cells of the look-up of sources for each source, and at least; slots of a plan at most, so that each has points of its own.
CELLS, LEAST_CELLS, MOST_SLOTS = 4, 4096, 1 << BITS


def word_count(text: Column) -> Column:
    """Number of words (maximal runs outside ASCII white space) of a text; null has none."""
    t = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(t == "", F.lit(0)).otherwise(F.size(F.split(t, SPACE_RE, -1))).cast("long")


def _point(i: Column) -> Column:
    """``i * STEP mod 2**BITS`` without overflow."""
    half, mask = 1 << (BITS // 2), (1 << BITS) - 1
    i = i.bitwiseAND(F.lit(mask))
    high, low = F.shiftright(i, BITS // 2), i.bitwiseAND(F.lit(half - 1))
    return ((high * STEP).bitwiseAND(F.lit(half - 1)) * half + low * STEP).bitwiseAND(F.lit(mask))


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> DataFrame:
    """``df`` with, for each name, the sum of its column over all rows before in ``order``.

    Rows are sorted by range, so no task holds all of them: sums inside a range, and one over the few ranges.
    """
    held = written(df.select("*", *[c.alias(f"{n}_of_row") for n, c in sums.items()]).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range_no", F.spark_partition_id()), name)
    ranges = held.groupBy("range_no").agg(*[F.sum(f"{n}_of_row").alias(f"{n}_of_range") for n in sums])
    before = Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    first = ranges.select("range_no", *[F.coalesce(F.sum(f"{n}_of_range").over(before), F.lit(0)).alias(f"{n}_first") for n in sums])
    inside = Window.partitionBy("range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = held.join(first, "range_no")
    return out.select(*df.columns, *[(F.col(f"{n}_first") + F.coalesce(F.sum(f"{n}_of_row").over(inside), F.lit(0))).alias(n) for n in sums])


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """``source, source_size`` -> also ``weight, target``: all words shared by weight, none above ``cap`` times its size.

    What is above the cap goes to the others by weight until none is above: sorted by ``cap * size / weight``, the
    capped sources are a prefix, so one running sum finds them.
    """
    source, size, weight = F.col("source"), F.col("source_size"), F.col("weight")
    placed = running(sizes, [source.asc_nulls_last()], {"place": F.lit(1).cast("long")}, "mix-order")
    weighed = placed.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("long")).drop("place")
    ranked = written(running(weighed, [(size / weight).asc(), source.asc_nulls_last()], {"before": size * cap, "weights": weight}, "mix-levels"), "mix-levelled")
    total, every = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total or 0) - F.col("before")).cast("double") / (F.lit(every or 0) - F.col("weights"))
    levelled = ranked.withColumn("level", level).withColumn("free", F.col("level") * weight <= size * cap)
    shared = levelled.where("free").agg(F.max(F.struct((-size / weight).alias("s"), "level")).alias("x")).first()["x"]
    found = F.lit(float(shared["level"]) if shared else 0.0) * weight
    return levelled.withColumn("target", F.when(F.col("free"), found).otherwise((size * cap).cast("double"))).drop("level", "free", "before", "weights")


def _place(p: Column, total_slots: int) -> Column:
    """``p * total_slots >> BITS``, exact: the point's halves are multiplied one by one, which stays below 2**63."""
    half = BITS // 2
    high, low = F.shiftright(p, half), p.bitwiseAND(F.lit((1 << half) - 1))
    return F.shiftright(high * F.lit(total_slots).cast("long") + F.shiftright(low * F.lit(total_slots).cast("long"), half), half)


def slot_sources(slots: DataFrame, plan: DataFrame, total_slots: int) -> DataFrame:
    """``slot, sid`` of given slots: the source whose interval has the slot's place.

    Sources lie in cells of equal width, several of them for each source, so that a slot meets few sources.
    """
    if total_slots > MOST_SLOTS:
        raise ValueError(f"a plan takes at most {MOST_SLOTS} slots")
    count = max(LEAST_CELLS, min(CELLS * plan.count(), 1 << 22))
    width = -(-total_slots // count)
    cell = lambda x: F.expr(f"{x} div {width}")
    cells = plan.where("high > low").select("sid", "low", "high", F.explode(F.sequence(cell("low"), cell("(high - 1)"))).alias("cell"))
    placed = slots.select("slot", _place(_point(F.col("slot")), total_slots).alias("at")).withColumn("cell", cell("at"))
    return placed.join(cells, "cell").where("at >= low and at < high").select("slot", "sid")


def schedule(plan: DataFrame, total_slots: int) -> DataFrame:
    """Slots ``slot, sid, rank``: the source of each slot and its rank among the source's slots, from 0.

    ``plan`` has ``sid, low, high``: the source's interval of ``[0, total_slots)``.
    """
    slots = plan.sparkSession.range(total_slots).select(F.col("id").alias("slot"))
    found = slot_sources(slots, plan, total_slots).withColumn("run", F.shiftright("slot", 14))
    runs = found.groupBy("sid", "run").agg(F.count("*").alias("n"))
    first = runs.select("sid", "run", (F.sum("n").over(Window.partitionBy("sid").orderBy("run")) - F.col("n")).alias("first"))
    within = found.withColumn("k", F.row_number().over(Window.partitionBy("sid", "run").orderBy("slot")) - 1)
    return within.join(first, ["sid", "run"]).select("slot", "sid", (F.col("first") + F.col("k")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, cap: int = 3, block: int = 64, seed: str = "mix", row_col: str | None = None) -> DataFrame:
    """What the mix takes of each row: ``row, doc_id, source, size, source_size, target, taken, first_word``.

    ``taken`` counts words with repeats; it is ``epochs`` times the size plus the words of a last, partial pass, which
    are the document's first ``taken % size`` ones. Rows with null ids, sources or texts take part: a null source is a
    source of its own (the last), a null text has no words, takes nothing. Repeated rows are rows of their own. An
    empty table gives an empty result; if no document has a word all targets are 0. ``row`` numbers the rows of this
    run (or is ``row_col``); other columns are not looked at. Reruns on the same rows agree, however the files are cut: the
    shuffle is by a hash of id and seed, then of the text; only rows with equal ids and texts are told apart by their place.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    base = docs.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(text_col).alias("tie"))
    base = written(base.withColumn("key", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), "mix-rows")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    k = (F.floor(F.col("target") / F.col("source_size")) * F.ceil(F.col("source_size") / block) + F.round((F.col("target") % F.col("source_size")) / block)).cast("long")
    of_source = targets(sizes, weights, cap).withColumn("slots", F.when(F.col("source_size") > 0, k).otherwise(F.lit(0)).cast("long"))
    of_source = running(of_source, [F.col("source").asc_nulls_last()], {"sid": F.lit(1).cast("long"), "low": F.col("slots")}, "mix-slots")
    of_source = written(of_source.withColumn("high", F.col("low") + F.col("slots")).withColumn("nb", F.ceil(F.col("source_size") / block)), "mix-sources")
    totals = of_source.agg(F.sum("slots"), F.sum("rows")).first()
    total_slots, rows = int(totals[0] or 0), int(totals[1] or 0)
    slots = schedule(of_source, max(total_slots, 1))
    blocks = slots.join(of_source.select("sid", "nb"), "sid").where(F.col("rank") < F.col("nb") * cap).groupBy("sid", (F.col("rank") % F.col("nb")).alias("b")).agg(F.count("*").alias("times"))
    # places in the shuffled order: a running sum inside buckets of the hash, and one over the buckets
    buckets = max(1, int(rows**0.5))
    placed = base.join(of_source.select(F.col("source").alias("s"), "sid", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumn("bucket", F.pmod("key", F.lit(buckets)))
    held = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    first = held.select("sid", "bucket", (F.sum("n").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("n")).alias("first"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(first, ["sid", "bucket"]).withColumn("stop", F.col("first") + F.col("upto")).withColumn("start", F.col("stop") - F.col("size"))
    parts = placed.where("size > 0").select("row", "sid", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).alias("b"))
    overlap = F.least(F.col("stop"), (F.col("b") + 1) * block) - F.greatest(F.col("start"), F.col("b") * block)
    taken = parts.join(blocks, ["sid", "b"]).groupBy("row").agg(F.sum(overlap * F.col("times")).alias("taken"))
    out = placed.select("row", "doc_id", "source", "size", "source_size", "target").join(taken, "row", "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word, as it stands."""
    return F.array_join(F.slice(F.split(text, "(?<=[^\\x20\\x09-\\x0D])(?=[\\x20\\x09-\\x0D])", -1), F.lit(1), n), "")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed table: each row as often as whole passes take it, and once more up to the end of the last word taken where a last pass takes a part.

    Columns are those of ``docs``, whatever their names. A part is a prefix of the text; ``n_chars``, where there is one,
    follows it. Rows of which nothing is taken go.
    """
    row, size, taken, each_pass = (free_name(docs.columns, n) for n in ("mix_row", "mix_size", "mix_taken", "mix_pass"))
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-docs")
    took = mix(kept, id_col, text_col, source_col, row_col=row, **options).select(F.col("row").alias(row), F.col("size").alias(size), F.col("taken").alias(taken)).where(F.col(taken) > 0)
    rest = F.col(taken) % F.col(size)
    passes = F.concat(F.array_repeat(F.lit(-1).cast("long"), F.floor(F.col(taken) / F.col(size)).cast("int")), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    each = kept.join(took, row).withColumn(each_pass, F.explode(passes))
    out = each.withColumn(text_col, F.when(F.col(each_pass) < 0, F.col(text_col)).otherwise(first_words(F.col(text_col), F.col(each_pass).cast("int"))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(each_pass) < 0, F.col("n_chars")).otherwise(F.length(text_col).cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)
