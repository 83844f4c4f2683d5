"""Sections of template files, chained stage outputs and assembled prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import lexicons
from ..functions import text as X
from ..functions.arrow import free_name

PREVIOUS, CONTEXT = 2000, 3000
#: Candidate files of a stage's output, in the order in which they are looked for.
OUTPUTS = ("{}_output.txt", "{}_result.txt", "story_{}.txt")


def stages(spark: SparkSession) -> DataFrame:
    """``idx, stage, file, section``."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(lexicons.STAGES)], "idx int, stage string, file string, section string")


def stage_index(stage: str) -> int:
    """The stage's place; an unknown stage is an error."""
    names = [s for s, _, _ in lexicons.STAGES]
    if stage not in names:
        raise ValueError(f"unknown stage {stage!r}; known: {', '.join(names)}")
    return names.index(stage)


def section(content: Column, name: Column) -> Column:
    """``struct(found, body)``: what stands between the section's marker and the next; the whole content if it has no such marker."""
    head = F.concat(F.lit(r"(?s)<!-- FILE_SECTION:\s*"), X.escaped(name), F.lit(r"\s*-->"))
    found = F.regexp_like(content, head)
    body = X.strip(F.get(F.regexp_extract_all(content, F.concat(head, F.lit(r"(.*?)(?=<!-- FILE_SECTION:|\z)")), F.lit(1)), 0))
    return F.struct(found.alias("found"), F.when(found, body).otherwise(content).alias("body"))


def first_template(found: Column, body: Column) -> Column:
    """Without keyword: past the section's own header, the first part between rules of ``---``."""
    at = F.instr(body, "\n---\n")
    past = F.when(found & (at > 0), X.strip(F.substr(body, at + 5))).otherwise(body)
    return X.strip(F.split(past, "---", 2)[0])


def keyword_template(found: Column, body: Column, keyword: Column) -> Column:
    """The first part with the keyword; the first template if there is none, or no keyword."""
    part = F.get(F.filter(F.split(body, "---", -1), lambda x: F.contains(x, keyword)), 0)
    return F.when(F.coalesce(keyword, F.lit("")) == "", first_template(found, body)).otherwise(F.coalesce(X.strip(part), first_template(found, body)))


def load_templates(stage_rows: DataFrame, files: DataFrame, keyword: str | None = None) -> DataFrame:
    """``idx, stage, template`` of stages whose file (``file, content``) exists."""
    rows = stage_rows.join(files, "file").withColumn("_s", section(F.col("content"), F.col("section")))
    return rows.select("idx", "stage", keyword_template(F.col("_s")["found"], F.col("_s")["body"], F.lit(keyword or "")).alias("template"))


def previous_outputs(stage_rows: DataFrame, outputs: DataFrame) -> DataFrame:
    """``idx, stage, previous``: the output of the stage before, the first that exists of its candidate files.

    ``outputs`` has ``file, text``.
    """
    before = stage_rows.select((F.col("idx") + 1).alias("idx"), F.col("stage").alias("b"))
    names = before.select("idx", F.posexplode(F.array(*[F.concat(*[x for piece in o.split("{}") for x in (F.lit(piece), F.col("b"))][:-1]) for o in OUTPUTS])).alias("prio", "file"))
    best = names.join(outputs, "file").groupBy("idx").agg(F.min_by("text", "prio").alias("previous"))
    return stage_rows.select("idx", "stage").join(best, "idx", "left")


def previous_turn(turns: DataFrame, by: str = "conv_id", order: str = "turn", text_col: str = "text") -> DataFrame:
    """Each turn with ``previous``, the text of the one before, cut to what a prompt takes; a column of that name is an error."""
    if "previous" in turns.columns:
        raise ValueError("the turns have a column previous already")
    w = Window.partitionBy(by).orderBy(order)
    return turns.withColumn("previous", F.left(F.lag(text_col).over(w), F.lit(PREVIOUS)))


def chained(turns: DataFrame, roles: list[str], by: str = "conv_id", order: str = "turn", role_col: str = "role", text_col: str = "text", chunk: int = 1000) -> DataFrame:
    """Each turn with ``previous`` (or that with underscores in front): the latest earlier text that isn't empty, of the first of ``roles`` that has one.

    Turns (whole numbers) go in chunks of ``chunk``: each is walked by itself, and carries on the latest text of each role from
    the chunks before; so a long conversation is many tasks' work, and what is carried is a text a role. Earlier is a smaller
    turn; of equal turns of a role the last text in order counts. Null turns and roles are before nothing; null keys are one
    conversation.
    """
    name = free_name(turns.columns, "previous")
    part, row = free_name(turns.columns, "chunk"), free_name(turns.columns, "latest")
    said = lambda r: F.when((F.col(role_col) == r) & (F.col(text_col) != "") & F.col(order).isNotNull(), F.struct(F.col(order).alias("o"), F.col(text_col).alias("t")))
    cut = turns.withColumn(part, F.floor(F.col(order) / chunk))
    here = Window.partitionBy(by, part).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    walked = cut.withColumn(row, F.array(*[F.max(said(r)).over(here) for r in roles]))
    ends = cut.where(F.col(part).isNotNull()).groupBy(F.col(by).alias(f"{row}_by"), F.col(part).alias(f"{row}_part")).agg(*[F.max(said(r)).alias(f"{row}_{i}") for i, r in enumerate(roles)])
    before = Window.partitionBy(f"{row}_by").orderBy(f"{row}_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(f"{row}_by", f"{row}_part", F.array(*[F.max(f"{row}_{i}").over(before) for i in range(len(roles))]).alias(f"{row}_carried"))
    both = walked.join(carried, F.col(by).eqNullSafe(F.col(f"{row}_by")) & (F.col(part) == F.col(f"{row}_part")), "left")
    best = F.coalesce(*[x for i in range(len(roles)) for x in (F.get(row, F.lit(i)), F.get(f"{row}_carried", F.lit(i)))])
    return both.withColumn(name, F.left(F.when(F.col(order).isNotNull(), best["t"]), F.lit(PREVIOUS))).select(*turns.columns, name)


def prompt(template: Column, previous: Column, context: Column, params: Column, stage: Column | None = None, role: str = "You are an experienced editor.") -> Column:
    """One text of role, template, previous output, context (not for the polishing stage) and parameters; missing parts are left out."""
    shows = (F.coalesce(context, F.lit("")) != "") & (F.lit(True) if stage is None else ~stage.eqNullSafe(F.lit("优化")))
    bullets = F.transform(F.map_entries(params), lambda e: F.concat(F.lit("- "), e["key"], F.lit(": "), e["value"]))
    return F.concat_ws(
        "\n",
        F.lit(f"{role}\n"), template, F.lit(""),
        F.when(F.coalesce(previous, F.lit("")) != "", F.concat(F.lit("\n---\n## Previous output\n\n"), F.left(previous, F.lit(PREVIOUS)), F.lit("\n"))),
        F.when(shows, F.concat(F.lit("\n---\n## Context\n\n"), F.left(context, F.lit(CONTEXT)))),
        F.lit("\n---\n## Parameters\n"),
        F.when(F.coalesce(F.size(params), F.lit(0)) > 0, F.array_join(bullets, "\n")).otherwise("- defaults"),
    )
