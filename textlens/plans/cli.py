"""Command line: ``python -m textlens.plans.cli JOB ...``."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .. import lexicons
from ..functions import segment, text
from ..profiles import LATIN, ZH
from ..sources import corpus as files
from ..sources import sinks
from . import jobs


def parser() -> argparse.ArgumentParser:
    a = argparse.ArgumentParser(prog="textlens")
    a.add_argument("job", choices=["distil", "fuse", "stage", "check", "audit", "adjust"])
    a.add_argument("paths", nargs="*")
    a.add_argument("--corpus", default="corpus")
    a.add_argument("-c", "--category")
    a.add_argument("-n", "--sample", type=int, default=5)
    a.add_argument("-s", "--stage")
    a.add_argument("-t", "--keyword")
    a.add_argument("-p", "--params", default="{}")
    a.add_argument("-P", "--previous")
    a.add_argument("--prompts", default="prompt")
    a.add_argument("-o", "--output", default="output")
    a.add_argument("--genre")
    a.add_argument("--min-kb", type=float, default=0, help="with fuse: the least size of drawn files")
    a.add_argument("--max-kb", type=float, default=99999)
    a.add_argument("--excl", type=float, default=0.0)
    a.add_argument("--profile", choices=["zh", "latin"], default="zh")
    a.add_argument("--dictionary", help="a parquet table of term and freq")
    a.add_argument("--interactive", action="store_true", help="ask for parameters; blank answers are left out")
    return a


def parameters(given: str) -> tuple[dict[str, str], str | None]:
    """Values as text; a malformed object gives none and a warning."""
    try:
        got = json.loads(given)
    except ValueError as e:
        return {}, f"parameters can't be read: {e}"
    return ({str(k): v if isinstance(v, str) else json.dumps(v, ensure_ascii=False) for k, v in got.items()}, None) if isinstance(got, dict) else ({}, "parameters aren't an object")


def asked(stage: str | None = None, ask=input) -> dict[str, str]:
    """The answers to the stage's questions; for a stage without any, ``name=value`` lines until a blank one. Blank answers are left out."""
    if questions := lexicons.STAGE_QUESTIONS.get(stage or ""):
        answers = {name: ask(f"{name} ({hint}): ").strip() for name, hint in questions}
        return {k: v for k, v in answers.items() if v}
    out = {}
    while line := ask("name=value: ").strip():
        k, _, v = line.partition("=")
        if k.strip() and v.strip():
            out[k.strip()] = v.strip()
    return out


def main(argv: list[str] | None = None) -> int:
    a, unknown = parser().parse_known_args(argv)
    p = ZH if a.profile == "zh" else LATIN
    log = [("warn", f"ignored: {x}") for x in unknown]
    params, warning = parameters(a.params)
    if warning:
        log.append(("warn", warning))
    if a.interactive:
        params |= asked(a.stage)
    spark = SparkSession.builder.appName("textlens").getOrCreate()
    words = spark.read.parquet(a.dictionary) if a.dictionary else None
    o = jobs.Options(a.corpus, a.category, a.sample, a.stage, a.keyword, params, None)
    try:
        if a.previous:
            o.previous = files.story(spark, a.previous).first()["text"]
        if a.job in ("distil", "fuse", "stage"):
            tokens = jobs.fingerprint.latin_tokens if p is LATIN else segment.segmenter(words) if words is not None else segment.jieba_segmenter()
            context, picked = jobs.fuse(spark, o, a.paths, tokens, p, a.min_kb, a.max_kb) if a.job == "fuse" else (None if a.stage == "优化" else jobs.distil(spark, o, tokens, p), None)
            if a.job == "fuse":
                context.select(F.col("context").alias("value")).coalesce(1).write.mode("overwrite").text(f"{a.output}/fusion_context")
                if picked is not None:
                    print("\n".join([f"drawn from {a.category}:", *(f"  {r['path']}" for r in picked.select("path").collect())]))
            elif a.job == "distil":
                context.select(F.col("context").alias("value")).write.mode("overwrite").text(f"{a.output}/context")
                sinks.write_paths(jobs.drawn(spark, o, p), f"{a.output}/picked_sources")
                sinks.put_placeholder(f"{a.output}/story.txt")
            else:
                read = lambda path, glob: spark.read.option("pathGlobFilter", glob).text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), F.col("value"))
                prompts = jobs.stage_prompt(spark, o, read(a.prompts, "*.md").withColumnRenamed("value", "content"), read(a.output, "*.txt").select(F.url_decode("file").alias("file"), F.col("value").alias("text")), context)
                sinks.write_prompts(prompts, f"{a.output}/prompts")
        else:
            story = files.story(spark, a.paths[0] if a.paths else f"{a.output}/story.txt")
            name = a.paths[0] if a.paths else f"{a.output}/story.txt"
            if a.job == "check":
                head = {"letters": story.select(text.letter_count(F.col("text"), p)).first()[0], "genre": a.genre or "default"}
                print(sinks.write_report(jobs.check(story, p, a.genre, words), name, "check_report", head))
            elif a.job == "audit":
                sources = jobs.corpus.union_all(*[files.story(spark, x) for x in a.paths[1:]] or [story.limit(0)]).select(F.col("doc_id").alias("source_id"), "text")
                found, pairs = jobs.audit(story, sources, p)
                rows = pairs.select("doc_id", F.when(F.col("matches") > 0, "issue").otherwise("pass").alias("severity"), F.lit("overlap").alias("rule"), F.col("source_id").alias("term"), F.col("matches").cast("double").alias("value"))
                print(sinks.write_report(found.unionByName(rows), name, "audit"))
            else:
                sinks.write_rewritten(jobs.adjust(story, p, a.excl, words), f"{a.output}/adjusted", name)
    except (ValueError, FileNotFoundError, ImportError) as e:
        log.append(("error", str(e)))
    sinks.write_log(log, f"{a.output}/run.log")
    for level, message in log:
        print(f"{level}: {message}", file=sys.stderr)
    return int(any(level == "error" for level, _ in log))


if __name__ == "__main__":
    sys.exit(main())
