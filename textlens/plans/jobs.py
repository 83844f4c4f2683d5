"""Whole jobs: distil a category, assemble a stage's prompt, audit and adjust stories."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus, fingerprint, names, overlap, rewrite, rules, templates
from ..profiles import ZH, LanguageProfile
from ..sources import corpus as files


@dataclass
class Options:
    corpus: str = "corpus"
    category: str | None = None
    sample: int = 5
    stage: str | None = None
    keyword: str | None = None
    params: dict[str, str] = field(default_factory=dict)
    previous: str | None = None
    seed: int = 42


def drawn(spark: SparkSession, o: Options, p: LanguageProfile = ZH) -> DataFrame:
    """The sampled healthy documents; an error if they are too few."""
    docs = files.scan(spark, o.corpus, o.category)
    return corpus.require(corpus.sample(corpus.healthy(docs, p), o.sample, o.seed, None))


def distil(spark: SparkSession, o: Options, tokens, p: LanguageProfile = ZH) -> DataFrame:
    """``context``: the fingerprints of the sampled documents rendered as one text."""
    return _context(drawn(spark, o, p), tokens, p, False)


def fuse(spark: SparkSession, o: Options, paths: list[str], tokens, p: LanguageProfile = ZH, least_kb: float = 0, most_kb: float = 99999) -> tuple[DataFrame, DataFrame]:
    """The given files together with files of the category drawn by size, as a context with rules; and the drawn files. At least three are needed."""
    # as given, in their order, before the drawn ones
    given = [files.story(spark, path).select(F.lit(i).alias("order"), F.lit(path).alias("path"), "text") for i, path in enumerate(paths)]
    picked = files.pick(spark, o.corpus, o.category, o.sample, least_kb, most_kb, o.seed) if o.category else None
    rows = [*given, *([picked.select(F.lit(len(paths)).alias("order"), "path", "text")] if picked is not None else [])]
    if not rows:
        raise ValueError(f"at least {corpus.LEAST_DOCS} documents are needed, found 0")
    docs = corpus.require(corpus.union_all(*rows)).withColumn("doc_id", F.struct("order", "path"))
    return _context(docs, tokens, p, True), picked


def _context(docs: DataFrame, tokens, p: LanguageProfile, rules_too: bool) -> DataFrame:
    named = docs.withColumn("doc_id", F.struct("doc_id", X.basename(F.col("path")).alias("name")))
    prints = fingerprint.fingerprint(named, p, tokens, whole=False).withColumn("name", F.col("doc_id.name"))
    return fingerprint.context(prints, p.context, p.lists if rules_too else None)


def stage_prompt(spark: SparkSession, o: Options, template_files: DataFrame, outputs: DataFrame, context: DataFrame | None) -> DataFrame:
    """``stage, prompt`` of the asked stage. The polishing stage takes no context."""
    stage_i = templates.stage_index(o.stage)
    all_stages = templates.stages(spark)
    one = templates.load_templates(all_stages.where(F.col("idx") == stage_i), template_files, o.keyword)
    before = templates.previous_outputs(all_stages, outputs).where(F.col("idx") == stage_i).select("idx", "previous")
    rows = one.join(before, "idx", "left")
    if o.previous is not None:
        rows = rows.withColumn("previous", F.lit(o.previous))
    rows = rows.crossJoin(context) if context is not None and o.stage != "优化" else rows.withColumn("context", F.lit(None).cast("string"))
    params = F.create_map(*[F.lit(x) for kv in o.params.items() for x in kv]).cast("map<string,string>") if o.params else F.lit(None).cast("map<string,string>")
    return rows.select("stage", templates.prompt(F.col("template"), F.col("previous"), F.col("context"), params, F.col("stage")).alias("prompt"))


def check(stories: DataFrame, p: LanguageProfile = ZH, genre: str | None = None, dictionary: DataFrame | None = None) -> DataFrame:
    """All findings of the checker, the names of Chinese texts included."""
    found = rules.findings(stories, p, genre)
    if p.name == "zh":
        found = found.unionByName(names.cast_findings(names.names(stories, dictionary), stories)).unionByName(names.alias_findings(names.aliases(stories, dictionary)))
    return found


def audit(stories: DataFrame, sources: DataFrame, p: LanguageProfile = ZH) -> tuple[DataFrame, DataFrame]:
    """The audit's findings, and the overlap with each source."""
    return rules.findings(stories, p, rules=rules.audit_rules), overlap.overlap_grid(stories, sources, p)


def adjust(stories: DataFrame, p: LanguageProfile, target: float, dictionary: DataFrame | None = None) -> DataFrame:
    """Commas inside words cleaned where a dictionary is given, then exclamations and commas adjusted."""
    if dictionary is not None:
        pairs = stories.select(F.explode(rewrite.comma_pairs(F.col("text"), p)).alias("pair")).distinct()
        cleaned = rewrite.clean_commas(stories, p, rewrite.one_word(dictionary, pairs))
        stories = cleaned.withColumn("text", F.col("cleaned")).drop("cleaned")
    return rewrite.adjusted(stories, p, target)
