"""Registered queries over the driver's tables with the Latin profile, and the DuckDB SQL that checks them.

Inline fixtures exercise the Chinese profile; they are written once and given to both engines.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import segment, trie
from .functions import text as X
from .operators import corpus, fingerprint, lexicon, names, overlap, rewrite, rules, templates
from .plans import cli
from .profiles import LATIN, ZH
from .sources import corpus as files
from .sources import files as source
from .sources import sinks

P = LATIN
SEED, TARGET = 42, 0.5
LETTER, ENDS = f"[{P.letters}]", f"[{P.ends}]"
LISTS, GENRE = P.lists, P.genre(None)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def text_() -> Column:
    return F.col("text")


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def spread(df: DataFrame) -> DataFrame:
    """Over all cores, if the input has fewer splits than there are: a single file would keep one core busy. Large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def q(s: str) -> str:
    """A SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def array(terms: list[str]) -> str:
    return "[" + ", ".join(map(q, terms)) + "]"


def values(rows: list[tuple], names_: str) -> str:
    """An inline table for DuckDB."""
    cell = lambda x: "NULL" if x is None else q(x) if isinstance(x, str) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names_})"


# SQL pieces with the meaning of the functions in functions/text.py
def n_of(pattern: str, t: str = "text") -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def n_lit(k: str, t: str = "text") -> str:
    return f"((length({t}) - length(replace({t}, {q(k)}, ''))) // {len(k)})"


def n_all(terms: list[str], t: str = "text") -> str:
    return "(" + " + ".join(n_lit(k, t) for k in terms) + ")"


def any_of(terms: list[str], t: str = "text") -> str:
    return "(" + " OR ".join(f"contains({t}, {q(k)})" for k in terms) + ")"


LETTERS = n_of(LETTER)
SENTENCES = f"len(list_filter(string_split_regex(text, {q(ENDS)}), lambda s: regexp_matches(s, {q(LETTER)})))"
STRIP = lambda s: f"regexp_replace({s}, '^[\\s\\p{{Z}}\\x0B\\x85]+|[\\s\\p{{Z}}\\x0B\\x85]+$', '', 'g')"
LINES = f"list_transform(string_split(text, chr(10)), lambda s: {STRIP('s')})"
OPENING = f"array_to_string((list_filter({LINES}, lambda s: s <> '' AND NOT starts_with(s, '=') AND NOT {any_of(LISTS['boilerplate'], 's')}))[1:30], chr(10))"
PARAGRAPHS = f"list_filter({LINES}, lambda s: s <> '')"
SPANS = n_of('["][^"]{1,50}["]')
CUES = n_of(rf"[{P.ends}\n][^{P.ends}\n]*?[{P.cues}]")
CLEAN = lambda t: f"regexp_replace({t}, '[{P.dropped}\\s\\d]', '', 'g')"


@query(f"SELECT doc_id, {LETTERS}::BIGINT AS letters FROM documents")
def letter_count(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.letter_count(text_(), P).alias("letters"))


@query("SELECT doc_id, ord::INTEGER AS ord, term, n::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT doc_id, {i} AS ord, {q(k)} AS term, {n_lit(k)} AS n FROM documents" for i, k in enumerate(LISTS["templates_check"] + LISTS["thinking"])) + ") WHERE n > 0")
def literal_counts(spark, sf_dir):
    return corpus.term_counts(docs(spark, sf_dir), LISTS["templates_check"] + LISTS["thinking"])


@query(f"SELECT doc_id, {SENTENCES}::BIGINT AS sentences, {n_lit('!')} / greatest({SENTENCES}, 1) AS excl_per_sent, {n_lit(',')} / greatest({SENTENCES}, 1) AS comma_per_sent FROM documents")
def sentence_stats(spark, sf_dir):
    n = X.sentence_count(text_(), P)
    return docs(spark, sf_dir).select("doc_id", n.alias("sentences"), X.per_sentence(X.literal_count(text_(), "!"), n).alias("excl_per_sent"), X.per_sentence(X.literal_count(text_(), ","), n).alias("comma_per_sent"))


@query(f"SELECT doc_id, {OPENING} AS opening FROM documents")
def opening_lines(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.opening_lines(text_(), P).alias("opening"))


@query(f"SELECT doc_id, contains(left(text, {LETTERS} // 2), '\"') AS uses_quotes FROM documents")
def quote_in_head(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", X.quote_in_head(text_(), X.letter_count(text_(), P)).alias("uses_quotes"))


@query(f"SELECT doc_id, md5(regexp_replace(left(text, 2 * {LETTERS}), '[^{P.letters}]', '', 'g')) AS head FROM documents")
def head_letters(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.head_letters(text_(), X.letter_count(text_(), P), P)).alias("head"))


@query(f"SELECT doc_id, md5({CLEAN('text')}) AS clean FROM documents")
def normalised_text(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(X.normalised(text_(), P)).alias("clean"))


@query(
    "WITH c AS (SELECT doc_id, len(list_filter(string_split(text, chr(10))[2:-2], lambda s: regexp_full_match(s, '\\d+'))) AS digits, "
    + f"{n_of('(?i)' + chr(92) + 'nChapter' + chr(92) + 's+' + chr(92) + 'd+')} AS chapters, {n_of(P.heading_counts[2])} AS roman FROM documents) SELECT doc_id, digits::BIGINT AS digits, chapters::BIGINT AS chapters, roman::BIGINT AS roman, greatest(digits, chapters, roman)::BIGINT AS headings FROM c"
)
def heading_counts(spark, sf_dir):
    h = docs(spark, sf_dir).select("doc_id", X.heading_counts(text_(), P).alias("h"))
    return h.select("doc_id", F.col("h")[0].alias("digits"), F.col("h")[1].alias("chapters"), F.col("h")[2].alias("roman"), F.array_max("h").alias("headings"))


def _splits() -> str:
    parts = [f"string_split_regex(text, {q(h)})" for h in P.headings]
    return "CASE " + " ".join(f"WHEN len({x}) >= 2 THEN {x}" for x in parts[:-1]) + f" ELSE {parts[-1]} END"


@query(f"WITH s AS (SELECT doc_id, {_splits()} AS s FROM documents) SELECT doc_id, len(s)::BIGINT AS n_sections, md5(s[1]) AS first_section, md5(array_to_string(s[1:3], '')) AS first_three FROM s")
def section_split(spark, sf_dir):
    s = docs(spark, sf_dir).select("doc_id", X.sections(text_(), P).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n_sections"), F.md5(F.element_at("s", 1)).alias("first_section"), F.md5(X.first_sections(F.col("s"))).alias("first_three"))


@query(f"SELECT doc_id, md5(right(text, 300)) AS tail, {n_all(LISTS['open_endings'], 'right(text, 300)')}::BIGINT AS open_markers, {n_all(LISTS['ending_power'], 'right(text, 300)')}::BIGINT AS power_words FROM documents")
def ending_markers(spark, sf_dir):
    end = X.tail(text_())
    return docs(spark, sf_dir).select("doc_id", F.md5(end).alias("tail"), X.total_count(end, LISTS["open_endings"]).alias("open_markers"), X.total_count(end, LISTS["ending_power"]).alias("power_words"))


@query(f"WITH p AS (SELECT doc_id, {PARAGRAPHS} AS p FROM documents) SELECT doc_id, len(p)::BIGINT AS n, len(list_filter(p, lambda s: length(s) > 200))::BIGINT AS long, list_sum(list_transform(p, lambda s: length(s)))::BIGINT / nullif(len(p), 0) AS average FROM p")
def paragraph_rhythm(spark, sf_dir):
    m = docs(spark, sf_dir).select("doc_id", X.paragraph_stats(text_()).alias("p")).select("doc_id", "p.*")
    return m.select("doc_id", "n", "long", (F.col("chars") / F.nullif("n", F.lit(0))).alias("average"))


@query(f"SELECT doc_id, {SPANS}::BIGINT AS spans, {CUES}::BIGINT AS cues, ({SPANS} + {CUES}) / nullif({LETTERS} / 100.0::DOUBLE, 0) AS density FROM documents")
def dialogue_density(spark, sf_dir):
    spans, cues = X.dialogue_spans(text_(), P), X.dialogue_cues(text_(), P)
    return docs(spark, sf_dir).select("doc_id", spans.alias("spans"), cues.alias("cues"), F.try_divide(spans + cues, X.letter_count(text_(), P) / F.lit(100.0)).alias("density"))


@query(f"WITH c AS (SELECT doc_id, {n_lit(chr(34))} AS d, {n_lit(chr(39))} AS s FROM documents) SELECT doc_id, d::BIGINT AS n_double, s::BIGINT AS n_single, concat_ws(' + ', CASE WHEN d > 0 THEN 'double ' || d END, CASE WHEN s > 0 THEN 'single ' || s END) AS detail FROM c")
def quote_tally(spark, sf_dir):
    x = docs(spark, sf_dir).select("doc_id", X.quote_tally(text_()).alias("x"))
    return x.select("doc_id", F.col("x.double").alias("n_double"), F.col("x.single").alias("n_single"), "x.detail")


@query(f"SELECT doc_id, {n_all(GENRE['emotion'])}::BIGINT AS total, {n_all(GENRE['emotion'])} / nullif({LETTERS} / 300.0::DOUBLE, 0) AS density FROM documents")
def emotion_density(spark, sf_dir):
    n = X.total_count(text_(), GENRE["emotion"])
    return docs(spark, sf_dir).select("doc_id", n.alias("total"), F.try_divide(n, X.letter_count(text_(), P) / F.lit(300.0)).alias("density"))


@query(f"SELECT doc_id, letters FROM (SELECT doc_id, {LETTERS}::BIGINT AS letters FROM documents) WHERE letters >= 500")
def healthy_docs(spark, sf_dir):
    return corpus.healthy(docs(spark, sf_dir), P).select("doc_id", "letters")


@query(f"SELECT doc_id, letters FROM (SELECT doc_id, {LETTERS}::BIGINT AS letters FROM documents) WHERE letters < 500")
def rejected_docs(spark, sf_dir):
    return corpus.rejected(docs(spark, sf_dir), P).select("doc_id", "letters")


@query("SELECT source, count(*)::BIGINT AS docs FROM documents GROUP BY source")
def category_counts(spark, sf_dir):
    return corpus.category_counts(docs(spark, sf_dir), "source")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def category_filter(spark, sf_dir):
    return docs(spark, sf_dir).where(F.col("lang") == "fr").select("doc_id", "lang")


DRAWN = f"SELECT * FROM documents WHERE {LETTERS} >= 500 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('{SEED}-' || doc_id)) <= 5"


def _drawn(spark, sf_dir) -> DataFrame:
    return corpus.sample(corpus.healthy(docs(spark, sf_dir), P), 5, SEED, "lang")


@query(f"SELECT doc_id, lang FROM ({DRAWN})")
def seeded_sample(spark, sf_dir):
    return _drawn(spark, sf_dir).select("doc_id", "lang")


SIZED = "octet_length(encode(text)) / 1024.0 BETWEEN 2 AND 8"


@query(f"SELECT doc_id, octet_length(encode(text))::BIGINT AS bytes FROM documents WHERE {SIZED}")
def size_range(spark, sf_dir):
    n = F.octet_length("text").cast("long")
    return docs(spark, sf_dir).select("doc_id", n.alias("bytes")).where((F.col("bytes") / 1024.0).between(2, 8))


BAG = "SELECT doc_id, term, count(*) AS n, min(pos) AS first_pos FROM (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-zà-ÿ]{2,}') AS w FROM documents)) GROUP BY doc_id, term"
TOP = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS rank, term, n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_pos) AS r FROM ({BAG})) WHERE r <= 40 AND NOT list_contains({array(LISTS['stop'])}, term)) QUALIFY rank <= 8"


@query(f"SELECT doc_id, rank::INTEGER AS rank, term, n::BIGINT AS n FROM ({TOP})")
def top_terms(spark, sf_dir):
    return fingerprint.top_terms(docs(spark, sf_dir), P, LISTS["stop"])


PRINT = f"SELECT d.doc_id, {LETTERS}::BIGINT AS chars, greatest({SENTENCES}, 1)::BIGINT AS sentences, {n_lit('!')} / greatest({SENTENCES}, 1) AS excl_per_sent, {n_lit(',')} / greatest({SENTENCES}, 1) AS comma_per_sent, contains(left(text, {LETTERS} // 2), '\"') AS uses_quotes, {OPENING} AS opening_30_lines, coalesce(terms, '') AS terms FROM documents d LEFT JOIN (SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS terms FROM ({TOP}) GROUP BY doc_id) t ON d.doc_id = t.doc_id"


@query(PRINT)
def fingerprints(spark, sf_dir):
    out = fingerprint.fingerprint(docs(spark, sf_dir), P)
    return out.withColumn("terms", F.array_join("top_terms", ",")).drop("top_terms")


def _rounded(c: str, places: int) -> str:
    n = f"floor({c} * {10**places}::DOUBLE + 0.5)::BIGINT"
    return f"(({n}) // {10**places})::VARCHAR || '.' || regexp_replace(lpad((({n}) % {10**places})::VARCHAR, {places}, '0'), '^(.+?)0+$', '\\1')"


def _context_sql(words: dict[str, str], some: str, rules_: str | None) -> str:
    """A context by plain concatenation."""

    def line(key: str, /, **cols: str) -> str:
        out = q(words[key])
        for k, v in cols.items():
            out = f"replace({out}, '{{{k}}}', {v})"
        return out

    nl = " || chr(10) || "
    block = nl.join([line("source", i="i::VARCHAR", name="doc_id::VARCHAR"), line("counts", chars="chars::VARCHAR", sentences="sentences::VARCHAR"), line("ratios", exclamations=_rounded("excl_per_sent", 3), commas=_rounded("comma_per_sent", 2)), line("terms", terms="array_to_string(string_split(terms, ',')[1:5], ', ')"), line("lines", opening="opening_30_lines"), "''"])
    parts = [q(words["opening"]), q(words["sources"]), f"string_agg({block}, chr(10) ORDER BY doc_id)", q(words["dimensions"]), q(words["constraints"]), *([q(rules_)] if rules_ else []), q(words["output"])]
    return f"WITH p AS (SELECT x.*, row_number() OVER (ORDER BY doc_id) AS i FROM ({PRINT}) x JOIN ({some}) USING (doc_id)) SELECT {nl.join(parts)} AS context FROM p"


@query(_context_sql(P.context, f"SELECT doc_id FROM ({DRAWN}) WHERE lang = 'es'", None))
def fingerprint_context(spark, sf_dir):
    """The context of the drawn documents of one language, as a distilled category has it: without rules."""
    some = _drawn(spark, sf_dir).where("lang = 'es'")
    return fingerprint.context(fingerprint.fingerprint(some, P).withColumn("name", F.col("doc_id")), P.context)


@query(_context_sql(ZH.context, f"SELECT doc_id FROM ({DRAWN})", fingerprint.rules_block(ZH.context, ZH.lists)))
def fusion_context(spark, sf_dir):
    """The Chinese context with its rules, over all drawn documents."""
    prints = fingerprint.fingerprint(_drawn(spark, sf_dir), P).withColumn("name", F.col("doc_id"))
    return fingerprint.context(prints, ZH.context, ZH.lists)


COUNTED = f"SELECT lang, term, count(DISTINCT doc_id) AS docs FROM ({BAG}) JOIN ({DRAWN}) USING (doc_id) GROUP BY lang, term"


def _counted(spark, sf_dir) -> DataFrame:
    some = _drawn(spark, sf_dir)
    return fingerprint.term_documents(fingerprint.head_terms(some, P), some, "lang")


@query(f"SELECT lang, term, docs::BIGINT AS docs FROM ({COUNTED}) WHERE docs >= 3")
def common_terms(spark, sf_dir):
    return fingerprint.shared_terms(_counted(spark, sf_dir))


@query(f"SELECT lang, term, docs::BIGINT AS docs FROM ({COUNTED}) WHERE docs < 3")
def author_terms(spark, sf_dir):
    return fingerprint.own_terms(_counted(spark, sf_dir))


@query(f"SELECT lang, term FROM ({COUNTED}) WHERE docs = 5")
def strict_common_terms(spark, sf_dir):
    return fingerprint.shared_terms(_counted(spark, sf_dir), 5).select("lang", "term")


HITS = f"""
WITH s AS (SELECT item_id, {CLEAN('text')} AS c FROM benchmark),
g AS (SELECT item_id, substring(c, i + 1, 16) AS gram FROM (SELECT item_id, c, unnest(range(0, greatest(length(c) - 16, 0), 5)) AS i FROM s)),
d AS (SELECT doc_id, {CLEAN('text')} AS c FROM documents),
h AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, substring(c, i + 1, 16) AS gram FROM (SELECT doc_id, c, unnest(range(0, greatest(length(c) - 15, 0))) AS i FROM d)) WHERE gram IN (SELECT gram FROM g))
SELECT doc_id, item_id, count(*)::BIGINT AS matches FROM h JOIN g USING (gram) GROUP BY doc_id, item_id"""


def _overlap(spark, sf_dir) -> DataFrame:
    return overlap.overlap(docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), P, source_id="item_id")


@query(HITS)
def originality_overlap(spark, sf_dir):
    return _overlap(spark, sf_dir)


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({HITS}))")
def original_docs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id").join(_overlap(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


@query(f"SELECT doc_id, item_id, coalesce(matches, 0)::BIGINT AS matches, CASE WHEN matches IS NULL THEN 'OK' ELSE 'FAIL' END AS verdict FROM documents LEFT JOIN ({HITS}) h USING (doc_id)")
def overlap_report(spark, sf_dir):
    """Every document: its pairs that share a passage, or one row that it shares none."""
    return overlap.overlap_report(docs(spark, sf_dir).select("doc_id", "text"), table(spark, sf_dir, "benchmark"), P, source_id="item_id")


def _banned(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in LISTS["patterns_audit"]], "term string")


@query(f"SELECT doc_id FROM documents WHERE {any_of(LISTS['patterns_audit'])}")
def banned_semi(spark, sf_dir):
    return corpus.with_any(docs(spark, sf_dir), _banned(spark)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE NOT {any_of(LISTS['patterns_audit'])}")
def banned_anti(spark, sf_dir):
    return corpus.without_any(docs(spark, sf_dir), _banned(spark)).select("doc_id")


WORDS = "SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \\n]+')) AS term FROM benchmark"


def _lexicon(spark, sf_dir) -> DataFrame:
    """Every word of the benchmark, repeats kept."""
    return table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "[ \n]+")).alias("term"))


@query(f"SELECT doc_id, term, {n_lit('§', 'text').replace(q('§'), 'term').replace('// 1', '// length(term)')}::BIGINT AS n FROM documents JOIN ({WORDS}) ON contains(text, term)")
def lexicon_counts(spark, sf_dir):
    """Every word of the benchmark counted in every document, in one pass over the texts."""
    return lexicon.term_counts(docs(spark, sf_dir), _lexicon(spark, sf_dir))


@query(f"SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM documents JOIN ({WORDS}) ON contains(text, term) WHERE length(term) >= 9)")
def lexicon_semi(spark, sf_dir):
    """Documents with some long word of the benchmark."""
    return lexicon.with_any(docs(spark, sf_dir).select("doc_id", "text"), _lexicon(spark, sf_dir).where(F.length("term") >= 9)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM documents JOIN ({WORDS}) ON contains(text, term) WHERE length(term) >= 9)")
def lexicon_anti(spark, sf_dir):
    """Documents without any."""
    return lexicon.without_any(docs(spark, sf_dir).select("doc_id", "text"), _lexicon(spark, sf_dir).where(F.length("term") >= 9)).select("doc_id")


def _rule(severity: str, rule: str, value: str, when: str = "TRUE", term: str = "") -> str:
    return f"SELECT doc_id, {severity} AS severity, '{rule}' AS rule, {q(term)} AS term, ({value})::DOUBLE AS value FROM m WHERE {when}"


def finding_rows() -> tuple[str, list[str]]:
    """What the checker's rules look at as ``m``, and the rows of each rule, in order."""
    each = lambda s, rule, name: [_rule(s, rule, n_lit(k), f"{n_lit(k)} > 0", k) for k in LISTS[name]]
    marks, quotes, thinking, tpl = n_all(LISTS["banned_marks"]), "(" + n_lit('"') + " + " + n_lit("'") + ")", n_all(LISTS["thinking"]), n_all(LISTS["templates_check"])
    first = "array_to_string(s[1:3], '')"
    emotion, dialogue = f"{n_all(GENRE['emotion'])} / (letters / 300.0::DOUBLE)", f"({SPANS} + {CUES}) / (letters / 100.0::DOUBLE)"
    long, average = "len(list_filter(p, lambda s: length(s) > 200))", "list_sum(list_transform(p, lambda s: length(s)))::BIGINT / len(p)"
    end = "right(text, 300)"
    rows = [
        _rule("CASE WHEN letters < 1000 THEN 'issue' WHEN letters > 50000 THEN 'warn' ELSE 'pass' END", "length", "letters"),
        *each("'issue'", "banned_mark", "banned_marks"),
        _rule("'warn'", "ascii_quotes", quotes, f"{quotes} > 0"),
        _rule("'pass'", "punctuation", "0", f"{marks} = 0 AND {quotes} = 0"),
        *each("'issue'", "template", "templates_check"),
        _rule("'pass'", "template", "0", f"{tpl} = 0"),
        *each("'warn'", "thinking", "thinking"),
        _rule("'issue'", "thinking_total", thinking, f"{thinking} > 5"),
        _rule("'pass'", "thinking_total", thinking, f"{thinking} = 0"),
        _rule("'warn'", "sections", "len(s)", "len(s) < 3"),
        _rule(f"CASE WHEN {n_all(GENRE['climax'], first)} < 1 THEN 'warn' ELSE 'pass' END", "climax", n_all(GENRE["climax"], first), "len(s) >= 3"),
        _rule(f"CASE WHEN {any_of(GENRE['setup'], 's[1]')} THEN 'pass' ELSE 'warn' END", "setup", f"{any_of(GENRE['setup'], 's[1]')}::INT", "len(s) >= 3"),
        _rule(f"CASE WHEN {emotion} < 0.5 THEN 'warn' ELSE 'pass' END", "emotion_density", emotion, "letters > 0"),
        _rule("'issue'", "open_ending", n_all(LISTS["open_endings"], end), f"{n_all(LISTS['open_endings'], end)} > 0"),
        _rule(f"CASE WHEN {n_all(LISTS['ending_power'], end)} = 0 THEN 'warn' ELSE 'pass' END", "ending_power", n_all(LISTS["ending_power"], end)),
        _rule(f"CASE WHEN {dialogue} < 1.5 THEN 'warn' ELSE 'pass' END", "dialogue_density", dialogue, "letters > 0"),
        _rule("'warn'", "long_paragraph", long, f"{long} > 0"),
        _rule(f"CASE WHEN {average} > 80 THEN 'warn' ELSE 'pass' END", "paragraph_length", average, "len(p) > 0"),
    ]
    return f"WITH m AS MATERIALIZED (SELECT doc_id, text, {LETTERS} AS letters, {_splits()} AS s, {PARAGRAPHS} AS p FROM documents)", rows


def _findings_sql() -> str:
    measures, rows = finding_rows()
    return f"{measures} " + " UNION ALL ".join(rows)


@query(_findings_sql())
def rule_findings(spark, sf_dir):
    return rules.findings(docs(spark, sf_dir), P)


@query(f"SELECT doc_id, count(*) FILTER (severity = 'pass')::BIGINT AS passes, count(*) FILTER (severity = 'warn')::BIGINT AS warns, count(*) FILTER (severity = 'issue')::BIGINT AS issues FROM ({_findings_sql()}) GROUP BY doc_id")
def severity_totals(spark, sf_dir):
    return rules.totals(docs(spark, sf_dir), P)


def _audit_sql() -> str:
    hit = lambda rule, name: [(rule, k, n_lit(k)) for k in LISTS[name]]
    bans = [*hit("banned_mark", "banned_marks"), ("corner_quotes", "", n_of("[「」]")), *hit("banned_pattern", "patterns_audit"), *hit("template", "templates_audit")]
    ratio = lambda mark: f"{n_lit(mark)} / nullif(sentences, 0)"
    rows = [_rule("'info'", "letters", "letters"), _rule("'info'", "sentences", "sentences"), _rule("'info'", "exclamations_per_sentence", ratio("!")), _rule("'info'", "commas_per_sentence", ratio(","))]
    rows += [_rule("'issue'", r, n, f"{n} > 0", k) for r, k, n in bans]
    rows.append(_rule("'pass'", "fixed_rules", "0", " AND ".join(f"{n} = 0" for _, _, n in bans)))
    return f"WITH m AS MATERIALIZED (SELECT doc_id, text, {LETTERS} AS letters, {SENTENCES} AS sentences FROM documents) " + " UNION ALL ".join(rows)


@query(_audit_sql())
def audit_findings(spark, sf_dir):
    return rules.findings(docs(spark, sf_dir), P, rules=rules.audit_rules)


@query("SELECT conv_id, turn, left(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), 2000) AS previous FROM conversations")
def previous_turn(spark, sf_dir):
    return templates.previous_turn(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "previous")


@query(
    "WITH c AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations) SELECT conv_id, turn, "
    "'You are an experienced editor.' || chr(10) || chr(10) || left(text, 100) || chr(10) || chr(10) || CASE WHEN coalesce(prev, '') <> '' THEN chr(10) || '---' || chr(10) || '## Previous output' || chr(10) || chr(10) || left(prev, 2000) || chr(10) || chr(10) ELSE '' END || "
    "chr(10) || '---' || chr(10) || '## Parameters' || chr(10) || chr(10) || CASE WHEN role = 'user' THEN '- defaults' ELSE '- role: ' || role END AS prompt FROM c"
)
def prompt_assembly(spark, sf_dir):
    c = templates.previous_turn(table(spark, sf_dir, "conversations"))
    params = F.when(F.col("role") != "user", F.create_map(F.lit("role"), F.col("role")))
    return c.select("conv_id", "turn", templates.prompt(F.left("text", F.lit(100)), F.col("previous"), F.lit(None).cast("string"), params).alias("prompt"))


@query("SELECT conv_id, turn, role, left((SELECT e.text FROM conversations e WHERE e.conv_id = c.conv_id AND e.turn < c.turn AND e.role IN ('assistant', 'user') AND e.text <> '' ORDER BY e.role, e.turn DESC LIMIT 1), 2000) AS previous FROM conversations c")
def chained_turns(spark, sf_dir):
    """Each turn with the latest earlier text of the assistant, or else of the user."""
    return templates.chained(table(spark, sf_dir, "conversations"), ["assistant", "user"], chunk=3).select("conv_id", "turn", "role", "previous")


@query("WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+')) AS w FROM documents) SELECT a.doc_id, a.w AS short, b.w AS long FROM n a JOIN n b ON a.doc_id = b.doc_id AND a.w <> b.w AND starts_with(b.w, a.w) AND length(a.w) >= 3")
def latin_aliases(spark, sf_dir):
    """Capitalised words of which one begins with the other."""
    return names.latin_aliases(docs(spark, sf_dir))


@query(f"SELECT lang, count(*) FILTER (l >= 500)::BIGINT AS healthy, count(*) FILTER (l < 500)::BIGINT AS rejected FROM (SELECT lang, {LETTERS} AS l FROM documents) GROUP BY lang")
def guarded_counts(spark, sf_dir):
    """Healthy and rejected documents of each language and the guard against too few, from the one pass that a job makes over the healthy ones."""
    d = docs(spark, sf_dir)
    langs = sorted(r[0] for r in table(spark, sf_dir, "documents").select("lang").distinct().limit(1000).collect())
    good, seen = corpus.guarded(d, P, langs, "lang")
    good.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame(corpus.enough(seen, langs), "lang string, healthy long, rejected long")


@query("SELECT doc_id, lang FROM documents WHERE lang = 'de' UNION ALL SELECT doc_id, lang FROM documents WHERE source = 'src1'")
def source_union(spark, sf_dir):
    d = docs(spark, sf_dir)
    return corpus.union_all(d.where("lang = 'de'"), d.where("source = 'src1'")).select("doc_id", "lang")


_POSITIONS = f"""
WITH d AS (SELECT doc_id, text, greatest(0, floor({SENTENCES} * {TARGET})::BIGINT - {n_lit('!')}) AS need, {n_lit('.')} AS periods FROM documents),
c AS (SELECT doc_id, need, greatest(1, periods // greatest(need, 1)) AS step, unnest(range(1, length(text) + 1)) AS i, text FROM d),
k AS (SELECT doc_id, need, step, i, ch, p, CASE WHEN ch = '.' THEN sum((ch = '.')::INT) OVER w END AS k FROM (SELECT *, substring(text, i, 1) AS ch, CASE WHEN i > 1 THEN substring(text, i - 1, 1) ELSE '' END AS p FROM c) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
e AS (SELECT *, CASE WHEN ch = '.' AND need > 0 AND k % step = 0 AND i > 1 AND NOT regexp_matches(p, '[{P.not_before_period}]') THEN 1 ELSE 0 END AS fits FROM k),
r AS (SELECT *, sum(fits) OVER (PARTITION BY doc_id ORDER BY i) AS n FROM e)
SELECT doc_id, string_agg(CASE WHEN fits = 1 AND n <= need THEN '!' ELSE ch END, '' ORDER BY i) AS raised FROM r GROUP BY doc_id"""


@query(f"SELECT d.doc_id, md5(coalesce(raised, '')) AS rewritten FROM documents d LEFT JOIN ({_POSITIONS}) x ON d.doc_id = x.doc_id")
def raise_exclamations(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(rewrite.raise_exclamations(text_(), P, TARGET)).alias("rewritten"))


def _pieces(table_: str) -> str:
    """``doc_id, commas``: the texts of a table with commas inserted."""
    return f"""
WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^{P.ends}]*[{P.ends}]|[^{P.ends}]+')) AS s, generate_subscripts(regexp_extract_all(text, '[^{P.ends}]*[{P.ends}]|[^{P.ends}]+'), 1) AS i FROM {table_}),
n AS (SELECT *, {n_of(LETTER, 's')} AS z FROM s)
SELECT doc_id, string_agg(CASE WHEN z BETWEEN 12 AND 30 AND NOT contains(s, ',') THEN (SELECT r FROM (SELECT CASE WHEN length(h) < length(s) THEN h || ',' || substring(s, length(h) + 1) ELSE s END AS r FROM (SELECT array_to_string(list_transform(range(1, z // 2 + 1), lambda j: regexp_extract_all(s, '[^{P.letters}]*[{P.letters}]')[j]), '') AS h))) ELSE s END, '' ORDER BY i) AS commas FROM n GROUP BY doc_id"""


@query(f"SELECT d.doc_id, md5(coalesce(commas, '')) AS rewritten FROM documents d LEFT JOIN ({_pieces('documents')}) x ON d.doc_id = x.doc_id")
def insert_commas(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(rewrite.insert_commas(text_(), P)).alias("rewritten"))


@query(
    f"WITH raised AS (SELECT doc_id, raised AS text FROM ({_POSITIONS})), both_ AS (SELECT d.doc_id, text, coalesce(commas, '') AS r FROM documents d LEFT JOIN ({_pieces('raised')}) x ON d.doc_id = x.doc_id) "
    f"SELECT doc_id, md5(r) AS rewritten, {n_lit('!')}::BIGINT AS excl_before, {n_lit('!', 'r')}::BIGINT AS excl_after, {n_lit(',')}::BIGINT AS comma_before, {n_lit(',', 'r')}::BIGINT AS comma_after FROM both_"
)
def adjusted_texts(spark, sf_dir):
    """Both rewrites in order, with the counts before and after."""
    return rewrite.adjusted(docs(spark, sf_dir).select("doc_id", "text"), P, TARGET).select("doc_id", F.md5("rewritten").alias("rewritten"), "excl_before", "excl_after", "comma_before", "comma_after")


@query("SELECT doc_id, left(text, 2000) AS short, length(left(text, 3000))::BIGINT AS n FROM documents")
def prefix_truncation(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.left("text", F.lit(2000)).alias("short"), F.length(F.left("text", F.lit(3000))).cast("long").alias("n"))


@query("SELECT page_id, string_split_regex(url, '[/\\\\]')[-1] AS name FROM pages")
def basenames(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.basename(F.col("url")).alias("name"))


DICTIONARY = [("the", 900), ("of", 400), ("ther", 7), ("la", 300)]


@query(f"SELECT doc_id, term, n::BIGINT AS n, coalesce(freq, -1)::BIGINT AS freq FROM ({TOP}) LEFT JOIN {values(DICTIONARY, 'w, freq')} ON term = w")
def dictionary_lookup(spark, sf_dir):
    terms = fingerprint.top_terms(docs(spark, sf_dir), P, LISTS["stop"])
    return corpus.frequencies(terms, spark.createDataFrame(DICTIONARY, "term string, freq long")).select("doc_id", "term", "n", "freq")


# each letter run is folded from its end: the best way from a place to the end, of its words and the ways from where they end
_PATHS = f"""
WITH f AS (SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{LETTER}+')) AS term FROM benchmark) GROUP BY term),
d AS MATERIALIZED (SELECT term, least(-1, floor(ln(n::DOUBLE / (SELECT sum(n) FROM f)) * {trie.UNIT})::BIGINT) AS w FROM f),
z AS MATERIALIZED (SELECT max(length(term)) AS longest, least(-1, floor(ln(1.0::DOUBLE / (SELECT sum(n) FROM f)) * {trie.UNIT})::BIGINT) AS alone FROM d),
r AS MATERIALIZED (SELECT doc_id, unnest(w) AS s, generate_subscripts(w, 1) AS run FROM (SELECT doc_id, regexp_extract_all(replace(text, ' ', ''), '{LETTER}+') AS w FROM documents)),
i AS (SELECT doc_id, run, s, unnest(range(1, length(s) + 1)) AS p FROM r),
x AS (SELECT doc_id, run, s, p, unnest(range(1, least(longest, length(s) - p + 1) + 1)) AS x, alone FROM i, z),
e AS (SELECT doc_id, run, p, list({{'v': coalesce(w, alone), 'x': x, 'g': x * x * p, 'c': 1::BIGINT}}) AS es FROM x LEFT JOIN d ON term = substring(s, p, x) WHERE term IS NOT NULL OR x = 1 GROUP BY doc_id, run, p),
l AS (SELECT doc_id, run, list(es ORDER BY p DESC) AS ls FROM e GROUP BY doc_id, run),
b AS (SELECT doc_id, list_reduce(ls, lambda a, y: list_prepend(list_max(list_transform(y, lambda e: {{'v': e.v + a[e.x].v, 'x': e.x, 'g': e.g + a[e.x].g, 'c': 1 + a[e.x].c}})), a)[1:40], [{{'v': 0::BIGINT, 'x': 0::BIGINT, 'g': 0::BIGINT, 'c': 0::BIGINT}}])[1] AS b FROM l),
t AS (SELECT doc_id, sum(b.c)::BIGINT AS n, sum(b.g)::BIGINT AS places FROM b GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(places, 0) AS places FROM documents LEFT JOIN t USING (doc_id)"""


@query(_PATHS)
def segmented_documents(spark, sf_dir):
    """Documents without their spaces, segmented by the benchmark's words: how many words, and a sum over their places and lengths in each run of letters."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(f"({LETTER}+)"))).alias("term")).groupBy("term").agg(F.count("*").alias("freq"))
    runs = docs(spark, sf_dir).select("doc_id", F.posexplode_outer(F.regexp_extract_all(F.replace("text", F.lit(" "), F.lit("")), F.lit(f"({LETTER}+)"))).alias("run", "s"))
    cut = trie.with_words(runs, words, P.letters, "s")
    step = lambda a, w: F.struct((a["at"] + F.length(w)).alias("at"), (a["sum"] + F.length(w) * F.length(w) * (a["at"] + 1)).alias("sum"))
    of = F.aggregate("words", F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("sum")), step)["sum"]
    return cut.groupBy("doc_id").agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).cast("long").alias("n_words"), F.coalesce(F.sum(of), F.lit(0)).alias("places"))


def written_corpus(spark, sf_dir) -> str:
    """All documents as text files by language."""
    source.register(spark)
    folder = source.scratch(spark, "corpus")
    docs(spark, sf_dir).select(F.col("lang").alias("category"), F.col("doc_id").cast("string").alias("name"), "text").write.format("corpus").mode("append").save(folder)
    return folder


@query("SELECT lang AS category, doc_id, octet_length(encode(text))::BIGINT AS bytes, md5(text) AS content FROM documents")
def corpus_files(spark, sf_dir):
    """All documents written as files by language, and read back."""
    found = spark.read.format("corpus").load(written_corpus(spark, sf_dir))
    return found.select("category", F.col("name").cast("long").alias("doc_id"), "bytes", F.md5("text").alias("content"))


@query("SELECT doc_id, md5(text) AS content FROM documents WHERE lang = 'fr' AND octet_length(encode(text)) BETWEEN 1000 AND 20000")
def corpus_files_chosen(spark, sf_dir):
    """Of these files those of one language and a range of sizes; no other is opened."""
    found = spark.read.format("corpus").load(written_corpus(spark, sf_dir)).where("category = 'fr' and bytes >= 1000 and bytes <= 20000")
    return found.select(F.col("name").cast("long").alias("doc_id"), F.md5("text").alias("content"))


# inline fixtures
TEMPLATE = "头\n<!-- FILE_SECTION: 人设生成器 -->\n描述\n---\n模板A\n---\n模板B 黑莲花\n<!-- FILE_SECTION: 其他 -->\nX"
FILES = [(1, "人设生成器", TEMPLATE), (2, "其他", TEMPLATE), (3, "没有", TEMPLATE), (4, "人设生成器", "只有一段")]
MARK = "'<!-- FILE_SECTION: ' || name || ' -->'"
BODY = f"CASE WHEN contains(content, {MARK}) THEN {STRIP(f'split_part(split_part(content, {MARK}, 2), {q("<!-- FILE_SECTION:")}, 1)')} ELSE content END"


def _files(spark) -> DataFrame:
    rows = spark.createDataFrame(FILES, "id int, name string, content string")
    return rows.withColumn("s", templates.section(F.col("content"), F.col("name")))


@query(f"SELECT id, contains(content, {MARK}) AS found, {BODY} AS body FROM {values(FILES, 'id, name, content')}")
def template_section(spark, sf_dir):
    return _files(spark).select("id", "s.found", "s.body")


FIRST = f"{STRIP('split_part(CASE WHEN found AND contains(body, chr(10) || ' + q('---') + ' || chr(10)) THEN substring(body, instr(body, chr(10) || ' + q('---') + ' || chr(10)) + 5) ELSE body END, ' + q('---') + ', 1)')}"
_SECTIONS = f"SELECT id, contains(content, {MARK}) AS found, {BODY} AS body FROM {values(FILES, 'id, name, content')}"


@query(f"SELECT id, {FIRST} AS template FROM ({_SECTIONS})")
def template_first(spark, sf_dir):
    return _files(spark).select("id", templates.first_template(F.col("s.found"), F.col("s.body")).alias("template"))


@query(f"SELECT id, k, coalesce({STRIP('list_filter(string_split(body, ' + q('---') + '), lambda x: contains(x, k))[1]')}, {FIRST}) AS template FROM ({_SECTIONS}) CROSS JOIN (VALUES ('黑莲花'), ('无'), ('模板')) AS w(k)")
def template_keyword(spark, sf_dir):
    rows = _files(spark).crossJoin(spark.createDataFrame([("黑莲花",), ("无",), ("模板",)], "k string"))
    return rows.select("id", "k", templates.keyword_template(F.col("s.found"), F.col("s.body"), F.col("k")).alias("template"))


STAGE_ROWS = [(i, *s) for i, s in enumerate(templates.lexicons.STAGES)]
OUTPUT_ROWS = [("story_脑洞.txt", "c"), ("脑洞_result.txt", "b"), ("人设_output.txt", "a"), ("story_人设.txt", "x"), ("正文_output.txt", "z")]
_STAGES = values(STAGE_ROWS, "idx, stage, file, section")


@query(f"SELECT s.idx::INTEGER AS idx, s.stage, (SELECT text FROM {values(OUTPUT_ROWS, 'file, text').replace('AS v(', 'AS o(')} WHERE o.file IN (b.stage || '_output.txt', b.stage || '_result.txt', 'story_' || b.stage || '.txt') ORDER BY list_position([b.stage || '_output.txt', b.stage || '_result.txt', 'story_' || b.stage || '.txt'], o.file) LIMIT 1) AS previous FROM {_STAGES.replace('AS v(', 'AS s(')} LEFT JOIN {_STAGES.replace('AS v(', 'AS b(')} ON b.idx = s.idx - 1")
def stage_chain(spark, sf_dir):
    return templates.previous_outputs(templates.stages(spark), spark.createDataFrame(OUTPUT_ROWS, "file string, text string"))


CONTENT_ROWS = [("prompt_character.md", TEMPLATE), ("prompt_outline.md", "大纲\n---\n二")]


@query(f"SELECT idx::INTEGER AS idx, stage, {FIRST} AS template FROM (SELECT idx, stage, contains(content, {MARK}) AS found, {BODY} AS body FROM (SELECT idx, stage, section AS name, content FROM {_STAGES.replace('AS v(', 'AS s(')} JOIN {values(CONTENT_ROWS, 'file, content').replace('AS v(', 'AS f(')} USING (file)))")
def stage_templates(spark, sf_dir):
    return templates.load_templates(templates.stages(spark), spark.createDataFrame(CONTENT_ROWS, "file string, content string"))


PARAMS = [(1, '{"a":"b"}'), (2, "bad"), (3, '{"a":1,"c":""}'), (4, "{}")]


@query("SELECT * FROM (VALUES (1, 'a=b,z=9'), (2, 'a=0,z=9'), (3, 'a=1,z=9'), (4, 'a=0,z=9')) AS v(id, merged)")
def params_merge(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.lit("0"), F.lit("z"), F.lit("9"))
    rows = spark.createDataFrame(PARAMS, "id int, j string").select("id", X.merged_params(base, X.json_params(F.col("j"))).alias("m"))
    return rows.select("id", F.array_join(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


@query("SELECT * FROM (VALUES ('default', 8, 19, 7), ('系统流', 10, 18, 8), ('虐恋', 8, 15, 7), ('重生', 8, 13, 6), ('别的', 8, 19, 7)) AS v(genre, climax, emotion, setup)")
def genre_profiles(spark, sf_dir):
    rows = [(g, len(x["climax"]), len(x["emotion"]), len(x["setup"])) for g in ("default", "系统流", "虐恋", "重生", "别的") for x in (ZH.genre(g),)]
    return spark.createDataFrame(rows, "genre string, climax int, emotion int, setup int")


STORIES = [(1, "方，向，你，好"), (2, "他说，方，向对，的"), (3, "，方，"), (4, "没有")]
WORDS = [("方向", 100), ("你好", 90), ("方", 5), ("向", 5), ("你", 3), ("好", 4), ("说方", 0)]


@query("SELECT * FROM (VALUES (1, '方向，你好', 2), (2, '他说，方向对，的', 1), (3, '，方，', 0), (4, '没有', 0)) AS v(doc_id, cleaned, removed)")
def clean_commas(spark, sf_dir):
    d = spark.createDataFrame(STORIES, "doc_id int, text string")
    pairs = d.select(F.explode(rewrite.comma_pairs(text_(), ZH)).alias("pair")).distinct()
    words = rewrite.one_word(spark.createDataFrame(WORDS, "term string, freq long"), pairs)
    return rewrite.clean_commas(d, ZH, words).select("doc_id", "cleaned", F.col("removed").cast("int").alias("removed"))


CAST = [(1, "赵天豪说，苏暖走。苏暖暖笑。张三说。"), (2, "慕容雪笑，慕容白走。"), (3, "谢谢周总监。方方的走。"), (4, "方悦说：来。北方更美。")]


@query("SELECT * FROM (VALUES (1, '苏暖'), (1, '赵天豪'), (2, '慕容白走'), (2, '慕容雪'), (4, '方悦'), (4, '方更美')) AS v(doc_id, name)")
def character_names(spark, sf_dir):
    return names.names(spark.createDataFrame(CAST, "doc_id int, text string")).select("doc_id", "name")


@query("SELECT * FROM (VALUES (1, '苏暖'), (1, '赵天豪'), (2, '慕容白走'), (2, '慕容雪'), (4, '方悦')) AS v(doc_id, name)")
def character_names_checked(spark, sf_dir):
    words = spark.createDataFrame([("北方", 900), ("方案", 800)], "term string, freq long")
    return names.names(spark.createDataFrame(CAST, "doc_id int, text string"), words).select("doc_id", "name")


@query("SELECT * FROM (VALUES (1, 'pass', 2.0::DOUBLE, '苏暖,赵天豪'), (2, 'pass', 2.0, '慕容白走,慕容雪'), (3, 'warn', 0.0, ''), (4, 'pass', 2.0, '方悦,方更美')) AS v(doc_id, severity, value, term)")
def name_counts(spark, sf_dir):
    d = spark.createDataFrame(CAST, "doc_id int, text string")
    return names.cast_findings(names.names(d), d).select("doc_id", "severity", "value", "term")


@query("SELECT * FROM (VALUES (1, 0, 1, 1, 0), (2, 2, 0, 0, 0), (4, 0, 0, 0, 2)) AS v(doc_id, compound, strong, medium, weak)")
def name_tiers(spark, sf_dir):
    found = names.tiers(names.names(spark.createDataFrame(CAST, "doc_id int, text string")))
    return found.select("doc_id", *[F.col(c).cast("int").alias(c) for c in ("compound", "strong", "medium", "weak")])


@query("SELECT * FROM (VALUES (1, 'warn', 2.0::DOUBLE, '苏暖 → 苏暖暖, 苏暖 → 苏暖走'), (2, 'warn', 1.0, '慕容白 → 慕容白走')) AS v(doc_id, severity, value, term)")
def name_aliases(spark, sf_dir):
    found = names.alias_findings(names.aliases(spark.createDataFrame(CAST, "doc_id int, text string")))
    return found.select("doc_id", "severity", "value", "term")


SENTENCES_ZH = [(1, "方向你好，好x方"), (2, "你方向"), (3, "abc"), (4, "向你好方向。方方")]
SEGMENTS = [("方向", 50), ("你好", 40), ("好", 10), ("方", 1), ("向你", 1)]


@query("SELECT * FROM (VALUES (1, '方向|你好|好|方'), (2, '你|方向'), (3, ''), (4, '向|你好|方向|方|方')) AS v(id, words)")
def segmented_words(spark, sf_dir):
    cut = segment.segmenter(spark.createDataFrame(SEGMENTS, "term string, freq long"))
    return spark.createDataFrame(SENTENCES_ZH, "id int, text string").select("id", F.array_join(cut(F.col("text")), "|").alias("words"))


# files: a small folder is written, then read by the sources and written by the sinks
FOLDER = {"in/甲/1.txt": "方向你好。", "in/甲/2.txt": "第二篇，" * 400, "in/b/1.txt": "one\r\ntwo\rthree", "in/b/gbk.txt": "短文".encode("gbk"), "in/b/note.md": "no", "in/root.txt": "ignored", "flat/x.txt": b"\xef\xbb\xbfabc\xff", "story.txt": "One. Two!\r\nThree?"}


def _folder(spark) -> str:
    """The files, in a new folder of this machine; for local runs."""
    root = tempfile.mkdtemp(prefix="textlens-files-")
    for name, content in FOLDER.items():
        os.makedirs(os.path.dirname(f"{root}/{name}"), exist_ok=True)
        with open(f"{root}/{name}", "wb") as f:
            f.write(content if isinstance(content, bytes) else content.encode())
    return root


@query("SELECT * FROM (VALUES ('all', '甲', '1.txt', '方向你好。'), ('all', '甲', '2.txt', NULL), ('all', 'b', '1.txt', 'one' || chr(13) || chr(10) || 'two' || chr(13) || 'three'), ('all', 'b', 'gbk.txt', '短文'), ('one', 'b', '1.txt', 'one' || chr(13) || chr(10) || 'two' || chr(13) || 'three'), ('one', 'b', 'gbk.txt', '短文'), ('flat', 'corpus', 'x.txt', chr(65279) || 'abc�')) AS v(scan, category, name, text)")
def scanned_files(spark, sf_dir):
    """All categories, one, and a folder without any; undecodable bytes and other endings. Long texts are left out of the comparison."""
    root = _folder(spark)
    scans = {"all": files.scan(spark, f"{root}/in"), "one": files.scan(spark, f"{root}/in", "b"), "flat": files.scan(spark, f"{root}/flat"), "none": files.scan(spark, f"{root}/in", "c"), "missing": files.scan(spark, f"{root}/no")}
    rows = [d.select(F.lit(k).alias("scan"), "category", X.basename(F.col("path")).alias("name"), F.when(F.length("text") < 100, F.col("text")).alias("text")) for k, d in scans.items()]
    return corpus.union_all(*rows)


@query("SELECT * FROM (VALUES ('small', '甲', '1.txt'), ('large', '甲', '2.txt'), ('flat', 'corpus', 'x.txt'), ('replaced', 'b', '1.txt'), ('replaced', 'b', 'gbk.txt')) AS v(pick, category, name)")
def picked_files(spark, sf_dir):
    """By size in kilobytes; a missing category takes the folder itself."""
    root = _folder(spark)
    picks = {"small": files.pick(spark, f"{root}/in", "甲", 9, 0, 1), "large": files.pick(spark, f"{root}/in", "甲", 9, 1), "flat": files.pick(spark, f"{root}/flat", "甲", 9), "replaced": files.pick(spark, f"{root}/in", "b", 9)}
    return corpus.union_all(*[d.select(F.lit(k).alias("pick"), "category", X.basename(F.col("path")).alias("name")) for k, d in picks.items()])


@query("SELECT 'One. Two!' || chr(10) || 'Three?' AS text")
def story_text(spark, sf_dir):
    return files.story(spark, f"{_folder(spark)}/story.txt").select("text")


def _message(run) -> str:
    try:
        run()
    except (ValueError, FileNotFoundError) as e:
        return type(e).__name__
    return "none"


@query("SELECT * FROM (VALUES ('missing story', 'FileNotFoundError'), ('unknown stage', 'ValueError'), ('known stage', 'none'), ('two documents', 'ValueError'), ('three documents', 'none'), ('source as target', 'ValueError'), ('lexicon too long', 'ValueError')) AS v(kind, error)")
def guards(spark, sf_dir):
    """What stops a run, and what doesn't."""
    three = spark.range(3)
    cases = {
        "missing story": lambda: files.story(spark, "/no/such/story.txt"), "unknown stage": lambda: templates.stage_index("x"), "known stage": lambda: templates.stage_index("优化"),
        "two documents": lambda: corpus.require(three.limit(2)), "three documents": lambda: corpus.require(three), "source as target": lambda: sinks.write_rewritten(three, "/tmp/a.txt", "/tmp/./a.txt"),
        "lexicon too long": lambda: corpus.with_any(three.selectExpr("'a' AS text"), three.selectExpr("string(id) AS term"), most=2),
    }
    return spark.createDataFrame([(k, _message(run)) for k, run in cases.items()], "kind string, error string")


@query("SELECT * FROM (VALUES ('paths', '甲/1.txt'), ('paths', '甲/2.txt'), ('prompts', '人设: P'), ('findings', 'issue length'), ('findings', 'pass template'), ('rewritten', 'One! Two!' || chr(10) || 'Three?'), ('placeholder', 'true'), ('placeholder', 'true'), ('placeholder', 'false'), ('log', 'warn: a'), ('log', 'end'), ('log', 'run of')) AS v(sink, line)")
def written_files(spark, sf_dir):
    """What each sink writes, read back."""
    root = _folder(spark)
    sinks.write_paths(files.scan(spark, f"{root}/in", "甲"), f"{root}/paths")
    sinks.write_prompts(spark.createDataFrame([("人设", "P")], "stage string, prompt string"), f"{root}/prompts")
    found = spark.createDataFrame([("issue", "length"), ("pass", "template")], "severity string, rule string")
    sinks.write_findings(found, f"{root}/findings")
    story = files.story(spark, f"{root}/story.txt")
    sinks.write_rewritten(rewrite.adjusted(story, P, 0.7), f"{root}/rewritten", f"{root}/story.txt")
    put = [sinks.put_placeholder(f"{root}/new/story.txt"), sinks.put_placeholder(f"{root}/new/story.txt"), sinks.put_placeholder(f"{root}/story.txt")]
    sinks.write_log([("warn", "a")], f"{root}/run.log")
    line = lambda d, sink, c: d.select(F.lit(sink).alias("sink"), c.alias("line"))
    kept = spark.createDataFrame([("placeholder", str(x).lower()) for x in put], "sink string, line string")
    return corpus.union_all(
        line(spark.read.text(f"{root}/paths"), "paths", F.regexp_extract("value", "[^/]+/[^/]+$", 0)), line(spark.read.text(f"{root}/prompts"), "prompts", F.concat("stage", F.lit(": "), "value")),
        line(spark.read.parquet(f"{root}/findings"), "findings", F.concat_ws(" ", "severity", "rule")), line(spark.read.parquet(f"{root}/rewritten"), "rewritten", F.col("rewritten")), kept,
        line(spark.read.text(f"{root}/run.log"), "log", F.regexp_replace("value", "^run of .*$", "run of")),
    )


REPORT = [("pass", "dialogue_density", "", 6.66), ("pass", "paragraph_length", "", 12.4), ("issue", "banned_mark", ";", 3.0), ("info", "exclamations_per_sentence", "", 0.12345), ("info", "commas_per_sentence", "", None), ("warn", "aliases", "a → b", 1.0)]


@query("SELECT unnest(['s.txt', repeat('=', 50), 'genre: default', '', 'info (2)', '  exclamations_per_sentence: 0.123', '  commas_per_sentence: -', '', 'pass (2)', '  dialogue_density: 6.7', '  paragraph_length: 12', '', 'warn (1)', '  aliases a → b: 1', '', 'issue (1)', '  banned_mark ;: 3', '', 'total: 2 pass / 1 warn / 1 issue', '']) AS line")
def report_lines(spark, sf_dir):
    """A report's banner, findings by severity with their decimals, and totals."""
    rows = spark.createDataFrame(REPORT, "severity string, rule string, term string, value double").collect()
    return spark.createDataFrame([(x,) for x in sinks.render_report(rows, "s.txt", {"genre": "default"}).split("\n")], "line string")


@query("SELECT * FROM (VALUES ('脑洞', '小说类型=古代,目标受众=女频'), ('人设', ''), ('细纲', 'a=b')) AS v(stage, params)")
def stage_questions(spark, sf_dir):
    """Answers to a stage's own questions, or free pairs; blank ones go."""
    given = {"脑洞": ["古代", "", "女频"], "人设": ["", " "], "细纲": ["a=b", "c=", ""]}
    rows = [(s, ",".join(f"{k}={v}" for k, v in cli.asked(s, lambda _, it=iter(answers): next(it)).items())) for s, answers in given.items()]
    return spark.createDataFrame(rows, "stage string, params string")
