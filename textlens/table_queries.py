"""Registered queries that run templates, parameters, comma cleaning, file sources, sinks and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as X
from . import lexicons as L
from .operators import fingerprint, names, rewrite, rules, templates
from .profiles import LATIN as P
from .queries import BAG, BODY, FIRST, LETTER, MARK, STRIP, docs, finding_rows, q, query, table, text_, written_corpus
from .sources import corpus as files
from .sources import files as source
from .sources import sinks

# every document as a template file: a section named by its source, with two parts, and another section
_HEAD, _MIDDLE, _TAIL = "intro\n<!-- FILE_SECTION: ", " -->\n", "\n---\n second part \n<!-- FILE_SECTION: other -->\nX"
_CONTENT = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'none' ELSE source END AS name, {q(_HEAD)} || source || {q(_MIDDLE)} || text || {q(_TAIL)} AS content FROM documents"
_SECTIONS = f"SELECT doc_id, contains(content, {MARK}) AS found, {BODY} AS body FROM ({_CONTENT})"


def _sections(spark, sf_dir) -> DataFrame:
    content = F.concat(F.lit(_HEAD), F.col("source"), F.lit(_MIDDLE), "text", F.lit(_TAIL))
    named = docs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "none").otherwise(F.col("source")).alias("name"), content.alias("content"))
    return named.select("doc_id", templates.section(F.col("content"), F.col("name")).alias("s"))


@query(f"SELECT doc_id, found, md5(body) AS body FROM ({_SECTIONS})")
def document_sections(spark, sf_dir):
    """The section of its source in every document's template; the whole template where it has no such section."""
    return _sections(spark, sf_dir).select("doc_id", "s.found", F.md5("s.body").alias("body"))


_KEYWORD = f"coalesce({STRIP('list_filter(string_split(body, ' + q('---') + '), lambda x: contains(x, ' + q('the') + '))[1]')}, {FIRST})"


@query(f"SELECT doc_id, md5({FIRST}) AS first, md5({_KEYWORD}) AS keyed FROM ({_SECTIONS})")
def document_templates(spark, sf_dir):
    """The first template of each, and the first with a keyword."""
    s = _sections(spark, sf_dir)
    found, body = F.col("s.found"), F.col("s.body")
    return s.select("doc_id", F.md5(templates.first_template(found, body)).alias("first"), F.md5(templates.keyword_template(found, body, F.lit("the"))).alias("keyed"))


_JSON = """CASE doc_id % 4 WHEN 0 THEN '{"lang": "' || lang || '", "source": "' || source || '"}' WHEN 1 THEN '{"lang": ' WHEN 2 THEN '{"lang": "", "n": ' || n_chars || '}' ELSE '{}' END"""


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'lang=' || lang || ',source=' || source || ',z=9' WHEN 2 THEN 'lang=xx,n=' || n_chars || ',z=9' ELSE 'lang=xx,z=9' END AS merged FROM documents")
def document_params(spark, sf_dir):
    """Parameters of every document, some malformed or blank, merged over the defaults."""
    base = F.create_map(F.lit("lang"), F.lit("xx"), F.lit("z"), F.lit("9"))
    rows = docs(spark, sf_dir).select("doc_id", X.merged_params(base, X.json_params(F.expr(_JSON))).alias("m"))
    return rows.select("doc_id", F.array_join(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",").alias("merged"))


_COMMAS = f"""
WITH b AS (SELECT regexp_replace(text, '[^{P.letters}]+', ' ', 'g') AS t FROM benchmark),
g AS (SELECT substring(t, i, n) AS term FROM (SELECT t, unnest(range(1, length(t) + 1)) AS i FROM b), (VALUES (1), (2)) AS v(n)),
f AS (SELECT term, count(*) AS freq FROM g WHERE regexp_full_match(term, '{LETTER}+') GROUP BY term),
z AS (SELECT sum(freq) AS total FROM f),
w AS (SELECT list(p.term) AS pairs FROM f p LEFT JOIN f x ON x.term = left(p.term, 1) LEFT JOIN f y ON y.term = right(p.term, 1), z WHERE length(p.term) = 2 AND ln(p.freq) - ln(total) >= ln(coalesce(x.freq, 1)) + ln(coalesce(y.freq, 1)) - 2 * ln(total)),
d AS (SELECT doc_id, replace(text, ' ', '') AS t, string_split(replace(text, ' ', ''), ',') AS s FROM documents),
c AS (SELECT doc_id, t, array_to_string(list_transform(range(1, len(s) + 1), lambda i: s[i] || CASE WHEN i = len(s) OR list_contains(pairs, right(s[i], 1) || left(s[i + 1], 1)) THEN '' ELSE ',' END), '') AS c FROM d, w)
SELECT doc_id, md5(c) AS cleaned, (length(t) - length(c))::BIGINT AS removed FROM c"""


@query(_COMMAS)
def cleaned_documents(spark, sf_dir):
    """Documents without spaces: commas go where the letters around them are a likely pair, by the benchmark's letters and pairs."""
    t = F.regexp_replace("text", f"[^{P.letters}]+", " ")
    of_size = lambda n: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substr(t, i, F.lit(n)))
    places = table(spark, sf_dir, "benchmark").select(F.explode(F.array(of_size(1), of_size(2))).alias("x"))
    pieces = places.select(F.explode("x").alias("term")).where(F.col("term").rlike(f"^{LETTER}+$"))
    bare = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(" "), F.lit("")).alias("text"))
    pairs = bare.select(F.explode(rewrite.comma_pairs(text_(), P)).alias("pair")).distinct()
    likely = rewrite.one_word(pieces.groupBy("term").agg(F.count("*").alias("freq")), pairs)
    return rewrite.clean_commas(bare, P, likely).select("doc_id", F.md5("cleaned").alias("cleaned"), "removed")


@query("SELECT lang AS category, doc_id || '.txt' AS name, octet_length(encode(text))::BIGINT AS length, md5(text) AS content FROM documents")
def scanned_documents(spark, sf_dir):
    """Every document as a file, by the scan of folders."""
    found = files.scan(spark, written_corpus(spark, sf_dir))
    return found.select("category", X.basename(F.col("path")).alias("name"), "length", F.md5("text").alias("content"))


@query("SELECT lang AS category, doc_id || '.txt' AS name FROM documents WHERE lang = 'de' AND octet_length(encode(text)) BETWEEN 1024 AND 8192")
def picked_documents(spark, sf_dir):
    """All files of one language between one and eight kilobytes."""
    return files.pick(spark, written_corpus(spark, sf_dir), "de", 10**6, 1, 8).select("category", X.basename(F.col("path")).alias("name"))


_ROWS = " UNION ALL ".join(f"SELECT *, {i} AS o FROM ({row})" for i, row in enumerate(finding_rows()[1]))


@query(f"{finding_rows()[0]} SELECT severity, rule, term, count(*)::BIGINT AS documents, max(value) AS most FROM ({_ROWS}) GROUP BY ALL")
def written_findings(spark, sf_dir):
    """All findings written by severity, read back and counted."""
    folder = source.scratch(spark, "findings")
    sinks.write_findings(rules.findings(docs(spark, sf_dir), P), folder)
    return spark.read.parquet(folder).groupBy("severity", "rule", "term").agg(F.count("*").alias("documents"), F.max("value").alias("most"))


def _report_sql() -> str:
    n = "floor(value * 10 + 0.5)::BIGINT"
    tenths = f"(({n}) // 10)::VARCHAR || '.' || (({n}) % 10)::VARCHAR"
    shown = f"CASE WHEN value IS NULL THEN '-' WHEN rule IN ('emotion_density', 'dialogue_density') THEN {tenths} ELSE floor(value + 0.5)::BIGINT::VARCHAR END"
    order = "list_position(['info', 'pass', 'warn', 'issue'], severity)"
    total = " || ' / ' || ".join(f"count(*) FILTER (severity = '{s}')::VARCHAR || ' {s}'" for s in ("pass", "warn", "issue"))
    return f"""{finding_rows()[0]},
r AS (SELECT *, {order} AS s FROM ({_ROWS})),
g AS (SELECT doc_id, s, severity, chr(10) || severity || ' (' || count(*) || ')' || chr(10) || string_agg('  ' || rule || CASE WHEN term = '' THEN '' ELSE ' ' || term END || ': ' || {shown}, chr(10) ORDER BY o) AS block FROM r GROUP BY doc_id, s, severity),
b AS (SELECT doc_id, string_agg(block, chr(10) ORDER BY s) AS blocks FROM g GROUP BY doc_id),
t AS (SELECT doc_id, {total} AS total FROM r GROUP BY doc_id)
SELECT doc_id, md5(doc_id::VARCHAR || chr(10) || repeat('=', 50) || chr(10) || 'genre: default' || chr(10) || blocks || chr(10) || chr(10) || 'total: ' || total || chr(10)) AS report FROM b JOIN t USING (doc_id)"""


@query(_report_sql())
def document_reports(spark, sf_dir):
    """The checker's report of every document, made in its own row."""
    found = rules.reports(docs(spark, sf_dir), P, {"genre": "default"}, sinks.DECIMALS)
    return found.select("doc_id", F.md5("report").alias("report"))


_BY_SOURCE = f"SELECT source AS category, term, count(*) AS docs, any_value(of) AS of FROM ({BAG}) JOIN documents USING (doc_id) JOIN (SELECT source, count(*) AS of FROM documents GROUP BY source) USING (source) GROUP BY source, term"


@query(f"SELECT category, term, docs::BIGINT AS docs, of::BIGINT AS of FROM ({_BY_SOURCE}) WHERE docs * 5 >= of * 3")
def common_by_source(spark, sf_dir):
    """Terms that three of five documents of a source have, of all its documents."""
    return fingerprint.common_terms(fingerprint.category_terms(docs(spark, sf_dir), P, category_col="source"))


@query(f"SELECT any_value(category) AS category, term, sum(docs)::BIGINT AS docs FROM ({_BY_SOURCE}) GROUP BY term HAVING count(*) = 1 AND sum(docs) >= 3")
def terms_of_one_source(spark, sf_dir):
    """Terms of three documents or more that all lie in one source."""
    return fingerprint.terms_of_one(fingerprint.category_terms(docs(spark, sf_dir), P, category_col="source"))

# documents in Han letters: each Latin letter becomes one, so that surnames, verbs of speech and marks stand in every text
_FROM = "etaoinshrdlucmfpgwybvkxqjz"
_TO = "说慕天明雪海笑容风山林水苏李月白星赵云石竹松兰梅金华"
_HAN = f"translate(replace(text, ' ', ''), {q(_FROM + _FROM.upper() + '.,')}, {q(_TO * 2 + '。，')})"
_SURE, _WEAK, _COMPOUND = L.STRONG_SURNAMES + L.MEDIUM_SURNAMES, L.WEAK_SURNAMES, "|".join(L.COMPOUND_SURNAMES)
# what a name stands before is marked, as the patterns here can't look ahead; a mark may stand inside a name
_NAMED = [rf"((?:{_COMPOUND})\x01?H)\x01", rf"((?:{_COMPOUND})\x01?H\x01?H)\x01", rf"([{_SURE}]\x01?H)\x01", rf"([{_SURE}]\x01?H\x01?H)\x01", rf"([{_WEAK}]\x01?H\x01?H)\x01", rf"(?:^|[^一-鿿\x01])([{_WEAK}]\x01?H)\x01"]
_FOUND = " || ".join(f"regexp_extract_all(m, {q(x.replace('H', '[一-鿿]'))}, 1)" for x in _NAMED)
_NAMES = f"""
d AS MATERIALIZED (SELECT doc_id, {_HAN} AS t FROM documents),
m AS (SELECT doc_id, t, regexp_replace(t, {q("([" + L.NAME_CONTEXT + "])")}, chr(1) || '\\1', 'g') AS m FROM d),
c AS (SELECT DISTINCT doc_id, t, replace(unnest({_FOUND}), chr(1), '') AS n FROM m),
g AS (SELECT doc_id, n, (length(t) - length(replace(t, n, ''))) // length(n) AS times, regexp_matches(n, '^(?:{_COMPOUND})') AS compound FROM c
  WHERE NOT (length(n) IN (2, 3) AND (regexp_matches(substring(n, 2, 1), '^[{L.UNLIKELY_SECOND}]') OR length(n) = 3 AND (regexp_matches(substring(n, 2, 1), '^[{L.NUMERALS}]') OR substring(n, 1, 1) = substring(n, 2, 1))))
  AND NOT (length(n) = 2 AND regexp_matches(n, '^[{_SURE}{_WEAK}]{{2}}'))),
n AS (SELECT doc_id, n AS name, times::BIGINT AS times FROM g QUALIFY row_number() OVER (PARTITION BY doc_id, left(n, CASE WHEN compound THEN 3 ELSE 2 END) ORDER BY regexp_matches(right(n, 1), '^[{L.SPEECH_TAIL}]'), times DESC, length(n) DESC, n DESC) = 1)"""


def _han(spark, sf_dir) -> DataFrame:
    return docs(spark, sf_dir).select("doc_id", F.translate(F.replace("text", F.lit(" "), F.lit("")), _FROM + _FROM.upper() + ".,", _TO * 2 + "。，").alias("text"))


@query(f"WITH {_NAMES} SELECT doc_id, name, times FROM n")
def document_names(spark, sf_dir):
    """The names in every document's Han letters, one of each group that starts alike, with how often they occur."""
    return names.names(_han(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT doc_id, count(*) FILTER (regexp_matches(name, '^(?:{_COMPOUND})'))::BIGINT AS compound, count(*) FILTER (regexp_matches(name, '^[{L.STRONG_SURNAMES}]'))::BIGINT AS strong, count(*) FILTER (regexp_matches(name, '^[{L.MEDIUM_SURNAMES}]'))::BIGINT AS medium, count(*) FILTER (regexp_matches(name, '^[{_WEAK}]'))::BIGINT AS weak FROM n GROUP BY doc_id")
def document_name_tiers(spark, sf_dir):
    """How many names of each kind of surname every document has."""
    return names.tiers(names.names(_han(spark, sf_dir)))


@query(f"""WITH {_NAMES}, k AS (SELECT doc_id, count(*) AS k, array_to_string(list_sort(list(name))[1:8], ',') AS term FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(k, 0) BETWEEN 1 AND 10 THEN 'pass' ELSE 'warn' END AS severity, coalesce(k, 0)::DOUBLE AS value, coalesce(term, '') AS term FROM documents LEFT JOIN k USING (doc_id)""")
def document_casts(spark, sf_dir):
    """The finding on every document's cast."""
    d = _han(spark, sf_dir)
    return names.cast_findings(names.names(d), d).select("doc_id", "severity", "value", "term")
