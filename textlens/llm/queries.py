"""The subpackage's registered queries, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, SPACE_RE, finished, let
from . import divergence, langid, lm, mixing, packing, pseudonyms, quality, repeats, runs, setsketch, simhash, topk, warc


#: The queries' key; a deployment passes its own secret.
KEY = "textlens"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of power-of-two lengths."""
    return packing.pack(_table(spark, sf_dir, "documents"), _tokenizer(), with_ids=False)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What remains of every document without passages of smaller documents."""
    return finished(lambda: repeats.remove_repeats(_table(spark, sf_dir, "documents")), "op2-repeats")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return finished(lambda: warc.round_trip(_table(spark, sf_dir, "pages")), "op3-warc")


def op4_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced by pseudonyms, and how many values that were."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, KEY, "text", "kinds").select("doc_id", "text", F.size("kinds").cast("long").alias("n_values"), F.array_join("kinds", ",").alias("kinds"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that are not held out."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = finished(lambda: simhash.near_duplicates(_table(spark, sf_dir, "documents")), "op6-simhash")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much more every document reads like the well-labelled ones than like all."""
    return lm.cross_entropy_difference(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), _tokenizer())


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rules and risk-controlled verdict of every document."""
    out = finished(lambda: quality.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")), "op8-quality")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every twentieth embedding."""
    return topk.top_k(_table(spark, sf_dir, "embeddings")).select("query_id", "rank", "vec_id", "score")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    out = finished(lambda: mixing.mix(_table(spark, sf_dir, "documents")), "op10-mix")
    return out.select("doc_id", "size", "source", "source_size", "target", "taken")


def op11_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by word shingles."""
    return finished(lambda: setsketch.near_copies(_table(spark, sf_dir, "documents")), "op11-setsketch")


def _with_cycles(docs: DataFrame) -> DataFrame:
    """A tenth of the documents, by their ids, get a tail that repeats its own beginning: the known runs of the query."""
    words = F.split(F.btrim(F.coalesce("text", F.lit("")), F.lit(SPACE)), SPACE_RE, -1)
    g = F.floor(F.crc32(F.col("doc_id").cast("string")) / 10)

    def cycled(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        block = F.slice(w, (a + 1).cast("int"), p.cast("int"))
        return F.array_join(F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))), " ")

    return docs.withColumn("text", F.when((F.crc32(F.col("doc_id").cast("string")) % 10 == 0) & (F.btrim("text", F.lit(SPACE)) != ""), let(words, cycled)).otherwise(F.col("text")))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The periodic runs of every document's words, and what remains without their repeats."""
    found = runs.periodic_runs(_with_cycles(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text"))
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", none, lambda y, x: F.when(y.isNull() | more(x, y), x).otherwise(y))
    lines = F.array_join(F.transform("runs", lambda x: F.concat(x["start"], F.lit(","), x["length"], F.lit(","), x["period"], F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that each has above its language."""
    return finished(lambda: divergence.audit(_table(spark, sf_dir, "documents")), "op13-divergence")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_repeats": op2_repeats,
    "op3_warc": op3_warc,
    "op4_pseudonyms": op4_pseudonyms,
    "op5_language_id": op5_language_id,
    "op6_simhash": op6_simhash,
    "op7_cross_entropy": op7_cross_entropy,
    "op8_quality_rules": op8_quality_rules,
    "op9_top_k": op9_top_k,
    "op10_source_mix": op10_source_mix,
    "op11_setsketch": op11_setsketch,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_divergence": op13_divergence,
}

_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""

_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id IS DISTINCT FROM c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 20"""


def _quality_sql() -> str:
    per = lambda a, b, f="100.0::DOUBLE * ": f"CASE WHEN {b} > 0 THEN {f}{a} / {b} ELSE 0.0 END"
    value = {"symbols_per_100_words": per("n_symbols", "n_words"), "dup_lines_per_100_lines": per("n_dup_lines", "n_lines"), "repeat_words_per_100_words": per("n_repeat_words", "n_words"), "chars_per_word": "(" + per("word_chars", "n_words") + ") / 100"}
    rules = list(quality.RULES)
    tests = " UNION ALL ".join(f"SELECT lang, '{r}' AS rule, {c}::DOUBLE AS cutoff, ({value[r]}) > {c} AS hit FROM held" for r in rules for c in quality.RULES[r])
    share = quality.RISK / len(rules)
    hits = ", ".join(f"CASE WHEN ({value[r]}) > (SELECT cutoff FROM cuts c WHERE c.rule = '{r}' AND c.lang IS NOT DISTINCT FROM j.lang) THEN '{r}' END" for r in rules)
    space = "[\\x20\\x09-\\x0D]"
    return f"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
r AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM g SEMI JOIN (SELECT doc_id, s FROM g GROUP BY doc_id, s HAVING count(*) > 1) d ON g.doc_id = d.doc_id AND g.s = d.s) GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{space}', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, ls AS lines, len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w) w LEFT JOIN r ON w.doc_id = r.doc_id),
j AS MATERIALIZED (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
held AS (SELECT * FROM j WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(coalesce(quality, 0)) = 1 AND max(coalesce(toxic, 1)) = 0)),
tests AS (SELECT lang, rule, cutoff, count(*) AS good, count(*) FILTER (hit) AS rejected FROM ({tests}) GROUP BY ALL),
cuts AS (SELECT lang, rule, min(cutoff) AS cutoff FROM tests WHERE rejected < good * {share} AND list_sum(list_transform(range(0, rejected + 1), lambda i: exp(lgamma(good + 1) - CASE WHEN i = 0 THEN 0 ELSE lgamma(i + 1) END - lgamma(good - i + 1) + i * ln({share}) + (good - i) * ln(1 - {share})))) <= {quality.DELTA} / (SELECT count(*) FROM tests) GROUP BY lang, rule),
v AS (SELECT *, array_to_string(list_filter([{hits}], lambda x: x IS NOT NULL), ',') AS rejected_by FROM j)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rejected_by = '' AS kept, rejected_by FROM v"""


_DIVERGENCE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, lang_n, coalesce(x.n, 0) AS n FROM g JOIN k ON g.lang = k.lang LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS MATERIALIZED (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER s + 5 * count(*) OVER s)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (lang_n + 5)) // (sum(lang_n) OVER s + 5 * count(*) OVER s)::HUGEINT AS q FROM c WINDOW s AS (PARTITION BY lang, source)),
v AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN v ON v.lang = a.lang AND v.source = a.source AND v.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value::BIGINT AS value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM u QUALIFY part = 'pair' OR rank <= 50"""

_NEAR_SQL = """
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, len(w) > 0 AS filled, list_distinct(CASE WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM d),
n AS MATERIALIZED (SELECT r, CASE WHEN filled THEN len(s) ELSE 0 END AS n, md5(array_to_string(list_sort(s), chr(10))) AS k FROM s),
c AS MATERIALIZED (SELECT k, min(r) AS c, min(n) AS n FROM n WHERE n > 0 GROUP BY k),
e AS MATERIALIZED (SELECT c, n, hash(unnest(s)) AS h FROM c JOIN s ON s.r = c.c),
l AS MATERIALIZED (SELECT a.c AS a, b.c AS b FROM e a JOIN e b ON a.h = b.h AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
t AS (SELECT a, b FROM l UNION SELECT t.a, l.b FROM t JOIN l ON t.b = l.a),
m AS (SELECT n.r, d.doc_id, n.n, CASE WHEN n.n > 0 THEN least(c.c, coalesce((SELECT min(b) FROM t WHERE t.a = c.c), c.c)) END AS g FROM n JOIN d ON d.r = n.r LEFT JOIN c ON c.k = n.k AND n.n > 0),
o AS (SELECT doc_id, n::BIGINT AS n_shingles, CASE WHEN g IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS component_id FROM m)
SELECT doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o"""

ORACLE_SQL: dict[str, str] = {"op11_setsketch": _NEAR_SQL, "op13_divergence": _DIVERGENCE_SQL, "op3_warc": _WARC_SQL, "op8_quality_rules": _quality_sql(), "op9_top_k": _TOP_SQL}
