"""Quality rules that emit findings by severity.

Measures are one narrow projection a document; findings are rows ``doc_id, severity, rule, term, value``, made by one
``inline`` over an array, so a corpus is audited without a shuffle. Thresholds use unrounded values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..profiles import LanguageProfile

# Severities; the thresholds stand in the rules below.
ISSUE, WARN, PASS = "issue", "warn", "pass"


def measures(p: LanguageProfile, genre: str | None, t: Column) -> dict[str, Column]:
    """Everything that some rule looks at, by name."""
    g, lists = p.genre(genre), p.lists
    counts = lambda name: F.array(*[X.literal_count(t, k) for k in lists[name]])
    end = X.tail(t)

    def of_sections(s: Column) -> Column:
        return F.struct(F.size(s).cast("long").alias("n"), X.total_count(X.first_sections(s), g["climax"]).alias("climax"), X.contains_any(F.element_at(s, 1), g["setup"]).alias("setup"))

    return {
        "letters": X.letter_count(t, p), "sentences": X.sentence_count(t, p), "exclamations": X.literal_count(t, p.exclamation), "commas": X.literal_count(t, p.comma),
        "marks": counts("banned_marks"), "quotes": X.quote_tally(t), "templates": counts("templates_check"), "thinking": counts("thinking"), "templates_audit": counts("templates_audit"), "patterns_audit": counts("patterns_audit"),
        "sections": X.bind(X.sections(t, p), of_sections), "emotion": X.total_count(t, g["emotion"]), "open": X.total_count(end, lists["open_endings"]), "power": X.total_count(end, lists["ending_power"]),
        "dialogue": X.dialogue_spans(t, p) + X.dialogue_cues(t, p), "paragraphs": X.paragraph_stats(t), "corner_quotes": F.regexp_count(t, F.lit("[「」]")).cast("long"),
    }


def measured(df: DataFrame, p: LanguageProfile, genre: str | None = None, id_col: str = "doc_id", text_col: str = "text", only: tuple[str, ...] | None = None) -> DataFrame:
    """``doc_id`` and the struct ``m`` of what the rules look at, or of ``only`` some of it."""
    all_of = measures(p, genre, F.col(text_col))
    m = F.struct(*[all_of[k].alias(k) for k in only or all_of])
    # bound, so that the optimizer doesn't compute a field again for each rule that reads it
    return df.select(F.col(id_col).alias("doc_id"), X.bind(m, lambda x: x).alias("m"))


def _finding(severity: Column | str, rule: str, value: Column, term: str = "", when: Column | None = None) -> Column:
    s = severity if isinstance(severity, Column) else F.lit(severity)
    row = F.struct(s.alias("severity"), F.lit(rule).alias("rule"), F.lit(term).alias("term"), value.cast("double").alias("value"))
    return row if when is None else F.when(when, row)


def _ladder(*steps: tuple[Column, str], otherwise: str) -> Column:
    out = None
    for condition, severity in steps:
        out = F.when(condition, severity) if out is None else out.when(condition, severity)
    return out.otherwise(otherwise)


def check_rules(p: LanguageProfile) -> list[Column]:
    """The checker's rules over ``m``; null where a rule is silent."""
    m = F.col("m")
    letters, sec, par = m["letters"], m["sections"], m["paragraphs"]
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    per = lambda n, unit: n / (F.nullif(letters, F.lit(0)) / F.lit(float(unit)))
    each = lambda severity, rule, c, name: [_finding(severity, rule, c[i], k, c[i] > 0) for i, k in enumerate(p.lists[name])]
    marks, quotes = total(m["marks"]), m["quotes"]["double"] + m["quotes"]["single"]
    emotion, dialogue, average = per(m["emotion"], 300), per(m["dialogue"], 100), par["chars"] / F.nullif(par["n"], F.lit(0))
    thinking = total(m["thinking"])
    return [
        _finding(_ladder((letters < 1000, ISSUE), (letters > 50000, WARN), otherwise=PASS), "length", letters),
        *each(ISSUE, "banned_mark", m["marks"], "banned_marks"),
        _finding(WARN, "ascii_quotes", quotes, when=quotes > 0),
        _finding(PASS, "punctuation", F.lit(0), when=(marks == 0) & (quotes == 0)),
        *each(ISSUE, "template", m["templates"], "templates_check"),
        _finding(PASS, "template", F.lit(0), when=total(m["templates"]) == 0),
        *each(WARN, "thinking", m["thinking"], "thinking"),
        _finding(ISSUE, "thinking_total", thinking, when=thinking > 5),
        _finding(PASS, "thinking_total", thinking, when=thinking == 0),
        _finding(WARN, "sections", sec["n"], when=sec["n"] < 3),
        _finding(_ladder((sec["climax"] < 1, WARN), otherwise=PASS), "climax", sec["climax"], when=sec["n"] >= 3),
        _finding(_ladder((sec["setup"], PASS), otherwise=WARN), "setup", sec["setup"].cast("int"), when=sec["n"] >= 3),
        _finding(_ladder((emotion < 0.5, WARN), otherwise=PASS), "emotion_density", emotion, when=letters > 0),
        _finding(ISSUE, "open_ending", m["open"], when=m["open"] > 0),
        _finding(_ladder((m["power"] == 0, WARN), otherwise=PASS), "ending_power", m["power"]),
        _finding(_ladder((dialogue < 1.5, WARN), otherwise=PASS), "dialogue_density", dialogue, when=letters > 0),
        _finding(WARN, "long_paragraph", par["long"], when=par["long"] > 0),
        _finding(_ladder((average > 80, WARN), otherwise=PASS), "paragraph_length", average, when=par["n"] > 0),
    ]


#: What each set of rules looks at; nothing else is measured for it.
check_rules.reads = ("letters", "marks", "quotes", "templates", "thinking", "sections", "emotion", "open", "power", "dialogue", "paragraphs")


def audit_rules(p: LanguageProfile) -> list[Column]:
    """The audit's rules: a header of measures, then bans; one pass row if nothing is found."""
    m = F.col("m")
    ratio = lambda n: n / F.nullif(m["sentences"], F.lit(0))
    hit = lambda rule, c, name: [_finding(ISSUE, rule, c[i], k, c[i] > 0) for i, k in enumerate(p.lists[name])]
    bans = [*hit("banned_mark", m["marks"], "banned_marks"), _finding(ISSUE, "corner_quotes", m["corner_quotes"], when=m["corner_quotes"] > 0), *hit("banned_pattern", m["patterns_audit"], "patterns_audit"), *hit("template", m["templates_audit"], "templates_audit")]
    clean = F.forall(F.array(*bans), lambda x: x.isNull())
    info = [_finding("info", "letters", m["letters"]), _finding("info", "sentences", m["sentences"]), _finding("info", "exclamations_per_sentence", ratio(m["exclamations"])), _finding("info", "commas_per_sentence", ratio(m["commas"]))]
    return [*info, *bans, _finding(PASS, "fixed_rules", F.lit(0), when=clean)]


audit_rules.reads = ("letters", "sentences", "exclamations", "commas", "marks", "templates_audit", "patterns_audit", "corner_quotes")


def _rows(df: DataFrame, p: LanguageProfile, genre: str | None, id_col: str, text_col: str, rules) -> DataFrame:
    return measured(df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))), p, genre, id_col, text_col, getattr(rules, "reads", None))


def _present(rules: list[Column]) -> Column:
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def findings(df: DataFrame, p: LanguageProfile, genre: str | None = None, rules=check_rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, severity, rule, term, value`` of every document; null texts are empty."""
    # the array stands inside: as a column of its own the optimizer would filter by it, and so compute it twice
    return _rows(df, p, genre, id_col, text_col, rules).select("doc_id", F.inline(_present(rules(p))))


def totals(df: DataFrame, p: LanguageProfile, genre: str | None = None, rules=check_rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, passes, warns, issues`` of every document, counted in its own row."""
    n = lambda s, name: F.size(F.filter(F.col("s"), lambda x: x == s)).cast("long").alias(name)
    severities = X.bind(F.transform(_present(rules(p)), lambda x: x["severity"]), lambda s: s)
    return _rows(df, p, genre, id_col, text_col, rules).select("doc_id", severities.alias("s")).select("doc_id", n(PASS, "passes"), n(WARN, "warns"), n(ISSUE, "issues"))


def reports(df: DataFrame, p: LanguageProfile, head: dict[str, str] | None = None, decimals: dict[str, int] | None = None, genre: str | None = None, rules=check_rules, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, report``: each document's findings as one text, made in its own row.

    A banner with the id and ``head``, findings by severity in the order of the rules, and how many there are of each.
    Values have the ``decimals`` of their rule, half up, none where none are named.
    """

    def shown(x: Column) -> Column:
        out = F.floor(x["value"] + 0.5).cast("string")
        for rule, places in (decimals or {}).items():
            if places:
                n = F.floor(x["value"] * 10**places + 0.5)
                out = F.when(x["rule"] == rule, F.concat(F.floor(n / 10**places).cast("string"), F.lit("."), F.lpad((n % 10**places).cast("string"), places, "0"))).otherwise(out)
        return F.coalesce(out, F.lit("-"))

    line = lambda x: F.concat(F.lit("  "), x["rule"], F.when(x["term"] == "", "").otherwise(F.concat(F.lit(" "), x["term"])), F.lit(": "), shown(x))

    def block(s: str) -> Column:
        own = F.filter("found", lambda x: x["severity"] == s)
        return X.bind(own, lambda f: F.when(F.size(f) > 0, F.concat(F.lit(f"\n{s} ("), F.size(f).cast("string"), F.lit(")\n"), F.array_join(F.transform(f, line), "\n"))))

    count = lambda s: F.concat(F.size(F.filter("found", lambda x: x["severity"] == s)).cast("string"), F.lit(f" {s}"))
    rows = _rows(df, p, genre, id_col, text_col, rules).select("doc_id", X.bind(_present(rules(p)), lambda x: x).alias("found"))
    banner = [F.col("doc_id").cast("string"), F.lit("=" * 50), *[F.lit(f"{k}: {v}") for k, v in (head or {}).items()]]
    total = F.concat(F.lit("\ntotal: "), F.concat_ws(" / ", *map(count, (PASS, WARN, ISSUE))), F.lit("\n"))
    return rows.select("doc_id", F.concat_ws("\n", *banner, *map(block, ("info", PASS, WARN, ISSUE)), total).alias("report"))
