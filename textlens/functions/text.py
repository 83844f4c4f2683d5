"""Column functions over a document's text. All stay in the JVM; lengths and positions count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..profiles import LanguageProfile


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once even where ``body`` uses it in lambdas."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def letter(p: LanguageProfile) -> str:
    return f"[{p.letters}]"


def letter_count(t: Column, p: LanguageProfile) -> Column:
    """By what goes when letters go: looked up one by one where there are few, else matched as runs."""
    rest = F.translate(t, p.few_letters, "") if p.few_letters else F.regexp_replace(t, letter(p) + "+", "")
    return (F.length(t) - F.length(rest)).cast("long")


def literal_count(t: Column, k: str) -> Column:
    """Non-overlapping occurrences of a literal, by bytes, which need no pass over the text to be counted."""
    return ((F.octet_length(t) - F.octet_length(F.replace(t, F.lit(k), F.lit("")))) / len(k.encode())).cast("long")


def total_count(t: Column, terms: list[str]) -> Column:
    """Sum over terms; a term inside another counts for both."""
    total = F.lit(0).cast("long")
    for k in terms:
        total = total + literal_count(t, k)
    return total


def contains_any(t: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for k in terms:
        out = out | F.contains(t, F.lit(k))
    return out


def sentences(t: Column, p: LanguageProfile) -> Column:
    """Pieces between sentence ends that have a letter."""
    return F.filter(F.split(t, f"[{p.ends}]", -1), lambda s: s.rlike(letter(p)))


def sentence_count(t: Column, p: LanguageProfile) -> Column:
    return F.size(sentences(t, p)).cast("long")


def sentence_pieces(t: Column, p: LanguageProfile) -> Column:
    """Pieces with their ends kept; joined they give the text again."""
    return F.split(t, f"(?<=[{p.ends}])", -1)


def per_sentence(n: Column, sentence_n: Column) -> Column:
    """A raw ratio; no sentence counts as one."""
    return n / F.greatest(sentence_n, F.lit(1))


# White space of any script.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(s: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.btrim(s, F.lit(WHITE))


def quote_in_head(t: Column, letters: Column) -> Column:
    """An ASCII double quote in the first ``letters / 2`` characters."""
    return F.contains(F.left(t, F.floor(letters / 2).cast("int")), F.lit('"'))


def opening_lines(t: Column, p: LanguageProfile, n: int = 30) -> Column:
    """The first stripped lines that aren't blank, rules of ``=`` or boilerplate."""
    lines = F.transform(F.split(t, "\n", -1), strip)
    keep = F.filter(lines, lambda s: (s != "") & ~s.startswith("=") & ~contains_any(s, p.lists["boilerplate"]))
    return F.array_join(F.slice(keep, 1, n), "\n")


def head_letters(t: Column, letters: Column, p: LanguageProfile) -> Column:
    """The letters of the first ``2 * letters`` characters."""
    return F.regexp_replace(F.left(t, (letters * 2).cast("int")), f"[^{p.letters}]", "")


def normalised(t: Column, p: LanguageProfile) -> Column:
    """For overlap: without marks, white space and digits of any script."""
    return F.regexp_replace(t, rf"(?U)[{p.dropped}\s\d]", "")


def heading_counts(t: Column, p: LanguageProfile) -> Column:
    """Matches of each heading pattern."""
    return F.array(*[F.regexp_count(t, F.lit(h)).cast("long") for h in p.heading_counts])


def sections(t: Column, p: LanguageProfile) -> Column:
    """Split by the first heading pattern that the text has (each takes characters, so a match gives two pieces); by the last one if it has none.

    A pattern is looked for up to its first match, and only one of them splits the text.
    """
    out = F.split(t, p.headings[-1], -1)
    for h in reversed(p.headings[:-1]):
        out = F.when(t.rlike(h), F.split(t, h, -1)).otherwise(out)
    return out


def first_sections(pieces: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(pieces, 1, n), "")


def tail(t: Column, n: int = 300) -> Column:
    return F.right(t, F.lit(n))


def paragraphs(t: Column) -> Column:
    return F.filter(F.transform(F.split(t, "\n", -1), strip), lambda s: s != "")


def paragraph_stats(t: Column, long: int = 200) -> Column:
    """``struct(n, long, chars)`` of the paragraphs: how many, how many beyond ``long`` characters, and all their characters."""

    def of(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n"), F.size(F.filter(x, lambda s: F.length(s) > long)).cast("long").alias("long"), F.aggregate(x, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("chars"))

    return bind(paragraphs(t), of)


def dialogue_spans(t: Column, p: LanguageProfile) -> Column:
    q = p.quotes
    return F.regexp_count(t, F.lit(f"[{q}][^{q}]{{1,50}}[{q}]")).cast("long")


def dialogue_cues(t: Column, p: LanguageProfile) -> Column:
    return F.regexp_count(t, F.lit(rf"[{p.ends}\n][^{p.ends}\n]*?[{p.cues}]")).cast("long")


def quote_tally(t: Column) -> Column:
    """``struct(double, single, detail)`` of the ASCII quotes."""
    d, s = literal_count(t, '"'), literal_count(t, "'")
    part = lambda n, label: F.when(n > 0, F.concat(F.lit(label), n.cast("string")))
    return F.struct(d.alias("double"), s.alias("single"), F.concat_ws(" + ", part(d, "double "), part(s, "single ")).alias("detail"))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def newlines(t: Column) -> Column:
    """``\\n`` for every kind of line end."""
    return F.regexp_replace(t, "\r\n?", "\n")


def escaped(literal: Column) -> Column:
    """A pattern that matches the literal."""
    return F.concat(F.lit(r"\Q"), F.replace(literal, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def merged_params(a: Column, b: Column) -> Column:
    """Two string maps; on equal keys the right one wins."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def json_params(j: Column) -> Column:
    """A string map of a JSON object; malformed input is an empty map, blank values go."""
    none = F.create_map().cast("map<string,string>")
    return F.map_filter(F.coalesce(F.from_json(j, "map<string,string>"), none), lambda k, v: v.isNotNull() & (v != ""))
