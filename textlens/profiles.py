"""Language profiles: what a letter, a sentence's end or a comma is, and the word lists of the rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from . import lexicons


@dataclass(frozen=True)
class LanguageProfile:
    """Character classes are bodies of regular-expression brackets."""

    name: str
    letters: str
    ends: str
    period: str
    exclamation: str
    comma: str
    dropped: str  # marks that overlap detection ignores
    quotes: str  # around dialogue
    cues: str  # letters that end a dialogue cue
    not_before_period: str  # no exclamation after these
    headings: tuple[str, ...]  # section headings, tried in order
    heading_counts: tuple[str, ...]
    lists: dict[str, list[str]] = field(default_factory=dict)
    genres: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    context: dict[str, str] = field(default_factory=dict)  # texts of a rendered context

    @property
    def few_letters(self) -> str | None:
        """All letters, if they are few."""
        ends = re.findall(r"(.)-(.)", self.letters)
        if "".join(f"{a}-{z}" for a, z in ends) != self.letters or sum(ord(z) - ord(a) + 1 for a, z in ends) > 500:
            return None
        return "".join(chr(c) for a, z in ends for c in range(ord(a), ord(z) + 1))

    def genre(self, name: str | None) -> dict[str, list[str]]:
        """The genre's lists, or the default's."""
        return self.genres.get(name or "default", self.genres["default"])

    def lexicon(self, spark: SparkSession) -> DataFrame:
        """``profile, list_name, ord, term`` of all lists, those of genres as ``genre/list``."""
        rows = [(self.name, n, i, t) for n, ts in self.lists.items() for i, t in enumerate(ts)]
        rows += [(self.name, f"{g}/{n}", i, t) for g, lists in self.genres.items() for n, ts in lists.items() for i, t in enumerate(ts)]
        return spark.createDataFrame(rows, "profile string, list_name string, ord int, term string")


# The Chinese profile's marks and patterns.
ZH = LanguageProfile(
    name="zh",
    letters="一-鿿",
    ends="。！？",
    period="。",
    exclamation="！",
    comma="，",
    dropped="，。！？：；、",
    quotes='"「」',
    cues="说问道喊叫嚷吧吗呢啊",
    not_before_period="0-9a-zA-Z",
    headings=(r"\n第[一二三四五六七八九十百千\d]+章[：:\s]*", r"(?i)\nChapter\s+\d+", r"\n[一二三四五六七八九十]{1,3}\s*\n", r"\n(?=\d+\n)", r"\n\s*\n\s*\n"),
    heading_counts=(r"(?<=\n)\d+(?=\n)", r"\n第[一二三四五六七八九十百千\d]+章", r"(?i)\nChapter\s+\d+", r"\n[一二三四五六七八九十]{1,3}\s*\n"),
    lists=lexicons.ZH_LISTS,
    genres=lexicons.ZH_GENRES,
    context=lexicons.ZH_CONTEXT,
)

LATIN = LanguageProfile(
    name="latin",
    letters="A-Za-zÀ-ÿ",
    ends=".!?",
    period=".",
    exclamation="!",
    comma=",",
    dropped=",.!?:;",
    quotes='"',
    cues="aeiou",
    not_before_period="0-9",
    headings=(r"\n#+\s*", r"(?i)\nChapter\s+\d+", r"\n\s*\n", r"\n"),
    heading_counts=(r"(?<=\n)\d+(?=\n)", r"(?i)\nChapter\s+\d+", r"\n[IVX]{1,4}\s*\n"),
    lists=lexicons.LATIN_LISTS,
    genres=lexicons.LATIN_GENRES,
    context=lexicons.LATIN_CONTEXT,
)
