"""Text analytics for document corpora on Spark DataFrames."""

from .profiles import LATIN, ZH, LanguageProfile

__all__ = ["LATIN", "ZH", "LanguageProfile"]
