"""Word segmentation by the most probable path through a dictionary, as a column function."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..profiles import ZH
from . import trie


def segmenter(dictionary: DataFrame, most: int = trie.MOST, letters: str = ZH.letters):
    """A column function from text to words for a dictionary ``term, freq`` of at most ``most`` terms (it is held by every worker)."""
    held = dictionary.sparkSession.sparkContext.broadcast(trie.built(dictionary, letters, most))

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = trie.letter_table(letters)
        for texts in batches:
            yield pd.Series(trie.segmented(list(texts), table, *held.value))

    return words


def jieba_segmenter():
    """The same with the jieba package, where it is installed."""
    import jieba

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(jieba.cut(t)) if t is not None else None)

    return words
