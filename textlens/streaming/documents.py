"""Per-document operators over streams. None of them keeps state, so they run on a stream of documents as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import corpus, rules
from ..profiles import LanguageProfile


def stream_findings(docs: DataFrame, p: LanguageProfile, genre: str | None = None) -> DataFrame:
    """The checker's findings of a stream ``doc_id, text``."""
    return rules.findings(docs, p, genre)


def stream_healthy(docs: DataFrame, p: LanguageProfile) -> DataFrame:
    return corpus.healthy(docs, p)


def write_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to parquet and end; run it again for what has come since."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
