"""Results to files. Tables go out as Spark writes them; reports of one document are small and written by the driver."""

from __future__ import annotations

import os
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = "[placeholder: replace with the finished text]"


def write_paths(df: DataFrame, path: str) -> None:
    """One path per line."""
    df.select("path").write.mode("overwrite").text(path)


def write_prompts(df: DataFrame, path: str) -> None:
    """Prompts in one folder per stage."""
    df.select("stage", F.col("prompt").alias("value")).write.mode("overwrite").partitionBy("stage").text(path)


def write_findings(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").partitionBy("severity").parquet(path)


def write_rewritten(df: DataFrame, path: str, source: str | None = None) -> None:
    """Rewritten texts, never over what they were read from."""
    if source is not None and os.path.normpath(path) == os.path.normpath(source):
        raise ValueError("a rewritten text goes to a new path")
    df.write.mode("errorifexists").parquet(path)


def report_path(story: str, suffix: str) -> str:
    """``name_suffix.txt`` beside the story, whatever its ending."""
    base = story[: -len(".txt")] if story.endswith(".txt") else story
    return f"{base}_{suffix}.txt"


# Decimals of the values in reports, by rule; whole numbers where none are named.
DECIMALS = {"emotion_density": 1, "dialogue_density": 1, "paragraph_length": 0, "exclamations_per_sentence": 3, "commas_per_sentence": 2}
#: Findings of one report at most.
MOST = 100_000


def _line(r) -> str:
    value = "-" if r["value"] is None else f"{r['value']:.{DECIMALS.get(r['rule'], 0)}f}"
    return f"  {r['rule']}{' ' + r['term'] if r['term'] else ''}: {value}"


def render_report(rows: list, title: str, head: dict | None = None) -> str:
    """Findings of one document as text: a banner with what is known of the document, findings by severity, and how many there are of each."""
    order = {"info": 0, "pass": 1, "warn": 2, "issue": 3}
    out = [title, "=" * 50, *(f"{k}: {v}" for k, v in (head or {}).items())]
    by = {s: [r for r in rows if r["severity"] == s] for s in sorted({r["severity"] for r in rows}, key=lambda s: order.get(s, 9))}
    for severity, own in by.items():
        out += [f"\n{severity} ({len(own)})", *map(_line, own)]
    out.append("\ntotal: " + " / ".join(f"{len(by.get(s, []))} {s}" for s in ("pass", "warn", "issue")))
    return "\n".join(out) + "\n"


def write_report(found: DataFrame, story: str, suffix: str, head: dict | None = None) -> str:
    """Write and print the report of one document; more than ``MOST`` findings are none of one document and an error."""
    rows = found.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a report takes at most {MOST} findings")
    path, report = report_path(story, suffix), render_report(rows, os.path.basename(story), head)
    print(report)
    with open(path, "w", encoding="utf-8") as f:
        f.write(report)
    return path


def put_placeholder(path: str) -> bool:
    """A placeholder where the file is missing, blank or a placeholder already."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            if f.read().strip() not in ("", PLACEHOLDER):
                return False
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(PLACEHOLDER)
    return True


def write_log(lines: list[tuple[str, str]], path: str) -> None:
    """The run's log: a time, level and message a line."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"run of {datetime.now():%Y-%m-%d %H:%M:%S}\n")
        f.writelines(f"{level}: {text}\n" for level, text in lines)
        f.write("end\n")
