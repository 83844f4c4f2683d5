import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_flagship_and_names(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["doc_id", "item_id", "matches"] and df.count() == 3
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_base_stands_without_the_optional_part(tmp_path):
    shutil.copytree(ROOT, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".*"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 40 and not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and set(e.oracle_sql()) == set(e.queries())"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
