import os
import shutil
import subprocess
import sys

import __spark_entry__

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["analysis_id", "rule_id", "category", "severity", "confidence", "path", "start_line", "end_line", "subject", "detail", "identity_key"]
    assert found.count() > 0


def test_every_oracle_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_training_operators(tmp_path):
    for name in ("__spark_entry__.py", "lodestone"):
        source = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "lodestone" / "llm", ignore_errors=True)
    run = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, timeout=120).returncode == 0
