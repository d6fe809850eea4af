"""The driver contract: importable with and without the training-data part, names in step with SQL."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and "sessions_window" in e.queries()


def test_core_works_without_the_optional_part(tmp_path):
    for p in ROOT.rglob("*.py"):
        at = p.relative_to(ROOT)
        if "llm" in at.parts or at.name == "corpus_pipeline.py" or at.parts[0].startswith("."):
            continue
        (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / at).write_bytes(p.read_bytes())
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sessions_window' in q and not any(x.startswith('op') for x in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


@pytest.mark.skipif(not SMALL.exists(), reason="no tables here")
def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["session_id", "cwd", "title", "last_ts", "turns"]
    assert e.entry(spark).count() > 0
