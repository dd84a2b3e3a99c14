import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("gone", [{"corpus_pipeline.py"}, set()])
def test_imports_without_the_pipeline_operators(tmp_path, gone):
    """With the folders of those operators gone, the rest still loads, with the pipeline's file there or not."""
    for p in ROOT.iterdir():
        if p.name not in {"strata", ".git"} | gone:
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "strata").mkdir()
    for p in (ROOT / "strata").iterdir():
        if p.name != "llm":
            (tmp_path / "strata" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'kv_get_latest' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, check=True)
