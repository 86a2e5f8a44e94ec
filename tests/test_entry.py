import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")


def test_every_query_is_callable_and_every_sql_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60
    assert all(callable(q) for q in e.queries().values())


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
def test_the_flagship_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(3).count() == 3


def test_the_core_stands_without_the_llm_subpackage(tmp_path):
    shutil.copytree(REPO / "prismarium", tmp_path / "prismarium", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'search_all' in e.queries() and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
    for source in (REPO / "prismarium").rglob("*.py"):
        if "llm" not in source.relative_to(REPO).parts:
            assert "prismarium.llm" not in source.read_text(), source
