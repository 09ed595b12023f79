"""The driver's entry without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = "import __spark_entry__ as e; q = e.queries(); assert 'entropy_by_document' in q and not [n for n in q if n.startswith('op') or n == 'pipeline'], sorted(q); assert set(e.oracle_sql()) <= set(q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_llm(tmp_path, pipeline):
    shutil.copytree(ROOT / "sedimenta", tmp_path / "sedimenta", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * (pipeline and (ROOT / "corpus_pipeline.py").exists()):
        shutil.copy(ROOT / name, tmp_path)
    subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, check=True)
