import os
import shutil
import subprocess
import sys

from .conftest import ROOT


def test_the_rest_imports_without_the_text_operators(tmp_path):
    shutil.copytree(os.path.join(ROOT, "framewright"), tmp_path / "framewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'lpf_constant' in q and not any(n.startswith('op') for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, check=True)
