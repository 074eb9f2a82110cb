"""The entry point with and without the training-data operators and what they need."""

import os
import subprocess
import sys

import pytest

from palimpsest.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
BLOCKED = """
import sys, warnings
class Block:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == %r or name == %r:
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Block())
warnings.simplefilter("ignore")
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), sum(q[:2] == "op" for q in e.queries()))
"""


@pytest.mark.parametrize("name", ["public_tokenizers", "zstandard", "tokenizers", "tiktoken", "xxhash", "regex", "corpus_pipeline", "palimpsest.llm"])
def test_core_queries_stand_without(name):
    out = subprocess.run([sys.executable, "-c", BLOCKED % (name, name)], cwd=ROOT, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr
    assert out.stdout.split() == [str(len(catalog.queries())), str(len(catalog.oracle_sql())), "0"]


def test_other_errors_are_not_swallowed(tmp_path):
    (tmp_path / "corpus_pipeline.py").write_text("raise ValueError('broken')")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=ROOT, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": f"{tmp_path}:{ROOT}", "PYTHONSAFEPATH": "1"})
    assert "broken" in out.stderr
