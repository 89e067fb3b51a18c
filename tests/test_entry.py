"""The driver's contract, with and without the training-data operators."""

import re
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent

WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tracery.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
from tracery.plans.queries import QUERIES
assert set(e.queries()) == set(e.oracle_sql()) == set(QUERIES)
"""


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_the_operators():
    subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, check=True)


def test_nothing_else_imports_them():
    for f in (ROOT / "tracery").rglob("*.py"):
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(?:from|import)\s.*\bllm\b", f.read_text(), re.M), f
