"""The entry points, with and without the training-data subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == "weft.llm" or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert set(e.oracle_sql()) <= set(e.queries()) and "bm25_top20" in e.queries() and not any(q.startswith("op") and q[2].isdigit() for q in e.queries())
"""


def test_entry_without_llm():
    subprocess.run([sys.executable, "-c", HIDE], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.columns == ["doc_id", "score"] and out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
