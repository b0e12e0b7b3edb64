import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
names, sql = set(entry.queries()), set(entry.oracle_sql())
assert sql <= names, sql - names
own = [n for n in names if n == "pipeline" or n.startswith("op") and n[2].isdigit()]
print(len(names) - len(own), len(own))
"""


@pytest.mark.parametrize("name", ["tidebar.llm", "xxhash", "corpus_pipeline", "nothing_like_this"])
def test_other_queries_stay_where_the_add_on_cannot_be_imported(name):
    done = subprocess.run([sys.executable, "-c", SCRIPT.format(name=name)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    rest, own = map(int, done.stdout.split())
    assert rest > 110
    if name in ("tidebar.llm", "xxhash"):
        assert own == 0
