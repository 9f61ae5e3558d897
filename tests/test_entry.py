"""The entry without the training-data operators, or what they need."""

import subprocess
import sys

from tests.conftest import ROOT

RUN = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {missing!r} or name in {missing!r}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
names = set(e.queries())
assert set(e.oracle_sql()) <= names
print(len([n for n in names if n.startswith("op") or n == "pipeline"]), len(names))
"""


def _run(*missing):
    done = subprocess.run([sys.executable, "-c", RUN.format(missing=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    return done


def test_audits_stay_without_the_operators_or_their_modules():
    for missing in ("tillscope.llm", "corpus_pipeline", "public_tokenizers"):
        done = _run(missing)
        assert done.returncode == 0, done.stderr
        llm, every = map(int, done.stdout.split())
        assert llm == 0 and every >= 60 and "no module" in done.stderr


def test_a_missing_core_module_is_an_error():
    done = _run("tillscope.operators")
    assert done.returncode and "tillscope.operators" in done.stderr
