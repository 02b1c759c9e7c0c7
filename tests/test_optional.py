"""The entry module works without the training-data subpackage and its pipeline."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys, importlib.abc
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name == "memberrisk.llm" or name.startswith("memberrisk.llm."):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as entry
names = entry.queries()
assert len(names) > 130 and "pipeline" not in names and not any(n.startswith("op1") for n in names)
assert set(entry.oracle_sql()) <= set(names)
"""


def test_entry_without_the_subpackage():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_library_does_not_import_the_subpackage():
    for folder, _, names in os.walk(os.path.join(ROOT, "memberrisk")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    text = open(os.path.join(folder, name), encoding="utf-8").read()
                    assert "memberrisk.llm" not in text and "corpus_pipeline" not in text, name
