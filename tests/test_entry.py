import subprocess
import sys

from .conftest import ROOT


def test_queries_have_sql_of_their_own():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_training_data_folder(tmp_path):
    code = "import sys, importlib.abc\nclass No(importlib.abc.MetaPathFinder):\n    def find_spec(self, n, p=None, t=None):\n        if n.startswith(('palimpsest.llm', 'corpus_pipeline')):\n            raise ModuleNotFoundError(n)\nsys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nassert len(e.queries()) > 60 and not any(k.startswith('op') for k in e.queries()), list(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
