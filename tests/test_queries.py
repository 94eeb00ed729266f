"""Every query with a SQL twin against it, on the smallest tables."""

from __future__ import annotations

import pytest

from netobs.checks import load
from tests.check_oracles import compare, connect

REGISTRY = load()


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(REGISTRY.QUERIES))
def test_query(spark, duck, sf_dir, name):
    good, note = compare(spark, duck, sf_dir, name, REGISTRY.QUERIES[name], REGISTRY.ORACLES.get(name))
    assert good, note


def test_every_query_has_a_twin():
    assert sorted(REGISTRY.QUERIES) == sorted(REGISTRY.ORACLES)


def test_names_and_twins_need_no_session():
    """A fresh process lists all queries and twins before any session starts."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries()); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True)
    assert done.stdout.strip() == "fine", done.stderr


def test_entry_imports_without_the_corpus_package(tmp_path):
    """The other queries stay when ``netobs/llm`` and ``corpus_pipeline.py`` are gone."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{root}/netobs", tmp_path / "netobs", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import re, __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(re.match(r'op\\d+_|pipeline', x) for x in q); print('fine')"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": ""})
    assert done.stdout.strip() == "fine", done.stderr
