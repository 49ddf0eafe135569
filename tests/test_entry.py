"""The entry works without the text operators and without the libraries that they need."""

import os
import subprocess
import sys

import pytest

from roadstats.plans.queries import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.modules.update({{name: None for name in {names}}})
import __spark_entry__ as entry
print(len(entry.queries()), len(entry.oracle_sql()))
"""


@pytest.mark.parametrize("names", [["tiktoken", "public_tokenizers"], ["roadstats.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_blocked_imports(names):
    done = subprocess.run(
        [sys.executable, "-c", CODE.format(names=names)], cwd=REPO, capture_output=True, text=True, check=True
    )
    n, with_sql = map(int, done.stdout.split())
    assert n >= len(QUERIES) and with_sql >= len(QUERIES)
    if names != ["corpus_pipeline"]:
        assert n == with_sql == len(QUERIES)
