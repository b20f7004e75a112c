"""Registered queries agree with their SQL on the smallest tables."""

import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from nextdist.plans.queries import ORACLES, QUERIES

from compare import same

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() == 3
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", ["k12_corpus_summary", "p5_sliding_windows", "a9_document_level_stats", "h1_level_stats_sorted", "a14_merge_level_stats", "j5_training_batch", "o10_growth_curve", "u3_only_on_one_side"])
def test_query_equals_sql(spark, name):
    ok, said = same(spark, SF, QUERIES[name], ORACLES[name])
    assert ok, said


@pytest.mark.parametrize("gone", ["nextdist.llm", "xxhash", "corpus_pipeline"])
def test_the_core_goes_on_without_the_training_data_operators(gone):
    """A failed import is told of, and nothing else is lost."""
    code = f"import sys; sys.modules['{gone}'] = None; import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"
    here = os.path.dirname(os.path.abspath(entry.__file__))
    got = subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, timeout=120)
    n, pipeline = got.stdout.split()
    assert int(n) >= len(QUERIES) and pipeline == "False" and "WARNING" in got.stderr
