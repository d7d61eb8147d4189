"""Which training queries have SQL, and that the entry works without them."""

import subprocess
import sys
from pathlib import Path

from dqspark.llm import queries

ROOT = Path(__file__).resolve().parents[2]


def test_queries_without_sql_are_tested_by_other_means():
    without = {"op1_secret_forest", "op2_stratified_sharding", "op4_suffix_repeats", "op6_tensored_minhash", "op7_toxicity_gru",
               "op8_curriculum_mixing", "op12_first_fit_packing"}
    assert set(queries.QUERIES) - set(queries.ORACLES) == without and set(queries.ORACLES) <= set(queries.QUERIES)


def test_the_entry_works_where_the_subpackage_cannot_be_imported():
    code = ("import sys; sys.modules['dqspark.llm'] = None; import __spark_entry__ as e; "
            "print(any(n.startswith('op') or n == 'pipeline' for n in e.queries()), len(e.queries()) > 80, set(e.oracle_sql()) == set(e.queries()))")
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["False", "True", "True"], done.stderr
