"""Every registered query beside its SQL."""

import pytest

import check
import __spark_entry__ as entry
from lurewatch.catalog.oracles import ORACLES
from lurewatch.catalog.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    return check.connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, sf, name):
    assert check.compare(spark, db, sf, name) is None


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    rows = entry.entry(spark)
    assert {"msg_id", "result", "risk_level", "tier_used"} <= set(rows.columns)


def test_a_missing_dependency_leaves_the_other_queries(tmp_path):
    """In a process of its own, without the modules that only the optional subpackage needs."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['ahocorasick'] = None; sys.modules['tokenizers'] = None\n"
            "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))")
    out = subprocess.run([sys.executable, "-c", code], cwd=entry.os.path.dirname(entry.__file__), capture_output=True, text=True)
    assert out.stdout.split() == [str(len(QUERIES)), str(len(ORACLES))], out.stderr
