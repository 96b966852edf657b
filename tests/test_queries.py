"""Every query with a SQL equivalent returns the same rows as DuckDB."""

import pytest

from lanlore.queries import ORACLE, QUERIES

from .compare import connect, differences
from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


#: Fits at the operators' full defaults take minutes here; small fits of the same operators are tested in test_search,
#: test_bundle and test_distributed, and these queries run by `python -m tests.compare`.
FULL_FITS = {n for n in ORACLE if n.startswith(("mod2_", "mod4_", "mod5_", "mod7_", "mod13_"))} | {"snk5_bundle", "snk5_saved_model", "str8_model_reports"}


@pytest.mark.parametrize("name", sorted(set(ORACLE) - FULL_FITS))
def test_matches_sql(spark, duck, name):
    assert differences(spark, duck, QUERIES[name], ORACLE[name], SF) is None


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
