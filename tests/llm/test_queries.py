"""Every query that SQL can say returns the same rows as DuckDB."""

import pytest

from lanlore.llm.queries import ORACLE, QUERIES

from ..compare import connect, differences
from ..conftest import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, name):
    assert differences(spark, connect(SF), QUERIES[name], ORACLE[name], SF) is None


def test_thirteen_operators_and_the_pipeline():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(QUERIES) <= names and "pipeline" in names
