"""Every query against its SQL, or at least for a stable schema and rows."""

from __future__ import annotations

import oracle
import pytest
from evalweave.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLE_SQL:
        assert oracle.difference(df, catalog.ORACLE_SQL[name], sf_dir) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["runner_id", "composite", "rank"] and df.count() == 4
    assert set(e.oracle_sql()) <= set(e.queries())
