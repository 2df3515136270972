"""Every query that SQL can express gives the oracle's rows; the others run and give a stable schema."""

import pytest
from compare import rows

from lamplight.plans import audit_queries, conversation_queries, corpus_queries, policy_queries, registry, text_queries  # noqa: F401


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows_as_sql(name, spark, folder, duck):
    ours = registry.QUERIES[name](spark, folder).toPandas()
    theirs = duck.sql(registry.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(name, spark, folder):
    df = registry.QUERIES[name](spark, folder)
    assert df.count() >= 0 and df.columns
