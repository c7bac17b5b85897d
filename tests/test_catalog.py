"""Every registered query of the engine's own operators against its SQL."""

import pytest

from tessera.plans import catalog


#: Beyond SQL; held against brute force in test_similarity.py.
NO_SQL = {"scope_tree_match"}


def test_every_query_has_its_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES) - NO_SQL


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(name, spark, sf_dir, duck, same):
    same(catalog.QUERIES[name](spark, sf_dir).toPandas(), duck.execute(catalog.ORACLE[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() >= 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
