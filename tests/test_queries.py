"""Every registered query with SQL gives the SQL's rows on the smallest tables; the others give rows of their schema."""

import pytest
from oracle import same

from siteflow.jobs.catalog import QUERIES
from siteflow.jobs.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_its_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
