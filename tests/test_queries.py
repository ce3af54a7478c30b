"""Every relational query against its oracle, or, for models and streams, for rows and a stable schema."""

import __spark_entry__
import pytest
from dyadlake.plans import catalogue as registry

from oracle import same


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, small, name):
    same(registry.QUERIES[name](spark, small), registry.ORACLE_SQL[name], small)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "moved_rank" in df.columns


def test_every_query_is_registered():
    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
