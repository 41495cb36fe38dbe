"""Every core query against its SQL at the smallest size."""

import pytest

from eventloom.plans import registry
from tests.compare import ROOT, differences

SF = f"{ROOT}/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_equals_sql(spark, name):
    assert differences(registry.queries()[name](spark, SF), registry.oracles()[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
