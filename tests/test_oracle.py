"""Every registered query against its oracle SQL, or at least for rows."""

import pytest
from oracle import TESTDATA, compare

from tessera.plans.catalog import REGISTRY

SF = f"{TESTDATA}/sf0.001"


@pytest.mark.parametrize("name", sorted(REGISTRY.oracle))
def test_equals_oracle(spark, name):
    compare(spark, REGISTRY.queries[name], REGISTRY.oracle[name], SF)


@pytest.mark.parametrize("name", sorted(set(REGISTRY.queries) - set(REGISTRY.oracle)))
def test_has_rows(spark, name):
    assert REGISTRY.queries[name](spark, SF).count() > 0
