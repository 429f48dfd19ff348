"""Every query of the library against its SQL, over the smallest tables."""

import pytest

from lanternfish.plans import registry
from tests.conftest import SF, same_rows


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, duck, name):
    same_rows(registry.queries()[name](spark, SF), duck.execute(registry.oracle_sql()[name]))


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
