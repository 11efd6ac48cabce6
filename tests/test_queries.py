import pytest
from compare import duck_rows, spark_rows

from palimpsest.plans import queries  # noqa: F401
from palimpsest.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    assert rows or name in ("allowed_pairs",)
    if name in ORACLES:
        want = duck_rows(ORACLES[name], sf)
        assert columns == want[0] and rows == want[1]
