import pytest

from factloom.plans import catalog
from tests.compare import duck, of_frame, of_sql


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    names, rows = of_frame(catalog.QUERIES[name](spark, sf))
    want_names, want = of_sql(con, catalog.ORACLES[name])
    assert names == want_names
    assert rows, "no rows"
    assert len(rows) == len(want)
    differ = [(a, b) for a, b in zip(rows, want, strict=True) if a != b]
    assert not differ, differ[:3]
