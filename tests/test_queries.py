import pytest

from courtside import catalog

from .conftest import SMALL
from .oracle import same


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_equals_sql(spark, name):
    same(catalog.QUERIES[name](spark, SMALL), catalog.ORACLE_SQL[name], SMALL)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLE_SQL])
def test_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0
