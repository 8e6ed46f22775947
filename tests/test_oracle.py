"""Every query of the catalog runs at the smallest scale and equals its SQL."""

from __future__ import annotations

import pytest
from oracle import compare

from paperloom import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    if name in catalog.SQL:
        assert compare(spark, name, catalog.QUERIES[name], catalog.SQL[name], SF) is None
    else:
        assert catalog.QUERIES[name](spark, SF).count() > 0
