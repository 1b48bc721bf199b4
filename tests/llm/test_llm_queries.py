"""Every registered query of the training-data operators that SQL can express gives the rows of its SQL."""

import pytest
from oracle import compare, connect

from corpusaudit.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_llm_query_equals_sql(name, spark, sf_dir):
    assert compare(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) is None
