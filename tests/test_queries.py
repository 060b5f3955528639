import pytest
from compare import differing
from platlens import queries as core

NAMES = [n for n in core.oracle_sql()]


@pytest.mark.parametrize("part", range(4))
def test_core_queries_equal_their_sql(spark, sf_dir, part):
    assert differing(spark, sf_dir, NAMES[part::4], say=lambda *_: None) == []


def test_registry():
    import __spark_entry__ as entry

    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(NAMES) >= 60 and "topic_salience" in q
