"""The driver's contract."""

import __spark_entry__


def test_entry_and_names(spark, sf_dir):
    q, o = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(o) <= set(q) and len(q) > 100
    assert __spark_entry__.entry(spark).count() > 0
