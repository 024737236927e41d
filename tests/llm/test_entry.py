import re

import __spark_entry__ as entry


def test_all_operators_are_registered():
    names = entry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
