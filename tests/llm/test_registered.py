import re

import __spark_entry__ as contract


def test_every_text_query_is_registered():
    """The guard around the imports must not hide a missing dependency."""
    names = contract.queries()
    numbers = sorted(int(m[1]) for m in (re.match(r"op(\d+)_", n) for n in names) if m)
    assert numbers == list(range(1, 14)) and "pipeline" in names
    assert "op12_merkle_manifest" in contract.oracle_sql()
