import re

import __spark_entry__ as entry


def test_names():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    assert {"op5_decontamination", "op7_source_mixing"} <= set(entry.oracle_sql())
