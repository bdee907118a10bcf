"""Keys may have the name of a column that an operator adds or uses."""

import pytest

from tidemark.llm.license_scan import scan_licenses
from tidemark.llm.passage_dedup import drop_repeats
from tidemark.llm.simhash import near_dedup


@pytest.mark.parametrize("operator", [near_dedup, scan_licenses, drop_repeats])
def test_same_rows_whatever_the_key_is_called(spark, operator):
    rows = [(1, "released under the mit license " + "a b c d e " * 40), (2, "x y z " * 50), (2, "x y z " * 50), (3, None)]
    results = []
    for name in ("doc_id", "_text", "_key", "_id", "fp", "licenses", "kept"):
        docs = spark.createDataFrame(rows, f"`{name}` long, text string")
        found = operator(docs, name, "text")
        assert found.columns[0] == name
        results.append(sorted(tuple(map(str, r)) for r in found.collect()))
    assert len(results[0]) == len(rows) and all(r == results[0] for r in results)
