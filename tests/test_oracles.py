"""Every registered query against its SQL oracle, on the smallest tables."""

import pytest
from oracle import differences

from leafwright.plans.catalogue import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert differences(spark, name, QUERIES[name], ORACLES[name], FOLDER) == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(e.oracle_sql()) <= set(e.queries())


def test_contents_lines_of_all_pages(spark):
    """TOC05 over each line of each text: no page is left out, whatever its number."""
    import re

    hit = re.compile(r"^((?:\d{1,2}(?:\.\d{1,2}){0,3}\s+)?)([^\n.…·]{2,80})[.…·\s]+(\d{1,4})\s*$", re.M | re.A)
    want = []
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        for page, line in enumerate((r.text or "").split("\n"), 1):
            for n, t, p in hit.findall(f"{line}\n1.2 First part ..... {page}"):
                if int(p) > 0 and t.strip(" "):
                    want.append((r.doc_id, page, n.strip(" "), t.strip(" "), int(p)))
    got = [tuple(r) for r in QUERIES["toc05_lines"](spark, FOLDER).collect()]
    assert sorted(got) == sorted(want) and {p % 2 for _, p, *_ in got} == {0, 1}
