import os

import pytest

from feedloom.llm import catalogue

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no tables")
COLUMNS = {
    "p1_found": "entry_id bigint, line_no bigint", "p2_found": "tab string, rec_id bigint, line_no bigint", "p3_found": "tab string, rec_id bigint", "p4_found": "item_id bigint, field_name string",
    "p6_found": "item_id bigint, field_name string, markup string", "p8_ids": "doc_id bigint, ids array<int>", "p10_found": "doc_id bigint, kind string, start_pos bigint, end_pos bigint",
}


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, name):
    from tests.test_catalogue import compare

    compare(spark, name, catalogue.QUERIES[name], catalogue.SQL[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    x = catalogue.QUERIES[name](spark, D)
    assert ", ".join(f"{c} {t}" for c, t in x.dtypes) == COLUMNS[name]
    assert x.count() == x.distinct().count() > 0


def test_nothing_else_imports_the_subpackage():
    import pathlib
    import re

    root = pathlib.Path(__file__).parents[2]
    for p in (root / "feedloom").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"feedloom\.llm|from feedloom import llm", p.read_text()), p
