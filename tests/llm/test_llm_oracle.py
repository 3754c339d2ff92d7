"""Every operator that SQL can express, over the whole small tables, against DuckDB."""

import pytest

from llm_paths import SF_SMALL
from subrecon.llm.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(columns).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, want))


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
