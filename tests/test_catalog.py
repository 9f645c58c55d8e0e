from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from civicflow.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert not [n for n in catalog.queries() if re.match(r"p\d+_", n) and n != "p6_found"]


@pytest.mark.parametrize("name", ["t04_normalize_whitespace", "d02_exact_verdicts", "c06_confidence_bands", "g14_nearby_candidates", "e12_top_keywords", "r01_event_connections", "q02_ece_brier", "t09_canonical_url"])
def test_queries_equal_their_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    from pathlib import Path

    if not Path(DATA).is_dir():
        pytest.skip("no test data")
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    flat = lambda d: sorted(map(str, ([None if v is None or v != v else round(v, 6) if isinstance(v, float) else str(v) for v in r] for r in d[sorted(d.columns)].itertuples(index=False))))
    assert flat(got) == flat(want)
