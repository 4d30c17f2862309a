"""The driver's contract, and the quick queries against their SQL on the smallest tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("TRACKLOOM_TEST_DATA", "/root/testdata/sf0.001")
QUICK = ["p1_found", "p4_found", "p4_grid", "p6_found", "clean_annotations", "interval_last_wins", "asof_nearest", "event_segments", "close_open_bouts", "frame_metrics", "ranked_metrics", "ratio_sample", "group_folds", "fill_forward_back"]


@pytest.fixture(scope="module")
def entry():
    import __spark_entry__

    return __spark_entry__


def test_names(entry):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and {"p1_found", "p4_found", "p5_found", "p6_found", "p7_found"} <= set(queries)


def plain(rows):
    def value(v):
        return None if v is None or v != v else round(float(v), 5) if isinstance(v, float) else v

    return sorted(map(str, (tuple(map(value, r)) for r in rows)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, entry, name):
    found = entry.queries()[name](spark, DATA)
    columns = sorted(found.columns)
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    expected = db.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(expected)
    assert not any(math.isnan(v) for r in expected for v in r if isinstance(v, float))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_nearest_frame_keeps_every_annotation(spark, entry):
    test_query_equals_sql(spark, entry, "nearest_frame_any")
    events = entry.queries()["clean_annotations"](spark, DATA).select("annotation_id", "source", "id", "t0").distinct().count()
    assert entry.queries()["nearest_frame_any"](spark, DATA).count() == events > entry.queries()["nearest_frame"](spark, DATA).count()
