"""A sample of the registered queries against their SQL twins on small tables (the driver holds all of them)."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from isopleth.plans import base, fields, models, more, nulls, stats, zones  # noqa: F401

SF = "/root/testdata/sf0.01"
SAMPLE = ["flagship_mam", "a4_season_totals_wrap", "a10_j8_lead_windows", "a26_two_grains", "r3_loyo_predictions", "r34_w9_benjamini_hochberg", "m2_m4_m5_tercile_probabilities", "g9_adjusted_rand", "x1_links", "g11_w4_w7_seasons", "r10_tendency", "r38_verdict", "u6_m6_fold_predictors", "t3_t5_complete_windows_stream"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    key = lambda v: "" if v is None or isinstance(v, float) and math.isnan(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(key(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = base.QUERIES[name](spark, SF)
    found = con.execute(base.SQL[name])
    assert plain(df.collect(), df.columns) == plain(found.fetchall(), [d[0] for d in found.description])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_windows_of_events_beside_their_borders(spark, con, tmp_path):
    """Events in the last half second before a window and at its first; the last event opens or just fails to open the watermark. DuckDB rounds seconds."""
    start = 1704326400  # 2024-01-04
    for last in ("0.2", "-0.4", "0.6", "-0.6"):
        days = ", ".join(f"('{c}', {start + 86400 * d + 600}, {d}.25)" for c in "abc" for d in range(7))
        rows = f"(VALUES {days}, ('a', {start} - 0.3, 9e0), ('b', {start} - 0.7, 9e0), ('c', {start} + 604799.5, 9e0), ('b', {start} + 604800.5, 9e0), ('z', {start} + 691200 + {last}, 1e0))"
        folder = tmp_path / last
        folder.mkdir()
        c = con.cursor()
        c.execute(f"COPY (SELECT row_number() OVER () AS event_id, make_timestamp((s * 1000000)::BIGINT) AS ts, 1::BIGINT AS user_id, cell AS event_type, v::DOUBLE AS value, '' AS props FROM {rows} r(cell, s, v)) TO '{folder}/events.parquet'")
        c = duckdb.connect()
        c.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
        df = base.QUERIES["t3_t5_complete_windows_stream"](spark, str(folder))
        found = c.execute(base.SQL["t3_t5_complete_windows_stream"])
        names = [d[0] for d in found.description]
        want = plain(found.fetchall(), names)
        assert plain(df.collect(), df.columns) == want
        assert len(want) == (2 if float(last) >= 0 else 0)
