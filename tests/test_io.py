import math
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from isopleth.functions.scalar import r4, settled
from isopleth.operators import rolling, text
from isopleth.plans import base, stats  # noqa: F401
from isopleth.sources import io
from isopleth.streaming import issuance


def test_degenerate_tables_are_refused(spark):
    same = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    with pytest.raises(Exception, match="degenerate"):
        io.guarded(same, "v").collect()


def test_partial_window_is_refused(spark):
    daily = spark.createDataFrame([("a", d, 1.0) for d in range(1, 8) if d != 4] + [("a", d, 2.0) for d in range(8, 15)], "cell string, day int, v double")
    windows = spark.createDataFrame([("week1", 1, 7), ("week2", 8, 14)], "window string, first_day int, last_day int")
    assert [(r.window, r.v) for r in rolling.lead_window_mean(daily, windows, ["cell"]).collect()] == [("week2", 2.0)]
    assert [r.day for r in rolling.missing_days(daily, windows).collect()] == [4]


def test_required_rows_pass_and_bad_ones_fail_the_job(spark):
    rows = spark.range(5)
    assert rolling.require(rows, F.col("id") > 9, "too large").count() == 5
    with pytest.raises(Exception, match="too large"):
        rolling.require(rows, F.col("id") > 3, "too large").collect()


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None)], "k int, s string")
    assert io.content_hash(a) == io.content_hash(a.orderBy(F.desc("k"))) != io.content_hash(a.limit(1))


def test_jsonl_rejects_are_apart(spark):
    path = io.shared_folder(spark, "t")
    spark.createDataFrame([('{"k": 1}',), ('{"k": 2, "error": "x"}',), ("{oops",)], "value string").write.text(path)
    good, bad = io.read_jsonl(spark, path, "k int")
    assert [r.k for r in good.collect()] == [1] and bad.count() == 2


def test_stream_of_issuances_is_idempotent(spark):
    source, out = io.shared_folder(spark, "in"), io.shared_folder(spark, "out")
    rows = spark.createDataFrame([("2024-01-01", "w", 1.0), ("2024-01-01", "w", 1.0), ("2024-01-03", "w", 2.0)], "init string, window string, v double")
    rows.write.parquet(source)
    for k in range(2):
        stream = spark.readStream.schema(rows.schema).parquet(source)
        issuance.issue(stream, out, f"{out}-check{k}", ["init", "window"]).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_markdown_and_dates(spark):
    html = "<html><head><title>T</title></head><body><nav><a href='x'>x</a></nav><h2>Head</h2><p>One <b>two</b><br>three<ul><li>a</li></ul></p></body></html>"
    assert text.to_markdown(html) == "## Head\n\nOne **two**\n\nthree\n\n- a"
    got = spark.createDataFrame([("on March 7, 2024 it",), ("none",)], "s string").select(text.long_date(F.col("s")).cast("string").alias("d")).collect()
    assert [r.d for r in got] == ["2024-03-07", None]


def test_revisions_at_a_tie_do_not_hang_on_the_order_of_rows(spark, tmp_path):
    """The mean of ten members is 49.72785 exactly; some orders of the same rows add up to less."""
    sums = spark.createDataFrame([(49.72784999999999,), (49.72785,), (49.727850000000004,)], "v double")
    assert {r.v for r in sums.select(r4(settled(F.col("v"))).alias("v")).collect()} == {49.7279}
    for sf in ("sf0.001", "sf0.01"):
        e = spark.read.parquet(f"/root/testdata/{sf}/events.parquet").select("event_type", F.pmod("user_id", F.lit(10)).alias("member"), F.dayofmonth("ts").alias("day"), F.round(F.col("value") * 100).cast("long").alias("cents"))
        members: dict = {}
        for r in e.groupBy("event_type", "day", "member").agg(F.sum("cents").alias("s"), F.count("*").alias("n")).collect():
            members.setdefault((r.event_type, r.day), []).append(Fraction(r.s, 100 * r.n))
        want = {k: math.floor((sum(v) / len(v) + (k[1] > 16)) * 10_000 + Fraction(1, 2)) / 10_000 for k, v in members.items()}
        assert {(r.cell, r.day): r.v for r in base.QUERIES["t2_revision_overlay"](spark, f"/root/testdata/{sf}").collect()} == want
