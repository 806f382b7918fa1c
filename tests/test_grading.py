"""Grading against worked cases."""

import math

import pytest
from pyspark.sql import functions as F

from rollscan.functions import grading
from rollscan.operators import astm


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_points_by_band(spark):
    lengths = [0.0, 1.0, 74.0, 75.0, 76.0, 150.0, 151.0, 230.0, 231.0, 1000.0]
    assert values(spark, [(x,) for x in lengths], "mm double", grading.points_by_band(F.col("mm"))) == [1, 1, 1, 1, 2, 2, 3, 3, 4, 4]


def test_points_of_continuous_events(spark):
    cases = {230.0: 4, 999.0: 4, 1000.0: 4, 1001.0: 8, 2000.0: 8, 2001.0: 12, 3400.0: 16, 100.0: 2}
    assert values(spark, [(x,) for x in cases], "mm double", grading.points_of_event(F.col("mm"))) == list(cases.values())


def test_negative_length_is_refused(spark):
    with pytest.raises(Exception, match="negative"):
        values(spark, [(-1.0,)], "mm double", grading.points_by_band(F.col("mm")))


def test_density_and_verdict(spark):
    got = values(spark, [(20, 50.0, 1.5)], "p int, l double, w double", grading.density(F.col("p"), F.col("l"), F.col("w")))
    assert got == [pytest.approx(20 * 83.61 / 75)]
    assert values(spark, [(x,) for x in (19.9, 20.0, 39.9, 40.0)], "d double", grading.verdict(F.col("d"))) == ["pass", "hold", "hold", "reject"]
    with pytest.raises(Exception, match="not positive"):
        values(spark, [(1, 0.0, 1.5)], "p int, l double, w double", grading.density(F.col("p"), F.col("l"), F.col("w")))


def test_confidence(spark):
    got = values(spark, [(1.0,), (2.0,), (2.5,), (3.0,), (4.0,)], "s double", grading.confidence(F.col("s"), F.lit(3.0), F.lit(2.0)))
    assert got == [0, 0, 0.25, 0.5, pytest.approx(0.5 + 0.5 * (1 - math.exp(-1)))]
    assert values(spark, [(2.9,), (3.0,)], "s double", grading.confidence(F.col("s"), F.lit(3.0), F.lit(3.0))) == [0, 1]


def test_five_event_roll(spark):
    rows = [(100.0, 48.0, "asserted", "proposed"), (900.0, 180.0, "asserted", "confirmed"), (3000.0, 1400.0, "asserted", "proposed"), (5000.0, 62.0, "uncertain", "proposed"), (6000.0, 35.0, "asserted", "rejected")]
    events = spark.createDataFrame([("a", 1, *r) for r in rows], "sku string, roll_id int, along_start_mm double, length_mm double, assertion string, status string")
    rolls = spark.createDataFrame([("a", 1, 7.4, 0.586), ("a", 2, 5.0, 1.0)], "sku string, roll_id int, length_m double, width_m double")
    got = {r.roll_id: (r.points, r.verdict) for r in astm.roll_verdicts(events, rolls, ["sku", "roll_id"]).collect()}
    assert got[1][0] == 12
    assert got[2] == (0, "pass")


def test_metre_cap(spark):
    events = spark.createDataFrame([("a", 1, 100.0 + i, 200.0, "asserted", "proposed") for i in range(5)], "sku string, roll_id int, along_start_mm double, length_mm double, assertion string, status string")
    rolls = spark.createDataFrame([("a", 1, 2.0, 1.0)], "sku string, roll_id int, length_m double, width_m double")
    assert astm.roll_verdicts(events, rolls, ["sku", "roll_id"]).first().points == 4


def test_boxes(spark):
    box = lambda *v: tuple(F.lit(float(x)) for x in v)
    r = spark.range(1).select(
        grading.iou(box(0, 10, 0, 10), box(0, 10, 0, 10)).alias("same"), grading.iou(box(0, 10, 0, 10), box(20, 30, 0, 10)).alias("apart"), grading.iou(box(0, 10, 0, 10), box(5, 15, 0, 10)).alias("third"),
        grading.continues(box(0, 10, 0, 10), box(40, 50, 0, 10)).alias("on"), grading.continues(box(0, 10, 0, 10), box(40, 50, 900, 910)).alias("off"),
    ).first()
    assert (r.same, r.apart, r.third, r.on, r.off) == (1, 0, pytest.approx(1 / 3), True, False)
