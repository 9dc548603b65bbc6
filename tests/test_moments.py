"""Sliding moments from the ends of blocks against sums over each frame."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import calendar, labels
from tidemark.operators.moments import frame_moments, pair


def made(seed, days, gaps=0.0, repeat=False):
    rng = random.Random(seed)
    rows = []
    for g in ("a", "b", None):
        for t in range(days):
            if rng.random() < gaps:
                continue
            for _ in range(2 if repeat and rng.random() < 0.2 else 1):
                v = (None, None) if rng.random() < 0.1 else (rng.gauss(5, 1), rng.gauss(-2, 3))
                rows.append((g, t, *v))
        rows.append((g, None, 1.0, 1.0))
    return rows


@pytest.mark.parametrize(("low", "high", "gaps", "repeat"), [(-12, -3, 0.0, False), (-12, -3, 0.5, False), (-30, -10, 0.9, False), (-5, 0, 0.3, True), (-3, 4, 0.2, False), (0, 1, 0.2, True)])
def test_any_frame(spark, low, high, gaps, repeat):
    rows = made(low * 7 + high, 70, gaps, repeat)
    df = spark.createDataFrame(rows, "g string, t long, x double, y double")
    got = frame_moments(df, "t", low, high, ("x", "y"), ["g"], "m").where("t IS NOT NULL").collect()
    assert len(got) == sum(r[1] is not None for r in rows)
    for r in got:
        frame = [q for q in rows if q[0] == r["g"] and q[1] is not None and r["t"] + low <= q[1] < r["t"] + high]
        xy = np.array([q[2:] for q in frame if q[2] is not None]).reshape(-1, 2)
        assert (r["m_rows"], r["m_n"]) == (len(frame), len(xy))
        if len(xy):
            assert r["m_mean_x"] == pytest.approx(xy[:, 0].mean(), abs=1e-12)
        if len(xy) > 1:
            c = np.cov(xy.T)
            for a, b, v in (("x", "x", c[0, 0]), ("y", "x", c[0, 1]), ("y", "y", c[1, 1])):
                assert r[f"m_{pair(a, b, ('x', 'y'))}"] == pytest.approx(v, abs=1e-11)
        else:
            assert r["m_cov_x_y"] is None


def test_a_value_out_of_line_spoils_no_other_frame(spark):
    rows = [("a", t, 1e14 if t == 33 else float(t % 7)) for t in range(100)]
    df = spark.createDataFrame(rows, "g string, t long, x double")
    for r in frame_moments(df, "t", -20, 0, ("x",), ["g"], "m").collect():
        frame = [x for _, t, x in rows if r["t"] - 20 <= t < r["t"]]
        if len(frame) > 1 and 1e14 not in frame:
            assert r["m_cov_x_x"] == pytest.approx(np.var(frame, ddof=1), abs=1e-12)


def test_no_long_frame_slides(spark, sf):
    from tidemark.sources import proxy

    out = labels.label_events(proxy.events(spark, sf), proxy.prices(spark, sf), proxy.factors(spark, sf))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    bounded = re.findall(r"specifiedwindowframe\((?:Row|Range)Frame, ([^()]*(?:\([^()]*\))?[^()]*)\)", plan)
    assert bounded
    for frame in bounded:
        low, high = frame.split(", ")
        if re.fullmatch(r"-?\d+", low):  # the others grow from the beginning
            assert high == "currentrow$()" or abs(int(high) - int(low)) <= 30


def test_the_labels_are_the_calendar(spark):
    day = F.col("d").cast("date")
    sessions = spark.createDataFrame([("a", "2020-01-06", 1), ("a", "2020-01-08", 2), ("b", "2020-01-07", 3)], "ticker string, d string, v int").select("ticker", day.alias("t0"), "v")
    events = spark.createDataFrame([(1, "a", "2020-01-01 12:00:00"), (2, "a", "2020-01-06 20:00:00"), (3, "a", "2020-01-08 20:00:00"), (4, "b", "2020-01-01 12:00:00"), (5, "c", "2020-01-01 12:00:00"), (6, "a", None)], "id int, ticker string, at string").withColumn("at", F.to_timestamp_ntz("at"))
    plain = sessions.withColumnRenamed("t0", "trade_date").select("ticker", "trade_date")
    got = {r["id"]: (str(r["t0"]), r["v"]) for r in calendar.next_session(events, plain, "at", "t0", by=["ticker"], beside=sessions).collect()}
    assert got == {1: ("2020-01-06", 1), 2: ("2020-01-08", 2), 3: ("None", None), 4: ("2020-01-07", 3), 5: ("None", None), 6: ("None", None)}
