"""Boundaries, by hand."""

from __future__ import annotations

import math
import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import clock, numeric, text
from tidemark.operators import backtest, calendar, canary, diagnose, features, labels, metrics, ranks, returns, splits
from tidemark.plans import pipelines
from tidemark.sources import dims, factors, filings, sinks

D = date(2024, 1, 1)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def ts(spark, s):
    return F.lit(datetime.fromisoformat(s)).cast("timestamp_ntz")


@pytest.mark.parametrize(("utc", "label", "day"), [("2024-07-01 13:30:00", "intraday", "2024-07-01"), ("2024-01-02 13:30:00", "pre_open", "2024-01-02"), ("2024-01-02 21:00:00", "after_close", "2024-01-02"), ("2024-01-06 15:00:00", "weekend", "2024-01-06"), ("2024-01-03 02:00:00", "after_close", "2024-01-02"), ("2024-01-02 14:29:59.999999", "pre_open", "2024-01-02")])
def test_market_clock(spark, utc, label, day):
    assert one(spark, clock.time_label(ts(spark, utc))) == label
    assert str(one(spark, clock.market_date(ts(spark, utc)))) == day


def test_time_label_unknown(spark):
    assert one(spark, clock.time_label(F.lit(None).cast("timestamp_ntz"))) == "unknown"


def test_as_of_sessions(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4, 5, 8)]
    px = spark.createDataFrame([("A", d) for d in days], "ticker string, trade_date date")
    at = {1: "2024-01-03 14:29:59", 2: "2024-01-03 14:30:00", 3: "2024-01-06 12:00:00", 4: "2024-01-08 15:00:00", 5: "2023-12-20 12:00:00", 6: "2024-01-03 14:30:00.000001"}
    ev = spark.createDataFrame([(k, "A", datetime.fromisoformat(v)) for k, v in at.items()] + [(7, "A", None), (8, "B", datetime(2024, 1, 3))], "event_id int, ticker string, publish_ts timestamp_ntz")
    strict = {r.event_id: r.t0 for r in calendar.next_session(ev, px, by=["ticker"]).collect()}
    loose = {r.event_id: r.entry_day for r in calendar.entry_session(ev, px, by=["ticker"]).collect()}
    assert strict == {1: days[1], 2: days[2], 3: days[4], 4: None, 5: days[0], 6: days[2], 7: None, 8: None}
    assert loose == {1: days[1], 2: days[1], 3: days[4], 4: None, 5: days[0], 6: days[2], 7: None, 8: None}


def test_labels_of_thresholds(spark):
    z = [-0.76, -0.75, 0.75, 0.76, None]
    assert [one(spark, numeric.direction_label(F.lit(x).cast("double"))) for x in z] == ["down", "neutral", "neutral", "up", None]
    assert [one(spark, numeric.materiality_label(F.lit(x))) for x in (-1.51, 1.5, 1.51)] == [True, False, True]
    assert [one(spark, numeric.z_score(F.lit(1.0), F.lit(s).cast("double"))) for s in (2.0, 0.0, None)] == [0.5, 0.0, 0.0]


def test_split_edges(spark):
    cfg = splits.SplitConfig()
    at = ["2020-12-31 23:59:59.999999", "2021-01-01 00:00:00", "2021-01-07 23:59:59.999999", "2021-01-08 00:00:00", "2022-01-01 00:00:00", "2022-01-08 00:00:00", "2023-01-01 00:00:00"]
    assert [one(spark, splits.split_name(ts(spark, x), cfg)) for x in at] == ["train", None, None, "val", None, "test", None]


def test_earnings(spark):
    df = spark.createDataFrame([("2.02",), ("2.02,9.01",), ("12.02",), (None,), ("2x02",)], "items string")
    assert {r.items for r in splits.drop_earnings(df).collect()} == {"12.02", None, "2x02"}
    assert {r.items for r in splits.earnings_only(df).collect()} == {"2.02", "2.02,9.01"}


def test_text(spark):
    assert one(spark, text.strip_html(F.lit("<p>a&nbsp;&amp;  b</p>"))) == "a & b"
    assert one(spark, text.items_mentioned(F.lit("Item 2.02 ITEM  9.01 item 2.02"))) == ["2.02", "9.01"]
    assert one(spark, text.trim_body(F.lit("cover. Today the company ANNOUNCES\n\n news"))) == "ANNOUNCES news"
    assert one(spark, text.trim_body(F.lit(None).cast("string"))) == ""
    for answer, want in [("direction: UP\nMateriality: immaterial", ("up", "immaterial")), ("foo", (None, None)), (None, (None, None))]:
        d, m = text.parse_response(F.lit(answer).cast("string"))
        assert (one(spark, d), one(spark, m)) == want
    assert one(spark, text.response(F.lit(None).cast("string"), F.lit(None).cast("string"))) == "Direction: neutral\nMateriality: immaterial"
    assert one(spark, text.materiality_text(F.lit(None).cast("boolean"))) == "immaterial"
    assert one(spark, text.items_display(F.lit("  "))) == "n/a"


def test_described_items(spark):
    assert one(spark, features.described_items(F.lit("2.02, 9.99"), dims.ITEM_NAMES)) == "  Item 2.02: Results of Operations and Financial Condition (EARNINGS)\n  Item 9.99: ?"
    assert one(spark, features.described_items(F.lit(None).cast("string"), dims.ITEM_NAMES)) == ""


@pytest.mark.parametrize(("up", "down", "m", "want"), [(0.6, 0.4, 0.5, 1), (0.4, 0.6, 0.5, -1), (0.59, 0.4, 0.9, 0), (0.9, 0.0, 0.49, 0), (None, 0.1, 0.9, 0), (float("nan"), 0.1, 0.9, 0)])
def test_trade_gate(spark, up, down, m, want):
    cfg = backtest.BacktestConfig(edge_threshold=0.6 - 0.4)
    assert one(spark, backtest.trade_signal(F.lit(up).cast("double"), F.lit(down), F.lit(m), cfg)) == want


def days_from(n, start=D):
    return [start + timedelta(days=i) for i in range(n)]


def test_exit_needs_a_session(spark):
    px = spark.createDataFrame([("A", d, 100.0 + i) for i, d in enumerate(days_from(12))], "ticker string, trade_date date, open double")
    p = spark.createDataFrame([("A", datetime(2024, 1, 1, 5), 0.9, 0.0, 0.9), ("A", datetime(2024, 1, 2, 5), 0.9, 0.0, 0.9), ("A", datetime(2024, 1, 3, 5), 0.9, 0.0, 0.9)], "ticker string, publish_ts_utc timestamp_ntz, pred_p_up double, pred_p_down double, pred_p_material double")
    got = backtest.trades(p, px).orderBy("entry_day").collect()
    assert [(r.entry_day, r.exit_day) for r in got] == [(D, days_from(12)[10]), (days_from(12)[1], days_from(12)[11])]
    assert got[0].net_return == pytest.approx(110 / 100 - 1 - 0.0015)
    assert backtest.trades(p.drop("pred_p_up"), px).count() == 0
    empty = backtest.summary(backtest.trades(p.limit(0), px)).first()
    assert empty.n_trades == 0 and empty.note == "no trades fired" and empty.sharpe_net is None


def test_drawdown_without_the_start(spark):
    eq = spark.createDataFrame(list(zip(days_from(3), [100.0, 90.0, 95.0])), "day date, equity double")
    assert backtest.drawdown(eq).agg(F.min("drawdown")).first()[0] == pytest.approx(-0.10)


def test_sharpe_gates(spark):
    assert one(spark, backtest.sharpe(F.lit(0.1), F.lit(0.2), F.lit(1), F.lit(1))) is None
    assert one(spark, backtest.sharpe(F.lit(0.1), F.lit(0.0), F.lit(5), F.lit(1))) is None
    assert one(spark, backtest.sharpe(F.lit(0.1), F.lit(0.2), F.lit(8), F.lit(2))) == pytest.approx(0.1 * 4 / (0.2 * 2) * 252**0.5)


def test_auc(spark):
    def auc(pairs):
        return metrics.rank_auc(spark.createDataFrame(pairs, "y int, s double"), "y", "s").first()["auc"]

    assert auc([(0, 0.5), (1, 0.5), (1, 0.5)]) == 0.5
    assert auc([(1, 0.5), (1, 0.1)]) is None
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 500), rng.integers(0, 40, 500) / 7
    want = np.mean([(s[y == 1] > a).mean() + 0.5 * (s[y == 1] == a).mean() for a in s[y == 0]])
    rows = [(int(a), float(b)) for a, b in zip(y, s)]
    assert auc(rows) == pytest.approx(want)
    assert auc([(a, -b) for a, b in rows]) == pytest.approx(1 - want)


def test_ece_bins(spark):
    rows = [(1, p) for p in (0.3, 0.6, 1.0, 0.0, 0.05, 0.15, 0.25, 0.95, 0.5, 1.5)]
    got = metrics.ece(spark.createDataFrame(rows, "y int, p double"), "y", "p").first()["ece_10bin"]
    groups = {2: [0.3, 0.25], 5: [0.6, 0.5], 9: [1.0, 0.95], 0: [0.0, 0.05], 1: [0.15]}  # 0.3 and 0.6 lie below their edges
    assert got == pytest.approx(sum(len(g) / 10 * abs(np.mean(g) - 1) for g in groups.values()))
    assert metrics.ece(spark.createDataFrame(rows[:9], "y int, p double"), "y", "p").first()["ece_10bin"] is None


def test_spearman(spark):
    def ic(rows):
        return metrics.spearman_ic(spark.createDataFrame(rows, "pred_p_up double, pred_p_down double, pred_p_material double, car_0_1 double")).first()

    few = ic([(0.1 * i, 0.0, 0.5, 0.1 * i) for i in range(4)])
    assert few.n == 4 and few.spearman_rho is None and few.note is None
    flat = ic([(0.5, 0.0, 0.5, 0.1 * i) for i in range(8)])
    assert flat.spearman_rho is None and flat.note == "constant input"
    up = ic([(0.1 * i**2, 0.0, 0.5, 0.1 * i) for i in range(8)] + [(float("nan"), 0.0, 0.1, 0.3)])
    assert up.n == 8 and up.spearman_rho == pytest.approx(1.0)


def test_ranks_of_any_values(spark):
    """Outliers, ties, zeros of both signs, tiny and huge numbers; ranks as sorting gives them, in each group."""
    rng = random.Random(9)
    values = [0.0, -0.0, 1e300, -1e300, 5e-324, -5e-324, 2.0**-1000, 1.0, 1.0 + 2**-52, 1.0 - 2**-53, 8.0, math.nextafter(8.0, 0), float("inf"), float("-inf"), *[rng.gauss(0, 0.02) for _ in range(150)], *[0.5] * 40, *[-float(i % 7) for i in range(60)]]
    rows = [(g, v) for g in ("a", None) for v in values[: None if g else 120]]
    got = metrics.with_rank(spark.createDataFrame(rows, "g string, v double"), "v", "r", ["g"]).collect()
    assert len(got) == len(rows)
    for g in ("a", None):
        own = sorted(v for k, v in rows if k == g)
        assert all(r.r == (sum(x < r.v for x in own) + 1 + sum(x <= r.v for x in own)) / 2 for r in got if r.g == g)
    labels = [(v, int(rng.random() < 0.4)) for v in values]
    auc = metrics.rank_auc(spark.createDataFrame(labels, "s double, y int"), "y", "s").first().auc
    pos, neg = [v for v, y in labels if y], [v for v, y in labels if not y]
    assert auc == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))


@pytest.mark.parametrize("broadcast", [100_000, 0])
def test_rank_windows_are_bounded(spark, monkeypatch, broadcast):
    """An outlier doesn't put all values into one cell, ties are dealt over many tasks, and a join does what a broadcast does."""
    monkeypatch.setattr(ranks, "BROADCAST_CELLS", broadcast)
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("v"), (F.col("id") % 2).alias("g")).unionByName(spark.createDataFrame([(1e12, 0)], "v double, g long"))
    splitters = df.agg(F.percentile_approx("v", F.expr(f"array({', '.join(f'{i / ranks.SPLITS}D' for i in range(1, ranks.SPLITS))})"), 10 * ranks.SPLITS)).first()[0]
    assert ranks.with_cell(df, "v", "c", splitters).groupBy("c").count().agg(F.max("count")).first()[0] < 3 * 20_000 / ranks.SPLITS
    got = metrics.with_rank(df, "v", "r", ["g"]).collect()
    for g in (0, 1):
        assert [r.r for r in sorted((r for r in got if r.g == g), key=lambda r: r.v)] == [float(i + 1) for i in range(10_001 - g)]
    assert metrics.with_rank(spark.range(1000).select(F.lit(3.0).alias("v")), "v", "r").agg(F.min("r"), F.max("r")).first() == (500.5, 500.5)
    assert metrics.with_rank(spark.createDataFrame([], "v double, g long"), "v", "r", ["g"]).collect() == []
    two = ranks.with_ranks(spark.createDataFrame([(1.0, None), (2.0, 5.0), (2.0, 4.0), (None, None)], "a double, b double"), {"ra": "a", "rb": "b"})
    assert sorted(map(tuple, two.collect()), key=str) == sorted([(1.0, None, 1.0, None), (2.0, 5.0, 2.5, 2.0), (2.0, 4.0, 2.5, 1.0), (None, None, None, None)], key=str)


def test_evaluation_reads_predictions_once(spark, tmp_path):
    rows = [("AB"[i % 2], "S", f"202{i % 3}-01-0{1 + i % 9} 00:00:00", "up", ["up", "down", None][i % 3], "material" if i % 4 else "immaterial", "material", i / 7 % 1, i / 50, i / 60, 0.1) for i in range(60)]
    names = "ticker, sector, at, direction, pred_direction, materiality, pred_materiality, pred_p_material, car_0_1, pred_p_up, pred_p_down".split(", ")
    df = spark.createDataFrame(rows, names).withColumn("publish_ts_utc", F.to_timestamp("at"))
    df.write.parquet(f"{tmp_path}/p")
    got = pipelines.evaluate(spark.read.parquet(f"{tmp_path}/p"))
    assert set(got) == {"overall", "by_ticker", "by_year", "by_sector"}
    for name, apart in (("by_ticker", metrics.stratified_report(df, "ticker")), ("by_year", metrics.year_strata(df)), ("by_sector", metrics.sector_strata(df))):
        assert sorted(map(tuple, got[name].collect())) == sorted(map(tuple, apart.collect())) != []
        assert "InMemoryTableScan" in got[name]._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_spearman_p():
    assert metrics.spearman_p(0.0, 10) == pytest.approx(1.0)
    assert metrics.spearman_p(1.0, 10) == 0.0
    assert metrics.spearman_p(None, 10) is None
    # t of two degrees of freedom has a closed form: p = 1 - t / sqrt(t^2 + 2)
    t = 0.5 * (2 / (1 - 0.25)) ** 0.5
    assert metrics.spearman_p(0.5, 4) == pytest.approx(1 - t / (t * t + 2) ** 0.5, rel=1e-12)


def test_softmax_and_argmax(spark):
    assert one(spark, numeric.softmax(F.array(*[F.lit(0.0)] * 4))) == [0.25] * 4
    assert one(spark, numeric.argmax_label(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)))) == "down"
    assert one(spark, numeric.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))) == [0.5, 0.5]


@pytest.mark.parametrize(("n", "auc", "want"), [(199, 0.9, "INCONCLUSIVE"), (200, 0.63, "FAIL"), (200, 0.57, "WARN"), (200, 0.5, "PASS"), (200, None, "INSUFFICIENT_DATA")])
def test_verdict(spark, n, auc, want):
    assert one(spark, canary.verdict(F.lit(n), F.lit(auc).cast("double"))) == want


def test_simple_return_pads(spark):
    px = spark.createDataFrame([("A", d, c) for d, c in zip(days_from(3), [1.0, None, 2.0])], "ticker string, trade_date date, close double")
    assert [r.ret for r in returns.simple_return(px).orderBy("trade_date").collect()] == [None, 0.0, 1.0]


def test_solve(spark):
    a = np.array([[4.0, 1, 0.5], [1, 3, 0.2], [0.5, 0.2, 2]])
    c = np.array([1.0, 2, 3])
    lit = lambda m: [[F.lit(float(x)) for x in row] for row in m]
    got = one(spark, numeric.solve_spd(lit(a), [F.lit(float(x)) for x in c]))
    assert np.allclose(got, np.linalg.solve(a, c))
    a[2] = a[1]
    a[:, 2] = a[:, 1]
    a[2, 2] = a[1, 1]
    assert one(spark, numeric.solve_spd(lit(a), [F.lit(float(x)) for x in c])) == [None] * 3


@pytest.fixture(scope="module")
def market(spark):
    rng = np.random.default_rng(3)
    days = [D + timedelta(days=i) for i in range(420)]
    f = rng.normal(0, 0.01, (420, 5))
    f[:, 3] = 0.0001
    ret = 0.0002 + f[:, [0, 1, 2, 4]] @ np.array([1.1, 0.4, -0.3, 0.2]) + rng.normal(0, 0.01, 420)
    return days, f, ret


def frames(spark, days, f, ret):
    fac = spark.createDataFrame([(d, *map(float, x)) for d, x in zip(days, f)], "date date, MKT_RF double, SMB double, HML double, RF double, MOM double")
    px = spark.createDataFrame([("A", d, None if r is None else float(r)) for d, r in zip(days, ret)], "ticker string, trade_date date, ret double")
    return px, fac


def reference_label(f, ret, t, lo=0, hi=1):
    x = np.column_stack([np.ones(len(f)), f[:, [0, 1, 2, 4]]])
    y = np.array([np.nan if r is None else r for r in ret]) - f[:, 3]
    est, idio, win = range(max(t - 250, 0), t - 30), range(t - 60, t - 30), range(t + lo, t + hi + 1)
    keep = [i for i in est if not np.isnan(y[i])]
    beta = np.linalg.lstsq(x[keep], y[keep], rcond=None)[0]
    resid = lambda rows: np.array([y[i] - x[i] @ beta for i in rows if not np.isnan(y[i])])
    return resid(win).sum(), resid(idio).std(ddof=1) * np.sqrt(len(win))


def test_labels_match_regression(spark, market):
    days, f, ret = market
    ret = [None if i % 10 == 3 else r for i, r in enumerate(ret)]
    got = {r.t0: r for r in labels.session_labels(*frames(spark, days, f, ret)).collect()}
    for t in (120, 250, 300, 417):
        car, sigma = reference_label(f, ret, t)
        assert got[days[t]].car_0_1 == pytest.approx(car, abs=1e-10)
        assert got[days[t]].sigma_window_0_1 == pytest.approx(sigma, rel=1e-9)
    # 60 price rows before t - 30 are needed, and both sessions of the window
    assert got[days[89]].car_0_1 is None and got[days[90]].car_0_1 is not None
    assert got[days[419]].car_0_1 is None and got[days[419]].car_minus1_0 is not None


def test_labels_dont_look_ahead(spark, market):
    days, f, ret = market
    t = 300
    base = labels.factor_model(labels.panel(*frames(spark, days, f, ret))).where(F.col("trade_date") == days[t]).first()
    later = [r if i < t - 30 else r + 0.5 for i, r in enumerate(ret)]
    moved = labels.factor_model(labels.panel(*frames(spark, days, f, later))).where(F.col("trade_date") == days[t]).first()
    assert moved.beta0 == pytest.approx(base.beta0, abs=1e-12) and moved.alpha == pytest.approx(base.alpha, abs=1e-12)
    after = [r if i <= t + 1 else r + 0.5 for i, r in enumerate(ret)]
    a, b = (labels.session_labels(*frames(spark, days, f, x)).where(F.col("t0") == days[t]).first() for x in (ret, after))
    assert a == b


def test_short_calendar_has_no_label(spark, market):
    days, f, ret = market
    assert labels.session_labels(*frames(spark, days[:25], f[:25], ret[:25])).where("car_0_1 IS NOT NULL").count() == 0


def test_missing_factor_day(spark, market):
    days, f, ret = market
    px, fac = frames(spark, days, f, ret)
    got = {r.t0: r for r in labels.session_labels(px, fac.where(F.col("date") != days[300])).collect()}
    assert got[days[300]].car_0_1 is None
    assert got[days[310]].car_0_1 is not None


def test_oversample_equalises(spark):
    df = spark.createDataFrame([(i, "up" if i < 9 else "down" if i < 12 else None) for i in range(14)], "k int, direction string")
    out = splits.oversample(df, "direction", "k")
    counts = {r["direction"]: r["count"] for r in out.groupBy("direction").count().collect()}
    assert counts == {"up": 9, "down": 9, None: 2}
    assert {r.k for r in out.where("draw > 0").collect()} <= {9, 10, 11}
    assert sorted(map(tuple, out.collect()), key=str) == sorted(map(tuple, splits.oversample(df.repartition(3), "direction", "k").collect()), key=str)


def test_features_on_their_own_rows(spark):
    ev = spark.createDataFrame(
        [(1, "XOM", datetime(2020, 1, 3, 15), "8.01", "b1", "up", True), (2, "JPM", datetime(2020, 1, 2, 15), None, None, None, None), (3, "XOM", datetime(2020, 1, 3, 16), "", "b3", "down", False), (4, "XOM", datetime(2020, 1, 10, 16), "1.01", "b4", "up", None)],
        "event_id int, ticker string, publish_ts timestamp_ntz, items string, body_text string, direction string, material boolean",
    )
    got = {r.event_id: r for r in features.event_features(ev, dims.sectors(spark)).collect()}
    assert [(got[i].n_same_day, got[i].days_since, got[i].sector) for i in (1, 2, 3, 4)] == [(2, -1, "Energy"), (1, -1, "Financials"), (2, 0, "Energy"), (1, 7, "Energy")]
    lines = {r["value"] for r in sinks.prompt_lines(ev_features(spark, ev), True).collect()}
    import json

    by = {(m["meta"]["ticker"], m["meta"]["publish_ts_utc"]): m for m in map(json.loads, lines)}
    own = by["XOM", "2020-01-03T15:00:00+00:00"]
    assert own["meta"]["materiality"] == "material" and own["meta"]["direction"] == "up" and "Body: b1" in own["text"] and own["meta"]["car_0_1"] is None


def ev_features(spark, ev):
    return features.event_features(ev, dims.sectors(spark))


def test_write_splits(spark, tmp_path, sf):
    from tidemark.sources import proxy

    n = sinks.write_splits(proxy.filings(spark, sf), dims.sectors(spark), str(tmp_path), balance=True)
    assert n["train"] > 0 and n["val_prompt"] == n["val_labeled"] > 0 and n["test_earnings_only"] > 0
    from tidemark.sources import tables

    counts = {r["class"]: r["n"] for r in tables.counts_by_class(tables.read_jsonl(spark, f"{tmp_path}/train")).where("field = 'direction'").collect()}
    assert len(set(counts.values())) == 1


def test_partitioned_write_skips_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("A", 2020, 1), ("B", 2020, 2)], "ticker string, year int, v int")
    path = str(tmp_path / "t")
    sinks.write_partitioned(df, path)
    sinks.write_partitioned(df.withColumn("v", F.lit(9)).unionByName(spark.createDataFrame([("C", 2021, 3)], df.schema)), path)
    assert {(r.ticker, r.v) for r in spark.read.parquet(path).collect()} == {("A", 1), ("B", 2), ("C", 3)}
    sinks.write_partitioned(df.where("ticker = 'A'").withColumn("v", F.lit(7)), path, overwrite=True)
    assert {(r.ticker, r.v) for r in spark.read.parquet(path).collect()} == {("A", 7), ("B", 2), ("C", 3)}


def test_sectioned_csv_takes_the_first_run(spark):
    text_ = ["This file", "", ",Mkt-RF,SMB", "20200102, 1.50,-0.20", "20200103,-99.99, 0.40", "", "Copyright", "20200104, 9.0, 9.0"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text_)], "file string, line_no int, line string")
    got = factors.sectioned_csv(lines, ["m", "s"], missing=-99.99).orderBy("date").collect()
    assert [(str(r.date), r.m, r.s) for r in got] == [("2020-01-02", pytest.approx(0.015), pytest.approx(-0.002)), ("2020-01-03", None, pytest.approx(0.004))]


def test_zip_factors(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w") as z:
        z.writestr("readme.txt", "x")
        z.writestr("m.CSV", "caf\xe9\n20200102,1.0\n20200103,2.0\nend\n".encode("latin-1"))
    got = factors.sectioned_csv(factors.read_zip_lines(spark, str(tmp_path / "m.zip")), ["v"])
    assert sorted(r.v for r in got.collect()) == [0.01, 0.02]


def test_cik(spark):
    js = '{"0":{"cik_str":19617,"ticker":"JPM","title":"J"},"1":{"cik_str":34088,"ticker":"XOM","title":"X"}}'
    got = filings.parse_company_tickers(spark.createDataFrame([(js,)], "v string"), "v")
    assert filings.cik_for_ticker(got, "jpm") == "0000019617"
    with pytest.raises(KeyError):
        filings.cik_for_ticker(got, "nope")


def test_collapse(spark):
    p = spark.createDataFrame([("up", "down", 0.5, 0.1, 0.3)] * 3, "pred_direction string, direction string, pred_p_up double, pred_p_down double, pred_p_material double")
    train = spark.createDataFrame([("up",), ("up",), ("down",), (None,)], "direction string")
    got = diagnose.collapse_diagnosis(p, train).first()
    assert got.collapsed_class == "up" and got.train_share == pytest.approx(2 / 3) and got.issues == "majority_class_collapse,tiny_test_set,zero_variance_edge"


def test_streams(spark, tmp_path):
    from tidemark.streaming import events

    rows = spark.createDataFrame([("A", datetime(2024, 1, 2, 15)), ("A", datetime(2024, 1, 2, 16)), ("B", datetime(2024, 1, 3, 15))], "ticker string, publish_ts timestamp_ntz")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = events.daily_counts(stream).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.ticker, str(r.day), r.n) for r in spark.table("daily").collect()} == {("A", "2024-01-02", 2), ("B", "2024-01-03", 1)}
    assert {r.n for r in events.session_bursts(rows).collect()} == {2, 1}


def test_http_reader_skips_errors():
    from tidemark.sources.http import _Reader

    rows = list(_Reader({"urls": "http://127.0.0.1:9/a http://127.0.0.1:9/b", "skip_errors": "true", "pause": "0"}).read(None))
    assert len(rows) == 2 and all(r[2] is None and r[3] for r in rows)
    with pytest.raises(OSError):
        list(_Reader({"urls": "http://127.0.0.1:9/a"}).read(None))


def test_backtest_equity_sums_pnl(spark, sf):
    from tidemark.sources import proxy

    out = backtest.run_backtest(proxy.predictions(spark, sf), proxy.prices(spark, sf))
    total = out["trades"].agg(F.sum("pnl")).first()[0]
    last = out["equity_curve"].orderBy(F.desc("day")).first()
    assert last.equity - 1_000_000 == pytest.approx(total)


def test_ingest_and_label(spark, tmp_path, market):
    from tidemark.plans import pipelines

    days, f, ret = market
    px, fac = frames(spark, days, f, ret)
    index = spark.createDataFrame(
        [("a-1", days[300], datetime(2024, 10, 27, 5), "8-K", "m.htm", "2.02", "A", "0000000001"), ("a-2", days[301], datetime(2024, 10, 28, 5), "8-K/A", "m.htm", "", "A", "0000000001")],
        "accessionNumber string, filingDate date, acceptanceDateTime timestamp_ntz, form string, primaryDocument string, items string, ticker string, cik string",
    )
    docs = spark.createDataFrame([("a-1", 2, "x-ex99.htm", "<p>more</p>"), ("a-1", 0, "m.htm", "<b>Item 2.02</b> main"), ("a-1", 1, "r.xml", "no")], "accessionNumber string, position int, name string, html string")
    pipelines.ingest_and_label(spark, index, docs, px, fac, str(tmp_path))
    got = spark.read.parquet(pipelines.labeled_path(str(tmp_path))).collect()
    assert len(got) == 1 and got[0].body_text == "Item 2.02 main more" and got[0].exhibits == ["x-ex99.htm"] and got[0].items_in_body == ["2.02"]
    assert got[0].car_0_1 is not None and got[0].t0 is not None
    assert pipelines.for_each_cell([("A", 1), ("B", 2)], lambda t, y: 1 / (y - 2))["failed"][0][:2] == ("B", 2)
