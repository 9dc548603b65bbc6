"""The command line's stages, each through main(), on a small service of its own."""

from __future__ import annotations

import http.server
import json
import math
import random
import threading
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import backtest, features, inference
from tidemark.sources import dims, sinks

RECENT = {
    "accessionNumber": ["0001-24-000003", "0001-24-000002", "0001-24-000009"], "filingDate": ["2024-03-05", "2024-02-01", "2024-03-06"], "acceptanceDateTime": ["2024-03-05T21:00:00.000Z", "2024-02-01T13:00:00.000Z", "2024-03-06T13:00:00.000Z"],
    "form": ["8-K", "8-K", "10-Q"], "primaryDocument": ["c.htm", "b.htm", "q.htm"], "primaryDocDescription": ["", "", ""], "items": ["8.01", "2.02,9.01", ""],
}
OLDER = {k: [v] for k, v in zip(RECENT, ("0001-19-000001", "2019-05-06", "2019-05-06T12:00:00.000Z", "8-K", "a.htm", "", "1.01"))}
PAGES = {
    "/files/company_tickers.json": {"0": {"cik_str": 17, "ticker": "JPM", "title": "Bank"}, "1": {"cik_str": 18, "ticker": "XOM", "title": "Oil"}},
    "/submissions/CIK0000000017.json": {"filings": {"recent": RECENT, "files": [{"name": "CIK0000000017-submissions-001.json"}]}},
    "/submissions/CIK0000000017-submissions-001.json": OLDER,
    "/Archives/edgar/data/17/000124000003/index.json": {"directory": {"item": [{"name": "c.htm"}, {"name": "c-ex99.htm"}, {"name": "gone-ex99.htm"}, {"name": "r.xml"}]}},
    "/Archives/edgar/data/17/000124000003/c.htm": "<p>Item 8.01 the main text</p>",
    "/Archives/edgar/data/17/000124000003/c-ex99.htm": "<p>an exhibit</p>",
    "/Archives/edgar/data/17/000124000002/b.htm": "<p>Item 2.02 results</p>",
    "/Archives/edgar/data/17/000119000001/a.htm": "<p>old</p>",
}


@pytest.fixture(scope="module")
def service():
    asked: list[str] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            page = PAGES.get(self.path)
            body = (page if isinstance(page, str) else json.dumps(page)).encode()
            self.send_response(200 if page is not None else 404)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", asked
    server.shutdown()


def run(capsys, *args):
    cli.main([str(a) for a in args])
    return json.loads(capsys.readouterr().out)


def test_ingest_label_dataset(spark, service, tmp_path, capsys):
    url, asked = service
    how = ("ingest", "--root", tmp_path, "--tickers", "JPM", "--start", "2019-01-01", "--end", "2025-01-01", "--www", url, "--data", url, "--pause", "0")
    assert run(capsys, *how) == [{"ticker": "JPM", "year": 2019, "n_filings": 1}, {"ticker": "JPM", "year": 2024, "n_filings": 2}]
    got = {r.accessionNumber: r for r in spark.read.parquet(f"{tmp_path}/filings").collect()}
    assert got["0001-24-000003"].body_text == "Item 8.01 the main text an exhibit" and got["0001-24-000003"].exhibits == ["c-ex99.htm"]
    assert {r.cik for r in got.values()} == {"0000000017"} and {r.form for r in got.values()} == {"8-K"}
    # addresses that answered aren't asked for again
    before = len(asked)
    run(capsys, *how)
    assert set(asked[before:]) == {"/Archives/edgar/data/17/000124000003/gone-ex99.htm", "/Archives/edgar/data/17/000124000002/index.json", "/Archives/edgar/data/17/000119000001/index.json"}
    with pytest.raises(KeyError):
        cli.main([str(a) for a in (*how[:4], "NONE", *how[5:])])
    capsys.readouterr()

    days = [d for d in (date(2022, 1, 3) + timedelta(i) for i in range(900)) if d.weekday() < 5]
    rng = random.Random(3)
    f = [[rng.gauss(0, 0.01) for _ in range(4)] for _ in days]
    level, prices = 100.0, []
    for i, d in enumerate(days):
        level *= 1 + f[i][0] + 0.3 * f[i][1] + rng.gauss(0, 0.003)
        prices.append(("JPM", d, level, level))
    spark.createDataFrame(prices, "ticker string, trade_date date, open double, close double").write.parquet(f"{tmp_path}/prices")
    spark.createDataFrame([(d, *x, 0.0001) for d, x in zip(days, f)], "date date, MKT_RF double, SMB double, HML double, MOM double, RF double").write.parquet(f"{tmp_path}/factors")
    out = run(capsys, "label", "--root", tmp_path, "--prices", f"{tmp_path}/prices", "--factors", f"{tmp_path}/factors", "--tickers", "JPM", "it's", "--start-year", "2019", "--end-year", "2024", "--combined", f"{tmp_path}/all")
    assert out["cells"] == [{"ticker": "JPM", "year": 2019, "n_events": 1, "n_labeled": 0}, {"ticker": "JPM", "year": 2024, "n_events": 2, "n_labeled": 2}]
    assert out["combined"] == [{"ticker": "JPM", "n_events": 3}]
    n = run(capsys, "dataset", "--events", f"{tmp_path}/all", "--out-dir", f"{tmp_path}/sets", "--train-end", "2024-02-15", "--val-end", "2025-01-01", "--test-end", "2026-01-01")
    # the one of 2019 has no label, that of February reports earnings
    assert n["train"] == 0 and n["val_prompt"] == n["val_labeled"] == 1


SCORER = """
class Scorer:
    def generate(self, prompts, max_new_tokens):
        return ["Direction: up\\nMateriality: material" if "XOM" in p else "?" for p in prompts]

    def log_probs(self, prompt, completions):
        return [float(-i) for i, _ in enumerate(completions)]
"""


def events(spark):
    rows = [(i, t, datetime(2020, 1, 6 + i, 15), "8.01", f"body {i}", d, True, c) for i, (t, d, c) in enumerate([("XOM", "up", 0.1), ("JPM", None, 0.2), ("JPM", "down", None), ("JPM", "down", float("nan")), ("JPM", "neutral", 0.0)])]
    return spark.createDataFrame(rows, "event_id int, ticker string, publish_ts timestamp_ntz, items string, body_text string, direction string, material boolean, car_0_1 double")


def test_events_without_a_label_are_in_no_split(spark, tmp_path):
    n = sinks.write_splits(events(spark), dims.sectors(spark), str(tmp_path))
    assert n["train"] == 2
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/train").collect()]
    assert sorted(x["meta"]["direction"] for x in lines) == ["neutral", "up"]
    # features are of the whole history: the last event's day gap is to the one before, labelled or not
    assert "Days since previous 8-K: 1" in next(x["text"] for x in lines if x["meta"]["direction"] == "neutral")


def test_infer_and_evaluate(spark, tmp_path, capsys):
    sinks.write_jsonl(features.event_features(events(spark), dims.sectors(spark)), f"{tmp_path}/prompts", False)
    (tmp_path / "scorer_of_tests.py").write_text(SCORER)
    spark.sparkContext.addPyFile(str(tmp_path / "scorer_of_tests.py"))
    scorer = "scorer_of_tests:Scorer"
    assert run(capsys, "infer", "--prompts", f"{tmp_path}/prompts", "--scorer", scorer, "--out", f"{tmp_path}/greedy") == {"n_rows": 5, "parseable_rate": 0.2}
    got = spark.read.parquet(f"{tmp_path}/greedy")
    assert got.columns == ["ticker", "sector", "publish_ts_utc", "direction", "materiality", "car_0_1", "car_z_0_1", "items", "raw_response", "pred_direction", "pred_materiality"]
    assert {(r.ticker, r.pred_direction) for r in got.collect()} == {("XOM", "up"), ("JPM", None)}
    assert run(capsys, "infer-probs", "--prompts", f"{tmp_path}/prompts", "--scorer", scorer, "--out", f"{tmp_path}/probs")["parseable_rate"] == 1.0
    one = spark.read.parquet(f"{tmp_path}/probs").first()
    assert one.pred_direction == "down" and one.pred_p_down == pytest.approx(1 / (1 + math.exp(-1) + math.exp(-2)))
    report = run(capsys, "evaluate", "--predictions", f"{tmp_path}/probs")
    assert {"overall", "by_ticker", "by_year", "by_sector"} == set(report) and any(r["metric"] == "accuracy" for r in report["overall"])
    assert {"predicted", "truth", "issues", "edge"} == set(run(capsys, "diagnose", "--dataset-dir", _train(spark, tmp_path), "--predictions", f"{tmp_path}/probs"))


def _train(spark, tmp_path):
    sinks.write_splits(events(spark), dims.sectors(spark), f"{tmp_path}/sets")
    return f"{tmp_path}/sets"


def test_canary_and_spot_check(spark, tmp_path, capsys):
    rows = [(f"a-{i}", "JPM", datetime(2020, 1, 1 + i, 15), "2.02" if i % 3 == 0 else "8.01", f"body {i} " + ("rises" if i % 2 else "falls"), 0.01 * (-1) ** i, None if i == 5 else 0.02 * (i % 4 - 1.5), float(i)) for i in range(16)]
    spark.createDataFrame(rows, "accessionNumber string, ticker string, acceptanceDateTime timestamp, items string, body_text string, car_0_1 double, car_minus1_0 double, car_z_0_1 double").write.parquet(f"{tmp_path}/e")
    got = {r["events"]: r for r in run(capsys, "canary", "--events", f"{tmp_path}/e")}
    assert got["all"]["n_events"] == 15 and got["without_earnings"]["n_events"] == 9
    assert got["all"]["verdict"] in ("INCONCLUSIVE", "INSUFFICIENT_DATA") and got["without_earnings"]["verdict"] == "INSUFFICIENT_DATA"
    top = run(capsys, "spot-check", "--events", f"{tmp_path}/e")
    assert [r["accessionNumber"] for r in top] == [f"a-{i}" for i in range(15, 5, -1)] and "Item 2.02" in top[0]["items_described"]


def test_backtest_stage(spark, sf, tmp_path, capsys):
    from tidemark.sources import proxy

    proxy.predictions(spark, sf).write.parquet(f"{tmp_path}/p")
    proxy.prices(spark, sf).write.parquet(f"{tmp_path}/px")
    out = run(capsys, "backtest", "--predictions", f"{tmp_path}/p", "--prices", f"{tmp_path}/px", "--out-dir", f"{tmp_path}/out")
    assert out["n_trades"] == spark.read.parquet(f"{tmp_path}/out/trades").count() > 0


def test_trades_need_finite_prices(spark):
    days = [date(2024, 1, d) for d in (2, 3, 4, 5)]
    predictions = spark.createDataFrame([(t, datetime(2024, 1, 2, 12), 0.9, 0.1, 0.9) for t in "ABC"], "ticker string, publish_ts_utc timestamp, pred_p_up double, pred_p_down double, pred_p_material double")
    opens = {"A": [1.0, 1, 1, 1], "B": [float("inf"), 1, 1, 1], "C": [1.0, 1, float("inf"), 1]}
    prices = spark.createDataFrame([(t, d, float(o)) for t, x in opens.items() for d, o in zip(days, x)], "ticker string, trade_date date, open double")
    got = backtest.trades(predictions, prices, backtest.BacktestConfig(holding_days=2)).collect()
    assert [r.ticker for r in got] == ["A"]


@pytest.mark.parametrize(("before", "whole", "want"), [([1, 2, 3], [1, 2, 3, 4, 5], 3), ([1, 2, 3], [1, 2, 9, 4], 2), ([1, 2, 3], [1, 2, 3], 3), ([], [7], 0), ([1, 2, 3], [1, 2], 2), ([5], [], 0)])
def test_shared_prefix(before, whole, want):
    assert inference.shared_prefix(before, whole) == want
    got = inference.completion_log_prob(before, whole, [-1.0] * len(whole))
    assert got == (None if want == len(whole) else -float(len(whole) - want))
