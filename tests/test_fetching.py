"""Fetching from a service that fails: once, always, at a document, a list, an exhibit; and a run that is cut off."""

from __future__ import annotations

import http.server
import json
import threading
from collections import Counter
from datetime import date

import pytest

from tidemark.plans import pipelines


def filed(n, year, cik=17):
    return {"accessionNumber": f"00{cik}-{year % 100}-00000{n}", "filingDate": f"{year}-03-0{n}", "acceptanceDateTime": f"{year}-03-0{n}T21:00:00.000Z", "form": "8-K", "primaryDocument": f"m{n}.htm", "primaryDocDescription": "", "items": "8.01"}


def columns(rows):
    return {k: [r[k] for r in rows] for k in rows[0]}


def folder(n, year, cik=17):
    return f"/Archives/edgar/data/{cik}/00{cik}{year % 100}00000{n}"


@pytest.fixture()
def service():
    """(address, pages, statuses to give per path, paths asked for)."""
    pages = {"/files/company_tickers.json": {"0": {"cik_str": 17, "ticker": "AA", "title": "A"}, "1": {"cik_str": 18, "ticker": "BB", "title": "B"}}}
    for cik, years in ((17, (2020, 2021)), (18, (2020,))):
        rows = [filed(n, y, cik) for y in years for n in (1, 2)]
        pages[f"/submissions/CIK{cik:010d}.json"] = {"filings": {"recent": columns(rows[1:]), "files": [{"name": f"CIK{cik:010d}-submissions-001.json"}]}}
        pages[f"/submissions/CIK{cik:010d}-submissions-001.json"] = columns(rows[:1])
        for y in years:
            for n in (1, 2):
                at = folder(n, y, cik)
                pages |= {f"{at}/index.json": {"directory": {"item": [{"name": f"m{n}.htm"}, {"name": "x-ex99.htm"}]}}, f"{at}/m{n}.htm": f"<p>main {n}</p>", f"{at}/x-ex99.htm": "<p>exhibit</p>"}
    bad: dict[str, list[int]] = {}
    asked: list[str] = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            wrong = bad.get(self.path, [])
            status = wrong[0] if wrong else 200 if self.path in pages else 404
            if len(wrong) > 1 or wrong and wrong[0] > 0:
                bad[self.path] = wrong[1:]
            if status <= 0:  # no answer, always
                self.close_connection = True
                return
            page = pages.get(self.path, "")
            body = (page if isinstance(page, str) else json.dumps(page)).encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}", pages, bad, asked
    server.shutdown()


def ingest(spark, url, root, tickers=("AA", "BB"), **how):
    done = pipelines.fetch_and_ingest(spark, list(tickers), date(2020, 1, 1), date(2022, 1, 1), str(root), www=url, data=url, pause=0, **({"retries": 2, "backoff": 0.0} | how))
    there = spark.read.parquet(pipelines.edgar_path(str(root))).select("ticker", "year", "accessionNumber", "body_text", "exhibits").collect()
    return done, {(r.ticker, r.year, r.accessionNumber): r for r in there}


def test_a_server_that_fails_twice_and_then_answers(spark, service, tmp_path):
    url, pages, bad, asked = service
    bad |= {p: [503, 429] for p in pages}
    done, got = ingest(spark, url, tmp_path)
    assert done.failed == [] and len(got) == 6
    assert all(r.body_text == f"main {r.accessionNumber[-1]} exhibit" for r in got.values())
    assert set(Counter(asked).values()) == {3}


def test_failures_name_their_cells_and_are_mended_by_the_next_run(spark, service, tmp_path):
    url, pages, bad, asked = service
    main, listing, exhibit = f"{folder(1, 2020)}/m1.htm", f"{folder(2, 2021)}/index.json", f"{folder(2, 2020, 18)}/x-ex99.htm"

    bad |= {main: [503] * 50, listing: [500] * 50, exhibit: [503] * 50}
    done, got = ingest(spark, url, tmp_path)
    assert sorted((t, y) for t, y, _ in done.failed) == [("AA", 2020), ("AA", 2021)]
    assert all("503" in e or "500" in e for _, _, e in done.failed) and any(main in e for _, _, e in done.failed)
    # an exhibit that is refused with a status is left out, its filing stays; the others go on
    assert set(got) == {("BB", 2020, "0018-20-000001"), ("BB", 2020, "0018-20-000002")}
    assert got["BB", 2020, "0018-20-000002"].body_text == "main 2" and got["BB", 2020, "0018-20-000002"].exhibits == []
    bad.clear()
    asked.clear()
    done, got = ingest(spark, url, tmp_path)
    assert done.failed == [] and len(got) == 6 and got["AA", 2020, "0017-20-000001"].body_text == "main 1 exhibit"
    # only what had failed, and what its list now names, is asked for
    assert set(asked) == {main, listing, exhibit, f"{folder(2, 2021)}/x-ex99.htm"} and len(asked) == 4


def test_an_exhibit_without_an_answer_fails_its_cell(spark, service, tmp_path):
    url, pages, bad, _ = service
    bad[f"{folder(1, 2020, 18)}/x-ex99.htm"] = [0]
    done, got = ingest(spark, url, tmp_path, retries=1)
    assert [(t, y) for t, y, _ in done.failed] == [("BB", 2020)] and {k[0] for k in got} == {"AA"}


def test_a_main_document_that_is_gone_is_no_filing(spark, service, tmp_path):
    url, pages, _, _ = service
    del pages[f"{folder(1, 2021)}/m1.htm"]
    done, got = ingest(spark, url, tmp_path)
    assert [(t, y) for t, y, _ in done.failed] == [("AA", 2021)]
    assert {(t, y) for t, y, _ in got} == {("AA", 2020), ("BB", 2020)}


def test_tickers_without_a_company_or_an_index(spark, service, tmp_path):
    url, pages, bad, _ = service
    bad["/submissions/CIK0000000018-submissions-001.json"] = [503] * 50
    done, got = ingest(spark, url, tmp_path, tickers=("NONE", "AA", "BB"))
    assert sorted((t, y) for t, y, _ in done.failed) == [("BB", None), ("NONE", None)] and {k[0] for k in got} == {"AA"}
    with pytest.raises(KeyError):
        pipelines.fetch_and_ingest(spark, ["NONE"], date(2020, 1, 1), date(2022, 1, 1), str(tmp_path), www=url, data=url, pause=0)


def test_a_run_that_is_cut_off_asks_for_nothing_twice(spark, service, tmp_path):
    url, pages, _, asked = service
    paths = sorted(pages)
    want = [url + p for p in paths]
    pipelines.fetch(spark, want[:4], f"{tmp_path}/log", "a", 0, batch=2)  # two commits, and then the end
    assert len(asked) == 4 and pipelines.answers(spark, f"{tmp_path}/log").count() == 4
    pipelines.fetch(spark, want, f"{tmp_path}/log", "a", 0, batch=3)
    assert set(Counter(asked).values()) == {1} and len(asked) == len(want)
    assert pipelines.answers(spark, f"{tmp_path}/log").where("body IS NOT NULL").count() == len(want)
