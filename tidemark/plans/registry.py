"""Every operator as a query over the driver's tables, with the SQL that must give the same rows.

Doubles are rounded on both sides, since engines sum in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clock, numeric, text
from ..operators import backtest, calendar, canary, diagnose, features, inference, labels, metrics, returns, splits
from ..sources import dims, factors, filings, proxy, sinks
from ..session import table
from . import oracle as O

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def r6(name: str, digits: int = 6):
    return F.round(F.col(name), digits).alias(name)


# ---- sources and sinks


def _index_json(spark: SparkSession, sf: str) -> DataFrame:
    """One JSON object of parallel arrays per customer, from its orders."""
    o = table(spark, sf, "orders").select(
        "o_custkey", F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 10 == 0, F.lit("bad")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("d"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("t"), F.when(F.col("o_orderkey") % 3 == 0, F.lit("8-K/A")).otherwise(F.lit("8-K")).alias("f"), "o_orderpriority",
    )
    rows = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "d", "t", "f", "o_orderpriority"))).alias("a"))
    arr = lambda name: F.transform("a", lambda x: x[name].cast("string"))
    obj = F.struct(arr("k").alias("accessionNumber"), arr("d").alias("filingDate"), arr("t").alias("acceptanceDateTime"), arr("f").alias("form"), arr("o_orderpriority").alias("primaryDocument"))
    return rows.select("o_custkey", F.to_json(obj).alias("json"))


@query("""
SELECT o_custkey, CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filing_date,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS accepted, CASE WHEN o_orderkey % 3 = 0 THEN '8-K/A' ELSE '8-K' END AS form, o_orderpriority AS primary_document, '' AS description, '' AS items
FROM orders""")
def columnar_json_to_rows(spark, sf):
    rows = filings.columnar_json_to_rows(_index_json(spark, sf), keep=("o_custkey",))
    return rows.select(
        "o_custkey", F.col("accessionNumber").alias("accession"), F.col("filingDate").cast("string").alias("filing_date"), F.date_format("acceptanceDateTime", "yyyy-MM-dd HH:mm:ss").alias("accepted"), "form",
        F.col("primaryDocument").alias("primary_document"), F.col("primaryDocDescription").alias("description"), "items",
    )


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS accession, CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS filing_date FROM orders WHERE o_orderkey % 3 <> 0""")
def list_filings(spark, sf):
    rows = filings.columnar_json_to_rows(_index_json(spark, sf), keep=("o_custkey",))
    recent, older = rows.where("o_custkey % 2 = 0"), rows.where("o_custkey % 2 = 1")
    return filings.list_filings(recent, older).select(F.col("accessionNumber").alias("accession"), F.col("filingDate").cast("string").alias("filing_date"))


@query("""SELECT upper(c_name) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, c_mktsegment AS title FROM customer""")
def ticker_to_cik(spark, sf):
    c = table(spark, sf, "customer")
    one = F.to_json(F.create_map(F.col("c_custkey").cast("string"), F.struct(F.col("c_custkey").alias("cik_str"), F.upper("c_name").alias("ticker"), F.col("c_mktsegment").alias("title"))))
    return filings.parse_company_tickers(c.select(one.alias("json")), "json")


@query(rf"""
WITH t AS (SELECT page_id // 4 AS filing, page_id, page_id % 4 = 0 AS main, {O.strip_html("html")} AS s FROM pages),
c AS (SELECT filing, page_id, main, CASE WHEN main THEN substring(s, 1, 4000) ELSE substring(s, 1, 8000) END AS s FROM t)
SELECT filing, CAST(sum(CASE WHEN main THEN 0 ELSE 1 END) AS BIGINT) AS n_exhibits, md5(substring(trim(string_agg(s, ' ' ORDER BY CASE WHEN main THEN 0 ELSE 1 END, page_id)), 1, 12000)) AS body_md5 FROM c GROUP BY filing""")
def filing_text_assembly(spark, sf):
    parts = table(spark, sf, "pages").select(F.expr("page_id div 4").alias("filing"), "page_id", (F.col("page_id") % 4 == 0).alias("main"), "html")
    out = filings.assemble_text(parts, "filing", "page_id", "html", "main")
    return out.select("filing", "n_exhibits", F.md5("body_text").alias("body_md5"))


@query("""
SELECT page_id, name FROM (SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'main.htm' WHEN 1 THEN 'a-EX99_1.htm' WHEN 2 THEN 'x_ex-99.TXT' WHEN 3 THEN 'exhibit991.html' WHEN 4 THEN 'ex99.jpg' ELSE 'r1.htm' END AS name FROM pages)
WHERE name <> 'main.htm' AND regexp_matches(lower(name), '(htm|html|txt)$') AND regexp_matches(lower(name), 'ex-?99|exhibit99')""")
def exhibit_predicate(spark, sf):
    k = F.col("page_id") % 6
    name = F.element_at(F.array(*[F.lit(x) for x in ("main.htm", "a-EX99_1.htm", "x_ex-99.TXT", "exhibit991.html", "ex99.jpg", "r1.htm")]), (k + 1).cast("int"))
    rows = table(spark, sf, "pages").select("page_id", name.alias("name"), F.lit("main.htm").alias("primaryDocument"))
    return filings.exhibits(rows).select("page_id", "name")


@query("""
SELECT CAST(y AS VARCHAR) AS file, CAST(d AS DATE) AS date, round((v % 700) / 100.0 / 100, 8) AS mkt, round((v % 300) / 100.0 / 100, 8) AS rf
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, year(o_orderdate) AS y, dayofyear(o_orderdate) * 13 AS v FROM orders)""")
def sectioned_csv_scan(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("d")).distinct().withColumn("file", F.year("d").cast("string")).withColumn("v", F.dayofyear("d") * 13)
    pct = lambda n: F.format_string("%.2f", (F.col("v") % n) / F.lit(100.0))
    body = days.select("file", F.concat(F.date_format("d", "yyyyMMdd"), F.lit(",  "), pct(700), F.lit(","), pct(300)).alias("line"))
    body = body.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("l"))
    pre, post = F.array(F.lit("A preamble, of words"), F.lit(""), F.lit(",Mkt,RF")), F.array(F.lit(""), F.lit(" Annual Factors"), F.lit("19260701,  9.99,9.99"), F.lit("1927,  1,1"))
    lines = body.select("file", F.posexplode(F.concat(pre, "l", post)).alias("line_no", "line"))
    return factors.sectioned_csv(lines, ["mkt", "rf"]).select("file", "date", r6("mkt", 8), r6("rf", 8))


@query(f"""WITH {O.FILINGS}, {O.FEATURES} SELECT event_id, md5(u) AS prompt_md5 FROM (SELECT event_id, {O.USER_PROMPT} AS u FROM feat)""")
def render_user_prompt(spark, sf):
    rows = features.prompts(features.event_features(proxy.filings(spark, sf), dims.sectors(spark)), False)
    return rows.select("event_id", F.md5(F.col("messages")[1]["content"]).alias("prompt_md5"))


@query(f"""WITH {O.FILINGS}, {O.FEATURES} SELECT event_id, 3 AS n_turns, md5({O.chat(True)}) AS text_md5, md5({O.chat(False)}) AS open_md5 FROM feat""")
def to_messages(spark, sf):
    rows = features.event_features(proxy.filings(spark, sf), dims.sectors(spark))
    full = features.prompts(rows, True).select("event_id", F.size("messages").alias("n_turns"), F.md5("text").alias("text_md5"), F.md5(text.chat_template(F.slice("messages", 1, 2), generation=True)).alias("open_md5"))
    return full


@query(f"""WITH {O.FILINGS}, {O.FEATURES}
SELECT event_id, {O.chat(True)} AS text, ticker, sector, strftime(publish_ts, '%Y-%m-%dT%H:%M:%S+00:00') AS publish_ts_utc, direction, CASE WHEN material THEN 'material' ELSE 'immaterial' END AS materiality, CAST(NULL AS DOUBLE) AS car, items FROM feat""")
def prompt_jsonl(spark, sf):
    rows = features.prompts(features.event_features(proxy.filings(spark, sf), dims.sectors(spark)), True)
    lines = rows.select("event_id", sinks.training_json(rows).alias("value"))
    from ..schemas import TRAINING_ROW

    back = lines.select("event_id", F.from_json("value", TRAINING_ROW).alias("j"))
    m = lambda c: F.col(f"j.meta.{c}").alias(c)
    return back.select("event_id", F.col("j.text").alias("text"), m("ticker"), m("sector"), m("publish_ts_utc"), m("direction"), m("materiality"), F.col("j.meta.car_0_1").alias("car"), m("items"))


# ---- projections, filters, predicates


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1996-01-01'""")
def date_range_filter(spark, sf):
    return splits.date_range(table(spark, sf, "orders"), "o_orderdate", date(1995, 1, 1), date(1996, 1, 1)).select("o_orderkey", "o_totalprice")


@query(f"""WITH {O.EVENTS} SELECT event_id, items FROM ev WHERE NOT regexp_matches(coalesce(items, ''), '\\b2\\.02\\b')""")
def drop_earnings(spark, sf):
    return splits.drop_earnings(proxy.events(spark, sf)).select("event_id", "items")


@query(f"""WITH {O.EVENTS} SELECT event_id, items FROM ev WHERE regexp_matches(coalesce(items, ''), '\\b2\\.02\\b')""")
def earnings_only(spark, sf):
    return splits.earnings_only(proxy.events(spark, sf)).select("event_id", "items")


@query(f"""WITH {O.PRED} SELECT event_id, direction, car_0_1 FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL AND car_0_1 IS NOT NULL""")
def require_complete(spark, sf):
    return splits.require(proxy.predictions(spark, sf), ["direction", "pred_direction", "car_0_1"]).select("event_id", "direction", "car_0_1")


@query(f"""WITH {O.PRED} SELECT event_id, {O.SIGNAL} AS signal FROM pr""")
def trade_signal(spark, sf):
    return proxy.predictions(spark, sf).select("event_id", backtest.trade_signal(F.col("pred_p_up"), F.col("pred_p_down"), F.col("pred_p_material")).alias("signal"))


@query("""SELECT event_id, CASE WHEN value / 40 - 1 < -0.75 THEN 'down' WHEN value / 40 - 1 > 0.75 THEN 'up' WHEN value IS NOT NULL THEN 'neutral' END AS direction FROM events""")
def direction_label(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.direction_label(F.col("value") / 40 - 1).alias("direction"))


@query("""SELECT event_id, abs(value / 40 - 1) > 1.5 AS material FROM events""")
def materiality_label(spark, sf):
    return table(spark, sf, "events").select("event_id", numeric.materiality_label(F.col("value") / 40 - 1).alias("material"))


@query("""SELECT n, auc, CASE WHEN auc IS NULL THEN 'INSUFFICIENT_DATA' WHEN n < 200 THEN 'INCONCLUSIVE' WHEN auc > 0.62 THEN 'FAIL' WHEN auc > 0.56 THEN 'WARN' ELSE 'PASS' END AS verdict
FROM (SELECT user_id, count(*) AS n, CASE WHEN user_id % 9 <> 0 THEN 0.4 + (user_id % 30) / 100.0 END AS auc FROM (SELECT user_id % 500 AS user_id FROM events UNION ALL SELECT o_custkey % 40 FROM orders) GROUP BY user_id)""")
def sample_size_verdict(spark, sf):
    both = table(spark, sf, "events").select((F.col("user_id") % 500).alias("u")).unionAll(table(spark, sf, "orders").select(F.col("o_custkey") % 40))
    rows = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).withColumn("auc", F.when(F.col("u") % 9 != 0, 0.4 + (F.col("u") % 30) / 100.0))
    return rows.select("n", "auc", canary.verdict(F.col("n"), F.col("auc")).alias("verdict"))


# ---- joins


@query(f"""WITH {O.FAC} SELECT date, round(MKT_RF, 6) AS MKT_RF, round(MOM, 6) AS MOM FROM fac""")
def factor_inner_join(spark, sf):
    f = proxy.factors(spark, sf)
    return returns.join_factors(f.select("date", "MKT_RF"), f.select("date", "MOM")).select("date", r6("MKT_RF"), r6("MOM"))


@query(f"""WITH {O.PX}, {O.FAC}, {O.RET} SELECT ticker, r.d AS trade_date, round(ret - RF, 6) AS excess FROM ret r JOIN fac ON r.d = fac.date WHERE ret IS NOT NULL""")
def excess_return_join(spark, sf):
    return returns.excess_returns(proxy.prices(spark, sf), proxy.factors(spark, sf)).select("ticker", "trade_date", r6("excess"))


@query(f"""WITH {O.PX}, {O.EVENTS}, {O.target("ev", "<")}
SELECT event_id, ticker, (SELECT min(px.d) FROM px WHERE px.ticker = tg.ticker AND px.d >= tg.target) AS t0 FROM tg""")
def next_session_asof(spark, sf):
    return calendar.next_session(proxy.events(spark, sf), proxy.prices(spark, sf).select("ticker", "trade_date"), by=["ticker"]).select("event_id", "ticker", "t0")


@query(f"""WITH {O.PX}, {O.EVENTS}, {O.target("ev", "<=")}
SELECT event_id, ticker, (SELECT min(px.d) FROM px WHERE px.ticker = tg.ticker AND px.d >= tg.target) AS entry_day FROM tg""")
def entry_session_asof(spark, sf):
    return calendar.entry_session(proxy.events(spark, sf), proxy.prices(spark, sf).select("ticker", "trade_date"), by=["ticker"]).select("event_id", "ticker", "entry_day")


@query(f"""WITH {O.PX}, s AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY d) AS seq FROM px)
SELECT ticker, d AS trade_date, CAST(count(*) OVER w AS BIGINT) AS n, CAST(sum(volume) OVER w AS BIGINT) AS total FROM s WINDOW w AS (PARTITION BY ticker ORDER BY seq RANGE BETWEEN 30 PRECEDING AND 6 PRECEDING)""")
def offset_window_join(spark, sf):
    p = proxy.prices(spark, sf)
    rows = p.join(calendar.ordinals(p.select("ticker", "trade_date"), by=["ticker"]), ["ticker", "trade_date"])
    w = calendar.offset_window("seq", -30, -5, ["ticker"])
    return rows.select("ticker", "trade_date", F.count(F.lit(1)).over(w).alias("n"), F.sum("volume").over(w).alias("total"))


@query(f"""WITH {O.PX} SELECT ticker, d AS trade_date, lead(d, 10) OVER w AS exit_day, lead(px, 10) OVER w AS exit_price FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d)""")
def exit_offset_lookup(spark, sf):
    return proxy.prices(spark, sf).select("ticker", "trade_date", calendar.ahead("trade_date", 10).alias("exit_day"), calendar.ahead("open", 10).alias("exit_price"))


@query(f"""WITH {O.FILINGS}, {O.SECTORS} SELECT event_id, lower(f.ticker) AS ticker, coalesce(sector, 'Unknown') AS sector FROM (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'ZZZ' ELSE ticker END AS ticker FROM fl) f LEFT JOIN sectors s ON s.ticker = f.ticker""")
def sector_lookup(spark, sf):
    rows = proxy.filings(spark, sf).select("event_id", F.lower(F.when(F.col("event_id") % 10 == 3, F.lit("ZZZ")).otherwise(F.col("ticker"))).alias("ticker"))
    return features.with_sector(rows, dims.sectors(spark)).select("event_id", "ticker", "sector")


@query(f"""WITH {O.EVENTS}, {O.ITEMS}
SELECT event_id, coalesce((SELECT string_agg('  Item ' || trim(x.i) || ': ' || coalesce(d.description, '?'), chr(10) ORDER BY x.n) FROM (SELECT unnest(string_split(ev.items, ',')) AS i, generate_subscripts(string_split(ev.items, ','), 1) AS n) x LEFT JOIN itemdim d ON d.item = trim(x.i)), '') AS described FROM ev""")
def item_describe(spark, sf):
    return proxy.events(spark, sf).select("event_id", features.described_items(F.col("items"), dims.ITEM_NAMES).alias("described"))


@query("""WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS v FROM orders GROUP BY 1)
SELECT CAST(g.day AS DATE) AS day, round(coalesce(v, 0), 2) AS v FROM (SELECT unnest(generate_series((SELECT min(day) FROM d), (SELECT max(day) FROM d), INTERVAL 1 DAY)) AS day) g LEFT JOIN d ON d.day = CAST(g.day AS DATE) WHERE isodow(g.day) < 6""")
def calendar_densify(spark, sf):
    daily = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    return calendar.densify(daily, "day", {"v": 0.0}).select("day", r6("v", 2))


# ---- regression labels


def _session_labels(spark: SparkSession, sf: str) -> DataFrame:
    return labels.session_labels(proxy.prices(spark, sf), proxy.factors(spark, sf))


@query(f"WITH {O.OLS} SELECT ticker, d AS trade_date, round(alpha, 5) AS alpha, {', '.join(f'round(b{i}, 4) AS beta{i}' for i in range(4))} FROM ols WHERE b0 IS NOT NULL")
def rolling_factor_ols(spark, sf):
    rows = labels.factor_model(labels.panel(proxy.prices(spark, sf), proxy.factors(spark, sf)))
    return rows.where("beta0 IS NOT NULL").select("ticker", "trade_date", r6("alpha", 5), *[r6(f"beta{i}", 4) for i in range(4)])


@query(f"WITH {O.OLS} SELECT ticker, d AS trade_date, round(r2, 6) AS r2 FROM ols WHERE r2 IS NOT NULL")
def factor_r2(spark, sf):
    rows = labels.factor_model(labels.panel(proxy.prices(spark, sf), proxy.factors(spark, sf)))
    return rows.where("r2 IS NOT NULL").select("ticker", "trade_date", r6("r2"))


@query(f"WITH {O.OLS}, {O.SIGMA} SELECT ticker, d AS trade_date, round(sigma, 6) AS sigma FROM sig WHERE sigma IS NOT NULL")
def idio_sigma(spark, sf):
    rows = labels.idio_sigma(labels.factor_model(labels.panel(proxy.prices(spark, sf), proxy.factors(spark, sf))))
    return rows.where("sigma IS NOT NULL").select("ticker", "trade_date", r6("sigma"))


@query(f"WITH {O.OLS}, {O.SIGMA}, {O.CAR} SELECT ticker, d AS trade_date, round(car_0_1, 6) AS car_0_1, round(car_m1_0, 6) AS car_minus1_0 FROM car WHERE car_0_1 IS NOT NULL OR car_m1_0 IS NOT NULL")
def car_window(spark, sf):
    rows = labels.factor_model(labels.panel(proxy.prices(spark, sf), proxy.factors(spark, sf)))
    rows = labels.car_window(labels.car_window(rows, 0, 1, "car_0_1"), -1, 0, "car_minus1_0")
    return rows.where("car_0_1 IS NOT NULL OR car_minus1_0 IS NOT NULL").select("ticker", "trade_date", r6("car_0_1"), r6("car_minus1_0"))


@query(f"WITH {O.OLS}, {O.SIGMA}, {O.CAR} SELECT ticker, d AS t0, round(sigma * sqrt(2.0), 6) AS sigma_window, round(CASE WHEN sigma > 0 THEN car_0_1 / (sigma * sqrt(2.0)) ELSE 0 END, 4) AS z FROM car WHERE car_0_1 IS NOT NULL AND sigma IS NOT NULL")
def sigma_window_z(spark, sf):
    rows = _session_labels(spark, sf).where("car_0_1 IS NOT NULL")
    return rows.select("ticker", "t0", F.round("sigma_window_0_1", 6).alias("sigma_window"), F.round("car_z_0_1", 4).alias("z"))


@query(f"""WITH {O.OLS}, {O.SIGMA}, {O.CAR}, {O.EVENTS}, {O.target("ev", "<")},
placed AS (SELECT tg.*, (SELECT min(px.d) FROM px WHERE px.ticker = tg.ticker AND px.d >= tg.target) AS t FROM tg),
z AS (SELECT *, CASE WHEN sigma > 0 THEN car_0_1 / (sigma * sqrt(2.0)) ELSE 0 END AS z FROM car WHERE car_0_1 IS NOT NULL AND sigma IS NOT NULL)
SELECT event_id, placed.ticker, CASE WHEN z.z IS NOT NULL THEN t END AS t0, round(car_0_1, 6) AS car_0_1, round(z.z, 4) AS car_z_0_1,
 CASE WHEN z.z < -0.75 THEN 'down' WHEN z.z > 0.75 THEN 'up' WHEN z.z IS NOT NULL THEN 'neutral' END AS direction, abs(z.z) > 1.5 AS material, round(r2, 6) AS factor_r2, round(car_m1_0, 6) AS car_minus1_0
FROM placed LEFT JOIN z ON z.ticker = placed.ticker AND z.d = placed.t""")
def label_events(spark, sf):
    out = labels.label_events(proxy.events(spark, sf), proxy.prices(spark, sf), proxy.factors(spark, sf))
    # the check window of a session whose own window is cut off isn't shown, as that event has no label
    before = F.when(F.col("direction").isNotNull(), F.col("car_minus1_0"))
    return out.select("event_id", "ticker", "t0", r6("car_0_1"), r6("car_z_0_1", 4), "direction", "material", r6("factor_r2"), F.round(before, 6).alias("car_minus1_0"))


@query(f"WITH {O.OLS} SELECT ticker, d AS trade_date, round(alpha + b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3, 6) AS predicted FROM ols WHERE b0 IS NOT NULL AND x0 IS NOT NULL")
def predict_excess(spark, sf):
    rows = labels.factor_model(labels.panel(proxy.prices(spark, sf), proxy.factors(spark, sf))).where("beta0 IS NOT NULL AND x0 IS NOT NULL")
    value = numeric.predict_excess(F.col("alpha"), [F.col(f"beta{i}") for i in range(4)], [F.col(f"x{i}") for i in range(4)])
    return rows.select("ticker", "trade_date", F.round(value, 6).alias("predicted"))


# ---- windows


@query(f"WITH {O.PX}, {O.RET} SELECT ticker, d AS trade_date, round(ret, 6) AS ret FROM ret")
def simple_return(spark, sf):
    return proxy.prices(spark, sf).select("ticker", "trade_date", r6("ret"))


@query(f"""WITH {O.EVENTS} SELECT event_id, CAST(coalesce(date_diff('day', lag({O.ET_DATE}) OVER w, {O.ET_DATE}), -1) AS INTEGER) AS days_since FROM ev WINDOW w AS (PARTITION BY ticker ORDER BY publish_ts, event_id)""")
def days_since_prev(spark, sf):
    return features.days_since_previous(proxy.events(spark, sf)).select("event_id", "days_since")


@query(f"""WITH {O.EVENTS} SELECT event_id, CAST(count(*) OVER (PARTITION BY ticker, {O.ET_DATE}) AS BIGINT) AS n_same_day FROM ev""")
def same_day_count(spark, sf):
    return features.same_day_count(proxy.events(spark, sf)).select("event_id", "n_same_day")


@query(f"""WITH {O.EVENTS} SELECT event_id, CAST(count(*) OVER (PARTITION BY ticker, {O.ET_DATE} ORDER BY publish_ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_so_far FROM ev""")
def same_day_running_count(spark, sf):
    return features.same_day_count(proxy.events(spark, sf), out="n_so_far", running=True).select("event_id", "n_so_far")


@query("""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderdate, o_orderkey) <= CAST(floor((SELECT count(*) FROM orders) * CAST(0.7 AS DOUBLE)) AS BIGINT) THEN 'train' ELSE 'test' END AS part FROM orders""")
def time_ordered_holdout(spark, sf):
    return splits.time_holdout(table(spark, sf, "orders"), "o_orderdate", "o_orderkey").select("o_orderkey", "part")


# ---- backtest


def _trades(spark: SparkSession, sf: str) -> DataFrame:
    return backtest.trades(proxy.predictions(spark, sf), proxy.prices(spark, sf))


@query(f"WITH {O.TRADES} SELECT event_id, ticker, CAST(signal AS INTEGER) AS direction_signed, entry_day, exit_day, round(gross, 6) AS gross_return, round(net, 6) AS net_return, round(pnl, 4) AS pnl FROM tr")
def trade_returns(spark, sf):
    p = proxy.predictions(spark, sf)
    # the time of an event stands for its key here: keep the key beside the trades
    rows = backtest.trades(p, proxy.prices(spark, sf)).join(p.select("event_id", "ticker", "publish_ts_utc", "pred_p_up", "pred_p_down", "pred_p_material"), ["ticker", "publish_ts_utc", "pred_p_up", "pred_p_down", "pred_p_material"])
    return rows.select("event_id", "ticker", "direction_signed", "entry_day", "exit_day", r6("gross_return"), r6("net_return"), r6("pnl", 4))


@query(f"WITH {O.TRADES} SELECT exit_day AS day, round(sum(pnl), 4) AS daily_pnl FROM tr GROUP BY 1")
def daily_pnl(spark, sf):
    return backtest.daily_pnl(_trades(spark, sf)).select("day", r6("daily_pnl", 4))


@query(f"WITH {O.TRADES}, {O.EQUITY} SELECT day, round(daily_pnl, 4) AS daily_pnl, round(equity, 2) AS equity FROM eq")
def equity_curve(spark, sf):
    return backtest.equity_curve(backtest.daily_pnl(_trades(spark, sf))).select("day", r6("daily_pnl", 4), r6("equity", 2))


@query(f"WITH {O.TRADES}, {O.EQUITY} SELECT day, round(equity, 2) AS equity, round(max(equity) OVER (ORDER BY day), 2) AS peak, round(equity / max(equity) OVER (ORDER BY day) - 1, 6) AS drawdown FROM eq")
def equity_drawdown(spark, sf):
    curve = backtest.drawdown(backtest.equity_curve(backtest.daily_pnl(_trades(spark, sf))))
    return curve.select("day", r6("equity", 2), r6("peak", 2), r6("drawdown"))


@query(f"WITH {O.TRADES}, {O.EQUITY} SELECT day, round(max(equity) OVER (ORDER BY day), 2) AS peak FROM eq")
def running_peak(spark, sf):
    return backtest.drawdown(backtest.equity_curve(backtest.daily_pnl(_trades(spark, sf)))).select("day", r6("peak", 2))


@query(f"WITH {O.TRADES}, {O.EQUITY} SELECT round(min(dd), 6) AS max_drawdown FROM (SELECT equity / max(equity) OVER (ORDER BY day) - 1 AS dd FROM eq)")
def max_drawdown(spark, sf):
    return backtest.summary(_trades(spark, sf)).select(r6("max_drawdown"))


@query(f"WITH {O.TRADES}, {O.EQUITY}, {O.SUMMARY} SELECT round(sharpe_gross, 4) AS sharpe_gross, round(sharpe_net, 4) AS sharpe_net FROM sm")
def sharpe(spark, sf):
    return backtest.summary(_trades(spark, sf)).select(r6("sharpe_gross", 4), r6("sharpe_net", 4))


@query(f"""WITH {O.TRADES}, {O.EQUITY}, {O.SUMMARY} SELECT n_trades, n_long, n_short, round(hit_rate, 6) AS hit_rate, round(avg_gross, 6) AS avg_gross, round(avg_net, 6) AS avg_net, round(total_pnl, 2) AS total_pnl,
 round(total_pnl / 1000000, 6) AS total_return, round(daily_mean, 4) AS daily_mean, round(daily_std, 4) AS daily_std, active_days, n_tickers FROM sm""")
def backtest_summary(spark, sf):
    s = backtest.summary(_trades(spark, sf))
    return s.select(
        "n_trades", "n_long", "n_short", r6("hit_rate"), F.round("avg_gross_return_per_trade", 6).alias("avg_gross"), F.round("avg_net_return_per_trade", 6).alias("avg_net"), r6("total_pnl", 2), r6("total_return"),
        F.round("daily_pnl_mean", 4).alias("daily_mean"), F.round("daily_pnl_std", 4).alias("daily_std"), "active_days", F.col("n_unique_tickers_traded").alias("n_tickers"),
    )


@query(f"WITH {O.PRED} SELECT CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers, CAST(min(publish_ts_utc) AS DATE) - 30 AS start, CAST(max(publish_ts_utc) AS DATE) + 50 AS \"end\" FROM pr")
def price_bounds(spark, sf):
    return backtest.price_bounds(proxy.predictions(spark, sf))


# ---- metrics


def _pred(spark: SparkSession, sf: str) -> DataFrame:
    return proxy.predictions(spark, sf)


@query(f"WITH {O.PRED} SELECT ticker, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(direction = pred_direction AS INTEGER)), 6) AS accuracy FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL GROUP BY ticker")
def direction_accuracy(spark, sf):
    return metrics.direction_metrics(_pred(spark, sf), ["ticker"]).select("ticker", "n", r6("accuracy"))


@query(f"""WITH {O.PRED}, v AS (SELECT * FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL), c AS (SELECT ticker, direction, count(*) AS k FROM v GROUP BY ALL),
a AS (SELECT ticker, avg(CAST(direction = pred_direction AS INTEGER)) AS acc FROM v GROUP BY 1)
SELECT c.ticker, round(max(k) / sum(k), 6) AS majority_baseline, round((any_value(acc) - max(k) / sum(k)) * 100, 4) AS lift_over_majority_pp FROM c JOIN a ON a.ticker = c.ticker GROUP BY c.ticker""")
def majority_baseline(spark, sf):
    return metrics.direction_metrics(_pred(spark, sf), ["ticker"]).select("ticker", r6("majority_baseline"), r6("lift_over_majority_pp", 4))


@query(f"""WITH {O.PRED}, v AS (SELECT * FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL) SELECT ticker, round(avg(rec), 6) AS balanced_accuracy FROM (SELECT ticker, direction, avg(CAST(direction = pred_direction AS INTEGER)) AS rec FROM v GROUP BY ALL) GROUP BY ticker""")
def balanced_accuracy(spark, sf):
    return metrics.direction_metrics(_pred(spark, sf), ["ticker"]).select("ticker", r6("balanced_accuracy"))


@query(f"""WITH {O.PRED}, v AS (SELECT * FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL), k AS (SELECT unnest(['down', 'neutral', 'up']) AS c),
f AS (SELECT c, sum(CAST(direction = c AND pred_direction = c AS INTEGER)) AS tp, sum(CAST(direction = c AS INTEGER)) AS t, sum(CAST(pred_direction = c AS INTEGER)) AS p FROM v, k GROUP BY c)
SELECT round(avg(2.0 * tp / (t + p)), 6) AS macro_f1 FROM f WHERE t + p > 0""")
def macro_f1(spark, sf):
    return metrics.direction_metrics(_pred(spark, sf)).select(r6("macro_f1"))


@query(f"WITH {O.PRED} SELECT ticker, round(avg(CAST(pred_direction IS NOT NULL AS INTEGER)), 6) AS parseable_rate FROM pr GROUP BY ticker")
def parseable_rate(spark, sf):
    return metrics.direction_metrics(_pred(spark, sf), ["ticker"]).select("ticker", r6("parseable_rate"))


@query(f"WITH {O.PRED}, {O.MAT}, {O.AUC} SELECT round(auc, 8) AS auc FROM auc")
def rank_auc(spark, sf):
    return metrics.materiality_metrics(_pred(spark, sf)).select(r6("auc", 8))


@query(f"WITH {O.PRED}, {O.MAT} SELECT round(avg((s - y) * (s - y)), 6) AS brier FROM mt")
def brier(spark, sf):
    return metrics.materiality_metrics(_pred(spark, sf)).select(r6("brier"))


@query(f"WITH {O.PRED}, {O.MAT}, {O.ECE} SELECT round(ece, 6) AS ece_10bin FROM ece")
def ece_10bin(spark, sf):
    return metrics.materiality_metrics(_pred(spark, sf)).select(r6("ece_10bin"))


@query(f"WITH {O.PRED}, {O.MAT} SELECT CAST(count(*) AS BIGINT) AS n, round(avg(y), 6) AS base_rate_material, round(avg(CAST(y = CAST(s > 0.5 AS INTEGER) AS INTEGER)), 6) AS accuracy, false AS score_is_proxy FROM mt")
def base_rate(spark, sf):
    return metrics.materiality_metrics(_pred(spark, sf)).select("n", r6("base_rate_material"), r6("accuracy"), "score_is_proxy")


@query(f"WITH {O.PRED}, {O.SPEARMAN} SELECT n, round(rho, 6) AS spearman_rho FROM sp")
def spearman_ic(spark, sf):
    return metrics.spearman_ic(_pred(spark, sf)).select("n", r6("spearman_rho"))


@query()
def spearman_p_value(spark, sf):
    return metrics.spearman_ic(_pred(spark, sf), ["ticker"], with_p=True).select("ticker", "n", r6("spearman_rho"), r6("p_value"))


@query(f"WITH {O.PRED}, {O.strata('ticker')} SELECT * FROM st")
def stratified_report(spark, sf):
    return _strata(metrics.stratified_report(_pred(spark, sf), "ticker"))


@query(f"WITH {O.PRED}, {O.strata('CAST(year(publish_ts_utc) AS VARCHAR)')} SELECT * FROM st")
def year_strata(spark, sf):
    return _strata(metrics.year_strata(_pred(spark, sf)))


@query(f"WITH {O.PRED}, {O.strata('sector')} SELECT * FROM st")
def sector_strata(spark, sf):
    return _strata(metrics.sector_strata(_pred(spark, sf)))


def _strata(df: DataFrame) -> DataFrame:
    return df.select("key", "n", r6("direction_accuracy"), r6("spearman"), r6("materiality_auc"))


@query(f"WITH {O.PRED}, {O.MAT}, {O.AUC}, {O.ECE}, {O.SPEARMAN}, {O.REPORT} SELECT block, metric, round(value, 6) AS value FROM rep")
def overall_report(spark, sf):
    return metrics.overall_report(_pred(spark, sf)).select("block", "metric", r6("value"))


# ---- distributions and diagnosis


@query(f"""WITH {O.PRED} SELECT class, n, round(share, 6) AS share, printf('%.1f%%', 100 * share) AS shown FROM (SELECT direction AS class, CAST(count(*) AS BIGINT) AS n, count(*) / sum(count(*)) OVER () AS share FROM pr WHERE direction IS NOT NULL GROUP BY 1)""")
def class_distribution(spark, sf):
    return diagnose.class_distribution(_pred(spark, sf), "direction").select("class", "n", r6("share"), "shown")


@query(f"""WITH {O.PRED}, e AS (SELECT pred_p_up - pred_p_down AS e, pred_p_material AS m FROM pr)
SELECT round(min(e), 6) AS edge_min, round(max(e), 6) AS edge_max, round(avg(e), 6) AS edge_mean, round(stddev_samp(e), 6) AS edge_std, round(min(m), 6) AS material_min, round(max(m), 6) AS material_max, round(stddev_samp(m), 6) AS material_std, stddev_samp(e) < 0.001 AS edge_is_constant FROM e""")
def edge_stats(spark, sf):
    s = diagnose.edge_stats(_pred(spark, sf))
    return s.select(*[r6(c) for c in s.columns if c != "edge_is_constant"], "edge_is_constant")


@query(f"""WITH {O.PRED} SELECT CAST((SELECT count(*) FROM pr) AS BIGINT) AS n, 'up' AS collapsed_class, round((SELECT count(*) FROM pr WHERE direction = 'up') / (SELECT count(*) FROM pr WHERE direction IS NOT NULL), 6) AS train_share,
 'majority_class_collapse' || CASE WHEN (SELECT count(*) FROM pr) < 200 THEN ',tiny_test_set' ELSE '' END || ',zero_variance_edge' AS issues""")
def collapse_diagnosis(spark, sf):
    p = _pred(spark, sf)
    flat = p.withColumns({"pred_direction": F.lit("up"), "pred_p_up": F.lit(0.5), "pred_p_down": F.lit(0.2)})
    return diagnose.collapse_diagnosis(flat, p).select("n", "collapsed_class", r6("train_share"), "issues")


@query(f"WITH {O.EVENTS} SELECT ticker, CAST(count(*) AS BIGINT) AS n FROM ev GROUP BY ticker")
def events_per_ticker(spark, sf):
    return diagnose.count_by(proxy.events(spark, sf), "ticker")


# ---- sorts and sets


@query("""SELECT o_orderkey, o_totalprice - 150000 AS z FROM orders ORDER BY abs(o_totalprice - 150000) DESC NULLS LAST, o_orderkey LIMIT 10""")
def topk_abs(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") - 150000).alias("z"))
    return rows.orderBy(F.abs("z").desc_nulls_last(), "o_orderkey").limit(10)  # ten is what is asked for


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY md5(CAST(event_id AS VARCHAR) || ':42'), event_id) AS INTEGER) AS place FROM events""")
def seeded_shuffle(spark, sf):
    from pyspark.sql import Window

    rows = splits.seeded_shuffle(table(spark, sf, "events"), "event_id")
    order = Window.partitionBy("user_id").orderBy(splits.mixed_key(F.col("event_id"), 42), "event_id")
    return rows.select("event_id", F.row_number().over(order).alias("place"))


@query("""WITH s AS (SELECT vec_id, embedding[1] AS a, embedding[2] AS b, embedding[3] AS c FROM embeddings) SELECT vec_id, CASE WHEN a >= b AND a >= c THEN 'down' WHEN b >= c THEN 'neutral' ELSE 'up' END AS label FROM s""")
def argmax_label(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("p", F.slice("embedding", 1, 3))
    return e.select("vec_id", numeric.argmax_label(F.col("p")).alias("label"))


@query("""SELECT c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier""")
def union_shards(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    return splits.union_shards(a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")))


@query(f"""WITH {O.FILINGS}, rows AS (SELECT event_id, direction, row_number() OVER (PARTITION BY direction ORDER BY substr(md5(CAST(event_id AS VARCHAR)), 1, 3), event_id) - 1 AS rank, count(*) OVER (PARTITION BY direction) AS n FROM fl WHERE direction IS NOT NULL),
 draws AS (SELECT direction, n, unnest(range(1, (SELECT max(n) FROM rows) - n + 1)) AS draw FROM (SELECT DISTINCT direction, n FROM rows))
 SELECT event_id, direction, CAST(0 AS BIGINT) AS draw FROM fl UNION ALL
 SELECT rows.event_id, rows.direction, CAST(draw AS BIGINT) FROM draws JOIN rows ON rows.direction = draws.direction AND rank = CAST('0x' || substr(md5(draws.direction || ':' || draw || ':42'), 1, 8) AS BIGINT) % draws.n""")
def oversample_minority(spark, sf):
    return splits.oversample(proxy.filings(spark, sf).select("event_id", "direction"), "direction", "event_id")


@query(f"""WITH {O.FILINGS} SELECT event_id, split FROM (SELECT event_id, CASE WHEN publish_ts < TIMESTAMP '2021-01-01' THEN 'train' WHEN publish_ts >= TIMESTAMP '2021-01-08' AND publish_ts < TIMESTAMP '2022-01-01' THEN 'val'
 WHEN publish_ts >= TIMESTAMP '2022-01-08' AND publish_ts < TIMESTAMP '2023-01-01' THEN 'test' END AS split FROM fl) WHERE split IS NOT NULL""")
def temporal_split(spark, sf):
    return splits.temporal_split(proxy.filings(spark, sf)).select("event_id", "split")


# ---- scalar functions


@query(rf"SELECT page_id, {O.strip_html('html')} AS text FROM pages")
def strip_html(spark, sf):
    return table(spark, sf, "pages").select("page_id", text.strip_html(F.col("html")).alias("text"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(t, '(?i)Item\s+(\d+\.\d+)', 1))), ',') AS items FROM (SELECT doc_id, concat(coalesce(text, ''), ' Item ', doc_id % 9, '.0', doc_id % 4, ' ITEM  9.01 item 2.02 Item x') AS t FROM documents)""")
def items_mentioned(spark, sf):
    t = F.concat(F.coalesce("text", F.lit("")), F.lit(" Item "), (F.col("doc_id") % 9).cast("string"), F.lit(".0"), (F.col("doc_id") % 4).cast("string"), F.lit(" ITEM  9.01 item 2.02 Item x"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(text.items_mentioned(t), ",").alias("items"))


@query(f"""SELECT doc_id, {O.trim_body("t")} AS body FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN substring(text, 1, 100) || ' Press  Release: ' || text ELSE 'cover ' || text || ' announces' END AS t FROM documents)""")
def trim_body(spark, sf):
    k, t = F.col("doc_id") % 3, F.col("text")
    shown = F.when(k == 0, t).when(k == 1, F.concat(F.substring(t, 1, 100), F.lit(" Press  Release: "), t)).otherwise(F.concat(F.lit("cover "), t, F.lit(" announces")))
    return table(spark, sf, "documents").select("doc_id", text.trim_body(shown).alias("body"))


@query(f"WITH {O.EVENTS} SELECT event_id, {O.TIME_LABEL} AS time_label FROM ev")
def time_label(spark, sf):
    return proxy.events(spark, sf).select("event_id", clock.time_label(F.col("publish_ts")).alias("time_label"))


@query(f"WITH {O.EVENTS} SELECT event_id, strftime({O.ET}, '%Y-%m-%d') AS et_date FROM ev")
def et_date(spark, sf):
    return proxy.events(spark, sf).select("event_id", F.date_format(clock.market_date(F.col("publish_ts")), "yyyy-MM-dd").alias("et_date"))


@query(f"""WITH {O.PRED} SELECT event_id, 'Direction: ' || coalesce(pred_direction, 'neutral') || chr(10) || 'Materiality: ' || coalesce(pred_materiality, 'immaterial') AS answer FROM pr""")
def render_response(spark, sf):
    return _pred(spark, sf).select("event_id", text.response(F.col("pred_direction"), F.col("pred_materiality")).alias("answer"))


_ANSWERS = """CASE event_id % 5 WHEN 0 THEN 'direction: UP' || chr(10) || 'Materiality: immaterial' WHEN 1 THEN 'foo' WHEN 2 THEN 'Well. Direction:   down Materiality:Material!' WHEN 3 THEN 'Direction: sideways' || chr(10) || 'Materiality: material' ELSE 'Direction: ' || coalesce(pred_direction, 'x') || chr(10) || 'Materiality: ' || coalesce(pred_materiality, 'y') END"""


@query(f"""WITH {O.PRED}, a AS (SELECT event_id, {_ANSWERS} AS t FROM pr) SELECT event_id, nullif(lower(regexp_extract(t, '(?i)Direction:\\s*(down|neutral|up)\\s*\\n?Materiality:\\s*(material|immaterial)', 1)), '') AS direction,
 nullif(lower(regexp_extract(t, '(?i)Direction:\\s*(down|neutral|up)\\s*\\n?Materiality:\\s*(material|immaterial)', 2)), '') AS materiality FROM a""")
def parse_response(spark, sf):
    d, m = text.parse_response(F.expr(_ANSWERS.replace("chr(10)", "char(10)")))
    return _pred(spark, sf).select("event_id", d.alias("direction"), m.alias("materiality"))


@query("""WITH s AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), m AS (SELECT *, greatest(a, b, c) AS t FROM s), e AS (SELECT vec_id, exp(a - t) AS a, exp(b - t) AS b, exp(c - t) AS c FROM m)
SELECT vec_id, round(a / (a + b + c), 6) AS p_down, round(b / (a + b + c), 6) AS p_neutral, round(c / (a + b + c), 6) AS p_up FROM e""")
def softmax(spark, sf):
    p = numeric.softmax(F.slice("embedding", 1, 3))
    return table(spark, sf, "embeddings").select("vec_id", *[F.round(p[i], 6).alias(f"p_{d}") for i, d in enumerate(numeric.DIRECTIONS)])


@query("""SELECT doc_id, replace(substring(text, greatest(instr(lower(text), 'exhibit 99'), 1), 600), chr(10), ' ') AS excerpt FROM documents""")
def body_excerpt(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.excerpt(F.col("text")).alias("excerpt"))


# ---- models


@query(O.TFIDF)
def tfidf_features(spark, sf):
    """The canary's features over whole texts: of each term, the documents that have it and its weights' sum."""
    docs = table(spark, sf, "documents").select("text")
    vocabulary, idf = canary.fit_tfidf(docs)
    return canary.feature_totals(canary.with_tfidf(docs, vocabulary, idf, keep=[]), vocabulary).select("term", "df", r6("weight"))


@query(O.TERM_WEIGHTS)
def tfidf_whole_texts(spark, sf):
    return canary.term_weights(table(spark, sf, "documents")).select("term", "df", r6("idf"))


@query()
def leakage_canary(spark, sf):
    docs = proxy.filings(spark, sf).withColumns({"car_0_1": (F.col("event_id") * 31337 % 2001 - 1000) / 10000.0, "car_minus1_0": (F.col("event_id") * 7919 % 2003 - 1000) / 10000.0})
    return canary.run_canary(docs, ts="publish_ts")


class _KeyScorer:
    """Stands in for a model: log-probabilities and texts made from the prompt's length."""

    def log_probs(self, prompt, completions):
        return [-float((len(prompt) * 31 + len(c) * 17 + i * 7) % 97) / 20 for i, c in enumerate(completions)]

    def generate(self, prompts, max_new_tokens):
        return [f"Direction: {numeric.DIRECTIONS[len(p) % 3]}\nMateriality: {numeric.MATERIALITIES[len(p) % 2]}" if len(p) % 5 else "?" for p in prompts]


def _prompts(spark: SparkSession, sf: str) -> DataFrame:
    return features.prompts(features.event_features(proxy.filings(spark, sf), dims.sectors(spark)), False).select("event_id", "text")


_P = ", ".join([f"round(p_d{i}, 6) AS pred_p_{x}" for i, x in enumerate(numeric.DIRECTIONS)] + [f"round(p_m{i}, 6) AS pred_p_{x}" for i, x in enumerate(numeric.MATERIALITIES)])


@query(f"WITH {O.FILINGS}, {O.FEATURES}, pt AS (SELECT event_id, {O.chat(False)} AS t FROM feat), {O.key_scorer('pt')} SELECT event_id, pred AS pred_direction, mat AS pred_materiality, {_P} FROM q")
def prob_infer(spark, sf):
    out = inference.prob_infer(_prompts(spark, sf), _KeyScorer)
    return out.select("event_id", "pred_direction", "pred_materiality", *[r6(f"pred_p_{x}") for x in (*numeric.DIRECTIONS, *numeric.MATERIALITIES)])


@query(f"""WITH {O.FILINGS}, {O.FEATURES}, pt AS (SELECT event_id, length({O.chat(False)}) AS n FROM feat),
 a AS (SELECT event_id, CASE WHEN n % 5 <> 0 THEN ['down', 'neutral', 'up'][n % 3 + 1] END AS d, CASE WHEN n % 5 <> 0 THEN ['material', 'immaterial'][n % 2 + 1] END AS m FROM pt)
 SELECT event_id, coalesce('Direction: ' || d || chr(10) || 'Materiality: ' || m, '?') AS raw_response, d AS pred_direction, m AS pred_materiality FROM a""")
def greedy_infer(spark, sf):
    return inference.greedy_infer(_prompts(spark, sf), _KeyScorer)
