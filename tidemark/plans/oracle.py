"""Pieces of the SQL that other engines run to check the queries: common table expressions and expressions."""

from __future__ import annotations

from ..functions.numeric import DIRECTIONS, MATERIALITIES
from ..functions.text import BODY_CUES, SYSTEM_PROMPT
from ..sources.dims import FULL_TICKERS, ITEM_NAMES, SECTORS

#: Fixed: the English stop words of Spark's remover that are words of letters alone, as others are no terms.
STOP_WORDS = (
    "about above after again against all am an and any are as at be because been before being below between both but by can cannot could did do does doing don down during each few for from further had has have having he her here hers "
    "herself him himself his how if in into is it its itself just me more most my myself no nor not now of off on once only or other ought our ours ourselves out over own same she should so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves"
).split()


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PX = """px AS (SELECT c_mktsegment AS ticker, CAST(l_shipdate AS DATE) AS d, CAST(sum(CAST(floor(l_extendedprice / l_quantity * 10000) AS BIGINT)) AS DOUBLE) / count(*) / 10000.0::DOUBLE AS px, CAST(sum(l_quantity) AS BIGINT) AS volume FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 WHERE isodow(l_shipdate) < 6 GROUP BY ALL)"""


def _spread(a: str, b: str, name: str) -> str:
    return f"round(coalesce(avg(p) FILTER (WHERE {a}) - avg(p) FILTER (WHERE {b}), 0) / 10000, 9) AS {name}"


FAC = f"""fac AS (SELECT CAST(l_shipdate AS DATE) AS date, round(avg(p) / 10000, 9) AS MKT_RF, {_spread("p_size <= 25", "p_size > 25", "SMB")}, {_spread("l_returnflag = 'A'", "l_returnflag = 'R'", "HML")},
 round(avg(l_tax) / 252, 9) AS RF, {_spread("l_discount < 0.05", "l_discount >= 0.05", "MOM")} FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem JOIN part ON l_partkey = p_partkey WHERE isodow(l_shipdate) < 6) GROUP BY 1)"""
RET = "ret AS (SELECT ticker, d, px / lag(px) OVER (PARTITION BY ticker ORDER BY d) - 1 AS ret FROM px)"
EVENTS = """ev AS (SELECT o_orderkey AS event_id, c_mktsegment AS ticker, o_orderdate + to_minutes(CAST((o_orderkey * 37) % 1440 AS BIGINT)) AS publish_ts,
 CASE WHEN o_orderkey % 5 = 0 THEN '2.02,9.01' WHEN o_orderkey % 7 = 0 THEN NULL ELSE (1 + o_orderkey % 8) || '.0' || (o_orderkey % 3) END AS items FROM orders JOIN customer ON o_custkey = c_custkey)"""
ET = "timezone('America/New_York', timezone('UTC', publish_ts))"
ET_DATE = f"CAST({ET} AS DATE)"
TIME_LABEL = f"CASE WHEN publish_ts IS NULL THEN 'unknown' WHEN isodow({ET}) > 5 THEN 'weekend' WHEN CAST({ET} AS TIME) < TIME '09:30:00' THEN 'pre_open' WHEN CAST({ET} AS TIME) < TIME '16:00:00' THEN 'intraday' ELSE 'after_close' END"


def target(source: str, same: str) -> str:
    return f"tg AS (SELECT *, CASE WHEN CAST({ET} AS TIME) {same} TIME '09:30:00' THEN {ET_DATE} ELSE {ET_DATE} + 1 END AS target FROM {source})"


SECTORS_ = ", ".join(f"({_q(t)}, {_q(s)})" for s, names in SECTORS.items() for t in names)
SECTORS = f"sectors AS (SELECT * FROM (VALUES {SECTORS_}) AS v(ticker, sector))"
ITEMS = "itemdim AS (SELECT * FROM (VALUES " + ", ".join(f"({_q(i)}, {_q(d)})" for i, d in ITEM_NAMES.items()) + ") AS v(item, description))"
_TICKERS = "[" + ", ".join(map(_q, FULL_TICKERS)) + "]"
FILINGS = f"""fl AS (SELECT doc_id AS event_id, {_TICKERS}[doc_id * 3 % {len(FULL_TICKERS)} + 1] AS ticker, TIMESTAMP '2018-06-01' + to_days(CAST(doc_id * 37 % 1900 AS INTEGER)) + to_minutes(CAST(doc_id * 53 % 1440 AS BIGINT)) AS publish_ts,
 CASE WHEN doc_id % 5 = 0 THEN '2.02,9.01' WHEN doc_id % 7 = 0 THEN NULL ELSE (1 + doc_id % 8) || '.0' || (doc_id % 3) END AS items, text AS body_text, ['down', 'neutral', 'up'][doc_id * 31 % 7 % 3 + 1] AS direction, doc_id % 4 = 1 AS material FROM documents)"""


def strip_html(column: str) -> str:
    return rf"trim(regexp_replace(replace(regexp_replace(regexp_replace({column}, '<[^>]+>', ' ', 'g'), '&nbsp;|&#160;', ' ', 'g'), '&amp;', '&'), '\s+', ' ', 'g'))"


def trim_body(column: str) -> str:
    at = ", ".join(f"nullif(instr(lower({column}), {_q(c)}), 0)" for c in BODY_CUES)
    return rf"coalesce(trim(regexp_replace(substring({column}, coalesce(least({at}), 1), 1500), '\s+', ' ', 'g')), '')"


FEATURES = f"""{SECTORS}, feat AS (SELECT fl.*, coalesce(sector, 'Unknown') AS sector, strftime({ET}, '%Y-%m-%d') AS publish_date, {TIME_LABEL} AS time_label, count(*) OVER (PARTITION BY fl.ticker, {ET_DATE}) AS n_same_day,
 date_diff('day', lag({ET_DATE}) OVER (PARTITION BY fl.ticker ORDER BY publish_ts, event_id), {ET_DATE}) AS gap, {trim_body("body_text")} AS body FROM fl LEFT JOIN sectors ON sectors.ticker = fl.ticker)"""
USER_PROMPT = (
    "'Ticker: ' || ticker || chr(10) || 'Sector: ' || sector || chr(10) || 'Filing date (UTC): ' || publish_date || chr(10) || 'Time relative to market: ' || time_label || chr(10) || 'Same-day 8-K count for ticker: ' || n_same_day || chr(10) || "
    "'Days since previous 8-K: ' || coalesce(CAST(gap AS VARCHAR), 'n/a') || chr(10) || '8-K items: ' || coalesce(nullif(trim(items), ''), 'n/a') || chr(10) || 'Body: ' || body"
)


def chat(answered: bool) -> str:
    end = "'<|im_end|>' || chr(10)"
    head = f"'<|im_start|>system' || chr(10) || {_q(SYSTEM_PROMPT)} || {end} || '<|im_start|>user' || chr(10) || {USER_PROMPT} || {end} || '<|im_start|>assistant' || chr(10)"
    answer = f" || 'Direction: ' || direction || chr(10) || 'Materiality: ' || CASE WHEN material THEN 'material' ELSE 'immaterial' END || {end}"
    return head + (answer if answered else "")


PRED = f"""{EVENTS}, raw AS (SELECT *, (event_id * 7919) % 997 + 1 AS u, (event_id * 104729) % 991 + 1 AS w, (event_id * 1299709) % 983 + 1 AS v, ((event_id * 15485863) % 1001) / 1000.0::DOUBLE AS m FROM ev),
pr AS (SELECT event_id, ticker, 'S' || substring(ticker, 1, 1) AS sector, publish_ts AS publish_ts_utc, publish_ts, CASE WHEN event_id % 11 <> 0 THEN ['down', 'neutral', 'up'][event_id * 31 % 3 + 1] END AS direction,
 CASE WHEN event_id % 4 = 1 THEN 'material' ELSE 'immaterial' END AS materiality, CASE WHEN event_id % 13 <> 0 THEN ((event_id * 31337) % 2001 - 1000) / 10000.0::DOUBLE END AS car_0_1, items,
 CASE WHEN event_id % 17 <> 0 THEN ['down', 'neutral', 'up'][event_id * 7 % 3 + 1] END AS pred_direction, u / CAST(u + v + w AS DOUBLE) AS pred_p_up, w / CAST(u + v + w AS DOUBLE) AS pred_p_down, v / CAST(u + v + w AS DOUBLE) AS pred_p_neutral,
 CASE WHEN event_id % 17 <> 0 THEN CASE WHEN m > 0.5 THEN 'material' ELSE 'immaterial' END END AS pred_materiality, m AS pred_p_material FROM raw)"""
SIGNAL = "CASE WHEN abs(pred_p_up - pred_p_down) >= 0.2 AND pred_p_material >= 0.5 THEN CASE WHEN pred_p_up - pred_p_down > 0 THEN 1 ELSE -1 END ELSE 0 END"
TRADES = f"""{PX}, {PRED}, sg AS (SELECT *, {SIGNAL} AS signal FROM pr), {target("(SELECT * FROM sg WHERE signal <> 0)", "<=")}, lead_px AS (SELECT *, lead(d, 10) OVER w AS exit_day, lead(px, 10) OVER w AS exit_px FROM px WINDOW w AS (PARTITION BY ticker ORDER BY d)),
placed AS (SELECT tg.*, (SELECT min(px.d) FROM px WHERE px.ticker = tg.ticker AND px.d >= tg.target) AS entry_day FROM tg),
tr0 AS (SELECT placed.event_id, placed.ticker, signal, entry_day, exit_day, signal * (exit_px / px - 1) AS gross FROM placed JOIN lead_px ON lead_px.ticker = placed.ticker AND lead_px.d = placed.entry_day WHERE exit_px IS NOT NULL AND px > 0),
tr AS (SELECT *, gross - 0.0015 AS net, 10000.0 * (gross - 0.0015) AS pnl FROM tr0)"""
EQUITY = """dp AS (SELECT exit_day AS day, sum(pnl) AS p FROM tr GROUP BY 1), cal AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM dp), (SELECT max(day) FROM dp), INTERVAL 1 DAY)) AS DATE) AS day),
eq AS (SELECT cal.day, coalesce(p, 0) AS daily_pnl, 1000000 + sum(coalesce(p, 0)) OVER (ORDER BY cal.day) AS equity FROM cal LEFT JOIN dp ON dp.day = cal.day WHERE isodow(cal.day) < 6)"""
SUMMARY = """tot AS (SELECT CAST(count(*) AS BIGINT) AS n_trades, CAST(count(*) FILTER (WHERE signal > 0) AS BIGINT) AS n_long, CAST(count(*) FILTER (WHERE signal < 0) AS BIGINT) AS n_short, avg(CAST(net > 0 AS INTEGER)) AS hit_rate, avg(gross) AS avg_gross, avg(net) AS avg_net,
 sum(pnl) AS total_pnl, stddev_samp(gross) AS sd_gross, stddev_samp(net) AS sd_net, CAST(count(DISTINCT ticker) AS BIGINT) AS n_tickers FROM tr),
dy AS (SELECT avg(daily_pnl) AS daily_mean, stddev_samp(daily_pnl) AS daily_std, CAST(count(*) FILTER (WHERE daily_pnl <> 0) AS BIGINT) AS active_days FROM eq),
sm AS (SELECT *, avg_gross * (n_trades / active_days) / (sd_gross * sqrt(n_trades / active_days)) * sqrt(252.0) AS sharpe_gross, avg_net * (n_trades / active_days) / (sd_net * sqrt(n_trades / active_days)) * sqrt(252.0) AS sharpe_net FROM tot, dy)"""
MAT = "mt AS (SELECT CAST(materiality = 'material' AS INTEGER) AS y, pred_p_material AS s FROM pr WHERE pred_materiality IS NOT NULL AND materiality IS NOT NULL)"
AUC = """rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS r FROM mt), auc AS (SELECT (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)) AS auc FROM rk)"""
ECE = """bins AS (SELECT y, s, list_sum([CAST(s >= e AS INTEGER) FOR e IN [0.1::DOUBLE, 0.2::DOUBLE, 3 * 0.1::DOUBLE, 0.4::DOUBLE, 0.5::DOUBLE, 6 * 0.1::DOUBLE, 7 * 0.1::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]]) AS b FROM mt),
ece AS (SELECT sum(n * abs(conf - acc)) / sum(n) AS ece FROM (SELECT b, count(*) AS n, avg(s) AS conf, avg(y) AS acc FROM bins GROUP BY b))"""
SPEARMAN = """sc AS (SELECT pred_p_up - pred_p_down AS s, car_0_1 AS c FROM pr WHERE car_0_1 IS NOT NULL AND pred_p_up IS NOT NULL),
sr AS (SELECT rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0::DOUBLE AS a, rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0::DOUBLE AS b FROM sc), sp AS (SELECT CAST(count(*) AS BIGINT) AS n, corr(a, b) AS rho FROM sr)"""


def strata(key: str) -> str:
    return f"""k AS (SELECT *, {key} AS key FROM pr), one AS (SELECT key, CAST(count(*) AS BIGINT) AS n, avg(CAST(coalesce(direction = pred_direction, false) AS INTEGER)) AS acc FROM k GROUP BY key HAVING count(*) >= 10),
sr AS (SELECT key, rank() OVER (PARTITION BY key ORDER BY s) + (count(*) OVER (PARTITION BY key, s) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY key ORDER BY car_0_1) + (count(*) OVER (PARTITION BY key, car_0_1) - 1) / 2.0::DOUBLE AS b FROM (SELECT *, pred_p_up - pred_p_down AS s FROM k WHERE car_0_1 IS NOT NULL)),
sp AS (SELECT key, corr(a, b) AS rho FROM sr GROUP BY key HAVING count(*) >= 5),
rk AS (SELECT key, CAST(materiality = 'material' AS INTEGER) AS y, rank() OVER (PARTITION BY key ORDER BY pred_p_material) + (count(*) OVER (PARTITION BY key, pred_p_material) - 1) / 2.0::DOUBLE AS r FROM k WHERE pred_materiality IS NOT NULL),
au AS (SELECT key, (sum(r) FILTER (WHERE y = 1) - sum(y) * (sum(y) + 1) / 2.0::DOUBLE) / nullif(CAST(sum(y) AS DOUBLE) * sum(1 - y), 0) AS auc FROM rk GROUP BY key),
st AS (SELECT one.key, n, round(acc, 6) AS direction_accuracy, round(rho, 6) AS spearman, round(auc, 6) AS materiality_auc FROM one LEFT JOIN sp ON sp.key = one.key LEFT JOIN au ON au.key = one.key)"""


REPORT = """v AS (SELECT * FROM pr WHERE direction IS NOT NULL AND pred_direction IS NOT NULL), kk AS (SELECT unnest(['down', 'neutral', 'up']) AS c),
f1 AS (SELECT avg(2.0 * tp / (t + p)) AS f FROM (SELECT c, sum(CAST(direction = c AND pred_direction = c AS INTEGER)) AS tp, sum(CAST(direction = c AS INTEGER)) AS t, sum(CAST(pred_direction = c AS INTEGER)) AS p FROM v, kk GROUP BY c)),
ac AS (SELECT avg(CAST(direction = pred_direction AS INTEGER)) AS a FROM v), mj AS (SELECT max(n) / sum(n) AS m FROM (SELECT count(*) AS n FROM v GROUP BY direction)), ba AS (SELECT avg(r) AS b FROM (SELECT avg(CAST(direction = pred_direction AS INTEGER)) AS r FROM v GROUP BY direction)),
rep AS (SELECT 'direction' AS block, 'n' AS metric, CAST((SELECT count(*) FROM v) AS DOUBLE) AS value UNION ALL SELECT 'direction', 'parseable_rate', (SELECT avg(CAST(pred_direction IS NOT NULL AS INTEGER)) FROM pr)
 UNION ALL SELECT 'direction', 'accuracy', a FROM ac UNION ALL SELECT 'direction', 'majority_baseline', m FROM mj UNION ALL SELECT 'direction', 'lift_over_majority_pp', (a - m) * 100 FROM ac, mj
 UNION ALL SELECT 'direction', 'balanced_accuracy', b FROM ba UNION ALL SELECT 'direction', 'macro_f1', f FROM f1
 UNION ALL SELECT 'materiality', 'n', count(*) FROM mt UNION ALL SELECT 'materiality', 'accuracy', avg(CAST(y = CAST(s > 0.5 AS INTEGER) AS INTEGER)) FROM mt UNION ALL SELECT 'materiality', 'auc', auc FROM auc
 UNION ALL SELECT 'materiality', 'brier', avg((s - y) * (s - y)) FROM mt UNION ALL SELECT 'materiality', 'ece_10bin', ece FROM ece UNION ALL SELECT 'materiality', 'base_rate_material', avg(y) FROM mt UNION ALL SELECT 'materiality', 'score_is_proxy', 0
 UNION ALL SELECT 'ic', 'n', n FROM sp UNION ALL SELECT 'ic', 'spearman_rho', rho FROM sp UNION ALL SELECT 'ic', 'score_uses_probs', 1)"""


def _ols() -> str:
    """Betas by eliminating one factor after the other."""
    n = 4
    w = "est AS (PARTITION BY ticker ORDER BY fq RANGE BETWEEN 250 PRECEDING AND 31 PRECEDING)"
    moments = [f"covar_samp(x{i}, x{j}) OVER est AS a{i}{j}" for i in range(n) for j in range(n)] + [f"covar_samp(x{i}, y) OVER est AS c{i}" for i in range(n)]
    moments += [f"avg({c}) OVER est AS mean_{c}" for c in ("y", "x0", "x1", "x2", "x3")] + ["var_samp(y) OVER est AS var_y", "count(y) OVER est AS n_complete", "count(*) OVER est AS n_rows"]
    parts = [f"e0 AS (SELECT *, {', '.join(f'c{i} AS g{i}' for i in range(n))} FROM (SELECT *, {', '.join(moments)} FROM pan WINDOW {w}))"]
    for k in range(n - 1):
        rest = range(k + 1, n)
        new = [f"a{i}{j} - a{i}{k} * a{k}{j} / nullif(a{k}{k}, 0) AS a{i}{j}" for i in rest for j in rest] + [f"c{i} - a{i}{k} * c{k} / nullif(a{k}{k}, 0) AS c{i}" for i in rest]
        parts.append(f"e{k + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM e{k})")
    last = f"e{n - 1}"
    for i in reversed(range(n)):
        rest = "".join(f" - a{i}{j} * b{j}" for j in range(i + 1, n))
        parts.append(f"s{i} AS (SELECT *, CASE WHEN n_complete >= 30 AND n_rows >= 60 AND a{i}{i} > 0 THEN (c{i}{rest}) / a{i}{i} END AS b{i} FROM {last})")
        last = f"s{i}"
    alpha, fit = "".join(f" - b{i} * mean_x{i}" for i in range(n)), " + ".join(f"b{i} * g{i}" for i in range(n))
    pan = """days AS (SELECT date, row_number() OVER (ORDER BY date) AS fq FROM fac), pan AS (SELECT r.ticker, r.d, fq, row_number() OVER (PARTITION BY r.ticker ORDER BY r.d) AS pq, ret - RF AS y,
 CASE WHEN ret IS NOT NULL THEN MKT_RF END AS x0, CASE WHEN ret IS NOT NULL THEN SMB END AS x1, CASE WHEN ret IS NOT NULL THEN HML END AS x2, CASE WHEN ret IS NOT NULL THEN MOM END AS x3 FROM ret r JOIN fac ON fac.date = r.d JOIN days ON days.date = r.d)"""
    return f"{PX}, {FAC}, {RET}, {pan}, {', '.join(parts)}, ols AS (SELECT *, mean_y{alpha} AS alpha, ({fit}) / nullif(var_y, 0) AS r2 FROM {last})"


def _sigma() -> str:
    n = 4
    moments = ["var_samp(y) OVER w AS vy", "count(y) OVER w AS vn"] + [f"covar_samp(x{i}, y) OVER w AS vc{i}" for i in range(n)] + [f"covar_samp(x{i}, x{j}) OVER w AS v{i}{j}" for i in range(n) for j in range(n)]
    value = "vy" + "".join(f" - 2 * b{i} * vc{i}" for i in range(n)) + "".join(f" + b{i} * b{j} * v{i}{j}" for i in range(n) for j in range(n))
    return f"""mom AS (SELECT *, {", ".join(moments)} FROM ols WINDOW w AS (PARTITION BY ticker ORDER BY fq RANGE BETWEEN 60 PRECEDING AND 31 PRECEDING)), sig AS (SELECT *, CASE WHEN vn >= 10 AND b0 IS NOT NULL THEN sqrt(greatest({value}, 0)) END AS sigma FROM mom)"""


def _car() -> str:
    def one(lo: str, hi: str, name: str) -> tuple[str, str]:
        over = f"(PARTITION BY ticker ORDER BY pq ROWS BETWEEN {lo} AND {hi})"
        sums = f"count(*) OVER {over} AS n_{name}, count(y) OVER {over} AS m_{name}, sum(y) OVER {over} AS y_{name}, " + ", ".join(f"sum(x{i}) OVER {over} AS x{i}_{name}" for i in range(4))
        return sums, f"CASE WHEN n_{name} = 2 AND m_{name} > 0 THEN y_{name} - m_{name} * alpha" + "".join(f" - b{i} * x{i}_{name}" for i in range(4)) + f" END AS car_{name}"

    a, b = one("CURRENT ROW", "1 FOLLOWING", "0_1"), one("1 PRECEDING", "CURRENT ROW", "m1_0")
    return f"car AS (SELECT *, {a[1]}, {b[1]} FROM (SELECT *, {a[0]}, {b[0]} FROM sig))"


OLS, SIGMA, CAR = _ols(), _sigma(), _car()
_STOP = "[" + ", ".join(map(_q, STOP_WORDS)) + "]"
TERMS = rf"""d AS (SELECT doc_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}]{{2,}}'), lambda x: NOT list_contains({_STOP}, x)) AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS term FROM d UNION ALL SELECT doc_id, w[i] || ' ' || w[i + 1] FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)),
t AS (SELECT term, count(DISTINCT doc_id) AS df, count(*) AS c FROM u GROUP BY term HAVING count(DISTINCT doc_id) >= 2),
top AS (SELECT term, CAST(df AS BIGINT) AS df, ln((1 + (SELECT count(*) FROM documents)) / CAST(1 + df AS DOUBLE)) + 1 AS idf FROM t ORDER BY c DESC, term LIMIT 2000)"""
TERM_WEIGHTS = f"WITH {TERMS} SELECT term, df, round(idf, 6) AS idf FROM top"
TFIDF = f"""WITH {TERMS}, f AS (SELECT doc_id, u.term, count(*) * any_value(idf) AS x FROM u JOIN top ON top.term = u.term GROUP BY doc_id, u.term), n AS (SELECT doc_id, sqrt(sum(x * x)) AS norm FROM f GROUP BY doc_id)
SELECT term, CAST(count(*) AS BIGINT) AS df, round(sum(x / norm), 6) AS weight FROM f JOIN n ON n.doc_id = f.doc_id GROUP BY term"""


def key_scorer(prompt: str) -> str:
    """Common tables m, p, q: what the queries' stand-in for a model makes of (event_id, t) in `prompt`."""
    score = lambda size, i: f"-CAST((length(t) * 31 + {size} * 17 + {i} * 7) % 97 AS DOUBLE) / 20"
    d = ", ".join(f"{score(len('Direction: ' + x), i)} AS d{i}" for i, x in enumerate(DIRECTIONS))
    mats = ", ".join(f"{score(f'length({_q(chr(68) + 'irection: ')} || pred || chr(10) || {_q('Materiality: ' + x)})', i)} AS m{i}" for i, x in enumerate(MATERIALITIES))
    soft = lambda names, top: ", ".join(f"exp({n} - {top}) / ({' + '.join(f'exp({k} - {top})' for k in names)}) AS p_{n}" for n in names)
    ds, ms = [f"d{i}" for i in range(3)], [f"m{i}" for i in range(2)]
    pred = " ".join(f"WHEN d{i} >= greatest(d0, d1, d2) THEN {_q(x)}" for i, x in enumerate(DIRECTIONS))
    mat = " ".join(f"WHEN m{i} >= greatest(m0, m1) THEN {_q(x)}" for i, x in enumerate(MATERIALITIES))
    return f"""s AS (SELECT *, {d} FROM {prompt}), p AS (SELECT *, {soft(ds, "greatest(d0, d1, d2)")}, CASE {pred} END AS pred FROM s), r AS (SELECT *, {mats} FROM p), q AS (SELECT *, {soft(ms, "greatest(m0, m1)")}, CASE {mat} END AS mat FROM r)"""
