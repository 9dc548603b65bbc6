"""Schemas of the datasets that move between stages, as DDL that every reader takes."""

FILINGS = (
    "accessionNumber string, filingDate date, acceptanceDateTime timestamp, form string, primaryDocument string, primaryDocDescription string, "
    "items string, body_text string, items_in_body array<string>, exhibits array<string>, ticker string, cik string"
)
LABELS = (
    "car_0_1 double, car_z_0_1 double, direction string, material boolean, sigma_window_0_1 double, factor_r2 double, t0 date, car_minus1_0 double, car_z_minus1_0 double"
)
LABELED = f"{FILINGS}, {LABELS}"
PRICES = "ticker string, trade_date date, open double, high double, low double, close double, volume bigint, ret double"
FACTORS = "date date, MKT_RF double, SMB double, HML double, RF double, MOM double"
TRAINING_ROW = (
    "text string, meta struct<ticker:string,sector:string,publish_ts_utc:string,direction:string,materiality:string,car_0_1:double,car_z_0_1:double,items:string>"
)
PREDICTIONS_GREEDY = (
    "ticker string, sector string, publish_ts_utc timestamp, direction string, materiality string, car_0_1 double, car_z_0_1 double, items string, "
    "raw_response string, pred_direction string, pred_materiality string"
)
PREDICTIONS = (
    "ticker string, sector string, publish_ts_utc timestamp, direction string, materiality string, car_0_1 double, car_z_0_1 double, items string, "
    "pred_direction string, pred_p_down double, pred_p_neutral double, pred_p_up double, pred_materiality string, pred_p_material double, pred_p_immaterial double"
)
TRADES = (
    "ticker string, sector string, publish_ts_utc timestamp, entry_day date, exit_day date, direction_signed int, pred_p_up double, pred_p_down double, "
    "pred_p_material double, entry_price double, exit_price double, gross_return double, net_return double, pnl double, realized_car_0_1 double"
)
EQUITY = "day date, daily_pnl double, equity double"
#: The parallel arrays of a filing index, as they come in one JSON object.
FILING_ARRAY_NAMES = ("accessionNumber", "filingDate", "acceptanceDateTime", "form", "primaryDocument", "primaryDocDescription", "items")
FILING_ARRAYS = ", ".join(f"{n} array<string>" for n in FILING_ARRAY_NAMES)
