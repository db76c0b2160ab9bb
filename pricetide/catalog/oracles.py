"""Checking SQL for the registered queries, written apart from the operators.

Each query is a main select over named parts; `_sql` puts the parts it needs in front of it.
"""

from __future__ import annotations

import re

from pricetide.catalog import standins
from pricetide.catalog.queries import AS_OF, BOOST, FOLDS, LAST_DAYS, LIVE_AT, RECENT_DAYS, VALID_TRAIN_DAYS

FUELS = ["e5", "e10", "diesel"]


def _r(value: str, name: str) -> str:
    return f"round({value}, 9) + 0.0 AS {name}"


def _rs(*names: str, table: str = "") -> str:
    return ", ".join(_r(table + name, name) for name in names)


#: Gradients of the booster are whole numbers of this part of one.
SCALE = 1 << 24
MOMENT = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
DAY = "strftime({}, '%Y-%m-%d')"


def _fuel_parts() -> dict[str, str]:
    """Daily and rolling means, one fuel at a time."""
    parts = {}
    for fuel in FUELS:
        parts[f"{fuel}_daily"] = f"""
            SELECT uuid, day, avg({fuel}) AS {fuel}_1d_mean FROM prices WHERE {fuel} > 1 GROUP BY uuid, day"""
        parts[f"{fuel}_rolled"] = f"""
            SELECT uuid, day, {fuel}_1d_mean,
              avg({fuel}_1d_mean) OVER (PARTITION BY uuid ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS {fuel}_3d_mean,
              avg({fuel}_1d_mean) OVER (PARTITION BY uuid ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS {fuel}_7d_mean
            FROM {fuel}_daily"""
    parts["station_days"] = "SELECT DISTINCT uuid, day FROM prices WHERE diesel > 1 OR e5 > 1 OR e10 > 1"
    return parts


def _slice(name: str, keep: int, train_days: int, rest: str) -> dict[str, str]:
    """Rows of the last `keep` days with index and split."""
    return {
        f"{name}_days": "SELECT day, dense_rank() OVER (ORDER BY day) AS day_idx FROM (SELECT DISTINCT day FROM train_rows)",
        f"{name}_kept": f"SELECT * FROM {name}_days WHERE day_idx > (SELECT max(day_idx) FROM {name}_days) - {keep}",
        name: f"""
            SELECT t.*, k.day_idx,
              CASE WHEN k.day_idx <= (SELECT min(day_idx) FROM {name}_kept) + {train_days} THEN 'train' ELSE '{rest}' END AS split
            FROM train_rows t JOIN {name}_kept k ON t.day = k.day""",
    }


PARTS: dict[str, str] = {
    "prices_raw": standins.PRICES_RAW.format(events="events"),
    "stations": standins.STATIONS.format(customer="customer"),
    "scores": standins.SCORES.format(labels="labels", documents="documents"),
    "oil_daily": standins.OIL_DAILY_CHECK.format(events="events"),
    "oil_ticks": standins.OIL_TICKS.format(events="events"),
    "market_ticks": "SELECT date, max(close) AS close FROM oil_ticks GROUP BY date",
    "station_ticks": "SELECT uuid, date, max(close) AS own_close FROM oil_ticks GROUP BY uuid, date",
    "copy_lines": standins.COPY_LINES_CHECK.format(prices_raw="prices_raw"),
    "dump_lines": standins.DUMP_LINES.format(stations="stations", copy_lines="copy_lines"),
    "brands": "SELECT id, upper(trim(replace(brand, chr(9), ' '))) AS brand FROM stations",
    "prices": "SELECT id, uuid, date, cast(date AS date) AS day, change, "
    + ", ".join(f"CASE WHEN {f} >= 0 THEN {f} / 1000.0::double END AS {f}" for f in FUELS)
    + " FROM prices_raw",
    "shifted": """
        SELECT *, lead(diesel) OVER (PARTITION BY uuid ORDER BY date NULLS LAST, id NULLS LAST) AS diesel_shift FROM prices""",
    "labelled": """
        SELECT *, cast(coalesce(diesel <> diesel_shift, true) AS int) AS price_will_change FROM shifted""",
    "train_rows": "SELECT * FROM labelled WHERE diesel IS NOT NULL AND diesel_shift IS NOT NULL",
    **_slice("slice", 30, 20, "test"),
    **_slice("short_slice", LAST_DAYS, 20, "test"),
    **_slice("valid_slice", 30, VALID_TRAIN_DAYS, "valid"),
    **_fuel_parts(),
    "lagged": """
        SELECT uuid, day, e5_1d_mean,
          lag(e5_1d_mean, 1) OVER w AS e5_lag_1, lag(e5_1d_mean, 3) OVER w AS e5_lag_3, lag(e5_1d_mean, 7) OVER w AS e5_lag_7,
          avg(e5_1d_mean) OVER f AS e5_7d_avg, coalesce(stddev_samp(e5_1d_mean) OVER f, 0) AS e5_volatility
        FROM e5_daily
        WINDOW w AS (PARTITION BY uuid ORDER BY day),
          f AS (PARTITION BY uuid ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "live": """
        SELECT id, cast('1.' || right(id, 2) AS double) AS e5 FROM stations""",
    "newest": "SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY day DESC) AS back FROM e5_daily",
    "history": """
        SELECT uuid, any_value(e5_1d_mean) FILTER (back = 1) AS lag_1, any_value(e5_1d_mean) FILTER (back = 3) AS lag_3,
          any_value(e5_1d_mean) FILTER (back = 7) AS lag_7, avg(e5_1d_mean) AS mean_7, stddev_samp(e5_1d_mean) AS sd_7
        FROM newest WHERE back <= 7 GROUP BY uuid""",
    "oil": """
        SELECT date, close AS oil_price,
          avg(close) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS oil_7d_avg FROM oil_daily""",
    "hours": """
        SELECT uuid, date_trunc('hour', date) AS hour_start, arg_max(e5, (date, id)) AS e5
        FROM prices WHERE e5 IS NOT NULL GROUP BY uuid, date_trunc('hour', date)""",
    "hour_range": "SELECT uuid, unnest(generate_series(min(hour_start), max(hour_start), INTERVAL 1 HOUR)) AS hour_start FROM hours GROUP BY uuid",
    "grid": """
        SELECT r.uuid, r.hour_start,
          last_value(h.e5 IGNORE NULLS) OVER (PARTITION BY r.uuid ORDER BY r.hour_start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e5
        FROM hour_range r LEFT JOIN hours h ON r.uuid = h.uuid AND r.hour_start = h.hour_start""",
    "next_known": """
        SELECT *, lead(id) OVER (PARTITION BY uuid ORDER BY date NULLS LAST, id NULLS LAST) AS next_id FROM labelled""",
    "enriched": "SELECT p.*, s.brand, s.post_code FROM prices_raw p LEFT JOIN stations s ON p.uuid = s.id",
    "markers": """
        SELECT s.section, s.line_no AS start_no, min(e.line_no) AS end_no
        FROM (SELECT CASE WHEN line LIKE 'COPY public.gas_station (%' THEN 'stations' ELSE 'prices' END AS section, line_no
              FROM dump_lines WHERE line LIKE 'COPY public.gas_station (%' OR line LIKE 'COPY public.gas_station_information_history (%') s
        JOIN dump_lines e ON e.line = chr(92) || '.' AND e.line_no > s.line_no GROUP BY ALL""",
    "cells": """
        SELECT sum(cast(y_true = 0 AND y_prob <= 0.59 AS bigint)) AS tn, sum(cast(y_true = 0 AND y_prob > 0.59 AS bigint)) AS fp,
          sum(cast(y_true = 1 AND y_prob <= 0.59 AS bigint)) AS fn, sum(cast(y_true = 1 AND y_prob > 0.59 AS bigint)) AS tp
        FROM scores""",
    "by_class": """
        SELECT '0' AS label, coalesce(tn / nullif(tn + fn, 0), 0) AS p, coalesce(tn / nullif(tn + fp, 0), 0) AS r, tn + fp AS n FROM cells
        UNION ALL
        SELECT '1', coalesce(tp / nullif(tp + fp, 0), 0), coalesce(tp / nullif(tp + fn, 0), 0), tp + fn FROM cells""",
    "with_f1": "SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM by_class",
    # Forecast: what was known before a day.
    "numbered_days": "SELECT *, row_number() OVER (PARTITION BY uuid ORDER BY day) AS n FROM e5_daily",
    "priced_days": "SELECT DISTINCT uuid, day FROM prices WHERE e5 IS NOT NULL",
    "days_before": """
        SELECT k.uuid, k.day, count(d.n) AS nb FROM priced_days k LEFT JOIN numbered_days d ON d.uuid = k.uuid AND d.day < k.day
        GROUP BY k.uuid, k.day""",
    "past_means": """
        SELECT b.uuid, b.day, max(d.e5_1d_mean) FILTER (d.n = b.nb) AS lag_1, max(d.e5_1d_mean) FILTER (d.n = b.nb - 2) AS lag_3,
          max(d.e5_1d_mean) FILTER (d.n = b.nb - 6) AS lag_7, avg(d.e5_1d_mean) AS mean_7, stddev_samp(d.e5_1d_mean) AS sd_7
        FROM days_before b JOIN numbered_days d ON d.uuid = b.uuid AND d.n BETWEEN b.nb - 6 AND b.nb GROUP BY b.uuid, b.day""",
    "market": "SELECT day, avg(e5_1d_mean) AS market FROM e5_daily GROUP BY day",
    "forecast_days": """
        SELECT k.day, row_number() OVER (ORDER BY k.day) AS n, count(*) OVER () AS days,
          (SELECT arg_max(m.market, m.day) FROM market m WHERE m.day < k.day) AS market,
          (SELECT arg_max(o.oil_price, o.date) FROM oil o WHERE o.date < k.day) AS oil_price,
          (SELECT arg_max(o.oil_7d_avg, o.date) FROM oil o WHERE o.date < k.day) AS oil_7d_avg
        FROM (SELECT DISTINCT day FROM priced_days) k""",
    "forecast_codes": """
        SELECT p.uuid, row_number() OVER (ORDER BY p.uuid) - 1 AS code
        FROM (SELECT DISTINCT p.uuid FROM priced_days p JOIN forecast_days d ON p.day = d.day WHERE d.n <= ceil(d.days * 0.7)) p""",
    # Folds: classes in order of first appearance, rows of a class in row order, positions dealt in turn.
    "train_slice": "SELECT * FROM slice WHERE split = 'train'",
    "row_numbers": "SELECT *, row_number() OVER (ORDER BY day, uuid, date, id) AS row_no FROM train_slice",
    "class_order": "SELECT price_will_change, min(row_no) AS first_row FROM row_numbers GROUP BY price_will_change",
    "lined_up": """
        SELECT r.id, r.price_will_change, row_number() OVER (ORDER BY c.first_row, r.row_no) - 1 AS p,
          row_number() OVER (PARTITION BY r.price_will_change ORDER BY r.row_no) AS j
        FROM row_numbers r JOIN class_order c USING (price_will_change)""",
    "fold_ends": f"""
        SELECT price_will_change, p % {FOLDS} AS dealt,
          sum(count(*)) OVER (PARTITION BY price_will_change ORDER BY p % {FOLDS}) AS last_j
        FROM lined_up GROUP BY price_will_change, p % {FOLDS}""",
    # The booster's rows: codes of the training days, and bins of equal numbers of rows.
    "boost_rows": """
        SELECT t.id, t.price_will_change AS y, [
            (dense_rank() OVER (ORDER BY t.uuid) - 1)::double, t.diesel, day(t.date)::double, hour(t.date)::double,
            CASE WHEN b.brand IS NULL THEN (SELECT count(DISTINCT n.brand) FROM train_slice m JOIN brands n ON m.uuid = n.id)
              ELSE dense_rank() OVER (ORDER BY b.brand NULLS LAST) - 1 END::double] AS x
        FROM train_slice t LEFT JOIN brands b ON t.uuid = b.id""",
    "boost_values": """
        SELECT f, v, count(*) AS n FROM (SELECT unnest(range(5)) AS f, unnest(x) AS v FROM boost_rows) GROUP BY f, v""",
    "boost_cuts": """
        SELECT f, v, CASE WHEN count(*) OVER (PARTITION BY f) <= 255 THEN row_number() OVER (PARTITION BY f ORDER BY v) - 1
          ELSE 255 * (sum(n) OVER (PARTITION BY f ORDER BY v) - n) // sum(n) OVER (PARTITION BY f) END AS cut FROM boost_values""",
    "boost_bins": "SELECT f, v, dense_rank() OVER (PARTITION BY f ORDER BY cut) AS b FROM boost_cuts",
    "boost_start": """
        SELECT 1 / (1 + exp(-ln(sum(y)::double / sum(1 - y)))) AS p FROM boost_rows""",
    "boost_first": f"""
        SELECT id, list(b ORDER BY f) AS bs, any_value(round((p - y) * {SCALE})) AS g, any_value(round(p * (1 - p) * {SCALE})) AS h
        FROM (SELECT id, y, unnest(range(5)) AS f, unnest(x) AS v FROM boost_rows) JOIN boost_bins USING (f, v)
        CROSS JOIN boost_start
        GROUP BY id""",
    "ranked": """
        SELECT y_true, rank() OVER (ORDER BY y_prob) + (count(*) OVER (PARTITION BY y_prob) - 1) / 2.0 AS rnk FROM scores""",
}


def _grown(leaves: int, min_rows: int, penalty: float) -> str:
    """The first tree of the booster, one split after the other: the best split of any leaf is the next."""
    names = "['uuid', 'diesel', 'day', 'hour', 'brand']"
    gain = lambda g, h: f"pow(greatest(abs({g} / {SCALE}) - {penalty}, 0), 2) / ({h} / {SCALE} + {penalty})"
    parts = ["r0 AS MATERIALIZED (SELECT id, bs, g, h, 0 AS leaf FROM boost_first)"]
    for k in range(leaves - 1):
        parts.append(f"""h{k} AS MATERIALIZED (
          SELECT leaf, f, b, sum(g) AS g, sum(h) AS h, count(*) AS n
          FROM (SELECT leaf, unnest(range(5)) AS f, unnest(bs) AS b, g, h FROM r{k}) GROUP BY leaf, f, b)""")
        parts.append(f"""c{k} AS (
          SELECT leaf, f, b, sum(g) OVER l AS gl, sum(h) OVER l AS hl, sum(n) OVER l AS nl, sum(g) OVER a AS g, sum(h) OVER a AS h,
            sum(n) OVER a AS n FROM h{k} WINDOW a AS (PARTITION BY leaf, f), l AS (PARTITION BY leaf, f ORDER BY b))""")
        parts.append(f"""s{k} AS MATERIALIZED (
          SELECT leaf, f, b, n, {gain("gl", "hl")} + {gain("(g - gl)", "(h - hl)")} - {gain("g", "h")} AS gain FROM c{k}
          WHERE nl >= {min_rows} AND n - nl >= {min_rows} AND {gain("gl", "hl")} + {gain("(g - gl)", "(h - hl)")} - {gain("g", "h")} > 0
          ORDER BY gain DESC, leaf, f, b LIMIT 1)""")
        parts.append(f"""r{k + 1} AS MATERIALIZED (
          SELECT r.id, r.bs, r.g, r.h, CASE WHEN r.leaf = s.leaf AND r.bs[s.f + 1] > s.b THEN {k + 1} ELSE r.leaf END AS leaf
          FROM r{k} r LEFT JOIN s{k} s ON true)""")
    found = " UNION ALL ".join(f"SELECT {k} AS step, * FROM s{k}" for k in range(leaves - 1))
    return f"""
        SELECT t.step::int AS step, {names}[t.f + 1] AS feature, {_r("u.upper", "threshold")}, {_r("t.gain", "gain")}, t.n::bigint AS records
        FROM (WITH {", ".join(parts)} {found}) t
        JOIN (SELECT f, b, max(v) AS upper FROM boost_bins GROUP BY f, b) u ON t.f = u.f AND t.b = u.b"""


def _sql(main: str) -> str:
    """`main` with the parts it mentions, and the parts those mention, as common table expressions."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(PARTS[name])

    visit(main)
    depends = {n: {m for m in needed if m != n and re.search(rf"\b(FROM|JOIN)\s+{m}\b", PARTS[n])} for n in needed}
    ordered: list[str] = []
    while len(ordered) < len(needed):
        ordered += sorted(n for n in needed if n not in ordered and depends[n] <= set(ordered))
    parts = ",\n".join(f"{name} AS ({PARTS[name].strip()})" for name in ordered)
    return f"WITH {parts}\n{main.strip()}" if parts else main.strip()


MEANS = [f"{fuel}_{days}d_mean" for fuel in FUELS for days in (1, 3, 7)]
MEAN_JOINS = " ".join(f"LEFT JOIN {fuel}_rolled ON x.uuid = {fuel}_rolled.uuid AND x.day = {fuel}_rolled.day" for fuel in FUELS)
LAGGED = ["e5_1d_mean", "e5_lag_1", "e5_lag_3", "e5_lag_7", "e5_7d_avg", "e5_volatility", "oil_price", "oil_7d_avg"]

_MAIN: dict[str, str] = {
    "q_load_prices": "SELECT id, uuid, e5, e10, diesel, "
    "strftime(date, '%Y-%m-%d %H:%M:%S') || '.000000' AS date, change FROM prices_raw",
    "q_load_stations": """
        SELECT id, name, brand,
          nullif(post_code, chr(92) || 'N') AS post_code, try_cast(nullif(post_code, chr(92) || 'N') AS double) AS post_code_int
        FROM stations""",
    "q_copy_section": """
        SELECT m.section, d.line_no, d.line FROM dump_lines d JOIN markers m ON d.line_no > m.start_no AND d.line_no < m.end_no""",
    "q_land_dump": """
        SELECT m.section, d.line FROM dump_lines d JOIN markers m ON d.line_no > m.start_no AND d.line_no < m.end_no""",
    "q_parse_copy": f"""
        SELECT id, uuid, e5, e10, diesel, change,
          CASE WHEN id % 50 <> 0 THEN {MOMENT.format("date_trunc('second', date) - to_hours(cast(id % 2 AS int))")} END AS date,
          CASE WHEN id % 50 = 0 THEN 'date not readable' END AS reject FROM prices_raw""",
    "q_json_flatten": f"""
        SELECT 'a-' || event_id AS id, {_r("value", "e5")}, cast(json_extract(props, '$.k') AS bigint) AS props_k FROM events""",
    "q_oil_skip_first": f"""
        SELECT {DAY.format("date")} AS date, close FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM oil_daily) WHERE n > 1""",
    "q_recent_window": f"""
        SELECT id, uuid, {MOMENT.format("date")} AS date FROM prices_raw
        WHERE date >= TIMESTAMP '{AS_OF}' - INTERVAL {RECENT_DAYS} DAY""",
    "q_price_normalize": f"SELECT id, {_rs(*FUELS)} FROM prices",
    "q_price_enrich": f"SELECT * REPLACE ({MOMENT.format('date')} AS date) FROM enriched",
    "q_time_features": f"""
        SELECT id, hour(date)::int AS hour, minute(date)::int AS minute, month(date)::int AS month, day(date)::int AS day,
          (isodow(date) - 1)::int AS weekday,
          {_r("sin(2 * pi() * hour(date) / 24)", "hour_sin")}, {_r("cos(2 * pi() * hour(date) / 24)", "hour_cos")},
          {_r("sin(2 * pi() * (isodow(date) - 1) / 7)", "weekday_sin")}
        FROM prices_raw""",
    "q_change_label": f"SELECT id, uuid, {_rs('diesel', 'diesel_shift')}, price_will_change FROM labelled",
    "q_change_label_busy": f"SELECT id, uuid, {_rs('diesel', 'diesel_shift')}, price_will_change FROM labelled",
    "q_final_files": """
        SELECT month(date)::int AS month, day(date)::int AS day, count(*) AS records, 0::bigint AS falls
        FROM prices GROUP BY ALL""",
    "q_final_table": f"""
        SELECT l.uuid, {_rs(*FUELS, 'diesel_shift', table='l.')}, l.price_will_change, s.brand,
          hour(date)::int AS hour, minute(date)::int AS minute, month(date)::int AS month, day(date)::int AS day,
          {_r("sin(2 * pi() * hour(date) / 24)", "hour_sin")}, {_r("sin(2 * pi() * (isodow(date) - 1) / 7)", "weekday_sin")}
        FROM labelled l LEFT JOIN stations s ON l.uuid = s.id""",
    "q_clean_category": "SELECT id, brand FROM brands",
    "q_label_encode": """
        SELECT p.id, (dense_rank() OVER (ORDER BY p.uuid) - 1)::int AS uuid,
          (dense_rank() OVER (ORDER BY b.brand NULLS LAST) - 1)::int AS brand
        FROM prices_raw p LEFT JOIN brands b ON p.uuid = b.id""",
    "q_daily_mean": f"""
        SELECT x.uuid, {DAY.format("x.day")} AS day, {_rs(*[f"{f}_1d_mean" for f in FUELS])} FROM station_days x {MEAN_JOINS}""",
    "q_rolling_means": f"""
        SELECT x.uuid, {DAY.format("x.day")} AS day,
          {", ".join(_r(f"cast(cast({m} AS float) AS double)" if "_3d_" in m else m, m) for m in MEANS)}
        FROM station_days x {MEAN_JOINS}""",
    "q_attach_means": f"SELECT x.id, {_rs(*MEANS)} FROM prices x {MEAN_JOINS}",
    "q_join_oil": f"""
        SELECT p.id, {MOMENT.format("p.date")} AS date, {_r("o.close", "close")}
        FROM prices_raw p LEFT JOIN oil_daily o ON cast(p.date AS date) = o.date""",
    "q_oil_asof": f"""
        SELECT p.id, p.uuid, {MOMENT.format("p.date")} AS date, {_rs("close", table="m.")}, {_rs("own_close", table="s.")}
        FROM prices_raw p ASOF LEFT JOIN market_ticks m ON p.date >= m.date
        ASOF LEFT JOIN station_ticks s ON p.uuid = s.uuid AND p.date >= s.date""",
    "q_lag_features": f"""
        SELECT uuid, {DAY.format("day")} AS day, {_rs(*LAGGED)} FROM lagged LEFT JOIN oil ON lagged.day = oil.date""",
    "q_live_features": f"""
        SELECT l.id, {LIVE_AT.hour} AS hour, {_r("l.e5", "e5")},
          {_r(f"sin(2 * pi() * {LIVE_AT.hour} / 24)", "hour_sin")}, {_r(f"cos(2 * pi() * {LIVE_AT.hour} / 24)", "hour_cos")},
          {_r("coalesce(h.lag_1, l.e5)", "e5_lag_1")}, {_r("coalesce(h.lag_3, l.e5)", "e5_lag_3")},
          {_r("coalesce(h.lag_7, l.e5)", "e5_lag_7")}, {_r("coalesce(h.mean_7, l.e5)", "e5_7d_avg")},
          {_r("coalesce(h.sd_7, 0)", "e5_volatility")}, 70.0::double AS oil_price, 70.0::double AS oil_7d_avg
        FROM live l LEFT JOIN history h ON l.id = h.uuid""",
    "q_train_rows": f"SELECT id, uuid, {_rs('diesel', 'diesel_shift')}, price_will_change FROM train_rows",
    "q_day_index": """
        SELECT id, (month(day) * 100 + day(day))::int AS mmdd, day_idx::int AS day_idx FROM short_slice""",
    "q_train_test_split": "SELECT id, day_idx::int AS day_idx, split, price_will_change FROM slice",
    "q_train_valid_split": "SELECT id, day_idx::int AS day_idx, split, price_will_change FROM valid_slice",
    "q_eval_join": f"""
        SELECT orig_idx, id, uuid, {_rs('diesel', 'diesel_shift')}, price_will_change AS y_true
        FROM (SELECT *, row_number() OVER (ORDER BY day, uuid, date, id) - 1 AS orig_idx FROM slice) WHERE split = 'test'""",
    "q_folds": """
        SELECT l.id, l.price_will_change, cast(count(f.dealt) AS int) AS fold
        FROM lined_up l LEFT JOIN fold_ends f ON l.price_will_change = f.price_will_change AND f.last_j < l.j
        GROUP BY l.id, l.price_will_change""",
    "q_threshold": f"SELECT id, y_true, {_r('y_prob', 'y_prob')}, CASE WHEN y_prob > 0.59 THEN 1 ELSE 0 END AS y_pred FROM scores",
    "q_confusion_matrix": """
        SELECT g.y_true::int AS y_true, g.y_pred::int AS y_pred, count(s.id) AS n
        FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) g(y_true, y_pred)
        LEFT JOIN scores s ON s.y_true = g.y_true AND cast(s.y_prob > 0.59 AS int) = g.y_pred GROUP BY g.y_true, g.y_pred""",
    "q_classification_report": """
        SELECT label, round(p, 9) + 0.0 AS precision, round(r, 9) + 0.0 AS recall, round(f, 9) + 0.0 AS f1_score, n::bigint AS support FROM with_f1
        UNION ALL SELECT 'accuracy', NULL, NULL, round((tn + tp) / (tn + fp + fn + tp), 9), (tn + fp + fn + tp)::bigint FROM cells
        UNION ALL SELECT 'macro avg', round(avg(p), 9), round(avg(r), 9), round(avg(f), 9), sum(n)::bigint FROM with_f1
        UNION ALL SELECT 'weighted avg', round(sum(p * n) / sum(n), 9), round(sum(r * n) / sum(n), 9), round(sum(f * n) / sum(n), 9), sum(n)::bigint FROM with_f1""",
    "q_roc_auc": f"""
        SELECT {_r('''(sum(CASE WHEN y_true = 1 THEN rnk END) - count(*) FILTER (y_true = 1) * (count(*) FILTER (y_true = 1) + 1) / 2.0)
          / (count(*) FILTER (y_true = 1) * count(*) FILTER (y_true = 0))''', 'roc_auc')} FROM ranked""",
    "q_log_loss": f"""
        SELECT {_r('avg(-ln(CASE WHEN y_true = 1 THEN c ELSE 1 - c END))', 'log_loss')}
        FROM (SELECT y_true, greatest(least(y_prob, 1 - 1e-15), 1e-15) AS c FROM scores)""",
    "q_class_weights": f"""
        SELECT price_will_change, n, {_r('sum(n) OVER () / (count(*) OVER () * n)', 'weight')}
        FROM (SELECT price_will_change, count(*) AS n FROM train_rows GROUP BY price_will_change)""",
    "q_regression_metrics": f"""
        SELECT n, {_rs('pearson', 'mse', 'mae')}, round(pearson * sqrt((n - 2) / (1 - pearson * pearson)), 4) AS t
        FROM (SELECT count(*) AS n, corr(e5_1d_mean, e5_7d_avg) AS pearson, avg((e5_1d_mean - e5_7d_avg) ** 2) AS mse,
                avg(abs(e5_1d_mean - e5_7d_avg)) AS mae FROM lagged)""",
    "q_hourly_grid": f"SELECT uuid, {MOMENT.format('hour_start')} AS hour_start, {_r('e5', 'e5')} FROM grid",
    "q_cheapest_hour": f"""
        SELECT uuid, {DAY.format("hour_start")} AS day, hour(hour_start)::int AS hour, {_r("e5", "e5")}
        FROM (SELECT *, row_number() OVER (PARTITION BY uuid, cast(hour_start AS date) ORDER BY e5, hour_start) AS n FROM grid)
        WHERE n = 1""",
    "q_price_patterns": f"""
        SELECT b.brand, (isodow(l.date) - 1)::int AS weekday, hour(l.date)::int AS hour, count(*) AS records,
          {_r("avg(l.diesel)", "mean_price")}, {_r("avg(l.price_will_change)", "change_rate")}
        FROM labelled l LEFT JOIN brands b ON l.uuid = b.id GROUP BY ALL""",
    "q_stream_changes": f"""
        SELECT id, uuid, {_rs('diesel', 'diesel_shift')}, price_will_change FROM next_known WHERE next_id IS NOT NULL""",
}

# Facts about models that hold for any right training, beside what comes from the tables.
_MAIN |= {
    "q_scored_rows": "SELECT id, price_will_change, true AS class_follows FROM slice WHERE split = 'test'",
    "q_model_roundtrip": "SELECT id, price_will_change, true AS same FROM slice WHERE split = 'test'",
    "q_round_losses": f"""
        SELECT split, round::int AS round, CASE WHEN split = 'train' THEN true END AS no_higher,
          CASE WHEN split = 'test' AND round = {BOOST.rounds} THEN true END AS as_scored
        FROM (SELECT DISTINCT split FROM slice), (SELECT unnest(generate_series(1, {BOOST.rounds})) AS round)""",
    "q_feature_importance": """
        SELECT feature, true AS not_negative, 1.0::double AS total
        FROM (VALUES ('uuid'), ('diesel'), ('day'), ('hour'), ('brand')) f(feature)""",
    "q_leafwise_trees": _grown(64, 200, 0.5),
    "q_leafwise_model": """
        SELECT 'better than each feature' AS fact, true AS holds UNION ALL SELECT 'scores follow from the nodes', true
        UNION ALL SELECT 'text gives the same scores', true UNION ALL SELECT 'gains add up', true""",
    "q_leafwise_search": """
        SELECT 'points' AS fact, 4::bigint AS n UNION ALL SELECT 'distinct points', 4 UNION ALL SELECT 'scans of one point', 1
        UNION ALL SELECT 'best is least', 1 UNION ALL SELECT 'trees of the refit', 1""",
    "q_model_text": f"""
        SELECT id, {_r("a + b", "raw")}, {_r("1 / (1 + exp(-2.0 * (a + b)))", "y_prob")} FROM (
          SELECT id,
            CASE WHEN diesel <= 1.45 OR diesel IS NULL THEN CASE WHEN hour(date) <= 11.5 THEN 0.25 ELSE -0.125 END
              WHEN coalesce(e5, 0) <= 1.6 THEN 0.5 ELSE -0.75 END AS a,
            CASE WHEN hour(date) = 0 THEN 0.0625 WHEN hour(date) <= 17 THEN -0.03125 ELSE 0.0625 END AS b
          FROM prices)""",
    "q_search_runs": "SELECT 2::int AS points, 2::int AS distinct_points, true AS best_is_least, true AS refit",
    "q_sinks": f"""
        SELECT 'slice ' || split AS sink, count(*) AS records, {_r("sum(id)::double", "value")} FROM slice GROUP BY split
        UNION ALL SELECT 'oil ' || {DAY.format("date")}, 1::bigint, {_r("close", "value")} FROM oil_daily
        UNION ALL SELECT 'runs', 2::bigint, {_r("avg(-ln(CASE WHEN y_true = 1 THEN c ELSE 1 - c END))", "value")}
        FROM (SELECT y_true, greatest(least(y_prob, 1 - 1e-15), 1e-15) AS c FROM scores)""",
    "q_forecast_rows": f"""
        SELECT p.id, CASE WHEN d.n <= ceil(d.days * 0.7) THEN 'train' ELSE 'test' END AS split, {_r("p.e5", "e5")},
          coalesce(c.code, (SELECT count(*) FROM forecast_codes))::int AS station_id_encoded,
          {_r("sin(2 * pi() * hour(p.date) / 24)", "hour_sin")}, {_r("cos(2 * pi() * hour(p.date) / 24)", "hour_cos")},
          {_r("coalesce(h.lag_1, d.market, 0)", "e5_lag_1")}, {_r("coalesce(h.lag_3, h.lag_1, d.market, 0)", "e5_lag_3")},
          {_r("coalesce(h.lag_7, h.lag_1, d.market, 0)", "e5_lag_7")}, {_r("coalesce(h.mean_7, d.market, 0)", "e5_7d_avg")},
          {_r("coalesce(h.sd_7, 0)", "e5_volatility")},
          {_r("coalesce(d.oil_price, 70)", "oil_price")}, {_r("coalesce(d.oil_7d_avg, 70)", "oil_7d_avg")}
        FROM prices p JOIN forecast_days d ON p.day = d.day
        LEFT JOIN past_means h ON p.uuid = h.uuid AND p.day = h.day LEFT JOIN forecast_codes c ON p.uuid = c.uuid
        WHERE p.e5 IS NOT NULL""",
}

ORACLES: dict[str, str] = {name: _sql(main) for name, main in _MAIN.items()}
