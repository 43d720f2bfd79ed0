"""DuckDB SQL for every checkable key: the independent oracle.

Each entry is plain SQL over the given tables (region, nation, supplier,
lineitem, orders as views). Relations are built from CTE fragments so that
every query spells its whole derivation from the base tables. Float columns
listed per entry are rounded to 6 decimals, matching the Spark side, which
rounds all DOUBLE columns the same way before comparison.
"""

from __future__ import annotations

# "Today" is the latest bar in the data.
AS_OF = "(SELECT max(date) FROM prices_daily)"
INDEX_AS_OF = "(SELECT max(date) FROM index_daily)"
MIN_OVERLAP = 180
TICKER = "'NATION_3'"
DAILY_RF = "(CAST(0.065 AS DOUBLE) / 252.0)"
SQRT252 = "sqrt(252.0)"

# --- relation fragments -------------------------------------------------------

F_STOCKS = """stocks AS (
  SELECT n.n_name AS ticker, 'Company ' || n.n_name AS company_name, r.r_name AS sector,
         'Industry ' || CAST(n.n_nationkey % 7 AS VARCHAR) AS industry
  FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey)"""

F_PRICES = """prices_daily AS (
  SELECT n.n_name AS ticker, CAST(l.l_shipdate AS DATE) AS date,
         min_by(l.l_extendedprice / l.l_quantity,
                row(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS open,
         max(l.l_extendedprice / l.l_quantity) AS high,
         min(l.l_extendedprice / l.l_quantity) AS low,
         max_by(l.l_extendedprice / l.l_quantity,
                row(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS close,
         max_by(l.l_extendedprice / l.l_quantity,
                row(l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice)) AS adj_close,
         CAST(sum(l.l_quantity) AS BIGINT) AS volume
  FROM lineitem l
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  GROUP BY 1, 2)"""

F_INDEX = """index_daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         min_by(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, max_by(o_totalprice, o_orderkey) AS close,
         count(*) AS volume
  FROM orders GROUP BY 1)"""

F_PRED = """pred_abc AS (
  SELECT ticker, date,
         1 + CAST(floor(close) AS BIGINT) % 97 AS a,
         1 + CAST(floor(open * 7) AS BIGINT) % 89 AS b,
         1 + volume % 83 AS c,
         CAST(floor(close) AS BIGINT) % 10 AS k
  FROM prices_daily),
pred_cls AS (
  SELECT *, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS p
  FROM pred_abc),
ml_predictions AS (
  SELECT ticker, date,
         CAST(CASE WHEN k < 6 THEN p ELSE (p + 1) % 3 END AS INTEGER) AS actual_regime,
         CAST(p AS INTEGER) AS predicted_regime,
         round(a / (a + b + c), 4) AS prob_low,
         round(b / (a + b + c), 4) AS prob_medium,
         round(c / (a + b + c), 4) AS prob_high,
         greatest(round(a / (a + b + c), 4), round(b / (a + b + c), 4), round(c / (a + b + c), 4)) AS confidence,
         (CASE WHEN k < 6 THEN p ELSE (p + 1) % 3 END) = p AS correct
  FROM pred_cls)"""

F_RETURNS = """returns_daily AS (
  SELECT ticker, date, adj_close, prev_close,
         CASE WHEN prev_close IS NOT NULL AND prev_close <> 0
              THEN (adj_close - prev_close) / prev_close END AS simple_return,
         CASE WHEN prev_close > 0 AND adj_close > 0 THEN ln(adj_close / prev_close) END AS log_return
  FROM (SELECT ticker, date, adj_close,
               lag(adj_close) OVER (PARTITION BY ticker ORDER BY date) AS prev_close
        FROM prices_daily))"""

F_VOL = f"""rolling_volatility AS (
  SELECT ticker, date, adj_close, simple_return, log_return,
         stddev_samp(log_return) OVER w20 * {SQRT252} AS vol_20d,
         stddev_samp(log_return) OVER w60 * {SQRT252} AS vol_60d,
         count(log_return) OVER w20 AS n_obs_20d
  FROM returns_daily
  WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW))"""

F_SHARPE = f"""sharpe_base AS (
  SELECT ticker, date, log_return,
         avg(log_return - {DAILY_RF}) OVER w60 AS mean_excess_60d,
         stddev_samp(log_return) OVER w60 AS std_60d,
         count(log_return) OVER w60 AS n_obs_60d
  FROM returns_daily
  WINDOW w60 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
rolling_sharpe AS (
  SELECT ticker, date, log_return, mean_excess_60d, std_60d,
         CASE WHEN std_60d > 0 THEN mean_excess_60d * 252 / (std_60d * {SQRT252}) END AS sharpe_60d,
         n_obs_60d
  FROM sharpe_base)"""

F_DRAWDOWN = """drawdown_daily AS (
  SELECT ticker, date, adj_close, running_max,
         CASE WHEN running_max <> 0 THEN (adj_close - running_max) / running_max END AS drawdown
  FROM (SELECT ticker, date, adj_close,
               max(adj_close) OVER (PARTITION BY ticker ORDER BY date
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_max
        FROM prices_daily))"""

F_CORR = f"""corr_in AS (
  SELECT ticker, date, log_return FROM returns_daily
  WHERE date >= {AS_OF} - INTERVAL 365 DAY AND date <= {AS_OF} AND log_return IS NOT NULL),
correlation_matrix AS (
  SELECT a.ticker AS ticker_a, b.ticker AS ticker_b,
         covar_samp(a.log_return, b.log_return)
           / nullif(stddev_samp(a.log_return) * stddev_samp(b.log_return), 0) AS correlation,
         count(*) AS n_overlap_days
  FROM corr_in a JOIN corr_in b ON a.date = b.date
  GROUP BY 1, 2
  HAVING count(*) >= {MIN_OVERLAP})"""

F_ENRICHED = """predictions_enriched AS (
  SELECT p.ticker, s.company_name, s.sector, s.industry, p.date,
         p.actual_regime, p.predicted_regime, p.prob_low, p.prob_medium, p.prob_high,
         p.confidence, p.correct,
         CASE p.predicted_regime WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS predicted_label,
         CASE p.actual_regime WHEN 0 THEN 'Low' WHEN 1 THEN 'Medium' WHEN 2 THEN 'High' END AS actual_label,
         CASE WHEN p.confidence >= 0.70 THEN 'High' WHEN p.confidence >= 0.50 THEN 'Medium' ELSE 'Low' END
           AS confidence_tier
  FROM ml_predictions p JOIN stocks s ON s.ticker = p.ticker)"""

F_LATEST_PRED = """latest_predictions AS (
  SELECT DISTINCT ON (ticker) ticker, company_name, sector, date, predicted_regime, predicted_label,
         confidence, confidence_tier, prob_low, prob_medium, prob_high
  FROM predictions_enriched ORDER BY ticker, date DESC)"""

FRAGMENTS = {
    "stocks": (F_STOCKS, ()),
    "prices_daily": (F_PRICES, ()),
    "index_daily": (F_INDEX, ()),
    "ml_predictions": (F_PRED, ("prices_daily",)),
    "returns_daily": (F_RETURNS, ("prices_daily",)),
    "rolling_volatility": (F_VOL, ("returns_daily",)),
    "rolling_sharpe": (F_SHARPE, ("returns_daily",)),
    "drawdown_daily": (F_DRAWDOWN, ("prices_daily",)),
    "correlation_matrix": (F_CORR, ("returns_daily",)),
    "predictions_enriched": (F_ENRICHED, ("ml_predictions", "stocks")),
    "latest_predictions": (F_LATEST_PRED, ("predictions_enriched",)),
}


def _resolve(names, out, seen):
    for n in names:
        if n in seen:
            continue
        frag, deps = FRAGMENTS[n]
        _resolve(deps, out, seen)
        seen.add(n)
        out.append(frag)


def q(uses: tuple[str, ...], body: str, rnd: tuple[str, ...] = ()) -> str:
    """WITH <fragments for uses> <body>; ``rnd`` columns rounded to 6 decimals."""
    frags: list[str] = []
    _resolve(uses, frags, set())
    body = body.strip()
    if frags and body[:5].upper() == "WITH ":
        sql = "WITH " + ",\n".join(frags) + ",\n" + body[5:]
    else:
        sql = (("WITH " + ",\n".join(frags) + "\n") if frags else "") + body
    if rnd:
        repl = ", ".join(
            f"round_even({c} * CAST(1e6 AS DOUBLE), 0) / CAST(1e6 AS DOUBLE) AS {c}" for c in rnd)
        sql = f"SELECT * REPLACE ({repl}) FROM (\n{sql}\n) AS _o"
    return sql


# --- features (X1-X10): native windows + a recursive CTE for the EWM indicators ----

def _alpha(span: int) -> str:
    return f"(CAST(2 AS DOUBLE) / {span + 1})"


A14 = "(CAST(1 AS DOUBLE) / 14)"
A12, A26, A9 = _alpha(12), _alpha(26), _alpha(9)


def _features_fragment(target_frame: str) -> str:
    return f"""fx_lag AS (
  SELECT ticker, date, high, low, close, adj_close, volume,
         row_number() OVER w - 1 AS i,
         lag(adj_close, 1) OVER w AS p1, lag(adj_close, 5) OVER w AS p5,
         lag(adj_close, 20) OVER w AS p20, lag(close, 1) OVER w AS c1
  FROM prices_daily WINDOW w AS (PARTITION BY ticker ORDER BY date)),
fx_lr AS (
  SELECT *, CASE WHEN p1 > 0 AND adj_close > 0 THEN ln(adj_close / p1) END AS lr,
         greatest(high - low, abs(high - c1), abs(low - c1)) AS tr,
         adj_close - p1 AS dp
  FROM fx_lag),
fx_win AS (
  SELECT *,
    CASE WHEN p5 > 0 AND adj_close > 0 THEN ln(adj_close / p5) END AS ret_5d,
    CASE WHEN p20 > 0 AND adj_close > 0 THEN ln(adj_close / p20) END AS ret_20d,
    CASE WHEN count(lr) OVER w5 = 5 THEN stddev_samp(lr) OVER w5 * {SQRT252} END AS vol_5d,
    CASE WHEN count(lr) OVER w20 = 20 THEN stddev_samp(lr) OVER w20 * {SQRT252} END AS vol_20d,
    count(adj_close) OVER w20 AS n_p20, avg(adj_close) OVER w20 AS m20, stddev_pop(adj_close) OVER w20 AS s20,
    count(volume) OVER w20 AS n_v20, avg(volume) OVER w20 AS vm20,
    CASE WHEN count(lr) OVER wt = 5 THEN avg(abs(lr)) OVER wt END AS abs_return_next
  FROM fx_lr
  WINDOW w5 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
         w20 AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW),
         wt AS (PARTITION BY ticker ORDER BY date {target_frame})),
fx_rec AS (
  WITH RECURSIVE r(ticker, i, e12, e26, eu, ed, trs, atr, sig) AS (
    SELECT ticker, i, adj_close, adj_close, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), tr,
           CAST(0 AS DOUBLE), CAST(NULL AS DOUBLE)
    FROM fx_lr WHERE i = 0
    UNION ALL
    SELECT x.ticker, x.i,
      (1 - {A12}) * r.e12 + {A12} * x.adj_close,
      (1 - {A26}) * r.e26 + {A26} * x.adj_close,
      (1 - {A14}) * r.eu + {A14} * (CASE WHEN x.dp > 0 THEN x.dp ELSE 0 END),
      (1 - {A14}) * r.ed + {A14} * (CASE WHEN x.dp < 0 THEN -x.dp ELSE 0 END),
      r.trs + x.tr,
      CASE WHEN x.i < 13 THEN CAST(0 AS DOUBLE)
           WHEN x.i = 13 THEN (r.trs + x.tr) / 14
           ELSE (r.atr * 13 + x.tr) / CAST(14 AS DOUBLE) END,
      CASE WHEN x.i < 25 THEN NULL
           WHEN x.i = 25 THEN ((1 - {A12}) * r.e12 + {A12} * x.adj_close) - ((1 - {A26}) * r.e26 + {A26} * x.adj_close)
           ELSE (1 - {A9}) * r.sig + {A9} * (((1 - {A12}) * r.e12 + {A12} * x.adj_close)
                                              - ((1 - {A26}) * r.e26 + {A26} * x.adj_close)) END
    FROM r JOIN fx_lr x ON x.ticker = r.ticker AND x.i = r.i + 1)
  SELECT * FROM r),
feature_frame AS (
  SELECT w.ticker, w.date, w.lr AS ret_1d, w.ret_5d, w.ret_20d, w.vol_5d, w.vol_20d,
    CASE WHEN w.n_p20 = 20 AND w.m20 <> 0 THEN ((w.m20 + 2 * w.s20) - (w.m20 - 2 * w.s20)) / w.m20 END AS bb_width,
    CASE WHEN w.close <> 0 THEN r.atr / w.close END AS atr_14,
    CASE WHEN w.i < 13 THEN NULL WHEN r.ed = 0 THEN CAST(100 AS DOUBLE)
         ELSE 100 - (100 / (1 + r.eu / r.ed)) END AS rsi_14,
    CASE WHEN w.i >= 25 THEN r.e12 - r.e26 END AS macd,
    CASE WHEN w.i >= 33 THEN r.sig END AS macd_signal,
    CASE WHEN w.i >= 33 THEN (r.e12 - r.e26) - r.sig END AS macd_diff,
    CASE WHEN w.n_v20 = 20 AND w.vm20 <> 0 THEN w.volume / w.vm20 END AS volume_ratio,
    w.abs_return_next
  FROM fx_win w JOIN fx_rec r ON r.ticker = w.ticker AND r.i = w.i),
fx_q AS (
  SELECT ticker, count(abs_return_next) AS n,
         quantile_cont(abs_return_next, 1.0 / 3) AS q33, quantile_cont(abs_return_next, 2.0 / 3) AS q67
  FROM feature_frame GROUP BY ticker),
labelled AS (
  SELECT f.*, CAST(CASE WHEN q.n < 60 OR f.abs_return_next IS NULL THEN NULL
                        WHEN f.abs_return_next <= q.q33 THEN 0
                        WHEN f.abs_return_next <= q.q67 THEN 1 ELSE 2 END AS INTEGER) AS regime
  FROM feature_frame f JOIN fx_q q ON q.ticker = f.ticker),
ml_features AS (
  SELECT * FROM labelled
  WHERE ret_1d IS NOT NULL AND ret_5d IS NOT NULL AND ret_20d IS NOT NULL AND vol_5d IS NOT NULL
    AND vol_20d IS NOT NULL AND bb_width IS NOT NULL AND atr_14 IS NOT NULL AND rsi_14 IS NOT NULL
    AND macd IS NOT NULL AND macd_signal IS NOT NULL AND volume_ratio IS NOT NULL)"""


FRAGMENTS["ml_features"] = (_features_fragment("ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING"), ("prices_daily",))
FRAGMENTS["ml_features_fwd"] = (
    _features_fragment("ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING")
    .replace("fx_", "fy_").replace("feature_frame", "feature_frame_fwd").replace("labelled", "labelled_fwd")
    .replace("ml_features AS", "ml_features_fwd AS"),
    ("prices_daily",))
FEATURE_FLOATS = ("ret_1d", "ret_5d", "ret_20d", "vol_5d", "vol_20d", "bb_width", "atr_14",
                  "rsi_14", "macd", "macd_signal", "macd_diff", "volume_ratio", "abs_return_next")


# --- portfolio parameters as literal relations -------------------------------------

def _holdings_fragment() -> str:
    from kestrel.sources.adapters import PERIODS, PORTFOLIOS
    h = ", ".join(f"('{p}', '{t}', CAST({w!r} AS DOUBLE))" for p, items in PORTFOLIOS.items() for t, w in items)
    r = ", ".join(f"('{p}', DATE '{s.isoformat()}', DATE '{e.isoformat()}')" for p, (s, e) in PERIODS.items())
    return (f"fixed_holdings AS (SELECT * FROM (VALUES {h}) AS t(portfolio_id, ticker, weight)),\n"
            f"fixed_periods AS (SELECT * FROM (VALUES {r}) AS t(portfolio_id, start_date, end_date)),\n"
            f"""vol_holdings AS (
  SELECT 'vol_' || s.sector AS portfolio_id, v.ticker, v.vol / sum(v.vol) OVER (PARTITION BY s.sector) AS weight
  FROM (SELECT ticker, CAST(sum(volume) AS DOUBLE) AS vol FROM prices_daily GROUP BY ticker) v
  JOIN stocks s ON s.ticker = v.ticker),
holdings AS (SELECT * FROM fixed_holdings UNION ALL SELECT * FROM vol_holdings),
periods AS (SELECT * FROM fixed_periods UNION ALL
            SELECT DISTINCT portfolio_id, CAST({AS_OF} - INTERVAL 1 YEAR AS DATE), {AS_OF} FROM vol_holdings)""")


FRAGMENTS["holdings"] = (_holdings_fragment(), ("prices_daily", "stocks"))
