"""Registered keys: sources and sinks (S2-S9), named-query lookup (P11), ML (L1-L11), refresh job."""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kestrel.config import FEATURE_COLS, checkpoint_dir
from kestrel.operators import ml
from kestrel.operators.boosting import BoostedModel
from kestrel.plans import job
from kestrel.plans import named as N
from kestrel.plans.context import BAR_SOURCES
from kestrel.plans.oracle import AS_OF, INDEX_AS_OF, q
from kestrel.plans.registry import register
from kestrel.sources import adapters, checked, comoments, incremental, ingest, sinks, vendor
from kestrel.sources.store import source_signature
from kestrel.sources.tables import read_table

PRICE_FLOATS = ("open", "high", "low", "close", "adj_close")



def _index_range(m):
    """The fetch window that ends with the latest index bar."""
    end = F.date_add(m.index.select(F.max("date")).scalar(), 1)
    return ingest.index_fetch_range(end)


# ---- S2-S9 ---------------------------------------------------------------------------

register("ingest_bars", q(("prices_daily",), """
SELECT ticker, date, open, high, low, close, adj_close, volume FROM prices_daily""",
    PRICE_FLOATS))(lambda m: ingest.ingest_bars(adapters.raw_vendor_bars(m.spark, m.base)))

register("ingest_index", q(("index_daily",), f"""
SELECT date, open, high, low, close, volume FROM index_daily
WHERE date >= {INDEX_AS_OF} - INTERVAL {5 * 365 + 30 - 1} DAY""",
    ("open", "high", "low", "close")))(
    lambda m: ingest.ingest_index(adapters.raw_vendor_index(m.spark, m.base), *_index_range(m)))

register("ingest_summary", q(("stocks", "prices_daily"), """
SELECT s.ticker, CASE WHEN p.n IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(p.n, 0) AS n_rows,
       p.earliest, p.latest
FROM stocks s LEFT JOIN (SELECT ticker, count(*) AS n, min(date) AS earliest, max(date) AS latest
                         FROM prices_daily GROUP BY ticker) p ON p.ticker = s.ticker"""))(
    lambda m: ingest.ingest_summary(ingest.ingest_bars(adapters.raw_vendor_bars(m.spark, m.base)), m.stocks))



def _vendor_files(m, broken=None):
    """The bars written as vendor files and read back by the data source."""
    path = f"{checkpoint_dir(m.spark).rstrip('/')}/vendor-{uuid.uuid4().hex[:12]}"
    raw = m.prices.withColumnRenamed("ticker", "symbol")
    vendor.write_vendor_files(raw, path, None if broken is None else broken(raw))
    return ingest.ingest_bars(vendor.vendor_bars(vendor.read_vendor(m.spark, path)))


register("vendor_ingest", q(("prices_daily",), """
SELECT ticker, date, open, high, low, close, adj_close, volume FROM (
  SELECT ticker, date, open, high, low, close, close AS adj_close, volume FROM prices_daily) WHERE close IS NOT NULL""",
    PRICE_FLOATS))(_vendor_files)

register("vendor_ingest_summary", q(("stocks", "prices_daily"), """
WITH p AS (
  SELECT ticker, count(*) AS n, min(date) AS earliest, max(date) AS latest FROM prices_daily
  WHERE close IS NOT NULL AND ticker <> (SELECT min(ticker) FROM prices_daily) GROUP BY ticker)
SELECT s.ticker, CASE WHEN p.n IS NULL THEN 'failed' ELSE 'ok' END AS status, coalesce(p.n, 0) AS n_rows,
       p.earliest, p.latest
FROM stocks s LEFT JOIN p ON p.ticker = s.ticker"""))(
    lambda m: ingest.ingest_summary(_vendor_files(m, lambda raw: raw.agg(F.min("symbol").alias("symbol"))), m.stocks))

register("static_dimension", q(("stocks",), "SELECT ticker, company_name, sector, industry FROM stocks"))(
    lambda m: ingest.static_dimension(m.spark, m.stocks))


def _upsert_updates(m):
    nation = read_table(m.spark, m.base, "nation", ["n_name", "n_regionkey"])
    region = read_table(m.spark, m.base, "region", ["r_regionkey", "r_name"])
    renamed = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey).select(
        F.col("n_name").alias("ticker"), F.concat(F.lit("Company "), "n_name", F.lit(" Ltd")).alias("company_name"),
        F.col("r_name").alias("sector"), F.concat(F.lit("Industry R"), F.col("n_regionkey").cast("string")).alias("industry"))
    added = region.select(F.concat(F.lit("INDEX_"), "r_name").alias("ticker"),
                          F.concat(F.lit("Index "), "r_name").alias("company_name"),
                          F.col("r_name").alias("sector"), F.lit("Index").alias("industry"))
    return renamed.unionByName(added)


register("upsert_dimension", q(("stocks",), """
WITH n AS (
  SELECT n_name AS ticker, 'Company ' || n_name || ' Ltd' AS company_name, r_name AS sector,
         'Industry R' || CAST(n_regionkey AS VARCHAR) AS industry
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 'INDEX_' || r_name, 'Index ' || r_name, r_name, 'Index' FROM region)
SELECT coalesce(n.ticker, s.ticker) AS ticker,
       CASE WHEN n.ticker IS NOT NULL THEN n.company_name ELSE s.company_name END AS company_name,
       CASE WHEN n.ticker IS NOT NULL THEN n.sector ELSE s.sector END AS sector,
       CASE WHEN n.ticker IS NOT NULL THEN n.industry ELSE s.industry END AS industry
FROM stocks s FULL OUTER JOIN n ON n.ticker = s.ticker"""))(
    lambda m: sinks.upsert_dimension(m.stocks, _upsert_updates(m)))

register("full_refresh_sink", q(("prices_daily",), "SELECT * FROM prices_daily", PRICE_FLOATS))(
    lambda m: m.spark.read.parquet(sinks.full_refresh(m.prices, "prices_daily")))

_DECIMALS = {c: t.simpleString() for c, t in sinks.ML_FEATURES_DDL.items() if isinstance(t, T.DecimalType)}


def _drop_create(m):
    """The stored table, its declared decimals read as double."""
    stored = m.spark.read.parquet(sinks.drop_create(m.features, "ml_features", sinks.ML_FEATURES_DDL))
    return stored.select(*(F.col(c).cast("double").alias(c) if c in _DECIMALS else F.col(c) for c in stored.columns))


register("drop_create_sink", q(("ml_features",), "SELECT ticker, date, " + ", ".join(
    f"CAST(CAST({c} AS {t}) AS DOUBLE) AS {c}" for c, t in _DECIMALS.items())
    + ", CAST(regime AS SMALLINT) AS regime FROM ml_features", tuple(_DECIMALS)))(_drop_create)


def _materialize(m):
    r = m.returns
    return sinks.materialize_views({
        "rolling_volatility": m.volatility, "rolling_sharpe": m.sharpe,
        "drawdown_daily": m.drawdown, "correlation_matrix": m.correlation(),
    }, shared=r)


register("materialize_views", q(
    ("rolling_volatility", "rolling_sharpe", "drawdown_daily", "correlation_matrix"), " UNION ALL ".join(
        f"SELECT '{v}' AS \"view\", count(*) AS n_rows FROM {v}"
        for v in ("rolling_volatility", "rolling_sharpe", "drawdown_daily", "correlation_matrix"))))(_materialize)



def _incremental(view: str):
    """The stored view after a refresh from the bars before the last day to all bars."""
    def run(m):
        root = f"{checkpoint_dir(m.spark).rstrip('/')}/incremental-{uuid.uuid4().hex[:12]}"
        views = {view: incremental.VIEWS[view]}
        before = m.prices.filter(F.col("date") < m.prices.select(F.max("date")).scalar())
        incremental.write_views(before, root, views)
        incremental.refresh_views(before, m.prices, root, views)
        return incremental.read_view(m.spark, view, root)
    return run


_VIEW_FLOATS = {"rolling_volatility": ("adj_close", "simple_return", "log_return", "vol_20d", "vol_60d"),
                "rolling_sharpe": ("log_return", "mean_excess_60d", "std_60d", "sharpe_60d"),
                "drawdown_daily": ("adj_close", "running_max", "drawdown")}
for _view, _floats in _VIEW_FLOATS.items():
    register(f"incremental_{_view}", q((_view,), f"SELECT * FROM {_view}", _floats))(_incremental(_view))


def _from_states(m):
    """The correlation matrix from states stored before the last day and refreshed with it."""
    root = f"{checkpoint_dir(m.spark).rstrip('/')}/states-{uuid.uuid4().hex[:12]}"
    before = m.prices.filter(F.col("date") < m.prices.select(F.max("date")).scalar())
    comoments.write_states(before, root, m.stocks.count())
    comoments.refresh_states(before, m.prices, root)
    return comoments.correlation_from_states(m.spark, m.as_of, min_overlap=adapters.MIN_OVERLAP, root=root)


register("correlation_from_states", q(("correlation_matrix",), "SELECT * FROM correlation_matrix", ("correlation",)))(
    _from_states)


def _spoiled(m):
    """The bars with known faults: on some days of the month a null price, a crossed range, a price of 0."""
    day = F.dayofmonth("date")
    return (m.prices.withColumn("close", F.when(day != 13, F.col("close")))
            .withColumn("high", F.when(day == 14, F.col("low") - 1).otherwise(F.col("high")))
            .withColumn("open", F.when(day == 15, 0.0).otherwise(F.col("open")))
            .withColumn("volume", F.when(day == 16, -F.col("volume")).otherwise(F.col("volume"))))


_SPOILED_SQL = """
spoiled AS (
  SELECT ticker, date, CASE WHEN day(date) = 15 THEN 0.0 ELSE open END AS open,
         CASE WHEN day(date) = 14 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN day(date) <> 13 THEN close END AS close, adj_close,
         CASE WHEN day(date) = 16 THEN -volume ELSE volume END AS volume FROM prices_daily),
marked AS (
  SELECT *, CASE WHEN close IS NULL THEN 'null_price' WHEN least(open, high, low, close, adj_close) <= 0 THEN 'nonpositive_price'
                 WHEN high < low THEN 'high_below_low' WHEN close > high OR close < low THEN 'close_outside_range'
                 WHEN volume < 0 THEN 'negative_volume' END AS rule_id
  FROM spoiled)"""


def _checked(m, read):
    root = f"{checkpoint_dir(m.spark).rstrip('/')}/checked-{uuid.uuid4().hex[:12]}"
    _, metrics = checked.checked_refresh(_spoiled(m), "prices_daily", checked.bar_rules(), root)
    return read(m.spark, root, metrics)


register("checked_metrics", q(("prices_daily",), f"""
WITH {_SPOILED_SQL.strip()}
SELECT metric, value FROM (
  SELECT 'n_rows' AS metric, CAST(count(*) AS VARCHAR) AS value FROM marked
  UNION ALL SELECT 'n_good', CAST(count(*) FILTER (rule_id IS NULL) AS VARCHAR) FROM marked
  {" ".join(f"UNION ALL SELECT 'rule_{r}', CAST(count(*) FILTER (rule_id = '{r}') AS VARCHAR) FROM marked" for r in (
      "null_key", "null_price", "nonpositive_price", "high_below_low", "close_outside_range", "negative_volume"))}
  {" ".join(f"UNION ALL SELECT 'null_{c}', CAST(count(*) FILTER ({c} IS NULL) AS VARCHAR) FROM marked" for c in (
      "ticker", "date", "open", "high", "low", "close", "adj_close", "volume"))}
  UNION ALL SELECT 'first_date', CAST(min(date) AS VARCHAR) FROM marked
  UNION ALL SELECT 'last_date', CAST(max(date) AS VARCHAR) FROM marked)"""))(
    lambda m: _checked(m, lambda spark, root, metrics: checked.metrics_frame(spark, metrics)))
register("quarantine", q(("prices_daily",), f"""
WITH {_SPOILED_SQL.strip()}
SELECT * FROM marked WHERE rule_id IS NOT NULL""", PRICE_FLOATS))(
    lambda m: _checked(m, lambda spark, root, metrics: checked.read_quarantine(spark, "prices_daily", root)))

register("query_by_name", q(("stocks", "prices_daily"), f"""
SELECT * FROM (
  SELECT s.ticker, s.company_name, s.sector, round((l.price_now - sp.price_then) / sp.price_then * 100, 2) AS return_pct
  FROM stocks s
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_then FROM prices_daily
        WHERE date <= {AS_OF} - INTERVAL 180 DAY ORDER BY ticker, date DESC) sp ON sp.ticker = s.ticker
  JOIN (SELECT DISTINCT ON (ticker) ticker, adj_close AS price_now FROM prices_daily
        WHERE date <= {AS_OF} ORDER BY ticker, date DESC) l ON l.ticker = s.ticker)
ORDER BY return_pct ASC NULLS LAST, ticker LIMIT 3""", ("return_pct",)))(
    lambda m: N.query_by_name(m, "top_losers", days_back=180, limit_n=3))

# ---- L1-L11 --------------------------------------------------------------------------

_FEATS = ", ".join(FEATURE_COLS)
register("load_features", q(("ml_features",), f"""
SELECT ticker, date, {_FEATS}, abs_return_next, regime FROM ml_features WHERE regime IS NOT NULL""",
    tuple(FEATURE_COLS) + ("abs_return_next",)))(lambda m: ml.load_features(m.features))


def _split_sql(train_op: str) -> str:
    return f"""
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d)
SELECT CASE WHEN date {train_op} c.cut THEN 'train' WHEN date > c.cut THEN 'test' ELSE 'excluded' END AS split,
       count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date
FROM d, c GROUP BY 1"""


register("time_split", q(("ml_features",), _split_sql("<")))(
    lambda m: ml.split_summary(ml.load_features(m.features)))
register("time_split_inclusive", q(("ml_features",), _split_sql("<=")))(
    lambda m: ml.split_summary(ml.load_features(m.features), inclusive_train=True))


def _scale_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURE_COLS)
    z = ", ".join(f"({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END) AS {c}" for c in FEATURE_COLS)
    return f"""
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d),
st AS (SELECT {stats} FROM d, c WHERE d.date < c.cut)
SELECT ticker, date, abs_return_next, CAST(regime AS INTEGER) AS regime, {z}
FROM d, c, st WHERE d.date > c.cut"""


def _standard_scale(m):
    train, test = ml.time_split(ml.load_features(m.features))
    return ml.standard_scale(train, test)


register("standard_scale", q(("ml_features",), _scale_sql(), tuple(FEATURE_COLS) + ("abs_return_next",)))(
    _standard_scale)

register("walk_forward_cv", q(("ml_features",), """
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d),
t AS (SELECT d.*, row_number() OVER (ORDER BY date, ticker) - 1 AS pos FROM d, c WHERE d.date < c.cut),
n AS (SELECT count(*) AS n, count(*) // 4 AS size FROM t),
f AS (SELECT CAST(k AS INTEGER) AS fold, n.n - (4 - k) * n.size AS train_size, n.size AS test_size
      FROM n, (VALUES (1), (2), (3)) AS v(k))
SELECT f.fold, CAST(f.train_size AS BIGINT) AS train_size, CAST(f.test_size AS BIGINT) AS test_size,
       t.date AS test_start_date,
       CAST(f.train_size - (SELECT count(*) FROM t t2 WHERE t2.date < t.date) AS BIGINT) AS rows_into_date
FROM f JOIN t ON t.pos = f.train_size"""))(
    lambda m: ml.fold_bounds(ml.time_split(ml.load_features(m.features))[0]))

_FOLDS_SQL = """
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d),
t AS (SELECT d.*, row_number() OVER (ORDER BY date, ticker) - 1 AS pos FROM d, c WHERE d.date < c.cut),
n AS (SELECT count(*) AS n, count(*) // 4 AS size FROM t),
f AS (SELECT CAST(k AS INTEGER) AS fold, n.n - (4 - k) * n.size AS train_size, n.size AS test_size
      FROM n, (VALUES (1), (2), (3)) AS v(k))"""


def _training_rows(m):
    return ml.time_split(ml.load_features(m.features))[0]


register("fold_statistics", q(("ml_features",), _FOLDS_SQL + " UNION ALL ".join(f"""
SELECT f.fold, '{c}' AS feature, count({c}) AS n_train, avg({c}) AS mean, stddev_pop({c}) AS std,
       min({c}) AS low, max({c}) AS high
FROM f JOIN t ON t.pos < f.train_size GROUP BY f.fold""" for c in FEATURE_COLS), ("mean", "std", "low", "high")))(
    lambda m: ml.fold_statistics(ml.fold_states(_training_rows(m))))
register("walk_forward_scaled", q(("ml_features",), _FOLDS_SQL + f""",
st AS (SELECT f.fold, {", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in FEATURE_COLS)}
       FROM f JOIN t ON t.pos < f.train_size GROUP BY f.fold)
SELECT f.fold, ticker, date, abs_return_next, CAST(regime AS INTEGER) AS regime,
       {", ".join(f"({c} - m_{c}) / (CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END) AS {c}" for c in FEATURE_COLS)}
FROM f JOIN st ON st.fold = f.fold JOIN t ON t.pos >= f.train_size AND t.pos < f.train_size + f.test_size""",
    tuple(FEATURE_COLS) + ("abs_return_next",)))(lambda m: ml.fold_scaled(_training_rows(m)))


_MODELS: dict[tuple, str] = {}   # (application, dataset, state of its files, kind) -> folder of the fitted model


def _trained(m, lr: bool = False):
    """(model, train, test); a model is fitted once per state of a dataset and read back afterwards."""
    train, test = ml.time_split(ml.load_features(m.features))
    if lr:
        train, test = ml.standard_scale(train, train), ml.standard_scale(train, test)
    key = (m.spark.sparkContext.applicationId, m.base, source_signature(m.spark, m.base, BAR_SOURCES)[0], lr)
    if key not in _MODELS:
        rows = ml.materialize(train)
        path = f"{checkpoint_dir(m.spark).rstrip('/')}/models/{'lr' if lr else 'trees'}-{uuid.uuid4().hex[:12]}"
        if lr:
            ml.logistic_baseline(rows).save(path)
        else:
            ml.tree_classifier(rows).save(m.spark, path)
        _MODELS[key] = path
    model = PipelineModel.load(_MODELS[key]) if lr else BoostedModel.load(m.spark, _MODELS[key])
    return model, train, test


def _acc_frame(m, name, model, test):
    return m.spark.createDataFrame([(name, float(ml.accuracy(model, test)), test.count())],
                                   "model string, accuracy double, n_test bigint")


register("logistic_baseline", None)(lambda m: _acc_frame(m, "logistic_regression", *_trained(m, lr=True)[::2]))
register("tree_classifier", None)(lambda m: _acc_frame(m, "boosted_trees", *_trained(m)[::2]))
register("generate_predictions", None)(lambda m: ml.generate_predictions(*_trained(m)[::2]))
register("generated_rows", q(("ml_features",), """
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d)
SELECT ticker, date, regime AS actual_regime, true AS probabilities_sum_to_1, true AS most_probable_predicted
FROM d, c WHERE d.date > c.cut"""))(
    lambda m: ml.prediction_checks(ml.generate_predictions(*_trained(m)[::2])))
register("feature_importance", None)(lambda m: ml.feature_importance(m.spark, _trained(m)[0]))
register("model_persist", q(("ml_features",), """
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
c AS (SELECT max(date) - INTERVAL 360 DAY AS cut FROM d)
SELECT count(*) AS n_rows, count(*) AS n_equal FROM d, c WHERE d.date > c.cut"""))(
    lambda m: ml.model_persist(*_trained(m)[::2]).drop("path"))


def _sweep(m):
    train, test = ml.time_split(ml.load_features(m.features), inclusive_train=True)
    return ml.hyperparam_sweep(train, test)


register("hyperparam_sweep", None)(_sweep)


_SCORES: dict[tuple, list] = {}   # as _MODELS -> one row a fold


def _walk_forward_scores(m):
    key = (m.spark.sparkContext.applicationId, m.base, source_signature(m.spark, m.base, BAR_SOURCES)[0])
    train, _ = ml.time_split(ml.load_features(m.features))
    if key not in _SCORES:
        scores = ml.walk_forward_scores(train)
        _SCORES[key] = scores.schema, scores.collect()
    schema, rows = _SCORES[key]
    return m.spark.createDataFrame(rows, schema)


register("walk_forward_scores", None)(_walk_forward_scores)
register("walk_forward_sizes", q(("ml_features",), """
WITH d AS (SELECT * FROM ml_features WHERE regime IS NOT NULL),
n AS (SELECT count(*) AS n, count(*) // 4 AS size FROM d WHERE date < (SELECT max(date) - INTERVAL 360 DAY FROM d))
SELECT CAST(k AS INTEGER) AS fold, CAST(n - (4 - k) * size AS BIGINT) AS train_size, CAST(size AS BIGINT) AS test_size, true AS accuracy_is_a_share
FROM n, (VALUES (1), (2), (3)) AS v(k)"""))(
    lambda m: _walk_forward_scores(m).select("fold", "train_size", "test_size",
                                             F.col("accuracy").between(0, 1).alias("accuracy_is_a_share")))


def _baseline(m):
    lr_model, _, lr_test = _trained(m, lr=True)
    model, _, test = _trained(m)
    return ml.baseline_compare(ml.accuracy(lr_model, lr_test), ml.accuracy(model, test), m.spark)


register("baseline_compare", None)(_baseline)

# ---- R1 --------------------------------------------------------------------------------


def _refresh(m):
    root = f"{checkpoint_dir(m.spark).rstrip('/')}/refresh-{uuid.uuid4().hex[:12]}"
    job.save_model(m.spark, _trained(m)[0], root)
    return job.refresh_job(m.spark, lambda: adapters.raw_vendor_bars(m.spark, m.base),
                           lambda: adapters.raw_vendor_index(m.spark, m.base), m.stocks, _index_range(m), root) \
        .select("step", "status")


register("refresh_job", """
SELECT * FROM (VALUES ('1. ingest prices', 'ok'), ('2. ingest index', 'ok'), ('3. refresh views', 'ok'), ('4. features', 'ok'),
                      ('5. predictions', 'ok'), ('6. prediction views', 'ok')) AS t(step, status)""")(_refresh)
