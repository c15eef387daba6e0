"""Queries over the given tables, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions import text as T
from fathom.functions import words
from fathom.operators import articles as A
from fathom.operators import backtest as B
from fathom.operators import daily as D
from fathom.operators import indicators as I
from fathom.operators import keywords as K
from fathom.operators import lexicon as L
from fathom.operators import matrix as M
from fathom.operators import paragraphs as G
from fathom.operators import regimes as R
from fathom.operators import series as S
from fathom.operators import walk as V
from fathom.plans import fixtures as X
from fathom.plans.fixtures import WEEK, with_tables
from fathom.sources import pages as P
from fathom.sources.scratch import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(tables: str = "", sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_tables(tables, sql) if tables else sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*((F.round(c, places) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0::DOUBLE AS {n}" for n in names)


TOPICS = {"first": ["the ", "and"], "second": ["der", "die "], "third": ["que", "ion"]}
TOPIC_LIST = "list_filter([CASE WHEN contains(lower({0}), 'the ') OR contains(lower({0}), 'and') THEN 'first' END, CASE WHEN contains(lower({0}), 'der') OR contains(lower({0}), 'die ') THEN 'second' END, CASE WHEN contains(lower({0}), 'que') OR contains(lower({0}), 'ion') THEN 'third' END], lambda x: x IS NOT NULL)"
POLARITY = {"the": 1.0, "and": -1.0, "der": 0.5, "que": -0.5}
LEX = "CASE word WHEN 'the' THEN 1.0 WHEN 'and' THEN -1.0 WHEN 'der' THEN 0.5 WHEN 'que' THEN -0.5 ELSE 0.0 END::DOUBLE"


def _returns(spark: SparkSession, d: str) -> DataFrame:
    return X.price(spark, d).withColumn("ret", S.change(F.col("close"), S.over()))


def _vol(spark: SparkSession, d: str) -> DataFrame:
    return S.volatility(_returns(spark, d), "ret")


def _bt(spark: SparkSession, d: str) -> DataFrame:
    rows = _returns(spark, d).select("date", F.col("ret").alias("y_true"), F.lag("ret").over(S.over()).alias("y_pred"), F.when(F.month("date") % 2 == 0, "macro").otherwise("demand").alias("regime"))
    return rows.where("y_pred is not null")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    side = F.when(F.col("doc_id") % 3 == 0, "rise").when(F.col("doc_id") % 3 == 1, "fall")
    return X.table(spark, d, "documents").select("doc_id", "text", side.alias("price_direction"))


def _drivers(spark: SparkSession, d: str) -> DataFrame:
    """Weekly changes, the surprise of a change, the level that is kept, and momentum."""
    w = S.over()
    rows = written(X.macro(spark, d), "macro").select("date", (F.col("stocks") - F.lag("stocks").over(w)).alias("stocks_chg"), "rate", (F.col("rate") - F.lag("rate").over(w)).alias("rate_chg"), S.change(F.col("stocks"), w, 4).alias("stocks_mom"))
    return rows.select("date", "stocks_chg", S.seasonal_surprise(rows, "stocks_chg").alias("surprise"), "rate", "rate_chg", "stocks_mom")


X.SQL["drivers"] = """SELECT *, stocks_chg - CASE WHEN count(stocks_chg) OVER s >= 4 THEN avg(stocks_chg) OVER s END AS surprise FROM (SELECT date, stocks - lag(stocks) OVER w AS stocks_chg, rate, rate - lag(rate) OVER w AS rate_chg, (stocks / lag(stocks, 4) OVER w - 1) * 100 AS stocks_mom FROM macro WINDOW w AS (ORDER BY date))
WINDOW s AS (PARTITION BY weekofyear(date) ORDER BY date ROWS UNBOUNDED PRECEDING)"""


DAILY = "SELECT date, count(id) AS headline_count, avg(sentiment) AS sentiment_mean, stddev_samp(sentiment) AS sentiment_std, min(sentiment) AS sentiment_min, max(sentiment) AS sentiment_max, avg(positive) AS positive_mean, avg(negative) AS negative_mean, avg(neutral) AS neutral_mean, avg(CASE WHEN negative > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE) AS negative_ratio, avg(CASE WHEN positive > 0.5 THEN 1.0 ELSE 0.0 END::DOUBLE) AS positive_ratio, ln(1 + count(id)) AS log_headline_count FROM scored GROUP BY date"
DAILY_DOUBLES = ("sentiment_mean", "sentiment_std", "sentiment_min", "sentiment_max", "positive_mean", "negative_mean", "neutral_mean", "negative_ratio", "positive_ratio", "log_headline_count")


@query("scored", f"SELECT date, headline_count, {r(*DAILY_DOUBLES)} FROM ({DAILY})")
def A1_daily_sentiment(spark, d):
    return rounded(D.daily_sentiment(X.scored(spark, d)))


_FLAGS = "round(avg(sentiment), 6) + 0.0::DOUBLE AS {0}_sentiment, round(coalesce(stddev_samp(sentiment), 0), 6) AS {0}_sentiment_std, 1 AS {0}_event_day, 1 AS {0}_event_window"


@query("news", f"SELECT date, count(id) AS opec_article_count, {_FLAGS.format('opec')}, max(contains(lower(title), 'deal')::INT) AS opec_decision_day FROM news WHERE tier = 'purchase' GROUP BY date")
def A2_decision_flags(spark, d):
    return rounded(D.event_flags(X.news(spark, d).where("tier = 'purchase'"), "opec", words.DECISION_TERMS))


@query("news", f"SELECT date, count(id) AS disruption_intensity, {_FLAGS.format('disruption')} FROM news WHERE tier = 'error' GROUP BY date")
def A3_disruption_flags(spark, d):
    return rounded(D.event_flags(X.news(spark, d).where("tier = 'error'"), "disruption", before=1, after=3, count="intensity"))


def _weekly(spark, d):
    daily = D.daily_sentiment(X.scored(spark, d))
    return S.weekly(daily, {"headline_count": F.sum("headline_count"), "sentiment_mean": F.avg("sentiment_mean"), "sentiment_std": F.avg("sentiment_std"), "sentiment_min": F.min("sentiment_min"), "log_headline_count": F.sum("log_headline_count")}, ("headline_count", "log_headline_count"))


WEEKLY = f"SELECT c.date, coalesce(headline_count, 0)::BIGINT AS headline_count, sentiment_mean, sentiment_std, sentiment_min, coalesce(log_headline_count, 0) AS log_headline_count FROM (SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAYS))::DATE AS date FROM (SELECT {WEEK.format('date')} AS w FROM daily)) c LEFT JOIN (SELECT {WEEK.format('date')} AS date, sum(headline_count) AS headline_count, avg(sentiment_mean) AS sentiment_mean, avg(sentiment_std) AS sentiment_std, min(sentiment_min) AS sentiment_min, sum(log_headline_count) AS log_headline_count FROM daily GROUP BY 1) s USING (date)"
X.SQL["daily"], X.SQL["weekly"] = DAILY, WEEKLY


@query("scored daily weekly", f"SELECT date, headline_count, {r('sentiment_mean', 'sentiment_std', 'sentiment_min', 'log_headline_count')} FROM weekly")
def A4_weekly_calendar(spark, d):
    return rounded(_weekly(spark, d))


def _topic_articles(spark, d):
    rows = X.articles(spark, d)
    return rows.select("date", (F.length("body") % 7 / 7.0).alias("sentiment"), T.topics(F.col("headline"), TOPICS).alias("topics"))


IND = f"""t AS (SELECT {WEEK.format('date')} AS week, (length(body) % 7) / 7.0::DOUBLE AS sentiment, {TOPIC_LIST.format('headline')} AS topics FROM articles),
tot AS (SELECT week, count(*) AS total FROM t GROUP BY week),
ex AS (SELECT week, sentiment, len(topics) AS k, unnest(topics) AS category FROM t),
su AS (SELECT week, category, sum(1.0::DOUBLE / k) AS w, avg(sentiment) AS mean, var_samp(sentiment) AS var FROM ex GROUP BY week, category),
full_ AS (SELECT week, category, coalesce(w / total, 0) AS intensity, coalesce(mean, 0) AS sentiment, coalesce(var, 0) AS var, dense_rank() OVER (ORDER BY week) AS n FROM tot CROSS JOIN (SELECT unnest(CATEGORIES) AS category) LEFT JOIN su USING (week, category)),
ind AS (SELECT week, category, intensity, sentiment, intensity * var AS variance, (SELECT sum(o.sentiment * exp(-(f.n - o.n) / 4.0::DOUBLE)) FROM full_ o WHERE o.category = f.category AND o.n <= f.n) AS decay FROM full_ f)"""
IND, LM_IND = IND.replace("CATEGORIES", str(list(TOPICS))), IND.partition("tot AS")[1] + IND.partition("tot AS")[2].replace("CATEGORIES", str(list(words.TOPIC_KEYWORDS)))


@query(sql=with_tables("articles", f", {IND} SELECT week, category, {r('intensity', 'sentiment', 'variance', 'decay')} FROM ind").replace(") , t AS", "), t AS"))
def A5_A7_W10_weekly_indicators(spark, d):
    return rounded(I.weekly_indicators(_topic_articles(spark, d), list(TOPICS)))


_WIDE = [f"{c}_{k}" for c in TOPICS for k in ("intensity", "sentiment", "variance", "decay")]
_WIDE_SQL = ", ".join(f"round(max({n.split('_')[1]}) FILTER (category = '{n.split('_')[0]}'), 6) + 0.0::DOUBLE AS {n}" for n in _WIDE)


@query(sql=with_tables("articles", f", {IND} SELECT week, {_WIDE_SQL} FROM ind GROUP BY week").replace(") , t AS", "), t AS"))
def A8_wide_indicators(spark, d):
    return rounded(I.wide(I.weekly_indicators(_topic_articles(spark, d), list(TOPICS)), list(TOPICS)))


@query("tokens counts", "SELECT * FROM counts")
def A9_class_counts(spark, d):
    return L.class_counts(_labelled(spark, d), stop=())


@query("tokens", "SELECT word AS token, count(DISTINCT doc_id) AS n_docs FROM tokens GROUP BY word")
def A11_document_frequency(spark, d):
    return K.token_index(X.table(spark, d, "documents")).groupBy("token").agg(F.count("*").alias("n_docs"))


@query("labelled", "SELECT price_direction, count(*) AS n FROM labelled GROUP BY 1")
def A13_value_counts(spark, d):
    return _labelled(spark, d).groupBy("price_direction").agg(F.count("*").alias("n"))


@query("price ret bt bt2 out", f"SELECT regime, n, {r('accuracy', 'mean_strategy_ret', 'mean_bh_ret')}, accuracy < 0.5 AS below_50pct_acc FROM (SELECT regime, count(*) AS n, avg(hit) AS accuracy, avg(strategy_ret) AS mean_strategy_ret, avg(bh_ret) AS mean_bh_ret FROM out GROUP BY regime)")
def A15_A18_by_regime(spark, d):
    return rounded(B.weak_regimes(B.outcomes(_bt(spark, d))))


@query("price ret bt bt2 out cum", f"SELECT {r('accuracy', 'mean_strategy_ret', 'mean_bh_ret', 'cum_strategy_ret', 'cum_bh_ret')} FROM (SELECT avg(hit) AS accuracy, avg(strategy_ret) AS mean_strategy_ret, avg(bh_ret) AS mean_bh_ret, max_by(cum_strategy_ret, date) AS cum_strategy_ret, max_by(cum_bh_ret, date) AS cum_bh_ret FROM cum)")
def A16_overall(spark, d):
    return rounded(B.overall(B.outcomes(_bt(spark, d))))


@query("price ret bt bt2", "SELECT fold, regime, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY fold), 6) AS share FROM (SELECT *, ((row_number() OVER (ORDER BY date) - 1) // 52 + 1)::BIGINT AS fold FROM bt2) GROUP BY fold, regime")
def A17_regime_shares(spark, d):
    return rounded(B.regime_shares(_bt(spark, d)))


_ERR = "count(*) AS n, round(avg(abs(y_pred - y_true)), 6) AS mae, round(sqrt(avg((y_pred - y_true) ** 2)), 6) AS rmse, round(avg((sign(y_pred) = sign(y_true))::INT), 6) AS dir_acc, round(avg(abs(y_pred)), 6) AS mean_abs_pred, round(stddev_pop(y_pred) / stddev_pop(y_true), 6) AS var_ratio"


@query("price ret bt bt2", f"SELECT {_ERR} FROM bt2")
def A19_errors(spark, d):
    return rounded(B.errors(_bt(spark, d)))


@query("price ret bt bt2", f"SELECT regime, {_ERR} FROM bt2 GROUP BY regime")
def A21_errors_by_regime(spark, d):
    return rounded(B.errors(_bt(spark, d), "regime"))


@query("price ret bt bt2", "SELECT t AS threshold, count(*) AS n, round(avg((sign(y_pred) = sign(y_true))::INT), 6) AS accuracy, count(*) FILTER (y_pred > 0) AS n_long, count(*) FILTER (y_pred < 0) AS n_short FROM bt2 JOIN (SELECT unnest([0, 0.5, 1, 1.5, 2]::DOUBLE[]) AS t) ON abs(y_pred) >= t GROUP BY t HAVING count(*) >= 5")
def A20_ladder(spark, d):
    return rounded(B.ladder(_bt(spark, d)))


@query("articles", "SELECT count(*) FILTER (contains(lower(body), 'the ') OR contains(lower(body), 'and')) AS first, count(*) FILTER (contains(lower(body), 'der') OR contains(lower(body), 'die ')) AS second FROM articles")
def A22_coverage(spark, d):
    low = F.lower("body")
    return X.articles(spark, d).agg(*(F.sum(T.any_term(low, TOPICS[k]).cast("long")).alias(k) for k in ("first", "second")))


@query("price", "SELECT round(median(close), 6) AS med, round(greatest(quantile_cont(close, 0.75) - quantile_cont(close, 0.25), 1e-6), 6) AS iqr FROM price")
def A23_robust_stats(spark, d):
    return rounded(R.robust_stats(X.price(spark, d), ["close"]).select(F.col("close")[0].alias("med"), F.col("close")[1].alias("iqr")))


@query("price", "SELECT date, round(lag(close) OVER (ORDER BY date), 6) AS close_lag1 FROM price")
def W1_lag(spark, d):
    return rounded(S.lagged(X.price(spark, d), ["close"]))


@query("price", "SELECT date, round((close / lag(close) OVER w - 1) * 100, 6) AS ret, round((close / lag(close, 4) OVER w - 1) * 100, 6) AS mom, round(close - lag(close) OVER w, 6) + 0.0::DOUBLE AS diff FROM price WINDOW w AS (ORDER BY date)")
def W2_W3_changes(spark, d):
    w = S.over()
    return rounded(X.price(spark, d).select("date", S.change(F.col("close"), w).alias("ret"), S.change(F.col("close"), w, 4).alias("mom"), (F.col("close") - F.lag("close").over(w)).alias("diff")))


@query("price ret vol", "SELECT date, round(realized_vol, 6) AS realized_vol FROM vol")
def W4_rolling_volatility(spark, d):
    return rounded(_vol(spark, d).select("date", "realized_vol"))


@query("price ret vol", "SELECT date, round(first_value(v IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS realized_vol FROM (SELECT date, CASE WHEN realized_vol IS NOT NULL THEN greatest(realized_vol, 0.5) END AS v FROM vol)")
def W5_clipped_volatility(spark, d):
    return rounded(S.clipped_volatility(_returns(spark, d), "ret").select("date", "realized_vol"))


@query("price ret", "SELECT date, round(coalesce(CASE WHEN count(ret) OVER w >= 8 THEN (ret - avg(ret) OVER w) / greatest(stddev_samp(ret) OVER w, 1e-6) END, 0), 6) + 0.0::DOUBLE AS z FROM ret WINDOW w AS (ORDER BY date ROWS BETWEEN 51 PRECEDING AND CURRENT ROW)")
def W6_zscore(spark, d):
    return rounded(_returns(spark, d).select("date", S.zscore("ret", S.over()).alias("z")))


@query("price ret bt bt2 out", "SELECT date, round(CASE WHEN count(hit) OVER w >= 13 THEN avg(hit) OVER w END, 6) AS acc FROM out WINDOW w AS (ORDER BY date ROWS BETWEEN 25 PRECEDING AND CURRENT ROW)")
def W7_rolling_accuracy(spark, d):
    return rounded(B.outcomes(_bt(spark, d)).select("date", S.rolling(F.avg, "hit", S.over(), 26, 13).alias("acc")))


@query("macro drivers", f"SELECT date, {r('stocks_chg', 'surprise')} FROM drivers")
def W8_E1_seasonal_surprise(spark, d):
    return rounded(_drivers(spark, d).select("date", "stocks_chg", "surprise"))


@query("price ret", "SELECT date, round(y, 6) + 0.0::DOUBLE AS decayed FROM (SELECT a.date, sum(coalesce(b.ret, 0) * exp(-(a.n - b.n) / 4.0::DOUBLE)) AS y FROM (SELECT *, row_number() OVER (ORDER BY date) AS n FROM ret) a JOIN (SELECT *, row_number() OVER (ORDER BY date) AS n FROM ret) b ON b.n <= a.n GROUP BY a.date)")
def W9_decay(spark, d):
    return rounded(S.decayed(_returns(spark, d), {"decayed": "ret"}).select("date", "decayed"))


REGIME = "SELECT *, CASE WHEN realized_vol <= q[1] THEN 0 WHEN realized_vol <= q[2] THEN 1 WHEN realized_vol IS NOT NULL THEN 2 END AS vol_regime FROM vol CROSS JOIN (SELECT quantile_cont(realized_vol, [0.33, 0.66]) AS q FROM vol)"
X.SQL["regime"] = REGIME


@query("price ret vol regime", "SELECT date, round(realized_vol, 6) AS realized_vol, vol_regime, coalesce((vol_regime = 0)::INT, 0) AS vol_regime_low, coalesce((vol_regime = 1)::INT, 0) AS vol_regime_mid, coalesce((vol_regime = 2)::INT, 0) AS vol_regime_high FROM regime")
def R1_W11_volatility_regime(spark, d):
    return rounded(R.volatility_regime(_vol(spark, d)).drop("close", "ret"))


@query("price ret vol regime", "SELECT date, coalesce(vol_regime <> lag(vol_regime) OVER (ORDER BY date), true)::INT AS switched FROM regime WHERE vol_regime IS NOT NULL")
def W12_regime_switch(spark, d):
    rows = R.volatility_regime(_vol(spark, d)).where("vol_regime is not null").select("date", F.col("vol_regime").cast("string").alias("v"))
    return rows.select("date", R.switched("v").alias("switched"))


@query("price ret bt bt2 out cum", "SELECT date, regime, pred_dir, true_dir, hit, " + r("y_true", "y_pred", "strategy_ret", "bh_ret", "cum_strategy_ret", "cum_bh_ret") + " FROM cum")
def B12_W13_outcomes(spark, d):
    return rounded(B.outcomes(_bt(spark, d)))


@query("price ret", "SELECT * FROM (SELECT date, round(ret, 6) AS target, " + ", ".join(f"round(lag(close, {k}) OVER (ORDER BY date), 6) AS past{k}" for k in (4, 3, 2, 1)) + " FROM ret) WHERE past4 IS NOT NULL")
def W14_sequences(spark, d):
    rows = S.sequences(_returns(spark, d), ["close"])
    return rounded(rows.select("date", F.col("ret").alias("target"), *(F.col("past")[4 - k]["close"].alias(f"past{k}") for k in (4, 3, 2, 1))))


@query("price", "SELECT date, round(v / avg(v) OVER (), 6) AS weight FROM (SELECT date, pow(0.995, count(*) OVER () - row_number() OVER (ORDER BY date)) AS v FROM price)")
def W15_age_weights(spark, d):
    return rounded(X.price(spark, d).select("date", S.age_weights(Window.partitionBy(F.lit(0))).alias("weight")))


@query("price ret vol", "SELECT date, round(greatest(least(ret / realized_vol, 10), -10), 6) + 0.0::DOUBLE AS target FROM vol WHERE realized_vol > 0")
def W17_normalised_target(spark, d):
    return rounded(_vol(spark, d).where("realized_vol > 0").select("date", F.greatest(F.least(F.col("ret") / F.col("realized_vol"), F.lit(10.0)), F.lit(-10.0)).alias("target")))


_FOLDS = "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY fold) AS c FROM (SELECT date, rn, ((rn - 1 - {0}) // {1})::BIGINT AS fold FROM (SELECT date, row_number() OVER (ORDER BY date) AS rn FROM price) WHERE rn > {0})) WHERE c >= {2}"


@query("price", f"SELECT date, rn, fold FROM ({_FOLDS.format(104, 13, 5)})")
def W18_folds(spark, d):
    return S.folds(X.price(spark, d).select("date"), 104, 13, 5)


@query("price", f"SELECT date, rn, fold FROM ({_FOLDS.format(156, 1, 1)})")
def W19_weekly_folds(spark, d):
    return S.folds(X.price(spark, d).select("date"), 156, 1)


@query("price", "SELECT n, e FROM (SELECT count(*) AS n FROM price), LATERAL (SELECT DISTINCT CAST(floor(104 + (n - 26 - 104) * k / 2.0) AS BIGINT) AS e FROM range(3) t(k))")
def W20_inner_splits(spark, d):
    return S.inner_split_rows(X.price(spark, d).agg(F.count("*").alias("n")))


@query("scored", "SELECT date FROM (SELECT DISTINCT date FROM scored) s WHERE EXISTS (SELECT 1 FROM scored e WHERE e.tier = 'signup' AND e.sentiment > 0.94 AND s.date BETWEEN e.date - 2 AND e.date + 2)")
def J7_event_window(spark, d):
    rows = X.scored(spark, d)
    return S.near_events(rows.select("date").distinct(), rows.where("tier = 'signup' and sentiment > 0.94").select("date"), 2, 2)


@query("price macro", "SELECT coalesce(p.date, m.date) AS date, round(close, 6) AS close, round(stocks, 6) AS stocks FROM price p FULL JOIN macro m ON p.date = m.date")
def J4_outer_merge(spark, d):
    return rounded(X.price(spark, d).join(X.macro(spark, d), "date", "full").select("date", "close", "stocks"))


@query("price macro", "SELECT p.date, round(close, 6) AS close, round(coalesce(stocks, 0), 6) AS stocks, round(rate, 6) AS rate FROM price p LEFT JOIN macro m ON p.date = m.date")
def J1_J2_J5_P10_star_join(spark, d):
    return rounded(D.with_news(X.price(spark, d), X.macro(spark, d), zero=("stocks",)))


@query("price macro", "SELECT p.date, round(close, 6) AS close, round(coalesce(stocks, 0), 6) AS stocks_lag1, round(coalesce(rate, 0), 6) AS rate_lag1 FROM price p LEFT JOIN macro m ON p.date = m.date + 7")
def J6_lag_join(spark, d):
    return rounded(I.lag_join(X.price(spark, d), X.macro(spark, d).withColumnRenamed("date", "week")))


@query("macro drivers", f"SELECT date, {r('stocks_chg', 'surprise', 'rate', 'rate_chg', 'stocks_mom')} FROM drivers")
def E1_E2_macro_changes(spark, d):
    return rounded(_drivers(spark, d))


@query(sql="SELECT " + WEEK.format("ts::DATE") + " AS week, round(arg_max(value, (ts, event_id)), 6) AS value FROM events WHERE value IS NOT NULL GROUP BY 1")
def S16_last_of_week(spark, d):
    rows = X.table(spark, d, "events").where("value is not null")
    return rounded(rows.groupBy(S.friday(F.to_date("ts")).alias("week")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value")))


@query(sql="SELECT " + WEEK.format("ts::DATE") + " AS week, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY " + WEEK.format("ts::DATE") + " ORDER BY ts DESC, event_id DESC) = 1")
def W16_U4_keep_last(spark, d):
    rows = X.table(spark, d, "events").withColumn("week", S.friday(F.to_date("ts")))
    return rounded(S.keep_first(rows, ["week"], [F.desc("ts"), F.desc("event_id")]).select("week", "event_id", "value"))


@query(sql="SELECT start::DATE AS start, least(start::DATE + 30, DATE '2024-12-31') AS \"end\" FROM (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31', INTERVAL 31 DAYS)) AS start)")
def S4_scan_windows(spark, d):
    return A.scan_windows(spark, "2024-01-01", "2024-12-31")


@query("articles", "SELECT id, trim(headline) AS headline, date FROM articles WHERE trim(coalesce(headline, '')) <> ''")
def S12_P3_normalised(spark, d):
    return A.normalised(X.articles(spark, d).select("id", "headline", "date"), ("headline",))


@query(sql="SELECT ('0x' || substr(md5(url), 1, 15))::BIGINT AS id, url FROM pages")
def K5_F13_hashed_ids(spark, d):
    return X.table(spark, d, "pages").select(T.hashed_id(F.col("url")).alias("id"), "url")


@query("articles", "SELECT id, date, lang AS title FROM articles WHERE id % 2 = 0 UNION ALL SELECT id, date, NULL AS title FROM articles WHERE id % 3 = 0 AND id % 2 <> 0")
def U1_S11_union_keep_first(spark, d):
    rows = X.articles(spark, d)
    return A.merged(rows.where("id % 2 = 0").select("id", "date", F.col("lang").alias("title")), rows.where("id % 3 = 0").select("id", "date"))


@query("articles", "SELECT id, date, source FROM articles WHERE id % 2 = 0 UNION ALL SELECT id, date, 'new' FROM articles WHERE id % 2 <> 0 AND id % 5 = 0")
def K2_upsert(spark, d):
    rows = X.articles(spark, d).select("id", "date", "source")
    return A.upserted(rows.where("id % 2 = 0"), rows.where("id % 5 = 0").withColumn("source", F.lit("new")))


@query("articles", "SELECT id, date, CASE WHEN id % 2 = 0 THEN lang END AS title FROM articles")
def U1_S11_union_of_all(spark, d):
    rows = X.articles(spark, d)
    return A.merged(rows.where("id % 2 = 0").select("id", "date", F.col("lang").alias("title")), rows.select("id", "date"))


@query("articles", "SELECT id, date, CASE WHEN id % 2 = 0 THEN source ELSE 'new' END AS source FROM articles")
def K2_upsert_of_all(spark, d):
    rows = X.articles(spark, d).select("id", "date", "source")
    return A.upserted(rows.where("id % 2 = 0"), rows.withColumn("source", F.lit("new")))


@query(sql="SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def J12_K3_not_done(spark, d):
    rows = X.table(spark, d, "pages").select("page_id")
    return rows.join(rows.where("page_id % 3 = 0"), "page_id", "left_anti")


@query(sql=r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', '', 'g')) AS title, len(regexp_extract_all(html, '(?s)<p[^>]*>.*?</p>')) AS n_paragraphs FROM pages")
def S18_headlines(spark, d):
    return P.headline(X.table(spark, d, "pages"))


@query(sql=r"""SELECT page_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, title FROM (SELECT page_id, a, trim(regexp_replace(regexp_replace(a, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a [^>]*>.*?</a>')) AS a FROM pages)) WHERE length(title) >= 5""")
def S17_links(spark, d):
    return P.links(X.table(spark, d, "pages"), 5)


@query()
def S18_articles(spark, d):
    return P.articles(X.table(spark, d, "pages"))


@query("tokens", "SELECT d.doc_id, coalesce(n, 0) AS n_tokens FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id) USING (doc_id)")
def F1_tokens(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"), ())).cast("long").alias("n_tokens"))


@query("articles", r"SELECT id, (CASE WHEN contains(c, 'the') OR contains(c, 'der') THEN 3 ELSE 0 END + contains(c, 'ion')::INT + contains(c, 'ing')::INT - CASE WHEN contains(c, 'que') AND NOT contains(c, 'les') THEN 2 ELSE 0 END)::BIGINT AS score FROM (SELECT id, trim(regexp_replace(lower(headline), '\s+', ' ', 'g')) AS c FROM articles)")
def F2_F3_headline_score(spark, d):
    return X.articles(spark, d).select("id", T.headline_score(F.col("headline"), ["the", "der"], ["ion", "ing"], ["que"], ["les"]).alias("score"))


@query("articles", r"SELECT id, (contains(c, 'the') OR contains(c, 'der')) AND (contains(c, 'ion') OR contains(c, 'ing')) AND (3 + contains(c, 'ion')::INT + contains(c, 'ing')::INT) >= 4 AS relevant FROM (SELECT id, trim(regexp_replace(lower(headline), '\s+', ' ', 'g')) AS c FROM articles)")
def F4_relevant(spark, d):
    return X.articles(spark, d).select("id", T.relevant(F.col("headline"), 4, ["the", "der"], ["ion", "ing"], blocked=[], core=[]).alias("relevant"))


@query("articles", f"SELECT id, array_to_string({TOPIC_LIST.format('headline')}, ',') AS topics FROM articles")
def F5_F8_topics(spark, d):
    return X.articles(spark, d).select("id", F.array_join(T.topics(F.col("headline"), TOPICS), ",").alias("topics"))


@query("articles", "SELECT id, CASE WHEN o AND u AND NOT f THEN 'rise' WHEN o AND f AND NOT u THEN 'fall' END AS direction FROM (SELECT id, contains(lower(headline), 'er') AS o, list_has_any(regexp_split_to_array(lower(headline), '\\s+'), ['the', 'die']) AS u, list_has_any(regexp_split_to_array(lower(headline), '\\s+'), ['and', 'und']) AS f FROM articles)")
def F9_direction(spark, d):
    return X.articles(spark, d).select("id", T.direction(F.col("headline"), ["er"], ["the", "die"], ["and", "und"]).alias("direction"))


@query("tokens", f"SELECT doc_id, round(greatest(least(coalesce(s / n, 0), 1), -1), 6) + 0.0::DOUBLE AS lm_sentiment FROM documents LEFT JOIN (SELECT doc_id, sum({LEX}) AS s, count(*) AS n FROM tokens GROUP BY doc_id) USING (doc_id)")
def F10_lexicon_score(spark, d):
    return rounded(L.scored_by_map(X.table(spark, d, "documents").select("doc_id", "text"), POLARITY, stop=()).drop("text"))


@query()
def F11_M4_paragraphs(spark, d):
    return X.table(spark, d, "documents").select("doc_id", F.posexplode(T.paragraphs(F.col("text"))).alias("paragraph_idx", "paragraph_text")).withColumn("weak_labels", T.topics(F.col("paragraph_text"), TOPICS))


LEXICON = "SELECT word, polarity FROM base UNION ALL SELECT word, CASE WHEN n_rise > n_fall THEN 1 ELSE -1 END * round((q - 1) / (q + 1), 4) AS polarity FROM (SELECT *, greatest((n_rise + 0.5::DOUBLE) / (n_fall + 0.5::DOUBLE), (n_fall + 0.5::DOUBLE) / (n_rise + 0.5::DOUBLE)) AS q FROM counts) WHERE n_rise + n_fall >= 3 AND q >= 1.5 AND word NOT IN (SELECT word FROM base)"
X.SQL["base"] = "SELECT unnest(['the', 'and', 'der', 'que']) AS word, unnest([1.0, -1.0, 0.5, -0.5]::DOUBLE[]) AS polarity"
X.SQL["lexicon"] = LEXICON


def _lexicon(spark, d):
    base = spark.createDataFrame(sorted(POLARITY.items()), "word string, polarity double")
    return L.expanded_lexicon(base, written(L.class_counts(_labelled(spark, d), stop=()), "counts"))


@query("tokens counts base lexicon", "SELECT word, round(polarity, 4) AS polarity FROM lexicon")
def M2_lexicon(spark, d):
    return rounded(_lexicon(spark, d), 4)


@query("tokens counts base lexicon", "SELECT doc_id, round(greatest(least(coalesce(s / n, 0), 1), -1), 6) + 0.0::DOUBLE AS lm_sentiment FROM documents LEFT JOIN (SELECT doc_id, sum(coalesce(polarity, 0)::DECIMAL(18, 6))::DOUBLE AS s, count(*) AS n FROM tokens LEFT JOIN lexicon USING (word) GROUP BY doc_id) USING (doc_id)")
def M3_J9_article_scores(spark, d):
    return rounded(L.scored(X.table(spark, d, "documents"), _lexicon(spark, d), "doc_id", stop=()))


def _token_index(spark, d):
    """The index as a table: texts are read and cut into tokens once."""
    return written(K.token_index(X.table(spark, d, "documents")), "index")


_A, _B = ["the", "tion", "ing", "ble"], ["and", "that", "from"]


@query("tokens", f"SELECT word, seed, round(log2(n_ab * n / (a.c * b.c)::DOUBLE), 6) + 0.0::DOUBLE AS pmi FROM (SELECT x.word, y.word AS seed, count(*) AS n_ab FROM (SELECT DISTINCT * FROM tokens WHERE word IN {tuple(_A)}) x JOIN (SELECT DISTINCT * FROM tokens WHERE word IN {tuple(_B)}) y USING (doc_id) GROUP BY 1, 2) JOIN (SELECT word, count(DISTINCT doc_id) AS c FROM tokens GROUP BY word) a USING (word) JOIN (SELECT word AS seed, count(DISTINCT doc_id) AS c FROM tokens GROUP BY word) b USING (seed) CROSS JOIN (SELECT count(DISTINCT doc_id) AS n FROM tokens)")
def M13_J10_pmi(spark, d):
    return rounded(K.pair_pmi(_token_index(spark, d), _A, _B))


@query("tokens", f"SELECT word, seed, round(log2(n_ab * n / (a.c * b.c)::DOUBLE), 6) + 0.0::DOUBLE AS pmi FROM (SELECT x.word, y.word AS seed, count(*) AS n_ab FROM (SELECT DISTINCT * FROM tokens) x JOIN (SELECT DISTINCT * FROM tokens WHERE word IN {tuple(_B)}) y USING (doc_id) WHERE x.word <> y.word GROUP BY 1, 2) JOIN (SELECT word, count(DISTINCT doc_id) AS c FROM tokens GROUP BY word) a USING (word) JOIN (SELECT word AS seed, count(DISTINCT doc_id) AS c FROM tokens GROUP BY word) b USING (seed) CROSS JOIN (SELECT count(DISTINCT doc_id) AS n FROM tokens)")
def M13_J10_pmi_of_all(spark, d):
    return rounded(K.all_pmi(_token_index(spark, d), _B))


@query("tokens counts", "SELECT word, side, round(gap, 9) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(gap) DESC, word) AS n FROM (SELECT word, n_rise / r - n_fall / f AS gap, CASE WHEN n_rise / r - n_fall / f > 0 THEN 'rise' ELSE 'fall' END AS side FROM counts CROSS JOIN (SELECT sum(n_rise)::DOUBLE AS r, sum(n_fall)::DOUBLE AS f FROM counts) WHERE n_rise + n_fall >= 3 AND word NOT IN ('the', 'and', 'der', 'que')) WHERE abs(gap) > 0.00012) WHERE n <= 500")
def M14_A10_L4_rate_gap(spark, d):
    return rounded(K.rate_gap(written(L.class_counts(_labelled(spark, d), stop=()), "counts"), base=tuple(POLARITY)), 9)


def _vectors(spark, d):
    rows = X.table(spark, d, "embeddings")
    return rows.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")), rows.where("vec_id < 20").select(F.col("vec_id").alias("seed"), F.col("embedding").alias("vector"))


_NEAR = "SELECT s.vec_id AS seed, e.vec_id AS word, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings s JOIN embeddings e ON s.vec_id < 20 AND e.vec_id <> s.vec_id QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY similarity DESC, e.vec_id) <= 5"


@query(sql=f"SELECT seed, word, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, word))::INT AS rank FROM ({_NEAR})")
def L2_neighbours(spark, d):
    return rounded(K.all_neighbours(*_vectors(spark, d)))


@query(sql=f"SELECT word, round(max(similarity), 6) AS similarity, arg_max(seed, (similarity, -seed)) AS similar_to FROM ({_NEAR}) GROUP BY word")
def L3_M11_best_seed(spark, d):
    return rounded(K.best_seed(K.all_neighbours(*_vectors(spark, d))))


def _all_neighbours(spark, d):
    rows = X.table(spark, d, "embeddings")
    return K.all_neighbours(rows.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector")), rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("seed"), F.col("embedding").alias("vector")))


_ALL_NEAR = "SELECT s.vec_id AS seed, e.vec_id AS word, list_cosine_similarity(s.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS similarity FROM embeddings s JOIN embeddings e ON s.vec_id % 50 = 0 AND e.vec_id <> s.vec_id QUALIFY row_number() OVER (PARTITION BY s.vec_id ORDER BY similarity DESC, e.vec_id) <= 5"


@query(sql=f"SELECT seed, word, round(similarity, 6) AS similarity, (row_number() OVER (PARTITION BY seed ORDER BY similarity DESC, word))::INT AS rank FROM ({_ALL_NEAR})")
def L2_neighbours_of_all(spark, d):
    return rounded(_all_neighbours(spark, d))


@query(sql=f"SELECT word, round(max(similarity), 6) AS similarity, arg_max(seed, (similarity, -seed)) AS similar_to FROM ({_ALL_NEAR}) GROUP BY word")
def L3_M11_best_seed_of_all(spark, d):
    return rounded(K.best_seed(_all_neighbours(spark, d)))


@query("articles", "SELECT DISTINCT source AS word FROM articles WHERE lower(source) NOT IN ('src1', 'src2')")
def J11_K8_novel(spark, d):
    existing = spark.createDataFrame([("SRC1",), ("src2",)], "term string")
    return K.novel(X.articles(spark, d).select(F.col("source").alias("word")).distinct(), existing)


@query(sql="""WITH c AS (SELECT vec_id AS word, embedding[1]::DOUBLE AS p, embedding[2]::DOUBLE AS w FROM embeddings),
v AS (SELECT *, greatest(p, 0) AS pr, greatest(-p, 0) AS pf, greatest(0, 0.05::DOUBLE - abs(p)) AS pn, greatest(w, 0) AS wr, greatest(-w, 0) AS wf, greatest(0, 0.05::DOUBLE - abs(w)) AS wn FROM c WHERE abs(p) >= 0.02 OR abs(w) >= 0.02),
s AS (SELECT word, p, w, (pr / (pr + pf + pn) + wr / (wr + wf + wn)) / 2 AS vote_rise, (pn / (pr + pf + pn) + wn / (wr + wf + wn)) / 2 AS vote_neutral, (pf / (pr + pf + pn) + wf / (wr + wf + wn)) / 2 AS vote_fall FROM v),
l AS (SELECT *, CASE WHEN vote_rise >= vote_fall AND vote_rise >= vote_neutral THEN 'rise' WHEN vote_fall >= vote_neutral THEN 'fall' ELSE 'neutral' END AS label, greatest(vote_rise, vote_fall, vote_neutral) AS agreement_score FROM s)
SELECT word, round(p, 6) + 0.0::DOUBLE AS pmi_polarity, round(w, 6) + 0.0::DOUBLE AS w2v_polarity, round(vote_rise, 6) AS vote_rise, round(vote_neutral, 6) AS vote_neutral, round(vote_fall, 6) AS vote_fall, label, round(agreement_score, 6) AS agreement_score FROM l WHERE label <> 'neutral' AND agreement_score >= 0.35""")
def M16_F24_fusion(spark, d):
    rows = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding")[0].cast("double").alias("pmi_polarity"), F.col("embedding")[1].cast("double").alias("w2v_polarity"))
    return rounded(K.fused(rows, 0.02, 0.02, 0.05, 0.35))


X.SQL["z"] = "SELECT v.*, (coalesce(ret, rm) - rm) / ri AS zr, (coalesce(realized_vol, vm) - vm) / vi AS zv FROM vol v CROSS JOIN (SELECT median(ret) AS rm, greatest(quantile_cont(ret, 0.75) - quantile_cont(ret, 0.25), 1e-6) AS ri, median(realized_vol) AS vm, greatest(quantile_cont(realized_vol, 0.75) - quantile_cont(realized_vol, 0.25), 1e-6) AS vi FROM vol)"
X.SQL["sc"] = "SELECT *, zr * 0.4 AS s1, -zv AS s2, -0.5 * (abs(zr * 0.4) + abs(zv)) AS s3, greatest(zr * 0.4, -zv, -0.5 * (abs(zr * 0.4) + abs(zv))) AS top FROM z"


@query("price ret vol z sc", "SELECT date, round(exp(s1 - top) / t, 6) AS p1, round(exp(s2 - top) / t, 6) AS p2, round(exp(s3 - top) / t, 6) AS p3 FROM (SELECT *, exp(s1 - top) + exp(s2 - top) + exp(s3 - top) AS t FROM sc)")
def R8_R9_F17_F19_rule_regime(spark, d):
    rows = R.rule_scores(_vol(spark, d), {"up": {"ret": 0.4}, "calm": {"realized_vol": -1.0}}, "mixed")
    return rounded(rows.select("date", *(F.col(f"regime_prob_{k}").alias(f"p{i}") for i, k in enumerate(("up", "calm", "mixed"), 1))))


@query("price ret bt bt2", "SELECT date, sw AS regime_switched, m AS regime_sent_mult, round(y_true * m * (1 - sw * 0.35), 6) + 0.0::DOUBLE AS y_true_regime_adj, round(y_pred * m, 6) + 0.0::DOUBLE AS y_pred_regime_adj FROM (SELECT *, coalesce(regime <> lag(regime) OVER (ORDER BY date), true)::INT AS sw, CASE regime WHEN 'macro' THEN 0.65 ELSE 1.0 END::DOUBLE AS m FROM bt2)")
def R10_adjusted_sentiment(spark, d):
    return rounded(R.adjusted(_bt(spark, d), ["y_true"], ["y_pred"]).select("date", "regime_switched", "regime_sent_mult", "y_true_regime_adj", "y_pred_regime_adj"))


@query("price ret vol z sc bt", "SELECT sc.date, round(0.2 * ret + 0.8 * (p * ret + (1 - p) * (ret * 2)), 6) + 0.0::DOUBLE AS mixed FROM (SELECT *, exp(s1) / (exp(s1) + exp(s2)) AS p FROM sc) sc WHERE ret IS NOT NULL")
def B4_mixture(spark, d):
    rows = R.rule_scores(_vol(spark, d), {"up": {"ret": 0.4}, "calm": {"realized_vol": -1.0}}, "mixed").where("ret is not null")
    y = F.col("ret")
    return rounded(rows.select("date", B.mixture(y, {"up": None, "calm": y * 2}, {"up": F.exp("regime_score_up"), "calm": F.exp("regime_score_calm")}).alias("mixed")))


_RULES = (("buyhold", "1.0"), ("naive", "(y_pred > 0)::INT"), ("filtered", "CASE WHEN y_pred >= 1 THEN 1 WHEN y_pred <= -1 THEN -1 ELSE 0 END"), ("regime_filtered", "CASE WHEN regime = 'macro' THEN 0 WHEN y_pred >= 1 THEN 1 WHEN y_pred <= -1 THEN -1 ELSE 0 END"))


@query("price ret bt bt2", "SELECT date, " + ", ".join(f"round(product(1 + {p} * y_true / 100) OVER w, 6) AS growth_{k}" for k, p in _RULES) + " FROM bt2 WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)")
def B10_signals(spark, d):
    return rounded(B.signal(_bt(spark, d)).select("date", *(f"growth_{k}" for k, _ in _RULES)))


@query("price ret bt bt2", f"SELECT count(*) AS n, count(*) FILTER (s <> 0) AS n_trades, count(*) FILTER (s = 1) AS n_long, count(*) FILTER (s = -1) AS n_short, round(avg((sign(y_pred) = sign(y_true))::INT) FILTER (s <> 0), 6) AS dir_acc FROM (SELECT *, {_RULES[2][1]} AS s FROM bt2)")
def B10_trades(spark, d):
    return rounded(B.trades(B.signal(_bt(spark, d))))


@query()
def R2_R5_R6_markov_regime(spark, d):
    """A model for each market segment's weekly prices."""
    by = ("series",)
    rows = X.segment_price(spark, d).withColumn("ret", S.change(F.col("close"), S.over(by=by)))
    return R.markov_regime(S.volatility(rows, "ret", by=by), ["ret", "realized_vol"])


@query()
def R2_R5_R6_markov_regime_of_events(spark, d):
    """A model for each type of event over its values in time, long series in blocks."""
    rows = X.table(spark, d, "events").where("value is not null").groupBy(F.col("event_type").alias("series"), F.col("ts").alias("date")).agg(F.avg("value").alias("value"))
    return R.markov_regime(rows, ["value"], 2)


@query("price ret vol regime", 'SELECT vol_regime AS "from", "to", n, round(n / sum(n) OVER (PARTITION BY vol_regime), 6) AS share FROM (SELECT vol_regime, "to", count(*) AS n FROM (SELECT vol_regime, lead(vol_regime) OVER (ORDER BY date) AS "to" FROM regime WHERE vol_regime IS NOT NULL) WHERE "to" IS NOT NULL GROUP BY 1, 2)')
def R7_transitions(spark, d):
    return rounded(R.transitions(R.volatility_regime(_vol(spark, d)), "vol_regime"))


@query()
def W18_ridge_walk_forward(spark, d):
    rows = _vol(spark, d)
    w = S.over()
    lags = rows.select("date", "ret", *(F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in ("ret", "realized_vol") for k in (1, 2))).where("ret is not null")
    return V.ridge_walk_forward(lags, "ret", ["ret_lag1", "ret_lag2", "realized_vol_lag1", "realized_vol_lag2"])


def _layer_sql(days: str, how: dict[str, str], name: str, mean: str, std: str) -> str:
    """The CTEs of matrix.weekly_layer(): {name}_w, and {name}_l with what is derived from it."""
    week = WEEK.format("date")
    columns = ", ".join(f"coalesce({c}, 0) AS {c}" if f == "sum" else c for c, f in how.items())
    sums = ", ".join(f"{f}({c})" + ("::BIGINT" if f == "sum" and c != "log_headline_count" else "") + f" AS {c}" for c, f in how.items())
    return f"""{name}_w AS (SELECT c.date, {columns} FROM (SELECT unnest(generate_series(min(w), max(w), INTERVAL 7 DAYS))::DATE AS date FROM (SELECT {week} AS w FROM {days})) c LEFT JOIN (SELECT {week} AS date, {sums} FROM {days} GROUP BY 1) s USING (date)),
{name}_l AS (SELECT *, {mean} * {std} AS {name}_csi_v FROM {name}_w JOIN (SELECT a.date, sum(coalesce(b.{mean}, 0) * exp(-date_diff('day', b.date, a.date) / 28.0::DOUBLE)) AS {name}_cs_di FROM {name}_w a JOIN {name}_w b ON b.date <= a.date GROUP BY a.date) USING (date))"""


_LAYERS = {"broad": M.BROAD, "opec": M.DECISIVE, "disruption": M.DISRUPTIVE}
_NEWS = [c for name, how in _LAYERS.items() for c in (*(c for c in how if not c.endswith("event_window")), f"{name}_cs_di", f"{name}_csi_v")]
_REST = ["realized_vol", "vol_regime_low", "vol_regime_mid", "vol_regime_high", "stocks_chg", "surprise", "rate", "rate_chg", "stocks_mom"]
_WHOLE = {c for c in _NEWS if c != "log_headline_count" and any(x in c for x in ("count", "_day", "intensity"))} | set(_REST[1:4])
_DAY_FLAGS = "avg(sentiment) AS {0}_sentiment, coalesce(stddev_samp(sentiment), 0) AS {0}_sentiment_std, 1 AS {0}_event_day, 1 AS {0}_event_window"
X.SQL["bday"] = DAILY.replace("FROM scored", "FROM news WHERE tier NOT IN ('purchase', 'error')")
X.SQL["oday"] = f"SELECT date, count(id) AS opec_article_count, {_DAY_FLAGS.format('opec')}, max(contains(lower(title), 'deal')::INT) AS opec_decision_day FROM news WHERE tier = 'purchase' GROUP BY date"
X.SQL["dday"] = f"SELECT date, count(id) AS disruption_intensity, {_DAY_FLAGS.format('disruption')} FROM news WHERE tier = 'error' GROUP BY date"
_MATRIX = ",\n".join((
    with_tables("news bday oday dday price ret vol regime macro drivers", "").strip(),
    _layer_sql("bday", M.BROAD, "broad", "sentiment_mean", "sentiment_std"), _layer_sql("oday", M.DECISIVE, "opec", "opec_sentiment", "opec_sentiment_std"), _layer_sql("dday", M.DISRUPTIVE, "disruption", "disruption_sentiment", "disruption_sentiment_std"),
    "j AS (SELECT v.date, close, ret AS close_pct_change, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in _NEWS) + ", realized_vol, " + ", ".join(f"coalesce((vol_regime = {k})::INT, 0) AS vol_regime_{x}" for k, x in enumerate(("low", "mid", "high"))) + ", stocks_chg, surprise, rate, rate_chg, stocks_mom FROM regime v LEFT JOIN broad_l USING (date) LEFT JOIN opec_l USING (date) LEFT JOIN disruption_l USING (date) LEFT JOIN drivers USING (date))",
    "l AS (SELECT date, close, close_pct_change, " + ", ".join(f"lag({c}) OVER o AS {c}_lag1" for c in _NEWS + _REST) + " FROM j WINDOW o AS (ORDER BY date))",
))


@query(sql=f"{_MATRIX} SELECT date, {r('close', 'close_pct_change')}, " + ", ".join(f"{c}_lag1" if c in _WHOLE else r(f"{c}_lag1") for c in _NEWS + _REST) + " FROM l WHERE close_pct_change IS NOT NULL AND " + " AND ".join(f"{c}_lag1 IS NOT NULL" for c in _NEWS + _REST))
def X1_feature_matrix(spark, d):
    """Three layers of news, volatility regimes and macro changes, a week late, beside the price."""
    return rounded(_matrix(spark, d))


@query()
def X1_feature_matrix_with_states(spark, d):
    """X1_feature_matrix with the states of a hidden Markov model."""
    return rounded(_matrix(spark, d, 3))


def _matrix(spark, d, states=0):
    rows = written(X.news(spark, d), "news")
    tiers = [rows.where(c) for c in ("tier not in ('purchase', 'error')", "tier = 'purchase'", "tier = 'error'")]
    return M.news_matrix(written(X.price(spark, d), "price"), *tiers, _drivers(spark, d), states)


def _sql_list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _any_sql(column: str, terms) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t}')" for t in terms) + ")"


_BASE_SQL = ", ".join(f"('{w}', {p}::DOUBLE)" for w, p in sorted({w: p for some, p in L.BASE for w in some}.items()))
_LM = ",\n".join((
    with_tables("price ret", "").strip(),
    "c AS (SELECT doc_id AS id, DATE '1995-01-06' + (doc_id % 2390)::INT AS date, coalesce(split_part(text, chr(10), 1), '') AS headline, trim(coalesce(split_part(text, chr(10), 1), '') || ' ' || coalesce(text, '')) AS text FROM documents)",
    f"d AS (SELECT *, {_any_sql('lower(headline)', words.CONTEXT_WORDS)} AS o, list_has_any(regexp_split_to_array(lower(headline), '\\s+'), {_sql_list(words.RISE_WORDS)}) AS u, list_has_any(regexp_split_to_array(lower(headline), '\\s+'), {_sql_list(words.FALL_WORDS)}) AS f FROM c WHERE text <> '')",
    rf"tk AS (SELECT id, CASE WHEN o AND u AND NOT f THEN 'rise' WHEN o AND f AND NOT u THEN 'fall' END AS side, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND NOT list_contains({_sql_list(words.STOP_WORDS)}, x))) AS word FROM d)",
    "counts AS (SELECT word, count(*) FILTER (side = 'rise') AS n_rise, count(*) FILTER (side = 'fall') AS n_fall FROM tk WHERE side IS NOT NULL GROUP BY word)",
    f"base AS (SELECT * FROM (VALUES {_BASE_SQL}) v(word, polarity))",
    f"lexicon AS ({LEXICON.replace('FROM counts', 'FROM counts, (SELECT coalesce(sum(n_rise), 0) AS sr, coalesce(sum(n_fall), 0) AS sf FROM counts)').replace('WHERE n_rise', 'WHERE sr > 0 AND sf > 0 AND n_rise')})",
    "sc AS (SELECT id, sum(coalesce(polarity, 0)::DECIMAL(18, 6))::DOUBLE / count(*) AS s FROM tk LEFT JOIN lexicon USING (word) GROUP BY id)",
    f"t AS (SELECT {WEEK.format('date')} AS week, greatest(least(coalesce(s, 0), 1), -1)::DOUBLE AS sentiment, list_filter([" + ", ".join(f"CASE WHEN {_any_sql('lower(text)', terms)} THEN '{k}' END" for k, terms in words.TOPIC_KEYWORDS.items()) + "], lambda x: x IS NOT NULL) AS topics FROM d LEFT JOIN sc USING (id))",
    LM_IND,
    "w AS (SELECT week, " + ", ".join(f"max({k}) FILTER (category = '{c}') AS {c}_{k}" for c in words.TOPIC_KEYWORDS for k in ("intensity", "sentiment", "variance", "decay")) + " FROM ind GROUP BY week)",
))


@query(sql=f"{_LM} SELECT ret.date, {r('close')}, {r('ret').replace('AS ret', 'AS close_pct_change')}, " + ", ".join(f"round(coalesce({c}_{k}, 0), 6) + 0.0::DOUBLE AS {c}_{k}_lag1" for c in words.TOPIC_KEYWORDS for k in ("intensity", "sentiment", "variance", "decay")) + " FROM ret LEFT JOIN w ON ret.date = w.week + 7 WHERE ret IS NOT NULL")
def X3_lexicon_matrix(spark, d):
    """Direction, grown lexicon, score, topics and 32 indicators with the lists of functions.words."""
    day = F.date_add(F.lit("1995-01-06").cast("date"), (F.col("id") % 2390).cast("int"))
    return rounded(M.lexicon_matrix(X.price(spark, d), A.corpus(X.articles(spark, d).select("id", F.col("headline").alias("title"), "body", day.alias("date")))))


X.SQL["kt"] = rf"SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{{L}}\p{{N}}_]+'), lambda x: regexp_matches(x, '^[a-z]{{3,}}$') AND NOT list_contains({_sql_list(words.KEYWORD_STOP_WORDS)}, x)) AS w FROM documents"
X.SQL["kp"] = "SELECT doc_id, i - 1 AS pos, w[i] AS token, w[i + 1] AS next FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM kt)"
X.SQL["pair"] = "SELECT token AS a, next AS b, count(*) AS n_ab FROM kp WHERE next IS NOT NULL GROUP BY ALL"
X.SQL["single"] = "SELECT token, count(*) AS n FROM kp GROUP BY token"
X.SQL["phr"] = "SELECT * FROM (SELECT a, b, n_ab, (n_ab - 5) * ((SELECT count(*) FROM pair) + (SELECT count(*) FROM single)) / (x.n * y.n)::DOUBLE AS score FROM pair JOIN single x ON x.token = a JOIN single y ON y.token = b WHERE n_ab >= 5) WHERE score > 10"
X.SQL["run"] = "SELECT doc_id, pos, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM kp JOIN phr ON token = a AND next = b"
X.SQL["taken"] = "SELECT doc_id, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY pos) AS k FROM run) WHERE k % 2 = 1"


def _keyword_tokens(spark, d):
    return written(X.table(spark, d, "documents").select("doc_id", T.tokens(F.col("text"), words.KEYWORD_STOP_WORDS).alias("tokens")), "tokens")


@query("kt kp pair single phr", "SELECT a, b, n_ab, round(score, 6) AS score FROM phr")
def M8_phrases(spark, d):
    return rounded(K.phrases(_keyword_tokens(spark, d)))


@query("kt kp pair single phr run taken", "SELECT kp.doc_id, kp.pos::INT AS pos, CASE WHEN t.pos IS NOT NULL THEN token || '_' || next ELSE token END AS token FROM kp LEFT JOIN taken t ON t.doc_id = kp.doc_id AND t.pos = kp.pos LEFT JOIN taken u ON u.doc_id = kp.doc_id AND u.pos = kp.pos - 1 WHERE u.pos IS NULL")
def M8_phrased(spark, d):
    docs = _keyword_tokens(spark, d)
    return K.phrased(docs, written(K.phrases(docs), "phrases"))


@query()
def M9_M10_M11_expanded_groups(spark, d):
    """From the corpus to new keywords of three groups: phrases, vectors, seeds, neighbours, gates."""
    groups = spark.createDataFrame([(g, s) for g, some in {"one": ["the", "that", "with"], "two": ["der", "und", "nicht"], "three": ["que", "les", "dans"]}.items() for s in some], "group string, seed string")
    return K.expanded_groups(_keyword_tokens(spark, d), groups, least=0.3, cosine_least=0.2, size=50, rounds=5)


_NAMED = "e AS (SELECT 'w' || vec_id AS word, embedding::DOUBLE[] AS v, vec_id FROM embeddings)"


def _named_vectors(spark, d):
    rows = X.table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("word"), F.col("embedding").alias("vector"))
    return rows.select("word", "vector"), rows.where("vec_id % 50 = 0").select(F.col("word").alias("seed"), "vector"), rows


@query(sql=f"WITH {_NAMED}, n AS (SELECT s.word AS seed, e.word, list_cosine_similarity(s.v, e.v) AS similarity FROM e s JOIN e ON s.vec_id % 50 = 0 AND e.word <> s.word QUALIFY row_number() OVER (PARTITION BY s.word ORDER BY similarity DESC, e.word) <= 10) SELECT word, word AS display, round(similarity, 4) AS similarity, seed AS similar_to FROM n WHERE similarity >= 0.2 AND length(word) >= 4 AND word NOT IN (SELECT word FROM e WHERE vec_id % 10 = 5) QUALIFY row_number() OVER (PARTITION BY word ORDER BY n.similarity DESC, seed) = 1")
def M11_expansion(spark, d):
    vectors, seeds, rows = _named_vectors(spark, d)
    return K.expanded(vectors, seeds, rows.where("vec_id % 10 = 5").select(F.col("word").alias("term")), 10, 0.2)


@query(sql=f"WITH {_NAMED} SELECT e.word, round(avg(list_cosine_similarity(e.v, s.v)), 6) + 0.0::DOUBLE AS mean_cosine FROM e JOIN e s ON s.vec_id % 50 = 0 GROUP BY e.word")
def M12_mean_cosine(spark, d):
    vectors, seeds, _ = _named_vectors(spark, d)
    return rounded(K.mean_cosine(vectors, seeds.select("vector")))


_PMI = """b AS (SELECT DISTINCT 'w' || (l_partkey % 500) AS word, l_orderkey FROM lineitem), nb AS (SELECT word, count(*) AS c FROM b GROUP BY word),
pm AS (SELECT word, avg(log2(n_ab * (SELECT count(DISTINCT l_orderkey) FROM b) / (x.c * y.c)::DOUBLE)) AS mean_pmi FROM (SELECT b.word, s.word AS seed, count(*) AS n_ab FROM b JOIN b s USING (l_orderkey) WHERE s.word IN ('w0', 'w50', 'w100') AND b.word <> s.word GROUP BY ALL) JOIN nb x USING (word) JOIN nb y ON y.word = seed GROUP BY word)"""


def _baskets(spark, d):
    return written(X.table(spark, d, "lineitem").select(F.concat(F.lit("w"), (F.col("l_partkey") % 500).cast("string")).alias("token"), F.col("l_orderkey").alias("doc_id")).distinct(), "baskets")


@query(sql=f"WITH {_PMI} SELECT word, round(mean_pmi, 6) + 0.0::DOUBLE AS mean_pmi FROM pm")
def M13_mean_pmi(spark, d):
    return rounded(K.mean_pmi(_baskets(spark, d), ["w0", "w50", "w100"]))


@query(sql=f'WITH {_NAMED}, {_PMI}, c AS (SELECT e.word, e.vec_id, avg(list_cosine_similarity(e.v, s.v)) AS mean_cosine FROM e JOIN e s ON s.vec_id % 50 = 0 GROUP BY ALL) SELECT \'g\' || (vec_id % 3) AS "group", word, CASE WHEN vec_id % 3 < 2 THEN round(mean_cosine, 4) + 0.0::DOUBLE END AS mean_cosine, CASE WHEN vec_id % 3 < 2 THEN round(mean_pmi, 4) + 0.0::DOUBLE END AS mean_pmi FROM c LEFT JOIN pm USING (word) WHERE vec_id % 3 = 2 OR (mean_cosine >= 0 AND mean_pmi >= 0.02)')
def M15_relevance(spark, d):
    vectors, seeds, rows = _named_vectors(spark, d)
    group = F.concat(F.lit("g"), (F.substring("word", 2, 20).cast("long") % 3).cast("string")).alias("group")
    cosines = K.mean_cosine(vectors, seeds.select("vector")).select("*", group)
    pmis = K.mean_pmi(_baskets(spark, d), ["w0", "w50", "w100"]).select("*", group)
    return rounded(K.relevant(rows.select("word", group), cosines, pmis, ["g0", "g1"], 0.0, 0.02), 4)


@query(sql="""WITH c AS (SELECT r_name AS strategy, n_name AS term FROM nation JOIN region ON n_regionkey = r_regionkey), m AS (SELECT * FROM (VALUES ('BUILDING', 'ASIA'), ('MACHINERY', 'EUROPE')) v(g, strategy)),
n AS (SELECT DISTINCT strategy, lower(n_name) AS term FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN m ON g = c_mktsegment) SELECT * FROM c UNION ALL SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.strategy = n.strategy AND lower(c.term) = n.term)""")
def K8_catalogue(spark, d):
    nation = X.table(spark, d, "nation")
    catalogue = nation.join(X.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("strategy"), F.col("n_name").alias("term"))
    found = X.table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("group"), F.lower("n_name").alias("word")).distinct()
    return K.appended(catalogue, found, spark.createDataFrame([("BUILDING", "ASIA"), ("MACHINERY", "EUROPE")], "group string, strategy string"))


@query()
def M5_M6_J13_A12_article_topics(spark, d):
    """Topics by classifiers that learn from the keywords of functions.words."""
    return G.topics_by_model(X.articles(spark, d).select("id", "body"), "id", "body").select("id", F.array_join("topics", ",").alias("topics"))


@query("articles", "SELECT id, array_to_string(list_sort(list_filter([" + ", ".join(f"CASE WHEN {_any_sql('lower(body)', terms)} THEN '{k}' END" for k, terms in words.TOPIC_KEYWORDS.items()) + "], lambda x: x IS NOT NULL)), ',') AS topics FROM articles")
def A12_F7_weak_topics(spark, d):
    """The union of labels that are certain: those of the keywords, for a text as one paragraph."""
    rows = X.articles(spark, d).select("id", "body")
    sure = rows.select("id", T.once(T.topics(F.col("body")), lambda t: F.map_from_arrays(t, F.transform(t, lambda _: F.lit(1.0)))).alias("probabilities"))
    return G.article_topics(rows, sure).select("id", F.array_join("topics", ",").alias("topics"))


_GROUPS = {
    "supply": {"opec_event_day_lag1": 1.0, "disruption_event_day_lag1": 1.0, "disruption_intensity_lag1": 1.0, "opec_sentiment_lag1": 0.4, "opec_cs_di_lag1": 1.0, "disruption_cs_di_lag1": 1.0},
    "demand": {"stocks_chg_lag1": 1.0, "surprise_lag1": 1.0},
    "macro": {"rate_chg_lag1": 1.0, "stocks_mom_lag1": 1.0, "realized_vol_lag1": 1.0},
}
_SCORES = {
    "supply": (("opec_event_day_lag1", 1, False), ("disruption_event_day_lag1", 1, False), ("disruption_intensity_lag1", 1, False)), "demand": (("stocks_chg_lag1", -1, False),),
    "macro": (("stocks_mom_lag1", 1, True), ("rate_chg_lag1", 1, True)), "risk_off": (("realized_vol_lag1", 1, False), ("negative_ratio_lag1", 1, False)),
}
_DRIVERS = sorted({c for terms in _SCORES.values() for c, *_ in terms})


def _learnable(spark, d):
    rows = _matrix(spark, d)
    return rows, "close_pct_change", [c for c in rows.columns if c.endswith("_lag1")]


def _design(features):
    rule = V.Regimes(_GROUPS, "risk_off", tuple(c for c in features if c.endswith("_cs_di_lag1")), tuple(c for c in features if c.endswith("_sentiment_lag1")))
    return V.Design("close_pct_change", tuple(features), rule)


@query()
def B1_B2_B3_B6_regime_walk_forward(spark, d):
    rows, _, features = _learnable(spark, d)
    return V.regime_walk_forward(rows, _design(features))


@query()
def B5_nested_tuning(spark, d):
    """What the nested search chooses on all weeks: a row, with the experts' parameters by regime."""
    rows, target, features = _learnable(spark, d)
    weeks = V.gathered(rows, [target, *features])
    whole = spark.createDataFrame([(0, len(weeks["date"]))], "fold long, first long")
    return V.tuned(whole, weeks, _design(features))


@query()
def B7_boosted_walk_forward(spark, d):
    return V.boosted_walk_forward(*_learnable(spark, d))


@query()
def B9_specialist_walk_forward(spark, d):
    return V.specialist_walk_forward(*_learnable(spark, d), _DRIVERS, _SCORES)


@query()
def B11_L7_permutation_importance(spark, d):
    return V.permutation_importance(*_learnable(spark, d))


@query()
def R3_R4_R11_driver_regime(spark, d):
    rows, *_ = _learnable(spark, d)
    return R.driver_regime(rows.withColumn("series", F.lit("all")), _DRIVERS, _SCORES)


@query()
def R7_driver_report(spark, d):
    """Weeks and mean drivers of each regime as inferred, and what its state says of itself."""
    rows = _learnable(spark, d)[0].withColumn("series", F.lit("all")).select("series", "date", *_DRIVERS)
    models = R.driver_models(rows, _DRIVERS, _SCORES)
    labels = R.driver_regime(rows, _DRIVERS, _SCORES, models=models).select("series", "date", "regime")
    summary = R.regime_means(rows.join(labels, ["series", "date"]), _DRIVERS).withColumns({c: F.col(c).alias(c) for c in _DRIVERS})
    seen = F.explode(F.create_map(*(x for c in ("n_weeks", *_DRIVERS) for x in (F.lit(c if c == "n_weeks" else f"seen {c}"), F.col(c).cast("double"))))).alias("measure", "value")
    state = R.state_report(models, spark)
    said = F.map_concat(F.create_map(F.lit("decay_weeks"), F.col("decay_weeks").cast("double")), F.transform_keys("moves", lambda k, _: F.concat(F.lit("to "), k)), F.transform_keys("means", lambda k, _: F.concat(F.lit("state "), k)))
    return summary.select("regime", seen).union(state.select("regime", F.explode(said).alias("measure", "value")))


@query("price ret bt bt2", "SELECT regime, count(*) AS n_weeks, round(avg(y_true), 3) + 0.0::DOUBLE AS y_true, round(avg(y_pred), 3) + 0.0::DOUBLE AS y_pred FROM bt2 GROUP BY regime")
def A14_regime_means(spark, d):
    return rounded(R.regime_means(_bt(spark, d), ["y_true", "y_pred"]))


@query(sql="SELECT 'union' AS kind, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'rest', count(*) FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def U3_set_operations(spark, d):
    a, b = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("k")), X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("k"))
    sizes = {"union": a.union(b).distinct(), "both": a.intersect(b), "rest": a.subtract(b)}
    found = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in sizes.items()]
    return found[0].union(found[1]).union(found[2])


@query(sql=" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(median({c}), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice")))
def A24_described(spark, d):
    return rounded(S.described(X.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("articles", "SELECT id, date FROM articles")
def L1_sorted(spark, d):
    """Sorted by ranges of (date, id), not in one task."""
    return X.articles(spark, d).select("id", "date").orderBy("date", "id")


@query(sql="SELECT c_mktsegment AS \"group\", c_name AS word, round(c_acctbal, 6) AS similarity, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_name))::INT AS rank FROM customer QUALIFY rank <= 10")
def L5_report(spark, d):
    return rounded(K.report(X.table(spark, d, "customer").select(F.col("c_mktsegment").alias("group"), F.col("c_name").alias("word"), F.col("c_acctbal").alias("similarity"))))
