"""The measures of a back-test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fathom.operators.series import growth, over


def outcomes(rows: DataFrame, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (date, y_true, y_pred) with directions, returns, hits and cumulative returns."""
    rows = rows.withColumns({"pred_dir": (F.col("y_pred") > 0).cast("int"), "true_dir": (F.col("y_true") > 0).cast("int"), "strategy_ret": F.signum("y_pred") * F.col("y_true"), "bh_ret": F.col("y_true")})
    rows = rows.withColumn("hit", (F.col("pred_dir") == F.col("true_dir")).cast("int"))
    return rows.select("*", growth(F.col("strategy_ret"), over(date, by)).alias("cum_strategy_ret"), growth(F.col("bh_ret"), over(date, by)).alias("cum_bh_ret"))


def by_regime(bt: DataFrame) -> DataFrame:
    """Number, accuracy and mean returns of each regime, and whether accuracy is below a half."""
    out = bt.groupBy("regime").agg(F.count("*").alias("n"), F.avg("hit").alias("accuracy"), F.avg("strategy_ret").alias("mean_strategy_ret"), F.avg("bh_ret").alias("mean_bh_ret"))
    return out.withColumn("below_50pct_acc", F.col("accuracy") < 0.5)


def weak_regimes(bt: DataFrame) -> DataFrame:
    """by_regime(), regimes above a half first and each part from the least accurate on."""
    return by_regime(bt).orderBy("below_50pct_acc", "accuracy", "regime")


def overall(bt: DataFrame, date: str = "date") -> DataFrame:
    return bt.agg(F.avg("hit").alias("accuracy"), F.avg("strategy_ret").alias("mean_strategy_ret"), F.avg("bh_ret").alias("mean_bh_ret"), F.max_by("cum_strategy_ret", date).alias("cum_strategy_ret"), F.max_by("cum_bh_ret", date).alias("cum_bh_ret"))


def regime_shares(bt: DataFrame, size: int = 52, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Number and share of each regime in runs of `size` rows."""
    runs = bt.withColumn("fold", (F.floor((F.row_number().over(over(date, by)) - 1) / size) + 1).cast("long"))
    counts = runs.groupBy(*by, "fold", "regime").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "fold")))


def errors(rows: DataFrame, *by: str) -> DataFrame:
    """MAE, RMSE, share of equal signs, mean size of the forecasts, and the ratio of the deviations."""
    miss = F.col("y_pred") - F.col("y_true")
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg(F.abs(miss)).alias("mae"), F.sqrt(F.avg(miss * miss)).alias("rmse"),
        F.avg((F.signum("y_pred") == F.signum("y_true")).cast("double")).alias("dir_acc"), F.avg(F.abs("y_pred")).alias("mean_abs_pred"), F.try_divide(F.stddev_pop("y_pred"), F.stddev_pop("y_true")).alias("var_ratio"),
    )


def ladder(rows: DataFrame, thresholds=(0.0, 0.5, 1.0, 1.5, 2.0), least: int = 5) -> DataFrame:
    """For each threshold the rows whose forecast reaches it: number, accuracy, long and
    short; it ends ahead of the first threshold that leaves fewer than `least`."""
    kept = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).where(F.abs("y_pred") >= F.col("threshold"))
    sums = kept.groupBy("threshold").agg(
        F.count("*").alias("n"), F.avg((F.signum("y_pred") == F.signum("y_true")).cast("double")).alias("accuracy"),
        F.sum((F.col("y_pred") > 0).cast("long")).alias("n_long"), F.sum((F.col("y_pred") < 0).cast("long")).alias("n_short"),
    )
    return sums.where(F.col("n") >= least)  # numbers only fall with the threshold


def mixture(global_pred: Column, experts: dict[str, Column | None], probs: dict[str, Column], weight: float = 0.2) -> Column:
    """weight * global + (1 - weight) * experts by their normalised probabilities; a
    missing expert is the global one."""
    total = F.greatest(sum((F.coalesce(p, F.lit(0.0)) for p in probs.values()), F.lit(0.0)), F.lit(1e-12))
    mixed = sum((F.coalesce(p, F.lit(0.0)) / total * (global_pred if experts.get(r) is None else F.coalesce(experts[r], global_pred)) for r, p in probs.items()), F.lit(0.0))
    return weight * global_pred + (1 - weight) * mixed


def signal(rows: DataFrame, least: float = 1.0, skip: str = "macro", date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Positions and growth of 1 of four rules: buy and hold; long where the forecast is
    above 0, else out; long or short on forecasts of `least` or more; the same but
    out in one regime."""
    strong = F.when(F.abs("y_pred") >= least, F.signum("y_pred")).otherwise(0.0)
    w = over(date, by)
    rules = {"buyhold": F.lit(1.0), "naive": F.when(F.col("y_pred") > 0, 1.0).otherwise(0.0), "filtered": strong, "regime_filtered": F.when(F.col("regime") == skip, 0.0).otherwise(strong)}
    rows = rows.withColumns({f"signal_{k}": position for k, position in rules.items()}).withColumns({f"_{k}": position * F.col("y_true") for k, position in rules.items()})
    return rows.select("*", *((growth(F.col(f"_{k}"), w) + 1).alias(f"growth_{k}") for k in rules)).drop(*(f"_{k}" for k in rules))


def trades(signals: DataFrame, rule: str = "filtered") -> DataFrame:
    """Of a rule of signal(): weeks, trades, long and short ones, and the share of trades
    whose forecast has the sign of the return (null without trades)."""
    position = F.col(f"signal_{rule}")
    right = F.when(position != 0, (F.signum("y_pred") == F.signum("y_true")).cast("double"))
    return signals.agg(F.count("*").alias("n"), *(F.count(F.when(c, 1)).alias(k) for k, c in (("n_trades", position != 0), ("n_long", position == 1), ("n_short", position == -1))), F.avg(right).alias("dir_acc"))


def composed(rows: DataFrame, base: list[str]) -> list[str]:
    """The numeric columns of base, and those that the regimes add; sorted, each once."""
    extra = [c for c in rows.columns if c.endswith("_regime_adj") or c.startswith("regime_prob_") or c in ("regime_sent_mult", "regime_switched")]
    numeric = {f.name for f in rows.schema.fields if f.dataType.typeName() in ("byte", "short", "integer", "long", "float", "double", "decimal")}
    return sorted({c for c in (*base, *extra) if c in numeric})
