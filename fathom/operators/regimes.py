"""Market regimes: volatility bins, rule scores, a hidden Markov model, adjustments."""

from __future__ import annotations

import itertools
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fathom.functions.text import first_of_largest, softmax
from fathom.operators import markov
from fathom.operators.series import over

REGIMES = ["supply", "demand", "macro", "risk_off"]
#: Weights of sentiment in each regime, and weeks of its decay.
MULTIPLIERS = {"supply": 1.10, "demand": 1.00, "macro": 0.65, "risk_off": 0.50}
DECAY_WEEKS = {"supply": 6, "demand": 4, "macro": 2, "risk_off": 1}


def volatility_regime(rows: DataFrame, column: str = "realized_vol", low: float = 0.33, high: float = 0.66) -> DataFrame:
    """vol_regime 0, 1 or 2 by quantiles of the whole column (bins closed on the right)
    and its one-hots; null and 0 where the volatility is null."""
    q = rows.agg(F.percentile(column, F.array(F.lit(low), F.lit(high))).alias("q")).scalar()
    rows = rows.withColumn("_q", q)
    regime = F.when(F.col(column) <= F.col("_q")[0], 0).when(F.col(column) <= F.col("_q")[1], 1).when(F.col(column).isNotNull(), 2)
    rows = rows.withColumn("vol_regime", regime).drop("_q")
    return rows.select("*", *(F.coalesce((F.col("vol_regime") == k).cast("int"), F.lit(0)).alias(f"vol_regime_{name}") for k, name in enumerate(("low", "mid", "high"))))


def _robust(columns: list[str]) -> dict[str, Column]:
    q = {c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in columns}
    return {c: F.when(F.count(c) > 0, F.array(q[c][1], F.greatest(q[c][2] - q[c][0], F.lit(1e-6)))).otherwise(F.array(F.lit(0.0), F.lit(1.0))) for c in columns}


def robust_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column an array of the median and the interquartile range,
    at least 1e-6; (0, 1) for a column of nulls."""
    return rows.agg(*(c.alias(n) for n, c in _robust(columns).items()))


def rule_scores(rows: DataFrame, groups: dict[str, dict[str, float]], muted: str, train: DataFrame | None = None, band: float = 0.5, by: tuple[str, ...] = ()) -> DataFrame:
    """regime_score_*, regime_prob_* and regime: the score of a group is the weighted sum
    of its columns' robust z-scores (0 for a missing column), that of `muted` the
    negative sum of the others' magnitudes times `band`. Medians and ranges are those of
    train, or of the rows themselves, and of each part that `by` tells apart."""
    held = sorted({c for weights in groups.values() for c in weights if c in rows.columns})
    source = rows if train is None else train
    if by:
        stats = source.groupBy(*by).agg(*(c.alias(f"_s_{n}") for n, c in _robust(held).items()))
        rows = rows.join(stats, list(by), "left")
    else:
        stats = robust_stats(source, held)
        rows = rows.withColumns({f"_s_{c}": stats.select(c).scalar() for c in held})

    def z(c: str) -> Column:
        return (F.coalesce(F.col(c), F.col(f"_s_{c}")[0]) - F.col(f"_s_{c}")[0]) / F.col(f"_s_{c}")[1] if c in held else F.lit(0.0)

    scores = {g: sum((z(c) * w for c, w in weights.items()), F.lit(0.0)) for g, weights in groups.items()}
    rows = rows.withColumns({f"regime_score_{g}": s for g, s in scores.items()}).drop(*(f"_s_{c}" for c in held))
    rows = rows.withColumn(f"regime_score_{muted}", -band * sum((F.abs(f"regime_score_{g}") for g in groups), F.lit(0.0)))
    names = [*groups, muted]
    rows = rows.withColumns({f"regime_prob_{g}": p for g, p in zip(names, softmax([F.col(f"regime_score_{g}") for g in names]), strict=True)})
    return rows.withColumn("regime", first_of_largest(names, [F.col(f"regime_prob_{g}") for g in names]))


def switched(regime: str, date: str = "date", by: tuple[str, ...] = (), before: str | None = None) -> Column:
    """1 where the regime differs from that of the row before; the first row differs
    unless `before` says what came ahead of it."""
    last = F.lag(regime, 1, before).over(over(date, by)) if before else F.lag(regime).over(over(date, by))
    return F.coalesce(F.col(regime) != last, F.lit(True)).cast("int")


def adjusted(rows: DataFrame, decayed: list[str], plain: list[str], reset: float = 0.35, multipliers: dict[str, float] = MULTIPLIERS, date: str = "date", by: tuple[str, ...] = (), before: str | None = None) -> DataFrame:
    """Sentiment by regime: times its multiplier (1 if unknown); what carries over
    also loses `reset` where the regime switches. before: the regime ahead of the rows."""
    table = F.create_map(*(F.lit(x) for pair in multipliers.items() for x in pair))
    rows = rows.withColumn("regime_switched", switched("regime", date, by, before)).withColumn("regime_sent_mult", F.coalesce(table[F.col("regime")], F.lit(1.0)))
    kept = F.col("regime_sent_mult") * (1 - F.col("regime_switched") * reset)
    return rows.select("*", *((F.coalesce(F.col(c), F.lit(0.0)) * kept).alias(f"{c}_regime_adj") for c in decayed), *((F.coalesce(F.col(c), F.lit(0.0)) * F.col("regime_sent_mult")).alias(f"{c}_regime_adj") for c in plain))


def assignment(scores: np.ndarray) -> tuple[int, ...]:
    """The column of each row in the one-to-one assignment with the largest sum."""
    n = len(scores)
    return max(itertools.permutations(range(scores.shape[1]), n), key=lambda p: sum(scores[i, p[i]] for i in range(n)))


#: What tells the regimes of a driver model apart: column, weight, whether its magnitude counts.
DRIVER_SCORES = {
    "supply": (("opec_event_day", 1, False), ("disruption_event_day", 1, False), ("disruption_intensity", 1, False)),
    "demand": (("spx_ret_pct", 1, False), ("inventory_chg_kb", -1, False)),
    "macro": (("usd_mom_4w", 1, True), ("yield_10y_chg", 1, True)),
    "risk_off": (("realized_vol", 1, False), ("negative_ratio", 1, False), ("negative_mean", 1, False)),
}


def named(means: np.ndarray, columns: list[str], scores: dict = DRIVER_SCORES) -> list[str]:
    """The regime of each state: the one-to-one assignment with the largest sum of scores,
    made of the states' means (a row each) over their largest magnitude."""
    share = {c: means[:, j] / max(np.abs(means[:, j]).max(), 1e-6) for j, c in enumerate(columns)}
    value = lambda c, w, size: w * (np.abs(share[c]) if size else share[c])
    table = np.stack([sum((value(*x) for x in terms if x[0] in share), np.zeros(len(scores))) for terms in scores.values()], axis=1)
    return [list(scores)[j] for j in assignment(table)]


class DriverRegimes:
    """Named regimes of a four-state model with diagonal covariances over standardised
    drivers of some hundred rows, the training weeks of a fold; nulls are 0."""

    def __init__(self, x: np.ndarray, columns: list[str], scores: dict = DRIVER_SCORES):
        x = np.nan_to_num(x)
        self.mean, std = x.mean(axis=0), x.std(axis=0)
        self.std = np.where(std > 0, std, 1.0)
        self.states, self.seen = markov.fitted((x - self.mean) / self.std, markov.Settings(len(scores), diagonal=True))
        self.names = named(self.states.mean * self.std + self.mean, columns, scores)

    def infer(self, x: np.ndarray) -> tuple[list[str], dict[str, np.ndarray]]:
        """(regime of each row, probabilities of each regime)."""
        path, post = markov.decoded(self.states, (np.nan_to_num(x) - self.mean) / self.std)
        return [self.names[k] for k in path], {name: post[:, k] for k, name in enumerate(self.names)}


class DriverModels(NamedTuple):
    """The models of driver_models(): moments (key, mean, std) of the drivers, blocks of the
    standardised rows, fits, and the regimes' names of each series by state."""

    columns: list[str]
    moments: dict[str, tuple[np.ndarray, np.ndarray]]
    packed: DataFrame
    fits: markov.Fits
    names: dict[str, list[str]]


def driver_models(rows: DataFrame, columns: list[str], scores: dict = DRIVER_SCORES, date: str = "date", key: str = "series", least: int = 40, block: int = markov.BLOCK) -> DriverModels:
    """A model of named regimes for each series of `least` rows or more, over its drivers
    less their mean and over their deviation; nulls are 0. Long series are fitted in blocks
    of time; the driver holds the models, some hundred numbers a series."""
    flat = rows.select(F.col(key).cast("string").alias(key), date, *(F.nanvl(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in columns)).where(F.col(key).isNotNull())
    moments = flat.groupBy(key).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns)).where(F.col("_n") >= least)
    held = {r[key]: (np.array([r[f"_m_{c}"] for c in columns]), np.array([r[f"_s_{c}"] or 1.0 for c in columns])) for r in moments.collect()}
    scaled = flat.join(moments, key).select(key, date, *(((F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)).alias(c) for c in columns))
    packed = markov.blocks(scaled, columns, date, key, block)
    fits = markov.fit(packed, markov.Settings(len(scores), diagonal=True), len(columns), key)
    return DriverModels(columns, held, packed, fits, {k: named(m.mean * held[k][1] + held[k][0], columns, scores) for k, m in fits.models.items()})


def driver_regime(rows: DataFrame, columns: list[str], scores: dict = DRIVER_SCORES, date: str = "date", key: str = "series", block: int = markov.BLOCK, models: DriverModels | None = None) -> DataFrame:
    """(key, date, regime, regime_prob_*) of each row, by the models of its series; nulls
    where the series has none. (key, date) tells rows apart."""
    models = driver_models(rows, columns, scores, date, key, block=block) if models is None else models
    probs = [f"regime_prob_{r}" for r in scores]
    states = rows.sparkSession.createDataFrame([(k, n, [n.index(r) for r in scores]) for k, n in models.names.items()], f"{key} string, _names array<string>, _at array<int>")
    found = markov.inferred(models.packed, models.fits.models, date, key).join(F.broadcast(states), key)
    found = found.select(key, date, F.col("_names")[F.col("state")].alias("regime"), *(F.col("probs")[F.col("_at")[j]].alias(p) for j, p in enumerate(probs)))
    return rows.select(F.col(key).cast("string").alias(key), date).join(found, [key, date], "left")


def state_report(models: DriverModels, spark: SparkSession, key: str = "series") -> DataFrame:
    """(key, regime, decay_weeks, moves, means): for each regime of each series the weeks of
    its sentiment's decay, its chances of moving to each regime, and the mean of each driver
    in its own units, to three places."""
    rows = []
    for k, m in models.fits.models.items():
        mean, std = models.moments[k]
        for state, name in enumerate(models.names[k]):
            moves = {n: round(float(p), 3) for n, p in zip(models.names[k], m.move[state], strict=True)}
            rows.append((k, name, DECAY_WEEKS.get(name), moves, {c: round(float(v), 3) for c, v in zip(models.columns, m.mean[state] * std + mean, strict=True)}))
    return spark.createDataFrame(rows, f"{key} string, regime string, decay_weeks int, moves map<string,double>, means map<string,double>")


def regime_means(rows: DataFrame, columns: list[str], regime: str = "regime") -> DataFrame:
    """Rows and mean drivers of each regime, to three places."""
    return rows.groupBy(regime).agg(F.count("*").alias("n_weeks"), *(F.round(F.avg(c), 3).alias(c) for c in columns))


def markov_regime(rows: DataFrame, columns: list[str], states: int = 3, date: str = "date", key: str = "series", block: int = markov.BLOCK) -> DataFrame:
    """(key, date, hmm_regime, hmm_prob_*) of each row, by a model of its series, however
    many series there are and however long they are. Rows with nulls, and those of
    series with fewer than five whole rows a state, get null and 0. (key, date) tells rows apart."""
    flat = rows.select(F.col(key).cast("string").alias(key), date, *columns)
    whole = flat.dropna(subset=[key, *columns])
    enough = whole.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") >= 5 * states)
    packed = markov.blocks(whole.join(enough, key, "left_semi"), columns, date, key, block)
    found = markov.inferred(packed, markov.fit(packed, markov.Settings(states), len(columns), key).models, date, key)
    out = flat.select(key, date).join(found, [key, date], "left")
    return out.select(key, date, F.col("state").alias("hmm_regime"), *(F.coalesce(F.col("probs")[k], F.lit(0.0)).alias(f"hmm_prob_{k}") for k in range(states)))


def transitions(rows: DataFrame, regime: str, date: str = "date", by: tuple[str, ...] = ()) -> DataFrame:
    """Shares of the moves from each regime."""
    moves = rows.where(F.col(regime).isNotNull()).withColumn("to", F.lead(regime).over(over(date, by))).where("`to` is not null")
    counts = moves.groupBy(F.col(regime).alias("from"), "to").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("from")))
